"""V2, V3, V5: result sets stored with a tree of digests, so that two of them are compared from the top down.

Members are hashed; a node stands for all hashes that begin with its hexadecimal digits and holds their
number and two sums, which need no order and merge. Leaves lie sorted in folders by their first two
digits. A comparison reads a level's nodes only below nodes that differ, and members only in the last
level's ranges that differ, so what is read grows with the difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.scratch import folder

#: Members in a range of the last level, about.
RANGE = 64
FOLDER_DIGITS = 2
MEMBERS = "member string, h string, top string"
NODES = "node string, n bigint, a decimal(38,0), b decimal(38,0)"


def store(members: DataFrame, key: str, path: str, ranges: int | None = None) -> int:
    """Writes the different members and the digests of all levels; gives the number of levels. ``ranges`` sets that of another set to compare with."""
    rows = members.select(F.col(key).cast("string").alias("member")).where("member is not null").distinct().withColumn("h", F.sha2("member", 256))
    rows.withColumn("top", F.substring("h", 1, FOLDER_DIGITS)).repartition("top").sortWithinPartitions("top", "h").write.partitionBy("top").parquet(f"{path}/members")
    saved = members.sparkSession.read.schema(MEMBERS).parquet(f"{path}/members")
    depth = ranges
    while depth is None:
        n, k = saved.count() // RANGE, 1
        while 16**k < n:
            k += 1
        depth = max(k, FOLDER_DIGITS)
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    level = saved.groupBy(F.substring("h", 1, depth).alias("node")).agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(17)).alias("b"))
    for k in range(depth, -1, -1):
        level.write.parquet(f"{path}/nodes/level={k}")
        level = members.sparkSession.read.schema(NODES).parquet(f"{path}/nodes/level={k}").groupBy(F.substring("node", 1, k - 1 if k else 0).alias("node")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return depth


def differing(spark: SparkSession, before: str, after: str, depth: int) -> list[DataFrame]:
    """For each level the nodes that differ, found below those of the level above."""
    nodes = lambda path, k: spark.read.schema(NODES).parquet(f"{path}/nodes/level={k}")
    out: list[DataFrame] = []
    root = folder(spark, "members")
    for k in range(depth + 1):
        one, two = nodes(before, k), nodes(after, k)
        if out:
            above = out[-1].select(F.col("node").alias("_up"))
            one, two = (x.join(above, F.substring("node", 1, k - 1) == F.col("_up"), "left_semi") for x in (one, two))
        both = one.select("node", F.struct("n", "a", "b").alias("x")).join(two.select("node", F.struct("n", "a", "b").alias("y")), "node", "full")
        both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node").write.parquet(f"{root}/{k}")
        out.append(spark.read.schema("node string").parquet(f"{root}/{k}"))
        if not out[-1].limit(1).count():
            break
    return out


def changes(spark: SparkSession, before: str, after: str, depth: int, listed: int = 1000) -> DataFrame:
    """(member, change): added and removed members of two stored sets of one depth. Up to ``listed`` ranges are named in the filter, so that files and row groups are skipped; more are joined."""
    last = differing(spark, before, after, depth)[-1]
    read = lambda path: spark.read.schema(MEMBERS).parquet(f"{path}/members")
    few = [r.node for r in last.limit(listed + 1).collect()]  # bounded by listed
    if len(few) <= listed:
        ends = [(x, x + "g") for x in few]  # "g" follows all digits
        within = F.lit(False)
        for a, b in ends:
            within = within | F.col("h").between(a, b)
        some = lambda path: read(path).where(F.col("top").isin([x[:FOLDER_DIGITS] for x in few]) & within)
    else:
        some = lambda path: read(path).join(last, F.substring("h", 1, depth) == F.col("node"), "left_semi")
    a, b = some(before).select("h", "member"), some(after).select("h", "member")
    return b.join(a, "h", "left_anti").select("member", F.lit("added").alias("change")).union(a.join(b, "h", "left_anti").select("member", F.lit("removed").alias("change")))


class Standing:
    """A watched result: its baseline is the set stored last, and each evaluation becomes the next."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _known(self) -> list:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sets")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return []
        return self.spark.read.schema("number long, depth int, batch string").json(f"{self.path}/sets").orderBy("number").collect()  # a row for each evaluation

    def advance(self, members: DataFrame, key: str, batch: str | None = None) -> DataFrame | None:
        """Stores the members and gives what changed since the baseline; None for the first set, and for a batch that was taken before."""
        known = self._known()
        if batch is not None and any(x.batch == batch for x in known):
            return None
        number, before = len(known), known[-1] if known else None
        depth = store(members, key, f"{self.path}/{number}", before.depth if before else None)
        self.spark.createDataFrame([(number, depth, batch)], "number long, depth int, batch string").coalesce(1).write.mode("append").json(f"{self.path}/sets")
        return None if before is None else changes(self.spark, f"{self.path}/{before.number}", f"{self.path}/{number}", depth)
