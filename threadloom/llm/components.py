"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch


def components(links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): label is the least node of its component.

    In each round a node takes the least label among itself and its neighbours, then its label's
    label. Rounds end when none changes. Every join's sides can be split where a node is frequent.
    """
    both = work.save(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-both")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = work.save(labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("lower")), f"{name}-{k}-lower")
        jump = lower.select(F.col("node").alias("at"), F.col("lower").alias("further"))
        moved = lower.join(jump, lower["lower"] == jump["at"], "left")
        new = work.save(moved.select("node", "label", F.least("lower", F.coalesce("further", "lower")).alias("new")), f"{name}-{k}")
        changed = new.where("new <> label").limit(1).count()
        work.drop(f"{name}-{k}-lower", *[f"{name}-{k - 1}"])
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
