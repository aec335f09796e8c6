"""Lineage and links: roots, descendants, threads, composed transcripts, components and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.scratch import folder
from threadloom.scratch import written as _keep


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that has a row for each node: never sent to the driver to be broadcast, however well it is packed on disk."""
    return df.hint("merge")


def roots(edges: DataFrame) -> DataFrame:
    """L1: (node, root, depth) for every node of (node, parent), parent null at a root.

    Each round follows all walks on and doubles the distance covered, until none moves. A walk that
    meets an unknown parent ends there; one that runs into a cycle has no root (null, as its depth).
    """
    root = folder(edges.sparkSession, "graph")
    at = _keep(edges.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.lit(True).alias("moved")), f"{root}/0")
    nodes, reach, k = at.count(), 1, 0
    while True:
        far = at.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        k += 1
        at = _keep(at.join(_large(far), "up", "left").select("node", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")), f"{root}/{k}")
        if reach > nodes or not at.where("moved").limit(1).count():  # a walk of more steps than nodes is in a cycle
            return at.select("node", F.when(~F.col("moved"), F.col("up")).alias("root"), F.when(~F.col("moved"), F.col("depth")).alias("depth"))
        reach *= 2


def threads(edges: DataFrame) -> DataFrame:
    """L4: size and depth of each root's family."""
    return roots(edges).where("root is not null").groupBy("root").agg(F.count("*").alias("members"), F.max("depth").alias("depth"))


def thread_report(sessions: DataFrame) -> DataFrame:
    """L4: each root's family with leaves, bounds, cost, most common repository and how well it is supported.

    sessions: (node, parent, started, ended, cost, repo). A session whose parent is not known is a root.
    """
    root = folder(sessions.sparkSession, "threads")
    known = sessions.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    own = _keep(sessions.join(_large(known), "parent", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known"), f"{root}/sessions")
    parents = own.select(F.col("parent").alias("node"), F.lit(True).alias("_has")).where("node is not null").distinct()
    placed = _keep(roots(own.select("node", "parent")).where("root is not null").join(_large(own), "node").join(_large(parents), "node", "left"), f"{root}/placed")
    repo = placed.where("repo is not null").groupBy("root", "repo").agg(F.count("*").alias("_n")).groupBy("root").agg(F.min(F.struct((-F.col("_n")).alias("n"), "repo"))["repo"].alias("dominant_repo"))
    whole = placed.groupBy("root").agg(F.count("*").alias("members"), F.max("depth").alias("depth"), F.count_if(F.col("_has").isNull()).alias("branch_count"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("cost").alias("cost"))
    many = F.col("members") > 1
    signals = F.array_compact(F.array(F.lit("explicit_lineage"), F.when(many, "multi_session_thread"), F.when(F.col("branch_count") > 1, "branching_continuations"), F.when(F.col("dominant_repo").isNotNull(), "dominant_repo"), F.when(F.col("started").isNotNull() & F.col("ended").isNotNull(), "wallclock_bounds")))
    return whole.join(repo, "root", "left").select("*", F.when(many, "strong").otherwise("moderate").alias("support"), F.when(many, 1.0).otherwise(0.85).alias("confidence"), signals.alias("signals"))


def descendants(edges: DataFrame, root) -> DataFrame:
    """L2: the nodes below one root, with their depth."""
    return roots(edges).where((F.col("root") == root) & (F.col("node") != root)).select("node", "depth")


def ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Per node each ancestor, itself included, with the least branch position on the way up.

    edges: (node, parent, branch), branch being the parent's last position that the node shares.
    A walk ends where it meets an ancestor again, and after ``depth`` steps if that is given. Each
    round doubles the distance covered and is a written table.
    """
    root = folder(edges.sparkSession, "graph")
    leap = edges.where("parent is not null").select("node", F.col("parent").alias("to"), F.col("branch").alias("limit"))
    out = _keep(edges.select("node", F.col("node").alias("ancestor"), F.lit(None).cast("long").alias("limit"), F.lit(0).alias("depth")).distinct(), f"{root}/0")
    reach, before, k = 1, out.count(), 0
    while depth is None or reach <= depth:
        k += 1
        leap = _keep(leap, f"{root}/leap-{k}")
        known = out.select(F.col("node").alias("to"), "ancestor", F.col("limit").alias("_limit"), (F.col("depth") + reach).alias("depth"))
        missing = leap.join(edges.select(F.col("node").alias("to")), "to", "left_anti").select("node", F.col("to").alias("ancestor"), "limit", F.lit(reach).alias("depth"))
        further = leap.join(known, "to").select("node", "ancestor", F.least("limit", "_limit").alias("limit"), "depth").unionByName(missing)
        out = _keep(out.unionByName(further).groupBy("node", "ancestor").agg(F.min_by("limit", "depth").alias("limit"), F.min("depth").alias("depth")), f"{root}/{k}")  # a cycle meets an ancestor again
        now = out.count()
        if now == before:
            break
        leap = leap.join(leap.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("limit").alias("_limit")), "to").select("node", F.col("_to").alias("to"), F.least("limit", "_limit").alias("limit"))
        before, reach = now, 2 * reach
    return out if depth is None else out.where(F.col("depth") <= depth)


def composed(messages: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Each session's transcript, its ancestors' messages up to the branch points and then its own.

    messages: (session_id, position, …), positions of a branch going on after its branch point. A
    parent that is missing adds nothing.
    """
    walk = ancestors(edges, depth)
    parts = messages.withColumnRenamed("session_id", "ancestor").join(walk, "ancestor")
    return parts.where(F.col("limit").isNull() | (F.col("position") <= F.col("limit"))).withColumnRenamed("node", "session_id").withColumnRenamed("ancestor", "from_session").drop("limit")


def lineage_state(edges: DataFrame) -> DataFrame:
    """(node, state, complete, root) of each walk up (node, parent): 'rooted', 'missing_parent' or 'cycle'; complete only where rooted."""
    known = edges.select(F.col("node").alias("root"), F.lit(True).alias("_known"))
    state = F.when(F.col("root").isNull(), "cycle").when(F.col("_known"), "rooted").otherwise("missing_parent")
    return roots(edges).join(_large(known), "root", "left").select("node", state.alias("state"), (state == "rooted").alias("complete"), "root")


def family(edges: DataFrame, seed) -> DataFrame:
    """All nodes that share the seed's root, itself included; the seed alone where it has none."""
    at = _keep(roots(edges), f"{folder(edges.sparkSession, 'graph')}/roots")
    own = at.where(F.col("node") == seed).select(F.col("root").alias("_root"))
    return at.join(own, at["root"] == own["_root"], "left_semi").select("node").union(edges.where(F.col("node") == seed).select("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """How many links enter and leave each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaves"), F.lit(1).alias("enters")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("enters").alias("in_degree"), F.sum("leaves").alias("out_degree"))


def one_hop(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Links that leave ('out'), enter ('in') or touch ('both') the nodes."""
    keys = nodes.select("node").distinct()
    out = edges.join(keys.withColumnRenamed("node", "a"), "a", "left_semi").select(*edges.columns)
    into = edges.join(keys.withColumnRenamed("node", "b"), "b", "left_semi").select(*edges.columns)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the least node reachable over links (a, b) in either direction.

    A node takes the least label of itself and its neighbours, then that label's own; each round is
    a written table, so a lost executor costs one round at most.
    """
    root = folder(edges.sparkSession, "graph")
    keep = lambda df, name: _keep(df, f"{root}/{name}")
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    at = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "0")
    k, moving = 0, True
    while moving:
        k += 1
        near = both.join(_large(at.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = at.join(_large(near), "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = at.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = keep(lower.join(_large(jump), "component", "left").select("node", "before", F.least("component", "further").alias("component")), str(k))
        moving = new.where("component <> before").limit(1).count() > 0
        at = new.select("node", "component")
    return at


def simple_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Node sets of simple cycles, of up to ``most`` nodes if that is given; a path starts at its least node.

    Rounds go on until no path can be made longer; each is a written table. Meant for graphs of item
    groups, as the number of paths grows with the degree to their length; only nodes on cycles take part.
    """
    root = folder(edges.sparkSession, "cycles")
    core = cyclic_core(edges.where("a <> b"))
    links = _keep(core.select(F.col("a").alias("_at"), F.col("b").alias("_to")), f"{root}/links")
    paths = links.where("_to > _at").select(F.array("_at", "_to").alias("path"))
    found, n = [], 2
    while True:
        paths = _keep(paths, f"{root}/{n}")
        if not paths.limit(1).count():
            break
        found.append(paths.join(links, (F.element_at("path", -1) == F.col("_at")) & (F.col("_to") == F.element_at("path", 1))).select(F.array_sort("path").alias("members")))
        if n == most:
            break
        onward = paths.withColumn("_at", F.element_at("path", -1)).join(links, "_at")
        paths, n = onward.where((F.col("_to") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("_to"))).select(F.array_append("path", F.col("_to")).alias("path")), n + 1
    if not found:
        return links.select(F.array("_at").alias("members")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def pairwise(ordered: DataFrame, key: str, item: str, rank: str) -> DataFrame:
    """From each key's ordering of few items, all (winner, loser) pairs; equal ranks give none."""
    a, b = ordered.select(key, F.col(item).alias("winner"), F.col(rank).alias("_a")), ordered.select(key, F.col(item).alias("loser"), F.col(rank).alias("_b"))
    return a.join(b, key).where("_a < _b").select(key, "winner", "loser")


def win_rates(games: DataFrame) -> DataFrame:
    """(item, wins, games, rate) from (winner, loser) rows: each game counts for both of its sides; a game against oneself is none."""
    real = games.where("winner <> loser")
    sides = real.select(F.col("winner").alias("item"), F.lit(1).alias("won")).union(real.select("loser", F.lit(0)))
    return sides.groupBy("item").agg(F.sum("won").alias("wins"), F.count("*").alias("games")).withColumn("rate", F.round(F.col("wins") / F.col("games"), 6))


#: Pairs of items in one component of comparisons, at most: a component is one row of the iteration.
PAIRS = 1_000_000


def bradley_terry(games: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(item, component, games, strength) from (winner, loser) rows, strength as a logarithm.

    Games are summed to one row for each pair of items and iterated for each component of items that
    have met, components side by side; the geometric mean of a component's strengths is held at 1.
    An item without wins keeps its strength but for that. A component of more than ``PAIRS`` pairs is refused.
    """
    root = folder(games.sparkSession, "strength")
    pairs = _keep(games.where("winner <> loser").groupBy("winner", "loser").agg(F.count("*").alias("n")), f"{root}/pairs")
    label = _keep(components(pairs.select(F.col("winner").alias("a"), F.col("loser").alias("b"))), f"{root}/labels")
    both = pairs.select(F.col("winner").alias("node"), F.col("loser").alias("other"), F.col("n").alias("wins"), "n").unionByName(pairs.select(F.col("loser").alias("node"), F.col("winner").alias("other"), F.lit(0).cast("long").alias("wins"), "n"))
    met = both.groupBy("node", "other").agg(F.sum("wins").alias("wins"), F.sum("n").alias("n")).join(label, "node")
    if met.groupBy("component").count().where(F.col("count") > 2 * PAIRS).limit(1).count():
        raise ValueError("too many pairs of items in one component")
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    placed = label.withColumn("at", place)
    named = met.join(placed.select(F.col("node").alias("other"), F.col("at").alias("of")), "other")
    item = named.groupBy("component", "node").agg(F.sum("wins").alias("wins"), F.sum("n").alias("games"), F.collect_list(F.struct("of", "n")).alias("met")).join(placed, ["component", "node"])
    group = item.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "node", "wins", "games", "met"))).alias("items"))
    new = """transform(items, i -> IF(i.wins = 0, st.s[i.at], i.wins / aggregate(i.met, 0D, (t, m) -> t + m.n / (st.s[i.at] + st.s[m.of]))))"""
    scaled = f"transform(array({new}), r -> transform(r, x -> x / exp(aggregate(r, 0D, (t, y) -> t + ln(y)) / size(r))))[0]"
    step = f"transform(array({scaled}), r -> named_struct('s', r, 'done', forall(sequence(0, size(r) - 1), k -> abs(r[k] - st.s[k]) < {tolerance}D)))[0]"
    last = F.expr(f"aggregate(sequence(1, {rounds}), named_struct('s', transform(items, i -> 1D), 'done', false), (st, k) -> IF(st.done, st, {step}))")
    out = group.select("component", "items", last["s"].alias("s")).select("component", "s", F.explode("items").alias("i"))
    return out.select(F.col("i.node").alias("item"), "component", F.col("i.games").alias("games"), F.log(F.expr("s[i.at]")).alias("strength"))


def ranker_fit(games: DataFrame, ties: DataFrame) -> DataFrame:
    """Items with component, strength, observations and ties, and a total rank by (component, strength down, item)."""
    tied = ties.select(F.explode(F.array("winner", "loser")).alias("item")).groupBy("item").agg(F.count("*").alias("ties"))
    fit = bradley_terry(games).join(tied, "item", "full").select("item", "component", F.coalesce("games", F.lit(0)).alias("games"), F.coalesce("ties", F.lit(0)).alias("ties"), "strength")
    order = Window.orderBy(F.col("component").asc_nulls_last(), F.desc("strength"), "item")  # items, not sessions
    return fit.withColumn("rank", F.row_number().over(order)).withColumn("n_observations", F.col("games") + F.col("ties"))


def edge_kind(branch: Column, missing: str = "unknown") -> Column:
    """The branch's kind; a parent without a kind is not given a narrower one."""
    return F.when(branch.isin("continuation", "sidechain", "fork", "subagent"), branch).otherwise(missing)


def topology(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst, branch) with kind and whether the parent is among nodes (node); run again once late parents have come."""
    here = nodes.select(F.col("node").alias("dst")).distinct().withColumn("_here", F.lit(True))
    return links.join(here, "dst", "left").select("src", "dst", edge_kind(F.col("branch")).alias("kind"), F.when(F.col("_here"), "resolved").otherwise("unresolved").alias("state"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (a, b) left when those without a way in or out are peeled off, which are those on cycles and from one cycle to another; none are left if, and only if, there is no cycle."""
    keep = _numbered(folder(edges.sparkSession, "core"))
    every = keep(edges.select("a", "b").distinct())
    of = keep(strong_components(edges))
    one, two = (of.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    merged = every.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    left, runs, _ = _raked(keep(merged), of.select(F.col("component").alias("node")).distinct(), keep)
    held = keep(left.select(F.col("a").alias("node")).union(left.select("b")).union(of.select("node")).distinct())
    for run in reversed(runs):  # a run is between two cycles if both its ends are
        held = keep(held.union(run.join(held.select(F.col("node").alias("up")), "up", "left_semi").join(held.select(F.col("node").alias("down")), "down", "left_semi").select("node")))
    return every.join(held.select(F.col("node").alias("a")), "a", "left_semi").join(held.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def _numbered(root: str):
    steps = iter(range(1 << 30))
    return lambda df: _keep(df, f"{root}/{next(steps)}")


def _raked(left: DataFrame, fixed: DataFrame | None, keep) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Edges (a, b) without ends and runs: nodes with one way only go, a node with one way in and one out becomes part of an edge; ``fixed`` nodes stay.

    Gives what is left, the runs in order (node, up, down: the nodes at both ends) and rings of such nodes alone (node, label).
    """
    runs, rings = [], []
    while left.limit(1).count():
        ways = left.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o")).join(left.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i")), "node", "full")
        if fixed is not None:
            ways = ways.join(fixed.withColumn("_fixed", F.lit(2)), "node", "left").select("node", *[(F.coalesce(c, F.lit(0)) + F.coalesce("_fixed", F.lit(0))).alias(c) for c in "io"])
        ways = keep(ways.where("i > 0 and o > 0"))
        chain = ways.where("i = 1 and o = 1").select("node")
        long = chain.count()
        if not long:
            inner = keep(left.join(ways.select(F.col("node").alias("a")), "a", "left_semi").join(ways.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
            if inner.count() == left.count():
                break
            left = inner
            continue
        up, down = left.select(F.col("b").alias("node"), F.col("a").alias("up")), left.select(F.col("a").alias("node"), F.col("b").alias("down"))
        at, reach, moving = keep(chain.join(up, "node").join(down, "node").withColumn("least", F.col("node"))), 1, True
        while moving and reach <= 2 * long:  # a pointer that still moves then is on a ring
            on = at.select(F.col("node").alias("down"), F.col("down").alias("_down"), F.col("least").alias("_least"))
            back = at.select(F.col("node").alias("up"), F.col("up").alias("_up"))
            at = keep(at.join(on, "down", "left").join(back, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), F.coalesce("_down", "down").alias("down"), F.least("least", F.coalesce("_least", "least")).alias("least"), (F.col("_down").isNotNull() | F.col("_up").isNotNull()).alias("moved")))
            reach, moving = reach * 2, at.where("moved").limit(1).count() > 0
        still = F.col("moved") if moving else F.lit(False)
        rings.append(at.where(still).select("node", F.col("least").alias("label")))
        runs.append(at.where(~still).select("node", "up", "down"))
        past = runs[-1].select(F.col("node").alias("b"), F.col("down").alias("_to"))
        left = keep(left.join(chain.select(F.col("node").alias("a")), "a", "left_anti").join(past, "b", "left").select("a", F.coalesce("_to", "b").alias("b")).where("a <> b").distinct())
    return left, runs, rings


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes on cycles of edges (a, b), the component being its least node.

    Nodes without a way in or out go, and runs of nodes with one way in and one way out become one
    edge each, by pointers that double their reach; trees, tails and rings so need a number of rounds
    that grows with the logarithm of their size. In what is left, colours run forward (each node takes
    the greatest that reaches it) and a component is what reaches its colour's own node backward; that
    takes rounds by the core's diameter. Each round is a written table. Edges with a null end are none.
    """
    keep = _numbered(folder(edges.sparkSession, "strong"))
    every = keep(edges.select("a", "b").where("a is not null and b is not null").distinct())
    left, runs = keep(every.where("a <> b")), []
    found = left.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    while True:
        left, more, rings = _raked(left, None, keep)
        runs += more
        for ring in rings:
            found = found.union(ring)
        if not left.limit(1).count():
            break
        ways = left.select(F.col("a").alias("node")).distinct()
        ends = lambda df, *c: [df.select(F.col("node").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in c]) for x in "ab"]
        colour = keep(ways.select("node", F.col("node").alias("colour")))
        moving = True
        while moving:
            came = left.join(colour.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("came"))
            new = keep(colour.join(came, "node", "left").select("node", F.greatest("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") > F.col("colour")).alias("moved")))
            moving = new.where("moved").limit(1).count() > 0
            colour = new.select("node", "colour")
        one, two = ends(colour, "colour")
        same = keep(left.join(one, "a").join(two, "b").where("colour_a = colour_b").select("a", "b", F.col("colour_a").alias("label")))
        front = keep(colour.where("node = colour").select("node", F.col("colour").alias("label")))
        reached = front
        while front.limit(1).count():
            back = same.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "label").distinct()
            front = keep(back.join(reached.select("node"), "node", "left_anti"))
            reached = keep(reached.union(front))
        found = keep(found.union(reached))
        out = reached.select("node")
        left = keep(left.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti"))
    for run in reversed(runs):  # a run belongs to a component if both its ends do
        label = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))  # noqa: E731, B023
        both = run.join(label("up"), "up", "left").join(label("down"), "down", "left").select("node", F.coalesce("_up", "up").alias("_up"), F.coalesce("_down", "down").alias("_down"), "up")
        held = both.where("_up = _down")
        alone = held.where("_up = up").select(F.col("up").alias("node"), F.col("up").alias("label"))  # its end's own cycle goes through it
        found = keep(found.union(held.select("node", F.col("_up").alias("label"))).union(alone).distinct())
    loops = every.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label")).join(found.select("node"), "node", "left_anti")
    sizes = found.groupBy("label").agg(F.count("*").alias("_n"), F.min("node").alias("component"))
    several = found.join(sizes.where("_n > 1"), "label").select("node", "component")
    single = found.join(sizes.where("_n = 1"), "label").join(every.where("a = b").select(F.col("a").alias("node")), "node").select("node", F.col("node").alias("component"))
    return several.union(single).union(loops.select("node", F.col("label").alias("component")))
