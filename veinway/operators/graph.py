"""Graph measures and traversals over (etype, src, dst, confidence, last_seen)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.lineage import pinned
from veinway.operators.frontier import FEW, among, walk
from veinway.operators.upserts import swapped

def with_owner(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds the owner of each node, where an owning edge names one: the least of several."""
    one = owners.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("owner"))
    return found.join(one, "node", "left")


def hub_degree(edges: DataFrame) -> DataFrame:
    """(id, degree, score): distinct edges at either end, and the degree over the largest."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("id"))
    degrees = ends.groupBy("id").agg(F.count("*").alias("degree"))
    most = degrees.agg(F.max("degree").alias("most"))
    return degrees.crossJoin(F.broadcast(most)).select("id", "degree", F.round(F.col("degree") / F.col("most"), 4).alias("score"))


def ranked(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The n largest scores with their rank from 1; ties by id."""
    top = scores.orderBy(F.desc(score), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def ends(edges: DataFrame) -> DataFrame:
    """(id, inner) of everything at either end of an edge, stored; inner is what edges both enter and leave. Edges without an end are left out."""
    both = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(
        F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("left")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("left")))).alias("end")
    )
    return pinned(both.groupBy("end.id").agg((F.bool_or("end.left") & ~F.bool_and("end.left")).alias("inner")))


def betweenness(edges: DataFrame, pivots: DataFrame | None, nodes: DataFrame | None = None) -> DataFrame:
    """(id, score): share of shortest paths through each node, from the pivots (id), scaled up to all nodes as sources; None takes every node.

    Brandes' sums, a level at a time for all pivots at once. Forwards, each level holds for each
    pivot and node how many shortest paths lead there; backwards, a node gets from each node a
    step further the share of that one's paths that it is on. Nodes that edges enter and leave alone lie
    on a path, so the first level holds those; whether a node was reached in one step, the edges themselves tell.
    State is one row for each pivot and such node that it reaches, and for each further node; steps after the
    first go over the edges that leave inner nodes, which are stored. Edges are read four times, so
    those that are dear to work out should be stored; they may repeat. `nodes` are their `ends`, where the caller
    has them. Pivots that are in no edge count for nothing; edges without an end are left out.
    """
    pairs = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    nodes = ends(edges) if nodes is None else nodes
    n = asked = nodes.count()
    started = pairs
    if pivots is not None:
        wanted = pinned(pivots.select("id").distinct())
        asked = nodes.join(wanted, "id", "left_semi").count()
        keep, exact = among(wanted)
        started = keep(pairs, "src") if exact else keep(pairs, "src").join(wanted.withColumnRenamed("id", "src"), "src", "left_semi")
    keep, _ = among(pinned(nodes.filter("inner").select("id")))
    inner = near = pinned(keep(pairs, "src").distinct())
    keep_met, _ = among(inner.select("dst"))
    direct = pinned(keep_met(started, "dst").select(F.col("src").alias("pivot"), F.col("dst").alias("node")))
    level = pinned(keep(started, "dst").distinct().select(F.col("src").alias("pivot"), F.col("dst").alias("node"), F.lit(1.0).alias("paths")))
    levels, leaving = [level], []
    while True:
        small = near.count()
        if not small:
            break
        near = F.broadcast(near) if small <= FEW else near
        keep, _ = among(near.select("dst"))  # visits of what this step may reach
        visited = keep(direct, "node")
        for each in levels[1:]:
            visited = visited.unionAll(keep(each.select("pivot", "node"), "node"))
        reached = level.join(near, F.col("node") == F.col("src")).filter("pivot <> dst").groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = pinned(reached.join(visited, ["pivot", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        leaving.append(near)
        keep, _ = among(level.select("node"))
        near = pinned(keep(inner, "src"))
    further, total = levels[-1].withColumn("part", F.lit(0.0)), None
    for at in range(len(leaving) - 1, -1, -1):
        each = further.select("pivot", F.col("node").alias("dst"), ((1 + F.col("part")) / F.col("paths")).alias("each"))
        how = "left" if at else "inner"  # the level before needs nodes without a step further as well
        steps = levels[at].join(leaving[at], F.col("node") == F.col("src"), how).select("pivot", "node", "dst", "paths").join(each, ["pivot", "dst"], how)
        parts = steps.select("pivot", "node", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("part"))
        if at:
            parts = further = pinned(parts.groupBy("pivot", "node").agg(F.max("paths").alias("paths"), F.sum("part").alias("part")))
        rows = parts.select(F.col("node").alias("id"), "part").filter("part > 0")
        total = rows if total is None else total.unionAll(rows)
    if total is None:
        total = nodes.limit(0).select("id", F.lit(0.0).alias("part"))
    size = max(1, (n - 1) * (n - 2)) * max(1, asked) / max(1, n)
    return total.groupBy("id").agg(F.round(F.sum("part") / size, 8).alias("score"))


def flows(edges: DataFrame, entries: DataFrame, max_depth: int, store: bool = True) -> DataFrame:
    """(entry, node, depth, position): calls reached from each entry, in order of discovery; flows of one node are left out. `store` is that of `walk`."""
    reached = walk(edges.filter(F.col("etype") == "CALLS"), entries.select(F.col("id").alias("seed")), max_depth, store=store)
    found = reached.select(F.col("seed").alias("entry"), "node", "depth")
    starts = found.select("entry").distinct().select("entry", F.col("entry").alias("node"), F.lit(0).alias("depth"))
    every = starts.unionByName(found)
    return every.withColumn("position", F.row_number().over(Window.partitionBy("entry").orderBy("depth", "node")) - 1)


def criticality(members: DataFrame, risks: DataFrame, fan_in: DataFrame, secure: Column) -> DataFrame:
    """(entry, node_count, criticality): .4 fan-in of the entry to 10, .4 mean risk, .2 security, at most 1."""
    joined = members.join(risks, members.node == risks.id, "left").withColumn("secure", secure)
    per = joined.groupBy("entry").agg(F.count("*").alias("node_count"), F.avg("risk_score").alias("risk"), F.max("secure").alias("secure"))
    scored = per.join(fan_in.withColumnRenamed("id", "entry"), "entry", "left")
    value = (
        F.least(F.coalesce("fan_in", F.lit(0)) / 10.0, F.lit(1.0)) * 0.4 + F.coalesce("risk", F.lit(0.0)) * 0.4
        + F.when(F.col("secure"), 0.2).otherwise(0.0)
    )
    return scored.select("entry", "node_count", F.round(F.least(value, F.lit(1.0)) + 1e-9, 3).alias("criticality"))


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct edges (seed, src, dst) at a seed or at one of its direct neighbours, either way. Edges may repeat.

    Edges that meet by their target are one for each (seed, src, dst) where they met; of those that meet by
    their source, the ones whose target is a neighbour as well are among them already.
    """
    pairs, asked = edges.select("src", "dst"), pinned(seeds.select("seed").distinct())
    keep, _ = among(asked)
    side = lambda x, y: keep(pairs, x).select(F.col(x).alias("seed"), F.col(y).alias("x")).join(asked, "seed", "left_semi")
    near = pinned(asked.select("seed", F.col("seed").alias("x")).unionAll(side("src", "dst")).unionAll(side("dst", "src")).distinct())
    keep, _ = among(near.select("x"))
    at = lambda end: keep(pairs, end).join(near, F.col("x") == F.col(end)).select("seed", "src", "dst").distinct()
    return at("dst").unionAll(at("src").join(near.select("seed", F.col("x").alias("dst")), ["seed", "dst"], "left_anti").select("seed", "src", "dst"))


def closure(edges: DataFrame, entries: DataFrame, store: bool = True) -> DataFrame:
    """(id) of everything that the entries reach, to the fixpoint, however far away it is.

    Only edges that may leave what was reached last are shuffled. `store` tells that edges, which are read for each step,
    are dear to work out, so that is done once. Edges may repeat.
    """
    visited = frontier = pinned(entries.select("id").distinct())
    edges = pinned(edges.select("src", "dst")) if store else edges.select("src", "dst")
    while True:
        keep, _ = among(frontier)
        frontier = pinned(
            frontier.join(keep(edges, "src"), F.col("id") == F.col("src"), "inner").select(F.col("dst").alias("id")).distinct().join(visited, "id", "left_anti")
        )
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
    return visited


def reachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame, keep: Column, attach: list[str], most_dropped: float = 0.9, store: bool = True) -> DataFrame:
    """Nodes that entries reach, that attach to those by a reverse edge of given types, or that are always kept.

    Where there are no entries, or more than `most_dropped` of the nodes would go, all nodes stay.
    `store` is that of `closure`.
    """
    if entries.isEmpty():
        return nodes
    core = closure(edges, entries, store)
    attached = edges.filter(F.col("etype").isin(attach)).join(core, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"))
    wanted = core.unionAll(attached).distinct().withColumn("_wanted", F.lit(True))
    kept = pinned(nodes.join(wanted, "id", "left").filter(F.col("_wanted").isNotNull() | keep).select(*nodes.columns))
    total, left = nodes.count(), kept.count()
    return nodes if total and (total - left) / total > most_dropped else kept


def dirty_set(edges: DataFrame, changed: DataFrame, kinds: list[str], hops: int = 2) -> DataFrame:
    """(node, depth): changed nodes and what depends on them over so many reverse hops; depth is the least."""
    back = swapped(edges.filter(F.col("etype").isin(kinds)))
    frontier = changed.select(F.col("id").alias("node")).distinct()
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        frontier = pinned(
            frontier.join(back, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            .join(visited, "node", "left_anti")
        )
        visited = visited.unionAll(frontier.withColumn("depth", F.lit(depth)))
    return visited


def causal_chain(events: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, event_id, hops): ancestors over `parent` of each start event, up to so many steps back, the start included."""
    parents = events.filter("parent IS NOT NULL").select(F.col("event_id").alias("src"), F.col("parent").alias("dst"), F.lit("CAUSED").alias("etype"), F.lit(1.0).alias("confidence"))
    reached = walk(parents, starts.select(F.col("event_id").alias("seed")), most)
    own = starts.select(F.col("event_id").alias("start"), "event_id", F.lit(0).alias("hops"))
    return own.unionAll(reached.select(F.col("seed").alias("start"), F.col("node").alias("event_id"), F.col("depth").alias("hops")))


def causal_walk(events: DataFrame, starts: DataFrame, most: int = 20) -> DataFrame:
    """(start, event_id, popped) of what a queue reaches over all parents of events (event_id, parents) with `most` expansions for each start.

    A start's queue gives its events in the order in which they came in; each takes one expansion, and
    its known parents that have not been seen come in, in the order in which it names them. `popped` is the
    number of an event's expansion from 1, null for those that the budget did not reach. The budget is of expansions, not of
    levels: a level is expanded in the queue's order as far as the budget goes. Nobody's
    state is larger than the budget and its parents. Null and unknown parents are left out.
    """
    steps = events.select(F.col("event_id").alias("node"), F.posexplode("parents").alias("place", "parent")).dropna()
    steps = pinned(steps.join(events.select(F.col("event_id").alias("parent")).distinct(), "parent", "left_semi"))
    level = starts.select(F.col("event_id").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(1).alias("popped"))
    level = pinned(level.join(events.select(F.col("event_id").alias("node")).distinct(), "node", "left_semi").select("start", "node", "popped"))
    visited, out, before = level.select("start", "node"), [level], level.select("start", F.lit(1).alias("pops"))
    while True:
        met = level.filter(F.col("popped") <= most).join(steps, "node").groupBy("start", F.col("parent").alias("node")).agg(F.min(F.struct("popped", "place")).alias("at"))
        new = met.join(visited, ["start", "node"], "left_anti").join(before, "start")
        rank = F.row_number().over(Window.partitionBy("start").orderBy("at", "node"))
        level = pinned(new.select("start", "node", (F.col("pops") + rank).alias("popped")))
        if level.isEmpty():
            break
        out.append(level)
        visited = visited.unionAll(level.select("start", "node"))
        before = pinned(before.join(level.groupBy("start").agg(F.max("popped").alias("last")), "start").select("start", F.col("last").alias("pops")))
    every = out[0]
    for rows in out[1:]:
        every = every.unionAll(rows)
    return every.select("start", F.col("node").alias("event_id"), F.when(F.col("popped") <= most, F.col("popped")).alias("popped"))


def uncovered_callers(edges: DataFrame, sites: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, uncovered): direct callers of throwing sites that no covering edge protects, counted per site."""
    callers = edges.filter(F.col("etype") == "CALLS").join(sites.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    left = callers.join(covered.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("uncovered"))


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, hot: int) -> DataFrame:
    """(id, gap): isolated nodes of degree 1 at most, and hot ones with at least `hot` callers and no risk score."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    callers = edges.filter(F.col("etype") == "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    joined = nodes.join(ends, "id", "left").join(callers, "id", "left")
    gap = F.when(F.coalesce("degree", F.lit(0)) <= 1, "isolated").when((F.coalesce("callers", F.lit(0)) >= hot) & F.col("risk_score").isNull(), "unscored_hotspot")
    return joined.withColumn("gap", gap).filter("gap IS NOT NULL").select("id", "gap")
