"""Graph operators over edges (src, dst, kind): level loops of joins, cut off from their lineage at each level.

An edge points from the dependent to what it depends on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.operators import graph_sets
from relscope.operators.lineage import cut

DEPTH_CAP = 32
#: Levels after which what was seen so far is written as one table again.
COMPACT = 16


def _grown(seen: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """seen with the rows of a level. Both are cut off already, so a union is enough but for every COMPACT-th level."""
    both = seen.union(level)
    return cut(both) if depth % COMPACT == 0 else both


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = DEPTH_CAP) -> DataFrame:
    """(root, object_id, depth, via_kind, capped): all that depends on a root, directly or not; roots (root).

    Breadth first along reversed edges. via_kind is the kind of the edge by which the search first came to the object:
    the one from the parent found earliest, then by kind. capped says that some object was found at the depth cap.
    """
    back = cut(edges.where("dst <> ''").select(F.col("dst").alias("at"), F.col("src").alias("object_id"), "kind").distinct())
    # an object's rank is the path by which it was found: of equally long paths the lesser was found earlier
    start = roots.select("root", F.col("root").alias("at"), F.array("root").alias("rank"))
    seen = cut(start.select("root", F.col("root").alias("object_id"), F.lit(0).alias("depth"), F.lit("").alias("via_kind")).distinct())
    frontier = start
    for depth in range(1, max_depth + 1):
        reached = frontier.join(back, "at").groupBy("root", "object_id").agg(F.min(F.struct("rank", "object_id", "kind")).alias("f"))
        new = reached.join(seen.select("root", "object_id"), ["root", "object_id"], "left_anti")
        level = cut(new.select("root", "object_id", F.lit(depth).alias("depth"), F.col("f.kind").alias("via_kind"), F.concat("f.rank", F.array("object_id")).alias("rank")))
        if level.isEmpty():
            break
        seen = _grown(seen, level.drop("rank"), depth)
        frontier = level.select("root", F.col("object_id").alias("at"), "rank")
    hits = seen.where("depth > 0")
    at_cap = hits.groupBy("root").agg((F.max("depth") >= max_depth).alias("capped"))
    return hits.join(at_cap, "root")


def reach(edges: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth): what each seed reaches along its outgoing (or incoming) edges, itself left out; seeds (seed)."""
    return graph_sets.closures(edges, seeds, forward, max_depth, words=1).pairs()


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[str]:
    """Ids of a shortest directed path; [start] if both are equal, [] if there is none. Ties as in shortest_paths."""
    pairs = edges.sparkSession.createDataFrame([(start, goal)], "start string, goal string")
    return [r["id"] for r in graph_sets.shortest_paths(edges, pairs).orderBy("step").select("id").collect()]  # one row a step


#: Steps that a search goes along single edges before shortcuts are laid.
PLAIN_STEPS = 6
#: Trimming and folding go on while they leave at most this share of the edges, and up to PATIENCE times in a small graph, where
#: a step costs less than a search.
FAIR, FEW, PATIENCE = 0.95, 10_000, 8


def shortcuts(edges: DataFrame) -> DataFrame:
    """(src, dst): where 2, 4, 8, ... steps lead along one chosen outgoing edge of each node, and along one incoming edge.

    Each doubling is a join of the pointers with themselves; there are as many as the longest path can need.
    """
    n = edges.select("src").distinct().count()
    found = []
    for near, far in (("src", "dst"), ("dst", "src")):
        pointer = cut(edges.groupBy(F.col(near).alias("at")).agg(F.min(far).alias("to")))
        for _ in range(max(0, n - 1).bit_length()):
            pointer = cut(pointer.join(pointer.toDF("to", "further"), "to").select("at", F.col("further").alias("to")).where("at <> to"))
            found.append(pointer.toDF(near, far).select("src", "dst"))
            if pointer.isEmpty():
                break
    return reduce(DataFrame.union, found).distinct()


def _trimmed(left: DataFrame) -> DataFrame:
    """left without edges that come from a node without a predecessor or lead to one without a successor."""
    kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return cut(kept.select("src", "dst"))


def _folded(left: DataFrame, n: int, folds: list[DataFrame]) -> DataFrame:
    """left, of n edges, without nodes that have one edge in and one out: a path of such nodes becomes one edge.

    Each step takes out the nodes with a greater hash than both neighbours, about a third, and tells the neighbours whom they
    stand next to now; so a path or cycle of m nodes takes about log m steps, and all steps together a few times its rows. What
    a step takes out is appended to folds as (id, pred, succ).
    """
    sides = left.select(F.col("dst").alias("id"), F.col("src").alias("pred"), F.lit(None).alias("succ")).union(left.select(F.col("src").alias("id"), F.lit(None).alias("pred"), F.col("dst").alias("succ")))
    ends = sides.groupBy("id").agg(F.count("pred").alias("ins"), F.count("succ").alias("outs"), F.min("pred").alias("pred"), F.min("succ").alias("succ"))
    paths = cut(ends.where("ins = 1 and outs = 1").select("id", "pred", "succ"))
    inside = paths.select("id")
    rest = left.limit(0) if paths.count() == n else left.join(inside.toDF("src"), "src", "left_anti").join(inside.toDF("dst"), "dst", "left_anti").select("src", "dst")
    # each row knows whether its neighbours are on a path (pp, sp); one message a neighbour says so
    kind = paths.schema["id"].dataType
    none, no = F.lit(None).cast(kind), F.lit(None).cast("boolean")
    line = lambda to, own, *values: F.struct(to.alias("id"), F.lit(own).alias("own"), *[v.alias(c) for v, c in zip(values, ("pred", "pp", "succ", "sp", "mp", "mpp", "ms", "msp"))])
    i, p, s, pp, sp = (F.col(c) for c in ("id", "pred", "succ", "pp", "sp"))

    def told(rows: DataFrame, lines: Column) -> DataFrame:
        """(id, pred, pp, succ, sp) of the nodes that send their own line, with what the others tell them."""
        sent = rows.select(F.explode(lines).alias("m")).where("m is not null").select("m.*")
        got = sent.groupBy("id").agg(F.bool_or("own").alias("own"), *[F.max(c).alias(c) for c in ("pred", "pp", "succ", "sp", "mp", "mpp", "ms", "msp")]).where("own")
        return got.select("id", F.coalesce("mp", "pred").alias("pred"), F.coalesce("mpp", "pp", F.lit(False)).alias("pp"), F.coalesce("ms", "succ").alias("succ"), F.coalesce("msp", "sp", F.lit(False)).alias("sp"))

    yes, bare, step = F.lit(True), [], 0
    rows = told(paths, F.array(line(i, True, p, no, s, no, none, no, none, no), line(p, False, none, no, none, no, none, no, none, yes), line(s, False, none, no, none, no, none, yes, none, no)))
    while True:
        rank = lambda c, k=step: F.xxhash64(c, F.lit(k))
        top = (~pp | (rank(i) > rank(p))) & (~sp | (rank(i) > rank(s)))
        state = cut(rows.where("id <> pred").withColumn("gone", top))  # a node that is its own neighbour is what a cycle has become
        if state.isEmpty():
            break
        gone = state.where("gone")
        folds.append(gone.select("id", "pred", "succ"))
        bare.append(gone.where("not pp and not sp").select(p.alias("src"), s.alias("dst")))
        stays, leaves = line(i, True, p, pp, s, sp, none, no, none, no), F.col("gone")
        rows = told(state, F.array(F.when(~leaves, stays), F.when(leaves & pp, line(p, False, none, no, none, no, none, no, s, sp)), F.when(leaves & sp, line(s, False, none, no, none, no, p, pp, none, no))))
        step += 1
    return cut(reduce(DataFrame.union, [rest, *bare]).where("src <> dst").distinct())


def _unfolded(fold: DataFrame, members: DataFrame) -> DataFrame:
    """members (id, head) with those of a fold: a node is on a cycle if both neighbours are in one component or are the same."""
    both = fold.join(members.toDF("pred", "p"), "pred", "left").join(members.toDF("succ", "s"), "succ", "left").where("pred = succ or p = s")
    new = cut(both.select("id", F.coalesce("p", "pred").alias("head"), F.col("p").isNull().alias("first")))
    return members.union(new.select("id", "head")).union(new.where("first").select(F.col("head").alias("id"), "head").distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(component_id, id, size) of the strongly connected components of two or more nodes; component_id is the least id.

    Nodes without a predecessor or successor are trimmed and paths are folded to single edges while that takes a fair share
    away; so trees, chains and cycles of n nodes take about log n steps. Then the nodes get labels in random order, and each
    learns the least label that reaches it and the least that it reaches. Where both are the same, the nodes of that label are
    a component. The rest goes on along edges between nodes that agree in both, as a component's nodes do; random labels cut
    it into pieces that shrink by shares, so about log n rounds do. A search that isn't done after PLAIN_STEPS steps goes on
    with shortcuts, which double in length. At last the folded nodes come back, those folded last first.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found: DataFrame | None = None
    folds: list[DataFrame] = []
    n = left.count()
    while True:
        slow = 0
        while n and slow < PATIENCE:
            before = n
            left = _trimmed(left)
            n = left.count()
            if n > FAIR * before:
                left = _folded(left, n, folds)
                n = left.count()
            if n > FAIR * before:
                slow = slow + 1 if FEW >= n < before else PATIENCE
        if not n:
            break
        # after the shuffle of distinct nodes stand in the order of their hashes, which has nothing to do with the edges
        dealt = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("f", F.monotonically_increasing_id())
        state = cut(dealt.select("id", "f", F.col("f").alias("b"), F.lit(True).alias("moved")))
        wide, steps = left, 0
        while True:
            pushing = state.where("moved")
            ahead = wide.join(pushing.select(F.col("id").alias("src"), "f"), "src").select(F.col("dst").alias("id"), "f", F.lit(None).cast("long").alias("b"))
            behind = wide.join(pushing.select(F.col("id").alias("dst"), "b"), "dst").select(F.col("src").alias("id"), F.lit(None).cast("long").alias("f"), "b")
            came = ahead.union(behind).groupBy("id").agg(F.min("f").alias("cf"), F.min("b").alias("cb"))
            moved = F.coalesce(F.col("cf") < F.col("f"), F.lit(False)) | F.coalesce(F.col("cb") < F.col("b"), F.lit(False))
            state = cut(state.drop("moved").join(came, "id", "left").select("id", F.least("f", "cf").alias("f"), F.least("b", "cb").alias("b"), moved.alias("moved")))
            steps += 1
            if state.where("moved").isEmpty():
                break
            if steps == PLAIN_STEPS:
                wide = cut(left.union(shortcuts(left)).distinct())
                state = cut(state.withColumn("moved", F.lit(True)))  # all push once along the shortcuts
        member = state.where("f = b").select("id", F.col("f").alias("label"))
        heads = member.groupBy("label").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
        member = cut(member.join(heads, "label").select("id", "head"))
        found = member if found is None else found.union(member)
        rest = state.where("f <> b")
        agreed = left.join(rest.select(F.col("id").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs")), "src").join(rest.select(F.col("id").alias("dst"), F.col("f").alias("fd"), F.col("b").alias("bd")), "dst")
        left = cut(agreed.where("fs = fd and bs = bd").select("src", "dst"))
        n = left.count()
    if found is None:
        found = left.select(F.col("src").alias("id"), F.col("src").alias("head")).limit(0)
        if not folds or reduce(DataFrame.union, folds).where("pred = succ").isEmpty():
            return found.select(F.col("head").alias("component_id"), "id", F.lit(0).cast("long").alias("size"))
    for k, fold in enumerate(reversed(folds), 1):
        found = _unfolded(fold, found)
        if k % COMPACT == 0:
            found = cut(found)
    sizes = found.groupBy("head").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    return found.join(sizes, "head").select("component_id", "id", "size")


def cycles(edges: DataFrame, limit: int = 100, shown: int = 12) -> DataFrame:
    """(component_id, size, members, more): the largest components first, their first members in order."""
    c = strong_components(edges).groupBy("component_id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("id")).alias("m"))
    return c.select("component_id", "size", F.slice("m", 1, shown).alias("members"), F.greatest(F.lit(0), F.size("m") - shown).alias("more")).orderBy(F.desc("size"), "component_id").limit(limit)


def orphans(nodes: DataFrame, edges: DataFrame, referenced_only: bool = False) -> DataFrame:
    """Nodes without any edge; with referenced_only, nodes that no edge points to."""
    out = nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return out if referenced_only else out.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge to or from another node."""
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def neighbours(edges: DataFrame, anchors: DataFrame, forward: bool = True) -> DataFrame:
    """(id): distinct ids one edge away from the anchors (id)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.join(anchors.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id")).distinct()


def neighbourhood(edges: DataFrame, centre: str, hops: int = 1, direction: str = "both", cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth, degree) within hops of the centre, at most cap, and the edges (src, dst) that the search went along."""
    kinds = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(""))
    nodes = cut(graph_sets.neighbourhoods(kinds, edges.sparkSession.createDataFrame([(centre,)], "centre string"), hops, direction, cap))
    return nodes.select("id", "depth", "degree"), graph_sets.neighbourhood_edges(kinds, nodes, hops, direction).select("src", "dst").distinct()
