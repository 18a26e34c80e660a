"""Graph operators that answer many questions at once: paths of many pairs, closures of many seeds, neighbourhoods of many
centres. Each level is one job over the frontiers of all questions together.

An edge points from the dependent to what it depends on. Ids are strings or numbers; edges with a null or empty end don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relscope.operators.lineage import cut

#: Longs of a node's row in a closure: a block of 64 times as many seeds travels together.
WORDS = 16
COMPACT = 16


def usable(edges: DataFrame, *more: str) -> DataFrame:
    """Distinct (src, dst, *more) with both ends known."""
    known = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("src", "dst")]
    return edges.where(known[0] & known[1]).select("src", "dst", *more).distinct()


# ---- shortest paths of pairs --------------------------------------------------------------------------------------


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, step, id): the nodes of a shortest directed path of each of the pairs (start, goal), from step 0.

    Of equally short paths the one whose first differing node is least is taken, which is the path that a breadth-first
    search finds that visits the nodes in order. A pair of equal ends has one row; a pair without a path has none; repeated
    pairs count once. Both ends search at once: in each round a pair goes one level on from the end with fewer nodes, until
    a new node is on the other end's last level. Then only nodes on shortest paths are kept, and the paths are laid from the
    start by joins.
    """
    pairs = pairs.select("start", "goal").where("start is not null and goal is not null").distinct()
    step = cut(usable(edges))
    same = pairs.where("start = goal").select("start", "goal", F.lit(0).alias("step"), F.col("start").alias("id"))
    # number the pairs, so that two ends don't travel with every node
    asked = cut(pairs.where("start <> goal").withColumn("pair", F.monotonically_increasing_id()))
    ends = F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("start").alias("id")), F.struct(F.lit(False).alias("ahead"), F.col("goal").alias("id"))))
    seen = cut(asked.select("pair", ends.alias("e")).select("pair", "e.ahead", "e.id", F.lit(0).alias("depth")))
    frontier, met, done = seen, [], asked.select("pair").limit(0)
    while not frontier.isEmpty():
        sizes = frontier.groupBy("pair").agg(F.count_if("ahead").alias("a"), F.count_if(~F.col("ahead")).alias("b"))
        side = sizes.where("a > 0 and b > 0").select("pair", (F.col("a") <= F.col("b")).alias("side"))
        moving = cut(frontier.join(side, "pair"))
        ahead = moving.where("ahead and side").join(step, F.col("id") == F.col("src")).select("pair", "ahead", F.col("dst").alias("id"), "depth")
        behind = moving.where("not ahead and not side").join(step, F.col("id") == F.col("dst")).select("pair", "ahead", F.col("src").alias("id"), "depth")
        new = ahead.union(behind).groupBy("pair", "ahead", "id").agg((F.max("depth") + 1).alias("depth")).join(seen.select("pair", "ahead", "id"), ["pair", "ahead", "id"], "left_anti")
        new = cut(new)
        still = moving.where(F.col("ahead") != F.col("side")).select("pair", "ahead", "id", "depth")
        meeting = cut(new.alias("n").join(still.alias("s"), (F.col("n.pair") == F.col("s.pair")) & (F.col("n.id") == F.col("s.id"))).select("n.pair", "n.id", F.when(F.col("n.ahead"), F.col("n.depth")).otherwise(F.col("s.depth")).alias("at"), (F.col("n.depth") + F.col("s.depth")).alias("length")))
        met.append(meeting)
        seen = seen.union(new)
        if len(met) % COMPACT == 0:
            seen = cut(seen)
        done = meeting.select("pair").distinct()
        frontier = cut(new.union(still).join(done, "pair", "left_anti"))
    if not met:
        return same
    meeting = cut(reduce(DataFrame.union, met))
    return same.union(_laid(step, asked, cut(seen), meeting))


def _laid(step: DataFrame, asked: DataFrame, seen: DataFrame, meeting: DataFrame) -> DataFrame:
    """Rows of the paths of the pairs that met."""
    found = meeting.groupBy("pair").agg(F.min("at").alias("at"), F.min("length").alias("length"))
    far = seen.join(found, "pair")
    # the start's side: what leads to a meeting node, level by level down
    own = far.where("ahead and depth <= at").select("pair", "id", "depth")
    level, on = meeting.select("pair", "id", F.col("at").alias("depth")), [meeting.select("pair", "id", F.col("at").alias("depth"))]
    tallest = found.agg(F.max("at"), F.max("length")).first()
    for _ in range(tallest[0] or 0):
        back = level.where("depth > 0").join(step, F.col("id") == F.col("dst")).select("pair", F.col("src").alias("id"), (F.col("depth") - 1).alias("depth")).distinct()
        level = cut(back.join(own, ["pair", "id", "depth"], "left_semi"))
        on.append(level)
    # the goal's side: the depth counts from the goal; what is next on a path has one less
    rest = far.where("not ahead").select("pair", "id", (F.col("length") - F.col("depth")).alias("depth"), "at").where("depth > at").select("pair", "id", "depth")
    places = cut(reduce(DataFrame.union, [*on, rest]).distinct())
    now = cut(asked.join(found, "pair").select("pair", F.lit(0).alias("step"), F.col("start").alias("id")))
    laid = [now]
    for n in range(1, (tallest[1] or 0) + 1):
        ahead = now.join(step, F.col("id") == F.col("src")).select("pair", F.col("dst").alias("id"))
        here = places.where(F.col("depth") == n).select("pair", "id")
        now = cut(ahead.join(here, ["pair", "id"], "left_semi").groupBy("pair").agg(F.min("id").alias("id")).select("pair", F.lit(n).alias("step"), "id"))
        laid.append(now)
    return reduce(DataFrame.union, laid).join(asked, "pair").select("start", "goal", "step", "id")


# ---- closures of seeds --------------------------------------------------------------------------------------------


def closure(edges: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """(id, depth): what the seeds (id) reach together along their outgoing (or incoming) edges, no seed among it."""
    step = usable(edges)
    step = cut(step if forward else step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    frontier = seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, F.col("id") == F.col("src"), "inner").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier) if depth % COMPACT else cut(seen.union(frontier))
    return seen.where("depth > 0")


class Closures:
    """Which of many seeds reach a node and at which depth: rows (block, id, depth, w0, w1, ...), a bit a seed.

    The seeds of a block, 64 times WORDS of them, go through the graph in the same rows: a level joins the frontier's rows
    with the edges once for all seeds, and what arrives at a node is one OR an edge, combined before the shuffle.
    """

    def __init__(self, levels: DataFrame, numbers: DataFrame, words: int):
        self.levels, self.numbers, self.words = levels, numbers, words

    def pairs(self) -> DataFrame:
        """(seed, id, depth): a row for each seed and node; this is the size of the answer."""
        bits = F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), _set(f"w{k}")), _plus(64 * k)) for k in range(self.words)]))
        rows = self.levels.select("block", "id", "depth", F.explode(bits).alias("bit"))
        return rows.join(self.numbers, ["block", "bit"]).select("seed", "id", "depth")

    def counts(self) -> DataFrame:
        """(id, seeds, nearest, total_depth): how many seeds reach a node, the least depth and the sum of depths."""
        n = reduce(lambda a, b: a + b, [F.bit_count(f"w{k}") for k in range(self.words)]).cast("long")
        per = self.levels.select("id", "depth", n.alias("n"))
        return per.groupBy("id").agg(F.sum("n").alias("seeds"), F.min("depth").alias("nearest"), F.sum(F.col("n") * F.col("depth")).alias("total_depth"))


def _set(word: str):
    return lambda b: F.getbit(F.col(word), b) == 1


def _plus(n: int):
    return lambda b: b + n


def closures(edges: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int | None = None, words: int = WORDS) -> Closures:
    """What each of the seeds (seed) reaches along its outgoing (or incoming) edges, itself left out.

    Seeds are numbered in their order, so seeds of neighbouring ids share a block: where they reach the same nodes, as in graphs
    whose edges stay within a range of ids, a node has a row in few blocks.
    """
    size, names = 64 * words, [f"w{k}" for k in range(words)]
    step = usable(edges)
    step = cut(step if forward else step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    numbers = cut(_numbered(seeds.select("seed").where("seed is not null").distinct().orderBy("seed")).select("seed", F.expr(f"n div {size}").alias("block"), (F.col("n") % size).cast("int").alias("bit")))
    word = lambda k: F.when(F.expr(f"bit div 64 = {k}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")).alias(f"w{k}")
    frontier = cut(numbers.select("block", F.col("seed").alias("id"), *map(word, range(words))))
    seen, levels, depth = frontier, [], 0
    any_of = lambda: reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    while max_depth is None or depth < max_depth:
        depth += 1
        came = frontier.join(step, F.col("id") == F.col("src")).groupBy("block", F.col("dst").alias("id")).agg(*[F.bit_or(n).alias(n) for n in names])
        had = seen.groupBy("block", "id").agg(*[F.bit_or(n).alias(f"had_{n}") for n in names])
        fresh = lambda n: F.col(n).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"had_{n}"), F.lit(0).cast("long"))))
        frontier = cut(came.join(had, ["block", "id"], "left").select("block", "id", *[fresh(n).alias(n) for n in names]).where(any_of()))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
        if depth % COMPACT == 0:
            seen = cut(seen.groupBy("block", "id").agg(*[F.bit_or(n).alias(n) for n in names]))
    none = frontier.limit(0).withColumn("depth", F.lit(0))
    return Closures(reduce(DataFrame.union, levels) if levels else none, numbers, words)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n = 0, 1, 2, ...: a partition's rows are numbered on from the sum of those before (a row a partition)."""
    placed = cut(rows.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = sizes.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.withColumn("__p", part).join(before, "__p").withColumn("n", F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__before")).drop("__m", "__p", "__before")


# ---- neighbourhoods of centres ------------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct edges (src, dst, kind) that begin or end at a node; a self-edge counts twice."""
    return usable(edges, "kind").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbourhoods(edges: DataFrame, centres: DataFrame, hops: int = 1, direction: str = "both", cap: int = 40) -> DataFrame:
    """(centre, id, depth, degree, total): the nodes within hops of each of the centres (centre), at most cap of them.

    edges have a kind. The centre always stays; the others by degree, and of equal degree those that a breadth-first search
    meets first, which asks a node's outgoing edges before its incoming ones, each by id. total is the number before the
    cut. Of each centre only the first cap rows of a task reach the shuffle.
    """
    one = usable(edges)
    out = one.select(F.col("src").alias("at"), F.col("dst").alias("id"), F.lit("0").alias("way"))
    back = one.select(F.col("dst").alias("at"), F.col("src").alias("id"), F.lit("1").alias("way"))
    step = cut({"out": out, "in": back, "both": out.union(back)}[direction])
    start = cut(centres.select("centre").where("centre is not null").distinct().select("centre", F.col("centre").alias("id"), F.lit(0).alias("depth"), F.array(F.lit("")).alias("rank")))
    seen = frontier = start
    for depth in range(1, hops + 1):
        rank = F.concat("rank", F.array("way", F.col("id").cast("string")))
        new = frontier.withColumnRenamed("id", "at").join(step, "at").groupBy("centre", "id").agg(F.min(rank).alias("rank"))
        frontier = cut(new.join(seen.select("centre", "id"), ["centre", "id"], "left_anti").select("centre", "id", F.lit(depth).alias("depth"), "rank"))
        seen = seen.union(frontier)
    sized = seen.join(degrees(edges), "id", "left").na.fill(0, ["degree"])
    order = Window.partitionBy("centre").orderBy((F.col("depth") > 0).cast("int"), F.desc("degree"), "depth", "rank")
    kept = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    return kept.join(seen.groupBy("centre").agg(F.count("*").alias("total")), "centre").select("centre", "id", "depth", "degree", "total")


def neighbourhood_edges(edges: DataFrame, nodes: DataFrame, hops: int = 1, direction: str = "both") -> DataFrame:
    """(centre, src, dst, kind): edges between a neighbourhood's nodes that the search went along."""
    one = usable(edges, "kind")
    side = lambda end: nodes.select("centre", F.col("id").alias(end), F.col("depth").alias(f"{end}_depth"))
    both = side("src").join(one, "src").join(side("dst"), ["centre", "dst"])
    went: dict[str, Column] = {"out": F.col("src_depth") < hops, "in": F.col("dst_depth") < hops}
    return both.where(went["out"] | went["in"] if direction == "both" else went[direction]).select("centre", "src", "dst", "kind")
