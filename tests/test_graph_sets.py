"""Set-at-a-time graph operators against plain searches on random graphs."""

import random
from collections import deque

import pytest

from relscope.operators import graph as G
from relscope.operators import graph_sets as S


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def out_of(edges):
    out = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    return out


def bfs_path(edges, start, goal):
    if start == goal:
        return [start]
    out, prev, queue = out_of(edges), {start: None}, deque([start])
    while queue:
        at = queue.popleft()
        for b in out.get(at, []):
            if b not in prev:
                prev[b] = at
                if b == goal:
                    path = [b]
                    while path[-1] != start:
                        path.append(prev[path[-1]])
                    return path[::-1]
                queue.append(b)
    return []


def depths(edges, seed, most=None):
    out, seen, queue = out_of(edges), {seed: 0}, deque([seed])
    while queue:
        at = queue.popleft()
        if most is not None and seen[at] >= most:
            continue
        for b in out.get(at, []):
            if b not in seen:
                seen[b] = seen[at] + 1
                queue.append(b)
    return seen


def frame(spark, edges):
    return spark.createDataFrame([(*e, "k") for e in edges], "src string, dst string, kind string")


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 20), (3, 40, 52)])
def test_paths_are_those_of_a_breadth_first_search(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    names = sorted({x for e in edges for x in e})
    rng = random.Random(seed)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)] + [(names[0], names[0]), ("nowhere", names[0]), (names[0], None)]
    got = {}
    for r in S.shortest_paths(frame(spark, edges), spark.createDataFrame(pairs, "start string, goal string")).orderBy("step").collect():
        got.setdefault((r["start"], r["goal"]), []).append(r["id"])
    assert got == {p: path for p in set(pairs) if p[1] is not None and (path := bfs_path(edges, *p))}


def test_paths_without_pairs_or_edges(spark):
    none = spark.createDataFrame([], "start string, goal string")
    assert S.shortest_paths(frame(spark, [("a", "b")]), none).count() == 0
    empty = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r) for r in S.shortest_paths(empty, spark.createDataFrame([("a", "b"), ("c", "c")], "start string, goal string")).collect()] == [("c", "c", 0, "c")]
    assert G.shortest_path(frame(spark, [("a", "c"), ("a", "b"), ("c", "d"), ("b", "d")]), "a", "d") == ["a", "b", "d"]


@pytest.mark.parametrize("words", [1, 2])
def test_closures_of_more_seeds_than_bits(spark, words):
    edges = random_graph(5, 90, 150) + [("", "n01"), ("n01", "")]
    seeds = sorted({x for e in edges for x in e if x})
    df = spark.createDataFrame([(x,) for x in [*seeds, seeds[0], None]], "seed string")
    clean = [e for e in edges if "" not in e]
    want = sorted((s, x, d) for s in seeds for x, d in depths(clean, s).items() if d)
    found = S.closures(frame(spark, edges), df, words=words)
    assert sorted(tuple(r) for r in found.pairs().collect()) == want
    per = {}
    for _, x, d in want:
        n, least, total = per.get(x, (0, 99, 0))
        per[x] = (n + 1, min(least, d), total + d)
    assert {r["id"]: (r["seeds"], r["nearest"], r["total_depth"]) for r in found.counts().collect()} == per
    back = sorted(tuple(r) for r in S.closures(frame(spark, edges), df, forward=False, max_depth=2, words=words).pairs().collect())
    turned = [(b, a) for a, b in clean]
    assert back == sorted((s, x, d) for s in seeds for x, d in depths(turned, s, 2).items() if d)


def test_closure_of_a_set_has_no_seed(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    seeds = spark.createDataFrame([("a",), ("c",)], "id string")
    assert sorted(tuple(r) for r in S.closure(frame(spark, edges), seeds).collect()) == [("b", 1), ("d", 1), ("e", 2)]
    assert sorted(tuple(r) for r in S.closure(frame(spark, edges), seeds, forward=False).collect()) == [("b", 1)]


def plain_neighbourhood(edges, centre, hops, direction, cap):
    """As the page's script does it: outgoing edges before incoming ones, then by degree, the centre first."""
    out, inc = {}, {}
    for e in sorted(edges):
        out.setdefault(e[0], []).append(e)
        inc.setdefault(e[1], []).append(e)
    seen, queue, used = {centre: 0}, deque([centre]), []
    while queue:
        at = queue.popleft()
        if seen[at] >= hops:
            continue
        for e in (out.get(at, []) if direction != "in" else []) + (inc.get(at, []) if direction != "out" else []):
            other = e[1] if e[0] == at else e[0]
            used.append(e)
            if other not in seen:
                seen[other] = seen[at] + 1
                queue.append(other)
    ids = list(seen)
    if len(ids) > cap:
        ids.sort(key=lambda x: -(len(out.get(x, [])) + len(inc.get(x, []))))
        ids = [centre, *[x for x in ids if x != centre][: cap - 1]]
    return set(ids), {e for e in used if e[0] in ids and e[1] in ids}, len(seen)


@pytest.mark.parametrize(("hops", "direction", "cap"), [(2, "both", 6), (2, "out", 4), (3, "in", 40)])
def test_neighbourhoods_of_all_centres(spark, hops, direction, cap):
    rng = random.Random(hops)
    edges = sorted({(a, b, rng.choice("rw")) for a, b in random_graph(7, 25, 60)})
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    centres = sorted({x for e in edges for x in e[:2]}) + ["lonely"]
    nodes = S.neighbourhoods(df, spark.createDataFrame([(c,) for c in centres], "centre string"), hops, direction, cap)
    rows = nodes.collect()
    lines = S.neighbourhood_edges(df, nodes, hops, direction).collect()
    for c in centres:
        ids, used, total = plain_neighbourhood(edges, c, hops, direction, cap)
        assert {r["id"] for r in rows if r["centre"] == c} == ids, c
        assert {(r["src"], r["dst"], r["kind"]) for r in lines if r["centre"] == c} == used, c
        assert {r["total"] for r in rows if r["centre"] == c} == {total}


def tarjan(edges):
    reach = {x: set(depths(edges, x)) for x in {y for e in edges for y in e}}
    groups = {}
    for x in reach:
        group = {y for y in reach[x] if x in reach[y]}
        if len(group) > 1:
            groups[min(group)] = len(group)
    return groups


@pytest.mark.parametrize("seed", [11, 12])
def test_strong_components_of_random_graphs(spark, seed):
    edges = random_graph(seed, 40, 60)
    got = {r["component_id"]: r["size"] for r in G.strong_components(frame(spark, edges)).collect()}
    assert got == tarjan(edges)


def test_a_long_cycle_takes_few_steps(spark):
    n, tracker = 800, spark.sparkContext.statusTracker()
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    tail = spark.range(20).selectExpr(f"id + {n} as src", f"case when id = 19 then 0 else id + {n + 1} end as dst")
    spark.sparkContext.setJobGroup("ring", "ring")
    got = G.strong_components(ring.union(tail)).groupBy("component_id", "size").count().collect()
    jobs = len(tracker.getJobIdsForGroup("ring"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [(0, n, n)]
    assert 0 < jobs < n / 2, jobs  # an uncut search takes a few jobs for each of n steps


def test_seeds_of_one_part_share_a_block(spark):
    """Two rings of 64 nodes: the seeds of a ring are one block, so each node has rows in one block."""
    ring = spark.range(128).selectExpr("id src", "if(id % 64 = 63, id - 63, id + 1) dst")
    seeds = spark.createDataFrame([(i % 2 * 64 + i // 2,) for i in range(128)], "seed long")
    found = S.closures(ring, seeds, max_depth=3, words=1)
    assert found.levels.select("block", "id").distinct().count() == 128
    assert sorted(tuple(r) for r in found.pairs().where("seed = 62").collect()) == [(62, 0, 2), (62, 1, 3), (62, 63, 1)]
