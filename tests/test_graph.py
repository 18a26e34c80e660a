import random

import pytest
from pyspark.sql import functions as F

from relscope.operators import graph as G
from relscope.operators import query_lang
from relscope.operators import relational as R


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k[0] if k else "read") for a, b, *k in pairs], "src string, dst string, kind string")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def hits(df):
    return sorted((r["object_id"], r["depth"]) for r in df.collect())


def test_impact_chain(spark):
    got = G.impact(edges(spark, [("a", "b"), ("b", "c")]), roots(spark, "c"))
    assert hits(got) == [("a", 2), ("b", 1)] and not any(r["capped"] for r in got.collect())


def test_impact_cycle(spark):
    assert hits(G.impact(edges(spark, [("a", "b"), ("b", "a")]), roots(spark, "a"))) == [("b", 1)]


def test_impact_is_capped_at_32(spark):
    got = G.impact(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(40)]), roots(spark, "n40")).collect()
    assert len(got) == 32 and all(r["capped"] for r in got)


def test_impact_kind_of_first_edge(spark):
    got = G.impact(edges(spark, [("a", "b", "fk-cascade"), ("a", "b", "fk"), ("c", "b", "read"), ("d", "c", "update"), ("d", "a", "read")]), roots(spark, "b")).collect()
    assert {r["object_id"]: r["via_kind"] for r in got} == {"a": "fk", "c": "read", "d": "read"}


def brute_components(pairs):
    reach = {}
    nodes = {x for p in pairs for x in p}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in pairs:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        reach[n] = seen
    groups = {frozenset(m for m in nodes if m == n or m in reach[n] and n in reach[m]) for n in nodes}
    return sorted((min(g), m) for g in groups if len(g) > 1 for m in g)


@pytest.mark.parametrize("seed", range(2))
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(22)]
    got = sorted((r["component_id"], r["id"]) for r in G.strong_components(edges(spark, pairs)).collect())
    assert got == brute_components([p for p in pairs if p[0] != p[1]])


def test_paths_are_folded(spark, monkeypatch):
    """A chain and a cycle of 300 nodes each, the cycle with a long way round a part of it and a tail: steps grow with the log."""
    tables = []
    monkeypatch.setattr(G, "cut", lambda df, cut=G.cut: tables.append(1) or cut(df))
    chain = [(f"a{i:03}", f"a{i + 1:03}") for i in range(300)]
    ring = [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)] + [("r010", "s0"), ("s0", "s1"), ("s1", "r200"), ("r050", "t0"), ("t0", "t1"), ("t1", "a200")]
    got = sorted(tuple(r) for r in G.strong_components(edges(spark, chain + ring)).collect())
    assert got == [("r000", m, 302) for m in sorted({a for a, _ in ring} - {"t0", "t1"})]
    assert len(tables) < 90


def test_no_components(spark):
    assert G.strong_components(edges(spark, [("a", "b"), ("b", "b")])).count() == 0
    assert G.cycles(edges(spark, [("a", "b"), ("b", "a"), ("c", "a")])).collect()[0]["members"] == ["a", "b"]


def test_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")])
    assert G.shortest_path(e, "a", "e") == ["a", "b", "d", "e"]
    assert G.shortest_path(e, "a", "a") == ["a"] and G.shortest_path(e, "e", "a") == []


def test_neighbourhood_keeps_the_centre(spark):
    nodes, between = G.neighbourhood(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), "b", 1)
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b", "c"] and between.count() == 2
    nodes, _ = G.neighbourhood(edges(spark, [("x", "a")] + [("a", f"h{i}") for i in range(5)]), "x", 2, cap=2)
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "x"]


def test_query_language(spark):
    e = edges(spark, [("s.a", "s.b"), ("s.b", "t.c")]).select("src", "dst")
    rows = [(i, i.split(".")[0], i, "table" if i < "s.b" else "view", 3, 1) for i in ("s.a", "s.b", "t.c", "t.d")]
    nodes = spark.createDataFrame(rows, "id string, schema string, path string, kind string, loc int, cog int")
    nodes = nodes.join(R.fan_counts(e, nodes), "id")
    ask = lambda q, **k: [r["id"] for r in query_lang.query(nodes, e, q, **k).collect()]
    assert ask("orphans") == ["t.d"] and ask("orphans in t") == ["t.d"] and ask("orphans", strict=False) == ["s.a", "t.d"]
    assert ask("fanin >= 1") == ["s.b", "t.c"] and ask("schema: T") == ["t.c", "t.d"] and ask("kind: vie") == ["s.b", "t.c", "t.d"]
    assert ask("references: s.a") == ["s.b"] and ask("usedby: c") == ["s.b"]
    assert ask("affects: s.a") == ["s.b", "t.c"] and ask("affects: t.c", strict=False) == ["s.a", "s.b"] and ask("reachedby: t.c") == ["s.a", "s.b"]
    assert ask("path: s.a t.c") == ["s.a", "s.b", "t.c"]
    for bad in ("nonsense", "path: one", "what: x"):
        with pytest.raises(ValueError):
            ask(bad)


def test_hot_rows_small(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)] + [(10, 9)], "id int, n int")
    assert sorted(r["id"] for r in R.hot_rows(df, "n").collect()) == [9, 10]


def test_index_pairs(spark):
    df = spark.createDataFrame([("t", "A", ["A", "B"]), ("t", "B", ["a", "b"]), ("t", "C", ["A"]), ("t", "D", []), ("u", "E", ["A"])], "object_id string, name string, key_columns array<string>")
    assert sorted(tuple(r) for r in R.index_pairs(df).collect()) == [("t", "A", "B", "identical"), ("t", "A", "C", "prefix"), ("t", "B", "C", "prefix")]


def test_stream_counters(spark, tmp_path):
    from relscope.streaming.counters import windowed

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,30*id) ts, 'k' k, id v from range(8)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("counted").collect()) == sorted(tuple(r) for r in windowed(rows, "k", "v").collect())
    assert spark.table("counted").agg(F.sum("events")).first()[0] == 8
