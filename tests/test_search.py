"""Gram search, palettes and glob joins against scans; index pairs, selection and snapshots against plain versions."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from relscope.functions import scalars
from relscope.operators import relational as R
from relscope.operators import search, snapshots

WORDS = ["Order", "order_Line", "Überweisung", "a.b", "x", "", "Zeile (neu)", "Kunde%1", "kunden_konto", "log\\x", "*star*", "aXbXc", None]


def texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(w or "" for w in rng.sample(WORDS[:-1], 2)) if i % 9 else None) for i in range(120)]
    return rows, spark.createDataFrame(rows, "id long, text string")


def test_containing_is_the_scan(spark):
    rows, df = texts(spark)
    asked = ["o", "RD", "order", "Line", "über", "x", "%1", "(neu)", "\\x", "zzz", "", "kunden_konto", "a.b", "*"]
    got = sorted(tuple(r) for r in search.containing(df, spark.createDataFrame([(a,) for a in [*asked, None, "o"]], "needle string")).collect())
    assert got == sorted((a.lower(), i) for a in asked if a for i, t in rows if t and a.lower() in t.lower())


def test_palette_is_the_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["dbo.", "app.", "Sales."]) + rng.choice(["orders", "Customers", "item_log", "v_x", "a+b"]) + str(i), rng.choice(["table", "view", None, "file"]), f"#{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "name string, detail string, href string")
    asked = ["d", "ord", "dbo", "table", "sct", "a+", "log1", "zz", "bl", "le"]
    got = search.palette(df, spark.createDataFrame([(a.upper(),) for a in asked], "needle string"), 7).collect()
    for a in asked:
        want = [tuple(r) for r in df.withColumn("score", scalars.palette_score(F.col("name"), F.col("detail"), a)).where("score > 0").orderBy(F.desc("score"), "name", "href").limit(7).select("score", "name", "detail", "href").collect()]
        assert sorted((tuple(r)[1:] for r in got if r["needle"] == a), key=repr) == sorted(want, key=repr), a


def test_globs_are_the_single_ones(spark):
    rows, df = texts(spark)
    patterns = ["*", "?", "", "order*", "*LINE", "*er?ei*", "a.b*", "*(neu)*", "?????", "??*", "*%*", "*\\x*", "x", "no*such", "*a*b*c*", "[a]*", "**"]
    got = sorted(tuple(r) for r in search.glob_matches(df, spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")).collect())
    glob = lambda p: re.compile(fnmatch.translate(p.lower().replace("[", "[[]")))
    assert got == sorted((i, p) for p in patterns for i, t in rows if glob(p).match((t or "").lower()))
    kept = search.excluding(df, spark.createDataFrame([("*order*",), ("1*",)], "pattern string"), "id", "text").select("id").collect()
    assert sorted(r["id"] for r in kept) == sorted(i for i, t in rows if not ("order" in (t or "").lower() or str(i).startswith("1")))
    assert R.exclude(df, ["*order*", "1*"], "id", "text").count() == len(kept)


@pytest.mark.parametrize("scarce", [search.SCARCE, 0])
def test_globs_meet_by_their_ends(spark, monkeypatch, scarce):
    """Keys of a glob's ends find what a scan finds, with few and with many texts a key, and few candidates where grams are frequent."""
    monkeypatch.setattr(search, "SCARCE", scarce)
    monkeypatch.setattr(search, "GRAMS", 16 if scarce else 0)
    rows = [(i, f"Item {'ab'[i % 2]}{'İ' if i % 7 == 0 else ''}.{i}") for i in range(400)] + [(900, None), (901, "ITEM\n.12"), (902, "x")]
    patterns = [f"item?{'AB'[i % 2]}*.{i}" for i in range(0, 400, 3)] + ["*.1?", "??em*7", "it?m*", "*?2", "item a.10", "item?a.??", "*tem*b.3*", "?", "**", "i*m*.*9", "?????aİ*"]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(tuple(r) for r in search.glob_matches(df, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect())
    glob = lambda p: re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p), re.I | re.S)
    assert got == sorted((i, p) for p in patterns for i, t in rows if glob(p).fullmatch(t or ""))


def test_globs_that_end_apart_ask_for_no_grams(spark, monkeypatch):
    """Numbers of five digits share their grams, so a gram gives each glob a hundred texts or more, its end one."""
    monkeypatch.setattr(search, "index", lambda *a: pytest.fail("texts were cut into grams"))
    df = spark.range(3000).selectExpr("id", "concat('name.', 10000 + id) text")
    globs = df.selectExpr("concat('NA?*.', 10000 + id) pattern")
    assert search.glob_matches(df, globs).count() == 3000 and search.excluding(df, globs, "id", "text").count() == 0


def test_index_pairs_of_a_hot_table(spark):
    rng = random.Random(3)
    rows = [("t" if i % 2 else "u", f"ix{i}", [rng.choice("abAB") for _ in range(rng.randrange(5))]) for i in range(160)]
    got = sorted(tuple(r) for r in R.index_pairs(spark.createDataFrame(rows, "object_id string, name string, key_columns array<string>")).collect())
    want = []
    for t, n, k in rows:
        for u, m, j in rows:
            a, b = [x.lower() for x in k], [x.lower() for x in j]
            if t == u and n < m and a and b and a[: len(b)] == b[: len(a)]:
                want.append((t, n, m, "identical" if a == b else "prefix"))
    assert got == sorted(want)


@pytest.mark.parametrize("kind", ["long", "double", "float", "int"])
def test_selection_by_digits(spark, kind):
    rng = random.Random(4)
    whole = kind in ("long", "int")
    values = [rng.randrange(-(1 << 31), 1 << 31) if whole else rng.choice([rng.uniform(-1, 1), rng.uniform(-1e30, 1e30), 0.0, -0.0, 1e-300, float("inf"), float("-inf")]) for _ in range(300)] + [5, 5, 5, -5]
    df = spark.createDataFrame([(None,), *[(v if whole else float(v),) for v in values]], f"v {kind if kind != 'float' else 'double'}").select(F.col("v").cast(kind).alias("v"))
    order = sorted((r["v"] for r in df.where("v is not null").collect()), reverse=True)
    for place in (1, 2, 30, 150, len(order)):
        assert R.value_at(df, "v", place) == order[place - 1]
    assert R.value_at(df, "v", len(order) + 1) is None and R.value_at(df.limit(0), "v", 1) is None
    assert R.hot_rows(df.limit(0), "v").count() == 0


def snapshot_rows(spark, seed):
    rng = random.Random(seed)
    ids = [f"s.t{i}" for i in range(60) if rng.random() < 0.9]
    objects = spark.createDataFrame([(i, rng.choice(["table", "view"])) for i in ids], "id string, kind string")
    columns = spark.createDataFrame([(i, c if rng.random() < 0.8 else c.upper(), rng.choice(["int", "bigint", "varchar", "nvarchar", "text"]), rng.random() < 0.5) for i in ids for c in "abcde" if rng.random() < 0.8], "id string, column string, data_type string, nullable boolean")
    fks = spark.createDataFrame([(i, rng.choice(ids), [rng.choice("ab")]) for i in [*ids, "s.gone"] if rng.random() < 0.5], "from_id string, to_id string, columns array<string>")
    return objects, columns, fks


def test_drift_of_stored_snapshots(spark):
    old, new = snapshot_rows(spark, 5), snapshot_rows(spark, 6)
    names = [snapshots.write(snapshots.nested(*rows), buckets=4) for rows in (old, new)]
    got = snapshots.drift(spark, *names)
    want = R.diff(old[0], new[0], old[1], new[1], old[2], new[2])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kinds = {r["kind"] for r in got.select("kind").distinct().collect()}
    assert kinds == {"object-dropped", "object-added", "column-dropped", "column-added", "column-type-narrowed", "column-type-widened", "column-not-null-tightened", "fk-dropped"}
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for n in names:
        spark.sql(f"drop table {n}")


def test_many_patterns_exclude_as_few_do(spark):
    from relscope.operators import model
    from relscope.sources import scripts

    units = scripts.units(spark, [("a.sql", "CREATE TABLE dbo.keep (id INT); CREATE TABLE dbo.tmp_1 (id INT)"), ("b.sql", "CREATE VIEW app.v_old AS SELECT id FROM dbo.tmp_1"), ("c.sql", "CREATE VIEW app.v AS SELECT id FROM dbo.keep")])
    few, many = ["*tmp?1", "APP.*old"], ["*tmp?1", "APP.*old", *[f"no{i}*" for i in range(model.MANY_PATTERNS)]]
    a, b = model.build(units, few), model.build(units, many)
    for name in ("objects", "dependencies", "diagnostics"):
        assert sorted(map(repr, getattr(a, name).collect())) == sorted(map(repr, getattr(b, name).collect())), name
    assert [r["id"] for r in b.objects.orderBy("id").collect()] == ["app.v", "dbo.keep"]
