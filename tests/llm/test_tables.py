"""WARC archives, mixing, decontamination and the pipeline against brute force."""

import base64
import hashlib
import io
import random
import re
import struct
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
import zstandard

import __spark_entry__
import corpus_pipeline
from relscope.llm import decontaminate as C
from relscope.llm import language_id
from relscope.llm import mixing as M
from relscope.llm import warc as W
from relscope.llm.common import local_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string, payload string"


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(0)
    html = [f"<html><body><p>{'common words here ' * rng.randrange(5, 30)}{i % 40}</p></body></html>" for i in range(200)] + [None, "", "", "é" * 50_000, "x\r\n\r\ny"]
    df = spark.createDataFrame([(i, None if i % 50 == 3 else f"http://h/{i}", h, "clash") for i, h in enumerate(html)], PAGES)
    listed = W.write(df, str(tmp_path / "w"), file_bytes=60_000).collect()
    assert len(listed) > 3 and sum(r["n_records"] for r in listed) == len(html)
    got = {r["page_id"]: r for r in W.load(spark.createDataFrame(listed, "uri string, n_records long")).collect()}
    payloads = {i: (h or "").encode() for i, h in enumerate(html)}
    last = defaultdict(int)
    for i, p in payloads.items():
        last[p] = max(last[p], i)
    for i, p in payloads.items():
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[p] == i else ("revisit", last[p]))
        assert r["url"] == (None if i % 50 == 3 else f"http://h/{i}") and (bytes(r["payload"]) == p if last[p] == i else r["payload"] is None)
    first = open(listed[0]["uri"], "rb").read()
    assert struct.unpack("<I", first[:4])[0] == W.DICT_MAGIC


def test_archive_of_few_records_and_offsets():
    records = [W.record("response", i, "u", b"abc" * i, W.digest32(b"abc" * i), None) for i in range(5)]
    data, places = W.archive(records)
    assert list(W.frames(io.BytesIO(data))) == records
    size = struct.unpack("<II", data[:8])[1]
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    at, n = places[3]
    assert zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at : at + n]) == records[3]
    one, ((at, n),) = W.archive(records[3:4])
    assert zstandard.ZstdDecompressor().decompressobj().decompress(one[at : at + n]) == records[3] and list(W.frames(io.BytesIO(one))) == records[3:4]
    many = [W.record("response", i, "u", f"<p>page {i} of the site</p>".encode() * 9, "D", None) for i in range(300)]
    data, _ = W.archive(many)
    assert list(W.frames(io.BytesIO(data))) == many
    with pytest.raises(ValueError):
        list(W.frames(io.BytesIO(data[:-5])))


@pytest.mark.parametrize(("n", "size"), [(2, 300_000), (3, 40_000), (100, 287_000), (40, 3_000)])
def test_few_and_large_records_have_a_dictionary(n, size):
    rng = random.Random(n)
    words = [f"word{rng.randrange(10**6)}" for _ in range(4000)]
    body = " ".join(rng.choice(words) for _ in range(size // 11)).encode()
    records = [W.record("response", i, f"http://h/{i}", b"<p>%d</p>" % i + body, "D", None) for i in range(n)]
    data, places = W.archive(records)
    assert struct.unpack("<I", data[:4])[0] == W.DICT_MAGIC and list(W.frames(io.BytesIO(data))) == records and len(places) == n


def test_pages_without_an_id(spark):
    big = (1 << 61) + 1
    rows = [(big, "u", "same", "x"), (None, "v", "same", "x"), (3, None, "same", "x"), (None, "w", "own", "x"), (None, None, "own", "x"), (5, "u", None, "x"), (7, "u", "", "x"), (7, "u", "", "x")]
    got = sorted(((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in W.archived(spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    assert got == sorted([("3", "revisit", big), ("5", "revisit", 7), ("7", "response", None), ("7", "response", None), (str(big), "response", None), ("None", "response", None), ("None", "response", None), ("None", "revisit", big)], key=repr)


def test_no_pages(spark):
    assert W.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_targets():
    assert M.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert M.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]
    sizes = [3, 500, 20, 7, 90, 1]
    got = M.targets(sizes)
    assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), "en", rng.choice(["b", "a", "é", None] + ["hot"] * 4), 1) for i in range(600)]
    rows += [(700, None, "en", "a", 1), (701, "", "en", "only-empty", 1), (702, "w " * 9000, "en", "b", 1), (5, rows[5][1], "en", rows[5][3], 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = M.mixed(df).collect()
    again = M.mixed(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, M.targets([sizes[s] for s in order]), strict=True))
    by_id = {i: s for i, _, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == goal[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 2 for s in order)
    assert M.mixed(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("place", [0, 1, 2])
def test_small_source_meets_its_target_where_slots_are_bounded(spark, monkeypatch, place):
    monkeypatch.setattr(M, "MAX_SLOTS", 5000)
    names = ["b", "c"]
    names.insert(place, "small")
    rows = [(i, " ".join(["w"] * 1000), "en", s, 1) for i, s in enumerate(n for n in names if n != "small" for _ in range(250))]
    rows.append((9000, " ".join(["w"] * 20), "en", "small", 1))
    rows = [(i, t, lang, f"{names.index(s)}{s}", n) for i, t, lang, s, n in rows]
    taken, goal = defaultdict(int), {}
    for r in M.mixed(spark.createDataFrame(rows, DOCS)).collect():
        name = "small" if r["doc_id"] == 9000 else r["doc_id"] // 250
        taken[name] += r["taken"]
        goal[name] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 4 for s in goal) and goal["small"] > 10


def slow_taken(rows, order):
    """taken of (key, source, size) rows whose shuffle order is known, word by word."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    sources, _, slots = M.plan([(s, sizes[s]) for s in names])
    owner = {s: [] for s in names}
    for key, s, n in sorted(rows, key=lambda r: order[r[0]]):
        owner[s] += [key] * n
    uses, taken = defaultdict(int), defaultdict(int)
    for i in range(slots):
        u = ((i * M.STEP + M.STEP // 2) % 2**64) >> 11
        sid = next(x["sid"] for x in sources if x["lo"] <= u < x["hi"])
        if uses[sid] < 3 * sources[sid]["blocks"]:
            at = uses[sid] % sources[sid]["blocks"] * sources[sid]["block"]
            for key in owner[names[sid]][at : at + sources[sid]["block"]]:
                taken[key] += 1
        uses[sid] += 1
    return taken


def test_taken_matches_a_slow_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60, 500])), "en", rng.choice(["a", "b", None, "c", "c", "c"]), 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    order = {r["doc_id"]: r["o"] % 2**64 for r in df.selectExpr("doc_id", f"xxhash64({M.SEED}, doc_id, xxhash64(text)) as o").collect()}
    want = slow_taken([(i, s, len(t.split())) for i, t, _, s, _ in rows], order)
    got = {r["doc_id"]: r["taken"] for r in M.mixed(df).collect()}
    assert sum(got.values()) > 1000 and got == {i: want.get(i, 0) for i, *_ in rows}


def test_a_slot_finds_its_source_among_many(spark):
    sources, block, slots = M.plan([(f"s{i:04d}", 1 + i * i % 97) for i in range(700)])
    drawn = {(r["slot"], r["sid"]) for r in M.schedule(spark, sources, slots, block).select("slot", "sid").collect()}
    for slot, sid in random.Random(1).sample(sorted(drawn), 300):
        u = ((slot * M.STEP + M.STEP // 2) % 2**64) >> 11
        assert sources[sid]["lo"] <= u < sources[sid]["hi"]
    assert len({s for _, s in drawn}) == sum(s["hi"] > s["lo"] for s in sources)


@pytest.mark.parametrize("sizes", [[5_000_000_000, 10, 2_000], [2_000, 5_000_000_000, 10], [10**12, 60, 150]])
def test_plan_gives_tiny_sources_their_slots(sizes):
    sources, _, slots = M.plan([(f"s{i}", n) for i, n in enumerate(sizes)])
    for s in sources:
        share = (s["hi"] - s["lo"]) / 2**53 * slots * s["block"]  # words that the source's part of the slots comes to
        assert abs(share - s["target"]) <= max(2 * s["block"], 0.002 * s["target"])
        assert s["block"] <= max(1, s["target"] / 1000)


def test_schedule_follows_the_golden_ratio(spark):
    sources, block, slots = M.plan([("a", 4000), ("b", 2000), (None, 1000)])
    got = sorted((r["slot"], r["sid"], r["rank"], r["block"]) for r in M.schedule(spark, sources, slots, block).collect())
    used = defaultdict(int)
    want = []
    for i in range(slots):
        u = ((i * M.STEP + M.STEP // 2) % 2**64) >> 11
        sid = next(s["sid"] for s in sources if s["lo"] <= u < s["hi"])
        if used[sid] < 3 * sources[sid]["blocks"]:
            want.append((i, sid, used[sid], used[sid] % sources[sid]["blocks"]))
        used[sid] += 1
    assert got == want


@pytest.mark.parametrize("n_rows", [10, 100_000, 10**9])
def test_running_start_in_levels(spark, n_rows):
    df = spark.range(300).selectExpr("id % 2 as g", "xxhash64(id) as o", "id as v")
    got = M.running_start(df, "g", "o", "v", n_rows, "start").collect()
    for g in (0, 1):
        at = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"] % 2**64):
            assert r["start"] == at
            at += r["v"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(C.UPPER, C.LOWER)


def slow_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(item)
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)] + ["École", "ÉCOLE", "K", "k", "K"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 10, 14, 30]))) for i in range(30)] + [(100, "w1"), (101, None), (102, "..."), (103, "W3--w4"), (9, "w3 w4")]
    docs = [(i, text(rng.choice([0, 1, 5, 60]))) for i in range(60)]
    docs += [(100 + i, text(20) + " " + items[i][1].upper().replace(" ", " !! ") + " " + text(5)) for i in range(30)] + [(200, None), (201, ""), (202, "w1"), (203, items[4][1])]
    d = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in C.contamination(d, b).collect()}
    want = slow_contamination(docs, items)
    assert got == want
    assert {r["doc_id"] for r in C.clean(d, b).collect()} == {i for i, v in want.items() if not v[4]}


def test_contamination_of_repeated_ids_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c", "x", "s", 1), (1, "q", "x", "s", 1), (1, "a b c", "x", "s", 1), (None, "z a B c", "x", "s", 1)], DOCS)
    b = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in C.contamination(d, b).collect()) == [("1", 1, 0), ("1", 3, 3), ("1", 3, 3), ("None", 4, 3)]
    assert C.contamination(d, b.limit(0)).where("contaminated").count() == 0 and C.contamination(d.limit(0), b).count() == 0


def test_windows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 500)
    d = spark.createDataFrame([(i, " ".join(f"t{(i + k) % 40}" for k in range(30)), "x", "s", 1) for i in range(20)], DOCS)
    items = [(i, " ".join(f"t{(3 * i + k) % 40}" for k in range(12))) for i in range(12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in C.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == slow_contamination([(r["doc_id"], r["text"]) for r in d.collect()], items)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from relscope.llm.common import saved

        docs, _ = saved(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(v[4] for v in slow_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items).values())
    assert corpus_pipeline.run(spark, sf).count() == n


def test_pipeline_stages_on_odd_rows(spark):
    """Repeated ids with other texts, null ids, null texts, clashing names and empty tables go through every stage."""
    rng = random.Random(8)
    words = [f"the{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(80)
    rows = [(i, text(60) + " " + (shared if i % 3 == 0 else text(40)), "en", "s", 1) for i in range(60)]
    rows += [(1, text(90), "en", "s", 1), (1, text(30), "en", "s", 1), (3, rows[3][1], "en", "s", 1), (None, text(50) + " " + shared, "en", None, None), (None, None, None, None, None), (70, "", "en", "s", 0), (71, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as key", "1 as id", "2 as fp", "3 as __id", "4 as hit_id", "5 as order")
    for table in (docs.limit(0), docs):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert name == "mix" or now.columns == docs.columns
            got = now.collect()
            if name != "mix":
                now = spark.createDataFrame(got, docs.schema)
        assert (len(got) > 50) == (table is docs)
    kept = sorted(str(r["doc_id"]) for r in got)
    assert kept.count("1") == 3 and "70" not in kept and "71" not in kept and sum(r["size"] >= 138 for r in got) <= 3


@pytest.mark.parametrize("name", ["op4_lattice", "op7_warc", "op10_decontaminate"])
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_pipeline_takes_long_texts_in_batches_of_bounded_bytes(spark):
    text = "the quick fox " * 5000  # 70 KB each, 14 MB together
    docs = spark.createDataFrame([(i, f"{i} {text}", "en", "s", 1) for i in range(200)], DOCS).coalesce(1)
    for stage in (corpus_pipeline.language, corpus_pipeline.simhash_dedup, corpus_pipeline.substring_dedup):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(0), "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "n": [b.nbytes]}) for b in batches), "rows long, n long").collect()
        assert sum(r["rows"] for r in sizes) == 200 and max(r["n"] for r in sizes) < 2 << 20


def test_rows_of_the_driver_need_no_python_workers(spark, monkeypatch):
    rows = [(1, "a", 0.5), (None, None, None), (3, "é", 1e300)]
    schema = "i int, s string, d double"
    own = local_rows(spark, rows, schema)
    assert own.schema == spark.createDataFrame(rows, schema).schema and [tuple(r) for r in own.collect()] == rows
    assert local_rows(spark, [], schema).collect() == [] and local_rows(spark, [], schema).schema == own.schema
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more", "ab"[i % 2], "st"[i % 2], 1) for i in range(40)], DOCS)

    def refused(*args, **kw):
        raise AssertionError("a list went through an RDD")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert language_id.fit(docs) is not None
    assert M.mixed(docs).count() == 40
