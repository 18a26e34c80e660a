"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only (operator 10).

An item window is a set of two-word shingles that a document must hold in full, so its necessary prefix is one shingle:
the one that is rarest in the documents. Document shingles meet prefixes in a hash join inside the scan's own stage; the
join condition applies the positional and length bounds and then compares the whole window, so no text is shuffled.
The window table is broadcast in chunks of a checked size: a benchmark beyond the bound takes more scans, not more memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import read, saved

WINDOW = 10
#: Bytes of item windows that one broadcast may hold.
CHUNK_BYTES = 32 << 20

#: Everything that is not a word: ASCII but for letters and digits.
GAP = r"[\x00-/:-@\[-`{-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _shingle(first: Column, second: Column) -> Column:
    # lower() also folds letters beyond ASCII, so keys may meet too often, never too seldom; the window is compared exactly
    return F.xxhash64(F.lower(first), F.lower(second))


def item_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(win, len, item_ids): the distinct windows of all items, each with the items that hold it."""
    split = items.select(F.col(item_id).alias("item_id"), words(ascii_lower(F.col(text))).alias("w")).withColumn("len", F.least(F.size("w"), F.lit(window))).where("len > 0")
    starts = split.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return starts.select("item_id", "len", F.slice("w", F.col("s"), F.col("len")).alias("win")).groupBy("win", "len").agg(F.collect_set("item_id").alias("item_ids"))


def _doc_shingles(docs: DataFrame) -> DataFrame:
    """docs of (id, version, w) with a row for each word that has a successor: pos from 0, key."""
    return docs.select("*", F.posexplode_outer("w").alias("pos", "word")).where(F.col("pos") + 1 < F.size("w")).withColumn("key", _shingle(F.col("word"), F.element_at("w", F.col("pos") + 2)))


def _prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """windows with (key, off): the shingle that is rarest in docs and where it stands in the window."""
    pairs = windows.where("len > 1").withColumn("x", F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.struct(_shingle(F.element_at("win", i), F.element_at("win", i + 1)).alias("key"), (i - 1).alias("off")))))
    pairs = pairs.select("win", "len", "item_ids", "x.key", "x.off")
    keys = pairs.select("key").distinct()
    seen = reduce(DataFrame.union, [_doc_shingles(docs).join(F.broadcast(part), "key").groupBy("key").count() for part in _chunks(keys, F.lit(16))])
    rated = pairs.join(seen, "key", "left").withColumn("rarity", F.struct(F.coalesce("count", F.lit(0)), "key", "off"))
    return rated.groupBy("win", "len").agg(F.min("rarity").alias("r"), F.first("item_ids").alias("item_ids")).select("win", "len", "item_ids", F.col("r.key").alias("key"), F.col("r.off").alias("off"))


def _chunks(table: DataFrame, row_bytes: Column, key: str = "key") -> list[DataFrame]:
    """The table in parts of at most about CHUNK_BYTES, dealt by key; as many parts as its measured size needs."""
    size = table.agg(F.sum(row_bytes + 48)).first()[0] or 0
    n = int(size // CHUNK_BYTES) + 1
    return [table] if n == 1 else [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def hits(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, version, start, len, item_ids): each place of docs (id, version, w) where an item window stands."""
    windows, _ = saved(item_windows(items, item_id, text, window), "windows")
    long, _ = saved(_prefixes(windows, docs), "prefixes")
    found = []
    bytes_of = F.length(F.array_join("win", " ")) + 8 * F.size("item_ids")
    for part in _chunks(long, bytes_of):
        side = F.broadcast(part.withColumn("exact", F.array_join("win", " ")).drop("win"))
        start = F.col("pos") - F.col("off")
        inside = (start >= 0) & (start + F.col("len") <= F.size("w"))
        same = ascii_lower(F.array_join(F.slice("w", start + 1, F.col("len")), " ")) == F.col("exact")
        d = _doc_shingles(docs)
        found.append(d.join(side, (d["key"] == side["key"]) & inside & same).select("id", "version", start.alias("start"), "len", "item_ids"))
    single = windows.where("len = 1").select(F.col("win")[0].alias("exact"), "item_ids", F.xxhash64(F.lower(F.col("win")[0])).alias("key"))
    if not single.isEmpty():
        for part in _chunks(single, F.length("exact") + 8 * F.size("item_ids")):
            d = docs.select("id", "version", F.posexplode("w").alias("pos", "word")).withColumn("k", F.xxhash64(F.lower("word")))
            side = F.broadcast(part)
            found.append(d.join(side, (d["k"] == side["key"]) & (ascii_lower(F.col("word")) == F.col("exact"))).select("id", "version", F.col("pos").alias("start"), F.lit(1).alias("len"), "item_ids"))
    return reduce(DataFrame.union, found)


def covered(spans: Column) -> Column:
    """How many positions the sorted (start, len) spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Null and empty texts have no words and are clean; items without words match nothing; repeated rows each come back,
    and rows that share an id but not a text are judged each by its own text. Other columns are not read, so clashing
    names don't matter. An empty docs table gives an empty result, an empty items table leaves every document clean.
    """
    named = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), words(F.col(text)).alias("w"))
    places = hits(named, items, item_id, item_text, window)
    # a document's places are at most its words times the distinct window lengths
    by_doc = places.groupBy("id", "version").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("found"))
    by_doc = by_doc.select(F.col("id").alias("hit_id"), F.col("version").alias("hit_version"), covered(F.col("spans")).cast("long").alias("hit"), F.array_sort(F.transform("found", lambda x: x.cast("string"))).alias("found"))
    sized = named.select("id", "version", F.size("w").cast("long").alias("n_words"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    joined = sized.join(by_doc, sized["id"].eqNullSafe(by_doc["hit_id"]) & (sized["version"] == by_doc["hit_version"]), "left")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item window; columns as they were.

    Null and empty texts stay. Rows that share an id are judged each by its own text, also those with a null id. Empty
    tables of either kind and clashing names of other columns are fine.
    """
    named = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), words(F.col(text)).alias("w"))
    found, _ = saved(hits(named, items, item_id, item_text).select("id", "version").distinct(), "contaminated")
    small = found.count() * 64 <= CHUNK_BYTES
    side = found.select(F.col("id").alias("__id"), F.col("version").alias("__version"))
    same = docs[doc_id].eqNullSafe(side["__id"]) & (F.xxhash64(docs[text]) == side["__version"])
    return docs.join(F.broadcast(side) if small else side, same, "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hit) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""
