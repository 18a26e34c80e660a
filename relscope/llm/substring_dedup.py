"""Near-duplicate passages by compact windows (operator 5).

Tokens are five-word shingles. Under each of `HASHES` hash functions a Cartesian tree over a document's token hashes gives
its compact windows (a, c, b): all token sequences that begin in [a, c] and end in [c, b] share the min-hash that stands at
c. Windows of different documents meet by their min-hash. Each document is first matched with the first document (smallest
id) of every group, so a passage that many documents share costs one row a document, never a pair of each. Matches of one
pair of documents are joined by their intervals: a passage needs windows of at least `LEAST_HASHES` hash functions on about
the same diagonal, and is then verified on the 64-bit tokens: every 50-word window is measured.

Windows that this leaves open (their centre lies in no passage found) are few. Those that have shared windows of several
hash functions around them meet anew by signatures of several min-hashes and are compared with the first documents of each
of their signatures' bands. What that leaves open meets by a band and one of the rarest tokens, which any two similar windows
have in common, and is compared with the earlier documents of each such key, the earliest first, until it is settled or none
is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.llm.common import BROADCAST_BYTES, Scratch, ranked, read, small
from relscope.llm.passage_tokens import HASHES, MIN_WORDS, SHINGLE, SIMILARITY, WIDTH, Side, chunks, hopeful, looped, rarest, run_hashes, signatures, verified, windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_HASHES = 2
#: Shingles on either side of a window's centre that verification looks at: all passages with that centre, and some more.
REACH = MIN_WORDS
#: Bounds of a first document's regions are rounded to this many shingles, so that its regions are few.
SNAP = 32
#: Tokens whose signatures are made at once.
SIGNED = 1 << 16
#: Open windows are compared with so many documents of each of their bands first, and with GROWTH times as many each round.
EARLIEST, GROWTH = 4, 4
#: Bits of a place and its flags, and the count from which tokens are equally frequent.
PLACE, MOST_COUNTED = 36, 1 << 26
PLACE_MASK = (1 << PLACE) - 1

#: Bytes of tokens that a batch of regions holds, or those of one region.
CUT_BYTES = 1 << 22
#: Bytes of a row of a few numbers, where it is broadcast.
ROW_BYTES = 64
#: Bits that keep the centres of a batch's documents apart.
APART = 40

PAIRS = "doc_id long, first_id long, lo int, hi int, first_lo int, first_hi int"
FOUND = "doc_id long, first_doc_id long, start_word long, n_words long, first_start_word long, similarity double"
#: Passages, and centres [from, to] all windows of which have the same tokens as one of an earlier document.
CHECKED = FOUND + ", same_from long, same_to long"


def _batch(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A record batch with the columns of a schema text."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _packed(a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Centre and clipped extents of a window in one long."""
    return c << 20 | np.minimum(c - a, REACH) << 10 | np.minimum(b - c, REACH)


def window_rows(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(key, doc_id, win) of docs (doc_id, text) for each compact window."""
    schema = "key long, doc_id long, win long"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, tokens, sizes in chunks(batch.column(1)):
                w = windows(tokens, sizes, WIDTH, hashes)
                for at in range(0, len(w), 1 << 16):
                    x = w[at : at + (1 << 16)]
                    yield _batch(schema, x[:, 1], ids[rows[x[:, 0]]], _packed(x[:, 2], x[:, 3], x[:, 4]))

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(make, schema)


def aligned(links: list[tuple[int, int, int]], least: int = LEAST_HASHES) -> list[tuple[int, int, int, int]]:
    """Regions (from, to, first from, first to) where enough hash functions agree, of links (k, win, first win).

    Links are joined while their centres and their diagonals stay within two passage lengths.
    """

    def at(win: int) -> tuple[int, int, int]:
        c = win >> 20
        return c, c - (win >> 10 & 1023), c + (win & 1023)

    rows = sorted((at(w), at(f), k) for k, w, f in links)
    out: list[tuple[int, int, int, int]] = []
    open_sets: list[list] = []
    for row in rows:
        (c, _, _), (f, _, _), _ = row
        open_sets = [s for s in open_sets if c - s[-1][0][0] <= 2 * MIN_WORDS or _done(s, out, least)]
        for s in open_sets:
            if abs((f - c) - (s[-1][1][0] - s[-1][0][0])) <= 2 * MIN_WORDS:
                s.append(row)
                break
        else:
            open_sets.append([row])
    for s in open_sets:
        _done(s, out, least)
    return out


def _done(rows: list, out: list, least: int) -> bool:
    """Put a finished set of links into out if enough functions agree; always False, for use in a filter."""
    if len({k for _, _, k in rows}) >= least:
        first_lo, first_hi = min(f[1] for _, f, _ in rows), max(f[2] for _, f, _ in rows) + 1
        out.append((min(w[1] for w, _, _ in rows), max(w[2] for w, _, _ in rows) + 1, first_lo // SNAP * SNAP, -(-first_hi // SNAP) * SNAP))
    return False


def merged(regions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Regions (from, to, first from, first to) of a pair of documents, joined where they overlap on both sides."""
    out: list[list[int]] = []
    for r in sorted(regions):
        for o in out:
            if r[0] <= o[1] and o[0] <= r[1] and r[2] <= o[3] and o[2] <= r[3]:
                o[:] = [min(o[0], r[0]), max(o[1], r[1]), min(o[2], r[2]), max(o[3], r[3])]
                break
        else:
            out.append(list(r))
    return [tuple(o) for o in out]


def aligned_all(links: np.ndarray, sizes: np.ndarray, least: int = LEAST_HASHES) -> np.ndarray:
    """Rows (pair number, *region) as `aligned` makes them, of the links (k, win, first win) of consecutive pairs.

    No set of links reaches over a gap between centres, so the links of a pair fall apart there; where all diagonals of what
    is between two gaps are near each other it is one set. Only the others are looked at one by one.
    """
    k, win, first = links.T
    owner = np.repeat(np.arange(len(sizes)), sizes)
    c, f = win >> 20, first >> 20
    lo, hi, first_lo, first_hi = c - (win >> 10 & 1023), c + (win & 1023), f - (first >> 10 & 1023), f + (first & 1023)
    order = np.lexsort((k, first_hi, first_lo, f, hi, lo, c, owner))
    links, owner, c, way, kinds = links[order], owner[order], c[order], (f - c)[order], 1 << k[order]
    at = np.flatnonzero(np.concatenate(([True], (np.diff(owner) > 0) | (np.diff(c) > 2 * MIN_WORDS))))
    turns = np.concatenate(([False], np.abs(np.diff(way)) > 2 * MIN_WORDS))
    turns[at] = False
    mixed = np.bitwise_or.reduceat(turns, at)
    kinds = np.bitwise_or.reduceat(kinds, at)
    good = ~mixed & (sum(kinds >> j & 1 for j in range(8)) >= least)
    ends = [g.reduceat(x[order], at)[good] for g, x in ((np.minimum, lo), (np.maximum, hi), (np.minimum, first_lo), (np.maximum, first_hi))]
    out = [np.stack([owner[at][good], ends[0], ends[1] + 1, ends[2] // SNAP * SNAP, -(-(ends[3] + 1) // SNAP) * SNAP], axis=1)]
    stops = np.append(at[1:], len(owner))
    for a, b in zip(at[mixed].tolist(), stops[mixed].tolist(), strict=True):
        out += [np.array([(owner[a], *r)]) for r in aligned(list(map(tuple, links[a:b].tolist())), least)]
    return np.concatenate(out)


def merged_all(links: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (pair number, *region) as `merged` makes them, of the regions of consecutive pairs."""
    parts = np.split(links, np.cumsum(sizes)[:-1])
    return np.array([(i, *r) for i, part in enumerate(parts) for r in merged(part.tolist())])


def _regions_of(pairs: DataFrame, join) -> DataFrame:
    """PAIRS of rows (doc_id, first_id, links): join makes the regions of all pairs' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spans = _spans(batch, 2)
                rows = join(np.concatenate(spans), np.array([len(x) for x in spans]))
                if len(rows):
                    yield _batch(PAIRS, *(batch.column(i).to_numpy()[rows[:, 0]] for i in (0, 1)), *(rows[:, i].astype(np.int32) for i in range(1, 5)))

    return pairs.select("doc_id", "first_id", "links").mapInArrow(run, PAIRS)


def _wanted(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(doc_id, spans): the distinct regions of each document in pairs, their size in bytes, and that of their tokens."""
    mine = pairs.select("doc_id", "lo", "hi")
    theirs = pairs.select(F.col("first_id").alias("doc_id"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi"))
    grouped = scratch.save(mine.union(theirs).groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "wanted")
    tokens = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["hi"] - x["lo"]) * 8 + 60)
    size = grouped.agg(F.sum(F.size("spans") * 16 + 40), F.sum(tokens)).first()
    return grouped, size[0] or 0, size[1] or 0


REGIONS = "doc_id long, lo int, hi int, tokens binary"
#: A region's tokens beside the first document's region that they are compared with, or (doc_id = first_id) that one's own.
SIDES = "first_id long, first_lo int, first_hi int, doc_id long, lo int, hi int, tokens binary"


def _spans(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    """The rows of a column of arrays of structs of whole numbers, one array a row."""
    column = batch.column(at)
    flat, ends = column.flatten(), np.cumsum(np.concatenate(([0], np.diff(column.offsets.to_numpy()))))
    fields = np.stack([np.array(flat.field(i)) for i in range(flat.type.num_fields)], axis=1).astype(np.int64)
    return [fields[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sides(given: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """SIDES of the whole texts for pairs (PAIRS): a row for each pair and one for each region of a first document.

    A region leaves the texts with the key that it is compared by, so its tokens are shuffled once. The spans grow with the
    texts, so both are shuffled at every size; the spans are the hashed side, texts aren't sorted.
    """
    key = ["first_id", "first_lo", "first_hi"]
    firsts = pairs.select(*(F.col(c).alias(n) for c, n in zip(key, ["doc_id", "lo", "hi"], strict=True)), *key)
    spans = pairs.select("doc_id", "lo", "hi", *key).union(firsts)
    wanted = scratch.save(spans.groupBy("doc_id").agg(F.collect_set(F.struct(*key, "lo", "hi")).alias("spans")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0).to_numpy(), _spans(batch, 2)
            for rows, tokens, sizes in chunks(batch.column(1)):
                base, out, size = np.cumsum(sizes) - sizes, [], 0
                for row, at, n in zip(rows.tolist(), base.tolist(), sizes.tolist(), strict=True):
                    for *first, lo, hi in spans[row].tolist():
                        out.append((*first, ids[row], lo, hi, tokens[at + lo : at + min(hi, n)].tobytes()))
                        size += len(out[-1][-1])
                        if size > CUT_BYTES:
                            yield _batch(SIDES, *map(list, zip(*out, strict=True)))
                            out, size = [], 0
                if out:
                    yield _batch(SIDES, *map(list, zip(*out, strict=True)))

    return given.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans").mapInArrow(cut, SIDES)


def _cut_stretches(stretches: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """REGIONS as _cut_texts makes them, from stretches (doc_id, lo, tokens) that hold the regions wholly."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _spans(batch, 3)
            out = []
            for i, d, start, rows in zip(range(len(ids)), ids.tolist(), starts.tolist(), spans, strict=True):
                tokens = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8")
                out += [(d, lo, hi, tokens[lo - start : hi - start].tobytes()) for lo, hi in rows.tolist() if start <= lo and hi <= start + len(tokens)]
            if out:
                yield _batch(REGIONS, *map(list, zip(*out, strict=True)))

    return stretches.join(small(wanted, size), "doc_id").select("doc_id", "lo", "tokens", "spans").mapInArrow(cut, REGIONS)


def _checked(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """CHECKED of pairs (PAIRS and tokens) with the first documents' regions (REGIONS): rows of a passage or of equal windows."""
    first = regions.select(F.col("doc_id").alias("first_id"), F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), F.col("tokens").alias("first_tokens"))
    both = pairs.join(first, ["first_id", "first_lo", "first_hi"])
    both = both.select("doc_id", "first_id", "lo", "hi", "first_lo", "tokens", "first_tokens")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = side = None  # a first region's rows may come in several batches
        for batch in batches:
            rows, out = zip(*(batch.column(i).to_numpy().tolist() for i in range(5)), strict=True), []
            for i, (d, f, lo, hi, first_lo) in enumerate(rows):
                mine, theirs = (batch.column(c)[i].as_buffer() for c in (5, 6))
                if side is None or not theirs.equals(last):  # rows come by first region
                    last, side = theirs, Side(np.frombuffer(theirs, "<u8"))
                tokens, equal = np.frombuffer(mine, "<u8"), []
                out += [(d, f, lo + a, b - a + SHINGLE - 1, first_lo + at, sim, None, None) for a, b, at, sim in verified(tokens, side, equal=equal)]
                for a, b in equal:  # windows that reach over an end of the stretch differ, but none reaches over an end of the text
                    a, b = a if lo + a == 0 else a + WIDTH - 1, b if b == len(tokens) < hi - lo else b - WIDTH + 1
                    if a < b:
                        out.append((d, f, None, None, None, None, lo + a, lo + b - 1))
            if out:
                yield _batch(CHECKED, *map(list, zip(*out, strict=True)))

    return both.mapInArrow(check, CHECKED)


def _passages(checked: DataFrame) -> DataFrame:
    """FOUND of CHECKED."""
    rows = checked.where("start_word is not null")
    return rows.groupBy("doc_id", "first_doc_id", "start_word", "n_words").agg(F.min("first_start_word").alias("first_start_word"), F.max("similarity").alias("similarity"))


def _told_apart(given: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, bool]:
    """(doc_id, text_hash, own_id) for every text of an id that several texts share, None if there is no such id.

    The text with the least hash keeps the id; the others get ids of their own above all others, so they come last. And
    whether any id has several rows.
    """
    hashed = given.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"))
    counted = hashed.groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"), F.count("*").alias("n"))
    repeated = scratch.save(counted.where("n > 1").drop("n"), "repeated-ids")
    shared = repeated.where("least <> most").drop("most")
    if shared.isEmpty():
        return None, not repeated.isEmpty()
    top = given.agg(F.max("doc_id")).first()[0]
    rows = hashed.join(shared, "doc_id").distinct()
    # made once, as the table is written
    return scratch.save(rows.select("doc_id", "text_hash", F.when(F.col("text_hash") == F.col("least"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.lit(top + 1)).alias("own_id")), "own-ids"), True


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_doc_id, start_word, n_words, first_start_word, similarity, text_hash): passages an earlier document has.

    One row for each stretch of a document in which every 50-word window is similar to one of an earlier document, the
    first one with that passage where there are many; the document with the smallest id of a group has no row for it.
    Documents without such passages don't appear: clean ones, null, empty and short texts. Rows with a null id take no
    part. Rows that repeat an id and its text count as one document; of texts that share an id each is a document of its
    own, the one with the least hash in the id's place, the others after all other documents, and text_hash (XXH64 as
    Spark has it, null elsewhere) says which one a row is about. Ties are broken by position. Other columns are not read,
    so clashing names don't matter. An empty table gives an empty result.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        own, repeated = _told_apart(given, scratch)
        if own is not None:
            names = small(own.withColumnRenamed("doc_id", "__id"), own.count() * 40)
            same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("text_hash"))
            given = given.join(names, same, "left").select(F.coalesce("own_id", "doc_id").alias("doc_id"), "text")
        found = _found(given, repeated, scratch)
        if own is None:
            return scratch.keep(found.withColumn("text_hash", F.lit(None).cast("long")), "passages")
        a, b = own.select(F.col("own_id").alias("__own"), F.col("doc_id").alias("__id"), "text_hash"), own.select(F.col("own_id").alias("__first_own"), F.col("doc_id").alias("__first_id"))
        told = found.join(a, F.col("doc_id") == F.col("__own"), "left").join(b, F.col("first_doc_id") == F.col("__first_own"), "left")
        rest = ["start_word", "n_words", "first_start_word", "similarity", "text_hash"]
        return scratch.keep(told.select(F.coalesce("__id", "doc_id").alias("doc_id"), F.coalesce("__first_id", "first_doc_id").alias("first_doc_id"), *rest), "passages")


def _found(given: DataFrame, repeated: bool, scratch: Scratch) -> DataFrame:
    """FOUND of given (doc_id, text), ids of which stand for one text each; repeated: some have several rows."""
    every = scratch.save(window_rows(given), "windows")
    # keys that several documents have; one row a key and task goes over the wire. What is aggregated is written before it
    # is joined: a join of plain exchanges can split a hot key's partition. The keys are the hashed side: windows aren't sorted
    least = every.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("most")).where("first_id < most").drop("most")
    many = scratch.save(least, "repeated-keys")
    shared = scratch.save(every.join(many.hint("shuffle_hash"), "key"), "shared-windows")
    for name in ("windows", "repeated-keys"):
        scratch.drop(name)
    first = scratch.save(shared.where("doc_id = first_id").groupBy("key").agg(F.min("win").alias("first_win")), "first-windows")
    links = shared.where("doc_id > first_id").join(first.hint("shuffle_hash"), "key")
    by_pair = links.groupBy("doc_id", "first_id").agg(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(7)).alias("k"), "win", "first_win")).alias("links"))
    pairs = scratch.save(_regions_of(by_pair.where(F.size("links") >= LEAST_HASHES), aligned_all), "aligned")
    scratch.drop("first-windows")
    sides = _sides(given, pairs, scratch)
    sides = scratch.save(sides.distinct() if repeated else sides, "regions")
    checked = scratch.save(_checked(sides.where("doc_id <> first_id"), sides.where("doc_id = first_id")), "checked")
    for name in ("regions", "aligned", "wanted"):
        scratch.drop(name)
    found = scratch.save(_passages(checked), "found")
    same = checked.where("same_from is not null").select("doc_id", "same_from", "same_to")
    for more in _later(given, shared, found, same, scratch):
        found = found.union(more)
    return found


def _unsettled(rows: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """rows (doc_id, at, ...) whose shingle `at` lies in no passage of found."""
    # a passage in every cell of MIN_WORDS shingles that it touches, so long documents are no product of rows and passages
    end = F.col("start_word") + F.col("n_words") - SHINGLE
    spans = found.select("doc_id", F.col("start_word").alias("__a"), end.alias("__b"), F.explode(F.sequence(F.expr(f"start_word div {MIN_WORDS}"), F.floor(end / MIN_WORDS))).alias("__cell"))
    same = (rows["doc_id"] == spans["doc_id"]) & (F.floor(rows[at] / MIN_WORDS) == spans["__cell"]) & (rows[at] >= spans["__a"]) & (rows[at] <= spans["__b"])
    return rows.join(spans, same, "left_anti")


def _centres(packed: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Sorted centres of open windows that have a shared window of another function within a passage's reach.

    packed: centre, function (three bits) and whether the window's key is open (one bit) of a document's shared windows.
    same: rows (from, to) of centres that are left out.
    """
    c, k = packed >> 4, packed >> 1 & 7
    ask = np.unique(c[packed & 1 == 1])
    before = np.searchsorted(np.sort(same[:, 0]), ask, side="right") - np.searchsorted(np.sort(same[:, 1]), ask)
    ask = ask[before == 0]
    functions = np.zeros(len(ask), np.int64)
    for f in np.unique(k):
        own = np.sort(c[k == f])
        i = np.searchsorted(own, ask - WIDTH + 1)
        functions += (i < len(own)) & (own[i.clip(max=len(own) - 1)] < ask + WIDTH)
    return ask[functions >= LEAST_HASHES]


def _asked(shared: DataFrame, open_keys: DataFrame, same: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, centres): where documents with an open key are asked for it.

    Windows that have the same tokens as one of an earlier document (same) aren't: whatever is similar to them is similar to
    that one, which is asked or has the same tokens as a still earlier one. So of many copies only what differs is asked.
    """
    marked = shared.join(open_keys.withColumn("open", F.lit(1)), "key", "left")
    packed = F.shiftright("win", 20) * 16 + F.col("key").bitwiseAND(F.lit(7)) * 2 + F.coalesce("open", F.lit(0))
    grouped = marked.groupBy("doc_id").agg(F.collect_list(packed).alias("near"), F.max("open").alias("open")).where("open = 1").drop("open")
    known = same.groupBy("doc_id").agg(F.collect_set(F.struct("same_from", "same_to")).alias("same"))
    schema = "doc_id long, centres array<long>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, near = batch.column(0).to_numpy(), batch.column(1)
            own = np.repeat(np.arange(len(ids)), pc.list_value_length(near).to_numpy())
            packed = near.flatten().to_numpy(zero_copy_only=False) + (own << APART + 4)  # documents far apart from each other
            spans = batch.column(2).flatten()
            own = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)) << APART
            at = np.stack([np.array(spans.field(i)).astype(np.int64) + own for i in (0, 1)], axis=1)
            c = _centres(packed, at)
            rows, sizes = np.unique(c >> APART, return_counts=True)
            if len(c):
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(c & (1 << APART) - 1, pa.int64()))], ["doc_id", "centres"])

    return scratch.save(grouped.join(known, "doc_id", "left").mapInArrow(ask, schema), "open-windows")


def _stretches(given: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lo, tokens): the tokens of all passages with an asked centre, overlapping ones joined."""
    schema = "doc_id long, lo int, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, centres = batch.column(0).to_numpy(), batch.column(2)
            for rows, tokens, sizes in chunks(batch.column(1)):
                base, out = np.cumsum(sizes) - sizes, []
                for row, at, n in zip(rows.tolist(), base.tolist(), sizes.tolist(), strict=True):
                    c = np.array(centres[row].values)
                    new = np.concatenate(([True], np.diff(c) > 2 * WIDTH - 1))
                    ends = np.append(np.flatnonzero(new)[1:], len(c)) - 1
                    for lo, hi in zip(np.maximum(0, c[new] - WIDTH + 1).tolist(), np.minimum(n, c[ends] + WIDTH).tolist(), strict=True):
                        out.append((ids[row], lo, tokens[at + lo : at + hi].tobytes()))
                if out:
                    yield _batch(schema, *map(list, zip(*out, strict=True)))

    return scratch.save(given.join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "centres").mapInArrow(cut, schema), "stretches")


def _common_tokens(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lo, near): for each stretch the places of tokens that a stretch of another document has too.

    near has a place times eight, plus four if a later document has the token, plus two if an earlier one has it, plus one if
    it is looped anywhere; above those PLACE bits it has how often the token occurs.
    """
    schema = "token long, doc_id long, lo int, at int, loops int"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(2)]
            sizes = np.array([len(p) for p in parts])
            at = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            tokens = np.concatenate(parts)
            loops = looped(tokens.view(np.uint64), sizes=sizes).astype(np.int32)
            yield _batch(schema, tokens, *(np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)), at, loops)

    every = scratch.save(stretches.select("doc_id", "lo", "tokens").mapInArrow(spread, schema), "tokens")
    common = every.groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("loops").alias("looped"), F.count("*").alias("n")).where("least < most")
    common = scratch.save(common, "common-tokens")
    flags = F.when(F.col("doc_id") < F.col("most"), 4).otherwise(0) + F.when(F.col("doc_id") > F.col("least"), 2).otherwise(0) + F.col("looped")
    packed = F.shiftleft(F.least("n", F.lit(MOST_COUNTED)), PLACE) + F.col("at").cast("long") * 8 + flags
    return scratch.save(every.join(common.hint("shuffle_hash"), "token").groupBy("doc_id", "lo").agg(F.collect_list(packed).alias("near")), "common-places")


def _signed(stretches: DataFrame, common: DataFrame) -> DataFrame:
    """(joint, doc_id, c, lo, hi, seeks, run): signatures of the hopeful windows of stretches; [lo, hi) holds the windows.

    A window of which another document lacks more than a fifth of the tokens (common has the places of the others) is similar
    to none and has no signature: so edges of a passage that many documents share don't meet in its bands. seeks is 1 if one
    of the windows is hopeful with the tokens of earlier documents alone: others have no earlier window to be similar to. run
    is a hash of the tokens in [lo, hi).
    """
    schema = "joint long, doc_id long, c int, lo int, hi int, seeks int, run long"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(2)]
            ids, starts, near = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            ends, stops = np.cumsum([len(p) for p in parts]), np.cumsum(pc.list_value_length(near).to_numpy())
            packed = near.flatten().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(parts):  # about SIGNED tokens at once
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SIGNED)))
                sizes = np.array([len(p) for p in parts[at:to]])
                tokens = np.concatenate(parts[at:to])
                own = packed[stops[at - 1] if at else 0 : stops[to - 1]]
                base = np.repeat(np.cumsum(sizes) - sizes, np.diff(stops[at:to], prepend=stops[at - 1] if at else 0))
                known = np.zeros(len(tokens), np.int64)
                known[base + ((own & PLACE_MASK) >> 3)] = 8 | own & 7
                side = Side(tokens)
                wanted, seeks = (hopeful(tokens, known & bits > 0, circling=known & 1 > 0, sizes=sizes, side=side) for bits in (8, 2))
                rows = signatures(tokens, sizes, wanted=wanted)
                owner = at + rows[:, 0]
                lo, hi = starts[owner] + rows[:, 2], starts[owner] + rows[:, 3] + WIDTH
                before = np.concatenate(([0], np.cumsum(seeks)))
                base = (np.cumsum(sizes) - sizes)[rows[:, 0]]
                some = before[base + rows[:, 3] + 1] > before[base + rows[:, 2]]
                run = run_hashes(tokens, base + rows[:, 2], base + rows[:, 3] + WIDTH)
                yield _batch(schema, rows[:, 1], ids[owner], *(x.astype(np.int32) for x in ((lo + hi) // 2, lo, hi, some)), run)
                at = to

    return stretches.join(common, ["doc_id", "lo"]).select("doc_id", "lo", "tokens", "near").mapInArrow(make, schema)


def _rare_tokens(stretches: DataFrame, common: DataFrame, regions: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lo, hi, seeks, rare): the rarest tokens of each of regions (doc_id, lo, hi, seeks) of stretches.

    Those that an earlier document has where seeks is 1, those that a later one has where it is 0.
    """
    schema = "doc_id long, lo int, hi int, seeks int, rare array<long>"
    wanted = scratch.save(regions.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "seeks")).alias("spans")), "rare-wanted")
    size = wanted.agg(F.sum(F.size("spans") * 16 + 40)).first()[0] or 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, cut, n = batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), [], 0
            for i, (d, start) in enumerate(zip(ids, starts, strict=True)):
                tokens, spans = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8"), batch.column(4)[i].values
                packed = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                known, count = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
                at = (packed & PLACE_MASK) >> 3
                known[at], count[at] = packed & 7, packed >> PLACE
                for lo, hi, seeks in zip(*(spans.field(c).to_numpy().tolist() for c in range(3)), strict=True):
                    if start <= lo and hi <= start + len(tokens):
                        a, b = lo - start, hi - start
                        cut.append((d, lo, hi, seeks, tokens[a:b], count[a:b], known[a:b] & (2 if seeks else 4) > 0, known[a:b] & 1))
                        n += b - a
                if cut and (n >= SIGNED or i + 1 == len(ids)):
                    *keys, tokens, count, usable, circling = zip(*cut, strict=True)
                    sizes = np.array([len(x) for x in tokens])
                    owner, token = rarest(np.concatenate(tokens), sizes, *map(np.concatenate, (count, usable, circling)))
                    rare = np.split(token.view(np.int64), np.searchsorted(owner, np.arange(1, len(sizes))))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys, kinds), pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "lo", "hi", "seeks", "rare"])
                    cut, n = [], 0

    near = common.join(small(wanted.select("doc_id"), size), "doc_id", "left_semi")
    both = stretches.join(small(wanted, size), "doc_id").join(near, ["doc_id", "lo"])
    return scratch.save(both.select("doc_id", "lo", "tokens", "near", "spans").mapInArrow(find, schema), "rare-tokens")


def _finer(seekers: DataFrame, waiting: DataFrame, stretches: DataFrame, common: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """seekers (joint, doc_id, c, lo, hi) and waiting (joint, first_id, first_lo, first_hi) by finer keys.

    A key is a band and one of the rarest tokens of a window of the region. Similar windows of two regions of a band have one
    in common, so no pair of regions that holds some is lost; windows that only have in common what many others have too
    don't meet. Only what has a key of a seeker goes on waiting; waiting is ranked by idx, from 0, in each key.
    """
    most = scratch.save(seekers.groupBy("joint").agg(F.max("doc_id").alias("most")), "open-bands")
    left = waiting.join(small(most, most.count() * ROW_BYTES), "joint").where("first_id < most").drop("most")
    left = scratch.save(left, "waiting-in-bands")
    theirs = left.select(F.col("first_id").alias("doc_id"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi"), F.lit(0).alias("seeks"))
    rare = _rare_tokens(stretches, common, seekers.select("doc_id", "lo", "hi", F.lit(1).alias("seeks")).union(theirs), scratch)
    seekers = seekers.join(rare.where("seeks = 1").drop("seeks"), ["doc_id", "lo", "hi"])
    seekers = scratch.save(seekers.select("joint", "doc_id", "c", "lo", "hi", F.explode("rare").alias("token")).withColumn("joint", F.xxhash64("joint", "token")).drop("token"), "finer-seekers")
    keys = scratch.save(seekers.groupBy("joint").agg(F.max("doc_id").alias("most")), "finer-keys")
    theirs = rare.where("seeks = 0").select(F.col("doc_id").alias("first_id"), F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), "rare")
    left = left.join(theirs, ["first_id", "first_lo", "first_hi"]).select("joint", "first_id", "first_lo", "first_hi", F.explode("rare").alias("token"))
    left = left.withColumn("joint", F.xxhash64("joint", "token")).drop("token").join(keys, "joint").where("first_id < most").drop("most")
    left = scratch.save(left, "finer-waiting")
    return seekers, scratch.save(ranked(left, "joint", ["first_id", "first_lo", "first_hi"], scratch, "finer"), "finer-ranked")


def _later(given: DataFrame, shared: DataFrame, found: DataFrame, same: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """Further passages for windows that no passage with the first document of their key settles.

    Documents that have the key of such a window meet anew by the signatures of the windows around it: a band of a signature
    is several min-hashes, so windows that are far from the similarity seldom meet. What is open is compared with the first
    EARLIEST documents of each of its bands; what a passage covers then is settled. The rest meets by finer keys (`_finer`)
    and is compared with the first EARLIEST documents of each, then with the next ones, GROWTH times as many each round,
    until no open window has an earlier document with a key of its own that it was not compared with. Most settle at once,
    and a group of r documents takes about log r rounds; each candidate is read in one round, and no pair of a document and
    region is verified twice.
    """
    rows = shared.where("doc_id > first_id").select("key", "doc_id", F.shiftright("win", 20).cast("int").alias("c"))
    open_keys = scratch.save(_unsettled(rows, found, "c").select("key").distinct(), "open-keys")
    stretches = _stretches(given, _asked(shared, open_keys, same, scratch), scratch)
    for name in ("checked", "open-windows", "open-keys", "shared-windows"):
        scratch.drop(name)
    common = _common_tokens(stretches, scratch)
    signed = scratch.save(_signed(stretches, common), "signatures")
    for name in ("tokens", "common-tokens"):
        scratch.drop(name)
    many = scratch.save(signed.groupBy("joint").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "repeated-signatures")
    # a band that returns within REACH shingles (a text that runs in circles) counts once
    place = F.floor(F.col("c") / REACH)
    runs = [F.sum(F.shiftrightunsigned("run", 24)).alias("runs"), F.max("run").alias("run")]  # tells runs of other tokens apart
    spans = [F.min("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("seeks").alias("seeks")]
    left = scratch.save(signed.join(many, "joint").groupBy("joint", "doc_id", "least", place.alias("place")).agg(*spans, *runs), "shared-signatures")
    scratch.drop("signatures")
    seekers = left.where("doc_id > least and seeks = 1").select("joint", "doc_id", "c", "lo", "hi", "runs", "run")
    # of windows with the same tokens in a band the earliest is enough: what is similar to one is similar to all, and a later
    # document with the same tokens meets that one first of all
    earliest = left.groupBy("joint", "runs", "run").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("f"))
    waiting = scratch.save(earliest.select("joint", "runs", "run", F.col("f.doc_id").alias("first_id"), F.col("f.lo").alias("first_lo"), F.col("f.hi").alias("first_hi")), "earliest-runs")
    seekers = scratch.save(_unsettled(seekers, found, "c"), "seekers")
    wanted = scratch.save(seekers.groupBy("joint").agg(F.max("doc_id").alias("most")), "seekers-keys")
    rank = F.row_number().over(Window.partitionBy("joint").orderBy("first_id", "first_lo", "first_hi"))
    # of a band only the first rows of each task go over the wire
    now = waiting.drop("runs", "run").join(small(wanted, wanted.count() * ROW_BYTES), "joint").where("first_id < most").drop("most").withColumn("rank", rank).where(F.col("rank") <= EARLIEST).drop("rank")
    now = scratch.save(now, "candidates")
    met = seekers.drop("runs", "run").join(small(now, now.count() * ROW_BYTES), "joint").where("first_id < doc_id")
    met = met.unionByName(seekers.join(waiting, ["joint", "runs", "run"]).where("first_id < doc_id").drop("runs", "run"))
    tested, found = _compared(met, None, stretches, scratch, 0)
    yield found
    seekers = scratch.save(_unsettled(seekers.drop("runs", "run"), found, "c"), "open-seekers")
    if seekers.isEmpty():
        return
    seekers, waiting = _finer(seekers, waiting.drop("runs", "run"), stretches, common, scratch)
    done, size, turn = 0, EARLIEST, 1
    while True:
        wanted = scratch.save(seekers.groupBy("joint").agg(F.max("doc_id").alias("most")), f"seekers-keys-{turn % 2}")
        now = waiting.where((F.col("idx") >= done) & (F.col("idx") < done + size)).drop("idx")
        now = now.join(small(wanted, wanted.count() * ROW_BYTES), "joint").where("first_id < most").drop("most")
        now = scratch.save(now, f"candidates-{turn % 2}")
        if not (n := now.count()):
            return
        met = seekers.join(small(now, n * ROW_BYTES), "joint").where("first_id < doc_id")
        pairs, found = _compared(met, small(tested, tested.count() * ROW_BYTES), stretches, scratch, turn)
        yield found
        tested = tested.union(pairs)
        seekers = scratch.save(_unsettled(seekers, found, "c"), f"seekers-{turn % 2}")
        done, size, turn = done + size, size * GROWTH, turn + 1


def _compared(met: DataFrame, tested: DataFrame | None, stretches: DataFrame, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame]:
    """PAIRS of met (doc_id, lo, hi, first_id, first_lo, first_hi) that aren't in tested, and FOUND of those."""
    by_pair = met.groupBy("doc_id", "first_id").agg(F.collect_set(F.struct("lo", "hi", "first_lo", "first_hi")).alias("links"))
    pairs = _regions_of(by_pair, merged_all)
    if tested is not None:
        pairs = pairs.join(tested, tested.columns, "left_anti")
    pairs = scratch.save(pairs, f"later-pairs-{turn}")
    cut, n_bytes, n_tokens = _wanted(pairs, scratch)
    regions = scratch.save(_cut_stretches(stretches, cut, n_bytes), "later-regions")
    return pairs, scratch.save(_passages(_checked(pairs.join(small(regions, n_tokens), ["doc_id", "lo", "hi"]), regions)), f"later-found-{turn}")


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the passages of repeated_passages cut out of their texts; documents that keep no word go.

    Columns stay as they were, n_chars follows the text. Rows without a passage stay as they are: clean ones, null and
    empty texts, null ids. Rows that repeat an id lose the passages of their own text only. Empty tables of either kind
    and clashing names of other columns are fine.
    """
    columns = [f"__{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*columns)
    of = dict(zip(docs.columns, columns, strict=True))
    spans = F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end_word"))
    kept = passages.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.sort_array(F.collect_set(spans)).alias("spans"))
    with Scratch(docs.sparkSession) as scratch:
        kept = scratch.keep(kept, "spans")
    size = kept.agg(F.sum(F.size("spans") * 24 + 40)).first()[0] or 0
    same = (F.col(of[doc_id]) == F.col("id")) & (F.col("text_hash").isNull() | (F.xxhash64(of[text]) == F.col("text_hash")))
    joined = named.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, same, "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _cut(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    new = F.when(F.col("id").isNull(), F.col(of[text])).otherwise(cut(F.col(of[text]), F.col("spans")))
    changed = joined.withColumn("new", new).where(F.col("id").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return changed.select(*[_column(c, text, of[c], docs) for c in docs.columns])


def _cut(t: str, spans: list[tuple[int, int]]) -> str:
    """t without the words of spans (from, to)."""
    places = list(WORDS.finditer(t))
    out, at = [], 0
    for a, b in spans:
        if a >= len(places):
            continue
        lo, hi = places[a].start(), places[min(b, len(places)) - 1].end()
        if hi > at:
            out.append(t[at : max(at, lo)])
            at = hi
    return "".join([*out, t[at:]]).strip()


def _column(name: str, text: str, now: str, docs: DataFrame) -> Column:
    if name == text:
        return F.col("new").alias(text)
    if name == "n_chars":
        return F.when(F.col("id").isNull(), F.col(now)).otherwise(F.char_length("new")).cast(docs.schema[name].dataType).alias(name)
    return F.col(now).alias(name)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
