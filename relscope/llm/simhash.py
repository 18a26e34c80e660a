"""SimHash near-duplicates: fingerprints, pivot distance tables, components (operator 3).

Fingerprints of whole texts are made in Arrow batches. Equal fingerprints collapse to one class before any comparison,
so thousands of copies cost one row. Classes meet in blocks: if two 64-bit fingerprints differ in at most `radius` bits
and the bits are cut into radius + k blocks, k blocks are equal, so every linked pair shares the value of some choice of
k blocks. A block of too many rows is cut once more: the bits that it leaves open go into radius + 1 parts, one of which two
linked fingerprints share as well, so no pair is lost and no task gets a crowd. Inside a block the pivot distance table (distances to `n_pivots` reference fingerprints) discards every pair
whose coordinates differ by more than `radius` anywhere (triangle inequality), and the survivors are verified on all
bits. Each block returns the edges of a spanning forest, not its pairs, so output stays linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import ASCII_LOWER, Scratch, components, local_rows, read, small, word_blocks

RADIUS, SHINGLE, SEED, N_PIVOTS = 4, 4, 42, 16
#: Rows above which a block is cut into finer ones, and how often.
CROWDED, LEVELS = 4096, 3


def _bit_counts(digests: bytes) -> np.ndarray:
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 15):
        counts += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return counts


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 for null texts and texts without words."""
    if not text:
        return 0
    digest = xxhash.xxh64_digest
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text.encode("utf-8", "replace").translate(ASCII_LOWER)):
        words = carry + block
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            cut = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            counts += _bit_counts(b"".join([digest(joined[i:j], seed) for i, j in cut]))
            total += len(words) - shingle + 1
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not carry:
            return 0
        counts, total = _bit_counts(digest(b" ".join(carry), seed)), 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with the column `out` (long): the fingerprint of the whole text."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, by rule: the XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def block_masks(n_classes: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within `radius` agree under one mask at least.

    k of radius + k blocks must agree; k grows with the number of classes so that a mask's value stays selective.
    """
    k = 1 if n_classes <= 1 << 19 else 2 if n_classes <= 1 << 27 else 3 if n_classes <= 1 << 33 else 4
    n = radius + k
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k)]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that contain mask, such that two fingerprints that agree under it and are within `radius` agree under one of them."""
    left = [b for b in range(64) if not mask >> b & 1]
    if len(left) <= radius + 1:
        return [mask]
    edges = [len(left) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in left[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def forest(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS, n_pivots: int = N_PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components that links within `radius` make inside each run of equal groups.

    fps: uint64, sorted by groups. Pairs are visited by their offset in the run, so memory is linear in the rows.
    """
    n = len(fps)
    label, reach = np.arange(n), np.arange(n)
    table = np.bitwise_count(fps[:, None] ^ pivots(n_pivots)[None, :]).astype(np.int8)
    offset = 0
    while len(reach):
        offset += 1
        reach = reach[reach + offset < n]
        reach = reach[groups[reach] == groups[reach + offset]]
        i, j = reach, reach + offset
        for c in range(table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, c] - table[j, c]) <= radius
            i, j = i[near], j[near]
        linked = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        i, j = i[linked], j[linked]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return fps[label[member]], fps[member]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocked(classes: DataFrame, masks: list[int], scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(mask, value, fp): the blocks of classes (fp); crowded ones are replaced by the finer blocks of their rows."""
    spark = classes.sparkSession
    rows = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    for level in range(LEVELS):
        crowded = scratch.save(rows.groupBy("mask", "value").count().where(F.col("count") > CROWDED).drop("count"), f"crowded-{level}")
        n = crowded.count()
        if not n:
            break
        fine = rows.join(small(crowded, n * 32), ["mask", "value"], "left_anti")
        done = fine if done is None else done.unionByName(fine)
        parts = {m: finer(m, radius) for m in masks}
        cut = local_rows(spark, [(_signed(m), _signed(x)) for m, own in parts.items() for x in own], "mask long, part long")
        again = rows.join(small(crowded, n * 32), ["mask", "value"]).join(F.broadcast(cut), "mask")  # five rows a mask
        rows = again.select("fp", F.col("part").alias("mask"), F.col("fp").bitwiseAND(F.col("part")).alias("value"))
        masks = [x for own in parts.values() for x in own]
    return rows if done is None else done.unionByName(rows)


def links(classes: DataFrame, n_classes: int, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints that join the same fingerprints as all links do."""
    rows = blocked(classes, block_masks(n_classes, radius), scratch, radius)
    dealt = rows.select("fp", F.col("mask").alias("m"), F.col("value").alias("key")).repartition("m", "key").sortWithinPartitions("m", "key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["m"] == pdf["m"].iloc[-1]) & (pdf["key"] == pdf["key"].iloc[-1]) if len(pdf) else None
            rest, whole = (pdf[last], pdf[~last]) if len(pdf) else (None, pdf)
            yield run(whole)
        if rest is not None:
            yield run(rest)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, key = pdf["m"].to_numpy(), pdf["key"].to_numpy()
        new = np.ones(len(pdf), bool)
        new[1:] = (m[1:] != m[:-1]) | (key[1:] != key[:-1])
        a, b = forest(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), np.cumsum(new), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Nulls and texts without words have fingerprint 0 and link like any other; repeated rows and ties stay as they are
    (each row comes back); a null id takes part in the links but never names a component unless it is alone. Other
    columns of docs are not read, so clashing names don't matter. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.save(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
        classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        found = components(links(classes, classes.count(), scratch), scratch=scratch)
        named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        least = named.groupBy("component").agg(F.min("first").alias("component_id"))
        joined = prints.join(named.join(least, "component").select("fp", "component_id"), "fp")
        return scratch.keep(joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near-duplicates")


def keep_first(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest id stays, columns as they were.

    Of repeated rows with that id all stay, also such with another text; rows with a null id stay as well, as nothing can
    name them. Null and empty texts are near-duplicates of each other. An empty table stays empty; other columns, whatever
    their names, are not read.
    """
    first = near_duplicates(docs, doc_id).where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    kept = docs.join(first, docs[doc_id] == first["__first"], "left_semi")
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
