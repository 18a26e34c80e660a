"""Embedding near-duplicates by lattice hashing (operator 4).

Equal vectors collapse to one class. Every table projects a unit vector to 8 dimensions for each lattice point of its key,
scales the projection and decodes the nearest points of E8; a class stands in its own cell and also visits the
neighbouring cells whose lattice vectors lie closest to its residual. A coordinate of a projected unit vector has the
scale as its spread whatever the vector's length, so one setting serves every width. It is the same for every number of
rows too (`SETTING`): whether two vectors meet depends on them, not on the size of the table.

What travels by cell is ids with a sketch of 128 signs, never vectors: rows of a cell whose sketches are too far apart for
the threshold are no candidates. Before that, tight groups collapse to balls: a class joins a reference vector of its
group within half the threshold's angle, so all members of a ball are links of each other and need no comparison.
Candidates are pairs of balls; their members are compared in double precision, the smaller ball visiting tiles of the
larger one, and a task returns a count a member and one edge a pair of balls, never the pairs of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import Scratch, components, read, small

THRESHOLD, SEED = 0.9, 11
#: Rows of one side that a tile of a cell or of a ball holds.
TILE = 1024
#: Signs of a sketch, and by how many standard deviations a pair at the threshold may exceed the expected differences.
SIGNS, DEVIATIONS = 128, 3.7
#: Keys by which a class looks for the reference vector of its group.
HOMES = 8
#: Cells of up to so many rows are compared all at once, by offset.
SMALL_CELL = 64


@dataclass(frozen=True)
class Setting:
    """E8 points in a key, spread of a projected coordinate, tables, neighbouring cells visited in each."""

    points: int
    scale: float
    tables: int
    probes: int


#: Finds pairs at a cosine of 0.9 with a recall of 0.99; of random vectors of 64 floats 6 in 10,000 meet.
SETTING = Setting(2, 0.5625, 42, 1)
#: The keys of HOMES: so fine that vectors which are not alike rarely share one.
FINE = Setting(3, 0.65, HOMES, 0)


def setting_for(n: int) -> Setting:
    """The setting for a table of n rows: SETTING for any n, so that no link depends on the size of the table."""
    return SETTING


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum)."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    other = near.copy()
    other[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return np.where((near.sum(axis=1) % 2 != 0)[:, None], other, near)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 with its copy shifted by one half."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or all +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            rows.append(v)
    rows += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(rows)


def _keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One 64-bit key of each row of (doubled, integer) lattice coordinates; tables and dimensions don't meet."""
    out = np.full(len(points), (0x9E3779B97F4A7C15 * (2 * table + 1) ^ dim) & (2**64 - 1), np.uint64)
    for c in np.rint(2 * points).astype(np.int64).view(np.uint64).T:
        out = (out ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@cache
def _projection(dim: int, columns: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([*seed, dim]).standard_normal((dim, columns))


def cells(unit: np.ndarray, setting: Setting, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table: own cell keys (n), probed keys (n, probes)."""
    out, dim, k = [], unit.shape[1], setting.points
    for t in range(setting.tables):
        shift = np.random.default_rng([seed, t, 1]).uniform(0, 1, 8 * k)
        x = (unit @ _projection(dim, 8 * k, seed, t)) * setting.scale + shift
        own = np.concatenate([decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(k)], axis=1)
        near = []
        if setting.probes:
            short = least_vectors()
            gain = np.concatenate([(x - own)[:, 8 * b : 8 * b + 8] @ short.T for b in range(k)], axis=1)
            best = gain.argmax(axis=1)[:, None] if setting.probes == 1 else np.argpartition(-gain, setting.probes - 1, axis=1)[:, : setting.probes]
            for p in range(setting.probes):
                q, which = own.copy(), best[:, p] // len(short)
                for b in range(k):
                    hit = which == b
                    q[hit, 8 * b : 8 * b + 8] += short[best[hit, p] % len(short)]
                near.append(_keys(q, t, dim))
        out.append((_keys(own, t, dim), np.stack(near, axis=1) if near else np.zeros((len(unit), 0), np.int64)))
    return out


def sketches(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Signs of SIGNS random projections, as two longs a row."""
    signs = unit @ _projection(unit.shape[1], SIGNS, seed, 1 << 20) >= 0
    return np.packbits(signs, axis=1).view("<i8").astype(np.int64)


@cache
def most_differences(threshold: float) -> np.ndarray:
    """By whole degrees of slack: how many signs may differ between vectors at the threshold's angle plus that slack."""
    p = ((math.degrees(math.acos(min(1.0, max(-1.0, threshold)))) + np.arange(181)) / 180).clip(0, 1)
    return np.floor(SIGNS * p + DEVIATIONS * np.sqrt(SIGNS * p * (1 - p)) + 0.5).astype(np.int64)


def _unit(blobs: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision of equally long stored vectors."""
    n = len(blobs)
    v = np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(n, -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_width(blobs: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of each length."""
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _stored(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, vec): the components as bytes; null for vectors that link with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(1)
            n, sizes = len(e), pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = e.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # + 0.0 turns -0.0 to 0.0
            ends = np.cumsum(sizes)
            count = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[ends] - c[ends - sizes]  # noqa: E731, B023
            good = (sizes > 0) & (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)
            kept = np.where(good, sizes, 0) * np.dtype(kind).itemsize
            offsets = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
            data = values[np.repeat(good, sizes)].tobytes()
            valid = np.packbits(good, bitorder="little").tobytes()
            vec = pa.Array.from_buffers(pa.large_binary(), n, [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), vec.cast(pa.binary())], ["vec_id", "vec"])

    return vectors.mapInArrow(pack, "vec_id long, vec binary")


def _with_homes(classes: DataFrame, kind: str, setting: Setting) -> DataFrame:
    """classes with the array column `homes`: fine cells, one of each table."""
    names = [*classes.columns, "homes"]
    at = classes.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = np.zeros((batch.num_rows, setting.tables), np.int64)
            for rows in _by_width(batch.column(at)):
                homes[rows] = np.stack([own for own, _ in cells(_unit(batch.column(at).take(pa.array(rows)), kind), setting, SEED + 1)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, homes.size + 1, setting.tables, dtype=np.int32), pa.array(homes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    return classes.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in classes.dtypes), "homes array<bigint>"]))


def _gathered(classes: DataFrame, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(cid, ball, slack, s0, s1) of the classes that lie within half the threshold's angle of a reference, their ball.

    The reference is the least class that shares a home; slack is the angle to it in whole degrees, rounded up, and s0, s1
    are its sketch. All members of a ball are links of each other.
    """
    homes = classes.select("cid", F.explode("homes").alias("home"))
    shared = scratch.save(homes.groupBy("home").agg(F.min("cid").alias("ref"), F.count("*").alias("n")).where("n > 1").drop("n"), "homes")
    named = scratch.save(homes.join(shared, "home").where("ref < cid").groupBy("cid").agg(F.min("ref").alias("ref")), "references")
    refs = scratch.save(named.select(F.col("ref").alias("cid")).distinct(), "reference-ids")
    vectors = classes.select("cid", "vec")
    ref_vectors = scratch.save(vectors.join(small(refs, refs.count() * 16), "cid").toDF("ref", "ref_vec"), "reference-vectors")
    near = vectors.join(small(named, named.count() * 32), "cid").join(ref_vectors, "ref").select("cid", "ref", "vec", "ref_vec")
    half = math.sqrt((1 + threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            same = np.flatnonzero(pc.equal(pc.binary_length(a), pc.binary_length(b)).to_numpy(zero_copy_only=False))
            got = [np.zeros((0, 5), np.int64)]
            cid, ref = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows in _by_width(a.take(pa.array(same))) if len(same) else ():
                rows = same[rows]
                u, w = _unit(a.take(pa.array(rows)), kind), _unit(b.take(pa.array(rows)), kind)
                cos = (u * w).sum(axis=1)
                inside = cos >= half
                slack = np.ceil(np.degrees(np.arccos(cos[inside].clip(-1, 1)))).astype(np.int64)
                got.append(np.column_stack([cid[rows][inside], ref[rows][inside], slack, sketches(w[inside])]))
            rows = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["cid", "ball", "slack", "s0", "s1"])

    return scratch.save(near.mapInArrow(run, "cid long, ball long, slack long, s0 long, s1 long"), "gathered")


def _placed(members: DataFrame, kind: str, setting: Setting, residents_only: bool = False) -> DataFrame:
    """(cell, probe, ball, slack, s0, s1) of members (cid, vec, ball, slack, s0, s1); within a batch each ball once a cell."""
    names = ["cell", "probe", "ball", "slack", "s0", "s1"]
    setting = replace(setting, probes=0) if residents_only else setting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            ball = batch.column(2).to_numpy()
            slack, s0, s1 = (np.array(batch.column(i)) for i in (3, 4, 5))
            for rows in _by_width(vec):
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    unit = _unit(vec.take(pa.array(some)), kind)
                    alone = slack[some] == 0  # its own ball, or equal in direction to its reference
                    s0[some[alone]], s1[some[alone]] = sketches(unit[alone]).T
                    own, near = map(list, zip(*cells(unit, setting), strict=True))
                    keys = np.concatenate([*own, *(n.ravel(order="F") for n in near)])
                    probe = np.repeat([False, True], [len(some) * len(own), len(keys) - len(some) * len(own)])
                    who = np.tile(some, len(keys) // len(some))
                    # several members of a ball in a cell count once, with the largest slack
                    order = np.lexsort((-slack[who], ball[who], keys, probe))
                    first = np.ones(len(order), bool)
                    a, b = order[1:], order[:-1]
                    first[1:] = (keys[a] != keys[b]) | (ball[who[a]] != ball[who[b]]) | (probe[a] != probe[b])
                    take = order[first]
                    columns = [keys[take], probe[take], *(c[who[take]] for c in (ball, slack, s0, s1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return members.select("cid", "vec", "ball", "slack", "s0", "s1").mapInArrow(run, "cell long, probe boolean, ball long, slack long, s0 long, s1 long")


def _met(rows: np.ndarray, start: np.ndarray, size: np.ndarray, home: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs (ball, ball) of one cell whose sketches are near; rows (ball, slack, s0, s1), residents first in every cell.

    start and size give the cells; cells of more than SMALL_CELL rows are compared in blocks, the others by offset.
    """
    found = []
    cell_of = np.repeat(np.arange(len(size)), size)
    end = (start + size)[cell_of]
    i = np.flatnonzero(home & (size <= SMALL_CELL)[cell_of])
    offset = 0
    while len(i):
        offset += 1
        i = i[i + offset < end[i]]
        found.append(_close(rows[i], rows[i + offset], most))
    for s, n in zip(start[size > SMALL_CELL], size[size > SMALL_CELL], strict=True):
        found.append(_crossed(rows[s : s + n], rows[s : s + n][home[s : s + n]], most))
    return np.concatenate([np.zeros((0, 2), np.int64), *found])


def _close(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count((a[:, 2:] ^ b[:, 2:]).view(np.uint64)).sum(axis=1)
    hit = (differ <= most[a[:, 1] + b[:, 1]]) & (a[:, 0] != b[:, 0])
    return np.column_stack([a[hit, 0], b[hit, 0]])


def _crossed(rows: np.ndarray, residents: np.ndarray, most: np.ndarray) -> np.ndarray:
    """As _close, of all rows with all residents, in blocks."""
    found = []
    for at in range(0, len(rows), TILE):
        part = rows[at : at + TILE]
        for to in range(0, len(residents), TILE):
            other = residents[to : to + TILE]
            differ = sum(np.bitwise_count((part[:, c, None] ^ other[None, :, c]).view(np.uint64)).astype(np.int16) for c in (2, 3))
            i, j = np.nonzero((differ <= most[part[:, 1, None] + other[None, :, 1]]) & (part[:, 0, None] != other[None, :, 0]))
            ends = np.column_stack([part[i, 0], other[j, 0]])
            found.append(np.unique(np.column_stack([ends.min(axis=1), ends.max(axis=1)]), axis=0) if len(ends) else ends)
    return np.concatenate([np.zeros((0, 2), np.int64), *found])


def candidates(members: DataFrame, kind: str, setting: Setting, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: balls with members that share a cell and whose sketches don't rule a link out; each pair once."""
    placed = _placed(members, kind, setting)
    # cells with more residents than a tile holds are dealt to tiles; visitors and residents go to every tile of theirs
    crowded = scratch.save(_placed(members, kind, setting, residents_only=True).groupBy("cell").count().where(F.col("count") > TILE), "crowded-cells")
    tiles = crowded.select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(small(tiles, crowded.count() * 32), "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("ball"), "tiles").cast("int")
    dealt = tiled.withColumn("own", own).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("cell", "tile", (~F.col("probe") & (F.col("tile") == F.col("own"))).alias("home"), "ball", "slack", "s0", "s1")
    dealt = dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile", F.desc("home"))
    most = most_differences(threshold)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None  # the last cell's key and residents: it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, tile, home = (np.array(batch.column(i)) for i in range(3))
            rows = np.column_stack([np.array(batch.column(i)) for i in range(3, 7)])
            start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])])
            size = np.diff(np.append(start, len(rows)))
            found = [_met(rows, start, size, home, most)]
            if now == (cell[0], tile[0]):
                first = rows[: size[0]]
                found.append(_crossed(first, held, most))
                held = np.concatenate([held, first[home[: size[0]]]])
            if now != (cell[-1], tile[-1]):
                now, held = (cell[-1], tile[-1]), rows[start[-1] :][home[start[-1] :]]
            ends = np.concatenate(found)
            ends = np.unique(np.column_stack([ends.min(axis=1), ends.max(axis=1)]), axis=0) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], ["a", "b"])

    return scratch.save(dealt.mapInArrow(meet, "a long, b long").distinct(), "candidates")


def verified(members: DataFrame, pairs: DataFrame, kind: str, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a, b) of balls: (cid, others), the linked vectors in other balls of each class, and the balls that link.

    The larger ball of a pair stands in tiles, the members of the smaller one visit each tile; a task returns one count a
    member and visit, so a large group costs its rows times the tiles, not its square in rows.
    """
    touched = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    sizes = scratch.save(members.select("ball").join(touched, "ball").groupBy("ball").count(), "ball-sizes")
    of = lambda x: sizes.select(F.col("ball").alias(x), F.col("count").alias(f"n_{x}"))
    larger = F.struct("n_a", F.col("a")) >= F.struct("n_b", F.col("b"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    both = both.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("guest"), F.ceil(F.greatest("n_a", "n_b") / TILE).cast("int").alias("tiles"))
    both = scratch.save(both, "visits")
    row = [F.col(c) for c in ("cid", "copies", "vec")]
    owners = both.select(F.col("owner").alias("ball"), "tiles").distinct()
    stand = members.join(owners, "ball").select(F.col("ball").alias("owner"), F.pmod(F.xxhash64("cid"), "tiles").cast("int").alias("tile"), F.lit(None).cast("long").alias("guest"), *row)
    visit = members.join(both.withColumnRenamed("guest", "ball"), "ball").select("owner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("ball").alias("guest"), *row)
    dealt = stand.union(visit).repartition("owner", "tile").sortWithinPartitions("owner", "tile", F.col("guest").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            owner, tile, cid, copies = (np.array(batch.column(i)) for i in (0, 1, 3, 4))
            guest, vec = batch.column(2), batch.column(5)
            stands = guest.is_null().to_numpy(zero_copy_only=False)
            guest = guest.fill_null(0).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (tile[1:] != tile[:-1])]) if len(owner) else []
            counts, edges = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(start, [*start[1:], len(owner)], strict=False):
                mine = lo + np.flatnonzero(stands[lo:hi])
                theirs = lo + np.flatnonzero(~stands[lo:hi])
                if now != (owner[lo], tile[lo]):
                    now, held = (owner[lo], tile[lo]), None
                if len(mine):
                    unit = _unit(vec.take(pa.array(mine)), kind)
                    held = (cid[mine], copies[mine], unit) if held is None else (np.r_[held[0], cid[mine]], np.r_[held[1], copies[mine]], np.r_[held[2], unit])
                for at in range(0, len(theirs) if held is not None else 0, TILE):
                    some = theirs[at : at + TILE]
                    for rows in _by_width(vec.take(pa.array(some))):
                        rows = some[rows]
                        unit = _unit(vec.take(pa.array(rows)), kind)
                        if unit.shape[1] != held[2].shape[1]:
                            continue
                        link = held[2] @ unit.T >= threshold
                        up, across = link @ copies[rows], held[1] @ link
                        counts += [np.column_stack([held[0], up])[up > 0], np.column_stack([cid[rows], across])[across > 0]]
                        edges.append(np.unique(np.column_stack([np.full(len(rows), owner[lo]), guest[rows]])[across > 0], axis=0))
            sums, pairs = np.concatenate(counts), np.unique(np.concatenate(edges), axis=0)
            ids, place = np.unique(sums[:, 0], return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, place, sums[:, 1])
            out = np.concatenate([np.column_stack([np.zeros(len(ids), np.int64), ids, total]), np.column_stack([np.ones(len(pairs), np.int64), pairs])])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], ["edge", "x", "y"])

    out = scratch.save(dealt.mapInArrow(compare, "edge long, x long, y long"), "compared")
    counts = out.where("edge = 0").groupBy(F.col("x").alias("cid")).agg(F.sum("y").alias("others"))
    return counts, out.where("edge = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0, their own
    component. Vectors of different lengths never link. Equal vectors link with each other, and rows that repeat an id
    count as different vectors. A row with a null id links like any other and counts in its neighbours' n_links, but never
    names a component: its component_id is the smallest id it reaches, null if there is none, and it is not kept. Other
    columns are not read, so clashing names don't matter. An empty table gives an empty result.
    """
    single = "float" in vectors.schema[embedding].dataType.simpleString()
    kind = "<f4" if single else "<f8"  # components are stored as they are given; all arithmetic is in double precision
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("e"))
    stored = _stored(given, kind)
    with Scratch(vectors.sparkSession) as scratch:
        distinct = stored.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        # ids of classes are made once, as the table is written, and read from there
        rows = distinct.select(F.monotonically_increasing_id().alias("cid"), F.sha2("vec", 256).alias("digest"), "first", "copies", "vec")
        classes = scratch.save(_with_homes(rows, kind, FINE), "classes")
        gathered = _gathered(classes, kind, threshold, scratch)
        joined = classes.drop("homes").join(small(gathered, gathered.count() * 48), "cid", "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("slack", "s0", "s1")]
        members = scratch.save(joined.select("cid", "digest", "first", "copies", "vec", F.coalesce("ball", "cid").alias("ball"), *zero), "members")
        scratch.drop("classes")
        # a reference can have joined another ball than its own: those two balls meet in any case
        moved = gathered.select(F.col("ball").alias("a")).distinct().join(members.select(F.col("cid").alias("a"), F.col("ball").alias("b")), "a").where("a <> b")
        pairs = candidates(members, kind, SETTING, threshold, scratch)
        pairs = pairs.union(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        counts, edges = verified(members, pairs, kind, threshold, scratch)
        edges = scratch.save(edges, "ball-edges")
        named = components(edges, scratch=scratch).toDF("ball", "label")
        facts = members.select("cid", "digest", "first", "copies", "ball").join(named, "ball", "left").withColumn("label", F.coalesce("label", "ball"))
        facts = scratch.save(facts, "labels")
        least = scratch.save(facts.groupBy("label").agg(F.min("first").alias("component_id")), "least-ids")
        together = scratch.save(facts.groupBy("ball").agg(F.sum("copies").alias("held")), "held")
        linked = facts.join(together, "ball").join(counts, "cid", "left").join(least, "label")
        digests = scratch.save(linked.select("digest", (F.col("held") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id"), "facts")
        all_rows = stored.select("vec_id", F.sha2("vec", 256).alias("digest"))
        out = all_rows.join(digests, "digest", "left")
        alone = F.col("n_links").isNull()
        done = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        return scratch.keep(done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-vectors")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
