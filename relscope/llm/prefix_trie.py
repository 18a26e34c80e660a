"""Prefix trie of conversations (operator 13).

Conversations, as sequences of turn digests, are sorted over all ranges; neighbours' common prefixes (LCPs) make an array
whose Cartesian tree is the trie: a node is an interval between the nearest smaller values on both sides, equal values of one
interval being one node. The values are found in parallel: a task solves an aligned block of the array with a stack. What it
can't close runs down to the block's minimum and up again; that part alone, with all between its values folded into sums, goes
to the next level, where many blocks' rests are solved in the same way, until one task closes the last of them. An interval
stands for all depths above its parent's, so missing depths are expanded as it closes. Rests are bounded by the depth, not by
the number of conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import Scratch, ranked, read

#: Conversations of a block; blocks whose rests one task of the next level solves; ids of a piece of a node's list.
BLOCK, FAN, PIECE = 512, 256, 4096
#: A conversation keeps up to MOST_SHARED - 1 first turns of the one whose id is rounded down to ROUND.
ROUND, MOST_SHARED = 100, 6
DIGEST = 16

ITEM = pa.struct([("lo", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.int64()), ("chars", pa.list_(pa.int64()))])
ROWS = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("rep", pa.int64()), ("parent", pa.int64()), ("lo", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.int64()), ("sequence", pa.binary()), ("value", pa.int64()), ("equal", pa.int64()), ("inner", ITEM), ("after", ITEM),
])
_ITEM = "struct<lo:long,n:long,conv:long,leaves:long,saved:long,ends:long,chars:array<long>>"
SCHEMA = f"kind string, block long, rep long, parent long, lo long, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends long, sequence binary, value long, equal long, inner {_ITEM}, after {_ITEM}"


@dataclass
class Item:
    """Sums over neighbouring conversations whose own nodes are all closed; ends: of those that end at the interval around."""

    lo: int
    n: int
    conv: int
    leaves: int
    saved: int
    ends: int
    chars: list[int]

    def plus(self, other: Item | None) -> Item:
        if other is None:
            return self
        return Item(self.lo, self.n + other.n, min(self.conv, other.conv), self.leaves + other.leaves, self.saved + other.saved, self.ends + other.ends, self.chars)


@dataclass
class Mark:
    """A value of the LCP array, where it first stands (rep), how often it stands in its interval as far as known, what lies
    between those places, and what lies after the last up to the next mark."""

    value: int
    rep: int
    equal: int
    inner: Item | None
    after: Item | None


@dataclass
class Out:
    block: int
    rows: list[dict] = field(default_factory=list)

    def node(self, **columns) -> None:
        self.rows.append({"kind": "node", **columns})

    def table(self, marks: list[Mark]) -> pa.Table:
        for i, m in enumerate(marks):
            if m.after is not None and i + 1 < len(marks):  # no interval around it is deeper than the marks beside it
                m.after.chars = m.after.chars[: max(m.value, marks[i + 1].value, 0)]
            if m.inner is not None:
                m.inner.chars = []
            self.rows.append({"kind": "mark", "block": self.block, "rep": m.rep, "value": m.value, "equal": m.equal, "inner": m.inner and vars(m.inner), "after": m.after and vars(m.after)})
        return pa.Table.from_pylist(self.rows, schema=ROWS)


class Solver:
    """Nearest smaller values by a stack; takes marks in order and closes every interval with a smaller value on both sides."""

    def __init__(self, out: Out, aliases: bool):
        self.out, self.aliases = out, aliases
        self.open_left: list[Mark] = []
        self.stack: list[Mark] = []

    def take(self, m: Mark) -> None:
        stack = self.stack
        while stack and stack[-1].value > m.value:
            top = stack.pop()
            if stack:
                below = stack[-1]
                around = below.rep if below.value >= m.value else m.rep
                below.after = self.close(top, below.after.plus(top.inner).plus(top.after), max(below.value, m.value), around)
            else:
                self.open_left.append(top)
        if stack and stack[-1].value == m.value:
            top = stack[-1]
            top.inner = top.after.plus(m.inner) if top.inner is None else top.inner.plus(top.after).plus(m.inner)
            top.equal, top.after = top.equal + m.equal, m.after
            if self.aliases:
                self.out.rows.append({"kind": "alias", "rep": m.rep, "parent": top.rep})
        else:
            stack.append(m)

    def close(self, m: Mark, whole: Item, parent_depth: int, around: int) -> Item:
        children, saved = m.equal + 1 - whole.ends, whole.saved
        leaves = whole.leaves + (children == 0)
        for depth in range(m.value, parent_depth, -1):
            saved += (whole.n - 1) * whole.chars[depth - 1] if depth else 0
            own = depth == m.value
            self.out.node(
                rep=m.rep if own else None, parent=around if depth == parent_depth + 1 and depth else None, lo=whole.lo, depth=depth, n_convs=whole.n, conv_id=whole.conv,
                n_children=children if own else 1, n_leaves=leaves, saved_tokens=saved, ends=whole.ends if own else 0,
            )
        return Item(whole.lo, whole.n, whole.conv, leaves, saved, 0, whole.chars)

    def rest(self) -> list[Mark]:
        return self.open_left + self.stack


def common(a: bytes, b: bytes) -> int:
    """Equal digests at the beginning of two sequences."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    lo, hi = 0, n  # the first lo are equal, the first hi aren't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * DIGEST] == b[: mid * DIGEST] else (lo, mid)
    return lo


def block_solver(size: int):
    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A block of `size` sorted conversations (idx, conv_id, seq, chars), with the one before it and the one after it."""
        block, rows = key[0].as_py(), table.sort_by("idx")
        at, convs, seqs, chars = (rows[c].to_pylist() for c in ("idx", "conv_id", "seq", "chars"))
        out = Out(block)
        solver = Solver(out, False)
        values = [-1, *[common(a, b) for a, b in zip(seqs, seqs[1:], strict=False)], -1]  # values[i]: with the row before
        for i, idx in enumerate(at):
            if idx // size != block:
                continue
            here, after, depth = values[i], values[i + 1], len(seqs[i]) // DIGEST
            parent_depth, single = max(here, after), Item(idx, 1, convs[i], 0, 0, 1, chars[i])
            solver.take(Mark(here, idx, 1, None, single))
            if depth > parent_depth:
                single.leaves, single.ends = 1, 0
                around = idx + 1 if after > here else solver.stack[-1].rep
                for d in range(parent_depth + 1, depth + 1):
                    out.node(rep=None, parent=around if d == parent_depth + 1 and d else None, lo=idx, depth=d, n_convs=1, conv_id=convs[i], n_children=int(d < depth), n_leaves=1, saved_tokens=0, ends=int(d == depth))
            else:
                out.rows.append({"kind": "end", "lo": idx, "conv_id": convs[i], "sequence": hashlib.sha256(seqs[i]).digest()})
        return out.table(solver.rest())

    return solve


def _item(value: dict | None) -> Item | None:
    return value and Item(**{**value, "chars": value["chars"] or []})


def solve_rests(last: bool):
    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The rests of neighbouring blocks, in order; with last, the sentinel at the array's end closes all."""
        out = Out(key[0].as_py())
        solver = Solver(out, True)
        for r in table.sort_by("rep").to_pylist():
            solver.take(Mark(r["value"], r["rep"], r["equal"], _item(r["inner"]), _item(r["after"])))
        if last:
            solver.take(Mark(-1, -1, 1, None, None))
        return out.table([] if last else solver.rest())

    return solve


def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids; its pieces come one after the other, so only the hash is kept."""
    now, first, state = None, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple[int, str]] = []
        for sequence, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence", "lo", "ids")), strict=True):
            if sequence != now:
                if now is not None:
                    out.append((first, state.hexdigest()))
                now, first, state = sequence, lo, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch({"lo": pa.array([o[0] for o in out], pa.int64()), "ends_sha256": pa.array([o[1] for o in out], pa.string())})
    if now is not None:
        yield pa.record_batch({"lo": pa.array([first], pa.int64()), "ends_sha256": [state.hexdigest()]})


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, seq, chars): each conversation with its first turns replaced by those of the conversation at the hundred.

    seq joins the first 16 bytes of each turn's SHA-256 over role and text, chars has the code points of each text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST).alias("h"), F.char_length(text).cast("long").alias("n"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    own = scratch.save(own.select("conv_id", F.transform("turns", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("turns")), "turns")
    heads = own.where(F.col("conv_id") % ROUND == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % ROUND).withColumn("shared", shared).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("shared")), none), F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns") - F.col("shared"), F.lit(0))))
    whole = joined.select("conv_id", whole.alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["h"]), "")).alias("seq"), F.transform("turns", lambda x: x["n"]).alias("chars"))


def trie(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turn, role, text).

    Turns of a conversation are ordered by turn, null first, then by their digest; repeated rows are turns of their own. A
    null role or text is empty. Rows without conv_id belong to no conversation and are left out. A conversation whose turns
    are all replaced by none is a member of the root only. An empty table has no root. Other columns are ignored. A
    conversation travels as one row of 24 bytes a turn.
    """
    spark = turns.sparkSession
    with Scratch(spark) as scratch:
        order = ranked(rebuilt(turns, scratch).withColumn("one", F.lit("")), "one", ["seq", "conv_id"], scratch, "sorted").drop("one")
        places = F.array_distinct(F.array(*[F.expr(f"(idx + {k}) div {block}") for k in (-1, 0, 1)]))
        levels = [scratch.save(order.withColumn("block", F.explode(places)).groupBy("block").applyInArrow(block_solver(block), SCHEMA), "level-0")]
        n = order.agg(F.count("*")).first()[0]
        n_blocks = -(-n // block)
        while True:
            n_blocks = -(-n_blocks // fan)
            marks = levels[-1].where("kind = 'mark'").withColumn("block", F.expr(f"block div {fan}"))
            levels.append(scratch.save(marks.groupBy("block").applyInArrow(solve_rests(n_blocks <= 1), SCHEMA), f"level-{len(levels)}"))
            if n_blocks <= 1:
                break
        rows = levels[0]
        for level in levels[1:]:
            rows = rows.union(level)
        nodes = rows.where("kind = 'node'")
        final = _final_aliases(rows.where("kind = 'alias'").select("rep", "parent"), len(levels) - 1, scratch)
        root = nodes.where("depth = 0").select("conv_id").first()
        # a node under the root, where most meet, needs no join; others find the interval around them by its first place
        near = nodes.where("parent is null or depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long")).when(F.col("depth") > 1, F.col("conv_id")))
        linked = nodes.where("parent is not null and depth > 1").join(final, "parent", "left").withColumn("parent", F.coalesce("final", "parent")).drop("final")
        linked = scratch.save(linked, "linked")
        around = scratch.save(nodes.where("rep is not null").select(F.col("rep").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "around")
        linked = linked.join(around, "parent")
        every = near.unionByName(linked)
        pieces = rows.where("kind = 'end'").groupBy("sequence", F.expr(f"lo div {PIECE}").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",").alias("ids"), F.min("lo").alias("lo"))
        hashes = scratch.save(pieces.repartition("sequence").sortWithinPartitions("sequence", "piece").select("sequence", "lo", "ids").mapInArrow(list_hashes, "lo long, ends_sha256 string"), "hashes")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        shared_ends = (F.col("ends") > 0) & F.col("rep").isNotNull()
        listed = every.where(shared_ends).join(hashes, "lo").select(*columns, "ends_sha256")
        rest = every.where(~shared_ends).select(*columns, F.sha2(F.when(F.col("ends") > 0, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"))
        return scratch.keep(listed.union(rest), "trie")


def _final_aliases(aliases: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(parent, final): where intervals that began in several blocks have their first place; a chain is as long as the levels."""
    links = scratch.save(aliases.toDF("parent", "final"), "aliases")
    out, step = links, links.toDF("final", "further")
    for _ in range(levels - 1):
        out = out.join(step, "final", "left").select("parent", F.coalesce("further", "final").alias("final"))
    return scratch.save(out, "final-aliases")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt `conversations`."""
    return trie(read(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, h, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS i FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END)), CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS k
  FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, o.i, o.h, o.n FROM c JOIN o ON o.conv_id = c.base AND o.i <= k
  UNION ALL SELECT c.conv_id, o.i, o.h, o.n FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > k
), s AS (SELECT conv_id, row_number() OVER w AS d, n, sha256(string_agg(h, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT conv_id, d, n, key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
f AS (SELECT *, lag(key) OVER w AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
node AS (
  SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM f GROUP BY d, key
), kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, key)),
sub AS (
  SELECT m.d, m.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * x.n) AS BIGINT) AS saved_tokens FROM full_node x JOIN m ON x.conv_id = m.conv_id AND m.d <= x.d GROUP BY 1, 2
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_node x JOIN sub USING (d, key) LEFT JOIN node p ON p.d = x.d - 1 AND p.key = x.up
"""
