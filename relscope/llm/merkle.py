"""Merkle manifest of a dataset with an authentication path for every row (operator 11).

Leaves are ranked within their language by ranges, never in one task, and cut into aligned blocks of 8^4. A task walks a
block's leaves in order by fractal traversal: the block's height is cut into tiers of stacked subtrees, each tier keeps the
existing subtree, which holds the siblings of the present path, and the desired one, which is built leaf by leaf meanwhile
and replaces it when the walk leaves it. So a task holds two subtrees a tier, whatever the number of leaves. Roots of blocks
are leaves of the tree above; that one is built in the same way until one node a language is left, and again over the
languages. The upper parts of the paths, a row a block, are joined to the blocks and appended to the paths inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import Scratch, ranked, read

#: Children of a node; levels of a block; levels of a stacked subtree.
FAN, HEIGHT, TIER = 8, 4, 2
BLOCK = FAN**HEIGHT

Path = list[tuple[str, str]]


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """The nodes of levels base .. base + height of a tree, from the leaves below them, one at a time.

    Below base only the open run of each level is kept.
    """

    def __init__(self, base: int, height: int):
        self.base, self.top = base, base + height
        self.rows: list[list[str]] = [[] for _ in range(height + 1)]
        self.open: list[list[str]] = [[] for _ in range(self.top)]

    def push(self, node: str, level: int = 0) -> None:
        while True:
            if level >= self.base:
                self.rows[level - self.base].append(node)
            if level == self.top:
                return
            run = self.open[level]
            run.append(node)
            if len(run) < FAN:
                return
            node, level = h("".join(run)), level + 1
            run.clear()

    def close(self) -> None:
        """Close the last, shorter run of every level."""
        for level in range(self.top):
            if run := self.open[level]:
                node = h("".join(run))
                run.clear()
                self.push(node, level + 1)


def root_of(leaves: Sequence[str], height: int) -> str:
    """The node `height` levels above the leaves of a block."""
    tree = Subtree(height, 0)
    for leaf in leaves:
        tree.push(leaf)
    tree.close()
    return tree.rows[0][0]


def traverse(leaves: Sequence[str], height: int) -> Iterator[Path]:
    """The path of each leaf in order: for each level the siblings left and right of the node, as text."""
    tiers = [(base, min(TIER, height - base)) for base in range(0, height, TIER)]
    spans = [FAN ** (base + tall) for base, tall in tiers]
    existing = [Subtree(*t) for t in tiers]
    for tree, span in zip(existing, spans, strict=True):
        for leaf in leaves[:span]:
            tree.push(leaf)
        tree.close()
    desired = [Subtree(*t) for t in tiers]
    for i in range(len(leaves)):
        path: Path = []
        for tree, span in zip(existing, spans, strict=True):
            start = i // span * span
            for level in range(tree.base, tree.top):
                at = i // FAN**level - start // FAN**level
                run, row = at // FAN * FAN, tree.rows[level - tree.base]
                path.append(("".join(row[run:at]), "".join(row[at + 1 : run + FAN])))
        yield path
        for t, span in enumerate(spans):  # a leaf a round into each desired subtree, which is ready when it is needed
            if i + span < len(leaves):
                desired[t].push(leaves[i + span])
            if (i + 1) % span == 0 and i + 1 < len(leaves):
                desired[t].close()
                existing[t], desired[t] = desired[t], Subtree(*tiers[t])


def fold(node: str, path: Path) -> str:
    for left, right in path:
        node = h(left + node + right)
    return node


def packed(path: Path) -> str:
    return "".join(f"{left}|{right}," for left, right in path)


def unpacked(text: str) -> Path:
    return [tuple(level.split("|")) for level in text.split(",")[:-1]]


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def levels(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(21)]), lambda x: x < n))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("idx").combine_chunks()


def _roots(table: pa.Table) -> pa.Table:
    """The root of a block of leaves."""
    rows = _sorted(table)
    leaves, height = [x.hex() for x in rows["digest"].to_pylist()], rows["height"][0].as_py()
    return pa.table({"g": rows["g"][:1], "idx": rows["block"][:1], "digest": [bytes.fromhex(root_of(leaves, min(height, HEIGHT)))], "height": pa.array([max(0, height - HEIGHT)], pa.int32())})


def _walk(table: pa.Table) -> pa.Table:
    """The nodes of a block with their paths to its root, and the root."""
    rows = _sorted(table)
    nodes, height = [x.hex() for x in rows["digest"].to_pylist()], rows["height"][0].as_py()
    paths, n = [packed(p) for p in traverse(nodes, min(height, HEIGHT))], len(nodes)
    root = bytes.fromhex(root_of(nodes, min(height, HEIGHT)))
    return pa.table({"g": rows["g"], "idx": rows["idx"], "block": rows["block"], "path": paths, "digest": [root] * n, "height": pa.array([max(0, height - HEIGHT)] * n, pa.int32())})


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """From nodes (g, idx, digest, height): (g, idx, path) up to the group's last node, and that one as (g, digest)."""
    stages = []
    while True:
        dealt = nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
        stages.append(scratch.save(dealt.groupBy("g", "block").applyInArrow(_walk, "g string, idx long, block long, path string, digest binary, height int"), f"{name}-{len(stages)}"))
        nodes = stages[-1].groupBy("g", F.col("block").alias("idx")).agg(F.min("digest").alias("digest"), F.min("height").alias("height"))
        if not (stages[-1].agg(F.max("block")).first()[0] or 0):
            break
    paths = stages[-1].select("g", "idx", "path")
    for stage in reversed(stages[:-1]):
        paths = stage.join(paths.select("g", F.col("idx").alias("block"), F.col("path").alias("rest")), ["g", "block"]).select("g", "idx", F.concat("path", "rest").alias("path"))
    return paths, nodes.select("g", "digest")


def _prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and fold of each leaf of a block; above is the block's one row with what lies over it."""
    rows = _sorted(leaves)
    up = above.to_pylist()[0]
    height, rest, upper = rows["height"][0].as_py(), up["path"], unpacked(up["path"])
    rest, subroot, root = rest.replace("|", "").replace(",", ""), up["subroot"].hex(), up["root"].hex()
    nodes, found = [x.hex() for x in rows["digest"].to_pylist()], [x.hex() for x in rows["found"].to_pylist()]
    over: dict[str, str] = {}  # an untouched leaf folds to the block's root, as the others do
    proofs, folds = [], []
    for path, leaf, node in zip(traverse(nodes, min(height, HEIGHT)), found, nodes, strict=True):
        proofs.append(h("".join(a + b for a, b in path) + rest))
        at = fold(leaf, path)
        if leaf == node and at in over:
            folds.append(over[at])
        else:
            folds.append(fold(at, upper))
            if leaf == node:
                over[at] = folds[-1]
    n = len(nodes)
    return pa.table({
        "doc_id": rows["doc_id"], "leaf": nodes, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folds, "verified": [f == root for f in folds],
    })


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """A row of RESULT for each document (doc_id, source, lang, n_chars, text): its leaf, roots and proof.

    found is a text column: what is checked against the manifest (None: the text itself). A null in any field is a field of
    its own kind ("-"), so a null lang is a group, before all others, and a null doc_id comes before the others of its
    language. Rows with the same doc_id come by their leaf; equal rows have equal leaves, so their order doesn't matter.
    A language of one row has its leaf as subroot; an only subroot is the root. An empty table gives an empty result. Other
    columns are ignored. Texts stay in the JVM; after them travel 72 bytes a document and its language.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    group = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang"))
    rows = docs.select(
        group.alias("g"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("known"), digest(*fields, F.col("text")).alias("digest"),
        (digest(*fields, F.col("text")) if found is None else digest(*fields, found)).alias("found"),
    )
    with Scratch(spark) as scratch:
        rows = scratch.save(rows, "digests")  # ranges are cut by a sample, so what is ranked is read twice
        leaves = ranked(rows, "g", ["known", "id", "digest", "found"], scratch, "leaves")
        sizes = scratch.save(leaves.groupBy("g").agg(levels(F.count("*")).alias("height")), "sizes")
        leaves = leaves.join(sizes, "g").withColumn("block", F.expr(f"idx div {BLOCK}")).withColumn("doc_id", F.when(F.col("known"), F.col("id"))).select("g", "idx", "block", "doc_id", "digest", "found", "height")
        leaves = scratch.save(leaves, "blocks")
        blocks = leaves.select("g", "idx", "block", "digest", "height").groupBy("g", "block").applyInArrow(_roots, "g string, idx long, digest binary, height int")
        paths, subroots = climb(blocks, scratch, "tree")
        subroots = scratch.save(subroots, "subroots")
        langs = ranked(subroots.withColumn("one", F.lit("")), "one", ["g"], scratch, "langs")
        tall = len([k for k in range(21) if FAN**k < subroots.count()])
        over, roots = climb(langs.select(F.lit("").alias("g"), "idx", "digest", F.lit(tall).alias("height")), scratch, "top")
        root = roots.first()
        per = langs.join(over.select("idx", F.col("path").alias("rest")), "idx").select("g", F.col("digest").alias("subroot"), "rest")
        above = paths.join(per, "g").select("g", F.col("idx").alias("block"), F.concat("path", "rest").alias("path"), "subroot", F.lit(bytes(root["digest"]) if root else b"").alias("root"))
        proved = leaves.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_prove, RESULT)
        return scratch.keep(proved, "manifest")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, checked against texts of which those of every third crc32 of doc_id are lower-cased (A-Z)."""
    docs = read(spark, sf_dir, "documents")
    upper, lower = ("".join(chr(c + k) for c in range(26)) for k in (65, 97))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text")))


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM documents
), crc AS (
  SELECT k, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END)) AS r
  FROM d
), leaf AS (
  SELECT d.k, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(r, CAST(4294967295 AS UBIGINT)) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS found
  FROM d JOIN crc USING (k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, found) - 1 AS idx FROM leaf
), nodes(g, lvl, idx, h, n) AS (
  SELECT g, 0, idx, h, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT g, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, lvl, idx // 8, n
), sub AS (SELECT g, lvl AS tall, h, row_number() OVER (ORDER BY g) - 1 AS idx FROM nodes WHERE n = 1),
tops(lvl, idx, h, n) AS (
  SELECT 0, idx, h, (SELECT count(*) FROM sub) FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, idx // 8, n
), root AS (SELECT h, lvl AS tall FROM tops WHERE n = 1),
side AS (
  SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
), topside AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
), walk(k, g, idx, lvl, node, proof) AS (
  SELECT k, g, idx, 0, found, '' FROM placed
  UNION ALL
  SELECT w.k, w.g, w.idx // 8, w.lvl + 1, sha256(s.l || w.node || s.r), w.proof || s.l || s.r FROM walk w JOIN side s ON w.g = s.g AND w.lvl = s.lvl AND w.idx = s.idx
), up(k, idx, lvl, node, proof) AS (
  SELECT w.k, s.idx, 0, w.node, w.proof FROM walk w JOIN sub s ON w.g = s.g AND w.lvl = s.tall
  UNION ALL
  SELECT u.k, u.idx // 8, u.lvl + 1, sha256(s.l || u.node || s.r), u.proof || s.l || s.r FROM up u JOIN topside s ON u.lvl = s.lvl AND u.idx = s.idx
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = r.h AS verified
FROM placed p JOIN sub s ON p.g = s.g JOIN up u ON p.k = u.k JOIN root r ON u.lvl = r.tall
"""
