"""Merkle manifest, exact top-k search and prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from relscope.llm import merkle as M
from relscope.llm import prefix_trie as T
from relscope.llm import topk as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string"
TURNS = "conv_id long, turn long, role string, text string, seq string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Merkle manifest ----------------------------------------------------------------------------------------------


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_in(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def brute_manifest(rows, found):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, found(r)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:4])]) for g in order}
    top = tree_of([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:4])):
            path = path_in(trees[g], i) + path_in(top, n)
            node = M.fold(x[3], path)
            out.append((x[4], x[2], trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def made_docs():
    rng = random.Random(3)
    rows = [(i, f"Text {i} " * rng.randrange(1, 4), "de", "s", i) for i in range(9000)]
    rows += [(20_000 + i, None if i % 7 == 0 else f"é{i}", rng.choice(["", "a", "Z", None]), None, None if i % 3 else i) for i in range(300)]
    return rows + [(7, "same id", "de", "x", 1), (7, "same id", "de", "x", 1), (None, "No id", "de", "x", 1), (None, None, None, None, None), (5, "one", "alone", "x", 1), (6, "L" * 200_000, "a", "x", 1)]


def test_manifest_is_the_brute_force_one(spark):
    rows = made_docs()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = M.manifest(df, F.when(tampered, F.lower("text")).otherwise(F.col("text"))).collect()
    want = brute_manifest(rows, lambda r: r[1].lower() if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1])
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert M.manifest(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = M.manifest(spark.createDataFrame([(1, "t", "x", "s", 1, "", "")], DOCS)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("") and r["verified"]


def test_traversal_keeps_two_subtrees_a_tier():
    for n in (1, 7, 8, 9, 63, 64, 65, 511, 513, 4000, 40_000):
        leaves = [sha(str(i)) for i in range(n)]
        levels = tree_of(leaves)
        height = len(levels) - 1
        assert M.root_of(leaves, height) == levels[-1][0]
        for i, path in enumerate(M.traverse(leaves, height)):
            assert path == path_in(levels, i) and M.unpacked(M.packed(path)) == path


def test_lone_nodes_of_a_deeper_tree_are_hashed_alone():
    assert M.root_of(["a"], 2) == sha(sha("a")) and list(M.traverse(["a"], 2)) == [[("", ""), ("", "")]]


# ---- exact top-k --------------------------------------------------------------------------------------------------


def brute_top(rows, k, is_query):
    vec = {n: [math.floor(256 * x) for x in v] for n, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out, asked = [], set()
    for n, q in vec.items():
        qid = rows[n][0]
        if qid is None or not is_query(qid) or (qid, tuple(q)) in asked:
            continue
        asked.add((qid, tuple(q)))
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        got = [(-cut(sum(a * b for a, b in zip(q, c, strict=True))), rows[m][0] is None, rows[m][0] or 0) for m, c in vec.items() if rows[m][0] != qid and len(c) == len(q)]
        for rank, (s, null, i) in enumerate(sorted(got)[:k], 1):
            out.append((qid, rank, None if null else i, -s))
    return sorted(out, key=repr)


def searched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id string").repartition(5)
    return sorted((tuple(r) for r in K.top_k(df.where("vec_id % 10 = 0"), df, **options).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_search_is_the_brute_force_one(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.2 * rng.normal(size=24)]) for i in range(400)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(300)] + [(2000 + i, [0.5, -0.25, 1.0]) for i in range(40)] + [(10, hot), (10, hot), (20, [9.0] * 24)] * 8
    rows += [(3000, None), (3010, []), (3011, []), (3020, [None] * 24), (3030, [float("nan")] * 24), (3040, [float("inf")] * 24), (3050, [0.0] * 24), (3051, [-0.0] * 24), (None, hot), (None, hot)]
    want = brute_top(rows, 5, lambda i: i % 10 == 0)
    assert searched(spark, rows) == want and searched(spark, rows, query_bytes=4000) == want


def test_search_beyond_exact_doubles_and_longs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 10.0 ** (3 * (i % 5))]) for i in range(60)] + [(100 + i, [float(np.float32(1e30 * (i - 2)))] * 6) for i in range(5)]
    assert searched(spark, rows) == brute_top(rows, 5, lambda i: i % 10 == 0)


def test_search_of_few_or_no_rows(spark):
    assert searched(spark, [(10, [1.0, 2.0])]) == [] and searched(spark, [(11, [1.0])]) == []
    assert searched(spark, [(10, [1.0]), (11, [2.0]), (12, [-1.0])]) == [(10, 1, 11, 131072), (10, 2, 12, -65536)]


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(4)
    a, b = np.floor(256 * rng.normal(size=(200, 50))), np.floor(256 * rng.normal(size=(150, 50)))
    true, last = a @ b.T, None
    for x, y in zip(K.Vectors(a).stats, K.Vectors(b).stats, strict=True):
        bound = x @ y.T
        assert (bound >= true - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


# ---- prefix trie --------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0, sha(f"{len(role)}:{role}{text}")), role, text))
    own = {c: [x[1:] for x in sorted(ts, key=lambda x: x[0])] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        k = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:k] + ts[k:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[x] for x in kids[key]) + (not kids[key])
        saved[key] = sum(saved[x] for x in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    return sorted(((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids[key]), leaves[key], saved[key], sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(key)))))) for key, m in members.items()), key=repr)


def grown(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(4)
    got = T.trie(df, **options).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made_turns(seed, n, words, most):
    rng, rows = random.Random(seed), []
    for c in range(n):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(words)) for t in range(rng.randrange(most + 1))]
    return rows


def test_trie_is_the_brute_force_one(spark):
    rows = made_turns(1, 300, ["a", "bb", "ccc"], 9)
    rows += [(1000 + i, t, "user", f"turn {t}") for i in range(120) for t in range(8)]  # copies but for the first turns
    rows += [(2000, None, None, None), (2000, None, "x", "y"), (2000, 3, "x", None), (2000, 3, "x", None), (2001, 1, "q", "z" * 100_000), (-305, 0, "n", "m"), (-300, 0, "n", "k"), (None, 0, "lost", "lost")]
    want = brute_trie(rows)
    assert grown(spark, rows) == want
    assert grown(spark, rows, block=8, fan=3) == want and grown(spark, rows, block=1, fan=2) == want


def test_trie_of_deep_conversations(spark):
    rows = [(c, t, "u", "w" if t < 200 + c else f"{c}") for c in range(40) for t in range(230)]
    assert grown(spark, rows, block=4, fan=2) == brute_trie(rows)


def test_trie_of_one_and_of_nothing(spark):
    assert grown(spark, []) == [] and grown(spark, [(None, 0, "a", "b")]) == []
    for rows in ([(7, 0, "a", "b")], [(100, 0, "a", "b"), (100, 1, "a", "c")], [(100, 0, "a", "b"), (200, 0, "a", "b")]):
        assert grown(spark, rows) == brute_trie(rows)
