"""Near-duplicates: fingerprints, pivots, lattice cells, compact windows, each against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relscope.llm import common, embed_dedup, passage_tokens, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    words = (text or "").encode().translate(common.ASCII_LOWER).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    if not grams:
        return 0
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = {i: i for i in fps}
    todo = list(fps)
    while todo:
        a = todo.pop()
        for b in fps:
            if label[b] > label[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                label[b] = label[a]
                todo.append(b)
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[a] < label[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[b] = label[a]
                    changed = True
    return label


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 40, 120]))))
    return out


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "A b C", "x " * 50, "É e É é a b c", " ".join(map(str, range(5000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "word_blocks", lambda data: common.word_blocks(data, 40))
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_near_duplicates_match_brute_force(spark):
    all_texts = [*texts(120, 1), "", None, "", "same", "same"]
    df = spark.createDataFrame([(i, t, "fp", "component", 1) for i, t in enumerate(all_texts)], DOCS).withColumn("fp", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(all_texts)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_components(fps)


@pytest.mark.parametrize("n", [1, 1 << 20, 1 << 28, 1 << 40])
def test_block_masks_lose_no_pair(n):
    masks, rng = simhash.block_masks(n), random.Random(n)
    for _ in range(300):
        flips = rng.sample(range(64), 4)
        assert any(not m & sum(1 << f for f in flips) for m in masks)


@pytest.mark.parametrize("n", [1, 1 << 28])
def test_finer_blocks_lose_no_pair(n):
    rng = random.Random(n)
    for mask in simhash.block_masks(n):
        assert all(mask & m == mask for m in simhash.finer(mask))
        for _ in range(40):
            flips = rng.sample([b for b in range(64) if not mask >> b & 1], 4)
            assert any(not m & sum(1 << f for f in flips) for m in simhash.finer(mask))


def test_crowded_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 20)
    rng = random.Random(3)
    base = [rng.getrandbits(20) for _ in range(3)]  # one template family: the upper bits are equal
    fps = sorted({b ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(4))) for b in base for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    with common.Scratch(spark) as scratch:
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), scratch).collect()
    want = slow_components(dict(enumerate(fps)))
    place = {f: i for i, f in enumerate(fps)}
    label = {i: i for i in want}
    for _ in range(30):
        for a, b in edges:
            i, j = place[a % 2**64], place[b % 2**64]
            label[i] = label[j] = min(label[i], label[j])
    assert label == want


def test_forest_matches_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in base]]))
    a, b = simhash.forest(fps, np.zeros(len(fps), int))
    want = slow_components({i: int(f) for i, f in enumerate(fps)})
    place = {int(f): i for i, f in enumerate(fps)}
    joined = {i: i for i in want}
    for x, y in zip(a, b, strict=True):
        joined[place[int(y)]] = place[int(x)]
    root = lambda i: i if joined[i] == i else root(joined[i])
    assert {i: root(i) for i in want} == want


def test_keep_first_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None), (3, "other words stand here today now", "en", "s", 1)], DOCS)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert substring_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 64))
    near = base[:60] / np.linalg.norm(base[:60], axis=1, keepdims=True)
    side = rng.standard_normal(near.shape)
    side -= (side * near).sum(axis=1, keepdims=True) * near
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = np.concatenate([base, 3 * (0.93 * near + np.sqrt(1 - 0.93**2) * side), base[:5], base[:5]]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    rows = [(i, [float(x) for x in e], 0) for i, e in enumerate(v)] + [(1000 + i, e, 0) for i, e in enumerate(odd)]
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = v.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    assert [got[i]["n_links"] for i in range(len(v))] == link.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == min([i, *np.flatnonzero(link[i])]) for i in range(150))
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(len(odd)))


def at_cosine(cos, n, dim, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    return a, cos * a + np.sqrt(1 - cos**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [8, 64, 384, 768])
@pytest.mark.parametrize("n", [1 << 10, 1 << 19, 1 << 20, 1 << 27, 1 << 30])
def test_recall_at_the_threshold(n, dim):
    a, b = at_cosine(0.9, 600, dim)
    hit = np.zeros(len(a), bool)
    for (own, near), (own2, near2) in zip(*[embed_dedup.cells(x, embed_dedup.setting_for(n)) for x in (a, b)], strict=True):
        hit |= (own == own2) | (near == own2[:, None]).any(axis=1) | (near2 == own[:, None]).any(axis=1)
    differ = np.bitwise_count((embed_dedup.sketches(a) ^ embed_dedup.sketches(b)).view(np.uint64)).sum(axis=1)
    hit &= differ <= embed_dedup.most_differences(0.9)[0]
    assert hit.mean() > 0.95


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_cells_stay_selective_at_every_width(dim):
    unit = np.random.default_rng(5).standard_normal((1500, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    met = np.zeros((1500, 1500), bool)
    for own, near in embed_dedup.cells(unit, embed_dedup.setting_for(1500)):
        met |= (own[:, None] == own[None, :]) | (near[:, :, None] == own[None, None, :]).any(axis=1)
    sketch = embed_dedup.sketches(unit)
    differ = np.bitwise_count((sketch[:, None] ^ sketch[None]).view(np.uint64)).sum(axis=2)
    assert met.mean() < 0.1  # the share of other vectors that a vector meets by cell
    assert (met & (differ <= embed_dedup.most_differences(0.9)[0])).sum() < 2 * len(unit)  # after the sketch less than one candidate a vector


def test_balls_tiles_and_small_ids(spark, monkeypatch):
    """Tight groups of many different vectors, in tiles, against brute force; huge, null and repeated ids."""
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5, 64))
    v = np.concatenate([c + s * rng.standard_normal((n, 64)) for c, n, s in zip(centres, [150, 80, 40, 10, 2], [0.12, 0.2, 0.3, 0.25, 0.1], strict=True)] + [rng.standard_normal((60, 64))]).astype(np.float32)
    v = np.concatenate([v, v[:7], v[:7]])
    ids = [(1 << 61) + 3 * i if i % 2 else i for i in range(len(v))]
    ids[5], ids[200], ids[20] = None, None, ids[21]
    rows = [(i, [float(x) for x in e], 0, "x") for i, e in zip(ids, v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ball int, cell string")
    got = sorted((r["vec_id"] or -1, r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df.repartition(5)).collect())
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    label = np.arange(len(v))
    for _ in range(20):
        label = np.array([label[link[i]].min() for i in range(len(v))])
    least = {k: min((ids[i] for i in np.flatnonzero(label == k) if ids[i] is not None), default=-1) for k in set(label)}
    want = sorted((ids[i] or -1, int(link[i].sum()) - 1, least[label[i]], ids[i] == least[label[i]]) for i in range(len(v)))
    assert len(set(label)) > 50 and sum(w[1] for w in want) > 20_000
    assert got == want


def test_links_do_not_depend_on_the_size_of_the_table(spark):
    """1,700 pairs just above the threshold, alone and among other rows: the same links."""
    v = np.concatenate(at_cosine(0.9001, 1700, 64, 12))
    more = np.random.default_rng(9).standard_normal((6000, 64))
    said = []
    for rows in (v, np.concatenate([v, more / np.linalg.norm(more, axis=1, keepdims=True)])):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
        said.append({tuple(r) for r in embed_dedup.near_vectors(df).where("vec_id < 3400").collect()})
    assert said[0] == said[1]
    assert sum(r[1] for r in said[0]) > 0.98 * 3400


def test_e8_decoding_matches_brute_force():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 8))
    got = embed_dedup.decode_e8(x)
    near = np.concatenate([np.zeros((1, 8)), embed_dedup.least_vectors()])
    best = ((x[:, None, :] - near[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - got) ** 2).sum(axis=1) <= best + 1e-9).all()
    assert np.allclose(np.rint(got * 2), got * 2) and np.allclose(got.sum(axis=1) % 2, 0)


def slow_windows(h, width):
    out = set()
    for c in range(len(h)):
        a = c
        while a > 0 and h[a - 1] > h[c]:
            a -= 1
        b = c
        while b + 1 < len(h) and h[b + 1] >= h[c]:
            b += 1
        if b - a + 1 >= width:
            out.add((a, c, b))
    return out


def test_compact_windows_match_brute_force():
    sizes = np.array([0, 9, 10, 57, 400, 3, 46])
    tokens = np.random.default_rng(1).integers(0, 1 << 60, sizes.sum()).astype(np.uint64)
    got, ends = passage_tokens.windows(tokens, sizes, width=10, hashes=3), np.cumsum(sizes)
    for i, (n, end) in enumerate(zip(sizes, ends, strict=True)):
        for k, salt in enumerate(passage_tokens.salts(3)):
            h = passage_tokens.mixed(tokens[end - n : end] ^ salt)
            assert {tuple(r[2:]) for r in got.tolist() if r[0] == i and r[1] & 7 == k} == slow_windows(h.tolist(), 10)


def test_windows_of_one_long_text_in_stretches(monkeypatch):
    tokens = np.random.default_rng(2).integers(0, 1 << 60, 900).astype(np.uint64)
    monkeypatch.setattr(passage_tokens, "STRETCH", 300)
    got = passage_tokens.windows(tokens, np.array([900]), width=10, hashes=1)
    assert got[:, 3].min() >= 0 and got[:, 4].max() < 900
    h = passage_tokens.mixed(tokens ^ passage_tokens.salts(1)[0])
    for s in range(891):  # the least token of every run of 10 stands in a window that spans the run
        c = s + int(h[s : s + 10].argmin())
        assert ((got[:, 2] <= s) & (got[:, 3] == c) & (got[:, 4] >= s + 9)).any()


def test_circling_text_has_few_windows():
    assert len(passage_tokens.windows(np.zeros(4600, np.uint64), np.array([4600]), width=46, hashes=1)) <= 101


def test_tokens_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["A b  c d e f", None, "", "a\tB\nc d e", " ", "x" * 5000 + " y z w v u", " ".join(f"w{i}" for i in range(3000)), "É b c d e", "é b c d e"]
    one = [passage_tokens.shingles(t).tolist() for t in texts]
    assert [len(x) for x in one] == [2, 0, 0, 1, 0, 2, 2996, 1, 1] and one[0][0] == one[3][0] and one[7] != one[8]
    for size in (16, 700, 1 << 19):
        monkeypatch.setattr(passage_tokens, "CHUNK", size)
        got = {}
        for rows, tokens, sizes in passage_tokens.chunks(pa.array(texts)):
            for row, part in zip(rows.tolist(), np.split(tokens, np.cumsum(sizes)[:-1]), strict=True):
                got[row] = part.tolist()
        assert [got[i] for i in range(len(texts))] == one


def slow_verified(mine, first, width, similarity):
    out = []
    for i in range(len(mine) - width + 1):
        x = set(mine[i : i + width])
        out.append(max((len(x & set(first[j : j + width])) / len(x | set(first[j : j + width])) for j in range(len(first) - width + 1)), default=0) >= similarity)
    return out


def test_every_window_is_measured():
    rng = random.Random(4)
    for _ in range(150):
        first = [rng.randrange(10**6) for _ in range(rng.randrange(40, 110))]
        a = rng.randrange(10, len(first) // 2)
        mine = [rng.randrange(10**6) for _ in range(rng.randrange(15))] + first[a : min(a + 60, len(first) - 10)] + [rng.randrange(10**6) for _ in range(rng.randrange(15))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(mine))
            mine[at : at + rng.randrange(3)] = [rng.randrange(10**6) for _ in range(rng.randrange(3))]
        want, said = slow_verified(mine, first, 20, 0.8), [False] * max(0, len(mine) - 19)
        equal: list = []
        for lo, hi, _, sim in passage_tokens.verified(np.array(mine, np.uint64), np.array(first, np.uint64), 20, 0.8, equal):
            assert 0.8 <= sim <= 1
            said[lo : hi - 19] = [True] * (hi - 19 - lo)
        same = [any(a <= i and i + 20 <= b for a, b in equal) for i in range(len(want))]
        assert same == slow_verified(mine, first, 20, 1)
        assert all(w or not s for w, s in zip(want, said, strict=True)) and sum(want) - sum(said) <= 2
    line = [7, 8, 9, 10, 11, 12]
    (got,) = passage_tokens.verified(np.array(line * 20, np.uint64), np.array(line * 11 + [99], np.uint64), 46, 0.8)
    assert got[:2] == (0, 120) and got[3] == 1


def circling(rng, blocks, n):
    """n blocks of a few tokens in random order, here and there with one token changed."""
    out = []
    for _ in range(n):
        out += rng.choice(blocks)
        if rng.random() < 0.2:
            out[rng.randrange(len(out))] = rng.randrange(100, 110)
    return out


def test_every_window_of_circling_texts_is_measured(monkeypatch):
    """Texts that return to the same tokens on many diagonals, against brute force, whatever is tried first."""
    rng, similar = random.Random(5), 0
    for turn in range(60):
        monkeypatch.setattr(passage_tokens, "MOST_PLACES", (1 << 16, 40)[turn % 2])
        monkeypatch.setattr(passage_tokens, "CELLS", (1 << 20, 500)[turn // 2 % 2])
        blocks = [[rng.randrange(30) for _ in range(rng.randrange(2, 9))] for _ in range(rng.randrange(2, 12))]
        mine, first = circling(rng, blocks, rng.randrange(10, 60)), circling(rng, blocks, rng.randrange(10, 60))
        want, said = slow_verified(mine, first, 20, 0.8), [False] * max(0, len(mine) - 19)
        for lo, hi, at, sim in passage_tokens.verified(np.array(mine, np.uint64), np.array(first, np.uint64), 20, 0.8):
            assert 0.8 <= sim <= 1 and at >= 0
            said[lo : hi - 19] = [True] * (hi - 19 - lo)
        assert said == want
        similar += sum(want)
    assert similar > 1000


def passage(seed, n=70):
    rng = random.Random(seed)
    return [f"p{seed}q{rng.randrange(10_000)}" for _ in range(n)]


def filler(seed, n):
    rng = random.Random(-seed - 1)
    return [f"f{rng.randrange(1_000_000)}" for _ in range(n)]


def test_repeated_passages(spark):
    p, q = passage(1), passage(2)
    near = p.copy()
    near[20] = "changed"
    rows = [
        (5, [*filler(1, 80), *p, *filler(2, 30)]), (7, [*filler(3, 10), *p, *filler(4, 90)]), (9, [*filler(5, 60), *near, *filler(6, 5)]), (11, [*q, *filler(7, 40)]), (13, [*filler(8, 200), *q[:40]]), (15, filler(9, 300)), (17, p[:30]), (19, []),
        *[(100 + i, [*filler(20 + i, 25), *q, *filler(60 + i, 25)]) for i in range(20)],
    ]
    df = spark.createDataFrame([(i, " ".join(w).replace("p1q", "P1q") if i == 7 else " ".join(w), "en", "s", 1) for i, w in rows] + [(None, " ".join(p), "en", "s", 1), (21, None, None, None, None)], DOCS)
    got = substring_dedup.repeated_passages(df)
    found = {(r["doc_id"], r["first_doc_id"]): r for r in got.collect()}
    assert set(found) == {(7, 5), (9, 5), *[(100 + i, 11) for i in range(20)]}
    r = found[7, 5]
    assert abs(r["start_word"] - 10) <= 12 and abs(r["n_words"] - 70) <= 24 and r["similarity"] >= 0.8
    cut = substring_dedup.without_passages(df, got)
    kept = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == df.columns and set(kept) == {i for i, _ in rows} | {None, 21}
    assert kept[5]["text"].count("p1q") == 70 and kept[100]["text"].count("p2q") <= 24 and kept[100]["n_chars"] == len(kept[100]["text"])
    assert filler(3, 10)[0] in kept[7]["text"] and filler(4, 90)[-1] in kept[7]["text"]


def test_documents_without_rest_go(spark):
    p = passage(3, 120)
    df = spark.createDataFrame([(1, " ".join(p), "en", "s", 1), (2, " ".join(p), "en", "s", 1)], DOCS)
    got = substring_dedup.without_passages(df, substring_dedup.repeated_passages(df))
    assert [r["doc_id"] for r in got.collect()] == [1]


@pytest.mark.parametrize("n", [0, 1, 6])
def test_passage_with_older_half_similar_variants(spark, n):
    p = passage(4, 60)
    rows = [(50, [*filler(90, 40), *p, *filler(91, 40)]), (51, [*filler(92, 70), *p, *filler(93, 10)])]
    for i in range(n):  # every twelfth word changed: some min-hashes are the same, no window reaches the similarity
        rows.append((i, [*filler(100 + i, 30), *[f"v{i}x{j}" if j % 12 == i % 12 else w for j, w in enumerate(p)], *filler(200 + i, 30)]))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    got = {(r["doc_id"], r["first_doc_id"]): r for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {(51, 50)}
    assert abs(got[51, 50]["start_word"] - 70) <= 12 and abs(got[51, 50]["n_words"] - 60) <= 24


def test_hopeful_windows_are_those_with_enough_common_tokens():
    from relscope.llm.passage_tokens import hopeful

    rng = random.Random(8)
    for _ in range(60):
        n, kinds = rng.randrange(1, 120), rng.choice([5, 40, 1000])
        tokens = np.array([rng.randrange(kinds) for _ in range(n)], np.uint64)
        shared = {t for t in set(tokens.tolist()) if rng.random() < rng.choice([0.7, 0.9])}
        got = hopeful(tokens, np.array([t in shared for t in tokens.tolist()]), width=12)
        for s in range(n):
            window = set(tokens[s : s + 12].tolist())
            assert got[s] == (s + 12 <= n and len(window & shared) >= 0.8 * len(window) - 1e-9)


def test_hopeful_windows_with_circling_tokens_are_all_that_can_be_similar():
    """Against brute force: every similar window is hopeful, and most of what a plain window can't reach is left out."""
    rng = random.Random(7)
    old = new = similar = 0
    for _ in range(40):
        base = [rng.randrange(10**6) for _ in range(60)]
        base[30:30] = base[10:22] if rng.random() < 0.3 else []
        mine, first = [list(base) for _ in range(2)]
        for text in (mine, first):
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(1, 5)] = [rng.randrange(10**6) for _ in range(rng.randrange(5))]
        a, b = np.array(mine, np.uint64), np.array(first, np.uint64)
        loops = set(b[passage_tokens.looped(b, 20)].tolist()) | set(a[passage_tokens.looped(a, 20)].tolist())
        common, circling = np.isin(a, b), np.isin(a, np.array(sorted(loops), np.uint64))
        want = slow_verified(mine, first, 20, 0.8)
        got = passage_tokens.hopeful(a, common, 20, 0.8, circling)
        assert all(g or not w for g, w in zip(got, want, strict=False)) and not got[len(want) :].any()
        old, new, similar = old + passage_tokens.hopeful(a, common, 20, 0.8).sum(), new + got.sum(), similar + sum(want)
    assert similar <= new < old - (old - similar) // 3


def test_centres_leave_out_what_an_earlier_document_has():
    rng = random.Random(9)
    for _ in range(40):
        rows = [(rng.randrange(300), rng.randrange(4), rng.randrange(2)) for _ in range(rng.randrange(1, 60))]
        same = [(a, a + rng.randrange(40)) for a in (rng.randrange(300) for _ in range(rng.randrange(5)))]
        got = substring_dedup._centres(np.array([c << 4 | k << 1 | o for c, k, o in rows]), np.array(same, np.int64).reshape(-1, 2))
        near = {c: {k for x, k, _ in rows if abs(x - c) < passage_tokens.WIDTH} for c, _, o in rows if o}
        assert got.tolist() == sorted(c for c, kinds in near.items() if len(kinds) >= 2 and not any(a <= c <= b for a, b in same))


@pytest.mark.parametrize("n", [3, 40])
def test_passages_near_a_text_with_many_copies(spark, n):
    """A variant is found where what it is near to is the n-th copy of a text, in whole or inside other words."""
    rng, rows, groups = random.Random(n), [], 20
    for g in range(groups):
        p = passage(700_000 + 1000 * n + g, 70)
        far = [f"g{g}{w}" if j % 10 == 3 else w for j, w in enumerate(p)]
        near = far.copy()
        near[rng.randrange(8, 62)] = "changed"
        rows.append((g * 1000, [*filler(10**6 + g, 10), *p, *filler(2 * 10**6 + g, 10)]))
        for i in range(1, n):
            around = [] if g % 2 else filler(3 * 10**6 + g * 1000 + i, 20)
            rows.append((g * 1000 + i, [*around, *far, *around]))
        rows.append((g * 1000 + 999, [*filler(4 * 10**6 + g, 30), *near, *filler(5 * 10**6 + g, 30)]))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    got = {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_passages(df).where("doc_id % 1000 = 999").collect()}
    assert sum(any(d == g * 1000 + 999 and f > g * 1000 for d, f in got) for g in range(groups)) >= 0.95 * groups


@pytest.mark.parametrize("n", [30, 200])
def test_passages_behind_many_older_variants(spark, n):
    """Later near copies are found however many variants below the similarity came before them."""
    rng, rows, groups = random.Random(n), [], 20
    for g in range(groups):
        p = passage(900_000 + 1000 * n + g, 60)
        for i in range(n):
            at = set(rng.sample(range(60), 2))
            rows.append((g * 1000 + i, [*filler(10**6 + g * 1000 + i, 10), *[f"v{i}x{j}" if j in at else w for j, w in enumerate(p)], *filler(2 * 10**6 + g * 1000 + i, 10)]))
        near = p.copy()
        near[rng.randrange(8, 52)] = "changed"
        q = [f"g{g}{w}" if j % 10 == 3 else w for j, w in enumerate(p)]  # far from all variants
        near_q = q.copy()
        near_q[rng.randrange(8, 52)] = "changed"
        rows += [(g * 1000 + 998, [*filler(3 * 10**6 + g, 20), *q]), (g * 1000 + 999, [*filler(4 * 10**6 + g, 30), *near_q])]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    got = {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_passages(df).where("doc_id % 1000 = 999").collect()}
    assert sum((g * 1000 + 999, g * 1000 + 998) in got for g in range(groups)) >= 0.95 * groups


def test_similar_windows_share_one_of_their_rarest_tokens():
    """On plain and circling texts: no pair of similar windows is lost, and most others are."""
    rng, width, lost, kept, pairs = random.Random(31), passage_tokens.WIDTH, 0, 0, 0
    for case in range(30):
        base = [rng.randrange(40 if case % 3 == 0 else 10**6) for _ in range(110)]
        texts = [[rng.choice(base) if rng.random() < 0.12 else rng.randrange(10**6) if rng.random() < 0.05 else x for x in base] for _ in range(2)]
        a, b = (np.array(t, np.uint64) for t in texts)
        both = set(a.tolist()) & set(b.tolist())
        loops = set(a[passage_tokens.looped(a)].tolist()) | set(b[passage_tokens.looped(b)].tolist())
        rare = []
        for t in (a, b):
            at = range(len(t) - width + 1)
            tokens, sizes = np.concatenate([t[i : i + width] for i in at]), np.full(len(at), width)
            flags = [np.array([f(x) for x in tokens.tolist()]) for f in (lambda x: x * 7 % 5, lambda x: x in both, lambda x: x in loops)]
            owner, token = passage_tokens.rarest(tokens, sizes, *flags)
            rare.append([set(token[owner == i].tolist()) for i in at])
        for i, x in enumerate(rare[0]):
            for j, y in enumerate(rare[1]):
                one, two = set(a[i : i + width].tolist()), set(b[j : j + width].tolist())
                similar = len(one & two) >= 0.8 * len(one | two)
                lost += similar and not x & y
                kept, pairs = kept + bool(x & y and not similar), pairs + (not similar)
    assert not lost and kept < 0.5 * pairs


def test_variants_of_one_text_are_not_all_compared(spark, monkeypatch):
    """Where no variant of a text is similar to another the regions compared don't grow with the square of their number."""
    counted = []
    checked = substring_dedup._checked
    monkeypatch.setattr(substring_dedup, "_checked", lambda pairs, regions: counted.append(pairs.count()) or checked(pairs, regions))
    p, rng, n, rows = passage(77_000_000, 56), random.Random(5), 150, []
    for i in range(n):
        at = {rng.randrange(14, 24): f"x{i % 75}", rng.randrange(34, 44): f"y{i // 2}"}
        rows.append((i, " ".join([*filler(8 * 10**7 + i, 10), *[at.get(j, w) for j, w in enumerate(p)], *filler(9 * 10**7 + i, 10)]), "en", "s", 1))
    substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(counted) > 1 and sum(counted) < 12 * n


def test_tokens_of_first_regions_are_shuffled_once(spark, monkeypatch):
    """Texts and spans are shuffled to cut the regions, and each region once to meet the one that it is compared with."""
    plans, save = {}, common.Scratch.save

    def kept(scratch, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return save(scratch, df, name)

    monkeypatch.setattr(common.Scratch, "save", kept)
    rows = [(i, " ".join([*filler(60 + i, 20), *passage(41, 200), *filler(80 + i, 20)]), "en", "s", 1) for i in range(6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i, 0) for i in range(1, 6)}
    assert sum(plans[name].count("Exchange hashpartitioning") for name in ("regions", "checked")) == 4


def test_links_of_many_pairs_at_once():
    """All pairs of a batch give the regions that each gives alone."""
    rng = random.Random(3)
    win = lambda c: c << 20 | rng.randrange(min(c, 50) + 1) << 10 | rng.randrange(51)
    for _ in range(60):
        pairs = []
        for _ in range(rng.randrange(1, 10)):
            at = [rng.randrange(rng.choice([200, 2000])) for _ in range(rng.randrange(1, 25))]
            pairs.append([(rng.randrange(4), win(c), win(c + 300 + rng.choice([0, 3, 90, 150, 400, -70]))) for c in at])
        got = substring_dedup.aligned_all(np.array([x for p in pairs for x in p]), np.array([len(p) for p in pairs]))
        assert sorted(map(tuple, got.tolist())) == sorted((i, *r) for i, p in enumerate(pairs) for r in substring_dedup.aligned(p))


def test_windows_of_consecutive_texts_lie_in_one():
    rng = random.Random(11)
    for _ in range(60):
        parts = [np.array([rng.randrange(rng.choice([20, 1000])) for _ in range(rng.randrange(90))], np.uint64) for _ in range(rng.randrange(1, 8))]
        sizes, tokens = np.array([len(p) for p in parts]), np.concatenate(parts)
        common_, loops = (np.array([rng.random() < share for _ in tokens], bool) for share in (0.9, 0.3))
        assert passage_tokens.looped(tokens, 12, sizes).tolist() == [x for p in parts for x in passage_tokens.looped(p, 12).tolist()]
        each = zip(parts, *(np.split(x, np.cumsum(sizes)[:-1]) for x in (common_, loops)), strict=True)
        want = [x for p, c, l in each for x in passage_tokens.hopeful(p, c, 12, 0.8, l).tolist()]
        assert passage_tokens.hopeful(tokens, common_, 12, 0.8, loops, sizes).tolist() == want


@pytest.mark.parametrize("n", [50, 60, 90])
def test_recall_of_passages_with_a_changed_word(spark, n):
    """At 50 words one changed word leaves a similarity of 0.80, the threshold."""
    rows, rng = [], random.Random(n)
    for i in range(150):
        p = passage(1000 * n + i, n)
        near = p.copy()
        near[rng.randrange(8, n - 8)] = "changed"
        rows += [(2 * i, [*filler(4 * i, 40), *p, *filler(4 * i + 1, 40)]), (2 * i + 1, [*filler(4 * i + 2, 20), *near, *filler(4 * i + 3, 60)])]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    got = {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert all(a == b + 1 and b % 2 == 0 for a, b in got) and len(got) >= 0.95 * 150


def test_passages_cover_what_brute_force_finds(spark):
    """Every 50-word window that an earlier document has word for word, on random texts of many shared passages."""
    rng = random.Random(12)
    pool = [passage(i, rng.choice([30, 45, 55, 80, 130])) for i in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [*filler(rng.randrange(10**6), rng.randrange(0, 30)), *rng.choice(pool)]
        rows.append((i, words))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    covered = {i: set() for i, _ in rows}
    for r in substring_dedup.repeated_passages(df).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert r["first_doc_id"] < r["doc_id"]
    seen, hit, all_of = set(), 0, 0
    for i, w in rows:
        own = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        for s, gram in enumerate(own):
            if gram in seen:
                all_of += 50
                hit += sum(x in covered[i] for x in range(s, s + 50))
        seen |= set(own)
    assert all_of > 100_000 and hit / all_of > 0.999
    vocabulary = {i: set(zip(*[w[k:] for k in range(5)], strict=False)) for i, w in rows}
    for i, w in rows:  # and no word of a passage that no other document has anything of
        alone = [s for s in range(len(w) - 4) if not any(tuple(w[s : s + 5]) in v for j, v in vocabulary.items() if j < i)]
        assert sum(s in covered[i] and s + 4 in covered[i] for s in alone) <= 0.25 * max(1, len(covered[i]))


def test_repeated_ids_null_ids_and_clashing_names(spark):
    """Texts that share an id are documents of their own; only their own passages are cut."""
    p, q = passage(31, 80), passage(32, 80)
    text = lambda *parts: " ".join(w for part in parts for w in part)
    rows = [
        (1, text(filler(1, 40), p), "en", "s", 1), (2, text(filler(2, 30), p, filler(3, 20)), "en", "s", 1), (2, text(filler(4, 60)), "en", "s", 1), (2, "short", "en", "s", 1), (2, "short", "en", "s", 1),
        (3, text(q, filler(5, 30)), "en", "s", 1), (3, text(filler(6, 200), q, p), "en", "s", 1), (None, text(p, q), None, None, None), (4, None, "en", "s", 1), (4, "", "en", "s", 1), (5, text(q), "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as id", "'y' as spans", "1 as `new`", "2 as text_hash", "3 as __0")
    found = substring_dedup.repeated_passages(df)
    assert all(r["text_hash"] is None for r in found.where("doc_id = 5").collect()) and all(r["text_hash"] is not None for r in found.where("doc_id in (2, 3)").collect())
    kept = substring_dedup.without_passages(df, found)
    assert kept.columns == df.columns
    got = kept.collect()
    texts_left = [(r["doc_id"], r["text"]) for r in got]
    for row in (rows[0], rows[2], rows[3], rows[7], rows[8], rows[9]):
        assert (row[0], row[1]) in texts_left
    assert texts_left.count((2, "short")) == 2 and (5, rows[10][1]) not in texts_left
    whole = " ".join(t or "" for i, t in texts_left if i is not None)
    assert whole.count("p31q") <= 80 + 6 and whole.count("p32q") <= 80 + 6 and text(filler(6, 190)) in whole


def test_without_passages_of_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    found = substring_dedup.repeated_passages(df)
    assert substring_dedup.without_passages(df, found).count() == 0
    some = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    assert [r["text"] for r in substring_dedup.without_passages(some, found).collect()] == ["a b"]
