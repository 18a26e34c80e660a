"""Quality scores by attention-based multiple-instance learning (operator 8).

A document is a bag of passages of fixed length that cover it wholly. Each passage is described by its words (hashed to
BUCKETS), shares of character classes, word statistics and repetition, encoded by a tanh layer, and weighted by gated
attention; the weighted sum gives the score. All weights are learned from document labels alone, in numpy, on every passage
of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import in_share, read
from relscope.llm.language_id import held_out
from relscope.llm.passage_tokens import word_hashes

#: Bytes of a passage; hidden and attention sizes.
PASSAGE, HIDDEN, GATE = 600, 16, 8
#: Labelled documents at most; texts up to MOST_BYTES are preferred, and all drawn texts of a label are together at most
#: LABEL_BYTES, the first whatever its length; passes, rate, seed.
SAMPLE, MOST_BYTES, LABEL_BYTES, EPOCHS, RATE, SEED = 6000, 1 << 15, 96 << 20, 40, 0.01, 3
#: Buckets of hashed words, and passages that are described at once.
BUCKETS, AT_ONCE = 64, 800

CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r\x0b\x0c", b".", b",", b"!", b"?", b":;", b"'\"", b"|", b"#", b"$", b"%", b"&", b"*", b"-_", b"/\\<>=@^~`+", b"()[]{}"]
KIND = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    KIND[list(_c)] = _i
KIND[128:] = len(CLASSES) + 1
N_KINDS = len(CLASSES) + 2
#: Class shares, words a byte, share of distinct words, share of words equal to the one before, longest word, passage fill,
#: then the square roots of the shares of words by bucket.
N_PLAIN = N_KINDS + 5
N_FEATURES = N_PLAIN + BUCKETS


def features(text: str | None) -> np.ndarray:
    """Passages x N_FEATURES of the whole text; an empty or null text is one passage of zeros.

    A word belongs to the passage that it begins in.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros((1, N_FEATURES), np.float32)
    span = AT_ONCE * PASSAGE
    return np.concatenate([_described(data[at : at + span]) for at in range(0, len(data), span)])


def _described(data: np.ndarray) -> np.ndarray:
    n = -(-len(data) // PASSAGE)
    out = np.zeros((n, N_FEATURES), np.float32)
    owner = np.arange(len(data)) // PASSAGE
    count = np.bincount(owner * N_KINDS + KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    size = count.sum(axis=1)
    out[:, :N_KINDS] = count / size[:, None]
    out[:, N_PLAIN - 1] = size / PASSAGE
    hashes, start, end = word_hashes(data, np.zeros(0, np.int64))
    if not len(hashes):
        return out
    where = start // PASSAGE
    k = np.bincount(where, minlength=n)
    most = np.maximum(1, k)
    order = np.lexsort((hashes, where))
    fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (where[order][1:] != where[order][:-1])))
    out[:, N_KINDS] = 10 * k / size
    out[:, N_KINDS + 1] = np.bincount(where[order][fresh], minlength=n) / most
    out[:, N_KINDS + 2] = np.bincount(where[1:][(hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])], minlength=n) / most
    longest = np.zeros(n)
    np.maximum.at(longest, where, np.minimum(60, end - start) / 20)
    out[:, N_KINDS + 3] = longest
    bucket = (hashes >> np.uint64(58)).astype(np.int64)
    out[:, N_PLAIN:] = np.sqrt(np.bincount(where * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / most[:, None])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag of passages."""
        x = ((np.concatenate(bags) - self.mean) / self.scale).clip(-8, 8)
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
        return _forward(self.p, x, starts)["out"]


def _forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "out": 1 / (1 + np.exp(-(z @ p["c"] + p["d"]).clip(-30, 30)))}


def train(bags: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """Gradient descent (Adam) on the log loss of document labels; None without labels."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [((b - mean) / scale).clip(-8, 8) for b in bags]
    y = np.array(labels, float)
    share = y.mean().clip(0.02, 0.98)
    p = {
        "w": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, 0.1, GATE), "c": rng.normal(0, 0.1, HIDDEN), "d": np.array(np.log(share / (1 - share))),
    }
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            now = order[at : at + 64]
            step += 1
            x = np.concatenate([bags[i] for i in now])
            starts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in now])[:-1]))
            f = _forward(p, x, starts)
            h, t, s, a, sizes = (f[k] for k in ("h", "t", "s", "a", "sizes"))
            err = (f["out"] - y[now]) / len(now)
            g = {"c": f["z"].T @ err, "d": err.sum()}
            gz = np.repeat(err[:, None] * p["c"], sizes, axis=0)
            ga = (gz * h).sum(axis=1)
            ge = a * (ga - np.repeat(np.add.reduceat(a * ga, starts), sizes))
            g["a"] = (t * s).T @ ge
            gt, gs = ge[:, None] * p["a"] * s * (1 - t**2), ge[:, None] * p["a"] * t * s * (1 - s)
            g["v"], g["u"] = h.T @ gt, h.T @ gs
            gh = (a[:, None] * gz + gt @ p["v"].T + gs @ p["u"].T) * (1 - h**2)
            g["w"], g["b"] = x.T @ gh + 1e-4 * p["w"], gh.sum(axis=0)
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * np.square(g[k])
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Train on at most `sample` labelled documents that are not held out, chosen by a hash of the id, with all passages.

    Texts up to MOST_BYTES come first, then longer ones by size, while those of a label are at most LABEL_BYTES; the first of
    a label is taken whatever its length, so long texts teach where there are no others. Null texts are drawn as empty ones.
    """
    rows = labels.where(~held_out(doc_id, 3, 1) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    order = F.xxhash64(F.lit(SEED), F.col(doc_id))
    some = rows.where(in_share(order, 2 * sample / max(1, rows.count())))
    chosen = some.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y"), order.alias("__o")).orderBy("__o", "y").limit(sample)
    texts = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # what is drawn is settled by sizes alone, a row a drawn document
    sizes = texts.join(F.broadcast(chosen), "__id").select("__id", "y", "__o", F.octet_length("t").alias("n")).orderBy("__o", "y", "n").limit(sample).collect()
    spent, ids = {0: 0, 1: 0}, {}
    for r in sorted(sizes, key=lambda r: (r["n"] if r["n"] > MOST_BYTES else 0, r["__o"], r["y"], r["n"])):
        if not spent[r["y"]] or spent[r["y"]] + r["n"] <= LABEL_BYTES:
            spent[r["y"]] += r["n"] + 1
            ids[(r["__id"], r["y"], r["__o"])] = max(r["n"], ids.get((r["__id"], r["y"], r["__o"]), 0))
    drawn = docs.sparkSession.createDataFrame([(*k, n) for k, n in ids.items()], "__id long, y int, __o long, most int")
    found = texts.join(F.broadcast(drawn), "__id").where(F.octet_length("t") <= F.col("most")).orderBy("__o", "y", "t").limit(sample)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["__id"], "y": pdf["y"], "bag": [features(t).tobytes() for t in pdf["t"]]})

    got = sorted(found.mapInPandas(bags, "id long, y int, bag binary").collect(), key=lambda r: (r["id"], r["y"], bytes(r["bag"])))
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in got], [r["y"] for r in got])


def scored(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`: the score of the whole text; 0.5 where there was nothing to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = np.full(len(batch), 0.5)
            if shared.value is not None:
                held, size, first = [], 0, 0
                for i, t in enumerate(batch):
                    held.append(features(t))
                    size += len(held[-1])
                    if size >= 4096 or i == len(batch) - 1:
                        got[first : i + 1] = shared.value.score(held)
                        held, size, first = [], 0, i + 1
            yield pd.Series(got)

    return docs.withColumn(out, of(F.col(text)))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts are scored as one empty passage. Labels other than 0 and 1, and labels without a document, teach
    nothing; without any label every score is 0.5. Repeated rows each come back, rows with a null id are not held out, and
    other columns are not read. An empty table gives an empty result.
    """
    model = fit(docs, labels, doc_id, text, label)
    rows = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
