"""Language identification by a byte convolutional network (operator 2).

The network: byte embeddings, filters of several widths, ReLU, max pooling over a window of fixed length, softmax. It is
trained in numpy on every window of a bounded sample of labelled rows. A text of any length is cut into overlapping windows that cover
it wholly; window logits are averaged by the letters they hold. For scoring, embedding and filters are folded into tables
of byte pairs, so a filter of width 4 costs two look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.llm.common import ASCII_LOWER, in_share, local_rows, read

WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
#: Training sample: rows a language, rows at most in all; texts up to MOST_BYTES are preferred, and longer ones taken while a
#: language's texts are together at most LANGUAGE_BYTES, its first text whatever its length; passes, learning rate, seed.
PER_LANGUAGE, SAMPLE, MOST_BYTES, LANGUAGE_BYTES, EPOCHS, RATE, SEED = 150, 4000, 1 << 15, 150 << 15, 6, 0.01, 5
#: Windows that one forward pass handles.
BATCH = 512
STRIDE = WINDOW - max(WIDTHS) + 1
LETTER = regex.compile(r"\p{L}")
#: Bytes that count as letters when window logits are averaged.
LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)], np.float32)


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray  # (widths * FILTERS) x labels
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by byte pair (65536 x FILTERS) or byte (256 x FILTERS), summed along the window."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            one = [(self.embed @ f[k]).astype(np.float32) for k in range(w)]
            two = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            two[0] = two[0] + b
            out.append([*two, one[-1]] if w % 2 else two)
        return out


def windows_of(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover data; neighbours share max(WIDTHS) - 1 bytes, the last is padded with 0."""
    n = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    whole = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::STRIDE]


def pooled(x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Max-pooled filter outputs of windows (n x WINDOW bytes)."""
    pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    out = []
    for w, parts in zip(WIDTHS, tables, strict=True):
        n = WINDOW - w + 1
        y = parts[0].take(pair[:, :n], axis=0)
        for k, part in enumerate(parts[1:], 1):
            y += part.take(pair[:, 2 * k : 2 * k + n], axis=0) if len(part) > 256 else part.take(x[:, 2 * k : 2 * k + n], axis=0)
        out.append(np.maximum(y.max(axis=1), 0))
    return np.concatenate(out, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """Fit on every window of whole texts with their languages; None without any."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    rows, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        own = windows_of(text.encode("utf-8", "replace").translate(ASCII_LOWER))
        own = own[LETTERS[own].any(axis=1)]
        rows.append(own)
        ys += [labels.index(lang)] * len(own)
    x, y = np.concatenate(rows), np.array(ys, np.int64)
    if not len(y):
        return None
    weight = (len(y) / (len(labels) * np.bincount(y, minlength=len(labels))))[y]
    p = {"e": rng.normal(0, 0.5, (256, DIM)), "d": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "o": np.zeros(len(labels))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)), np.zeros(FILTERS)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    as_model = lambda: Model(labels, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["o"])
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            now = order[at : at + 128]
            bx, n, step = x[now], len(now), step + 1
            emb = p["e"][bx]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            tops, places = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                z = sum(emb[:, k : k + span] @ p[f"f{w}"][k] for k in range(w)) + p[f"b{w}"]
                where = z.argmax(axis=1)
                tops.append(np.take_along_axis(z, where[:, None], axis=1)[:, 0])
                places.append(where)
            top = np.concatenate(tops, axis=1)
            h = np.maximum(top, 0)
            out = _softmax(h @ p["d"] + p["o"])
            out[np.arange(n), y[now]] -= 1
            out *= weight[now][:, None] / n
            g["d"], g["o"] = h.T @ out, out.sum(axis=0)
            back = (out @ p["d"].T) * (top > 0)
            for i, (w, where) in enumerate(zip(WIDTHS, places, strict=True)):
                gz = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = gz.sum(axis=0)
                for k in range(w):
                    byte = np.take_along_axis(bx, where + k, axis=1)
                    g[f"f{w}"][k] = np.einsum("nfd,nf->df", p["e"][byte], gz)
                    np.add.at(g["e"], byte, gz[:, :, None] * p[f"f{w}"][k].T[None])
            for k, v in p.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                v -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return as_model()


def predict(model: Model | None, texts: list[str | None], tables: list[list[np.ndarray]] | None = None) -> list[tuple[str, float]]:
    """(language, probability) of whole texts; ("und", 0.0) for null and for texts without a letter."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if model is None:
        return out
    tables = tables or model.tables()
    dense, offset = model.dense.astype(np.float32), model.offset.astype(np.float32)
    held: list[tuple[int, np.ndarray]] = []
    sums = np.zeros((len(texts), len(model.labels)))
    mass = np.zeros(len(texts))

    def run() -> None:
        x = np.concatenate([w for _, w in held])
        owner = np.concatenate([np.full(len(w), i) for i, w in held])
        weight = LETTERS[x].sum(axis=1).astype(np.float64) + 1e-6
        np.add.at(sums, owner, (pooled(x, tables) @ dense + offset) * weight[:, None])
        np.add.at(mass, owner, weight)

    size = 0
    for i, text in enumerate(texts):
        if not text or not LETTER.search(text):
            continue
        rows = windows_of(text.encode("utf-8", "replace").translate(ASCII_LOWER))
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            held.append((i, part))
            size += len(part)
            if size >= BATCH:
                run()
                held, size = [], 0
    if held:
        run()
    for i in np.flatnonzero(mass):
        prob = _softmax(sums[i] / mass[i])
        best = int(prob.argmax())
        out[i] = (model.labels[best], float(min(1.0, max(0.0, prob[best]))))
    return out


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Train on whole texts of rows that are not held out and have a language.

    Of every language as many rows are drawn, by a hash of the id: per_language, or fewer where there are so many languages
    that they would be more than `sample` in all. Texts up to MOST_BYTES come first, then longer ones by size, so a language
    of long texts only is taught by its shortest ones; LANGUAGE_BYTES bound what the driver gets of each. Held-out rows,
    their languages included, have no part in any of this.
    """
    known = docs.where(~held_out(doc_id, 5, 0)).select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("l is not null")
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each = max(1, min(per_language, sample // len(counts)))
    # a little more than the share that fills a language's part, so that tasks send few rows
    share = local_rows(docs.sparkSession, [(x, 3.0 * each / n) for x, n in counts.items()], "l string, share double")
    rows = known.where(F.col("t").rlike(r"\p{L}")).withColumn("o", F.xxhash64(F.lit(SEED), F.col("id")))
    some = rows.join(F.broadcast(share) if len(counts) <= 10_000 else share, "l").where(in_share(F.col("o"), F.col("share")))
    # rows are chosen by their sizes alone; their texts are read for what was chosen
    size = F.octet_length("t")
    by = [F.when(size > MOST_BYTES, size).otherwise(0), "o", "h"]
    sized = some.withColumn("h", F.xxhash64("t")).select("l", "o", "h", size.alias("n"), by[0].alias("long"))
    order = Window.partitionBy("l").orderBy("long", "o", "h")
    ranked = sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = ranked.where((F.col("rank") == 1) | (F.col("sum") <= LANGUAGE_BYTES)).select("l", "o", "h").distinct()
    got = some.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["l", "o", "h"]).select("o", "l", "t").orderBy("o", "l", "t").limit(sample + len(counts)).collect()
    return train([r["t"] for r in got], [r["l"] for r in got])


def identified(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_id") -> DataFrame:
    """docs with a struct column `out` of (lang_pred, score), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mine = shared.value
        tables = mine.tables() if mine else None
        for batch in batches:
            yield pd.DataFrame(predict(mine, [None if t is None else t for t in batch], tables), columns=["lang_pred", "score"])

    return docs.withColumn(out, of(F.col(text)))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Null texts and texts without a letter (Unicode category L) are `und` with score 0, as is everything if no row has a
    language to learn from. Repeated rows each come back; rows with a null id are not held out; other columns are not read,
    so clashing names don't matter. An empty table gives an empty result.
    """
    model = fit(docs, doc_id, text, lang)
    rows = identified(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_id.lang_pred", "lang_id.score")


def known_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.35) -> DataFrame:
    """docs whose language can be told: texts with a letter and a score of at least `least`; columns as they were.

    If no row has a language to learn from, only texts without a letter go, null and empty ones among them. Repeated rows
    are judged alike; rows with a null id and other columns, whatever their names, stay as they are. An empty table stays
    empty.
    """
    model = fit(docs, doc_id, text, lang)
    columns = [f"__{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, columns, strict=True))[text]
    rated = identified(docs.toDF(*columns), model, own, "language")
    enough = F.col("language.score") >= least if model else F.lit(True)
    kept = rated.where(F.col(own).isNotNull() & F.col(own).rlike(r"\p{L}") & enough)
    return kept.select(*[F.col(c).alias(name) for c, name in zip(columns, docs.columns, strict=True)])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))
