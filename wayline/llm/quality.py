"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words, all of them, whatever its length. Each passage is
encoded as shares of byte pairs (hashed into buckets), word-form statistics and repetition within the
document; a learned layer embeds it. Attention weights come from a gate, softmax over the document of
w.(tanh(Vh) * sigmoid(Uh)), and the weighted sum of the embeddings is scored by a logistic layer. All
is learned from document labels alone, by Adam in numpy, on a bounded sample of labelled rows
(``sample_docs`` by a hash of doc_id, whatever their length; of one longer than ``sample_chars`` the passages
of a run of so many characters from a place given by a hash). Executors only score.

Defined results: a null or empty text is one empty passage and gets a score; ties play no part;
repeated rows are each scored, repeated or contradictory labels each count; rows with a null label
are not learned from; without labels every score is 0.5; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import LOWER, SPACE, Block, blocks, keep_rows, mix, run_of_text, span_hashes

PASSAGE, BUCKETS, HIDDEN, GATE = 64, 96, 24, 12
SCHEMA = "doc_id long, score double, predicted int, passages long, top_passage long, top_weight double, good boolean"

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other ASCII mark, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 not ASCII, 7 sentence mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_CLASS[[44, 46, 39, 45, 59, 58, 63, 33]] = 7
_PAIR = (mix(np.arange(65536, dtype=np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int32)
FEATURES = BUCKETS + 8 + 6


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and for each document where its passages begin."""
    starts, ends, first = block.words(SPACE)
    words = np.diff(first)
    count = np.maximum(-(-words // PASSAGE), 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(words)), words)
    of_word = begin[:-1][owner] + (np.arange(len(owner)) - first[:-1][owner]) // PASSAGE
    n = int(begin[-1])
    # A byte belongs to the passage of the last word that began before it, or else to its document's first.
    doc = np.repeat(np.arange(len(words)), np.diff(block.bounds))
    last = np.searchsorted(starts, np.arange(len(block.data)), side="right") - 1
    of_byte = begin[:-1][doc]
    started = last >= first[:-1][doc]
    of_byte[started] = of_word[last[started]]
    size = np.maximum(np.bincount(of_byte, minlength=n), 1)[:, None]
    out = np.zeros((n, FEATURES), dtype=np.float32)
    low = LOWER[block.data]
    if len(low) > 1:
        same = of_byte[1:] == of_byte[:-1]
        pair = _PAIR[low[:-1].astype(np.int32) << 8 | low[1:]][same]
        out[:, :BUCKETS] = np.sqrt(np.bincount(of_byte[1:][same] * BUCKETS + pair, minlength=n * BUCKETS).reshape(n, BUCKETS) / size)
    out[:, BUCKETS : BUCKETS + 8] = np.sqrt(np.bincount(of_byte * 8 + _CLASS[block.data], minlength=8 * n).reshape(n, 8) / size)
    at = BUCKETS + 8
    number = np.bincount(of_word, minlength=n)
    some = np.maximum(number, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(of_word, length, minlength=n) / some
    out[:, at] = np.log1p(mean)
    out[:, at + 1] = np.log1p(np.sqrt(np.maximum(np.bincount(of_word, length**2, minlength=n) / some - mean**2, 0)))
    out[:, at + 2] = np.log1p(number)
    if len(starts):
        tail = np.isin(_CLASS[block.data[ends - 1]], (0, 7))
        out[:, at + 3] = np.bincount(of_word, tail, minlength=n) / some
        hashes = span_hashes(low, starts, ends)
        for k, keys in enumerate((hashes, mix(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(5)) if len(hashes) > 2 else hashes[:0])):
            where = of_word[: len(keys)]
            order = np.lexsort((np.arange(len(keys)), keys, owner[: len(keys)]))
            again = np.zeros(len(keys), dtype=bool)
            if len(order):
                again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
            out[:, at + 4 + k] = np.bincount(where, again, minlength=n) / some
    return out, begin


class Bags:
    """The model: scores bags of passages, and its gradient."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        p, at, count = self.p, begin[:-1], np.diff(begin)
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), count))
        a = e / np.repeat(np.add.reduceat(e, at), count)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        return z @ p["c"] + p["d"][0], a, (x, h, t, s, z, count)

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, a, (x, h, t, s, z, count) = self.forward(x, begin)
        g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        per = np.repeat(g, count)
        da = h @ p["c"] * per
        de = a * (da - np.repeat(np.add.reduceat(a * da, begin[:-1]), count))
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (a * per)[:, None] * p["c"] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h**2)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}


def fit(texts: list[str], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Bags:
    """Adam over shuffled bags; the order and the start are fixed, so equal samples give equal models."""
    parts = [passages(b) for b in blocks(pa.array(texts, type=pa.string()))]
    x = np.concatenate([f for f, _ in parts])
    count = np.concatenate([np.diff(b) for _, b in parts])
    begin = np.concatenate([[0], np.cumsum(count)])
    deviation = x.std(axis=0)
    model = Bags(x.mean(axis=0), np.where(deviation > 1e-4, 1 / np.maximum(deviation, 1e-4), 0).astype(np.float32), seed)
    rng, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        order = rng.permutation(len(count))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            own = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in some])
            grad = model.gradient(x[own], np.concatenate([[0], np.cumsum(count[some])]), labels[some])
            step += 1
            for k, g in grad.items():
                g = g + decay * model.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                model.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, labelled: Column, sample_docs: int, sample_chars: int) -> tuple[list[str], np.ndarray]:
    """About ``sample_docs`` labelled texts, by a hash of doc_id, or runs of long ones. The chosen labels have that bound, so they are sent to all."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(labelled & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = rows.count()
    share = min(1_000_000, 1_000_000 * sample_docs // max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", run_of_text(F.col("text"), sample_chars).alias("text"))
    got = sorted((r["doc_id"], r["quality"], r["text"]) for r in picked.collect())
    return [t for _, _, t in got], np.array([q for _, q, _ in got], dtype=np.float32)


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Bags | None = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block)
                if model is None:
                    score, count, top, weight = np.full(n, 0.5), np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n)
                else:
                    x, begin = passages(block)
                    logit, a, _ = model.forward(x, begin)
                    score, count = 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64))), np.diff(begin)
                    best = np.lexsort((np.arange(len(a)), -a, np.repeat(np.arange(n), count)))[begin[:-1]]
                    top, weight = best - begin[:-1], a[best].astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count), pa.array(top), pa.array(weight), pa.array(score >= threshold)], names=["doc_id", "score", "predicted", "passages", "top_passage", "top_weight", "good"])

    return run


def classify(docs: DataFrame, training: DataFrame, labels: DataFrame, labelled: Column, sample_docs: int = 4000, sample_chars: int = 1 << 15, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, passages, top_passage and top_weight (the passage that weighs most) for each row of ``docs`` (doc_id, text).

    training, labels: texts (doc_id, text) and their labels (doc_id, quality) of which those where ``labelled`` holds are learned from.
    """
    run = scorer(docs.sparkSession, training, labels, labelled, sample_docs, sample_chars, threshold)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def scorer(spark: SparkSession, training: DataFrame, labels: DataFrame, labelled: Column, sample_docs: int = 4000, sample_chars: int = 1 << 15, threshold: float = 0.3):
    """Fits the model and gives the mapInArrow function that ``classify`` applies."""
    texts, y = sample(training, labels, labelled, sample_docs, sample_chars)
    return _score(spark.sparkContext.broadcast(fit(texts, y) if len(texts) else None), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, labelled: Column, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose score is at least ``threshold``."""
    return keep_rows(docs, scorer(docs.sparkSession, docs, labels, labelled, threshold=threshold), "good")
