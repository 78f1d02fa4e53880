"""Language identification by interpolated Kneser-Ney character language models.

One model a language is fitted on a bounded sample of labelled rows (``sample_docs`` documents a
language, chosen by a hash of doc_id whatever their length; of one longer than ``sample_chars`` a run of so
many characters from a place given by a hash); a fifth of it is held back to calibrate rejection. Letters are lower-cased, every run of other characters becomes one space.

The models are stored together: for each order a sorted array of n-gram hashes and a matrix with one
log-probability a language, and for each order a sorted array of context hashes with the log back-off
weights. A text is scored by binary search in these arrays: its longest known n-gram at each
character, and the back-off weights of the contexts that are longer. The language of the lowest
cross-entropy a character wins. A text is rejected if that cross-entropy is above the language's
calibrated limit (a quantile of held-back texts plus a margin, wider for short texts), or if it has no
letters.

Defined results: a null text or one without letters is ``und`` with score 0 and not accepted; equal
cross-entropies give the language that sorts first; repeated rows are each scored; without any
labelled row every text is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import Block, blocks, keep_rows, mix, run_of_text

ORDER = 4
#: A short text's cross-entropy varies: the limit is widened by so many nats over the square root of its characters.
SLACK = 4.0
#: Bytes of text whose grams are counted together in fitting.
FIT_BYTES = 1 << 18
#: Characters that are scored together.
SLICE = 1 << 17
_LAST_LETTER = 0x32400
_SALT = np.random.default_rng(0x1A96).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD: list[np.ndarray] = []

SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"


def _fold() -> np.ndarray:
    """For each code point its lower case, or 32 if it is no letter."""
    if not _FOLD:
        table = np.full(_LAST_LETTER + 1, 32, dtype=np.uint32)
        for i in range(_LAST_LETTER):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def letters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all documents, each beginning with one space, and where each document begins."""
    data = np.insert(block.data, block.bounds[:-1], 10)
    bounds = block.bounds + np.arange(len(block.bounds))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    b0 = data[lead]
    code = b0.astype(np.uint32)
    wide = np.flatnonzero(b0 >= 0xC0)
    if len(wide):
        at = lead[wide]
        b, c1, c2, c3 = (padded[at + k].astype(np.uint32) for k in range(4))
        c1, c2, c3 = c1 & 63, c2 & 63, c3 & 63
        code[wide] = np.select([b < 0xE0, b < 0xF0], [(b & 31) << 6 | c1, (b & 15) << 12 | c1 << 6 | c2], (b & 7) << 18 | c1 << 12 | c2 << 6 | c3)
    folded = _fold()[np.minimum(code, _LAST_LETTER)]
    space = folded == 32
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begin = np.searchsorted(lead, bounds)
    keep[begin[:-1]] = True  # a document never leans on the one before
    after = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], after[begin]


def gram_hashes(text: np.ndarray, first: np.ndarray, order: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each position; before a document all is space."""
    at = np.arange(len(text)) if at is None else at
    total = np.full(len(at), order, dtype=np.uint64)
    begin = first[np.searchsorted(first, at, side="right") - 1] if order > 1 else None
    for k in range(order):
        if k:
            back = at - k
            value = np.where(back >= begin, text[np.maximum(back, 0)], 32)
        else:
            value = text[at]
        total += (value.astype(np.uint64) + np.uint64(1)) * _SALT[k]
    return mix(total)


@dataclass
class Model:
    """grams[n], logp[n], contexts[n], backoff[n] for orders 1..ORDER; limits: the largest accepted cross-entropy."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def cross_entropies(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character of each document under each language, the characters scored, and the letters."""
        text, first = letters(block)
        number, n = len(block), np.diff(first) - 1
        sums = np.zeros((number, len(self.langs)))
        for begin in range(0, len(text), SLICE):
            at = np.arange(begin, min(begin + SLICE, len(text)))
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at > first[doc]
            scores = self._scores(text, first, at[inside])
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(doc[inside], scores[:, k], minlength=number)
        letter = np.concatenate([[0], np.cumsum(text != 32)])
        return -sums / np.maximum(n, 1)[:, None], n, letter[first[1:]] - letter[first[:-1]]

    def _scores(self, text: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log-probability of the characters at some positions under each language."""
        scores = np.zeros((len(at), len(self.langs)), dtype=np.float32)
        left, held = np.arange(len(at)), np.zeros((len(at), len(self.langs)), dtype=np.float32)
        for order in range(ORDER, 0, -1):
            keys, grams = gram_hashes(text, first, order, at[left]), self.grams[order]
            spot = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            known = grams[spot] == keys
            scores[left[known]] = self.logp[order][spot[known]] + held[left[known]]
            left = left[~known]
            if not len(left):
                break
            if order > 1:
                context = gram_hashes(text, first, order - 1, at[left] - 1)
                spot = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
                known = self.contexts[order][spot] == context
                held[left[known]] += self.backoff[order][spot[known]]
        scores[left] = self.floor + held[left]
        return scores


def _distinct(keys: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, counts: np.ndarray | None = None) -> tuple:
    """Distinct grams, their counts, and the grams without their last and without their first character."""
    unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(inverse, counts, minlength=len(unique)).astype(np.int64), prefix[at], suffix[at]


def _merged(one: tuple | None, other: tuple) -> tuple:
    if one is None:
        return other
    keys, counts, prefix, suffix = (np.concatenate(x) for x in zip(one, other))
    return _distinct(keys, prefix, suffix, counts)


def fit(texts: dict[str, list[str]], quantile: float = 0.999, margin: float = 0.8) -> Model:
    """Kneser-Ney models of ``texts`` by language; every fifth text calibrates the limit of rejection instead."""
    langs = sorted(texts)
    own: dict[str, list] = {}
    for lang in langs:
        kept = [t for k, t in enumerate(texts[lang]) if k % 5 != 4 or len(texts[lang]) < 5]
        tables = [None] + [None] * ORDER
        for block in blocks(pa.array(kept, type=pa.string()), FIT_BYTES):
            text, first = letters(block)
            at = np.setdiff1d(np.arange(len(text)), first[:-1], assume_unique=True)
            below = np.zeros(len(text), dtype=np.uint64)
            for n in range(1, ORDER + 1):
                whole = gram_hashes(text, first, n)
                tables[n] = _merged(tables[n], _distinct(whole[at], below[at - 1], below[at]))
                below = whole
        counted = []
        for n in range(1, ORDER + 1):
            keys, counts, prefix, suffix = tables[n]
            if n < ORDER:  # the number of different characters seen before it
                after, number = np.unique(tables[n + 1][3], return_counts=True)
                spot = np.minimum(np.searchsorted(after, keys), len(after) - 1)
                counts = np.where(after[spot] == keys, number[spot], 0)
            counted.append((keys, counts, prefix, suffix))
        own[lang] = counted
    model = Model(langs, [None], [None], [None], [None], np.empty(0), np.full(len(langs), np.inf))
    below = None
    for n in range(1, ORDER + 1):
        keys, _, prefix, suffix = _distinct(*(np.concatenate(x) for x in zip(*((own[l][n - 1][0], own[l][n - 1][2], own[l][n - 1][3]) for l in langs))))
        contexts = np.unique(prefix)
        p, weight = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
        spot = np.searchsorted(contexts, prefix)
        for k, lang in enumerate(langs):
            grams, counts, before, _ = own[lang][n - 1]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / max(once + 2 * twice, 1) if once else 0.5
            row = np.searchsorted(contexts, before)
            total = np.bincount(row, counts, minlength=len(contexts))
            kinds = np.bincount(row, np.minimum(counts, discount), minlength=len(contexts))
            weight[:, k] = np.where(total > 0, kinds / np.maximum(total, 1), 1.0)
            p[np.searchsorted(keys, grams), k] = np.maximum(counts - discount, 0) / np.maximum(total[row], 1)
        if below is None:
            floor = weight[0] / (len(keys) + 1)  # one place for all unknown characters
            p += floor
            model.floor = np.log(np.maximum(floor, 1e-12)).astype(np.float32)
        else:
            p += weight[spot] * below[1][np.searchsorted(below[0], suffix)]
        below = (keys, p)
        model.grams.append(keys)
        model.logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(np.maximum(weight, 1e-12)).astype(np.float32))
    for k, lang in enumerate(langs):
        held = [t for i, t in enumerate(texts[lang]) if i % 5 == 4]
        found = [model.cross_entropies(b)[0][:, k] for b in blocks(pa.array(held, type=pa.string()), FIT_BYTES)]
        if found:
            model.limits[k] = np.quantile(np.concatenate(found), quantile) + margin
    return model


def sample(docs: DataFrame, labelled: Column, sample_docs: int, sample_chars: int) -> dict[str, list[str]]:
    """About ``sample_docs`` texts a language, by a hash of doc_id, or runs of long ones; what it brings to the driver has that bound."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[str]] = {}
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, 1_000_000 * sample_docs // n))).otherwise(share)
    for row in rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < share).select("lang", run_of_text(F.col("text"), sample_chars).alias("text"), F.xxhash64("doc_id", "text").alias("h")).collect() if counts else []:
        out.setdefault(row["lang"], []).append((row["h"], row["text"]))
    return {lang: [t for _, t in sorted(x)] for lang, x in out.items()}


def _predict(shared, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block)
                if model is None:
                    best, score, low, named, size = np.zeros(n, int), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool), np.ones(n)
                    limits, langs = np.zeros(1), np.array(["und"], dtype=object)
                else:
                    h, size, letter = model.cross_entropies(block)
                    best, named = h.argmin(axis=1), letter > 0
                    low = h[np.arange(n), best]
                    score = np.where(named, 1 / np.exp(-sharpness * (h - low[:, None])).sum(axis=1), 0.0)
                    limits, langs = model.limits, np.array(model.langs, dtype=object)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), pa.array(np.where(named, langs[best], "und").tolist(), type=pa.string()), pa.array(score), pa.array(np.where(named, low, np.nan), from_pandas=True), pa.array(named & (low - SLACK / np.sqrt(np.maximum(size, 1)) <= limits[best]))],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"],
                )

    return run


def identify(docs: DataFrame, training: DataFrame, labelled: Column, sample_docs: int = 800, sample_chars: int = 1 << 16, sharpness: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and accepted for each row of ``docs`` (doc_id, text).

    training: rows (doc_id, text, lang) of which those where ``labelled`` holds are learned from.
    score: the share of the best language in a softmax of ``-sharpness`` times the cross-entropies.
    """
    run = predictor(docs.sparkSession, training, labelled, sample_docs, sample_chars, sharpness)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def predictor(spark: SparkSession, training: DataFrame, labelled: Column, sample_docs: int = 800, sample_chars: int = 1 << 16, sharpness: float = 8.0):
    """Fits the models and gives the mapInArrow function that ``identify`` applies."""
    texts = sample(training, labelled, sample_docs, sample_chars)
    return _predict(spark.sparkContext.broadcast(fit(texts) if texts else None), sharpness)


def keep_accepted(docs: DataFrame, labelled: Column) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) that are not rejected."""
    return keep_rows(docs, predictor(docs.sparkSession, docs, labelled), "accepted")
