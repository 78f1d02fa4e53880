"""Secrets in texts: fixed patterns, and values in a credential's place that are hard to guess.

Patterns give the base spans. Besides, every value that stands in a credential's context (after a key
word and ``:`` or ``=``, in an authorization header, in a URL's user part) is segmented at the least
guessing cost by dynamic programming: into words of a ranked list (in any case, with common character
swaps), dates and years, copies of what stands up to eight characters before, walks over neighbouring
keys or along the alphabet, and characters guessed by brute force. Costs are decimal logarithms of
numbers of guesses and add up; each segment after the first costs ``SWITCH`` more. All costs are
additive a character, so an open segment is a state and a value takes time in proportion to its length,
whatever that is. A value of ``least`` or more (10: ten billion guesses) is a span of kind ``guess``
unless a base span covers part of it.

Words come from a public tokenizer's vocabulary file, whose order is one of frequency; its path is a
parameter. One pass over the texts, no shuffle; a document is worked on whole.

Defined results: a null or empty text has no spans; repeated rows are each reported; an empty table
gives no rows; other columns are ignored; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import LOWER, blocks

#: Base kinds in their order, and the least lengths of a value, a key id and a hexadecimal run.
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Fixed value: the assignment pattern, here over lower-cased bytes.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")

#: Where a credential's value stands; the first group that matched is the value. Over lower-cased bytes.
CONTEXT = re.compile(
    rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|encryption|signing|client|account)[ _-]?(?:key|secret|token))[\"']?\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?[\"'`]?([^\s\"'`,;<>(){}\[\]]+)"
    rb"|authorization[\"']?\x20*[:=]\x20*[\"']?(?:bearer|basic|token)\x20+([a-z0-9+/_.=~-]+)"
    rb"|://[^\s/:@]+:([^\s/:@]+)@"
)

SWITCH = math.log10(4)
BRUTE = 1.0
#: Longest word that is looked up; farthest copy.
LONGEST, FARTHEST = 24, 8
_COPY, _COPIED = 0.6, 0.05
_WALK, _STEP, _TURN = math.log10(94), 0.05, math.log10(4)

#: Rows of a US keyboard, unshifted and shifted, each row half a key to the right of the one above.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), ("~!@#$%^&*()_+", "QWERTYUIOP{}|", "ASDFGHJKL:\"", "ZXCVBNM<>?")
_KEY = {c: (r, i + (0 if r == 0 else r + 1)) for rows in _ROWS for r, row in enumerate(rows) for i, c in enumerate(row)}
#: Characters that often stand for letters.
_SWAPS = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b"})
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:(?:19|20)\d\d|\d\d)|(?:1[0-2]|0?[1-9])([-/._]?)(?:[12]\d|3[01]|0?[1-9])\3(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
_DATE_COST = {True: math.log10(365 * 120), False: math.log10(120)}


def _direction(a: str, b: str):
    """How ``b`` follows ``a``: along the alphabet or the digits, or to a neighbouring key; None if it doesn't."""
    step = ord(b) - ord(a)
    if abs(step) == 1 and a.isalnum() and b.isalnum():
        return "code", step
    x, y = _KEY.get(a), _KEY.get(b)
    if x is None or y is None:
        return None
    move = y[0] - x[0], y[1] - x[1]
    return ("key", move) if move in ((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)) else None


def _word_cost(own: str, rank: int, swaps: int) -> float:
    upper = sum(c.isupper() for c in own)
    cased = 0.0 if not upper else math.log10(2) if upper == len(own) or (upper == 1 and own[0].isupper()) else math.log10(sum(math.comb(len(own), k) for k in range(1, min(upper, len(own) - upper) + 1)) or 1)
    return math.log10(rank + 1) + cased + swaps * math.log10(2)


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses that ``value`` takes; from ``enough`` on any number of at least that."""
    n = len(value)
    lower, swapped = value.lower(), value.lower().translate(_SWAPS)
    if len(lower) != n:  # a letter whose lower case is longer
        lower = swapped = value
    done = [math.inf] * (n + 1)
    done[0] = -SWITCH
    brute, walk, was, copies = math.inf, math.inf, None, [math.inf] * (FARTHEST + 1)
    for j in range(1, n + 1):
        before = done[j - 1] + SWITCH
        # What may go on at j: brute force, a copy from p characters before, a walk and its last direction.
        brute = min(before, brute) + BRUTE
        best = brute
        c = value[j - 1]
        for p in range(1, min(FARTHEST, j - 1) + 1):
            copies[p] = min(before + _COPY, copies[p]) + _COPIED if value[j - 1 - p] == c else math.inf
            best = min(best, copies[p])
        way = _direction(value[j - 2], c) if j >= 2 else None
        walk = min(walk + (_STEP if way == was else _TURN), done[j - 2] + SWITCH + _WALK + _STEP) if way else math.inf
        was, best = way, min(best, walk)
        for i in range(max(0, j - LONGEST), j - 2):
            word = lower[i:j]
            rank = ranks.get(word)
            if rank is not None:
                best = min(best, done[i] + SWITCH + _word_cost(value[i:j], rank, 0))
            if (other := swapped[i:j]) != word and (rank := ranks.get(other)) is not None:
                best = min(best, done[i] + SWITCH + _word_cost(value[i:j], rank, sum(a != b for a, b in zip(word, other))))
        for i in range(max(0, j - 10), j - 3):
            if value[i].isdigit() and _DATE.fullmatch(value, i, j):
                best = min(best, done[i] + SWITCH + _DATE_COST[j - i > 4] + (0.6 if not value[i:j].isdigit() else 0.0))
        done[j] = best
        # Whatever follows, a segmentation has an end among the last places: none of them gets cheaper.
        if best >= enough and j >= LONGEST and min(done[j - LONGEST : j + 1]) >= enough:
            return best
    return max(done[n], 0.0)


@lru_cache(maxsize=2)
def word_ranks(path: str) -> dict[str, int]:
    """Words of three letters and more of a tokenizer's vocabulary that marks word ends, by their order in it."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = sorted((n, w[:-4]) for w, n in vocabulary.items() if w.endswith("</w>") and len(w) >= 7 and w[:-4].isalpha() and len(w) - 4 <= LONGEST)
    return {w: rank for rank, (_, w) in enumerate(words)}


_HEX, _UPPER = np.ones(256, dtype=bool), np.ones(256, dtype=bool)
_HEX[[*range(48, 58), *range(97, 103)]] = False
_UPPER[[*range(48, 58), *range(65, 91)]] = False


def _base(block) -> dict[int, list]:
    """For each document that has any its base spans (start, kind, end) in bytes of the block."""
    found: dict[int, list] = {}

    def add(at: int, kind: int, end: int) -> None:
        found.setdefault(int(np.searchsorted(block.bounds, at, side="right")) - 1, []).append((at, kind, end))

    starts, ends, _ = block.words(_HEX)
    for k in np.flatnonzero(ends - starts >= LEAST_HEX).tolist():
        add(int(starts[k]), 2, int(ends[k]))
    starts, ends, _ = block.words(_UPPER)
    for k in np.flatnonzero(ends - starts >= LEAST_ACCESS).tolist():
        run = block.data[starts[k] : ends[k]].tobytes()
        at = run.find(b"AKIA")
        if at >= 0 and len(run) - at >= LEAST_ACCESS:
            add(int(starts[k]) + at, 1, int(ends[k]))
    return found


def _scan(path: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(path)

        @lru_cache(maxsize=1 << 14)
        def short(value: str) -> bool:
            return guess_cost(value, ranks, least) >= least

        for batch in batches:
            for block in blocks(batch.column(1)):
                n, found, text = len(block), _base(block), LOWER[block.data].tobytes()
                counts = np.zeros((n, 4), dtype=np.int64)
                digests, spans = [_NONE] * n, [""] * n
                for d in range(n):
                    a, b = int(block.bounds[d]), int(block.bounds[d + 1])
                    own = found.get(d, [])
                    own += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text, a, b) if m.end(2) - m.start(2) >= LEAST_VALUE]
                    held = sorted((s, e) for s, _, e in own)
                    reach = list(np.maximum.accumulate([e for _, e in held])) if held else []
                    begins = [s for s, _ in held]
                    for m in CONTEXT.finditer(text, a, b):
                        s, e = m.span(m.lastindex)
                        k = int(np.searchsorted(begins, e))  # base spans that begin before the value's end
                        if e - s < 4 or (k and reach[k - 1] > s):
                            continue
                        value = block.data[s:e].tobytes().decode("utf-8", "replace")
                        if short(value) if len(value) <= 256 else guess_cost(value, ranks, least) >= least:
                            own.append((s, 3, e))
                    if own:
                        own.sort()
                        place = np.concatenate([[0], np.cumsum((block.data[a:b] & 0xC0) != 0x80)])
                        shown = [(kind, f"{KINDS[kind]}:{place[s - a]}:{place[e - a]}") for s, kind, e in own]
                        spans[d] = ",".join(x for _, x in shown)
                        digests[d] = hashlib.sha256(",".join(x for kind, x in shown if kind < 3).encode()).hexdigest()
                        counts[d] = np.bincount([kind for kind, _ in shown], minlength=4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, type=pa.string()), pa.array(spans, type=pa.string()), pa.array(counts[:, 3])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
                )

    return run


_NONE = hashlib.sha256(b"").hexdigest()


def find_secrets(docs: DataFrame, vocabulary: str, least: float = 10.0) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): base spans by kind, their digest, all spans, and how many the guessing cost added.

    Spans are written kind:start:end, ordered by start and then kind. ``vocabulary`` is the path of the
    ranked words, the same file on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(vocabulary, least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
