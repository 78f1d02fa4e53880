"""A small causal self-attention language model over subword ids in numpy, and its use to score whole corpora.

A text is its words (lower-cased A-Z) and one end; a word is its subword ids, the last of which is marked
(a *symbol* is an id and whether it ends its word; the end and a word without ids are symbols too). Each
word's input is the sum of the embeddings of all its ids. One attention head with relative-position biases
reads the words before; each symbol of the next word is then predicted from what was read and from the
symbol before it in that word. A probability over all symbols is a path in a tree of two learned
softmaxes, *groups* and the *leaves* of a group, times the symbol's share of its leaf:

    P(symbol) = P(group | context) * P(leaf | group, context) * corpus(symbol | leaf)

The learned factors are mixed with the corpus's frequencies (``MIX``). A word's probability is a mixture
(``WHOLE``) of two: the product over its symbols, and that of its first symbol's leaf times the word's
add-half share, in the corpus, of the words that begin in that leaf. The first can spell any word, the
second knows those of the corpus.

All training documents are learned from, whole. Words, symbols and ends are counted over them, and so is
which ids stand near each other, from which ids get their groups. For the weights each document, of
whatever length, is cut into slices of ``SLICE`` words, and each slice has its turn in one of the
``ROUNDS``: each task learns from its slices by itself, from the average of the round before, and the
results are averaged, each embedding by how often its task met it. The first round is the smallest, so it
has the fewest tasks. A corpus of fewer than ``START`` slices is gone through more often, in every round.

Scoring goes in overlapping windows: blocks of ``STRIDE`` words attend to themselves and to the
``STRIDE`` before, under one mask for causality and document bounds, many blocks at a time. Each token
is scored once.

Word counts can have any size, so they are never broadcast: documents are put into chunks of bounded
size in the order in which they are read, and written as numbers into the chunk's own table of words.
Each chunk's distinct words get the sums of their counts in a window over the words' bytes, and each
chunk meets its counts again in a cogroup. A word has at most a row or two a chunk, a chunk is bounded:
neither is a hot key.

Defined results: a null or wordless text is one end; repeated rows are each scored, and learned from;
equal texts get equal scores; rows with a null doc_id count as not held out if the caller's column says
so; a text longer than a chunk is a chunk by itself; an empty training side gives base scores of
log10(0.5 / (0.5 * (V + 1))) with V = 0 and the untrained model's scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep
from .textvec import LOWER, SPACE, Block, blocks, distinct_spans, mix, one_thread, ragged, span_hashes
from .tokens import coder

STRIDE, DIM, HIDDEN, GROUPS, LEAVES = 16, 16, 24, 32, 32
#: The share of the corpus's frequencies in each learned factor, and of whole words in a word's probability.
MIX, WHOLE = 0.02, 0.7
CHUNK_BYTES = 28 << 20
#: Words of a slice; slices that learning takes in all at least, so small corpora are gone through more often; slices of a task at least; rates of the averaged rounds.
SLICE, START, TASK_SLICES, ROUNDS = 64, 16_000, 16_000, (0.012, 0.006, 0.002)
#: Each round takes so many times the slices of the one before.
MORE = 4
#: Slices of a step of learning, and slices that a task holds and shuffles at once.
BATCH, HELD_SLICES = 32, 8000
#: Parts in which embeddings travel when they are averaged.
PARTS = 16
#: Hashed neighbours that ids are told apart by when they are grouped, and how far away they stand.
NEAR, REACH = 128, 5
#: Slices have turns from 0 to this, by a hash.
TURNS = 1 << 20


@dataclass
class Words:
    """Words as subword ids: the ids of word i are ids[bounds[i]:bounds[i + 1]]."""

    ids: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, which: np.ndarray) -> "Words":
        size = np.diff(self.bounds)[which]
        return Words(self.ids[ragged(self.bounds[which], size)], np.concatenate([[0], np.cumsum(size)]))


@dataclass
class Windows:
    """Blocks of positions of some documents. A position reads the word before it and predicts its own, or the end."""

    x: np.ndarray  # the word that each position reads: 0 is the beginning, k the word k - 1
    target: np.ndarray  # the word that it predicts, -1 for the end
    query: np.ndarray  # (blocks, STRIDE) positions; a block's keys are the block before and itself
    exists: np.ndarray  # which query positions are of the block's document
    real: np.ndarray  # which of them are to be scored
    opening: np.ndarray  # which blocks are their document's first, so that the block before is another's


_CAUSAL = np.arange(2 * STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE
_LAG = np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :], 0, 2 * STRIDE - 1)


def windows(words: np.ndarray, counts: np.ndarray, opens: np.ndarray | None = None, closes: np.ndarray | None = None) -> Windows:
    """words: numbers of all words of all documents; counts: words of each. opens, closes: whether the first word and the end are predicted, all by default."""
    # Only the end's own position reads the last word: without it, nothing reads that word.
    size = counts + 1 if closes is None else np.maximum(counts + closes, 1)
    bounds = np.concatenate([[0], np.cumsum(size)])
    opening = np.zeros(int(bounds[-1]), dtype=bool)
    opening[bounds[:-1]] = True
    last = np.cumsum(counts) - 1
    read = np.ones(len(words), dtype=bool)
    if closes is not None:
        read[last[~closes & (counts > 0)]] = False
    ending = np.zeros(len(opening), dtype=bool)
    ending[bounds[1:][size > counts] - 1] = True
    x, target = np.zeros(len(opening), dtype=np.int64), np.full(len(opening), -1, dtype=np.int64)
    x[~opening], target[~ending] = words[read] + 1, words
    wanted = np.ones(len(opening), dtype=bool)
    if opens is not None:
        wanted[bounds[:-1][~opens]] = False
    if closes is not None:
        wanted[bounds[1:][~closes & (counts == 0)] - 1] = False
    number = -(-size // STRIDE)
    owner = np.repeat(np.arange(len(size)), number)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    query = (bounds[:-1][owner] + STRIDE * k)[:, None] + np.arange(STRIDE)
    exists = query < bounds[1:][owner][:, None]
    query = np.minimum(query, max(len(opening) - 1, 0))
    return Windows(x, target, query, exists, exists & wanted[query] if len(wanted) else exists, k == 0)


class Tree:
    """Where each symbol stands: its group, its leaf in the group, and its share of the leaf."""

    def __init__(self, group: np.ndarray, leaf: np.ndarray, count: np.ndarray):
        self.group, self.leaf = group, leaf
        at = group * LEAVES + leaf
        shape = (GROUPS + 1, LEAVES)
        kinds, total = np.bincount(at, minlength=shape[0] * LEAVES), np.bincount(at, count, minlength=shape[0] * LEAVES)
        self.share = np.log((count + 0.5) / (total + 0.5 * kinds)[at])
        self.open = (kinds > 0).reshape(shape)
        mass = np.where(self.open, total.reshape(shape) + 0.5, 0)
        self.prior1 = (mass.sum(1) / mass.sum()).astype(np.float32)
        self.prior2 = (mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)).astype(np.float32)

    def at(self, symbol: np.ndarray) -> np.ndarray:
        """One number for group and leaf."""
        return self.group[symbol] * LEAVES + self.leaf[symbol]

    @classmethod
    def plain(cls, vocabulary: int) -> "Tree":
        return cls.grown(vocabulary, np.arange(vocabulary) % GROUPS, np.zeros(2 * vocabulary + 2))

    @classmethod
    def grown(cls, vocabulary: int, groups: np.ndarray, count: np.ndarray) -> "Tree":
        """Of groups of ids and counts of symbols: leaves hold about equal shares of their group, so frequent symbols stand alone."""
        group = np.append(np.repeat(groups, 2), [GROUPS, GROUPS])
        order = np.lexsort((np.arange(len(count)), -count, group))
        mass = count[order] + 0.5
        total = np.bincount(group, count + 0.5, minlength=GROUPS + 1)
        first = np.searchsorted(group[order], np.arange(GROUPS + 1))
        before = np.cumsum(mass) - mass
        before -= before[np.minimum(first, len(before) - 1)][group[order]]
        leaf = np.zeros(len(count), dtype=np.int64)
        leaf[order] = np.minimum(before / total[group[order]] * LEAVES, LEAVES - 1).astype(np.int64)
        leaf[2 * vocabulary :] = [0, 1]
        return cls(group, leaf, count)


#: Logits within this go through exp as they are, others less the largest of their column first.
_PLAIN = 40


def _plain(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no input within -1 to 1 gives a logit that is large, or only logits that are small. Logits along the last axis, inputs along the one before."""
    spread = np.abs(weights).sum(axis=-2)
    return bool((bias + spread).max() < _PLAIN and (bias - spread).max(axis=-1).min() > -_PLAIN)


def _runs(a: np.ndarray, rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``a`` that each run of ``rows`` names: run i is rows[begin[i]:begin[i] + size[i]], none is empty."""
    order = np.argsort(9 - np.minimum(size, 9).astype(np.uint8), kind="stable")  # long runs first
    begin, size = begin[order], size[order]
    out = a.take(rows[begin], axis=0)
    for k in range(1, 8):
        n = int(np.count_nonzero(size > k))
        if not n:
            break
        out[:n] += a.take(rows[begin[:n] + k], axis=0)
    n = int(np.count_nonzero(size > 8))
    if n:
        out[:n] = np.add.reduceat(a.take(rows[ragged(begin[:n], size[:n])], axis=0), np.cumsum(size[:n]) - size[:n], axis=0)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return out.take(back, axis=0)


def _sums(index: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``a`` that share an index."""
    out = np.zeros(size * a.shape[1], dtype=a.dtype)
    np.add.at(out, (index[:, None] * a.shape[1] + np.arange(a.shape[1])).ravel(), a.ravel())  # flat and of one type: numpy's quick path
    return out.reshape(size, -1)


def _kinds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and which of them each is; short ids are sorted by their digits."""
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")
    new = np.ones(len(ids), dtype=bool)
    new[1:] = np.diff(ids[order]) != 0
    index = np.empty(len(ids), dtype=np.int64)
    index[order] = np.cumsum(new) - 1
    return ids[order[new]], index


class Net:
    """Weights and tree. Rows of E: the vocabulary's ids, then the beginning, a word without ids, and 'no symbol before'."""

    def __init__(self, vocabulary: int, tree: Tree | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.size, self.tree = vocabulary, tree or Tree.plain(vocabulary)
        self.p = {
            "E": (0.1 * rng.standard_normal((vocabulary + 3, DIM))).astype(np.float32), "Q": draw(DIM, DIM), "K": draw(DIM, DIM), "V": draw(DIM, DIM), "r": np.zeros(2 * STRIDE, np.float32),
            "W1": draw(DIM, HIDDEN), "W2": draw(DIM, HIDDEN), "U": draw(DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
            "O1": 0.3 * draw(HIDDEN, GROUPS + 1), "o1": np.log(self.tree.prior1), "O2": 0.3 * draw(GROUPS + 1, HIDDEN, LEAVES), "o2": np.log(np.maximum(self.tree.prior2, 1e-9)),
        }

    BEGIN, BLANK, FIRST = range(3)

    def row(self, k: int) -> int:
        return self.size + k

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of E that make up the inputs, the input that each is part of, and the inputs: the beginning, then the words."""
        size = np.diff(words.bounds)
        filled = np.concatenate([[1], np.maximum(size, 1)])
        rows = np.full(int(filled.sum()), self.row(self.BLANK))
        rows[0] = self.row(self.BEGIN)
        rows[1:][np.repeat(size > 0, filled[1:])] = words.ids
        return rows, np.repeat(np.arange(len(filled)), filled), _runs(self.p["E"], rows, np.cumsum(filled) - filled, filled)

    def spelling(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words' symbols and then the end, the row of E of the symbol before each, where each word's begin, and their numbers. The end is the last, word -1."""
        symbol, bounds = symbols_of(words, self.size)
        before = np.concatenate([[0], symbol >> 1])
        before[bounds] = self.row(self.FIRST)
        return np.append(symbol, 2 * self.size), before, bounds, np.append(np.diff(bounds), 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Each distinct input's query, key, value and direct part of the hidden layer, side by side."""
        p = self.p
        out = x @ np.concatenate([p["Q"] * x.dtype.type(DIM**-0.5), p["K"], p["V"], p["W1"]], axis=1)
        out[:, 3 * DIM :] += p["b"]
        return out

    def attend(self, projected: np.ndarray, w: Windows, some: slice) -> tuple:
        """What the hidden layer gets from attention and the word before, for a slice of blocks."""
        p, low = self.p, some.start or 0
        q = w.x[w.query[max(low - 1, 0) : some.stop]]
        if not low:  # before the first block stands none, so any will do
            q = np.concatenate([q[:1], q])
        own = projected.take(q.ravel(), axis=0)
        n, (row, one) = len(q) - 1, own.strides
        # A block's keys begin where the block before does: views that overlap.
        of = lambda k, size: np.ndarray((n, size, DIM), own.dtype, own, (2 * STRIDE - size) * row + k * DIM * one, (STRIDE * row, row, one))
        queries, keys, values = of(0, STRIDE), of(1, 2 * STRIDE), of(2, 2 * STRIDE)
        e = np.matmul(queries, keys.transpose(0, 2, 1))
        e += np.where(_CAUSAL, p["r"][_LAG], -1e9).astype(e.dtype)
        e[w.opening[some], :, :STRIDE] = -1e9
        e -= e.max(axis=2, keepdims=True)
        np.exp(e, out=e)
        e *= 1 / (e.reshape(-1, 2 * STRIDE) @ np.ones(2 * STRIDE, dtype=e.dtype)).reshape(n, STRIDE, 1)
        read = np.matmul(e, values)
        return own[STRIDE:, 3 * DIM :] + read.reshape(-1, DIM) @ p["W2"], (q[1:], queries, keys, values, e, read)

    def hidden(self, pre: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """The hidden layer and a last column of ones for the biases. spelled: what the symbols before contribute; is overwritten."""
        spelled += pre
        out = np.ones((len(spelled), HIDDEN + 1), dtype=spelled.dtype)
        out[:, :HIDDEN] = np.tanh(spelled, out=spelled)
        return out

    def by_group(self, symbol: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the symbols by their groups, and each group that some have with where it begins and ends there."""
        group = self.tree.group[symbol].astype(np.int16)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(GROUPS + 2)).tolist()
        return order, [(g, i, j) for g, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j]

    def outputs(self) -> tuple[np.ndarray, bool]:
        """For each group the weights and, last, the biases of all groups and of its own leaves, side by side; and whether their logits are ``_plain``."""
        p, bias = self.p, np.where(self.tree.open, self.p["o2"], np.float32(-1e9))
        both, filled = np.empty((GROUPS + 1, HIDDEN + 1, GROUPS + 1 + LEAVES), dtype=p["O1"].dtype), self.tree.open.any(1)
        both[:, :HIDDEN, : GROUPS + 1], both[:, HIDDEN, : GROUPS + 1] = p["O1"], p["o1"]
        both[:, :HIDDEN, GROUPS + 1 :], both[:, HIDDEN, GROUPS + 1 :] = p["O2"], bias
        return both, _plain(p["O1"], p["o1"]) and _plain(p["O2"][filled], bias[filled])

    def exponentials(self, h: np.ndarray, groups: list[tuple[int, int, int]], outputs: tuple[np.ndarray, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all groups and then of the leaves of each one's group, not yet divided by their sums; and the two sums. ``h`` in the order of ``by_group``.

        Small logits go through exp as they are, others less the largest.
        """
        both, plain = outputs
        out = np.empty((len(h), GROUPS + 1 + LEAVES), dtype=h.dtype)
        for g, i, j in groups:
            np.matmul(h[i:j], both[g], out=out[i:j])
        halves = out[:, : GROUPS + 1], out[:, GROUPS + 1 :]
        if not plain:
            for one in halves:
                one -= one.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return (out, *(one @ np.ones(one.shape[1], dtype=h.dtype) for one in halves))

    def sorted_logs(self, h: np.ndarray, symbol: np.ndarray, groups: list[tuple[int, int, int]], outputs: tuple[np.ndarray, bool]) -> np.ndarray:
        """``logs`` of what is in the order of ``by_group``, from what ``hidden`` gives."""
        t, group, leaf, at = self.tree, self.tree.group[symbol], self.tree.leaf[symbol], np.arange(len(symbol))
        both, one, two = self.exponentials(h, groups, outputs)
        first, second = both[at, group] / one, both[at, GROUPS + 1 + leaf] / two
        return np.log(((1 - MIX) * first + MIX * t.prior1[group]) * ((1 - MIX) * second + MIX * t.prior2[group, leaf]))

    def logs(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural logarithms of the mixed probabilities of the symbols' leaves. h: a symbol a row."""
        order, groups = self.by_group(symbol)
        out = np.empty(len(h), dtype=np.result_type(h.dtype, np.float32))
        out[order] = self.sorted_logs(np.concatenate([h[order], np.ones((len(h), 1), dtype=h.dtype)], axis=1), symbol[order], groups, self.outputs())
        return out

    def contributions(self) -> np.ndarray:
        """What each row of E adds to the hidden layer as the symbol before."""
        return self.p["E"] @ self.p["U"]

    def word_logs(self, words: Words, w: Windows, step: int = 256, contributions: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For what each position predicts natural logarithms of the probability of its symbols and of its first symbol's leaf, 0 where it isn't to be scored."""
        contributions = self.contributions() if contributions is None else contributions
        out, head = np.zeros(len(w.target)), np.zeros(len(w.target))
        projected, outputs = self.project(self.inputs(words)[2]), self.outputs()
        symbols, befores, begins, numbers = self.spelling(words)
        for i in range(0, len(w.query), step):
            some = slice(i, i + step)
            pre, _ = self.attend(projected, w, some)
            real = np.flatnonzero(w.real[some])
            at = w.query[some].ravel()[real]
            target = w.target[at]
            n = numbers[target]
            flat = ragged(begins[target], n)
            symbol = symbols[flat]
            order, groups = self.by_group(symbol)
            h = self.hidden(pre.take(np.repeat(real, n)[order], axis=0), contributions.take(befores[flat[order]], axis=0))
            found = np.empty(len(symbol))
            found[order] = self.sorted_logs(h, symbol[order], groups, outputs)
            begin = np.cumsum(n) - n
            out[at] = np.add.reduceat(found + self.tree.share[symbol], begin) if len(begin) else 0
            head[at] = found[begin]
        return out, head

    def loss_gradient(self, words: Words, w: Windows) -> tuple[float, dict, np.ndarray]:
        """Mean loss a symbol without the mixing, gradients, and the rows of E that ``gradient["E"]`` is of. No word is read twice."""
        p, t = self.p, self.tree
        rows, owner, x = self.inputs(words)
        pre, (q, queries, keys, values, e, read) = self.attend(self.project(x), w, slice(None))
        symbols, befores, begins, numbers = self.spelling(words)
        real = np.flatnonzero(w.real)
        target = w.target[w.query.ravel()[real]]
        number = numbers[target]
        flat = ragged(begins[target], number)
        order, groups = self.by_group(symbols[flat])
        symbol, before = symbols[flat[order]], befores[flat[order]]
        spelled = p["E"].take(before, axis=0)
        h = self.hidden(pre.take(np.repeat(real, number)[order], axis=0), spelled @ p["U"])
        group, leaf, n = t.group[symbol], t.leaf[symbol], max(len(symbol), 1)
        at, outputs = np.arange(len(symbol)), self.outputs()
        both, one, two = self.exponentials(h, groups, outputs)
        loss, part = 0.0, h.dtype.type(1 / n)
        for some, total, k in ((both[:, : GROUPS + 1], one, group), (both[:, GROUPS + 1 :], two, leaf)):
            some *= (part / total)[:, None]
            chosen = some[at, k]
            loss -= np.log(chosen * n).sum()
            some[at, k] = chosen - part
        g = {"O2": np.zeros_like(p["O2"]), "o2": np.zeros_like(p["o2"])}
        first, dz = np.zeros((HIDDEN + 1, GROUPS + 1), dtype=h.dtype), np.empty((len(h), HIDDEN), dtype=h.dtype)
        for c, i, j in groups:
            second = h[i:j].T @ both[i:j]
            first += second[:, : GROUPS + 1]
            g["O2"][c], g["o2"][c] = second[:HIDDEN, GROUPS + 1 :], second[HIDDEN, GROUPS + 1 :]
            np.matmul(both[i:j], outputs[0][c, :HIDDEN].T, out=dz[i:j])
        g["O1"], g["o1"] = first[:HIDDEN], first[HIDDEN]
        h = h[:, :HIDDEN]
        dz *= 1 - h * h
        g["U"] = spelled.T @ dz
        dpre = np.zeros_like(pre)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = at
        if len(real):
            dpre[real] = _runs(dz, back, np.cumsum(number) - number, number)
        g["W2"], dread = read.reshape(-1, DIM).T @ dpre, (dpre @ p["W2"].T).reshape(read.shape)
        de = np.matmul(dread, values.transpose(0, 2, 1))
        de -= ((dread * read).reshape(-1, DIM) @ np.ones(DIM, dtype=read.dtype)).reshape(*read.shape[:2], 1)
        de *= e
        g["r"] = np.bincount(_LAG.ravel(), de.sum(0).ravel(), minlength=2 * STRIDE).astype(p["r"].dtype)
        d = np.empty((len(dpre), 3 * DIM + HIDDEN), dtype=dpre.dtype)
        at = lambda k: d.reshape(*read.shape[:2], -1)[:, :, k * DIM : (k + 1) * DIM]
        np.matmul(de, keys, out=at(0))
        for k, a, b in ((1, de, queries), (2, e, dread)):
            np.matmul(a[:, :, STRIDE:].transpose(0, 2, 1), b, out=at(k))
            # The first half of a block's keys are the block before, or masked and without gradient.
            at(k)[:-1] += np.matmul(a[1:, :, :STRIDE].transpose(0, 2, 1), b[1:])
        d[:, 3 * DIM :] = dpre
        # Positions beyond their document's end get and give no gradient.
        scale, read_by = x.dtype.type(DIM**-0.5), q.ravel()
        g["Q"], g["K"], g["V"], g["W1"] = np.split(x.take(read_by, axis=0).T @ d, [DIM, 2 * DIM, 3 * DIM], axis=1)
        g["Q"] = g["Q"] * scale
        g["b"] = d[:, 3 * DIM :].sum(0)
        each = np.zeros((len(d) + 1, DIM), dtype=x.dtype)
        np.matmul(d, np.concatenate([p["Q"] * scale, p["K"], p["V"], p["W1"]], axis=1).T, out=each[:-1])
        by = np.full(len(x), len(d))  # the row of nothing
        exists = np.flatnonzero(w.exists)
        by[read_by[exists]] = exists
        dx = each.take(by, axis=0)
        dx[0] = each.take(exists[read_by[exists] == 0], axis=0).sum(0)
        later = np.flatnonzero(before != self.row(self.FIRST))
        touched, index = _kinds(np.concatenate([rows, before[later], [self.row(self.FIRST)]]))
        dz = dz @ p["U"].T
        some = dz.take(later, axis=0)
        g["E"] = _sums(index, np.concatenate([dx.take(owner, axis=0), some, [dz.sum(0) - some.sum(0)]]), len(touched))
        return float(loss) / n, g, touched


def _neighbours(vocabulary: int):
    """mapInArrow function over (symbols): how often each id stands near each hashed neighbour, in parts."""

    def run(batches):
        one = np.int32(1)  # of the table's type: numpy takes another path, 20 times slower, for any other
        table, near = None, (mix(np.arange(vocabulary, dtype=np.uint64)) % np.uint64(NEAR)).astype(np.int64)
        for batch in batches:
            symbols = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            real = symbols < 2 * vocabulary
            ids, owner = (symbols[real] >> 1).astype(np.int64), owner[real]
            if table is None:
                table = np.zeros(vocabulary * NEAR, dtype=np.int32)
            for lag in range(1, REACH + 1):
                same = np.flatnonzero(owner[lag:] == owner[:-lag])
                a, b = ids[same], ids[same + lag]
                np.add.at(table, a * NEAR + near[b], one)
                np.add.at(table, b * NEAR + near[a], one)
        if table is not None:
            empty = np.empty(0, dtype=np.float64).tobytes()
            for k, some in enumerate(np.array_split(table.reshape(vocabulary, NEAR), PARTS)):
                yield _part_rows([(k, some.astype(np.float32).tobytes(), empty)])

    return run


def _groups(table: np.ndarray, seed: int = 5) -> np.ndarray:
    """Groups of ids that stand in like company: k-means on weighted co-occurrence with hashed neighbours."""
    group, t = np.arange(len(table)) % GROUPS, table
    seen = t.sum(1)
    often = np.flatnonzero(seen >= 40)
    if len(often) < GROUPS:
        return group
    t = np.log(np.maximum(t * t.sum() / np.maximum(seen[:, None] * t.sum(0, keepdims=True), 1e-9), 1)).astype(np.float32)
    v = np.linalg.eigh(t[often].T @ t[often])[1][:, ::-1]
    z = t @ v[:, :24]
    z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(seen[often].astype(np.float64))
    centre = z[often[np.random.default_rng(seed).choice(len(often), GROUPS, replace=False, p=weight / weight.sum())]]
    for _ in range(15):
        nearest = (z[often] @ centre.T).argmax(1)
        for g in range(GROUPS):
            own = nearest == g
            if own.any():
                centre[g] = np.average(z[often[own]], axis=0, weights=weight[own])
                centre[g] /= np.linalg.norm(centre[g]) + 1e-9
    met = seen > 0
    group[met] = (z[met] @ centre.T).argmax(1)
    return group


def _unpacked(symbols: list[np.ndarray], vocabulary: int) -> tuple[Words, np.ndarray]:
    """Slices' symbols as words, and the number of words of each slice."""
    flat, size = np.concatenate(symbols), np.array([len(s) for s in symbols])
    ending = (flat & 1) == 1  # the last symbol of a word; a word without ids is odd too
    counts = np.diff(np.concatenate([[0], np.cumsum(ending)])[np.concatenate([[0], np.cumsum(size)])])
    word = np.cumsum(ending) - ending
    real = flat < 2 * vocabulary
    return Words((flat >> 1)[real], np.concatenate([[0], np.cumsum(np.bincount(word[real], minlength=int(ending.sum())))]).astype(np.int64)), counts


class Learner:
    """Adam over batches of slices, rows of E only where a batch has them. ``met``: how often each row was."""

    def __init__(self, net: Net, rate: float, seed: int = 3):
        self.net, self.rate, self.rng, self.step = net, rate, np.random.default_rng(seed), 0
        # All weights but E are parts of one array, and go through a step together.
        self.rest = _rest(net.p)
        _put_rest(net.p, self.rest)
        self.m, self.v = ((np.zeros_like(self.rest), np.zeros_like(net.p["E"])) for _ in range(2))
        self.met = np.zeros(len(net.p["E"]))

    def learn(self, slices: list[np.ndarray], flags: np.ndarray, epochs: int = 1) -> None:
        """flags: 1 a document's first words, 2 its last."""
        net, (m, m_e), (v, v_e) = self.net, self.m, self.v
        for _ in range(epochs):
            order = self.rng.permutation(len(slices))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                words, counts = _unpacked([slices[j] for j in some], net.size)
                _, grad, rows = net.loss_gradient(words, windows(np.arange(len(words)), counts, (flags[some] & 1) > 0, (flags[some] & 2) > 0))
                self.met[rows] += 1
                self.step += 1
                self.rest -= self._move(m, v, _rest(grad))
                one, two = m_e.take(rows, axis=0), v_e.take(rows, axis=0)
                net.p["E"][rows] -= self._move(one, two, grad["E"])
                m_e[rows], v_e[rows] = one, two

    def _move(self, m: np.ndarray, v: np.ndarray, g: np.ndarray) -> np.ndarray:
        """What a step takes off; brings the running means up to date and overwrites ``g``."""
        m *= 0.9
        m += 0.1 * g
        g *= g
        g -= v
        g *= 0.005
        v += g
        np.sqrt(v, out=g)
        g *= (1 - 0.995**self.step) ** -0.5
        g += 1e-8
        np.divide(m, g, out=g)
        g *= self.rate / (1 - 0.9**self.step)
        return g


def _rest(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p) if k != "E"])


def _put_rest(p: dict, flat: np.ndarray) -> None:
    """Makes all weights but E views of ``flat``."""
    at = 0
    for k in sorted(p):
        if k != "E":
            p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size


def _learned(shared, rate: float, epochs: int):
    """mapInArrow function over (symbols, flags): each task's weights after its own slices, times what they count, in parts."""

    def run(batches):
        one_thread()
        net: Net = shared.value
        learner, count, slices, flags = None, 0, [], []

        def some():
            nonlocal learner, count
            if learner is None:
                own = Net(net.size, net.tree)
                own.p = {k: x.copy() for k, x in net.p.items()}
                learner = Learner(own, rate)
            learner.learn(slices, np.array(flags), epochs)
            count += len(slices)
            slices.clear()
            flags.clear()

        for batch in batches:
            at = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            slices += np.split(at, ends[:-1])
            flags += batch.column(1).to_pylist()
            if len(slices) >= HELD_SLICES:
                some()
        if slices:
            some()
        if learner is not None:
            p, met = learner.net.p, learner.met
            parts = [(k, (p["E"][rows] * met[rows, None]).astype(np.float32).tobytes(), met[rows].tobytes()) for k, rows in enumerate(np.array_split(np.arange(len(p["E"])), PARTS))]
            parts.append((PARTS, (_rest(p) * np.float32(count)).tobytes(), np.array([count], dtype=np.float64).tobytes()))
            yield _part_rows(parts)

    return run


def _part_rows(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], type=pa.int32()), *(pa.array([x[k] for x in parts], type=pa.binary()) for k in (1, 2))], names=["part", "sums", "counts"])


def _added(batches):
    """mapInArrow function: the sums of each part's rows, held one at a time."""
    total: dict[int, list] = {}
    for batch in batches:
        for k, sums, counts in zip(*(c.to_pylist() for c in batch.columns)):
            sums, counts = np.frombuffer(sums, dtype=np.float32).astype(np.float64), np.frombuffer(counts, dtype=np.float64)
            if k in total:
                total[k][0] += sums
                total[k][1] += counts
            else:
                total[k] = [sums, counts.copy()]
    if total:
        yield _part_rows([(k, s.astype(np.float32).tobytes(), c.tobytes()) for k, (s, c) in total.items()])


_PARTED = "part int, sums binary, counts binary"


def _in_parts(df: DataFrame, function) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums and counts of all tasks' parts, added up by the executors."""
    parts = df.mapInArrow(function, _PARTED).repartition(PARTS + 1, "part").mapInArrow(_added, _PARTED)
    return {r["part"]: (np.frombuffer(r["sums"], dtype=np.float32), np.frombuffer(r["counts"], dtype=np.float64)) for r in parts.collect()}


def _averaged(net: Net, slices: DataFrame, rate: float, epochs: int) -> None:
    """One round: all tasks learn from ``slices`` (symbols, flags), and ``net`` takes the weighted mean of their weights."""
    shared = slices.sparkSession.sparkContext.broadcast(net)
    rows = _in_parts(slices, _learned(shared, rate, epochs))
    shared.unpersist()
    for k, at in enumerate(np.array_split(np.arange(len(net.p["E"])), PARTS)):
        if k in rows:
            sums, counts = rows[k]
            seen = counts > 0
            net.p["E"][at[seen]] = sums.reshape(len(at), DIM)[seen] / counts[seen, None]
    if PARTS in rows:
        _put_rest(net.p, (rows[PARTS][0] / rows[PARTS][1][0]).astype(np.float32))


def block_words(block: Block, own) -> tuple:
    """Lower-cased bytes, spans and hashes of a block's words, where each document's begin, its distinct words' first spans and ids, and which each word is."""
    data = LOWER[block.data]
    starts, ends, first = block.words(SPACE, data)
    hashes = span_hashes(data, starts, ends)
    if not len(starts):
        return data, starts, ends, hashes, first, np.empty(0, np.int64), Words(np.empty(0, np.int64), np.zeros(1, np.int64)), np.empty(0, np.int64)
    begin, count, inverse, pool = own.lookup(data, starts, ends, hashes)
    at = np.empty(len(begin), dtype=np.int64)
    at[inverse[::-1]] = np.arange(len(inverse))[::-1]
    return data, starts, ends, hashes, first, at, Words(pool[ragged(begin, count)], np.concatenate([[0], np.cumsum(count)])), inverse


def symbols_of(words: Words, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """All words' symbols, and where each word's begin."""
    size = np.diff(words.bounds)
    filled = np.maximum(size, 1)
    bounds = np.concatenate([[0], np.cumsum(filled)])
    out = np.full(int(bounds[-1]), 2 * vocabulary + 1, dtype=np.int64)
    out[np.repeat(size > 0, filled)] = 2 * words.ids.astype(np.int64)
    ending = bounds[1:] - 1
    out[ending[size > 0]] += 1
    return out, bounds


def _chunked(chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for block in blocks(batch.column(2)):
                if held and held + len(block.data) > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += len(block.data)
                n = len(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *(batch.column(k).slice(block.first, n) for k in range(3))], names=["chunk", "doc_id", "held_out", "text"])

    return run


#: What the first pass gives. WORD: a word of a chunk, its number there and its training count. TABLE: the ids of a chunk's words, and how many each has in
#: ``word``. TEXT: a document as its words' numbers, its id in ``n``, whether it is held out in ``at``. COUNTED: counts of symbols. SLICED: what is learned from, its turn in ``at``.
GATHERED = "kind int, chunk long, word binary, ids binary, at int, head int, n long, symbols array<int>, counts array<long>"
WORD, COUNTED, SLICED, TABLE, TEXT = range(5)
_EMPTY = {"kind": pa.int32(), "chunk": pa.int64(), "word": pa.binary(), "ids": pa.binary(), "at": pa.int32(), "head": pa.int32(), "n": pa.int64(), "symbols": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}


def _gathered(rows: int, kind: int, /, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(rows, kind)
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) if k in columns else pa.nulls(rows, t) for k, t in _EMPTY.items()], names=list(_EMPTY))


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _id_type(vocabulary: int) -> np.dtype:
    """How ids travel."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _gather(tokenizer_path: str, vocabulary: int, share: float = 1.0):
    """mapInArrow function over (chunk, held_out, text) and, if texts are wanted, doc_id. share: of the slices."""
    id_type = _id_type(vocabulary)

    def merged(chunk: int, parts: list) -> list[pa.RecordBatch]:
        sizes = np.concatenate([s for _, s, *_ in parts])
        data, hashes, n = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 4))
        ids = np.concatenate([w.ids for _, _, _, w, *_ in parts])
        counts = np.concatenate([np.diff(w.bounds) for _, _, _, w, *_ in parts])
        ends = np.cumsum(sizes)
        where, which, _ = distinct_spans(data, ends - sizes, ends, hashes)
        n = np.bincount(which, n, minlength=len(where)).astype(np.int64)
        words = Words(ids, np.concatenate([[0], np.cumsum(counts)])).take(where)
        size = sizes[where]
        symbols, bounds = symbols_of(words, vocabulary)
        total = np.bincount(symbols, np.repeat(n, np.diff(bounds)), minlength=2 * vocabulary + 2)
        some = np.flatnonzero(total)
        out = []
        if len(where):
            texts = _binary(data[ragged((ends - sizes)[where], size)], np.concatenate([[0], np.cumsum(size)]))
            out.append(_gathered(len(where), WORD, chunk=np.full(len(where), chunk), word=texts, at=np.arange(len(where)), head=symbols[bounds[:-1]], n=n))
        if len(some):
            out.append(_gathered(1, COUNTED, symbols=[some.tolist()], counts=[total[some].astype(np.int64).tolist()]))
        out.append(_gathered(1, TABLE, chunk=[chunk], ids=[words.ids.astype(id_type).tobytes()], word=[np.diff(words.bounds).astype("<i4").tobytes()]))
        first = np.cumsum([0] + [len(s) for _, s, *_ in parts])
        for offset, (*_, numbers, lengths, doc_id, held_out) in zip(first, parts):
            if doc_id is not None:
                numbers = which[offset + numbers].astype("<i4")
                out.append(_gathered(len(lengths), TEXT, chunk=np.full(len(lengths), chunk), n=doc_id, at=held_out.astype(np.int32), ids=_binary(numbers.view(np.uint8), 4 * np.concatenate([[0], np.cumsum(lengths)]))))
        return out

    def sliced(words: Words, inverse: np.ndarray, hashes: np.ndarray, first: np.ndarray, learn_from: np.ndarray) -> pa.RecordBatch | None:
        """The slices of a block. A slice's turn is a hash of its words and of its number, so equal texts give equal slices."""
        counts = np.diff(first)
        number = np.where(learn_from, np.maximum(-(-counts // SLICE), 1), 0)
        owner = np.repeat(np.arange(len(counts)), number)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        low = first[:-1][owner] + SLICE * k
        high = np.minimum(low + SLICE, first[1:][owner])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))]) if len(hashes) else np.zeros(1, np.uint64)
        turn = (mix(sums[high] - sums[low] + k.astype(np.uint64)) % np.uint64(TURNS)).astype(np.int64)
        chosen = np.flatnonzero(turn < share * TURNS)
        if not len(chosen):
            return None
        symbols, bounds = symbols_of(words, vocabulary)
        flags = (k[chosen] == 0) + 2 * (high[chosen] == first[1:][owner[chosen]])
        size = (high - low)[chosen]
        each = inverse[ragged(low[chosen], size)]
        width = np.diff(bounds)[each]
        flat = symbols[ragged(bounds[:-1][each], width)]
        cut = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        listed = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32)))
        return _gathered(len(chosen), SLICED, at=turn[chosen], n=flags, symbols=listed)

    def run(batches):
        own, now, parts = coder(tokenizer_path, words_only=True), None, []
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for block in blocks(batch.column(2)):
                chunk_of = chunks[block.first : block.first + len(block)]
                data, starts, ends, hashes, first, at, words, inverse = block_words(block, own)
                counts = np.diff(first)
                learn_from = ~batch.column(1).slice(block.first, len(block)).to_numpy(zero_copy_only=False).astype(bool)
                found = sliced(words, inverse, hashes, first, learn_from)
                if found is not None:
                    yield found
                edges = np.flatnonzero(np.diff(chunk_of)) + 1
                for i, j in zip([0, *edges], [*edges, len(block)]):
                    if chunk_of[i] != now and parts:
                        yield from merged(now, parts)
                        parts = []
                    now, some = int(chunk_of[i]), inverse[first[i] : first[j]]
                    n = np.bincount(some, np.repeat(learn_from[i:j], counts[i:j]), minlength=len(at))
                    met = np.zeros(len(at), dtype=bool)
                    met[some] = True
                    here = np.flatnonzero(met)
                    size = (ends - starts)[at[here]]
                    doc_id = batch.column(3).slice(block.first + i, j - i) if batch.num_columns > 3 else None
                    parts.append((data[ragged(starts[at[here]], size)], size, hashes[at[here]], words.take(here), n[here], (np.cumsum(met) - 1)[some], counts[i:j], doc_id, ~learn_from[i:j]))
        if parts:
            yield from merged(now, parts)

    return run


def _score(shared, totals):
    """Cogroup function: a chunk's documents with the table of its words, and the words' counts."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        one_thread()
        net: Net = shared.value
        n_all, kinds, ends_seen, leaf_n, leaf_kinds = totals
        of = docs.column("kind").combine_chunks().to_numpy()
        table, docs = docs.slice(int(np.flatnonzero(of == TABLE)[0]), 1).to_pylist()[0], docs.filter(pa.array(of == TEXT))
        words = Words(np.frombuffer(table["ids"], _id_type(net.size)).astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(table["word"], "<i4"))]))
        known = np.zeros(len(words), dtype=np.int64)
        known[counted.column("at").to_numpy()] = counted.column("c").to_numpy()
        contributions = net.contributions()
        symbols, begin = symbols_of(words, net.size)
        leaf = net.tree.at(symbols[begin[:-1]])
        inner = np.log((known + 0.5) / (leaf_n[leaf] + 0.5 * (leaf_kinds[leaf] + 1)))
        bottom = n_all + 0.5 * (kinds + 1)
        base, end_base = np.log((known + 0.5) / bottom), np.log((ends_seen + 0.5) / bottom)
        out = []
        for block in blocks(docs.column("ids").combine_chunks()):
            at, counts = block.data.view("<i4").astype(np.int64), np.diff(block.bounds) // 4
            first = block.bounds // 4
            met = np.zeros(len(words), dtype=bool)
            met[at] = True
            here = np.flatnonzero(met)
            w = windows((np.cumsum(met) - 1)[at], counts)
            spelled, head = net.word_logs(words.take(here), w, contributions=contributions)
            plain, share = (np.where(w.target >= 0, a[here][w.target] if len(here) else 0.0, b) for a, b in ((base, end_base), (inner, 0.0)))
            both = np.logaddexp(np.log(1 - WHOLE) + spelled, np.log(WHOLE) + head + share)
            bounds = np.concatenate([[0], np.cumsum(counts + 1)])
            sums = lambda x, b: np.diff(np.concatenate([[0.0], np.cumsum(x)])[b]) / np.log(10)
            seen = np.diff(np.concatenate([[0], np.cumsum(known[at] > 0)])[first]) + int(ends_seen > 0)
            out.append((counts + 1, seen, sums(plain, bounds), sums(both, bounds)))
        n_tokens, n_known, base_score, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": docs.column("n"), "held_out": docs.column("at").cast(pa.bool_()), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(n_tokens), int(n_all)), "base_score": base_score, "score": score})

    return run


def fitted(gathered: DataFrame, vocabulary: int, n_slices: int, counts: np.ndarray) -> Net:
    """Tree and weights from all slices: groups by one pass over them, then rounds in which each has its turn."""
    if not n_slices:
        return Net(vocabulary, Tree.grown(vocabulary, np.arange(vocabulary) % GROUPS, counts))
    slices = gathered.where(F.col("kind") == SLICED)
    near = _in_parts(slices.select("symbols").coalesce(-(-n_slices // (8 * TASK_SLICES))), _neighbours(vocabulary))
    table = np.concatenate([near[k][0] for k in range(PARTS)]).reshape(vocabulary, NEAR)
    net = Net(vocabulary, Tree.grown(vocabulary, _groups(table), counts))
    passes, begin = max(1.0, START / n_slices), 0
    whole = sum(MORE**k for k in range(len(ROUNDS)))
    for k, rate in enumerate(ROUNDS):
        # The rounds' turns meet without a gap; a round of more than all takes all, so many times.
        end = TURNS if k == len(ROUNDS) - 1 else begin + TURNS * MORE**k // whole
        epochs = max(1, round(passes * MORE**k / whole))
        some = slices if passes > 1 else slices.where((F.col("at") >= begin) & (F.col("at") < end))
        number = n_slices if passes > 1 else n_slices * (end - begin) / TURNS
        _averaged(net, some.select("symbols", F.col("n").alias("flags")).coalesce(max(1, int(-(-number // TASK_SLICES)))), rate, epochs)
        begin = end
    return net


def score(docs: DataFrame, held_out: Column, tokenizer_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text).

    Documents where ``held_out`` is false or null are learned from, all of them. base_score: the add-half word
    model; score: log10 of the text's probability under the attention model.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = coder(tokenizer_path, words_only=True).tokenizer.get_vocab_size()
    chunks = docs.mapInArrow(_chunked(chunk_bytes), "chunk long, doc_id long, held_out boolean, text string")
    gathered = keep(chunks.select("chunk", "held_out", "text", "doc_id").mapInArrow(_gather(tokenizer_path, vocabulary), GATHERED), "lm-gathered", compression="zstd")
    each = Window.partitionBy("word")
    words = gathered.where(F.col("kind") == WORD).select("chunk", "word", "at", "head", "n")
    words = keep(words.select("chunk", "at", "head", "n", F.sum("n").over(each).alias("c"), F.count("*").over(each).alias("rows")), "lm-words", compression="zstd")
    size = {(r["kind"], r["at"]): r["n"] for r in gathered.where(F.col("kind").isin(TEXT, SLICED, TABLE)).groupBy("kind", F.when(F.col("kind") == TEXT, F.col("at")).alias("at")).agg(F.count("*").alias("n")).collect()}
    ends_seen, n_slices = size.get((TEXT, 0), 0), size.get((SLICED, None), 0)
    # One row a symbol reaches the driver, however large the corpus.
    symbol = np.zeros(2 * vocabulary + 2)
    for r in gathered.where(F.col("kind") == COUNTED).select(F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy("x.symbols").agg(F.sum("x.counts").alias("n")).collect():
        symbol[r["symbols"]] = r["n"]
    symbol[2 * vocabulary] = ends_seen
    net = fitted(gathered, vocabulary, n_slices, symbol)
    leaf_n, leaf_kinds = np.zeros((GROUPS + 1) * LEAVES), np.zeros((GROUPS + 1) * LEAVES)
    # A word counts once, whatever its number of rows.
    for r in words.where("c > 0").groupBy("head").agg(F.sum("n").alias("n"), F.sum(1 / F.col("rows")).alias("kinds")).collect():
        at = net.tree.at(r["head"])
        leaf_n[at], leaf_kinds[at] = leaf_n[at] + r["n"], leaf_kinds[at] + round(r["kinds"])
    shared = spark.sparkContext.broadcast(net)
    totals = (float(leaf_n.sum() + ends_seen), float(leaf_kinds.sum() + (ends_seen > 0)), float(ends_seen), leaf_n, leaf_kinds)
    # Twice as many partitions as chunks, so that few hold more than one.
    number = 2 * max(1, size.get((TABLE, None), 0))
    texts = gathered.where(F.col("kind").isin(TABLE, TEXT)).select("chunk", "kind", "word", "ids", "at", "n")
    sides = [x.repartition(number, "chunk").groupBy(F.col("chunk").alias("_chunk")) for x in (texts, words.select("chunk", "at", "c"))]
    return sides[0].cogroup(sides[1]).applyInArrow(_score(shared, totals), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
