"""The prefix trie of conversations: how many share each beginning, and what sharing saves.

Conversations are sequences of turns. Their turns' digests, in rows of at most ``BLOCK`` turns, are
sorted by range partitions, so that sequences with a common beginning stand together. Each Arrow batch
of the sorted rows has an array of the turns that neighbours have in common (LCP) and a sparse table of
its range minima. Every prefix of every row is a candidate: it binary-searches, by range minima and
independently of all others, how far to its left and right the rows still begin with it. A candidate
that is its interval's first row is a node, and the interval its members; a second sparse table gives
the smallest of them. A node whose interval runs over a batch's end is found in parts, which are summed.

A row beyond a conversation's first ``BLOCK`` turns is sorted under the prefix that it continues. So no
task holds more than a batch of short rows, however long a conversation and however many copies of it
there are; places and prefixes come from running aggregates that split a long conversation.

A node belongs to its smallest member. What the nodes of a conversation sum to (childless ones; bytes
saved) is added over the members of an interval in a second search over the same rows, which gives the
sums over subtrees without walking the tree.

Turns are equal if the SHA-256 digests of role and text are (128 bits are kept); a prefix is known by 128
bits, the exclusive or of its turns' digests, each salted with its depth.

Defined results: null roles and texts are empty; rows without a conv_id belong to no conversation; turns
of equal number follow by role and text, and repeated rows are turns each; a conversation that is left
without turns counts at the root; an empty table gives no rows; other columns are ignored. A conversation
that ends where very many others do is hashed in one task, a batch at a time, since SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import running
from .scratch import keep
from .textvec import crc_bucket

#: Turns of a sorted row.
BLOCK = 64
#: Conversations that begin alike are rebuilt from the one whose number this divides; fixed by definition, like the modulus of the turns taken.
GROUP, TURNS = 5, 9


class RangeMin:
    """Minima of any range in two look-ups: level k holds the minima of 2^k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))
        self.log = np.zeros(len(values) + 1, dtype=np.int64)
        for k in range(1, len(self.levels)):
            self.log[1 << k :] = k
        width = len(values)
        self.flat = np.concatenate([np.pad(x, (0, width - len(x))) for x in self.levels]).reshape(len(self.levels), width)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of [first, last], which aren't empty."""
        k = self.log[last - first + 1]
        return np.minimum(self.flat[k, first], self.flat[k, last + 1 - (1 << k)])


def common(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many turns each sorted row has in common with the one before it; 0 for the first, and for rows that continue different prefixes. Rows are padded with -1."""
    out = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        same = (rows[1:] == rows[:-1]) & (rows[1:] >= 0) & (starts[1:] == starts[:-1]).all(axis=1)[:, None]
        out[1:] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return out


def extents(shared: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that begin with the first ``depth`` turns of each candidate's ``row``: two binary searches over range minima."""
    least = RangeMin(shared)
    a, b = np.zeros(len(row), dtype=np.int64), row.copy()
    while (open_ := a < b).any():
        mid = (a + b) // 2
        near = np.minimum(mid + 1, row)
        far = open_ & (least(near, row) >= depth)
        a, b = np.where(open_ & ~far, mid + 1, a), np.where(far, mid, b)
    left, a, b = a, row.copy(), np.full(len(row), len(shared) - 1)
    while (open_ := a < b).any():
        mid = (a + b + 1) // 2
        near = np.minimum(row + 1, mid)
        far = open_ & (least(near, np.maximum(mid, near)) >= depth)
        a, b = np.where(far, mid, a), np.where(open_ & ~far, mid - 1, b)
    return left, a


_FOUND = "x long, y long, depth long, px long, py long, n long, conv_id long, bytes long, leaves long, saved long"


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, before, sx, sy, turns, xs, ys, sizes, leaves, saved) to the parts of nodes in each batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        number = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        listed = lambda name: batch.column(batch.schema.get_field_index(name)).flatten()
        size = batch.column(batch.schema.get_field_index("turns")).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        turns = np.frombuffer(b"".join(listed("turns").to_pylist()), dtype="V16")
        code = np.unique(turns.view([("a", "<u8"), ("b", "<u8")]), return_inverse=True)[1].ravel()
        row = np.repeat(np.arange(n), size)
        first = np.cumsum(size) - size
        depth = np.arange(len(row)) - first[row] + 1
        table = np.full((n, BLOCK), -1, dtype=np.int64)
        table[row, depth - 1] = code
        starts = np.stack([number("sx"), number("sy")], axis=1)
        left, right = extents(common(table, starts), row, depth)
        at = np.flatnonzero(left == row)
        left, right = left[at], right[at]
        own = RangeMin(number("conv_id"))
        xs, ys = listed("xs").to_numpy(zero_copy_only=False), listed("ys").to_numpy(zero_copy_only=False)
        top = depth[at] == 1
        above = np.maximum(at - 1, 0)
        sums = [np.concatenate([[0], np.cumsum(number(name))]) for name in ("leaves", "saved")]
        columns = [xs[at], ys[at], depth[at] + number("before")[left], np.where(top, starts[left, 0], xs[above]), np.where(top, starts[left, 1], ys[above]), right - left + 1, own(left, right), listed("sizes").to_numpy(zero_copy_only=False)[at], *(s[right + 1] - s[left] for s in sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=[f.split()[0] for f in _FOUND.split(", ")])


def _nodes(rows: DataFrame) -> DataFrame:
    """The nodes below the root of rows with ``leaves`` and ``saved``."""
    order = ["sx", "sy", "turns", "conv_id"]
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_intervals, _FOUND)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved")]
    return found.groupBy("x", "y", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.min("px").alias("px"), F.min("py").alias("py"), *sums)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, conv_id), sorted, to a digest of each node's conversations; a node may go on over batches."""
    node, state = None, None
    for batch in batches:
        out = []
        for x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (x, y) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (x, y), hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        yield _digest_rows(out)
    if state is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])


def _lane(column, k: int):
    """The k-th 64 bits of a hexadecimal digest as a long."""
    return F.conv(F.substring(column, 16 * k + 1, 16), 16, -10).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of every rebuilt conversation's turns, and all conv_ids with the turns that each takes from its group's first.

    Conversation c takes the first h turns of conversation c - c % GROUP, h being crc32(c) % TURNS, and then its own after its first h.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "bytes": F.octet_length("text").cast("long")})
    own = running(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], {"place": (F.sum, F.lit(1).cast("long"))}).select("conv_id", "place", "digest", "bytes")
    own = keep(own.withColumn("h", F.pmod(crc_bucket(F.col("conv_id")), F.lit(TURNS))), "places")
    convs = own.groupBy("conv_id").agg(F.first("h").alias("h")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    first = own.where((F.col("place") < TURNS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    head = convs.join(first, "base").where(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    taken = keep(convs.join(head.groupBy("conv_id").agg(F.count("*").alias("taken")), "conv_id", "left").select("conv_id", F.coalesce("taken", F.lit(0)).alias("taken")), "conversations")
    tail = own.where(F.col("place") > F.col("h")).join(taken, "conv_id").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return head.union(tail), taken


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv_id, turn, role, text), rebuilt: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns)
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    rows = rows.withColumns({"a": _lane(salted, 0), "b": _lane(salted, 1), "turn": F.unhex(F.substring("digest", 1, 32))}).drop("digest")
    rows = keep(running(rows, "conv_id", [F.col("depth")], {"x": (F.bit_xor, F.col("a")), "y": (F.bit_xor, F.col("b"))}), "prefixes")
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    cells = F.sort_array(F.collect_list(F.struct("depth", "turn", "x", "y", "bytes", "a", "b")))
    blocks = rows.groupBy("conv_id", (block * BLOCK).alias("before")).agg(cells.alias("c"))
    start = lambda lane, salt: F.element_at("c", 1)[lane].bitwiseXOR(F.element_at("c", 1)[salt])
    sorted_ = keep(blocks.select("conv_id", "before", start("x", "a").alias("sx"), start("y", "b").alias("sy"), F.col("c.turn").alias("turns"), F.col("c.x").alias("xs"), F.col("c.y").alias("ys"), F.col("c.bytes").alias("sizes")), "sequences")

    zero = F.lit(0).cast("long")
    found = keep(_nodes(sorted_.withColumns({"leaves": zero, "saved": zero})).drop("leaves", "saved"), "nodes")
    children = found.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    valued = found.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    valued = keep(valued.withColumns({"own_leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "own_saved": (F.col("n") - 1) * F.col("bytes")}), "valued")
    # What a conversation's own nodes sum to, all of them and from each depth on.
    totals = keep(valued.groupBy("conv_id").agg(F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved")), "totals")
    below = running(valued, "conv_id", [F.desc("depth")], {"from_leaves": (F.sum, F.col("own_leaf")), "from_saved": (F.sum, F.col("own_saved"))})
    weighed = sorted_.join(totals, "conv_id", "left").fillna(0, ["leaves", "saved"])
    members = _nodes(weighed).select("x", "y", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    below = below.join(totals, "conv_id").join(members, ["x", "y"])
    below = below.select("x", "y", "depth", "px", "py", "conv_id", "n", "n_children", *((F.col(f"all_{c}") - F.col(c) + F.col(f"from_{c}")).alias(c) for c in ("leaves", "saved")))

    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    whole = valued.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.coalesce(F.sum("own_leaf"), zero), F.lit(1).cast("long")).alias("leaves"), F.coalesce(F.sum("own_saved"), zero).alias("saved"))
    nothing = F.lit(None).cast("long")
    root = root.crossJoin(whole).select(zero.alias("x"), zero.alias("y"), zero.alias("depth"), nothing.alias("px"), nothing.alias("py"), "conv_id", "n", "n_children", "leaves", "saved")
    nodes = keep(below.union(root), "trie")

    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("x", "y"), "depth").alias("l"))
    ends = convs.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("l.x", zero).alias("x"), F.coalesce("l.y", zero).alias("y"), "conv_id")
    ends = ends.repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_digests, "x long, y long, ends_sha256 string")
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(ends, ["x", "y"], "left").join(parents, ["px", "py"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
