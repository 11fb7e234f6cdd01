"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

The longest pieces go first, each into the open sequence with the least room that still holds it; a segment
tree over remaining capacities finds that room in logarithmic time. What decides is only how many pieces of
each length there are, at most CAPACITY numbers for any corpus, so the driver packs the whole corpus's
histogram and places equal pieces in runs: the result is that of one piece after another over all documents.
The pieces then look up their places by their position in the global order (length, doc_id, piece), which a
range-partitioned running count gives. Neither a length that a third of all pieces share nor any group meets
in one task.

Defined cases: a null text is the empty text, a piece of the end id alone; texts over the capacity are cut
into pieces of the capacity, the last one shorter; rows that repeat are packed separately; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column_batches, only, running_total, staged
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1


class RoomTree:
    """Segment tree over the capacities 0..top: which have an open sequence."""

    def __init__(self, top: int) -> None:
        self.width = 1 << top.bit_length()
        self.open = [False] * (2 * self.width)

    def set(self, room: int, is_open: bool) -> None:
        k = room + self.width
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, need: int) -> int:
        """The smallest open capacity of at least need, or -1."""
        k = need + self.width
        if self.open[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return -1


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Pack counts[length] pieces of each length. Gives runs in the order of falling length and the number of sequences.

    A run (first, length, sequence, each, offset) places the pieces from the global position first on: each of
    them a sequence, from the given sequence and offset on.
    """
    tree, groups = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    runs, position, sequences = [], 0, 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups[room].append((first, n))
            tree.set(room, True)

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = groups[room].pop()
                tree.set(room, bool(groups[room]))
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            runs.append((position, length, first, each, capacity - room))
            position += full * each + rest
            left -= full * each + rest
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def best_fit(items: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset; order makes the placing of equal lengths deterministic."""
    keyed = items.withColumn("_neg", -F.col(length)).withColumn("_one", F.lit(1).cast("long"))
    placed = running_total(keyed, ["_neg", *order], "_one", "_pos", "order")
    counts = {r[0]: r["count"] for r in placed.groupBy(length).count().collect()}  # at most capacity rows
    runs, _ = best_fit_runs(counts, capacity)
    kept = items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(b: pa.RecordBatch):
        at = b.column(b.schema.get_field_index("_pos")).to_numpy()
        r = runs[np.searchsorted(runs[:, 0], at, side="right") - 1]
        k = at - r[:, 0]
        yield [*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(r[:, 2] + k // r[:, 3]), pa.array(r[:, 4] + k % r[:, 3] * r[:, 1])]

    return arrow_map(placed.select(*kept, "_pos"), place, schema)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32 and, where asked for, the ids themselves."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(b: pa.RecordBatch):
        enc = encoder(path)
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for lo, hi in column_batches(texts, 4_000_000):
            out: list[list] = [[] for _ in fields]
            flat, cuts = enc.encode(texts.slice(lo, hi - lo), end_id)
            raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
            for doc_id, first, last in zip(ids[lo:hi], cuts.tolist(), cuts[1:].tolist()):
                for k, at in enumerate(range(first, last, capacity)):
                    piece = raw[4 * at : 4 * min(at + capacity, last)]
                    for col, x in zip(out, (doc_id, k, at - first, len(piece) // 4, zlib.crc32(piece), piece)):
                        col.append(x)
            if with_ids:
                out[-1] = list(map(bytes, out[-1]))
            yield out

    return arrow_map(only(docs, doc_id="long", text="string"), run, T.StructType(fields))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = staged(token_pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces")
    return best_fit(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit), from pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most capacity ids
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
