"""Best-fit packing with certified bounds (operator 5).

Every document becomes its ids plus an end id; only documents longer than a sequence are cut.  Pieces are dealt to
partitions of about ``PART`` pieces and packed best-fit decreasing.  Dual feasible functions give a lower bound of each
partition's sequences.  A partition whose count meets its bound is certified and gives up its roomiest sequence only
(the one that rounding up left open); a partition with a gap gives up every sequence that leaves more than ``LOOSE`` of
its room.  What is given up is dealt out anew, so partitions exchange documents, and packed again, over fewer and
fewer partitions, until the sequences of a round meet the bound of all their ids or ``ROUNDS`` are over; ``gap`` tells how
many sequences a packing has over the bound of all pieces together.

Null text is empty (the end id alone).  Repeated doc_ids are rows of their own: ``piece`` counts within a row.  An
empty table gives no pieces.  Packing sees lengths and a row number only; texts are read once and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import slices, stored, table, whole_texts
from netspark.llm.tokens import shared_encoder

CAPACITY, PART, ROUNDS, LOOSE = 4096, 50_000, 6, 0.002

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, without its ids: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = shared_encoder(path, True), np.uint32(end_id).tobytes()
        for b in slices(batches, 64):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield table(_PIECE, *zip(*rows))
        enc.rest()

    return whole_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and what each bin holds.  The open bin with the least sufficient room is found
    as the lowest set bit of a bitmap over room sizes."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if room > n:
            if not by_room[room - n]:
                rooms |= 1 << room - n
            by_room[room - n].append(b)
    return bins, offsets, np.array(filled, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions over the histogram of lengths."""
    return histogram_bound(*np.unique(lengths, return_counts=True), capacity) if len(lengths) else 0


def histogram_bound(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    best = -(-int((size * count).sum()) // capacity)
    # large ones fill a bin, small ones vanish
    for eps in size[2 * size <= capacity]:
        value = np.where(size > capacity - eps, capacity, np.where(size < eps, 0, size))
        best = max(best, -(-int((value * count).sum()) // capacity))
    # rounding to multiples of 1/k
    for k in range(1, 33):
        whole = size * (k + 1) % capacity == 0
        scaled = np.where(whole, size * k, size * (k + 1) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((scaled * count).sum()) // (k * capacity)))
    return best


_PUT = pa.schema([("row", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("room", pa.int64()), ("certified", pa.bool_()), ("gives", pa.bool_())])


def _round(items: DataFrame, parts: int, number: int, capacity: int, loose: float) -> DataFrame:
    def pack(group: pa.Table) -> pa.Table:
        part, lengths = group["part"][0].as_py(), group["length"].to_numpy()
        order = np.argsort(group["row"].to_numpy(), kind="stable")  # the same whatever order rows arrive in
        bins, offsets, filled = best_fit_decreasing(lengths[order], capacity)
        room = capacity - filled
        met = len(filled) == lower_bound(lengths, capacity)
        gives = (np.arange(len(filled)) == np.argmax(room)) & (room > 0) if met else room > loose * capacity
        ids = bins + (number << 56) + (part << 32)
        put = [group["row"].to_numpy()[order], lengths[order], ids, offsets, room[bins], np.full(len(lengths), met), gives[bins]]
        return pa.Table.from_batches([table(_PUT, *put)])

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)).cast("long").alias("part"))
    schema = "row long, length long, sequence_id long, offset long, room long, certified boolean, gives boolean"
    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS, loose: float = LOOSE) -> DataFrame:
    """``items`` (row, length) with sequence_id and offset; ``certified``: the partition met its bound."""
    done, todo, before = [], items, None
    for number in range(rounds):
        parts = max(1, -(-todo.count() // part))
        put = stored(_round(todo, parts, number, capacity, loose), f"packed-{number}")
        one = put.where("offset = 0")  # a row a sequence
        bins, held, met = one.agg(F.count("*"), F.sum(capacity - F.col("room")), F.min("certified")).first()
        if not bins:
            break
        # nothing is to gain where the sequences of this round meet the bound of all their ids together
        if bins == -(-held // capacity) or bins == before or number == rounds - 1 or (parts == 1 and met):
            done.append(put)
            break
        before = bins if parts == 1 else None
        done.append(put.where("not gives"))
        todo = put.where("gives")
    out = done[0] if done else put
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("row", "sequence_id", "offset", "certified")


def gap(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a packing (length, sequence_id, offset) and the lower bound of all its pieces together."""
    sizes = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("starts")).collect()  # capacity rows
    if not sizes:
        return 0, 0
    size, count, starts = (np.array(x, np.int64) for x in zip(*sorted(map(tuple, sizes))))
    return int(starts.sum()), histogram_bound(size, count, capacity)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Columns of ``docs`` other than ``doc_id`` and ``text`` are not read.
    """
    made = stored(pieces(docs, path, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return made.join(pack(made.select("row", "length"), capacity, part), "row").drop("row")
