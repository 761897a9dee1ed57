"""Token-ID output: shards of concatenated ids with Elias-Fano document boundaries (operator 1).

A shard holds documents in ascending ``doc_id`` order: their ids one after another (two bytes each where the vocabulary
allows it, else four), and the ends of the documents as an Elias-Fano sequence: the low ``l`` bits of each end in a
packed array, the high bits in unary, in about ``2 + log2(ids / documents)`` bits a document.  ``select(i)`` finds the
i-th one bit through a sampled directory that is stored with the bits, which gives any document's place without a table
of 64-bit offsets.  The shard's doc_ids, which ascend, are an Elias-Fano sequence of their distances from the first.

Documents are range-partitioned by ``doc_id`` (equal ids: by text), so shards in the order of their numbers concatenate
to the whole sequence; shards are rows of a Parquet table in the shared folder.  Null text is empty and is the end id
alone; null doc_ids come first; repeated doc_ids stay rows of their own, in the order of their text's hash.  An empty
table gives no shards; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.common import slices, stored, table, whole_texts
from netspark.llm.tokens import shared_encoder

SHARD_IDS, SAMPLE, BROADCAST_SHARDS = 4 << 20, 256, 1_000_000


class EliasFano:
    """A non-decreasing sequence of ``n`` numbers, with a directory of every SAMPLE-th one bit."""

    HEAD = struct.Struct("<4sQQQB")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, byte_of: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.byte_of, self.before = n, low_bits, low, high, byte_of, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        marks = np.zeros((top >> low_bits) + n + 1, np.uint8)
        marks[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little")
        counts = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        byte_of = np.searchsorted(counts, np.arange(1, n + 1, SAMPLE))
        before = np.where(byte_of > 0, counts[byte_of - 1], 0)
        return cls(n, low_bits, low, high, byte_of.astype("<u4"), before.astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number."""
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``, side by side: the directory gives the byte to start at, popcounts lead on."""
        at, rank = self.byte_of[i // SAMPLE].astype(np.int64), self.before[i // SAMPLE].astype(np.int64)
        walk = np.arange(len(i))
        while len(walk):
            ones = np.bitwise_count(self.high[at[walk]])
            walk, ones = walk[short := rank[walk] + ones <= i[walk]], ones[short]
            rank[walk] += ones
            at[walk] += 1
        bits = np.unpackbits(self.high[at][:, None], axis=1, bitorder="little")
        pos = (np.cumsum(bits, axis=1) == (i - rank + 1)[:, None]).argmax(1)
        high = (8 * at + pos - i).astype(np.uint64) << np.uint64(self.low_bits)
        place = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)
        return high | np.bitwise_or.reduce(low, axis=1, initial=np.uint64(0))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(b"EF02", self.n, len(self.low), len(self.byte_of), self.low_bits)
        return b"".join([head, self.byte_of.tobytes(), self.before.tobytes(), self.low.tobytes(), self.high.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        magic, n, size, samples, low_bits = cls.HEAD.unpack_from(raw)
        if magic != b"EF02":
            raise ValueError("not an Elias-Fano sequence")
        at = cls.HEAD.size
        byte_of, before = (np.frombuffer(raw, "<u4", samples, at + 4 * k * samples) for k in (0, 1))
        body = np.frombuffer(raw, np.uint8, offset=at + 8 * samples)
        return cls(n, low_bits, body[:size], body[size:], byte_of, before)


def code_ids(ids: list[int | None]) -> tuple[int, int, bytes]:
    """Ascending ids, nulls first: how many nulls, the first id, the distances from it."""
    known = [x for x in ids if x is not None]
    base = known[0] if known else 0
    return len(ids) - len(known), base, EliasFano.of(np.array([x - base for x in known], np.uint64)).to_bytes()


def ids_at(nulls: int, base: int, coded: bytes, i: np.ndarray) -> list[int | None]:
    """The ids at ascending places ``i``."""
    some = i[i >= nulls] - nulls
    return [None] * (len(i) - len(some)) + [base + x for x in EliasFano.from_bytes(coded).select_many(some).tolist()]


_SHARD = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int8())]
    + [("null_ids", pa.int64()), ("first_id", pa.int64()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())]
)


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """Encodes and stores ``docs``; the table of shards.  Without a ``folder`` they last as long as the application."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = shared_encoder(path), TaskContext.get().partitionId(), 0
        wide = enc.tok.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        kind, end = ("<u4" if wide else "<u2"), np.uint32(end_id).tobytes()
        names: list = []
        sizes: list[int] = []
        packed: list[bytes] = []

        def shut() -> pa.RecordBatch:
            ends = np.cumsum(np.array(sizes, np.int64))
            nulls, base, coded = code_ids(names)
            row = part, shard, len(names), int(ends[-1]), np.dtype(kind).itemsize, nulls, base, coded, EliasFano.of(ends).to_bytes(), b"".join(packed)
            return table(_SHARD, *([x] for x in row))

        for b in slices(batches, 64):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist())):
                ids = np.frombuffer(ids + end, "<u4")
                names.append(doc)
                sizes.append(len(ids))
                packed.append(ids.astype(kind).tobytes())
            if sum(sizes) >= shard_ids:
                yield shut()
                names, sizes, packed, shard = [], [], [], shard + 1
        if names:
            yield shut()
        enc.rest()

    texts = whole_texts(docs).withColumn("h", F.xxhash64("text"))
    parts = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    shards = parts.mapInArrow(encode, "part int, shard int, n_docs long, n_ids long, id_bytes byte, null_ids long, first_id long, doc_ids binary, ends binary, ids binary")
    if folder is None:
        return stored(shards, "token-shards")
    shards.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(shards.schema).parquet(folder)


_PLACE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_places(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards: doc_id, start, n_tokens, ids_crc32; ends and doc_ids come through select.

    The first id of each shard is a running sum over the parts (one row a task of the writer) and then over a part's
    shards (4 million ids each).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = {k: v[0] for k, v in b.to_pydict().items()}
            ids, ends, n = np.frombuffer(row["ids"], f"<u{row['id_bytes']}"), EliasFano.from_bytes(row["ends"]), row["n_docs"]
            at = 0
            for k in range(0, n, 4096):
                i = np.arange(k, min(n, k + 4096))
                z = ends.select_many(i).astype(np.int64)
                a = np.concatenate([[at], z[:-1]])
                crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(a.tolist(), z.tolist())]
                yield table(_PLACE, ids_at(row["null_ids"], row["first_id"], row["doc_ids"], i), a + row["first"], z - a, crc)
                at = int(z[-1])

    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("shard")
    first = shards.select("part", "shard", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inside")).join(before, "part")
    first = first.select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))
    if shards.count() <= BROADCAST_SHARDS:  # 24 bytes a shard: 24 MB at most; beyond it the join shuffles
        first = F.broadcast(first)
    columns = ["n_docs", "id_bytes", "null_ids", "first_id", "doc_ids", "ends", "ids"]
    return (
        shards.select("part", "shard", *columns)
        .join(first, ["part", "shard"])
        .select(*columns, "first")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_document(shard: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard row, through two selects."""
    ends = EliasFano.from_bytes(shard["ends"])
    a, z = ends.select(i - 1) if i else 0, ends.select(i)
    return np.frombuffer(shard["ids"], f"<u{shard['id_bytes']}")[a:z]
