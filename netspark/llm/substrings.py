"""Removal of long repeated substrings by a logarithmic family of sampled suffix arrays (operator 2).

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

Sampling.  Of the 32-byte grams in each window of ``length`` bytes the one with the least hash (the leftmost on ties)
is the window's *anchor*; equal windows have equal anchors at equal places, so comparing suffixes at anchors loses no
match.  Consecutive windows with one anchor form a *run*, about one in ``length / 2`` bytes.  A batch's suffix array
holds one entry a run, ordered by anchor gram and then by the BLAKE2b digest (128 bits) of all the run's bytes.

Runs that repeat inside a stretch of one text are settled there: one of them goes on as an entry that stands twice, of the
others only the merged intervals of their windows.  So periodic text, which has a run a byte, gives an entry for each
byte of its period and one interval.

Family.  Each new batch gets its suffix array; while a level of the same rank exists the two are merge-scanned into one
of the next rank, equal entries falling together with their counts.  The remaining levels are scanned against each
other at the end.  An entry that occurs twice settles all windows of its runs.  A family can be stored, opened again and
given further batches; ``known`` tells which entries of a batch the levels hold already.

Rims.  Where a repeated passage begins or ends inside a run, the run shares its anchor with others but not all its
bytes.  One run of each different entry then sends its bytes, keyed by the half of the window around the anchor that
every one of its windows must hold, and the members of a key compare their windows, byte by byte where their rolling
hashes agree.  Keys with very many members compare digests of their windows by a distributed count instead.  No pair of
documents is ever enumerated.

Matches never cross documents.  Null text is empty; rows that repeat a doc_id and text are copies of each other; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm.common import passing, shared_dir, slices, stored, table, whole_texts

LENGTH, GRAM, CHUNK, BATCHES, HOT = 400, 32, 1 << 18, 4, 20_000

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _grams(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded.data, 0, (1,)).astype(np.uint64)


def _sums(x: np.ndarray) -> list[np.ndarray]:
    """Prefix sums of two polynomial hashes over the eight-byte grams."""
    out = []
    for odd, base in ((_ODD[0], 0x5851F42D4C957F2D), (_ODD[1], 0x2545F4914F6CDD1D)):
        v = x * odd
        v ^= v >> _U(31)
        out.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * _powers(base, 1 << 20)[: len(v)])]))
    return out


@lru_cache(1)
def _inverse(n: int = 1 << 20) -> list[np.ndarray]:
    return [_powers(pow(b, -1, 1 << 64), n) for b in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]


def _hash(sums: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Two fingerprints of each [a, b) of at least eight bytes, wherever it stands."""
    return [(s[b - 7] - s[a]) * inv[a] for s, inv in zip(sums, _inverse())]


def _digests(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each [a, b) as two numbers."""
    raw = memoryview(np.ascontiguousarray(buf))
    both = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist()))
    pair = np.frombuffer(both, "<u8").reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def runs_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of the texts [starts, ends) of ``buf``: text number, first and last window, anchor, gram, fingerprints."""
    n, grams = len(buf), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length or not ((ends - starts) >= length).any():
        return dict.fromkeys(("text", "first", "last", "anchor", "gram", "u1", "u2"), none)
    x = _grams(buf)
    m = n - GRAM + 1
    g = x[:m] * _ODD[0] + x[8 : 8 + m] * _ODD[1] + x[16 : 16 + m] * _ODD[2] + x[24 : 24 + m] * _ODD[3]
    g ^= g >> _U(32)
    g *= _ODD[4]
    g ^= g >> _U(29)
    least = g & _U(0xFFFFFFFF00000000) | np.arange(m, dtype=np.uint64)
    wide = 1
    while 2 * wide <= grams:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < grams:
        least = np.minimum(least[: len(least) - (grams - wide)], least[grams - wide :])
    step = np.zeros(n + 1, np.int64)
    long = (ends - starts) >= length
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[: len(least)])
    anchor = (least[at] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = at[np.concatenate([[0], new])]
    last = at[np.concatenate([new - 1, [len(at) - 1]])]
    anchor = anchor[np.concatenate([[0], new])]
    u1, u2 = _digests(buf, first, last + length)
    return {"text": np.searchsorted(starts, first, "right") - 1, "first": first, "last": last, "anchor": anchor, "gram": g[anchor], "u1": u1, "u2": u2}


def settled(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Of runs as from ``runs_of``: which go on, how often each stands here (2 means more), and (text, first, last) of
    the merged windows of the others, which repeat one that goes on."""
    n = len(r["first"])
    order = np.lexsort((np.arange(n), r["u2"], r["u1"], r["gram"], r["text"]))
    same = np.zeros(n, bool)
    if n:
        same[1:] = np.logical_and.reduce([r[c][order][1:] == r[c][order][:-1] for c in ("text", "gram", "u1", "u2")])
    stays = np.sort(order[~same])
    times = np.ones(n, np.int64)
    times[order[:-1][same[1:] & ~same[:-1]]] = 2  # the first of several
    out: list[list[int]] = []
    for i in np.sort(order[same]).tolist():
        t, a, z = int(r["text"][i]), int(r["first"][i]), int(r["last"][i])
        if out and out[-1][0] == t and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([t, a, z])
    return stays, times[stays], [tuple(x) for x in out]


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, or overlapping stretches of long ones, in chunks of bounded size: numbers, offsets, bytes."""
    number, offset, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[a : a + CHUNK + length - 1]
            if size and size + len(part) > CHUNK + length:
                yield number, offset, held
                number, offset, held, size = [], [], [], 0
            number.append(i)
            offset.append(a)
            held.append(part)
            size += len(part)
    if held:
        yield number, offset, held


_RUN = pa.schema([(c, pa.int64()) for c in ("doc_id", "hash")] + [(c, pa.int32()) for c in ("first", "last", "anchor")] + [(c, pa.int64()) for c in ("gram", "u1", "u2")] + [("times", pa.int8())])


def runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Entries of every text, with their places and how often they stand there (``times``: 1, or 2 for more).

    Rows with 0 times are no entries but windows ``first`` to ``last`` that repeat others of the same text.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            for number, offset, held in _chunks([t.encode() for t in b.column(1).to_pylist()], length):
                sizes = np.array(list(map(len, held)))
                starts = np.cumsum(sizes) - sizes
                r = runs_of(np.frombuffer(b"".join(held), np.uint8), starts, starts + sizes, length)
                stays, times, again = settled(r)
                move = np.array(offset) - starts
                rows = [number[k] for k in r["text"][stays].tolist()]
                places = [r[c][stays] + move[r["text"][stays]] for c in ("first", "last", "anchor")]
                yield table(_RUN, [ids[k] for k in rows], [hashes[k] for k in rows], *places, *(r[c][stays].view(np.int64) for c in ("gram", "u1", "u2")), times)
                if again:
                    rows, none = [number[t] for t, _, _ in again], [None] * len(again)
                    firsts, lasts = [a + int(move[t]) for t, a, _ in again], [z + int(move[t]) for t, _, z in again]
                    yield table(_RUN, [ids[k] for k in rows], [hashes[k] for k in rows], firsts, lasts, none, none, none, none, [0] * len(again))

    return texts.mapInArrow(make, "doc_id long, hash long, first int, last int, anchor int, gram long, u1 long, u2 long, times byte")


ENTRY = ("gram", "u1", "u2")


class SuffixFamily:
    """Levels of ranks 0, 1, 2 ...: a level of rank r stands for 2 ** r batches, ordered by ``ENTRY``.

    ``folder`` keeps the levels beyond the application, one Parquet table each and a table ``levels`` that lists them.
    """

    def __init__(self, folder: str | None = None) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.folder = folder
        self.paths: dict[int, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SuffixFamily:
        family = cls(folder)
        for r in spark.read.parquet(f"{folder}/levels").collect():  # a row a level
            family.paths[r.rank], family.levels[r.rank] = r.path, spark.read.parquet(f"{folder}/{r.path}")
        return family

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy(*ENTRY).agg(F.sum("n").alias("n"), F.min("one").alias("one"))

    @staticmethod
    def array(batch: DataFrame) -> DataFrame:
        """The suffix array of rows of ``runs``: gram, u1, u2, n (how often), one (a run that has it)."""
        place = F.xxhash64("doc_id", "hash", "first")  # names one run of each entry
        return batch.where("times > 0").groupBy(*ENTRY).agg(F.sum("times").cast("long").alias("n"), F.min(place).alias("one"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows of ``runs``.  Makes its suffix array and merges levels of equal rank."""
        level, rank = self.array(batch), 0
        while rank in self.levels:
            level = self._merge(self.levels.pop(rank), level)
            self.paths.pop(rank, None)
            rank += 1
        level = level.sortWithinPartitions(*ENTRY)
        if self.folder is None:
            self.levels[rank] = stored(level, f"suffix-level-{rank}")
            return
        spark, path = batch.sparkSession, f"level-{rank}-{uuid.uuid4().hex}"
        level.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
        self.paths[rank], self.levels[rank] = path, spark.read.schema(level.schema).parquet(f"{self.folder}/{path}")
        listed = spark.createDataFrame(sorted(self.paths.items()), "rank int, path string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/levels")

    def known(self, batch: DataFrame) -> DataFrame:
        """Entries of a new batch that some level holds, without adding them."""
        held = self.entries()
        return self.array(batch).limit(0) if held is None else self.array(batch).join(held.select(*ENTRY), list(ENTRY), "left_semi")

    def entries(self) -> DataFrame | None:
        """All levels scanned against each other: gram, u1, u2, n (how often), one (a run that has it)."""
        out = None
        for rank in sorted(self.levels):
            out = self.levels[rank] if out is None else self._merge(out, self.levels[rank])
        return out


def matches(made: DataFrame, entries: DataFrame) -> DataFrame:
    """Runs that may be repeated: their place, ``full`` (every window is) and ``send`` (bytes are to be compared)."""
    several = entries.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram", F.lit(True).alias("several"))
    known = entries.join(several, "gram", "left").where("n > 1 or several").withColumn("several", F.coalesce("several", F.lit(False)))
    place = F.xxhash64("doc_id", "hash", "first")
    found = made.where("times > 0").join(known, list(ENTRY)).select(
        "doc_id", "hash", "first", "last", "anchor", "gram", (F.col("n") > 1).alias("full"), (F.col("several") & (F.col("one") == place)).alias("send")
    )
    again = made.where("times = 0").select("doc_id", "hash", "first", "last", "anchor", "gram", F.lit(True).alias("full"), F.lit(False).alias("send"))
    return found.unionByName(again)


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed stretches [a, b) of windows that start in the given closed intervals."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def without(text: bytes, stretches: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in stretches:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_SPOT = [("doc_id", pa.int64()), ("hash", pa.int64())]
_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_PART = pa.struct([("key", pa.int64()), ("first", pa.int32()), ("own", pa.bool_()), ("bytes", pa.binary())])
_STATE_DDL = "doc_id long, hash long, text binary, starts array<struct<a:int,b:int>>, parts array<struct<key:long,first:int,own:boolean,bytes:binary>>"


class Finish(NamedTuple):
    """What becomes of a text once its removed stretches are known: a function of both, and the columns it gives."""

    of: Callable[[bytes, list[tuple[int, int]]], dict]
    columns: pa.StructType
    ddl: str


def _settle(marked: DataFrame, length: int, finish: Finish) -> DataFrame:
    """Texts that wait for an answer, with their settled windows; the result (``done``) of all others; the bytes that
    unsettled runs send."""
    half = (length + GRAM) // 2
    schema = pa.schema([*_SPOT, ("text", pa.binary()), ("starts", _PAIRS), ("parts", pa.list_(_PART)), ("done", finish.columns)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in slices(batches, 128):
            ids, texts, hashes, marks = (b.column(i) for i in range(4))
            out = []
            for t, found in zip(texts.to_pylist(), marks.to_pylist()):
                raw, starts, parts, waits = t.encode(), [], [], False
                for m in found or ():
                    i, j, p = m["first"], m["last"], m["anchor"]
                    if m["full"]:
                        starts.append((i, j))
                    else:
                        waits = True
                    if m["send"]:
                        edge = p - (length - half)  # windows from here on hold the half after the anchor
                        for lo, hi, a in ((max(i, edge), j, p), (i, min(j, edge - 1), edge)):
                            if lo <= hi:
                                key = xxh64_intdigest(raw[a : a + half], m["gram"] & (1 << 64) - 1) - (1 << 63)
                                parts.append({"key": key, "first": lo, "own": not m["full"], "bytes": raw[lo : hi + length]})
                if waits:
                    out.append((raw, [{"a": a, "b": z} for a, z in starts], parts, None))
                else:
                    out.append((None, [], parts, finish.of(raw, covered(starts, length))))
            yield table(schema, ids, hashes, *zip(*out))

    return marked.mapInArrow(make, f"{_STATE_DDL}, done struct<{finish.ddl}>")


def _windows(firsts: list[int], parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, start and fingerprints (two columns) of every window of the parts."""
    sizes = np.array(list(map(len, parts)))
    starts = np.cumsum(sizes) - sizes
    part, at, prints = [], [], []
    cut = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, int(sizes.sum()) + CHUNK, CHUNK)) + 1
    a = 0
    for z in [*cut.tolist(), len(parts)]:
        z = min(z, len(parts))
        if a >= z:
            continue
        n = sizes[a:z] - length + 1
        which = np.repeat(np.arange(a, z), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = starts[which] - starts[a] + k
        sums = _sums(_grams(np.frombuffer(b"".join(parts[a:z]), np.uint8)))
        prints.append(np.stack(_hash(sums, place, place + length), 1))
        part.append(which)
        at.append(np.array(firsts)[which] + k)
        a = z
    return np.concatenate(part), np.concatenate(at), np.concatenate(prints)


def _intervals(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one part as closed intervals."""
    if not len(part):
        return part, at, at
    new = np.flatnonzero((part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(part) - 1]])
    return part[first], at[first], at[last]


_STARTS = pa.schema([*_SPOT, ("a", pa.int32()), ("b", pa.int32())])
_WINDOW = pa.schema([*_SPOT, ("start", pa.int32()), ("own", pa.bool_()), ("w1", pa.int64()), ("w2", pa.int64())])


def _compare(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the parts of each key; a key's parts stand together."""

    def settle(rows: dict) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.array(rows["key"]), return_counts=True)
        pick = [i for i, k in enumerate(rows["key"]) if counts[np.searchsorted(keys, k)] > 1]
        if not pick:
            return
        part, at, prints = _windows([rows["first"][i] for i in pick], [rows["bytes"][i] for i in pick], length)
        # a window counts with its key: the same bytes under another key are another part's business
        group = np.searchsorted(keys, np.array(rows["key"])[pick])[part]
        order = np.lexsort((prints[:, 1], prints[:, 0], group))
        same = (prints[order][1:] == prints[order][:-1]).all(1) & (group[order][1:] == group[order][:-1])
        bodies, firsts = [rows["bytes"][i] for i in pick], [rows["first"][i] for i in pick]
        for k in np.flatnonzero(same).tolist():  # rolling hashes may collide: bytes decide
            (p, i), (q, j) = ((int(part[x]), int(at[x])) for x in (order[k], order[k + 1]))
            i, j = i - firsts[p], j - firsts[q]
            same[k] = bodies[p][i : i + length] == bodies[q][j : j + length]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        twice &= np.array([rows["own"][i] for i in pick])[part]
        p, a, b = _intervals(part[twice], at[twice])
        rows_of = [pick[i] for i in p.tolist()]
        yield table(_STARTS, [rows["doc_id"][i] for i in rows_of], [rows["hash"][i] for i in rows_of], a, b)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in slices(batches, 4096):
            for k, v in b.to_pydict().items():
                held.setdefault(k, []).extend(v)
            last = held["key"][-1] if held["key"] else None
            whole = len(held["key"])
            while whole and held["key"][whole - 1] == last:  # the last key may go on
                whole -= 1
            if whole:
                yield from settle({k: v[:whole] for k, v in held.items()})
                held = {k: v[whole:] for k, v in held.items()}
        if held.get("key"):
            yield from settle(held)

    dealt = parts.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "doc_id", "hash", "first", "own", "bytes").mapInArrow(make, "doc_id long, hash long, a int, b int")


def _compare_hot(parts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many parts, by counting windows over all tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            r = b.to_pydict()
            for i, body in enumerate(r["bytes"]):
                n = len(body) - length + 1
                k = np.arange(n)
                pair = _digests(np.frombuffer(body, np.uint8), k, k + length)
                yield table(_WINDOW, [r["doc_id"][i]] * n, [r["hash"][i]] * n, r["first"][i] + k, [r["own"][i]] * n, *(x.view(np.int64) for x in pair))

    made = parts.select("doc_id", "hash", "first", "own", "bytes").mapInArrow(make, "doc_id long, hash long, start int, own boolean, w1 long, w2 long")
    made = stored(made, "suffix-windows")
    twice = made.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return made.where("own").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "hash", F.col("start").alias("a"), F.col("start").alias("b"))


def without_repeats(docs: DataFrame, finish: Finish, length: int = LENGTH, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """Per row: doc_id and the columns of ``finish``."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    texts = whole_texts(docs).withColumn("hash", F.xxhash64("text"))
    path = f"{shared_dir(spark)}/suffix-runs-{uuid.uuid4().hex}"
    # a batch is a share of the documents
    made = runs(texts, length).withColumn("batch", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(batches)))
    made.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    passing(spark, path)
    made = spark.read.schema(made.schema).parquet(path)
    family = SuffixFamily()
    for k in range(batches):
        family.add(made.where(F.col("batch") == k).drop("batch"))
    marks = matches(made.drop("batch"), stored(family.entries(), "suffix-entries"))
    spot = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash"
    marks = marks.groupBy(*spot).agg(F.collect_set(F.struct("first", "last", "anchor", "gram", "full", "send")).alias("marks"))
    texts = texts.select("doc_id", "text", *spot)
    marked = texts.join(marks, ["no_id", "id", "hash"], "left").select("doc_id", "text", "hash", "marks")
    state = stored(_settle(marked, length, finish), "suffix-state")
    parts = state.select("doc_id", "hash", F.explode("parts").alias("p")).select("doc_id", "hash", "p.*")
    many = stored(parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "suffix-hot")
    if many.isEmpty():
        more = _compare(parts, length)
    else:
        more = _compare(parts.join(many, "key", "left_anti"), length).unionByName(_compare_hot(parts.join(many, "key", "left_semi"), length))
    more = more.groupBy(*spot).agg(F.collect_set(F.struct("a", "b")).alias("more"))
    waiting = state.where("done is null").select("doc_id", "text", "starts", *spot).join(more, ["no_id", "id", "hash"], "left")
    schema = pa.schema([("doc_id", pa.int64()), *finish.columns])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts, *found = (c.to_pylist() for c in b.columns)
            rows = [finish.of(t, covered([(x["a"], x["b"]) for x in [*p, *(q or ())]], length)) for t, p, q in zip(texts, *found)]
            yield table(schema, ids, *([r[f.name] for r in rows] for f in finish.columns))

    late = waiting.select("doc_id", "text", "starts", "more").mapInArrow(make, f"doc_id long, {finish.ddl}".replace(":", " "))
    return late.unionByName(state.where("done is not null").select("doc_id", "done.*"))


_REST = Finish(
    lambda t, s: {"kept": without(t, s), "n_bytes": len(t), "removed": [[a, b] for a, b in s]},
    pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.list_(pa.int32())))]),
    "kept:binary, n_bytes:long, removed:array<array<int>>",
)
_DIGEST = Finish(
    lambda t, s: {"n_bytes": len(t), "n_removed": sum(b - a for a, b in s), "n_spans": len(s), "kept_sha256": hashlib.sha256(without(t, s)).hexdigest()},
    pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]),
    "n_bytes:long, n_removed:long, n_spans:long, kept_sha256:string",
)


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, kept (remaining bytes), n_bytes, removed (stretches [a, b))."""
    return without_repeats(docs, _REST, length, **options)


def digests(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, _DIGEST, length, **options)
