"""Near copies by the word shingles they share: Jaccard similarity of at least 0.8 over five words.

The words are those of operator 9's fingerprints (lower-case A-Z, between ASCII white space); a text of fewer than ``k``
words is one shingle.  The method is operator 9's, made for a lower similarity: SimHash fingerprints, tables of their
distances to pivots, verified links, components.

1. Every text has a SimHash of 512 bits over its distinct shingles.  At a similarity of 0.8 two differ in 78 bits on
   average (standard deviation 8); ``radius`` allows some 5.7 standard deviations more.
2. Blocks of bits can't say which texts meet at that distance (24 bits agree in 2 % of such pairs), so texts meet in
   buckets of 24 keys, each of four least hashes: a pair of similarity s shares one with probability
   1 - (1 - s^4)^24, which is 0.999997 at 0.8 and more above.
3. In a bucket a search from member to member gives a forest of pairs within the radius.  The distances of all members to
   some of them (pivots) are tabled; pairs whose tables differ by more than the radius are discarded unseen.
   The forests' components are loose groups: a link that shares a key never leaves its group.
4. Every text of a group is sent once to a task of the group, which searches again from member to member, and keeps what the
   exact similarity of the texts verifies.  A group of more than ``TILE`` shingles is dealt to tiles, and every pair
   of tiles is a task, so a task stays bounded.  The components of these links are the result.

No step gives a row for each pair of a group, and nothing is capped or sampled.  Rows are told apart by a number of their
own, so null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import free_name, slices, stored, table
from netspark.llm.simhash import pivots
from netspark.operators.components import connected_components

SHINGLE, SIMILARITY, WORDS, KEYS, KEY_ROWS, PIVOTS, TILE = 5, 0.8, 8, 24, 4, 8, 1 << 18
LEAST, FEW = KEYS * KEY_ROWS, 8

_SIGNED = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))])
_MEMBER = pa.schema([("key", pa.int64()), ("row", pa.int64())])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: str, k: int = SHINGLE) -> set[bytes]:
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    return set(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) >= k else {b" ".join(words)}


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``64 * WORDS`` bits of hashed shingles: a bit is 1 where more than half the shingles have it."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):  # so many bits add up in a byte
        z = hashes[i : i + 255, None] + pivots(WORDS)
        z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        ones += np.unpackbits((z ^ z >> np.uint64(32)).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def signature(found: set[bytes]) -> tuple[np.ndarray, list[int]]:
    """Fingerprint and bucket keys of a text's shingles."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    turns = pivots(2 * LEAST)
    least = np.full(LEAST, ~np.uint64(0))
    for i in range(0, len(hashes), 512):
        turned = hashes[i : i + 512][None, :] * (turns[:LEAST, None] | np.uint64(1)) + turns[LEAST:, None]
        np.minimum(least, turned.min(1), out=least)
    keys = [xxh64_intdigest(least[i * KEY_ROWS : (i + 1) * KEY_ROWS].tobytes(), i) - (1 << 63) for i in range(KEYS)]
    return fingerprint(hashes), keys


def radius(similarity: float = SIMILARITY, few: bool = False) -> int:
    """Bits in which fingerprints of texts of that similarity may differ.

    The angle of two sets of one size is the widest at a similarity.  Of ``few`` shingles many bits are ties, which adds
    up to a quarter (four shingles against five: 0.1875 of the bits differ instead of 0.1515).
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi * (1.25 if few else 1)
    return math.ceil(64 * WORDS * p + 5.7 * math.sqrt(64 * WORDS * p * (1 - p)))


def distances(fps: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ x).sum(1, dtype=np.int32)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Distance of each fingerprint to some of them, each pivot the furthest from those before it."""
    columns, nearest = [distances(fps, fps[0])], None
    while len(columns) < min(PIVOTS, 1 + len(fps) // 8):
        nearest = columns[-1] if nearest is None else np.minimum(nearest, columns[-1])
        columns.append(distances(fps, fps[nearest.argmax()]))
    return np.stack(columns, 1)


def forest(fps: np.ndarray, n: np.ndarray, similarity: float, side: np.ndarray | None = None, verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Members and those first reached from them: pairs that connect what all pairs within the radius would.

    ``verify`` keeps those of some members that are linked to one; members of one ``side``, 0 or 1, don't meet.
    """
    tabled, left, wide, widest = distance_table(fps), np.arange(len(fps)), radius(similarity), radius(similarity, True)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            some = left[np.minimum(n[left], n[x]) >= similarity * np.maximum(n[left], n[x])]
            if side is not None and side[x] < 2:
                some = some[side[some] != side[x]]
            most = np.where(np.minimum(n[some], n[x]) <= FEW, widest, wide)
            ok = np.abs(tabled[some] - tabled[x]).max(1, initial=0) <= most  # triangle inequality
            some, most = some[ok], most[ok]
            some = some[distances(fps[some], fps[x]) <= most]
            if verify and len(some):
                some = verify(x, some)
            if len(some):
                yield x, some
                queue += some.tolist()
                left = left[~np.isin(left, some, assume_unique=True)]


def similar(found: list[set[bytes]], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Says which of some members have the exact similarity to one, given the shingles of each."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(g, len(number)) for g in x), np.int64, len(x)) for x in found]
    n, mark = np.array([len(x) for x in ids]), np.zeros(len(number), bool)

    def verify(x: int, some: np.ndarray) -> np.ndarray:
        mark[ids[x]] = True
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        both = np.add.reduceat(mark[np.concatenate([ids[i] for i in some])], starts, dtype=np.int64)
        mark[ids[x]] = False
        return some[both / (n[x] + n[some] - both) >= similarity]

    return verify


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets; the input is sorted by ``key``, its first column."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        if not len(keys):
            continue
        whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if whole:
            yield pa.Table.from_batches([*kept, b.slice(0, whole)])
            kept = []
        elif kept and kept[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(b.slice(whole))
    if kept:
        yield pa.Table.from_batches(kept)


def _each(t: pa.Table) -> list[tuple[int, int]]:
    """Where the buckets of two rows or more begin and end."""
    keys = t.column("key").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    more = ends - starts > 1
    return list(zip(starts[more].tolist(), ends[more].tolist()))


def _fps(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)


def _pairs(rows: np.ndarray, found: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, some in found:
        yield np.minimum(rows[some], rows[x]), np.maximum(rows[some], rows[x])


def _given(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield table(_PAIR, np.concatenate([u for u, _ in pairs]), np.concatenate([v for _, v in pairs]))


def _bucketed(members: DataFrame) -> DataFrame:
    return members.repartition("key").sortWithinPartitions("key", "row")


def groups(signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(row, component)`` of every row that lies within the radius of another in a bucket, itself or by others."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            if each := _each(t):
                at = np.concatenate([np.arange(s, e) for s, e in each])
                yield table(_MEMBER, *(t.column(c).to_numpy()[at] for c in ("key", "row")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            rows, n, fps = t.column("row").to_numpy(), t.column("n").to_numpy(), _fps(t)
            yield from _given([p for s, e in _each(t) for p in _pairs(rows[s:e], forest(fps[s:e], n[s:e], similarity))])

    dealt = _bucketed(signed.select(F.explode("keys").alias("key"), "row")).mapInArrow(shared, "key long, row long")
    members = stored(dealt, "near-members").join(signed.select("row", "n", "fp"), "row").select("key", "row", "n", "fp")
    loose = stored(_bucketed(members).mapInArrow(search, "u long, v long").distinct(), "near-loose")
    return connected_components(loose).select(F.col("node").alias("row"), "component")


def verified(grouped: DataFrame, signed: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``(u, v)``: links of the exact similarity whose components are those of all such links inside the groups."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            for s, e in _each(t):
                one = t.slice(s, e - s)
                found = [shingles(x, k) for x in one.column("text").to_pylist()]
                n, verify = np.array([len(x) for x in found]), similar(found, similarity)
                del found
                yield from _given(list(_pairs(one.column("row").to_numpy(), forest(_fps(one), n, similarity, one.column("side").to_numpy(), verify))))

    placed = stored(grouped.join(signed.select("row", "n", "fp"), "row"), "near-groups")
    tiles = placed.groupBy("component").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    placed = placed.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("row"), "tiles").cast("int"))
    sent = texts.join(placed, "row").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    key = F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other"))  # if two are one by chance, more pairs meet
    sent = sent.select(key.alias("key"), "row", "fp", side.alias("side"), "text")
    return _bucketed(sent).mapInArrow(search, "u long, v long")


def links(texts: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(u, v)``: verified links among ``texts`` (row, text) whose components are those of all links."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(t, k) for t in b.column(1).to_pylist()]
            signed = [signature(x) for x in found]
            yield table(_SIGNED, b.column(0), [len(x) for x in found], [f.tobytes() for f, _ in signed], [ks for _, ks in signed])

    signed = stored(texts.mapInArrow(sign, "row long, n int, fp binary, keys array<long>"), "near-signed")
    return verified(groups(signed, similarity), signed, texts, k, similarity)


def one_of_each(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged: of each component the smallest doc_id, null last."""
    row = free_name(docs, "row_number")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    texts = numbered.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(connected_components(stored(links(texts, k, similarity), "near-links")), "near-components")
    named = found.join(numbered.select(F.col(row).alias("node"), "doc_id"), "node")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))["node"].alias("stays"))
    gone = named.join(best, "component").where("node <> stays").select(F.col("node").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
