"""SimHash near-duplicates with pivot distance tables (operator 9).

Fingerprints: lower-case A-Z, words between ASCII white space, shingles of ``k`` words (fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is 1 where more than half the hashes have it.  No word: fingerprint 0.

Links (Hamming distance at most ``radius``) are searched among *distinct* fingerprints.  The distance of every
fingerprint to fixed reference fingerprints (pivots) is tabled; by the triangle inequality a pair whose tables differ
by more than the radius in any coordinate is no link, and the survivors are verified bit by bit.  So that the tables
are not compared pair by pair over all rows, only fingerprints that agree on all but ``radius`` of some equal blocks
of bits meet (pigeonhole: exact, no link is lost).  In one bucket a search from member to member returns a spanning
forest of the links, not all pairs: every member leaves the list of the unvisited when it is first reached.

Null and empty texts have fingerprint 0 and link like others.  Rows that repeat a doc_id are rows of their own; a null
doc_id is a row like others that never names a component (only rows without any id reach no smallest id: null).  An
empty table gives an empty result.  Columns other than ``doc_id`` and ``text`` are not read; ``one_of_each`` passes them
through, whatever their names.  Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import free_name, slices, stored, table, whole_texts
from netspark.operators.components import connected_components

SHINGLE, SEED, RADIUS, PIVOTS, SMALL = 4, 42, 4, 16, 24

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) >= k else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row, fp as a signed 64-bit integer with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64)
            yield table(_FP, b.column(0), fps.view(np.int64))

    return whole_texts(docs).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: outputs of a counter through a 64-bit mixer."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def forest(fps: np.ndarray, near: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the members of one bucket as all its links would."""
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            some = left
            for p in range(near.shape[1]):
                some = some[np.abs(near[some, p] - near[x, p]) <= radius]
                if len(some) < 64:
                    break
            some = some[np.abs(near[some] - near[x]).max(1, initial=0) <= radius]
            some = some[np.bitwise_count(fps[some] ^ fps[x]) <= radius]
            if len(some):
                links += [(x, y) for y in some]
                queue += list(some)
                left = np.setdiff1d(left, some, assume_unique=True)
    return links


def bucket_links(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of every bucket; equal ``keys`` stand together."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    us, vs = [], []
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        rows = starts[sizes == n][:, None] + np.arange(n)
        for part in np.array_split(rows, 1 + len(rows) * n * n // (1 << 20)):
            near = distance_table(fps[part].ravel(), refs).reshape(*part.shape, -1)
            for a, b in combinations(range(n), 2):
                ok = np.abs(near[:, a] - near[:, b]).max(1, initial=0) <= radius
                x, y = fps[part[ok, a]], fps[part[ok, b]]
                ok = np.bitwise_count(x ^ y) <= radius
                us.append(x[ok])
                vs.append(y[ok])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        f = fps[s : s + n]
        if pairs := forest(f, distance_table(f, refs), radius):
            pairs = np.array(pairs, np.int64)
            us.append(f[pairs[:, 0]])
            vs.append(f[pairs[:, 1]])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


def blocks_for(n: int, radius: int) -> int:
    """Blocks of which all but ``radius`` agree in a link, such that the key has more values than there are rows."""
    blocks = radius + 2
    while 64 * (blocks - radius) / blocks < max(n, 2).bit_length() and blocks < radius + 6:
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """``(u, v)``: links among distinct fingerprints (column ``fp``) whose components are those of all links."""
    blocks = blocks_for(distinct.count() if n is None else n, radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))
    dealt = distinct.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", "fp")
    refs = pivots()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole:
                u, v = bucket_links(keys[:whole], fps[:whole], refs, radius)
                yield table(_LINK, u.view(np.int64), v.view(np.int64))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            u, v = bucket_links(keys, fps, refs, radius)
            yield table(_LINK, u.view(np.int64), v.view(np.int64))

    return dealt.select("key", "fp").mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links reach, its own included)."""
    fps = stored(fingerprints(docs, k), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = connected_components(stored(links(distinct.select("fp"), radius), "simhash-links"))
    of_fp = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = of_fp.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged: the smallest doc_id of each component, null last.

    Of rows that repeat that doc_id, and of rows without any, the first by number stays.
    """
    row = free_name(docs, "row_number")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    of_row = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), k, radius).select(F.col("doc_id").alias("row"), "component_id")
    named = of_row.join(numbered.select(F.col(row).alias("row"), "doc_id"), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("stays"))
    gone = named.join(best, "component_id").where("row <> stays").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
