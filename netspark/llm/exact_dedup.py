"""Exact dedup by content sort (operator 7).

Texts are equal when they are identical after lower-casing A-Z only (bytes of UTF-8 otherwise untouched).  Equal texts
of one Arrow batch are first folded into one *local group*, so a text that a third of all rows share crosses the
network once a batch, not once a row.  The local groups are dealt out by sampled splitters over the first bytes of
their normalised text, its hash and their own number (``repartitionByRange``), sorted externally by all bytes there, and
neighbours are compared in full.  The number lets a text with very many local groups span partitions; the groups at a
partition's rims are compared once more with each other, at most a few a partition.  Only numbers are joined back.

Null text counts as empty.  Rows that repeat a ``doc_id`` are rows of their own; a null ``doc_id`` never outranks a
number.  An empty table gives an empty result.  Columns other than ``doc_id`` and ``text`` are not read; ``exact_dedup``
passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import free_name, slices, stored, table, whole_texts

PREFIX = 32

_LOCAL = pa.schema(
    [("local", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("norm", pa.binary()), ("sha", pa.string())]
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the equal texts of a batch: their ids, row numbers, normalised bytes and SHA-256."""
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        groups: dict[bytes, list] = {}
        for part in slices([batch]):
            for i, t in zip(zip(part.column(0).to_pylist(), part.column(2).to_pylist()), part.column(1).to_pylist()):
                groups.setdefault(t.encode().lower(), []).append(i)  # bytes.lower() changes A-Z only
        keys = list(groups)
        for k in range(0, len(keys), 1024):
            some = keys[k : k + 1024]
            yield table(_LOCAL, range(at, at + len(some)), [[i for i, _ in groups[x]] for x in some], [[r for _, r in groups[x]] for x in some], some, [hashlib.sha256(x).hexdigest() for x in some])
            at += len(some)


_MEMBER = pa.schema([("local", pa.int64()), ("group", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("rim", pa.binary())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the groups of equal neighbours of a sorted partition (local, norm, id, n, first, hash).

    Groups whose text may go on in the partition before or after also give a row with their bytes (``rim``): those that
    share the first or the last hash.
    """
    group = (TaskContext.get().partitionId() << 36) - 1
    last, held, opening = None, [], True  # the last row's hash and bytes; groups of its hash

    def rims() -> pa.RecordBatch:
        none = [None] * len(held)
        return table(_MEMBER, none, [g for g, _ in held], none, none, none, [x for _, x in held])

    for b in batches:
        if not b.num_rows:
            continue
        norm, hashes = b.column(1), b.column(5)
        other = [last is None or last[1] != norm[0].as_py()]
        if b.num_rows > 1:
            other += pc.not_equal(norm.slice(1), norm.slice(0, b.num_rows - 1)).to_pylist()
        groups = []
        for i, new in enumerate(other):
            if new:
                group += 1
                h = hashes[i].as_py()
                if last is None or h != last[0]:
                    if last is not None and opening:
                        yield rims()
                        opening = False
                    held = []
                last = (h, norm[i].as_py())
                held.append((group, last[1]))
            groups.append(group)
        yield table(_MEMBER, b.column(0), groups, b.column(2), b.column(3), b.column(4), [None] * b.num_rows)
    if held:
        yield rims()


def _groups(numbered: DataFrame, keep: str) -> DataFrame:
    """One row per row of ``numbered`` (doc_id, text, row): doc_id, row, keep_id, group_size, stays, text_sha256.

    ``stays`` is true for one row of each group: the first by number of those that have the kept id, or no id if none has.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    array_best = F.array_max if keep == "max" else F.array_min
    local = stored(
        whole_texts(numbered, "row").mapInArrow(_fold, "local long, ids array<long>, rows array<long>, norm binary, sha string"), "content-local"
    )
    first = F.array_min(F.transform(F.filter(F.arrays_zip("ids", "rows"), lambda x: x["ids"].eqNullSafe(F.col("id"))), lambda x: x["rows"]))
    # splitters are a short prefix, a hash and a number, so their sample stays small and a common text doesn't pile up
    dealt = (
        local.select("local", "norm", array_best("ids").alias("id"), F.size("ids").cast("long").alias("n"), "ids", "rows")
        .select("local", "norm", "id", "n", first.alias("first"))
        .withColumns({"prefix": F.substring("norm", 1, PREFIX), "hash": F.xxhash64("norm")})
        .repartitionByRange("prefix", "hash", "local")
        .sortWithinPartitions("prefix", "hash", "norm", "local")
        .select("local", "norm", "id", "n", "first", "hash")
    )
    found = stored(dealt.mapInArrow(_neighbours, "local long, group long, id long, n long, first long, rim binary"), "content-groups")
    rims = found.where("rim is not null").groupBy("rim").agg(F.collect_list("group").alias("groups"), F.min("group").alias("root"))
    rims = rims.where(F.size("groups") > 1).select(F.explode("groups").alias("group"), "root")
    members = found.where("local is not null").join(rims, "group", "left").withColumn("group", F.coalesce("root", "group"))
    if keep == "max":
        best = F.max(F.struct("id", (-F.col("first")).alias("at")))
    else:
        best = F.min(F.struct(F.col("id").isNull(), "id", F.col("first").alias("at")))
    groups = members.groupBy("group").agg(best.alias("b"), F.sum("n").alias("group_size"))
    groups = groups.select("group", F.col("b.id").alias("keep_id"), "group_size", F.abs("b.at").alias("row_that_stays"))
    of_local = members.select("local", "group").join(groups, "group").drop("group")
    rows = local.select("local", F.arrays_zip("ids", "rows").alias("of"), F.col("sha").alias("text_sha256")).join(of_local, "local")
    rows = rows.select("*", F.explode("of").alias("x"))
    return rows.select(
        F.col("x.ids").alias("doc_id"), F.col("x.rows").alias("row"), "keep_id", "group_size",
        (F.col("x.rows") == F.col("row_that_stays")).alias("stays"), "text_sha256",
    )


def content_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest (``min``) or the largest (``max``) doc_id of equal texts stays.  Rows that repeat the
    kept id are all marked as kept; of a group without any id one row is.
    """
    rows = _groups(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), keep)
    kept = F.when(F.col("keep_id").isNull(), F.col("stays")).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged: one row of each group of equal texts.

    Rows are told apart by a number of their own, so null and repeated doc_ids lose no group and leave no copies.
    """
    row = free_name(docs, "row_number")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "content-rows")
    gone = _groups(numbered.select("doc_id", "text", F.col(row).alias("row")), keep).where("not stays")
    return numbered.join(gone.select(F.col("row").alias(row)), row, "left_anti").drop(row)
