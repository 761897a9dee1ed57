"""Toxic passages by maximum-scoring segment search (operator 3).

Tokens are words.  Their log-odds between toxic and clean labelled documents have Dirichlet (additive) priors; a word
is judged by itself and by its first four, five and six letters, and counts by its lower confidence bound, so rare
words stay neutral.  Evidence is counted once per distinct pair of a word and the word before it, so copies of one
passage count once.  All other tokens cost a small drift, which makes chance segments short.

All maximal scoring segments of a whole text are found in one linear scan (only runs between scoring tokens matter).
Their scores are calibrated as extreme values: lambda solves ``sum p(s) exp(lambda s) = 1`` over clean text, and
``lambda * S - ln(words)`` has one distribution whatever a document's length; texts under ``FLOOR`` words count as that
long, so being short is no evidence.  A logistic curve over the best segment's value, fitted on the same labelled rows,
gives the score; segments with E-value below 0.01 are passages.

A text without a scoring word has no segment and gets the least value there is: null, empty and wordless texts score
lowest, with all other texts without evidence.  Rows that repeat a doc_id are rows of their own; an empty table gives
an empty result; columns other than ``doc_id`` and ``text`` are not read.  Labels are read for learning only; of
several labels of one document the toxic one counts.  Without labels of both kinds every score is 0.

The model has bounds of its own, which are parameters of learning and not of scoring: ``PER_CLASS`` labelled documents of
each kind, tokens seen in at least ``SUPPORT`` toxic pairs, scores of at most ``TOP``, the ``MOST`` surest words and as many
stems of each size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import first_by_hash, slices, stored, table, whole_texts

PER_CLASS, PRIOR, CONFIDENCE, LEAST, SUPPORT, TOP, DRIFT, MOST, STEMS = 4000, 0.5, 2.0, 1.2, 5, 8.0, 0.1, 50_000, (6, 5, 4)
FLOOR, RANGE, STEP = 100, 12.0, 0.01
_WORD = re.compile(r"\w+")


class Model(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    rate: float  # lambda
    a: float
    b: float


def segments(at: np.ndarray, gain: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that gains at ``at`` and else loses ``drift``.

    Linear: every candidate knows the nearest one before it that starts lower, so a candidate that was passed over once
    is not looked at again.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum after it, the one that starts lower
    total, before = 0.0, -1
    for i, s in zip(at.tolist(), gain.tolist()):
        total -= drift * (i - before - 1)
        before = i
        first, left, right = i, total, total + s
        total, lower = right, len(stack) - 1
        while True:
            while lower >= 0 and stack[lower][2] >= left:
                lower = stack[lower][4]
            if lower < 0 or stack[lower][3] >= right:
                break
            first, _, left, _, up = stack[lower]
            del stack[lower:]
            lower = up
        stack.append((first, i, left, right, lower))
    return [(f, l, r - b) for f, l, b, r, _ in stack]


def gains(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places and gains of the scoring words."""
    memo = _memo(model)
    s = list(map(memo.__getitem__, words))
    at = [i for i, x in enumerate(s) if x]
    return np.array(at, np.int64), np.array([s[i] for i in at])


class _Scores(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, w: str) -> float:
        s = max(self.model.words.get(w, 0.0), *(self.model.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k), 0.0)
        if len(self) > 200_000:
            self.clear()
        self[w] = s
        return s


_kept: list = [None, None]


def _memo(model: Model) -> _Scores:
    if _kept[0] is not model:
        _kept[:] = [model, _Scores(model)]
    return _kept[1]


def value(text: str, model: Model) -> tuple[float, list[tuple[int, int, float]], list[str]]:
    """Extreme value of the best segment (the least there is without one), the segments by word numbers, the words."""
    words = _WORD.findall(text.lower())
    at, gain = gains(words, model)
    if not len(at):
        return -RANGE, [], words
    found = segments(at, gain)
    x = model.rate * max(s for *_, s in found) - float(np.log(max(FLOOR, len(words))))
    return max(-RANGE, min(RANGE, x)), found, words


def drift_rate(seen: dict[float, float], total: float) -> float:
    """lambda from how often clean text gains which score, with half a token more than was seen."""
    seen = {**seen, TOP: seen.get(TOP, 0.0) + 0.5}
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        over = sum(m / total * np.exp(mid * s) for s, m in seen.items()) + (1 - sum(seen.values()) / total) * np.exp(-mid * DRIFT) > 1
        low, high = (low, mid) if over else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope over values ``x`` with labels ``y``, each seen ``n`` times; goals are held off 0 and 1.

    Texts without evidence stand where a text of FLOOR words would that scores nothing.  Newton steps are halved until
    the (slightly penalised) likelihood grows, so labels that a value parts cleanly don't run away.
    """
    x = np.maximum(x, -np.log(FLOOR))
    n1, n0 = float(n[y == 1].sum()), float(n[y == 0].sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, design = np.array([0.0, 1.0]), np.stack([np.ones(len(x)), x], 1)

    def gain(t: np.ndarray) -> float:
        z = design @ t
        return float(n @ (goal * z - np.logaddexp(0, z)) - 5e-4 * t @ t)

    for _ in range(100):
        p = 0.5 * (1 + np.tanh(design @ theta / 2))
        hess = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (n * (goal - p)) - 1e-3 * theta)
        while np.abs(step).max() > 1e-9 and gain(theta + step) <= gain(theta):
            step = step / 2
        theta = theta + step
        if np.abs(step).max() <= 1e-9:
            break
    return float(theta[0]), max(0.0, float(theta[1]))


_PAIRS = pa.schema([("toxic", pa.int32()), ("before", pa.string()), ("word", pa.string())])
_SEEN = pa.schema([("score", pa.float64()), ("n", pa.int64())])
_VALUES = pa.schema([("toxic", pa.int32()), ("x", pa.int32())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = _WORD.findall(text.lower())
            found = list(set(zip(chain([""], words), words)))
            for k in range(0, len(found), 1 << 16):
                some = found[k : k + (1 << 16)]
                yield table(_PAIRS, [toxic] * len(some), [x for x, _ in some], [w for _, w in some])


def _log_odds(counts: DataFrame, n: tuple[int, int]) -> dict[str, float]:
    """Of ``counts`` (name, t, c) the tokens whose log-odds exceed LEAST with confidence, with their lower bound."""
    t, c = F.col("t") + PRIOR, F.col("c") + PRIOR
    delta = F.log(t / (n[1] + 2 * PRIOR - t)) - F.log(c / (n[0] + 2 * PRIOR - c))
    low = delta - CONFIDENCE * F.sqrt(1 / t + 1 / c)
    best = counts.where(F.col("t") >= SUPPORT).select("name", F.least(low, F.lit(TOP)).alias("s")).where(F.col("s") >= LEAST)
    return {r.name: r.s for r in best.orderBy(F.desc("s"), F.desc("name")).limit(MOST).collect()}  # the model: MOST at most


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Learns from at most ``per_class`` labelled documents of each kind, by hash of doc_id; None without both labels.

    Words are counted where texts are read, once per distinct pair; the driver gets the model, a histogram of what clean
    words score and one of the documents' values.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = first_by_hash(known, "doc_id", "toxic", per_class).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # 2 per_class rows
    rows = stored(whole_texts(docs).join(F.broadcast(some), "doc_id").select("toxic", "text"), "toxic-sample")
    pairs = rows.mapInArrow(_pairs, "toxic int, before string, word string").distinct()
    counts = pairs.groupBy(F.col("word").alias("name")).agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    counts = stored(counts, "toxic-counts")
    n = tuple(counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first())
    if rows.select("toxic").distinct().count() < 2:
        return None
    words, stems = _log_odds(counts, n), {}
    for size in STEMS:
        part = counts.where(F.length("name") >= size).groupBy(F.substring("name", 1, size).alias("name")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        stems |= _log_odds(part, n)
    model = Model(words, stems, 1.0, 0.0, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST words and 3 MOST stems at most

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _memo(shared.value), {}
        for b in batches:
            for w, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s := memo[w]:
                    seen[round(s, 1)] = seen.get(round(s, 1), 0) + m
        yield table(_SEEN, list(seen), list(seen.values()))

    seen = counts.where("c > 0").select("name", "c").mapInArrow(clean_scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
    model = model._replace(rate=drift_rate({r.score: r.n for r in seen.orderBy("score").collect()}, n[0] + 1))  # 10 TOP rows at most
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield table(_VALUES, b.column(0), [round(value(t, fitted.value)[0] / STEP) for t in b.column(1).to_pylist()])

    held = rows.mapInArrow(values, "toxic int, x int").groupBy("toxic", "x").agg(F.count("*").alias("n")).orderBy("toxic", "x").collect()
    y, x, n = (np.array([r[i] for r in held], float) for i in range(3))  # 4 RANGE / STEP rows at most
    a, b = logistic(x * STEP, y, n)
    return model._replace(a=a, b=b)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("passages", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("e_value", pa.float64())])))])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, score, n_passages, passages (first and last word number, E-value)."""
    # at most MOST words and 3 x MOST stems
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            scores, found = [], []
            for t in b.column(1).to_pylist():
                if m is None:
                    scores.append(0.0)
                    found.append([])
                    continue
                x, segs, words = value(t, m)
                scores.append(float(0.5 * (1 + np.tanh((m.a + m.b * x) / 2))))
                e = [(f, l, float(len(words) * np.exp(-m.rate * s))) for f, l, s in segs]
                found.append([{"first": f, "last": l, "e_value": v} for f, l, v in e if v < 0.01])
            yield table(_SCORED, b.column(0), scores, list(map(len, found)), found)

    return whole_texts(docs).mapInArrow(run, "doc_id long, score double, n_passages long, passages array<struct<first:long,last:long,e_value:double>>")


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, cut: float = 0.7) -> DataFrame:
    """Learns outside the held-out fold (crc32 of doc_id as text) and scores every document."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out
    model = fit(docs, labels.where(~fold))
    out = score(docs, model).withColumn("held_out", F.coalesce(fold, F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
