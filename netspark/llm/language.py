"""Language identification by multilingual mixture inference (operator 8).

Learning: byte trigrams of lower-cased words, hashed into a fixed table, counted per language over a bounded sample of
labelled documents (``per_language``, by hash of doc_id) with a Dirichlet prior.  Inference: expectation-maximisation
estimates each document's proportions of the languages from the likelihoods of all its trigrams; languages are taken
out one by one, the least first, while the loss of log-likelihood stays below the penalty of a further parameter.

Null text, or one without a letter (``str.isalpha``; fractions and Roman numerals are numbers), is ``und`` with score 0.
With nothing to learn from, every document is ``und``; an empty table gives an empty result.  Equal proportions go to the
language first by name.  Rows that repeat a doc_id are rows of their own.  ``lang`` is read for learning only; the score
is the proportion of the predicted language.  Columns other than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import first_by_hash, slices, table

BINS, PER_LANGUAGE, PRIOR, PENALTY = 1 << 16, 1500, 0.5, 30.0
CHUNK = 1 << 18
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

_PRED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _codes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) % BINS


def _raw(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a whole text, those of three separators left out."""
    return _codes(_raw(text))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a whole text and how often each stands there; long texts are counted in chunks."""
    raw = _raw(text)
    if len(raw) <= CHUNK:
        return np.unique(_codes(raw), return_counts=True)
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        total += np.bincount(_codes(raw[at : at + CHUNK + 2]), minlength=BINS)
    grams = np.flatnonzero(total)
    return grams, total[grams]


_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods (BINS x languages) from ``doc_id, text, lang`` of the rows to learn from.

    At most ``per_language`` rows of a language count.  Texts are counted where they are read; only counts move.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    ids = first_by_hash(known.select("doc_id", "lang"), "doc_id", "lang", per_language).distinct()
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams, n = counted(text)
                total.setdefault(lang, np.zeros(BINS, np.int64))[grams] += n
        for lang, n in total.items():
            grams = np.flatnonzero(n)
            yield table(_GRAMS, [lang] * len(grams), grams, n[grams])

    def dense(group: pa.Table) -> pa.Table:
        counts = np.zeros(BINS, np.int64)
        counts[group["gram"].to_numpy()] = group["n"].to_numpy()
        return pa.table({"lang": [group["lang"][0].as_py()], "counts": pa.array([counts], pa.list_(pa.int64()))})

    grams = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sorted(grams.groupBy("lang").applyInArrow(dense, "lang string, counts array<long>").collect())  # BINS numbers a language
    if not rows:
        return [], np.zeros((BINS, 0))
    counts = np.array([r.counts for r in rows], float).T
    return [r.lang for r in rows], np.log((counts + PRIOR) / (counts + PRIOR).sum(0))


def proportions(codes: np.ndarray, logp: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> np.ndarray:
    """Proportion of every language in a document with these trigrams; zero outside the selected set."""
    return mixture(*np.unique(codes, return_counts=True), logp, penalty, steps)


def mixture(grams: np.ndarray, n: np.ndarray, logp: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> np.ndarray:
    """The same from different trigrams and how often each stands there."""
    n = n.astype(float)
    p = np.exp(logp[grams])
    chosen = np.arange(p.shape[1])

    def em(cols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        if len(cols) == 1:
            return np.ones(1), float(n @ logp[grams, cols[0]])
        q, pi = p[:, cols], start
        for _ in range(steps):
            mix = q @ pi
            pi = pi * (n / mix @ q) / n.sum()
        return pi, float(n @ np.log(q @ pi))

    pi, best = em(chosen, np.full(len(chosen), 1 / len(chosen)))
    while len(chosen) > 1:
        stay = np.delete(np.arange(len(chosen)), np.argmin(pi))
        less, value = em(chosen[stay], pi[stay] / max(pi[stay].sum(), 1e-300))
        if best - value > penalty + 0.5 * np.log(n.sum()):
            break
        chosen, pi, best = chosen[stay], less, value
    out = np.zeros(p.shape[1])
    out[chosen] = pi
    return out


def _pred(text: str | None, langs: list[str], logp: np.ndarray) -> tuple[str, float]:
    if not langs or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    pi = mixture(*counted(text), logp)
    k = int(np.argmax(pi))
    return langs[k], float(min(1.0, pi[k]))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # 512 KB a language, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [_pred(t, langs, shared.value) for t in b.column(1).to_pylist()]
            yield table(_PRED, b.column(0), [x for x, _ in out], [x for _, x in out])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the documents outside the held-out fold (crc32 of doc_id as text) and predicts all of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out
    model = fit(docs.where(~fold), per_language)
    return predict(docs, model).withColumn("held_out", F.coalesce(fold, F.lit(False)))


def known_only(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, all their columns unchanged; no shuffle."""
    langs, logp = model
    shared, at = docs.sparkSession.sparkContext.broadcast(logp), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([_pred(t, langs, shared.value)[0] != "und" for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
