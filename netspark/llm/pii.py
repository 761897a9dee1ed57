"""Personal data: patterns, then information-theoretic sanitisation (operator 6).

Base spans are the e-mail, IP, card and phone patterns; each is found in linear time whatever the text holds.

Around every base span the words of a window are its context.  The co-occurrence of a term and an entity (one address,
number ...) tells how much of the entity the term gives away: with *distinct texts* as events,
``PMI(t, c) / IC(c) = 1 + ln p(c | t) / -ln p(c)``.  For p(c | t) stands the lower end of its confidence interval (Wilson,
``Z``), so few events need a clearer case and no number of them is asked for.  A term that reaches ``threshold`` of what
is to be known about an entity is a span of its own (kind ``term``) wherever it stands, in whichever text.

``sanitise`` replaces base spans by their kind.  Terms are generalised along the vocabulary: the classes of a term are the
words that begin like it (``STEMS`` letters), and the narrowest class that discloses none of the entities the term does
takes its place (``zorb*``); a term whose every class discloses is removed (``<TERM>``).

Every count is one of distinct texts, so copies of a document are no evidence; texts that repeat one context about the
entity weigh as one in the interval.  The event that brings a pair up is no evidence for it, only what repeats it is.
Counts cover the whole corpus: fixed bitmaps (128 KB) of hashes only spare counting words that can't matter.

Null text is empty and has no spans; rows that repeat a doc_id are rows of their own; an empty table gives an empty
result.  ``detect`` reads ``doc_id`` and ``text`` only; ``sanitise`` passes all other columns through, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from netspark.llm.common import free_name, slices, stored, table, whole_texts

KINDS = ("email", "ip", "card", "phone", "term")
BITS, WINDOW, Z, THRESHOLD, STEMS = 20, 100, 1.2816, 0.9, (6, 4, 2)  # Z: 90 % of one side
MASK = (1 << BITS) - 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: what follows the run decides, wherever one starts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of every base match, by start and then kind as listed."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _touched(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span has a character in [start, end); ``spans`` are ordered by start."""
    starts, ends = [a for _, a, _ in spans], list(accumulate((b for _, _, b in spans), max))
    return lambda a, b: (k := bisect_left(starts, b)) > 0 and ends[k - 1] > a


def _sign(s: str) -> int:
    return xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def classes(word: str) -> list[str]:
    """A lower-case word and the classes it can be generalised to, the narrowest first."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


def contexts(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> Iterator[tuple[int, str, int]]:
    """(entity, term, context) for the whole words around each span that no base span touches."""
    touched = _touched(spans)
    for kind, a, b in spans:
        shown = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[a:b])
        low, high = max(0, a - window), min(len(text), b + window)
        entity, where = _sign(f"{kind}:{shown}"), _sign(text[low:a] + "\0" + text[b:high])
        for side, end in ((low, a), (b, high)):
            for m in _TERM.finditer(text, side, end):
                s, e = m.span()
                cut = (s == low and s > 0 and text[s - 1].isalnum()) or (e == high and e < len(text) and text[e].isalnum())
                if not cut and not touched(s, e):
                    yield entity, m[0].lower(), where


_NEAR = pa.schema([("text_hash", pa.int64()), ("entity", pa.int64()), ("term", pa.int64()), ("level", pa.int32()), ("class", pa.int64()), ("context", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64())]
    + [("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
    + [("hits", pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))]
)
_FOUND_DDL = "doc_id long, text_hash long, spans array<struct<kind:string,start:int,end:int>>, hits array<struct<term:long,start:int,end:int>>"
_COUNT = pa.schema([("text_hash", pa.int64()), ("class", pa.int64()), ("n", pa.int64())])


class _Marks:
    """A fixed bitmap of 64-bit hashes: no hash is missed, some others pass."""

    def __init__(self, hashes: DataFrame):
        # at most 2 ** BITS numbers, whatever the corpus
        slots = [r[0] for r in hashes.select(F.col(hashes.columns[0]).bitwiseAND(MASK).cast("int")).distinct().collect()]
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[slots] = True
        self.shared = hashes.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def read(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.shared.value, np.uint8)).astype(bool)


class _Prefix(dict):
    """From the first ``k`` letters of a word, as written, to the hash of its class if a bitmap has it, else None."""

    def __init__(self, k: int, wanted: bytes):
        self.k, self.wanted = k, wanted

    def __missing__(self, p: str) -> int | None:
        if len(self) > 200_000:
            self.clear()
        h = _sign(f"{(p + 'a').lower()[: self.k]}*")  # a letter more: the last one of a word may have a form of its own
        self[p] = h = h if self.wanted[h & MASK] else None
        return h


class _Wanted:
    """What a bitmap has of the classes and words of a text.

    A class is wanted wherever a narrower one is (more texts, more contexts), so most words end at their first letters.
    """

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted.tobytes()
        self.of = {k: _Prefix(k, self.wanted) for k in STEMS}

    def words(self, text: str) -> tuple[set[str], dict[str, int]]:
        """All words of a text and, of those that are wanted, the hash."""
        words, four = set(_TERM.findall(text)), self.of[4]
        some = [w for w in words if len(w) == 4 or four[w[:4]] is not None]
        return words, {w: h for w in some if self.wanted[(h := _sign(w.lower())) & MASK]}

    def classes(self, text: str) -> set[int]:
        words, own = self.words(text)
        two, four, six = (self.of[k] for k in (2, 4, 6))
        out = {two[p] for p in {w[:2] for w in words}}
        wide = [w for w in words if len(w) > 4 and four[w[:4]] is not None]
        out.update(four[w[:4]] for w in wide)
        out.update(six[p] for p in {w[:6] for w in wide if len(w) > 6})
        out.update(own.values())
        out.discard(None)
        return out


def _hashed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))


def near_terms(docs: DataFrame) -> DataFrame:
    """(text_hash, entity, term, level, class, context) for the terms around base spans (level 0) and their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = set()
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for entity, word, where in contexts(t, base_spans(t)):
                    names = list(map(_sign, classes(word)))
                    out.update((h, entity, names[0], k, x, where) for k, x in enumerate(names))
            yield table(_NEAR, *(zip(*out) if out else [[]] * 6))

    return _hashed(docs).mapInArrow(run, "text_hash long, entity long, term long, level int, class long, context long").distinct()


def _reaches(pairs: DataFrame, hits, tries, total: int, threshold: float) -> DataFrame:
    """``pairs`` in which the lower end of the interval of hits / tries reaches the threshold."""
    n, z2 = F.greatest(tries, F.lit(1e-9)), Z * Z
    p = F.least(F.lit(1.0), hits / n)
    low = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    ic = -F.log(F.least(F.col("n_entity") / F.lit(float(total)), F.lit(0.5)))
    return pairs.where((hits > 0) & (1 + F.log(F.greatest(low, F.lit(1e-300))) / ic >= threshold))


def judged(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, level, class, tells): every class of a term that discloses the entity beyond the threshold, the
    term itself as level 0, and whether the class does, too."""
    events = stored(near_terms(docs), "pii-events")
    copies = stored(_hashed(docs).groupBy("text_hash").agg(F.count("*").alias("n")), "pii-copies")
    total = max(2, copies.count())
    of_entity = events.select("entity", "text_hash").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    kind = ["entity", "class", "level"]
    in_texts = events.select(*kind, "text_hash").distinct().groupBy(*kind).agg(F.count("*").alias("n_pair"))
    in_contexts = events.select(*kind, "context").distinct().groupBy(*kind).agg(F.count("*").alias("n_context"))
    pairs = in_texts.join(in_contexts, kind).join(of_entity, "entity")
    pairs = pairs.withColumn("own", F.least("n_pair", "n_context").cast("double"))
    # what can't reach the threshold even if the term stood nowhere else needs no count
    pairs = stored(_reaches(pairs, F.col("own") - 1, F.col("own") - 1, total, threshold), "pii-pairs")
    names, repeated = _Marks(pairs.select("class")), _Marks(copies.where("n > 1").select("text_hash"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, several = names.read(), repeated.read()
        if not wanted.any():
            return
        find, seen, done = _Wanted(wanted).classes, Counter(), set()
        for b in slices(batches):
            own: list[tuple[int, int]] = []
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if h in done:
                    continue
                here = find(t)
                if several[h & MASK]:  # may stand in other tasks, too: counted apart
                    if len(done) > 100_000:
                        done.clear()
                    done.add(h)
                    own += [(h, x) for x in here]
                else:
                    seen.update(here)
            if own:
                yield table(_COUNT, *zip(*own), [1] * len(own))
            if len(seen) > 100_000:
                yield table(_COUNT, [None] * len(seen), list(seen), list(seen.values()))
                seen.clear()
        yield table(_COUNT, [None] * len(seen), list(seen), list(seen.values()))

    counts = stored(_hashed(docs).mapInArrow(count, "text_hash long, class long, n long"), "pii-counts")
    once = counts.where("text_hash is not null").distinct()
    counts = counts.where("text_hash is null").unionByName(once).groupBy("class").agg(F.sum("n").alias("n_class"))
    pairs = pairs.join(counts, "class")
    found = _reaches(pairs, F.col("own") - 1, F.col("own") * F.col("n_class") / F.col("n_pair") - 1, total, threshold)
    found = stored(found.select(*kind), "pii-judged")
    # which classes stand above a term that discloses: one row a term, entity and level
    ladder = events.select("entity", "term", "level", "class").distinct()
    terms = found.where("level = 0").select("entity", F.col("class").alias("term"))
    return ladder.join(terms, ["entity", "term"]).join(found.withColumn("tells", F.lit(True)), kind, "left").select("entity", "term", "level", "class", F.coalesce("tells", F.lit(False)).alias("tells"))


def letters_left(ladder: DataFrame) -> DataFrame:
    """(term, letters) of a ladder as from ``judged``: how many letters of each term may stay.

    ``letters`` is the length of the narrowest class that discloses none of the term's entities, 0 where there is none.
    """
    told = ladder.groupBy("term", "level").agg(F.max("tells").alias("tells"))
    letters = F.element_at(F.array(*map(F.lit, STEMS)), F.lit(1 + len(STEMS)) - F.col("left"))
    free = told.groupBy("term").agg(F.min(F.when(~F.col("tells"), F.col("level"))).alias("level"), F.max("level").alias("top"))
    # a short word has fewer classes: the widest is the last of STEMS always
    left = F.col("top") - F.col("level") + 1
    return free.withColumn("left", left).select("term", F.when(F.col("level").isNull(), 0).otherwise(letters).alias("letters"))


def scan(docs: DataFrame, terms: _Marks) -> DataFrame:
    """Base spans and words that may be terms, per row; no texts.  ``terms``: of terms and all their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.read()
        any_wanted, words = bool(wanted.any()), _Wanted(wanted).words
        for b in slices(batches):
            spans, hits = [], []
            for t in b.column(1).to_pylist():
                found, some = base_spans(t), []
                if any_wanted and (here := words(t)[1]):
                    touched = _touched(found)
                    for m in _TERM.finditer(t):
                        if m[0] in here and not touched(*m.span()):
                            some.append({"term": here[m[0]], "start": m.start(), "end": m.end()})
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                hits.append(some)
            yield table(_FOUND, b.column(0), b.column(2), spans, hits)

    return _hashed(docs).mapInArrow(run, _FOUND_DDL)


_SPANS = "array<struct<kind:string,start:int,end:int,letters:int>>"


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, text_hash, spans (array of kind, start, end and, of terms, letters that may stay; in order)."""
    ladder = stored(judged(docs, threshold), "pii-ladder")
    terms = stored(letters_left(ladder), "pii-terms")
    found = stored(scan(docs, _Marks(ladder.select("class"))).withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    hits = found.select("row", F.explode("hits").alias("x")).select("row", "x.term", "x.start", "x.end")
    more = hits.join(terms, "term").select("row", "start", "end", "letters")
    more = more.groupBy("row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "letters")).alias("more"))
    listed = F.array(*map(F.lit, KINDS))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("letters")))
    all_ = F.concat(base.cast(_SPANS), F.coalesce(F.col("more").cast(_SPANS), F.expr(f"cast(array() as {_SPANS})")))
    keyed = F.transform(all_, lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["letters"].alias("letters")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["letters"].alias("letters")))
    return found.drop("hits").join(more, "row", "left").select("doc_id", "text_hash", ordered.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and texts of the spans of each row."""
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts[:4], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), counts[4])


def replaced(text: str, spans: list) -> str:
    """``text`` with each run of overlapping spans replaced by what its first is: a kind, or a term's wider class."""
    out, at = [], 0
    for kind, a, b, letters in spans:
        if a >= at:
            out += [text[at:a], f"{text[a : a + letters]}*" if letters else f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns and null texts as they are.

    Where there is an ``n_chars`` column it follows the new text.
    """
    h, i, s = (free_name(docs, x) for x in ("text_hash", "id_of_spans", "spans"))
    spans = detect(docs, threshold).where(F.size("spans") > 0).select(F.col("text_hash").alias(h), F.col("doc_id").alias(i), F.col("spans").alias(s))
    spans = spans.dropDuplicates([h, i])

    @F.pandas_udf("string")
    def put(text, found):
        import pandas as pd

        one = lambda t, s: t if s is None else replaced(t, [(x["kind"], x["start"], x["end"], x["letters"]) for x in s])
        return pd.Series([one(t, s) for t, s in zip(text, found)], dtype=object)

    key = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    out = docs.join(spans, key, "left").withColumn("text", F.when(F.col(s).isNull(), F.col("text")).otherwise(put("text", s)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
