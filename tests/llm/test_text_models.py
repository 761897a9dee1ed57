import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.llm import language, media, pii, toxicity
from tests.llm.cases import TEXTS, frames, rows

# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def plain_spans(t):
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("ab@.@-+ 1123()4.5 -", "0123456789. -+", "a@b.c@d._%+- "):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t
    t = "card 4111 1111 1111 1111, mail é.x@y-z.org, 10.0.0.1, +46 (31) 123-45-67"
    assert [k for k, *_ in pii.base_spans(t)] == ["card", "email", "ip", "phone"]


def test_linear_on_long_runs():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+1" * 50_000, "@" * 100_000, "1 " * 100_000, "0" * 200_000 + ".0.0.0", "0" * 5000 + "1.0.0.0"):
        pii.base_spans(t)
    assert pii.base_spans("0" * 5000 + ".0.0.0") == [("ip", 0, 5006)] and pii.base_spans("0" * 5000 + "256.0.0.0") == []


def seconds(f, *args):
    best = 9e9
    for _ in range(3):
        began = time.perf_counter()
        f(*args)
        best = min(best, time.perf_counter() - began)
    return best


def test_contexts_are_linear_in_spans():
    def run(n):
        t = " ".join(f"some words a{i}@b{i}.org" for i in range(n))
        return seconds(lambda: sum(1 for _ in pii.contexts(t, pii.base_spans(t))))

    assert run(4000) < 9 * run(1000)


def plain_judged(texts, threshold=pii.THRESHOLD):
    """(entity, class): what discloses, from sets of texts, without hashes, bitmaps or tasks."""
    texts = {t or "" for t in texts}
    has, near, where, of = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]{4,}", t)):
            for c in pii.classes(w.lower()):
                has[c].add(t)
        for entity, word, context in pii.contexts(t, pii.base_spans(t)):
            of[entity].add(t)
            for c in pii.classes(word):
                near[entity, c].add(t)
                where[entity, c].add(context)
    out = set()
    for (entity, c), found in near.items():
        own = min(len(found), len(where[entity, c]))
        hits, n = own - 1, max(1e-9, own * len(has[c]) / len(found) - 1)
        p, z2 = min(1, hits / n), pii.Z**2
        low = (p + z2 / 2 / n - pii.Z * math.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n)
        ic = -math.log(min(0.5, len(of[entity]) / max(2, len(texts))))
        if hits > 0 and 1 + math.log(max(low, 1e-300)) / ic >= threshold:
            out.add((entity, c))
    return out, near


def test_disclosure_against_brute_force(spark):
    rng = random.Random(8)
    syllables = "ba ke li mo nu ra so ti vu zy".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(300)]
    texts = []
    for i in range(700):
        t = [rng.choice(words) for _ in range(rng.randint(3, 30))]
        if i % 5 == 0:
            k = rng.randrange(6)
            t += [f"person{'abcdef'[k]}", f"p{k}@corp.com", rng.choice(words)]
        texts.append(" ".join(t))
    texts += texts[:60] + [None, ""]
    for threshold in (0.9, 0.4):
        want, near = plain_judged(texts, threshold)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        told = {(r.entity, r.term, r.level): r.tells for r in pii.judged(docs, threshold).collect()}
        sign = pii._sign
        expect = {}
        for entity, c in want:
            if "*" not in c:
                for level, x in enumerate(pii.classes(c)):
                    expect[entity, sign(c), level] = (entity, x) in want
        assert told == expect and len(told) > 5
        letters = {r.term: r.letters for r in pii.letters_left(pii.judged(docs, threshold)).collect()}
        for term in {c for _, c in want if "*" not in c}:
            holders = [e for e, c in want if c == term]
            stay = [x for x in pii.classes(term)[1:] if not any((e, x) in want for e in holders)]
            assert letters[sign(term)] == (len(stay[0]) - 1 if stay else 0)


def test_revealing_terms(spark):
    out = [(i, f"note {i} alpha{'x' * (i % 7)} Zorblatt mail boss@corp.com about thing{'y' * (i % 5)} {'w' * (4 + i)}") for i in range(12)]
    out += [(100 + i, f"plain text about common words and thing number {'v' * (4 + i)}") for i in range(300)]
    out += [(500 + i, "copied Frobnitz text tells x@y.org every time") for i in range(50)]
    docs = spark.createDataFrame(out, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.detect(docs).collect()}
    for i, t in out[:12]:
        assert ("term", t.index("Zorblatt"), t.index("Zorblatt") + 8) in found[i]
    assert not any(k == "term" for s in [found[500], found[100]] for k, *_ in s)  # copies are no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "<EMAIL>" in clean[0] and "Zorblatt" not in clean[0] and clean[100] == out[12][1]


def plain_corpus(n):
    return [(10_000 + i, f"plain text about common words and thing number {'v' * (4 + i % 900)} {i}") for i in range(n)]


def term_spans(spark, rows_):
    found = pii.detect(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    texts = dict(rows_)
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} for r in found}


def test_terms_of_few_contexts_are_judged(spark):
    few = [(i, f"{'abcd'[i] * 5} Zorblatt mail boss@corp.com about {'efgh'[i] * 6}") for i in range(4)]
    got = term_spans(spark, few + [(10, "seen once Frobnitz beside lone@corp.com only")] + plain_corpus(4000))
    assert all("Zorblatt" in got[i] for i in range(4)) and not got[10] and not any(got[i] for i in got if i >= 10_000)


def test_copies_neither_clear_nor_convict_a_term(spark):
    few = [(-1000 * k - i - 1, f"{'abcde'[i] * 5} Zorblatt mail boss@corp.com about {'fghij'[i] * 6}") for i in range(5) for k in range(40)]
    got = term_spans(spark, few + [(900 + i, "copied Frobnitz text tells x@y.org every time") for i in range(50)] + plain_corpus(4000))
    assert all("Zorblatt" in got[d] for d, _ in few) and not got[900]


def test_terms_are_marked_wherever_they_stand(spark):
    few = [(i, f"{chr(97 + i) * 5} Zorblatt mail boss@corp.com about {chr(97 + i) * 6} " + "plain words " * 30 + "zorblatt again") for i in range(20)]
    docs = few + [(50, "without any address ZORBLATT stands here")] + plain_corpus(4000)
    got = term_spans(spark, docs)
    assert all({"Zorblatt", "zorblatt"} <= got[i] for i in range(20)) and got[50] == {"ZORBLATT"}
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[50] == "without any address <TERM> stands here" and "orblatt" not in clean[0]


def test_terms_are_generalised_before_they_are_removed(spark):
    few = [(i, f"{chr(97 + i) * 5} Zorblatt words boss@corp.com about {chr(97 + i) * 6}") for i in range(20)]
    docs = few + plain_corpus(4000) + [(50_000 + i, f"a word like zorbing{'x' * (i % 40)} number {i}") for i in range(400)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[0] == "aaaaa Zorb* words <EMAIL> about aaaaaa" and clean[50_000] == "a word like zorbing number 0"


def test_pii_rows(spark):
    docs, empty = frames(spark)
    got = Counter((r.doc_id, r.base_sha256) for r in pii.digest(pii.detect(docs)).collect())
    sha = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")).encode()).hexdigest()
    assert got == Counter((r[0], sha(r[1])) for r in rows())
    clash = docs.selectExpr("*", "1 as text_hash", "2 as id_of_spans", "'x' as spans")
    assert pii.sanitise(clash).columns == clash.columns and pii.sanitise(clash).count() == len(rows())
    assert pii.detect(empty).count() == 0 and pii.sanitise(docs).count() == len(rows()) and pii.sanitise(empty).count() == 0


# ---- toxicity


def brute_segments(s):
    """Maximal scoring segments by their definition: best segment, then both sides of it."""
    out = []

    def split(lo, hi):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best and best[0] > 1e-9:
            a, b = best[3:]
            out.append((a, b - 1, round(best[0], 6)))
            split(lo, a)
            split(b, hi)

    split(0, len(s))
    return sorted(out)


def test_segments_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        score = np.where(rng.random(n) < 0.25, rng.integers(1, 9, n) * 0.37, -0.5)
        at = np.flatnonzero(score > 0)
        got = sorted((a, b, round(v, 6)) for a, b, v in toxicity.segments(at, score[at], 0.5))
        assert got == brute_segments(score.tolist())


def test_segments_are_linear():
    def run(n):
        return seconds(toxicity.segments, np.arange(n) * 20, np.full(n, 1.0), 0.1)

    assert run(64_000) < 10 * run(16_000)


def plain_learn(rows_):
    """The whole of learning without Spark: counts of distinct pairs, bounds, lambda, values, logistic curve."""
    pairs = [{(a, b) for t, k in rows_ if k == kind for w in [re.findall(r"\w+", t.lower())] for a, b in zip(["", *w], w)} for kind in (0, 1)]
    counts, n = [Counter(b for _, b in p) for p in pairs], [len(p) for p in pairs]

    def odds(t, c):
        out = {}
        for w, k in t.items():
            if k >= toxicity.SUPPORT:
                x, y = k + 0.5, c[w] + 0.5
                s = math.log(x / (n[1] + 1 - x)) - math.log(y / (n[0] + 1 - y)) - 2 * math.sqrt(1 / x + 1 / y)
                if min(s, 8) >= 1.2:
                    out[w] = min(s, 8)
        return out

    words, stems = odds(counts[1], counts[0]), {}
    for size in (6, 5, 4):
        parts = [Counter() for _ in range(2)]
        for kind in (0, 1):
            for w, m in counts[kind].items():
                if len(w) >= size:
                    parts[kind][w[:size]] += m
        stems |= odds(parts[1], parts[0])
    score = lambda w: max(words.get(w, 0), 0, *(stems.get(w[:k], 0) for k in (6, 5, 4) if len(w) >= k))
    seen = Counter()
    for w, m in counts[0].items():
        if score(w):
            seen[round(score(w), 1)] += m
    model = toxicity.Model(words, stems, toxicity.drift_rate(dict(seen), n[0] + 1), 0, 1)
    x = np.array([round(toxicity.value(t, model)[0], 2) for t, _ in rows_])
    y = np.array([k for _, k in rows_], float)
    a, b = toxicity.logistic(x, y, np.ones(len(x)))
    return model._replace(a=a, b=b)


def test_learning_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"{c}{i}lex" for i in range(60) for c in "abcd"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + (" vilest word Vileness" * rng.randint(0, 3) if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int")
    want, got = plain_learn([r[1:] for r in data]), toxicity.fit(docs, known)
    assert got.words == pytest.approx(want.words) and got.stems == pytest.approx(want.stems) and got.words
    assert (got.rate, got.a, got.b) == pytest.approx((want.rate, want.a, want.b), rel=1e-3)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, got).collect()}
    for i, t, _ in data:
        x = toxicity.value(t, want)[0]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(want.a + want.b * x))), abs=1e-3)
    few = toxicity.fit(docs, known, per_class=20)
    assert few is None or len(few.words) <= len(got.words)


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    bad = ["vile", "scumword", "trashword"]
    out, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randint(0, len(t)), rng.choice(bad))
        out.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_held_out(docs, known).join(known, "doc_id").where("held_out").collect()
    assert len(got) > 200 and all(r.predicted == r.toxic for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    case, empty = frames(spark)
    model = toxicity.fit(docs, known)
    assert toxicity.score(case, model).where("score between 0 and 1").count() == len(rows())
    short = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(0, None), (1, ""), (2, "Hello"), (3, "w1 w2 w3"), (4, "?!"), (5, "scumword vile"), (6, " ".join(words))], "doc_id long, text string"), model).collect()}
    assert len({short[i] for i in (0, 1, 2, 3, 4, 6)}) == 1 and short[0] < 0.2 and short[5] > short[0] == min(short.values())
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(docs, known.where("toxic = 0")) is None
    assert toxicity.score(case, None).agg(F.max("score")).first()[0] == 0


# ---- language


def test_language_held_out(spark):
    sounds = {"xx": "ba be bi bo bu".split(), "yy": "kra kre kri krü kro".split(), "zz": "ño ña ñe ñi lu".split()}
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(600):
        k = "xyz"[i % 3] * 2
        out.append((i, " ".join(word(k) for _ in range(rng.randint(5, 60))), k))
    out += [(1000, None, "xx"), (1001, "12 34 --", "yy"), (1002, "", None), (1003, "\u00bd \u00b2", "xx"), (1004, "\u2167", None)]
    docs = spark.createDataFrame(out, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == k for i, _, k in out[:600])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(1000, 1005))
    langs, logp = language.fit(docs)
    mixed = " ".join([word("xx") for _ in range(60)] + [word("yy") for _ in range(30)])
    share = language.proportions(language.trigrams(mixed), logp)
    assert share[langs.index("xx")] > 0.5 and share[langs.index("yy")] > 0.15 and share[langs.index("zz")] == 0
    assert language.known_only(docs, (langs, logp)).count() == 600
    case, empty = frames(spark)
    assert language.identify(case).count() == len(rows()) and language.identify(empty).count() == 0


def plain_mixture(text, logp, penalty):
    """Expectation-maximisation over every single trigram, and the penalised choice of languages by plain loops."""
    codes = language.trigrams(text).tolist()
    p = np.exp(logp)

    def em(cols, pi):
        for _ in range(12 if len(cols) > 1 else 0):
            new = [0.0] * len(cols)
            for c in codes:
                mix = sum(w * p[c, k] for w, k in zip(pi, cols))
                for j, k in enumerate(cols):
                    new[j] += pi[j] * p[c, k] / mix
            pi = [x / len(codes) for x in new]
        return pi, sum(math.log(sum(w * p[c, k] for w, k in zip(pi, cols))) for c in codes)

    cols = list(range(p.shape[1]))
    pi, best = em(cols, [1 / len(cols)] * len(cols))
    while len(cols) > 1:
        drop = pi.index(min(pi))
        less = [k for j, k in enumerate(cols) if j != drop]
        rest = [x for j, x in enumerate(pi) if j != drop]
        new, value = em(less, [x / sum(rest) for x in rest] if len(less) > 1 else [1.0])
        if best - value > penalty + 0.5 * math.log(len(codes)):
            break
        cols, pi, best = less, new, value
    out = np.zeros(p.shape[1])
    out[cols] = pi
    return out


def test_mixture_against_brute_force():
    rng = np.random.default_rng(9)
    words = [["ba", "bi", "bo"], ["kra", "kri"], ["\u00f1o", "lu", "ba"], ["zu", "wei"]]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    counts = np.stack([np.bincount(language.trigrams(text(k, 500)), minlength=language.BINS) for k in range(4)], 1)
    logp = np.log((counts + 0.5) / (counts + 0.5).sum(0))
    seen = set()
    for parts in ((0,), (1, 2), (0, 2), (0, 1, 2, 3), (3, 3, 1)):
        t = " ".join(text(k, int(rng.integers(3, 40))) for k in parts)
        for penalty in (0.5, 30.0):
            got, want = language.proportions(language.trigrams(t), logp, penalty), plain_mixture(t, logp, penalty)
            assert got == pytest.approx(want, abs=1e-6)
            seen.add(int((want > 0).sum()))
    assert len(seen) > 1
    long = "ba kri \u00f1o " * 60_000
    assert [x.tolist() for x in language.counted(long)] == [x.tolist() for x in np.unique(language.trigrams(long), return_counts=True)]


def test_bounded_sample(spark):
    from netspark.llm.common import first_by_hash

    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 10 = 0, 'few', 'many') as lang").unionByName(spark.createDataFrame([(None, None)], "doc_id long, lang string"))
    got = Counter(r.lang for r in first_by_hash(docs, "doc_id", "lang", 100).collect())
    assert got == {"few": 100, "many": 100}
    assert first_by_hash(docs, "doc_id", "lang", 4000).count() == 4500


# ---- media


def test_media_round_trip():
    rng = np.random.default_rng(0)
    texts = [(t or "").encode() for t in TEXTS] + [b"\0" * 200, b"x" + b"\0" * 40 + b"y", bytes(range(256)) * 3, b"\xff" * 130]
    for _ in range(150):
        a = rng.integers(0, 256, int(rng.integers(0, 400)))
        a[rng.random(len(a)) < rng.random()] = 0
        texts.append(a.astype(np.uint8).tobytes())
    files = media.encode_many(texts)
    for t, (f, c) in zip(texts, media.decode_many(files)):
        raw, n = media.payload(f, c)
        assert n == len(t) and raw == t.ljust(64 * max(1, -(-len(t) // 64)), b"\0")
    assert media.encode_many(texts[:1]) == media.encode_many(texts)[:1]


def colour_jpeg(luma, interval=0):
    """A small baseline image with 2 x 2 subsampling: flat blocks of the given DC values, no AC."""
    import struct

    dc, ac = media.Huffman([[], [], list(range(12)), *[[] for _ in range(13)]][:2] + [[], list(range(12))] + [[] for _ in range(12)]), media.Huffman([[], [0x00]] + [[] for _ in range(14)])
    bits = ""
    high, wide = luma.shape
    pred = [0, 0, 0]
    n = 0
    parts = []

    def put(k, v):
        nonlocal bits
        d = v - pred[k]
        pred[k] = v
        size = int(abs(d)).bit_length()
        bits += f"{int(dc.code[size]):0{int(dc.bits[size])}b}"
        if size:
            bits += f"{d if d > 0 else d + (1 << size) - 1:0{size}b}"
        bits += f"{int(ac.code[0]):0{int(ac.bits[0])}b}"

    def close():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        parts.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
        bits = ""

    for r in range(0, high, 2):
        for c in range(0, wide, 2):
            if interval and n and n % interval == 0:
                close()
                pred[:] = [0, 0, 0]
            for i in (0, 1):
                for j in (0, 1):
                    put(0, int(luma[r + i, c + j]))
            put(1, 3)
            put(2, -4)
            n += 1
    close()
    scan = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    comps = bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + comps) + dc.segment(0) + ac.segment(0x10) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_colour_image_with_subsampling(interval):
    luma = np.random.default_rng(interval).integers(-200, 200, (4, 6))
    (frame, c), = media.decode_many([colour_jpeg(luma, interval)])
    assert media.thumbnail(frame, c).tolist() == np.clip((2 * luma + 4) // 8 + 128, 0, 255).tolist()


def test_broken_images():
    good = media.encode_many([b"hello" * 40])[0]
    for bad in (b"", b"no image", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-20] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            media.decode_many([bad])


def test_media_rows(spark):
    docs, empty = frames(spark)
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_features(docs).collect())
    pad = lambda t: t.ljust(64 * max(1, -(-len(t) // 64)), b"\0")
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    assert got == Counter((i, len(t), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-64:])) for i, t in texts)
    assert media.media_features(empty).count() == 0
    assert io.BytesIO(media.encode_many([b"a"])[0]).read(2) == b"\xff\xd8"
