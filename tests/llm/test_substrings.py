import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.llm import substrings
from tests.llm.cases import frames, rows


def brute(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n, alphabet):
    rng = np.random.default_rng(seed)
    new = lambda k: "".join(rng.choice(list(alphabet), k))
    passages = [new(int(k)) for k in rng.integers(60, 400, 6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            p = passages[rng.integers(0, 6)]
            a = int(rng.integers(0, len(p)))
            parts.append([new(int(rng.integers(0, 150))), p, p[a:], p[:a], "ab" * int(rng.integers(0, 90))][rng.integers(0, 5)])
        out.append("".join(parts))
    return out + out[:5] + ["", "z" * 500, "é" * 300]


@pytest.mark.parametrize("seed,alphabet,hot,batches", [(1, "abcdefgh ", 100_000, 4), (2, "ab", 100_000, 3), (3, "theéin ", 5, 4), (4, "abcde", 100_000, 1)])
def test_against_brute_force(spark, seed, alphabet, hot, batches):
    texts = corpus(seed, 60, alphabet)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(docs, 100, batches=batches, hot=hot).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 100)))


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    texts = [t.encode() for t in corpus(5, 25, "abcdef ")]
    texts.append(b"".join(texts))
    want = Counter()
    for t in texts:
        want.update(t[i : i + 100] for i in range(len(t) - 99))
    entries = defaultdict(list)
    for number, offset, held in substrings._chunks(texts, 100):
        sizes = np.array([len(x) for x in held])
        starts = np.cumsum(sizes) - sizes
        r = substrings.runs_of(np.frombuffer(b"".join(held), np.uint8), starts, starts + sizes, 100)
        stays, times, again = substrings.settled(r)
        kept = defaultdict(int)
        for i, n in zip(stays, times):
            kept[int(r["text"][i]), int(r["gram"][i]), int(r["u1"][i]), int(r["u2"][i])] = n
        every = Counter((int(t), int(g), int(a), int(b)) for t, g, a, b in zip(r["text"], r["gram"], r["u1"], r["u2"]))
        assert {k: min(2, n) for k, n in every.items()} == kept
        gone = {(t, x) for t, a, z in again for x in range(a, z + 1)}
        left = set(range(len(r["first"]))) - set(stays.tolist())
        assert gone == {(r["text"][i], x) for i in left for x in range(r["first"][i], r["last"][i] + 1)}
        for k, f, z, u in zip(r["text"], r["first"], r["last"], r["u1"]):
            a, z = f - starts[k] + offset[k], z - starts[k] + offset[k]
            entries[int(u)].append(texts[number[k]][a : z + 100])
            for i in range(a, z + 1):
                want[texts[number[k]][i : i + 100]] -= 1
    assert not any(want.values())  # every window of every text stands in exactly one run
    assert all(len(set(x)) == 1 for x in entries.values())


def test_every_kind_of_row(spark):
    docs, empty = frames(spark)
    texts = [(r[1] or "").encode() for r in rows()]
    got = Counter(tuple(r) for r in substrings.digests(docs, 100).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows(), brute(texts, 100)))
    assert substrings.digests(empty).count() == 0
    kept = {r.doc_id: (bytes(r.kept), r.removed) for r in substrings.remove_repeats(docs, 100).collect()}
    assert kept[3] == (b"Hello World", [])


def test_periodic_texts_give_few_rows(spark):
    texts = ["-" * 50_000, "abcdefg" * 5000, "x" * 399, "one two three four five " * 900, "-" * 450 + "!" + "-" * 450]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = substrings.runs(docs.withColumn("hash", F.xxhash64("text")), 400)
    assert made.count() < 150
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(docs, 400).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 400)))


def test_family_takes_batches_and_opens_again(spark, tmp_path):
    texts = corpus(7, 40, "abcdef ")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = substrings.runs(docs.withColumn("hash", F.xxhash64("text")), 100).cache()
    kept, plain = substrings.SuffixFamily(str(tmp_path)), substrings.SuffixFamily()
    for k in range(5):
        batch = made.where(F.pmod("doc_id", F.lit(5)) == k)
        if k:
            kept = substrings.SuffixFamily.open(spark, str(tmp_path))
            before = {tuple(r) for r in kept.entries().select(*substrings.ENTRY).collect()}
            new = {tuple(r) for r in substrings.SuffixFamily.array(batch).select(*substrings.ENTRY).collect()}
            assert {tuple(r)[:3] for r in kept.known(batch).collect()} == before & new
        kept.add(batch)
        plain.add(batch)
    assert sorted(kept.levels) == [0, 2] == sorted(plain.levels)
    want = Counter()
    for r in made.where("times > 0").collect():
        want[r.gram, r.u1, r.u2] += r.times
    for family in (kept, plain):
        assert {(r.gram, r.u1, r.u2): r.n for r in family.entries().collect()} == want
