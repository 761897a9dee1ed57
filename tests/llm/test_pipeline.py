import random

import numpy as np
import pytest

import corpus_pipeline
from netspark.llm import near
from tests.llm.cases import SCHEMA, sentence


def test_stages_take_effect(spark, tmp_path):
    base = [sentence(150 + i, 5 + i) for i in range(12)]
    out = [(i, t, "en", "s", len(t), "x", "y", 1) for i, t in enumerate(base)]
    out += [(100, base[0].upper(), "en", "s", 1, "x", "y", 1), (101, base[1] + " end.", "en", "s", 1, "x", "y", 1)]
    out += [(102, None, "en", "s", None, "x", "y", 1), (103, "12 !!", "en", "s", 5, "x", "y", 1), (104, "write to someone@example.org " + sentence(90, 3), "en", "s", 9, "x", "y", 1)]
    spark.createDataFrame(out, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns
        docs = spark.createDataFrame(done.collect(), SCHEMA)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 102 not in seen["language_id"] and 103 not in seen["language_id"] and len(seen["language_id"]) == 15
    assert 0 not in seen["exact_dedup"] and 100 in seen["exact_dedup"]
    assert 1 in seen["simhash"] and 101 not in seen["simhash"]
    assert "<EMAIL>" in seen["pii"][104] and "someone@" not in seen["pii"][104]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_reaches_a_similarity_of_0_8(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out, i = [], 0
    for base in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(120, 300))]
        out.append((1000 * base, " ".join(t)))
        for changed in (1, 2, 3, 5, 8):
            other = list(t)
            for at in rng.sample(range(len(t)), changed):
                other[at] = rng.choice(words)
            out.append((1000 * base + changed, " ".join(other)))
    out += [(None, out[0][1] + " tail"), (None, "alone under the null id stays where it is"), (7, "same id one two three"), (7, "other words with that id again")]
    docs = spark.createDataFrame(out, "doc_id long, text string")
    shingles = [set(zip(*(t.lower().split()[i:] for i in range(5)))) for _, t in out]
    leader = list(range(len(out)))

    def root(x):
        while leader[x] != x:
            x = leader[x]
        return x

    near = 0
    for a in range(len(out)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both / (len(shingles[a]) + len(shingles[b]) - both) >= 0.8:
                near += 1
                leader[root(a)] = root(b)
    groups = {}
    for x in range(len(out)):
        groups.setdefault(root(x), []).append(out[x])
    want = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)
    assert near > 100 and len(want) < len(out) - 60
    assert sorted(map(tuple, corpus_pipeline.near(spark, docs, "").collect()), key=str) == want


def _alike(n: int, rng: random.Random) -> list[str]:
    """Texts whose similarity to each other lies about 0.67, with a linked pair now and then."""
    base, out = [f"b{i}" for i in range(200)], []
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(200), 4):
            t[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
        if i % 20 == 0:
            out.append(" ".join([*t[:-1], "other"]))
    return out


def _leaders(texts: list[str], similarity: float) -> list[int]:
    found, leader = [near.shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(found[a] & found[b])
            if both / (len(found[a]) + len(found[b]) - both) >= similarity:
                leader[root(a)] = root(b)
    return [root(x) for x in range(len(texts))]


@pytest.mark.parametrize("tile", [1 << 18, 5000])
def test_alike_texts_give_no_row_a_pair(spark, monkeypatch, tile):
    rows, whole = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df, name, *a: rows.append(whole(df, name, *a)) or rows[-1])
    monkeypatch.setattr(near, "TILE", tile, raising=False)
    texts = _alike(400, random.Random(8))
    leaders = _leaders(texts, 0.8)
    kept = near.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(kept) == len(set(leaders)) < len(texts)
    assert max(df.count() for df in rows) <= near.KEYS * len(texts)  # pairs would be 88,000


def test_fingerprints_and_pivot_tables_of_the_near_stage():
    """Pairs of 0.8 lie within the radius, and the tables discard only pairs beyond it."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(3)
    fp = lambda names: near.fingerprint(np.array([xxh64_intdigest(str(x)) for x in names], np.uint64))
    for size, own in ((4, 1), (8, 1), (80, 10), (400, 50)):
        for _ in range(200):
            common = list(rng.integers(0, 2**60, size))
            a, b = common + list(rng.integers(0, 2**60, own)), common + (list(rng.integers(0, 2**60, own)) if size > 8 else [])
            assert len(common) / (len(a) + len(b) - len(common)) >= 0.8
            assert np.bitwise_count(fp(a) ^ fp(b)).sum() <= near.radius(0.8, len(b) <= near.FEW)
    fps = rng.integers(0, 2**64, (60, near.WORDS), np.uint64)
    fps[30:] = fps[:30] ^ np.uint64(5)
    n, tabled = np.full(60, 100), near.distance_table(fps)
    assert tabled.shape[1] == near.PIVOTS
    assert sorted((int(x), int(y)) for x, some in near.forest(fps, n, 0.8) for y in some) == [(i, i + 30) for i in range(30)]
    for i in range(60):
        assert (np.abs(tabled - tabled[i]).max(1) <= near.distances(fps, fps[i])).all()
