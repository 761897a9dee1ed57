import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from netspark.llm import exact_dedup, near, packing, roundtrip, simhash, token_output
from netspark.llm.tokens import PieceEncoder, tokenizer_path
from tests.llm.cases import TEXTS, frames, rows

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def plain(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_library():
    for path, lower in ((BYTE, False), (WORD, True)):
        enc, ref = PieceEncoder(path, lower=lower, memo=50), plain(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(TEXTS)] == [ref(t) for t in TEXTS]


def test_splitting_rules_agree_with_the_library_on_random_texts():
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\t", "\r", "'", "'s", "'re", "'ll", "'v", "r", "e", "s", "t", "é", "ß", "1", "23", "½", "²"]
    parts += [".", ",", "!", "-", "‐", "‧", "¡", "<", "|", "Word", "ª", "×", "µ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(5000)]
    for path, lower in ((BYTE, False), (WORD, True)):
        enc, ref = PieceEncoder(path, lower=lower, memo=300), plain(path)
        for k in range(0, len(texts), 64):
            some = texts[k : k + 64]
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(some)] == [ref(t) for t in some]


def test_tree_concatenation_is_exact():
    rng = np.random.default_rng(1)
    enc, ref = PieceEncoder(BYTE, long=16, leaf=5), plain(BYTE)
    for alphabet in ("ab", "theinrs", "éàthe日", "=-", "0123456789"):
        for n in (16, 17, 40, 333, 2000):
            t = "".join(rng.choice(list(alphabet), n))
            assert enc.tree(t) == ref(t)


def test_decode_as_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    docs, empty = frames(spark)
    got = {(r.doc_id, bytes(r.ids)): bytes(r.decoded).decode() for r in roundtrip.encode_decode(docs, BYTE).collect()}
    for r in rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0], np.array(ids, "<u4").tobytes()] == tok.decode(ids, skip_special_tokens=False)
    assert roundtrip.digests(empty, BYTE).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300, 5000):
        v = np.cumsum(rng.integers(0, 900, n))
        ef = token_output.EliasFano.from_bytes(token_output.EliasFano.of(v).to_bytes())
        assert ef.select_many(np.arange(n)).tolist() == v.tolist()
        assert [ef.select(i) for i in range(0, n, 7)] == v[::7].tolist()
    for v in ([0], [5] * 700, [0] * 600 + [2**62], [3, 2**63 + 5, 2**64 - 1], []):
        ef = token_output.EliasFano.from_bytes(token_output.EliasFano.of(np.array(v, np.uint64)).to_bytes())
        assert ef.select_many(np.arange(len(v))).tolist() == v
    for ids in ([None, None, -5, 0, 7, 7, 2**63 - 1], [None], [-(2**63), 2**63 - 1], []):
        assert token_output.ids_at(*token_output.code_ids(ids), np.arange(len(ids))) == ids
    assert len(token_output.EliasFano.of(np.cumsum(np.full(10_000, 1000))).to_bytes()) < 10_000 * 2


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_token_output(spark, size):
    docs, empty = frames(spark)
    shards = token_output.write_shards(docs, BYTE, 2, size)
    got = sorted(token_output.read_places(shards).collect(), key=lambda r: r.start)
    ref, start = plain(BYTE), 0
    left = Counter((r[0], tuple([*ref(r[1]), 2])) for r in rows())
    by_crc = {(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())): (d, i) for d, i in left}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda x: -1 if x is None else x)
    for r in got:
        assert r.start == start
        left[by_crc[r.doc_id, r.n_tokens, r.ids_crc32]] -= 1
        start += r.n_tokens
    assert not any(left.values())
    row = shards.first().asDict()
    assert token_output.read_document(row, 0)[-1] == 2
    assert token_output.read_places(token_output.write_shards(empty, BYTE)).count() == 0


def test_exact_dedup(spark):
    docs, empty = frames(spark)
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").encode().lower()].append(r[0])
    want = Counter()
    for k, ids in groups.items():
        best = max(i for i in ids if i is not None)
        want.update((i, best, len(ids), i == best, hashlib.sha256(k).hexdigest()) for i in ids)
    assert Counter(tuple(r) for r in exact_dedup.content_groups(docs).collect()) == want
    assert exact_dedup.content_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(docs).columns == docs.columns


def test_null_and_repeated_ids_lose_no_text_and_leave_no_copy(spark):
    out = [(None, "only null ids"), (None, "ONLY null ids"), (None, "beside a number"), (4, "beside a number"), (9, "twice"), (9, "twice"), (None, "alone")]
    docs = spark.createDataFrame(out, "doc_id long, text string")
    for keep in ("min", "max"):
        got = Counter(r.text.lower() for r in exact_dedup.exact_dedup(docs, keep).collect())
        assert got == Counter(["only null ids", "beside a number", "twice", "alone"])
        assert (4, "beside a number") in set(map(tuple, exact_dedup.exact_dedup(docs, keep).collect()))
        groups = exact_dedup.content_groups(docs, keep).collect()
        assert sum(r.kept for r in groups if r.keep_id is None) == 2
    assert Counter(r.text.lower() for r in simhash.one_of_each(docs).collect()) == got


def test_groups_that_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_fold", one_row_each)
    docs = spark.range(4000).repartition(7).selectExpr("if(id = 17, null, id) doc_id", "case when id % 3 = 0 then 'Same' when id % 3 = 1 then concat('t', id % 50) else concat('u', id) end text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = defaultdict(list)
    for d, t in texts.items():
        want[t.lower()].append(d)
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup.content_groups(docs, keep).collect()
        assert len(got) == 4000
        for r in got:
            ids = want[texts[r.doc_id].lower()]
            assert (r.group_size, r.keep_id) == (len(ids), pick((x for x in ids if x is not None), default=None))
        assert sum(r.kept for r in got) == len(want) == exact_dedup.exact_dedup(docs, keep).count()


def one_row_each(batches):
    """As ``_fold``, but every row is a local group: a common text then has as many as it has rows."""
    from pyspark import TaskContext

    from netspark.llm.common import slices, table

    at = TaskContext.get().partitionId() << 36
    for b in slices(batches, 500):
        norm = [t.encode().lower() for t in b.column(1).to_pylist()]
        yield table(exact_dedup._LOCAL, range(at, at + b.num_rows), [[i] for i in b.column(0).to_pylist()], [[r] for r in b.column(2).to_pylist()], norm, [hashlib.sha256(x).hexdigest() for x in norm])
        at += b.num_rows


def test_hot_group_is_whole(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) text")
    got = exact_dedup.content_groups(docs)
    assert got.where("group_size = 10000 and keep_id = 29997").count() == 10_000 and got.where("kept").count() == 20_001


def naive_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash(spark):
    docs, empty = frames(spark)
    docs = docs.where("doc_id is not null")
    fps = {r[0]: naive_fp(r[1] or "") for r in rows() if r[0] is not None}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((r[0], fps[r[0]], want[r[0]]) for r in rows() if r[0] is not None)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns
    every, _ = frames(spark)
    assert Counter((r.doc_id, r.fp % 2**64) for r in simhash.near_duplicates(every).collect()) == Counter((r[0], naive_fp(r[1] or "")) for r in rows())
    assert {r.component_id for r in simhash.near_duplicates(every).collect() if r.doc_id is None} == {want[3]}
    clash = every.withColumnRenamed("ids", "row_number").withColumnRenamed("part", "Row_Number_")
    for f in (simhash.one_of_each, exact_dedup.exact_dedup, near.one_of_each):
        assert f(clash).columns == clash.columns and f(clash).count() > 0 and f(clash.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_against_brute_force(spark, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = base[rng.integers(0, 30, 400)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) * rng.integers(0, 2, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [(r.u, r.v) for r in simhash.links(df, radius).collect()]
    ids = fps.view(np.int64).tolist()
    full = [(a, b) for a in ids for b in ids if a < b and ((a ^ b) % 2**64).bit_count() <= radius]
    assert {tuple(sorted(p)) for p in got} <= set(full)
    assert components(ids, got) == components(ids, full)


def test_packing(spark):
    docs, empty = frames(spark)
    docs = docs.unionByName(spark.range(100, 400).selectExpr("id doc_id", "repeat('word and ', cast(id * id % 700 as int)) text", "'' lang", "'' source", "0L n_chars", "'' ids", "'' norm", "0 part"))
    ref = plain(WORD)
    got = packing.pack_documents(docs, WORD, 1, 256, part=80).collect()
    places, per_doc = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for spots in places.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= 256
    bound = packing.lower_bound(np.array([r.length for r in got]), 256)
    from pyspark.sql import SparkSession

    whole = SparkSession.getActiveSession().createDataFrame([(r.length, r.sequence_id, r.offset) for r in got], "length long, sequence_id long, offset long")
    assert packing.gap(whole, 256) == (len(places), bound) and packing.gap(whole.limit(0), 256) == (0, 0)
    assert bound <= len(places) <= 1.01 * bound + 1
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*ref(r.text), 1]
        want[r.doc_id] += [(k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert {d: sorted((x.piece, x.start, x.length, x.ids_crc32) for x in xs) for d, xs in per_doc.items()} == {d: sorted(x) for d, x in want.items()}
    assert packing.pack_documents(empty, WORD).count() == 0


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, filled = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(filled) and filled.max() <= 100
    assert packing.lower_bound(np.array([51, 51, 51, 49]), 100) == 3
