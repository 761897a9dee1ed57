"""Every registered query with its production parameters against plain versions, over a table of all kinds of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from netspark.llm import media, pii
from netspark.llm.queries import ORACLE_SQL, QUERIES
from netspark.llm.tokens import tokenizer_path
from tests.llm.cases import rows, sentence
from tests.llm.test_substrings import brute
from tests.llm.test_text_models import plain_spans
from tests.llm.test_tokens_dedup_pack import components, naive_fp

LONG = "a passage that stands in several documents and is longer than four hundred bytes " * 6
MORE = [sentence(300, 5), LONG + "one", "two " + LONG, "-" * 5000, "0" * 5000 + ".0.0.0", "mail a@b.org, 10.1.2.3 +46 31 123 45 67 4111 1111 1111 1111", "½", "Ⅷ", "w" * 3000]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    from tests.llm.cases import SCHEMA

    data = [r for r in rows() if r[0] is not None] + [(1000 + i, t, "sv" if i % 2 else "en", "s", len(t), "clash", "clash", 1) for i, t in enumerate(MORE)]
    data = list({r[0]: r for r in data}.values())
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2) for r in data], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, [(r[0], r[1] or "") for r in data]


def run(spark, table, name):
    return QUERIES[name](spark, table[0]).collect()


def ids_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t, lambda x: t.encode(x, add_special_tokens=False).ids


pack = lambda ids: np.array(ids, "<u4").tobytes()


def test_op1(spark, table):
    _, ids = ids_of("byte_bpe_50k.json")
    start, want = 0, []
    for d, t in sorted(table[1]):
        x = [*ids(t), 2]
        want.append((d, start, len(x), zlib.crc32(pack(x))))
        start += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, table, "op1_token_output")) == want


def test_op2(spark, table):
    want = dict(zip((d for d, _ in table[1]), brute([t.encode() for _, t in table[1]], 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, table, "op2_suffix_dedup")} == want
    assert sum(w[1] > 0 for w in want.values()) > 3


def test_op3_and_op8(spark, table):
    got = run(spark, table, "op3_toxicity")
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in table[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    got = {r.doc_id: r for r in run(spark, table, "op8_language")}
    for d, t in table[1]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1
        assert got[d].lang_pred in (("en", "sv") if any(map(str.isalpha, t)) else ("und",))


def test_op4(spark, table):
    tok, ids = ids_of("byte_bpe_50k.json")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(ids(t)), sha(pack(ids(t))), sha(tok.decode(ids(t), skip_special_tokens=False).encode())) for d, t in table[1]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, table, "op4_bpe_roundtrip")} == want


def test_op5(spark, table):
    _, ids = ids_of("word_bpe_49k.json")
    want = Counter()
    for d, t in table[1]:
        x = [*ids(t), 1]
        want.update((d, k, a, len(x[a : a + 4096]), zlib.crc32(pack(x[a : a + 4096]))) for k, a in enumerate(range(0, len(x), 4096)))
    got = run(spark, table, "op5_packing")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for s in spots.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_op6(spark, table):
    for r in run(spark, table, "op6_pii"):
        base = plain_spans(dict(table[1])[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS[:4]]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == (shown.split(",") if shown else [])


def test_op7(spark, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{table[0]}/documents.parquet/*.parquet'")
    got = QUERIES["op7_exact_dedup"](spark, table[0])
    want = con.execute(ORACLE_SQL["op7_exact_dedup"])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_op9(spark, table):
    fps = {d: naive_fp(t) for d, t in table[1]}
    least = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, table, "op9_simhash")} == {d: (f"{fps[d]:016x}", least[d]) for d in fps}


def test_op10(spark, table):
    got = {r.doc_id: r for r in run(spark, table, "op10_media")}
    for d, t in table[1]:
        raw = t.encode()
        full = raw.ljust(64 * max(1, -(-len(raw) // 64)), b"\0")
        (file,) = media.encode_many([raw])
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    same = defaultdict(set)
    for d, t in table[1]:
        same[t].add((got[d].feature, got[d].media_sha256))
    assert all(len(x) == 1 for x in same.values()) and len({f for x in same.values() for f, _ in x}) > 5


def test_pipeline(spark, table):
    got = corpus_pipeline.run(spark, table[0]).collect()
    kept = {r.doc_id for r in got}
    texts = dict(table[1])
    assert kept and all(any(map(str.isalpha, texts[d])) for d in kept)
    shingled = [re.sub(r"[A-Z]", lambda m: m[0].lower(), texts[d]) for d in kept]
    assert len(set(shingled)) == len(shingled)
