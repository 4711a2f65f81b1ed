"""The registered queries over whole small tables against brute force, and the pipeline's stages on odd rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrystone.llm import matroska, queries, sharding, url_filter

from test_corpus_operators import components, prose
from test_text_operators import DOC, ODD, descend

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op5_components(spark, texts):
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] for i, t in texts.items()}
    sets = {i: frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset() for i, w in words.items()}
    expected = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    got = queries.op5_minhash_inverted_join(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        (i, len(s), expected[i], expected[i] == i) for i, s in sets.items()
    )


def test_op6_pieces(spark, texts):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op6_bounded_space_packing(spark, SF).collect()
    own, sequences = {}, {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(texts)
    for i, t in texts.items():
        ids = np.array([*full.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op7_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and all(c is not None for c in r.embedding)}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids, matrix = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    got = {}
    for r in queries.op7_multiprobe_p_stable(spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in x if i % 20 == 0}
    met = total = 0
    for q, own in got.items():
        score = matrix @ x[q]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))][: min(20, len(ids) - 1)].tolist())
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in own)
        met, total = met + len(best & {r.vec_id for r in own}), total + len(best)
    assert met >= 0.9 * total


def test_op8_ids(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: np.array(own.encode_ordinary(t), "<u4") for i, t in texts.items()}
    got = queries.op8_byte_bpe(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(ids[i]), sha(ids[i].tobytes()), sha(t.encode())) for i, t in texts.items())


def test_op9_shards(spark, texts):
    now, then = sharding.build_tree(40), sharding.build_tree(41)
    got = queries.op9_hash_tree_sharding(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (descend(now, r.doc_id)[1], descend(then, r.doc_id)[1])
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_op10_columns(spark, texts):
    """All columns from the texts alone; the stored form's own by its length and by reading packets in plain Python."""
    got = queries.op10_matroska_columns(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        media = matroska.mux(payload)
        assert (r.media_bytes, r.media_sha256, r.error) == (len(media), sha(media), None)
        n = len(payload) // 192
        above = [b >= 128 for b in payload]
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert told == {
            "packets": str(n),
            "clusters": str(-(-n // 256)),
            "cues": str(-(-n // 256)),
            "laced": str(n - (n % 8 == 1)),
            "last_ms": str(24 * (n - 1)),
            "mean": str(sum(payload) * 1000 // len(payload)),
            "power": str(sum(b * b for b in payload) * 1000 // len(payload)),
            "crossings": str(sum(a != b for a, b in zip(above, above[1:]))),
        }


def test_broken_media_is_a_row(spark):
    good = matroska.store(spark.createDataFrame(ODD, DOC))
    bad = spark.createDataFrame([(7, 3, bytearray(b"not media")), (8, 0, None)], "doc_id long, n_bytes long, media binary")
    got = matroska.read_back(good.unionByName(bad)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.payload is None) == (r.feature is None) == (r.error is not None) == (r.doc_id in (7, 8))


def test_url_columns_of_any_name(spark):
    names = ["_row", "_keys", "_rules", "_hosts", "_first", "_best", "_bad", "_key", "key", "a.b"]
    rows = [(1, "http://x.net/de/1", *names), (1, "http://x.net/de/1", *names), (None, None, *[None] * len(names)), (2, "http://y.z/" + "p" * 300_000, *names)]
    df = spark.createDataFrame(rows, ["page_id", "url", *names])
    for most in (16 << 20, 0):
        out = url_filter.judge(df, [url_filter.Rule("net", "/de/", "block")], ["y.z"], max_bytes=most)
        assert out.columns == [*df.columns, "host", "path", "rule", "verdict"]
        got = out.collect()
        assert sorted(map(str, (tuple(r)[: len(rows[0])] for r in got))) == sorted(map(str, rows))
        assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "net/de/", "block"), (None, None, "allow"), (2, None, "block")}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names, and empty tables."""
    import corpus_pipeline

    rng = random.Random(14)
    extra = ["_row", "host", "path", "good", "toxic", "keep", "id", "mark", "_gone", "_id", "component_id", "kept", "start", "n_words", "sequence_id"]
    same, long = prose(rng, 90), prose(rng, 40_000)
    known = [(i, prose(rng, 60) if i < 30 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(60)]
    rows = [(i, t, "s", "en") for i, t in known]
    rows += [(100, same, "s", "en"), (100, same, "s", "en"), (101, same, None, None), (102, None, "s", None), (103, "", "s", "en"), (104, "", "s", "en")]
    rows += [(105, long, "s", "en"), (None, prose(rng, 70), "s", "en"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in extra))
    labels = spark.createDataFrame([*((i, int(i < 30), 0) for i, _ in known), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    count = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    left = count(good)
    assert [i for i in left if i.isdigit() and 30 <= int(i) < 60] == [] and left.count("100") == 2 and {*map(str, range(30)), "101", "105"} <= {*left}

    one = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    # Without words nothing is linked; repeated rows are one document, which stays.
    assert count(one) == sorted(str(r[0]) for r in rows if r[0] != 101)

    first = stages["substring dedup"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    after = {(r.doc_id, r.text) for r in first.collect()}
    assert count(first) == sorted(str(r[0]) for r in rows if r[0] != 101)
    assert {(100, same), (102, None), (103, ""), (105, long), (None, None)} <= after

    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(p.length for p in pieces if p.doc_id == 102) == 1 and sum(p.start == 0 for p in pieces) == len(rows)

    for stage in stages.values():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    bare = tmp_path / "bare"
    docs.limit(0).select("doc_id", "text", "source", "lang").write.parquet(str(bare / "documents.parquet"))
    labels.limit(0).write.parquet(str(bare / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(bare)).count() == 0
