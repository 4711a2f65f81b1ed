"""Chat, URL cascades, sharding, BPE, Matroska and packing on small fixtures."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrystone.llm import byte_bpe, chat, matroska, packing, sharding, url_filter

DOC = "doc_id long, text string, _bucket string"
ODD = [(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (3, "", ""), (None, "null id", "y"), (4, "é " * 3000 + "end", "z")]


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", r"a<\\/s> [\INST] <s>"), (1, 2, "user", "tail"), (2, 0, "user", "only"),
        (3, 0, "assistant", None), (3, None, None, "x"), (None, 5, "assistant", "n"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.prefix_targets(df)).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.prefix_targets(df).filter("conv_id = 4").orderBy("example").collect()
    assert [e.trainable for e in examples] == [True, True] and examples[1].context.startswith(examples[0].context + examples[0].target)
    assert chat.digests(chat.prefix_targets(df.limit(0))).count() == 0
    nodes = str(chat.digests(chat.prefix_targets(df))._jdf.queryExecution().executedPlan())
    assert "Python" not in nodes and "Pandas" not in nodes


def test_url_cascade_is_exact(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.{rng.choice(['a', 'b.c', 'example.net'])}" for i in range(3000)]
    listed = set(rng.sample(hosts, 200))
    urls = [(i, f"https://WWW.{h.upper()}/de/{i % 100}?q") for i, h in enumerate(hosts)] + [(-1, None), (-2, "no scheme"), (-3, "x://")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit("old"))
    rules = [url_filter.Rule("net", "/de/", "allow"), url_filter.Rule("example.net", "/de/8", "block")]
    got = {r.page_id: r for r in url_filter.judge(df, rules, sorted(listed)).collect()}
    slow = {r.page_id: r for r in url_filter.judge(df, rules, sorted(listed), max_bytes=0).collect()}
    for i, h in enumerate(hosts):
        path = f"/de/{i % 100}"
        rule = "example.net/de/8" if h.endswith("example.net") and path.startswith("/de/8") else "net/de/" if h.endswith("net") else None
        verdict = {"example.net/de/8": "block", "net/de/": "allow"}.get(rule) or ("block" if h in listed else "allow")
        for r in (got[i], slow[i]):
            assert (r.host, r.path, r.rule, r.verdict) == ("www." + h.lower(), path, rule, verdict)
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (-1, -2, -3)] == [("", "", "allow")] * 3
    assert url_filter.judge(df.limit(0), rules, []).count() == 0


def spark_hash(name, key):
    """Spark's xxhash64(name, key) of a string and a long."""
    h = xxhash.xxh64_intdigest(name.encode(), 42)
    return h if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)


def descend(node, key):
    """(draw, shard) by walking the tree."""
    if not node.children:
        return -math.log(((spark_hash(node.name, key) >> 12) + 1) * 2.0**-52) / node.weight, node.shard
    d, shard = min(descend(c, key) for c in node.children)
    return d / node.weight, shard


def test_sharding_law(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame(ODD, DOC).select("doc_id", "text"))
    rows = sharding.place_documents(docs.withColumn("_bucket", F.lit(1)), 7, buckets=3).collect()
    assert len(rows) == 4006 and {r.grown_shard for r in rows if r.grown_shard != r.shard} == {7}
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all((r.shard, r.grown_shard) == (descend(sharding.build_tree(7), r.doc_id)[1], descend(sharding.build_tree(8), r.doc_id)[1]) for r in rows)
    by_text = {(t or "").encode() for _, t, _ in ODD} | {b"t"}
    assert {(r.size, r.text_crc32, r.law) for r in rows} == {(len(t) + 16, zlib.crc32(t), "key") for t in by_text}
    tree = sharding.build_tree(20)
    for part, inside in (("s7", {7}), ("k1", {*range(5, 10)}), ("r1", {*range(10, 20)})):
        heavier = sharding.build_tree(20, weights={part: 3.0})
        both = sharding.shard_by_key(sharding.shard_by_key(docs, "doc_id", tree, "a"), "doc_id", heavier, "b")
        moved = {(r.a, r.b) for r in both.filter("a != b").select("a", "b").distinct().collect()}
        assert moved and all(b in inside and a not in inside for a, b in moved)
    counts = np.bincount([descend(tree, i)[1] for i in range(8000)])
    assert len(counts) == 20 and 330 < counts.min() and counts.max() < 470
    assert sharding.place_documents(docs.limit(0), 7).count() == 0
    with pytest.raises(ValueError):
        sharding.number_in_shard(docs.withColumn("_n", F.lit(1)), "doc_id", ["text"], "slot", 3)


def test_a_grown_tree_is_the_next_tree(spark):
    keys = spark.range(300).withColumnRenamed("id", "doc_id")
    for n in (1, 4, 5, 9, 10, 39, 40, 59):
        now = {r.doc_id: r for r in sharding.place_documents(keys.withColumn("text", F.lit(None).cast("string")), n).collect()}
        then = {r.doc_id: r.shard for r in sharding.place_documents(keys.withColumn("text", F.lit("x")), n + 1).collect()}
        assert then == {i: r.grown_shard for i, r in now.items()}
    for n in range(1, 61):
        a, b = sharding.build_tree(n), sharding.build_tree(n + 1)
        for key in range(200):
            old, new = descend(a, key)[1], descend(b, key)[1]
            assert new in (old, n)


def test_bpe_against_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    signs = "  \n\t'''stremvlld sS aé日٣١2 9!,. 　 \x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 70))) for _ in range(2000)] + ["ab" * 3000, "a" * 700 + "'ll", ""]
    got = byte_bpe.encoder(path)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [own.encode_ordinary(t) for t in texts]
    docs = spark.createDataFrame(ODD, DOC)
    back = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in ODD)
    row = byte_bpe.encode(docs.filter("doc_id = 4"), path).first()
    ids, offsets = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.offsets, "<u4")
    assert ODD[-1][1].encode()[offsets[5] : offsets[6]] == byte_bpe.vocabulary(path)[ids[5]]
    assert byte_bpe.encode(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1536, 200_000])
def test_matroska_round_trip(n):
    size, payload = matroska.to_payload("x" * n)
    media = matroska.mux(payload)
    got = matroska.parse(media)
    assert size == n and got.error is None and matroska.payload_of(media, got) == payload and len(payload) % 192 == 0
    assert [p[2] for p in got.packets] == [i * 24_000_000 for i in range(len(payload) // 192)]
    assert len(got.cues) == len(got.clusters) and [c[2] for c in got.cues] == got.clusters


def test_matroska_laces_and_broken_bytes(spark):
    frames = [b"a" * 300, b"b" * 255, b"", b"c" * 17]
    head = matroska.element(matroska.EBML, b"")
    for kind in (matroska.XIPH_LACE, matroska.EBML_LACE):
        block = b"\x81\x00\x01" + bytes([kind << 1]) + matroska.lace(frames, kind)
        cluster = matroska.element_id(matroska.CLUSTER) + b"\xff" + matroska.unsigned(matroska.TIMESTAMP, 5) + matroska.element(matroska.SIMPLE_BLOCK, block)
        media = head + matroska.element_id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + matroska.element(matroska.CUES, b"")
        got = matroska.parse(media)
        assert got.error is None and [media[p[5] : p[5] + p[6]] for p in got.packets] == frames and got.packets[0][2] == 6_000_000
    good = matroska.mux(b"q" * 5000)
    for cut in range(0, len(good), 37):
        assert cut == len(good) or matroska.parse(good[:cut]).error
    assert matroska.parse(None).error == "null"
    docs = matroska.store(spark.createDataFrame(ODD, DOC))
    table = matroska.packet_table(docs)
    assert table.filter("doc_id = 4").count() == -(-len(ODD[-1][1].encode()) // 192)
    assert matroska.read_back(docs).count() == len(ODD) and matroska.store(spark.createDataFrame([], DOC)).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    rng = random.Random(3)
    signs = "  \n\t\r\x0b\x1c  '''stremvlld SséÉ́ﬁΣσς日٣2 9!,.<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["<|endoftext|> a", "a<|startoftext|>b <|ENDOFTEXT|> x<|endoftext|><|endoftext|>y", "word " * 900]
    docs = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5, "doc_id")
    pieces = packing.pack(df, path, window=256, windows=4, gap=8, merge=3).collect()
    for i, t in docs:
        expected = full.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == expected and {p.doc_tokens for p in own} == {len(expected)}
    total = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == total.get(p.sequence_id, 0)
        total[p.sequence_id] = p.offset + len(p.ids) // 4
    assert max(total.values()) <= 256 and sum(v < 256 - 8 for v in total.values()) <= 2
    assert packing.pack(df.limit(0), path).count() == 0
