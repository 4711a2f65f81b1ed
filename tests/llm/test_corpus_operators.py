"""Quality, near-duplicates, passages, nearest neighbours and the pipeline against brute force."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarrystone.llm import ann, near_dup, passages, quality

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "nan ser tol vim wex yop zur".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


def components(sets, linked):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and linked(sets[i], sets[j]) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(12):
        base = prose(rng, rng.choice([2, 6, 40, 150]))
        for _ in range(rng.randint(1, 9)):
            texts[len(texts)] = edited(rng, base, rng.choice([0, 0, 0.01, 0.03]))
    texts |= {1000: "", 1001: "A b", 1002: "a\tB", 1003: "one", 1004: " \n"}
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if (w := t.lower().split()) else frozenset() for i, t in texts.items()}
    expected = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    rows = [(i, t, "x") for i, t in texts.items()] + [(1001, "A b", "y"), (None, "A b", "z"), (2000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    params = near_dup.Params(shingle=3, percent=85)
    got = near_dup.near_duplicates(df, params).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id == 2000:
            assert r.component_id == r.doc_id and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    # Small tiles and bursts change the way, not the result.
    tiny = near_dup.near_duplicates(df, near_dup.Params(shingle=3, percent=85, tile=3, burst=1)).collect()
    assert sorted(map(str, tiny)) == sorted(map(str, got))
    kept = near_dup.keep_one(df, params)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in expected.items() if i == c} | {None, 2000}


def test_a_tile_against_all_its_pairs():
    """Candidates of a list of one hot group: what the forest and the bursts leave out is connected."""
    rng = np.random.default_rng(2)
    params = near_dup.Params(shingle=3, percent=85)
    sign = near_dup.Signatures(params)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for i in range(90):
        own = base.copy()
        at = rng.choice(300, rng.integers(0, 45), replace=False)
        own[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(own))
    coords = [sign(s) for s in sets]
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for a in range(90) for b in range(a + 1, 90) if 100 * (n := both(a, b)) >= 85 * (len(sets[a]) + len(sets[b]) - n)}
    assert len(links) > 200
    found = set()
    for c in range(params.prefix):
        for value in {int(x[c]) for x in coords}:
            own = [i for i in range(90) if coords[i][c] == value]
            if len(own) > 1:
                rows = {"rep": own, "part": own, "n": [len(sets[i]) for i in own], "side": 3, "coords": [coords[i] for i in own]}
                frame = pd.DataFrame(rows | {"sketch": [near_dup.sketch(sets[i]).tobytes() for i in own]})
                got = near_dup.candidates(frame, c, params, 10**6, 0.0)
                new = set(zip(got["a"], got["b"]))
                assert not new & found  # a pair comes from the first coordinate that it shares
                found |= new
    assert links <= found and len(found) < 1.5 * len(links)


def test_no_link_is_lost_on_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for k, percent in ((3, 85), (5, 80)):
        words = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")).split(" ") for r in rows}
        words = {i: [x for x in w if x] for i, w in words.items()}
        sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset() for i, w in words.items()}
        expected = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b))
        got = near_dup.near_duplicates(docs, near_dup.Params(shingle=k, percent=percent)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), expected[i]) for i, s in sets.items()}


def test_exact_passages_of_the_small_tables(spark):
    """Words in a run of 50 that an earlier document has too, by brute force, against what is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, repeated, n_words = {}, {}, 0
    for r in docs.orderBy("doc_id").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if w]
        runs = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        repeated[r.doc_id] = {i + j for i, run in enumerate(runs) if first.get(run, r.doc_id) != r.doc_id for j in range(50)}
        for run in runs:
            first.setdefault(run, r.doc_id)
        n_words += len(words)
    found = {i: set() for i in repeated}
    for r in passages.repeats(docs).collect():
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    total = sum(map(len, repeated.values()))
    met = sum(len(found[i] & own) for i, own in repeated.items())
    print("repeated words", total, "found", met, "marked", sum(map(len, found.values())), "of", n_words)
    assert total > 500 and met >= 0.97 * total


def test_passages(spark):
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (60, 80, 52)]
    docs = [(i, prose(rng, 120)) for i in range(20)]
    for i, s in ((3, 0), (7, 0), (11, 1), (12, 1), (15, 2), (19, 2)):
        t = docs[i][1].split()
        docs[i] = (i, " ".join(t[:50]) + "\n" + (edited(rng, shared[s], 0.02) if i == 12 else shared[s]) + "\n" + " ".join(t[50:]))
    docs += [(30, docs[3][1]), (31, None), (32, ""), (None, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("src", F.lit("s"))
    got = {(r.doc_id, r.source_doc_id): r for r in passages.repeats(df).collect()}
    assert set(got) == {(7, 3), (12, 11), (19, 15), (30, 3)}
    r = got[(7, 3)]
    assert docs[7][1][r.start_char : r.end_char].split()[:60] == shared[0].split() or abs(r.n_words - 60) <= 3
    assert got[(30, 3)].n_words == 180
    left = {x.doc_id: x.text for x in passages.cut(df).filter("doc_id IS NOT NULL").collect()}
    assert 30 not in left and left[3] == docs[3][1] and shared[0] not in left[7] and left[5] == docs[5][1]
    assert passages.repeats(df.limit(0)).count() == 0


def test_moved_paragraph(spark):
    rng = random.Random(21)
    first, moved, last = prose(rng, 120), prose(rng, 60), prose(rng, 100)
    docs = [(1, " ".join([first, last, prose(rng, 150), moved])), (2, " ".join([first, moved, last]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    covered = {w for r in passages.repeats(df).collect() if r.doc_id == 2 for w in range(r.start_word, r.end_word)}
    assert len(covered) >= 275 and covered >= set(range(125, 175))
    assert {x.doc_id for x in passages.cut(df).filter("length(text) > 60").collect()} == {1}


def test_good_half_of_a_poor_join():
    rng = np.random.default_rng(4)
    a = rng.permutation(1000)[:400]
    params = passages.Params()
    for good, poor in ((50, 23), (200, 200)):
        b = a[: good + poor + 6].copy()
        b[good : good + poor] += 5000
        if poor > 24:  # reworded to about 30 % equal words
            keep = good + np.flatnonzero(np.arange(poor) % 10 < 3)
            b[keep] -= 5000
        at = np.array([*range(0, good - 6, 7), good + poor])
        assert any(x0 <= 1 and good - 1 <= x1 <= good + 12 and same >= 0.75 * (x1 - x0) for x0, x1, _, _, same in passages.align(a[: len(b)], b, at, at, params))
    # Across a shift, and with the source's words before it.
    b = np.r_[a[300:310], a[:60], a[310:320], a[70:76]]
    at = np.array([0, 20, 40, 54, 70])
    assert any(x0 == 0 and x1 >= 60 and y0 == 10 for x0, x1, y0, _, _ in passages.align(a, b, at, at + np.array([10, 10, 10, 10, 10]), params))
    for _ in range(200):
        equal = rng.random(rng.integers(1, 60)) < rng.uniform(0.2, 0.9)
        runs = passages.good_runs(equal, 0.75)
        assert all(equal[i] and equal[j - 1] for i, j in runs) and {*np.flatnonzero(equal)} <= {p for i, j in runs for p in range(i, j)}
        x, y = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 20))
        columns = np.array(passages.edit_columns(x, y)).sum(0)
        assert tuple(columns) == (len(x), len(y), passages.edit_matches(x, y))


def test_fuzzy_passages(spark):
    rng = random.Random(33)
    docs, spans = [], {}
    for g in range(90):
        n, share = (60, 80, 100)[g % 3], (0.08, 0.1, 0.12, 0.15)[g % 4]
        passage = prose(rng, n)
        docs.append((2 * g, " ".join([prose(rng, 80), passage, prose(rng, 80)])))
        docs.append((2 * g + 1, " ".join([prose(rng, 80), edited(rng, passage, share), prose(rng, 80)])))
        spans[2 * g + 1] = set(range(80, 80 + n))
    got = {i: set() for i in spans}
    for r in passages.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    found = sum(len(got[i] & s) >= 0.7 * len(s) for i, s in spans.items())
    print("found", found, "of", len(spans))
    assert found >= 0.93 * len(spans)
    assert all(len(got[i] - s) <= 6 for i, s in spans.items())


def test_quality_on_held_out_documents(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = prose(rng, rng.randint(20, 60))
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            text = text + " vileword " + prose(rng, 5) + " vileness"
        rows.append((i, text, f"h{i % 4}", None if i % 7 == 0 else "p"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame([*rows, (None, None, None, None), (600, "", "new", "q")], "doc_id long, text string, source string, lang string").withColumn("host", F.lit(0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in quality.judge(docs, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 602
    right = sum(got[i].keep == (q == 1 and t == 0) for i, q, t in labels if i % 2)
    assert right >= 0.97 * 300
    kept = quality.keep_good(docs, model, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, r in got.items() if r.keep and i is not None}
    # The posteriors once more, from the scores of the documents alone.
    every = quality.judge(docs, model, F.col("source"), F.col("lang")).collect()
    for target, value, name in (("good", "doc_good", "p_good"), ("toxic", "doc_toxic", "p_toxic")):
        p = np.array([r[value] for r in every])
        host, path = [r.host for r in every], [(r.host, r.path) for r in every]
        mean = min(max(p.mean(), 1e-6), 1 - 1e-6)
        sums = lambda keys: {k: (sum(q == k for q in keys), sum(x for q, x in zip(keys, p) if q == k)) for k in set(keys)}
        hosts, paths = sums(host), sums(path)
        noise = mean * (1 - mean)

        def strength(groups, parent):
            s = sum(n * (t / n - parent(k)) ** 2 for k, (n, t) in groups.items())
            return float(np.clip(noise / max(max(0.0, s - len(groups) * noise) / len(p), 1e-12) - 1, 1.0, 1e6))

        a, b = strength(hosts, lambda k: mean), strength(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0])
        for r, own, h, q in zip(every, p, host, path):
            up = (hosts[h][1] - own + a * mean) / (hosts[h][0] - 1 + a)
            site = (paths[q][1] - own + b * up) / (paths[q][0] - 1 + b)
            odds = [x / (1 - x) for x in (min(max(y, 1e-6), 1 - 1e-6) for y in (own, site, mean))]
            joint = odds[0] * odds[1] / odds[2]
            assert abs(r[name] - (joint / (1 + joint) if own > 0 else 0.0)) < 1e-6
    # Scores of a batch are those of one text at a time.
    reader = quality.BatchReader(model.words, limit=50)
    doc, own, shapes = reader([r[1] for r in rows] + [None, ""])
    one = quality.Reader(model.words)
    for i, r in enumerate(rows):
        words, shape = one(r[1])
        assert set(words) == set(own[doc == i]) and np.allclose(shape, shapes[i])
    empty = quality.fit(docs, known.limit(0))
    assert quality.judge(docs.limit(0), empty, F.col("source"), F.col("lang")).count() == 0
    assert quality.judge(docs, empty, F.col("source"), F.col("lang")).filter("NOT keep").count() == 0


def test_only_unfinished_lists_are_looked_at_again(spark, monkeypatch):
    rng = random.Random(31)

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"edit{rng.randint(0, 10**9)}"
        return " ".join(words)

    fresh = lambda: [rng.choice(WORDS) + str(rng.randint(0, 10**6)) for _ in range(200)]
    base = fresh()
    texts = [edited(base, 3) for _ in range(30)]  # near, but no links
    for _ in range(40):  # lists in common, but no candidates
        base = fresh()
        texts += [edited(base, 9) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, remaining = [], near_dup.remaining

    def counted(shared, *more):
        sizes.append(shared.count())
        return remaining(shared, *more)

    monkeypatch.setattr(near_dup, "remaining", counted)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, near_dup.Params(shingle=3, percent=85, burst=1)).collect()}
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    assert got == dict(enumerate(root))
    assert len(sizes) > 1 and sizes[1] < sizes[0]


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0]), (None, [1.0] * 16), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("s"))
    got = ann.search(df, F.col("id") % 20 == 0, ann.Params(k=20, cell_rows=50)).collect()
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len(set(best) & {r.vec_id for r in own})
        if q in (100, 120):
            assert [r.vec_id for r in own if abs(r.score - s[101]) < 1e-9][:5] == [i for i in range(100, 107) if i != q][:5]
    assert hits >= 0.9 * 20 * 45
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 4"), F.col("id") == 0, ann.Params(k=20)).collect()
    assert len(few) == 3


def test_search_of_outliers(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([1 + 0.02 * rng.standard_normal((900, 16)), rng.standard_normal((8, 16))])
    x *= 4 / np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    params = ann.Params(k=20, width=0.5)
    got = ann.search(df, (F.col("id") >= 900) | (F.col("id") % 100 == 0), params).collect()
    for q in [*range(0, 900, 100), *range(900, 908)]:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-9 for r in own)


def test_search_of_copies_is_exact_among_them(spark):
    rng = np.random.default_rng(21)
    few = rng.standard_normal((30, 8))
    x = few[np.arange(900) % 30]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = ann.search(df, F.col("id") % 4 == 0, ann.Params(k=40)).collect()
    for q in range(0, 900, 4):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == np.lexsort((np.arange(900), -s))[:40].tolist()


def test_search_block_keeps_the_best_of_the_cells_within_reach():
    rng = np.random.default_rng(22)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    params = ann.Params(k=10, cell_rows=64)
    norm = float(np.sqrt((x * x).sum(1).max()))
    tables = ann.Tables(16, params)
    for reach in (None, 0.3):
        block = ann.Block(np.arange(3000), x, tables, norm, reach)
        for low in (-np.inf, 0.2):
            got = block.nearest(pd.DataFrame({"id": np.arange(50), "vec": list(x[:50]), "low": low}), 1e-5)
            for q in range(50):
                s = (x * x[q]).sum(1)
                seen = np.full(3000, reach is None)
                for t in range(params.tables if reach else 0):
                    place = tables.places(ann.unit_query(x[q : q + 1]), t)
                    seen |= ann.border_distance(place, np.floor(tables.places(ann.unit(x, norm), t))).sum(1) <= reach
                s[~seen] = -np.inf
                best = [int(i) for i in np.lexsort((np.arange(3000), -s))[:11] if s[i] > -np.inf and s[i] >= low * norm * np.sqrt((x[q] * x[q]).sum()) - 1e-9]
                assert got["b"][got["a"] == q].tolist() == best


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    passage = prose(rng, 70)
    docs = [(i, prose(rng, 80), "h", "en") for i in range(40)]
    docs += [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "h", "en") for i in range(40)]
    docs += [(200, edited(rng, docs[0][1], 0.01), "h", "en"), (201, prose(rng, 60) + " " + passage, "h", "en"), (202, prose(rng, 60) + " " + passage, "h", "en")]
    labels = [(i, int(i < 100), 0) for i, *_ in docs if i < 140]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {p.doc_id for p in pieces}
    assert ids == {*range(40), 201, 202}
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert tokens[202] < 0.7 * tokens[201]
