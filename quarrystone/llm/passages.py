"""Repeated passages by collinear chaining of shared word k-mers.

1. A document posts the minimisers of its word k-mers: any run of window + k - 1 words that two documents share
   gives both a common seed.
2. A seed is joined with its first occurrence only (least document, then position), so a seed of very many
   occurrences gives one match for each and never a pair of every two.
3. A document's matches with one source are chained: a chain's matches go forward in both texts, each earns its
   words and pays for the gap to the one before. A Fenwick tree over source positions finds the best match to
   go on from.
4. Chains are aligned on the words of both texts, gaps by edit distance, ends by extension while matches outweigh
   the rest; what is left of the chains of a document is joined where they touch. Passages of at least min_words
   are kept. As sources differ from seed to seed, chains of part of a passage are joined again here.

The first document with a passage keeps it; in all later ones it is a repeat.

Defined cases: a null or empty text or one of under min_words words has no passage; a text of any length is read
whole, in one task; a null id takes no part; rows of one id with different texts are told apart by their texts; repeated rows of one id and text count as one
document and each shows its passages; passages inside one document alone are left; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, materialise, n_partitions, reclaim, shingles, small_batches

#: Members of a source that one task aligns at a time.
GROUP = 256
#: Passages up to which their documents' texts are fetched by a broadcast; with more, texts are shuffled.
BROADCAST_ROWS = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Params:
    k: int = 6
    window: int = 12
    max_gap: int = 96
    break_gap: int = 24
    min_words: int = 45
    least_identity: float = 0.75


def minimisers(words: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are least in some window of them."""
    grams = shingles(words, params.k)
    if len(grams) <= params.window:
        at = np.array([int(grams.argmin())]) if len(grams) else np.zeros(0, int)
        return at, grams[at]
    view = np.lib.stride_tricks.sliding_window_view(grams, params.window)
    at = view.argmin(1) + np.arange(len(view))
    at = at[np.r_[True, at[1:] != at[:-1]]]  # the first least of a window never lies before that of the one before
    return at, grams[at]


def chains(x: np.ndarray, y: np.ndarray, params: Params) -> list[np.ndarray]:
    """Collinear chains of matches (x, y), best first, as arrays of their indices; each match is in one chain.

    A match earns k, or what it adds to an overlapping one, and pays k / (2 max_gap) for each word of both gaps.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(1, int)]
    order = np.lexsort((-y, x))
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    rate = params.k / (2 * params.max_gap)
    score, before = np.zeros(n), np.full(n, -1)
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    for i in order.tolist():
        best, at, r = -np.inf, -1, rs[i] - 1
        while r > 0:  # of all with a smaller source position
            if tree[r][0] > best:
                best, at = tree[r]
            r &= r - 1
        here = rate * (xs[i] + ys[i])
        score[i] = params.k
        if at >= 0 and xs[at] < xs[i]:
            earned = min(params.k, xs[i] - xs[at], ys[i] - ys[at])
            if best - here + earned > params.k:
                score[i], before[i] = best - here + earned, at
        value, r = (score[i] + here, i), rs[i]
        while r <= size:
            if tree[r][0] < value[0]:
                tree[r] = value
            r += r & -r
    used = np.zeros(n, bool)
    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a best alignment of two short runs leaves equal (longest common subsequence)."""
    row = np.zeros(len(b) + 1, int)
    for w in a:
        new = row.copy()
        hit = np.flatnonzero(b == w)
        new[hit + 1] = np.maximum(new[hit + 1], row[hit] + 1)
        row = np.maximum.accumulate(new)
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far equal words outweigh others at the beginning of two runs: length and equal words."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = np.flatnonzero(a[:n] == b[:n])
    if not len(same):
        return 0, 0
    # One for each equal word and two off for each other, up to and with an equal word.
    gain = 3 * np.arange(1, len(same) + 1) - 2 * (same + 1)
    best = int(gain.argmax())
    return (int(same[best]) + 1, best + 1) if gain[best] > 0 else (0, 0)


def edit_columns(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """A best alignment of two short runs as columns: words of a, words of b, equal; equal words are as in edit_matches."""
    most = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            most[i, j] = most[i + 1, j + 1] + 1 if a[i] == b[j] else max(most[i + 1, j], most[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and (a[i] == b[j] or most[i + 1, j + 1] == most[i, j]):
            step = (1, 1, int(a[i] == b[j]))
        elif i < len(a) and (j == len(b) or most[i + 1, j] == most[i, j]):
            step = (1, 0, 0)
        else:
            step = (0, 1, 0)
        out.append(step)
        i, j = i + step[0], j + step[1]
    return out


def good_runs(equal: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Ranges of columns of which at least a share `least` is equal, the longest first and then those of what is left.

    Their ends are cut back to where equal columns outweigh the rest, as in extend().
    """
    out, left = [], [(0, len(equal))]
    while left:
        lo, hi = left.pop()
        own = equal[lo:hi]
        if not own.any():
            continue
        total = np.r_[0.0, np.cumsum(np.where(own, 1 - least, -least))]
        # For each end, the first beginning from which the run is good enough.
        start = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9)
        end = int((np.arange(len(total)) - start).argmax())
        first, last = int(start[end]), end
        gain = np.r_[0, np.cumsum(np.where(own[first:last], 1, -2))]
        last = first + int(gain.argmax())
        first += int(gain[: last - first + 1].argmin())
        out.append((lo + first, lo + last))
        left += [(lo, lo + first), (lo + last, hi)]
    return sorted(out)


def split(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], params: Params) -> list[tuple[int, int, int, int, int]]:
    """The good runs of a part, given as runs on diagonals (first and last position in a, first in b) in order."""
    steps: list[np.ndarray] = []
    x, y = runs[0][0], runs[0][2]
    for x0, x1, y0 in runs:
        if x0 > x or y0 > y:
            steps.append(np.array(edit_columns(a[x:x0], b[y:y0])))
        size = x1 - x0
        steps.append(np.stack([np.ones(size, int), np.ones(size, int), a[x0:x1] == b[y0 : y0 + size]], 1))
        x, y = x1, y0 + size
    columns = np.concatenate(steps)
    at = np.r_[[[runs[0][0], runs[0][2], 0]], columns].cumsum(0)
    out = []
    for i, j in good_runs(columns[:, 2] > 0, params.least_identity):
        if at[j, 0] - at[i, 0] >= params.k:
            out.append((int(at[i, 0]), int(at[j, 0]), int(at[i, 1]), int(at[j, 1]), int(at[j, 2] - at[i, 2])))
    return out


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, params: Params) -> list[tuple[int, int, int, int, int]]:
    """Word ranges of both texts and equal words for what a chain with matches (x, y) aligns; none where its seeds don't hold.

    Runs of matches on one diagonal are compared word by word and cut where over break_gap words differ in a row; two
    parts are joined across a shift of at most break_gap words by edit distance. A part below least_identity is split
    into what is good in it.
    """
    k, reach, wide = params.k, 4 * params.break_gap, params.break_gap
    fits = (x + k <= len(a)) & (y + k <= len(b))
    x, y = x[fits], y[fits]
    if not len(x):
        return []
    if len(x) == 1:
        x0, y0 = int(x[0]), int(y[0])
        if (a[x0 : x0 + k] == b[y0 : y0 + k]).all():  # a lone seed that holds: nothing to join, only its ends to extend
            back, more = extend(a[max(0, x0 - reach) : x0][::-1], b[max(0, y0 - reach) : y0][::-1])
            on, most = extend(a[x0 + k : x0 + k + reach], b[y0 + k : y0 + k + reach])
            if k + more + most >= params.least_identity * (k + back + on):
                return [(x0 - back, x0 + k + on, y0 - back, y0 + k + on, k + more + most)]
            return split(a, b, [(x0 - back, x0, y0 - back), (x0, x0 + k, y0), (x0 + k, x0 + k + on, y0 + k)], params)
    firsts = np.flatnonzero(np.r_[True, np.diff(x - y) != 0])
    parts: list[list[int]] = []
    for f, n in zip(firsts.tolist(), np.r_[firsts[1:], len(x)].tolist()):
        x0, y0, size = int(x[f]), int(y[f]), int(x[n - 1] - x[f]) + k
        same = np.flatnonzero(a[x0 : x0 + size] == b[y0 : y0 + size])
        if not len(same):
            continue
        cut = np.flatnonzero(np.diff(same) > wide)
        for i, j in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(same) - 1].tolist()):
            lo, hi = int(same[i]), int(same[j]) + 1
            parts.append([x0 + lo, x0 + hi, y0 + lo, y0 + hi, j - i + 1])
    done: list[list[int]] = []
    runs: list[list[tuple[int, int, int]]] = []
    for part in parts:
        if done:
            last = done[-1]
            over = max(0, last[1] - part[0], last[3] - part[2])
            if over:  # overlapping seeds of two diagonals: the later part gives way
                part = [part[0] + over, part[1], part[2] + over, part[3], part[4] - over]
            gap_a, gap_b = part[0] - last[1], part[2] - last[3]
            if part[0] >= part[1]:
                continue
            if gap_a <= wide and gap_b <= wide:
                last[4] += max(0, part[4]) + (edit_matches(a[last[1] : part[0]], b[last[3] : part[2]]) if gap_a and gap_b else 0)
                last[1], last[3] = part[1], part[3]
                runs[-1].append((part[0], part[1], part[2]))
                continue
        done.append(part)
        runs.append([(part[0], part[1], part[2])])
    out = []
    for (x0, x1, y0, y1, equal), own in zip(done, runs):
        back, more = extend(a[max(0, x0 - reach) : x0][::-1], b[max(0, y0 - reach) : y0][::-1])
        on, most = extend(a[x1 : x1 + reach], b[y1 : y1 + reach])
        if x1 - x0 + back + on < params.k:
            continue
        whole = (x0 - back, x1 + on, y0 - back, y1 + on, equal + more + most)
        if whole[4] >= params.least_identity * max(whole[1] - whole[0], whole[3] - whole[2]):
            out.append(whole)
        else:
            out += split(a, b, [(x0 - back, x0, y0 - back), *own, (x1, x1 + on, y1)], params)
    return out


def seeds(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """(seed, id, pos) of every document that is long enough."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            ids, at, grams = [], [], []
            for own, text in zip(pdf["id"], pdf["text"]):
                words = hashes(text)
                if len(words) >= params.min_words:
                    where, what = minimisers(words, params)
                    ids.append(np.full(len(where), own))
                    at.append(where)
                    grams.append(what)
            if ids:
                yield pd.DataFrame({"seed": np.concatenate(grams).view(np.int64), "id": np.concatenate(ids), "pos": np.concatenate(at)})

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    return picked.mapInPandas(run, f"seed long, id {kind}, pos int")


def chained(matches: DataFrame, params: Params, kind: str) -> DataFrame:
    """(id, chains): all chains of a document, each with its source and positions as 32-bit integers.

    A document's matches are at most its seeds, so a group is never larger than a document.
    """
    spark = matches.sparkSession
    sorted_ = matches.repartition(n_partitions(spark), "id").sortWithinPartitions("id", "src", "pos")

    def of(part: pd.DataFrame) -> list[tuple]:
        own, src = part["id"].to_numpy(), part["src"].to_numpy()
        x, y = part["pos"].to_numpy(), part["spos"].to_numpy()
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (src[1:] != src[:-1])])
        out: list[tuple] = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
            if not out or out[-1][0] != own[lo]:
                out.append((own[lo], []))
            # All chains: one inside another's range may align what that one only bridges.
            for c in chains(x[lo:hi], y[lo:hi], params):
                out[-1][1].append({"src": src[lo], "xs": x[lo + c].astype("<i4").tobytes(), "ys": y[lo + c].astype("<i4").tobytes()})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held = ["id", "chains"], []
        for pdf in batches:
            if not len(pdf):
                continue
            # A document that may go on in the next batch waits; its parts are joined once.
            own = pdf["id"].to_numpy()
            last = int(own.searchsorted(own[-1])) if own.dtype != object else int(np.flatnonzero(np.r_[True, own[1:] != own[:-1]])[-1])
            if held and last == 0 and held[-1]["id"].iloc[-1] == own[0]:
                held.append(pdf)
                continue
            if held or last:
                yield pd.DataFrame(of(pd.concat([*held, pdf.iloc[:last]])), columns=columns)
            held = [pdf.iloc[last:]]
        if held:
            yield pd.DataFrame(of(pd.concat(held)), columns=columns)

    return sorted_.mapInPandas(run, f"id {kind}, chains array<struct<src:{kind},xs:binary,ys:binary>>")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))


def segments(chains_: list, n: int, params: Params) -> list[tuple]:
    """(source, first word, last word, chains) for a document of n words: what its chains' alignments can reach, overlapping reaches as one."""
    reach = 4 * params.break_gap
    spans = []
    for c in chains_:
        x = np.frombuffer(c["xs"], "<i4")
        first, last = max(0, int(x[0]) - reach), min(n, int(x[-1]) + params.k + reach)
        if first < last:
            spans.append((c["src"], first, last, c))
    out: list[list] = []
    for src, first, last, c in sorted(spans, key=lambda s: s[:3]):
        if out and out[-1][0] == src and first <= out[-1][2]:
            out[-1][2] = max(out[-1][2], last)
            out[-1][3].append({"xs": c["xs"], "ys": c["ys"]})
        else:
            out.append([src, first, last, [{"xs": c["xs"], "ys": c["ys"]}]])
    return out


def sliced(found: DataFrame, docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """A row for each segment: src, id, mark (of the text), its words from word `first` on as 32-bit hashes, and its chains.

    So a document's text is read once, whatever the number of its sources, and only these words go to the source.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    met = texts_of(docs, id_col, text_col).join(found, "id").select("id", "mark", "text", "chains")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for own, mark, text, chains_ in zip(*(pdf[c] for c in ("id", "mark", "text", "chains"))):
                words = hashes(text).astype("<u4")
                out += [(src, own, mark, lo, words[lo:hi].tobytes(), inside) for src, lo, hi, inside in segments(chains_, len(words), params)]
            yield pd.DataFrame(out, columns=["src", "id", "mark", "first", "words", "chains"])

    return met.mapInPandas(run, f"src {kind}, id {kind}, mark long, first int, words binary, chains array<struct<xs:binary,ys:binary>>")


def aligned(found: DataFrame, docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """Aligned chains: id, mark, src, word ranges of both, equal words.

    A source of very many documents is spread over tasks, each with a copy of its text; a task streams the segments.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = found.select(F.explode(F.array_distinct(F.col("chains.src"))).alias("src"))
    counts = materialise(wanted.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts")), "sources")
    members = sliced(found, docs, params, id_col, text_col).join(counts, "src")
    members = members.withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).drop("salts")
    copies = counts.select(F.col("src").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    sources = texts_of(docs, id_col, text_col).join(copies, "id").select(F.col("id").alias("src"), "salt", "text")
    # No nulls in whole numbers, which would turn them into floats on their way.
    sources = sources.select("*", F.col("src").alias("id"), F.lit(0).cast("long").alias("mark"), F.lit(0).alias("first"))
    met = (
        members.unionByName(sources, allowMissingColumns=True)
        .withColumn("role", F.col("text").isNull().cast("int"))
        .repartition(n_partitions(spark), "src", "salt")
        .sortWithinPartitions("src", "salt", "role")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        now, sources_ = None, []
        for pdf in batches:
            out = []
            for src, salt, text, own, mark, first, words, chains_ in zip(*(pdf[c] for c in ("src", "salt", "text", "id", "mark", "first", "words", "chains"))):
                if (src, salt) != now:
                    now, sources_ = (src, salt), []
                if text is not None:
                    sources_.append(hashes(text).astype("<u4"))
                    continue
                mine = np.frombuffer(words, "<u4")
                for c in chains_:
                    x, y = np.frombuffer(c["xs"], "<i4") - np.int32(first), np.frombuffer(c["ys"], "<i4")
                    for other in sources_:
                        got = align(mine, other, x, y, params)
                        if got:
                            out += [(own, mark, src, g[0] + int(first), g[1] + int(first), *g[2:]) for g in got]
                            break
            yield pd.DataFrame(out, columns=["id", "mark", "src", "a0", "a1", "b0", "b1", "equal"])

    return met.mapInPandas(run, f"id {kind}, mark long, src {kind}, a0 int, a1 int, b0 int, b1 int, equal int")


def with_characters(found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """found (id, mark, start_word, end_word, ...) plus start_char and end_char, from the texts of its documents."""
    own = found.groupBy("id", "mark").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    texts = texts_of(docs, id_col, text_col)
    met = texts.join(F.broadcast(own) if found.count() <= BROADCAST_ROWS else own, ["id", "mark"])
    met = met.groupBy("id", "mark").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own_, mark, text, spans in zip(*(pdf[c] for c in ("id", "mark", "text", "spans"))):
                at = [m.span() for m in WORD.finditer(text)]
                out += [(own_, mark, s["start_word"], at[s["start_word"]][0], at[s["end_word"] - 1][1]) for s in spans]
            yield pd.DataFrame(out, columns=["id", "mark", "start_word", "start_char", "end_char"])

    placed = met.mapInPandas(run, f"id {kind}, mark long, start_word int, start_char int, end_char int")
    return found.join(placed, ["id", "mark", "start_word"])


def repeats(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages: id, mark, start_word, end_word, start_char, end_char, n_words, identity, source_<id>,
    source_start_word and source_end_word (of the largest chain in it), n_sources."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    posted = materialise(seeds(docs, params, id_col, text_col), "seeds")
    firsts = posted.groupBy("seed").agg(F.min(F.struct("id", "pos")).alias("f"), F.max("id").alias("high"))
    firsts = firsts.filter(F.col("f.id") != F.col("high")).select("seed", F.col("f.id").alias("src"), F.col("f.pos").alias("spos"))
    # Each of the large shuffles is written off and freed before the next.
    firsts = materialise(firsts, "firsts")
    reclaim(docs.sparkSession)
    matches = posted.join(firsts.hint("merge"), "seed").filter(F.col("id") != F.col("src")).select("id", "pos", "src", "spos")
    found = materialise(chained(matches, params, kind), "chains")
    discard(posted, firsts)
    reclaim(docs.sparkSession)
    lines = aligned(found, docs, params, id_col, text_col)
    # Chains that touch or nearly touch are one passage: a new one begins where no earlier chain reaches.
    order = Window.partitionBy("id", "mark").orderBy("a0", "a1", "src", "b0")
    reach = F.max("a1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("a0") > reach + params.k), 1).otherwise(0)
    numbered = lines.distinct().withColumn("_new", fresh)
    numbered = numbered.withColumn("_passage", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("src", "b0", "b1", "equal", "a0", "a1"), F.struct("equal", "a1"))
    merged = numbered.groupBy("id", "mark", "_passage").agg(
        F.min("a0").alias("start_word"),
        F.max("a1").alias("end_word"),
        best.alias("best"),
        F.count_distinct("src").alias("n_sources"),
    )
    merged = materialise(merged.filter(F.col("end_word") - F.col("start_word") >= params.min_words), "passages")
    discard(found)
    reclaim(docs.sparkSession)
    return with_characters(merged, docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        "mark",
        "start_word",
        "end_word",
        "start_char",
        "end_char",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("best.src").alias(f"source_{id_col}"),
        F.col("best.b0").alias("source_start_word"),
        F.col("best.b1").alias("source_end_word"),
        (F.col("best.equal") / F.greatest(F.expr("best.a1 - best.a0"), F.expr("best.b1 - best.b0"))).alias("identity"),
        F.col("n_sources").cast("int").alias("n_sources"),
    )


def cut(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated passages; rows of which nothing but white space is left are dropped; all columns stay."""
    spans = F.array_sort(F.collect_list(F.struct("start_char", "end_char")))
    found = repeats(docs, params, id_col, text_col).groupBy(id_col, "mark").agg(spans.alias("_spans"))
    found = found.select(F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), "_spans")
    text = F.col(f"_row.`{text_col}`").cast("string")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    met = row.join(found, (F.col(f"_row.`{id_col}`") == F.col("_id")) & (F.xxhash64(text) == F.col("_mark")), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end_char"]))
    ends = F.concat(F.transform("_spans", lambda s: s["start_char"]), F.array(F.length(text)))
    rest = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))), "")
    left = met.withColumn("_left", F.when(F.col("_spans").isNull(), text).otherwise(rest))
    left = left.filter(F.col("_spans").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col("_left").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
