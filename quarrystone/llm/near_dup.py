"""Near-duplicates by MinHash and an inverted join over signature coordinates.

A document's set holds the hashes of its distinct word shingles. Documents of equal sets form a class, which
its smallest id stands for. A class's signature has `coords` coordinates, each a hash of `rows` minima, and a
parity sketch: a bit field in which each member of the set flips one bit. The bits in which two sketches differ
are never more than the sets' symmetric difference, so a pair whose sketches differ by more than the threshold
allows is certainly no link.

1. Post each class under its coordinate-value pairs, on a prefix of the coordinates only: two classes that
   agree on `match` or more of all coordinates agree on at least one of the first coords - match + 1.
2. Count the collisions of each class with the lists' centres, the classes that meet most others; a class goes
   with the centre that it collides with most, if `match` times or more.
3. Confirm pairs on the full sets, read again from the whole texts, and join links into components.
4. In each list that still holds several components, members outside the largest are held against the list: the
   postings of their coordinates among the list's members are merged, the match - 1 longest skipped and only
   probed for what the others brought up; what collides `match` times or more, shares no earlier prefix coordinate
   (there the pair is met already) and passes sizes and sketches is a candidate. Clear candidates are cut down to
   a forest of the list's components; others are taken nearest first, `burst` for each member and eight times as
   many each round, till no candidate is left. A list is done, and not looked at again, once all of its candidates
   were given and its clear ones hold. So no group is expanded into all its pairs, and no pair of a list stays untested
   unless it is connected.

Lists of over 2 * `tile` members are dealt over tiles: blocks of members outside the largest component meet each
other and blocks of the largest.

`match` follows from the threshold: a pair at the threshold falls below it with odds of `miss`.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle; a text of any length is read whole; rows of
one doc_id are one document, whose texts each count; a row with a null doc_id is linked with nothing and has a null
component_id; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, materialise, mix64, n_partitions, reclaim, shingles, small_batches

#: Members of a centre that one task confirms at a time.
GROUP = 512
#: Rows (ids and a salt) that are broadcast to fetch texts; with more, texts are shuffled.
BROADCAST_ROWS = 500_000
#: A candidate is clear where the difference that its sketches point to is below this share of what is allowed.
CLEAR = 0.9


@dataclass(frozen=True)
class Params:
    """shingle words; links at percent * union <= 100 * intersection; signature of coords times rows minima."""

    shingle: int = 5
    percent: int = 80
    coords: int = 32
    rows: int = 5
    miss: float = 1e-5
    tile: int = 4096
    burst: int = 8

    @property
    def match(self) -> int:
        """Coordinates that a pair at the threshold agrees on, but for odds of `miss`; one at least."""
        return max(1, least_of(self.coords, (self.percent / 100) ** self.rows, self.miss))

    @property
    def prefix(self) -> int:
        return self.coords - self.match + 1


def least_of(n: int, p: float, miss: float) -> int:
    """The largest number that a binomial count of n tries falls below with odds of `miss` at most."""
    below = 0.0
    for t in range(n):
        below += comb(n, t) * p**t * (1 - p) ** (n - t)
        if below > miss:
            return t
    return n


class Signatures:
    """Coordinates of sets of hashes, as 32-bit numbers."""

    def __init__(self, params: Params):
        self.params = params
        rng = np.random.default_rng(20_011)
        n = params.coords * params.rows
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.salt = rng.integers(0, 2**63, params.coords, dtype=np.uint64)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[None, i : i + 1024] * self.a + self.b).min(1), out=low)
        parts = low.reshape(self.params.coords, self.params.rows).astype(np.uint64)
        out = self.salt.copy()
        for j in range(self.params.rows):
            out = mix64(out + parts[:, j])
        return out.astype(np.uint32).view(np.int32)


#: Bits of a parity sketch: a power of two of about four for each member, within these bounds.
SKETCH_BITS = (64, 1 << 15)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity sketch of a set of hashes, as 64-bit words."""
    bits = SKETCH_BITS[0]
    while bits < min(4 * len(own), SKETCH_BITS[1]):
        bits *= 2
    odd = np.bincount((mix64(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of words) brought to `size` words, which halves their bits as often as is needed."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, k))


def features(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), f1 and f2 (the set's fingerprint; null for an empty set), coords, and the sketch as bytes."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sign = WordHashes(), Signatures(params)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                own = shingle_set(hashes(text), params.shingle)
                if not len(own):
                    rows.append((0, None, None, None, None))
                    continue
                mark = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                rows.append((len(own), int(mark[0]), int(mark[1]), sign(own), sketch(own).tobytes()))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "coords", "sketch"], dtype=object)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInPandas(run, f"id {kind}, n long, f1 long, f2 long, coords array<int>, sketch binary")


def confirm(pairs: DataFrame, docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold.

    A centre a and its members b meet in groups of about GROUP members, each with a copy of the centre's text,
    so a centre of very many members is spread over tasks; a task holds one centre's set and streams members.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    members = salted.select(F.col("b").alias("id"), F.col("a").alias("centre"), "salt", F.lit(1).alias("role"))
    centres = salted.select("a", "salt").distinct().select(F.col("a").alias("id"), F.col("a").alias("centre"), "salt", F.lit(0).alias("role"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = members.unionByName(centres)
    met = (
        (texts.join(F.broadcast(asked), "id") if 2 * pairs.count() <= BROADCAST_ROWS else texts.join(asked, "id"))
        .repartition(n_partitions(spark), "centre", "salt")
        .sortWithinPartitions("centre", "salt", "role")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        now, sets = None, []
        for pdf in batches:
            a, b = [], []
            for own, centre, salt, role, text in zip(pdf["id"], pdf["centre"], pdf["salt"], pdf["role"], pdf["text"]):
                if (centre, salt) != now:
                    now, sets = (centre, salt), []
                mine = shingle_set(hashes(text), params.shingle)
                if role == 0:
                    sets.append(mine)
                    continue
                for other in sets:
                    if not len(mine) or not len(other):
                        continue
                    at = np.minimum(other.searchsorted(mine), len(other) - 1)
                    both = int((other[at] == mine).sum())
                    if 100 * both >= params.percent * (len(mine) + len(other) - both):
                        a.append(centre)
                        b.append(own)
                        break
            yield pd.DataFrame({"a": pd.Series(a, dtype=pdf["id"].dtype), "b": pd.Series(b, dtype=pdf["id"].dtype)})

    return met.mapInPandas(run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that can be reached.

    Each round takes the least label among neighbours, then the label of that label; each round's table is
    written to shared storage and its forerunner removed. Labels only fall, so the rounds end when none does; their
    number grows with the logarithm of the longest path.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(edges, "edges")
    near = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"), F.lit(1).alias("moved"))
    labels = materialise(near, "labels")
    while not labels.filter("moved = 1").isEmpty():
        own = labels.select("id", "component")
        seen = edges.join(own, edges["b"] == own["id"]).groupBy("a").agg(F.min("component").alias("c"))
        best = own.join(seen, own["id"] == seen["a"], "left").select("id", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        up = own.select(F.col("id").alias("top"), F.col("component").alias("over"))
        now = F.least("c", F.coalesce("over", "c"))
        jumped = best.join(up, best["c"] == up["top"], "left").select("id", now.alias("component"), (now != F.col("was")).cast("int").alias("moved"))
        before, labels = labels, materialise(jumped, "labels")
        discard(before)
    discard(edges)
    return labels.select("id", "component")


def postings(classes: DataFrame, params: Params) -> DataFrame:
    """(rep, at, value): the prefix of each class's coordinates."""
    return classes.select("rep", F.posexplode(F.slice("coords", 1, params.prefix)).alias("at", "value"))


def link_classes(docs: DataFrame, params: Params, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The components (id, component) of the linked classes."""
    spark = docs.sparkSession
    posted = postings(classes, params)
    key = ["at", "value"]
    # A class that meets most others makes the best centre: an original meets its edited copies more than they each other.
    sizes = posted.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = materialise(posted.join(sizes.filter("low != high").select(*key, "size").hint("merge"), key), "shared")
    reclaim(spark)
    meets = shared.groupBy("rep").agg(F.sum("size").alias("meets"))
    centres = shared.join(meets, "rep").groupBy(*key).agg(F.max(F.struct("meets", "rep")).alias("top")).select(*key, F.col("top.rep").alias("centre"))
    met = shared.join(centres, key).filter(F.col("rep") != F.col("centre"))
    counted = met.groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= params.match)
    best = counted.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    pairs = materialise(best, "pairs")
    reclaim(spark)
    links = [materialise(confirm(pairs, docs, params, id_col, text_col), "links")]
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found, burst, clear = components(links[0]), params.burst, CLEAR
    while True:
        reclaim(spark)
        more = remaining(shared, classes, found, params, burst, clear)
        fresh = materialise(more.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        failed = more.filter("clear")
        if not fresh.isEmpty():
            links.append(materialise(confirm(fresh, docs, params, id_col, text_col), "links"))
            failed = failed.join(links[-1], ["a", "b"], "left_anti")
            if not links[-1].isEmpty():
                merged = links[0].select("a", "b")
                for own in links[1:]:
                    merged = merged.unionByName(own.select("a", "b"))
                before, found = found, components(merged)
                discard(before)
        # Clear candidates stand for others of their components; should one fail, or have failed before, its list is looked at pair by pair.
        left = materialise(more.filter("cut").select(*key).union(failed.select(*key)).distinct(), "left")
        if left.isEmpty():
            discard(more, left)
            break
        if not failed.isEmpty():
            clear = 0.0
        before, shared = shared, materialise(shared.join(left, key, "left_semi"), "shared")
        tested, burst = materialise(tested.unionByName(fresh), "tested"), 8 * burst
        discard(more, left, before, fresh)
    discard(shared, pairs, *links)
    return found


def remaining(shared: DataFrame, classes: DataFrame, found: DataFrame, params: Params, burst: int, clear: float) -> DataFrame:
    """Candidates (at, value, a, b, clear, cut) of different components, a < b, at most `burst` unclear ones a member; cut: its tile has more."""
    spark = shared.sparkSession
    kind = classes.schema["rep"].dataType.simpleString()
    key = ["at", "value"]
    named = found.select(F.col("id").alias("rep"), "component")
    marked = shared.select("rep", *key).join(named, "rep", "left")
    marked = materialise(marked.select(*key, "rep", F.coalesce("component", "rep").alias("part")), "marked")
    sizes = marked.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("size"))
    lists = sizes.groupBy(*key).agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts"))
    lists = lists.filter("parts > 1").select(*key, F.col("top.part").alias("main"), F.col("top.size").alias("n_main"), (F.col("all") - F.col("top.size")).alias("n_stray"))
    # Blocks of strays meet each other and blocks of the main component; the first block of that goes to each stray block's own tile.
    blocks = lambda n: F.ceil(F.col(n) / params.tile).cast("int")
    lists = lists.select(*key, "main", blocks("n_stray").alias("s"), blocks("n_main").alias("m"))
    own = marked.join(lists, key).withColumn("stray", F.col("part") != F.col("main"))
    own = own.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("s")).otherwise(F.col("m"))).cast("int"))
    each = F.sequence(F.lit(0), F.col("s") - 1)
    tile = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    # Side 1 asks, side 2 answers, 3 does both.
    at = F.col("block")
    among = F.transform(each, lambda h: tile(F.least(h, at), F.greatest(h, at), F.when(h == at, 3).when(h > at, 1).otherwise(2)))
    beyond = F.transform(F.expr("IF(m > 1, sequence(1, m - 1), array())").cast("array<int>"), lambda h: tile(at, F.col("s") + h, F.lit(1)))
    main = F.transform(each, lambda h: tile(h, F.when(at == 0, h).otherwise(F.col("s") + at), F.lit(2)))
    dealt = own.withColumn("t", F.explode(F.when(F.col("stray"), F.concat(among, beyond)).otherwise(main)))
    dealt = dealt.select(*key, "t.i", "t.j", "t.side", "rep", "part")
    met = (
        dealt.join(classes.select("rep", "n", "coords", "sketch"), "rep")
        .repartition(n_partitions(spark), *key, "i", "j")
        .sortWithinPartitions(*key, "i", "j")
    )

    def listed(own: pd.DataFrame, at: tuple) -> pd.DataFrame:
        return candidates(own, at[0], params, burst, clear).assign(at=at[0], value=at[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = list(zip(pdf["at"], pdf["value"], pdf["i"], pdf["j"]))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if keys[lo] != now and held:
                    out.append(listed(pd.concat(held) if len(held) > 1 else held[0], now))
                    held = []
                now = keys[lo]
                held.append(pdf.iloc[lo:hi])
            if out:
                yield pd.concat(out)
        if held:
            yield listed(pd.concat(held), now)

    small_batches(spark)
    got = materialise(met.mapInPandas(run, f"at int, value int, a {kind}, b {kind}, clear boolean, cut boolean"), "candidates")
    discard(marked)
    return got


NONE = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "clear": pd.Series(dtype=bool), "cut": pd.Series(dtype=bool)})


def merged_counts(lists: list[np.ndarray], match: int) -> np.ndarray:
    """What occurs in `match` or more of the sorted lists: the match - 1 longest are skipped, then probed for what the others hold."""
    lists.sort(key=len)
    short = lists[: len(lists) - match + 1]
    found, count = np.unique(np.concatenate(short), return_counts=True) if len(short) > 1 else (short[0], np.ones(len(short[0]), int))
    for left, own in zip(range(match - 1, 0, -1), lists[len(short) :]):
        ok = count + left >= match
        found, count = found[ok], count[ok]
        if not len(found):
            return found
        count = count + (own[np.minimum(own.searchsorted(found), len(own) - 1)] == found)
    return found[count >= match]


class Sketches:
    """Parity sketches of a tile's members, by their length."""

    def __init__(self, fields: list[bytes]):
        own = [np.frombuffer(f, np.uint64) for f in fields]
        self.size = np.array([len(f) for f in own])
        self.place = np.zeros(len(own), int)
        self.rows = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.rows[size] = np.stack([own[i] for i in at])

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which the sketch of i differs from each of the others, all brought to the shorter length."""
        mine = self.rows[int(self.size[i])][self.place[i]]
        out = np.zeros(len(others), int)
        sizes = self.size[others]
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            rows = folded(self.rows[size][self.place[others[at]]], len(mine))
            out[at] = np.bitwise_count(rows ^ folded(mine, size)).sum(1)
        return out


def candidates(own: pd.DataFrame, at: int, params: Params, burst: int, clear: float) -> pd.DataFrame:
    """Candidates of one tile of a list on coordinate `at`: a < b, whether clear, and (in one row) whether a member has more than are given."""
    reps, parts, n, side = (own[c].to_numpy() for c in ("rep", "part", "n", "side"))
    asks, replies = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    coords = np.stack(own["coords"].to_numpy()).astype(np.int64)
    keyed = coords + (np.arange(coords.shape[1]) << 32)
    # Postings: those who answer by coordinate and value; a member's own lists lie from low to high.
    flat = keyed[replies].T.ravel()
    by = np.argsort(flat, kind="stable")
    members, flat = replies[by % len(replies)], flat[by]
    low, high = flat.searchsorted(keyed[asks], "left"), flat.searchsorted(keyed[asks], "right")
    sketches = None
    left, right, far = [], [], []
    for i, lo, hi in zip(asks, low, high):
        use = np.flatnonzero(hi > lo)
        if len(use) < params.match:
            continue
        got = merged_counts([members[lo[c] : hi[c]] for c in use], params.match)
        got = got[(parts[got] != parts[i]) & ((side[got] + side[i] < 6) | (reps[got] > reps[i]))]
        small, large = np.minimum(n[got], n[i]), np.maximum(n[got], n[i])
        got = got[(small * 100 >= large * params.percent) & ~(coords[got, :at] == coords[i, :at]).any(1)]
        if not len(got):
            continue
        # 100 both >= percent * union, as a bound of the symmetric difference.
        most = (n[got] + n[i]) * (100 - params.percent) // (100 + params.percent)
        sketches = sketches or Sketches(own["sketch"].tolist())
        apart = sketches.apart(i, got)
        ok = apart <= most
        got, apart, most = got[ok], apart[ok], most[ok]
        bits = np.minimum(sketches.size[i], sketches.size[got]) * 64
        # The difference that so many odd bits point to, as a share of what is allowed.
        far.append(-bits / 2 * np.log(np.maximum(1 - 2 * apart / bits, 1e-9)) / np.maximum(most, 0.5))
        left.append(np.full(len(got), i))
        right.append(got)
    if not sum(map(len, left)):
        return NONE
    i, j, share = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    ranked = np.argsort(share, kind="stable")
    sure = ranked[share[ranked] < clear]
    up: dict = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    given: dict[int, int] = {}
    chosen, over = [], False
    for k in sure.tolist():
        x, y = top(parts[i[k]]), top(parts[j[k]])
        if x != y:
            up[x] = y
            chosen.append(k)
    n_clear = len(chosen)
    for k in ranked[len(sure) :].tolist():
        if top(parts[i[k]]) != top(parts[j[k]]):
            now = given[i[k]] = given.get(i[k], 0) + 1
            if now <= burst:
                chosen.append(k)
            else:
                over = True
    a, b, order = reps[i[chosen]], reps[j[chosen]], np.arange(len(chosen))
    return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "clear": order < n_clear, "cut": (order == 0) & over})


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable) and kept."""
    feats = materialise(features(docs, params, id_col, text_col), "features")
    classes = (
        feats.filter(F.col("f1").isNotNull() & F.col("id").isNotNull())
        .groupBy("f1", "f2")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("coords").alias("coords"), F.first("sketch").alias("sketch"))
    )
    classes = materialise(classes, "classes")
    rows = materialise(feats.select("id", "n", "f1", "f2"), "marks")
    discard(feats)
    reclaim(docs.sparkSession)
    found = link_classes(docs, params, classes, id_col, text_col)
    named = classes.join(found, classes["rep"] == found["id"], "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("part")
    )
    named = materialise(named, "parts")
    discard(classes, found)
    reclaim(docs.sparkSession)
    own = F.when(F.col("id").isNotNull(), F.coalesce("part", "id"))
    return (
        rows.join(named, (rows["f1"] == named["g1"]) & (rows["f2"] == named["g2"]), "left")
        .withColumn("component_id", own)
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that a smaller id of their component stands for; all columns stay."""
    gone = near_duplicates(docs, params, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
