"""Document quality by a classifier and hierarchical empirical Bayes over sites.

Two logistic regressions (good against bad, toxic against not) give each document a probability from its words
and the shape of its text. Sites add evidence on two levels, host and path within host: the mean of a site's
other documents, shrunk by a Beta prior towards its parent's mean, the host's towards the global one. A prior's
strength comes from the sites themselves, by the method of moments: the less they differ beyond chance, the
stronger sparse and large sites alike are drawn to the parent. A document's odds are then multiplied by the odds
of its site over the global odds.

All sums are grouped aggregations with partial sums on the map side; a document's own share is taken out of its
site's sums, so that it isn't counted twice.

Fitting uses at most `sample` labelled documents (the least by a hash of their id); scoring and all site figures
cover every document in full.

Defined cases: a null or empty text has no words and gets what its shape gives; a text of any length is read whole; a null host or path is a site
of its own; without labels of both kinds a target's probability is 0.5 for good and 0 for toxic, and all documents
stay; repeated rows are judged each; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

TARGETS = ("good", "toxic")
#: Figures of a text's shape, in this order.
SHAPE = ("upper", "signs_behind", "signs_alone", "digits", "word_length", "distinct_words", "distinct_lines", "log_words")
#: The figures lie within about 0 to 1; scaled up, the ridge hardly holds their weights down.
SHAPE_SCALE = 5.0
#: Tokens that one worker keeps before it starts afresh.
TOKEN_CACHE = 400_000


@dataclass(frozen=True)
class Params:
    sample: int = 6000
    words: int = 200
    least_documents: int = 4
    least_evidence: float = 1.0
    l2: float = 1e-3
    steps: int = 600
    good_at: float = 0.5
    toxic_at: float = 0.5


STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’¿¡…"


def pieces(word: str) -> set[str]:
    """A word and its runs of 4 to 6 signs, its borders marked."""
    marked = f"^{word}$"
    return {marked, *(marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1))}


class Reader:
    """Features and shape of texts; a bounded cache holds tokens seen.

    With a model's words, features are the numbers of those that a text holds; without, all its pieces.
    """

    def __init__(self, words: list[str] | None = None, limit: int = TOKEN_CACHE):
        self.limit, self.known = limit, {}
        self.find = None if words is None else ahocorasick.Automaton()
        for i, w in enumerate(words or []):
            self.find.add_word(w, i)
        if words:
            self.find.make_automaton()
        self.size = len(words or [])

    def learn(self, token: str) -> tuple:
        """Features, whether upper case, signs behind, signs alone, digits, and the word's length."""
        core = token.strip(STRIP)
        plain = core.isalpha()
        if not plain and not any(c.isalnum() for c in core):
            return (), 0, 0, 1, 0, len(token)
        if self.find is None:
            own = pieces(core.lower())
        else:
            # The model's words are pieces, which are what is found anywhere in the marked word.
            own = {i for _, i in self.find.iter(f"^{core.lower()}$")} if self.size else ()
        behind = len(token) - len(token.rstrip(STRIP))
        return (
            tuple(own), int(len(core) > 1 and core.isupper()), int(behind > 1), 0, int(not plain and any(c.isdigit() for c in core)), len(core)
        )

    def __call__(self, text: str | None) -> tuple[list, np.ndarray]:
        tokens = (text or "").split()
        if not tokens:
            return [], np.zeros(len(SHAPE))
        known = self.known
        if len(known) > self.limit:
            known.clear()
        facts = []
        for t in tokens:
            f = known.get(t)
            if f is None:
                f = known[t] = self.learn(t)
            facts.append(f)
        features, *figures = zip(*facts)
        lines = [x for x in text.split("\n") if x.strip()]
        n = len(tokens)
        shape = np.array(
            [*(sum(x) / n for x in figures[:4]), sum(figures[4]) / n / 10, len(set(tokens)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n) / 10]
        )
        own = {i for f in features if f for i in f}
        return list(own), shape * SHAPE_SCALE


@dataclass
class Model:
    """Weights by piece of a word and of the shape's figures, for each target; None: a target without examples."""

    words: list[str]
    weights: dict[str, np.ndarray | None] = field(default_factory=dict)
    base: dict[str, float] = field(default_factory=dict)

    def probabilities(self, target: str, doc: np.ndarray, own: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """For documents with these rows of shapes, of which document doc[i] has the word own[i]."""
        w = self.weights.get(target)
        if w is None:
            return np.full(len(shapes), 0.5 if target == "good" else 0.0)
        n = len(self.words)
        z = np.bincount(doc, weights=w[own], minlength=len(shapes)) + shapes @ w[n:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class BatchReader:
    """Words and shapes of many texts at once: tokens are numbered, and what Reader says of each is kept in arrays."""

    def __init__(self, words: list[str], limit: int = TOKEN_CACHE):
        self.reader, self.limit = Reader(words), limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.figures = np.zeros((0, 5))
        self.own, self.start = np.zeros(0, int), np.zeros(1, int)

    def learn(self, tokens: Iterable[str]) -> None:
        if len(self.number) > self.limit:
            self.clear()
        fresh = [t for t in dict.fromkeys(tokens) if t not in self.number]
        if not fresh:
            return
        facts = [self.reader.learn(t) for t in fresh]
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        self.figures = np.vstack([self.figures, [f[1:] for f in facts]])
        self.own = np.concatenate([self.own, np.fromiter(chain.from_iterable(f[0] for f in facts), int)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f[0]) for f in facts])])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc and own (a document's number and each word that it has, once), and the shapes."""
        tokens = [(t or "").split() for t in texts]
        n = np.array([len(t) for t in tokens], int)
        flat = list(chain.from_iterable(tokens))
        self.learn(flat)
        ids = np.fromiter(map(self.number.__getitem__, flat), int, len(flat))
        doc, many = np.repeat(np.arange(len(texts)), n), max(1, len(self.number))
        shapes = np.zeros((len(texts), len(SHAPE)))
        some = np.maximum(n, 1)
        for j in range(5):
            shapes[:, j] = np.bincount(doc, weights=self.figures[ids, j], minlength=len(texts)) / some
        shapes[:, 4] /= 10
        pairs = distinct(doc * many + ids)
        doc, ids = pairs // many, pairs % many
        shapes[:, 5] = np.bincount(doc, minlength=len(texts)) / some
        lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
        shapes[:, 6] = [len(set(x)) / max(1, len(x)) for x in lines]
        shapes[:, 7] = np.log1p(n) / 10
        count = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(ids) else ids
        width = max(1, self.reader.size)
        pairs = distinct(np.repeat(doc, count) * width + self.own[at])
        return pairs // width, pairs % width, shapes * SHAPE_SCALE


def train(rows: np.ndarray, shapes: np.ndarray, y: np.ndarray, params: Params) -> np.ndarray:
    """Logistic regression with ridge, by full steps with momentum; classes weigh alike."""
    x = np.hstack([rows, shapes, np.ones((len(y), 1))]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, params.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) / len(y) + params.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def labelled(docs: DataFrame, labels: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """The sample's texts with their labels; the sample's ids are at most params.sample rows, so they are broadcast.

    Of several texts of one id the least stands for all, so the sample is at most params.sample texts.
    """
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("id").isNotNull() & F.col("good").isNotNull() & F.col("toxic").isNotNull())
        .orderBy(F.xxhash64("id"), "id")
        .limit(params.sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(picked), "id").groupBy("id", "good", "toxic").agg(F.min("text").alias("text"))
    return materialise(met, "labelled")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Choose the words that tell most about each target, then fit both targets on the sample."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, params, id_col, text_col)
    totals = sample.agg(*[F.count(F.lit(1)).alias("n")], *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            seen, marked = Counter(), {t: Counter() for t in TARGETS}
            for text, *kinds in zip(pdf["text"], *(pdf[t] for t in TARGETS)):
                own = reader(text)[0]
                seen.update(own)
                for t, kind in zip(TARGETS, kinds):
                    if kind:
                        marked[t].update(own)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), **{t: [c[w] for w in seen] for t, c in marked.items()}})

    counts = (
        sample.mapInPandas(count, "word string, n long, good long, toxic long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        .filter(F.col("n") >= params.least_documents)
    )
    counts = materialise(counts, "word-counts")

    def evidence(target: str) -> Column:
        """What the log odds ratio of a piece amounts to at least, two standard errors off."""
        a, b = F.col(target), F.col("n") - F.col(target)
        odds = F.log((a + 0.5) / (totals[target] - a + 0.5)) - F.log((b + 0.5) / (totals["n"] - totals[target] - b + 0.5))
        return F.abs(odds) - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    chosen = {
        r["word"]
        for t in TARGETS
        for r in counts.filter(evidence(t) >= params.least_evidence).orderBy(F.desc(evidence(t)), "word").limit(params.words).select("word").collect()
    }
    model = Model(sorted(chosen))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.words)
        for pdf in batches:
            got = [reader(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "good": pdf["good"],
                    "toxic": pdf["toxic"],
                    "at": [w for w, _ in got],
                    "shape": [s.tolist() for _, s in got],
                }
            )

    rows = sample.mapInPandas(read, "good int, toxic int, at array<int>, shape array<double>").toPandas()
    x = np.zeros((len(rows), len(model.words)), np.float32)
    for i, at in enumerate(rows["at"]):
        x[i, list(at)] = 1
    shapes = np.array(rows["shape"].tolist(), dtype=np.float32).reshape(len(rows), len(SHAPE))
    for t in TARGETS:
        y = rows[t].to_numpy(np.float32) if len(rows) else np.zeros(0, np.float32)
        model.weights[t] = train(x, shapes, y, params) if len(y) and 0 < y.mean() < 1 else None
        model.base[t] = float(y.mean()) if len(y) else 0.5
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (good, toxic) of the classifier's probabilities for docs' text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    reader: list[BatchReader] = []

    @F.pandas_udf("good double, toxic double")
    def score(text: pd.Series) -> pd.DataFrame:
        if not reader:
            reader.append(BatchReader(shared.value.words))
        read = reader[0](text.tolist())
        return pd.DataFrame({k: shared.value.probabilities(k, *read) for k in TARGETS})

    return score(F.col(text_col).cast("string"))


def site_table(scores: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Per (host, path) the counts and sums of its own and of its host, and the global mean and priors' strengths.

    Only the global figures, a single row, come to the driver.
    """
    sums = [F.sum(t).alias(f"path_{t}") for t in TARGETS]
    paths = scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), *sums)
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), *[F.sum(f"path_{t}").alias(f"host_{t}") for t in TARGETS])
    all_ = hosts.agg(F.sum("host_n").alias("n"), *[(F.sum(f"host_{t}") / F.sum("host_n")).alias(t) for t in TARGETS]).first()
    # Written, the table has a size by which Spark broadcasts it or not.
    sites = materialise(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "sites")
    facts: dict[str, float] = {"n": all_["n"] or 0}
    for t in TARGETS:
        mean = min(max(all_[t] or 0.0, 1e-6), 1 - 1e-6)
        facts[t] = mean
        # Strength of a Beta prior: mean (1 - mean) over the variance of sites' true means, less one.
        noise = mean * (1 - mean)
        between = {}
        for level, frame in (("host", hosts), ("path", sites)):
            parent = F.lit(mean) if level == "host" else F.col(f"host_{t}") / F.col("host_n")
            off = F.col(f"{level}_{t}") / F.col(f"{level}_n") - parent
            got = frame.agg(F.sum(F.col(f"{level}_n") * off * off).alias("s"), F.count(F.lit(1)).alias("k")).first()
            excess = max(0.0, (got["s"] or 0.0) - got["k"] * noise)
            between[level] = excess / max(facts["n"], 1)
        for level, var in between.items():
            facts[f"{level}_{t}"] = float(np.clip(noise / max(var, 1e-12) - 1, 1.0, 1e6))
    return sites, facts


def combined(target: str, facts: dict[str, float]) -> Column:
    """The document's probability with its site's posterior in place of the global prior."""
    own, mean = F.col(target), F.lit(facts[target])
    host = (F.col(f"host_{target}") - own + F.lit(facts[f"host_{target}"]) * mean) / (F.col("host_n") - 1 + F.lit(facts[f"host_{target}"]))
    path = (F.col(f"path_{target}") - own + F.lit(facts[f"path_{target}"]) * host) / (F.col("path_n") - 1 + F.lit(facts[f"path_{target}"]))
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda p: inside(p) / (1 - inside(p))
    joint = odds(own) * odds(path) / odds(mean)
    return F.when(own > 0, joint / (1 + joint)).otherwise(F.lit(0.0))


def with_sites(frame: DataFrame, sites: DataFrame, facts: dict[str, float], params: Params, keys: list[str]) -> DataFrame:
    """frame (with host, path, good and toxic) plus p_good, p_toxic and keep."""
    mate = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    met = frame.join(mate, frame["host"].eqNullSafe(mate["_host"]) & frame["path"].eqNullSafe(mate["_path"]))
    named = met.withColumn("p_good", combined("good", facts)).withColumn("p_toxic", combined("toxic", facts))
    return named.withColumn("keep", (F.col("p_good") >= params.good_at) & (F.col("p_toxic") < params.toxic_at)).select(
        *keys, "p_good", "p_toxic", "keep"
    )


def judge(docs: DataFrame, model: Model, host: Column, path: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, host, path, doc_good, doc_toxic, p_good, p_toxic and keep."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), scored(docs, model, text_col).alias("s"))
    rows = materialise(rows.select("id", "host", "path", "s.good", "s.toxic"), "scores")
    sites, facts = site_table(rows)
    out = with_sites(rows, sites, facts, params, ["id", "host", "path", "good", "toxic"])
    return out.withColumnsRenamed({"id": id_col, "good": "doc_good", "toxic": "doc_toxic"})


def keep_good(docs: DataFrame, model: Model, host: Column, path: Column, params: Params = Params(), text_col: str = "text") -> DataFrame:
    """docs without rejected rows; all columns stay. Rows are judged one by one, so ids need not be unique.

    Rows are written with their scores, so that texts are scored once.
    """
    small_batches(docs.sparkSession)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        scored(docs, model, text_col).alias("s"),
    ).select("_row", "host", "path", "s.good", "s.toxic")
    whole = materialise(whole, "scored")
    sites, facts = site_table(whole.select("host", "path", "good", "toxic"))
    return with_sites(whole, sites, facts, params, ["_row"]).filter("keep").select("_row.*")
