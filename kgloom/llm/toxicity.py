"""Toxicity by maximum-scoring segments of token log-odds.

Words and their beginnings get log-odds between toxic and clean documents,
with Dirichlet priors in proportion to how often they occur at all. A text is
a sequence of such scores; every other word has one small negative score. A
linear-time scan finds all maximal-scoring segments (Ruzzo and Tompa 1999).
Under the clean scores' distribution segment maxima follow an extreme-value
law (Karlin and Altschul 1990), which turns segment scores into expected counts
of such segments by chance: those below ``ALPHA`` are the significant passages.
A logistic curve over the strongest and the summed normalised scores gives the
probability of a document.

The model is fitted on a bounded sample: about ``FIT_TOXIC`` and ``FIT_CLEAN``
labelled documents, near copies among them left out, and at most ``FEATURES``
features. Scores cover all words of whole texts.

Cases: null and empty texts have no segments and get the probability of such
texts; rows without a label teach nothing; without both labels every score is
the share of toxic labels (0 without labels); repeated rows and ids are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgloom.llm.bytesvec import mix, shingle_sets, slices
from kgloom.llm.common import stored

FIT_TOXIC, FIT_CLEAN, FEATURES = 5000, 8000, 20000
PREFIXES = (3, 4, 5, 6)
PRIOR_DOCS, LEAST_Z, ALPHA, THRESHOLD = 10.0, 3.0, 0.05, 0.3
WORD = re.compile(r"\w+")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def features(word: str) -> list[str]:
    """A word as a whole, and its beginnings, marked by a trailing hyphen."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.02
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fixed: float | None = None

    def __post_init__(self):
        self.starts = {f[: min(PREFIXES)].rstrip("-") for f in self.weights}

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        starts, least = self.starts, min(PREFIXES)
        return [(i, w) for i, word in enumerate(words) if word[:least] in starts and (w := self.weight(word)) > 0]

    def normalised(self, score: float, n_words: int) -> float:
        """Score in units in which exp(-x) is the count expected by chance."""
        return self.rate * score - self.log_k - math.log(max(n_words, 1))

    def summary(self, segments: list[tuple[int, int, float]], n_words: int) -> tuple[float, float]:
        """The strongest normalised score, and the sum of the significant ones."""
        x = [self.normalised(s, n_words) for _, _, s in segments]
        limit = -math.log(ALPHA)
        return (min(max(x), 60.0) if x else -15.0), math.log1p(sum(v for v in x if v >= limit))

    def probability(self, summary: tuple[float, float]) -> float:
        if self.fixed is not None:
            return self.fixed
        a, b, c = self.curve
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * summary[0] / 10 + c * summary[1]))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that scores ``drift`` wherever there is no hit.

    Candidates are kept as (first, last, sum before, sum through, index of the candidate with
    a smaller sum before); the links make the scan linear.
    """
    found: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for i, w in hits:
        total += drift * (i - at)
        first, before, through = i, total, total + w
        total, at = through, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= through:
                found.append((first, i, before, through, j))
                break
            first, before, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in found]


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """``id``, ``toxic``, ``text`` of about ``FIT_TOXIC`` and ``FIT_CLEAN`` rows by hash, less near copies; and all labels' counts.

    Two least hashes stand for a document; one document of each value stays.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, total.get(k, 0))) for k, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))}
    place = F.xxhash64("id").cast("double") / 2.0**64 + 0.5
    ids = marks.where(place <= F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # Bounded by FIT_TOXIC + FIT_CLEAN ids.
    chosen = docs.select(F.col(doc_id).alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "id")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def least_hashes(text: pd.Series) -> pd.Series:
        out = []
        for _, offsets, data in slices(pa.array(text, pa.string())):
            for u in shingle_sets(offsets, data):
                out.append([int(v.min().view(np.int64)) for v in (u, mix(u ^ np.uint64(0x5DEECE66D)))] if len(u) else [0, 0])
        return pd.Series(out, dtype=object)

    kept = chosen.withColumn("h", least_hashes("text"))
    for k in range(2):
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("toxic", F.col("h")[k]).orderBy("id", "text"))).where("nth = 1")
    return kept.select("id", "toxic", "text"), total


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature``, ``toxic`` and ``clean``: in how many documents of the sample it occurs."""

    def work(frames):
        counts = {0: Counter(), 1: Counter()}
        for frame in frames:
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                counts[toxic].update({f for w in set(WORD.findall(lowered(text))) for f in features(w)})
        names = sorted(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pd.DataFrame({"feature": part, "toxic": [counts[1][f] for f in part], "clean": [counts[0][f] for f in part]})

    return rows.select("toxic", "text").mapInPandas(work, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``feature``, ``weight``, ``z`` of the features that mark toxic documents: log-odds with a Dirichlet prior, and in units of its deviation."""
    prior = PRIOR_DOCS * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    weight = F.log(t / (n_toxic + PRIOR_DOCS - t + 1)) - F.log(c / (n_clean + PRIOR_DOCS - c + 1))
    scored = counts.where("toxic >= 4").select("feature", weight.alias("weight"), (weight / F.sqrt(1 / t + 1 / c)).alias("z"))
    return scored.where((F.col("z") >= LEAST_Z) & (F.col("weight") > 1)).orderBy(F.desc("z"), "feature").limit(FEATURES)


def scanned(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Of each sample document its label, words, marks (their different weights, and how often), segment scores: small rows, as many as the sample."""

    def work(frames):
        for frame in frames:
            out = []
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                words = WORD.findall(lowered(text))
                hits = model.hits(words)
                spread = hits[-1][0] - hits[0][0] + 1 if hits else 0
                weights = Counter(w for _, w in hits)
                out.append((toxic, len(words), len(hits), spread, list(weights), list(weights.values()), [s for _, _, s in maximal_segments(hits, model.drift)]))
            yield pd.DataFrame(out, columns=["toxic", "words", "hits", "spread", "weights", "times", "segments"])

    return rows.select("toxic", "text").mapInPandas(work, "toxic int, words long, hits long, spread long, weights array<double>, times array<long>, segments array<double>").toPandas()


def decay(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, for scores of negative mean of which some are positive."""
    low, high = 1e-6, 1.0
    excess = lambda x: float((chances * np.exp(np.minimum(x * values, 500))).sum()) - 1
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        penalty = ridge * np.r_[0, np.ones(len(b) - 1)]
        grad = x.T @ (weight * (y - p)) - penalty * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-6 * np.eye(len(b)), grad)
        b += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> Model:
    """A model from the rows of ``docs`` that ``labels`` (``doc_id``, ``toxic``) marks."""
    rows, total = sample(docs, labels, doc_id)
    everything = sum(total.values())
    if not total.get(0) or not total.get(1):
        return Model(fixed=float(total.get(1, 0)) / everything if everything else 0.0)
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(3))), "toxic-sample")
    lexicon, rest = rows.where("part < 2"), rows.where("part = 2")
    sizes = {r["toxic"]: r["n"] for r in lexicon.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = {r["feature"]: r["weight"] for r in log_odds(feature_counts(lexicon), n_toxic, n_clean).collect()}
    model = Model(weights=weights)
    first = scanned(lexicon, model)
    toxic, clean = first[first.toxic == 1], first[first.toxic == 0]
    q_toxic = min(0.5, (toxic.hits.sum() + 1) / (toxic.spread.sum() + 20))
    q_clean = (clean.hits.sum() + 0.5) / (clean.words.sum() + 20)
    model.drift = min(-0.005, math.log1p(-q_toxic) - math.log1p(-q_clean))
    seen = Counter()
    for ws, ns in zip(clean.weights, clean.times, strict=True):
        seen.update(dict(zip(ws, ns, strict=True)))
    seen = seen or Counter([max(weights.values(), default=1.0)])
    often = np.array(list(seen.values()), float)
    values, chances = np.r_[list(seen), model.drift], np.r_[often * (q_clean / often.sum()), 1 - q_clean]
    model.rate = decay(values, chances / chances.sum())
    held = scanned(rest, model)
    peaks = [model.rate * max(s) - math.log(max(1, n)) for s, n, t in zip(held.segments, held.words, held.toxic, strict=True) if t == 0 and len(s)]
    # The mean of the law is log K plus Euler's constant; documents without any segment count at the least peak seen.
    model.log_k = float(np.mean(peaks)) - 0.5772 if len(peaks) >= 20 else 0.0
    x = np.array([model.summary([(0, 0, v) for v in s], n) for s, n in zip(held.segments, held.words, strict=True)]).reshape(-1, 2)
    y = held.toxic.to_numpy(float)
    if len(set(y)) < 2:
        return Model(fixed=float(total[1]) / everything)
    back = np.where(y == 1, total[1] / max(1, y.sum()), total[0] / max(1, (1 - y).sum()))  # to the labels' own shares
    model.curve = tuple(float(v) for v in logistic(x / np.array([10.0, 1.0]), y, back * len(y) / everything))
    return model


PASSAGES = "array<struct<start:int,stop:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score``, ``predicted`` and the significant ``passages`` (code points; score; count expected by chance) of each row.

    ``text`` may be a field of ``doc_id``, as ``row.text`` is of ``row``: it then travels once, inside the id.
    """
    inside = text.removeprefix(f"{doc_id}.") if text.startswith(f"{doc_id}.") else None
    frame = docs.select(F.col(doc_id).alias("id"), *([] if inside else [F.col(text).alias("text")]))
    schema = T.StructType([frame.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T._parse_datatype_string(PASSAGES))])

    def work(batches):
        for batch in batches:
            scores, passages = [], []
            for t in batch.column(0).field(inside) if inside else batch.column(1):
                low = lowered(t.as_py() or "")
                words = WORD.findall(low)
                segments = maximal_segments(model.hits(words), model.drift)
                scores.append(model.probability(model.summary(segments, len(words))))
                kept = [(a, b, s, e) for a, b, s in segments if (e := math.exp(-max(-30.0, model.normalised(s, len(words))))) <= ALPHA]
                spans = [m.span() for m in WORD.finditer(low)] if kept else []
                passages.append([{"start": spans[a][0], "stop": spans[b][1], "score": s, "expected": e} for a, b, s, e in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, kind)], names=schema.names)

    kind = to_arrow_type(schema["passages"].dataType)
    return frame.mapInArrow(work, schema)
