"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of a fixed number of bytes that cover them whole.
Filters of several widths slide over the byte embeddings of a window, each
gives its largest response, and a softmax turns these into languages; a
document has the mean over its windows. The network is fitted on the driver
to a bounded sample of labelled windows: about ``FIT_DOCS`` different texts of a
language and ``FIT_WINDOWS`` windows of a text, which lie evenly over all of it. The second
bound keeps a few very long texts from making up most of what is learnt; prediction
reads every window of every text.

Cases: a null text, or one without any letter, is ``und`` with score 0; so is
every text where nothing can be learnt (no labelled rows). Rows without a
language teach nothing. Repeated rows and ids are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.bytesvec import slices

WINDOW = 96
EMBEDDED, WIDTHS, FILTERS = 8, (2, 3, 4), 12
FIT_DOCS, FIT_WINDOWS, STEPS, BATCH = 400, 8, 240, 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width the response of every byte at each place of the filter: (width, 256, filters)."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            out.append(np.stack([self.embedding @ f[k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(w)]).astype(np.float32))
        return out

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray] | None = None, block: int = 256) -> np.ndarray:
        """Softmax over languages for each window of bytes."""
        tables = tables or self.tables()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), block):
            x = windows[i : i + block]
            pooled = []
            for w, table, bias in zip(WIDTHS, tables, self.biases, strict=True):
                n = WINDOW - w + 1
                z = table[0].take(x[:, :n], axis=0)
                for k in range(1, w):
                    z += table[k].take(x[:, k : k + n], axis=0)
                pooled.append(z.max(axis=1) + bias)
            out[i : i + block] = softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.dense_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on cross-entropy; the gradient of a max goes to the place that won it."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    params = [rng.normal(0, 0.5, (256, EMBEDDED))]
    params += [rng.normal(0, (2 / (w * EMBEDDED)) ** 0.5, (w * EMBEDDED, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(windows), min(BATCH, len(windows)))
        x, y = windows[at], labels[at]
        b = len(x)
        embedded = params[0][x]
        pooled, won, patches = [], [], []
        for j, w in enumerate(WIDTHS):
            n = WINDOW - w + 1
            unfolded = np.concatenate([embedded[:, o : o + n] for o in range(w)], axis=2)
            z = unfolded @ params[1 + j]
            best = z.argmax(axis=1)
            won.append(best)
            patches.append(unfolded[np.arange(b)[:, None], best])
            pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0] + params[1 + len(WIDTHS) + j])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        wrong = softmax(active @ params[-2] + params[-1])
        wrong[np.arange(b), y] -= 1
        wrong /= b
        grads = [np.zeros_like(p) for p in params]
        grads[-2], grads[-1] = active.T @ wrong, wrong.sum(axis=0)
        back = (wrong @ params[-2].T) * (hidden > 0)
        for j, w in enumerate(WIDTHS):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            grads[1 + j] = np.einsum("bf,bfd->df", g, patches[j])
            grads[1 + len(WIDTHS) + j] = g.sum(axis=0)
            to_bytes = g[:, :, None] * params[1 + j].T[None]
            for o in range(w):
                np.add.at(grads[0], x[np.arange(b)[:, None], won[j] + o], to_bytes[:, :, o * EMBEDDED : (o + 1) * EMBEDDED])
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    params = [p.astype(np.float32) for p in params]
    return Network(languages, params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) : 1 + 2 * len(WIDTHS)], params[-2], params[-1])


def cut(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every text, the last of each padded with zeros, and how many each text has (one at least)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] * WINDOW, np.uint8)
    shift = (ends - counts) * WINDOW - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    return out.reshape(-1, WINDOW), counts


def training_windows(labelled: DataFrame, docs: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a sample of ``text`` and ``lang``: those texts of each language that have the least hashes, each once however often it is repeated."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not total:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    languages = sorted(total)
    # A share of the hash range that holds `docs` different texts of the language, give or take.
    most = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, docs / max(1, total[lang]))))])
    chosen = rows.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= most[F.col("lang")]).dropDuplicates(["lang", "h"])
    pieces = chosen.select("lang", F.expr(f"transform(sequence(0, {windows - 1}), k -> substring(text, cast(1 + floor(greatest(char_length(text) - {WINDOW}, 0) * k / {windows - 1}) as int), {WINDOW}))").alias("cut"))
    found = pieces.select("lang", F.explode(F.array_distinct("cut")).alias("piece")).where("piece rlike '\\\\p{L}'").toPandas()
    if found.empty:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    raw = [p.encode()[:WINDOW].ljust(WINDOW, b"\0") for p in found["piece"]]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WINDOW)
    return x, np.array([languages.index(v) for v in found["lang"]], np.int64), languages


def train(labelled: DataFrame) -> Network | None:
    x, y, languages = training_windows(labelled)
    if not len(x):
        return None
    order = np.lexsort(np.r_[x.T[::-1], y[None]])  # so that a fit does not depend on the order of rows
    return fit(x[order], y[order], languages)


def predict(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` of each row."""
    frame = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if network is None:
        return frame.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([frame.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches):
        tables = network.tables()
        names = np.array([*network.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for first, offsets, data in slices(batch.column(1)):
                n = len(offsets) - 1
                windows, counts = cut(offsets, data)
                p = network.probabilities(windows, tables).astype(np.float64)
                mean = np.add.reduceat(p, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                best = mean.argmax(axis=1)
                letters = batch.column(2).slice(first, n).to_numpy(zero_copy_only=False).astype(bool)
                score = np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return frame.mapInArrow(work, schema)
