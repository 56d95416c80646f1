"""Exact nearest vectors by cosine, as a join of cells around pivots (cf. Lu et al., VLDB 2012).

A bounded sample of vectors serves as pivots; each vector is stored in the cell of
its nearest pivot with its distance from it. By the triangle inequality a cell
whose ring of distances is too far from a query holds none of its nearest. Each
query first looks into the cell that it would be in itself, which gives a score
that its k-th best cannot be under, and then into every cell that can hold a
better one. Cells and queries meet in blocks of bounded size. On vectors without
clusters the bounds rule out little and nearly all is compared: exact search has
no way round that, and what was compared is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut

#: Pivots at most; vectors and queries in a block, about.
PIVOTS, BLOCK = 1024, 4096
#: Scores are rounded to nine digits; a difference that rounding may hide.
SLACK = 2e-9
PLACED = "cell int, reach double, vec_id long, unit array<double>"
ASKED = "cell int, chunk int, qblock int, query_id long, unit array<double>, n long"


def _units(frame: pd.DataFrame) -> np.ndarray:
    v = np.array(frame["embedding"].tolist(), float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * unit @ pivots.T))


def search(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest of each query, itself left out, and what was compared for it.

    The one is ``query_id``, ``vec_id``, ``score``, ``rank`` (ties to the smaller id), the other ``query_id``, ``compared``
    (vectors in the cells that it looked into). Both inputs have ``vec_id`` and ``embedding``; vectors that are null or hold
    nulls take no part. A vector of zeros is near nothing: its score is 0 with everything.
    """
    spark = vectors.sparkSession
    whole = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    queries, vectors = (x.select("vec_id", "embedding").where(whole) for x in (queries, vectors))
    total, asked = vectors.count(), queries.count()
    m = pivots or max(1, min(PIVOTS, round(total**0.5)))
    chosen = vectors.where("exists(embedding, x -> x <> 0)").orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).toPandas()  # PIVOTS at most
    if chosen.empty:
        chosen = vectors.limit(1).toPandas()
    if chosen.empty:
        empty = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        return empty, spark.createDataFrame([], "query_id long, compared long")
    around = spark.sparkContext.broadcast(_units(chosen))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                unit = _units(frame)
                far = _distances(unit, around.value)
                cell = far.argmin(axis=1)
                reach = far[np.arange(len(far)), cell]
                zero = ~unit.any(axis=1)  # on no sphere: a cell of their own, which all look into
                yield pd.DataFrame({"cell": np.where(zero, -1, cell), "reach": np.where(zero, 0.0, reach), "vec_id": frame["vec_id"], "unit": list(unit)})

    placed = cut(vectors.mapInPandas(place, PLACED))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).toPandas().sort_values("cell", ignore_index=True)  # a row for each pivot
    cells["chunks"] = -(-cells["n"] // BLOCK)
    qblocks = max(1, -(-asked // BLOCK))
    ring = spark.sparkContext.broadcast(cells)

    def visits(frame: pd.DataFrame, least: np.ndarray | None) -> pd.DataFrame:
        """Which cells each query looks into: the likeliest, or with a score to beat all others that can hold such."""
        cells, unit = ring.value, _units(frame)
        zero = ~unit.any(axis=1)
        at = cells["cell"].to_numpy()
        far = np.where(at >= 0, _distances(unit, around.value)[:, np.maximum(at, 0)], 0.0)
        first = np.where(at >= 0, far, np.inf).argmin(axis=1)
        mine = np.zeros(far.shape, bool)
        mine[np.arange(len(far)), first] = True
        if least is not None:
            gap = np.maximum(0.0, np.maximum(far - cells["high"].to_numpy(), cells["low"].to_numpy() - far))
            can = (1.0 - gap**2 / 2.0 >= least[:, None] - SLACK) | (at < 0) | zero[:, None]
            mine = can & ~mine
        rows, which = np.nonzero(mine)
        chunks = cells["chunks"].to_numpy()[which]
        chunk = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        rows, which = np.repeat(rows, chunks), np.repeat(which, chunks)
        ids = frame["vec_id"].to_numpy()[rows]
        n = np.where(chunk == 0, cells["n"].to_numpy()[which], 0)
        return pd.DataFrame({"cell": at[which], "chunk": chunk, "qblock": ids % qblocks, "query_id": ids, "unit": list(unit[rows]), "n": n})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield visits(frame, frame["least"].to_numpy() if "least" in frame else None)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s = np.round(np.stack(right["unit"]) @ np.stack(left["unit"]).T, 9)
        own, ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        s[ids[:, None] == own[None]] = -np.inf
        best = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
        at = np.repeat(np.arange(len(ids)), best.shape[1])
        out = pd.DataFrame({"query_id": ids[at], "vec_id": own[best.ravel()], "score": s[at, best.ravel()]})
        return out[np.isfinite(out["score"])]

    sizes = F.broadcast(spark.createDataFrame(cells[["cell", "chunks"]].astype("int32")))
    dealt = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"), "vec_id", "unit")

    def meet(rows: DataFrame) -> DataFrame:
        keys = ["cell", "chunk", "qblock"]
        return dealt.join(rows.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    early = cut(queries.mapInPandas(ask, ASKED))
    near = cut(meet(early).withColumn("rank", best).where(F.col("rank") <= k))
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    late = cut(queries.join(least, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", F.lit(-2.0)).alias("least")).mapInPandas(ask, ASKED))
    found = near.select("query_id", "vec_id", "score").union(meet(late)).withColumn("rank", best).where(F.col("rank") <= k)
    return found, early.select("query_id", "n").union(late.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("compared"))


def retrieve_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``, ``rank``: the k nearest by cosine, itself left out; exact."""
    return search(queries, vectors, k)[0]
