"""Approximate nearest neighbours over balanced posting lists.

Distinct vectors are grouped around centroids, about ``PER_ROOT`` times the square root of their
number, which a sample gives by splitting clusters in two until none is large (so that lists are
balanced); a sample that is too large for one task is split in cells first, each of which is fitted by a task
of its own. A vector near a boundary goes into several lists: those of the
``REPLICAS`` nearest whose centroid is at most ``BOUNDARY`` times as far as the
nearest. A query walks a graph
of the centroids in memory, takes all within a ratio of the nearest
distance, and further ones until they hold ``k + 1`` distinct vectors, and is
compared with all of their vectors; short lists lie together in parts, to each of which a
query goes once, and a long list is split in parts that are searched apart. A pass over all centroids adds those within the ratio that the walk did not meet. The ratio is the
least that reaches ``TARGET`` of the nearest neighbours, among all vectors, of ``TRIALS`` of the queries themselves:
these may lie elsewhere than most vectors, and then need more lists than a vector of the sample does.

How much this saves depends on the vectors: where they form clusters few lists are near, while
among vectors of many dimensions without any structure all centroids are about as far away.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all of
them that any query can need, since ties go to smaller ids.

Cases: vectors that are null, empty, zero, of another dimension than most, or hold null
or non-finite components take no part; ids that are null take no part; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import stored

#: Lists for the square root of the number of vectors; vectors of the sample for a list, about; members of a cluster of the sample, at most.
PER_ROOT, FIT_EACH, FIT_CLUSTER = 3.3, 27, 40
#: Vectors that one task fits, about; rows of a part, of lists or of a long list, about; queries whose rows are made at once.
FIT_ROWS, CHUNK, ASKED = 20_000, 4096, 64
DEGREE, WALK, REPLICAS, BOUNDARY = 24, 64, 4, 1.15
TARGET, TRIALS = 0.95, 256


@dataclass
class Index:
    """Centroids and, for each, the numbers of its nearest others."""

    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    ratio: float = 1.3

    def nearest(self, vector: np.ndarray, width: int = WALK) -> list[int]:
        """Best-first walk of the graph: numbers of the centroids within the ratio of the nearest one's distance, nearest first.

        It goes on until what is left to follow lies beyond that distance and beyond the ``width`` nearest met.
        """
        c, ratio = self.centroids, self.ratio
        d = np.sqrt(((c[self.entry] - vector) ** 2).sum(axis=1))
        met = dict(zip(self.entry.tolist(), d.tolist(), strict=True))
        todo = [(x, i) for i, x in met.items()]
        heapq.heapify(todo)
        best = heapq.nlargest(width, (-x for x in met.values()))
        heapq.heapify(best)
        least = min(met.values())
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= width and x > max(-best[0], ratio * least):
                break
            fresh = [j for j in self.graph[i].tolist() if j not in met]
            if not fresh:
                continue
            for y, j in zip(np.sqrt(((c[fresh] - vector) ** 2).sum(axis=1)).tolist(), fresh, strict=True):
                met[j] = y
                heapq.heappush(todo, (y, j))
                if len(best) < width:
                    heapq.heappush(best, -y)
                elif y < -best[0]:
                    heapq.heapreplace(best, -y)
            least = min(least, -max(best))
        return [i for x, i in sorted((x, i) for i, x in met.items() if x <= ratio * least + 1e-12)]

    def lists_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The clusters that hold each vector: the nearest, and others across whose boundary it lies."""
        out = []
        for i in range(0, len(vectors), 1024):
            x = vectors[i : i + 1024]
            d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1)[None] - 2 * x @ self.centroids.T, 0))
            at = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
            near = np.take_along_axis(d, at, axis=1)
            out += [a[n <= BOUNDARY * n[0] + 1e-12] for a, n in zip(at, near, strict=True)]
        return out

    def lists_for(self, query: np.ndarray, owned: np.ndarray, least: int) -> list[int]:
        """The clusters that a query is compared with, of ``least`` distinct vectors at least if there are so many.

        ``owned`` counts the vectors of which a cluster is the nearest, so that none counts twice.
        """
        out = self.nearest(query)
        taken = set(out)
        d = np.sqrt(((self.centroids - query) ** 2).sum(axis=1))
        # The walk can end in a part of the graph that few links leave.
        missed = [i for i in np.flatnonzero(d <= self.ratio * d.min() + 1e-12).tolist() if i not in taken]
        out += missed
        taken.update(missed)
        held = int(owned[out].sum())
        if held < least:
            for i in np.argsort(d, kind="stable").tolist():
                if held >= least:
                    break
                if i not in taken:
                    out.append(i)
                    held += int(owned[i])
        return out


def balanced_centroids(x: np.ndarray, most: int = FIT_CLUSTER, seed: int = 5) -> np.ndarray:
    """Means of clusters of at most ``most`` rows: each larger one is split in two by 2-means, in halves where that is one-sided."""
    rng = np.random.default_rng(seed)
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(x[rows].mean(axis=0))
            continue
        part = x[rows]
        pair = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            gap = part @ (pair[1] - pair[0]) - (pair[1] @ pair[1] - pair[0] @ pair[0]) / 2
            side = gap > 0
            if side.all() or not side.any():
                break
            pair = np.stack([part[~side].mean(axis=0), part[side].mean(axis=0)])
        share = side.mean()
        if not 0.2 <= share <= 0.8:
            order = np.argsort(gap, kind="stable")
            side = np.zeros(len(rows), bool)
            side[order[len(rows) // 2 :]] = True
        todo += [rows[side], rows[~side]]
    return np.array(done)


def build_index(c: np.ndarray, sample: np.ndarray, k: int = 10) -> Index:
    near = []
    for i in range(0, len(c), 512):
        d = ((c[i : i + 512] ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None]) - 2 * c[i : i + 512] @ c.T
        near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1])
    near = np.concatenate(near)
    # A few links at random join what nearness alone leaves apart.
    far = np.random.default_rng(3).integers(0, len(c), (len(c), 4))
    index = Index(c, np.concatenate([near, far], axis=1), np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(int)))
    index.ratio = ratio_for(index, sample, k)
    return index


def ratio_for(index: Index, sample: np.ndarray, k: int) -> float:
    """How far lists must be searched, in units of the nearest centroid's distance, to meet TARGET of the k nearest."""
    lists, needed = index.lists_of(sample), []
    for i in np.unique(np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)):
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        to_lists = np.sqrt(((index.centroids - sample[i]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        needed += [to_lists[lists[j]].min() / max(to_lists.min(), 1e-12) for j in near]
    return max(1.0, float(np.quantile(needed, TARGET, method="higher"))) if needed else 1.0


def true_neighbours(held: DataFrame, trials: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """For each of ``trials`` the k nearest other vectors of ``held``, by comparison with all of them; one pass, k rows a trial and task."""
    shared = held.sparkSession.sparkContext.broadcast((trials, trials.mean(axis=0)))

    def nearest(batches):
        asked, middle = shared.value
        q = asked - middle
        best = [[] for _ in q]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            near = (x - middle) @ q.T
            d = ((x - middle) ** 2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None] - 2 * near
            # A trial is its own nearest one, which does not count below.
            at = np.argpartition(d, min(k, len(x) - 1), axis=0)[: k + 1]
            for j in range(len(q)):
                rows = x[at[:, j]]
                best[j] = sorted(best[j] + list(zip(((rows - asked[j]) ** 2).sum(axis=1).tolist(), rows.tolist(), strict=True)))[: k + 1]
        found = [(j, d, v) for j, rows in enumerate(best) for d, v in rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.float64()), pa.array([r[2] for r in found], pa.list_(pa.float64()))], names=["trial", "d", "v"])

    met = held.select("v").mapInArrow(nearest, "trial int, d double, v array<double>")
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("trial").orderBy("d", "v"))).where(F.col("nth").between(2, k + 1))
    out: dict[int, list] = {}
    for r in first.select("trial", "v").collect():  # k rows for each of TRIALS
        out.setdefault(r["trial"], []).append(r["v"])
    return {j: np.array(v, float) for j, v in out.items()}


def ratio_of_queries(index: Index, held: DataFrame, queries: DataFrame, k: int) -> float:
    """How far lists must be searched, in units of the nearest centroid's distance, to meet TARGET of the nearest vectors of TRIALS queries (``key``, ``v``)."""
    trials = np.array([r["v"] for r in queries.orderBy(F.xxhash64("key"), "key").limit(TRIALS).select("v").collect()], float)
    if not len(trials):
        return index.ratio
    needed = []
    for j, near in true_neighbours(held, trials, k).items():
        to_lists = np.sqrt(((index.centroids - trials[j]) ** 2).sum(axis=1))
        needed += [to_lists[lists].min() / max(to_lists.min(), 1e-12) for lists in index.lists_of(near)]
    return max(1.0, float(np.quantile(needed, TARGET, method="higher"))) if needed else 1.0


def fit(held: DataFrame, k: int = 10) -> Index:
    """The index of a sample of the distinct vectors (``key``, ``v``). Centroids, as many as grow with the root of their number, reach the driver, and vectors of about FIT_ROWS."""
    spark, n = held.sparkSession, held.count()
    wanted = FIT_EACH * max(1, round(PER_ROOT * n**0.5))
    place = F.xxhash64("key").cast("double") / 2.0**64 + 0.5

    def sample(rows: int) -> DataFrame:
        return held.where(place <= min(1.0, rows / max(1, n))).orderBy("key").select("v")

    first = np.array([r["v"] for r in sample(min(wanted, FIT_ROWS)).collect() or held.orderBy("key").limit(FIT_ROWS).select("v").collect()], float)
    # As many neighbours in the sample as lie, on average, among the k nearest of all.
    k = max(1, round(k * len(first) / max(1, n)))
    if wanted <= FIT_ROWS or n <= FIT_ROWS:
        return build_index(balanced_centroids(first), first, k)
    cells = spark.sparkContext.broadcast(balanced_centroids(first, max(2, len(first) * FIT_ROWS // (2 * wanted))))

    def place_in(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            d = (cells.value**2).sum(axis=1)[None] - 2 * x @ cells.value.T
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1), pa.int64()), batch.column(0)], names=["cell", "v"])

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(rows["v"].tolist(), key=tuple))
        return pd.DataFrame({"v": list(balanced_centroids(x))})

    found = held.where(place <= min(1.0, wanted / n)).select("v").mapInArrow(place_in, "cell long, v array<double>").groupBy("cell").applyInPandas(split, "v array<double>")
    return build_index(np.array(sorted(r["v"] for r in found.collect())), first, k)


def parts_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of so many rows the first part that each is in, and in how many it is: short lists share a part of CHUNK rows at most, a longer one is cut in parts of its own."""
    first, pieces, part, held = np.zeros(len(sizes), np.int64), -(-sizes // CHUNK), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > CHUNK:
            part, held = part + 1, 0
        first[i] = part
        held += n
        if held > CHUNK:
            part, held = part + int(pieces[i]), 0
    return first, pieces


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    v = rows.select(F.col(vec_id).cast("long").alias("id"), doubles.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """``key``, ``v``, ``ids``: each distinct vector with its ``k + 1`` smallest ids."""
    # Negative zero is zero here too.
    keyed = vectors.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("nth") <= k + 1)
    return ranked.groupBy("key").agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def search(rows: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each id divisible by ``every`` the k nearest other rows."""
    spark = rows.sparkSession
    vectors = usable(rows, vec_id, vector)
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    vectors = vectors.where(F.size("v") == sizes[0]["d"])
    held = stored(entries(vectors, k), "vectors")
    asked = vectors.where(F.col("id") % every == 0)
    query_keys = stored(entries(asked, 0).select("key", "v"), "queries")
    fitted = fit(held, k)
    fitted.ratio = ratio_of_queries(fitted, held, query_keys, k)
    index = spark.sparkContext.broadcast(fitted)

    def post(batches):
        for batch in batches:
            lists = index.value.lists_of(matrix(batch.column(1)))
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            nearest = np.concatenate([np.arange(len(x)) == 0 for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int64()), *(batch.column(i).take(pa.array(at)) for i in range(3)), pa.array(nearest)], names=["list", "key", "v", "ids", "nearest"])

    postings = stored(held.select("key", "v", "ids").mapInArrow(post, "list long, key string, v array<double>, ids array<long>, nearest boolean"), "postings")
    # Numbers of each list, of which there are as many as centroids.
    owned, sizes = np.zeros((2, len(index.value.centroids)), np.int64)
    for r in postings.groupBy("list").agg(F.count_if("nearest").alias("owned"), F.count("*").alias("n")).collect():
        owned[r["list"]], sizes[r["list"]] = r["owned"], r["n"]
    first, pieces = parts_of(sizes)
    shared = spark.sparkContext.broadcast((owned, first, pieces))

    def ask(batches):
        owned, first, pieces = shared.value
        for batch in batches:
            # A query has a row for each part that it meets: few queries at once, whatever a batch has.
            for start in range(0, batch.num_rows, ASKED):
                some = batch.slice(start, ASKED)
                parts, at, lists = [], [], []
                for i, x in enumerate(matrix(some.column(1))):
                    met: dict[int, list[int]] = {}
                    for which in index.value.lists_for(x, owned, k + 1):
                        for part in range(first[which], first[which] + pieces[which]):
                            met.setdefault(part, []).append(which)
                    parts += met
                    at += [i] * len(met)
                    lists += met.values()
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(lists, pa.list_(pa.int64())), *(some.column(i).take(pa.array(at, pa.int64())) for i in range(2))], names=["part", "lists", "query", "q"])

    # A query is sent once to a part and not to each of its lists. Only the places of lists are broadcast: what is asked grows faster than the vectors.
    questions = query_keys.mapInArrow(ask, "part long, lists array<long>, query string, q array<double>")
    places = spark.createDataFrame([(i, int(first[i]), int(pieces[i])) for i in np.flatnonzero(sizes).tolist()], "list long, first long, pieces long")
    dealt = postings.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("key"), F.col("pieces"))).alias("part"), "list", "key", "v", "ids")

    def compare(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if members.empty or queries.empty:
            return pd.DataFrame(columns=["query", "key", "ids", "score"], dtype=object)
        x = np.array(members["v"].tolist())
        keys, ids = members["key"].tolist(), [list(i) for i in members["ids"]]
        least, lists = np.array([i[0] for i in ids]), members["list"].to_numpy()
        # A vector is in REPLICAS lists at most, so that so many rows hold k + 1 vectors.
        enough = REPLICAS * (k + 1)
        out = []
        for query, q, asked_lists in zip(queries["query"], queries["q"], queries["lists"], strict=True):
            rows = np.flatnonzero(np.isin(lists, asked_lists))
            d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
            if len(d) > enough:
                near = np.flatnonzero(d <= np.partition(d, enough - 1)[enough - 1])
                rows, d = rows[near], d[near]
            best: dict[str, tuple[int, float]] = {}
            for j in np.lexsort((least[rows], d)).tolist():
                if len(best) > k:
                    break
                best.setdefault(keys[rows[j]], (rows[j], float(d[j])))
            out += [(query, key, ids[i], score) for key, (i, score) in best.items()]
        return pd.DataFrame(out, columns=["query", "key", "ids", "score"])

    near = dealt.groupBy("part").cogroup(questions.groupBy("part")).applyInPandas(compare, "query string, key string, ids array<long>, score double")
    # A vector met in several lists counts once; k + 1 entries hold the k nearest rows whichever row asks.
    once = near.groupBy("query", "key").agg(F.any_value("ids").alias("ids"), F.any_value("score").alias("score"))
    hits = once.select("query", "score", F.explode("ids").alias("vec_id"))
    top = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    found = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    askers = asked.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select(F.col("id").alias("query_id"), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256).alias("query"))
    own = askers.join(found, "query").select("query_id", F.posexplode(F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {k})")).alias("at", "hit"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", F.col("hit.score").alias("score"))
