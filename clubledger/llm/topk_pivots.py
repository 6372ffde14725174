"""Exact top-k search by inner product over an index of pivot distances.

Vectors are lifted by one coordinate onto a sphere around zero, where a larger inner
product with a query is a smaller distance to it. Every vector is then keyed by its
nearest pivot and its distance to that pivot. By the triangle inequality a vector at
distance d from a pivot is at least |D - d| away from a query at distance D, so the
vectors of a pivot, sorted by distance, are searched in annuli outward from D, until
the next annulus is farther than the k-th best found so far.

The first search of a query, in one shard of its own pivot, gives a bound; with it
the query goes to those pivots only whose annuli reach into the bound. A shard is a
pivot's vectors or, where it has many, a part of them chosen by a hash. Partitions are
sorted so that a shard's vectors come before its queries; a task holds one shard and a
batch of queries. The rows of a shard travel once for every million queries that visit
it, and not at all without one. Pivots are fitted to a bounded sample; every vector is
indexed, and results are exact whatever the pivots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubledger.llm.common import hashed_share
from clubledger.session import write_through

SAMPLE_ROWS, MOST_PIVOTS = 2048, 64
#: Vectors of a shard, queries that a copy of it serves, vectors of an annulus.
SHARD_ROWS, BLOCK_QUERIES, ANNULUS_ROWS = 16384, 1 << 20, 256
KEY = ["pivot", "part", "block"]
#: Relative slack that keeps rounding from cutting off a tie.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: Column, factor: int = 64) -> Column:
    """Each component as the largest whole number not above ``factor`` times it."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def _matrix(cells: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(cells), width))
    for row, cell in zip(out, cells, strict=True):
        row[: len(cell)] = cell
    return out


def _products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; whole numbers beyond the reach of doubles go another way."""
    if exact:
        return queries @ vectors.T
    wide = [np.vectorize(int, otypes=[object])(m) for m in (queries, vectors)]
    return (wide[0] @ wide[1].T).astype(object)


class Sphere:
    """The lift: vectors of squared length up to ``most`` onto a sphere."""

    def __init__(self, most: float, pivots: np.ndarray):
        self.most = max(most, 1.0)
        self.pivots = self.lift(pivots)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.most - (vectors * vectors).sum(axis=1))
        return np.column_stack([vectors, np.sqrt(rest)])

    def _to_pivots(self, lifted: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.most - 2 * lifted @ self.pivots.T))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return self._to_pivots(self.lift(vectors))

    def query_distances(self, queries: np.ndarray) -> np.ndarray:
        """Queries are scaled to the sphere, which keeps the order of their results."""
        norms = np.linalg.norm(queries, axis=1)
        scaled = queries * (np.sqrt(self.most) / np.maximum(norms, 1e-300))[:, None]
        return self._to_pivots(np.column_stack([scaled, np.zeros(len(queries))]))

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far a vector with such a score is from its query; a query of zeros is
        equally far from all, and has no bound, like one without a score yet."""
        with np.errstate(divide="ignore", invalid="ignore"):
            squared = 2 * self.most - 2 * np.sqrt(self.most) / norms * scores
        open_ended = (norms == 0) | ~np.isfinite(scores)
        reach = np.sqrt(np.maximum(0.0, np.where(open_ended, 0.0, squared)))
        return np.where(open_ended, np.inf, reach + SLACK * np.sqrt(self.most) * 1e3)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those before."""
    chosen = [int(np.argmax((sample * sample).sum(axis=1)))]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        step = sample - sample[chosen[-1]]
        nearest = np.minimum(nearest, (step * step).sum(axis=1))
        if not nearest.max():
            break
        chosen.append(int(np.argmax(nearest)))
    return sample[chosen]


class Shard:
    """A shard's vectors in order of distance to the pivot, and their annuli."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values(["distance", "id"])
        self.pivot = int(rows["pivot"].iloc[0])
        self.vectors, self.ids = _matrix(rows["vector"], width), rows["id"].to_numpy()
        away = rows["distance"].to_numpy()
        self.starts = np.arange(0, len(rows), ANNULUS_ROWS)
        self.low = away[self.starts]
        self.high = away[np.minimum(self.starts + ANNULUS_ROWS, len(rows)) - 1]


def search_shard(
    shard: Shard, queries: pd.DataFrame, sphere: Sphere, width: int, k: int, exact: bool
) -> pd.DataFrame:
    """The best ``k`` of one shard for each query, as far as they reach its bound.

    Annuli are runs of the shard's vectors in order of distance to the pivot. Every
    query takes them from the nearest outward and leaves when its bound ends.
    """
    vectors, ids, starts, low, high = shard.vectors, shard.ids, shard.starts, shard.low, shard.high
    asked, own = _matrix(queries["vector"], width), queries["id"].to_numpy()
    norms = np.linalg.norm(asked, axis=1)
    bound = queries["bound"].to_numpy(dtype=float)
    at = sphere.query_distances(asked)[:, shard.pivot][:, None]
    gaps = np.maximum(0.0, np.maximum(low - at, at - high))
    order = np.argsort(gaps, axis=1, kind="stable")
    kind = float if exact else object
    least = -np.inf if exact else float("-inf")
    best = np.full((len(own), k), least, dtype=kind)
    best_ids = np.full((len(own), k), np.iinfo(np.int64).max)
    alive = np.arange(len(own))
    for step in range(len(starts)):
        floor = np.maximum(bound[alive], best[alive, -1].astype(float))
        turn = order[alive, step]
        alive_now = gaps[alive, turn] <= sphere.radius(norms[alive], floor)
        alive, turn = alive[alive_now], turn[alive_now]
        for a in np.unique(turn):
            some = alive[turn == a]
            span = slice(starts[a], starts[a] + ANNULUS_ROWS)
            scores = _products(asked[some], vectors[span], exact)
            scores[own[some][:, None] == ids[span][None, :]] = least
            all_scores = np.concatenate([best[some], scores], axis=1)
            all_ids = np.concatenate(
                [best_ids[some], np.broadcast_to(ids[span], scores.shape)], axis=1
            )
            if exact:
                top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            else:
                top = np.array(
                    [
                        sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k]
                        for s, i in zip(all_scores, all_ids, strict=True)
                    ]
                )
            best[some] = np.take_along_axis(all_scores, top, axis=1)
            best_ids[some] = np.take_along_axis(all_ids, top, axis=1)
    found = (best != least) & (best >= bound[:, None])
    return pd.DataFrame(
        {
            "query_id": np.repeat(own, k)[found.ravel()],
            "vec_id": best_ids[found],
            "score": [int(s) for s in best[found]],
        }
    )


def _runs(batch: pd.DataFrame):
    """A sorted batch in pieces of one shard, block and kind each."""
    keys = batch[[*KEY, "is_query"]].to_numpy()
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    edges = [0, *cuts.tolist(), len(batch)]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield tuple(keys[start][:-1]), bool(keys[start][-1]), batch.iloc[start:end]


def search_sorted(batches, sphere: Sphere, width: int, k: int, exact: bool):
    """Search a partition in which the vectors of every shard come just before the
    queries of it: one shard is held at a time, and of its queries one batch."""
    current, rows, shard = None, [], None
    for batch in batches:
        for key, is_query, piece in _runs(batch):
            if key != current:
                current, rows, shard = key, [], None
            if not is_query:
                rows.append(piece)
                continue
            if shard is None and rows:
                shard, rows = Shard(pd.concat(rows), width), []
            if shard is not None:
                yield search_shard(shard, piece, sphere, width, k, exact)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row that ``is_query``, a
    condition over ``vec_id``, the ``k`` others with the largest inner product.

    Components are whole numbers (see ``whole_numbers``) and scores exact; equal
    scores rank by the smaller id. Vectors that are null or hold a null or a number
    that is not finite, and rows without an id, take no part. Shorter vectors count
    as if they ended in zeros. Rows that repeat an id are candidates each, never of
    a query with that id; as a query such an id has the smallest of its vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("raw"))).select(
        "vec_id", whole_numbers(F.col("raw")).alias("vector")
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(squares).alias("most")
    ).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    width, exact = max(1, facts["width"]), facts["most"] < 2.0**53
    sample = hashed_share(rows, "vec_id", facts["n"], SAMPLE_ROWS, "pivots")
    sample = sample.limit(2 * SAMPLE_ROWS).toPandas().sort_values("vec_id")
    fitted = choose_pivots(_matrix(sample["vector"], width), pivots)
    sphere = spark.sparkContext.broadcast(Sphere(facts["most"], fitted))

    def place(batches):
        for batch in batches:
            distances = sphere.value.distances(_matrix(batch["vector"], width))
            batch["pivot"] = distances.argmin(axis=1).astype("int32")
            batch["distance"] = distances.min(axis=1)
            yield batch

    index = write_through(
        rows.mapInPandas(place, rows.select("*").schema.add("pivot", "integer").add("distance", "double")),
        "pivot-index",
    )
    # One row per pivot, so never more than MOST_PIVOTS.
    shells = index.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")
    ).toPandas()
    parts = {int(p): -(-int(n) // shard_rows) for p, n in zip(shells["pivot"], shells["n"])}
    shells["parts"] = [parts[int(p)] for p in shells["pivot"]]
    n_parts = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("pivot"))
    part = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), n_parts).cast("int")
    shards = index.withColumn("part", part)
    queries = (
        index.where(is_query)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min(F.struct("vector", "pivot")).alias("q"))
        .select("query_id", "q.vector", "q.pivot")
    )
    result = "query_id bigint, vec_id bigint, score bigint"

    def searched(asked: DataFrame, visits: dict[int, int], rows: DataFrame) -> DataFrame:
        """``asked(pivot, part, query_id, vector, bound)`` against the index rows of those
        shards. ``visits`` are the queries of a shard of each pivot: so many blocks of
        queries there are, and so often its rows are repeated, once as a rule."""
        blocks = {p: -(-n // block_queries) for p, n in visits.items() if n}
        if not blocks:
            return spark.createDataFrame([], result)
        n_blocks = F.element_at(
            F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("pivot")
        )
        block = F.pmod(F.xxhash64(F.lit("block"), "query_id"), n_blocks).cast("int")
        met = rows.where(F.col("pivot").isin(list(blocks))).select(
            "pivot", "part", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"),
            F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), "vector", "distance",
            F.lit(None).cast("double").alias("bound"),
        )
        asking = asked.select(
            "pivot", "part", block.alias("block"), F.lit(True).alias("is_query"),
            F.col("query_id").alias("id"), "vector", F.lit(None).cast("double").alias("distance"), "bound",
        )
        # A number of its own: the work is in the meetings, not in the bytes by which
        # Spark would merge partitions.
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        streams = met.unionByName(asking).repartition(n, *KEY).sortWithinPartitions(*KEY, "is_query")
        return streams.mapInPandas(
            lambda batches: search_sorted(batches, sphere.value, width, k, exact), result
        )

    # First the shard around each query, for a bound.
    home = queries.withColumn("part", F.lit(0)).withColumn("bound", F.lit(float("-inf")))
    # One row per pivot here and below.
    at_home = {r["pivot"]: r["n"] for r in queries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = write_through(searched(home, at_home, shards.where("part = 0")), "near")
    bounds = near.groupBy("query_id").agg(
        F.min("score").cast("double").alias("bound"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= k)
    bounded = queries.join(bounds.drop("n"), "query_id", "left").na.fill(
        float("-inf"), subset=["bound"]
    )

    def reached(batch: pd.DataFrame) -> np.ndarray:
        """For each query of a batch, the pivots whose annuli reach into its bound."""
        low, high = shells["low"].to_numpy(), shells["high"].to_numpy()
        asked = _matrix(batch["vector"], width)
        at = sphere.value.query_distances(asked)[:, shells["pivot"].to_numpy()]
        gaps = np.maximum(0.0, np.maximum(low - at, at - high))
        bound = batch["bound"].to_numpy(dtype=float)
        return gaps <= sphere.value.radius(np.linalg.norm(asked, axis=1), bound)[:, None]

    def count_visits(batches):
        for batch in batches:
            yield pd.DataFrame({"pivot": shells["pivot"], "n": reached(batch).sum(axis=0)})

    def reach(batches):
        """Each query once for every other shard whose annuli reach into its bound."""
        numbers, n_parts = shells["pivot"].to_numpy(), shells["parts"].to_numpy()
        for batch in batches:
            q, p = np.nonzero(reached(batch))
            times = n_parts[p]
            q, p = np.repeat(q, times), np.repeat(p, times)
            number = np.concatenate([np.arange(t) for t in times] or [np.empty(0, int)])
            out = batch.iloc[q][["query_id", "vector", "bound"]].copy()
            out["home"] = batch["pivot"].to_numpy()[q]
            out["pivot"], out["part"] = numbers[p].astype("int32"), number.astype("int32")
            yield out[(out["home"] != out["pivot"]) | (out["part"] != 0)].drop(columns="home")

    counted = bounded.select("vector", "bound").mapInPandas(count_visits, "pivot int, n bigint")
    visits = {r["pivot"]: r["n"] for r in counted.groupBy("pivot").agg(F.sum("n").alias("n")).collect()}
    wide = "query_id bigint, vector array<double>, bound double, pivot int, part int"
    far = searched(bounded.mapInPandas(reach, wide), visits, shards)
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
