"""Approximate nearest neighbours by learned partitions.

As in "Learning Space Partitions for Nearest Neighbor Search" (Dong, Indyk, Razenshteyn and Wagner,
2020): on a bounded sample the graph of near neighbours is cut into balanced parts, and a small softmax
classifier learns which part a vector's neighbours lie in. The classifier then puts every vector of the
table into its most probable partition, and routes a query to the several most probable ones, whose
vectors are ranked by exact cosine.

Vectors that are equal in all components are one candidate with the least ids: no more than ``k`` + 1 of
them can be among any query's ``k`` nearest, as equal scores go to smaller ids. A partition is dealt out
in blocks of at most about ``BLOCK`` vectors, so none is one task's, however many vectors it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import materialize, shuffle_partitions

#: The partitions are fitted to so many vectors at most: those of the least hashes of their ids.
SAMPLE = 16_384
#: Vectors to a partition, about, and the bounds of the number of partitions.
PER_PARTITION, LEAST_PARTITIONS, MOST_PARTITIONS = 1_024, 4, 256
NEIGHBOURS = 10
#: The partitions that a query visits are as many as held-out rows of the sample need for this recall.
TARGET_RECALL, CALIBRATED = 0.94, 1_024
BLOCK = 4_096


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by the largest component first keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by cosine, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for each row, none much above its share, that keeps neighbours together.

    It starts from balanced spherical k-means and then moves rows, most eager first, to the part that most
    of their neighbours (both ways) are in, as long as that part has room.
    """
    room = int(np.ceil(1.1 * len(x) / parts))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), parts, replace=False)]

    def place(wish: np.ndarray) -> np.ndarray:
        order = np.argsort(-wish, axis=1)[:, : min(parts, 16)]
        part, load = np.full(len(x), -1), np.zeros(parts, dtype=np.int64)
        top = np.take_along_axis(wish, order, axis=1)
        for row in np.argsort(-(top[:, 0] - top[:, min(1, parts - 1)]), kind="stable"):
            p = next((p for p in order[row] if load[p] < room), None)
            part[row] = int(np.argmin(load)) if p is None else p
            load[part[row]] += 1
        return part

    for _ in range(8):
        part = place(x @ centres.T)
        centres = np.stack([x[part == p].sum(0) if (part == p).any() else x[rng.integers(len(x))] for p in range(parts)])
        centres = centres / np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-12)
    head, tail = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (head, part[tail]), 1.0)
        np.add.at(votes, (tail, part[head]), 1.0)
        load = np.bincount(part, minlength=parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            if best[row] != part[row] and load[best[row]] < room:
                load[part[row]] -= 1
                load[best[row]] += 1
                part[row] = best[row]
                moved += 1
        if moved < len(x) / 200:
            break
    return part


@dataclass
class Router:
    """Softmax over partitions, linear in the unit vector."""

    weights: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def train_router(x: np.ndarray, target: np.ndarray, steps: int = 200, seed: int = 3) -> Router:
    """Fit to target distributions (rows x partitions) by Adam on minibatches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    first, second = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for k in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(1024, len(x)))
        z = x[rows] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
        for j, slope in enumerate((x[rows].T @ error, error.sum(0))):
            first[j] = 0.9 * first[j] + 0.1 * slope
            second[j] = 0.99 * second[j] + 0.01 * slope**2
            step = 0.3 * (1 - k / (steps + 1)) * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.99**k)) + 1e-8)
            if j == 0:
                w -= step
            else:
                b -= step
    return Router(w, b)


def probes_needed(router: Router, x: np.ndarray, queries: np.ndarray, near: np.ndarray) -> int:
    """The least number of partitions with which the queries (rows of x) find TARGET_RECALL of ``near``."""
    home = router.logits(x).argmax(1)
    place = np.argsort(np.argsort(-router.logits(x[queries]), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET_RECALL * len(ranks))))]) + 1


def fit_router(vectors: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """Graph, balanced partition and classifier for a sample of vectors, and the partitions to visit.

    The rows that the number of visits is measured on are not among those that the classifier is trained
    on. The sample is thinner than the table, so their neighbours are farther, and the number rather high.
    """
    x = _unit(vectors)
    if parts < 2 or len(x) < 8 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1)), 1
    graph = neighbour_graph(x, max(NEIGHBOURS, k))
    held = np.arange(len(x)) < min(CALIBRATED, len(x) // 4)
    kept = np.flatnonzero(~held)
    own = neighbour_graph(x[kept], NEIGHBOURS)
    part = balanced_partition(x[kept], own, parts)
    # what a vector should be routed to: where it is itself, and where its neighbours are
    target = np.zeros((len(kept), parts))
    np.add.at(target, (np.repeat(np.arange(len(kept)), own.shape[1]), part[own].ravel()), 0.5 / own.shape[1])
    target[np.arange(len(kept)), part] += 0.5
    router = train_router(x[kept], target)
    queries = np.flatnonzero(held)
    cosines = np.take_along_axis(x[queries] @ x.T, graph[queries], axis=1)
    near = np.take_along_axis(graph[queries], np.argsort(-cosines, axis=1)[:, :k], axis=1)
    return router, probes_needed(router, x, queries, near)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _route(router, probes: int, sizes: np.ndarray | None = None, least: int = 0):
    """Adds the most probable partitions: ``probes`` of them, and more where those hold fewer than ``least`` candidates."""

    def run(batches):
        r = router.value
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = r.logits(_unit(_matrix(batch.column("v"))))
            n = min(probes, logits.shape[1])
            order = np.argsort(-logits, axis=1, kind="stable").astype(np.int32)
            if sizes is None:
                top = order[:, :n].tolist()
            else:
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
                top = [row[: max(n, m)] for row, m in zip(order.tolist(), enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; the same for the same two vectors wherever they stand.

    Rows are scaled by powers of two first, which leaves the result as it is and keeps squares in range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _rank_block(k: int):
    """The k nearest candidates, in one block, of each query that is routed to it."""

    def run(key, table):
        own = table.combine_chunks()
        lists = own.column("ids").to_pylist()
        v = _matrix(own.column("v").combine_chunks() if own.num_rows else own.column("v"))
        is_query = own.column("is_query").to_numpy(zero_copy_only=False)
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out = []
        if len(q) and len(c):
            u = _unit(v)
            take = min(len(c), k + 8)  # some more than k, ranked again exactly
            for at in range(0, len(q), 512):
                rows = q[at : at + 512]
                near = u[rows] @ u[c].T
                top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                floor = np.take_along_axis(near, top, axis=1).min(axis=1) - 1e-9
                for i, row in enumerate(rows):
                    found = c[near[i] >= floor[i]]
                    score = cosine(np.repeat(v[row][None], len(found), 0), v[found])
                    me = lists[row][0]
                    ranked = sorted((-s, j) for s, f in zip(score.tolist(), found.tolist(), strict=True) for j in lists[f] if j != me)
                    out += [(me, j, -s) for s, j in ranked[:k]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows of other ids. The
    measure is the cosine in double precision; ties go to smaller ids. Vectors that are null, empty, zero
    or hold a null or non-finite component, and rows with a null id, take no part; of vectors of several
    lengths, those of the most frequent length (of equals the least) do. Of rows that repeat an id the
    one of the least vector does. Other columns are ignored; an empty table gives an empty result. The
    index is approximate only in which partitions a query visits; it visits further ones, in the router's order,
    until they hold ``k`` candidates.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == sizes["n"]).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows.withColumn("same", F.xxhash64("v")))

    count = sizes["count"]
    parts = int(min(MOST_PARTITIONS, max(LEAST_PARTITIONS, count // PER_PARTITION)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    router, probes = fit_router(_matrix(sample.column("v").combine_chunks()), parts, k)
    routed = spark.sparkContext.broadcast(router)

    # of equal vectors k + 1 ids at most, and one of them may be the query itself
    few = Window.partitionBy("same", "v").orderBy("id")
    distinct = rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    distinct = distinct.groupBy("same", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    schema = "ids array<long>, v array<double>, parts array<int>"
    index = distinct.select("ids", "v").mapInArrow(_route(routed, 1), schema)
    index = materialize(index.select("ids", "v", F.col("parts")[0].alias("part")))
    held = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("n_ids")).collect()
    blocks = {r["part"]: -(-r["n"] // BLOCK) for r in held}
    if not blocks:
        return spark.createDataFrame([], empty)
    sizes_of = np.zeros(parts, dtype=np.int64)
    for r in held:
        sizes_of[r["part"]] = r["n_ids"]
    # k candidates and the query itself; all partitions where even they hold fewer
    queries = rows.where(F.col("id") % query_every == 0).select(F.array("id").alias("ids"), "v").mapInArrow(_route(routed, probes, sizes_of, k + 1), schema)

    many = F.coalesce(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("part")], F.lit(0))
    index = index.withColumn("block", F.pmod(F.xxhash64("v"), many.cast("long")).cast("int")).withColumn("is_query", F.lit(False))
    # queries come in batches too, so that a partition with many of them is not one task's either
    queries = queries.withColumn("part", F.explode("parts")).withColumn("n", many).where("n > 0")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("is_query", F.lit(True))
    both = index.select("ids", "v", "part", "block", "is_query").union(queries.select("ids", "v", "part", "block", "is_query"))
    found = both.repartition(shuffle_partitions(spark), "part", "block").groupBy("part", "block").applyInArrow(_rank_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
