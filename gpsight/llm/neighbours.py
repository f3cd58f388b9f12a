"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Centroids come from balanced splits of a bounded sample. A graph over the centroids, searched
best-first with a beam, finds the lists near a vector. Vectors near a border go to every list whose
centroid is almost as near as the nearest. A query's beam is widened until it holds every list
whose distance is within a ratio of its nearest. Inner products become distances by one more
component (sqrt(M² - |x|²), M the largest norm).

A query reads its lists in rounds, nearest first, each round a few times as many as before. Every
round gives a score that its k-th neighbour reaches at least: in the next one a list whose
centroid's score plus the query's length times the list's largest residual stays below it is
left out, and only scores that reach it are passed on. So what is exchanged is some multiple of
k for each query and round, and the number of rounds grows with the logarithm of the table.

All vectors are indexed; only the fit uses the sample. Small lists are read together as a
cell; large ones are cut into parts of bounded size, and the queries of a cell into blocks, so
no task holds a whole hot list. Scores are
computed on the original vectors in double precision, a component at a time, so equal vectors
score equally and ties go to the smaller id.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do null ids and vectors of another length than the most frequent one; rows that repeat an
id and its vector count once, and an id with several vectors has its best score; with fewer than k
candidates all are returned; an empty table gives no rows; other columns than vec_id and embedding
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gpsight.llm.common import materialize, shuffle_partitions

SAMPLE, LIST_SIZE, MAX_LISTS = 20_000, 256, 2048
BORDER_RATIO, REPLICAS, QUERY_RATIO, BEAM, LINKS = 1.08, 6, 1.3, 48, 32
# The lists that a query reads first hold about so many times k vectors, those of each further round
# so many times what all before hold; a list with this ring is never read.
FIRST, GROWTH, NEVER = 8, 4, 255
PART_ROWS, QUERY_BLOCK = 4096, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good & some, F.lit(False)))
    sizes = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("embedding") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["vec_id", "embedding"])


def balanced_centroids(points: np.ndarray, leaf: int) -> np.ndarray:
    """Means of groups of at most ``leaf`` points, by halving along the line between two means."""
    rng = np.random.default_rng(3)
    todo, done = [points], []
    while todo:
        group = todo.pop()
        if len(group) <= leaf or (group == group[0]).all():
            done.append(group.mean(0))
            continue
        two = group[rng.choice(len(group), 2, replace=False)]
        for _ in range(6):
            near = ((group - two[0]) ** 2).sum(1) > ((group - two[1]) ** 2).sum(1)
            if near.all() or not near.any():
                two = group[rng.choice(len(group), 2, replace=False)]
                continue
            two = np.stack([group[~near].mean(0), group[near].mean(0)])
        along = group @ (two[1] - two[0])
        order = np.argsort(along, kind="stable")
        half = len(group) // 2
        todo += [group[order[:half]], group[order[half:]]]
    return np.unique(np.stack(done), axis=0)


class CentroidGraph:
    """Centroids linked to their nearest; a beam of the best known ones walks the links."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        links = min(LINKS, len(centroids))
        self.links = np.stack([np.argsort(((centroids - c) ** 2).sum(1), kind="stable")[:links] for c in centroids])
        # long links from evenly spaced centroids, so that no group of lists is out of reach
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), BEAM)).astype(int))

    def distances(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - self.centroids[nodes]) ** 2).sum(2))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each row, nearest first, and their distances."""
        beam = min(beam, len(self.centroids))
        nodes = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = self.distances(x, nodes)
        known = np.zeros(0)
        for _ in range(24):
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
            if known.shape == dist.shape and np.array_equal(known, dist):
                break
            known = dist
            front = nodes[:, :max(4, beam // 4)]
            more = self.links[front].reshape(len(x), -1)
            nodes = np.concatenate([nodes, more], 1)
            dist = np.concatenate([dist, self.distances(x, more)], 1)
            by_node = np.argsort(nodes, axis=1, kind="stable")
            nodes, dist = np.take_along_axis(nodes, by_node, 1), np.take_along_axis(dist, by_node, 1)
            dist = np.where(np.diff(nodes, axis=1, prepend=-1) == 0, np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(largest ** 2 - (x ** 2).sum(1, keepdims=True), 0))])


def matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), np.float64)


def place(vectors: DataFrame, graph: CentroidGraph, largest: float) -> DataFrame:
    """vec_id, embedding, list, nearest (whether it is the nearest list) and residual (the distance to
    the list's centroid) for each list of a vector."""
    schema = "vec_id long, embedding array<double>, list int, nearest boolean, residual double"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, dist = graph.search(lifted(matrix(part.column("embedding")), largest), 16)
                near = (dist <= BORDER_RATIO * dist[:, :1])
                near[:, REPLICAS:] = False
                row, column = np.nonzero(near)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("vec_id"), taken.column("embedding"), pa.array(nodes[row, column], pa.int32()),
                     pa.array(column == 0), pa.array(dist[row, column])],
                    ["vec_id", "embedding", "list", "nearest", "residual"])

    return vectors.mapInArrow(run, schema)


def list_cells(rows: np.ndarray) -> np.ndarray:
    """The cell of each list: lists in turn, together at most PART_ROWS rows, or one list alone."""
    cells, cell, held = np.zeros(len(rows), np.int64), 0, 0
    for i, n in enumerate(rows.tolist()):
        if held and held + n > PART_ROWS:
            cell, held = cell + 1, 0
        cells[i], held = cell, held + n
    return cells


def rings_of_lists(x: np.ndarray, graph: CentroidGraph, count: np.ndarray, k: int, ratio: float) -> np.ndarray:
    """For each row and list the round in which the row reads it, from 0; NEVER if it doesn't.

    Read are the lists within the ratio and as many as hold k other vectors, nearest first: round
    0 ends where FIRST * k vectors are held, each further one holds GROWTH times as many as all before.
    The graph is searched with a beam that doubles for the rows whose beam still ends inside.
    """
    rings = np.full((len(x), len(count)), NEVER, np.uint8)
    ends = FIRST * k * GROWTH ** np.arange(NEVER)[:28].astype(float)
    todo = [(np.arange(len(x)), BEAM)]
    while todo:
        rows, beam = todo.pop()
        most = max(1, BEAM * 64 // beam)  # rows searched together: only memory depends on it
        if len(rows) > most:
            todo += [(rows[at:at + most], beam) for at in range(0, len(rows), most)]
            continue
        nodes, dist = graph.search(x[rows], beam)
        held = np.where(np.isfinite(dist), count[nodes], 0)
        before = np.cumsum(held, axis=1) - held
        near = np.isfinite(dist) & ((dist <= ratio * dist[:, :1]) | (before <= k))
        done = ~near[:, -1] if beam < len(count) else np.ones(len(rows), bool)
        row, column = np.nonzero(near & done[:, None])
        rings[rows[row], nodes[row, column]] = np.searchsorted(ends, before[row, column])
        if not done.all():
            todo.append((rows[~done], 2 * beam))
    return rings


def choose_lists(queries: DataFrame, graph: CentroidGraph, sizes: dict[int, int], k: int, ratio: float) -> DataFrame:
    """query_id, embedding and rings (a byte for each list: the round that reads it) of each query."""
    count = np.array([sizes.get(i, 0) for i in range(len(graph.centroids))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column("embedding"))
                rings = rings_of_lists(np.hstack([x, np.zeros((len(x), 1))]), graph, count, k, ratio)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("embedding"), pa.array([r.tobytes() for r in rings], pa.binary())],
                    ["query_id", "embedding", "rings"])

    # few rows, much work each: one share of them for every task
    dealt = queries.repartition(shuffle_partitions(queries.sparkSession), "query_id")
    return dealt.mapInArrow(run, "query_id long, embedding array<double>, rings binary")


def reads_of_round(chosen: DataFrame, number: int, graph: CentroidGraph, cells: np.ndarray, residual: np.ndarray) -> DataFrame:
    """query_id, embedding, floor, reads (a bit for each list) and the cells that hold those lists, of the queries
    that still read in a round.

    ``chosen`` holds query_id, embedding, rings and floor, the score that the k-th neighbour reaches
    (null: unknown). Lists that can't reach it are left out.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column("embedding"))
                rings = np.frombuffer(b"".join(part.column("rings").to_pylist()), np.uint8).reshape(len(x), -1)
                floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = np.sqrt((x ** 2).sum(1))[:, None]
                    most = x @ graph.centroids[:, :-1].T + length * residual * (1 + 1e-9)
                    read = (rings == number) & ~(most < floor[:, None] - 1e-9 * np.abs(floor)[:, None])
                some = np.flatnonzero(read.any(1))
                taken = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("query_id"), taken.column("embedding"), taken.column("floor"),
                     pa.array([bits.tobytes() for bits in np.packbits(read[some], axis=1)], pa.binary()),
                     pa.array([np.unique(cells[r]).tolist() for r in read[some]], pa.list_(pa.int32()))],
                    ["query_id", "embedding", "floor", "reads", "cells"])

    return chosen.mapInArrow(run, "query_id long, embedding array<double>, floor double, reads binary, cells array<int>")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(v)))
    for a, b in zip(q.T, v.T):
        out += np.multiply.outer(a, b)
    return out


def best_pairs(q: np.ndarray, v: np.ndarray, ids: np.ndarray, read: np.ndarray, k: int, floor: np.ndarray):
    """Row, id and score of the k best ids of each row that reach its ``floor``; ``ids`` ascend, ``read``
    are the pairs that count.

    A matrix product leaves out what is below the k-th id by more than rounding can explain.
    """
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.where(read, q @ v.T, -np.inf)
        by_id = np.maximum.reduceat(rough, starts, axis=1)
        slack = 4 * q.shape[1] * np.finfo(float).eps * np.sqrt((q ** 2).sum(1) * (v ** 2).sum(1).max())
        least = np.maximum(floor, np.partition(by_id, -k, axis=1)[:, -k]) if len(starts) > k else floor
        read = read & ~(rough < (least - slack)[:, None])
        row, column = np.nonzero(read)
        scores = np.zeros(len(row))
        for a, b in zip(q.T, v.T):
            scores += a[row] * b[column]
        reached = ~(scores < floor[row])
        row, column, scores = row[reached], column[reached], scores[reached]
    order = np.lexsort((ids[column], -scores, row))
    row, found, scores = row[order], ids[column[order]], scores[order]
    # an id once, with its best score
    by_pair = np.lexsort((np.arange(len(row)), found, row))
    again = np.zeros(len(row), bool)
    again[by_pair[1:]] = (np.diff(row[by_pair]) == 0) & (found[by_pair[1:]] == found[by_pair[:-1]])
    row, found, scores = row[~again], found[~again], scores[~again]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], found[kept], scores[kept]


def search_cell(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("vec_id", kind="stable")
            v, ids, lists = matrix(vectors["embedding"]), vectors["vec_id"].to_numpy(), vectors["list"].to_numpy()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at:at + 256]
                own = part["query_id"].to_numpy()
                bits = np.frombuffer(b"".join(part["reads"]), np.uint8).reshape(len(part), -1)
                read = np.unpackbits(bits, axis=1)[:, lists].astype(bool) & (own[:, None] != ids[None, :])
                floor = part["floor"].fillna(-np.inf).to_numpy(float)
                row, found, scores = best_pairs(matrix(part["embedding"]), v, ids, read, k, floor)
                out.append(pd.DataFrame({"query_id": own[row], "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ratio: float = QUERY_RATIO,
            sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of ``vectors`` found for each query.

    A query is a row of ``vectors`` too; itself is not among its neighbours.
    """
    spark = vectors.sparkSession
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    total = vectors.agg(F.max(norm).alias("m"), F.count("*").alias("n")).first()
    leaf = max(8, -(-len(chosen) // max(1, min(MAX_LISTS, total["n"] // LIST_SIZE))))
    graph = CentroidGraph(balanced_centroids(lifted(matrix(chosen["embedding"]), total["m"]), leaf))
    lists = materialize(place(vectors, graph, total["m"]), "posting-lists")
    held = lists.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("nearest").cast("int")).alias("own"),
                                     F.max("residual").alias("residual")).collect()
    rows = {r["list"]: r["n"] for r in held}
    own = {r["list"]: r["own"] for r in held}
    residual = np.zeros(len(graph.centroids))
    residual[[r["list"] for r in held]] = [r["residual"] for r in held]
    cells = list_cells(np.array([rows.get(i, 0) for i in range(len(graph.centroids))]))
    asking = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    chosen = materialize(choose_lists(asking, graph, own, k, ratio), "list-queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    rounds = 1
    while FIRST * k * GROWTH ** (rounds - 1) < sum(own.values()):
        rounds += 1
    for number in range(rounds):
        floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        reads = materialize(reads_of_round(chosen.join(floor, "query_id", "left"), number, graph, cells, residual), "list-reads")
        found = best.drop("rank").union(read_lists(lists, reads, rows, cells, k))
        best = materialize(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "nearest-so-far")
    return best.select("query_id", "rank", "vec_id", "score")


def read_lists(lists: DataFrame, reads: DataFrame, rows: dict[int, int], cells: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query, reaching its floor, in each part of a cell it reads."""
    spark = lists.sparkSession
    asked = {r["cell"]: r["n"] for r in reads.select(F.explode("cells").alias("cell")).groupBy("cell")
             .agg(F.count("*").alias("n")).collect()}
    # parts of a cell and blocks of its queries: a table with a row for each list
    in_cell = np.bincount(cells, [rows.get(i, 0) for i in range(len(cells))])
    cuts = spark.createDataFrame([(i, c, max(1, -(-int(in_cell[c]) // PART_ROWS)), -(-asked[c] // QUERY_BLOCK))
                                  for i, c in enumerate(cells.tolist()) if c in asked],
                                 "list int, cell int, parts int, blocks int")
    slot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = (lists.join(F.broadcast(cuts), "list").withColumn("part", slot("vec_id", "parts"))
              .select("cell", "part", each("blocks").alias("block"), "vec_id", "embedding", "list"))
    asking = (reads.select("query_id", "embedding", "floor", "reads", F.explode("cells").alias("cell"))
              .join(F.broadcast(cuts.drop("list").distinct()), "cell").withColumn("block", slot("query_id", "blocks"))
              .select("cell", each("parts").alias("part"), "block", "query_id", "embedding", "floor", "reads"))
    keys = ["cell", "part", "block"]
    found = asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(
        lambda q, v: search_cell(k)(q, v), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
