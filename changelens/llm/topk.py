"""Exact search for the largest inner products of whole-number vectors.

Candidates are sorted by length, longest first, and stand in blocks of that order.
All vectors are turned by one rotation, from the singular value decomposition of a
sample, that moves most of their length into the first dimensions.  A block of queries
meets the vectors of a block chunk by chunk: the scores of the first dimensions, plus
the product of the lengths of what is left (Cauchy-Schwarz), bound a score from above,
and a pair is left once its bound is below the k-th best score that the query has
found.  What survives is scored in integers, so the result is exact; the rotation only
decides how early pairs are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from changelens.llm.common import materialize
from changelens.llm.vectors import exact, floored, kept, largest, longs, matrix


@dataclass(frozen=True)
class Search:
    """scale: component x counts as floor(scale * x); sample: at most so many vectors,
    those with the smallest hashes, make the rotation; block: vectors of a block;
    queries: of a block of queries; chunk: vectors that are scored at once, at most; stops: of
    how many eighths of the dimensions a partial sum is compared with its bound; slack:
    share of both lengths that rounding may cost at most."""

    scale: int = 256
    sample: int = 4000
    block: int = 8192
    queries: int = 512
    chunk: int = 1024
    stops: tuple[int, ...] = (1, 2, 4, 6)
    slack: float = 1e-9


def rotation(sample: np.ndarray, size: int) -> np.ndarray:
    """An orthonormal basis, its columns by falling share of the sample's length."""
    x = np.asarray(sample, float).reshape(-1, size)
    return np.linalg.svd(x / max(1.0, np.abs(x).max(initial=1.0)), full_matrices=len(x) < size)[2].T if len(x) else np.eye(size)


class Turned:
    """Vectors with their turned forms, and the lengths of what each stop leaves."""

    def __init__(self, x: np.ndarray, basis: np.ndarray, search: Search):
        self.x, size = x, x.shape[1]
        self.turned = x.astype(float) @ basis
        ends = sorted({max(1, size * s // 8) for s in search.stops} | {size})
        self.parts = list(zip([0, *ends[:-1]], ends, strict=True))
        self.left = [np.linalg.norm(self.turned[:, e:], axis=1) for e in ends]
        self.length = np.linalg.norm(self.turned, axis=1)


class Found:
    """The k best of each query so far: scores, rows of the candidates, and their
    smallest ids; least: the k-th best score, from which on a candidate matters."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.vec, self.row = (np.empty(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        query, score, vec, row = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.vec, vec), (self.row, row)))
        order = np.lexsort((vec, -score, query))
        query, score, vec, row = query[order], score[order], vec[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        keep = place < self.k
        self.query, self.score, self.vec, self.row = query[keep], score[keep], vec[keep], row[keep]


def scan(asked: Turned, ids: np.ndarray, stored: Turned, first: np.ndarray, second: np.ndarray, found: Found, search: Search) -> None:
    """Add to ``found`` what the stored vectors, longest first, have for the queries.

    first, second: the two smallest ids of each stored vector, -1 for none; a query's
    own row is no candidate, another row with an equal vector is.
    """
    end, width = 0, min(64, search.chunk)
    while end < len(stored.x):
        rows = np.arange(end, min(end + width, len(stored.x)))
        end, width = end + width, min(2 * width, search.chunk)  # the first ones only find out what is to be beaten
        room = asked.length * (1 + search.slack) * stored.length[rows].max()
        live = np.flatnonzero(room >= found.least)
        if not len(live):
            return  # all that follow are shorter
        slack = search.slack * np.outer(asked.length[live], stored.length[rows])
        total, alive = np.zeros((len(live), len(rows))), np.ones((len(live), len(rows)), bool)
        for (a, e), q_left, v_left in zip(asked.parts, asked.left, stored.left, strict=True):
            total += asked.turned[live, a:e] @ stored.turned[rows, a:e].T
            alive = total + np.outer(q_left[live], v_left[rows]) + slack >= found.least[live, None]
            some_q, some_v = alive.any(1), alive.any(0)
            if not some_q.all() or not some_v.all():
                live, rows = live[some_q], rows[some_v]
                total, alive, slack = (m[some_q][:, some_v] for m in (total, alive, slack))
            if not len(live):
                break
        q, v = np.nonzero(alive)
        q, v = live[q], rows[v]
        vec = np.where(first[v] == ids[q], second[v], first[v])
        q, v, vec = q[vec >= 0], v[vec >= 0], vec[vec >= 0]
        if not len(q):
            continue
        for t in range(0, len(q), 1 << 16):
            i, j = q[t : t + (1 << 16)], v[t : t + (1 << 16)]
            bound = largest(asked.x[i]) * largest(stored.x[j]) * asked.x.shape[1]
            score = longs((exact(asked.x[i], bound) * exact(stored.x[j], bound)).sum(1))
            on = score >= found.least[i]
            found.add(i[on], score[on], vec[t : t + (1 << 16)][on], j[on])


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<i4" if largest(x) < 1 << 31 else "<i8").tobytes()


def _unpacked(data: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * size else "<i8").reshape(rows, size).astype(np.int64)


BLOCK = "block long, length double, members array<array<bigint>>, data binary"


def _blocks(size: int, search: Search):
    """The rows of a sorted partition as blocks: its number, the length of its first
    vector, the ids of each vector, and the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def block(table: pa.Table) -> pa.RecordBatch:
            x = matrix(table.column("w").combine_chunks(), size)
            at = (table.column("part")[0].as_py() << 32) + number
            arrays = [pa.array([at], pa.int64()), pa.array([np.linalg.norm(x[0].astype(float))]), pa.array([table.column("members").to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([_packed(x)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "length", "members", "data"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= search.block:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, search.block))
                held, n, number = table.slice(search.block).to_batches(), n - search.block, number + 1
        if n:
            yield block(pa.Table.from_batches(held))

    return run


class Stored:
    """A block's vectors, ready to be scanned."""

    def __init__(self, data: bytes, members: list[list[int]], size: int, basis: np.ndarray, search: Search):
        self.members = members
        self.vectors = Turned(_unpacked(data, len(members), size), basis, search)
        self.first = np.array([m[0] for m in members], np.int64)
        self.second = np.array([m[1] if len(m) > 1 else -1 for m in members], np.int64)


def _started(head: Row, size: int, basis: np.ndarray, k: int, search: Search):
    """Blocks of queries with the k-th best score that the longest vectors give each."""
    data, members = bytes(head["data"]), head["members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = Stored(data, members, size, basis, search)
        for batch in batches:
            for ask in batch.to_pylist():
                ids = np.array(ask["ids"], np.int64)
                x = np.array(ask["vectors"], np.int64).reshape(len(ids), size)
                asked, found = Turned(x, basis, search), Found(np.full(len(ids), -np.inf), k)
                scan(asked, ids, stored.vectors, stored.first, stored.second, found, search)
                arrays = [pa.array([ask["ask"]], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([_packed(x)], pa.binary()), pa.array([found.least.tolist()], pa.list_(pa.float64())), pa.array([float((found.least / np.maximum(asked.length, 1e-300)).min())])]
                yield pa.RecordBatch.from_arrays(arrays, names=["ask", "ids", "data", "least", "reach"])

    return run


def _searched(size: int, basis: np.ndarray, k: int, search: Search):
    """The k best vectors of a block for each query that meets it. Rows stand by block,
    the block's own row (ask -1) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["ask"] < 0:
                    stored = Stored(row["data"], row["members"], size, basis, search)
                    continue
                ids = np.array(row["ids"], np.int64)
                asked, found = Turned(_unpacked(row["data"], len(ids), size), basis, search), Found(np.array(row["least"], float), k)
                scan(asked, ids, stored.vectors, stored.first, stored.second, found, search)
                if len(found.query):
                    of = pa.array([row["ask"]] * len(found.query), pa.int64())
                    arrays = [of, pa.array(found.query, pa.int32()), pa.array(ids[found.query], pa.int64()), pa.array(found.score, pa.int64()), pa.array([stored.members[r] for r in found.row], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["ask", "place", "query_id", "score", "members"])

    return run


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v")
            flat = floored(x.flatten().to_numpy(zero_copy_only=False), scale)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (len(flat) // max(1, len(x))), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("q"), rows], names=["i", "q", "w"])

    return run


def largest_products(df: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row where ``queries`` holds, the k rows
    with the largest inner products, itself left out; ties to the smaller id.

    Exact. Null ids, null vectors, those with null or non-finite components and those of
    another size than the most frequent take no part; zero vectors do. Rows that repeat
    count once; an id with several vectors asks once for each, and none of its rows is
    an answer to it. Equal vectors are compared once, under their k + 1 smallest ids: no
    other copy can be among the k largest. Components and scores beyond 64 bits are an
    error. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows, size = kept(df, vector, i=F.col(vec_id).cast("long"), q=F.coalesce(queries, F.lit(False)))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size:
        return empty
    rows = rows.where("i is not null").mapInArrow(_whole(search.scale), "i long, q boolean, w array<bigint>")
    smallest = Window.partitionBy("w").orderBy("i")
    copies = rows.select("i", "w").distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    square = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    groups = materialize(copies.groupBy("w").agg(F.sort_array(F.collect_list("i")).alias("members")).select("w", "members", square.alias("square"), F.xxhash64("w").alias("h")), "groups")
    sample = groups.orderBy("h", "w").limit(search.sample).select("w").toPandas()
    basis = rotation(np.array(sample["w"].tolist(), float), size)

    ordered = groups.repartitionByRange(F.desc("square"), F.col("h"), F.col("w")).sortWithinPartitions(F.desc("square"), "h", "w")
    ordered = ordered.select("w", "members", F.spark_partition_id().cast("long").alias("part"))
    blocks = materialize(ordered.mapInArrow(_blocks(size, search), BLOCK), "blocks")
    head = blocks.orderBy(F.desc("length"), "block").first()  # one block, of a known size
    if head is None:
        return empty

    asked = materialize(rows.where("q").select("i", "w").distinct(), "asked")
    many = max(1, -(-asked.count() // search.queries))
    asked = asked.groupBy(F.pmod(F.xxhash64("i", "w"), F.lit(many)).alias("ask")).agg(F.collect_list("i").alias("ids"), F.collect_list("w").alias("vectors"))
    asked = materialize(asked.mapInArrow(_started(head, size, basis, k, search), "ask long, ids array<bigint>, data binary, least array<double>, reach double"), "queries")

    # a block of queries meets the blocks that are long enough for one of its queries
    places = blocks.select("block", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("ask"))
    meet = places.join(asked, "ask").where(F.col("length") * (1 + 2 * search.slack) >= F.col("reach"))
    no_ids, no_members = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")
    stored = blocks.select("block", F.lit(-1).cast("long").alias("ask"), no_ids.alias("ids"), "data", F.array().cast("array<double>").alias("least"), "members")
    both = stored.unionByName(meet.select("block", "ask", "ids", "data", "least", no_members.alias("members")))
    found = both.repartition("block").sortWithinPartitions("block", "ask").mapInArrow(_searched(size, basis, k, search), "ask long, place int, query_id long, score long, members array<bigint>")
    each = found.select("ask", "place", "query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("ask", "place").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: What the query gives, in DuckDB's SQL.
ORACLE_SQL = """WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM k q JOIN k c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
