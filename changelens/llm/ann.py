"""Approximate search for the largest inner products.

Vectors are coded with four bits for each pair of dimensions.  The codebooks, and the
choice of codes, minimise a score-aware loss: the part of the residual parallel to the
vector, which shifts its inner products with the queries that matter, weighs more than
the part orthogonal to it.  What these codes leave is coded once more, by its own
codebooks.  Only directions are coded; a vector's length stands beside its code as a
double, so vectors of any finite size may stand side by side.  Queries scan blocks of
the first codes by table look-up; all within the measured error of the k-th best are
scored with both codes, and all of those within the error of both are ranked again by
exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import materialize


@dataclass(frozen=True)
class Index:
    """sample: at most so many vectors, those with the smallest hashes of their ids,
    fit the codebooks; threshold: cosine from which on an inner product matters;
    rounds: of the fit; rerank: candidates of each query that are ranked exactly at
    least; errors: how many times the measured error, times a vector's length, its score
    is taken to lie about its guess: it is ranked if it may be as large as the k-th
    surely is, so the depth follows the data; query_block, code_block: size of the
    blocks that one task scans."""

    sample: int = 8000
    threshold: float = 0.2
    rounds: int = 4
    rerank: int = 100
    errors: float = 1.5
    query_block: int = 512
    code_block: int = 65_536
    chunk: int = 64


@dataclass(frozen=True)
class Codebook:
    """centers: (pairs of dimensions, 16, 2); weight: of the parallel loss, less 1."""

    centers: np.ndarray
    weight: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The 16-way codes (rows, pairs), by coordinate descent on the loss."""
        parts = x.reshape(len(x), -1, 2)
        near = ((parts[:, :, None, :] - self.centers[None]) ** 2).sum(3)
        codes = near.argmin(2)
        if not len(x) or not self.weight:
            return codes
        scale = self.weight / np.maximum((x * x).sum(1), 1e-30)
        along = np.einsum("nmd,mkd->nmk", parts, self.centers)  # of each center with the vector's own part
        own = (parts**2).sum(2)
        rows = np.arange(len(x))
        total = (own - np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]).sum(1)  # residual times vector
        for _ in range(2):
            for m in range(parts.shape[1]):
                rest = total - (own[:, m] - along[rows, m, codes[:, m]])
                options = rest[:, None] + own[:, m, None] - along[:, m]
                codes[:, m] = (near[:, m] + scale[:, None] * options**2).argmin(1)
                total = options[rows, codes[:, m]]
        return codes

    def left(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of rows, and what they leave of the rows."""
        codes = self.encode(x)
        return codes, x - self.centers[np.arange(len(self.centers)), codes].reshape(x.shape)


def measured(x: np.ndarray, left: np.ndarray, k: int) -> float:
    """The root mean square of a guess's error for queries of length 1: of all pairs of
    sampled rows, or, if larger, of the pairs of each row with its k nearest."""
    q = x[:1000] / np.maximum(np.linalg.norm(x[:1000], axis=1), 1e-30)[:, None]
    error, product = (q @ left.T) ** 2, q @ x.T
    near = np.argpartition(-product, min(k, len(x) - 1), axis=1)[:, : k + 1]
    return float(np.sqrt(max(error.mean(), np.take_along_axis(error, near, 1).mean())))


def train(x: np.ndarray, index: Index = Index()) -> Codebook:
    """Alternate coding and the exact least-squares solution for all centers at once."""
    n, d = x.shape
    weight = max(0.0, (d - 1) * index.threshold**2 / (1 - index.threshold**2) - 1)
    rng = np.random.default_rng(0)
    parts = x.reshape(n, -1, 2)
    pick = rng.permutation(n)[np.arange(16) % max(n, 1)]
    book = Codebook(parts[pick].transpose(1, 0, 2).copy(), 0.0)
    pairs, size = d // 2, d * 16
    norm = np.maximum((x * x).sum(1), 1e-30)
    for step in range(2 * index.rounds):
        w = weight if step >= index.rounds else 0.0  # the plain loss first, as a start
        book = Codebook(book.centers, w)
        codes = book.encode(x)
        if w == 0:
            centers = book.centers.copy()
            for m in range(pairs):
                count = np.bincount(codes[:, m], minlength=16)
                for k in range(2):
                    mean = np.bincount(codes[:, m], parts[:, m, k], 16) / np.maximum(count, 1)
                    centers[m, :, k] = np.where(count > 0, mean, centers[m, :, k])
        else:
            # unknown of dimension j with code c: c * d + j
            at = np.repeat(codes, 2, axis=1) * d + np.arange(d)
            a = np.zeros(size * size)
            for s in range(0, n, 1000):
                i, v = at[s : s + 1000], x[s : s + 1000]
                both = (w / norm[s : s + 1000])[:, None, None] * v[:, :, None] * v[:, None, :] + np.eye(d)
                a += np.bincount((i[:, :, None] * size + i[:, None, :]).ravel(), both.ravel(), size * size)
            b = np.bincount(at.ravel(), ((1 + w) * x).ravel(), size)
            a = a.reshape(size, size)
            a[np.diag_indices(size)] += 1e-6 * n
            b += 1e-6 * n * book.centers.reshape(pairs, 16, 2).transpose(1, 0, 2).reshape(-1)
            centers = np.linalg.solve(a, b).reshape(16, pairs, 2).transpose(1, 0, 2).copy()
        book = Codebook(centers, w)
    return Codebook(book.centers, weight)


def valid(vector: Column, size: int) -> Column:
    """Vectors of the size, finite in all components and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in float32, with a zero added where the number of dimensions is
    odd, and the lengths. Rows are divided by their largest component first, so that no
    square is too large or too small."""
    x = np.asarray(x, np.float64)
    most = np.abs(x).max(1)
    scaled = x / most[:, None]
    length = np.linalg.norm(scaled, axis=1)
    with np.errstate(over="ignore"):
        lengths = np.minimum(most * length, np.finfo(np.float64).max)
    return np.pad((scaled / length[:, None]).astype(np.float32), ((0, 0), (0, x.shape[1] % 2))), lengths


def _packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    codes = np.pad(codes.astype(np.uint8), ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def _coded(book: Codebook, finer: Codebook):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit, length = directions(np.stack(batch["v"].to_numpy()))
                codes, left = book.left(unit)
                packed = np.concatenate([_packed(codes), _packed(finer.encode(left))], axis=1)
                yield pd.DataFrame({"g": batch["g"], "code": [c.tobytes() for c in packed], "length": length})

    return run


def _tables(book: Codebook, q: np.ndarray) -> np.ndarray:
    """(queries, bytes, 256): the score that each byte (two codes) adds."""
    pairs = len(book.centers)
    table = np.einsum("qmd,mkd->qmk", q.reshape(len(q), pairs, 2), book.centers.astype(np.float32))
    table = np.pad(table, ((0, 0), (0, pairs % 2), (0, 0)))
    return (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(q), -1, 256)


def _reached(guess: np.ndarray, margin: np.ndarray, k: int, least: int) -> np.ndarray:
    """The places of the guesses that, with their margin, may be as large as the k-th
    surely is, and of the ``least`` best at least."""
    if len(guess) <= max(k, least):
        return np.arange(len(guess))
    sure = -np.partition(margin - guess, k - 1)[k - 1]
    return np.flatnonzero((guess + margin >= sure) | (guess >= -np.partition(-guess, least - 1)[least - 1]))


def scan(tables: np.ndarray, finer: np.ndarray, packed: np.ndarray, length: np.ndarray, k: int, errors: tuple[float, float], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of the codes that it reaches.

    tables, finer: those of both codes; packed: the codes, one after the other; length:
    of their vectors; errors: of a guess with the first and with both codes, at length 1.
    """
    half, out = tables.shape[1], []
    part = np.ascontiguousarray(tables.transpose(1, 2, 0))
    total = np.zeros((len(packed), part.shape[2]), np.float32)
    for b in range(half):
        total += np.take(part[b], packed[:, b], axis=0)
    for row, table in zip(np.ascontiguousarray(total.T), finer, strict=True):
        near = _reached(row * length, errors[0] * length, k, least)
        guess = (row[near] + table[np.arange(half), packed[near, half:]].sum(1)) * length[near]
        best = _reached(guess, errors[1] * length[near], k, least)
        out.append((near[best], guess[best]))
    return out


def _scanned(book: Codebook, finer: Codebook, errors: tuple[float, float], k: int, index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for groups, codes, lengths, queries, vectors in zip(batch["groups"], batch["codes"], batch["lengths"], batch["queries"], batch["vectors"], strict=True):
                packed, length = np.stack([np.frombuffer(c, np.uint8) for c in codes]).astype(np.intp), np.asarray(lengths)
                for s in range(0, len(vectors), index.chunk):
                    q, _ = directions(np.stack(vectors[s : s + index.chunk]))
                    found = scan(_tables(book, q), _tables(finer, q), packed, length, k, errors, index.rerank)
                    many, guess, at = [len(p) for p, _ in found], np.concatenate([g for _, g in found]), np.concatenate([p for p, _ in found])
                    margin = errors[1] * length[at]
                    yield pd.DataFrame({"query_id": np.repeat(np.asarray(queries[s : s + index.chunk]), many), "g": np.asarray(groups)[at], "low": guess - margin, "reach": guess + margin})

    return run


def search(df: DataFrame, queries: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row where ``queries`` holds, the k rows
    with the largest inner products found, itself left out; ties to the smaller id.

    Null ids, null and zero vectors, vectors with null or non-finite components, and
    vectors of another size than the most frequent (of equally frequent ones, the
    largest) take no part. Repeated rows count once. Equal vectors are indexed together
    under their k + 1 smallest ids: no other copy can be among the k nearest. With at
    most ``rerank`` different vectors the result is exact.
    """
    spark, index = df.sparkSession, replace(index, rerank=max(index.rerank, k + 1))  # the query itself is one
    rows = df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q")).where("i is not null and v is not null")
    sizes = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None or sizes["s"] < 1:
        return empty
    rows = rows.where(valid(F.col("v"), sizes["s"]))
    smallest = Window.partitionBy("v").orderBy("i")
    copies = rows.select("i", "v").distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    groups = materialize(copies.groupBy("v").agg(F.min("i").alias("g"), F.sort_array(F.collect_list("i")).alias("members")), "groups")
    chosen = groups.select("g", F.xxhash64("g").alias("h")).orderBy("h").limit(index.sample)
    sample = groups.join(F.broadcast(chosen), "g").orderBy("h", "g").select("v").limit(index.sample).toPandas()
    if not len(sample):
        return empty
    x = directions(np.stack(sample["v"].to_numpy()))[0].astype(np.float64)
    book = train(x, index)
    _, left = book.left(x)
    finer = train(left, replace(index, threshold=0.0))
    errors = tuple(index.errors * e for e in (measured(x, left, k), measured(x, finer.left(left)[1], k)))

    # an id that stands for several vectors is told apart by the vector itself
    coded = groups.select(F.xxhash64("v").alias("g"), "v").mapInPandas(_coded(book, finer), "g long, code binary, length double")
    n = groups.count()
    blocks = -(-n // index.code_block)
    coded = coded.groupBy(F.pmod("g", F.lit(blocks)).alias("block")).agg(F.collect_list("g").alias("groups"), F.collect_list("code").alias("codes"), F.collect_list("length").alias("lengths"))
    asked = materialize(rows.where("q").select("i", "v").distinct(), "queries")
    ask_blocks = max(1, -(-asked.count() // index.query_block))
    most = F.array_max(F.transform("v", F.abs))  # a query's length doesn't matter for the order
    asked_in = asked.groupBy(F.pmod(F.xxhash64("i", "v"), F.lit(ask_blocks)).alias("ask")).agg(F.collect_list("i").alias("queries"), F.collect_list(F.transform("v", lambda x: (x / most).cast("float"))).alias("vectors"))
    # each block of codes meets each block of queries
    meet = coded.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ask_blocks - 1).cast("long")))).join(asked_in, "ask")
    guessed = meet.repartition("ask", "block").mapInPandas(_scanned(book, finer, errors, k + 1, index), "query_id long, g long, low double, reach double")
    best = Window.partitionBy("query_id").orderBy(F.desc("low"), "g")
    guessed = guessed.withColumn("r", F.row_number().over(best))
    last = F.max(F.when(F.col("r") == k + 1, F.col("low"))).over(Window.partitionBy("query_id"))  # the query itself is among the guesses
    guessed = guessed.withColumn("last", last).where((F.col("r") <= index.rerank) | (F.col("reach") >= F.col("last"))).select("query_id", "g")

    exact = guessed.join(groups.select(F.xxhash64("v").alias("g"), F.col("v").alias("w"), "members"), "g").join(asked.select(F.col("i").alias("query_id"), "v"), "query_id")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    ranked = exact.select("query_id", dot.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
