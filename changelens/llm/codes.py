"""Vector code compression: product quantisation in whole numbers.

A vector is cut into parts, and each part is replaced by the number of the nearest
entry of its position's codebook.  Components are integers and so are all distances,
so results are the same on any cluster.  The codebooks are small and go to all tasks;
a task computes the distances of a batch by |x - c|^2 = |x|^2 - 2 x.c + |c|^2 with one
integer matrix product for each position, and adds up the parts of each entry before
anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import materialize
from changelens.llm.vectors import exact, floored, kept, largest, longs, matrix


@dataclass(frozen=True)
class Coder:
    """parts: of a vector; entries: of a codebook, at most 256; rounds: of assigning and
    averaging; scale: component x counts as floor(scale * x); chunk: rows whose
    distances to all entries are held at once."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    chunk: int = 1024

    def width(self, size: int) -> int:
        """Components of a part; vectors are filled up with zeros to a multiple."""
        return -(-size // self.parts)

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width) of integers."""
        width = self.width(x.shape[1])
        return np.pad(floored(x, self.scale), ((0, 0), (0, width * self.parts - x.shape[1]))).reshape(len(x), self.parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each part, of equally near ones the first, and the squared
    distance, both (rows, parts). x: (rows, parts, width); book: (parts, entries, width)."""
    bound = 4 * x.shape[1] * x.shape[2] * max(largest(x), largest(book)) ** 2
    x, book = exact(x, bound), exact(book, bound)
    away = (book * book).sum(2)[:, None, :] - 2 * np.matmul(x.transpose(1, 0, 2), book.transpose(0, 2, 1))
    codes = away.argmin(2)
    least = np.take_along_axis(away, codes[:, :, None], 2)[:, :, 0]
    return codes.T, least.T + (x * x).sum(2)


def averaged(book: np.ndarray, sums: dict[tuple[int, int, int], int]) -> np.ndarray:
    """The codebooks with each used entry replaced by floor(sum / count) of its parts;
    sums: by position, entry and place, the count at the place after the last."""
    new, width = book.copy(), book.shape[2]
    for (part, entry, place), total in sums.items():
        if place < width:
            new[part, entry, place] = total // sums[part, entry, width]
    return new


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, comma-joined, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(s, rows) for batch in batches for s in range(0, batch.num_rows, rows))


def _summed(book: np.ndarray, size: int, coder: Coder):
    """The sums and counts of the parts of each entry, over a partition's rows."""
    width = book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*book.shape[:2], width + 1), object)
        for batch in _chunks(batches, coder.chunk):
            x = coder.cut(matrix(batch.column("v"), size))
            codes, _ = nearest(x, book)
            own, flat = np.zeros(total.shape, np.int64), np.arange(coder.parts) * book.shape[1] + codes
            values = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], axis=2)
            if len(x) * largest(x) >= 1 << 63:
                own, values = own.astype(object), values.astype(object)
            np.add.at(own.reshape(-1, width + 1), flat.ravel(), values.reshape(-1, width + 1))
            total += own
        part, entry, place = np.nonzero(np.broadcast_to(total[:, :, -1:] != 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(int(t)) for t in total[part, entry, place]], pa.decimal128(38, 0))],
            names=["part", "entry", "place", "total"],
        )

    return run


def fit(rows: DataFrame, size: int, coder: Coder = Coder()) -> np.ndarray:
    """The codebooks (parts, entries, width) of rows (i, v), of one size.

    They start as the rows with the smallest ids (null ids last, ties by the vector);
    fewer rows than entries give as many entries. Each round is one pass over the rows:
    sums are made in the tasks, merged by a grouped shuffle, and only the sums of the
    entries come to the driver. Unused entries stay. Repeated rows count each.
    """
    first = rows.orderBy(F.col("i").asc_nulls_last(), "v").limit(coder.entries).select("v").collect()
    book = coder.cut(np.array([r["v"] for r in first], float).reshape(len(first), size)).transpose(1, 0, 2).copy()
    for _ in range(coder.rounds if len(first) else 0):
        each = rows.select("v").mapInArrow(_summed(book, size, coder), "part int, entry int, place int, total decimal(38,0)")
        sums = each.groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
        book = averaged(book, {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in sums})
    return book


def _coded(book: np.ndarray, size: int, coder: Coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, coder.chunk):
            codes, error = nearest(coder.cut(matrix(batch.column("v"), size)), book)
            names = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), pa.array(names, pa.string()), pa.array(longs(error.sum(1)), pa.int64())], names=["i", "label", "code", "error"])

    return run


def compress(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", coder: Coder = Coder()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row with a finite vector.

    code: two hex digits for each part; error: squared distance to what the code stands
    for; label_error: its sum over the rows with the same label, null labels together.
    Vectors that are null or hold null or non-finite components are dropped, and so are
    those of another size than the most frequent. Rows with a null id stay; rows that
    repeat are coded each. Components, and errors, beyond 64 bits are an error. An empty
    table gives an empty one. Other columns don't matter.
    """
    rows, size = kept(df, vector, i=F.col(vec_id).cast("long"), label=F.col(label))
    kind = dict(rows.dtypes)["label"]
    book = fit(rows, size, coder) if size else np.zeros((coder.parts, 0, 0), np.int64)
    if not size or not book.size:
        return rows.select(F.col("i").alias("vec_id"), F.lit("").alias("code"), F.col("i").alias("error"), F.col("i").alias("label_error"), F.lit(digest(book)).alias("codebooks_sha256")).limit(0)
    coded = materialize(rows.mapInArrow(_coded(book, size, coder), f"i long, label {kind}, code string, error long"), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = coded.join(totals, coded["label"].eqNullSafe(totals["of"]))
    return both.select(F.col("i").alias("vec_id"), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _oracle() -> str:
    distance = "+".join(f"(p.x[{j}] - c.x[{j}]) * (p.x[{j}] - c.x[{j}])" for j in range(1, 5))
    mean = lambda j: f"(sum(x[{j}])::BIGINT - ((sum(x[{j}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)"
    steps = []
    for r in range(3):
        steps.append(f"a{r} AS (SELECT vec_id, p.part, any_value(p.x) AS x, min(({distance}) * 64 + entry) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY 1, 2)")
        if r < 2:
            steps.append(f"n{r} AS (SELECT part, best % 64 AS entry, [{', '.join(mean(j) for j in range(1, 5))}] AS x FROM a{r} GROUP BY 1, 2)")
            steps.append(f"c{r + 1} AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON c.part = n.part AND c.entry = n.entry)")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[4 * part + 1 : 4 * part + 4] AS x FROM k, range(16) t(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id)),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h"""


#: What the query gives, in DuckDB's SQL, for vectors of 64 components.
ORACLE_SQL = _oracle()
