"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest capacity, and the pieces are
dealt at random into shards of bounded size.  In each shard the permitted lengths are
chosen jointly: the pieces, from long to short, go into the open bin that they fill
best, and where none has room a bin is opened by one of several policies (the size
that costs least for each token it could hold, or at least one of the capacities), or
bins are filled one after the other with the size that costs least for each token of
what would go into it.  Each bin shrinks to the smallest capacity that holds its
contents, and of all these packings the cheapest counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import materialize

SCHEMA = "id long, piece int, start long, length int, bin_id string, offset int, capacity int"


@dataclass(frozen=True)
class Bins:
    """capacities: permitted sequence lengths. A bin of capacity c costs
    overhead + c + c * c / quadratic (attention grows with the square); costs, where
    given, states it outright. shard_tokens, shard_pieces: tokens and pieces of a shard,
    on average; the stricter of the two counts, so that very many short pieces fill no
    task's memory."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: float = 64.0
    quadratic: float = 65_536.0
    costs: dict[int, float] = field(default_factory=dict)
    shard_tokens: int = 4_000_000
    shard_pieces: int = 250_000

    def __post_init__(self):
        if not self.capacities or min(self.capacities) < 1:
            raise ValueError("capacities must be positive")

    def cost(self, capacity: int) -> float:
        return self.costs.get(capacity, self.overhead + capacity + capacity * capacity / self.quadratic)


Placed = tuple[list[tuple[int, int]], list[int]]


def opened(length: int, left: int, bins: Bins) -> int:
    """The capacity to open for a piece: the cheapest for each token that it could
    hold, given how many tokens of pieces are left; of equal ones, the smaller."""
    fits = [c for c in sorted(bins.capacities) if c >= length]
    return min(fits, key=lambda c: (bins.cost(c) / min(c, max(left, length)), c))


def best_fit(order: list[int], lengths: list[int], choose: Callable[[int, int], int]) -> Placed:
    """(bin, offset) of each piece, and what each bin holds. order: the pieces from long
    to short; choose: the capacity to open for a length, given the tokens left.

    Open bins are kept by the room they have left, and the set of rooms as the bits of
    one number, so the tightest bin is the lowest bit from the piece's length on.
    """
    by_room: dict[int, list[int]] = {}
    rooms, used, room, placed, left = 0, [], [], [(0, 0)] * len(lengths), sum(lengths)
    for i in order:
        n = lengths[i]
        above = rooms >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            b = len(used)
            used.append(0)
            room.append(choose(n, left))
        placed[i] = (b, used[b])
        used[b] += n
        room[b] -= n
        left -= n
        if room[b]:
            by_room.setdefault(room[b], []).append(b)
            rooms |= 1 << room[b]
    return placed, used


def bin_by_bin(order: list[int], lengths: list[int], bins: Bins) -> Placed:
    """(bin, offset) of each piece, and what each bin holds: for the longest piece left,
    each capacity is filled with the longest pieces that have room, and the one whose
    tokens cost least is taken. The lengths left are the bits of one number."""
    waiting: dict[int, list[int]] = {}
    for i in reversed(order):
        waiting.setdefault(lengths[i], []).append(i)
    there, placed, used = sum(1 << n for n in waiting), [(0, 0)] * len(lengths), []
    sizes = sorted(bins.capacities)
    while there:
        first, best = there.bit_length() - 1, None
        for c in sizes[bisect_left(sizes, first) :]:
            taken: dict[int, int] = {}
            room, rest = c, there
            while rest := rest & ((1 << room + 1) - 1):
                n = rest.bit_length() - 1
                taken[n] = min(len(waiting[n]), room // n)
                room -= n * taken[n]
                rest ^= 1 << n
            held = c - room
            price = bins.cost(sizes[bisect_left(sizes, held)]) / held
            if best is None or price < best[0]:
                best = price, taken
        at = 0
        for n, many in best[1].items():
            for _ in range(many):
                placed[waiting[n].pop()] = (len(used), at)
                at += n
            if not waiting[n]:
                del waiting[n]
                there ^= 1 << n
        used.append(at)
    return placed, used


def pack(lengths: list[int], bins: Bins = Bins()) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each piece in the cheapest packing found; of equally
    cheap ones, the first tried. lengths: from 1 to the longest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = sorted(bins.capacities)
    ways = [lambda: best_fit(order, lengths, lambda n, left: opened(n, left, bins)), lambda: bin_by_bin(order, lengths, bins)]
    ways += [lambda c=c: best_fit(order, lengths, lambda n, _: sizes[bisect_left(sizes, max(n, c))]) for c in sizes]
    spent, best = None, None
    for way in ways:  # one packing beside the best is held
        placed, used = way()
        final = [sizes[bisect_left(sizes, u)] for u in used]
        price = sum(map(bins.cost, final))
        if spent is None or price < spent:
            spent, best = price, [(b, at, final[b]) for b, at in placed]
    return best


def lower_bound(tokens: int, bins: Bins = Bins()) -> float:
    """What any packing of so many tokens costs at least: no bin holds a token for less
    than the cheapest full bin does."""
    return tokens * min(bins.cost(c) / c for c in bins.capacities)


def cost(packed: DataFrame, bins: Bins = Bins()) -> DataFrame:
    """(bins, tokens, cost, bound) of a result of ``packed``, in one row; of an empty one,
    zeros. Pieces of documents that repeat an id count each."""
    price = F.element_at(F.create_map(*(F.lit(x) for c in sorted(bins.capacities) for x in (c, float(bins.cost(c))))), F.col("capacity"))
    each = packed.groupBy("bin_id", "capacity").agg(F.sum("length").alias("length"))
    one = each.agg(F.count("*").alias("bins"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(price), F.lit(0.0)).alias("cost"))
    return one.withColumn("bound", F.col("tokens") * F.lit(lower_bound(1, bins)))


def _pack_shards(bins: Bins):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, kept = None, []

        def packed() -> pd.DataFrame:
            rows = pd.concat(kept, ignore_index=True)
            where = pack(rows["length"].tolist(), bins)
            rows["bin_id"] = [f"{shard}-{b}" for b, _, _ in where]
            rows["offset"], rows["capacity"] = [o for _, o, _ in where], [c for _, _, c in where]
            return rows[["id", "piece", "start", "length", "bin_id", "offset", "capacity"]]

        for batch in batches:
            for s, part in batch.groupby("shard", sort=False):
                if s != shard:
                    if kept:
                        yield packed()
                    shard, kept = s, []
                kept.append(part)
        if kept:
            yield packed()

    return run


def word_length(text: Column) -> Column:
    """A rough stand-in for the tokens of a text where no tokenizer is at hand: one more
    than its spaces and line ends; null and empty texts have none. A text without spaces
    counts as one token, however long: ``spm.count`` gives real lengths."""
    gaps = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) > 0, gaps + 1)


def packed(df: DataFrame, *, doc_id: str = "doc_id", length: Column, bins: Bins = Bins()) -> DataFrame:
    """(id, piece, start, length, bin_id, offset, capacity) for each piece of each row.

    ``length`` is the number of tokens of a row, as ``spm.count`` gives it. Null and non-positive lengths give no
    piece. A row longer than the longest capacity is cut into full pieces and a rest;
    start is where in the row a piece begins. Rows that repeat an id are packed each.
    The number of shards grows with tokens and pieces; pieces are dealt to them by a hash of
    the id and the piece, so no source and no long document fills one shard alone.
    """
    longest = max(bins.capacities)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), length.cast("long").alias("n"))
    # written before any filter, which would compute the lengths once more
    rows = materialize(rows, "lengths").where("n > 0")
    total, many = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n") / longest)), F.lit(0))).first()
    shards = max(1, -(-total // bins.shard_tokens), -(-many // bins.shard_pieces))
    pieces = rows.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(longest).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("id", "piece", "start", F.least(F.lit(longest), F.col("n") - F.col("start")).cast("int").alias("length"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(shards)))
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", F.desc("length"), "id", "piece")
    return dealt.mapInPandas(_pack_shards(bins), SCHEMA)
