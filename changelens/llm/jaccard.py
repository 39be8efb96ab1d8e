"""N-gram Jaccard join on prefix trees.

Documents become sets of word n-grams.  Which documents must be compared is found
without loss: sets that differ in at most d members agree in at least one of d + 1
disjoint parts, so rows with equal parts meet by hash, and documents that equal parts
connect form a cluster (a set that shares no part can't link and meets no trie).  Within blocks of a cluster the sets are put in one global
order (rarest members first) and stored in a trie; each set walks the trie, sharing
the overlap of common beginnings, and leaves a subtree once the lengths and members
that remain cannot reach the threshold, or once all in it is linked to the set anyway.

Sets that share a frequent passage can share small parts by chance, and so connect
clusters that have no link between them.  A cluster too large for one block is
therefore divided, without loss again, before it is compared: sets that link also share
one of their rarest members (of n, the first n - ceil(percent of n) + 1 in one order of
all members), and a frequent passage is in no text's rarest part unless it is most of
the text.

Sets are held as 64-bit hashes of their members: two documents would be misjudged
only if two different n-grams of theirs had the same hash (odds of about 1e-14 for
two sets of 400).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import WRITTEN, forget_shuffles, materialize, release, sieve
from changelens.llm.graph import components

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Join:
    """ngram: words of a shingle; percent: sets link if 100 * intersection >= percent
    * union; block_docs, block_members: size of a block that one task compares;
    pivots: how many sets, about, all blocks of a cluster share in the first round;
    buckets: members of large clusters are counted in so many buckets of their hash, or
    in one a member if there are more (``MOST_BUCKETS``; a byte each is broadcast), which
    orders them; any order gives the same links."""

    ngram: int = 3
    percent: int = 90
    block_docs: int = 512
    block_members: int = 2_000_000
    pivots: int = 16
    buckets: int = 1 << 20

    def differing(self, total: int) -> int:
        """The most members in which two sets of this total size can differ and link."""
        return total * (100 - self.percent) // (100 + self.percent)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, ngram: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams, A-Z in lower case.

    A text with fewer words is one n-gram; one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < ngram:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.array([digest(w) for w in found], np.uint64)
    total = np.zeros(len(each) - ngram + 1, np.uint64)
    for k in range(ngram):
        total = _mix(total * MIX[0] + each[k : len(each) - ngram + 1 + k])
    return np.unique(total)


def meeting_classes(size: int, percent: int) -> list[tuple[int, int]]:
    """(class, largest size in it) for the classes where a set of this size meets those
    it may link with: its own class of sizes, and the next if it is nearly as large."""
    low, k, found = 1, 0, []
    while low * percent <= size * 100:
        high = max(low + 1, low * 5 // 4)
        if size < high:
            found.append((k, high - 1))
        low, k = high, k + 1
    return found[:2]


def signatures(own: np.ndarray, join: Join) -> np.ndarray:
    """Hashes of the parts of a set; sets that link and differ have one in common.

    Sets that meet in a class differ in d members at most and are dealt into m > d
    parts, so m - d parts are equal at least. Empty parts and those of one or two
    members, which unrelated texts may share, are left out if some larger part must be
    equal still: if more parts are as large as the members in which this set can differ
    from any that it links with. The set with the stricter bound has such a part, and
    the other keeps it too. Looser joins have smaller parts, so more are to spare.
    """
    out = []
    for k, largest in meeting_classes(len(own), join.percent):
        d = join.differing(2 * largest)
        if not d:
            continue
        m = d + 2 + d // (8 if join.percent >= 90 else 5)
        part = (own % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=m)
        full = np.flatnonzero(count)
        total = np.zeros(m, np.uint64)
        total[full] = np.add.reduceat(_mix(own[order]), np.concatenate([[0], np.cumsum(count[full])[:-1]]))
        differ = join.differing(len(own) + min(largest, len(own) * 100 // join.percent))
        least = next((c for c in (3, 2, 1) if int((count >= c).sum()) > differ), 0)
        keep = count >= least
        place = np.arange(m, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(k)
        out.append(_mix(_mix(total) + place * MIX[0])[keep])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Trie:
    """Sets in one global order, in a prefix tree with compressed paths.

    A node holds the members from its parent's depth to its own, how many members
    the sets below have at least and at most, and the sets that end in it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.root = self._node(order, 0)

    def _node(self, docs: list[int], depth: int) -> list:
        first, last = self.sets[docs[0]], self.sets[docs[-1]]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(differ[0]) if len(differ) else n  # docs are in order, so all share what first and last share
        sizes = [len(self.sets[i]) for i in docs]
        ends = [i for i in docs if len(self.sets[i]) == end]
        children, start = [], len(ends)
        while start < len(docs):
            stop, x = start + 1, self.sets[docs[start]][end]
            while stop < len(docs) and self.sets[docs[stop]][end] == x:
                stop += 1
            children.append((docs[start:stop], end))
            start = stop
        # members here, depth at the end, smallest and largest set below, sets ending here, children, one set below, all of one component
        return [first[depth:end].tolist(), end, min(sizes), max(sizes), ends, children, docs[0], len(docs) == 1]

    def walk(self, own: np.ndarray, percent: int, same: callable, found: callable) -> None:
        """Call ``found(i)`` for each set i that links with ``own``; subtrees are passed
        over where ``same(i)`` holds for all sets of theirs."""
        line = own.tolist()
        member, n, stack = set(line), len(line), [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            here, depth, least, most, ends, children, one, uniform = node
            if uniform and same(one):
                continue
            left = n
            if here:
                overlap += len(member.intersection(here))
                left -= bisect_right(line, here[-1])
            size = min(max(depth + left, least), most)
            bound = overlap + min(left, size - depth)
            if 100 * bound < percent * (n + size - bound):
                continue
            for i in ends:
                if not same(i) and 100 * overlap >= percent * (n + depth - overlap):
                    found(i)
            if children:
                for k, child in enumerate(children):
                    if isinstance(child, tuple):
                        children[k] = self._node(*child)
                    stack.append((children[k], overlap))

    def settle(self, root: callable) -> None:
        """Mark the subtrees whose sets are all of one component by now."""
        nodes, stack = [], [self.root]
        while stack:
            node = stack.pop()
            nodes.append(node)
            stack.extend(c for c in node[5] if not isinstance(c, tuple) and not c[7])
        for node in reversed(nodes):
            r = root(node[6])
            node[7] = all(root(i) == r for i in node[4]) and all((all(root(i) == r for i in c[0]) if isinstance(c, tuple) else c[7] and root(c[6]) == r) for c in node[5])


def _ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted places in the global order: rarest first, then by hash."""
    names, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.uint32)
    rank[np.lexsort((names, count))] = np.arange(len(names), dtype=np.uint32)
    at = rank[inverse]
    return [np.sort(x) for x in np.split(at, np.cumsum([len(s) for s in sets])[:-1])]


def block_links(nodes: list[int], sets: list[np.ndarray], known: list[int], probes: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the links among a block's sets connect (a forest).

    known: the component each set is in already; probes: which sets walk (all, if
    None); links within a component are left out.
    """
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(known):
        parent[i] = root(first.setdefault(c, i))
    if len({root(i) for i in range(len(nodes))}) < 2:
        return []
    ranked = _ranked(sets)
    trie, links = Trie(ranked), []
    for x in range(len(nodes)) if probes is None else probes:
        before = len(links)

        def found(i: int, x: int = x) -> None:
            a, b = root(x), root(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((nodes[x], nodes[i]))

        trie.walk(ranked[x], percent, lambda i, x=x: root(i) == root(x), found)
        if len(links) > before and len(nodes) > 8:
            trie.settle(root)
    return links


def _records(join: Join):
    """(i, n, digest, copy_of, lows, sigs0, ...) of each row: size and digest of its set,
    the signatures, and what is known already from the rows of the same batch.

    Within a batch, equal texts point to the first of them (copy_of) and have no digest
    of their own, and each signature is left to the first row that has it, to which the
    others point (lows). So of a very large group of copies, or of a signature that very
    many rows share, no more than a row a batch is shuffled. Only a set of which a row
    ``signs`` has signatures; the digest connects other rows that have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                ids, sizes, digests, copies, parts, first = batch.column("i").to_pylist(), [], [], [], [np.empty(0, np.uint64)] * batch.num_rows, {}
                for k, (i, text, signs) in enumerate(zip(ids, batch.column("t").to_pylist(), batch.column("signs").to_pylist(), strict=True)):
                    own = shingles(text, join.ngram)
                    sizes.append(len(own))
                    name = xxhash.xxh3_128_digest(own.tobytes()) if len(own) and i is not None else None
                    at = first.setdefault(name, k) if name is not None else k
                    copies.append(ids[at] if at < k else None)
                    digests.append(name if at == k else None)
                    if name is not None and signs and not len(parts[at]):
                        parts[at] = signatures(own, join)
                sigs, lows = _left_to_first(ids, parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(copies, pa.int64()), pa.array(lows, pa.list_(pa.int64())), *_by_turn(sigs, TURNS)],
                    names=["i", "n", "digest", "copy_of", "lows", *_turns(TURNS)],
                )

    return run


def _left_to_first(ids: list[int | None], parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row's signatures that no row before it has, and the ids of the first rows of the others."""
    many = [len(x) for x in parts]
    ends = np.cumsum(many)[:-1]
    _, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(parts)), many)
    owner = row[first][inverse]
    sigs = [x[o == k].view(np.int64) for k, (x, o) in enumerate(zip(parts, np.split(owner, ends), strict=True))]
    lows = [np.array([ids[j] for j in np.unique(o[o != k])], np.int64) for k, o in enumerate(np.split(owner, ends))]
    return sigs, lows


#: Signatures, and keys of large clusters, are shuffled in so many turns, the files of one
#: gone when the next begins. The signatures of a turn are a column of their own, so that
#: no turn reads those of others.
TURNS, KEY_TURNS = 8, 2


def _turns(turns: int) -> list[str]:
    return [f"sigs{turn}" for turn in range(turns)]


def _by_turn(sigs: list[np.ndarray], turns: int) -> list[pa.Array]:
    return [pa.array([x[x % turns == turn] for x in sigs], pa.list_(pa.int64())) for turn in range(turns)]


def _sets(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, join.ngram).tobytes() for t in batch.column("t").to_pylist()]
            rest = [batch.column(c) for c in ("node", "cluster", "docs", "blocks")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) // 8 for x in own], pa.int64()), pa.array(own, pa.binary())], names=["node", "cluster", "docs", "blocks", "n", "own"])

    return run


#: Buckets beyond are not broadcast; their counts travel in ranges of so many buckets.
MOST_BUCKETS, RANGE = 1 << 26, 1 << 16


def _members(buckets: int):
    """(range, places): the buckets of the members of a batch's sets, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column("own").to_pylist()]
            bucket = np.sort((np.concatenate([np.empty(0, np.uint64), *own]) % np.uint64(buckets)).astype(np.int64))
            if len(bucket):
                starts = np.flatnonzero(np.diff(bucket // RANGE, prepend=-1))
                places = [x.astype(np.uint16).tobytes() for x in np.split(bucket % RANGE, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts] // RANGE), pa.array(places, pa.binary())], names=["range", "places"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, levels) of rows that stand by range: how often each of its buckets occurs, as
    a byte that grows with the logarithm of the count (the least counts all differ)."""
    at, count = None, np.zeros(RANGE, np.int64)

    def level() -> pa.RecordBatch:
        levels = np.minimum(np.round(16 * np.log2(1 + count)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([levels.tobytes()], pa.binary())], names=["range", "levels"])

    for batch in batches:
        for r, places in zip(batch.column("range").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if r != at:
                if at is not None:
                    yield level()
                at, count = r, np.zeros(RANGE, np.int64)
            count += np.bincount(np.frombuffer(places, np.uint16), minlength=RANGE)
    if at is not None:
        yield level()


def rarest(own: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The rarest members of a set, as many as must hold one that a linked set's also hold."""
    order = np.lexsort((own, often[(own % np.uint64(len(often))).astype(np.int64)]))
    return own[order[: len(own) * (100 - percent) // 100 + 1]]


def _keys(often: Broadcast, join: Join):
    """(node, lows, sigs0, ...) of each set: its rarest members, of its cluster alone; what
    other rows of the batch have before it is left to them, as in ``_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("node").to_pylist(), []
            for cluster, own in zip(batch.column("cluster").to_pylist(), batch.column("own").to_pylist(), strict=True):
                seed = _mix(np.array([cluster], np.int64).view(np.uint64) * MIX[0])
                parts.append(_mix(rarest(np.frombuffer(own, np.uint64), often.value, join.percent) + seed))
            if ids:
                sigs, lows = _left_to_first(ids, parts)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lows, pa.list_(pa.int64())), *_by_turn(sigs, KEY_TURNS)], names=["node", "lows", *_turns(KEY_TURNS)])

    return run


def _by_block(percent: int):
    """Links of the blocks in a partition, whose rows stand together by ``key``; rows
    that repeat a node's set count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, nodes, sets, known, probes = None, None, [], [], [], []

        def links() -> pd.DataFrame:
            found = block_links(nodes, sets, known, [i for i, p in enumerate(probes) if p], percent) if len(nodes) > 1 else []
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for batch in batches:
            for k, node, own, comp, probe in zip(batch["key"], batch["node"], batch["own"], batch["known"], batch["probe"], strict=True):
                if k != key:
                    if nodes:
                        yield links()
                    key, last, nodes, sets, known, probes = k, None, [], [], [], []
                if last == (node, own, probe):
                    continue
                last = (node, own, probe)
                nodes.append(node)
                sets.append(np.frombuffer(own, np.uint64))
                known.append(comp)
                probes.append(probe)
        if nodes:
            yield links()

    return run


def _compare(rows: DataFrame, join: Join) -> DataFrame:
    """Links of each block of rows (key, node, own, known, probe)."""
    rows = rows.select("key", "node", "own", "known", "probe").repartition("key").sortWithinPartitions("key", "node", "probe", "own")
    return rows.mapInPandas(_by_block(join.percent), "a long, b long")


#: Rows of one cluster are joined with what is known of the cluster in so many parts.
SALTS = 16


def _with_cluster(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``rows`` (node, cluster, ...) with the columns of ``about`` for their cluster. Each
    row of ``about`` is given SALTS times, so that a very large cluster's rows are spread."""
    salted = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"]).drop("salt")


def _met(rows: DataFrame, turns: int, same: DataFrame | None = None) -> DataFrame:
    """Components (node, component) of rows (node, lows, sigs0, ...) that have a signature
    in common, or stand in a row of ``same`` (node, low).

    A signature belongs to one turn, by its hash, so no meeting is lost; the disk that
    shuffles take is that of one turn.
    """
    spark, since, met = rows.sparkSession, len(WRITTEN), rows.select("node", F.explode("lows").alias("low"))
    met = met.unionByName(same) if same else met
    for own in _turns(turns):
        keys = rows.select("node", F.explode(own).alias("sig"))
        meet = keys.select("node", F.min("node").over(Window.partitionBy("sig")).alias("low")).where("node <> low")
        met = met.unionByName(materialize(meet.distinct(), "met"))
        forget_shuffles(spark)
    found = components(met, "node", "low")
    release(spark, since, keep=[found])
    return found


def _placed(near: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """(node, cluster, docs, blocks): the cluster of each node that meets another one, how
    many sets it has, and in how many blocks they are compared."""
    placed = near.select("node", F.col("component").alias("cluster")).join(sizes, "node")
    about = placed.groupBy("cluster").agg(F.sum("docs").alias("docs"), F.sum("members").alias("members")).where("docs > 1")
    about = about.select("cluster", "docs", _blocks(join, F.col("docs"), F.col("members")).alias("blocks"))
    return materialize(_with_cluster(placed.select("node", "cluster"), about).select("node", "cluster", "docs", "blocks"), "placed")


def _divided(sets: DataFrame, join: Join) -> DataFrame:
    """Components (node, component) of the sets of large clusters by their rarest members,
    within each cluster. What can't be rare is known from counts over all these sets, in
    about as many buckets as they have members: in fewer, what two sets share by chance
    couldn't be told from what one set has alone, and the more sets the more they'd meet."""
    spark = sets.sparkSession
    members = sets.agg(F.sum(F.octet_length("own"))).first()[0] or 0
    buckets = max(join.buckets, min(1 << (members // 8).bit_length(), MOST_BUCKETS))
    places = sets.select("own").mapInArrow(_members(buckets), "range long, places binary")
    counts = places.repartition("range").sortWithinPartitions("range").mapInArrow(_levels, "range long, levels binary").toArrow()
    often = np.zeros(-(-buckets // RANGE) * RANGE, np.uint8)
    for r, levels in zip(counts.column("range").to_pylist(), counts.column("levels").to_pylist(), strict=True):
        often[r * RANGE : (r + 1) * RANGE] = np.frombuffer(levels, np.uint8)
    sent = spark.sparkContext.broadcast(often[:buckets])
    sigs = ", ".join(f"{s} array<long>" for s in _turns(KEY_TURNS))
    keys = materialize(sets.select("node", "cluster", "own").mapInArrow(_keys(sent, join), f"node long, lows array<long>, {sigs}"), "keys")
    sent.destroy()
    return _met(keys, KEY_TURNS)


def _blocks(join: Join, docs: Column, members: Column) -> Column:
    return F.greatest(F.ceil(docs / join.block_docs), F.ceil(members / join.block_members)).cast("int")


def linked(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    component_id is the smallest id reachable by links. Null and empty texts have no
    shingles and link with nothing. Rows that repeat an id are one document with
    several texts. A row with a null id has a null component. The whole of every text
    counts, and no link is lost, whatever the sizes of groups. Other columns don't matter.

    The result reads tables in the shared folder (``common.release`` removes them); the
    tables that only the search for links needed are gone when this returns.
    """
    spark, since = documents.sparkSession, len(WRITTEN)
    docs = documents.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    # of equal texts the one with the smallest id has signatures for all
    signs = sieve(docs.groupBy(F.unhex(F.sha2("t", 256))).agg(F.min("i").alias("i")), "i")
    sigs = ", ".join(f"{s} array<long>" for s in _turns(TURNS))
    records = docs.withColumn("signs", signs(F.col("i"))).mapInArrow(_records(join), f"i long, n long, digest binary, copy_of long, lows array<long>, {sigs}")
    records = materialize(records, "records")

    # a representative for each text, and what the others are copies of
    heads = records.where("digest is not null").select("i", "n", F.min("i").over(Window.partitionBy("digest")).alias("rep"))
    heads = materialize(heads, "heads")

    # rows that have a part in common form clusters of representatives
    sizes = heads.where("i = rep").groupBy(F.col("i").alias("node")).agg(F.count("*").alias("docs"), F.sum("n").alias("members"))
    # the row that has a set's signatures needn't be the representative
    same = heads.where("i <> rep").select(F.col("i").alias("node"), F.col("rep").alias("low"))
    placed = _placed(_met(records.withColumnRenamed("i", "node"), TURNS, same), sizes, join)
    # the signatures have done their work, and are most of what is written
    records = materialize(records.select("i", "n", "copy_of"), "rows")
    release(spark, since, keep=[records, heads, placed])
    forget_shuffles(spark)
    copies = records.where("copy_of is not null").select(F.col("i").alias("a"), F.col("copy_of").alias("b")).unionByName(heads.select(F.col("i").alias("a"), F.col("rep").alias("b")))
    # only texts that may be in a cluster are shuffled; placed grows with the corpus: it isn't broadcast at any size
    in_cluster = sieve(placed, "node")
    sets = docs.where(in_cluster(F.col("i"))).join(placed.hint("merge"), F.col("i") == F.col("node")).select("node", "cluster", "docs", "blocks", "t")
    sets = materialize(sets.mapInArrow(_sets(join), "node long, cluster long, docs long, blocks int, n long, own binary").where("n > 0"), "sets")
    if not placed.where("blocks > 1").isEmpty():
        placed = _placed(_divided(sets.where("blocks > 1"), join), sizes, join)
        again = sets.where("blocks > 1").select("node", "n", "own").join(placed.hint("merge"), "node")
        sets = materialize(sets.where("blocks = 1").unionByName(again), "sets")
        release(spark, since, keep=[records, heads, placed, sets])
    forget_shuffles(spark)
    block = F.pmod(F.xxhash64("node", "own"), F.col("blocks")).cast("int")

    # first round: disjoint blocks, but for a few pivots that all blocks of a cluster share
    is_pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.ceil(F.col("docs") / join.pivots)) == 0)
    first = sets.withColumn("block", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    first = first.select(F.to_json(F.struct("cluster", "block")).alias("key"), "node", "own", F.col("node").alias("known"), F.lit(True).alias("probe"))
    links = materialize(_compare(first, join), "links")

    # second round: clusters of several blocks whose components may link across blocks
    if not placed.where("blocks > 1").isEmpty():
        links = _across(sets.where("blocks > 1"), links, join)
    found = components(copies.unionByName(links), "a", "b")
    out = records.select("i", "n").join(found.withColumnRenamed("node", "i"), "i", "left")
    out = out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "i").alias("component_id"))
    release(spark, since, keep=[out])
    forget_shuffles(spark)
    return out


#: Rows a set, about, that a turn of the second round shuffles for its blocks of probes.
COPIES = 4


def _across(sets: DataFrame, links: DataFrame, join: Join) -> DataFrame:
    """Links between blocks of the large clusters, once the first round's are known, and
    for these one from each set to its component.

    Sets of a cluster's largest component needn't be compared among themselves: all
    others are probes, in blocks of their own, against every block of the cluster. What
    is to be done with a set is found from ids alone; the sets themselves are joined by
    their own id, so no cluster's sets stand in one task. Each set is given once a block of
    probes; the blocks of probes take turns, so that about ``COPIES`` rows a set stand on
    disk at once, however many blocks there are.
    """
    spark, known = sets.sparkSession, components(links, "a", "b")
    rows = sets.select("node", "cluster", "n").join(known, "node", "left").withColumn("known", F.coalesce("component", "node"))
    count = rows.groupBy("cluster", "known").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    best = count.groupBy("cluster").agg(F.max(F.struct("c", "known")).alias("x"), F.sum("c").alias("all"))
    rest = count.join(best, "cluster").where("known <> x.known")  # clusters of one component are through
    rest = rest.groupBy("cluster").agg(F.first("x.known").alias("main"), F.first("all").alias("all"), _blocks(join, F.sum("c"), F.sum("m")).alias("probe_blocks"))
    rest = materialize(rest, "rest")
    work = materialize(_with_cluster(rows.select("node", "cluster", "known").distinct(), rest.drop("all")).drop("cluster"), "work")
    copied, most = rest.agg(F.sum(F.col("all") * F.col("probe_blocks")) / F.sum("all"), F.max("probe_blocks")).first()
    turns = min(max(1, -(-int(copied or 0) // COPIES)), most or 1)
    rows = sets.join(work.hint("merge"), "node").select("cluster", "node", "own", "known", "main", "blocks", "probe_blocks")
    own_block, own_other = F.pmod(F.xxhash64("node", "own"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit("probe"), "node", "own"), F.col("probe_blocks")).cast("int")
    links = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    for turn in range(turns):
        stored = rows.where(F.col("probe_blocks") > turn).withColumn("other", F.explode(F.sequence(F.lit(turn), F.col("probe_blocks") - 1, F.lit(turns)))).withColumn("block", own_block)
        probing = rows.where("known <> main").withColumn("other", own_other).where(F.col("other") % turns == turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = stored.withColumn("probe", F.lit(False)).unionByName(probing.withColumn("probe", F.lit(True)))
        across = _compare(both.withColumn("key", F.to_json(F.struct("cluster", "block", "other"))), join)
        links = links.unionByName(materialize(across, "links"))
        forget_shuffles(spark)
    return links
