"""Toxicity: a counterfactual-regularised linear classifier.

A logistic model over hashed words and word beginnings is fitted on a bounded
sample of labelled rows.  Each of them gives a pair of texts that differ only in the
social group that they name: a text that names one is paired with a copy in which
the name is swapped for another one's, any other text gives two copies to which a
term and its sibling are added.  Both copies keep the row's label in the fit, and it
penalises the squared difference of the pair's scores, and of each copy's from that of
the text to which a term was only added: so the mere mention of a group moves no
score, even if most of the labelled texts that name it are toxic.  Every text,
whatever its length, is scored as a whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import WRITTEN, held_out, materialize, release

#: Groups of interchangeable identity terms; a swap takes the next term of the group.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"),
)

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 20
#: A text is taken as toxic from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Fit:
    """How the classifier is fitted.

    max_rows: at most so many labelled rows are used, those with the smallest hash
    of their id; iterations, l2: of the optimiser; penalty: weight of the squared
    score changes by counterfactuals; copies: weight of each copy of a row in the
    likelihood; min_chi2: a feature is used if its association with the label has at
    least this chi-square value, and is among the max_features highest; those of identity
    terms always are; groups: of interchangeable identity terms, in lower case.
    """

    max_rows: int = 12_000
    iterations: int = 120
    l2: float = 1.0
    penalty: float = 1.0
    copies: float = 0.5
    min_chi2: float = 4.0
    max_features: int = 16_384
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


@dataclass(frozen=True)
class Model:
    """ids: the hashed features that count; weights: theirs; bias; pairs: how many
    counterfactual pairs the fit had."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0

    def scorer(self) -> Callable[[str | None], float]:
        """A function from text to score; it remembers which features that count a
        word has, for at most 200,000 words at a time."""
        known: dict[str, tuple[int, ...]] = {}
        weight = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))
        mask = (1 << BITS) - 1

        def ids(word: str) -> tuple[int, ...]:
            if len(known) > 200_000:
                known.clear()
            found = {crc32(x.encode()) & mask for x in (f"={word}", *(word[:n] for n in range(4, min(8, len(word)) + 1)))}
            known[word] = out = tuple(i for i in found if i in weight)
            return out

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for word in tokens(text):
                own = known.get(word)
                hit.update(ids(word) if own is None else own)
            z = self.bias + sum(weight[i] for i in sorted(hit))
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

        return score


def tokens(text: str | None) -> set[str]:
    """The distinct words of letters of a text, in lower case."""
    return set(LETTERS.findall(text.lower())) if text else set()


def features(found: set[str]) -> np.ndarray:
    """Hashed features: each word, and its beginnings of 4 to 8 letters."""
    named = {f"={w}" for w in found}
    for n in range(4, 9):
        named.update(w[:n] for w in found if len(w) >= n)
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((crc32(x.encode()) & mask for x in named), np.int64, len(named)))


def swapped(found: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> set[str]:
    """The words with each identity term replaced by the next one of its group."""
    following = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
    return {following.get(w, w) for w in found}


def contrast(found: set[str], order: int, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray, bool]:
    """Features by which the texts of a counterfactual pair differ, and whether they are added.

    A text that names a group is paired with its swapped copy: what only the text, and
    only the copy has. Any other text gives two copies: ``order`` chooses a term of a
    group for the one, its sibling goes into the other; what either has more than the text.
    """
    named, own = swapped(found, groups), features(found)
    several = [g for g in groups if len(g) > 1]
    if named == found and several:
        group = several[order % len(several)]
        at = order // len(several) % len(group)
        one, other = (np.setdiff1d(features({group[k % len(group)]}), own, assume_unique=True) for k in (at, at + 1))
        return one, other, True
    other = features(named)
    return np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True), False


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of either label have each feature, for a partition's texts."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, y in zip(batch["t"], batch["y"], strict=True):
            total[int(y)][features(tokens(text))] += 1
    ids = np.flatnonzero(total.any(0))
    yield pd.DataFrame({"f": ids, "n0": total[0][ids], "n1": total[1][ids]})


def associated(sample: DataFrame, fit: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """Features that go with the label, and for each its smoothed log ratio of rates:
    the fit scales features by it, so that few rows teach as much as they can. Those of
    identity terms are among them whatever they go with, with a ratio of 1 at least, so
    that the counterfactual pairs have what they compare.

    Counting and choosing happen on the executors, in a bounded number of features.
    """
    rows = {int(r["y"]): r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    if not n0 or not n1:
        return np.empty(0, np.int32), np.empty(0)
    counts = sample.select("t", "y").mapInPandas(_counted, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = F.col("n0") + F.col("n1")
    expected = share * F.lit(n1 / (n0 + n1))
    chi2 = (F.col("n1") - expected) ** 2 * (1 / expected + 1 / (share - expected))
    named = np.unique(np.concatenate([features({w}) for g in fit.groups for w in g] or [np.empty(0, np.int64)]))
    best = counts.where((share >= 2) & (chi2 >= fit.min_chi2)).orderBy(F.desc(chi2), "f").limit(fit.max_features)
    chosen = best.toPandas().set_index("f")[["n0", "n1"]]
    also = counts.where(F.col("f").isin(named.tolist())).toPandas().set_index("f")[["n0", "n1"]]
    chosen = pd.concat([chosen, also, pd.DataFrame(0, named, ["n0", "n1"])])
    chosen = chosen[~chosen.index.duplicated()].sort_index()
    ratio = (np.log((chosen["n1"] + 0.5) / (n1 + 1)) - np.log((chosen["n0"] + 0.5) / (n0 + 1))).to_numpy()
    ratio = np.where(np.isin(chosen.index, named), np.copysign(np.maximum(np.abs(ratio), 1.0), ratio), ratio)
    return chosen.index.to_numpy(np.int32), ratio


def _chosen_features(ids: np.ndarray, groups: tuple[tuple[str, ...], ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1, np.int32)
        place[ids] = np.arange(len(ids))

        def pick(found: np.ndarray) -> np.ndarray:
            at = place[found]
            return at[at >= 0]

        for batch in batches:
            rows = []
            for text, o in zip(batch["t"], batch["o"], strict=True):
                found = tokens(text)
                one, other, added = contrast(found, int(o) & ((1 << 62) - 1), groups)
                rows.append((pick(features(found)), pick(one), pick(other), added, len(one) + len(other) > 0))
            yield pd.DataFrame(rows, columns=["own", "one", "other", "added", "pair"]).assign(o=batch["o"].to_numpy(), y=batch["y"].to_numpy())

    return run


@dataclass(frozen=True)
class Sample:
    """Labels y of the rows; and of each kind (row, feature) of what a row has: own
    features, and those that only the one or the other text of its pair has; added:
    whether the pair's texts have these besides their own."""

    y: np.ndarray
    added: np.ndarray
    own: tuple[np.ndarray, np.ndarray]
    one: tuple[np.ndarray, np.ndarray]
    other: tuple[np.ndarray, np.ndarray]
    pairs: int


def sampled(sample: DataFrame, ids: np.ndarray, groups: tuple[tuple[str, ...], ...]) -> Sample:
    """The sample's rows, in order of o, with the chosen features only."""
    rows = sample.select("t", "y", "o").mapInPandas(_chosen_features(ids, groups), "own array<int>, one array<int>, other array<int>, added boolean, pair boolean, o long, y int")
    table = rows.toArrow().sort_by([("o", "ascending"), ("y", "ascending")])

    def sparse(name: str) -> tuple[np.ndarray, np.ndarray]:
        many = pc.list_value_length(table[name]).to_numpy()
        return np.repeat(np.arange(len(many), dtype=np.int32), many), pc.list_flatten(table[name]).to_numpy()

    return Sample(table["y"].to_numpy(), table["added"].to_numpy(), sparse("own"), sparse("one"), sparse("other"), int(pc.sum(table["pair"]).as_py() or 0))


def train(rows: Sample, ids: np.ndarray, scale: np.ndarray, fit: Fit = Fit()) -> Model:
    """Fit by Adam on the whole sample; without rows, every score is 0.5.

    The loss is the logistic one of the rows, and times ``copies`` of both texts of each
    pair with the row's label; half the squared changes of the log odds times ``penalty``
    (between the two texts, and from the row's text to one with a term added); and the
    squared weights times ``l2``, halved.
    """
    y, n, size = rows.y, len(rows.y), len(ids)
    if not n:
        return Model(ids, np.zeros(size, np.float32), 0.0)
    rate = float(y.mean())
    w, b, m1, m2 = np.zeros(size), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 0.0, 0.0

    def total(part: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> np.ndarray:
        return np.bincount(part[0], v[part[1]], n)

    def back(part: tuple[np.ndarray, np.ndarray], g: np.ndarray) -> np.ndarray:
        return np.bincount(part[1], g[part[0]], size)

    def odds(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, fit.iterations + 1):
        v = w * scale
        own, one, other = total(rows.own, v) + b, total(rows.one, v), total(rows.other, v)
        g = odds(own) - y
        # the pair's texts: own + one and own + other, or own and own - one + other
        first, second = fit.copies * (odds(np.where(rows.added, own + one, own)) - y), fit.copies * (odds(np.where(rows.added, own + other, own - one + other)) - y)
        between = fit.penalty * (one - other)
        by_one = between + np.where(rows.added, first + fit.penalty * one, -second)
        by_other = -between + second + np.where(rows.added, fit.penalty * other, 0.0)
        g = g + first + second
        grad = (back(rows.own, g) + back(rows.one, by_one) + back(rows.other, by_other)) * scale + fit.l2 * w
        grad = np.append(grad, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(ids, (w * scale).astype(np.float32), float(b), rows.pairs)


def learning_rows(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000) -> DataFrame:
    """(t, y, o) of the labelled documents that teach, written to the shared folder.

    A document with several label rows counts as toxic if one says so; null ids and
    null labels are ignored; null texts count as empty. The rows are chosen by ids and
    labels alone, so that no other text is moved. Of the texts of rows that share an
    id, the one with the smallest hash teaches: no id brings more than a row.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where("i is not null and y is not null").where(~held_out(F.col("i")))
    known = known.groupBy("i").agg((F.max("y") > 0).cast("int").alias("y"), F.xxhash64("i").alias("o"))
    there = known.join(documents.select(F.col(doc_id).alias("i")), "i", "left_semi")
    chosen = there.orderBy("o", "i").limit(max_rows)  # ids and labels only, max_rows at most
    texts = documents.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    each = texts.join(F.broadcast(chosen), "i").groupBy("i", "y", "o").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    return materialize(each.select("t", "y", "o"), "labelled")


def fit_on(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit: Fit = Fit()) -> Model:
    """Learn from the labelled documents that aren't held out; see ``learning_rows``."""
    since = len(WRITTEN)
    sample = learning_rows(documents, labels, doc_id=doc_id, text=text, label=label, max_rows=fit.max_rows)
    ids, scale = associated(sample, fit)
    model = train(sampled(sample, ids, fit.groups), ids, scale, fit)
    release(documents.sparkSession, since)
    return model


def score(model: Model, text: Column) -> Column:
    """A score from 0 to 1 for each whole text; null and empty texts, and those without
    a letter, get the bias's. Equal texts have equal scores, whatever is beside them."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype="float64")

    return F.pandas_udf(scored, "double")(text)
