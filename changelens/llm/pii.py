"""Personal data: exact base patterns, and a skip-chain conditional random field.

The base patterns find e-mail and IP addresses, payment cards and phone numbers.
A linear-chain field over the words of a document, with extra edges between words
that repeat or resemble each other, adds spans that the patterns miss: it learns
from the base spans of a bounded sample what such words look like, and loopy
message passing makes the labels of linked words agree across the document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import WORD

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 is none, then the kinds.
LABELS = ("none", *KINDS)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
OCTET = re.compile(r"[0-9]{1,3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(WORD)
CLUE = re.compile(r"[0-9@]")
EDGE = "\"'()[]{}<>|,;:.!?"


@dataclass(frozen=True)
class Fit:
    """max_texts: at most so many sampled rows with a clue teach the field, whole;
    iterations: of the fit, and passes: of message passing; sure: marginal from which
    on a span is added."""

    max_texts: int = 4000
    iterations: int = 300
    passes: int = 12
    sure: float = 0.9


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; in code points.

    The patterns' leftmost matches that don't overlap, by kind; matches that fail
    their check are dropped without another try. Each scan takes linear time.
    """
    found: list[tuple[str, int, int]] = []
    if not text or not CLUE.search(text):
        return found
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: What is asked of a word; each answer has a weight for each label.
N_FEATURES = 20


def _features(word: str) -> list[bool]:
    digits = "".join(c for c in word if "0" <= c <= "9")
    n, parts = len(digits), word.split(".")
    other = len(word) - n
    at = "@" in word[1:-1]
    return [
        True, at, at and "." in word.rsplit("@", 1)[1][1:-1], at and word.count("@") == 1, word.startswith("+"), word.startswith("(") or word.endswith(")"),
        n == 0, 1 <= n <= 3, n == 4, 5 <= n <= 7, 8 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        n > 0 and other == 0, "-" in word[1:-1] and n >= 5, len(parts) == 4 and all(OCTET.fullmatch(p) and int(p) <= 255 for p in parts),
        16 <= n <= 19 and luhn(digits), any(c.isalpha() for c in word), other > n,
    ]


@dataclass
class Graph:
    """The words of a text that could be personal data, with their links.

    spans: where they are; x: features; chain, skip: pairs of words; alone: how many
    of a word's two neighbours aren't in the graph (their label is none).
    """

    spans: list[tuple[int, int]]
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    alone: np.ndarray


def graph(text: str | None) -> Graph | None:
    """The graph of a whole text, or None where no word has a digit or an @.

    Skip edges link each word with the next one of the same letters and digits, of the
    same six digits or more, or of the same address before the @; so their number is
    at most three for each word, however often one repeats.
    """
    if not text or not CLUE.search(text):
        return None
    spans, places, rows, chain, skip = [], [], [], [], []
    last: dict[tuple[str, str], int] = {}
    for place, m in enumerate(WORDS.finditer(text)):
        word = m[0]
        if not CLUE.search(word):
            continue
        bare = word.strip(EDGE)
        start = m.start() + len(word) - len(word.lstrip(EDGE))
        k = len(spans)
        if k and places[-1] == place - 1:
            chain.append((k - 1, k))
        spans.append((start, start + len(bare)))
        places.append(place)
        rows.append(_features(word.strip("\"'[]{}<>|,;:.!?")))
        digits = "".join(c for c in bare if "0" <= c <= "9")
        keys = [("same", "".join(c for c in bare.lower() if c.isalnum()))]
        if len(digits) >= 6:
            keys.append(("digits", digits))
        if "@" in bare[1:]:
            keys.append(("local", bare[: bare.index("@", 1)].lower()))
        linked = {last[key] for key in keys if key in last}
        skip.extend((j, k) for j in linked)
        last.update(dict.fromkeys(keys, k))
    if not spans:
        return None
    chain_a, skip_a = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)
    alone = 2 - np.bincount(chain_a.ravel(), minlength=len(spans))
    return Graph(spans, np.array(rows, float), chain_a, skip_a, alone)


@dataclass(frozen=True)
class Model:
    """Weights: node (features by labels), chain (labels by labels, left and right),
    skip (by label, for two linked words that both have it)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


#: Which weights a word's label depends on: a number for its features, the labels of
#: the word, of the word before and of the one after, and how many linked words have each label.
CASE = ["x", "y", "left", "right", *(f"side{k}" for k in range(len(LABELS)))]
CASES = ", ".join(f"{c} int" for c in CASE) + ", n long"


def cases(texts: Iterable[str | None]) -> pd.DataFrame:
    """How often each different case stands in the texts, by their base spans. The fit
    needs no more, so no text leaves its task, however long it is."""
    found: Counter[tuple[int, ...]] = Counter()
    powers = 1 << np.arange(N_FEATURES)
    for text in texts:
        g = graph(text)
        if g is None:
            continue
        y, starts = np.zeros(len(g.spans), np.int64), [s for s, _ in g.spans]
        for kind, s, e in base_spans(text):
            for i in range(max(0, bisect_right(starts, s) - 1), bisect_left(starts, e)):
                if g.spans[i][1] > s:
                    y[i] = LABELS.index(kind)
        left, right, side = np.zeros_like(y), np.zeros_like(y), np.zeros((len(y), len(LABELS)), np.int64)
        left[g.chain[:, 1]], right[g.chain[:, 0]] = y[g.chain[:, 0]], y[g.chain[:, 1]]
        np.add.at(side, (g.skip[:, 0], y[g.skip[:, 1]]), 1)
        np.add.at(side, (g.skip[:, 1], y[g.skip[:, 0]]), 1)
        found.update(map(tuple, np.column_stack([g.x.astype(np.int64) @ powers, y, left, right, side]).tolist()))
    out = pd.DataFrame(list(found), columns=CASE, dtype="int64")
    return out.assign(n=np.array(list(found.values()), np.int64))


def train(counted: pd.DataFrame, fit: Fit = Fit()) -> Model:
    """Fit by pseudo-likelihood: each word's base label given its neighbours' labels."""
    n_labels, eye = len(LABELS), np.eye(len(LABELS))
    node, chain, skip = np.zeros((N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    if counted.empty:
        node[0, 0] = 10.0  # nothing to learn from: no word is personal data
        return Model(node, chain, skip)
    counted = counted.sort_values(CASE)
    x = (counted["x"].to_numpy()[:, None] >> np.arange(N_FEATURES) & 1).astype(float)
    y, left, right = (eye[counted[c].to_numpy()] for c in ("y", "left", "right"))
    side, share = counted[CASE[4:]].to_numpy(float), counted["n"].to_numpy(float)[:, None]
    share = share / share.sum()
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (node, chain, skip)]
    for step in range(1, fit.iterations + 1):
        z = x @ node + left @ chain + right @ chain.T + side * skip
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) * share
        grads = (x.T @ d + 1e-3 * node, left.T @ d + d.T @ right + 1e-3 * chain, (side * d).sum(0) + 1e-3 * skip)
        for w, g, m in zip((node, chain, skip), grads, moment, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            w -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        np.maximum(skip, 0, out=skip)  # linked words never repel each other
    return Model(node, chain, skip)


def marginals(g: Graph, model: Model, passes: int = Fit.passes) -> np.ndarray:
    """Each word's probabilities of the labels, by loopy sum-product message passing."""
    local = g.x @ model.node + g.alone[:, None] * (model.chain[0] + model.chain[:, 0]) / 2
    edges = np.concatenate([g.chain, g.skip])
    if not len(edges):
        local = np.exp(local - local.max(1, keepdims=True))
        return local / local.sum(1, keepdims=True)
    pair = np.concatenate([np.broadcast_to(model.chain, (len(g.chain), *model.chain.shape)), np.broadcast_to(np.diag(model.skip), (len(g.skip), *model.chain.shape))])
    # each edge both ways: the first half goes from its first word to its second
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    kernel = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), len(LABELS)))
    for _ in range(passes):
        belief = local.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", out, kernel) + 1e-300)
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    belief = local.copy()
    np.add.at(belief, target, message)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def all_spans(text: str | None, model: Model, fit: Fit = Fit()) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all: with those that the field adds beside them.

    Neighbouring words of a phone number make one span. An added span overlaps no other.
    """
    base = base_spans(text)
    g = graph(text)
    if g is None:
        return base, base
    p = marginals(g, model, fit.passes)
    label = np.where(p.max(1) >= fit.sure, p.argmax(1), 0)
    joined = {int(b): int(a) for a, b in g.chain}
    taken, more = sorted((s, e) for _, s, e in base), []
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or reach[k - 1] <= s

    run: dict[int, int] = {}
    for i in np.flatnonzero(label).tolist():
        s, e = g.spans[i]
        if e <= s or not free(s, e):
            continue
        if LABELS[label[i]] == "phone" and i in joined and joined[i] in run and label[joined[i]] == label[i]:
            run[i] = run[joined[i]]
            more[run[i]] = (more[run[i]][0], more[run[i]][1], e)
        else:
            run[i] = len(more)
            more.append((LABELS[label[i]], s, e))
    return base, sorted(base + [x for x in more if free(x[1], x[2])], key=lambda x: (KINDS.index(x[0]), x[1]))


def fit_on(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fit: Fit = Fit()) -> Model:
    """Learn from the whole texts with a digit or an @ whose ids have the smallest hashes.

    Null and empty texts teach nothing; without any text to learn from, the field adds
    nothing to the base spans. The cases are counted on the executors.
    """
    rows = documents.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    chosen = rows.select("h").orderBy("h").limit(fit.max_texts).distinct()  # hashes only, max_texts at most
    sample = rows.join(F.broadcast(chosen), "h").select("t")
    counted = sample.mapInPandas(lambda batches: (cases(batch["t"]) for batch in batches), CASES).groupBy(*CASE).agg(F.sum("n").alias("n"))
    return train(counted.toPandas(), fit)


def tag(model: Model, text: Column, fit: Fit = Fit()) -> Column:
    """A struct of base and spans, arrays of (kind, start, end), for each whole text.

    Null texts, empty ones and those without a digit or an @ have empty arrays. Each row
    is judged alone, so equal texts have equal spans. Spans are sorted by kind as listed,
    then by start; base spans of different kinds may overlap, added ones overlap none.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [all_spans(t, model, fit) for t in batch]
            as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield pd.DataFrame({"base": [as_rows(b) for b, _ in found], "spans": [as_rows(a) for _, a in found]})

    span = "array<struct<kind string, start int, end int>>"
    return F.pandas_udf(run, f"base {span}, spans {span}")(text)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that
    overlap, the one that starts first counts, then the longer."""
    at, parts = 0, []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
            at = e
        elif e > at:
            at = e  # what sticks out goes too
    return "".join([*parts, text[at:]])


def mask(model: Model, text: Column, fit: Fit = Fit()) -> Column:
    """Each whole text with all its spans masked; null stays null and empty texts empty.
    Each row is masked alone, so equal texts are masked alike."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else masked(t, all_spans(t, model, fit)[1]) for t in batch], dtype=object)

    return F.pandas_udf(run, "string")(text)
