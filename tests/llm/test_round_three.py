"""Conversation repair, vector codes and exact search against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import codes, repair, topk

SPACE = " \t\n\x0b\x0c\r"


# conversation repair


def cheapest(turns):
    """(cost, audit, lines): edits tried in order of (cost, audit) until one is a talk.
    turns: (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(lines)
        state = (i, roles[-1:], len(roles) > 0)
        if state in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add(state)
        for letter, name in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + letter, (*lines, f"{name}:")))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if not gone:
                heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, roles + letter, (*lines, f"{name}:{text}")))


def plain_repair(rows):
    """The contract by plain Python; rows (conv, turn, role, text), damaged."""
    show = lambda x: " " if x is None else str(x)
    talks = {}
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), "user" if kind == 4 else role
        talks.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, found in talks.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, n, turns = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, role, text in found:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for t, _, _ in found if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_turns(rng, convs, longest):
    rows, texts = [], ["Yes.", "No!", "why?", "it goes on", " \t", "", None, "same.", "same.", "a. b", "é\u00a0"]
    for conv in convs:
        for k in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([k, k, k, k + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "uncle", "", None]), rng.choice(texts)))
    return rows


def damaged_and_repaired(spark, rows, limit=repair.Segments()):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, rows string, part int")
    broken, copies = repair.damaged(df)
    got = repair.repaired(broken, copies=copies, limit=limit)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("limit", [repair.Segments(), repair.Segments(rows=2), repair.Segments(chars=5)])
def test_repair_equals_the_plain_version(spark, limit):
    rng = random.Random(33)
    rows = some_turns(rng, [*range(120), None], 7)
    got = damaged_and_repaired(spark, rows, limit)
    assert {r[0]: r[1:] for r in got} == plain_repair(rows) and len(got) == 121


def test_repair_of_one_very_long_conversation_in_many_tasks(spark):
    rng = random.Random(34)
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", rng.choice(["Word %d." % k, "Word %d" % k, "same.", "more."])) for k in range(3000)] + [(7, None, "system", "Be kind.")] * 400 + some_turns(rng, range(20, 60), 5)
    got = damaged_and_repaired(spark, rows, repair.Segments(rows=100))
    assert {r[0]: r[1:] for r in got} == plain_repair(rows)
    assert damaged_and_repaired(spark, rows) == got or set(damaged_and_repaired(spark, rows)) == set(got)


def test_repair_of_conversations_that_begin_and_end_in_the_middle_of_tasks(spark):
    rng = random.Random(38)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["Word %d." % rng.randint(0, 300), "same.", "no end"])) for c in range(3) for k in range(500)]
    for limit in (repair.Segments(), repair.Segments(rows=30)):
        assert {r[0]: r[1:] for r in damaged_and_repaired(spark, rows, limit)} == plain_repair(rows)


def test_repair_of_nothing_and_of_long_texts(spark):
    assert damaged_and_repaired(spark, []) == []
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(dropped, 1, "user", "Gone."), (1000, 2, "user", "word " * 300_000 + "."), (1000, 3, "assistant", "Yes.")]
    got = {r[0]: r[1:] for r in damaged_and_repaired(spark, rows)}
    assert got == plain_repair(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_the_chart_keeps_the_cheapest_of_all_edits():
    rng = random.Random(35)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "no"]), rng.random() < 0.2, False) for _ in range(rng.randint(0, 9))]
        turns = [(r, t, g, not g and t == "no") for r, t, g, _ in turns]
        symbols = "".join("-" if g else repair.symbol(r, t) for r, t, g, _ in turns)
        chart = {i: (c, a) for i, c, a in repair.parsed(symbols)}
        cost, audit = chart[repair.ended(chart)]
        lines = repair.follow(None, audit, [{"role": r, "text": t} for r, t, _, _ in turns])
        assert (cost, audit, lines) == cheapest(turns), symbols


# vector codes


def plain_codes(rows, parts=16, entries=64):
    """(vec_id, code, error, label_error, digest) by plain integers."""
    kept = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if v is not None and None not in v and np.isfinite(v).all()]
    kept = [(i, v + [0] * (-len(v) % parts), y) for i, v, y in kept]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [(i, [v[p * w : p * w + w] for p in range(parts)], y) for i, v, y in kept]
    book = [[x[p] for _, x, _ in sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for p in range(parts)]
    near = lambda x, c: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(c))
    for _ in range(2):
        for p in range(parts):
            own = [near(x[p], book[p])[1] for _, x, _ in cut]
            for k in set(own):
                of = [x[p] for (_, x, _), o in zip(cut, own) if o == k]
                book[p][k] = [sum(c) // len(of) for c in zip(*of)]
    out, by_label = [], {}
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    for i, x, y in cut:
        found = [near(x[p], book[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        by_label[y] = by_label.get(y, 0) + out[-1][2]
    return [(i, c, e, by_label[y], sha) for i, c, e, y in out]


VECTORS = "vec_id long, embedding array<double>, label int, v string, code string"


@pytest.mark.parametrize("n,size,scale", [(300, 32, 1.0), (40, 16, 1.0), (200, 20, 3.0), (150, 16, 1e6), (1, 16, 1.0)])
def test_codes_equal_the_plain_version(spark, n, size, scale):
    rng = np.random.default_rng(n)
    rows = [(int(i), (np.round(rng.normal(size=size), 2) * scale).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]
    rows += [(rows[0][0], rows[0][1], 1), (None, rows[0][1], None)] + [(1000 + k, rows[0][1], 2) for k in range(50)]
    odd = [(5000, None, 1), (5001, [None] * size, 1), (5002, [float("nan")] * size, 1), (5003, [float("inf")] * size, None), (5004, [], 1)]
    got = codes.compress(spark.createDataFrame([(*r, "x", "y") for r in rows + odd], VECTORS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_codes(rows), key=str)


def test_codes_of_nothing_and_beyond_64_bits(spark):
    for rows in ([], [(1, None, 1, "x", "y")], [(1, [], 1, "x", "y")]):
        got = codes.compress(spark.createDataFrame(rows, VECTORS))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e300] * 16, 1, "x", "y")], VECTORS)).collect()


# exact search


def plain_top(rows, k=5, every=50):
    ok = {(i, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(v).all()}
    out = []
    for q, x in sorted(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def found_top(spark, rows, **k):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, members string").repartition(4)
    return [tuple(r) for r in topk.largest_products(df, F.col("vec_id") % 50 == 0, **k).orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("search", [topk.Search(), topk.Search(block=64, queries=2, chunk=16), topk.Search(block=200, chunk=50, stops=(4,))])
def test_top_equals_the_plain_version(spark, search):
    rng = np.random.default_rng(36)
    length = 10.0 ** rng.uniform(-2, 2, 900)
    rows = [(i, (np.round(rng.normal(size=12), 1) * length[i]).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000 + i, [0.0] * 12) for i in range(60)] + [(50, rows[50][1])]
    odd = [(3000, None), (3050, [float("nan")] * 12), (3100, [None] * 12), (3150, [float("inf")] * 12), (3200, [1.0])]
    assert found_top(spark, rows + odd + [(None, rows[1][1])], search=search) == plain_top(rows)


def test_top_of_few_vectors_of_nothing_and_of_large_ones(spark):
    assert found_top(spark, []) == [] and found_top(spark, [(0, None)]) == [] and found_top(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.5]), (3, [1.0, 2.0])]
    assert found_top(spark, rows) == plain_top(rows)
    rows = [(i, [1e6 + i * 2.0**-8, -1e6]) for i in range(120)]
    assert found_top(spark, rows) == plain_top(rows)


def test_most_pairs_are_left_before_their_last_dimension():
    rng = np.random.default_rng(37)
    x = (rng.normal(size=(4000, 32)) * np.linspace(3, 0.05, 32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0] * 100).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    search = topk.Search()
    all_of, scored = topk.Turned(x, topk.rotation(x[:1000], 32), search), []
    found = topk.Found(np.full(40, -np.inf), 5)
    add = found.add
    found.add = lambda q, *rest: (scored.append(len(q)), add(q, *rest))
    topk.scan(topk.Turned(x[:4000:100], topk.rotation(x[:1000], 32), search), np.arange(0, 4000, 100), all_of, np.arange(4000), np.full(4000, -1), found, search)
    assert sum(scored) < 0.05 * 40 * 4000
    right = x[::100] @ x.T
    right[np.arange(40), np.arange(0, 4000, 100)] = np.iinfo(np.int64).min
    assert np.array_equal(np.sort(found.score.reshape(40, 5)), np.sort(np.sort(right)[:, -5:]))
