"""Conversation structure repair by error-correcting Earley parsing.

A weighted grammar says which order of roles a conversation may have; productions that
delete a turn, change its role or insert an empty one make every conversation parse at
some cost.  Items of a chart keep the least (cost, audit), the audit being one letter an
edit, and the completed chart yields the repair.

All nonterminals stand first in their productions, so every item begins where the
conversation does, and the chart after a turn is a handful of items whatever came
before.  A conversation of any length is therefore parsed in segments of bounded size,
each from every item that may be open at its start, by as many tasks as there are; the
segments' charts are then chained in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import SPACES, materialize

#: Productions; talk is a conversation: (s? (u a)+)?, roles by their first letters.
GRAMMAR: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("talk", ()), ("talk", ("answered",)), ("answered", ("asked", "a")), ("asked", ("head", "u")), ("asked", ("answered", "u")), ("head", ()), ("head", ("s",)),
)
#: Roles that a turn may be given, or an inserted one may have.
GIVEN = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """Of the edits, and of a truncated turn that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Segments:
    """rows, chars: of a segment at most (one longer text is a segment of its own)."""

    rows: int = 512
    chars: int = 100_000


#: A production and how much of it is read; an item of the chart.
Item = tuple[int, int]
Chart = dict[Item, tuple[int, str]]


def _next(item: Item) -> str | None:
    right = GRAMMAR[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


def is_open(item: Item) -> bool:
    """Whether a turn may follow, or the conversation may end: of such items a chart's
    other ones follow."""
    after = _next(item)
    return after is None and GRAMMAR[item[0]][0] == "talk" or after is not None and not any(after == left for left, _ in GRAMMAR)


START: Chart = {(k, 0): (0, "") for k, (_, right) in enumerate(GRAMMAR) if not right or is_open((k, 0))}


def _closed(chart: Chart, costs: Costs | None) -> Chart:
    """With all items that completed productions lead to, and with costs, inserted turns."""
    work = list(chart)
    while work:
        item = work.pop()
        (cost, audit), after = chart[item], _next(item)
        if after is None:
            reached = [((k, 1), (cost, audit)) for k, (_, right) in enumerate(GRAMMAR) if right and right[0] == GRAMMAR[item[0]][0]]
        elif after in GIVEN and costs:
            reached = [((item[0], item[1] + 1), (cost + costs.insert, audit + "I"))]
        else:
            reached = []
        for to, value in reached:
            if to not in chart or value < chart[to]:
                chart[to] = value
                work.append(to)
    return chart


def _read(chart: Chart, turn: str, costs: Costs) -> Chart:
    """The chart after a turn: deleted, kept or with another role.

    turn: the role's first letter (? for others than s, u, a), upper case where the text
    is truncated; - for a turn that must go.
    """
    out: Chart = {}

    def offer(item: Item, cost: int, audit: str) -> None:
        if item not in out or (cost, audit) < out[item]:
            out[item] = (cost, audit)

    extra = costs.truncated if turn.isupper() or turn == "!" else 0
    for item, (cost, audit) in chart.items():
        if not is_open(item):
            continue
        offer(item, cost + costs.delete, audit + "D")
        after = _next(item)
        if turn == "-" or after is None:
            continue
        to = (item[0], item[1] + 1)
        if turn.lower() == after:
            offer(to, cost + extra, audit + "K")
        if after in GIVEN:
            offer(to, cost + costs.rerole + extra, audit + "R")
    return _closed(out, costs)


def parsed(turns: str, start: Item | None = None, costs: Costs = Costs()) -> list[tuple[Item, int, str]]:
    """(item, cost, audit) of the open items after the turns, from an item, or from the
    beginning of a conversation."""
    chart = _closed(dict(START) if start is None else {start: (0, "")}, costs)
    for turn in turns:
        chart = _read(chart, turn, costs)
    return [(item, *value) for item, value in sorted(chart.items()) if is_open(item)]


#: Short conversations of the same symbols are parsed once a worker.
_parsed_once = lru_cache(maxsize=20_000)(parsed)


def ended(chart: dict[Item, tuple]) -> Item:
    """The item of a whole conversation with the least (cost, audit)."""
    return min((i for i in chart if _next(i) is None), key=lambda i: chart[i][:2])


def follow(item: Item | None, audit: str, turns: list[dict]) -> list[str]:
    """The repaired turns, as ``role:text``, from an item that is open before them."""
    state, at, out = _reach(set(START) if item is None else {item}), 0, []
    for edit in audit:
        if edit != "D":
            wanted = {_next(i) for i in state}
            role = turns[at]["role"] if edit == "K" else next(name for letter, name in GIVEN.items() if letter in wanted)  # the grammar asks for one of them
            out.append(f"{role}:{'' if edit == 'I' else turns[at]['text']}")
            state = _reach({(k, n + 1) for k, n in state if _next((k, n)) == role[:1]})
        at += edit != "I"
    return out


def _reach(state: set[Item]) -> set[Item]:
    """With the items that completed productions lead to."""
    return set(_closed({i: (0, "") for i in state}, None))


def symbol(role: str, text: str) -> str:
    """What the grammar sees of a turn that may stay; see ``_read``."""
    letter = role[:1] if role[:1] in ("s", "u", "a") else "?"
    if text.rstrip(SPACES).endswith((".", "!", "?")):
        return letter
    return "!" if letter == "?" else letter.upper()


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "distinct")
ENDS = ("low", "high", "first", "last")


class Tally:
    """Counts over turns in order (rows, faults, illegal neighbours, turn numbers), the
    lowest and highest number, and the first letters of the first and the last role."""

    def __init__(self):
        self.n, self.low, self.high, self.first, self.last = dict.fromkeys(COUNTS, 0), None, None, None, None

    def turns(self, turns: list[dict]) -> str:
        """Count turns (turn, role, text, seen: whether an earlier one is equal); their symbols."""
        out = []
        for t in turns:
            made = "-" if not t["text"].rstrip(SPACES) or t["seen"] else symbol(t["role"], t["text"])
            fault = "blank" if not t["text"].rstrip(SPACES) else "duplicate" if t["seen"] else "truncated" if made == "!" or made.isupper() else None
            one = dict.fromkeys(COUNTS, 0) | {"rows": 1, "distinct": int(t["turn"] is not None)}
            if fault:
                one[fault] = 1
            self.add(one, t["turn"], t["turn"], t["role"][:1], t["role"][:1])
            out.append(made)
        return "".join(out)

    def add(self, n: dict[str, int], low: int | None, high: int | None, first: str | None, last: str | None) -> None:
        """Add what follows; numbers ascend."""
        if not n["rows"]:
            return
        self.n["illegal"] += bool(self.n["rows"]) and self.last + first not in ("su", "ua", "au")
        self.n["distinct"] -= low is not None and low == self.high
        self.first = self.first if self.n["rows"] else first
        self.last = last
        self.low, self.high = low if self.low is None else self.low, self.high if high is None else high
        for c in COUNTS:
            self.n[c] += n[c]

    def result(self, conv: object, cost: int, audit: str, sha: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n["distinct"]
        return {"conv": conv, "gaps": gaps, **{c: self.n[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": sha}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("seen", pa.bool_())]))
RESULT_ARROW = [(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (x.split()[0] for x in RESULT.split(", "))]
PLACE_ARROW = [("part", pa.int64()), ("number", pa.int64())]
CHARTS = pa.list_(pa.struct([("from_rule", pa.int32()), ("from_dot", pa.int32()), ("to_rule", pa.int32()), ("to_dot", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
CHARTED = [*((c, pa.int64()) for c in (*COUNTS, "low", "high")), ("first", pa.string()), ("last", pa.string()), ("charts", CHARTS)]


def _repaired(conv: object, turns: list[dict], costs: Costs) -> dict:
    """The result of a conversation that is held as a whole."""
    tally = Tally()
    symbols = tally.turns(turns)
    chart = {i: (c, a) for i, c, a in (_parsed_once if len(symbols) <= 32 else parsed)(symbols, None, costs)}
    cost, audit = chart[ended(chart)]
    return tally.result(conv, cost, audit, _sha("\n".join(follow(None, audit, turns))).hexdigest())


def _sha(text: str):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass"))


def _segmented(costs: Costs, limit: Segments):
    """Results, or segments, of the conversations in a sorted partition (conv, turn,
    role, text, copies).

    A conversation in the middle of a partition that fits a segment is repaired here. Of
    others, whose turns may stand in other partitions too, segments are given, numbered
    within the task, with their turns, ``seen`` of those that repeat an earlier one there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, part, number, inner, cut, turns, chars, seen = none, None, 0, False, False, [], 0, set()
        out: list[dict] = []

        def segment(whole: bool) -> None:
            nonlocal number, cut
            if whole and inner and not cut:
                out.append(_repaired(conv, turns, costs))
            elif turns or not cut:
                out.append({"conv": conv, "part": part, "number": number, "turns": turns})
                number, cut = number + 1, True

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv"), *PLACE_ARROW, *RESULT_ARROW, ("turns", TURNS)])
            for row in batch.to_pylist():
                if conv is none or row["conv"] != conv:
                    if conv is not none:
                        segment(whole=True)
                    inner, cut, conv, part, turns, chars, seen = conv is not none, False, row["conv"], row["part"], [], 0, set()
                elif len(turns) >= limit.rows or chars >= limit.chars:
                    segment(whole=False)
                    turns, chars = [], 0
                for _ in range(row["copies"]):
                    name = _sha(f"{row['role']}\0{row['text']}").digest()
                    turns.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "seen": name in seen})
                    chars += len(row["text"])
                    seen.add(name)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if conv is not none:
            segment(whole=False)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _charted(costs: Costs):
    """Each segment's counts, and its charts from every item that may be open before it."""
    starts = [None, *(i for i in ((k, n) for k, (_, right) in enumerate(GRAMMAR) for n in range(len(right) + 1)) if is_open(i))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*batch.schema, *CHARTED])
            for row in (batch.slice(n, 1).to_pylist()[0] for n in range(batch.num_rows)):
                again = set(row["again"] or ())
                for n in again:
                    row["turns"][n]["seen"] = True
                tally = Tally()
                symbols = tally.turns(row["turns"])
                charts = [{"from_rule": a[0] if a else -1, "from_dot": a[1] if a else -1, "to_rule": k, "to_dot": n, "cost": c, "audit": t} for a in starts for (k, n), c, t in parsed(symbols, a, costs)]
                yield pa.RecordBatch.from_pylist([row | tally.n | {e: getattr(tally, e) for e in ENDS} | {"charts": charts}], schema)

    return run


class Chain:
    """A conversation's segments, one after the other.

    Each open item keeps its cost, the end of its audit (what all of them share is in
    ``shared``), the hash of the repaired text so far, and whether there is any.
    """

    def __init__(self, conv: object):
        self.conv, self.tally, self.shared = conv, Tally(), []
        self.open: dict[Item | None, tuple] = {None: (0, "", hashlib.sha256(), False)}

    def add(self, segment: dict) -> None:
        self.tally.add({c: segment[c] for c in COUNTS}, *(segment[e] for e in ENDS))
        best: dict[Item, tuple] = {}
        for c in segment["charts"]:
            start, to = (c["from_rule"], c["from_dot"]) if c["from_rule"] >= 0 else None, (c["to_rule"], c["to_dot"])
            if start in self.open:
                cost, audit = self.open[start][:2]
                value = (cost + c["cost"], audit + c["audit"])
                if to not in best or value < best[to][:2]:
                    best[to] = (*value, start, c["audit"])
        common = commonprefix([b[1] for b in best.values()])
        self.shared.append(common)
        after = {}
        for to, (cost, audit, start, own) in best.items():
            _, _, sha, some = self.open[start]
            lines = follow(start, own, segment["turns"])
            if lines:
                sha = sha.copy()
                sha.update(("\n" * some + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            after[to] = (cost, audit[len(common) :], sha, some or bool(lines))
        self.open = after

    def result(self) -> dict:
        cost, audit, sha, _ = self.open[ended(self.open)]
        return self.tally.result(self.conv, cost, "".join([*self.shared, audit]), sha.hexdigest())


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations whose segments stand in order."""
    chain, schema = None, None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv"), *RESULT_ARROW])
        for n in range(batch.num_rows):
            row = batch.slice(n, 1).to_pylist()[0]
            if chain is None or row["conv"] != chain.conv:
                if chain:
                    yield pa.RecordBatch.from_pylist([chain.result()], schema)
                chain = Chain(row["conv"])
            chain.add(row)
    if chain:
        yield pa.RecordBatch.from_pylist([chain.result()], schema)


def repaired(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, costs: Costs = Costs(), limit: Segments = Segments()) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    each conversation.

    Turns are taken in order of their numbers, null ones first; equal numbers in order of
    role and text. Null roles and texts are one space. The first fault of each turn
    counts: blank (nothing but white space), duplicate (role and text stood before) or
    truncated (the last character isn't one of ``.!?``). illegal counts neighbours whose
    roles' first letters aren't su, ua or au. Blank and duplicate turns must go. Of the
    cheapest repairs the one with the ASCII-least audit is taken: K keep, R rerole, D
    delete, I insert. ``copies``: how often a row stands there, once if not given; a
    conversation of which no row is left has zeros, an empty audit and the hash of
    nothing. Null conversation ids are one conversation. An empty table gives an empty one.

    Rows are dealt by range of (conversation, number, role, text), so that a very large
    conversation, or a very large number of equal turns, stands in many tasks. What a
    task can't see as a whole is cut into segments, parsed apart, and chained with the
    turns' texts going through a running hash; only its audit is held at once.
    """
    n = F.lit(1) if copies is None else copies
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), n.cast("int").alias("copies"), F.monotonically_increasing_id().alias("id"),
    )
    kind = dict(rows.dtypes)["conv"]
    order = ["conv", "turn", "role", "text", "id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "copies", F.spark_partition_id().cast("long").alias("part"))
    place, listed = "part long, number long", "array<struct<turn long, role string, text string, seen boolean>>"
    made = materialize(placed.mapInArrow(_segmented(costs, limit), f"conv {kind}, {place}, {RESULT}, turns {listed}"), "turns")
    columns = ["conv", *(c for c, _ in RESULT_ARROW)]

    # turns of a segment that repeat one of an earlier segment in another task
    segments = made.where("turns is not null").select("conv", "part", "number", "turns")
    name = F.sha2(F.concat_ws("\0", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull().cast("string"), "t.role", "t.text"), 256)
    each = segments.select("conv", "part", "number", F.posexplode("turns").alias("n", "t")).where("not t.seen").select("part", "number", "n", name.alias("name"))
    first = each.groupBy("name").agg(F.min("part").alias("first"), F.max("part").alias("other")).where("first < other")
    again = each.join(first, "name").where("part > first").groupBy("part", "number").agg(F.collect_list("n").alias("again"))
    charts = "array<struct<from_rule int, from_dot int, to_rule int, to_dot int, cost long, audit string>>"
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "low", "high"))
    parts = segments.join(again, ["part", "number"], "left").select("conv", "part", "number", "turns", "again")
    parts = parts.mapInArrow(_charted(costs), f"conv {kind}, {place}, turns {listed}, again array<int>, {counts}, first string, last string, charts {charts}")
    chained = parts.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_chained, f"conv {kind}, {RESULT}")
    return made.where("turns is null").select(*columns).unionByName(chained.select(*columns)).withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns (conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20, nulls as
    one space, and how often each stands there: 0 drops it, 1 empties its text, 2 takes
    its sentence ends away, 3 repeats it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def _oracle() -> str:
    """Damage, faults, and the charts of the four places that a conversation can be at:
    nothing yet (e), after the system (h), after the user (u), after the assistant (d)."""
    step = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}}"
    said = lambda role: f"chr(10) || {role} || ':' || text"
    insert = lambda s, role: step(s, 5, "I", f"chr(10) || '{role}:'")
    least = lambda *x: f"list_min([{', '.join(x)}])"
    none = "{'c': 1000000, 'a': '', 't': ''}"
    may = lambda condition, value: f"CASE WHEN {condition} THEN {value} ELSE {none} END"
    first, second = "{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}", "{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}"
    cut = "5 * truncated"
    keep = lambda s, letter: may(f"NOT gone AND role[1] = '{letter}'", step(s, cut, "K", said("role")))
    give = lambda s, role: may("NOT gone", step(s, f"1 + {cut}", "R", said(f"'{role}'")))
    drop = lambda s: step(s, 2, "D", "''")
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END)), 4294967295::BIGINT) % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM damaged),
faults AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare = '' OR again AS gone, CAST(bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS INT) AS truncated,
  i > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
charts AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS e, {none} AS h, {first} AS u, {second} AS d FROM conversations
  UNION ALL SELECT conv_id, i, e, h, u2 AS u, {least("d1", insert("u2", "assistant"))} AS d FROM (
    SELECT *, {least("u1", insert("e", "user"), insert("h", "user"), insert("d1", "user"))} AS u2 FROM (
      SELECT f.conv_id, f.i, {drop("e")} AS e, {least(drop("h"), keep("e", "s"))} AS h,
        {least(drop("u"), *(x for s in ("e", "h", "d") for x in (keep(s, "u"), give(s, "user"))))} AS u1, {least(drop("d"), keep("u", "a"), give("u", "assistant"))} AS d1
      FROM charts c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i + 1))),
best AS (SELECT conv_id, arg_max(list_min([e, d]), i) AS x FROM charts GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
  count(*) FILTER (WHERE truncated = 1) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM faults GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(x.c AS BIGINT) AS cost, x.a AS audit, sha256(substr(x.t, 2)) AS repaired_sha256 FROM best b LEFT JOIN counts n ON b.conv_id IS NOT DISTINCT FROM n.conv_id"""


#: What the query gives, in DuckDB's SQL.
ORACLE_SQL = _oracle()
