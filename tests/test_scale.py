"""Operators that pair, sweep and look up, against plain versions and on large groups."""

import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelens.errors import EngineError, translated
from changelens.functions.columns import CHANGES, FILE_DIFFS
from changelens.operators import analyses, grain
from changelens.operators.pairs import pairs_within
from changelens.operators.transforms import filter_paths
from changelens.options import Options
from changelens.plans.cli import help_text, main
from changelens.plans.runner import cells, run


def history(rng, commits, entities, largest):
    rows = []
    for c in range(commits):
        for e in rng.sample(range(entities), min(entities, rng.choice([1, 2, 3, 5, largest]))):
            name = f"e{min(e, rng.randint(0, entities))}"
            for other in (name, f"twin-{name}") if e % 3 == 0 and rng.random() < 0.95 else (name,):
                rows.append((f"r{c}", f"A{rng.randint(0, 5)}", f"2024-01-{c % 28 + 1:02d}", other, 1, 1))
    return rows


def plain_coupling(rows, o):
    sets = {}
    for rev, _, _, e, _, _ in rows:
        sets.setdefault(rev, set()).add(e)
    revs, shared = {}, {}
    for es in sets.values():
        for e in es:
            revs[e] = revs.get(e, 0) + 1
        if 2 <= len(es) <= o.max_changeset_size:
            for p in itertools.combinations(sorted(es), 2):
                shared[p] = shared.get(p, 0) + 1
    out = []
    for (a, b), n in shared.items():
        degree = 100 * n // max(revs[a], revs[b])
        if n >= o.min_shared_revs and min(revs[a], revs[b]) >= o.min_revs and o.min_coupling <= degree <= o.max_coupling:
            out.append((a, b, degree, (revs[a] + revs[b]) // 2))
    return sorted(out)


@pytest.mark.parametrize("size", [30, 200, 10_000])
@pytest.mark.parametrize("least", [1, 30, 60, 100])
def test_coupling_equals_all_pairs(spark, size, least):
    rows = history(random.Random(size + least), 150, 60, 40)
    o = Options(min_revs=2, min_shared_revs=2, min_coupling=least, max_changeset_size=size)
    got = run("coupling", spark.createDataFrame(rows, CHANGES), o).collect()
    assert sorted(map(tuple, got)) == plain_coupling(rows, o)
    assert got or least == 100


def test_coupling_of_a_very_large_changeset(spark):
    rows = [("big", "A", "2024-01-01", f"e{k:05d}", 1, 1) for k in range(3000)] + [(f"r{c}", "A", "2024-01-01", f"e{k:05d}", 1, 1) for c in range(4) for k in range(c, 40)]
    o = Options(min_revs=2, min_shared_revs=2, min_coupling=50, max_changeset_size=10_000)
    assert sorted(map(tuple, run("coupling", spark.createDataFrame(rows, CHANGES), o).collect())) == plain_coupling(rows, o)


def test_any_two_members_of_a_group_meet_once(spark):
    rows = [(g, f"m{m}", g + m) for g in range(3) for m in range(20 * g + 1)]
    df = spark.createDataFrame(rows, "g long, m string, x long")
    want = sorted((g, *sorted((a, b))) for g in range(3) for a, b in itertools.combinations([f"m{m}" for m in range(20 * g + 1)], 2))
    got = pairs_within(df, "g", "m", F.lit(41), block=4).collect()
    assert sorted((r["g"], r["a"], r["b"]) for r in got) == want
    assert all(r["a_x"] == r["g"] + int(r["a"][1:]) and r["b_x"] == r["g"] + int(r["b"][1:]) for r in got)


def test_communication_of_entities_with_the_same_authors(spark):
    rng, rows = random.Random(41), []
    for e in range(120):
        for a in rng.choice([range(5), range(3, 9), rng.sample(range(12), rng.randint(1, 6))]):
            rows += [(f"r{e}.{a}.{k}", f"A{a:02d}", "2024-01-01", f"e{e}", 1, 1) for k in range(2)]
    shared = {}
    for e in range(120):
        for p in itertools.combinations(sorted({r[1] for r in rows if r[3] == f"e{e}"}), 2):
            if len({r[0] for r in rows if r[3] == f"e{e}"}) >= 4:
                shared[p] = shared.get(p, 0) + 1
    got = run("communication", spark.createDataFrame(rows, CHANGES), Options(min_revs=4)).collect()
    assert [tuple(r) for r in got] == sorted(((a, b, n) for (a, b), n in shared.items()), key=lambda x: (-x[2], x[0], x[1]))


def test_summary_multiplies_no_row(spark):
    df = spark.createDataFrame(history(random.Random(42), 20, 9, 4), CHANGES)
    plan = run("summary", df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan


# function grain


def plain_owner(symbols, line):
    best = None
    for first, last, name in symbols:
        if first <= line <= last and (best is None or last - first < best[0]):
            best = (last - first, name)
    return best[1] if best else None


def some_files(rng, n):
    files = []
    for i in range(n):
        sides = []
        for _ in range(2):
            symbols = []
            for _ in range(rng.randint(0, 7)):
                first = rng.randint(1, 30)
                symbols.append((first, first + rng.choice([0, 1, 4, 4, 15, -1]), rng.choice(["f", "g", "h", "k", None])))
            sides.append(symbols)
        hunks = [(rng.choice([0, rng.randint(1, 35)]), rng.randint(0, 6), rng.randint(0, 35), rng.randint(0, 6)) for _ in range(rng.randint(0, 5))]
        files.append((f"r{i}", f"p{i % 7}.rs", *sides, hunks))
    return files


def plain_found(new, old, hunks):
    found = {}
    for k, symbols, ranges in ((0, new, [h[2:] for h in hunks]), (1, old, [h[:2] for h in hunks])):
        for start, count in ranges:
            for line in range(start, start + count) if start > 0 else ():
                name = plain_owner(symbols, line)
                if name is not None:
                    found.setdefault(name, [0, 0])[k] += 1
    return {n: tuple(x) for n, x in found.items()}


def as_rows(spark, files):
    as_structs = lambda symbols: [(n, a, b) for a, b, n in symbols]
    diffs = spark.createDataFrame([(r, p, as_structs(new), as_structs(old), h) for r, p, new, old, h in files], FILE_DIFFS)
    symbols = [(r, p, side, n, a, b, k) for r, p, new, old, _ in files for side, of in (("new", new), ("old", old)) for k, (a, b, n) in enumerate(of)]
    hunks = [(r, p, *h) for r, p, _, _, of in files for h in of]
    return diffs, spark.createDataFrame(symbols, grain.SYMBOLS), spark.createDataFrame(hunks, grain.HUNKS)


def test_both_forms_of_facts_equal_line_by_line(spark):
    files = some_files(random.Random(43), 400)
    diffs, symbols, hunks = as_rows(spark, files)
    want = {(r, p): plain_found(new, old, h) for r, p, new, old, h in files}
    for found, keys in ((grain.touched_symbols(diffs), set(want)), (grain.touched_symbols_of(symbols, hunks), {(r, p) for r, p, _, _, h in files if h})):
        got = {(r["rev"], r["path"]): {x["name"]: (x["added"], x["deleted"]) for x in r["found"]} for r in found.collect()}
        assert got == {k: want[k] for k in keys} and found.count() == len(keys)


def test_fifty_thousand_symbols_of_a_file_take_seconds(spark):
    n = 50_000
    nested = [(k + 1, 2 * n - k, f"s{k}") for k in range(n)]  # each within the one before
    files = [("r", "p.rs", nested, [], [(0, 0, k * 20 + 1, 10) for k in range(4000)])]
    diffs, symbols, hunks = as_rows(spark, files)
    began = time.time()
    one = grain.touched_symbols(diffs).collect()[0]["found"]
    other = grain.touched_symbols_of(symbols, hunks).collect()[0]["found"]
    assert time.time() - began < 60 and sorted(map(tuple, one)) == sorted(map(tuple, other))
    assert sum(x["added"] for x in one) == 40_000 and len(one) == 40_000


def test_ordinals_of_names_that_repeat(spark):
    rows = [("r", "a.rs", "new", "Foo::new", 9, 12, 0), ("r", "a.rs", "new", "Foo::new", 2, 4, 1), ("r", "a.rs", "new", "Foo::new", 2, 3, 2), ("r", "a.rs", "new", "bar", 20, 22, 3), ("r", "a.rs", "old", "Foo::new", 1, 2, 0), ("r", "b.rs", "new", "Foo::new", 1, 2, 0)]
    got = grain.with_ordinals(spark.createDataFrame(rows, grain.SYMBOLS)).collect()
    assert {(r["path"], r["side"], r["start_line"], r["end_line"]): r["name"] for r in got} == {
        ("a.rs", "new", 2, 3): "Foo::new#1", ("a.rs", "new", 2, 4): "Foo::new#2", ("a.rs", "new", 9, 12): "Foo::new#3", ("a.rs", "new", 20, 22): "bar", ("a.rs", "old", 1, 2): "Foo::new", ("b.rs", "new", 1, 2): "Foo::new",
    }


def test_ordinals_are_not_sorted_in_the_few_partitions_of_the_files(spark):
    """Rows made of few files after a shuffle, which fill one partition before and several after."""
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        files = spark.range(400).select((F.col("id") % 200).cast("string").alias("rev"), F.format_string("%d.rs", F.col("id") % 8).alias("path")).distinct()
        rows = files.select("rev", "path", F.lit("new").alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long"))).alias("start_line"))
        rows = rows.select("*", (F.col("start_line") + 1).alias("end_line"), F.lit(0).cast("long").alias("place"), F.when(F.col("start_line") > 2, F.format_string("f%d", F.expr("start_line div 2"))).otherwise(F.col("start_line").cast("string")).alias("name"))
        at = F.spark_partition_id().alias("at")
        assert rows.select(at).distinct().count() == 1
        got = grain.with_ordinals(rows).select("name", at).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    names = [r["name"] for r in got]
    assert len(got) == 40_000 and {x: names.count(x) for x in ("1", "2", "f1#1", "f2#1", "f2#2", "f100#1", "f100")} == {"1": 200, "2": 200, "f1#1": 0, "f2#1": 200, "f2#2": 200, "f100#1": 0, "f100": 200}
    assert len({r["at"] for r in got}) > 1


def test_of_several_facts_for_a_change_the_least_result_counts(spark):
    diffs = spark.createDataFrame([("r", "a.rs", [(n, 1, 9)], [], [(0, 0, 2, 3)]) for n in ("later", "early", "later")], FILE_DIFFS)
    changes = spark.createDataFrame([("r", "A", "2024-01-01", "a.rs", 1, 0)] * 2, CHANGES)
    for _ in range(2):
        found, dropped = grain.to_functions(changes, diffs.repartition(3))
        assert [(r["entity"], r["added"]) for r in found.collect()] == [("a.rs::early", 3)] * 2 and dropped == {"non_rust": 0, "no_overlap": 0}


# prefixes, and what callers add


def test_long_lists_of_prefixes(spark):
    rng = random.Random(44)
    paths = ["/".join(rng.choice(["a", "b", "c1", "x.rs"]) for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["", "/a", "a//b"]
    df = spark.createDataFrame([("1", "A", "2024-01-01", p, 1, 0) for p in paths], CHANGES)
    known = tuple({"/".join(rng.choice(["a", "b", "c1"]) for _ in range(rng.randint(1, 3))) for _ in range(20)})
    filler = tuple(f"none/{i}" for i in range(10_000))
    began = time.time()
    for more in ({"include": known}, {"exclude": (*known, "")}):
        short, long = (sorted(r["entity"] for r in filter_paths(df, **{k: v + x for k, v in more.items()}).collect()) for x in ((), filler))
        assert short == long and 0 < len(short) < len(paths)
    assert time.time() - began < 60


def test_analyses_and_resolvers_of_the_callers(spark, tmp_path, capsys):
    @analyses.analysis("paths")
    def paths(changes, options):
        return changes.select("entity").distinct(), [F.desc("entity")]

    def whole_files(changes, repo):
        line = F.lit(1).cast("long")
        symbol = F.array(F.struct(F.lit(repo).alias("name"), line.alias("start_line"), F.lit(99).cast("long").alias("end_line")))
        hunk = F.array(F.struct(*(line.alias(c) for c in ("old_start", "old_count", "new_start", "new_count"))))
        return changes.select("rev", F.col("entity").alias("path"), symbol.alias("symbols_new"), symbol.alias("symbols_old"), hunk.alias("hunks"))

    grain.register_resolver("whole", whole_files)
    try:
        assert "paths" in help_text() and "whole" in help_text()
        log = tmp_path / "log"
        log.write_text("--r--2024-01-01--A\n3\t1\ta.rs\n1\t1\tb.rs\n")
        argv = ["-l", str(log), "-c", "git2", "-a", "paths", "--grain", "function", "--repo", "all", "--format", "json"]
        assert main([*argv, "--resolver", "whole"], spark) == 0
        assert capsys.readouterr().out == '[\n  {"entity": "b.rs::all"},\n  {"entity": "a.rs::all"}\n]\n'
        assert main([*argv, "--resolver", "none"], spark) == 1 and "unknown resolver `none`" in capsys.readouterr().err
        with pytest.raises(EngineError, match="there already"):
            analyses.analysis("paths")(paths)
        with pytest.raises(EngineError, match="there already"):
            grain.register_resolver("whole", whole_files)
    finally:
        del analyses.ANALYSES["paths"], grain.RESOLVERS["whole"]


def test_an_error_comes_before_any_output(spark, tmp_path, capsys):
    from changelens.plans.sinks import rendered

    df = spark.createDataFrame([("1", "A", "2024-01-01", "x", None, 1)], CHANGES)
    with pytest.raises(EngineError, match="line counts"):
        rendered(run("abs-churn", df), "json")
    with pytest.raises(ZeroDivisionError), translated():
        1 / 0
    assert cells(run("revisions", df, Options(min_revs=1))).count() == 1


def test_rows_of_facts_where_partitions_are_coalesced_by_size(spark):
    """Symbols and hunks come dealt by (rev, path) already, and not coalesced alike."""
    files = some_files(random.Random(47), 300)
    _, symbols, hunks = as_rows(spark, files)
    want = {(r, p): plain_found(new, old, h) for r, p, new, old, h in files if h}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        own = hunks.groupBy("rev", "path").agg(F.collect_list(F.struct("old_start", "old_count", "new_start", "new_count")).alias("x")).select("rev", "path", F.inline("x"))
        found = grain.touched_symbols_of(symbols, own).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    got = {(r["rev"], r["path"]): {x["name"]: (x["added"], x["deleted"]) for x in r["found"]} for r in found}
    assert got == want and len(found) == len(want)


def test_small_files_of_a_batch_are_compared_at_once(monkeypatch):
    def never():
        raise AssertionError("a small file was swept line by line")

    monkeypatch.setattr(grain, "Sweep", never)
    symbol = [{"name": "f", "start_line": 1, "end_line": 9}, {"name": "g", "start_line": 3, "end_line": 4}]
    hunk = [{"old_start": 0, "old_count": 0, "new_start": 2, "new_count": 3}]
    batch = pa.RecordBatch.from_pydict({"rev": ["r", "s"], "path": ["a.rs", "b.rs"], "symbols_new": [symbol, None], "symbols_old": [[], symbol], "hunks": [hunk, hunk]})
    assert [x.to_pylist() for x in grain._touched(iter([batch]))][0][0]["found"] == [{"name": "f", "added": 1, "deleted": 0}, {"name": "g", "added": 2, "deleted": 0}]


def test_pairs_are_counted_by_numbers(spark):
    rows = [(f"r{k}", "A", "2024-01-01", e, 1, 0) for k in range(6) for e in ("z.rs", "a.rs", *(["m.rs"] if k < 5 else []))]
    df, _ = analyses.coupling(spark.createDataFrame(rows, CHANGES), Options(min_coupling=1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan
    assert {tuple(r) for r in df.collect()} == {("a.rs", "z.rs", 100, 6), ("a.rs", "m.rs", 83, 5), ("m.rs", "z.rs", 83, 5)}


def test_facts_are_dealt_in_few_rows_and_sorted_in_memory(spark, monkeypatch):
    files = 3000
    hunks = spark.range(files).selectExpr("cast(id as string) rev", "'src/a.rs' path", "explode(array(1L, 5L)) old_start", "1L old_count", "3L new_start", "2L new_count")
    symbols = spark.range(files + 50).selectExpr("cast(id as string) rev", "'src/a.rs' path", "'new' side", "explode(array('f', 'g', 'h')) name", "2L start_line", "9L end_line", "0L place")
    monkeypatch.setattr(grain, "SORTED_ROWS", 4000)
    monkeypatch.setattr(grain, "TASKS", 2)
    frame, rows = type(hunks), []
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: rows.append((self.count(), n)) or dealt(self, n, *c))
    found = {r["rev"]: r["found"] for r in grain.touched_symbols_of(symbols, hunks).collect()}
    assert {int(r) for r in found} == set(range(files)) and all([tuple(x) for x in f] == [("f", 4, 0)] for f in found.values())
    # 21,000 rows come in two a file, or three where a batch ends, to six tasks in three turns
    assert len(rows) == 3 and all(n == 2 for _, n in rows) and sum(k for k, _ in rows) < 2 * files + 200
