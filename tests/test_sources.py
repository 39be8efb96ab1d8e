"""Logs, layer maps, filters, function grain, text and JSON, the command line."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.errors import EngineError
from changelens.functions.columns import CHANGES, FILE_DIFFS, hunks
from changelens.operators.grain import to_functions
from changelens.operators.transforms import filter_paths, map_layers
from changelens.plans.cli import main, parse_args
from changelens.plans.sinks import json_lines, text_lines
from changelens.sources.layers import read_rules
from changelens.sources.log import faults, read_log, register_format, write_log


def parse(spark, tmp_path, text, vcs="git2", **more):
    path = tmp_path / "x.log"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return [tuple(r)[1:] for r in read_log(spark, str(path), vcs, **more).orderBy("pos").collect()]


def test_git2(spark, tmp_path):
    log = "--a--2024-01-01--Ada\n\n1\t2\tsrc/x\ty.rs \r\n-\t-\tbin\n--b--2024-1-2--Ada -- B\n3\t0\tz\n"
    assert parse(spark, tmp_path, log) == [("a", "Ada", "2024-01-01", "src/x\ty.rs", 1, 2), ("a", "Ada", "2024-01-01", "bin", 0, 0), ("b", "Ada -- B", "2024-1-2", "z", 3, 0)]
    assert parse(spark, tmp_path, "") == parse(spark, tmp_path, "\n\n") == parse(spark, tmp_path, "--a--2024-01-01--A\n") == []


H = "--a--2024-01-01--A\n"


@pytest.mark.parametrize("text", ["--onlyrev", "--rev----author", "----2024-01-01--Ada", "--abc--2024-01-01--", "--abc--x--Ada", "--", "1\t2\tx\n" + H, " \n" + H, H + "x\t1\ty", H + "1\t2", H + "1\t2\ta => b", H + "1\t2\tx\n----2024-01-01--Ada", H + "1\t-2\tx"])
def test_git2_errors(spark, tmp_path, text):
    with pytest.raises(EngineError):
        parse(spark, tmp_path, text)


def test_first_error_row_cap_and_encoding(spark, tmp_path):
    with pytest.raises(EngineError, match="missing deleted"):
        parse(spark, tmp_path, H + "1\n1\t2\tx => y => z\n")
    with pytest.raises(EngineError, match="exceeds 1 "):
        parse(spark, tmp_path, H + "1\t1\tx\n1\t1\ty\n", max_rows=1)
    with pytest.raises(EngineError, match="UTF-8"):
        parse(spark, tmp_path, H.encode() + b"1\t1\t\xff\n")
    with pytest.raises(EngineError, match="unknown vcs"):
        read_log(spark, "x", "svn")
    with pytest.raises(EngineError, match="cannot open log"):
        read_log(spark, str(tmp_path / "none"), "git")


def test_a_log_of_many_files_and_splits(spark, tmp_path):
    """Cut anywhere, also within a commit; files in few partitions, and many splits of a file."""
    rng, lines, right = random.Random(40), [], []
    for c in range(100):
        lines.append(f"--r{c}--2024-01-{c % 28 + 1:02d}--A{c % 7}")
        for k in range(rng.choice([0, 1, 3, 40])):
            lines.append(rng.choice([f"{k}\t1\tsrc/{c}.rs", "", f"-\t2\tdocs/{k}"]))
            if lines[-1]:
                a, d, e = lines[-1].split("\t")
                right.append((f"r{c}", f"A{c % 7}", f"2024-01-{c % 28 + 1:02d}", e, 0 if a == "-" else int(a), int(d)))
    for n in (1, 40):
        folder, cuts = tmp_path / f"log{n}", sorted(rng.sample(range(1, len(lines)), n - 1))
        folder.mkdir()
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True)):
            (folder / f"part-{i:05d}").write_text("\n".join(lines[a:b]) + "\n")
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                assert [tuple(r)[1:] for r in read_log(spark, str(folder), "git2").orderBy("pos").collect()] == right
                (folder / "part-00000").write_text("1\t1\tx\n" + "\n".join(lines[: cuts[0] if cuts else None]) + "\n")
                with pytest.raises(EngineError, match="before header: 1"):
                    read_log(spark, str(folder), "git2")
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                (folder / "part-00000").write_text("\n".join(lines[: cuts[0] if cuts else None]) + "\n")


def test_first_error_of_all_files(spark, tmp_path):
    for i, text in enumerate(["--a--2024-01-01--A\n1\t1\tx\n", "2\t2\ty\nbad\n", "--onlyrev\n"]):
        (tmp_path / f"{i}").write_text(text)
    with pytest.raises(EngineError, match="missing deleted"):
        read_log(spark, str(tmp_path), "git2")
    assert [r["error"] for r in faults(spark, str(tmp_path), "git2").orderBy("pos").collect()] == ["numstat line missing deleted count", "git2 header missing date"]
    (tmp_path / "1").write_text("2\t2\ty\n")
    with pytest.raises(EngineError, match="missing date"):
        read_log(spark, str(tmp_path), "git2")
    (tmp_path / "2").write_text("3\t3\tz\n")
    assert read_log(spark, str(tmp_path), "git2", max_rows=3).where("rev = 'a'").count() == 3
    with pytest.raises(EngineError, match="exceeds 2 "):
        read_log(spark, str(tmp_path), "git2", max_rows=2)


def test_a_format_of_the_callers(spark, tmp_path):
    def header(line):
        part = F.split(line, ";")
        return {"rev": F.substring(F.get(part, 0), 2, 99), "author": F.get(part, 1), "date": F.get(part, 2), "bad": F.when(F.size(part) < 3, F.lit("short header"))}

    register_format("semicolons", lambda line: line.startswith("#"), header)
    assert parse(spark, tmp_path, "#a;Ada;2024-01-01\n1\t2\tx\n", "semicolons") == [("a", "Ada", "2024-01-01", "x", 1, 2)]
    with pytest.raises(EngineError, match="short header"):
        parse(spark, tmp_path, "#a;Ada;2024-01-01\n1\t2\tx\n#b", "semicolons")
    with pytest.raises(EngineError, match="there already"):
        register_format("git2", lambda line: line, header)


@pytest.mark.parametrize("line, author, date", [
    ("[abc] Ada Lovelace 2024-01-02 fix bug", "Ada Lovelace", "2024-01-02"),
    ("[abc] Ada 2024-01-01 Fan <2024-01-02> subject here", "Ada 2024-01-01 Fan", "2024-01-02"),
    ("[abc] Ada Lovelace 2024-01-02 fixed 2023-12-01 regression", "Ada Lovelace", "2024-01-02"),
    ("[abc] Ada <not-a-date> 2024-01-02 subject", "Ada <not-a-date>", "2024-01-02"),
    ("[abc] Ada<2024-01-01>Fan 2024-01-02 subject", "Ada<2024-01-01>Fan", "2024-01-02"),
])
def test_legacy(spark, tmp_path, line, author, date):
    assert parse(spark, tmp_path, line + "\n1\t1\tx\n", "git") == [("abc", author, date, "x", 1, 1)]


@pytest.mark.parametrize("line", ["[abc] subject without date", "[abc]Ada2024-01-01 no-space", "[abc] short", "[abc] Ada 2024-13-40 s", "[rev missing date", "[] Ada 2024-01-01 x", "[abc] 2024-01-01 subject", "[abc missing close", "[r] A <x> B <2024-01-02> s"])
def test_legacy_errors(spark, tmp_path, line):
    with pytest.raises(EngineError):
        parse(spark, tmp_path, line + "\n", "git")


def paths(df):
    return sorted(r["entity"] for r in df.collect())


def changes(spark, *entities):
    return spark.createDataFrame([("1", "A", "2024-01-01", e, 1, 0) for e in entities], CHANGES)


def test_filters(spark):
    df = changes(spark, "src", "src/a.rs", "src2/a.rs", "docs/a.md", "vendor/x")
    assert paths(filter_paths(df, include=("src/",))) == ["src", "src/a.rs"]
    assert paths(filter_paths(df, exclude=("vendor", "", "  /"))) == ["docs/a.md", "src", "src/a.rs", "src2/a.rs"]
    assert paths(filter_paths(df, include=("src",), exclude=("src/a.rs",))) == ["src"]
    for bad in ("", "   ", "/", "  /  "):
        with pytest.raises(EngineError, match="non-empty"):
            filter_paths(df, include=(bad,))


def test_layers(spark):
    df = changes(spark, "src/api/x.rs", "src", "lib/y", "z")
    assert read_rules("a\u2028b => X\r\n") == [("a\u2028b", "X")]
    rules = read_rules("# comment\n\nsrc/ => A\nsrc/api => B\nlib=>L => M\n")
    assert rules == [("src", "A"), ("src/api", "B"), ("lib", "L => M")]
    assert paths(map_layers(df, rules)) == ["A", "A", "L => M", "z"]
    many = rules + [(f"none{i}", "N") for i in range(200)]
    assert paths(map_layers(df, many)) == ["A", "A", "L => M", "z"]
    for bad in ("not-a-rule", " => ", "src =>"):
        with pytest.raises(EngineError):
            read_rules(bad)


def expand(spark, new, old, hunk, entity="a.rs"):
    diffs = spark.createDataFrame([("1", "a.rs", new, old, hunk)], FILE_DIFFS)
    df, dropped = to_functions(changes(spark, entity), diffs)
    return sorted((r["entity"], r["added"], r["deleted"]) for r in df.collect()), dropped


@pytest.mark.parametrize("new, old, hunk, expected", [
    ([("foo", 1, 10), ("bar", 11, 20)], [], [(0, 0, 2, 2)], [("a.rs::foo", 2, 0)]),
    ([("inner", 5, 8), ("outer", 1, 20)], [], [(0, 0, 6, 1)], [("a.rs::inner", 1, 0)]),
    ([("foo", 1, 5)], [], [(0, 0, 40, 1)], []),
    ([("foo", 1, 10)], [], [], []),
    ([("foo", 1, 10)], [("foo", 1, 10), ("bar", 11, 20)], [(12, 2, 0, 0)], [("a.rs::bar", 0, 2)]),
    ([("foo", 1, 10)], [], [(1, 2, 0, 0)], []),
    ([("first", 1, 4), ("second", 1, 4)], [], [(0, 0, 2, 1)], [("a.rs::first", 1, 0)]),
    ([("out", 1, 20), ("in", 5, 8), ("low", 18, 30)], [("out", 3, 4)], [(2, 4, 4, 6), (0, 0, 18, 10)], [("a.rs::in", 4, 0), ("a.rs::low", 10, 0), ("a.rs::out", 2, 2)]),
])
def test_function_grain(spark, new, old, hunk, expected):
    found, dropped = expand(spark, new, old, hunk)
    assert found == expected
    assert dropped == {"non_rust": 0, "no_overlap": int(not expected)}


def test_function_grain_other_paths(spark):
    assert expand(spark, [], [], [], "readme.md") == ([], {"non_rust": 1, "no_overlap": 0})
    with pytest.raises(EngineError, match="missing symbol diff"):
        expand(spark, [], [], [], "other.RS")


def test_hunk_headers(spark):
    diff = "@@ -10,0 +12,3 @@ fn foo\n+@@ -1 +1 @@\n@@@ -1 +1 @@@\n@@ -5 +7 @@\n"
    row = spark.createDataFrame([(diff,)], "d string").select(hunks("d").alias("h")).first()
    assert [tuple(x) for x in row["h"]] == [(10, 0, 12, 3), (5, 1, 7, 1)]


def as_json(headers, rows):
    return "".join(json_lines(headers, rows))


def as_text(headers, rows):
    return "".join(text_lines(headers, rows, [max((len(r[i]) for r in rows), default=0) for i in range(len(headers))]))


def test_text_and_json():
    assert as_json(["a"], []) == "[\n]\n"
    assert as_json(["a", "b"], [["\\\t\n\r\x01\x7f\"", "é"], ["x", "y"]]) == '[\n  {"a": "\\\\\\t\\n\\r\\u0001\\u007f\\"", "b": "é"},\n  {"a": "x", "b": "y"}\n]\n'
    assert as_text(["entity", "n"], []) == "  ENTITY  N\n\n0 rows.\n"
    assert as_text(["e", "n-revs"], [["long.rs", "3"]]) == "  E        N-REVS\n  long.rs       3\n\n1 rows.\n"


MINI = "--aaa111--2024-01-01--Ada\n2\t0\tsrc/a.rs\n--bbb222--2024-01-02--Bea\n1\t1\tsrc/a.rs\n--ccc333--2024-01-03--Ada\n3\t0\tsrc/a.rs\n"


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "mini.log"
    log.write_text(MINI)
    assert main(["-l", str(log), "-c", "git2", "-a", "risk", "-n", "1", "--format", "json"], spark) == 0
    assert capsys.readouterr().out == '[\n  {"entity": "src/a.rs", "risk": "80.00", "revs": "3", "churn": "7", "soc": "0", "fragmentation": "44.44"}\n]\n'
    assert main(["-l", str(tmp_path / "none"), "-c", "git2"], spark) == 1
    assert "error: cannot open log" in capsys.readouterr().err
    assert main(["-l", "--help"], spark) == 0
    assert main(["-l", str(log), "-c", "git2", "-a", "revisions", "-n", "1"], spark) == 0
    assert capsys.readouterr().out.endswith("  ENTITY    N-REVS\n  src/a.rs       3\n\n1 rows.\n")
    assert main(["-l", str(log), "-c", "git2", "--max-rows", "2"], spark) == 1
    assert main(["-l", str(log), "-c", "git2", "--max-rows", "0"], spark) == 0
    for more, message in ((["-g", "none"], "cannot read layer map: none"), (["--grain", "function", "--repo", "none"], "cannot read table of file diffs: none")):
        assert main(["-l", str(log), "-c", "git2", *more], spark) == 1
        assert f"error: {message}" in capsys.readouterr().err


@pytest.mark.parametrize("vcs", ["git2", "git"])
def test_logs_round_trip(spark, tmp_path, vcs):
    rows = [(str(r), f"A B{r % 3}", "2024-01-02", f"src/x{e}.rs", r, e) for r in range(40) for e in range(r % 5 + 1)]
    write_log(spark.createDataFrame(rows, CHANGES).repartition(3, "rev"), str(tmp_path / "log"), vcs)
    assert sorted(tuple(r)[1:] for r in read_log(spark, str(tmp_path / "log"), vcs).collect()) == sorted(rows)


@pytest.mark.parametrize("argv", ["--what", "-l a -c git -c git2", "-l a --vcs git -c git", "-l a -c git -t week", "-l a -c git -s 201", "-l a -c git -i 80 -x 20", "-l a -c git -d 2024-13-40", "-l a -c git --format csv", "-l a -c git --grain layer", "-l a -c git --grain function", "-l a -c svn", "-c git", "-l a", "-l", "-l a -c git -n x", "-l a -c git -n -1", "-l a -c git --include /", "-l a -c git -a none", "-l=a -c git"])
def test_command_line_errors(argv):
    with pytest.raises(EngineError):
        parse_args(argv.split())


def test_command_line_values():
    args = parse_args("-l -c -c git -r 3 --include a --include b --exclude c -t day -d 2024-1-2".split())
    assert (args.log, args.vcs, args.options.rows, args.options.include, args.options.exclude) == ("-c", "git", 3, ("a", "b"), ("c",))


@pytest.mark.parametrize("vcs", ["git", "git2"])
def test_changes_are_computed_once_for_a_log(spark, tmp_path, vcs):
    seen = str(tmp_path / "seen")

    def counted(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    rows = [(f"r{k // 3}", "A B", "2024-01-01", f"p{k}.rs", k, 1) for k in range(60)]
    changes = spark.createDataFrame(rows, CHANGES)
    write_log(changes.mapInArrow(counted, changes.schema), str(tmp_path / "log"), vcs, 3)
    with open(seen) as f:
        assert len(f.read()) == len(rows)
    assert sorted(tuple(r) for r in read_log(spark, str(tmp_path / "log"), vcs).drop("pos").collect()) == sorted(rows)
