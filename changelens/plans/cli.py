"""The command line."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from changelens.errors import EngineError
from changelens.operators.grain import RESOLVERS
from changelens.operators.transforms import ensure_include
from changelens.options import MAX_CHANGE_ROWS, MAX_CHANGESET_SIZE_LIMIT, Options, is_date
from changelens.plans.runner import analysis_names, named_path, prepared, run
from changelens.plans.sinks import rendered
from changelens.sources.log import FORMATS, read_log
from changelens.sources.shared import WRITTEN, release

#: Names of each flag, the option it sets, and what it stands for in the help text.
FLAGS: tuple[tuple[tuple[str, ...], str, str], ...] = (
    (("-l", "--log"), "log", "PATH  commit log (required)"),
    (("-c", "--vcs"), "vcs", "NAME  format of the log (required)"),
    (("-a", "--analysis"), "analysis", "NAME  analysis to run (default: risk)"),
    (("-r", "--rows"), "rows", "N  rows to show at most"),
    (("--max-rows",), "max_rows", "N  change rows that a log may have (default: 1000000; 0: no limit)"),
    (("-n", "--min-revs"), "min_revs", "N  commits that an entity needs (default: 5)"),
    (("-m", "--min-shared-revs"), "min_shared_revs", "N  shared commits that a pair needs (default: 5)"),
    (("-i", "--min-coupling"), "min_coupling", "N  least degree of coupling, in percent (default: 30)"),
    (("-x", "--max-coupling"), "max_coupling", "N  greatest degree of coupling (default: 100)"),
    (("-s", "--max-changeset-size"), "max_changeset_size", "N  entities of a commit that counts for coupling (default: 30, at most 200)"),
    (("-d", "--age-time-now"), "age_time_now", "YYYY-MM-DD  day that ages are counted to"),
    (("-t", "--temporal-period"), "temporal_period", "day  an author's commits of a day are one (coupling, soc, risk)"),
    (("-g", "--group"), "group_file", "FILE  layer map, lines `prefix => layer`, first match wins"),
    (("--exclude",), "exclude", "PREFIX  leave out paths below (repeatable)"),
    (("--include",), "include", "PREFIX  keep only paths below (repeatable)"),
    (("--format",), "format", "text|json  form of the result (default: text)"),
    (("--grain",), "grain", "file|function  what an entity is (default: file)"),
    (("--repo",), "repo", "PATH  where the resolver finds file diffs, for function grain"),
    (("--resolver",), "resolver", "NAME  how file diffs are found (default: table)"),
)
INTEGERS = {"rows", "max_rows", "min_revs", "min_shared_revs", "min_coupling", "max_coupling", "max_changeset_size"}
BY_NAME = {name: option for names, option, _ in FLAGS for name in names}


@dataclass(frozen=True)
class Args:
    log: str = ""
    vcs: str = ""
    format: str = "text"
    max_rows: int = MAX_CHANGE_ROWS
    help: bool = False
    options: Options = Options()


def help_text() -> str:
    lines = ["changelens: maintenance metrics from commit logs", "", "Options:"]
    lines += [f"  {', '.join(names)} {what}" for names, _, what in FLAGS]
    lists = (("Analyses", analysis_names()), ("Formats", FORMATS), ("Resolvers", RESOLVERS))
    return "\n".join([*lines, "  -h, --help  this text", *(line for what, names in lists for line in ("", f"{what}:", "  " + ", ".join(sorted(names))))])


def parse_args(argv: list[str]) -> Args:
    """Arguments after the program's name; the first that is wrong is an error.

    -h or --help anywhere wins. A flag's value is the next argument, whatever it is.
    """
    if {"-h", "--help"} & set(argv):
        return Args(help=True)
    given: dict[str, object] = {"include": (), "exclude": ()}
    words = iter(argv)
    for flag in words:
        option = BY_NAME.get(flag)
        if option is None:
            raise EngineError(f"unknown argument `{flag}`")
        many = option in ("include", "exclude")
        if option in given and not many:
            raise EngineError(f"duplicate `{flag}`")
        value = next(words, None)
        if value is None:
            raise EngineError(f"missing value for `{flag}`")
        given[option] = (*given[option], value) if many else _value(option, flag, value)
    args = Args(log=given.pop("log", ""), vcs=given.pop("vcs", ""), format=given.pop("format", "text"), max_rows=given.pop("max_rows", MAX_CHANGE_ROWS), options=Options(**given))
    for check in CHECKS:
        check(args)
    return args


def _value(option: str, flag: str, raw: str) -> object:
    if option in INTEGERS:
        digits = raw.removeprefix("+")
        if not (digits.isascii() and digits.isdigit()) or int(digits) >= 1 << 64:
            raise EngineError(f"invalid integer for `{flag}`: {raw}")
        return int(digits)
    allowed = {"temporal_period": ("temporal period", ("day",)), "format": ("format", ("text", "json")), "grain": ("grain", ("file", "function"))}.get(option)
    if allowed and raw not in allowed[1]:
        raise EngineError(f"invalid {allowed[0]} `{raw}`; expected {' or '.join(f'`{x}`' for x in allowed[1])}")
    return raw


def _check(wrong: Callable[[Args], bool], message: Callable[[Args], str]) -> Callable[[Args], None]:
    def check(args: Args) -> None:
        if wrong(args):
            raise EngineError(message(args))

    return check


#: In this order, so that the first fault found is always the same.
CHECKS: tuple[Callable[[Args], object], ...] = (
    _check(lambda a: not a.log, lambda a: "missing required `-l/--log`"),
    _check(lambda a: not a.vcs, lambda a: "missing required `-c/--vcs`"),
    _check(lambda a: a.vcs not in FORMATS, lambda a: f"unknown vcs `{a.vcs}`; expected one of: {', '.join(sorted(FORMATS))}"),
    _check(lambda a: a.options.grain == "function" and a.options.repo is None, lambda a: "`--grain function` requires `--repo <path>`"),
    _check(lambda a: a.options.resolver not in RESOLVERS, lambda a: f"unknown resolver `{a.options.resolver}`; expected one of: {', '.join(sorted(RESOLVERS))}"),
    _check(lambda a: a.options.analysis not in analysis_names(), lambda a: f"unknown analysis `{a.options.analysis}`; expected one of: {', '.join(analysis_names())}"),
    _check(lambda a: a.options.min_coupling > a.options.max_coupling, lambda a: "`--min-coupling` must be less than or equal to `--max-coupling`"),
    _check(lambda a: a.options.max_changeset_size > MAX_CHANGESET_SIZE_LIMIT, lambda a: f"`--max-changeset-size` must be at most {MAX_CHANGESET_SIZE_LIMIT}"),
    _check(lambda a: a.options.age_time_now is not None and not is_date(a.options.age_time_now), lambda a: f"invalid `--age-time-now` `{a.options.age_time_now}`; expected `YYYY-MM-DD`"),
    lambda a: ensure_include(a.options.include),
)


def execute(spark: SparkSession, args: Args) -> tuple[Iterator[str], dict[str, int]]:
    """The parts of the rendered result, and what function grain dropped."""
    changes = read_log(spark, args.log, args.vcs, args.max_rows or None)
    diffs = None
    if args.options.grain == "function":
        with named_path("table of file diffs", args.options.repo):
            diffs = RESOLVERS[args.options.resolver](changes, args.options.repo)
    changes, dropped = prepared(changes, args.options, diffs)
    return rendered(run(args.options.analysis, changes, replace(args.options, include=(), exclude=())), args.format), dropped


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Print the result, or a message to standard error; the exit code. Tables that the
    run has written to the shared folder are removed at its end."""
    before = len(WRITTEN)
    try:
        args = parse_args(sys.argv[1:] if argv is None else argv)
        if args.help:
            print(help_text())
            return 0
        spark = spark or SparkSession.builder.appName("changelens").getOrCreate()
        text, dropped = execute(spark, args)
        if dropped["non_rust"]:
            print(f"note: dropped {dropped['non_rust']} non-Rust path(s) under --grain function", file=sys.stderr)
        if dropped["no_overlap"]:
            print(f"note: dropped {dropped['no_overlap']} path(s) with no function/method overlap under --grain function", file=sys.stderr)
        sys.stdout.writelines(text)
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if spark and len(WRITTEN) > before:
            release(spark, WRITTEN[before:])
