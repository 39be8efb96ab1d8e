"""The registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators.grain import to_functions, touched_symbols_of, with_ordinals
from changelens.operators.transforms import filter_paths, map_layers
from changelens.options import Options
from changelens.plans.runner import cells, run
from changelens.plans.sinks import rendered
from changelens.sources.log import faults, log_lines, read_log, write_lines, write_log
from changelens.sources.shared import held, release, shared_path, written
from changelens.sources.tables import events_as_commits, orders_as_commits

ORDERS = """SELECT CAST(l_orderkey AS VARCHAR) AS rev, n_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS date,
  lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '/p' || CAST(p_partkey % 40 AS VARCHAR) || '.rs' AS entity,
  CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
EVENTS = """SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%dT%H') AS rev, 'u' || CAST(user_id % 23 AS VARCHAR) AS author, strftime(ts, '%Y-%m-%d') AS date,
  event_type || '/k' || CAST(CAST(json_extract(props, '$.k') AS INT) % 20 AS VARCHAR) || '.rs' AS entity, CAST(floor(value) AS BIGINT) AS added, CAST(1 AS BIGINT) AS deleted FROM events"""
#: A layer map: types are layers, one brand has its own, and the rest stays.
LAYERS = [("standard/brand_1", "special"), ("standard", "standard"), ("promo", "promo"), ("economy", "economy"), ("small", "small")]


def _sql(source: str, body: str, o: Options) -> str:
    """The analysis in SQL over the changes, with the measures it shares with others."""
    lrev = "'day:' || date || ':' || author" if o.temporal_period == "day" else "rev"
    return f"""WITH changes AS ({source}),
r AS (SELECT entity, count(DISTINCT rev) AS n FROM changes GROUP BY 1), often AS (SELECT entity FROM r WHERE n >= {o.min_revs}),
pairs AS (SELECT DISTINCT {lrev} AS lrev, entity FROM changes), sizes AS (SELECT lrev, count(*) AS size FROM pairs GROUP BY 1),
m AS (SELECT * FROM pairs JOIN sizes USING (lrev)), l AS (SELECT entity, count(*) AS n FROM m GROUP BY 1),
socs AS (SELECT entity, CAST(sum(size - 1) AS BIGINT) AS soc FROM m WHERE size <= {o.max_changeset_size} GROUP BY 1),
ra AS (SELECT entity, author, count(DISTINCT rev) AS n FROM changes GROUP BY 1, 2), la AS (SELECT entity, author, count(DISTINCT {lrev}) AS n FROM changes GROUP BY 1, 2),
churns AS (SELECT entity, author, sum(added) AS a, sum(deleted) AS d FROM changes GROUP BY 1, 2)
{body}"""


def _frag_sql(own: str, total: str) -> str:
    """Squares of shares added in order of author."""
    return f"""SELECT entity, (1.0::DOUBLE - list_reduce(list_prepend(0.0::DOUBLE, list(s * s ORDER BY author)), lambda a, b: a + b)) * 100.0::DOUBLE AS f
  FROM (SELECT x.entity, author, CAST(x.n * 100.0::DOUBLE AS DOUBLE) / t.n / 100.0::DOUBLE AS s FROM {own} x JOIN {total} t USING (entity)) GROUP BY entity"""


def _pct(x: str) -> str:
    return f"printf('%.2f', {x})"


def _body(name: str, o: Options, pct: Callable[[str], str] = _pct) -> str:
    n = o.min_revs
    big = lambda x: f"CAST({x} AS BIGINT)"
    return {
        "summary": "SELECT 'number-of-commits' AS statistic, count(DISTINCT rev) AS value FROM changes UNION ALL SELECT 'number-of-entities', count(DISTINCT entity) FROM changes UNION ALL SELECT 'number-of-change-rows', count(*) FROM changes UNION ALL SELECT 'number-of-authors', count(DISTINCT author) FROM changes",
        "authors": f"SELECT entity, count(DISTINCT author) AS n_authors, count(DISTINCT rev) AS n_revs FROM changes GROUP BY 1 HAVING count(DISTINCT rev) >= {n}",
        "revisions": f"SELECT entity, n AS n_revs FROM r WHERE n >= {n}",
        "revision-churn": f"SELECT entity, any_value(n) AS n_revs, {big('sum(added + deleted)')} AS churn FROM changes JOIN r USING (entity) WHERE n >= {n} GROUP BY 1",
        "risk": f""", f AS ({_frag_sql("la", "l")}), c AS (SELECT entity, {big("sum(a + d)")} AS churn FROM churns GROUP BY 1),
g AS (SELECT l.entity, l.n AS revs, churn, coalesce(soc, 0) AS soc, f FROM l JOIN f USING (entity) JOIN c USING (entity) LEFT JOIN socs USING (entity) WHERE l.n >= {n}),
t AS (SELECT max(revs) AS mr, max(churn) AS mc, max(soc) AS ms, max(f) AS mf FROM g),
p AS (SELECT g.*, CASE WHEN mr > 0 THEN revs::DOUBLE / mr ELSE 0 END AS nr, CASE WHEN mc > 0 THEN churn::DOUBLE / mc ELSE 0 END AS nc, CASE WHEN ms > 0 THEN soc::DOUBLE / ms ELSE 0 END AS ns, CASE WHEN mf > 0 THEN f / mf ELSE 0 END AS nf FROM g, t)
SELECT entity, {pct("(0.35::DOUBLE * nr + (0.25::DOUBLE * nc + (0.20::DOUBLE * ns + 0.20::DOUBLE * nf))) * 100.0::DOUBLE")} AS risk, revs, churn, soc, {pct("f")} AS fragmentation FROM p""",
        "coupling": f""", e AS (SELECT * FROM m WHERE size <= {o.max_changeset_size}), s AS (SELECT a.entity, b.entity AS coupled, count(*) AS shared FROM e a JOIN e b ON a.lrev = b.lrev AND a.entity < b.entity GROUP BY 1, 2)
SELECT s.entity, s.coupled, 100 * shared // greatest(x.n, y.n) AS degree, (x.n + y.n) // 2 AS average_revs FROM s JOIN l x ON s.entity = x.entity JOIN l y ON s.coupled = y.entity
WHERE shared >= {o.min_shared_revs} AND x.n >= {n} AND y.n >= {n} AND 100 * shared // greatest(x.n, y.n) BETWEEN {o.min_coupling} AND {o.max_coupling}""",
        "soc": f"SELECT entity, soc FROM socs JOIN l USING (entity) WHERE n >= {n}",
        "entity-effort": f"SELECT ra.entity, author, ra.n AS author_revs, r.n AS total_revs FROM ra JOIN r USING (entity) WHERE r.n >= {n}",
        "main-dev-by-revs": f"SELECT entity, author AS main_dev, author_revs, {pct('author_revs * 100.0::DOUBLE / total')} AS ownership FROM (SELECT ra.entity, author, ra.n AS author_revs, r.n AS total, row_number() OVER (PARTITION BY ra.entity ORDER BY ra.n DESC, author DESC) AS k FROM ra JOIN r USING (entity) WHERE r.n >= {n}) WHERE k = 1",
        "fragmentation": f"SELECT entity, {pct('f')} AS fragmentation FROM ({_frag_sql('ra', 'r')}) JOIN often USING (entity)",
        "communication": ", p AS (SELECT DISTINCT entity, author FROM changes JOIN often USING (entity)) SELECT a.author, b.author AS peer, count(*) AS shared FROM p a JOIN p b ON a.entity = b.entity AND a.author < b.author GROUP BY 1, 2",
        "identity": "SELECT entity, author, date, rev, coalesce(CAST(added AS VARCHAR), '-') AS added, coalesce(CAST(deleted AS VARCHAR), '-') AS deleted FROM changes",
        "abs-churn": f"SELECT date, {big('sum(added)')} AS added, {big('sum(deleted)')} AS deleted FROM changes GROUP BY 1",
        "author-churn": f"SELECT author, {big('sum(added)')} AS added, {big('sum(deleted)')} AS deleted FROM changes GROUP BY 1",
        "entity-churn": f"SELECT entity, {big('sum(added)')} AS added, {big('sum(deleted)')} AS deleted, any_value(n) AS n_revs FROM changes JOIN r USING (entity) WHERE n >= {n} GROUP BY 1",
        "entity-ownership": f"SELECT entity, author, {big('a')} AS added, {big('d')} AS deleted FROM churns JOIN often USING (entity)",
        "main-dev": f"SELECT entity, author AS main_dev, {big('a')} AS added, {pct('a * 100.0::DOUBLE / total')} AS ownership FROM (SELECT *, sum(a) OVER (PARTITION BY entity) AS total, row_number() OVER (PARTITION BY entity ORDER BY a DESC, author DESC) AS k FROM churns JOIN often USING (entity)) WHERE k = 1 AND total > 0",
        "age": f"SELECT entity, greatest(date_diff('day', CAST(max(date) AS DATE), CAST({repr(o.age_time_now) if o.age_time_now else '(SELECT max(date) FROM changes)'} AS DATE)), 0) AS age_days FROM changes JOIN r USING (entity) WHERE n >= {n} GROUP BY 1",
    }[name]


@dataclass(frozen=True)
class Query:
    """many: the layer map has rules that match nothing besides; bare: without line counts."""

    analysis: str
    options: Options = Options()
    events: bool = False
    layers: bool = False
    many: bool = False
    bare: bool = False

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        changes = (events_as_commits if self.events else orders_as_commits)(spark, sf_dir)
        changes = filter_paths(changes, self.options.include, self.options.exclude)
        if self.layers:
            changes = map_layers(changes, LAYERS + [(f"none/{i}", "none") for i in range(200)] if self.many else LAYERS)
        if self.bare:
            changes = changes.withColumns({c: F.lit(None).cast("long") for c in ("added", "deleted")})
        return cells(run(self.analysis, changes, self.options))

    def sql(self) -> str:
        source = EVENTS if self.events else ORDERS
        below = lambda p: f"(entity = '{p}' OR starts_with(entity, '{p}/'))"
        keep = [f"NOT {below(p)}" for p in self.options.exclude]
        if self.options.include:
            keep.append("(" + " OR ".join(below(p) for p in self.options.include) + ")")
        if keep:
            source = f"SELECT * FROM ({source}) WHERE {' AND '.join(keep)}"
        if self.layers:
            cases = " ".join(f"WHEN {below(p)} THEN '{n}'" for p, n in LAYERS)
            source = f"SELECT * REPLACE (CASE {cases} ELSE entity END AS entity) FROM ({source})"
        body = _body(self.analysis, self.options)
        if self.bare:  # the rest of the weights, each divided by their sum
            source = f"SELECT * REPLACE (0 AS added, 0 AS deleted) FROM ({source})"
            rest = [repr(w * (1.0 / (0.35 + 0.20 + 0.20))) for w in (0.35, 0.20)]
            body = body.replace("0.35::DOUBLE", f"{rest[0]}::DOUBLE").replace("0.25::DOUBLE", "0.0::DOUBLE").replace("0.20::DOUBLE", f"{rest[1]}::DOUBLE")
        return _sql(source, body, self.options)


_DAY = {"temporal_period": "day"}
QUERIES: dict[str, Query] = {
    **{n.replace("-", "_"): Query(n) for n in (
        "summary", "authors", "revisions", "revision-churn", "risk", "soc", "entity-effort", "main-dev-by-revs", "fragmentation", "communication",
        "identity", "abs-churn", "author-churn", "entity-churn", "entity-ownership", "main-dev", "age")},
    "coupling": Query("coupling", Options(min_shared_revs=2, min_coupling=5)),
    "coupling_layers": Query("coupling", Options(min_coupling=5), layers=True),
    "coupling_day": Query("coupling", Options(min_coupling=5, **_DAY), events=True),
    "coupling_day_small_changesets": Query("coupling", Options(min_coupling=1, max_changeset_size=10, **_DAY), events=True),
    "coupling_day_any_changeset": Query("coupling", Options(min_coupling=20, max_changeset_size=10_000, **_DAY), events=True),
    "revisions_many_prefixes": Query("revisions", Options(include=("standard", "promo/brand_2", *(f"none/{i}" for i in range(150))), exclude=("standard/brand_1", *(f"no/{i}" for i in range(150))))),
    "soc_small_changesets": Query("soc", Options(max_changeset_size=3)),
    "soc_day": Query("soc", Options(**_DAY), events=True),
    "risk_day": Query("risk", Options(**_DAY), events=True),
    "risk_layers": Query("risk", layers=True),
    "risk_many_layers": Query("risk", layers=True, many=True),
    "risk_without_counts": Query("risk", bare=True),
    "risk_filtered": Query("risk", Options(include=("standard", "promo/brand_2"), exclude=("standard/brand_1",))),
    "age_since": Query("age", Options(age_time_now="2030-01-01")),
    "revision_churn_events": Query("revision-churn", events=True),
    "fragmentation_many_revs": Query("fragmentation", Options(min_revs=20)),
    "main_dev_layers": Query("main-dev", layers=True),
}


#: How each analysis is sorted, in SQL; ``identity`` is in the order of the log.
ORDER = {
    "summary": "list_position(['number-of-commits', 'number-of-entities', 'number-of-change-rows', 'number-of-authors'], statistic)",
    "authors": "n_authors DESC, n_revs DESC, entity", "revisions": "n_revs DESC, entity", "revision-churn": "n_revs DESC, churn DESC, entity",
    "risk": "risk DESC, entity", "coupling": "degree DESC, average_revs DESC, entity, coupled", "soc": "soc DESC, entity",
    "entity-effort": "entity, author_revs DESC, author", "main-dev-by-revs": "entity", "fragmentation": "fragmentation DESC, entity",
    "communication": "shared DESC, author, peer", "abs-churn": "date DESC", "author-churn": "added + deleted DESC, author",
    "entity-churn": "added + deleted DESC, entity", "entity-ownership": "entity, added DESC, author", "main-dev": "entity", "age": "age_days DESC, entity",
}
TOP = Options(rows=20, min_shared_revs=2, min_coupling=5)


def top(analysis: str) -> Callable[[SparkSession, str], DataFrame]:
    """The first rows of an analysis, with their places."""
    return lambda spark, sf_dir: cells(run(analysis, orders_as_commits(spark, sf_dir), TOP, place="place"))


def _top_sql(analysis: str) -> str:
    """Sorted by percentages as they are, and given with those that are shown."""
    shown = {"risk": ("risk", "fragmentation"), "fragmentation": ("fragmentation",), "main-dev": ("ownership",), "main-dev-by-revs": ("ownership",)}.get(analysis, ())
    columns = f"* REPLACE ({', '.join(f'{_pct(c)} AS {c}' for c in shown)})" if shown else "*"
    table = _sql(ORDERS, _body(analysis, TOP, lambda x: f"({x})"), TOP)
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {ORDER[analysis]}) AS place FROM ({table})) WHERE place <= {TOP.rows}"


def report(analysis: str, form: str) -> Callable[[SparkSession, str], DataFrame]:
    """The lines of the first rows of an analysis, as the command line writes them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = "".join(rendered(run(analysis, orders_as_commits(spark, sf_dir), TOP), form)).split("\n")[:-1]
        return spark.createDataFrame(list(enumerate(lines)), "line long, content string")

    return query


TEXT_SQL = f"""WITH t AS ({_top_sql("revisions")}), w AS (SELECT greatest(6, max(length(entity)))::INT AS a, greatest(6, max(length(CAST(n_revs AS VARCHAR))))::INT AS b, count(*) AS n FROM t)
SELECT CAST(0 AS BIGINT) AS line, '  ' || rpad('ENTITY', a, ' ') || '  ' || lpad('N-REVS', b, ' ') AS content FROM w
UNION ALL SELECT place, '  ' || rpad(entity, a, ' ') || '  ' || lpad(CAST(n_revs AS VARCHAR), b, ' ') FROM t, w UNION ALL SELECT n + 1, '' FROM w UNION ALL SELECT n + 2, n || ' rows.' FROM w"""
JSON_SQL = f"""WITH t AS ({_top_sql("risk")}), w AS (SELECT count(*) AS n FROM t)
SELECT CAST(0 AS BIGINT) AS line, '[' AS content UNION ALL SELECT n + 1, ']' FROM w
UNION ALL SELECT place, '  {{"entity": "' || entity || '", "risk": "' || risk || '", "revs": "' || revs || '", "churn": "' || churn || '", "soc": "' || soc || '", "fragmentation": "' || fragmentation || '"}}' || CASE WHEN place < n THEN ',' ELSE '' END FROM t, w"""


def function_diffs(changes: DataFrame) -> DataFrame:
    """Facts for function grain made of lineitem: symbols that nest, and two hunks."""
    changes = changes.groupBy("rev", "entity").agg(F.max("added").alias("a"), F.max("deleted").alias("d"))
    symbol = lambda name, first, last: F.struct(F.lit(name).alias("name"), first.cast("long").alias("start_line"), last.cast("long").alias("end_line"))
    new = F.array(symbol("outer", F.lit(1), F.lit(40)), symbol("inner", F.lit(10), F.lit(20)), symbol("twin", F.lit(10), F.lit(20)), symbol("tail", F.lit(45), F.lit(50)))
    old = F.array(symbol("outer", F.lit(1), F.lit(5)), symbol("gone", F.lit(6), F.lit(9)))
    hunk = lambda *x: F.struct(*(v.cast("long").alias(n) for v, n in zip(x, ("old_start", "old_count", "new_start", "new_count"), strict=True)))
    hunks = F.array(hunk(F.col("d"), F.lit(2), F.col("a"), F.lit(3)), hunk(F.lit(0), F.lit(0), F.lit(42), F.col("d")))
    return changes.select("rev", F.col("entity").alias("path"), new.alias("symbols_new"), old.alias("symbols_old"), hunks.alias("hunks"))


def function_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of functions."""
    changes = orders_as_commits(spark, sf_dir)
    changes, _ = to_functions(changes, function_diffs(changes))
    return changes.select("rev", "author", "date", "entity", "added", "deleted")


def function_rows(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same facts with a row for each symbol and each hunk."""

    def of(side: str) -> Column:
        fields = lambda x, place: F.struct(F.lit(side).alias("side"), *(x[c].alias(c) for c in ("name", "start_line", "end_line")), place.cast("long").alias("place"))
        return F.transform(f"symbols_{side}", fields)

    return diffs.select("rev", "path", F.inline(F.concat(of("new"), of("old")))), diffs.select("rev", "path", F.inline("hunks"))


def function_grain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of functions, from facts with a row a symbol."""
    changes, _ = written(orders_as_commits(spark, sf_dir), "changes")
    with held(function_diffs(changes), "diffs") as diffs:
        found = touched_symbols_of(*function_rows(diffs))
    changes, _ = to_functions(changes, found)
    return changes.select("rev", "author", "date", "entity", "added", "deleted")


def symbol_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of which two have the same name, with their numbers."""
    symbols, _ = function_rows(function_diffs(orders_as_commits(spark, sf_dir)))
    return with_ordinals(symbols.withColumn("name", F.when(F.col("name").isin("twin", "tail"), "inner").otherwise(F.col("name"))))


ORDINALS_SQL = f"""WITH f AS (SELECT DISTINCT rev, entity AS path FROM ({ORDERS})),
s(side, place, name, start_line, end_line) AS (VALUES ('new', 0, 'outer', 1, 40), ('new', 1, 'inner', 10, 20), ('new', 2, 'inner', 10, 20), ('new', 3, 'inner', 45, 50), ('old', 0, 'outer', 1, 5), ('old', 1, 'gone', 6, 9)),
n AS (SELECT *, count(*) OVER w AS c, row_number() OVER (w ORDER BY start_line, end_line, place) AS k FROM s WINDOW w AS (PARTITION BY side, name))
SELECT rev, path, side, CASE WHEN c > 1 THEN name || '#' || k ELSE name END AS name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(place AS BIGINT) AS place FROM f, n"""


def function_grain_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What function grain drops where a fifth of the paths isn't Rust and many hunks are outside symbols."""
    changes = orders_as_commits(spark, sf_dir)
    changes = changes.withColumn("entity", F.when(F.col("entity").endswith("0.rs"), F.regexp_replace("entity", "rs$", "md")).otherwise(F.col("entity")))
    diffs = function_diffs(orders_as_commits(spark, sf_dir))
    late = F.transform("hunks", lambda h: h.withField("new_start", h["new_start"] + 20).withField("old_start", h["old_start"] + 4))
    found, dropped = to_functions(changes, diffs.withColumn("hunks", late))
    rows = [(k, v) for k, v in sorted(dropped.items())]
    return spark.createDataFrame(rows, "what string, n long").unionByName(found.agg(F.lit("kept").alias("what"), F.count("*").alias("n")))


def log_round_trip(vcs: str, files: int = 40) -> Callable[[SparkSession, str], DataFrame]:
    """The changes, written as a log of many files, some of which begin in the middle of a
    commit, and read again; of the format ``git``, half of the dates are delimited."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, f"log-{vcs}")
        write_log(orders_as_commits(spark, sf_dir), path, vcs, files, F.xxhash64("rev") % 2 == 0)
        changes = read_log(spark, path, vcs, max_rows=None).drop("pos")
        release(spark, [path])  # what was read stands in a table by now
        return changes

    return query


def identity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a log of many files, in its order, with their places."""
    path = shared_path(spark, "log-identity")
    write_log(orders_as_commits(spark, sf_dir), path, "git2", 40)
    changes = read_log(spark, path, "git2", max_rows=None)
    release(spark, [path])
    return run("identity", changes, TOP, place="place")


IDENTITY_SQL = f"""SELECT * FROM (SELECT entity, author, date, rev, CAST(added AS VARCHAR) AS added, CAST(deleted AS VARCHAR) AS deleted,
  row_number() OVER (ORDER BY rev, date, author, added || chr(9) || deleted || chr(9) || entity) AS place FROM ({ORDERS})) WHERE place <= {TOP.rows}"""


def log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a log with planted faults, and how many lines have each."""
    path = shared_path(spark, "log-faults")
    with held(orders_as_commits(spark, sf_dir), "log-changes") as changes:
        write_lines(_with_faults(log_lines(changes, "git2")), path, 12)
    found = faults(spark, path, "git2").groupBy("error").agg(F.count("*").alias("n"))
    release(spark, [path])
    return found


def _with_faults(lines: DataFrame) -> DataFrame:
    """The lines of some commits, by number, each with one kind of fault."""
    order = F.col("rev").cast("long") % 40
    head = F.when(order == 1, F.regexp_replace("line", "--[^-]*$", "")).when(order == 2, F.regexp_replace("line", "-[0-9]{2}--([^-]*)$", "-32--$1")).otherwise(F.col("line"))
    own = F.split("line", "\t")
    row = F.when(order == 3, F.concat_ws("\t", F.lit("many"), own[1], own[2])).when(order == 4, F.concat_ws("\t", own[0], own[1])).when(order == 5, own[0])
    row = row.when(order == 6, F.concat(F.col("line"), F.lit(" => new"))).when(order == 7, F.concat_ws("\t", own[0], F.lit("-1"), own[2])).otherwise(F.col("line"))
    return lines.withColumn("line", F.when(F.col("k") == 0, head).otherwise(row))


ERRORS_SQL = f"""WITH c AS (SELECT *, CAST(rev AS BIGINT) % 40 AS o FROM ({ORDERS})),
h AS (SELECT DISTINCT rev, date, author, o FROM c),
e AS (SELECT 'git2 header missing author' AS error FROM h WHERE o = 1 UNION ALL SELECT 'malformed git2 header date (expected YYYY-MM-DD): --' || rev || '--' || date[1:8] || '32--' || author FROM h WHERE o = 2
  UNION ALL SELECT 'invalid numstat count `many`' FROM c WHERE o = 3 UNION ALL SELECT 'numstat line missing path' FROM c WHERE o = 4 UNION ALL SELECT 'numstat line missing deleted count' FROM c WHERE o = 5
  UNION ALL SELECT 'rename/copy numstat path is unsupported (use --no-renames): ' || entity || ' => new' FROM c WHERE o = 6 UNION ALL SELECT 'invalid numstat count `-1`' FROM c WHERE o = 7)
SELECT error, count(*) AS n FROM e GROUP BY 1"""


def _function_sql(changes: str, late: tuple[int, int], result: str) -> str:
    return f"""WITH changes AS ({changes}), f AS (SELECT rev, entity, max(added) AS a, max(deleted) AS d FROM changes GROUP BY 1, 2),
h AS (SELECT rev, entity, d + {late[1]} AS os, 2 AS oc, a + {late[0]} AS ns, 3 AS nc FROM f UNION ALL SELECT rev, entity, {late[1]}, 0, 42 + {late[0]}, d FROM f),
lines AS (SELECT rev, entity, 'new' AS side, unnest(range(ns, ns + nc)) AS line, ns AS z FROM h WHERE ns > 0 UNION ALL SELECT rev, entity, 'old', unnest(range(os, os + oc)), 0 FROM h WHERE os > 0),
s(side, k, name, a, b) AS (VALUES ('new', 0, 'outer', 1, 40), ('new', 1, 'inner', 10, 20), ('new', 2, 'twin', 10, 20), ('new', 3, 'tail', 45, 50), ('old', 0, 'outer', 1, 5), ('old', 1, 'gone', 6, 9)),
o AS (SELECT rev, entity, lines.side, line, z, arg_min(name, (b - a) * 10 + k) AS name FROM lines JOIN s ON lines.side = s.side AND line BETWEEN a AND b GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT rev, entity, name, count(*) FILTER (WHERE side = 'new') AS added, count(*) FILTER (WHERE side = 'old') AS deleted FROM o GROUP BY 1, 2, 3)
{result}"""


FUNCTION_SQL = _function_sql(ORDERS, (0, 0), "SELECT c.rev, author, date, c.entity || '::' || name AS entity, t.added, t.deleted FROM changes c JOIN t ON c.rev = t.rev AND c.entity = t.entity")
DROPPED_SQL = _function_sql(ORDERS, (20, 4), """SELECT 'kept' AS what, count(*) AS n FROM changes c JOIN t ON c.rev = t.rev AND c.entity = t.entity WHERE NOT ends_with(c.entity, '0.rs')
UNION ALL SELECT 'non_rust', count(*) FROM changes WHERE ends_with(entity, '0.rs')
UNION ALL SELECT 'no_overlap', count(*) FROM changes c WHERE NOT ends_with(entity, '0.rs') AND NOT EXISTS (SELECT 1 FROM t WHERE t.rev = c.rev AND t.entity = c.entity)""")


#: (query, SQL) of those that aren't in QUERIES.
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "function_grain": (function_grain, FUNCTION_SQL), "function_grain_dropped": (function_grain_dropped, DROPPED_SQL),
    "function_grain_rows": (function_grain_rows, FUNCTION_SQL), "symbol_ordinals": (symbol_ordinals, ORDINALS_SQL),
    "log_git2": (log_round_trip("git2"), ORDERS), "log_legacy": (log_round_trip("git"), ORDERS), "log_errors": (log_errors, ERRORS_SQL), "identity_top": (identity_top, IDENTITY_SQL),
    "revisions_text": (report("revisions", "text"), TEXT_SQL), "risk_json": (report("risk", "json"), JSON_SQL),
    **{f"{n.replace('-', '_')}_top": (top(n), _top_sql(n)) for n in ORDER},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.spark for name, q in QUERIES.items()} | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in QUERIES.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
