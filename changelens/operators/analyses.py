"""The 18 analyses. Each returns a typed table and the keys that it is sorted by."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.errors import EngineError
from changelens.functions.columns import day_number, logical_rev, percent
from changelens.operators import metrics as M
from changelens.operators.pairs import pairs_within
from changelens.options import MAX_CHANGESET_SIZE_LIMIT, Options
from changelens.sources.shared import written

Result = tuple[DataFrame, list[Column]]

#: Parts of the risk score (fixed values): commits, churn, sum of coupling, fragmentation.
WEIGHTS = (0.35, 0.25, 0.20, 0.20)


def summary(changes: DataFrame, options: Options) -> Result:
    """Each count reads its own column: values are combined before they are shuffled, and
    no row is multiplied for the sake of several distinct counts at once."""
    rows = []
    for k, (name, column) in enumerate((("number-of-commits", "rev"), ("number-of-entities", "entity"), ("number-of-change-rows", None), ("number-of-authors", "author"))):
        one = changes.agg(F.count("*").alias("value")) if column is None else changes.select(column).distinct().agg(F.count(column).alias("value"))
        rows.append(one.select(F.lit(k).alias("k"), F.lit(name).alias("statistic"), "value"))
    return reduce(DataFrame.unionByName, rows), [F.col("k")]


def authors(changes: DataFrame, options: Options) -> Result:
    df = changes.groupBy("entity").agg(F.countDistinct("author").alias("n_authors"), F.countDistinct("rev").alias("n_revs"))
    return df.where(F.col("n_revs") >= options.min_revs), [F.desc("n_authors"), F.desc("n_revs"), F.col("entity")]


def revisions(changes: DataFrame, options: Options) -> Result:
    return M.revisions(changes).where(F.col("n_revs") >= options.min_revs), [F.desc("n_revs"), F.col("entity")]


def revision_churn(changes: DataFrame, options: Options) -> Result:
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    df = changes.groupBy("entity").agg(F.countDistinct("rev").alias("n_revs"), F.sum(lines).alias("churn"))
    return df.where(F.col("n_revs") >= options.min_revs), [F.desc("n_revs"), F.desc("churn"), F.col("entity")]


def risk(changes: DataFrame, options: Options) -> Result:
    """100 times the weighted sum of four measures, each relative to its largest value
    among the entities with enough commits; without line counts, churn has no weight.

    The changes are read once, to what an author did to an entity in a commit; this is
    written, and all measures are made of it. The largest values are taken while the
    measures are written.
    """
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    both = F.bool_or(F.col("added").isNotNull() & F.col("deleted").isNotNull())
    each = changes.groupBy("entity", logical_rev(options.temporal_period).alias("lrev"), "author").agg(F.sum(lines).alias("churn"), both.alias("counted"))
    each, _ = written(each, "risk-changes")
    members = M.sized(each.select("lrev", "entity").distinct())
    totals = members.groupBy("entity").agg(F.count("*").alias("n_revs"), F.sum(F.when(F.col("size") <= options.max_changeset_size, F.col("size") - 1)).alias("soc"))
    by_author = each.groupBy("entity", "author").agg(F.count("*").alias("author_revs"), F.sum("churn").alias("churn"), F.bool_or("counted").alias("counted"))
    df = M.fragmentation(by_author, totals, F.any_value("soc").alias("soc"), F.sum("churn").alias("churn"), F.bool_or("counted").alias("counted"))
    df = df.select("entity", F.col("n_revs").alias("revs"), "churn", F.coalesce("soc", F.lit(0)).alias("soc"), "fragmentation", "counted")
    often, measures = F.col("revs") >= options.min_revs, ("revs", "churn", "soc", "fragmentation")
    df, top = written(df, "risk", where=often, **{c: F.max(F.when(often, F.col(c))) for c in measures}, counted=F.bool_or("counted"))
    rest = 1.0 / (WEIGHTS[0] + WEIGHTS[2] + WEIGHTS[3])
    weight = [w if top["counted"] else 0.0 if i == 1 else w * rest for i, w in enumerate(WEIGHTS)]
    part = [F.col(c).cast("double") / F.lit(float(top[c])) if top[c] and top[c] > 0 else F.lit(0.0) for c in measures]
    score = F.lit(weight[0]) * part[0] + (F.lit(weight[1]) * part[1] + (F.lit(weight[2]) * part[2] + F.lit(weight[3]) * part[3]))
    return df.select("entity", (score * 100.0).alias("risk"), *measures), [F.desc("risk"), F.col("entity")]


def coupling(changes: DataFrame, options: Options) -> Result:
    """Pairs of entities changed together, with the share of the more often changed one's
    commits. No more than the commits of the size limit make pairs, and of their entities
    those that have enough commits for a pair."""
    members = M.memberships(changes, options)
    revs = members.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= max(options.min_revs, options.min_shared_revs))
    able = members.where(F.col("size").between(2, options.max_changeset_size))
    shared = _shared_in_rows(able, revs, options) if options.max_changeset_size <= MAX_CHANGESET_SIZE_LIMIT else _shared_by_prefix(able.join(revs, "entity"), options)
    df = shared.where(F.col("shared") >= options.min_shared_revs)
    df = df.select("entity", "coupled", F.expr("100 * shared div greatest(ra, rb)").alias("degree"), F.expr("(ra + rb) div 2").alias("average_revs"))
    return df.where(F.col("degree").between(options.min_coupling, options.max_coupling)), [F.desc("degree"), F.desc("average_revs"), F.col("entity"), F.col("coupled")]


def _near(a: Column, b: Column, options: Options) -> Column:
    """Whether commit counts are near enough for the least degree: no more commits are
    shared than the smaller count."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * options.min_coupling


def _shared_in_rows(able: DataFrame, revs: DataFrame, options: Options) -> DataFrame:
    """(entity, coupled, ra, rb, shared), where a commit's entities fit in a row. Pairs are
    made and counted by numbers of entities; those that share enough commits get names."""
    named, _ = written(revs.withColumn("id", F.monotonically_increasing_id()), "coupling-entities")
    sets = able.join(named, "entity").groupBy("lrev").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("es")).where(F.size("es") > 1)
    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"))
    ahead = lambda x, i: F.transform(F.filter(F.slice("es", i + 2, F.size("es")), lambda y: _near(x["n"], y["n"], options)), lambda y: pair(x, y))
    shared = sets.select(F.inline(F.flatten(F.transform("es", ahead)))).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= options.min_shared_revs)
    of = lambda k: named.select(F.col("id").alias(k), F.struct("entity", "n").alias(f"{k}_of"))
    both = shared.join(of("a"), "a").join(of("b"), "b").select("shared", F.least("a_of", "b_of").alias("x"), F.greatest("a_of", "b_of").alias("y"))
    return both.select(F.col("x.entity").alias("entity"), F.col("y.entity").alias("coupled"), F.col("x.n").alias("ra"), F.col("y.n").alias("rb"), "shared")


def _shared_by_prefix(able: DataFrame, options: Options) -> DataFrame:
    """The same for commits of any size: pairs that can't reach the least degree aren't made.

    An entity of n commits shares t of them at least with any that it is coupled with, so
    both have in common one of all but their t - 1 largest commits: only in those are
    pairs made, block by block, and only of these pairs are the shared commits counted.
    Which commits these are is found from how many of each size an entity has.
    """
    least = F.greatest(F.lit(options.min_shared_revs), F.ceil(F.col("n") * options.min_coupling / 100), F.lit(1))
    sizes = able.groupBy("entity", "n", "size").agg(F.count("*").alias("c"))
    up = Window.partitionBy("entity").orderBy("size")
    placed = sizes.select("entity", "size", (F.sum("c").over(Window.partitionBy("entity")) - least + 1).alias("prefix"), (F.sum("c").over(up) - F.col("c")).alias("smaller"))
    cut = placed.where("smaller < prefix").groupBy("entity").agg(F.max("size").alias("largest"))
    first = able.join(cut, "entity").where("size <= largest").select("lrev", "entity", "n", "size")
    near = _near(F.col("a_n"), F.col("b_n"), options)
    maybe = pairs_within(first, "lrev", "entity", F.col("size")).where(near).select(F.col("a").alias("entity"), F.col("b").alias("coupled"), F.col("a_n").alias("ra"), F.col("b_n").alias("rb")).distinct()
    own = maybe.join(able.select("entity", "lrev"), "entity")
    other = able.select(F.col("entity").alias("coupled"), "lrev")
    return own.join(other, ["coupled", "lrev"]).groupBy("entity", "coupled", "ra", "rb").agg(F.count("*").alias("shared"))


def soc(changes: DataFrame, options: Options) -> Result:
    members = M.memberships(changes, options)
    often = members.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= options.min_revs)
    return M.sum_of_coupling(members, options).join(often.select("entity"), "entity", "left_semi"), [F.desc("soc"), F.col("entity")]


def entity_effort(changes: DataFrame, options: Options) -> Result:
    total = M.revisions(changes).where(F.col("n_revs") >= options.min_revs).withColumnRenamed("n_revs", "total_revs")
    df = M.author_revisions(changes).join(total, "entity").select("entity", "author", "author_revs", "total_revs")
    return df, [F.col("entity"), F.desc("author_revs"), F.col("author")]


def main_dev_by_revs(changes: DataFrame, options: Options) -> Result:
    total = M.revisions(changes).where(F.col("n_revs") >= options.min_revs)
    best = M.author_revisions(changes).groupBy("entity").agg(M.largest("author", "author_revs").alias("main_dev"), F.max("author_revs").alias("author_revs"))
    df = best.join(total, "entity").select("entity", "main_dev", "author_revs", percent(F.col("author_revs"), F.col("n_revs")).alias("ownership"))
    return df, [F.col("entity")]


def fragmentation(changes: DataFrame, options: Options) -> Result:
    total = M.revisions(changes).where(F.col("n_revs") >= options.min_revs)
    return M.fragmentation(M.author_revisions(changes), total).select("entity", "fragmentation"), [F.desc("fragmentation"), F.col("entity")]


def communication(changes: DataFrame, options: Options) -> Result:
    """Pairs of authors by the entities that both changed.

    Entities with the same set of authors, as told by its size and two hashes, are one
    with a weight: a set makes its pairs once, and a large one in blocks.
    """
    own = changes.join(M.often_changed(changes, options), "entity", "left_semi").select("entity", "author").distinct()
    sets = own.groupBy("entity").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), F.col("author"))).alias(f"h{k}") for k in (1, 2)))
    sets = sets.where("n > 1").groupBy("n", "h1", "h2").agg(F.min("entity").alias("entity"), F.count("*").alias("weight"))
    each = own.join(sets.select("entity", "n", "weight"), "entity")
    pairs = pairs_within(each, "entity", "author", F.col("n"))
    df = pairs.groupBy(F.col("a").alias("author"), F.col("b").alias("peer")).agg(F.sum("a_weight").alias("shared"))
    return df, [F.desc("shared"), F.col("author"), F.col("peer")]


def identity(changes: DataFrame, options: Options) -> Result:
    """The rows themselves, in the order of the log where the source knows it."""
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    order = [c for c in ("pos",) if c in changes.columns]
    df = changes.select("entity", "author", "date", "rev", count("added"), count("deleted"), *order)
    return df, [F.col(c) for c in order]


def _sums(changes: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    return changes.groupBy(*keys).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), *more)


def abs_churn(changes: DataFrame, options: Options) -> Result:
    return _sums(changes, "date", more=(M.missing(),)).where(M.complete()).drop("missing"), [F.desc("date")]


def author_churn(changes: DataFrame, options: Options) -> Result:
    return _sums(changes, "author", more=(M.missing(),)).where(M.complete()).drop("missing"), [F.desc(F.col("added") + F.col("deleted")), F.col("author")]


def entity_churn(changes: DataFrame, options: Options) -> Result:
    df = _sums(changes, "entity", more=(F.countDistinct("rev").alias("n_revs"), M.missing())).where(M.complete(F.col("n_revs") >= options.min_revs))
    return df.drop("missing"), [F.desc(F.col("added") + F.col("deleted")), F.col("entity")]


def entity_ownership(changes: DataFrame, options: Options) -> Result:
    often = M.often_changed(changes, options, counted=True)
    return _sums(changes, "entity", "author").join(often, "entity", "left_semi"), [F.col("entity"), F.desc("added"), F.col("author")]


def main_dev(changes: DataFrame, options: Options) -> Result:
    sums = changes.groupBy("entity", "author").agg(F.sum("added").alias("n"))
    best = sums.groupBy("entity").agg(M.largest("author", "n").alias("main_dev"), F.max("n").alias("added"), F.sum("n").alias("total")).where("total > 0")
    df = best.join(M.often_changed(changes, options, counted=True), "entity", "left_semi")
    return df.select("entity", "main_dev", "added", percent(F.col("added"), F.col("total")).alias("ownership")), [F.col("entity")]


def age(changes: DataFrame, options: Options) -> Result:
    """Days from an entity's last date, as text, to the reference date or the last of all."""
    if options.age_time_now is None and changes.limit(1).isEmpty():
        raise EngineError("no dates available")
    df = changes.groupBy("entity").agg(F.max("date").alias("date"), F.countDistinct("rev").alias("n_revs"))
    now = F.lit(options.age_time_now).alias("now") if options.age_time_now is not None else None
    df = df.withColumn("now", now) if now is not None else df.crossJoin(F.broadcast(changes.agg(F.max("date").alias("now"))))
    days = F.greatest(F.datediff(day_number(F.col("now")), day_number(F.col("date"))), F.lit(0)).cast("long")
    return df.where(F.col("n_revs") >= options.min_revs).select("entity", days.alias("age_days")), [F.desc("age_days"), F.col("entity")]


#: All analyses, in the order of the help text.
ANALYSES: dict[str, Callable[[DataFrame, Options], Result]] = {
    "summary": summary, "authors": authors, "revisions": revisions, "revision-churn": revision_churn, "risk": risk, "coupling": coupling, "soc": soc,
    "entity-effort": entity_effort, "main-dev-by-revs": main_dev_by_revs, "fragmentation": fragmentation, "communication": communication,
    "identity": identity, "abs-churn": abs_churn, "author-churn": author_churn, "entity-churn": entity_churn, "entity-ownership": entity_ownership,
    "main-dev": main_dev, "age": age,
}


def analysis(name: str) -> Callable[[Callable[[DataFrame, Options], Result]], Callable[[DataFrame, Options], Result]]:
    """Add an analysis, by the name that ``-a`` takes: a function from changes and options
    to a typed table and the keys that it is sorted by."""

    def add(function: Callable[[DataFrame, Options], Result]) -> Callable[[DataFrame, Options], Result]:
        if name in ANALYSES:
            raise EngineError(f"analysis `{name}` is there already")
        ANALYSES[name] = function
        return function

    return add
