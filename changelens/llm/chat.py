"""Preference formatting of conversations, in DataFrame functions only.

The longest common beginning of a chosen and a rejected conversation is rendered once
as the prompt; what follows on either side becomes a completion whose assistant turns
are trained on while everything else is masked.  The result has a row for each turn, so
that a conversation of any length stays spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is start + role + line end + text + end; trained_role: whose texts, with
    the end mark, are trained on; marks within texts are broken by a space."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    trained_role: str = "assistant"


def _escaped(text: Column, template: Template) -> Column:
    for mark in (template.start, template.end):
        text = F.replace(text, F.lit(mark), F.lit(mark[:1] + " " + mark[1:]))
    return text


def preference_turns(turns: DataFrame, *, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template()) -> DataFrame:
    """(pair_id, part, turn, copy, role, rendered, train_start) for each turn.

    ``pair`` names the pair of each row, ``chosen`` is true on its chosen side. part is
    prompt, chosen or rejected. Turns are compared by number: the prompt ends before
    the first number where the sides differ in role, in text or in how often a turn is
    repeated; if nowhere, all is prompt. Turns of the prompt are given once, repeated
    ones as often as one side has them (copy counts from 0). train_start is the code
    point in ``rendered`` where training starts; null for turns that are masked.
    Null roles are "user", null texts empty, null turn numbers come last. Rows whose
    pair is null are no part of any pair. A pair with one side only has no prompt.
    """
    last = F.lit((1 << 63) - 1)
    rows = turns.select(
        pair.cast("long").alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("c"), F.coalesce(F.col(turn).cast("long"), last).alias("turn"),
        F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("pair_id is not null")
    counted = rows.groupBy("pair_id", "turn", "role", "text").agg(F.count_if("c").alias("n_chosen"), F.count_if(~F.col("c")).alias("n_rejected"))
    ends = counted.groupBy("pair_id").agg(F.min(F.when(F.col("n_chosen") != F.col("n_rejected"), F.col("turn"))).alias("first"))
    placed = counted.join(ends, "pair_id").withColumn("shared", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    side = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("n"))
    parts = F.when(F.col("shared"), F.array(side("prompt", F.col("n_chosen")))).otherwise(F.array(side("chosen", F.col("n_chosen")), side("rejected", F.col("n_rejected"))))
    out = placed.withColumn("side", F.explode(parts)).where("side.n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side.n") - 1)))
    head = F.concat(F.lit(template.start), "role", F.lit("\n"))
    trained = (F.col("side.part") != "prompt") & (F.col("role") == template.trained_role)
    return out.select(
        "pair_id", F.col("side.part").alias("part"), "turn", "copy", "role",
        F.concat(head, _escaped(F.col("text"), template), F.lit(template.end + template.after)).alias("rendered"),
        F.when(trained, F.length(head).cast("long")).alias("train_start"),
    )


def preference_pairs(rendered: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans), one row a pair.

    Takes what ``preference_turns`` gives. Each text is its part's turns in order, empty
    where the part has none; spans are the (start, end) in code points of what is trained
    on, everything else is masked. This gathers a conversation in one row, as a trainer
    reads it; the rows of ``preference_turns`` serve where one may be too long for that.
    Turns with equal numbers are ordered by role and text, repeated ones stand as often as
    they are; an empty table gives an empty one.
    """
    parts = ("prompt", "chosen", "rejected")
    turn = F.struct("turn", "role", "rendered", "copy", "train_start")
    each = rendered.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in parts))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def spans(part: str) -> Column:
        def add(a: Column, x: Column) -> Column:
            end = a["at"] + F.length(x["rendered"])
            more = F.concat(a["spans"], F.array(F.struct((a["at"] + x["train_start"]).alias("start"), end.alias("end"))))
            return F.struct(end.alias("at"), F.when(x["train_start"].isNotNull(), more).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda a: a["spans"])

    texts = [F.array_join(F.transform(p, lambda x: x["rendered"]), "").alias(p) for p in parts]
    return each.select("pair_id", *texts, *(spans(p).alias(f"{p}_spans") for p in parts[1:]))


#: What the query gives, in DuckDB's SQL.
ORACLE_SQL = """
WITH r AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS c, CAST(turn AS BIGINT) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT pair_id, turn, role, text, count(*) FILTER (WHERE c) AS a, count(*) FILTER (WHERE NOT c) AS b FROM r GROUP BY ALL),
e AS (SELECT pair_id, min(CASE WHEN a <> b THEN turn END) AS first FROM k GROUP BY pair_id),
p AS (SELECT k.*, coalesce(turn < first, true) AS shared FROM k JOIN e USING (pair_id)),
s AS (SELECT pair_id, 'prompt' AS part, turn, role, text, a AS n FROM p WHERE shared
      UNION ALL SELECT pair_id, 'chosen', turn, role, text, a FROM p WHERE NOT shared
      UNION ALL SELECT pair_id, 'rejected', turn, role, text, b FROM p WHERE NOT shared),
x AS (SELECT *, unnest(range(0, n)) AS copy FROM s WHERE n > 0)
SELECT pair_id, part, turn, copy, role,
       '<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(length('<|im_start|>' || role || chr(10)) AS BIGINT) END AS train_start
FROM x
"""
