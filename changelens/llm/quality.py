"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: bare punctuation, too many symbols, short fragments
without punctuation at their end, navigation, boilerplate and repetition of an earlier
line remove it.  A document is then rejected if the removed
lines held too much of its text, or if it fails the whole-document base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import SPACES, WORD, words

SYMBOLS = "#*$%&|<>"
#: Lines that contain one of these phrases are boilerplate (fixed values, lower case).
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie policy", "cookie settings", "cookie consent", "cookies policy", "cookies settings", "cookies consent",
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe now", "subscribe to our", "sign up for",
    "log in to", "login to", "share this", "share on", "read more",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "jetzt abonnieren", "jetzt anmelden", "weiterlesen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "abonnez-vous", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí", "haz clic aquí", "suscríbete", "leer más",
)
#: How a sentence, a quotation or the head of a list ends, in Java's and RE2's patterns.
TERMINAL = r"[.!?:;…。！？\x22'”’»)\]][\x20\x09-\x0D]*\z"
#: Characters that part the entries of a navigation bar.
BARS = "|»›•·"


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_pct: base rules on documents; max_symbol_pct: symbols
    per word that a line may have; min_open_chars: a line that ends without terminal
    punctuation has so many characters at least, white space aside; max_bar_pct: entry separators per word;
    max_upper_pct: capital letters per letter, of lines with 20 or more letters;
    max_word_chars: mean length of a line's words; max_lost_pct: of a document's characters, removed with their lines."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 30
    min_open_chars: int = 20
    max_bar_pct: int = 30
    max_upper_pct: int = 70
    max_word_chars: int = 40
    max_lost_pct: int = 50


def _without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _bars(text: Column) -> Column:
    bare = text
    for c in BARS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(text) - F.length(bare)


def _has_phrase(text: Column) -> Column:
    """Whether a text in lower case holds a boilerplate phrase."""
    found = text.contains(BOILERPLATE[0])
    for x in BOILERPLATE[1:]:
        found = found | text.contains(x)
    return found


#: Three capitals with no other letter between: a line of 20 letters or more with over 70
#: percent of capitals has them.
CAPITALS = r"\p{Lu}\P{L}*+\p{Lu}\P{L}*+\p{Lu}"


def _signs(text: Column, low: Column, rules: Rules) -> Column:
    """What of a whole text decides which rules its lines can fail at all."""
    bars = F.lit(False)
    for c in BARS:
        bars = bars | text.contains(c)
    return F.struct(
        _count(text, SYMBOLS).alias("symbols"), bars.alias("bars"), _has_phrase(low).alias("phrases"),
        (text.rlike(CAPITALS) if rules.max_upper_pct >= 70 else F.lit(True)).alias("capitals"),
    )


def _line_fails(line: Column, rules: Rules, signs: Column | None = None) -> Column:
    """signs: of the whole text (``_signs``); rules that no line can fail aren't tried."""
    may = (lambda c: F.lit(True)) if signs is None else (lambda c: signs[c])
    solid = F.length(_without_spaces(line))
    n = F.length(line) - solid + 1
    letters, capitals = (F.regexp_count(line, F.lit(x)) for x in (r"\p{L}", r"\p{Lu}"))
    # letters are counted only where there are capitals enough for 20 letters
    upper = may("capitals") & (solid >= 20) & (100 * capitals > rules.max_upper_pct * 20) & (letters >= 20) & (100 * capitals > rules.max_upper_pct * letters)
    return (
        ~line.rlike(r"\p{L}")
        | ((solid < rules.min_open_chars) & ~line.rlike(TERMINAL))
        | ((F.lit(True) if signs is None else signs["symbols"] > 0) & (100 * _count(line, SYMBOLS) > rules.max_symbol_pct * n))
        | (may("bars") & (100 * _bars(line) > rules.max_bar_pct * n))
        | upper
        | (solid > rules.max_word_chars * n)
        | (may("phrases") & _has_phrase(F.lower(line)))
    )


def _places(found: Column) -> Column:
    """Where three-word windows start."""
    n = F.size(found)
    return F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))


def _ordered_windows(found: Column, hashes: Column) -> Column:
    """All three-word windows with their places, in order of their words; none if all
    hashes of windows differ, as then no window repeats."""
    n = F.size(hashes)
    three = [F.slice(found, k, n).alias(f"w{k}") for k in (1, 2, 3)]
    windows = F.arrays_zip(*three, _places(found).alias("i"))
    return F.when(F.size(F.array_distinct(hashes)) < n, F.sort_array(windows)).otherwise(F.slice(windows, 1, 0))


def _repeated_places(ordered: Column) -> Column:
    """Where windows start that have an equal neighbour, in order of place."""

    def pair(x: Column, k: Column) -> Column:
        y = F.get(ordered, k + 1)
        return F.when((y["w1"] == x["w1"]) & (y["w2"] == x["w2"]) & (y["w3"] == x["w3"]), F.array(x["i"], y["i"]))

    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.transform(ordered, pair)))))


def _covered_words(starts: Column) -> Column:
    """How many words the windows at these places cover, none counted twice."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measure(df: DataFrame, *, text: str = "text", rules: Rules = Rules(), into: str = "quality", clean: bool = False) -> DataFrame:
    """``df`` with a struct column ``into``: the base counts and the verdicts.

    With ``clean``, texts lose their failing and repeated lines, and the lines without a
    word; texts without such lines, and null, stay as they are. Null texts have no words and fail. A line counts as a duplicate if it has a word
    and equals an earlier line. n_repeat_words counts the words that stand in a
    three-word window found twice or more in the text. Texts of any length are
    measured to their end; every row is judged alone.
    """
    columns = [c for c in df.columns if c != into]  # a column of that name gives way
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    df = df.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), F.col(f"`{text}`").isNull().alias("none"))
    df = df.select("row", "t", "none", words(F.col("t")).alias("w"), _lines_with_words(F.col("t")).alias("lines"))
    df = df.select("row", "t", "none", "w", F.transform(_places(F.col("w")), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))).alias("h"), F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), F.array_distinct("lines").alias("lines"), F.lower("t").alias("low"))
    df = df.select("row", "t", "none", F.size("w").alias("n"), _ordered_windows(F.col("w"), F.col("h")).alias("o"), "n_lines", "chars", "lines", _signs(F.col("t"), F.col("low"), rules).alias("signs"))
    good = F.filter("lines", lambda x: ~_line_fails(x, rules, F.col("signs")))
    df = df.select("row", "t", "none", "n", "n_lines", F.size("lines").alias("n_distinct"), _repeated_places(F.col("o")).alias("p"), good.alias("good"), "chars", "signs.symbols")
    cleaned = F.when(~F.col("none"), F.when(F.size("good") == F.col("n_lines"), F.col("t")).otherwise(F.array_join("good", "\n"))) if clean else F.lit(None).cast("string")
    df = df.select("row", "t", "n", "n_lines", "n_distinct", F.aggregate("good", F.lit(0), lambda a, x: a + F.length(x)).alias("good_chars"), "chars", "symbols", _covered_words(F.col("p")).alias("r"), cleaned.alias("clean"))
    # a filter on the verdict isn't pushed below a generator, where it would compute everything again
    df = df.select("row", F.explode(F.array(F.struct("t", "n", "n_lines", "n_distinct", "good_chars", "chars", "symbols", "r", "clean"))).alias("x")).select("row", "x.*")
    failed = (F.col("n") < rules.min_words) | (100 * F.col("r") > rules.max_repeat_pct * F.col("n"))
    verdict = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(_without_spaces(F.col("t"))).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        (F.col("n_lines") - F.col("n_distinct")).cast("long").alias("n_dup_lines"),
        F.col("r").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (100 * (F.col("chars") - F.col("good_chars")) <= rules.max_lost_pct * F.col("chars"))).alias("kept"),
    )
    return df.select(*(F.col("clean").alias(c) if clean and c == text else F.col(f"row.`{c}`").alias(c) for c in columns), verdict.alias(into))


def clean_lines(df: DataFrame, *, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` with the failing and the repeated lines taken out of its texts (null stays null).

    Of equal lines the first stays. Lines without a word stay only between others.
    """
    lines = F.filter(F.array_distinct(F.split(F.col(text), "\n", -1)), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~_line_fails(x, rules))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.concat_ws("\n", lines)))


#: What ``measure`` gives for ``documents`` by ``Rules()``, in DuckDB's SQL.
ORACLE_SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), 'WORD') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, 'WORD')) AS lines FROM documents
), b AS (
  SELECT doc_id, t, len(w) AS n, lines,
         list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS g FROM a
), e AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM b
), f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e
), h AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE c > 1) GROUP BY doc_id
), l AS (SELECT doc_id, unnest(list_distinct(lines)) AS x FROM b
), m AS (
  SELECT doc_id, x, length(x) - length(regexp_replace(x, 'GAPS', '', 'g')) + 1 AS n, length(regexp_replace(x, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS capitals, length(regexp_replace(x, 'GAPS', '', 'g')) AS solid, length(x) AS chars FROM l
), k AS (
  SELECT doc_id, sum(chars) AS good FROM m
  WHERE NOT (letters = 0 OR (solid < 20 AND NOT regexp_matches(x, 'TERMINAL')) OR 100 * length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > 30 * n
    OR 100 * length(regexp_replace(x, '[^|»›•·]+', '', 'g')) > 30 * n OR (letters >= 20 AND 100 * capitals > 70 * letters) OR solid > 40 * n
    OR regexp_matches(lower(x), 'BOILERPLATE')) GROUP BY doc_id
), q AS (
  SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(t, 'GAPS', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, coalesce(good, 0) AS good, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS total
  FROM b LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (total - good) <= 50 * total) AS kept
FROM q
"""
for _name, _value in (("WORD", WORD), ("GAPS", r"[\x20\x09-\x0D]+"), ("TERMINAL", TERMINAL.replace("'", "''")), ("BOILERPLATE", "|".join(BOILERPLATE).replace("'", "''"))):
    ORACLE_SQL = ORACLE_SQL.replace(f"'{_name}'", f"'{_value}'")
