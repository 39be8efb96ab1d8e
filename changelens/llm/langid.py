"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with the words and pairs
of neighbouring words that would save the most bytes in a bounded sample of its texts,
each text counted to its end.  A text is compressed, block by block and to its end, with
each language's dictionary; the language with the fewest bytes wins.  A stretch of the
dictionary is put before each block, so that even a few words are compressed and not
stored as they are.  Where the runner-up is almost as small, the answer is marked as
unreliable.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import WRITTEN, materialize, release

UNKNOWN = "und"
SCHEMA = "lang string, score double, margin double, reliable boolean"


@dataclass(frozen=True)
class Fit:
    """texts: at most so many labelled rows of each language teach, whole (of rows that
    share an id's hash, all or none); dictionary_bytes: of each language's dictionary,
    less if there are so many languages that all together would exceed total_bytes;
    broadcast_names: up to so many languages, each one's last hash goes to all tasks
    instead of texts being shuffled (the same rows are chosen either way);
    block: characters that are compressed at a time; lead: bytes of the dictionary put
    before each block; min_margin: share of the runner-up's bytes that a reliable answer
    saves."""

    texts: int = 512
    dictionary_bytes: int = 32 << 10
    total_bytes: int = 8 << 20
    broadcast_names: int = 50_000
    block: int = 4096
    lead: int = 64
    min_margin: float = 0.01


def prepared(text: str) -> str:
    """Lower case, with every run of anything but letters as one space."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).strip()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> Iterator[str]:
    """The words of a text, and its pairs of neighbouring words."""
    found = prepared(text).split()
    yield from found
    yield from map(" ".join, zip(found, found[1:], strict=False))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, text in zip(batch["l"], batch["t"], strict=True):
            total.update((lang, g) for g in grams(text))
        if len(total) > 500_000:
            yield _as_rows(total)
            total.clear()
    yield _as_rows(total)


def _as_rows(total: Counter[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(lang, g, n) for (lang, g), n in total.items()], columns=["l", "gram", "n"])


def fit_on(documents: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit: Fit = Fit()) -> dict[str, bytes]:
    """Each language's dictionary, from the rows where ``learn`` holds.

    Rows without language, text or letter are passed over. The sample takes, of each
    language, the texts with the smallest hashes of their ids; two passes over the texts
    serve any number of languages. Words are counted, and the best chosen, on the
    executors: the driver gets total_bytes at most.
    """
    since = len(WRITTEN)
    rows = documents.where(learn).select(F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    first = rows.select("l", "h", F.pmod("h", F.lit(64)).alias("part"))
    for keys in (["l", "part"], ["l"]):  # in parts first, so that a frequent language's rows aren't all in one task
        first = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= fit.texts).drop("r")
    first = materialize(first.select("l", "h"), "chosen")
    limits = first.groupBy("l").agg(F.max("h").alias("last"))
    names = limits.count()
    if names <= fit.broadcast_names:
        sample = rows.join(F.broadcast(limits), "l").where("h <= last").select("l", "t")
    else:
        sample = rows.join(first.distinct().hint("merge"), ["l", "h"]).select("l", "t")
    counts = sample.mapInPandas(_counted, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    size = F.octet_length("gram") + 1
    best = Window.partitionBy("l").orderBy(F.desc(F.col("n") * size), "gram")
    ranked = counts.withColumn("used", F.sum(size).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= fit.dictionary_bytes)
    # the dictionaries' bytes are bounded before any is fetched
    chosen = ranked.where(F.col("used") <= fit.total_bytes // max(1, names)).select("l", "gram", "used").toPandas().sort_values(["l", "used"], ascending=[True, False])
    release(documents.sparkSession, since)
    return {name: " ".join(part["gram"]).encode() for name, part in chosen.groupby("l")}


class Classifier:
    """Compressors for all languages, made once for each task."""

    def __init__(self, model: dict[str, bytes], fit: Fit = Fit()):
        self.fit = fit
        self.compressors = {name: (self._compressor(raw), raw[-fit.lead :] + b" ") for name, raw in sorted(model.items())}

    def _compressor(self, raw: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(6, source_size=self.fit.block, dict_size=len(raw), min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        own.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=params)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the margin is wide enough.

        Null and empty texts, those without a letter, and all texts when no language was
        learned are ``und`` with score 0. Equal sizes go to the first name. Each text is
        judged alone, so equal texts have equal answers.
        """
        if not has_letter(text) or not self.compressors:
            return UNKNOWN, 0.0, 0.0, False
        clean = prepared(text)
        blocks = [clean[i : i + self.fit.block].encode() + b" " for i in range(0, len(clean), self.fit.block)]
        sizes = sorted((sum(len(c.compress(lead + b)) for b in blocks), name) for name, (c, lead) in self.compressors.items())
        best, name = sizes[0]
        if len(sizes) == 1:
            return name, 1.0, 1.0, True
        margin = (sizes[1][0] - best) / sizes[1][0]
        # each byte saved doubles the odds against the other languages
        score = 1 / sum(2.0 ** -min(60, size - best) for size, _ in sizes)
        return name, score, margin, margin >= self.fit.min_margin


def identify(model: dict[str, bytes], text: Column, fit: Fit = Fit()) -> Column:
    """A struct of lang, score, margin and reliable for each whole text, as ``Classifier``
    gives them: null and empty texts are ``und``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(model, fit)
        for batch in batches:
            yield pd.DataFrame([classify(t) for t in batch], columns=["lang", "score", "margin", "reliable"])

    return F.pandas_udf(run, SCHEMA)(text)
