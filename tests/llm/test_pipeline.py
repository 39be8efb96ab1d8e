"""Queries and the pipeline over a small table, stage by stage."""

import gc
import hashlib
import random
import re
import sys
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import common, jaccard, packing, pii, quality, spm, toxicity
from changelens.llm.queries import oracle_sql, queries

sys.path.insert(0, str(Path(__file__).parent))
import test_operators as plain  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        text = prose(8)
        if i % 5 == 0:
            text = text.replace(".", " vilepest.", 2)
        rows.append((i, text))
        labels.append((i, int(i % 5 == 0)))
    rows += [(200, rows[1][1] + " tail."), (201, rows[1][1]), (202, "too short"), (203, rows[2][1].replace(".", " a@b.org.", 1)), (204, None), (205, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {i for i in range(160) if i % 5 == 0}
    assert not toxic & set(kept[0]) and set(range(160)) - toxic <= set(kept[0])
    assert set(kept[1]) == set(kept[0]) - {202, 204, 205}
    assert set(kept[2]) == set(kept[1]) - {200, 201, 203}  # two copies, and one with an address put in
    assert all(not pii.base_spans(t) for t in kept[3].values()) and set(kept[3]) == set(kept[2])
    assert all(re.sub(r"<[A-Z]+>", "", t) for t in kept[3].values())


def test_near_copies_at_eighty_percent_of_five_words_go(spark):
    rng = random.Random(5)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]

    def share(a, b, n):
        x, y = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    rows, gone, changes = [], set(), [(96, 2), (200, 4), (540, 11), (96, 3), (200, 6)]
    for i, (n, changed) in enumerate(changes):
        text = fresh(n)
        copy = [*text]
        for k in range(changed):
            copy[(2 * k + 1) * n // (2 * changed)] = f"other{i}x{k}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        if share(text, copy, 5) >= 0.8:
            assert share(text, copy, 3) < 0.9
            gone.add(2 * i + 1)
    assert gone == {1, 3, 5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(range(10)) - gone
    assert jaccard.Join() == jaccard.Join(ngram=3, percent=90)


def test_of_equal_texts_of_an_id_the_row_that_comes_first_stays(spark):
    rows = [(1, "a b c d e f", s, x) for s in ("web", "book") for x in (2, 1)] * 3 + [(1, "another text of six words", "z", 0), (2, "a b c d e f", "web", 5), (2, "of the second", "web", 6), (None, "n", "q", 1), (None, "n", "q", 1), (3, None, "b", 1), (3, None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "book", 1), (1, "another text of six words", "z", 0), (None, "n", "q", 1), (None, "n", "q", 1), (3, None, "a", 1)], key=str)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(corpus_pipeline.STAGES) == 5 and rows
    bins = {}
    for r in rows:
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["length"]))
    for (_, capacity), parts in bins.items():
        assert sum(n for _, n in parts) <= capacity and len({o for o, _ in parts}) == len(parts)


def test_names_and_contract_columns(spark):
    assert sorted(re.match(r"op(\d+)_", n)[1] for n in queries()) == sorted(map(str, range(1, 14)))
    assert set(oracle_sql()) <= set(queries())
    wanted = {
        "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in wanted.items():
        df = queries()[name](spark, SF)
        assert df.columns[: len(columns)] == columns and df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def rows(spark, name):
    return queries()[name](spark, SF).collect()


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*{"documents": ("doc_id", "text"), "embeddings": ("vec_id", "embedding")}[name]).collect()]


def test_neighbours_query_equals_brute_force(spark):
    want = {(q, k): (i, s) for q, k, i, s in plain.brute(table(spark, "embeddings"), 20)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in rows(spark, "op4_nearest_neighbours")}
    assert set(got) == set(want) and sum(got[x][0] == want[x][0] for x in want) >= 0.99 * len(want)


def test_packing_query_places_every_token_once(spark):
    want = {i: len(x) for (i, _), x in zip(table(spark, "documents"), spm.Codec(spm.model_file()).encode([t or "" for _, t in table(spark, "documents")]))}
    got, bins = {}, {}
    for r in rows(spark, "op6_best_fit_packing"):
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["length"]))
    for parts in got.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert {i: sum(n for _, n in x) for i, x in got.items()} == {i: n for i, n in want.items() if n}
    assert all(sum(n for _, n in x) <= capacity for (_, capacity), x in bins.items())


def test_jaccard_query_equals_all_pairs(spark):
    assert sorted(tuple(r) for r in rows(spark, "op9_ngram_jaccard")) == plain.plain_components(sorted(table(spark, "documents")))


def test_personal_data_query_equals_the_patterns(spark):
    texts = dict(table(spark, "documents"))
    for r in rows(spark, "op10_pii"):
        base = plain.plain_spans(texts[r["doc_id"]])
        line = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest() and set(line) <= set(r["spans"].split(",")) | {""}


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row string, i long, t string, quality string"
    extra = ("en", "s", 1, "x", "r", 7, "t", "q")
    empty = spark.createDataFrame([], schema)
    prose = "\n".join(f"The word{i} of the text{i} goes on for some time{i}." for i in range(12))
    odd = spark.createDataFrame([(1, prose, *extra), (1, prose, *extra), (1, prose + " Other end.", *extra), (None, prose, *extra), (None, None, *extra), (3, None, *extra), (4, "", *extra), (5, "word " * 20_000, *extra)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
        found = stage(spark, odd, sf_dir)
        if name != "packing":
            assert found.columns == odd.columns
            kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in found.collect()))
            n = len(prose)
            assert {
                "toxicity": len(kept) == 8, "quality": kept == [(False, 1, n), (False, 1, n), (False, 1, n + 11), (True, 0, n)],
                "near_copies": kept == [(False, 1, n), (False, 1, n + 11), (False, 3, 0), (False, 4, 0), (False, 5, 100_000), (True, 0, 0), (True, 0, n)],
                "personal_data": len(kept) == 8,
            }[name], (name, kept)
        else:
            assert sorted({r["doc_id"] for r in found.collect() if r["doc_id"] is not None}) == [1, 5]


def test_defaults():
    assert quality.Rules().min_words == 50 and toxicity.THRESHOLD == 0.3 and max(packing.Bins().capacities) == 8192


def _shuffled(spark) -> int:
    """Bytes of shuffle files that stand on this machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().endswith(".data"))


def test_near_copies_shuffle_no_texts_that_are_in_no_cluster(spark):
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(1200):x}" for _ in range(12)) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(path := tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/docs")
    docs = spark.read.parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # then Spark removes the files of other tests
    time.sleep(2)
    before = _shuffled(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    ids = sorted(r["doc_id"] for r in kept.where("length(text) > 0").collect())
    assert ids == list(range(1500))
    assert _shuffled(spark) - before < sum(map(len, texts)) // 10


def _parquet(spark, rows, parts) -> object:
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/docs"
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_copies_have_no_signatures_and_are_not_shuffled(spark, monkeypatch):
    rng, sizes = random.Random(8), []
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(120)) for _ in range(150)]
    texts += [t.replace(t.split()[7], "other", 1) for t in texts[:30]]
    docs = _parquet(spark, [(k * 1000 + i, t) for k in range(6) for i, t in enumerate(texts)], 6)

    def seen(df, name, write=jaccard.materialize):
        out = write(df, name)
        if name == "records":
            columns = [c for c in out.columns if c.startswith("sigs")]
            sizes.append(out.select(sum(F.size(c).cast("long") for c in columns).alias("n")).agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(jaccard, "materialize", seen)
    jaccard.linked(docs.where("doc_id < 1000"), join=corpus_pipeline.NEAR)
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_copies(spark, docs, "")
        before = _shuffled(spark)
        assert sorted(r["doc_id"] for r in kept.where("length(text) > 0").collect()) == list(range(150))
        assert _shuffled(spark) - before < sum(map(len, texts)) // 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sizes[1] < sizes[0] * 1.5


def test_the_row_that_signs_for_copies_need_not_be_their_representative(spark):
    rng, base = random.Random(9), [f"w{k}" for k in range(100)]
    near = " ".join([*base[:-1], "z"])
    rows = [(7, " ".join(base)), (3, " ".join(base)), (5, " ".join(base)), (9, near), (8, " ".join(rng.sample(base, 100)))]
    # in order of rows: 7 comes before 3 in one batch and stands for it, 5 in another has the smaller id of the two
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows[:2], rows[2:3], rows[3:]], 3).flatMap(lambda x: x), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs, join=corpus_pipeline.NEAR).collect()}
    assert found == {3: 3, 5: 3, 7: 3, 9: 3, 8: 8}


def test_rare_members_are_told_apart_among_many(spark):
    rng, join = random.Random(10), jaccard.Join(buckets=64)
    texts = [" ".join(str(rng.randrange(200_000)) for _ in range(200)) for _ in range(300)]
    sets = [(i, 0, jaccard.shingles(t, 1).tobytes()) for i, t in enumerate(texts)]
    found = jaccard._divided(spark.createDataFrame(sets, "node long, cluster long, own binary"), join)
    assert found.count() < 30  # by 64 buckets nearly all sets meet


def test_the_second_round_is_bounded_on_disk(spark, monkeypatch):
    rng, join, rows = random.Random(11), jaccard.Join(ngram=1, percent=80, block_docs=8, pivots=2), []
    passage = [f"p{k}" for k in range(80)]
    texts = [" ".join(passage + [f"{g}-{k}" for k in range(17)] + [f"x{rng.randrange(10**6)}"]) for g in range(40) for _ in range(3)]
    sets = spark.createDataFrame([(i, 0, 120, 15, 98, jaccard.shingles(t, 1).tobytes()) for i, t in enumerate(texts)], "node long, cluster long, docs long, blocks int, n long, own binary")
    compare = jaccard._compare

    def counted(df, join):
        rows.append(df.where("not probe").count())
        return compare(df, join)

    monkeypatch.setattr(jaccard, "_compare", counted)
    none = spark.createDataFrame([], "a long, b long")
    found = jaccard.components(jaccard._across(sets, none, join), "a", "b").collect()
    assert sorted((r["node"], r["component"]) for r in found) == [(i, i // 3 * 3) for i in range(120)]
    assert len(rows) > 1 and max(rows) <= 120 * jaccard.COPIES


def test_a_sieve_lets_through_all_ids_and_few_others(spark):
    ids = spark.createDataFrame([(i * 37 - 5000,) for i in range(400)] + [(None,), (-(1 << 63),)], "x long")
    some = common.sieve(ids, "x")
    each = spark.range(-6000, 12000).withColumn("may", some(F.col("id"))).where("may")
    found = {r["id"] for r in each.collect()}
    wanted = {i * 37 - 5000 for i in range(400)}
    assert wanted <= found and len(found) < len(wanted) + 20
    assert ids.where(some(F.col("x"))).count() == 402
    assert spark.range(1000).where(common.sieve(ids.where("false"), "x")(F.col("id"))).count() == 0
