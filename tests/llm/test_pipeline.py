"""The stages of the pipeline, each on its own, and the run against a plain version of each step."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gradpath.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, rep string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted copies, leaks and toxic texts, and columns with clashing names."""
    d, rng = tmp_path_factory.mktemp("tables"), random.Random(9)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    bench = [(k, " ".join(fresh(25))) for k in range(5)]
    docs, kind = [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", f"s{len(docs) % 4}" if len(docs) % 9 else None, None, 3, "x"))

    for k in range(300):
        w = fresh(rng.randint(30, 80))
        if k % 5 == 0:
            w[3:3] = ["vile", "scum"]
        add(" ".join(w), "toxic" if k % 5 == 0 else "clean")
    for k in (1, 2, 3):
        add(docs[k][1].upper(), "copy")
        w = docs[k + 5][1].split()
        add(" ".join(w[:10] + ["changed"] + w[10:]) if k != 1 else " ".join(docs[6][1].split() + ["more"]), "near")
        add(" ".join(fresh(20)) + " " + bench[k][1], "leak")
    add(None, "clean")
    add("", "copy")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, int(kind[i] == "toxic")) for i in range(300)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), kind, {r[0]: r for r in docs}


def test_every_stage_keeps_columns_and_decides(spark, tables):
    d, kind, docs = tables
    now = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    left = ids(now)
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        gone, left = set(left) - set(ids(now)), ids(now)
        if name == "toxicity":
            assert len(gone) >= 50 and all(kind[i] == "toxic" for i in gone)
        if name == "exact_dedup":
            assert {docs[i][1] for i in gone} == {docs[i][1] for i in (1, 2, 3)} | {None}
        if name == "near_dedup":
            assert all(kind[i] == "near" for i in gone) and gone
        if name == "decontamination":
            assert all(kind[i] == "leak" for i in gone) and len(gone) == 3


def test_run_ends_in_the_mix(spark, tables):
    d, kind, _ = tables
    got = cp.run(spark, d)
    assert got.columns[-3:] == ["copy", "source_words", "source_target"]
    taken = got.withColumn("w", mixing.word_count(F.col("text"))).groupBy("source").agg(F.sum("w").alias("w"), F.first("source_target").alias("t")).collect()
    assert len(taken) == 5 and all(abs(r["w"] - r["t"]) <= 100 for r in taken)
    assert {kind[r["doc_id"]] for r in got.select("doc_id").distinct().collect()} <= {"clean", "copy", "near", "toxic"}


def test_empty_tables(spark, tables, tmp_path):
    d = tables[0]
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


CLASHING = ["id", "ID_", "gone", "sha", "own_sha", "of", "size", "copies", "words", "target", "row", "taken", "_id", "_gone", "_sha", "_source", "_size", "_copies", "_n",
            "_row", "h", "n", "s", "keep_id", "key", "norm", "rep", "component", "kept", "n_shingles", "class", "item_id", "score", "toxic", "place", "f1", "bands", "fp", "a", "b"]


def test_stages_with_clashing_columns(spark, tables):
    """Extra columns of any internal name change nothing and come through as they are."""
    d, _, _ = tables
    plain = spark.read.parquet(f"{d}/documents.parquet").drop("copies", "rep")
    extra = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for _, stage in cp.STAGES:
        want, got = stage(spark, plain, d), stage(spark, extra, d)
        assert got.columns == extra.columns + want.columns[len(plain.columns):]
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in want.collect())
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING)
    own = plain.withColumns({"copy": F.lit("x"), "Source_Words": F.lit("y")})
    got = mixing.mixed_documents(own)
    assert got.columns == [*plain.columns, "copy", "source_words", "source_target"] and dict(got.dtypes)["copy"] == "int"
