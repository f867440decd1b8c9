"""The quality model on held-out labels and odd texts, and the pipeline stage by stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickweave.llm.common import crc_mod, table
from tickweave.llm.line_quality import keep_good, train_quality, with_quality
from tickweave.llm.queries import op8_line_quality
from tickweave.llm.sentencepiece_trie import decode

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels_are_told_apart(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    rows = op8_line_quality(spark, FOLDER).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert better / (len(good) * len(bad)) > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    may = crc_mod(F.col("doc_id"), 4) != 2
    turned = labels.withColumn("quality", F.when(may, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (with_quality(docs, train_quality(docs, x, may)).agg(F.sum("score")).first()[0] for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("quality", [[1, 1], [0, 0], []])
def test_odd_labels_and_texts(spark, quality):
    texts = [None, "", " \n ", "One good line.\n" * 100_000, "x", "The same.", "The same."]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(k + 4, q) for k, q in enumerate(quality)], "doc_id long, quality int")
    scored = with_quality(docs, train_quality(docs, labels, F.lit(True)))
    assert scored.columns == ["doc_id", "text", "score"]
    assert all(0 <= r.score <= 1 for r in scored.select("score").collect())
    kept = keep_good(docs, train_quality(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns and keep_good(docs.limit(0), train_quality(docs, labels, F.lit(True))).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    names, before = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["quality", "near_duplicates", "pii", "mix", "tokens"]
    steps = {}
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, before, FOLDER)
        after.write.parquet(str(tmp_path / name))
        before = steps[name] = spark.read.parquet(str(tmp_path / name))
        assert before.columns[: len(docs.columns)] == docs.columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in steps.items()}
    scores = {r.doc_id: r.predicted for r in op8_line_quality(spark, FOLDER).collect()}
    assert sorted(ids["quality"]) == sorted(d for d, p in scores.items() if p)
    assert set(ids["near_duplicates"]) < set(ids["quality"]) and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    assert sorted(ids["pii"]) == sorted(ids["near_duplicates"])
    old = {r.doc_id: r.text for r in steps["near_duplicates"].collect()}
    new = {r.doc_id: r for r in steps["pii"].collect()}
    changed = [d for d in new if new[d].text != old[d]]
    assert 0 < len(changed) < len(new) / 3 and all("@example.invalid" in new[d].text or any(c.isdigit() for c in old[d]) for d in changed)
    assert all(r.n_chars == len(r.text) for r in new.values())
    assert set(ids["mix"]) <= set(ids["pii"]) and sorted(ids["tokens"]) == sorted(ids["mix"])
    back = decode(steps["tokens"])
    assert back.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0


def test_pipeline_takes_clashing_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(20).withColumn("IDS", F.lit("x"))
    done = corpus_pipeline.tokens(spark, docs, FOLDER)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"] and done.count() == 20
