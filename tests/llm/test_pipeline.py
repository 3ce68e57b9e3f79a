import corpus_pipeline
from pyspark.sql import functions as F

from shoptide.llm import mixing, near_texts, secret_scan
from shoptide.llm.common import components
from tests.llm.data import FOLDER, documents, empty, odd


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        ids, old = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, before))
        if k == 0:
            assert ids == old  # all of them have letters
        elif k == 1:
            found = near_texts.near_duplicates(before).collect()
            assert ids == {r.class_id for r in found} and docs.count() == len(ids)
        elif k == 2:
            assert ids == old
            texts = {r.doc_id: r.text for r in before.collect()}
            dirty = {r.doc_id for r in secret_scan.scan(before).where(F.size("spans") > 0).collect()}
            assert {r.doc_id for r in docs.collect() if r.text != texts[r.doc_id]} == dirty
            assert secret_scan.scan(docs).where(F.exists("spans", lambda s: s["place"] < 3)).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        elif k == 3:
            assert docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix(before).agg(F.sum("taken")).first()[0]
        else:
            assert docs.count() == before.count() and docs.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_every_stage_takes_odd_rows(spark):
    for rows in (documents(spark, odd()), empty(spark)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, rows, FOLDER)
            assert k == 4 or found.columns == rows.columns
            assert found.count() <= 2 * rows.count()
    kept = corpus_pipeline.STAGES[1][1](spark, documents(spark, odd()), FOLDER).collect()
    assert sum(r.doc_id in (6, 7) for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    assert sum(r.text is None for r in kept) == 2
    clean = {r.doc_id: r for r in corpus_pipeline.STAGES[2][1](spark, documents(spark, odd()), FOLDER).collect()}
    assert (clean[12].text, clean[12].n_chars) == ("[SECRET]", 8) and clean[9].text == "x\ny  z\t"


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300), (250, 300), (250, 260), (50, 60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100}
    assert {found[i] for i in (200, 250, 260, 300)} == {200} and found[60] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
