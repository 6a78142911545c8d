"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline
from kelpline.llm import language, pipeline, quality
from kelpline.llm.queries import language_model, quality_model
from tests.llm.test_operators import components_by_force, shingles

SF = "/root/testdata/sf0.001"


def test_stages_filter_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    model, net = language_model(spark, SF), quality_model(spark, SF)
    alive = set(texts)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == columns
        got = {r.doc_id for r in kept.collect()}
        if name == "language_id":
            found = dict(zip(texts, language.predict_texts(model, list(texts.values()), {}), strict=True))
            want = {i for i in alive if found[i][0] != "und" and found[i][2] >= pipeline.CONFIDENCE}
        elif name == "quality_classifier":
            want = {i for i in alive if net.score([texts[i]])[0] >= 0.7}
        else:
            groups = components_by_force([(i, shingles(texts[i], 5)) for i in sorted(alive)], 80)
            want = {i for i in alive if groups[i] == i}
        assert got == want
        alive = want
    assert len(alive) > 0.5 * len(texts)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == alive


def test_stages_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "words " * 30, "en", "s", 5)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).count() >= 0
