"""Columns of documents whose names operators use themselves stay as they are."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import mixing, packing, quality, sharding, simhash, toxicity

NAMES = [
    "_hash", "_doc", "_parts", "_source", "_name", "lap", "block", "held", "parts", "own_id", "own_hash", "own_source", "text_hash", "from_word", "n_words", "slot", "most", "_start",
    "_key", "key", "kept", "fp", "component", "component_id", "least", "_id", "_y", "_p", "pos", "unl", "score", "_text", "_score", "x", "size", "shard", "_arc", "_place", "_rank", "_chunk", "_value",
    "_seat", "_q_chars", "_q_w", "_q_l", "length", "piece", "start", "label", "n", "t", "target", "source_size", "taken", "mdoc", "line", "row",
]


def made(spark):
    rows = [(i, f"word{i} and {'more ' * (i % 3)}of the text{i}", "s", *range(len(NAMES))) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in NAMES))


def same(got, docs, but=()):
    assert got.columns == docs.columns
    assert all(tuple(r[n] for n in NAMES if n not in but) == tuple(i for i, n in enumerate(NAMES) if n not in but) for r in got.collect())


def test_whole_rows_stay(spark):
    docs = made(spark)
    same(mixing.mixed_texts(docs), docs)
    same(simhash.one_of_each_group(docs), docs)
    model = toxicity.ToxicityModel({1: 0}, np.zeros((1, 2)), 0.5)
    same(model.score(docs, "text", "score"), docs, ["score"])
    ensemble = quality.RuleEnsemble([(((0, True, 3.0),), 1.0)], 0.0)
    scored = ensemble.score(docs, "text", "points")
    assert scored.columns == [*docs.columns, "points"]
    same(scored.drop("points"), docs)


def test_other_operators_ignore_them(spark):
    docs = made(spark)
    assert mixing.mix_documents(docs).count() == packing.pack_documents(docs).count() == sharding.assign_shards(docs, 3).count() == 20
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), (F.col("doc_id") % 2).alias("quality"), "_id", "_y", "_p", "text")
    assert toxicity.toxicity_scores(docs, labels).count() == quality.quality_scores(docs, labels).count() == 20


def test_pipeline_stages_keep_them(spark, tmp_path):
    import corpus_pipeline

    docs = made(spark)
    spark.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        same(stage(spark, docs, str(tmp_path)), docs)
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
