import os
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import lines_of, similar
from tests.llm.test_simhash import brute as fingerprint_groups
from tests.llm.test_simhash import plain_fingerprint
from tests.llm.test_toxicity import made
from weftline.llm import toxicity


def tables(spark, tmp_path):
    docs, labels, rows = made(spark, 240)
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [(5000 + i, f"start{i} of a text number{i} here\n{passage} z{i}\nlast{i} words of the text{i}", "en", f"src{i % 3}") for i in range(12)]
    extra += [(6000 + i, extra[0][1], "en", "src1") for i in range(5)] + [(None, "some text without any id at all", None, None), (7000, None, "en", None), (7001, "", "en", "src0")]
    every = rows + extra
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_one_by_one(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = f"{d}/{len(seen)}.parquet"
        out.write.parquet(path)
        seen.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and docs.where(F.col("n_chars") != F.length("text")).isEmpty()
    (a, b), (_, c), (_, e), (_, mixed), (_, packed) = seen
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    want = Counter((r.doc_id, r.text) for r, score in zip(a, model.score_texts([r.text for r in a])) if score < 0.3)
    assert Counter((r.doc_id, r.text) for r in b) == want and len(a) - len(b) >= 20

    assert Counter(r.doc_id for r in b) == Counter(r.doc_id for r in c)
    texts = [(r.doc_id, r.text) for r in b]
    gone = set()
    ordered = lines_of(texts)
    for k, (doc, i, own, text) in enumerate(ordered):
        if any((x, t) != (doc, text) or j != i for x, j, other, t in ordered[:k] if similar(own, other)):
            gone.add((doc, i))
    last = (1 << 63) - 1
    want = Counter((doc, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (last if doc is None else doc, i) not in gone)) for doc, t in texts)
    assert Counter((r.doc_id, r.text) for r in c) == want

    prints = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in c}
    signed = lambda x: x - 2**64 if x >> 63 else x
    comp = fingerprint_groups({signed(p) for p in prints.values()})
    least = {}
    for (i, _), p in prints.items():
        g = comp[signed(p)]
        least[g] = min(least.get(g, last), last if i is None else i)
    assert sorted(last if r.doc_id is None else r.doc_id for r in e) == sorted(least.values())
    assert sum(r.length for r in packed) == sum(r.length for r in packed if 0 < r.length <= 4096) and {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_run_and_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, d)
    assert got.count() > 0 and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
    empty = os.path.join(d, "empty")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
