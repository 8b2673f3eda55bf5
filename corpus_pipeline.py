"""The corpus pipeline: toxicity, line dedup, near dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written and reread
before the next one. All but the last return the columns of `docs`, further ones than those of `documents` too, whatever their names.

Nulls and ties, stage by stage: a null text scores as an empty one and stays null through toxicity and line dedup; it shares the near-dedup group of all texts
without words; the mix takes no words of it, so it ends there, like every text without words. A null doc_id is the last of all ids; it never wins over another. Rows alike in
doc_id and text share their fate until near dedup, which keeps one of them. A null source is a source of its own. Empty tables give no rows. `n_chars`, where
there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, mixing, packing, simhash, toxicity
from weftline.llm.common import fresh, saved, table


def _sized(docs: DataFrame) -> DataFrame:
    """`n_chars` follows a text that a stage has cut; all other columns stay."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score the threshold or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score, = fresh(docs, "score")
    return model.score(docs, "text", score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that an earlier line matches are cut; every document stays, with an empty text if it has lost all its lines."""
    return _sized(line_dedup.dedup_lines(docs, min_words=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of linked documents the one with the smallest doc_id stays."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents as the mix takes them, one row for each time around; words that are not drawn are left out."""
    return _sized(mixing.mixed_texts(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Learned classifiers and similarity joins aren't expressed in SQL; each stage is held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
