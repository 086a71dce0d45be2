"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage works on all documents that its predecessor kept, written as Parquet
and read again.  All but the last return the columns of documents.

- toxicity drops documents scored toxic by the models learnt from ``labels``.
- quality_rules drops documents that fail the countable rules or lie outside their
  language's perplexity band.
- minhash_dedup keeps one document (the smallest id) of each group of texts linked
  by a similarity of five-word shingles of 0.8 or more.
- suffix_dedup removes every passage of ``PASSAGE_BYTES`` bytes or more that occurs
  at two places or more from all of them (whole characters only); a document of which nothing is left stays, empty.
- packing cuts the token streams into sequences of at most 2048 tokens.

Columns of the input may have any names: inside a stage they go by numbers, so that none
clashes with a result of its operator.  Empty documents tables pass through.

ORACLE_SQL is None: SQL can express neither the learnt models nor the packing.
tests/llm/test_pipeline.py holds each stage, with these parameters, against plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import arrays, minhash_dedup, packing, quality_rules, suffix_dedup, toxicity

#: Passages of over 50 words are longer than this.
PASSAGE_BYTES = 200


KEY, TEXT, LANG = "doc_id", "text", "lang"


class Apart:
    """docs with numbered columns, and the way back to their names."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*[f"_{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        return f"_{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.docs.columns).toDF(*self.names)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = Apart(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col(KEY).alias(x.of(KEY)), "toxic")
    return x.back(toxicity.score(x.docs, labels, x.docs.columns, x.of(KEY), x.of(TEXT)).filter(F.col("predicted") == 0))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = Apart(docs)
    return x.back(quality_rules.judge(x.docs, x.docs.columns, x.of(TEXT), x.of(LANG)).filter("kept"))


def minhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = Apart(docs)
    return x.back(minhash_dedup.dedup(x.docs, x.of(KEY), x.of(TEXT)))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = Apart(docs)
    left = suffix_dedup.cut(x.docs, x.docs.columns, x.of(TEXT), PASSAGE_BYTES, whole_characters=True).withColumn(x.of(TEXT), F.col("kept").cast("string"))
    if "n_chars" in x.names:
        left = left.withColumn(x.of("n_chars"), F.char_length(x.of(TEXT)).cast("long"))
    return x.back(left)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_rules_stage),
    ("minhash_dedup", minhash_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = arrays.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
