"""The queries opN_<name> over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    got = q.judge(_read(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    got = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ["doc_id"])
    return got.select("doc_id", "held_out", "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    got = sharding.assign(_read(spark, sf_dir, "documents"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier

    return quality_classifier.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    got = suffix_dedup.cut(_read(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup

    return minhash_dedup.link(_read(spark, sf_dir, "documents"), width=3, numerator=85, denominator=100)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format as c

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    got = c.format_tree(c.chains(rows, "conv_id", "turn", "role", "text"))
    got = got.select(F.col("conv").alias("conv_id"), "formatted", c.read_back(F.col("formatted")).alias("turns"), c.learned(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    hexed = lambda x: F.sha2(x.cast("binary"), 256)
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hexed(lines).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), hexed(F.col("learned")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    got = byte_bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["doc_id"], decode=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    got = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

#: The other queries' models, searches and packings are tested against brute force instead, but for op4's scores.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": r"""WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn), '') AS learned,
  sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS formatted_chars FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said""",
}
