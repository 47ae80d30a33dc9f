"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the caller writes it as
Parquet and reads it again as the next stage's ``docs``, so a lost executor costs tasks of one
stage only. All but the last return the columns of ``documents``; other columns pass through.

1. toxicity: documents that the classifier chain rejects go.
2. line_dedup: lines that repeat an earlier one within one edit go; ``n_chars`` follows the text;
   documents of which no word is left go with their last line.
3. near_dedup: one document of each class of near duplicates stays, the one with the least id.
4. decontamination: documents that hold a passage of a benchmark item go.
5. encode: token ids of every text, and digests of the ids and of the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import bpe, decontamination, lines, near_dups, toxicity
from tidemart.llm.common import WORD_PATTERN, cut, ship_package, table

#: No stage but the last is plain SQL: a trained model, edit-distance and set-similarity joins.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.dedup_rows(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD_PATTERN))

    def column(name: str) -> Column:
        own = F.col("_row")[name]
        if name == "n_chars":
            kind = docs.schema["n_chars"].dataType
            return F.when(F.col("n_removed") == 0, own).otherwise(F.char_length("text").cast(kind)).alias(name)
        return F.col("text") if name == "text" else own.alias(name)

    return found.select(*(column(name) for name in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)
    return decoded.select("doc_id", "n_tokens", "ids", "ids_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
