"""A corpus pipeline of five stages, each reading what the one before kept.

Stages but the last return the columns of documents (and any others they were given); n_chars follows
the text. Each stage defines null texts and ids, empty tables and repeated rows as its operator does:
rows without doc_id pass, except that of those in one near-duplicate group one stays and that mixing draws
them as it draws others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, line_dedup, mixing, quality, simhash
from tidewater.llm.common import NULL_ID, marked, only, real_id, table

#: Documents that must hold a line for its later occurrences to go.
LINE_DOCUMENTS = 10


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity is above their language's threshold."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return only(docs, quality.perplexities(docs, trusted).where("not kept"), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that LINE_DOCUMENTS documents or more hold stay at their first occurrence only."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(rest)))
    maps = line_dedup.keep_bitmaps(plain, min_docs=LINE_DOCUMENTS)
    done = line_dedup.drop_lines(plain, maps, *(f"x{i}" for i in range(len(rest))))
    named = done.select(real_id(), "text", *(F.col(f"x{i}").alias(c) for i, c in enumerate(rest)))
    if "n_chars" in rest:
        named = named.withColumn("n_chars", F.length("text").cast("long"))
    return named.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates."""
    first = simhash.similar_classes(docs).where("component_id is null or doc_id = component_id")
    keys = first.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("dk")).distinct()
    rows, dk, th = marked(docs)
    kept = rows.join(keys.withColumnRenamed("dk", dk), dk, "left_semi").dropDuplicates([dk, th])
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their rates: none, one or more copies of each. The clean domain has as many tokens as before."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.expr(mixing.DOMAIN).alias("domain"))
    found = mixing.mixed(docs, labelled, mixing.WEIGHTS, "clean")
    rows, dk, th = marked(docs)
    drawn = found.where(mixing.copies() > 0).groupBy(F.col("dk").alias(dk), F.col("th").alias(th)).agg(F.max(mixing.copies()).alias(f"{th}_n"))
    times = F.explode(F.sequence(F.lit(1), F.col(f"{th}_n"))).alias(f"{th}_i")
    return rows.join(drawn, [dk, th]).select("*", times).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): round_trip if the decoded ids are the text's bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = byte_bpe.encode_checked(docs, path, public_tokenizers.PATTERN, "lang", "source")
    return done.select(real_id(), "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", encode_stage),
]
#: The models and the search for classes are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
