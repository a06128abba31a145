"""Shared helpers: shared-folder tables, document keys, Arrow column access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Stands for a null doc_id wherever documents are told apart: all rows without an id are one document.
NULL_ID = -(2**63)

WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/tidewater/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove what this application's operators have written, once their results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs, with dk (doc_id, nulls as NULL_ID) and text never null."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dk"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *columns,
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int, *columns) -> pa.Table:
    """(h, dk, label, th, text, the columns) of at most fit_rows labelled texts of fit_bytes bytes in all.

    labels: doc_id, label. Those with the least hash of doc_id are taken, in this order, up to the first with which
    the texts are too large; a text and label that are repeated count once, as do repeated label rows.
    """
    spark, order = docs.sparkSession, ["h", "dk", "label", "th"]
    some = labels.select(F.col("doc_id").cast("long").alias("dk"), "label").where("dk is not null and label is not null").distinct()
    some = some.withColumn("h", F.xxhash64("dk")).orderBy("h", "dk", "label").limit(fit_rows)
    rows = keyed(docs, *columns).join(F.broadcast(some), "dk").withColumn("th", F.xxhash64("text"))
    sizes = rows.select(*order, F.octet_length("text").cast("long").alias("n")).distinct().orderBy(*order).limit(fit_rows)
    sizes = sizes.toArrow()  # at most fit_rows rows of five small columns
    count = int((np.cumsum(sizes.column("n").to_numpy()) <= fit_bytes).sum())
    names = [f.name for f in rows.schema if f.name not in (*order, "text")]
    wanted = spark.createDataFrame(sizes.select(["dk", "label", "th"]).slice(0, count).to_pandas(), f"dk long, label {some.schema['label'].dataType.simpleString()}, th long")
    found = rows.join(F.broadcast(wanted), ["dk", "label", "th"]).groupBy(*order).agg(*(F.first(c).alias(c) for c in ("text", *names)))
    return found.toArrow().combine_chunks().sort_by([(c, "ascending") for c in order])


def real_id(column: str = "dk"):
    """dk back to doc_id."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def marked(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are free in it, that hold dk and the text's xxhash64."""
    dk, th = (next(f"_{n}{i}" for i in range(len(docs.columns) + 1) if f"_{n}{i}" not in docs.columns) for n in ("dk", "th"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({dk: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), th: F.xxhash64(text)}), dk, th


def only(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """The rows of docs with (how: left_semi) or without (left_anti) a row of decided (dk, th)."""
    rows, dk, th = marked(docs)
    keys = decided.select(F.col("dk").alias(dk), F.col("th").alias(th))
    return rows.join(keys, [dk, th], how).select(*docs.columns)


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows in them, without copying rows."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch whose string column holds about limit bytes at most (one row may hold more)."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
