"""Queries that write files in the shared folder and read them back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators import usage
from seqlab.plans.register import query, table
from seqlab.sources import tables


def _new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(shared or '/tmp/checkpoints').rstrip('/')}/seqlab-{tag}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have gone first; the files are only left behind
            pass

    atexit.register(delete)
    return path


@query("SELECT f.format, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier CROSS JOIN (VALUES ('csv'), ('tsv')) f(format)")
def text_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV and as TSV with an index column and an unnamed one, and read without either (IO1-IO5)."""
    rows = table(spark, sf_dir, "supplier").select(F.monotonically_increasing_id().alias("index"), F.lit(0).alias("Unnamed: 0"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    read = []
    for name, sep in (("csv", ","), ("tsv", "\t")):
        path = _new_path(spark, name)
        tables.write_csv(rows, path, sep=sep)
        back = tables.drop_unnamed(tables.read_csv(spark, path, schema=rows.schema, sep=sep, index=True))
        read.append(back.withColumn("format", F.lit(name)))
    return read[0].unionByName(read[1])


@query("SELECT DISTINCT p_size AS old, p_size % 10 AS new FROM part")
def merge_map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge map written under the original tools' names and read again (IO6, U6)."""
    pairs = usage.label_map(table(spark, sf_dir, "part").select(F.col("p_size").alias("old"), (F.col("p_size") % 10).alias("new")), "old", "new")
    path = _new_path(spark, "merge-map")
    tables.write_merge_map(pairs, path)
    back = tables.read_csv(spark, path, schema="old int, new int")
    return back.select("old", "new")
