"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from rategrid.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    This cuts lineage like ``checkpoint()`` but keeps columns apart and compressed, so later readers take what they need.
    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    # snappy: many short tasks of a codec with native contexts hold memory outside the heap until garbage collection
    df.write.option("compression", "snappy").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)
