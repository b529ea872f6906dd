"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def base_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir; where unset, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


class Workspace:
    """A folder of its own for one operator run; tables written here survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{base_dir(spark)}/provlake/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts the lineage with a table that any executor can read."""
        self._n += 1
        path = self.file(f"{self._n}-{name}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove the files behind df, or the whole workspace."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = {self.path} if df is None else {p.rpartition("/")[0] for p in df.inputFiles()}
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns; extra columns of any name go no further."""
    return df.select(*[df[n] for n in names])


def row_key(documents: DataFrame) -> Column:
    """A key of doc_id and text, never null: filters that judge rows go by it, for a doc_id can be null or repeat."""
    return F.xxhash64(documents["doc_id"].cast("long"), documents["text"].cast("string"))


#: Keys that are looked up in a broadcast at most.
HOT_KEYS = 1024


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of left with right (one row a key) that no frequent key slows: weight is how many rows of left, of
    ``total``, have right's key. Keys of more than a 1024th of the rows, of which there are fewer than 1024, are
    looked up in a broadcast; the others meet by a shuffle. weight is left out of the result."""
    rest = [c for c in right.columns if c not in (key, weight)]
    is_hot = F.col(weight) * HOT_KEYS > total
    hot = right.filter(is_hot).select(key, F.struct(*rest).alias("_hot"))
    marked = left.join(F.broadcast(hot), key, "left")
    cold = marked.filter("_hot is null").drop("_hot").join(right.filter(~is_hot).drop(weight), key)
    return marked.filter("_hot is not null").select(*left.columns, "_hot.*").unionByName(cold.select(*left.columns, *rest))
