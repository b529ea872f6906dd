"""Readers and writers: golden questions, human labels, result dumps, the chunk index, datasets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = "experiment string, question string, key string, lesson string, judge_score int, human_score int, judge_reasoning string"
RESULT_SCHEMA = "experiment string, system string, model string, judge_model string, rows array<struct<run_id:string,id:string,category:string,question:string,should_answer:string,expected_answer:string,answer:string,refused:boolean,citations:array<string>,error:string,latency_s:double,scores:map<string,struct<score:int,comment:string>>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], schema: str = "path string, page int, text string") -> DataFrame:
    """Pages of binary files, such as PDF, by a function of a file's bytes that runs on the executors; none for a missing path.

    Extraction is a boundary: no PDF library is part of this engine. A file is one row until it is extracted.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = extract(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages), pa.string()), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(pages, pa.string())], ["path", "page", "text"])

    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def join_pages(pages: DataFrame) -> DataFrame:
    """path, text: the pages of each file, one line end between them."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A table from CSV in place of a sheet: rows whose first cell is blank are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.filter(F.trim(F.coalesce(F.col(f"`{raw.columns[0]}`"), F.lit(""))) != "")


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A table and its summary (metric, score, n), each as CSV beside the other."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def read_golden(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Golden questions from CSV: headers and values trimmed, rows without a question dropped, should_answer "yes" by default."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    df = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])
    if "should_answer" in df.columns:
        df = df.withColumn("should_answer", F.coalesce(F.nullif("should_answer", F.lit("")), F.lit("yes")))
    if "dataset_split" in df.columns:
        df = df.withColumn("dataset_split", F.from_json("dataset_split", "array<string>"))
    return df.filter(F.coalesce(F.col("question"), F.lit("")) != "")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels from JSON; a missing file, or one that is no JSON, is an empty table."""
    if not _exists(spark, path):
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in LABEL_SCHEMA.split(", "))])
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(path).filter("question is not null")


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels after a merge (operators.labels.merge_labels) without those deleted; replaces what is at path."""
    kept = labels.filter(F.col("action") != "delete").drop("action") if "action" in labels.columns else labels
    kept.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, costs: DataFrame | None = None) -> DataFrame:
    """Result rows of a dump, with cost by run_id where known."""
    rows = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path).select("experiment", "system", "model", F.explode("rows").alias("r")).select("experiment", "system", "model", "r.*")
    return rows.withColumn("cost", F.lit(None).cast("double")) if costs is None else rows.join(costs.select("run_id", "cost"), "run_id", "left")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON, without contexts."""
    rows.drop("contexts").write.mode("overwrite").json(path)


#: Parts of an index by a hash of chunk_id: an upsert rewrites only those that its rows fall in.
INDEX_PARTS = 64


def upsert_index(chunks: DataFrame, path: str, reset: bool = False) -> None:
    """Write chunks by chunk_id: new rows replace old ones, others stay; reset drops what was there. Nulls of metadata become ''.

    New parts are written beside the old ones; then the pointer, which names the folder of each part, is written aside
    and renamed over the old one. Readers see the index before or after, and a crash leaves it as it was.
    """
    spark = chunks.sparkSession
    text = [f.name for f in chunks.schema if f.dataType.simpleString() == "string" and f.name != "chunk_id"]
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(INDEX_PARTS)).cast("int")
    new = chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in text}).drop("part").withColumn("_part", part)
    known = {} if reset else _pointer(spark, path)
    if known:
        touched = sorted({str(r[0]) for r in new.select("_part").distinct().collect()})  # at most INDEX_PARTS
        old = [known[p] for p in touched if p in known]
        if old:
            kept = spark.read.parquet(*old).withColumn("_part", part).join(new.select("chunk_id"), "chunk_id", "left_anti")
            new = new.unionByName(kept, allowMissingColumns=True)
    target = f"{path}/gen-{uuid.uuid4().hex}"
    new.write.partitionBy("_part").parquet(target)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    written = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(target))]
    now = known | {n.partition("=")[2]: f"{target}/{n}" for n in written if n.startswith("_part=")}
    aside = hadoop.Path(f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    rename = getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), conf).rename(aside, hadoop.Path(f"{path}/CURRENT"), over)


def _pointer(spark: SparkSession, path: str) -> dict[str, str]:
    """part -> folder of the current index; empty where there is none."""
    if not _exists(spark, f"{path}/CURRENT"):
        return {}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    data = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    return data


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The current index."""
    return spark.read.parquet(*_pointer(spark, path).values())


def write_dataset(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Write a dataset; one that exists is only replaced on request."""
    rows.write.mode("overwrite" if replace else "errorifexists").parquet(path)
