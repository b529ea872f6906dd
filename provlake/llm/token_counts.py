"""Delta-maintained token counts: signed deltas by source, language and tokenizer version, committed by batch.

Counts are of a public tokenizer's ids; a version is the name of its file. A ledger is a folder with a state by
key, in ``PARTS`` parts by a hash of the key, and, for each batch, a rollup of signed deltas; totals are the sum of
the committed deltas and need no document. A batch of events (insert, delete, revise) reads and writes only the
parts that its keys fall in. Its files go to a folder of the attempt, and one marker, written aside and renamed
without overwriting, commits it: a crash leaves the ledger as it was, and of two writers one fails. A batch that is
delivered again, whole or after a crash, changes nothing.

Events: key, tokenizer_version, op, source, lang, n_docs, n_tokens, seq. A key names the rows that stand and fall
together; ``row_events`` makes one of doc_id, text, source and language, and counts equal rows in n_docs, so that
null and repeated doc_ids lose nothing. Of several events for one key and version in a batch, the last by seq
counts (ties: the larger op, then n_docs, then n_tokens). An insert or revise of a known key replaces what it had,
a delete of an unknown one does nothing. A null key or op fails the batch. Null sources, languages, versions are
values like others; null n_docs and n_tokens count as 0; an empty batch commits no deltas. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_output import Encoder
from .workspace import join_hot

#: Parts of the state, and rows for each file of a part.
PARTS, FILE_ROWS = 64, 2_000_000
_KEY = ["key", "tokenizer_version"]
_GROUP = ["source", "lang", "tokenizer_version"]
_VALUE = ["source", "lang", "n_docs", "n_tokens"]
_STATE = "key string, tokenizer_version string, source string, lang string, n_docs long, n_tokens long"
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = hadoop.Path
        self._fs = self._Path(path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._Path(path).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        self._fs.mkdirs(self._Path(f"{path}/commits"))

    def commits(self) -> list[dict]:
        """Committed batches in order: batch, attempt (a folder), parts (part -> attempt that has its state) and rows (at most) of the state."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/commits"))]
        out = []
        for n in sorted(x for x in names if x.isdigit()):
            stream = self._fs.open(self._Path(f"{self.path}/commits/{n}"))
            out.append(json.loads(bytes(stream.readAllBytes())))
            stream.close()
        return out

    def _commit(self, number: int, entry: dict) -> None:
        aside = self._Path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._files.rename(aside, self._Path(f"{self.path}/commits/{number:012d}"), self._no_overwrite)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])

    def state(self, parts: set[int] | None = None) -> DataFrame:
        """What is known by key, of some parts or of all."""
        done = self.commits()
        known = {int(p): a for p, a in done[-1]["parts"].items() if parts is None or int(p) in parts} if done else {}
        if not known:
            return self._empty(_STATE)
        return self.spark.read.schema(_STATE).parquet(*[f"{self.path}/attempts/{a}/state/_part={p}" for p, a in sorted(known.items())])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens: the sum of all committed deltas; groups of no documents are gone."""
        done = self.commits()
        if not done:
            return self._empty(_DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/attempts/{c['attempt']}/deltas" for c in done])
        return deltas.groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch_id: str, events: DataFrame) -> bool:
        """Apply a batch; False if it was committed before."""
        done = self.commits()
        if batch_id in {c["batch"] for c in done}:
            return False
        name = uuid.uuid4().hex
        attempt = f"{self.path}/attempts/{name}"
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
        given = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"an event without {c}")))
        text, number = lambda c: F.col(c).cast("string").alias(c), lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
        ev = events.select(given("key").alias("key"), text("tokenizer_version"), given("op").alias("op"), text("source"), text("lang"), number("n_docs"), number("n_tokens"), F.col("seq").cast("long").alias("seq"))
        last = ev.groupBy(*_KEY).agg(F.max(F.struct("seq", "op", "n_docs", "n_tokens", "source", "lang")).alias("e")).select(F.col("key").alias("e_key"), F.col("tokenizer_version").alias("e_version"), "e")
        # at most PARTS rows
        counts = {r.p: r["count"] for r in ev.select(part.alias("p")).groupBy("p").count().collect()}
        touched = set(counts)
        n_rows = sum(counts.values()) + (done[-1]["rows"] if done else 0)  # at most
        files = max(1, -(-n_rows // (PARTS * FILE_ROWS)))
        old = self.state(touched).select(*_KEY, F.struct(*_VALUE).alias("s"))
        both = old.join(last, (old["key"] == last["e_key"]) & old["tokenizer_version"].eqNullSafe(last["e_version"]), "full")
        changed = F.col("e").isNotNull()
        both = both.select(F.coalesce("e_key", "key").alias("key"), F.when(changed, F.col("e_version")).otherwise(F.col("tokenizer_version")).alias("tokenizer_version"), "s", "e")
        kept = F.when(~changed, F.col("s")).when(F.col("e.op") != "delete", F.struct(*[F.col(f"e.{c}").alias(c) for c in _VALUE]))
        state = both.select(*_KEY, kept.alias("n")).filter("n is not null").select(*_KEY, "n.*").withColumn("_part", part)
        # each task writes one file of one part
        dealt = state.repartition(PARTS * files, "_part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(files)))
        dealt.write.partitionBy("_part").parquet(f"{attempt}/state")
        # signed rows of the keys that the batch touches: what they had goes, what they have comes
        minus = both.filter(changed & F.col("s").isNotNull()).select("s.source", "s.lang", "tokenizer_version", (-F.col("s.n_docs")).alias("n_docs"), (-F.col("s.n_tokens")).alias("n_tokens"))
        plus = both.filter("e.op <> 'delete'").select("e.source", "e.lang", "tokenizer_version", "e.n_docs", "e.n_tokens")
        deltas = minus.unionByName(plus).groupBy(*_GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        deltas.select("source", "lang", "tokenizer_version", "n_docs", "n_tokens").write.parquet(f"{attempt}/deltas")
        parts = {int(p): a for p, a in done[-1]["parts"].items() if int(p) not in touched} if done else {}
        parts |= {p: name for p in self._written(attempt)}
        self._commit(len(done), {"batch": batch_id, "attempt": name, "parts": parts, "rows": n_rows})
        return True

    def _written(self, attempt: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{attempt}/state"))]
        return [int(n.partition("=")[2]) for n in names if n.startswith("_part=")]


_ENCODERS: dict[str, Encoder] = {}


def _counter(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in paths:
            if p not in _ENCODERS:
                _ENCODERS[p] = Encoder(p)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            counts = [pa.array(_ENCODERS[p].counts(text), pa.int64()) for p in paths]
            rest = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *counts], ["doc_id", "source", "lang", "h", *(f"n{i}" for i in range(len(paths)))])

    return run


def row_events(documents: DataFrame, tokenizers: list[str]) -> DataFrame:
    """key, doc_id, source, lang, h (of the text), n_docs, and n0, n1, ...: ids of the text by each tokenizer, of all equal rows.

    A row is counted where it stands; rows equal in doc_id, text, source and language become one of several n_docs.
    """
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(text, 256).alias("h"), text.alias("text"))
    sums = [f"n{i}" for i in range(len(tokenizers))]
    counted = rows.mapInArrow(_counter(tokenizers), "doc_id long, source string, lang string, h string, " + ", ".join(f"{n} long" for n in sums))
    each = counted.groupBy("doc_id", "source", "lang", "h").agg(F.count("*").alias("n_docs"), *[F.sum(n).alias(n) for n in sums])
    return each.withColumn("key", F.md5(F.to_json(F.struct("doc_id", "h", "source", "lang"))))


def events(rows: DataFrame, op: str, tokenizer: str, n_tokens: Column, seq: int = 0) -> DataFrame:
    """Events of one kind for row_events' rows."""
    return rows.select("key", F.lit(version(tokenizer)).alias("tokenizer_version"), F.lit(op).alias("op"), "source", "lang", "n_docs", n_tokens.cast("long").alias("n_tokens"), F.lit(seq).alias("seq"))


def version(tokenizer: str) -> str:
    return os.path.basename(tokenizer)


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text stands under a smaller doc_id too. Null doc_ids and null texts are no copies."""
    known = rows.filter("doc_id is not null and h is not null")
    first = known.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("_c")).filter("first < _last").drop("_last")
    return join_hot(known, first, "h", "_c", known.count()).filter("doc_id > first").drop("first")
