"""Chunking: units, carried context, sequences, greedy packing, windows, overlap and ids.

Ordered folds run on one document's array of units, never on more than a document, in time linear in it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import budget_tokens, slice_of, tail, token_pieces


def split_units(documents: DataFrame) -> DataFrame:
    """doc_id, unit_ord, text, n_tokens: lines that are not blank, numbered from 0."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.col("text").rlike(r"[^ \t]"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return lines.select("doc_id", ord_.alias("unit_ord"), "text", F.size(budget_tokens(F.col("text"))).alias("n_tokens"))


def split_by_header(lines: DataFrame, header: str) -> DataFrame:
    """doc_id, block, header, body from lines (doc_id, pos, text): blocks start at matching lines; what precedes the first is dropped."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    flagged = lines.withColumn("h", F.col("text").rlike(header)).withColumn("block", F.sum(F.when(F.col("h"), 1).otherwise(0)).over(w)).filter("block > 0")
    rows = flagged.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "text"))).alias("r"))
    body = F.array_join(F.transform(F.filter("r", lambda x: ~x["h"]), lambda x: x["text"]), "\n")
    return rows.select("doc_id", "block", F.col("r")[0]["text"].alias("header"), body.alias("body"))


def carry_context(rows: DataFrame, key: str, order: str, chapter: F.Column, section: F.Column) -> DataFrame:
    """rows with chapter and section carried forward by key; a new chapter ends the section."""
    w = Window.partitionBy(key).orderBy(order)
    runs = rows.withColumn("_c", chapter).withColumn("_s", section).withColumn("chapter", F.last("_c", True).over(w)).withColumn("_run", F.count("_c").over(w))
    return runs.withColumn("section", F.last("_s", True).over(Window.partitionBy(key, "_run").orderBy(order))).drop("_c", "_s", "_run")


def sequence_filter(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """The rows whose number is the next expected one, from 1 on; key, order, number."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(number).alias("n")))),
        F.expr("named_struct('next', 1, 'out', cast(array() as array<struct<o:bigint,n:int>>))"),
        lambda a, x: F.when(x["n"] == a["next"], F.struct((a["next"] + 1).alias("next"), F.array_append(a["out"], F.struct(x["o"].cast("long").alias("o"), x["n"].cast("int").alias("n"))).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return rows.groupBy(key).agg(fold.alias("x")).select(key, F.explode("x").alias("x")).select(key, F.col("x.o").alias(order), F.col("x.n").alias(number))


def citation_root(kind: Column, number: Column, chapter: Column, section: Column) -> Column:
    """What units of one packed group share: recitals and preamble clauses their type, others the whole provision."""
    return F.when(kind.isin("Recital", "Preamble"), kind).otherwise(F.to_json(F.array(kind, number, chapter, section)))


@F.pandas_udf(ArrayType(IntegerType()))
def _greedy(tokens: pd.Series, budgets: pd.Series, joins: pd.Series) -> pd.Series:
    """Group numbers of a document's units: a unit joins the open group if it may and the budget holds it and one joint."""

    def one(size, most, may):
        out, group, total = [], 0, 0
        for n, budget, ok in zip(size, most, may, strict=True):
            if group and ok and total + n + 1 <= budget:
                total += n + 1
            else:
                group, total = group + 1, n
            out.append(group)
        return out

    return pd.Series([one(*x) for x in zip(tokens, budgets, joins, strict=True)])


def pack(units: DataFrame, budget: Column, joins: Column) -> DataFrame:
    """units (doc_id, unit_ord, n_tokens, ...) with grp, from 1: greedy groups of consecutive units. joins: whether a unit
    may go with the one before it; budget: tokens that the group may have when the unit joins."""
    others = [c for c in units.columns if c != "doc_id"]
    rows = units.withColumn("_b", budget.cast("int")).withColumn("_j", F.coalesce(joins, F.lit(False)))
    arrays = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "_b", "_j", F.struct(*others).alias("r")))).alias("x"))
    field = lambda f: F.transform("x", lambda x: f(x))
    placed = arrays.withColumn("g", _greedy(field(lambda x: x["r"]["n_tokens"].cast("int")), field(lambda x: x["_b"]), field(lambda x: x["_j"])))
    flat = placed.select("doc_id", F.explode(F.zip_with("x", "g", lambda x, g: F.struct(x["r"].alias("r"), g.alias("grp")))).alias("y"))
    return flat.select("doc_id", "y.r.*", "y.grp")


def pack_size(units: DataFrame, budget: int) -> DataFrame:
    """units with grp: greedy groups of one document (and of equal roots in a row, if there is a root) within the budget."""
    joins = F.lit(True)
    if "root" in units.columns:
        units = units.withColumn("_same", F.col("root").eqNullSafe(F.lag("root").over(Window.partitionBy("doc_id").orderBy("unit_ord"))))
        return pack(units, F.lit(budget), F.col("_same")).drop("_same")
    return pack(units, F.lit(budget), joins)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def neighbour_similarity(units: DataFrame, vector: str) -> DataFrame:
    """units with sim: the similarity of a unit's vector to that of the unit before it of the same root; null without one."""
    w = Window.partitionBy("doc_id").orderBy("unit_ord")
    return units.withColumn("sim", F.when(F.col("root") == F.lag("root").over(w), _dot(F.col(vector), F.lag(vector).over(w))))


#: Bins of a level of share_threshold, and its levels: 4096^4 bins are finer than the values.
_BINS, _LEVELS = 4096, 4


def share_threshold(values: DataFrame, column: str, share: float, low: float = -1.0, high: float = 1.0 + 1e-9) -> tuple[float | None, int]:
    """(the interpolated percentile of a column within low to high, how many values there are), exact: nulls do not count.

    The k-th value is found by counts in bins, of the whole and then of the bin that it is in: no task orders the
    values, and the driver sees one row a bin.
    """
    some = values.select(F.col(column).cast("double").alias("v")).filter("v is not null")

    def kth(k: int) -> tuple[float, int]:
        lo, width, inside = low, (high - low) / _BINS, some
        total = None
        for _ in range(_LEVELS):
            place = F.floor((F.col("v") - F.lit(lo)) / F.lit(width))
            bins = sorted((r.b, r.n, r.least) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least")).collect())
            total = sum(n for _, n, _ in bins) if total is None else total
            if not total:
                return 0.0, 0
            for b, n, least in bins:
                if k < n:
                    break
                k -= n
            if n == 1:
                return least, total
            inside, lo, width = inside.filter(place == b), lo + b * width, width / _BINS
        return least, total

    _, n = kth(0)
    if not n:
        return None, 0
    place = share * (n - 1)
    below = kth(int(place))[0]
    above = below if place == int(place) else kth(int(place) + 1)[0]
    return below + (above - below) * (place - int(place)), n


def merge_groups(packed: DataFrame) -> DataFrame:
    """doc_id, grp, label ("a" or "a-b" of unit numbers from 1), text, n_units."""
    rows = packed.groupBy("doc_id", "grp").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))).alias("r"), F.min("unit_ord").alias("a"), F.max("unit_ord").alias("b"))
    label = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat((F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string")))
    return rows.select("doc_id", "grp", label.alias("label"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"), F.size("r").alias("n_units"))


def merge_units(packed: DataFrame) -> DataFrame:
    """Structured units, packed (grp), as one row a group: ranges of recitals or paragraphs, the rest from the first unit.

    Columns are those of the units, without grp; unit_ord is that of the first.
    """
    rows = packed.groupBy("doc_id", "grp").agg(F.array_sort(F.collect_list(F.struct("unit_ord", *[c for c in packed.columns if c not in ("doc_id", "grp", "unit_ord")]))).alias("r"))
    first, last = F.col("r")[0], F.element_at("r", -1)
    several = F.size("r") > 1
    preamble, recital = first["type"] == "Preamble", first["type"] == "Recital"
    span = lambda f: F.concat(first[f], F.lit("-"), last[f])
    texts = F.transform("r", lambda x: x["text"])
    changed = {
        "text": F.when(preamble, F.array_join(texts, "\n")).otherwise(F.array_join(texts, "\n\n")),
        "number": F.when(several & recital, span("number")).otherwise(first["number"]),
        "paragraph": F.when(several & ~recital & ~preamble, span("paragraph")).otherwise(first["paragraph"]),
        "citation": F.when(several & recital, F.concat(F.lit("Recitals "), span("number"))).when(several & ~preamble, F.concat(first["type"], F.lit(" "), first["number"], F.lit("("), span("paragraph"), F.lit(")"))).otherwise(first["citation"]),
    }
    return rows.select("doc_id", *[changed.get(c, first[c]).alias(c) for c in packed.columns if c not in ("doc_id", "grp")])


def adjacent_threshold(vectors: DataFrame, key: str, order: str, vector: str, share: float = 0.5) -> DataFrame:
    """One row: the interpolated percentile of the similarity of neighbours of one key, and how many there are."""
    units = vectors.select(F.col(key).alias("root"), F.col(order).alias("unit_ord"), F.col(vector).alias("v"))
    prev = F.lag("v").over(Window.partitionBy("root").orderBy("unit_ord"))
    found = units.select(_dot(F.col("v"), prev).alias("sim"))
    threshold, n = share_threshold(found, "sim", share)
    return vectors.sparkSession.createDataFrame([(threshold, n)], "threshold double, n_pairs long")


def windows(rows: DataFrame, budget: Column) -> DataFrame:
    """rows (doc_id, unit_ord, text, ...) as part (from 1; null for a text that fits), n_tokens and body: consecutive slices of
    budget tokens of the text. Rows without a token are left out."""
    cut = rows.withColumn("_t", token_pieces(F.col("text"))).withColumn("_b", budget.cast("int")).filter(F.size("_t") > 0)
    whole = F.size("_t") <= F.col("_b")
    parts = F.when(whole, F.array(F.struct(F.col("text").alias("body"), F.size("_t").alias("n")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_t") - 1, F.col("_b")), lambda i: F.struct(slice_of(F.col("_t"), i + 1, F.col("_b")).alias("body"), F.least(F.col("_b"), F.size("_t") - i).alias("n")))
    )
    out = cut.select(*[c for c in rows.columns if c != "text"], whole.alias("_w"), F.posexplode(parts).alias("_p", "_x"))
    return out.select(*[c for c in rows.columns if c != "text"], F.when(~F.col("_w"), F.col("_p") + 1).alias("part"), F.col("_x.n").alias("n_tokens"), F.col("_x.body").alias("body"))


def token_windows(units: DataFrame, budget: int) -> DataFrame:
    """doc_id, unit_ord, part, n_tokens, body: see windows."""
    return windows(units.select("doc_id", "unit_ord", "text"), F.lit(budget))


def overlap_tail(chunks: DataFrame, n: int, scope: str = "window") -> DataFrame:
    """chunks (doc_id, chunk_ord, part, body, and breadcrumb if they have one) with text: context lines, the last n tokens of
    the chunk before after an ellipsis, the body.

    Scope "window" carries into parts from 2 on, "document" into every chunk but the first.
    """
    before = F.lag("body").over(Window.partitionBy("doc_id").orderBy("chunk_ord"))
    carried = F.nullif(tail(F.col("_b"), n), F.lit(""))
    wants = F.col("part") >= 2 if scope == "window" else F.lit(True)
    lines = [F.nullif("breadcrumb", F.lit(""))] if "breadcrumb" in chunks.columns else []
    return chunks.withColumn("_b", before).withColumn("text", F.concat_ws("\n", *lines, F.when(wants, F.concat(F.lit("… "), carried)), "body")).drop("_b")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_ord, type, number, paragraph, part) with chunk_id; the n-th of equal ids gets __n."""
    base = F.concat(F.lower("type"), F.lit("-"), F.col("number"), F.coalesce(F.concat(F.lit("-"), F.col("paragraph")), F.lit("")), F.coalesce(F.concat(F.lit("#"), F.col("part").cast("string")), F.lit("")))
    n = F.row_number().over(Window.partitionBy("doc_id", "_id").orderBy("chunk_ord"))
    return chunks.withColumn("_id", base).withColumn("_n", n).withColumn("chunk_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("__"), F.col("_n").cast("string")))).drop("_id", "_n")


def gap_clusters(rows: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """key, n_clusters, low: values further apart than gap start a new cluster."""
    w = Window.partitionBy(key).orderBy(value)
    start = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", start).groupBy(key).agg((F.sum("_new") + 1).alias("n_clusters"), F.min(value).alias("low"))


def toc_breaks(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """The rows where the label changes, in order: a table of contents."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_b", before).filter(~F.col(label).eqNullSafe(F.col("_b"))).drop("_b")
