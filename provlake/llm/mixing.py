"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame and SQL functions only.

Source targets share ``percent`` of all words by weight; a target above ``most`` times its source's size is
cut there and the excess is shared again by weight. All documents of a source then have one fractional
copy count f = target / source size. The whole part is taken; the fraction is rounded by the pivotal
method: two documents with fractions pass words between them, one up and the other down, in a direction
drawn so that both expectations stay, until one of them has a whole count. What is left of a group of
about ``FAN`` documents is one fraction, which goes up a reduction tree to the next level's groups; the
root's last fraction is drawn alone. Words, not documents, are passed, so that a source's taken words miss
its target by less than one document. All draws are hashes of ids: reruns agree.

Cases: a null or empty text has size 0 and takes nothing; the null source is a source, ordered last;
sources of no words have target 0; rows that repeat are rounded each for itself; a null doc_id is an id
like others; an empty table gives an empty result; extra columns are not read by mix_plan and are kept by
mix_documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WEIGHTS = (5, 2, 1)
FAN = 64
SEED = 20240611
_WORD = r"[^\x20\x09-\x0D]+"

_ITEM = "struct<k:bigint,id:bigint,key:bigint,size:bigint,p:double>"
#: One pivotal step of the fold: a has the open document cur and the list done, x is the next document.
_UNIFORM = "(pmod(xxhash64(m.c.k, m.x.k, m.c.size, m.x.size, {seed}L), 9007199254740992L) / 9007199254740992D)"
_AT = "named_struct('k', {v}.k, 'id', {v}.id, 'key', {v}.key, 'size', {v}.size, 'p', {p})"


def _step(seed: int) -> str:
    at = lambda v, p: _AT.format(v=v, p=p)
    go = lambda cur, done: f"named_struct('cur', {cur}, 'done', array_append(m.done, {done}))"
    up, down = "m.up", "m.down"
    rise = f"if(m.c.size * (1D - m.c.p) <= m.x.size * m.x.p, {go(at('m.x', f'm.x.p - {up} / m.x.size'), at('m.c', '1D'))}, {go(at('m.c', f'm.c.p + {up} / m.c.size'), at('m.x', '0D'))})"
    fall = f"if(m.c.size * m.c.p <= m.x.size * (1D - m.x.p), {go(at('m.x', f'm.x.p + {down} / m.x.size'), at('m.c', '0D'))}, {go(at('m.c', f'm.c.p - {down} / m.c.size'), at('m.x', '1D'))})"
    pair = "named_struct('c', a.cur, 'x', x, 'done', a.done, 'up', least(a.cur.size * (1D - a.cur.p), x.size * x.p), 'down', least(a.cur.size * a.cur.p, x.size * (1D - x.p)))"
    draw = _UNIFORM.format(seed=seed) + " * (m.up + m.down) < m.down"
    step = f"element_at(transform(array({pair}), m -> if({draw}, {rise}, {fall})), 1)"
    return f"if(a.cur is null, named_struct('cur', x, 'done', a.done), {step})"


def _fold(seed: int) -> str:
    return f"aggregate(array_sort(items), named_struct('cur', cast(null as {_ITEM}), 'done', cast(array() as array<{_ITEM}>)), (a, x) -> {_step(seed)})"


def source_targets(sized: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """source, n_docs, source_size, target: one row a source. The running sums are over sources, not documents."""
    src = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # with every source before it at its cap, what a unit of weight gets at this source
    src = src.withColumn("total", F.sum("source_size").over(whole) * F.lit(percent / 100.0))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.row_number().over(by_ratio).alias("i"), F.col("level").alias("level")))
    src = src.withColumn("free", free).withColumn("final", F.min("free").over(whole)["level"])
    return src.select("source", "n_docs", "source_size", F.coalesce(F.least(F.col("w") * F.col("final"), F.col("cap")), F.col("cap")).alias("target"))


def mix_plan(documents: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """doc_id, row_key, size, source_size, target, copies: one row for each row of documents."""
    spark = documents.sparkSession
    ws = Workspace(spark, "mixing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", "source").alias("row_key"))
    sized = ws.save(sized, "sized")
    targets = source_targets(sized, percent, weights, most)
    # sources are numbered once, so that deeper levels move numbers, not names
    targets = ws.save(targets.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "targets")
    f = F.when(F.col("target") >= F.col("source_size") * float(most), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size"))
    joined = sized.join(targets.withColumnRenamed("source", "_source"), sized["source"].eqNullSafe(F.col("_source")))
    joined = joined.withColumn("f", F.when(F.col("source_size") > 0, f).otherwise(0.0)).withColumn("whole", F.floor("f").cast("long"))
    # a document without words passes none: its copies are the whole part
    joined = joined.withColumn("p", F.when(F.col("size") > 0, F.col("f") - F.col("whole")).otherwise(0.0))
    leaves = F.ceil(F.col("n_docs") / fan).cast("long")
    k = F.xxhash64("doc_id", "row_key", "size", F.lit(seed))
    open_ = joined.filter("p > 0").select("s", F.pmod(F.xxhash64(k, F.lit(1)), leaves).alias("leaf"), k.alias("k"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "size", "p")
    settled = joined.filter("p <= 0").select("s", F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "size", F.lit(0.0).alias("p"))
    width = (targets.agg(F.max("n_docs")).first()[0] or 0) / fan
    done, level = [settled], 0
    while True:
        items = open_.groupBy("s", "leaf").agg(F.collect_list(F.struct("k", "id", "key", "size", "p")).alias("items"))
        folded = items.select("s", "leaf", F.expr(_fold(seed + level)).alias("r"))
        rows = folded.select("s", "leaf", F.explode(F.concat(F.transform("r.done", lambda d: F.struct(d.alias("d"), F.lit(False).alias("open"))), F.array(F.struct(F.col("r.cur").alias("d"), F.lit(True).alias("open"))))).alias("e"))
        rows = ws.save(rows.select("s", "leaf", "e.open", "e.d.*"), f"level{level}")
        done.append(rows.filter("not open").select("s", "id", "key", "size", "p"))
        left = rows.filter("open").select("s", F.floor(F.col("leaf") / fan).cast("long").alias("leaf"), "k", "id", "key", "size", "p")
        if width <= 1:
            break
        open_, width, level = left, width / fan, level + 1
    draw = F.pmod(F.xxhash64("k", F.lit(seed), F.lit(99)), F.lit(1 << 53)) / float(1 << 53)
    done.append(left.select("s", "id", "key", "size", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    parts = targets.select("s", "source_size", "target", F.floor(F.when(F.col("source_size") > 0, f).otherwise(0.0)).cast("long").alias("whole"))
    return out.join(parts, "s").select(F.col("id").alias("doc_id"), F.col("key").alias("row_key"), "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix_documents(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents as often as the mix takes them, with all their columns. Equal rows are interchangeable."""
    plan = mix_plan(documents, **how).groupBy(F.col("row_key").alias("_key")).agg(F.sum("copies").alias("_c"), F.count("*").alias("_m")).filter("_c > 0")
    row_key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    renamed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), row_key.alias("_key"))
    # the texts move once: the window has the join's partitions and order
    joined = renamed.join(plan, "_key").withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    copies = F.floor(F.col("_c") / F.col("_m")) + F.when(F.col("_r") <= F.col("_c") % F.col("_m"), 1).otherwise(0)
    taken = joined.withColumn("_n", copies.cast("int")).filter("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
