"""Scoring: strict coverage, precision and recall at k, means that skip nulls, matrices and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 8)


def strict_score(should_answer: Column, refused: Column, expected: Column, got: Column, uncovered: Column | None = None) -> Column:
    """1 if every expected reference was cited, 0 if not; refusals count where nothing should be answered; no references: null.

    uncovered: true where the one expected provision has paragraphs that the citations leave out.
    """
    whole = F.lit(True) if uncovered is None else ~F.coalesce(uncovered, F.lit(False))
    covered = (F.size(F.array_except(expected, got)) == 0) & whole
    return F.when(should_answer == "no", F.when(refused, 1).otherwise(0)).when(F.coalesce(F.size(expected), F.lit(0)) < 1, None).otherwise(F.when(covered, 1).otherwise(0))


def missing_refs(expected: Column, got: Column) -> Column:
    """Expected references that were not cited: numbers in order, then others as text."""
    gone = F.array_except(expected, got)
    keyed = F.array_sort(F.transform(gone, lambda x: F.struct(x.cast("string").try_cast("long").isNull().alias("t"), x.cast("string").try_cast("long").alias("n"), x.cast("string").alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def top_hit(should_answer: Column, expected: Column, got: Column, k: int = 3) -> Column:
    """1 if any expected reference is among the first k, 0 if none; null where no answer is due or nothing expected."""
    return F.when((should_answer == "yes") & (F.size(expected) > 0), F.arrays_overlap(F.slice(got, 1, k), expected).cast("int"))


def precision_recall(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, k, precision, recall from ranked (query_id, rank, id, ref) and relevant (query_id, ref).

    Recall counts distinct references, precision ranked rows; a query without rows has 0, one without
    relevant references no row.
    """
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("total"))
    hit = ranked.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query_id", "ref"], "left")
    at = lambda c, k: F.when(F.col("rank") <= k, c)
    aggs = []
    for k in ks:
        aggs += [F.count_distinct(at(F.when(F.col("hit") == 1, F.col("ref")), k)).alias(f"r{k}"), F.sum(at(F.col("hit"), k)).alias(f"p{k}")]
    per = total.join(hit.groupBy("query_id").agg(F.count("*").alias("n"), *aggs), "query_id", "left")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"p{k}") / F.least(F.lit(k), "n"), F.lit(0.0)).alias("precision"), F.coalesce(F.col(f"r{k}") / F.col("total"), F.lit(0.0)).alias("recall")) for k in ks])
    return per.select("query_id", F.explode(rows).alias("x")).select("query_id", "x.*")


def macro_means(scores: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means and counts of rows that have the value, by group."""
    return scores.groupBy(by).agg(*[a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.count(c).alias(f"n_{c}"))])


def hits_at(first_ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, hits: queries whose first relevant rank is k or better."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias("h")) for k in ks])
    return first_ranks.select(F.explode(rows).alias("x")).groupBy("x.k").agg(F.sum("x.h").alias("hits"))


def confusion(rows: DataFrame, human: str, judge: str) -> DataFrame:
    """tp, tn, fp, fn, n_none, agreement, tpr, tnr; a null judge is counted apart."""
    h, j = F.col(human), F.col(judge)
    c = rows.agg(*[F.count_if(x).alias(n) for n, x in (("tp", (h == 1) & (j == 1)), ("tn", (h == 0) & (j == 0)), ("fp", (h == 0) & (j == 1)), ("fn", (h == 1) & (j == 0)), ("n_none", j.isNull()))])
    share = lambda a, b: F.round(F.try_divide(a, b), 3)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select("*", share(tp + tn, tp + tn + fp + fn).alias("agreement"), share(tp, tp + fn).alias("tpr"), share(tn, tn + fp).alias("tnr"))


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, score, n: a long table of means that skip nulls."""
    wide = rows.agg(*[a for m in metrics for a in (F.avg(m).alias(f"{m}_s"), F.count(m).alias(f"{m}_n"))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_s").alias("score"), F.col(f"{m}_n").alias("n")) for m in metrics])).alias("x")).select("x.*")


def override_agreement(reviewed: Column, overruled: Column) -> Column:
    """Share of reviewed verdicts that stood; null without reviews."""
    return F.try_divide(F.count_if(reviewed) - F.count_if(reviewed & overruled), F.count_if(reviewed))


def category_stats(rows: DataFrame, category: str, score: str) -> DataFrame:
    """category, n, graded, passed; blank categories are "uncategorised"."""
    name = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("uncategorised"))
    return rows.groupBy(name.alias("category")).agg(F.count("*").alias("n"), F.count(score).alias("graded"), F.count_if(F.col(score) == 1).alias("passed"))


def refusal_stats(rows: DataFrame) -> DataFrame:
    """From should_answer, refused, error: correct refusals of those due, false refusals of the rest, errors."""
    due, done = F.col("should_answer") == "no", F.col("refused")
    return rows.agg(F.count_if(due).alias("due"), F.count_if(due & done).alias("correct_refusals"), F.count_if(~due).alias("answerable"), F.count_if(~due & done).alias("false_refusals"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def compare_arms(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """key, a, b, delta, differs over both arms; differs is null-safe."""
    left, right = a.select(F.col(key).alias("_ka"), F.col(metric).alias("a")), b.select(F.col(key).alias("_kb"), F.col(metric).alias("b"))
    both = left.join(right, F.col("_ka") == F.col("_kb"), "full")
    return both.select(F.coalesce("_ka", "_kb").alias(key), "a", "b", (F.col("b") - F.col("a")).alias("delta"), (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


def arm_totals(rows: DataFrame, arm: str, cost: str, latency: str) -> DataFrame:
    """arm, n, total_cost, mean_cost, median_latency (mean of the middle two)."""
    return rows.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("n"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_cost"), F.median(latency).alias("median_latency"))


def ladder(steps: DataFrame, margin: int = 3) -> DataFrame:
    """step, hits, kept: a step is kept if it beats the last kept one by the margin. One bounded list of steps (step, hits)."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("step", "hits"))),
        F.expr("named_struct('best', cast(null as bigint), 'out', cast(array() as array<struct<step:bigint,hits:bigint,kept:boolean>>))"),
        lambda a, x: F.when(
            a["best"].isNull() | (x["hits"] >= a["best"] + margin),
            F.struct(x["hits"].cast("long").alias("best"), F.array_append(a["out"], F.struct(x["step"].cast("long").alias("step"), x["hits"].cast("long").alias("hits"), F.lit(True).alias("kept"))).alias("out")),
        ).otherwise(F.struct(a["best"].alias("best"), F.array_append(a["out"], F.struct(x["step"].cast("long").alias("step"), x["hits"].cast("long").alias("hits"), F.lit(False).alias("kept"))).alias("out"))),
        lambda a: a["out"],
    )
    return steps.agg(fold.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def rank_changes(ranks: DataFrame, base: str, other: str) -> DataFrame:
    """ref, before, after where the rank differs between two variants of ranks (variant, ref, rank)."""
    one = lambda v, n: ranks.filter(F.col("variant") == v).select("ref", F.col("rank").alias(n))
    return one(base, "before").join(one(other, "after"), "ref", "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def paragraph_index(units: DataFrame) -> DataFrame:
    """kind, num, labels (sorted): paragraphs known of each article or annex; ranges are expanded."""
    from ..functions.refs import expand_range

    rows = units.filter(F.col("type").isin("Article", "Annex") & F.col("paragraph").isNotNull()).select(F.lower("type").alias("kind"), F.col("number").try_cast("int").alias("num"), F.explode(expand_range(F.col("paragraph"))).alias("label"))
    return rows.filter("num is not null").groupBy("kind", "num").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def places(rows: DataFrame, keys: list[str], id_col: str, block: int = 4096) -> DataFrame:
    """rows with place, from 1, in the order of keys and then of the whole number id_col, over all of them.

    Rows are counted by keys and block of ids; a row's place is the count of the blocks before its own and its place
    in it. The running sum is over blocks, a ``block``-th of the rows at most, and no task orders more than one.
    """
    named = rows.withColumn("_k", F.struct(*keys, F.floor(F.col(id_col) / block).alias("b")))
    counts = named.groupBy("_k").agg(F.count("*").alias("_n"))
    before = counts.select("_k", (F.sum("_n").over(Window.orderBy("_k")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_k").orderBy(id_col))
    return named.join(before, "_k").withColumn("place", F.col("_before") + own).drop("_k", "_before")


def score_rows(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """rows with expected and got (references), score and note.

    rows: question, should_answer, refused, expected_source, citations (array); paragraphs: kind, num, labels
    (paragraph_index). The score is that of strict_score; a single provision that the question itself names, without
    a paragraph in the expected source, must be covered in all of its paragraphs, if it has several.
    """
    from ..functions.refs import citation_detail, parse_refs

    empty = F.expr("cast(array() as array<string>)")
    named = rows.withColumn("expected", parse_refs(F.coalesce("expected_source", F.lit("")))).withColumn("got", F.array_distinct(F.flatten(F.transform(F.coalesce("citations", empty), parse_refs))))
    one = (F.size("expected") == 1) & ~F.coalesce(F.col("expected_source"), F.lit("")).rlike(r"[0-9ivxlcIVXLC]\s*\([^)]*\)") & (F.size(F.array_except("expected", parse_refs(F.coalesce("question", F.lit(""))))) == 0)
    ref = F.when(one, F.col("expected")[0])
    keyed = named.withColumn("_kind", ref["kind"]).withColumn("_num", ref["num"])
    known = paragraphs.select(F.col("kind").alias("_kind"), F.col("num").alias("_num"), "labels").filter(F.size("labels") > 1)
    joined = keyed.join(known, ["_kind", "_num"], "left")
    details = F.filter(F.transform(F.coalesce("citations", empty), citation_detail), lambda x: x.isNotNull() & (x["kind"] == F.col("_kind")) & (x["num"] == F.col("_num")))
    joined = joined.withColumn("_covered", F.array_distinct(F.flatten(F.transform(details, lambda x: x["labels"]))))
    joined = joined.withColumn("_gone", F.when(F.col("labels").isNotNull(), missing_refs(F.col("labels"), F.col("_covered"))).otherwise(empty))
    score = strict_score(F.col("should_answer"), F.col("refused"), F.col("expected"), F.col("got"), F.size("_gone") > 0)
    lost = F.array_join(F.transform(F.array_sort(F.array_except("expected", "got")), lambda r: F.concat_ws(" ", r["kind"], r["num"].cast("string"))), ", ")
    note = (
        F.when(F.col("should_answer") == "no", "out of scope: scored on refusal")
        .when(F.size("expected") == 0, F.when(F.trim(F.coalesce("expected_source", F.lit(""))) != "", "no reference in the expected source").otherwise("no expected source"))
        .when(lost != "", F.concat(F.lit("missing: "), lost))
        .when(F.size("_gone") > 0, F.concat(F.lit("missing paragraphs of "), "_kind", F.lit(" "), F.col("_num").cast("string"), F.lit(": "), F.array_join("_gone", ", "), F.lit(" ("), F.size("_covered").cast("string"), F.lit("/"), F.size("labels").cast("string"), F.lit(")")))
        .otherwise("")
    )
    return joined.withColumn("score", score).withColumn("note", note).drop("_kind", "_num", "labels", "_covered", "_gone")


def tally(rows: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    """arm, metric, passed, graded, ungraded: by arm and metric; a null score is not graded."""
    long = rows.select(F.col(arm).alias("arm"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("score")) for m in metrics])).alias("x")).select("arm", "x.*")
    return long.groupBy("arm", "metric").agg(F.count_if(F.col("score") == 1).alias("passed"), F.count("score").alias("graded"), F.count_if(F.col("score").isNull()).alias("ungraded"))


def cost_ratio(totals: DataFrame, base: str) -> DataFrame:
    """Arms (arm, mean_cost) with the ratio of their mean cost to that of the base arm; null where that is 0 or unknown."""
    one = totals.filter(F.col("arm") == base).agg(F.first("mean_cost").alias("_base"))
    return totals.join(F.broadcast(one), F.lit(True), "left").withColumn("ratio", F.try_divide("mean_cost", "_base")).drop("_base")  # one row


def run_summary(rows: DataFrame, judges: list[str], others: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """metric, score, n: means that skip nulls of judges (after overrides and, as raw_<judge>, before), of others and of
    precision and recall at each k (columns p<k> and r<k>), and agreement_<judge>: the share of reviewed verdicts that stood.

    For each judge rows have raw_<judge>, and <judge>_reviewed and <judge>_overruled as booleans. Metrics without any
    value have a null score; agreement and raw means are left out where nothing was reviewed.
    """
    names = [*judges, *others, *[f"r{k}" for k in ks], *[f"p{k}" for k in ks]]
    mean = lambda m: [F.avg(m).alias(f"{m}_s"), F.count(m).alias(f"{m}_n")]
    extra = []
    for j in judges:
        seen = F.col(f"{j}_reviewed")
        extra += [F.avg(f"raw_{j}").alias(f"raw_{j}_s"), F.count(f"raw_{j}").alias(f"raw_{j}_n"), override_agreement(seen, F.col(f"{j}_overruled")).alias(f"agreement_{j}_s"), F.count_if(seen).alias(f"agreement_{j}_n")]
    wide = rows.agg(*[a for m in names for a in mean(m)], *extra)
    some = lambda j: F.col(f"agreement_{j}_n") > 0
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_s").cast("double").alias("score"), F.col(f"{m}_n").alias("n")) for m in names]
    for j in judges:
        cells += [F.when(some(j), F.struct(F.lit(m).alias("metric"), F.col(f"{m}_s").cast("double").alias("score"), F.col(f"{m}_n").alias("n"))) for m in (f"raw_{j}", f"agreement_{j}")]
    return wide.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")


def chunk_sizes(chunks: DataFrame, variant: str, tokens: str) -> DataFrame:
    """variant, n_chunks, median_tokens (mean of the middle two), max_tokens. Sizes are counted first, so the median is of
    a table with a row for each size."""
    sizes = chunks.groupBy(F.col(variant).alias("variant"), F.col(tokens).alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("variant").orderBy("t")
    placed = sizes.withColumn("_up", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy("variant")))
    at = lambda k: F.min(F.when(F.col("_up") > k, F.col("t")))
    low, high = at(F.floor((F.col("_all") - 1) / 2)), at(F.floor(F.col("_all") / 2))
    return placed.groupBy("variant").agg(F.sum("n").alias("n_chunks"), ((low + high) / 2).alias("median_tokens"), F.max("t").alias("max_tokens"))


def choose_variant(variants: DataFrame, base: str, second: str, margin: int = 3) -> DataFrame:
    """One row, the winner (label, hits, chunks) of variants: that of most hits, of equals of fewest chunks, if it beats the
    base by the margin; else the second, if it has no fewer hits than the base; else the base."""
    row = F.struct("label", "hits", "chunks")
    pick = lambda name: F.max(F.when(F.col("label") == name, row))
    best = F.max(F.struct("hits", (-F.col("chunks")).alias("fewer"), F.col("label").alias("label")))
    all_ = variants.agg(best.alias("b"), pick(base).alias("base"), pick(second).alias("second"))
    top = F.struct(F.col("b.label").alias("label"), F.col("b.hits").alias("hits"), (-F.col("b.fewer")).alias("chunks"))
    chosen = F.when(F.col("b.hits") >= F.col("base.hits") + margin, top).when(F.col("second.hits") >= F.col("base.hits"), F.col("second")).otherwise(F.col("base"))
    return all_.select(chosen.alias("w")).select("w.*")


def usage(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """question, llm_calls, tokens_in, tokens_out, cost from calls (question, tokens_in, tokens_out; nulls count 0); prices a million."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    out = calls.groupBy("question").agg(F.count("*").alias("llm_calls"), n("tokens_in").alias("tokens_in"), n("tokens_out").alias("tokens_out"))
    return out.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)
