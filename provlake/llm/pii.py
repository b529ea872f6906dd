"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Other candidates are
tokens with digits that might be secrets or personal numbers. Labelers vote on each candidate (+1, 0, -1):
by regex (hex keys, personal number shapes, mixed characters), by gazetteer (key prefixes, harmless
neighbours) and by context (names of secrets before it, an assignment). Expectation-maximisation over the
counts of vote patterns, of which there are at most 3^7, estimates how reliable each labeler is in either
class. The posteriors then train a logistic span classifier on features of the token alone, from counts by
feature vector; spans of kind ``secret`` are those that it accepts.

The text is read once; the models are folds over one bounded row. Positions are code points, end exclusive.

The patterns here are possessive and anchored at run starts, so that long runs cost linear time and no
deep recursion; they find the same matches as the plain patterns stated in ``KINDS``.

Cases: a null or empty text has no spans; ties do not arise, since spans of a kind do not overlap; rows
that repeat are searched each for itself; with no candidates at all no model is fitted and no span added;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Fixed patterns, as stated: email, ip, card, phone.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{9,}+",
}
#: Without this in a text, the kind has no match that passes its check.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "secret": r"[0-9]"}

LABELERS = ["regex_hex", "regex_number_shape", "regex_mixed", "gazetteer_prefix", "gazetteer_harmless", "context_name", "context_assigned"]
FEATURES = ["bias", "len_20", "len_32", "digit_third", "alternates", "hex_only", "digits_only", "has_upper", "has_lower", "has_dash"]
#: Fixed word lists of the gazetteers.
KEY_PREFIXES = "sk-|sk_|pk_|rk_|ghp_|gho_|ghs_|AKIA|ASIA|AIza|xox[abp]-|glpat-|eyJ|npm_|hf_"
KEY_NAMES = "key|token|secret|passw|pwd|credential|auth|ssn|iban|passport|account|konto|clave|mot de passe"
HARMLESS = "version|isbn|issn|vol|page|chapter|license|release|rfc|iso"

_NONE = "cast(array() as array<struct<s:int,e:int,m:string>>)"
EM_ROUNDS, FIT_ROUNDS, SMOOTH = 25, 300, 0.5


def _found(kind: str) -> tuple[Column, Column]:
    """(matches, lengths of what stands before each) of a kind in column text."""
    p = F.lit(_FAST[kind])
    has = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(_NEEDS[kind])
    gaps = F.transform(F.split("text", _FAST[kind], -1), F.length)
    return F.when(has, F.regexp_extract_all("text", p, F.lit(0))), F.when(has, gaps)


def _placed(kind: str) -> Column:
    """array of (s, e, m) from the matches and gaps of a kind."""
    fold = f"aggregate(zip_with(m_{kind}, slice(g_{kind}, 1, size(m_{kind})), (m, g) -> struct(m as m, g as g)), struct(0 as at, {_NONE} as out), (a, x) -> struct(a.at + x.g + length(x.m) as at, array_append(a.out, struct(a.at + x.g as s, a.at + x.g + length(x.m) as e, x.m as m)) as out), a -> a.out)"
    return F.coalesce(F.expr(fold), F.expr(_NONE))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.translate(m, " -", "")
        at = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)))
        return F.length(digits).between(16, 19) & (F.when(F.length(digits).between(16, 19), total).otherwise(1) % 10 == 0)
    if kind == "phone":
        return F.length(F.translate(m, " ().+-", "")).between(8, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["m"])


def _lists(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _votes(m: Column, before: Column) -> Column:
    """One vote a labeler, in the order of LABELERS."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    both = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    hexed = m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & both
    shaped = m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    mixed = F.when((F.length(m) >= 20) & m.rlike("[0-9][A-Za-z_-]++[0-9][A-Za-z_-]"), 1).when(m.rlike("^[0-9-]++$|^[A-Za-z_-]++[0-9]{1,4}$"), -1).otherwise(0)
    harmless = F.when(before.rlike(rf"(?i)\b(?:{HARMLESS})\W*$") | m.rlike(r"^[12][0-9]{3}-[01][0-9]-[0-3][0-9]$"), -1).otherwise(0)
    return F.array(yes(hexed), yes(shaped), mixed, yes(m.rlike(rf"^(?:{KEY_PREFIXES})")), harmless, yes(before.rlike(rf"(?i)(?:{KEY_NAMES})")), F.when(before.rlike(r"[=:]\s?[\"'`]?$"), 1).otherwise(-1))


def _features(m: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.array(F.lit(1), one(F.length(m) >= 20), one(F.length(m) >= 32), one(digits * 3 >= F.length(m)), one(m.rlike("[0-9][A-Za-z]++[0-9]")), one(m.rlike("^[0-9A-Fa-f]++$")), one(m.rlike("^[0-9-]++$")), one(m.rlike("[A-Z]")), one(m.rlike("[a-z]")), one(m.rlike("[_-]")))


def extract_candidates(documents: DataFrame) -> DataFrame:
    """doc_id, an array of (s, e, m) for each base kind, and candidates: array of (s, e, m, votes, features)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cols = {}
    for kind in _FAST:
        cols[f"m_{kind}"], cols[f"g_{kind}"] = _found(kind)
    placed = docs.withColumns(cols).select("doc_id", "text", *[_placed(k).alias(f"all_{k}") for k in _FAST])
    base = placed.withColumns({k: F.filter(f"all_{k}", _keeps(k)) for k in KINDS})
    taken = F.concat(*KINDS)
    free = F.filter("all_secret", lambda c: ~F.exists(taken, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    free_rows = base.withColumn("free", free)
    before = "substring(text, greatest(1, c.s - 31), least(c.s, 32))"
    with_context = free_rows.withColumn("ctx", F.expr(f"transform(free, c -> struct(c.s as s, c.e as e, c.m as m, {before} as b))"))
    judge = F.transform("ctx", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), _votes(c["m"], c["b"]).alias("votes"), _features(c["m"]).alias("features")))
    return with_context.select("doc_id", *KINDS, judge.alias("candidates"))


def fit_reliabilities(candidates: DataFrame) -> dict | None:
    """Expectation-maximisation over vote patterns: the prior and each labeler's chances of -1, 0, 1 in class 1, then 0.

    candidates has a column votes. The patterns are one bounded row; the rounds are a fold over it.
    """
    patterns = candidates.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p")).filter("size(p) > 0")
    n_labelers = len(LABELERS)
    weighted = "transform({p}, x -> struct(x.votes as v, x.n * x.q as a, x.n * (1D - x.q) as b))"
    total = lambda f: f"aggregate(w, 0D, (t, y) -> t + y.{f})"
    chance = lambda f: ", ".join(f"(aggregate(w, 0D, (t, y) -> t + if(y.v[j] = {k}, y.{f}, 0D)) + {SMOOTH}D) / ({total(f)} + {3 * SMOOTH}D)" for k in (-1, 0, 1))
    m_step = "element_at(transform(array({w}), w -> struct((" + total("a") + " + 1D) / (" + total("a") + " + " + total("b") + f" + 2D) as prior, transform(sequence(0, {n_labelers - 1}), j -> array({chance('a')}, {chance('b')})) as t)), 1)"
    like = lambda off: f"aggregate(sequence(0, {n_labelers - 1}), 0D, (l, j) -> l + ln(s.t[j][x.votes[j] + {off}]))"
    post = f"1D / (1D + exp(least(700D, ln(1D - s.prior) + {like(4)} - ln(s.prior) - {like(1)})))"
    e_step = f"transform(p, x -> struct(x.votes as votes, x.n as n, {post} as q))"
    start = "transform(p, x -> struct(x.votes as votes, x.n as n, case when aggregate(x.votes, 0, (t, v) -> t + v) > 0 then 0.9D when aggregate(x.votes, 0, (t, v) -> t + v) = 0 then 0.3D else 0.1D end as q))"
    first = m_step.replace("{w}", weighted.replace("{p}", start))
    again = m_step.replace("{w}", weighted.replace("{p}", e_step))
    fitted = row.select(F.expr(f"aggregate(sequence(1, {EM_ROUNDS}), {first}, (s, i) -> {again})").alias("m")).first()
    if fitted is None:
        return None
    return {"prior": fitted.m.prior, "chances": {name: list(t) for name, t in zip(LABELERS, fitted.m.t, strict=True)}}


def posterior(votes: Column, model: dict) -> Column:
    """The chance, after the votes, that a candidate is personal data."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, name in enumerate(LABELERS):
        t = model["chances"][name]
        logs = F.array(*[F.lit(math.log(t[k] / t[k + 3])) for k in range(3)])
        odds = odds + F.element_at(logs, votes[j] + 2)
    return 1 / (1 + F.exp(-odds))


def fit_classifier(candidates: DataFrame, model: dict) -> list[float]:
    """Weights of the logistic span classifier, fitted to the posteriors; one bounded row of feature vectors, folded."""
    rows = candidates.select("features", posterior(F.col("votes"), model).alias("q")).groupBy("features").agg(F.count("*").cast("double").alias("n"), F.sum("q").alias("a"))
    row = rows.agg(F.array_sort(F.collect_list(F.struct("features", "n", "a"))).alias("p"))
    k = len(FEATURES)
    score = f"aggregate(sequence(0, {k - 1}), 0D, (l, j) -> l + w[j] * x.features[j])"
    residual = f"transform(p, x -> struct(x.features as f, x.a - x.n / (1D + exp(-{score})) as r))"
    n = "aggregate(p, 0D, (t, x) -> t + x.n)"
    grad = f"transform(w, (v, j) -> v + 2D * (aggregate(r, 0D, (t, y) -> t + y.r * y.f[j]) / {n} - 0.0005D * v))"
    step = f"element_at(transform(array({residual}), r -> {grad}), 1)"
    return list(row.select(F.expr(f"aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {k}), (w, i) -> {step})").alias("w")).first().w)


def classify(features: Column, weights: list[float]) -> Column:
    """The classifier's probability."""
    z = F.lit(0.0)
    for j, w in enumerate(weights):
        z = z + features[j] * F.lit(w)
    return 1 / (1 + F.exp(-z))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, email, ip, card, phone and secret: arrays of (s, e, m) by start. One row for each row of documents."""
    ws = Workspace(documents.sparkSession, "pii")
    found = ws.save(extract_candidates(documents), "candidates")
    each = found.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.votes", "c.features")
    model = fit_reliabilities(each)
    span = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"))
    if model is None:
        return found.select("doc_id", *KINDS, F.expr(_NONE).alias("secret"))
    weights = fit_classifier(each, model)
    accepted = F.filter("candidates", lambda c: classify(c["features"], weights) >= 0.5)
    return found.select("doc_id", *KINDS, F.transform(accepted, span).alias("secret"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, and the counts of secrets and of all spans."""
    listed = lambda kinds: F.array_join(F.concat(*[F.transform(k, _lists(k)) for k in kinds]), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS), 256).alias("base_sha256"),
        listed([*KINDS, "secret"]).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
        sum((F.size(k) for k in KINDS), F.size("secret")).cast("long").alias("n_spans"),
    )
