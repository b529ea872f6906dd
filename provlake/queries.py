"""Queries over the standard tables, one for each operator, and their SQL.

Search queries take every vector whose id is divisible by 100 against all vectors, and every benchmark text
against all documents. Provisions are derived from documents: type by doc_id, number doc_id, chapter source,
section lang, paragraphs the lines that are not blank.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import refs as R
from .functions import text as T
from .functions.plugins import hashed_embedding
from .operators import chunking as C
from .operators import labels as L
from .operators import retrieval as V
from .operators import scoring as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Positions and counts that come out as long, as in SQL.
_LONG = ("rank", "n_tokens", "chunk_ord", "place", "first_rank")


def _wide(f):
    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if c in _LONG and kind == "int"})

    return run


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = _wide(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- dense retrieval -------------------------------------------------------------------------------------


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


def _knn(spark: SparkSession, d: str, k: int = 8, corpus: DataFrame | None = None) -> DataFrame:
    corpus = table(spark, d, "embeddings") if corpus is None else corpus
    return V.cosine_topk(_vector_queries(spark, d), corpus, k, extra=("label",))


_S = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, q_label, vec_id AS id, label, round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS sim FROM q, embeddings WHERE vec_id <> query_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 8),
low AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE label < 5 QUALIFY rank <= 8),
named AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE label = q_label QUALIFY rank <= 6)
"""


@query(_S + "SELECT query_id, id, sim, label, rank FROM knn")
def knn_topk(spark, d):
    return _knn(spark, d)


@query(_S + "SELECT query_id, id, sim, label, rank FROM low")
def knn_topk_restricted(spark, d):
    vectors = table(spark, d, "embeddings")
    allowed = vectors.filter("label < 5").select("vec_id").distinct()
    return _knn(spark, d, corpus=vectors.join(allowed, "vec_id", "left_semi"))


def _lists(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return _knn(spark, d).withColumn("list_idx", F.lit(0)).unionByName(_knn(spark, d, corpus=vectors.filter("label < 5")).withColumn("list_idx", F.lit(1)))


_LISTS = _S + ", lists AS (SELECT *, 0 AS list_idx FROM knn UNION ALL SELECT *, 1 AS list_idx FROM low)\n"


@query(_LISTS + "SELECT query_id, id, sim, list_idx, rank FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY sim DESC, list_idx, rank) = 1")
def pool_best(spark, d):
    return V.pool_best(_lists(spark, d)).select("query_id", "id", "sim", "list_idx", "rank")


_RRF = "(SELECT query_id, id, CAST(sum(CAST(round(1e12 / (60 + rank)) AS BIGINT)) AS DOUBLE) / 1e12 AS score, min(list_idx * 1000 + rank) AS seen FROM {lists} GROUP BY 1, 2)"
_FUSED = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM " + _RRF


@query(_LISTS + _FUSED.format(lists="lists"))
def rrf_fuse(spark, d):
    return V.rrf(_lists(spark, d))


def _named(spark, d) -> DataFrame:
    """Vectors of the query's own label stand for rows that metadata names."""
    return V.cosine_topk(_vector_queries(spark, d), table(spark, d, "embeddings"), 6, same=("q_label", "label"))


@query(_S + """, u AS (SELECT query_id, id, sim, rank, 0 AS p, 'metadata' AS retrieved_by FROM named
UNION ALL SELECT query_id, id, sim, rank, 1, 'similarity' FROM knn WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM named))
SELECT query_id, id, sim, retrieved_by, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS r FROM u) WHERE r <= 8""")
def metadata_first(spark, d):
    return V.metadata_first(_named(spark, d), _knn(spark, d))


@query(_LISTS + ", f AS (" + _FUSED.format(lists="lists") + """), u AS (SELECT query_id, id, sim, rank, 0 AS p, 'metadata' AS retrieved_by FROM named WHERE rank <= 3
UNION ALL SELECT f.query_id, f.id, f.score, f.rank, 1, 'similarity' FROM f WHERE (f.query_id, f.id) NOT IN (SELECT (query_id, id) FROM named WHERE rank <= 3))
SELECT query_id, id, sim, retrieved_by, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS r FROM u) WHERE r <= 10""")
def pin_first(spark, d):
    evidence = V.rrf(_lists(spark, d)).withColumnRenamed("score", "sim")
    return V.priority_union(_named(spark, d).filter("rank <= 3"), evidence, 10, "metadata", "similarity")


@query(_S + """SELECT q.query_id, max(sim) AS best, coalesce(NOT bool_or(knn.label = 3) AND max(sim) < 0.45, true) AS refuse
FROM q LEFT JOIN knn USING (query_id) GROUP BY 1""")
def similarity_gate(spark, d):
    rows = _knn(spark, d).withColumn("retrieved_by", F.when(F.col("label") == 3, "metadata").otherwise("similarity"))
    return V.similarity_gate(_vector_queries(spark, d), rows, 0.45)


def _ranked_refs(spark, d) -> tuple[DataFrame, DataFrame]:
    ranked = _knn(spark, d).withColumn("ref", F.col("label"))
    return ranked, _vector_queries(spark, d).select("query_id", F.col("q_label").alias("ref"))


_PR = _S + """, ks AS (SELECT unnest([1, 3, 5, 8]) AS k),
pr AS (SELECT query_id, k, round(count(*) FILTER (rank <= k AND label = q_label) / least(k, count(*)), 6) AS precision,
  round(CAST(count(DISTINCT CASE WHEN rank <= k AND label = q_label THEN label END) AS DOUBLE), 6) AS recall FROM knn, ks GROUP BY 1, 2)
"""


@query(_PR + "SELECT * FROM pr")
def precision_recall_at_k(spark, d):
    return S.precision_recall(*_ranked_refs(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(_PR + "SELECT k, round(avg(precision), 6) AS mean_precision, count(precision) AS n_precision, round(avg(recall), 6) AS mean_recall, count(recall) AS n_recall FROM pr GROUP BY 1")
def macro_avg(spark, d):
    out = S.macro_means(precision_recall_at_k(spark, d), "k", ["precision", "recall"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_precision", "mean_recall")})


@query(_S + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, min(rank) FILTER (label = q_label) AS first_rank FROM r GROUP BY 1")
def rank_of_ref(spark, d):
    """Over the whole corpus."""
    return V.first_rank(_vector_queries(spark, d), table(spark, d, "embeddings"), ("q_label", "label"))


@query(_S + """, f AS (SELECT query_id, min(rank) FILTER (label = q_label) AS r, count(DISTINCT label) AS n FROM knn GROUP BY 1)
SELECT k, CAST(sum(CASE WHEN r <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(n), 6) AS mean_distinct FROM f, (SELECT unnest([1, 3, 5, 8]) AS k) GROUP BY 1""")
def hits_at_k_distinct(spark, d):
    distinct = _knn(spark, d).groupBy("query_id").agg(F.count_distinct("label").alias("n"))
    each = rank_of_ref(spark, d).join(distinct, "query_id").withColumn("k", F.explode(F.array(*map(F.lit, S.KS))))
    return each.groupBy("k").agg(F.sum(F.coalesce((F.col("first_rank") <= F.col("k")).cast("long"), F.lit(0))).alias("hits"), F.round(F.avg("n"), 6).alias("mean_distinct"))


@query(_S + """SELECT query_id, string_agg('[' || rank || '] vector ' || id || chr(10) || 'label ' || label, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM knn GROUP BY 1""")
def context_block(spark, d):
    header = F.concat(F.lit("["), F.col("rank"), F.lit("] vector "), F.col("id"))
    return _knn(spark, d).groupBy("query_id").agg(T.ordered_block(F.col("rank"), header, F.concat(F.lit("label "), F.col("label"))).alias("context"))


@query(_S + """, a AS (SELECT query_id, id, sim, label FROM s WHERE label IN (1, 3))
SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM a QUALIFY rank <= 4""")
def follow_refs(spark, d):
    """References 1, 2, 3 asked for, of which 1 and 3 are allowed. All their rows count."""
    q = _vector_queries(spark, d)
    ref = lambda *r: q.select("query_id", F.explode(F.array(*map(F.lit, r))).alias("ref"))
    vectors = table(spark, d, "embeddings")
    rows, _ = V.follow_refs(ref(1, 2, 3), ref(1, 3), lambda followed: V.cosine_topk(q.join(followed, "query_id"), vectors, 4, extra=("label",), same=("ref", "label")).withColumn("ref", F.col("label")))
    return rows.select("query_id", "id", "sim", "rank")


@query(_S + """, p AS (SELECT query_id, pos, pick FROM q, (VALUES (1, 7), (2, 2), (3, 7), (4, 99), (5, 1)) v(pos, pick) WHERE q_label < 5),
c AS (SELECT p.query_id, id, min(pos) AS pos FROM p JOIN knn ON knn.query_id = p.query_id AND knn.rank = pick GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM c
UNION ALL SELECT query_id, id, rank FROM knn WHERE query_id NOT IN (SELECT query_id FROM c)""")
def select_picks(spark, d):
    picks = F.explode(F.array(*[F.struct(F.lit(a).alias("pos"), F.lit(b).alias("pick")) for a, b in ((1, 7), (2, 2), (3, 7), (4, 99), (5, 1))])).alias("x")
    asked = _vector_queries(spark, d).filter("q_label < 5").select("query_id", picks).select("query_id", "x.*")
    return V.select_picks(_knn(spark, d), asked)


@query("""SELECT round(quantile_cont(sim, 0.5), 9) AS threshold, count(*) AS n_pairs FROM (
SELECT list_dot_product(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS sim FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE sim IS NOT NULL""")
def adjacent_similarity_threshold(spark, d):
    return C.adjacent_threshold(table(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("threshold", F.round("threshold", 9))


# --- lexical retrieval -----------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_BM = f"""WITH dl AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM dl),
tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dl), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id AS id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score, count(*) AS matched FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)
"""


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1")
def corpus_stats(spark, d):
    return V.corpus_stats(table(spark, d, "documents"))


@query(_BM + "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 8")
def bm25_topk(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.bm25_topk(asked, table(spark, d, "documents"), 8).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_SLOT = "CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64"
_VECTORS = """{name}t AS (SELECT id, {slot} AS slot, count(*) AS c FROM (SELECT {id} AS id, unnest({tok}) AS term FROM {table}) GROUP BY ALL),
{name}n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}t GROUP BY 1), {name}v AS (SELECT id, slot, CAST(CAST(c / n AS FLOAT) AS DOUBLE) AS v FROM {name}t JOIN {name}n USING (id))"""


@query(_BM + ", " + _VECTORS.format(name="e", slot=_SLOT, id="doc_id", tok=_TOK, table="documents") + ", " + _VECTORS.format(name="b", slot=_SLOT, id="item_id", tok=_TOK, table="benchmark") + """,
every AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, documents),
dot AS (SELECT bv.id AS query_id, ev.id, round(sum(bv.v * ev.v), 6) AS sim FROM bv JOIN ev USING (slot) GROUP BY 1, 2),
dense AS (SELECT a.id AS query_id, b.id, coalesce(sim, 0) AS sim FROM bn a CROSS JOIN en b LEFT JOIN dot ON dot.query_id = a.id AND dot.id = b.id),
lists AS (SELECT query_id, id, 0 AS list_idx, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, id) AS rank FROM every LEFT JOIN sc USING (query_id, id)
UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) FROM dense)
""" + _FUSED.format(lists="lists").replace("* 1000 +", "* 1000000000 +") + " QUALIFY rank <= 8")
def hybrid_topk(spark, d):
    """BM25 and hashed embeddings, each a ranking of all documents."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.hybrid(asked, table(spark, d, "documents"), hashed_embedding, 8)


# --- provisions, units, chunks ---------------------------------------------------------------------------

_LINES = """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
u AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS unit_ord, text, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ \\t\\n\\x0B\\f\\rA-Za-z0-9]')) AS n_tokens FROM l WHERE regexp_matches(text, '[^ \\t]')),
g AS (SELECT doc_id, unit_ord, n_tokens, text, 1 AS grp, n_tokens AS t FROM u WHERE unit_ord = 0
UNION ALL SELECT u.doc_id, u.unit_ord, u.n_tokens, u.text, CASE WHEN g.t + u.n_tokens + 1 <= 60 THEN g.grp ELSE g.grp + 1 END, CASE WHEN g.t + u.n_tokens + 1 <= 60 THEN g.t + u.n_tokens + 1 ELSE u.n_tokens END FROM g JOIN u ON u.doc_id = g.doc_id AND u.unit_ord = g.unit_ord + 1)
"""


def _units(spark, d) -> DataFrame:
    return C.split_units(table(spark, d, "documents"))


@query(_LINES + "SELECT doc_id, unit_ord, text, n_tokens FROM u")
def split_units(spark, d):
    return _units(spark, d)


@query(_LINES + "SELECT doc_id, unit_ord, n_tokens, grp FROM g")
def pack_size(spark, d):
    return C.pack_size(_units(spark, d), 60).select("doc_id", "unit_ord", "n_tokens", "grp")


@query(_LINES + "SELECT doc_id, grp, CASE WHEN min(unit_ord) = max(unit_ord) THEN CAST(min(unit_ord) + 1 AS VARCHAR) ELSE (min(unit_ord) + 1) || '-' || (max(unit_ord) + 1) END AS label, string_agg(text, chr(10) || chr(10) ORDER BY unit_ord) AS text, count(*) AS n_units FROM g GROUP BY 1, 2")
def merge_ranges(spark, d):
    return C.merge_groups(C.pack_size(_units(spark, d), 60)).withColumn("n_units", F.col("n_units").cast("long"))


_WS = " \\t\\n\\x0B\\f\\r"
_SLICES = "regexp_extract_all({text}, '(?:[" + _WS + "]*(?:[A-Za-z0-9]+|[^" + _WS + "A-Za-z0-9])){{1,{n}}}')"
_LTRIM = "regexp_replace({x}, '^[" + _WS + "]+', '')"
_WIN = _LINES + """, t AS (SELECT doc_id, unit_ord, text, n_tokens AS n, __SLICES__ AS p FROM u WHERE n_tokens > 0),
w AS (SELECT doc_id, unit_ord, CASE WHEN n > 50 THEN CAST(i AS INTEGER) END AS part, least(50, n - 50 * (i - 1)) AS n_tokens, CASE WHEN n <= 50 THEN text ELSE __LTRIM__ END AS body, i
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM t))
""".replace("__SLICES__", _SLICES.format(text="text", n=50)).replace("__LTRIM__", _LTRIM.format(x="p[i]"))


@query(_WIN + "SELECT doc_id, unit_ord, part, n_tokens, body FROM w")
def token_windows(spark, d):
    return C.token_windows(_units(spark, d), 50)


def _chunks(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("unit_ord", F.coalesce("part", F.lit(0)))
    return C.token_windows(_units(spark, d), 50).withColumn("chunk_ord", F.row_number().over(w))


_CH = _WIN + ", c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, i) AS chunk_ord FROM w)\n"


# the last 10 tokens: what is left of the text when all tokens before them are cut off
_TAIL = "regexp_replace(substr({b}, length(array_to_string(array_slice(regexp_extract_all({b}, '[" + _WS + "]*(?:[A-Za-z0-9]+|[^" + _WS + "A-Za-z0-9])'), 1, greatest(0, len(regexp_extract_all({b}, '[A-Za-z0-9]+|[^" + _WS + "A-Za-z0-9]')) - 10)), '')) + 1), '^[" + _WS + "]+|[" + _WS + "]+$', '', 'g')"


@query(_CH + """, b AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY chunk_ord) AS prev FROM c)
SELECT doc_id, chunk_ord, part, CASE WHEN part >= 2 AND prev IS NOT NULL THEN '… ' || """ + _TAIL.format(b="prev") + """ || chr(10) || body ELSE body END AS text FROM b""")
def overlap_tail(spark, d):
    return C.overlap_tail(_chunks(spark, d), 10).select("doc_id", "chunk_ord", "part", "text")


@query(_CH + """, b AS (SELECT doc_id, chunk_ord, ['article', 'recital', 'annex'][doc_id % 3 + 1] || '-' || doc_id || '-' || (unit_ord % 4) || coalesce('#' || part, '') AS base FROM c)
SELECT doc_id, chunk_ord, base || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY chunk_ord) AS n FROM b)""")
def chunk_ids(spark, d):
    kind = F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Annex")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _chunks(spark, d).select("doc_id", "chunk_ord", "part", kind.alias("type"), F.col("doc_id").cast("string").alias("number"), (F.col("unit_ord") % 4).cast("string").alias("paragraph"))
    return C.chunk_ids(rows).select("doc_id", "chunk_ord", "chunk_id")


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '-\\n([a-z])', '\\1', 'g'), '(?m)^[ \\t]*(?:__FURN__)[ \\t]*$', '', 'g'), '(?m)^[ \\t]*(?:EN[ \\t]+[0-9]+[ \\t]+EN|[0-9]{1,4})[ \\t]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS text
FROM (SELECT doc_id, replace(text, '. ', chr(13) || chr(10) || '12' || chr(10) || chr(10) || 'OJ L, 12.7.2024' || chr(10)) || chr(10) AS t FROM documents)""".replace("__FURN__", T.FURNITURE))
def clean_text(spark, d):
    """Documents with page numbers and carriage returns put in at sentence ends."""
    dirty = F.concat(F.replace("text", F.lit(". "), F.lit("\r\n12\n\nOJ L, 12.7.2024\n")), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", T.clean_text(dirty).alias("text"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS chapter,
last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY event_id) AS section
FROM (SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def carry_context(spark, d):
    """Sign-ups open chapters, purchases sections, by user."""
    at = lambda t: F.when(F.col("event_type") == t, F.col("event_id"))
    return C.carry_context(table(spark, d, "events"), "user_id", "event_id", at("signup"), at("purchase")).select("event_id", "user_id", "chapter", "section")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(event_id % 7 + 1 AS INTEGER) AS n FROM events),
s AS (SELECT user_id, min(event_id) AS event_id, 1 AS n FROM e WHERE n = 1 GROUP BY 1
UNION ALL SELECT s.user_id, (SELECT min(e.event_id) FROM e WHERE e.user_id = s.user_id AND e.event_id > s.event_id AND e.n = s.n + 1), s.n + 1 FROM s WHERE s.event_id IS NOT NULL AND s.n < 7)
SELECT user_id, event_id, n FROM s WHERE event_id IS NOT NULL""")
def sequence_filter(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).cast("int").alias("n"))
    return C.sequence_filter(rows, "user_id", "event_id", "n")


@query("SELECT user_id, CAST(sum(new) + 1 AS BIGINT) AS n_clusters, min(value) AS low FROM (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 10 THEN 1 ELSE 0 END AS new FROM events) GROUP BY 1")
def gap_cluster(spark, d):
    return C.gap_clusters(table(spark, d, "events"), "user_id", "value", 10.0)


@query("SELECT doc_id, source, lang FROM (SELECT *, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE lang IS DISTINCT FROM b")
def toc(spark, d):
    return C.toc_breaks(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id", "lang")


@query("""WITH l AS (SELECT conv_id, turn, role = 'user' AS h, role || ': ' || replace(text, chr(10), ' ') AS text FROM conversations),
b AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM l)
SELECT conv_id, block, min(text) FILTER (h) AS header, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (NOT h), '') AS body FROM b WHERE block > 0 GROUP BY 1, 2""")
def split_by_header(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat("role", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return C.split_by_header(lines, "^user: ").withColumnRenamed("doc_id", "conv_id")


@query("SELECT ['Article', 'Recital', 'Annex'][doc_id % 3 + 1] AS type, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, d):
    kind = F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Annex")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@query("""SELECT lower(type) AS kind, num, list_sort(list_distinct(flatten(list(CASE WHEN b > a THEN [CAST(x AS VARCHAR) FOR x IN range(a, b + 1)] ELSE [CAST(a AS VARCHAR)] END)))) AS labels
FROM (SELECT ['Article', 'Recital', 'Annex'][doc_id % 3 + 1] AS type, CAST(doc_id AS INTEGER) AS num, n_chars % 9 AS a, n_chars % 9 + n_chars % 4 AS b FROM documents) WHERE type <> 'Recital' GROUP BY 1, 2""")
def paragraph_index(spark, d):
    kind = F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Annex")), (F.col("doc_id") % 3 + 1).cast("int"))
    a, b = F.col("n_chars") % 9, F.col("n_chars") % 9 + F.col("n_chars") % 4
    label = F.when(b > a, F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).otherwise(a.cast("string"))
    return S.paragraph_index(table(spark, d, "documents").select(kind.alias("type"), F.col("doc_id").cast("string").alias("number"), label.alias("paragraph")))


def _provisions(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    n = F.col("doc_id").cast("int")
    kind = F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Annex")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.when(kind == "Annex", F.coalesce(R.int_to_roman(n), n.cast("string"))).when(kind == "Recital", F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"))).otherwise(n.cast("string"))
    return doc.select(F.col("doc_id").alias("chunk_id"), kind.alias("type"), number.alias("number"), F.concat(R.int_to_roman(n % 9 + 1), F.lit(" - Title")).alias("chapter"), F.concat((n % 5).cast("string"), F.lit(" - Part")).alias("section"))


def _roman_sql(n: str) -> str:
    return f"['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][({n}) // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][({n}) % 10 + 1]"


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS t, doc_id % 9 + 1 AS c, doc_id % 5 AS s FROM documents), b AS (SELECT item_id AS query_id, item_id % 7 AS i, item_id % 90 + 1 AS n FROM benchmark)
SELECT query_id, doc_id AS chunk_id FROM b JOIN d ON t = 0 AND doc_id BETWEEN n AND n + 3 WHERE i = 0 UNION ALL
SELECT query_id, doc_id FROM b JOIN d ON t = 2 AND doc_id IN (n, n + 4) WHERE i = 1 UNION ALL
SELECT query_id, doc_id FROM b JOIN d ON t = 1 AND doc_id <= n + 1 AND doc_id + 2 >= n WHERE i = 2 UNION ALL
SELECT query_id, doc_id FROM b JOIN d ON c = n % 9 + 1 AND s = n % 5 WHERE i = 3 UNION ALL
SELECT query_id, doc_id FROM b JOIN d ON s = n % 5 WHERE i = 4 UNION ALL
SELECT query_id, doc_id FROM b JOIN d ON c = n % 9 + 1 WHERE i = 5""")
def metadata_match(spark, d):
    """A question for each benchmark item, against all provisions."""
    n, i = (F.col("item_id") % 90 + 1).cast("int"), F.col("item_id") % 7
    say = lambda form, *x: F.format_string(form, *x)
    text = F.when(i == 0, say("what do articles %d to %d say", n, n + 3)).when(i == 1, say("explain annex %s and annex %d", R.int_to_roman(n), n + 4)).when(i == 2, say("recital %d, %d", n, n + 1))
    text = text.when(i == 3, say("chapter %d section %d", n % 9 + 1, n % 5)).when(i == 4, say("section %d", n % 5)).when(i == 5, say("chapter %s", R.int_to_roman(n % 9 + 1))).otherwise("hello")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(R.parse_question(text)).alias("r")).select("query_id", "r.*")
    return R.match_provisions(_provisions(spark, d), asked).select("query_id", "chunk_id")


def _named_refs(refs: F.Column) -> F.Column:
    return F.array_join(F.transform(refs, lambda r: F.concat_ws(" ", r["kind"], r["num"].cast("string"))), ", ")


def _texts(spark, d, *forms) -> DataFrame:
    """doc_id, n and text: one of the forms of n = doc_id % 90 + 1, by doc_id."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 90 + 1).cast("int").alias("n"), (F.col("doc_id") % len(forms)).alias("i"))
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(F.col("i") == i, f(F.col("n"))).otherwise(text)
    return docs.withColumn("text", text)


def _text_sql(*values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"SELECT doc_id, CASE doc_id % {len(values)} {cases} END AS {{name}} FROM (SELECT doc_id, CAST(doc_id % 90 + 1 AS INTEGER) AS n FROM documents)"


_say = lambda form, *f: lambda n: F.format_string(form, *[x(n) for x in f])
_own = lambda n: n
_plus = lambda k: lambda n: n + k
_list = lambda *x: "array_to_string(list_sort([" + ", ".join(x) + "]), ', ')"


@query(_text_sql(
    _list("'article ' || n", "'article ' || (n + 1)", "'article ' || (n + 2)"), _list("'annex ' || " + _roman_sql("n"), "'recital ' || n"), _list("'recital ' || n", "'recital ' || (n + 1)", "'article ' || (n + 5)"),
    "'chapter ' || " + _roman_sql("n") + " || ', section ' || n", "'article ' || n", "''", _list("'annex ' || " + _roman_sql("n"), "'annex ' || " + _roman_sql("n + 1")), "'preamble 0'",
).replace("{name}", "refs"))
def parse_question(spark, d):
    rows = _texts(
        spark, d, _say("what do articles %d to %d say?", _own, _plus(2)), _say("explain annex %s and recital %d", R.int_to_roman, _own), _say("recitals %d, %d and article %d", _own, _plus(1), _plus(5)),
        _say("Chapter %d Section %d", _own, _own), _say("art. %d(2) on bias", _own), _say("how many annexes are there in %d? annex civil liability", _own), _say("annexes %s and %d", R.int_to_roman, _plus(1)), _say("what does the preamble say in %d", _own),
    )
    return rows.select("doc_id", _named_refs(R.parse_question(F.col("text"))).alias("refs"))


_refs_sql = lambda *x: "array_to_string(list_transform(list_sort([" + ", ".join("{'k': '" + k + "', 'n': CAST(" + n + " AS INTEGER)}" for k, n in x) + "]), lambda r: r.k || ' ' || r.n), ', ')"


@query(_text_sql(
    _refs_sql(("article", "n")), _refs_sql(("article", "n")), _refs_sql(("recital", "n"), ("recital", "n + 1"), ("article", "n + 2")), _refs_sql(("annex", "3"), ("article", "n"), ("article", "n + 1"), ("article", "n + 2"), ("article", "n + 9")),
    _refs_sql(("article", "n")), _refs_sql(("annex", "n")), "'preamble 0'", "''", _refs_sql(("article", "n"), ("article", "n + 3")), _refs_sql(("annex", "143")),
).replace("{name}", "refs"))
def parse_refs(spark, d):
    rows = _texts(
        spark, d, _say("artcile %d(a)", _own), _say("article %d(2), %d(5)", _own, _own), _say("Recital %d, %d, article %d", _own, _plus(1), _plus(2)), _say("annex 3, Article %d-%d, %d", _own, _plus(2), _plus(9)),
        _say("Section 4, article %d", _own), _say("Annex %s(2)", lambda n: F.when(n < 90, R.int_to_roman(n)).otherwise(n.cast("string"))), _say("Preamble %d", _own), lambda n: F.lit(""), _say("articles %d to %d", _own, _plus(3)), lambda n: F.lit("annex civil liability"),
    )
    return rows.select("doc_id", _named_refs(R.parse_refs(F.col("text"))).alias("refs"))


@query(_text_sql(
    "'article|' || n || '|1,2,3'", "'annex|' || n || '|' || n", "'recital|' || n || '|'", "NULL", "NULL", "'article|' || n || '|'",
).replace("{name}", "detail"))
def citation_detail(spark, d):
    rows = _texts(spark, d, _say("Article %d(1-3)", _own), _say("Annex %s(%d)", lambda n: F.when(n < 90, R.int_to_roman(n)).otherwise(n.cast("string")), _own), _say("Recitals %d-%d", _own, _plus(2)), _say("Article %da", _own), _say("see Article %d", _own), _say(" Article %d ", _own))
    c = R.citation_detail(F.col("text"))
    return rows.select("doc_id", F.concat_ws("|", c["kind"], c["num"].cast("string"), F.array_join(F.array_sort(c["labels"]), ",")).alias("t"), c.alias("c")).select("doc_id", F.when(F.col("c").isNotNull(), F.col("t")).alias("detail"))


@query("""SELECT doc_id, ['','M','MM','MMM'][n // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] AS roman, CAST(n AS INTEGER) AS back FROM (SELECT doc_id, doc_id % 3999 + 1 AS n FROM documents)""")
def roman(spark, d):
    r = R.int_to_roman((F.col("doc_id") % 3999 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", r.alias("roman"), R.roman_to_int(r).alias("back"))


@query(_text_sql("n || ',' || (n + 1) || ',' || (n + 2)", "CAST(n AS VARCHAR)", "''", "''", "n || ',' || (n + 1)", "n || 'a'").replace("{name}", "items"))
def expand_range(spark, d):
    rows = _texts(spark, d, _say("%d-%d", _own, _plus(2)), _say("%d", _own), lambda n: F.lit(""), _say("%d-%d", _plus(3), _own), _say("%d – %d", _own, _plus(1)), _say(" %da", _own))
    return rows.select("doc_id", F.array_join(R.expand_range(F.col("text")), ",").alias("items"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, CAST(n_chars % 40 AS INTEGER), doc_id) AS place FROM documents")
def lead_int_sort(spark, d):
    """The place of every document in the order of type, leading number and id, as in an export."""
    label = F.concat((F.col("n_chars") % 40).cast("string"), F.lit("-"), F.col("n_chars").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("kind"), R.lead_int(label).alias("lead"))
    return S.places(rows, ["kind", "lead"], "doc_id").select("doc_id", "place")


REFUSED = "I cannot find an answer to this in the EU AI Act excerpts provided"


@query(f"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{REFUSED}. ' || text WHEN 1 THEN '  ' || repeat('x', CAST(doc_id % 60 AS INTEGER)) || upper('{REFUSED}') WHEN 2 THEN text END AS answer FROM documents)
SELECT doc_id, coalesce(contains(substr(lower(trim(answer)), 1, {len(REFUSED) + 40}), lower('{REFUSED}')), false) AS refusal FROM a""")
def is_refusal(spark, d):
    i = F.col("doc_id") % 4
    answer = F.when(i == 0, F.concat(F.lit(REFUSED + ". "), "text")).when(i == 1, F.concat(F.lit("  "), F.repeat(F.lit("x"), (F.col("doc_id") % 60).cast("int")), F.lit(REFUSED.upper()))).when(i == 2, F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.is_refusal(answer).alias("refusal"))


@query(_text_sql("'Article ' || n || '(2)|Annex iv'", "'RECITAL ' || n", "''").replace("{name}", "cited"))
def citation_dedup(spark, d):
    rows = _texts(spark, d, _say("See article %d(2) and  Article  %d(2), then annex iv.", _own, _own), _say("RECITAL %d; recital %d", _own, _own), lambda n: F.lit("none"))
    return rows.select("doc_id", F.array_join(T.citations(F.col("text")), "|").alias("cited"))


@query(_text_sql("'annex 3'", "''", _list("'article ' || (n + 1)", "'article ' || (n + 2)", "'recital 7'")).replace("{name}", "unsupported"))
def unsupported_citations(spark, d):
    rows = _texts(spark, d, _say("Yes (Article %d, Annex III).", _own), _say("Yes (Article %d(5)).", _own), _say("No (Recital 7, Article %d-%d)", _own, _plus(2)))
    return rows.select("doc_id", F.array_join(R.unsupported_citations(F.col("text"), F.format_string("Article %d", "n")), ", ").alias("unsupported"))


# --- scoring ---------------------------------------------------------------------------------------------

_RUNS = """WITH runs AS (SELECT l.doc_id AS run_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS should_answer, toxic = 1 AS refused, lang AS category, source,
CASE WHEN l.doc_id % 4 = 0 THEN [] ELSE [CAST(l.doc_id % 5 AS BIGINT), CAST(l.doc_id % 7 AS BIGINT)] END AS expected, [CAST((l.doc_id + i) % 7 AS BIGINT) FOR i IN range(1, 6)] AS got,
CASE WHEN l.doc_id % 11 = 0 THEN 'timeout' END AS error, n_chars / 100.0 AS latency FROM labels l JOIN documents d USING (doc_id)),
sc AS (SELECT *, CASE WHEN should_answer = 'no' THEN CASE WHEN refused THEN 1 ELSE 0 END WHEN len(expected) = 0 THEN NULL WHEN list_has_all(got, expected) THEN 1 ELSE 0 END AS score FROM runs)
"""


def _runs(spark, d) -> DataFrame:
    n = F.col("doc_id")
    got = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")), lambda i: (n + i) % 7)
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = rows.select(
        n.alias("run_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("should_answer"), (F.col("toxic") == 1).alias("refused"), F.col("lang").alias("category"), "source",
        F.when(n % 4 == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(n % 5, n % 7)).alias("expected"), got.alias("got"), F.when(n % 11 == 0, "timeout").alias("error"), (F.col("n_chars") / 100.0).alias("latency"),
    )
    return rows.withColumn("score", S.strict_score(F.col("should_answer"), F.col("refused"), F.col("expected"), F.col("got")))


@query(_RUNS + "SELECT run_id, score, array_to_string(list_sort(list_distinct([x FOR x IN expected IF NOT list_contains(got, x)])), ',') AS missing FROM sc")
def strict_score(spark, d):
    return _runs(spark, d).select("run_id", "score", F.array_join(S.missing_refs(F.col("expected"), F.col("got")), ",").alias("missing"))


@query(_RUNS + "SELECT run_id, CASE WHEN should_answer = 'yes' AND len(expected) > 0 THEN CAST(list_has_any(got[1:3], expected) AS INTEGER) END AS top3 FROM sc")
def top3_hit(spark, d):
    return _runs(spark, d).select("run_id", S.top_hit(F.col("should_answer"), F.col("expected"), F.col("got")).alias("top3"))


@query(_RUNS + "SELECT 'score' AS metric, round(avg(score), 6) AS score, count(score) AS n FROM sc UNION ALL SELECT 'latency', round(avg(latency), 6), count(latency) FROM sc")
def eval_summary(spark, d):
    return S.summary(_runs(spark, d), ["score", "latency"]).withColumn("score", F.round("score", 6))


@query(_RUNS + "SELECT coalesce(nullif(trim(category), ''), 'uncategorised') AS category, count(*) AS n, count(score) AS graded, count(*) FILTER (score = 1) AS passed FROM sc GROUP BY 1")
def category_stats(spark, d):
    return S.category_stats(_runs(spark, d), "category", "score")


@query(_RUNS + "SELECT count(*) FILTER (should_answer = 'no') AS due, count(*) FILTER (should_answer = 'no' AND refused) AS correct_refusals, count(*) FILTER (should_answer <> 'no') AS answerable, count(*) FILTER (should_answer <> 'no' AND refused) AS false_refusals, count(error) AS errors FROM sc")
def refusal_stats(spark, d):
    return S.refusal_stats(_runs(spark, d))


@query(_RUNS + "SELECT count(score) AS scored, count(*) FILTER (score = 0) AS misses, round(count(*) FILTER (score = 0) / nullif(count(score), 0), 6) AS failure_rate FROM sc")
def failure_rate(spark, d):
    misses = F.count_if(F.col("score") == 0)
    return _runs(spark, d).agg(F.count("score").alias("scored"), misses.alias("misses"), F.round(F.try_divide(misses, F.count("score")), 6).alias("failure_rate"))


@query("""WITH r AS (SELECT quality AS h, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 - toxic END AS j FROM labels),
c AS (SELECT count(*) FILTER (h = 1 AND j = 1) AS tp, count(*) FILTER (h = 0 AND j = 0) AS tn, count(*) FILTER (h = 0 AND j = 1) AS fp, count(*) FILTER (h = 1 AND j = 0) AS fn, count(*) FILTER (j IS NULL) AS n_none FROM r)
SELECT *, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 3) AS agreement, round(tp / nullif(tp + fn, 0), 3) AS tpr, round(tn / nullif(tn + fp, 0), 3) AS tnr FROM c""")
def confusion_matrix(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("h"), F.when(F.col("doc_id") % 11 != 0, 1 - F.col("toxic")).alias("j"))
    return S.confusion(rows, "h", "j")


@query(_RUNS + """SELECT run_id, CASE WHEN error IS NOT NULL THEN NULL WHEN refused THEN 1 END AS groundedness, CASE WHEN error IS NOT NULL THEN NULL WHEN refused THEN CASE WHEN should_answer = 'no' THEN 1 ELSE 0 END END AS relevance,
CASE WHEN error IS NOT NULL THEN NULL WHEN should_answer = 'no' THEN CASE WHEN refused THEN 1 ELSE 0 END WHEN refused THEN 0 END AS correctness,
error IS NULL AND NOT refused AND len(expected) > 0 AS asks_groundedness, error IS NULL AND should_answer <> 'no' AND NOT refused AND category <> 'fr' AS asks_correctness FROM sc""")
def judge_rules(spark, d):
    rows = _runs(spark, d).withColumn("reference", F.when(F.col("category") != "fr", F.col("category")))
    j = L.judge_rules(F.col("error"), F.col("refused"), F.col("should_answer"), F.col("reference"), F.size("expected") > 0)
    return rows.withColumn("j", j).select("run_id", *[F.col(f"j.{k}.score").alias(k) for k in ("groundedness", "relevance", "correctness")], *[F.col(f"j.{k}.needs_judge").alias(f"asks_{k}") for k in ("groundedness", "correctness")])


@query("SELECT user_id AS run_id, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def feedback_pivot(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return L.feedback_pivot(rows, ["click", "error", "purchase", "signup", "view"])


@query("SELECT user_id, m.e AS experiment, m.s AS start FROM (SELECT user_id, max({'s': event_id, 'e': event_type}) AS m FROM events GROUP BY 1)")
def latest_experiment(spark, d):
    return L.latest_experiment(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL)
SELECT coalesce(x.user_id, y.user_id) AS user_id, CAST(x.v AS BIGINT) AS a, CAST(y.v AS BIGINT) AS b, CAST(y.v - x.v AS BIGINT) AS delta, x.v IS DISTINCT FROM y.v AS differs FROM (SELECT * FROM a WHERE event_type = 'view') x FULL JOIN (SELECT * FROM a WHERE event_type = 'error') y ON x.user_id = y.user_id""")
def arm_compare(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return S.compare_arms(rows.filter("event_type = 'view'"), rows.filter("event_type = 'error'"), "user_id", "v")


@query("SELECT event_type AS arm, count(*) AS n, round(sum(value), 2) AS total_cost, round(avg(value), 4) AS mean_cost, round(median(value), 4) AS median_latency FROM events GROUP BY 1")
def cost_accounting(spark, d):
    out = S.arm_totals(table(spark, d, "events"), "event_type", "value", "value")
    return out.withColumns({"total_cost": F.round("total_cost", 2), "mean_cost": F.round("mean_cost", 4), "median_latency": F.round("median_latency", 4)})


@query("SELECT event_type, round(avg(n), 6) AS mean_runs FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def run_means(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean_runs"))


@query("""WITH r AS (SELECT user_id AS ref, event_type AS variant, count(*) AS rank FROM events GROUP BY ALL)
SELECT coalesce(x.ref, y.ref) AS ref, x.rank AS before, y.rank AS after FROM (SELECT * FROM r WHERE variant = 'view') x FULL JOIN (SELECT * FROM r WHERE variant = 'click') y ON x.ref = y.ref WHERE x.rank IS DISTINCT FROM y.rank""")
def rank_changes(spark, d):
    ranks = table(spark, d, "events").groupBy(F.col("user_id").alias("ref"), F.col("event_type").alias("variant")).agg(F.count("*").alias("rank"))
    return S.rank_changes(ranks, "view", "click")


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY event_type) AS step, count(*) AS hits FROM events GROUP BY event_type),
l AS (SELECT step, hits, true AS kept, hits AS best FROM e WHERE step = 1
UNION ALL SELECT e.step, e.hits, e.hits >= l.best + 3, CASE WHEN e.hits >= l.best + 3 THEN e.hits ELSE l.best END FROM l JOIN e ON e.step = l.step + 1)
SELECT step, hits, kept FROM l""")
def decision_rule(spark, d):
    from pyspark.sql import Window

    steps = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("hits")).withColumn("step", F.row_number().over(Window.orderBy("event_type")))
    return S.ladder(steps, 3)


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN quality END, 1 - toxic) AS score, doc_id % 5 = 0 AS overridden FROM labels")
def label_override(spark, d):
    results = table(spark, d, "labels").select("doc_id", (1 - F.col("toxic")).alias("judge_score"))
    human = table(spark, d, "labels").filter("doc_id % 5 = 0").select("doc_id", F.col("quality").alias("human_score"))
    return L.with_overrides(results, human, ["doc_id"]).select("doc_id", "score", "overridden")


@query("""WITH l AS (SELECT doc_id, 'lesson ' || doc_id AS lesson, toxic AS js, quality AS hs FROM labels),
s AS (SELECT doc_id, CASE WHEN toxic + quality > 0 THEN 1 - toxic END AS judge, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars % 2 END AS human FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(lesson, '') AS lesson, CASE WHEN a IN ('insert', 'update') THEN judge ELSE js END AS judge_score, CASE WHEN a IN ('insert', 'update') THEN human ELSE hs END AS human_score, a AS action FROM (
SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, lesson, js, hs, judge, human, CASE WHEN s.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND judge IS NOT DISTINCT FROM human THEN 'delete' WHEN s.doc_id IS NOT NULL AND judge IS DISTINCT FROM human AND human IS NOT NULL THEN CASE WHEN l.doc_id IS NOT NULL THEN 'update' ELSE 'insert' END WHEN l.doc_id IS NOT NULL THEN 'keep' END AS a FROM l FULL JOIN s ON l.doc_id = s.doc_id) WHERE a IS NOT NULL""")
def label_merge(spark, d):
    t = table(spark, d, "labels")
    labels = t.select("doc_id", F.concat(F.lit("lesson "), F.col("doc_id")).alias("lesson"), F.col("toxic").alias("judge_score"), F.col("quality").alias("human_score"), F.lit("old").alias("judge_reasoning"))
    sheet = table(spark, d, "documents").join(t, "doc_id", "left").select("doc_id", F.when(F.col("toxic") + F.col("quality") > 0, 1 - F.col("toxic")).alias("judge"), F.when(F.col("n_chars") % 4 != 0, F.col("n_chars") % 2).alias("human"), F.lit("new").alias("reasoning"))
    return L.merge_labels(labels, sheet, ["doc_id"]).drop("judge_reasoning")


_JSON = {0: '```json\\n{"score": %d}\\n``` end {x}', 1: 'x {"score": "%d"} y', 2: '{"score": %d}', 3: "no object %d", 4: '{"score": null, "n": %d}', 5: '{"score": "high", "n": %d}'}


@query("""SELECT doc_id, CASE i WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CASE WHEN v IN (0, 1) THEN CAST(v AS INTEGER) END END AS score,
CASE i WHEN 3 THEN 'no score' WHEN 4 THEN 'no score' WHEN 5 THEN 'score is not a number: high' ELSE CASE WHEN v NOT IN (0, 1) THEN 'score out of range: ' || v END END AS reason
FROM (SELECT doc_id, doc_id % 6 AS i, quality + toxic + doc_id % 2 AS v FROM labels)""")
def judge_verdicts(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 6).alias("i"), (F.col("quality") + F.col("toxic") + F.col("doc_id") % 2).alias("v"))
    said = F.lit(None).cast("string")
    for i, form in _JSON.items():
        said = F.when(F.col("i") == i, F.format_string(form.replace("\\n", "\n"), F.col("v"))).otherwise(said)
    score, none = F.get_json_object(T.json_object(said), "$.score"), F.lit(None).cast("string")
    return rows.select("doc_id", T.verdict(score, none).alias("score"), T.verdict_reason(score, none).alias("reason"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Location: Chapter ' || """ + _roman_sql("doc_id % 9 + 1") + """ || ' (HIGH RISK) > Section ' || (doc_id % 5) || ' (' || source || ')' WHEN 1 THEN 'Location: Chapter ' || """ + _roman_sql("doc_id % 9 + 1") + """ END AS line FROM documents""")
def location_line(spark, d):
    n, i = R.int_to_roman((F.col("doc_id") % 9 + 1).cast("int")), F.col("doc_id") % 3
    chapter = F.when(i == 0, F.concat(n, F.lit(" - HIGH RISK"))).when(i == 1, n).otherwise("")
    section = F.when(i == 0, F.concat((F.col("doc_id") % 5).cast("string"), F.lit(" - "), "source")).otherwise("")
    return table(spark, d, "documents").select("doc_id", T.location_line(chapter, section).alias("line"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:1], '') AS first_line, source FROM documents WHERE contains(lower(source), 'src1')")
def citation_filter(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id", F.split("text", "\n")[0].alias("first_line"), "source")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY 1")
def full_document(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), F.size("r").cast("long").alias("n"))


@query("SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def extract_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\f\r]+", " ")).alias("text"))


_TURNS = "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations"


def _regulations(spark, d) -> DataFrame:
    """Conversations as regulations: a preamble, a recital for each role, 50 turns to an article, an annex of roles."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")).alias("t"))
    line = F.concat(F.when(F.col("turn") % 50 == 0, F.concat(F.lit("Article "), F.floor(F.col("turn") / 50) + 1, F.lit("\nAll turns\n"))).otherwise(""), F.col("turn") % 50 + 1, F.lit(". "), F.col("t"))
    body = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("r"), F.array_sort(F.collect_set("role")).alias("roles"))
    numbered = lambda form: F.array_join(F.transform("roles", lambda x, i: F.format_string(form, i + 1, x)), "\n")
    head = F.concat(F.lit("ACT ON CONVERSATION "), F.col("conv_id"), F.lit("\nlaying down what was said in it by all of those who took part, in the order in which they spoke\nHaving regard to them,\nWhereas:\n"))
    text = F.concat(head, numbered("(%d) %s"), F.lit("\n(1) OJ C 5, a footnote\nHAVE ADOPTED THIS REGULATION:\nCHAPTER I\nGeneral - part\nSECTION 2\nTurns\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"), F.lit("\nANNEX IV\nRoles\n"), numbered("(%d) %s"))
    return body.select(F.col("conv_id").alias("doc_id"), text.alias("text"))


@query("""WITH t AS (""" + _TURNS + """)
SELECT conv_id AS doc_id, 'Article' AS type, CAST(turn // 50 + 1 AS VARCHAR) AS number, CAST(turn % 50 + 1 AS VARCHAR) AS paragraph, 'All turns' AS title, 'I - General - part' AS chapter, '2 - Turns' AS section, (turn % 50 + 1) || '. ' || t AS text FROM t WHERE t <> ''""")
def structure_roundtrip(spark, d):
    """Conversations written out as chapters, sections, articles and paragraphs, then parsed back."""
    from .operators import structure as X

    return X.parse_provisions(X.marked_lines(_regulations(spark, d))).filter("type = 'Article'").select("doc_id", "type", "number", "paragraph", "title", "chapter", "section", "text")


_UNITS = """WITH t AS (""" + _TURNS + """), roles AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY role) AS i FROM (SELECT DISTINCT conv_id, role FROM conversations)),
c AS (SELECT DISTINCT conv_id FROM t),
un AS (SELECT conv_id, 0 AS z, 1 AS o, 'Preamble' AS type, '0' AS number, NULL AS paragraph, 'Preamble' AS citation, '' AS crumb, 'ACT ON CONVERSATION ' || conv_id || chr(10) || 'laying down what was said in it by all of those who took part, in the order in which they spoke' AS text FROM c
UNION ALL SELECT conv_id, 0, 2, 'Preamble', '0', NULL, 'Preamble', '', 'Having regard to them,' FROM c UNION ALL SELECT conv_id, 0, 3, 'Preamble', '0', NULL, 'Preamble', '', 'Whereas:' FROM c
UNION ALL SELECT conv_id, 1, i, 'Recital', CAST(i AS VARCHAR), NULL, 'Recital ' || i, '', '(' || i || ') ' || role FROM roles
UNION ALL SELECT conv_id, 2, turn, 'Article', CAST(turn // 50 + 1 AS VARCHAR), CAST(turn % 50 + 1 AS VARCHAR), 'Article ' || (turn // 50 + 1) || '(' || (turn % 50 + 1) || ')', 'Chapter I: General - part' || chr(10) || 'Section 2: Turns' || chr(10) || 'Article ' || (turn // 50 + 1) || ': All turns', (turn % 50 + 1) || '. ' || t FROM t WHERE t <> ''
UNION ALL SELECT conv_id, 3, i, 'Annex', 'IV', CAST(i AS VARCHAR), 'Annex IV(' || i || ')', 'Annex IV: Roles', i || '. ' || role FROM roles)
"""


@query(_UNITS + "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY z, o) - 1 AS unit_ord, type, number, paragraph, citation, crumb AS breadcrumb, text FROM un")
def parse_units(spark, d):
    """All parts of the same regulations: preamble clauses, recitals, articles, annexes, with their context lines."""
    from .operators import structure as X

    units = X.parse_units(_regulations(spark, d))
    return units.select("doc_id", F.col("unit_ord").cast("long").alias("unit_ord"), "type", "number", "paragraph", "citation", "breadcrumb", "text")


_TOKENS = "len(regexp_extract_all({x}, '[A-Za-z0-9]+|[^" + _WS + "A-Za-z0-9]'))"


@query(_UNITS + ", n AS (SELECT *, " + _TOKENS.format(x="text") + " AS n FROM un), m AS (SELECT *, 46 - " + _TOKENS.format(x="crumb") + """ AS b FROM n WHERE n > 0),
p AS (SELECT *, greatest(b, 10) AS most, CASE greatest(b, 10) """ + " ".join(f"WHEN {k} THEN " + _SLICES.format(text="text", n=k) for k in (46, 42, 31)) + """ END AS parts FROM m),
w AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p), x AS (SELECT *, n > most AS cut, CASE WHEN n <= most THEN text ELSE """ + _LTRIM.format(x="parts[i]") + """ END AS body FROM w),
y AS (SELECT *, lag(body) OVER (PARTITION BY conv_id ORDER BY z, o, i) AS prev, lower(type) || '-' || number || coalesce('-' || paragraph, '') || CASE WHEN cut THEN '#' || i ELSE '' END AS base FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY z, o, i) AS nth FROM y)
SELECT conv_id AS doc_id, base || CASE WHEN nth > 1 THEN '__' || nth ELSE '' END AS chunk_id, citation, CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) END || CASE WHEN cut AND i >= 2 THEN '… ' || """ + _TAIL.format(b="prev") + """ || chr(10) ELSE '' END || body AS text FROM k""")
def chunk_document(spark, d):
    """The same regulations as chunks of at most 60 tokens, 10 of them overlap, one unit each."""
    from .config import Config
    from .plans.ingest import chunk_documents

    return chunk_documents(_regulations(spark, d), Config(window=60, overlap=10, packing="none")).select("doc_id", "chunk_id", "citation", "text")


@query(_UNITS.replace("WITH t AS", "WITH RECURSIVE t AS") + """, n AS (SELECT *, """ + _TOKENS.format(x="text") + """ AS n, 446 - """ + _TOKENS.format(x="crumb") + """ AS b, CASE WHEN z < 2 THEN type ELSE type || number END AS root, row_number() OVER (PARTITION BY conv_id ORDER BY z, o) AS u FROM un),
r AS (SELECT conv_id, u, root, n AS t, 1 AS grp FROM n WHERE u = 1
UNION ALL SELECT n.conv_id, n.u, n.root, CASE WHEN n.root = r.root AND r.t + n.n + 1 <= n.b THEN r.t + n.n + 1 ELSE n.n END, CASE WHEN n.root = r.root AND r.t + n.n + 1 <= n.b THEN r.grp ELSE r.grp + 1 END FROM r JOIN n ON n.conv_id = r.conv_id AND n.u = r.u + 1)
SELECT conv_id AS doc_id, CAST(grp AS BIGINT) AS grp, CASE WHEN count(*) = 1 OR min(type) = 'Preamble' THEN min(citation) WHEN min(type) = 'Recital' THEN 'Recitals ' || min_by(number, u) || '-' || max_by(number, u) ELSE min(type) || ' ' || min(number) || '(' || min_by(paragraph, u) || '-' || max_by(paragraph, u) || ')' END AS citation,
CASE WHEN min(type) = 'Preamble' THEN string_agg(text, chr(10) ORDER BY u) ELSE string_agg(text, chr(10) || chr(10) ORDER BY u) END AS text FROM r JOIN n USING (conv_id, u) GROUP BY 1, 2""")
def pack_units(spark, d):
    """The same regulations packed to groups of one root, with their ranges, before windows are cut."""
    from .config import Config
    from .operators import structure as X

    units = X.parse_units(_regulations(spark, d)).withColumn("root", C.citation_root(F.col("type"), F.col("number"), F.col("chapter"), F.col("section")))
    units = units.withColumn("n_tokens", F.size(T.budget_tokens(F.col("text")))).withColumn("c", F.size(T.budget_tokens(F.col("breadcrumb"))))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("unit_ord")
    packed = C.pack(units.withColumn("j", F.col("root") == F.lag("root").over(w)), F.lit(Config().budget) - F.col("c"), F.col("j"))
    merged = C.merge_units(packed)
    return merged.withColumn("grp", F.row_number().over(w).cast("long")).select("doc_id", "grp", "citation", "text")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Sub-questions:' || chr(10) || '1. in ' || lang || chr(10) || '2. from ' || source || chr(10) || 'Assumptions: x; ' || lang WHEN 1 THEN 'Assumptions: x; ' || lang WHEN 2 THEN 'Sub-questions:' || chr(10) || '1. in ' || lang || chr(10) || '2. from ' || source END AS notes FROM documents""")
def notes_block(spark, d):
    i, none = F.col("doc_id") % 4, F.expr("cast(array() as array<string>)")
    asked = F.array(F.concat(F.lit("in "), "lang"), F.concat(F.lit("from "), "source"))
    questions = F.when(i.isin(0, 2), asked).otherwise(F.slice(asked, 1, 1))
    return table(spark, d, "documents").select("doc_id", T.notes_block(questions, F.when(i.isin(0, 1), F.array(F.lit("x"), F.col("lang"))).otherwise(none)).alias("notes"))


@query("SELECT toxic, string_agg('- ' || doc_id || ': judge ' || toxic || ', human ' || quality || CASE WHEN doc_id % 2 = 0 THEN ' (even)' ELSE '' END, chr(10) ORDER BY doc_id) AS block FROM labels WHERE toxic <> quality GROUP BY 1")
def calibration(spark, d):
    rows = table(spark, d, "labels").filter("toxic <> quality")
    lesson = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("")
    return rows.groupBy("toxic").agg(T.calibration_block(F.col("doc_id"), F.col("doc_id").cast("string"), F.col("toxic"), F.col("quality"), lesson).alias("block"))


@query("""WITH r AS (SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels)
SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN a IS DISTINCT FROM b THEN 'differs' END, CASE WHEN a = 1 AND b IS DISTINCT FROM 1 THEN 'only_a' END, CASE WHEN b = 1 AND a IS DISTINCT FROM 1 THEN 'only_b' END, CASE WHEN a = 0 AND b = 0 THEN 'both_wrong' END, 'all'], lambda x: x IS NOT NULL)) AS kind FROM r) GROUP BY 1""")
def report_filters(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    one = F.lit(1)
    kinds = F.array_compact(F.array(
        F.when(~F.col("a").eqNullSafe(F.col("b")), "differs"), F.when((F.col("a") == 1) & ~F.col("b").eqNullSafe(one), "only_a"),
        F.when((F.col("b") == 1) & ~F.col("a").eqNullSafe(one), "only_b"), F.when((F.col("a") == 0) & (F.col("b") == 0), "both_wrong"), F.lit("all"),
    ))
    return rows.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (h IS NOT NULL) AS reviewed, round((count(*) FILTER (h IS NOT NULL) - count(*) FILTER (h IS NOT NULL AND h <> j)) / nullif(count(*) FILTER (h IS NOT NULL), 0), 6) AS agreement FROM (SELECT 1 - toxic AS j, CASE WHEN doc_id % 5 = 0 THEN quality END AS h FROM labels)")
def override_agreement(spark, d):
    rows = table(spark, d, "labels").select((1 - F.col("toxic")).alias("j"), F.when(F.col("doc_id") % 5 == 0, F.col("quality")).alias("h"))
    seen = F.col("h").isNotNull()
    return rows.agg(F.count_if(seen).alias("reviewed"), F.round(S.override_agreement(seen, F.col("h") != F.col("j")), 6).alias("agreement"))


# --- pages, contents, exports ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id // 12 AS page, CAST(event_id * 37 % 842 AS DOUBLE) AS y, 40 + event_id % 50 AS x0, 15 + event_id % 50 AS w FROM events),
sep AS (SELECT DISTINCT page, round(y) AS y FROM r WHERE w BETWEEN 40 AND 60 AND x0 BETWEEN 40 AND 80 AND y > 0.55 * 842),
n AS (SELECT page, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 10 THEN 0 ELSE 1 END AS new FROM sep), c AS (SELECT page, sum(new) AS n, min(y) AS low FROM n GROUP BY 1)
SELECT page, coalesce(max(y) FILTER (w >= 20 AND y < 80), 0.065 * 842) AS header_cut, coalesce(max(CASE WHEN n = 1 THEN low END), 0.955 * 842) AS footnote_cut FROM r LEFT JOIN c USING (page) GROUP BY 1""")
def page_clip(spark, d):
    """Events as rules of pages, twelve to a page."""
    from .operators.structure import page_bodies

    e = F.col("event_id")
    rules = table(spark, d, "events").select(F.floor(e / 12).alias("page"), F.lit(842.0).alias("height"), (e * 37 % 842).cast("double").alias("y"), (40 + e % 50).alias("x0"), (15 + e % 50).alias("w"))
    return page_bodies(rules)


_PROVISIONS = """WITH p AS (SELECT doc_id // 40 AS act, doc_id AS ord, CAST(doc_id % 40 AS INTEGER) AS n, ['Article', 'Recital', 'Annex'][doc_id % 3 + 1] AS type, source AS title, CAST(doc_id % 40 // 9 + 1 AS INTEGER) AS c, doc_id % 40 // 4 % 3 AS s FROM documents)
"""


def _act_provisions(spark, d) -> DataFrame:
    """Documents as provisions of acts, forty to an act."""
    i = F.col("doc_id") % 40
    n, kind = i.cast("int"), F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Annex")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.when(kind == "Annex", F.coalesce(R.int_to_roman(n), F.lit(""))).when(kind == "Recital", F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"))).otherwise(n.cast("string"))
    section = F.when(F.floor(i / 4) % 3 > 0, F.concat((F.floor(i / 4) % 3).cast("string"), F.lit(" - Part"))).otherwise("")
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("doc_id"), F.col("doc_id").alias("ord"), kind.alias("type"), number.alias("number"), F.concat("source", F.lit("\nlead-in")).alias("title"), F.concat(R.int_to_roman((F.floor(i / 9) + 1).cast("int")), F.lit(" - Title")).alias("chapter"), section.alias("section"), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 7).cast("string")).alias("paragraph"))


@query(_PROVISIONS + """, a AS (SELECT *, lag(c) OVER w IS DISTINCT FROM c AS new_c, last_value(CASE WHEN s > 0 THEN s END IGNORE NULLS) OVER (PARTITION BY act, c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p WHERE type = 'Article' WINDOW w AS (PARTITION BY act ORDER BY n)),
al AS (SELECT act, count(*) AS n_a, string_agg(CASE WHEN new_c THEN 'Chapter ' || """ + _roman_sql("c") + """ || ' - Title' || chr(10) ELSE '' END || CASE WHEN s > 0 AND s IS DISTINCT FROM seen THEN '  Section ' || s || ' - Part' || chr(10) ELSE '' END || '    Article ' || n || ': ' || title, chr(10) ORDER BY n) AS l FROM a GROUP BY 1),
xl AS (SELECT act, count(*) AS n_x, string_agg('Annex ' || CASE WHEN n = 0 THEN '' ELSE """ + _roman_sql("n") + """ END || ': ' || title, chr(10) ORDER BY n) AS l FROM p WHERE type = 'Annex' GROUP BY 1),
rl AS (SELECT act, max(CASE WHEN type = 'Recital' THEN n + 2 END) AS r FROM p GROUP BY 1)
SELECT act AS doc_id, 'The Act has a preamble, ' || coalesce(r, 0) || ' recitals, ' || coalesce(n_a, 0) || ' articles and ' || coalesce(n_x, 0) || ' annexes.' || chr(10) || chr(10) || coalesce(al.l, '') || chr(10) || chr(10) || coalesce(xl.l, '') AS text FROM rl LEFT JOIN al USING (act) LEFT JOIN xl USING (act)""")
def table_of_contents(spark, d):
    from .operators import structure as X

    return X.table_of_contents(_act_provisions(spark, d))


@query(_PROVISIONS + """SELECT ord AS doc_id, row_number() OVER (ORDER BY act, CASE type WHEN 'Recital' THEN 0 WHEN 'Article' THEN 1 ELSE 2 END, n, CASE WHEN ord % 2 = 0 THEN n_chars % 7 ELSE 0 END, ord) AS place FROM p JOIN documents ON doc_id = ord""")
def chunk_export(spark, d):
    """The place of every provision in the order of an export, act by act."""
    from .operators import structure as X

    rows = _act_provisions(spark, d)
    keys = X.export_key(F.col("type"), F.col("number"), F.col("paragraph"))
    rows = rows.select(F.col("doc_id").alias("act"), F.col("ord").alias("doc_id"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return S.places(rows, ["act", "k0", "k1", "k2"], "doc_id").select("doc_id", "place")


@query(_S + "SELECT query_id, rank, id, sim AS similarity, 'Document' AS type, 'label ' || label AS page_content FROM knn")
def trace_documents(spark, d):
    from .operators import structure as X

    rows = _knn(spark, d).select("query_id", "rank", "id", F.col("sim").alias("similarity"), F.lit("similarity").alias("retrieved_by"), F.concat(F.lit("label "), F.col("label")).alias("text"))
    doc = F.col("document")
    return X.trace_documents(rows).select("query_id", "rank", doc["metadata"]["id"].alias("id"), doc["metadata"]["similarity"].alias("similarity"), doc["type"].alias("type"), doc["page_content"].alias("page_content"))


# --- experiments -------------------------------------------------------------------------------------------

_EXPERIMENT = """WITH r AS (SELECT event_id AS run_id, event_type AS experiment, CASE WHEN event_id % 5 > 0 THEN user_id END AS example_id, event_id % 4 > 0 AS is_root, event_id AS start_time, value FROM events)
"""


def _experiment_runs(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("run_id"), F.col("event_type").alias("experiment"), F.when(e % 5 > 0, F.col("user_id")).alias("example_id"), (e % 4 > 0).alias("is_root"), e.alias("start_time"), "value")


def _examples(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("example_id"), "quality", "toxic")


@query(_EXPERIMENT + "SELECT run_id, example_id, quality, toxic FROM r LEFT JOIN labels ON doc_id = example_id WHERE experiment = (SELECT arg_max(experiment, start_time) FROM r) AND is_root AND example_id IS NOT NULL")
def experiment_scan(spark, d):
    """The experiment that started last, with its examples."""
    return L.fetch_experiment(_experiment_runs(spark, d), _examples(spark, d)).select("run_id", "example_id", "quality", "toxic")


@query(_EXPERIMENT + ", f AS (SELECT user_id AS run_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1) SELECT r.run_id, click, \"view\" FROM r LEFT JOIN f USING (run_id)")
def run_feedback(spark, d):
    feedback = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return L.with_feedback(_experiment_runs(spark, d).select("run_id"), feedback, ["click", "view"])


@query("SELECT count(*) FILTER (o_orderkey IS NULL) AS n_missing FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 > 0) ON o_orderkey = l_orderkey")
def missing_costs(spark, d):
    costs = table(spark, d, "orders").filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("cost"))
    return L.with_costs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")), costs)[1]


@query(_RUNS + "SELECT run_id FROM sc WHERE should_answer = 'yes' AND len(expected) > 0 ORDER BY run_id LIMIT 50")
def answerable(spark, d):
    """The first fifty runs that should be answered, which is the limit asked for."""
    return L.first_rows(L.answerable(_runs(spark, d), F.col("expected")).select("run_id"), ["run_id"], 50)


@query("""WITH r AS (SELECT doc_id, doc_id % 3 + 1 AS k, n_chars % 4 + 1 AS m, doc_id % 2 = 0 AS asked, doc_id % 5 = 0 AS part, doc_id % 11 = 0 AS off, doc_id % 13 = 0 AS lost FROM documents)
SELECT doc_id, CASE WHEN off THEN 0 WHEN lost THEN 0 WHEN asked AND NOT part AND m > 1 AND m > k THEN 0 ELSE 1 END AS score,
CASE WHEN off THEN 'out of scope: scored on refusal' WHEN lost THEN 'missing: article ' || doc_id WHEN asked AND NOT part AND m > 1 AND m > k THEN 'missing paragraphs of article ' || doc_id || ': ' || array_to_string(range(k + 1, m + 1), ', ') || ' (' || k || '/' || m || ')' ELSE '' END AS note FROM r""")
def completeness(spark, d):
    """A question about each document as an article, with the paragraphs that the corpus has of it."""
    n, docs = F.col("doc_id").cast("string"), table(spark, d, "documents")
    cited = F.concat(F.when(F.col("doc_id") % 13 == 0, "Recital ").otherwise("Article "), n, F.lit("(1-"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(")"))
    rows = docs.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("summarize article "), n)).otherwise("what is it").alias("question"), F.when(F.col("doc_id") % 11 == 0, "no").otherwise("yes").alias("should_answer"), F.lit(False).alias("refused"),
        F.concat(F.lit("article "), n, F.when(F.col("doc_id") % 5 == 0, "(1)").otherwise("")).alias("expected_source"), F.array(cited, F.lit("Article 999999a")).alias("citations"),
    )
    corpus = docs.select(F.lit("Article").alias("type"), n.alias("number"), F.concat(F.lit("1-"), (F.col("n_chars") % 4 + 1).cast("string")).alias("paragraph"))
    return S.score_rows(rows, S.paragraph_index(corpus)).select("doc_id", "score", "note")


@query(_RUNS + """SELECT source AS arm, metric, count(*) FILTER (s = 1) AS passed, count(s) AS graded, count(*) FILTER (s IS NULL) AS ungraded FROM (SELECT source, 'score' AS metric, score AS s FROM sc UNION ALL SELECT source, 'refused', CAST(refused AS INTEGER) FROM sc) GROUP BY ALL""")
def arm_tally(spark, d):
    return S.tally(_runs(spark, d).withColumn("refused", F.col("refused").cast("int")), "source", ["score", "refused"])


@query("WITH t AS (SELECT event_type AS arm, avg(value) AS m FROM events GROUP BY 1) SELECT arm, round(m / (SELECT m FROM t WHERE arm = 'view'), 6) AS ratio FROM t")
def cost_ratio(spark, d):
    totals = S.arm_totals(table(spark, d, "events"), "event_type", "value", "value")
    return S.cost_ratio(totals, "view").select("arm", F.round("ratio", 6).alias("ratio"))


_SUMMARY = """, v AS (SELECT run_id, score, latency, run_id % 5 = 0 AS seen, CAST(refused AS INTEGER) AS raw, CASE WHEN run_id % 5 = 0 THEN CAST(run_id % 2 AS INTEGER) ELSE CAST(refused AS INTEGER) END AS judged FROM sc),
w AS (SELECT *, CASE WHEN run_id % 3 > 0 THEN run_id % 10 / 10.0 END AS p1 FROM v)
SELECT metric, round(s, 6) AS score, n FROM (SELECT 'judged' AS metric, avg(judged) AS s, count(judged) AS n FROM w UNION ALL SELECT 'score', avg(score), count(score) FROM w UNION ALL SELECT 'latency', avg(latency), count(latency) FROM w
UNION ALL SELECT 'r1', avg(p1 / 2), count(p1) FROM w UNION ALL SELECT 'p1', avg(p1), count(p1) FROM w UNION ALL SELECT 'raw_judged', avg(raw), count(raw) FROM w
UNION ALL SELECT 'agreement_judged', (count(*) FILTER (seen) - count(*) FILTER (seen AND raw <> judged)) / count(*) FILTER (seen), count(*) FILTER (seen) FROM w)"""


@query(_RUNS + _SUMMARY)
def run_summary(spark, d):
    rows = _runs(spark, d).withColumn("raw_judged", F.col("refused").cast("int")).withColumn("judged_reviewed", F.col("run_id") % 5 == 0)
    rows = rows.withColumn("judged", F.when(F.col("judged_reviewed"), (F.col("run_id") % 2).cast("int")).otherwise(F.col("raw_judged"))).withColumn("judged_overruled", F.col("judged") != F.col("raw_judged"))
    rows = rows.withColumn("p1", F.when(F.col("run_id") % 3 > 0, F.col("run_id") % 10 / 10.0)).withColumn("r1", F.col("p1") / 2)
    return S.run_summary(rows, ["judged"], ["score", "latency"], (1,)).withColumn("score", F.round("score", 6))


@query("SELECT source AS variant, count(*) AS n_chunks, median(n_chars) AS median_tokens, max(n_chars) AS max_tokens FROM documents GROUP BY 1")
def chunk_sizes(spark, d):
    return S.chunk_sizes(table(spark, d, "documents"), "source", "n_chars")


@query("""WITH v AS (SELECT event_type AS label, count(*) AS hits, count(DISTINCT user_id) AS chunks FROM events GROUP BY 1), b AS (SELECT * FROM v ORDER BY hits DESC, chunks, label DESC LIMIT 1), a AS (SELECT * FROM v WHERE label = 'view'), s AS (SELECT * FROM v WHERE label = 'click')
SELECT CASE WHEN b.hits >= a.hits + 3 THEN b.label WHEN s.hits >= a.hits THEN s.label ELSE a.label END AS label, CASE WHEN b.hits >= a.hits + 3 THEN b.hits WHEN s.hits >= a.hits THEN s.hits ELSE a.hits END AS hits, CASE WHEN b.hits >= a.hits + 3 THEN b.chunks WHEN s.hits >= a.hits THEN s.chunks ELSE a.chunks END AS chunks FROM a, b, s""")
def choose_variant(spark, d):
    variants = table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("hits"), F.count_distinct("user_id").alias("chunks"))
    return S.choose_variant(variants, "view", "click")


@query("SELECT conv_id AS question, count(*) AS llm_calls, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS tokens_in, CAST(sum(turn) AS BIGINT) AS tokens_out, round((sum(coalesce(length(text), 0)) * 3.0 + sum(turn) * 15.0) / 1e6, 9) AS cost FROM conversations GROUP BY 1")
def usage(spark, d):
    calls = table(spark, d, "conversations").select(F.col("conv_id").alias("question"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return S.usage(calls, 3.0, 15.0).withColumn("cost", F.round("cost", 9))


@query(_S + """, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 60)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 50, CASE WHEN rank <= 50 THEN -(id % 97) ELSE 0 END DESC, rank) AS rank, CASE WHEN rank <= 50 THEN CAST(-(id % 97) AS DOUBLE) END AS score FROM r""")
def rerank(spark, d):
    """The first 50 of 60 rescored by a table in place of a cross-encoder."""
    ranked = _knn(spark, d, 60).select("query_id", "id", "rank")
    scores = ranked.select("query_id", "id", (-(F.col("id") % 97)).cast("double").alias("score"))
    return V.rerank(ranked, scores)


@query(_S + f""", g AS (SELECT q.query_id, coalesce(max(sim) < 0.45, true) AS refuse, coalesce(list('v' || id ORDER BY rank) FILTER (id IS NOT NULL), []) AS c FROM q LEFT JOIN knn USING (query_id) GROUP BY 1),
m AS (SELECT *, query_id // 100 % 4 AS i FROM g)
SELECT query_id, CASE WHEN NOT refuse THEN CASE i WHEN 0 THEN 'yes' WHEN 1 THEN '{REFUSED}.' END END AS answer, refuse OR i = 1 AS refused, CASE WHEN NOT refuse THEN CASE i WHEN 2 THEN 'timeout' WHEN 3 THEN 'no answer' END END AS error, array_to_string(c, ',') AS citations, CAST(len(c) AS INTEGER) AS n_excerpts FROM m""")
def answer(spark, d):
    """The gate, what a model said, refusals, errors and citations of every query vector."""
    from .plans.answer import answer as answered

    i = F.floor(F.col("query_id") / 100) % 4
    questions = _vector_queries(spark, d).select("query_id")
    said = questions.select("query_id", F.when(i == 0, "yes").when(i == 1, REFUSED + ".").alias("answer"), F.when(i == 2, "timeout").alias("error"))
    rows = _knn(spark, d).withColumn("retrieved_by", F.lit("similarity")).withColumn("citation", F.concat(F.lit("v"), F.col("id")))
    return answered(questions, rows, said).withColumn("citations", F.array_join("citations", ","))
