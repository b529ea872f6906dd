"""Retrieval: exact cosine top-k, BM25, rank fusion, metadata-first lists, gates and pools.

Rankings are ordered by score, rounded so that the order of summation can't matter, then by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens

#: Query vectors that one scan of the corpus scores, in MB; more queries are taken in blocks.
BLOCK_MB = 64


#: Cells of a similarity matrix that a task holds at once.
CELLS = 4_000_000


def _merge_best(best_sim: np.ndarray, best_id: np.ndarray, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
    """Put candidates (row, id, sim) into the k best of each row, in place; ties to the smaller id."""
    k = best_sim.shape[1]
    held = np.flatnonzero(np.isfinite(best_sim.ravel()))
    rows = np.concatenate((held // k, rows))
    ids = np.concatenate((best_id.ravel()[held], ids))
    sim = np.concatenate((best_sim.ravel()[held], sim))
    order = np.lexsort((ids, -sim, rows))
    rows, ids, sim = rows[order], ids[order], sim[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = place < k
    best_sim[rows[top], place[top]] = sim[top]
    best_id[rows[top], place[top]] = ids[top]


def _unit_scorer(ids: np.ndarray, vectors: np.ndarray, tags: np.ndarray | None, k: int, itself: bool = False):
    """A task's k best of its whole partition for each query, in one output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_sim, best_id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            ok = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if not len(ok):
                continue
            batch = batch.take(pa.array(ok))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            e = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ok), -1)
            n = len(ok)
            step = max(1, CELLS // n)
            for lo in range(0, len(ids), step):
                q = slice(lo, lo + step)
                sim = np.round(vectors[q] @ e.T, 6)
                if not itself:
                    sim[ids[q, None] == own[None, :]] = -np.inf
                if tags is not None:
                    sim[tags[q, None] != batch.column(2).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                least = best_sim[q, -1]
                if n > k:
                    least = np.maximum(least, np.partition(sim, n - k, axis=1)[:, n - k])
                rows, cols = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
                _merge_best(best_sim[q], best_id[q], rows, own[cols], sim[rows, cols])
        rows, cols = np.nonzero(np.isfinite(best_sim))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(best_id[rows, cols]), pa.array(best_sim[rows, cols])], ["query_id", "id", "sim"])

    return run


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", vector: str = "embedding", extra: tuple[str, ...] = (), same: tuple[str, str] | None = None, block_mb: int = BLOCK_MB, itself: bool = False) -> DataFrame:
    """query_id, id, sim, the extra columns of the corpus, rank <= k. Vectors are of unit length; a query is not its own hit,
    unless itself is set, for ids that name other things in the queries than in the corpus.

    The query set goes to the tasks in blocks of a stated size; each task keeps its k best by query, and the
    final ranking sees no more than that. With same (a column of the queries, one of the corpus), only rows
    whose values are equal count.
    """
    spark = corpus.sparkSession
    n, dim = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    rows_a_block = max(1, block_mb * (1 << 20) // (8 * max(1, dim or 1)))
    blocks = max(1, -(-n // rows_a_block))
    tagged = [] if same is None else [F.col(same[1]).alias("tag")]
    source = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), *tagged)
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v"), F.lit(0).alias("tag") if same is None else F.col(same[0]).alias("tag")).filter("v is not null")
    out = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).collect()
        if not part:
            continue
        tags = None if same is None else np.array([r.tag for r in part])
        shared = spark.sparkContext.broadcast((np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.float64), tags))
        scored = source.mapInArrow(lambda it, s=shared: _unit_scorer(*s.value, k, itself)(it), "query_id long, id long, sim double")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("id", "long"), ("sim", "double"))])
    top = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)
    if not extra:
        return top
    return top.join(corpus.select(F.col(id_col).cast("long").alias("id"), *extra).dropDuplicates(["id"]), "id").select("query_id", "id", "sim", *extra, "rank")


class Places:
    """Targets (query_id, id, value) of some queries, and a count of rows that come between them.

    Rows go before others by higher value, then by smaller id. Row counts by place are added up; as ids only
    matter against those of the targets, a row's key is its value and its id's place among theirs.
    """

    def __init__(self, targets: list[tuple[int, int, float]]):
        self.ids = np.unique(np.array([i for _, i, _ in targets], np.int64))
        by: dict[int, list[complex]] = {}
        for (q, _, value), place in zip(targets, self._place(np.array([i for _, i, _ in targets], np.int64)), strict=True):
            by.setdefault(q, []).append(complex(-value, place))
        self.keys = {q: np.sort(np.array(x)) for q, x in by.items()}
        self.counts: dict[int, np.ndarray] = {}

    def _place(self, own: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(own), np.int64)
        at = np.searchsorted(self.ids, own)
        return 2 * at + (self.ids[np.minimum(at, len(self.ids) - 1)] == own)

    def add(self, q: int, value: np.ndarray, own: np.ndarray) -> None:
        key = np.empty(len(own), complex)
        key.real, key.imag = -value, self._place(own)
        n = np.bincount(np.searchsorted(self.keys[q], key, side="right"), minlength=len(self.keys[q]) + 1)
        self.counts[q] = self.counts[q] + n if q in self.counts else n

    def rows(self) -> pa.RecordBatch:
        found = [(q, place, n) for q, c in self.counts.items() for place, n in enumerate(c.tolist()) if n]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "place", "n"])


_COUNTS = "query_id long, place long, n long"


def _cosine_counter(ids: np.ndarray, vectors: np.ndarray, targets: list[tuple[int, int, float]], itself: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(targets)
        for batch in batches:
            ok = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if not len(ok):
                continue
            batch = batch.take(pa.array(ok))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            e = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ok), -1)
            step = max(1, CELLS // len(ok))
            for lo in range(0, len(ids), step):
                sim = np.round(vectors[lo : lo + step] @ e.T, 6)
                for q, s in zip(ids[lo : lo + step].tolist(), sim, strict=True):
                    other = slice(None) if itself else own != q
                    places.add(q, s[other], own[other])
        yield places.rows()

    return run


def _placed(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """targets (query_id, id, value) and before: how many counted rows go before each."""
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "id")
    at = targets.withColumn("_at", F.row_number().over(w) - 1)
    total = counts.groupBy(F.col("query_id").alias("_q"), "place").agg(F.sum("n").alias("n"))
    joined = at.join(total, (at["query_id"] == total["_q"]) & (total["place"] <= at["_at"]), "left")
    return joined.groupBy("query_id", "id", "value").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))


def cosine_places(queries: DataFrame, corpus: DataFrame, targets: DataFrame, query_id: str = "query_id", id_col: str = "vec_id", vector: str = "embedding", itself: bool = False, block_mb: int = BLOCK_MB) -> DataFrame:
    """targets (query_id, id, sim; rows of the corpus) and rank, their place in the ranking of the whole corpus.

    The rows that go before a target are counted, in one scan for each block of queries; no ranking is built.
    """
    spark = corpus.sparkSession
    n, dim = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = max(1, -(-n * 8 * max(1, dim or 1) // (block_mb * (1 << 20))))
    source = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).filter("v is not null").dropDuplicates(["q"])
    wanted = targets.select(F.col("query_id").cast("long").alias("query_id"), "id", F.col("sim").alias("value"))
    counts = spark.createDataFrame([], _COUNTS)
    for b in range(blocks):
        of_block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)) == b
        rows = [tuple(r) for r in wanted.filter(of_block("query_id")).collect()]
        having = {q for q, _, _ in rows}
        part = [r for r in asked.filter(of_block("q")).collect() if r.q in having]
        if part:
            shared = spark.sparkContext.broadcast((np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.float64), rows, itself))
            counts = counts.unionByName(source.mapInArrow(lambda it, s=shared: _cosine_counter(*s.value)(it), _COUNTS))
    return _placed(wanted, counts).select("query_id", "id", F.col("value").alias("sim"), (F.col("before") + 1).alias("rank"))


def first_rank(queries: DataFrame, corpus: DataFrame, same: tuple[str, str]) -> DataFrame:
    """query_id, first_rank: place of the first relevant row (equal values of same) among the whole corpus, null if none is."""
    best = cosine_topk(queries, corpus, 1, same=same)
    found = cosine_places(queries, corpus, best).select("query_id", F.col("rank").alias("first_rank"))
    return queries.filter("embedding is not null").select("query_id").distinct().join(found, "query_id", "left")


def corpus_stats(documents: DataFrame) -> DataFrame:
    """term, df, tf over all documents."""
    words = documents.select("doc_id", F.explode(search_tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def bm25_scores(queries: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, matched (distinct query terms) for each pair that shares a term. queries: query_id, text.

    Words of a query that repeat count as often. Only terms of the queries leave the scan of the documents.
    """
    terms = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    lengths = documents.select("doc_id", F.coalesce(search_tokens(F.col("text")), F.expr("cast(array() as array<string>)")).alias("words")).withColumn("dl", F.size("words"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = terms.select("term").distinct()
    postings = lengths.select("doc_id", "dl", F.explode("words").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = stats.first()
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = postings.join(df, "term").join(terms, "term").withColumn("w", weight)
    return scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"), F.count("*").alias("matched"))


def top_ranked(scores: DataFrame, k: int, score: str = "score", id_col: str = "doc_id", digits: int = 9) -> DataFrame:
    """The k best of each query, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, digits)), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rrf(lists: DataFrame, k: int | None = None, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, list_idx, rank, id): query_id, id, score, rank; ties by first seen."""
    # the sum is over parts of one billionth, so that its order can't matter
    part = F.round(F.lit(1e12) / (c + F.col("rank"))).cast("long")
    fused = lists.groupBy("query_id", "id").agg((F.sum(part) / 1e12).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen"))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "id"))).drop("seen")
    return out if k is None else out.filter(F.col("rank") <= k)


class Bm25:
    """BM25 of a bounded set of queries, scored document by document: no pair of query and document is shuffled."""

    def __init__(self, queries: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75):
        asked = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).collect()
        self.k1, self.b = k1, b
        self.terms = pa.array(sorted({r.term for r in asked}), pa.string())
        self.queries = np.array(sorted({r.query_id for r in asked}), np.int64)
        self.words = documents.select(F.col("doc_id").alias("id"), F.coalesce(search_tokens(F.col("text")), F.expr("cast(array() as array<string>)")).alias("words"))
        place = {t: i for i, t in enumerate(self.terms.to_pylist())}
        stats = dict(tuple(r) for r in self.words.mapInArrow(_term_stats(self.terms), "place long, n long").groupBy("place").agg(F.sum("n")).collect())
        n = stats.get(-1, 0)
        self.avgdl = stats.get(-2, 0) / n if n and stats.get(-2, 0) else 1.0
        df = np.array([stats.get(t, 0) for t in range(len(place))], np.float64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.weights = np.zeros((len(place), len(self.queries)))
        for r in asked:
            self.weights[place[r.term], np.searchsorted(self.queries, r.query_id)] = r.qtf * idf[place[r.term]]
        self.shared = documents.sparkSession.sparkContext.broadcast((self.terms, self.weights, self.avgdl, k1, b, self.queries))

    def run(self, words: DataFrame, task, schema: str) -> DataFrame:
        """task(queries, iterator of (ids, scores by document and query)) over the documents of words."""
        shared = self.shared
        return words.mapInArrow(lambda it: task(shared.value[-1], _bm25_matrices(it, *shared.value[:-1])), schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _term_places(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the terms in a batch's word lists, and the lengths of the lists."""
    words = batch.column(1)
    lengths = np.diff(words.offsets.to_numpy())
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)[at >= 0]
    key, tf = np.unique(owner * max(1, len(terms)) + at[at >= 0], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf, lengths


def _term_stats(terms: pa.Array):
    """Documents of each term by its place; -1: documents, -2: words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in _slices(batches):
            _, term, _, lengths = _term_places(batch, terms)
            df += np.bincount(term, minlength=len(terms))
            n, total = n + len(lengths), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *range(len(terms))], pa.int64()), pa.array([n, total, *df.tolist()], pa.int64())], ["place", "n"])

    return run


def _bm25_matrices(batches: Iterator[pa.RecordBatch], terms: pa.Array, weights: np.ndarray, avgdl: float, k1: float, b: float):
    for batch in _slices(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        doc, term, tf, lengths = _term_places(batch, terms)
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / avgdl))
        step = max(1, CELLS // max(1, len(terms), weights.shape[1]))
        for lo in range(0, len(ids), step):
            hi = min(len(ids), lo + step)
            p, e = np.searchsorted(doc, (lo, hi))
            part = np.zeros((hi - lo, len(terms)))
            part[doc[p:e] - lo, term[p:e]] = x[p:e]
            yield ids[lo:hi], np.round(part @ weights, 9)


def _best_scores(k: int):
    def task(queries: np.ndarray, matrices) -> Iterator[pa.RecordBatch]:
        best, best_id = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        for own, s in matrices:
            s = np.where(s > 0, s, -np.inf).T
            least = best[:, -1]
            if len(own) > k:
                least = np.maximum(least, np.partition(s, len(own) - k, axis=1)[:, len(own) - k])
            rows, cols = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            _merge_best(best, best_id, rows, own[cols], s[rows, cols])
        rows, cols = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(queries[rows]), pa.array(best_id[rows, cols]), pa.array(best[rows, cols])], ["query_id", "id", "value"])

    return task


def _all_scores(queries: np.ndarray, matrices) -> Iterator[pa.RecordBatch]:
    for own, s in matrices:
        rows, cols = np.nonzero(s > 0)
        yield pa.RecordBatch.from_arrays([pa.array(queries[cols]), pa.array(own[rows]), pa.array(s[rows, cols])], ["query_id", "id", "value"])


def _score_counter(shared):
    """Scored documents before each target: kind 0 by score and id, kind 1 by id alone; kind 2, query 0: documents by id."""

    def task(queries: np.ndarray, matrices) -> Iterator[pa.RecordBatch]:
        scored, by_id, every = (Places(t) for t in shared.value)
        for own, s in matrices:
            for q, col in zip(queries.tolist(), s.T, strict=True):
                hit = col > 0
                if q in scored.keys:
                    scored.add(q, col[hit], own[hit])
                if q in by_id.keys:
                    by_id.add(q, np.zeros(hit.sum()), own[hit])
            if 0 in every.keys:
                every.add(0, np.zeros(len(own)), own)
        for kind, places in enumerate((scored, by_id, every)):
            out = places.rows()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * out.num_rows, pa.int64()), *out.columns], ["kind", *out.schema.names])

    return task


def bm25_topk(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank <= k of the documents (doc_id, text) that share a term with the query.

    Documents are scored in the task that reads them, for a bounded set of queries; each task keeps its k best by query.
    """
    bm25 = Bm25(queries, documents)
    best = bm25.run(bm25.words, _best_scores(k), "query_id long, id long, value double")
    return top_ranked(best, k, score="value", id_col="id").withColumnRenamed("value", "score")


def hybrid(queries: DataFrame, documents: DataFrame, embed: Callable[[Column], Column], k: int = 8, c: int = 60) -> DataFrame:
    """query_id, id, score, rank <= k: fusion of the BM25 and the cosine ranking of all documents. queries: query_id, text.

    In each ranking every document has a place; those without a term of the query come last in BM25, by id, and those
    without tokens are in no cosine ranking. Nothing is lost by fusing few: the first k of a list score 1 / (c + k) or
    more, and a document behind place m = c + 2k of both lists at most 2 / (c + m + 1), which is less. So the first m
    of either list are taken, and their places in the other list counted over the whole corpus. doc_id is unique; the
    queries are a bounded set, whose candidates (about 2m each) go to the tasks.
    """
    spark = documents.sparkSession
    m = c + 2 * k
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bm25, pair = Bm25(queries, documents), "query_id long, id long, value double"
    asked = queries.select("query_id", embed(F.col("text")).alias("embedding"))
    corpus = documents.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"))
    dense = cosine_topk(asked, corpus, m, itself=True).select("query_id", "id", "sim").collect()
    lexical = top_ranked(bm25.run(bm25.words, _best_scores(m), pair), m, score="value", id_col="id").collect()
    least = [r[0] for r in documents.select("doc_id").orderBy("doc_id").limit(2 * m).collect()]
    every = {r[0] for r in queries.select("query_id").distinct().collect()}
    found: dict[int, set[int]] = {q: set() for q in every}
    for r in lexical:
        found[r.query_id].add(r.id)
    pairs = {(r.query_id, r.id) for r in dense} | {(r.query_id, r.id) for r in lexical}
    for q, ids in found.items():  # lists of fewer scored documents than m go on with the others, by id
        pairs |= {(q, i) for i in [i for i in least if i not in ids][: max(0, m - len(ids))]}
    if not pairs:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    candidates = spark.createDataFrame(sorted(pairs), "query_id long, id long")
    # both values of every candidate, by the same code that ranks the others
    few = candidates.select("id").distinct()
    score = {(r.query_id, r.id): r.value for r in bm25.run(bm25.words.join(F.broadcast(few), "id", "left_semi"), _all_scores, pair).join(candidates, ["query_id", "id"], "left_semi").collect()}
    with_term = [(*p, score[p]) for p in sorted(pairs) if p in score]
    without = [(*p, 0.0) for p in sorted(pairs) if p not in score]
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in documents.join(F.broadcast(few), documents["doc_id"] == few["id"], "left_semi").select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding")).collect() if r.embedding is not None}
    of_query = {r.query_id: np.array(r.embedding, np.float64) for r in asked.collect() if r.embedding is not None}
    near = [(q, i, float(np.round(of_query[q] @ vectors[i], 6))) for q, i in sorted(pairs) if q in of_query and i in vectors]
    place = cosine_places(asked, corpus, spark.createDataFrame(near, "query_id long, id long, sim double"), itself=True).select("query_id", "id", "rank", F.lit(1).alias("list_idx"))
    # the first counts give the places of scored candidates; the others come after all scored documents, by id
    every_id = [(0, i, 0.0) for i in {i for _, i, _ in without}]
    targets = spark.sparkContext.broadcast((with_term, without, every_id))
    counts: list[dict[int, dict[int, int]]] = [{}, {}, {}]
    for r in bm25.run(bm25.words, _score_counter(targets), f"kind long, {_COUNTS}").groupBy("kind", "query_id", "place").agg(F.sum("n").alias("n")).collect():
        counts[r.kind].setdefault(r.query_id, {})[r.place] = r.n
    all_before = _before(every_id, counts[2])
    ranks = [(q, i, 1 + n) for (q, i), n in _before(with_term, counts[0]).items()]
    for (q, i), n in _before(without, counts[1]).items():
        ranks.append((q, i, 1 + sum(counts[1].get(q, {}).values()) + all_before[0, i] - n))
    lists = place.unionByName(spark.createDataFrame(ranks, "query_id long, id long, rank long").withColumn("list_idx", F.lit(0)))
    return rrf(lists, k, c)


def _before(targets: list[tuple[int, int, float]], counts: dict[int, dict[int, int]]) -> dict[tuple[int, int], int]:
    """(query_id, id) of targets -> how many counted rows go before it."""
    by: dict[int, list[tuple[float, int]]] = {}
    for q, i, value in targets:
        by.setdefault(q, []).append((-value, i))
    out = {}
    for q, rows in by.items():
        total = 0
        for at, (_, i) in enumerate(sorted(rows)):
            total += counts.get(q, {}).get(at, 0)
            out[q, i] = total
    return out


def pool_best(lists: DataFrame) -> DataFrame:
    """Of each query and id the row of highest sim; ties to the first list, then rank."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("sim"), "list_idx", "rank")
    return lists.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def priority_union(first: DataFrame, second: DataFrame, k: int, first_tag: str, second_tag: str) -> DataFrame:
    """The rows of first, then those of second that are not in first, k by query (columns query_id, id, sim, rank)."""
    rest = second.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    cols = ["query_id", "id", "sim", "rank"]
    both = first.select(*cols, F.lit(0).alias("p"), F.lit(first_tag).alias("retrieved_by")).unionByName(rest.select(*cols, F.lit(1).alias("p"), F.lit(second_tag).alias("retrieved_by")))
    w = Window.partitionBy("query_id").orderBy("p", "rank")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("p")


def metadata_first(named: DataFrame, similar: DataFrame, k: int = 8, slots: int = 2) -> DataFrame:
    """At most k - slots named rows, by rank, before the similar rows that fill up to k. Both ranked by sim."""
    cap = max(k - slots, 1)
    return priority_union(named.filter(F.col("rank") <= cap), similar, k, "metadata", "similarity")


def similarity_gate(queries: DataFrame, rows: DataFrame, threshold: float = 0.45) -> DataFrame:
    """query_id, best, refuse: no rows, or none pinned by metadata and none similar enough."""
    best = rows.groupBy("query_id").agg(F.max("sim").alias("best"), F.bool_or(F.col("retrieved_by") == "metadata").alias("pinned"))
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", "best", F.coalesce(~F.col("pinned") & (F.col("best") < threshold), F.lit(True)).alias("refuse"))


def follow_refs(asked: DataFrame, allowed: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows of the references asked for and allowed, the best ``most`` by query; references that are not allowed).

    asked and allowed: query_id, ref; search(followed): query_id, ref, id, sim, the best ``most`` by query, or more,
    of all rows that the followed references name.
    """
    followed = asked.join(allowed, ["query_id", "ref"], "left_semi").distinct()
    hits = search(followed).join(followed, ["query_id", "ref"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    rows = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("retrieved_by", F.lit("reference"))
    return rows, asked.join(allowed, ["query_id", "ref"], "left_anti")


def select_picks(view: DataFrame, picks: DataFrame, cap: int = 10) -> DataFrame:
    """Rows of view (query_id, rank, id) in the order of picks (query_id, pos, pick); queries without a valid pick keep their ranking."""
    valid = picks.join(view.select("query_id", F.col("rank").alias("pick"), "id"), ["query_id", "pick"]).groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("pos")
    chosen = valid.withColumn("rank", F.row_number().over(w)).select("query_id", "id", "rank")
    rest = view.join(valid.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "id", "rank")
    return chosen.unionByName(rest).filter(F.col("rank") <= cap)


def rank_of(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, first_rank: rank of the first relevant row (query_id, id), null if none."""
    hit = ranked.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return ranked.select("query_id").distinct().join(hit, "query_id", "left")


def rerank(ranked: DataFrame, scores: DataFrame, pool: int = 50) -> DataFrame:
    """ranked (query_id, id, rank) with the first ``pool`` of each query in the order of scores (query_id, id, score), the
    others after them in their order. Rows of the pool without a score come last in it; ties by the rank before."""
    both = ranked.join(scores, ["query_id", "id"], "left").withColumn("_in", F.col("rank") <= pool)
    w = Window.partitionBy("query_id").orderBy(F.desc("_in"), F.when(F.col("_in"), F.col("score")).desc_nulls_last(), "rank", "id")
    return both.withColumn("place", F.row_number().over(w)).select("query_id", "id", F.col("place").alias("rank"), F.when(F.col("_in"), F.col("score")).alias("score"))
