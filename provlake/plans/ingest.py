"""From documents to an index of chunks: clean, structure, packing, windows, overlap, ids, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.plugins import hashed_embedding
from ..functions.text import budget_tokens, clean_text
from ..operators import chunking as C
from ..operators.structure import parse_units

ChunkConfig = Config


def _chunks(units: DataFrame, config: Config) -> DataFrame:
    """Units (parse_units' columns) to chunks: packed, cut to windows, with overlap and ids."""
    sized = units.withColumn("n_tokens", F.size(budget_tokens(F.col("text")))).withColumn("_crumb", F.size(budget_tokens(F.col("breadcrumb"))))
    sized = sized.withColumn("root", C.citation_root(F.col("type"), F.col("number"), F.col("chapter"), F.col("section")))
    order = Window.partitionBy("doc_id").orderBy("unit_ord")
    joins = F.col("root") == F.lag("root").over(order)
    if config.packing == "none":
        packed = sized.withColumn("grp", F.col("unit_ord") + 1)
    else:
        if config.packing == "semantic":
            sized = C.neighbour_similarity(sized.withColumn("_v", hashed_embedding(F.col("text"))), "_v").drop("_v")
            # a property of the corpus; without neighbours nothing may join
            least, _ = C.share_threshold(sized, "sim", config.percentile)
            joins = F.col("sim") >= F.lit(least).cast("double")
        packed = C.pack(sized.withColumn("_join", joins), F.lit(config.budget) - F.col("_crumb"), F.col("_join")).drop("_join", "sim")
    merged = C.merge_units(packed).drop("n_tokens", "root")
    parts = C.windows(merged, F.greatest(F.lit(config.budget) - F.col("_crumb"), F.lit(max(1, config.overlap)))).drop("_crumb")
    in_order = Window.partitionBy("doc_id").orderBy("unit_ord", F.coalesce("part", F.lit(0)))
    rows = parts.withColumn("chunk_ord", F.row_number().over(in_order)).withColumn("source", F.lit(config.source))
    return C.chunk_ids(C.overlap_tail(rows, config.overlap, config.scope)).drop("unit_ord", "breadcrumb")


def chunk_documents(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, chunk_ord, chunk_id, type, number, paragraph, title, chapter, section, citation, source, part, n_tokens, body, text
    from documents (doc_id, text): every part of a regulation's structure, packed and cut to the budget.

    A null text, or one without any structure, has no chunk; see chunk_lines for plain texts.
    """
    return _chunks(parse_units(documents.select("doc_id", clean_text(F.col("text")).alias("text"))), config)


def chunk_lines(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """chunk_documents for texts without structure: lines as paragraphs of one article, numbered by doc_id."""
    lines = C.split_units(documents.select("doc_id", clean_text(F.col("text")).alias("text")))
    number, para = F.col("doc_id").cast("string"), (F.col("unit_ord") + 1).cast("string")
    citation = F.concat(F.lit("Article "), number, F.lit("("), para, F.lit(")"))
    units = lines.select("doc_id", "unit_ord", F.lit("Article").alias("type"), number.alias("number"), para.alias("paragraph"), F.lit("").alias("title"), F.lit("").alias("chapter"), F.lit("").alias("section"), citation.alias("citation"), F.lit("").alias("breadcrumb"), "text")
    return _chunks(units, config)


def index_documents(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """Chunks with embeddings: by structure where a document has any, else by lines."""
    found = chunk_documents(documents, config)
    plain = documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(chunk_lines(plain, config)).withColumn("embedding", hashed_embedding(F.col("text")))
