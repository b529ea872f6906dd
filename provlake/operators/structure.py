"""Legal structure: zones, recitals in sequence, articles and annexes with their paragraphs, chapters and sections.

All by windows over a document's lines; a document is the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking as C

#: Fixed patterns of marker lines.
ADOPTED = r"(?i)HAVE ADOPTED THIS REGULATION"
CHAPTER, SECTION = r"^[ \t]*CHAPTER[ \t]+([IVXLCDM]+)[ \t]*$", r"^[ \t]*SECTION[ \t]+([0-9]+)[ \t]*$"
ARTICLE, ANNEX = r"^[ \t]*Article[ \t]+([0-9]+[a-z]?)[ \t]*$", r"^[ \t]*ANNEX[ \t]+([IVXLCDM]+)[ \t]*$"
RECITAL = r"^[ \t]*\(([0-9]{1,3})\)(?:[ \t]+|$)"
DOTTED, BRACKETED = r"^[ \t]*([0-9]{1,2})\.[ \t]+", r"^[ \t]*\(([0-9]{1,2})\)[ \t]+"
#: How bodies begin that show a number in brackets to be a footnote, and how clauses of a preamble begin.
FOOTNOTE = (
    r"^(?:OJ [CL]|Regulation \(|Directive |Council (?:Directive|Regulation|Decision|Framework)|Decision (?:\(|No)|"
    r"Position of the European Parliament|European Council|European Parliament resolution|Judgment of|Commission [A-Z]|Recommendation|Proposal for)"
)
CLAUSE = r"^[ \t]*(?:THE EUROPEAN PARLIAMENT|Having regard to|After |Acting in accordance|Whereas:)"
#: Title of preamble clauses, and words that a preamble has at least.
PREAMBLE_TITLE, PREAMBLE_WORDS = "Title and recitations", 20


def marked_lines(documents: DataFrame) -> DataFrame:
    """doc_id, pos, line, zone (recitals, articles, annexes), kind and number of marker lines. Of the line of adoption what precedes it is left."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("_a", F.col("line").rlike(ADOPTED)).withColumn("_seen", F.coalesce(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("_has", F.max("_a").over(Window.partitionBy("doc_id"))).withColumn("_head", F.col("_has") & ~F.col("_seen"))
    rows = rows.withColumn("line", F.when(F.col("_a") & ~F.col("_seen"), F.regexp_extract("line", ADOPTED.replace("(?i)", "(?i)^(.*?)"), 1)).otherwise(F.col("line")))
    rows = rows.withColumn("_x", F.max(~F.col("_head") & F.col("line").rlike(ANNEX)).over(w))
    rows = rows.withColumn("zone", F.when(F.col("_head"), "recitals").when(F.col("_x"), "annexes").otherwise("articles"))
    kinds = {"articles": (("chapter", CHAPTER), ("section", SECTION), ("article", ARTICLE)), "annexes": (("annex", ANNEX),), "recitals": (("recital", RECITAL),)}
    kind, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for zone, names in kinds.items():
        for name, pattern in names:
            hit = (F.col("zone") == zone) & F.col("line").rlike(pattern)
            kind, number = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(number)
    return rows.select("doc_id", "pos", "line", "zone", kind.alias("kind"), number.alias("number"))


def _joined(lines: Column) -> Column:
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def blocks(marked: DataFrame) -> DataFrame:
    """doc_id, pos, zone, kind, number, head (the marker line), lines: from each marker to the next of its zone; what precedes the first is dropped."""
    w = Window.partitionBy("doc_id", "zone").orderBy("pos")
    rows = marked.withColumn("_b", F.count("kind").over(w)).filter("_b > 0").groupBy("doc_id", "zone", "_b").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("r"), F.max("kind").alias("kind"), F.max("number").alias("number"))
    return rows.select("doc_id", F.col("r")[0]["pos"].alias("pos"), "zone", "kind", "number", F.col("r")[0]["line"].alias("head"), F.transform(F.slice("r", 2, 1 << 30), lambda x: x["line"]).alias("lines"))


def parse_preamble(marked: DataFrame) -> DataFrame:
    """doc_id, pos, text: clauses of what stands before the first recital, if that has PREAMBLE_WORDS words."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = marked.filter("zone = 'recitals'").withColumn("_k", F.count("kind").over(w)).filter("_k = 0")
    # blank lines before the first word are no text, and the first line always starts a clause
    head = head.withColumn("_t", F.max(F.col("line").rlike(r"\S")).over(w)).filter("_t").withColumn("_n", F.row_number().over(w))
    clause = F.sum(F.when((F.col("_n") > 1) & F.col("line").rlike(CLAUSE), 1).otherwise(0)).over(w)
    clauses = head.withColumn("_c", clause).groupBy("doc_id", "_c").agg(F.min("pos").alias("pos"), _joined(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("text"))
    words = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).over(Window.partitionBy("doc_id"))
    return clauses.withColumn("_w", words).filter((F.col("_w") >= PREAMBLE_WORDS) & (F.col("text") != "")).select("doc_id", "pos", "text")


def parse_recitals(marked: DataFrame) -> DataFrame:
    """doc_id, pos, number, text: blocks with a text that is no footnote and whose number is the next expected; others are lost."""
    own = blocks(marked.filter("zone = 'recitals'")).withColumn("body", _joined(F.concat(F.array(F.regexp_replace("head", RECITAL, "")), F.col("lines"))))
    own = own.filter(~F.col("body").rlike(FOOTNOTE) & (F.col("body") != "")).withColumn("n", F.col("number").cast("int"))
    kept = C.sequence_filter(own, "doc_id", "pos", "n").select("doc_id", F.col("pos").cast("int").alias("pos"))
    return own.join(kept, ["doc_id", "pos"], "left_semi").select("doc_id", "pos", "number", F.concat(F.lit("("), "number", F.lit(") "), "body").alias("text"))


def parse_provisions(marked: DataFrame) -> DataFrame:
    """doc_id, pos, unit, type, number, paragraph, title, chapter, section, text of articles and annexes.

    A provision with "n. " lines is cut at those, else at "(n) " lines; without either it is one unit of title
    and body. The title is what stands before the first paragraph, else the first line that is not blank.
    """
    rows = blocks(marked.filter("zone <> 'recitals'"))
    first = F.trim(F.element_at(F.filter("lines", lambda x: F.trim(x) != ""), 1))
    named = rows.withColumn("first", F.coalesce(F.when(F.exists("lines", lambda x: F.trim(x) != ""), first), F.lit("")))
    label = F.concat("number", F.lit(" - "), "first")
    carried = C.carry_context(named, "doc_id", "pos", F.when(F.col("kind") == "chapter", label), F.when(F.col("kind") == "section", label))
    own = carried.filter(F.col("kind").isin("article", "annex")).withColumn("style", F.when(F.exists("lines", lambda x: x.rlike(DOTTED)), DOTTED).when(F.exists("lines", lambda x: x.rlike(BRACKETED)), BRACKETED))
    annex = F.col("kind") == "annex"
    base = ["doc_id", "pos", F.initcap("kind").alias("type"), "number", F.when(annex, "").otherwise(F.coalesce("chapter", F.lit(""))).alias("chapter"), F.when(annex, "").otherwise(F.coalesce("section", F.lit(""))).alias("section")]
    whole = own.filter("style is null").select(*base, F.lit(None).cast("string").alias("paragraph"), F.col("first").alias("title"), F.lit(1).cast("long").alias("unit"), _joined(F.col("lines")).alias("text")).filter("text <> ''")
    each = own.filter("style is not null").select(*base, "style", F.posexplode("lines").alias("i", "line"))
    mark = F.when(F.col("style") == DOTTED, F.regexp_extract("line", DOTTED, 1)).otherwise(F.regexp_extract("line", BRACKETED, 1))
    each = each.withColumn("n", F.nullif(mark, F.lit(""))).withColumn("unit", F.count("n").over(Window.partitionBy("doc_id", "pos").orderBy("i")))
    cut = each.withColumn("line", F.when(F.col("n").isNull(), F.col("line")).when(F.col("style") == DOTTED, F.regexp_replace("line", DOTTED, "")).otherwise(F.regexp_replace("line", BRACKETED, "")))
    keys = ["doc_id", "pos", "type", "number", "chapter", "section"]
    units = cut.groupBy(*keys, "unit").agg(F.max("n").alias("paragraph"), _joined(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])).alias("body"))
    titles = units.filter("unit = 0").select("doc_id", "pos", F.col("body").alias("title"))
    some = units.filter("unit > 0 and body <> ''")
    # paragraphs without any text: the provision stays whole
    bare = own.filter("style is not null").join(some.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti").join(titles, ["doc_id", "pos"], "left")
    bare = bare.select(*base, F.lit(None).cast("string").alias("paragraph"), F.coalesce(F.col("title"), F.lit("")).alias("title"), F.lit(1).cast("long").alias("unit"), _joined(F.col("lines")).alias("text")).filter("text <> ''")
    parts = some.join(titles, ["doc_id", "pos"], "left").select(*keys, "paragraph", F.coalesce("title", F.lit("")).alias("title"), "unit", F.concat("paragraph", F.lit(". "), "body").alias("text"))
    return whole.select(*parts.columns).unionByName(bare.select(*parts.columns)).unionByName(parts)


def breadcrumb(chapter: Column, section: Column, kind: Column, number: Column, title: Column) -> Column:
    """Context lines of a provision; absent levels are left out."""
    part = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name} "), F.regexp_replace(x, "(?s)^(.*?) - ", "$1: ")))
    return F.concat_ws("\n", part("Chapter", chapter), part("Section", section), F.concat(kind, F.lit(" "), number, F.when(title != "", F.concat(F.lit(": "), title)).otherwise("")))


def parse_units(documents: DataFrame) -> DataFrame:
    """doc_id, unit_ord (from 0), type, number, paragraph, title, chapter, section, citation, breadcrumb, text of all parts of
    clean texts: preamble, recitals, articles, annexes. A document without any has no unit."""
    marked = marked_lines(documents)
    none, empty = F.lit(None).cast("string"), F.lit("")
    flat = lambda df, zone, kind, number, title, citation: df.select("doc_id", F.lit(zone).alias("z"), "pos", F.lit(1).cast("long").alias("unit"), F.lit(kind).alias("type"), number.alias("number"), none.alias("paragraph"), title.alias("title"), empty.alias("chapter"), empty.alias("section"), citation.alias("citation"), empty.alias("breadcrumb"), "text")
    preamble = flat(parse_preamble(marked), 0, "Preamble", F.lit("0"), F.lit(PREAMBLE_TITLE), F.lit("Preamble"))
    recitals = flat(parse_recitals(marked), 1, "Recital", F.col("number"), none, F.concat(F.lit("Recital "), F.col("number")))
    named = F.concat("type", F.lit(" "), "number", F.coalesce(F.concat(F.lit("("), F.col("paragraph"), F.lit(")")), empty))
    crumb = breadcrumb(F.col("chapter"), F.col("section"), F.col("type"), F.col("number"), F.trim("title"))
    rest = parse_provisions(marked).select("doc_id", F.when(F.col("type") == "Article", 2).otherwise(3).alias("z"), "pos", "unit", "type", "number", "paragraph", "title", "chapter", "section", named.alias("citation"), crumb.alias("breadcrumb"), "text")
    rows = preamble.unionByName(recitals).unionByName(rest)
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("z", "pos", "unit")) - 1
    return rows.withColumn("unit_ord", ord_).drop("z", "pos", "unit")


def page_bodies(rules: DataFrame, height: str = "height") -> DataFrame:
    """page, header_cut, footnote_cut from horizontal rules (page, height, y, x0, w): what lies between is a page's body.

    The header ends at the lowest rule within the first 80 points, else at 6.5 % of the height. Footnotes start at
    the separators (short rules at the left of the lower part) if they form one cluster; gaps of more than 10 points
    part clusters, and of several, or none, the cut is 95.5 %. A page without rules is not known here.
    """
    long = rules.filter(F.col("w") >= 20)
    pages = rules.groupBy("page").agg(F.max(height).alias("_h"))
    header = long.filter("y < 80").groupBy("page").agg(F.max("y").alias("_top"))
    low = long.filter((F.col("y") >= 80) & (F.col("y") > 0.55 * F.col(height)) & F.col("w").between(40, 60) & F.col("x0").between(40, 80))
    clusters = C.gap_clusters(low.select("page", F.rint("y").alias("y")), "page", "y", 10.0)
    out = pages.join(header, "page", "left").join(clusters, "page", "left")
    return out.select("page", F.coalesce("_top", 0.065 * F.col("_h")).alias("header_cut"), F.when(F.col("n_clusters") == 1, F.col("low")).otherwise(0.955 * F.col("_h")).alias("footnote_cut"))


def table_of_contents(provisions: DataFrame) -> DataFrame:
    """doc_id, text: what a regulation has, from provisions (doc_id, ord, type, number, title, chapter, section).

    Articles once each, by number, under chapters and sections where these change; annexes by roman number; titles
    by their first line. A document without articles or annexes lists none.
    """
    from ..functions.refs import lead_int, roman_to_int

    title = F.trim(F.substring_index(F.trim(F.coalesce("title", F.lit(""))), "\n", 1))
    rows = provisions.select("doc_id", "ord", "type", "number", title.alias("title"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("section", F.lit("")).alias("section"))
    first = F.row_number().over(Window.partitionBy("doc_id", "type", "number").orderBy("ord"))
    once = rows.filter(F.col("type").isin("Article", "Annex")).withColumn("_f", first).filter("_f = 1")
    articles = once.filter("type = 'Article'").withColumn("n", lead_int(F.col("number")))
    w = Window.partitionBy("doc_id").orderBy("n", "ord")
    articles = articles.withColumn("_c", ~F.col("chapter").eqNullSafe(F.lag("chapter").over(w))).withColumn("_run", F.sum(F.col("_c").cast("int")).over(w))
    named = F.last(F.nullif("section", F.lit("")), True).over(Window.partitionBy("doc_id", "_run").orderBy("n", "ord").rowsBetween(Window.unboundedPreceding, -1))
    articles = articles.withColumn("_s", (F.col("section") != "") & ~F.col("section").eqNullSafe(named))
    lines = F.concat_ws("\n", F.when(F.col("_c"), F.concat(F.lit("Chapter "), "chapter")), F.when(F.col("_s"), F.concat(F.lit("  Section "), "section")), F.concat(F.lit("    Article "), "number", F.lit(": "), "title"))
    ordered = lambda key, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, line.alias("l")))), lambda x: x["l"]), "\n")
    listed = articles.groupBy("doc_id").agg(F.count("*").alias("n_articles"), ordered(["n", "ord"], lines).alias("articles"))
    annexes = once.filter("type = 'Annex'").withColumn("n", F.coalesce(roman_to_int(F.col("number")), F.lit(0)))
    annexes = annexes.groupBy("doc_id").agg(F.count("*").alias("n_annexes"), ordered(["n", "ord"], F.concat(F.lit("Annex "), "number", F.lit(": "), "title")).alias("annexes"))
    last = F.max(F.when(F.col("type") == "Recital", F.element_at(F.split("number", "-"), -1).try_cast("int")))
    out = rows.groupBy("doc_id").agg(F.coalesce(last, F.lit(0)).alias("recitals")).join(listed, "doc_id", "left").join(annexes, "doc_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    summary = F.concat(F.lit("The Act has a preamble, "), count("recitals"), F.lit(" recitals, "), count("n_articles"), F.lit(" articles and "), count("n_annexes"), F.lit(" annexes."))
    return out.select("doc_id", F.concat(summary, F.lit("\n\n"), F.coalesce("articles", F.lit("")), F.lit("\n\n"), F.coalesce("annexes", F.lit(""))).alias("text"))


#: Order of types in an export.
TYPE_ORDER = {"Recital": 0, "Article": 1, "Annex": 2}


def export_key(kind: Column, number: Column, paragraph: Column) -> list[Column]:
    """Columns to order an export by: type, number (roman of annexes), leading number of the paragraph."""
    from ..functions.refs import lead_int, roman_value

    place = F.lit(9)
    for name, n in TYPE_ORDER.items():
        place = F.when(kind == name, n).otherwise(place)
    return [place, F.when(kind == "Annex", roman_value(number)).otherwise(lead_int(number)), lead_int(F.coalesce(paragraph, F.lit("")))]


def trace_documents(rows: DataFrame) -> DataFrame:
    """Retrieved rows (text, similarity, retrieved_by, metadata columns) as documents of a trace: page_content, type, metadata."""
    meta = [c for c in rows.columns if c not in ("text", "query_id", "rank")]
    return rows.select("query_id", "rank", F.struct(F.col("text").alias("page_content"), F.lit("Document").alias("type"), F.struct(*meta).alias("metadata")).alias("document"))
