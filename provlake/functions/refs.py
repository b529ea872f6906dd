"""Provision references: roman numbers, ranges, and two grammars that differ on purpose.

``parse_question`` is strict: a kind must be spelled out, ranges may use "to", annexes and chapters become
roman. ``parse_refs`` is loose: stems with typos count, bare numbers inherit the kind, annexes become ints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits by place.
_PLACES = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
_ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def int_to_roman(n: Column) -> Column:
    """1 to 3999; others are null."""
    digit = lambda i: F.element_at(F.array(*map(F.lit, _PLACES[i])), (F.floor(n / (10 ** (3 - i))) % 10 + 1).cast("int"))
    return F.when(n.between(1, 3999), F.concat(*[digit(i) for i in range(4)]))


def roman_value(s: Column) -> Column:
    """Sum of the digits I to M in any case, of which those with a larger one after them are taken away; others count 0."""
    digits = F.transform(F.split(F.upper(s), ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair]), c), F.lit(0)))
    signed = F.transform(digits, lambda v, i: F.when(F.exists(F.slice(digits, i + 2, F.size(digits)), lambda later: later > v), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def roman_to_int(s: Column) -> Column:
    """Value of a well-formed roman number, in any case; others are null."""
    return F.when((s != "") & F.upper(s).rlike(_ROMAN), roman_value(s))


def expand_range(label: Column) -> Column:
    """ "1-5" to its numbers as strings; another label to itself; empty to none. A falling range has none."""
    lo, hi = F.regexp_extract(label, r"^\s*([0-9]+)\s*[-–]\s*([0-9]+)\s*$", 1), F.regexp_extract(label, r"^\s*([0-9]+)\s*[-–]\s*([0-9]+)\s*$", 2)
    lo_n, hi_n = lo.try_cast("int"), hi.try_cast("int")
    empty = F.expr("cast(array() as array<string>)")
    rising = F.transform(F.sequence(lo_n, F.greatest(lo_n, hi_n)), lambda x: x.cast("string"))
    return F.when(F.coalesce(label, F.lit("")) == "", empty).when(lo == "", F.array(F.trim(label))).when(lo_n > hi_n, empty).otherwise(rising)


def lead_int(label: Column) -> Column:
    """First number of a value or range, else 0."""
    return F.coalesce(F.regexp_extract(label, r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


_REF = "array<struct<kind:string,num:string>>"


def parse_question(text: Column) -> Column:
    """Strict grammar: a sorted array of (kind, num) strings."""
    number = r"(?:[0-9]+[a-z]?|[ivxlcdm]+)\b(?:\s*\([^)]*\))*"
    joint = r"(?:\s*(?:,|&|\band\b|\bor\b|\bto\b|-|–)\s*(?:and\s+|or\s+)?)"
    spans = F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:(?:articles?|art\.?|annex(?:es)?|recitals?|sections?|chapters?)\s+{number}(?:{joint}{number})*|preamble\b)"), F.lit(0))

    def refs_of(span: Column) -> Column:
        stem = F.substring(span, 1, 3)
        kind = F.when(stem == "art", "article").when(stem == "ann", "annex").when(stem == "rec", "recital").when(stem == "sec", "section").when(stem == "cha", "chapter").otherwise("preamble")
        body = F.regexp_replace(F.regexp_replace(span, r"^[a-z]+\.?\s*", ""), r"\([^)]*\)", "")
        # separators first, so that the letters of "and" are no numbers
        parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(body, r"\bto\b|–", "-"), r"\band\b|\bor\b|&", ","), r"\s*,\s*"), lambda x: F.trim(x) != "")

        def numbers(part: Column) -> Column:
            ends = F.transform(F.split(part, r"\s*-\s*"), lambda x: F.trim(x))
            lo, hi = ends[0].try_cast("int"), F.try_element_at(ends, F.lit(2)).try_cast("int")
            span_ok = (F.size(ends) == 2) & lo.isNotNull() & hi.isNotNull() & (lo <= hi)
            return F.when(span_ok, F.transform(F.sequence(F.when(span_ok, lo).otherwise(1), F.when(span_ok, hi).otherwise(1)), lambda x: x.cast("string"))).otherwise(ends)

        def name(num: Column) -> Column:
            as_int = num.try_cast("int")
            roman = F.when(roman_to_int(num).isNotNull(), F.upper(num))
            wide = F.coalesce(F.when(as_int.isNotNull(), int_to_roman(as_int)), roman)
            plain = F.when(num.rlike("^[0-9]+[a-z]?$"), num)
            return F.when(kind.isin("annex", "chapter"), wide).when(kind == "article", plain).otherwise(F.when(as_int.isNotNull(), num))

        names = F.filter(F.transform(F.flatten(F.transform(parts, numbers)), name), lambda x: x.isNotNull())
        return F.when(kind == "preamble", F.array(F.struct(kind.alias("kind"), F.lit("0").alias("num")))).otherwise(F.transform(names, lambda n: F.struct(kind.alias("kind"), n.alias("num"))))

    return F.array_sort(F.array_distinct(F.coalesce(F.flatten(F.transform(spans, refs_of)), F.expr(f"cast(array() as {_REF})"))))


def parse_refs(text: Column) -> Column:
    """Loose grammar: a sorted array of (kind, int)."""
    bare = F.regexp_replace(F.lower(text), r"([0-9ivxlc])\s*\([^)]*\)", "$1")
    tokens = F.regexp_extract_all(bare, F.lit(r"\b(?:art|recit|annex|pream|section)[a-z]*|[0-9]+\s*[-–]\s*[0-9]+|[0-9]+|\b[ivxlc]+\b"), F.lit(0))
    # artcile and the like: the stem is enough
    state = "named_struct('kind', cast(null as string), 'out', cast(array() as array<struct<kind:string,num:int>>))"

    def step(a: Column, t: Column) -> Column:
        stem = F.when(t.startswith("art"), "article").when(t.startswith("recit"), "recital").when(t.startswith("annex"), "annex").when(t.startswith("pream"), "preamble").when(t.startswith("section"), "section")
        lo, hi = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("int"), F.regexp_extract(t, r"([0-9]+)$", 1).try_cast("int")
        number = F.when(lo.isNotNull(), F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi)))).when(a["kind"] == "annex", F.array(roman_value(t)))
        valid = F.filter(F.coalesce(number, F.expr("cast(array() as array<int>)")), lambda x: x.isNotNull())
        named = a["kind"].isin("article", "recital", "annex")
        more = F.when(named, F.transform(valid, lambda n: F.struct(a["kind"].alias("kind"), n.alias("num")))).otherwise(F.expr("cast(array() as array<struct<kind:string,num:int>>)"))
        preamble = F.array(F.struct(F.lit("preamble").alias("kind"), F.lit(0).alias("num")))
        return F.when(stem.isNotNull(), F.struct(stem.alias("kind"), F.when(stem == "preamble", F.concat(a["out"], preamble)).otherwise(a["out"]).alias("out"))).otherwise(F.struct(a["kind"].alias("kind"), F.concat(a["out"], more).alias("out")))

    return F.array_sort(F.array_distinct(F.aggregate(tokens, F.expr(state), step, lambda a: a["out"])))


def citation_detail(citation: Column) -> Column:
    """A strict citation as (kind, num, labels: the paragraphs it covers); null for other text, and for numbers that are none."""
    form = r"^(Article|Annex|Recital)s?\s+([A-Za-z0-9]+(?:\s*[-–]\s*[0-9]+)?)(?:\(([^)]+)\))?$"
    part = lambda i: F.regexp_extract(F.trim(citation), form, i)
    first = F.regexp_extract(part(2), r"^([A-Za-z0-9]+)", 1)
    num = F.coalesce(F.when((part(1) == "Annex") & F.upper(first).rlike("^[IVXLC]+$"), roman_value(first)), first.try_cast("int"))
    return F.when((part(1) != "") & num.isNotNull(), F.struct(F.lower(part(1)).alias("kind"), num.alias("num"), expand_range(part(3)).alias("labels")))


def unsupported_citations(answer: Column, kept: Column) -> Column:
    """References in an answer's brackets that the kept citations (one text) do not name, as sorted "kind n"."""
    inside = F.array_join(F.regexp_extract_all(answer, F.lit(r"\((?:[^()]|\([^()]*\))*\)"), F.lit(0)), " ; ")
    gone = F.array_except(parse_refs(F.regexp_replace(inside, r"^\(", "")), parse_refs(kept))
    return F.array_sort(F.transform(gone, lambda r: F.concat_ws(" ", r["kind"], r["num"].cast("string"))))


def match_provisions(chunks, refs):
    """chunks (chunk_id, type, number, chapter, section, ...) that refs (query_id, kind, num) name, with their query_id.

    Articles by number, annexes by roman number, recitals by overlap with a packed range, the preamble by
    type; a section counts within the chapters named, if any is, and a chapter where no section is named.

    Both sides become keys (kind, number), a packed range one key a number, and meet in equi-joins of keys alone;
    pairs are made distinct by id before the chunks' columns join them. chunk_id is unique.
    """
    from pyspark.sql import Window

    section, chapter = F.trim(F.substring_index("section", " - ", 1)), F.trim(F.substring_index("chapter", " - ", 1))
    key = lambda kind, num, on: F.when(on, F.transform(num, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("num"))))
    own = [key("article", F.array(F.lower("number")), F.col("type") == "Article"), key("annex", F.array(F.upper("number")), F.col("type") == "Annex"), key("recital", expand_range(F.col("number")), F.col("type") == "Recital"), key("preamble", F.array(F.lit("0")), F.col("type") == "Preamble")]
    none = F.expr("cast(array() as array<struct<kind:string,num:string>>)")
    named = chunks.select("chunk_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in own]))).alias("k")).select("chunk_id", "k.*")
    asked = refs.select("query_id", "kind", "num").distinct()
    has = lambda kind: F.max(F.col("kind") == kind).over(Window.partitionBy("query_id"))
    asked = asked.withColumn("_chapters", has("chapter")).withColumn("_sections", has("section"))
    places = chunks.select("chunk_id", section.alias("section"), chapter.alias("chapter")).filter("section <> '' or chapter <> ''")
    sections, chapters = asked.filter("kind = 'section'"), asked.filter("kind = 'chapter'")
    found = [
        named.join(asked.filter("kind not in ('section', 'chapter')"), ["kind", "num"]),
        places.join(sections.filter("not _chapters"), F.col("section") == F.col("num")),
        places.join(sections.filter("_chapters").join(chapters.select("query_id", F.col("num").alias("_chapter")), "query_id"), (F.col("section") == F.col("num")) & (F.col("chapter") == F.col("_chapter"))),
        places.join(chapters.filter("not _sections"), F.col("chapter") == F.col("num")),
    ]
    pairs = found[0].select("query_id", "chunk_id")
    for f in found[1:]:
        pairs = pairs.unionByName(f.select("query_id", "chunk_id"))
    return chunks.join(pairs.distinct(), "chunk_id")
