"""Text column functions: tokens, cleaning, refusals, context blocks, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The refusal sentence in lower case without its full stop, the lines of page furniture and of
#: page numbers, the form of citations, and the separator of context blocks.
REFUSAL = "i cannot find an answer to this in the eu ai act excerpts provided"
FURNITURE = r"EN|L series|Official Journal(?: of the European Union)?|of the European Union|OJ [LC], [0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|ELI:[ \t]*http[^ \t\n]*|[0-9]{4}/[0-9]{3,4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,3}/[0-9]{2,4}"
PAGE_NUMBER = r"EN[ \t]+[0-9]+[ \t]+EN|[0-9]{1,4}"
CITATION = r"(?i)\b(?:article\s+[0-9]+(?:\([0-9]+\))*(?:\([a-z]\))?|recital\s+[0-9]+\b|annex\s+[ivxl]+\b)"
BLOCK_SEPARATOR = "\n\n---\n\n"
_SPACE = r" \t\n\x0B\f\r"
TOKEN = rf"[A-Za-z0-9]+|[^{_SPACE}A-Za-z0-9]"


def search_tokens(text: Column) -> Column:
    """ASCII search tokens in lower case; accents split words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def budget_tokens(text: Column) -> Column:
    """Tokens that chunk budgets count: words and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_pieces(text: Column) -> Column:
    """The text in pieces of one token each, with the white space before it: pieces in a row are a slice of the text."""
    return F.regexp_extract_all(text, F.lit(rf"[{_SPACE}]*(?:{TOKEN})"), F.lit(0))


def slice_of(pieces: Column, start: Column, n: Column) -> Column:
    """The text of n pieces from start (from 1), without white space before the first token."""
    return F.regexp_replace(F.array_join(F.slice(pieces, start, n), ""), rf"^[{_SPACE}]+", "")


def tail(text: Column, n: int) -> Column:
    """The last n tokens of a text, as a slice of it."""
    pieces = token_pieces(text)
    return slice_of(pieces, F.greatest(F.lit(1), F.size(pieces) - n + 1), F.lit(n))


def clean_text(text: Column) -> Column:
    """Line ends, hyphenated breaks, page furniture, page numbers and blank runs, in this order; then trimmed."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "-\n([a-z])", "$1")
    for line in (FURNITURE, PAGE_NUMBER):
        out = F.regexp_replace(out, rf"(?md)^[ \t]*(?:{line})[ \t]*$", "")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\n]+|[ \t\n]+$", "")


def is_refusal(answer: Column, sentence: str = REFUSAL, slack: int = 40) -> Column:
    """Whether the refusal sentence stands near the start; null is no refusal."""
    return F.coalesce(F.contains(F.substring(F.lower(F.trim(answer)), 1, len(sentence) + slack), F.lit(sentence)), F.lit(False))


def refused(flag: Column, answer: Column) -> Column:
    return F.coalesce(flag, is_refusal(answer))


def capped_strings(values: Column, cap: int) -> Column:
    """Trimmed strings that are not empty, the first ``cap``."""
    return F.slice(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), 1, cap)


def location_line(chapter: Column, section: Column) -> Column:
    """Location line of a provision; empty parts are left out."""

    def part(word: str, x: Column) -> Column:
        number, title = F.substring_index(x, " - ", 1), F.regexp_extract(x, " - (.*)$", 1)
        return F.when(x != "", F.concat(F.lit(f"{word} "), number, F.when(title != "", F.concat(F.lit(" ("), title, F.lit(")"))).otherwise("")))

    parts = F.concat_ws(" > ", part("Chapter", chapter), part("Section", section))
    return F.when(parts != "", F.concat(F.lit("Location: "), parts))


def json_object(text: Column) -> Column:
    """The object of a model's answer: in a fenced block, else the whole text, else from the first { to the last }; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    spanned = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(valid(F.nullif(fenced, F.lit(""))), valid(F.when(F.trim(text).startswith("{"), F.trim(text))), F.nullif(spanned, F.lit("")))


def verdict(score: Column, error: Column) -> Column:
    """A judge's score if it is 0 or 1; everything else is null. Numeric text counts, fractions are cut."""
    n = score.try_cast("double").try_cast("int")
    return F.when(error.isNull() & n.isin(0, 1), n)


def verdict_reason(score: Column, error: Column) -> Column:
    """Why a verdict is null: the error, or a missing, not numeric or other score; null for a valid one."""
    n = score.try_cast("double")
    return F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(score.isNull(), "no score").when(n.isNull(), F.concat(F.lit("score is not a number: "), score)).when(~n.try_cast("int").isin(0, 1), F.concat(F.lit("score out of range: "), score))


def ordered_block(rank: Column, header: Column, body: Column) -> Column:
    """Aggregate: rows as one text, in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat(header, F.lit("\n"), body).alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), BLOCK_SEPARATOR)


def citations(text: Column) -> Column:
    """Citations named in a text: white space made single, first letter upper case, first of equals (any case) kept."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    neat = F.transform(found, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.regexp_replace(F.substring(x, 2, 1000), r"\s+", " ")))
    return F.aggregate(neat, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def notes_block(questions: Column, assumptions: Column) -> Column:
    """Numbered sub-questions, if there are several, and assumptions, if there are any; null without either."""
    numbered = F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    asked = F.when(F.size(questions) > 1, F.concat(F.lit("Sub-questions:\n"), numbered))
    assumed = F.when(F.size(assumptions) > 0, F.concat(F.lit("Assumptions: "), F.array_join(assumptions, "; ")))
    return F.nullif(F.concat_ws("\n", asked, assumed), F.lit(""))


def calibration_block(order: Column, question: Column, judge: Column, human: Column, lesson: Column) -> Column:
    """Aggregate: corrected verdicts as lines for a judge's prompt, in order."""
    line = F.concat_ws(" ", F.concat(F.lit("- "), question, F.lit(":")), F.concat(F.lit("judge "), judge.cast("string"), F.lit(", human "), human.cast("string")), F.when(lesson != "", F.concat(F.lit("("), lesson, F.lit(")"))))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.array_join(F.transform(rows, lambda x: x["l"]), "\n")
