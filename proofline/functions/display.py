"""Small text rules of sources, places and identifiers, as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a place that nothing is known of, and a citation that isn't a link yet.
NO_PLACE, _UNLINKED = "位置元数据暂缺", "(?i)\\[(S\\d+)\\](?!\\()"


def folded_lines(text: Column) -> Column:
    """Lines without outer white space and with single spaces inside; line breaks stay."""
    lines = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n")
    whole = F.array_join(F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "[\\t\\f\\x0B ]+", " "))), "\n")
    return F.regexp_replace(whole, "^\\s+|\\s+$", "")


def identifier(value: Column) -> Column:
    """A table's or figure's number in one spelling: a leading letter is upper case, else a closing one lower case."""
    bare = F.trim(value)
    return F.when(bare.rlike("^\\p{L}"), F.upper(bare)).when(bare.rlike("\\p{L}$"), F.lower(bare)).otherwise(bare)


def page_range(start: Column, end: Column) -> Column:
    """All pages from ``start`` to ``end``; the one that is known if the other isn't, none if both aren't."""
    none = F.array().cast("array<int>")
    both = F.when(start <= end, F.sequence(start, end)).otherwise(none)
    return F.when(start.isNotNull() & end.isNotNull(), both).otherwise(F.array_compact(F.array(start, end)))


def plain_words(text: Column) -> Column:
    """A text's words in NFKC and case-folded, with single spaces."""

    @F.arrow_udf("string")
    def folded(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in column.to_pylist()], pa.string())

    return F.array_join(F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), " ")


def source_id(given: Column, index: Column) -> Column:
    """The id that a source has, if it is a right one, else S and its place from 1."""
    bare = F.upper(F.trim(given))
    return F.when(bare.rlike("^S\\d+$"), bare).otherwise(F.concat(F.lit("S"), index.cast("string")))


def linked(text: Column) -> Column:
    """Citations as links to the evidence; those that are links already stay."""
    marks = F.regexp_replace(text, _UNLINKED, "\u0001$1\u0002")
    parts = F.split(marks, "\u0001")

    def link(part: Column) -> Column:
        name = F.upper(F.substring_index(part, "\u0002", 1))
        rest = F.regexp_replace(part, "(?s)^[^\u0002]*\u0002", "")
        return F.when(F.contains(part, F.lit("\u0002")), F.concat(F.lit("["), name, F.lit("](#evidence-"), name, F.lit(")"), rest)).otherwise(part)

    return F.array_join(F.transform(parts, link), "")


def place(page_start: Column, page_end: Column, section_path: Column) -> Column:
    """Where evidence is: its pages and its section, or NO_PLACE."""
    last = F.coalesce(page_end, page_start)
    pages = F.when(page_start == last, F.concat(F.lit("第 "), page_start, F.lit(" 页"))).when(page_start.isNotNull(), F.concat(F.lit("第 "), page_start, F.lit("–"), last, F.lit(" 页")))
    named = F.filter(section_path, lambda s: F.trim(s) != "")
    section = F.when(F.size(named) > 0, F.array_join(named, " › "))
    return F.coalesce(F.nullif(F.concat_ws(" · ", pages, section), F.lit("")), F.lit(NO_PLACE))


#: Titles that say nothing of a paper.
GENERIC_TITLES = ("perspective", "article", "research article", "contents")


def suspicious_title(title: Column) -> Column:
    """If a title is missing, an address, generic, or shorter than eight characters."""
    bare = F.trim(F.regexp_replace(title, "\\s+", " "))
    return F.coalesce((bare == "") | F.lower(bare).rlike("^(?:https?://|www\\.)") | F.lower(bare).isin(*GENERIC_TITLES) | (F.length(bare) < 8), F.lit(True))


def is_image_path(text: Column) -> Column:
    """If a text is nothing but the path of an image, marked up or not."""
    bare = F.regexp_replace(F.regexp_replace(text, "^\\s+|\\s+$", ""), "^[!\\[\\]()]+|[!\\[\\]()]+$", "")
    return bare.rlike("(?i)^(?:[./\\\\\\w-]+[/\\\\])?[\\w.-]+\\.(?:png|jpe?g|gif|svg|webp)$")
