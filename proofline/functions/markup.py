"""Blocks of an HTML page, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the page, and elements that are blocks of text.
LEFT_OUT = ("head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "svg")
BLOCKS = "h[1-6]|p|li|dt|dd|td|th|caption|figcaption|pre|blockquote|address|summary"
#: Other elements at whose tags a block ends.
OUTER = "html|body|main|article|section|header|hgroup|div|ul|ol|dl|table|thead|tbody|tfoot|tr|figure|details|fieldset|center|hr"
#: References that are decoded, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))
#: Marks that take the place of tags.
_START, _END = "\x01", "\x02"


def html_blocks(html: Column) -> Column:
    """The blocks of a whole page in order, as array<struct<tag,text>>; ``tag`` is empty for text outside of a block element.

    A block goes from its tag to the next tag of a block or an element around blocks, whatever inline tags and attributes
    lie between. White space within it becomes one space, common character references are decoded, blank blocks are left
    out.
    """
    text = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in LEFT_OUT:
        text = F.regexp_replace(text, f"(?is)<{tag}\\b.*?</{tag}\\s*>", f"{_START}{_END}")
    text = F.regexp_replace(text, f"(?i)<({BLOCKS})(?:\\s[^>]*)?>", f"{_START}$1{_END}")
    text = F.regexp_replace(text, f"(?i)</?(?:{BLOCKS}|{OUTER})(?:\\s[^>]*)?/?>", f"{_START}{_END}")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)<br\\b[^>]*>", " "), "<[^>]*>", "")

    def block(part: Column) -> Column:
        content = F.regexp_replace(part, f"(?s)^[^{_END}]*{_END}", "")
        for reference, mark in REFERENCES:
            content = F.replace(content, F.lit(reference), F.lit(mark))
        return F.struct(
            F.lower(F.regexp_extract(part, f"^([^{_END}]*){_END}", 1)).alias("tag"), F.trim(F.regexp_replace(content, "[ \\t\\r\\n\\x0B\\x0C]+", " ")).alias("text")
        )

    return F.filter(F.transform(F.split(text, _START), block), lambda b: b["text"] != "")


def html_blocks_sql(html: str) -> str:
    """``html_blocks`` in DuckDB SQL: a list of structs."""
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in LEFT_OUT:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b.*?</{tag}\\s*>', chr(1) || chr(2), 'g')"
    text = f"regexp_replace({text}, '(?i)<({BLOCKS})(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g')"
    text = f"regexp_replace({text}, '(?i)</?(?:{BLOCKS}|{OUTER})(?:\\s[^>]*)?/?>', chr(1) || chr(2), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?i)<br\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    content = "CASE WHEN contains(part, chr(2)) THEN substr(part, instr(part, chr(2)) + 1) ELSE part END"
    for reference, mark in REFERENCES:
        mark = mark.replace("'", "''")
        content = f"replace({content}, '{reference}', '{mark}')"
    content = f"trim(regexp_replace({content}, '[ \\t\\r\\n\\x0B\\x0C]+', ' ', 'g'))"
    tag = "CASE WHEN contains(part, chr(2)) THEN lower(left(part, instr(part, chr(2)) - 1)) ELSE '' END"
    return f"list_filter(list_transform(string_split({text}, chr(1)), lambda part: {{'tag': {tag}, 'text': {content}}}), lambda b: b.text <> '')"
