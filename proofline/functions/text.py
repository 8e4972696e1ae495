"""Text expressions that stay in the JVM, and the Python text rules that can't."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters that are matched by pairs, and other letters and digits.
CJK = "\\x{3400}-\\x{9fff}"
TOKEN = f"([{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+)"
#: One for each Han character, run of letters, digits and underscores, or other mark.
BUDGET = f"[{CJK}]|[A-Za-z0-9_]+|[^\\s]"
#: Fixed values of the reference penalty.
CITATION, MANY_CITATIONS, CITATION_HEAD = "\\[\\s*\\d+(?:\\s*[-,]\\s*\\d+)*\\s*\\]", 3, 1600
#: What a question says that asks for a kind of section.
QUESTION_CUES = {
    "method": ("方法", "模型", "架构", "怎么做", "如何实现", "method", "methodology", "approach", "architecture"),
    "conclusion": ("结论", "总结", "主要发现", "conclusion", "conclusions", "summary", "finding"),
    "abstract": ("摘要", "概述", "abstract", "overview"),
    "experiment": ("实验", "评测", "结果", "性能", "experiment", "evaluation", "result", "performance"),
}
#: How sections of that kind are named.
SECTION_CUES = {
    "method": (
        "method", "methodology", "model architecture", "approach", "encoder and decoder", "proposed model", "scaled dot-product attention",
        "multi-head attention", "position-wise feed-forward networks", "positional encoding",
    ),
    "conclusion": ("conclusion", "conclusions", "discussion and conclusion", "summary and conclusion"),
    "abstract": ("abstract",),
    "experiment": ("experiment", "experiments", "evaluation", "results", "experimental results"),
}


#: Texts of these characters alone are the same in NFKC, and but for sharp s their case folding is their lower case:
#: ASCII, letters of Western Europe, Han and its stops, dashes and quotes.
_FOLDED_PLAINLY = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ\\x{4e00}-\\x{9fa5}。、–—‘’“”]*$"


def tokens(text: Column) -> Column:
    """Lexical tokens of a text in NFKC and case-folded: runs of letters and digits; Han runs as overlapping pairs.

    A single Han character stays alone. Null gives null. Only texts with characters that NFKC or case folding may
    change go through Python.
    """
    folded = compatible(text)

    def parts(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    def split(once: Column) -> Column:
        plain = F.regexp_extract_all(once, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))  # much cheaper, and the same without Han
        runs = F.regexp_extract_all(once, F.lit(TOKEN), F.lit(1))
        return F.when(once.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, parts))).otherwise(plain)

    return F.transform(F.array(folded), split)[0]  # a variable of a lambda is computed once, however often it is named


def fold_compatibility(text: Column) -> Column:
    """NFKC and case folding."""

    @F.arrow_udf("string")
    def folded(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in column.to_pylist()], pa.string())

    return folded(text)


def compatible(text: Column) -> Column:
    """NFKC and case folding in the JVM where that is the lower case, in Python for the other texts."""
    plainly = text.rlike(_FOLDED_PLAINLY)
    return F.when(plainly, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(fold_compatibility(F.when(~plainly, text)))


def token_budget(text: Column) -> Column:
    """Estimated model tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(BUDGET)), F.lit(0)).cast("long")


def normal_name(value: Column) -> Column:
    """Lower case, with runs of spaces, underscores and hyphens as one space."""
    return F.trim(F.regexp_replace(F.lower(value), "[\\s_-]+", " "))


def query_id(value: Column, index: Column) -> Column:
    """A slug of up to 32 characters; ``query_<index>`` if nothing is left."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 32)
    return F.when(slug == "", F.concat(F.lit("query_"), index.cast("string"))).otherwise(slug)


def target_identity(value: Column) -> Column:
    """Letters and digits only, lower case: two targets with the same are the same."""
    return F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]+", "")


def _any_of(cues: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, cues)).replace("\\-", "-").replace("\\ ", " ")


def section_intent(question: Column) -> Column:
    """The one kind of section that a question asks for; null if none or several."""
    asked = F.array(*[F.when(F.lower(question).rlike(_any_of(cues)), F.lit(kind)) for kind, cues in QUESTION_CUES.items()])
    kinds = F.filter(asked, lambda k: k.isNotNull())
    return F.when(F.size(kinds) == 1, kinds[0])


def reference_penalty(content_type: Column, section: Column, text: Column) -> Column:
    """0.24 for a reference list, 0.18 for a passage full of bracket numbers, else 0."""
    listed = (F.lower(content_type) == "reference") | F.lower(section).rlike("references|bibliography|参考文献")
    many = F.regexp_count(F.substring(text, 1, CITATION_HEAD), F.lit(CITATION)) >= MANY_CITATIONS
    return F.when(F.coalesce(listed, F.lit(False)), 0.24).when(F.coalesce(many, F.lit(False)), 0.18).otherwise(0.0)


def section_boost(intent: Column, content_type: Column, section: Column, text: Column) -> Column:
    """0.42 if the section path names the intent, else 0.34 for a heading near the start of the text, else 0.30 by type."""
    named, headed, no = F.lit(False), F.lit(False), F.lit(False)
    for kind, cues in SECTION_CUES.items():
        words = _any_of(cues)
        named = named | ((intent == kind) & F.lower(section).rlike(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"))
        heading = f"(?:^|[\\r\\n]|[.!?]\\s+)\\s*(?:#{{1,6}}\\s*)?(?:\\*{{0,2}}\\d+(?:\\.\\d+)*\\*{{0,2}}\\s*)?\\*{{0,2}}(?:{words})\\*{{0,2}}(?=\\s|:)"
        headed = headed | ((intent == kind) & F.lower(F.substring(text, 1, 1200)).rlike(heading))
    return (
        F.when(F.coalesce(named, no), 0.42).when(F.coalesce(headed, no), 0.34).when(F.coalesce(intent == F.lower(content_type), no), 0.30).otherwise(0.0)
    )


def cited_numbers(answer: Column) -> Column:
    """Distinct source numbers that an answer cites as [S1] or [S1, S2]."""
    groups = F.regexp_extract_all(answer, F.lit("\\[(S[0-9]+(?:\\s*,\\s*S[0-9]+)*)\\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("S([0-9]+)"), F.lit(1)))).cast("array<int>"))


#: A citation bracket, an item of its list, the widest range and the most sources of one bracket.
_BRACKET = re.compile(r"\[\s*(S[^\]\n]*)\]", re.I)
_ITEM = re.compile(r"\s*S([1-9]\d{0,5})(?:\s*[-–—]\s*S?([1-9]\d{0,5}))?\s*", re.I)
_WIDEST, _MOST_SOURCES = 99, 100
#: The answer without evidence, what refuses any answer, what may, and what only looks like a citation.
NO_EVIDENCE = "当前检索证据不足，无法可靠回答该问题。请补充相关文献或缩小问题范围。"
_REFUSES = re.compile(r"cannot\s+(?:reliably\s+)?answer\s+(?:this|the|your)\s+question|无法(?:可靠)?回答(?:该|这个|此|您的)问题", re.I)
_ABSTAINS = re.compile(
    r"证据不足|信息不足|无法.{0,12}(?:回答|确定|确认)|(?:未|没有|并未).{0,8}(?:报告|提及|提供|包含|找到)|insufficient\s+evidence|"
    r"evidence\s+(?:is\s+)?insufficient|cannot\s+(?:reliably\s+)?(?:answer|determine|confirm)|"
    r"(?:does?\s+not|did\s+not|not)\s+(?:report|mention|provide|specify)",
    re.I,
)
_CITED_SENTENCE = re.compile(r"\[S[1-9]\d*\][^.!?。！？\n]*[.!?。！？\n]")
_CITED, _LOOKS_CITED = re.compile(r"\[S([1-9]\d*)\]"), re.compile(r"[\[［【]\s*[SsＳｓ]")


def _sources_of(bracket: str, source_count: int) -> list[int] | None:
    """The distinct sources that a bracket's list of ids and ranges names, in order; None if it is malformed."""
    items = [_ITEM.fullmatch(part) for part in re.split("[,;，、]", bracket)]
    if not all(items):
        return None
    ranges = [range(int(low), int(high or low) + 1) for low, high in (item.groups() for item in items)]
    if any(not 1 <= len(r) <= _WIDEST + 1 or r[-1] > source_count for r in ranges) or sum(map(len, ranges)) > _MOST_SOURCES:
        return None
    return list(dict.fromkeys(n for r in ranges for n in r))


def normalize_citations(answer: str, source_count: int) -> str | None:
    """``answer`` with each list or range of sources as single brackets; None if a bracket is malformed.

    Malformed is what isn't a list of ids and ranges, a descending range or one of over 100, a source beyond
    ``source_count``, or over 100 sources in one bracket.
    """
    named = {m[0]: _sources_of(m[1], source_count) for m in _BRACKET.finditer(answer)}
    if None in named.values():
        return None
    return _BRACKET.sub(lambda m: "".join(f"[S{n}]" for n in named[m[0]]), answer)


def refuses(answer: str) -> bool:
    """If the whole answer is a refusal, and not only a reservation after a cited sentence."""
    found = _ABSTAINS.search(answer)
    return bool(_REFUSES.search(answer) or (found and not _CITED_SENTENCE.search(answer, 0, found.start())))


def guard_answer(answer: str | None, source_count: int | None) -> tuple[str, str]:
    """(text to show, status): the answer, its citations expanded, if all it cites is there; else NO_EVIDENCE.

    The status is the first that holds of no_evidence (no sources), empty_answer, malformed_citation,
    insufficient_evidence (a refusal), malformed_citation (a bracket left over), invalid_or_missing_citation,
    normalized_citations (brackets were expanded) and passed.
    """
    text = normalize_citations(answer or "", source_count or 0)
    cited = [int(n) for n in _CITED.findall(text or "")]
    checks = [
        ("no_evidence", not source_count),
        ("empty_answer", not (answer or "").strip()),
        ("malformed_citation", text is None),
        ("insufficient_evidence", text is not None and refuses(text)),
        ("malformed_citation", text is not None and bool(_LOOKS_CITED.search(_CITED.sub("", text)))),
        ("invalid_or_missing_citation", not cited or max(cited) > (source_count or 0)),
    ]
    failed = next((name for name, holds in checks if holds), None)
    return (NO_EVIDENCE, failed) if failed else (text, "passed" if text == answer else "normalized_citations")


def identifiers(text: Column) -> Column:
    """A struct (doi, arxiv_id, year) of what the head of a paper says, null where it says nothing."""
    some = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    doi = F.regexp_replace(some("(?i)\\b(10\\.\\d{4,9}/[-._;()/:a-z0-9]+)", 1), "[.,;)]+$", "")
    arxiv = some("(?i)arxiv:\\s*(\\d{4}\\.\\d{4,5}(?:v\\d+)?)", 1)
    return F.struct(doi.alias("doi"), arxiv.alias("arxiv_id"), some("\\b((?:19|20)\\d{2})\\b", 1).cast("int").alias("year"))


def written_language(text: Column) -> Column:
    """zh if more than a fifth of the letters are Han, else en; null without letters."""
    han, letters = F.regexp_count(text, F.lit(f"[{CJK}]")), F.regexp_count(text, F.lit("\\p{L}"))
    return F.when(letters > 0, F.when(han > 0.2 * letters, "zh").otherwise("en"))
