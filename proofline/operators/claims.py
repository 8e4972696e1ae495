"""Answers, claims and verdicts: strict readers of model replies, and gates over their decisions."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of a claim reply.
MOST_REPLY, MOST_CLAIMS, MOST_TEXT, MOST_EVIDENCE = 40_000, 20, 1_200, 8
#: Fixed patterns of a claim: what it may not hold (control characters and line ends, citations in any bracket, code, tags), how it
#: may not begin (headings and items), formulas and abbreviations whose stops end nothing, and what may follow its end.
_MARKS = re.compile(r"[\x00-\x1f\x7f\u0085\u2028\u2029]|[\[［【]\s*[SsＳｓ]|`|<[^>]+>")
_BEGINS = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s)")
_FORMULA = re.compile(r"\$\$.*?\$\$|(?<!\\)\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S)
_ABBREVIATED = re.compile(r"\b(?:e\.g\.|i\.e\.|et al\.|Figs?\.|Eqs?\.|Sec\.|Dr\.|Prof\.)", re.I)
_CLOSING = " \t。.!?！？；;”’\"'"
_GOES_ON = re.compile(rf"(?:[。！？!?]|(?<!\d)\.|\.(?!\d)).*?[^{_CLOSING}]", re.S)


def one_sentence(text: str) -> bool:
    """If nothing but closing marks follows the first stop; stops in formulas, abbreviations and decimals are none."""
    for pattern in (_FORMULA, _ABBREVIATED):
        text = pattern.sub(lambda m: " " * len(m[0]), text)
    return not _GOES_ON.search(text)


def strict_json(raw: str) -> object:
    """JSON without repeated keys, NaN or infinities; ValueError otherwise."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name: str) -> None:
        raise ValueError(f"{name} is no number of JSON")

    return json.loads(raw, object_pairs_hook=pairs, parse_constant=constant)


#: What holds of each claim of a reply, given the known evidence ids.
_CLAIM_RULES = (
    lambda c, known: isinstance(c, dict) and c.keys() == {"text", "evidence_ids"} and isinstance(c["text"], str) and isinstance(c["evidence_ids"], list),
    lambda c, known: 0 < len(c["text"].strip()) and len(c["text"]) <= MOST_TEXT,
    lambda c, known: not _MARKS.search(c["text"]) and not _BEGINS.match(c["text"]) and one_sentence(c["text"]),
    lambda c, known: all(isinstance(e, str) and e in known for e in c["evidence_ids"]),
    lambda c, known: 1 <= len(set(c["evidence_ids"])) == len(c["evidence_ids"]) <= MOST_EVIDENCE,
)


def read_claims(raw: str | None, known: set[str]) -> tuple[str, list[tuple[str, list[str]]]]:
    """(status, [(claim, evidence ids)]) of a model's reply: all of it is right, or the status is ``invalid``.

    A reply has exactly the keys status and claims; ``insufficient`` goes with no claims. Each claim is one sentence
    without markup or citations, unlike the others, and names one to eight known ids once each.
    """
    invalid = ("invalid", [])
    if raw is None or len(raw) > MOST_REPLY:
        return invalid
    try:
        reply = strict_json(raw)
    except ValueError:
        return invalid
    if not (isinstance(reply, dict) and reply.keys() == {"status", "claims"} and isinstance(reply["claims"], list)):
        return invalid
    claims = reply["claims"]
    counts = {"insufficient": range(1), "answered": range(1, MOST_CLAIMS + 1)}
    if not isinstance(reply["status"], str) or len(claims) not in counts.get(reply["status"], ()):
        return invalid
    if not all(all(rule(claim, known) for rule in _CLAIM_RULES) for claim in claims):
        return invalid
    found = [(claim["text"].strip(), claim["evidence_ids"]) for claim in claims]
    return (reply["status"], found) if len(dict(found)) == len(found) else invalid


#: Fixed values of a decision: what is checked, with which outcomes, and on what basis a scope holds.
FACETS = ("content", "scope", "conditions")
STATES = frozenset(("entailed", "contradicted", "missing", "uncertain"))
BASES = frozenset(("explicit_statement", "aggregate_evidence", "single_example", "inference", "none"))
RELATIONS = frozenset(("same_or_narrower", "claim_broader", "unknown"))
#: Fixed patterns of words that a claim's scope or conditions hang on.
LIMITED = r"\bnot\s+(?:all|every|always)\b|并非所有|并非总是|并不总是|不总是|不是所有"
GENERAL = (
    r"\b(?:often|usually|generally|typically|always|all|every|most|default|universally|frequently)\b|通常|普遍|一般情况下|总是|所有|多数|默认|往往"
)
CONDITION = r"\b(?:only if|only when|provided that|if|when|unless|under|without|only)\b|只有在|仅在|如果|当.{0,12}时|除非|在.{0,12}条件下"


def risk_cues(claim: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, words) of the cues in a claim, in order; a generalisation that is taken back is only limited."""
    masked = re.sub(LIMITED, lambda m: "\0" * len(m[0]), claim, flags=re.I)  # as cue_counts, but in place
    where = {"limited_quantifier": (LIMITED, claim), "generalization": (GENERAL, masked), "condition": (CONDITION, claim)}
    return sorted((*m.span(), kind, m[0]) for kind, (pattern, text) in where.items() for m in re.finditer(pattern, text, re.I))


def cue_counts(claim: Column) -> Column:
    """How many cues of each kind a claim has, as a struct (limited, generalizations, conditions); counted in the JVM."""
    count = lambda text, pattern: F.coalesce(F.regexp_count(text, F.lit(f"(?i){pattern}")), F.lit(0))
    return F.struct(
        count(claim, LIMITED).alias("limited"), count(F.regexp_replace(claim, f"(?i){LIMITED}", " "), GENERAL).alias("generalizations"),
        count(claim, CONDITION).alias("conditions"),
    )


def read_decision(raw: str | None, packet_id: str, claim_id: str, known: set[str]) -> dict | None:
    """The checks of a reviewer's reply by facet, or None unless all of it is right.

    Each of the three checks has a state, a reason and up to three known evidence ids, at least one if it is entailed
    or contradicted; that of the scope also has a basis and a relation.
    """
    try:
        if raw is None or not raw.strip() or len(raw) > 24_000:
            return None
        reply = strict_json(raw)
        if set(reply) != {"packet_id", "claim_id", "checks"} or (reply["packet_id"], reply["claim_id"]) != (packet_id, claim_id) or set(reply["checks"]) != set(FACETS):
            return None
        for facet, check in reply["checks"].items():
            if set(check) != {"status", "reason", "evidence_ids"} | ({"basis", "relation"} if facet == "scope" else set()):
                return None
            ids, needed = check["evidence_ids"], check["status"] in ("entailed", "contradicted")
            if check["status"] not in STATES or not check["reason"].strip() or len(check["reason"]) > 600:
                return None
            if not isinstance(ids, list) or not needed <= len(ids) <= 3 or len(set(ids)) != len(ids) or not set(ids) <= known:
                return None
            if facet == "scope" and not (check["basis"] in BASES and check["relation"] in RELATIONS):
                return None
        return reply["checks"]
    except (ValueError, TypeError, AttributeError, KeyError):
        return None


def verdict(content: Column, scope: Column, conditions: Column, relation: Column, basis: Column, generalises: Column) -> Column:
    """supported, unsupported or uncertain, from the three checks of a claim.

    A claim that is broader than its evidence misses its scope unless that is contradicted; an unknown relation makes
    an entailed scope uncertain; without a basis, or for a generalisation from a single example or an inference, an
    entailed scope is missing. What is contradicted or missing is unsupported, what is uncertain uncertain.
    """
    scope = F.when((relation == "claim_broader") & (scope != "contradicted"), "missing").otherwise(scope)
    scope = F.when((relation == "unknown") & (scope == "entailed"), "uncertain").otherwise(scope)
    weak = (basis == "none") | (generalises & basis.isin("single_example", "inference", "none"))
    scope = F.when(weak & (scope == "entailed"), "missing").otherwise(scope)
    states = F.array(content, scope, conditions)
    return (
        F.when(F.array_contains(states, "contradicted") | F.array_contains(states, "missing"), "unsupported")
        .when(F.array_contains(states, "uncertain"), "uncertain").otherwise("supported")
    )


def gate_answers(packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state of each answer (answer_id, packet_id) under its decisions (packet_id, verdict).

    A verdict that is none of the known ones makes it invalid; then a packet without a decision incomplete, an
    unsupported claim unsupported, an uncertain one uncertain; else it is supported. Two decisions for one packet are
    invalid.
    """
    judged = decisions.groupBy("packet_id").agg(F.count("*").alias("n"), F.max("verdict").alias("verdict"))
    joined = packets.join(judged, "packet_id", "left")
    known = F.col("verdict").isin("supported", "unsupported", "uncertain")
    severity = (
        F.when(F.col("n") > 1, 4).when(F.col("n").isNull(), 3).when(~F.coalesce(known, F.lit(False)), 4)
        .when(F.col("verdict") == "unsupported", 2).when(F.col("verdict") == "uncertain", 1).otherwise(0)
    )
    names = F.array(*map(F.lit, ("supported", "uncertain", "unsupported", "incomplete", "invalid")))
    return joined.groupBy("answer_id").agg(F.max(severity).alias("s"), F.count("*").alias("claims")).select(
        "answer_id", "claims", names[F.col("s")].alias("state")
    )


#: Fixed limits of a quote and its source, and the white space that is folded.
MOST_QUOTE, MOST_SOURCE, _WHITE = 1_200, 64_000, "[ \\t\\r\\n]"


def align_quote(quote: Column, source: Column) -> Column:
    """A struct (start, stop, text, exact): the one place of ``source`` that has ``quote`` when runs of white space are equal.

    Offsets are code points of the source as it is, from 0, the end excluded; nothing is trimmed, and white space is never
    added or left out. ``exact`` says if the place spells the quote. Null where there is no such place or several
    (overlapping ones count), and where the quote is blank, or it, the place or the source is too long.
    """
    run = f"(?<!{_WHITE}){_WHITE}+(?!{_WHITE})"
    literal = lambda part: F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.array_join(F.transform(F.split(quote, f"{_WHITE}+"), literal), run)
    places = F.call_function("regexp_count", source, F.concat(F.lit("(?="), pattern, F.lit(")")))
    before = F.call_function("regexp_extract", source, F.concat(F.lit("(?s)^(.*?)(?:"), pattern, F.lit(")")), F.lit(1))
    text = F.call_function("regexp_extract", source, pattern, F.lit(0))
    fits = quote.rlike("[^ \\t\\r\\n]") & (F.length(quote) <= MOST_QUOTE) & F.length(source).between(1, MOST_SOURCE)
    start = F.length(before)
    found = F.struct(start.alias("start"), (start + F.length(text)).alias("stop"), text.alias("text"), (text == quote).alias("exact"))
    return F.when(fits & (places == 1) & (F.length(text) <= MOST_QUOTE), found)


def first_json_object(raw: str) -> dict:
    """The first JSON object in a model's reply, fenced or after other words; ValueError without one."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", raw, re.S | re.I)
    text = fenced[1] if fenced else raw
    start = text.find("{")
    if start < 0:
        raise ValueError("no object")
    value, _ = json.JSONDecoder().raw_decode(text[start:])
    return value


def read_plan(raw: str, question: str, most: int = 3) -> list[tuple[str, str]]:
    """(target, query) of each subquery of a planner's reply; ValueError unless there are two or more and all differ."""
    found = [(s["target"].strip(), s["query"].strip()) for s in first_json_object(raw)["subqueries"]]
    same = lambda text: re.sub(r"[\W_]+", "", text.casefold())
    queries, targets = {same(q) for _, q in found}, {same(t) for t, _ in found}
    if not 2 <= len(found) <= most or len(queries) < len(found) or len(targets) < len(found) or same(question) in queries:
        raise ValueError("subqueries")
    if any(not t or not q or len(t) > 500 or len(q) > 500 for t, q in found):
        raise ValueError("lengths")
    return found


#: Fixed patterns of an answer's claims: words whose period ends no sentence, headings, and lines that only lead in.
_SHORTENED = re.compile(r"\b(?:et al|e\.g|i\.e|Fig|Figs|Eq|Eqs|Sec|Secs|Dr|Mr|Ms|Prof)\.$", re.I)
_HEADING = re.compile(r"^\s*(?:(?:\d+|[A-Za-z])[.)]\s+)?(?:#{1,6}\s+.+|\*\*[^*\n]+\*\*\s*[:：]?)\s*$")
_LEAD_IN = re.compile(r"^\s*(?:\*{1,2})?[^.!?。！？:\n]{1,80}(?:\*{1,2})?\s*[:：]\s*$")
_ITEM_MARK = re.compile(r"^\s*(?:[-*+]\s+|\d+[.)]\s+|#{1,6}\s+)")
_UNIT_END = re.compile(r"(?<=[.!?。！？])\s+(?=\S)")


def claim_units(answer: str) -> list[str]:
    """The sentences of an answer that claim something: no headings, no lead-ins, three letters or digits at least.

    A sentence ends at a stop before white space, so citations behind that begin the next unit. A lead-in is a whole line of at most
    80 characters that ends in a colon; a period of an abbreviation ends no sentence.
    """
    units: list[str] = []
    for line in answer.splitlines():
        text = _ITEM_MARK.sub("", line)
        if _HEADING.fullmatch(line) or _LEAD_IN.fullmatch(text):
            continue
        ends = [m.span() for m in _UNIT_END.finditer(text) if not _SHORTENED.search(text, 0, m.start())]
        units += [text[a:b].strip() for a, b in zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)])]
    return [u for u in units if len(re.findall(r"[A-Za-z0-9\u3400-\u9fff]", re.sub(r"\[[^\]]+\]", "", u))) >= 3]


def claims_of_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, position, text, citations) of the units of each answer (answer_id, answer)."""
    from proofline.functions.text import cited_numbers

    @F.arrow_udf("array<string>")
    def units(column: pa.Array) -> pa.Array:
        return pa.array([claim_units(answer.as_py() or "") for answer in column], pa.list_(pa.string()))

    found = answers.select("answer_id", F.posexplode(units("answer")).alias("position", "text"))
    return found.withColumn("citations", cited_numbers(F.col("text")))


def no_evidence_no_support(judged: DataFrame) -> DataFrame:
    """Judged claims (citations, supported), where a claim without any citation is not supported, whatever was judged."""
    return judged.withColumn("supported", F.when(F.size("citations") == 0, F.lit(False)).otherwise(F.col("supported")))


def guard_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, source_count) with shown and status, as ``functions.text.guard_answer`` has them."""
    from proofline.functions.text import guard_answer

    @F.arrow_udf("struct<shown:string,status:string>")
    def guarded(texts: pa.Array, counts: pa.Array) -> pa.Array:
        found = [guard_answer(text.as_py(), n.as_py()) for text, n in zip(texts, counts)]
        return pa.array([{"shown": shown, "status": status} for shown, status in found], pa.struct([("shown", pa.string()), ("status", pa.string())]))

    return answers.withColumn("_g", guarded(F.col("answer"), F.col("source_count"))).withColumns({"shown": F.col("_g.shown"), "status": F.col("_g.status")}).drop("_g")
