"""Registered queries of requests, audits and displays, with DuckDB SQL; what the tables lack is derived from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions import display
from proofline.functions.text import token_budget
from proofline.operators import audits, catalog, requests
from proofline.sources.collections import parse_quality, read_table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks: those after the first go on, every fifth conversation is of bridges."""
    rows = _turns(spark, sf_dir).select("text", (F.col("turn") > 0).alias("continued"), (F.col("conv_id") % 5 == 0).alias("is_bridge"), F.col("text").rlike("[|]").alias("is_table"))
    return audits.chunk_summary(rows).withColumn("avg_chunk_length", F.round("avg_chunk_length", 6))


CHUNK_COUNTS = """
SELECT count(*) AS total_chunks, count(*) FILTER (conv_id % 5 = 0) AS bridge_chunks, count(*) FILTER (turn > 0 AND conv_id % 5 <> 0) AS cross_page_chunks,
       count(*) FILTER (turn <= 0 AND conv_id % 5 <> 0) AS single_page_chunks, count(*) FILTER (contains(text, '|')) AS table_chunks, round(avg(length(text)), 6) AS avg_chunk_length FROM conversations"""


def chunk_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks whose sources are the documents of the next two numbers; labels as blocks."""
    docs = read_table(spark, sf_dir, "documents")
    name = lambda k: F.concat(F.lit("b"), k)
    chunks = docs.select(F.floor(F.col("doc_id") / 3 * 2).alias("chunk_id"), token_budget(F.col("text")).alias("token_count"), F.array(name(F.col("doc_id") + 1), name(F.col("doc_id") + 2)).alias("block_ids"))
    blocks = read_table(spark, sf_dir, "labels").select(name(F.col("doc_id") * 2).alias("block_id"), F.when(F.col("quality") == 1, "table").otherwise("text").alias("type"))
    return audits.chunk_regression(chunks, blocks)


CHUNK_PROBLEMS = r"""
WITH c AS (SELECT CAST(floor(doc_id / 3 * 2) AS BIGINT) AS chunk_id, doc_id, coalesce(len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[^\s]')), 0) AS n FROM documents),
s AS (SELECT DISTINCT unnest([doc_id + 1, doc_id + 2]) AS b FROM c)
SELECT 'oversized' AS problem, count(*) AS n FROM c WHERE n > 900
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT chunk_id FROM c GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'dangling_source', count(*) FROM s WHERE b NOT IN (SELECT doc_id * 2 FROM labels)
UNION ALL SELECT 'missing_table', count(*) FROM labels WHERE quality = 1 AND doc_id * 2 NOT IN (SELECT b FROM s)"""


def claim_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as claims of ten documents a case, predicted from their toxicity."""
    labels = read_table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 10).alias("case_id"), (F.col("quality") == 1).alias("expected"), ((F.col("toxic") == 0) & (F.col("doc_id") % 9 > 0)).alias("predicted"))
    found = audits.claim_decisions(labels)
    return found.select(*[c if c in ("cases", "claims") else F.round(c, 6).alias(c) for c in found.columns])


CLAIM_ACCURACY = """
WITH l AS (SELECT doc_id // 10 AS case_id, quality = 1 AS expected, toxic = 0 AND doc_id % 9 > 0 AS predicted FROM labels),
c AS (SELECT case_id, bool_and(expected = predicted) AS exact FROM l GROUP BY ALL)
SELECT (SELECT count(*) FROM c) AS cases, count(*) AS claims, round(count(*) FILTER (expected = predicted) / count(*), 6) AS accuracy, (SELECT round(avg(CAST(exact AS INT)), 6) FROM c) AS exact_cases,
       coalesce(round(count(*) FILTER (NOT expected AND NOT predicted) / nullif(count(*) FILTER (NOT expected), 0), 6), 1) AS unsupported_recall,
       coalesce(round(count(*) FILTER (expected AND predicted) / nullif(count(*) FILTER (expected), 0), 6), 1) AS supported_recall FROM l"""


def claim_state_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    state = F.when(F.col("toxic") == 1, "unsupported").when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("quality") == 1, "supported").otherwise("uncertain")
    return audits.claim_states(labels.select(state.alias("state"))).withColumn("share", F.round("share", 6))


CLAIM_STATES = """
WITH s AS (SELECT CASE WHEN toxic = 1 THEN 'unsupported' WHEN doc_id % 11 = 0 THEN 'missing' WHEN quality = 1 THEN 'supported' ELSE 'uncertain' END AS state FROM labels)
SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY ALL"""


def supplier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's suppliers of returned and of other lines are the same."""
    lines = read_table(spark, sf_dir, "lineitem")
    side = lambda rows: rows.select((F.col("l_orderkey") % 500).alias("key"), (F.col("l_suppkey") % 4).alias("id"))
    return audits.same_sets(side(lines.where("l_returnflag = 'R'")), side(lines.where("l_returnflag <> 'R'")), "key", "id")


SUPPLIER_SETS = """
WITH a AS (SELECT l_orderkey % 500 AS key, list_sort(list_distinct(list(l_suppkey % 4))) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
b AS (SELECT l_orderkey % 500 AS key, list_sort(list_distinct(list(l_suppkey % 4))) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT key, coalesce(x = y, false) AS same FROM a FULL JOIN b USING (key)"""


def lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn that the next one hasn't as often."""
    words = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    keyed = lambda shift: words.select(F.concat_ws("/", "conv_id", F.col("turn") - shift).alias("key"), "word")
    return audits.lost_tokens(keyed(0), keyed(1), "key", "word")


LOST_WORDS = """
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations),
b AS (SELECT conv_id || '/' || turn AS key, word, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT conv_id || '/' || (turn - 1) AS key, word, count(*) AS m FROM w GROUP BY ALL)
SELECT key, word, n - coalesce(m, 0) AS lost FROM b LEFT JOIN a USING (key, word) WHERE n > coalesce(m, 0)"""


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' first words as evidence, all documents' as sources, by number of twenty."""
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("case_id"), "doc_id", F.array_join(F.slice(F.split("text", "[ \n]"), 1, 2), " ").alias("text"))
    asked = docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    found = audits.matching_sources(asked.withColumn("text", F.concat("text", F.lit("!"))), docs.select("case_id", F.col("doc_id").alias("source_id"), "text"))
    return found.select("case_id", "text", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("sources"))


EVIDENCE_SOURCES = r"""
WITH d AS (SELECT doc_id, doc_id % 20 AS case_id, array_to_string(list_slice(string_split_regex(text, '[ \n]'), 1, 2), ' ') AS text FROM documents),
n AS (SELECT *, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ') AS w FROM d),
e AS (SELECT DISTINCT case_id, text || '!' AS text, w FROM n WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT e.case_id, e.text, coalesce(string_agg(n.doc_id, ',' ORDER BY n.doc_id), '') AS sources FROM e LEFT JOIN n USING (case_id, w) GROUP BY ALL"""


def citation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that cite by their number, with the turns before them as sources."""
    turns = _turns(spark, sf_dir)
    name = F.concat_ws("/", "conv_id", "turn")
    said = turns.where("role = 'assistant'")
    answers = said.select(name.alias("answer_id"), F.concat(F.lit("So [S1] and ["), F.when(F.col("turn") % 4 == 1, "s2").otherwise("S9"), F.lit("].")).alias("answer"))
    sources = said.select(name.alias("answer_id"), F.posexplode(F.sequence(F.lit(1), F.col("turn") + 1)).alias("i", "k"))
    sources = sources.select("answer_id", (F.col("i") + 1).alias("position"), F.when(F.col("k") == 2, " s2 ").when(F.col("k") == 3, "x").alias("given_id"))
    return audits.cited_sources(answers, sources)


CITATION_KINDS = """
WITH a AS (SELECT conv_id || '/' || turn AS answer_id, turn, CASE WHEN turn % 4 = 1 THEN 'S2' ELSE 'S9' END AS second FROM conversations WHERE role = 'assistant'),
k AS (SELECT answer_id, 'S' || unnest(range(1, turn + 2)) AS source_id FROM a), c AS (SELECT answer_id, 'S1' AS source_id FROM a UNION SELECT answer_id, second FROM a)
SELECT answer_id, source_id, CASE WHEN k.answer_id IS NULL THEN 'unknown' WHEN c.answer_id IS NULL THEN 'uncited' ELSE 'cited' END AS kind FROM k FULL JOIN c USING (answer_id, source_id)"""


def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user's stream that is of an expected type."""
    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("filename"), F.col("event_id").alias("rank"))
    types = events.select("filename").distinct()
    users = events.select("query_id").distinct()
    expected = users.join(types, F.length("filename") % 3 == F.col("query_id") % 3)
    return audits.first_rank(events, expected)


FIRST_RANKS = """
WITH x AS (SELECT DISTINCT user_id AS query_id, t.event_type FROM events, (SELECT DISTINCT event_type FROM events) t WHERE length(t.event_type) % 3 = user_id % 3)
SELECT query_id, min(event_id) AS rank FROM x LEFT JOIN events ON user_id = query_id AND events.event_type = x.event_type GROUP BY ALL"""


def source_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sources: their id, place and link, pages and identifiers in one spelling."""
    events = read_table(spark, sf_dir, "events")
    k = F.col("user_id").cast("int")
    start, end = F.when(k % 3 > 0, k), F.when(k % 4 > 0, k + k % 2)
    path = F.when(k % 5 > 0, F.array("event_type", F.lit(" "), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return events.select(
        "event_id", display.source_id(F.when(k % 2 == 0, F.concat(F.lit(" s"), k)), F.col("event_id")).alias("source_id"), display.place(start, end, path).alias("place"),
        display.linked(F.concat(F.lit("a [s"), k, F.lit("] b [S2](#x) c"))).alias("linked"), F.size(display.page_range(start, end)).alias("pages"),
        display.identifier(F.concat(F.when(k % 2 == 0, "a.").otherwise(" "), k, F.lit("B "))).alias("identifier"),
        display.suspicious_title(F.when(k % 7 == 0, "Contents").when(k % 7 == 1, "WWW. a site of its own").when(k % 7 == 2, "short  ").otherwise("A title of a paper")).alias("suspicious"),
        display.is_image_path(F.concat(F.lit("![](img/"), "event_type", F.when(k % 2 == 0, ".PNG)").otherwise(".txt)"))).alias("is_image"),
        display.folded_lines(F.concat(F.lit("  a \t b\r\n "), "event_type", F.lit("  "))).alias("folded"),
    )


SOURCE_DISPLAY = r"""
WITH e AS (SELECT event_id, event_type, CAST(user_id AS INT) AS k, CASE WHEN user_id % 3 > 0 THEN CAST(user_id AS INT) END AS a, CASE WHEN user_id % 4 > 0 THEN CAST(user_id + user_id % 2 AS INT) END AS z FROM events),
p AS (SELECT *, CASE WHEN a = coalesce(z, a) THEN '第 ' || a || ' 页' WHEN a IS NOT NULL THEN '第 ' || a || '–' || coalesce(z, a) || ' 页' END AS paged, CASE WHEN k % 5 > 0 THEN event_type || ' › x' END AS named FROM e)
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'S' || k ELSE 'S' || event_id END AS source_id, coalesce(nullif(concat_ws(' · ', paged, named), ''), '位置元数据暂缺') AS place,
       'a [S' || k || '](#evidence-S' || k || ') b [S2](#x) c' AS linked, CAST(CASE WHEN a IS NULL AND z IS NULL THEN 0 WHEN a IS NULL OR z IS NULL THEN 1 ELSE z - a + 1 END AS INT) AS pages,
       CASE WHEN k % 2 = 0 THEN 'A.' || k || 'B' ELSE k || 'b' END AS identifier, k % 7 < 3 AS suspicious, k % 2 = 0 AS is_image, 'a b' || chr(10) || event_type AS folded FROM p"""


def chat_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat for each source answers from: candidates over a threshold, by section, five of them."""
    from proofline.plans.evidence import _section_hits

    hits = _section_hits(spark, sf_dir).withColumn("position", F.expr("row_number() over (partition by query_id order by id)"))
    return requests.chat_hits(hits, 5, 0.2).select("query_id", "id", "rank", F.round("adjusted", 6).alias("adjusted"))


def _chat_sql() -> str:
    from proofline.plans.evidence import SECTION_RERANK

    candidates = requests.candidates_for_sections(5)
    limited = SECTION_RERANK.replace("FROM documents WHERE source IS NOT NULL),", f"FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= {candidates} AND doc_id * 7 % 100 >= 20),")
    return f"SELECT query_id, id, rank, adjusted FROM ({limited.replace('rank <= 10', 'rank <= 5')})"


def named_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases whose lines' suppliers are hits, and two suppliers as the named papers of some."""
    lines = read_table(spark, sf_dir, "lineitem")
    hits = lines.select((F.col("l_orderkey") % 300).alias("case_id"), (F.col("l_suppkey") % 12).cast("string").alias("filename")).distinct()
    named = hits.select("case_id").distinct().where("case_id % 3 > 0").select("case_id", F.explode(F.array(F.lit("1"), (F.col("case_id") % 12).cast("string"))).alias("filename"))
    return requests.named_papers_gate(hits, named)


NAMED_GATE = """
WITH h AS (SELECT DISTINCT l_orderkey % 300 AS case_id, CAST(l_suppkey % 12 AS VARCHAR) AS filename FROM lineitem),
n AS (SELECT DISTINCT case_id, unnest(['1', CAST(case_id % 12 AS VARCHAR)]) AS filename FROM h WHERE case_id % 3 > 0),
m AS (SELECT DISTINCT case_id FROM n ANTI JOIN h USING (case_id, filename))
SELECT case_id, filename, CASE WHEN case_id % 3 > 0 THEN 'complete' END AS status FROM h WHERE case_id NOT IN (SELECT case_id FROM m)"""


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the nations after some are renamed and one collection is dropped."""
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("collection"), F.lower("n_name").alias("display_name"), "n_nationkey")
    changes = nations.where("n_nationkey % 4 = 0").select("collection", F.concat(F.lit("new "), "display_name").alias("display_name"))
    names = catalog.upsert_names(nations.drop("n_nationkey"), changes)
    return catalog.drop_collection(names, names, "collection", "NATION_3")[1]


DISPLAY_NAMES = "SELECT n_name AS collection, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' ELSE '' END || lower(n_name) AS display_name FROM nation WHERE n_name <> 'NATION_3'"


def parse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed papers of seven pages, whose lines are blocks; some lack their text, box or type."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("paper_id", F.col("l_orderkey") % 200)
    blocks = lines.select(
        "paper_id", F.when(F.col("l_tax") > 0.07, "unknown").otherwise(F.col("l_returnflag")).alias("type"), F.when(F.col("l_discount") > 0.08, " ").otherwise("x").alias("text"),
        F.col("l_linenumber").alias("page"), F.when(F.col("l_quantity") > 5, F.array(F.lit(0.0))).alias("bbox"),
    )
    found = parse_quality(blocks, lines.select("paper_id").distinct().withColumn("total_pages", F.lit(8)))
    return found.select(
        "paper_id", "total_blocks", "parsed_pages", F.round("provenance_coverage", 6).alias("provenance_coverage"), "empty_block_count",
        F.array_join(F.col("empty_page_numbers").cast("array<string>"), ",").alias("empty_pages"), F.coalesce(F.col("block_counts")["R"], F.lit(0)).alias("returned"),
    )


PARSE_REPORTS = """
WITH b AS (SELECT l_orderkey % 200 AS paper_id, CASE WHEN l_tax > 0.07 THEN 'unknown' ELSE l_returnflag END AS type, l_discount <= 0.08 AS has, l_linenumber AS page, l_quantity > 5 AS boxed FROM lineitem),
e AS (SELECT paper_id, string_agg(page, ',' ORDER BY page) AS empty_pages FROM (SELECT DISTINCT paper_id, unnest(range(1, 9)) AS page FROM b) ANTI JOIN (SELECT DISTINCT paper_id, page FROM b WHERE has) USING (paper_id, page) GROUP BY ALL)
SELECT paper_id, count(*) AS total_blocks, count(DISTINCT page) FILTER (has) AS parsed_pages, round(coalesce(avg(CAST(boxed AS INT)) FILTER (type <> 'unknown'), 0), 6) AS provenance_coverage,
       count(*) FILTER (NOT has) AS empty_block_count, coalesce(any_value(empty_pages), '') AS empty_pages, count(*) FILTER (type = 'R') AS returned FROM b LEFT JOIN e USING (paper_id) GROUP BY ALL"""


def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(catalog.searched(read_table(spark, sf_dir, "documents"), "SRC1", "source"), "lang", "source")


STORE_TOTALS = """
WITH g AS (SELECT lang, count(DISTINCT source) AS f, count(*) AS n FROM documents WHERE contains(lower(source), 'src1') GROUP BY lang)
SELECT count(*) AS collections, CAST(coalesce(sum(f), 0) AS BIGINT) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM g"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filenames(read_table(spark, sf_dir, "documents"), "source")


FILE_NAMES = "SELECT DISTINCT source AS filename FROM documents WHERE trim(source) <> ''"

QUERIES = {
    "chunk_counts": (chunk_counts, CHUNK_COUNTS),
    "chunk_problems": (chunk_problems, CHUNK_PROBLEMS),
    "claim_accuracy": (claim_accuracy, CLAIM_ACCURACY),
    "claim_state_shares": (claim_state_shares, CLAIM_STATES),
    "supplier_sets": (supplier_sets, SUPPLIER_SETS),
    "lost_words": (lost_words, LOST_WORDS),
    "evidence_sources": (evidence_sources, EVIDENCE_SOURCES),
    "citation_kinds": (citation_kinds, CITATION_KINDS),
    "first_ranks": (first_ranks, FIRST_RANKS),
    "source_display": (source_display, SOURCE_DISPLAY),
    "chat_selection": (chat_selection, _chat_sql()),
    "named_gate": (named_gate, NAMED_GATE),
    "display_names": (display_names, DISPLAY_NAMES),
    "parse_reports": (parse_reports, PARSE_REPORTS),
    "store_totals": (store_totals, STORE_TOTALS),
    "file_names": (file_names, FILE_NAMES),
}
