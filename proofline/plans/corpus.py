"""Registered queries over collections, samples, contexts, conversations, pages and events, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.markup import html_blocks, html_blocks_sql
from proofline.functions.text import cited_numbers, normal_name, token_budget
from proofline.operators import catalog, chunking, claims, context, metrics, papers, sampling, structure
from proofline.sources.collections import read_table
from proofline.streaming.ingest import event_windows, sessions

SEED = "proofline"


def catalog_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.document_catalog(read_table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars")


CATALOG_BY_SOURCE = "SELECT source AS filename, count(*) AS chunks, min(doc_id) AS first_chunk, max(n_chars) AS created FROM documents GROUP BY ALL"


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_stats(read_table(spark, sf_dir, "documents"), "source", "n_chars")


COLLECTION_STATS = "SELECT count(*) AS n_rows, count(DISTINCT source) AS files, max(n_chars) AS latest FROM documents"


def all_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.all_stats(read_table(spark, sf_dir, "documents"), "lang", "source")


ALL_STATS = "SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS files, CAST(grouping(lang) AS INT) AS is_total FROM documents GROUP BY ROLLUP (lang)"


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as collections; those that a page's path names by a language have it as display name."""
    docs = read_table(spark, sf_dir, "documents")
    names = docs.where("lang <> 'en'").groupBy(F.col("source").alias("collection")).agg(F.min("lang").alias("display_name"))
    return catalog.knowledge_bases(docs, names, "source")


KNOWLEDGE_BASES = """
WITH n AS (SELECT source AS collection, min(lang) AS display_name FROM documents WHERE lang <> 'en' GROUP BY ALL)
SELECT collection, coalesce(display_name, collection) AS display_name FROM (SELECT DISTINCT source AS collection FROM documents) LEFT JOIN n USING (collection)"""


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.where(catalog.in_scope(["fr", "es"], ["src1", "src2"], F.col("lang"), F.col("source"))).select("doc_id", normal_name(F.col("source")).alias("source"), "lang")


SCOPE_FILTER = "SELECT doc_id, trim(regexp_replace(lower(source), '[\\s_-]+', ' ', 'g')) AS source, lang FROM documents WHERE lang IN ('fr', 'es') OR source IN ('src1', 'src2')"


def duplicate_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a store of the labelled ones would refuse."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return catalog.already_present(docs, read_table(spark, sf_dir, "labels"), ["doc_id"])


DUPLICATE_INGEST = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def delete_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, removed = catalog.without(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    return left.agg(F.count("*").alias("remaining")).crossJoin(removed)


DELETE_LABELLED = """
SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS remaining,
       count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS removed FROM documents"""


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids of which there is no page."""
    return catalog.dangling(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "pages"), "doc_id", "page_id")


DANGLING = "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT page_id FROM pages)"


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.per_stratum(docs, "lang", "doc_id", 25, SEED)


HASH_SAMPLE = f"""
SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:sample:' || doc_id), doc_id) AS INT) AS position
FROM documents QUALIFY position <= 25"""


def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.proportional(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 97)


PROPORTIONAL = """
WITH p AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)
SELECT doc_id, source FROM p ORDER BY place / size, source, doc_id LIMIT 97"""


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.by_turns(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 90, SEED)


ROUND_ROBIN = f"""
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}:turn:' || doc_id), doc_id) AS INT) AS turn
FROM documents ORDER BY turn, source LIMIT 90"""


def nearest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of a user the nearest click on each side, not across an error."""
    events = read_table(spark, sf_dir, "events")
    kind = F.col("event_type")
    found = context.nearest_context(events, ["user_id"], ["ts", "event_id"], kind == "click", F.col("event_id"), kind == "error")
    return found.select("event_id", "before", "after")


NEAREST_VIEW = """
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch,
                  CASE WHEN event_type = 'click' THEN event_id END AS click FROM events)
SELECT event_id, last_value(click IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
       first_value(click IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM s WINDOW w AS (PARTITION BY user_id, stretch ORDER BY ts, event_id)"""


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an error and a purchase that are at most 12 events apart."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    pick = lambda kind: events.where(F.col("event_type") == kind).select("event_id", F.lit(0).alias("all"))
    return context.within_band(pick("error"), pick("purchase"), ["all"], "event_id", 12).select("l_event_id", "r_event_id")


BAND_JOIN = """
SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM events a JOIN events b ON abs(a.event_id - b.event_id) <= 12
WHERE a.event_type = 'error' AND b.event_type = 'purchase'"""


def alias_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the aliases of a page's host in its address (whole, without its first or last label) those in no longer one."""
    pages = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    labels = F.split(host, "\\.")
    aliases = F.array_distinct(F.array(host, F.array_join(F.slice(labels, 2, F.size(labels)), "."), labels[0]))
    spans = F.filter(
        F.transform(aliases, lambda a: F.struct(F.instr(F.col("url"), a).alias("start"), (F.instr(F.col("url"), a) + F.length(a)).alias("stop"), a.alias("alias"))),
        lambda s: (s["start"] > 0) & (F.length(s["alias"]) >= 3),
    )
    kept = pages.select("page_id", spans.alias("spans")).select("page_id", F.inline(context.widest_spans(F.col("spans"))))
    return kept.select("page_id", "alias", "start", "stop")


ALIAS_SPANS = r"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM h),
a AS (SELECT DISTINCT page_id, url, unnest([host, array_to_string(labels[2:], '.'), labels[1]]) AS alias FROM l),
s AS (SELECT page_id, alias, CAST(instr(url, alias) AS INT) AS start, CAST(instr(url, alias) + length(alias) AS INT) AS stop FROM a WHERE instr(url, alias) > 0 AND length(alias) >= 3)
SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.page_id = x.page_id AND y.start <= x.start AND y.stop >= x.stop AND y.stop - y.start > x.stop - x.start)"""


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule on the share of letters of the whole text."""
    docs = read_table(spark, sf_dir, "documents")
    letters = F.regexp_count("text", F.lit("\\p{L}")) / F.greatest(F.length("text"), F.lit(1))
    guessed = docs.select("doc_id", F.when(letters >= 0.75, 1).otherwise(0).alias("guess"))
    found = metrics.by_class(read_table(spark, sf_dir, "labels").join(guessed, "doc_id"), "quality", "guess")
    return found.select("class", "right", "said", "real", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


LABEL_CONFUSION = r"""
WITH g AS (SELECT quality, CASE WHEN len(regexp_extract_all(text, '\p{L}')) / greatest(length(text), 1) >= 0.75 THEN 1 ELSE 0 END AS guess
           FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest([0, 1]) AS class),
n AS (SELECT class, count(*) FILTER (quality = class AND guess = class) AS right, count(*) FILTER (guess = class) AS said, count(*) FILTER (quality = class) AS real FROM c, g GROUP BY ALL)
SELECT class, "right", said, real, CASE WHEN said > 0 THEN round("right" / said, 6) ELSE 0 END AS precision, CASE WHEN real > 0 THEN round("right" / real, 6) ELSE 0 END AS recall,
       CASE WHEN said + real > 0 THEN round(2 * "right" / (said + real), 6) ELSE 0 END AS f1 FROM n WHERE said + real > 0"""


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten turns of each conversation, 4,000 characters of each."""
    turns = read_table(spark, sf_dir, "conversations")
    kept = catalog.top_per_group(turns, ["conv_id"], [F.desc("turn")], 10)
    return kept.select("conv_id", "turn", "role", F.expr("left(text, 4000)").alias("text"))


HISTORY_WINDOW = "SELECT conv_id, turn, role, left(text, 4000) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10"


def reply_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of each assistant turn against the turn before it, and the sources that it cites."""
    turns = read_table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.split(F.lower("text"), " ").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("answer"), F.size(cited_numbers(F.col("text"))).alias("citations"))
    both = said.join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", "citations", F.round(metrics.bag_f1(F.col("answer"), F.col("question")), 6).alias("f1"))


REPLY_OVERLAP = r"""
WITH a AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS answer,
                  CAST(len(list_distinct(flatten(list_transform(regexp_extract_all(text, '\[(S[0-9]+(?:\s*,\s*S[0-9]+)*)\]', 1), lambda g: regexp_extract_all(g, 'S([0-9]+)', 1))))) AS INT) AS citations
           FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, turn + 1 AS turn, string_split(lower(text), ' ') AS question FROM conversations),
b AS (SELECT * FROM a JOIN q USING (conv_id, turn)),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(answer) AS w FROM b) GROUP BY ALL),
y AS (SELECT conv_id, turn, w, count(*) AS m FROM (SELECT conv_id, turn, unnest(question) AS w FROM b) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(n, m)) AS shared FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, citations, round(2.0::DOUBLE * coalesce(shared, 0) / (len(answer) + len(question)), 6) AS f1 FROM b LEFT JOIN o USING (conv_id, turn)"""


def page_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges between consecutive turns of a conversation, as between the pages of a document."""
    return context.bridges(read_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 150)


PAGE_BRIDGES = """
WITH n AS (SELECT conv_id, turn AS from_page, text, lead(turn) OVER w AS to_page, lead(text) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, from_page, to_page, right(text, 150) || chr(10) || left(following, 150) AS bridge FROM n WHERE to_page - from_page = 1 AND trim(text) <> '' AND trim(following) <> ''"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "(?i)<h1(?:\\s[^>]*)?>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("(?i)<p(?:\\s[^>]*)?>")).alias("paragraphs"))


PAGE_TITLES = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?i)<h1(?:\\s[^>]*)?>([^<]*)</h1>', 1) AS heading,
       CAST(len(regexp_extract_all(html, '(?i)<p(?:\\s[^>]*)?>')) AS INT) AS paragraphs FROM pages"""


def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, packed into chunks of 600 to 900 tokens."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    items = F.transform(lines, lambda line: F.struct(F.lit("").alias("section"), line.alias("text"), token_budget(line).alias("n")))
    return chunking.pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", items.alias("items")))


PACKED_LINES = r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents),
u AS (SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM s),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, len(regexp_extract_all(line, '[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[^\s]')) AS n FROM u WHERE trim(line) <> ''),
f AS (SELECT doc_id, pos, CAST(1 AS BIGINT) AS chunk, n AS total FROM l WHERE pos = 1
      UNION ALL SELECT l.doc_id, l.pos, chunk + CAST(total >= 600 OR total + n > 900 AS INT), CASE WHEN total >= 600 OR total + n > 900 THEN n ELSE total + n END
      FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1)
SELECT doc_id, CAST(chunk AS INT) AS chunk_index, '' AS section, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text, max(total) AS token_count FROM f JOIN l USING (doc_id, pos) GROUP BY doc_id, chunk"""


def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose every eight lines are a page, split and stitched."""
    lines = F.split("text", "\n")
    numbers = F.sequence(F.lit(1), F.ceil(F.size(lines) / 8).cast("int"))
    pages = F.transform(numbers, lambda page: F.struct(page.alias("page"), F.array_join(F.slice(lines, (page - 1) * 8 + 1, F.lit(8)), "\n").alias("text")))
    return chunking.chunk_documents(read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", pages.alias("pages")))


def sentence_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.evidence_anchors(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.evidence_units(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and other blocks of each whole page as blocks of a paper."""
    blocks = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), F.posexplode(html_blocks(F.col("html"))).alias("ord", "b"))
    return blocks.select("paper_id", "ord", F.when(F.col("b.tag").rlike("^h[1-6]$"), "heading").otherwise("paragraph").alias("type"), F.col("b.text").alias("text"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.section_paths(_page_blocks(spark, sf_dir))
    return found.select("paper_id", "ord", F.array_join("section_path", " > ").alias("section"))


PAGE_SECTIONS = f"""
WITH b AS (SELECT page_id, {html_blocks_sql('html')} AS blocks FROM pages),
u AS (SELECT page_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS ord FROM b)
SELECT page_id AS paper_id, CAST(ord AS INT) AS ord,
       coalesce(last_value(CASE WHEN b.tag = 'h1' THEN b.text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS section
FROM u"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each whole page."""
    found = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_blocks(F.col("html"))).alias("ord", "b"))
    return found.select("page_id", "ord", "b.tag", "b.text")


PAGE_BLOCKS = f"""
WITH b AS (SELECT page_id, {html_blocks_sql('html')} AS blocks FROM pages)
SELECT page_id, CAST(generate_subscripts(blocks, 1) - 1 AS INT) AS ord, unnest(blocks).tag AS tag, unnest(blocks).text AS text FROM b"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware chunks of the pages."""
    whole = structure.with_section_paths(_page_blocks(spark, sf_dir)).select(
        "paper_id", F.concat(F.lit("b"), "ord").alias("block_id"), "ord", "type", "text", F.lit(1).alias("page"), "section_path",
        F.lit(None).cast("string").alias("caption_of"), F.lit(None).cast("array<string>").alias("context_ids"),
    )
    about = read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("paper_id"), F.col("url").alias("filename"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.array().cast("array<string>").alias("authors")
    )
    return papers.structure_chunks(whole, about)


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers whose assistant turns are claims, judged by the labels of the same numbers."""
    turns = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    packets = turns.select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") * 2 + F.floor(F.col("turn") / 2)).alias("packet_id")).distinct()
    decisions = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("packet_id"), F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported").otherwise("uncertain").alias("verdict")
    )
    return claims.gate_answers(packets, decisions)


REVIEW_GATE = """
WITH p AS (SELECT DISTINCT conv_id AS answer_id, conv_id * 2 + turn // 2 AS packet_id FROM conversations WHERE role = 'assistant'),
d AS (SELECT doc_id AS packet_id, count(*) AS n, max(CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'uncertain' END) AS verdict FROM labels GROUP BY ALL),
s AS (SELECT answer_id, count(*) AS claims, max(CASE WHEN n > 1 THEN 4 WHEN n IS NULL THEN 3 WHEN verdict = 'unsupported' THEN 2 WHEN verdict = 'uncertain' THEN 1 ELSE 0 END) AS s
      FROM p LEFT JOIN d USING (packet_id) GROUP BY ALL)
SELECT answer_id, claims, ['supported', 'uncertain', 'unsupported', 'incomplete', 'invalid'][s + 1] AS state FROM s"""


def risk_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of scope and condition in each document that has any."""
    counted = read_table(spark, sf_dir, "documents").select("doc_id", claims.cue_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    return counted.where("limited + generalizations + conditions > 0")


RISK_CUES = rf"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[\x{{C0}}-\x{{24F}}]', 'x', 'g') AS text FROM documents), -- its word boundaries know ASCII only
c AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i){claims.LIMITED}')) AS INT) AS limited,
             CAST(len(regexp_extract_all(regexp_replace(text, '(?i){claims.LIMITED}', ' ', 'g'), '(?i){claims.GENERAL}')) AS INT) AS generalizations,
             CAST(len(regexp_extract_all(text, '(?i){claims.CONDITION}')) AS INT) AS conditions FROM d)
SELECT * FROM c WHERE limited + generalizations + conditions > 0"""


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the bucket of a value inside their JSON."""
    events = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.groupBy(F.floor(F.col("k") / 10).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


JSON_PATHS = "SELECT CAST(floor(CAST(props->>'$.k' AS BIGINT) / 10) AS BIGINT) AS bucket, event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL"


def _text_times(found: DataFrame, *names: str) -> DataFrame:
    return found.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_windows(read_table(spark, sf_dir, "events"), "1 hour")
    return _text_times(found, "window_start", "window_end").withColumn("total", F.round("total", 4))


TUMBLING = """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_windows(read_table(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return _text_times(found, "window_start", "window_end").withColumn("total", F.round("total", 4))


SLIDING = """
WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(sessions(read_table(spark, sf_dir, "events"), "30 minutes"), "session_start", "session_end")


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""


def order_priority_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star-schema check: revenue of each nation and order year."""
    t = lambda name: read_table(spark, sf_dir, name)
    revenue = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    customers = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    joined = revenue.join(orders, "l_orderkey").join(customers, "c_custkey").join(t("nation").select("n_nationkey", "n_name"), "n_nationkey")
    return joined.groupBy("n_name", "year").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n_lines"))


ORDER_REPORT = """
SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""

QUERIES = {
    "catalog_by_source": (catalog_by_source, CATALOG_BY_SOURCE),
    "collection_stats": (collection_stats, COLLECTION_STATS),
    "all_stats_rollup": (all_stats_rollup, ALL_STATS),
    "knowledge_bases": (knowledge_bases, KNOWLEDGE_BASES),
    "scope_filter": (scope_filter, SCOPE_FILTER),
    "duplicate_ingest": (duplicate_ingest, DUPLICATE_INGEST),
    "delete_labelled": (delete_labelled, DELETE_LABELLED),
    "dangling_references": (dangling_references, DANGLING),
    "hash_sample": (hash_sample, HASH_SAMPLE),
    "proportional_sample": (proportional_sample, PROPORTIONAL),
    "round_robin_sample": (round_robin_sample, ROUND_ROBIN),
    "nearest_view": (nearest_view, NEAREST_VIEW),
    "band_join": (band_join, BAND_JOIN),
    "alias_spans": (alias_spans, ALIAS_SPANS),
    "label_confusion": (label_confusion, LABEL_CONFUSION),
    "history_window": (history_window, HISTORY_WINDOW),
    "reply_overlap": (reply_overlap, REPLY_OVERLAP),
    "page_bridges": (page_bridges, PAGE_BRIDGES),
    "page_titles": (page_titles, PAGE_TITLES),
    "packed_lines": (packed_lines, PACKED_LINES),
    "stitched_pages": (stitched_pages, None),
    "sentence_anchors": (sentence_anchors, None),
    "sentence_units": (sentence_units, None),
    "page_sections": (page_sections, PAGE_SECTIONS),
    "page_blocks": (page_blocks, PAGE_BLOCKS),
    "page_chunks": (page_chunks, None),
    "review_gate": (review_gate, REVIEW_GATE),
    "risk_cues": (risk_cues, RISK_CUES),
    "json_paths": (json_paths, JSON_PATHS),
    "tumbling_events": (tumbling_events, TUMBLING),
    "sliding_events": (sliding_events, SLIDING),
    "session_events": (session_events, SESSIONS),
    "order_priority_report": (order_priority_report, ORDER_REPORT),
}
