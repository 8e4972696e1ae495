"""Structure-aware chunks of papers: abstract, tables, figures, formulas and prose, each by its own rule."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.shared import small_batches
from proofline.operators import evidence, structure

#: One token for each Han character, run of letters, digits and underscores, or other mark.
_TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
#: Fixed order of the kinds of chunks that begin at the same block.
ORDER = {"abstract": 0, "paragraph": 1, "table": 2, "figure": 3, "formula": 4}
CHUNK = (
    "chunk_id string, chunk_index int, content_type string, text string, retrieval_text string, page_start int, page_end int,"
    " section_path array<string>, source_block_ids array<string>, context_block_ids array<string>, part_index int, part_count int,"
    " row_start int, row_end int, token_count int, warnings array<string>"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_CHUNK = pa.struct([(name, _TYPES[kind]) for name, kind in map(str.split, CHUNK.split(","))])


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def parts_of(text: str, most: int) -> list[str]:
    """A text whole if it has ``most`` tokens at most, else in such parts, by sentences, and by words where a sentence is longer."""
    text = text.strip()
    if tokens(text) <= most:
        return [text] if text else []
    sentences = list(filter(None, map(str.strip, _SENTENCE_END.split(text))))
    pieces = [piece for sentence in sentences for piece in ([sentence] if tokens(sentence) <= most else _by_words(sentence, most))]
    if len(sentences) == 1:
        return pieces
    return _joined(pieces, most)


def _joined(pieces: list[str], most: int) -> list[str]:
    """Pieces joined by a space while they have ``most`` tokens at most; no token goes over a space, so those of a part add up."""
    groups: list[list[str]] = []
    size = 0
    for piece in pieces:
        n = tokens(piece)
        if groups and size + n <= most:
            groups[-1].append(piece)
            size += n
        else:
            groups.append([piece])
            size = n
    return [" ".join(group) for group in groups]


def _by_words(text: str, most: int) -> list[str]:
    words: list[str] = []
    for word in text.split():
        while tokens(word) > most:
            half = len(word) // 2
            words.append(word[:half])
            word = word[half:]
        words.append(word)
    return _joined(words, most)


def packed(units: list[tuple[str, str]], target: int, most: int) -> list[list[tuple[str, str]]]:
    """(block id, text) in groups that close at ``target`` tokens and don't exceed ``most``."""
    groups: list[list[tuple[str, str]]] = []
    size = target
    for unit in units:
        n = tokens(unit[1])
        if size >= target or size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(unit)
        size += n
    return groups


def table_parts(text: str, caption: str, most: int) -> list[tuple[str, int | None, int | None, str | None]]:
    """(text, first row, last row, warning) of each part of a Markdown table; caption and header come with every part."""
    lines = [line for line in text.split("\n") if line.strip()]
    rule = next((i for i, line in enumerate(lines) if re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", line)), None)
    whole = "\n".join(filter(None, [caption, *lines]))
    if rule is None:
        if tokens(whole) <= most:
            return [(whole, None, None, "table_row_structure_unavailable")]
        return [(part, None, None, "table_row_structure_unavailable") for part in parts_of(whole, most)]
    core = "\n".join(filter(None, [caption, *lines[: rule + 1]]))
    rows = lines[rule + 1 :]
    if tokens(core) >= most:
        return [(part, None, None, "table_core_split") for part in parts_of(whole, most)]
    if not rows:
        return [(core, None, None, None)]
    done: list[tuple[str, int | None, int | None, str | None]] = []
    room, start = most - tokens(core), 0
    while start < len(rows):
        end, used = start, 0
        while end < len(rows) and used + tokens(rows[end]) <= room:
            used += tokens(rows[end])
            end += 1
        if end == start:
            done += [(f"{core}\n{part}", start + 1, start + 1, "split_oversized_table_row") for part in parts_of(rows[start], room)]
            end = start + 1
        else:
            done.append(("\n".join([core, *rows[start:end]]), start + 1, end, None))
        start = end
    return done


def paper_chunks(blocks: list[dict], title: str, authors: list[str], target: int, most: int) -> list[dict]:
    """The chunks of one paper's blocks, in order."""
    by_id = {b["block_id"]: b for b in blocks}
    drafts: list[dict] = []

    def add(kind: str, text: str, sources: list[str], at: int, part: int, count: int, context: list[str] = (), rows: tuple = (None, None), warning: str | None = None, path: list[str] | None = None) -> None:
        pages = [by_id[i]["page"] for i in sources if by_id[i]["page"] is not None]
        drafts.append(
            {
                "content_type": kind, "text": text, "source_block_ids": list(dict.fromkeys(sources)), "context_block_ids": list(dict.fromkeys(context)), "at": at,
                "part_index": part, "part_count": count, "section_path": path or list(by_id[sources[0]]["section_path"] or []), "page_start": min(pages, default=None),
                "page_end": max(pages, default=None), "row_start": rows[0], "row_end": rows[1], "warnings": [warning] if warning else [], "token_count": tokens(text),
            }
        )

    def in_section(block: dict, *names: str) -> bool:
        return any(str(s).strip().lower().startswith(names) for s in block["section_path"] or [])

    prose = [b for b in blocks if b["type"] in ("paragraph", "list_item") and (b["text"] or "").strip()]
    def is_abstract(block: dict) -> bool:
        return any(str(s).strip().lower() == "abstract" for s in block["section_path"] or [])

    abstract = [b for b in prose if is_abstract(b)]
    if abstract:  # title, authors and the word come with every part; the title's block is a source too
        head = "\n".join(filter(None, [title, ", ".join(authors), "Abstract"]))
        sources = [b for b in blocks if b["type"] == "title"] + abstract
        units = parts_of("\n\n".join(b["text"] for b in abstract), max(1, most - tokens(head)))
        for n, unit in enumerate(units, 1):
            text = f"{head}\n\n{unit}"
            over = "oversized_atomic_unit" if tokens(text) > most else None
            add("abstract", text, [b["block_id"] for b in sources], min(b["ord"] for b in sources), n, len(units), warning=over, path=["Abstract"])

    captions: dict[str, list[dict]] = {}
    for b in blocks:
        if b["type"] == "caption" and b["caption_of"]:
            captions.setdefault(b["caption_of"], []).append(b)
    special = {b["block_id"] for bs in captions.values() for b in bs}
    for b in blocks:
        caption = " ".join((c["text"] or "").strip() for c in captions.get(b["block_id"], []))
        own = [b["block_id"], *[c["block_id"] for c in captions.get(b["block_id"], [])]]
        near = [i for i in b["context_ids"] or [] if i in by_id]
        if b["type"] == "table" and (b["text"] or caption):
            found = table_parts(b["text"] or "", caption, most)
            for n, (text, first, last, warning) in enumerate(found, 1):
                add("table", text, own, b["ord"], n, len(found), rows=(first, last), warning=warning)
        elif b["type"] in ("figure", "formula"):
            core = caption if b["type"] == "figure" else (b["text"] or "").strip()
            if not core or (b["type"] == "formula" and not near):
                continue
            room = max(1, most - tokens(core))
            units = [(i, part) for i in near for part in parts_of(by_id[i]["text"] or "", room)]
            groups = packed(units, room, room) or [[]]
            for n, group in enumerate(groups, 1):
                add(b["type"], "\n\n".join([core, *[t for _, t in group]]), own, b["ord"], n, len(groups), context=[i for i, _ in group])

    run: list[dict] = []
    for b in [*blocks, None]:
        candidate = b is not None and b["type"] in ("paragraph", "list_item") and (b["text"] or "").strip() and b["block_id"] not in special and not is_abstract(b) and not in_section(b, "reference")
        if run and (not candidate or list(b["section_path"] or []) != list(run[0]["section_path"] or [])):
            groups = packed([(x["block_id"], part) for x in run for part in parts_of(x["text"], most)], target, most)
            for n, group in enumerate(groups, 1):
                add("paragraph", "\n\n".join(t for _, t in group), [i for i, _ in group], by_id[group[0][0]]["ord"], n, len(groups))
            run = []
        if candidate:
            run.append(b)
    drafts.sort(key=lambda d: (d["at"], ORDER[d["content_type"]], d["part_index"]))
    return drafts


#: What a chunk is made of besides its paper.
_FIELDS = ("ord", "block_id", "type", "text", "page", "section_path", "caption_of", "context_ids")


def structure_chunks(blocks: DataFrame, papers: DataFrame, target: int = 600, most: int = 900) -> DataFrame:
    """Chunks of the blocks of each paper.

    ``blocks`` has paper_id, block_id, ord, type, text, page, section_path, caption_of (the block that a caption is of)
    and context_ids (blocks that explain a figure or formula); ``papers`` has paper_id, filename, title and authors.
    Each paper is folded by itself, many in one batch of a Python worker. A chunk's id is paper:type:first block:part, with a suffix where it comes again;
    its retrieval text has the title, or the file name, and the section path before the text.
    """
    if not 0 < target <= most:
        raise ValueError("target must be positive and at most the limit")
    held = small_batches(blocks).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("b"))
    return _chunked(held.join(papers.select("paper_id", *_ABOUT), "paper_id", "left"), target, most)


_ABOUT = ("filename", "title", "authors")


def _chunked(held: DataFrame, target: int, most: int, bind: bool = False) -> DataFrame:
    """The chunks of ``held`` (paper_id, b, filename, title, authors), a row for each paper; with ``bind`` its blocks are those of ``_told``."""

    def fold(paper: str | None, rows: list[dict], filename: str | None, title: str | None, authors: list[str] | None) -> list[dict]:
        if bind:
            rows = [row | place for row, place in zip(rows, _places(paper, rows))]
        name = title or filename or ""
        used: dict[str, int] = {}
        out = []
        for n, d in enumerate(paper_chunks(rows, title or "", authors or [], target, most), 1):
            anchor = re.sub(r"[^A-Za-z0-9]+", "_", d["source_block_ids"][0]).strip("_").lower() or "block"
            base = f"{paper}:{d['content_type']}:{anchor}:part_{d['part_index']:04d}"
            used[base] = used.get(base, 0) + 1
            d["chunk_id"] = base if used[base] == 1 else f"{base}:duplicate_{used[base]:02d}"
            d["retrieval_text"] = "\n".join(filter(None, [name, " > ".join(d["section_path"]), d["text"]]))
            d["chunk_index"] = n
            out.append({field: d[field] for field in _CHUNK.names})
        return out

    @F.arrow_udf(f"array<struct<{CHUNK}>>")
    def chunks(*columns: pa.Array) -> pa.Array:
        return pa.array([fold(*(value.as_py() for value in row)) for row in zip(*columns)], pa.list_(_CHUNK))

    return held.select("paper_id", F.inline(chunks(F.col("paper_id").cast("string"), "b", *_ABOUT)))


def _told(blocks: DataFrame) -> Column:
    """A block of ``blocks`` (ord, block_id, type, text, page) with the numbers that its label or its formula has, as ``_places`` reads it."""
    kind = F.col("type")
    numbers = {
        "table_no": F.when(kind == "caption", structure.label_number(F.col("text"), "table")), "figure_no": F.when(kind.isin("caption", "figure"), structure.label_number(F.col("text"), "figure")),
        "formula_no": F.when(kind == "formula", evidence.formula_number(F.col("text"))),
    }
    return F.struct("ord", "block_id", "type", "text", "page", *(number.alias(name) for name, number in numbers.items()))


def _places(paper: str | None, blocks: list[dict]) -> list[dict]:
    """section_path, caption_of and context_ids of each of a paper's blocks, which are in order; blocks of no paper have sections only."""
    paths = [row["section_path"] for row in structure.stacked([b["text"] if b["type"] == "heading" else None for b in blocks])]
    owner, contexts = ({}, {}) if paper is None else _bound(blocks, paths)
    ids = {b["ord"]: b["block_id"] for b in blocks}
    return [
        {"section_path": path, "caption_of": ids.get(owner.get(b["ord"])), "context_ids": [ids[i] for i in sorted(contexts[b["ord"]])] if b["ord"] in contexts else None}
        for b, path in zip(blocks, paths)
    ]


def _bound(blocks: list[dict], paths: list[list[str]]) -> tuple[dict[int, int], dict[int, set[int]]]:
    """({caption: its table or figure}, {figure or formula: its contexts}) of one paper, by ord."""
    captions = {b["ord"]: b for b in blocks if b["type"] == "caption"}
    tables: dict[int | None, list[int]] = {}
    for b in blocks:
        if b["type"] == "table":
            tables.setdefault(b["page"], []).append(b["ord"])
    labelled = [b | {"number": b["figure_no"]} for b in blocks if b["type"] == "figure" or (b["type"] == "caption" and b["figure_no"])]
    owner = {c["caption_ord"]: c["figure_ord"] for c in structure.claimed(labelled)}
    number = {owner[at]: captions[at]["figure_no"] for at in sorted(owner, reverse=True)}  # of a figure: that of its first caption, else its own
    for at, caption in captions.items():
        if caption["table_no"] and caption["page"] is not None and caption["page"] in tables:
            owner[at] = min(tables[caption["page"]], key=lambda target: (abs(target - at), target))
    contexts: dict[int, set[int]] = {}
    for at, b in enumerate(blocks):
        if b["type"] == "figure" and (no := number.get(b["ord"], b["figure_no"])):
            found = evidence.mentions_near(blocks, paths, at, evidence.FIGURE_MENTION.format(no))
        elif b["type"] == "formula":
            found = evidence.explained_beside(blocks, paths, at)
            if b["formula_no"]:
                found += evidence.mentions_near(blocks, paths, at, evidence.FORMULA_MENTION.format(re.escape(b["formula_no"])))
        else:
            continue
        if found:
            contexts.setdefault(b["ord"], set()).update(found)
    return owner, contexts


def bound_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (paper_id, ord, block_id, type, text, page) with section_path, caption_of and context_ids, as ``structure_chunks`` reads them.

    A caption belongs to the nearest table of its page that it labels, or to the figure that it claims; of several only to the
    table. Contexts are the blocks that explain a figure by its number, or a formula, in their order. A paper's blocks are gathered
    in one shuffle and bound in one fold, so nothing is written down or joined.
    """

    @F.arrow_udf("array<struct<section_path:array<string>,caption_of:string,context_ids:array<string>>>")
    def places(paper: pa.Array, column: pa.Array) -> pa.Array:
        return pa.array([_places(*(value.as_py() for value in row)) for row in zip(paper, column)], pa.list_(_PLACE))

    held = small_batches(blocks).groupBy("paper_id").agg(F.sort_array(F.collect_list(_told(blocks))).alias("b"))
    placed = held.select("paper_id", "b", places(F.col("paper_id").cast("string"), "b").alias("p")).select("paper_id", F.inline(F.arrays_zip("b", "p")))
    return placed.select("paper_id", *(f"b.{name}" for name in _FIELDS[:5]), "p.*")


_PLACE = pa.struct([("section_path", pa.list_(pa.string())), ("caption_of", pa.string()), ("context_ids", pa.list_(pa.string()))])


def chunks_of_blocks(blocks: DataFrame, papers: DataFrame, target: int = 600, most: int = 900) -> DataFrame:
    """From stored blocks (as ``trees.tree_blocks`` or ``collections.paper_blocks`` have them) to chunks: bound, then cut.

    The same as ``structure_chunks`` of ``bound_blocks``, but a paper's blocks and what is known about it meet in one shuffle and go
    through one fold, so that section paths, which can be longer than the texts, are never moved or written down.
    """
    if not 0 < target <= most:
        raise ValueError("target must be positive and at most the limit")
    block, about = _told(blocks).alias("b"), F.when(F.col("paper_id").isNotNull(), F.struct(*_ABOUT)).alias("about")
    of_blocks = small_batches(blocks).select("paper_id", block)
    of_papers = papers.select(F.col("paper_id").cast(blocks.schema["paper_id"].dataType).alias("paper_id"), about)
    held = of_blocks.unionByName(of_papers, allowMissingColumns=True).groupBy("paper_id").agg(F.sort_array(F.collect_list("b")).alias("b"), F.collect_list("about").alias("about"))
    known = held.where(F.size("b") > 0).select("paper_id", "b", F.explode_outer("about").alias("about"))
    return _chunked(known.select("paper_id", "b", "about.*"), target, most, bind=True)


def chunk_stats(chunks: DataFrame, most: int = 900) -> DataFrame:
    """Count, mean and largest tokens of each type of chunk, and how many are over the limit."""
    return chunks.groupBy("content_type").agg(
        F.count("*").alias("chunks"), F.avg("token_count").alias("mean_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("token_count") > most).alias("oversized")
    )
