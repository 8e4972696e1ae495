"""The split of ``records.split_records`` as a fold over one table, many tables of a batch at once.

The same rules as there, on plain lists: what is null or not a number is unknown, and no test holds of it. Words are cut into
lines for all tables of a batch in numpy; a table is folded by itself only if a row of it may be in doubt.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf, isnan, nan

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from proofline.functions.shared import small_batches
from proofline.operators import records as rules

_WORD = r"[^\W\d_]+(?<!_)"
_NUMBER = r"[+-]?\d+(?:[.,]\d+)?"
_NUMBER_UNIT = re.compile(rf"{_NUMBER}(?:[ \t\n\x0b\f\r]*({_WORD}(?:/{_WORD})?|%))?[\n\r\x85  ]?\Z")
_PREFIX_NUMBER = re.compile(rf"({_WORD}(?:[ -]+{_WORD}){{0,2}})[ \t\n\x0b\f\r]+{_NUMBER}(?:[ \t\n\x0b\f\r]|[\x85  ]?\Z)")
_SPACES = re.compile("[ \t\n\x0b\f\r]+")
_HYPHENS = ("-", "­", "‐")
#: The columns that ``split_tables`` can give, with their types.
COLUMNS = {
    "source_id": None, "row": "int", "col": "int", "row_span": "int", "col_span": "int", "header": "boolean", "bbox": "array<double>", "record": "int", "operation": "string", "ocr_ids": "array<long>", "text": "string",
}


@lru_cache(200_000)
def typed_start(text: str) -> str | None:
    """As ``records.typed_start``."""
    t = _SPACES.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip(" ")
    if not 1 <= len(t) <= 100:
        return None
    if named := _PREFIX_NUMBER.match(t):
        return f"prefix_number:{named[1]}"
    known = _NUMBER_UNIT.match(t)
    return f"number_unit:{known[1] or ''}" if known else None


def _least(a: float, b: float) -> float:
    """The smaller of two numbers; the other one where one is unknown."""
    return b if a != a or b < a else a


class _Lines:
    """The lines of all cells of a batch: of each (table, cell) where its words and lines begin and end, and the values of each line."""

    def __init__(self, table: np.ndarray, cell: list, ocr_id: pa.Array, text: pa.Array, box: np.ndarray):
        names: dict = {}
        code = np.array([names.setdefault(c, len(names)) for c in cell], dtype=np.int64)
        key, middle = table * len(names) + code, (box[:, 1] + box[:, 3]) / 2
        ids = ocr_id.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, np.where(np.isnan(middle), -np.inf, middle), key))  # unknown places come first
        key, y, box = key[order], middle[order], box[order]
        self.ocr_id = ids[order].tolist() if not ocr_id.null_count else ocr_id.take(pa.array(order)).to_pylist()
        self.text = pc.fill_null(text, "").to_numpy(zero_copy_only=False)[order].tolist()
        high = box[:, 3] - box[:, 1]
        begins = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(key))
        of = np.cumsum(begins) - 1
        ranked = high if len(high) and high.min() == high.max() else high[np.lexsort((high, of))]  # unknown heights go last
        height = (ranked[starts + (ends - starts - 1) // 2] + ranked[starts + (ends - starts) // 2]) / 2 if len(starts) else np.zeros(0)
        apart = np.ones(len(key), bool)
        if len(key):
            apart[1:] = begins[1:] | (np.abs(y[1:] - y[:-1]) > height[of[1:]] * rules.MERGE_HEIGHT)
            for s in np.flatnonzero(~np.logical_and.reduceat(apart, starts)).tolist():  # with words that may share a line
                low, limit = int(starts[s]), float(height[s]) * rules.MERGE_HEIGHT
                at = y[low : ends[s]].tolist()
                first = 0
                for i in range(1, len(at)):
                    apart[low + i] = abs(at[i] - (at[first + (i - first - 1) // 2] + at[first + (i - first) // 2]) / 2) > limit
                    if apart[low + i]:
                        first = i
        lines = np.flatnonzero(apart)
        n = np.append(lines[1:], len(key)) - lines
        half, self.high = (box[:, 3] - box[:, 1]) * 0.2, high.tolist()
        if len(lines):
            self.y = ((y[lines + (n - 1) // 2] + y[lines + n // 2]) / 2).tolist()
            self.core_top, self.core_bottom = np.fmin.reduceat(y - half, lines).tolist(), np.fmax.reduceat(y + half, lines).tolist()
        self.left, self.said, self.ids = box[lines, 0].tolist(), [self.text[i] for i in lines.tolist()], [[self.ocr_id[i]] for i in lines.tolist()]
        for i in np.flatnonzero(n > 1).tolist():
            low = int(lines[i])
            across = sorted(range(low, low + int(n[i])), key=lambda j: (-inf if isnan(box[j, 0]) else box[j, 0], self.ocr_id[j], self.text[j]))
            self.left[i], self.said[i], self.ids[i] = float(box[across[0], 0]), " ".join(self.text[j] for j in across), [self.ocr_id[j] for j in across]
        self.height, self.typed = height[of[lines]].tolist(), list(map(typed_start, self.said))
        first = np.searchsorted(lines, starts)
        self.names, self.keys = names, key[starts]
        self.places = np.stack([starts, ends, first, np.append(first[1:], len(lines))], axis=1) if len(starts) else np.zeros((1, 4), dtype=np.int64)

    def of(self, table: np.ndarray, cell: list) -> np.ndarray:
        """Where the words and lines of each cell begin and end; zeros for a cell without words."""
        code = np.array([self.names.get(c, -1) for c in cell], dtype=np.int64)
        key = table * len(self.names) + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.places) - 1)
        found = (code >= 0) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)
        return self.places[at] * found[:, None]


def _beside(m: _Lines, a: tuple, b: tuple) -> bool:
    """Whether enough lines of ``a`` find a free line of ``b``: each takes the nearest one, if it is level with it."""
    free, found = m.y[b[2] : b[3]], 0
    limit = _least(m.height[a[2]], m.height[b[2]]) * rules.ALIGN_HEIGHT  # lines of a cell have one height
    if any(y != y for y in free):  # an unknown place counts as nearest and is level with nothing
        return False
    for y in m.y[a[2] : a[3]]:
        near, best = -1, inf
        for j, other in enumerate(free):
            d = abs(y - other)
            if d < best:
                near, best = j, d
        if best <= limit and near >= 0:
            del free[near]
            found += 1
            if found >= rules.LEAST_LINES:
                return True
    return False


def _doubtful(m: _Lines, cells: list[tuple], places: list[tuple], several: list[bool]) -> list[int]:
    """The rows with two cells side by side."""
    by_row: dict[int, list[int]] = {}
    for n, cell in enumerate(cells):
        if several[n] and cell[1] is not None:
            by_row.setdefault(cell[1], []).append(n)
    return [row for row, held in by_row.items() if len(held) > 1 and _in_doubt(m, cells, places, held)]


def _in_doubt(m: _Lines, cells: list[tuple], places: list[tuple], held: list[int]) -> bool:
    known = sorted((cells[n][0], n) for n in held if cells[n][0] is not None and cells[n][2] is not None)
    for k, (cell, a) in enumerate(known):
        for other, b in known[k + 1 :]:
            if cell != other and cells[a][2] != cells[b][2] and _beside(m, places[a], places[b]):
                return True
    return False


def _spanned(row: int, span: int) -> range:
    return range(row, row + span) if span >= 1 else range(row, row + span - 2, -1)


def _row_split(m: _Lines, cells: list[tuple], places: list[tuple], row: int, n_cols: int | None) -> tuple | None:
    """(records, boundaries, {cell_id: parts}) of a row in doubt, or None if it may not be split."""
    here = [cell for cell in cells if (cell[1] == row if cell[3] == 1 else cell[1] is not None and cell[3] is not None and row in _spanned(cell[1], cell[3]))]
    known = lambda values: [v for v in values if v is not None and v == v]
    tops, bottoms = known(cell[6][1] for cell in here), known(cell[6][3] for cell in here)
    own = [(cell[0], places[n]) for n, cell in enumerate(cells) if cell[1] == row]
    odd = any((cell[3] is not None and cell[3] != 1) or (cell[4] is not None and cell[4] != 1) or cell[5] for cell in here)
    if row == 0 or odd or (n_cols is not None and (len(here) != n_cols or n_cols < rules.LEAST_COLUMNS)) or max(p[1] - p[0] for _, p in own) > rules.MOST_WORDS:
        return None
    if (tops and max(tops) - min(tops) > 1e-6) or (bottoms and max(bottoms) - min(bottoms) > 1e-6):
        return None
    top, bottom = max(tops, default=nan), min(bottoms, default=nan)
    heights = sorted((h for _, p in own for h in m.high[p[0] : p[1]]), key=lambda h: (h != h, h))
    scale = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
    lines: dict = {}
    for cell, p in own:
        lines.setdefault(cell, []).extend(range(p[2], p[3]))
    typed, found = m.typed, []
    for anchor, a in lines.items():
        label = typed[a[0]] if rules.LEAST_LINES <= len(a) <= rules.MOST_RECORDS else None
        if label is not None and label.startswith("number_unit:") and all(typed[i] == label for i in a):
            if right := _by_anchor(m, lines, anchor, a, top, bottom, scale):
                found.append((anchor, *right))
    if not found or len(found) > 1 and len({tuple(sorted((cell, record, i) for cell, of in placed.items() for i, record, _ in of)) for _, _, placed in found}) > 1:
        return None
    anchor, cuts, placed = min(found, key=lambda x: x[0])
    return len(lines[anchor]), [top, *cuts, bottom], {cell: _parts(m, of) for cell, of in placed.items()}


def _by_anchor(m: _Lines, lines: dict, anchor, a: list[int], top: float, bottom: float, scale: float) -> tuple | None:
    """(cuts, {cell_id: (line, record, starts) of its lines}) of a row by the lines ``a`` of one anchor, or None if these are not right."""
    count, support, placed = len(a), 0, {}
    at, typed = [m.y[j] for j in a], m.typed
    lows, highs = [inf] * count, [-inf] * count
    for cell, own in lines.items():
        if len(own) < count or any(i > j for i, j in zip(own, own[1:])):
            return None
        reach = _least(m.height[own[0]], m.height[a[0]]) * rules.ALIGN_HEIGHT  # lines of a cell have one height
        of, starts, kinds, k = [], [None] * count, set(), 0
        for i in own:  # from the top, as the anchor's lines, so what is above one line is above the next
            y = m.y[i]
            while k < count and y - at[k] > reach:
                k += 1
            if k < count and y - at[k] >= -reach:
                if starts[k] is not None or k + 1 < count and y - at[k + 1] >= -reach:
                    return None  # two starts in a record, or level with two
                starts[k] = i
                kinds.add(typed[i])
                of.append((i, k, True))
                record = k
            elif not k:
                return None
            else:
                record = k - 1
                of.append((i, record, False))
            if m.core_top[i] < lows[record]:
                lows[record] = m.core_top[i]
            if m.core_bottom[i] > highs[record]:
                highs[record] = m.core_bottom[i]
        if None in starts:
            return None
        if len(own) > count:
            before = list(starts)  # of each record, its start and then the line that went on last
            for i, record, begins in of:
                if begins:
                    continue
                if typed[i] is not None or record + 1 < count and m.y[i] >= at[record + 1] - reach:
                    return None
                if m.left[i] - m.left[starts[record]] < m.height[i] * rules.INDENT_HEIGHT and not m.said[before[record]].rstrip(" ").endswith(_HYPHENS):
                    return None
                before[record] = i
        support += len(kinds) == 1 and None not in kinds and cell != anchor
        placed[cell] = of
    if support < rules.LEAST_SUPPORT:
        return None
    cuts, gap = [], scale * rules.CORE_GAP
    for record, (low, high) in enumerate(zip(lows, highs)):
        low, high = nan if low == inf else low, nan if high == -inf else high
        if low < top or high > bottom or record and low - end < gap:
            return None
        if record:
            cuts.append((end + low) / 2)
        end = high
    return cuts, placed


def _parts(m: _Lines, of: list[tuple[int, int, bool]]) -> list[tuple[int, list[int], str]]:
    """(record, ocr_ids, text) of a cell's lines, in order of the records' starts."""
    held = {record: (m.ids[i], m.said[i]) for i, record, begins in of if begins}
    for i, record, begins in of:
        if not begins:
            ids, said = held[record]
            held[record] = ids + m.ids[i], f"{said} {m.said[i]}"
    return [(record, ids, said) for record, (ids, said) in held.items()]


def _plan(m: _Lines, cells: list[tuple], places: list[tuple], several: list[bool]) -> dict:
    """{row: its split} of a table, empty unless all its rows in doubt may be split."""
    doubtful = _doubtful(m, cells, places, several)
    if not doubtful or len(doubtful) > rules.MOST_ROWS:
        return {}
    n_rows, n_cols = (max((c[i] + c[i + 2] for c in cells if c[i] is not None and c[i + 2] is not None), default=None) for i in (1, 2))
    plan = {row: _row_split(m, cells, places, row, n_cols) for row in sorted(doubtful)}
    if None in plan.values() or n_rows is None or n_cols is None or (n_rows + sum(split[0] - 1 for split in plan.values())) * n_cols > rules.MOST_CELLS:
        return {}
    return plan


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_primitive(column.type) or pa.types.is_boolean(column.type) else column.to_numpy().tolist()


def _boxes(column: pa.Array) -> np.ndarray:
    n = pc.list_value_length(column)
    if not column.null_count and (not len(n) or pc.min_max(n).as_py() == {"min": 4, "max": 4}):
        return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 4)
    boxes = [[nan if v is None else v for v in [*(box or []), None, None, None, None][:4]] for box in column.to_pylist()]
    return np.array(boxes, dtype=np.float64).reshape(-1, 4)


def _items(column: pa.ListArray, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """The table of each item of ``column`` that isn't null, and its fields."""
    items = column.flatten()
    of = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    if items.null_count:
        kept = items.is_valid()
        items, of = items.filter(kept), of[kept.to_numpy(zero_copy_only=False)]
    return of, [pc.struct_field(items, name) for name in names]


def _folded(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The cells of the tables of a batch: those that stay, then those of tables that are split."""
    of_cell, (cell_id, row, col, row_span, col_span, header, bbox) = _items(batch.column("cells"), "cell_id", "row", "col", "row_span", "col_span", "header", "bbox")
    of_word, (own, ocr_id, text, place) = _items(batch.column("words"), "cell_id", "ocr_id", "text", "bbox")
    n_words = np.bincount(of_word, minlength=batch.num_rows).tolist()
    held = own.is_valid().to_numpy(zero_copy_only=False)  # a word of no cell counts and is nowhere
    if not held.all():
        own, ocr_id, text, place, of_word = own.drop_null(), ocr_id.filter(own.is_valid()), text.filter(own.is_valid()), place.filter(own.is_valid()), of_word[held]
    m = _Lines(of_word, _values(own), ocr_id, text, _boxes(place))
    boxes = _boxes(bbox)
    boxes, names = _boxes(bbox), _values(cell_id)
    at = m.of(of_cell, names)
    places = at.tolist()
    cells = list(zip(names, _values(row), _values(col), _values(row_span), _values(col_span), header.to_numpy(zero_copy_only=False).tolist(), boxes.tolist()))
    begin = np.searchsorted(of_cell, np.arange(batch.num_rows + 1)).tolist()
    numbers = lambda column: column.to_numpy(zero_copy_only=False)
    single = (numbers(row_span) == 1) & (numbers(col_span) == 1) & ~numbers(pc.fill_null(header, False))
    high = np.array([*m.height, nan])[np.minimum(at[:, 2], len(m.height))]
    several = single & (at[:, 3] - at[:, 2] >= rules.LEAST_LINES) & (boxes[:, 3] - boxes[:, 1] >= high * rules.LEAST_CELL_LINES)
    plans, known = {}, batch.column("table_id").is_valid().to_numpy(zero_copy_only=False)
    for t in np.flatnonzero(np.bincount(of_cell[several], minlength=batch.num_rows) > 1).tolist():
        first, last = begin[t], begin[t + 1]
        if n_words[t] <= rules.MOST_TABLE_WORDS and last - first <= rules.MOST_CELLS and known[t]:
            if plan := _plan(m, cells[first:last], places[first:last], several[first:last].tolist()):
                plans[t] = plan
    kinds = {"source_id": cell_id, "col": col, "row_span": row_span, "col_span": col_span, "header": header, "row": row, "bbox": bbox}

    def cells_out(of, made: dict) -> pa.RecordBatch:
        """The cells ``of`` with what was ``made`` anew of them."""
        of = pa.array(of, pa.int64())
        table = pa.array(of_cell).take(of)
        columns = [pa.array(made[f.name], f.type) if f.name in made else (kinds[f.name].take(of) if f.name in kinds else batch.column(f.name).take(table)).cast(f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    split = np.zeros(batch.num_rows, dtype=bool)
    split[list(plans)] = True
    plain = np.flatnonzero(~split[of_cell])
    with_ids, with_box = bool({"ocr_ids", "record"} & set(schema.names)), "bbox" in schema.names
    whole = [_in_order(m, first, last) for first, last, _, _ in at[plain].tolist()]
    yield cells_out(plain, {"record": [None] * len(plain), "operation": ["unchanged"] * len(plain), "ocr_ids": [ids for ids, _ in whole], "text": [said for _, said in whole]})
    of, rows, box, records, operations, ids_, texts = [], [], [], [], [], [], []  # of each cell that comes out
    for t, plan in plans.items():
        for n in range(begin[t], begin[t + 1]):
            cell = cells[n]
            at = cell[1]
            offset = sum([n_records - 1 for r, (n_records, _, _) in plan.items() if r < at]) if at is not None else 0
            if at in plan:
                _, bounds, parts = plan[at]
                parts = parts[cell[0]]
                of += [n] * len(parts)
                at += offset
                rows += [at + record for record, _, _ in parts]
                texts += [said for _, _, said in parts]
                operations += ["split"] * len(parts)
                if with_ids:
                    records += [record for record, _, _ in parts]
                    ids_ += [ids for _, ids, _ in parts]
                if with_box:
                    box += [[None if v != v else v for v in (cell[6][0], bounds[record], cell[6][2], bounds[record + 1])] for record, _, _ in parts]
            else:
                ids, said = _in_order(m, *places[n][:2])
                of.append(n)
                rows.append(at + offset if offset else at)
                operations.append("moved" if offset > 0 else "unchanged")
                texts.append(said)
                if with_ids:
                    records.append(None)
                    ids_.append(ids)
                if with_box:
                    box.append(bbox[n].as_py())
    yield cells_out(of, {"row": rows, "bbox": box, "record": records, "operation": operations, "ocr_ids": ids_, "text": texts})


def _in_order(m: _Lines, first: int, last: int) -> tuple[list[int], str]:
    """The ids and the text of a cell's words, by id."""
    if last - first == 1:
        return m.ocr_id[first:last], m.text[first]
    words = sorted(zip(m.ocr_id[first:last], m.text[first:last]))
    return [i for i, _ in words], " ".join([x for _, x in words])


def split_tables(tables: DataFrame, *columns: str) -> DataFrame:
    """The cells of ``tables`` (table_id, cells, words: arrays of structs as ``records`` has them as rows), a row for each table, as
    ``records.split_records`` has them; of its columns those that are named, else all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = columns or tuple(COLUMNS)
    types = {"table_id": tables.schema["table_id"].dataType.simpleString(), "source_id": tables.schema["cells"].dataType.elementType["cell_id"].dataType.simpleString()}
    wanted = ", ".join(f"{name} {types.get(name) or COLUMNS[name]}" for name in ("table_id", *names))
    schema = to_arrow_schema(_parse_datatype_string(wanted))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the collector would look through all lists again and again
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from _folded(batch, schema)
        finally:
            if collects:
                gc.enable()

    return small_batches(tables).select("table_id", "cells", "words").mapInArrow(fold, wanted)
