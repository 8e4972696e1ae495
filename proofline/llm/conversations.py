"""Conversation structure repair: the cheapest edits that make roles alternate, by run-length dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm import manifest
from proofline.llm.common import bounded_batches, cut

#: Costs of the edits. An undeleted row that is truncated costs TRUNCATED besides.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Records of one slice of a conversation: what a task holds at once.
SLICE = 1 << 16

SPACES = " \t\n\x0b\f\r"
#: A conversation so far: nothing, a system row, one that awaits the assistant, one that may end.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after the row that may be written (inserted or given a new role) in each state, and that row's role.
WRITTEN = (ASKED, ASKED, ANSWERED, ASKED)
ROLES = ("user", "user", "assistant", "user")
#: By a role's initial: the states in which such a row may stay as it is, and the state after it.
KEPT = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}, "": {}}
#: Symbols of rows: one for all that must go, and one for each initial, whole and truncated.
GONE = 0
SYMBOLS = {(initial, short): 1 + 2 * i + short for i, initial in enumerate(KEPT) for short in (0, 1)}
NEVER = float("inf")

Vector = tuple[float, ...]
Matrix = tuple[Vector, ...]


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product: costs of the one and then the other."""
    return tuple(tuple(min(row[k] + right[k][j] for k in range(4)) for j in range(4)) for row in left)


def before(matrix: Matrix, vector: Vector) -> Vector:
    """Costs to the end from before ``matrix``, if ``vector`` has those from after it."""
    return tuple(min(cost + to_go for cost, to_go in zip(row, vector)) for row in matrix)


def _inserts() -> Matrix:
    found = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        at, cost = state, 0
        while cost < found[state][at]:
            found[state][at] = cost
            at, cost = WRITTEN[at], cost + INSERT
    return tuple(map(tuple, found))


INSERTS = _inserts()
#: Costs to the end after the last row.
END: Vector = before(INSERTS, tuple(0 if state in (START, ANSWERED) else NEVER for state in range(4)))


@cache
def choices(symbol: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row as (initial, cost, next state), by their initials."""
    if symbol == GONE:
        return tuple((("D", DELETE, state),) for state in range(4))
    initial, short = next(k for k, v in SYMBOLS.items() if v == symbol)
    found = []
    for state in range(4):
        kept = [("K", TRUNCATED * short, KEPT[initial][state])] if state in KEPT[initial] else []
        found.append((("D", DELETE, state), *kept, ("R", REROLE + TRUNCATED * short, WRITTEN[state])))
    return tuple(found)


@cache
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2 ** k rows of ``symbol``, inserts before each row included."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    step = [[NEVER] * 4 for _ in range(4)]
    for state, edits in enumerate(choices(symbol)):
        for _, cost, after in edits:
            step[state][after] = min(step[state][after], cost)
    return times(INSERTS, tuple(map(tuple, step)))


def powers_of(symbol: int, n: int) -> Iterator[Matrix]:
    """The cached powers whose product is the transition of a run of ``n``."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            yield power(symbol, k)


@dataclass
class Slice:
    """Neighbouring records of a conversation: runs of equal symbols, and the rows that may stay."""

    part: int
    nth: int
    conv: object
    symbols: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    rows: list[tuple[int | None, str, bytes]] = field(default_factory=list)
    records: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None
    last_initial: str | None = None

    def run(self, symbol: int, n: int) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += n
        elif n:
            self.symbols.append(symbol)
            self.lengths.append(n)

    def add(self, turn: int | None, role: str, digest: bytes, n: int, first: bool, blank: bool, short: bool) -> None:
        """``n`` equal rows, of which the first is the conversation's first with its role and text if ``first``."""
        self.records += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last_initial = initial
        if blank:
            self.blank += n
            self.run(GONE, n)
            return
        if first:
            self.truncated += short
            self.run(SYMBOLS[initial if initial in KEPT else "", int(short)], 1)
            self.rows.append((turn, role, digest))
        self.duplicate += n - first
        self.run(GONE, n - first)

    def matrix(self) -> Matrix:
        found: Matrix | None = None
        for symbol, n in zip(self.symbols, self.lengths):
            for step in powers_of(symbol, n):
                found = step if found is None else times(found, step)
        return found

    def ahead(self, end: Vector) -> list[Vector]:
        """Costs to the conversation's end before each run, and after the last."""
        found = [end]
        for symbol, n in zip(reversed(self.symbols), reversed(self.lengths)):
            for step in powers_of(symbol, n):  # powers of one matrix commute
                end = before(step, end)
            found.append(end)
        return found[::-1]

    def unroll(self, state: int, ends: list[Vector], last: bool) -> tuple[str, list[dict], int]:
        """The audit, the rows that remain and the state after them; of equally cheap edits the least initials.

        In each state an initial leads to one next state, so the least audit is found from the front: the first
        edit, by its initial, after which the cheapest end can still be reached.
        """
        audit, made, rows = [], [], iter(self.rows)

        def insert() -> int:
            audit.append("I")
            made.append({"role": ROLES[state], "was": None, "turn": None, "digest": None})
            return WRITTEN[state]

        for symbol, n, end in zip(self.symbols, self.lengths, ends[1:]):
            if symbol == GONE:  # what must go goes before anything is inserted: D is the least initial
                audit.append("D" * n)
                continue
            within = [end]
            for _ in range(n):
                within.append(before(power(symbol, 0), within[-1]))
            for now, after in zip(within[:0:-1], within[-2::-1]):
                turn, role, digest = next(rows)
                while True:
                    fitting = {e: s for e, cost, s in choices(symbol)[state] if cost + after[s] == now[state]}
                    if "D" in fitting or INSERT + now[WRITTEN[state]] != now[state]:
                        break
                    state = insert()
                edit = min(fitting)
                audit.append(edit)
                if edit != "D":
                    made.append({"role": role if edit == "K" else ROLES[state], "was": role, "turn": turn, "digest": digest})
                state = fitting[edit]
        while last and state not in (START, ANSWERED):
            state = insert()
        return "".join(audit), made, state


def slices(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[Slice]:
    """The slices of one sorted partition of ``records``."""
    now, nth, first = None, 0, False
    for batch in batches:
        for part, conv, turn, role, digest, n, blank, short in zip(*(batch.column(name).to_pylist() for name in _RECORD)):
            if n == 0:  # says that the next record is a first one
                first = True
                continue
            if now is None or conv != now.conv or now.records >= most:
                if now is not None:
                    yield now
                    nth += 1
                now = Slice(part, nth, conv)
            now.add(turn, role, digest, n, first, blank, short)
            first = False
    if now is not None:
        yield now


_RECORD = ("part", "conv", "turn", "role", "digest", "n", "blank", "short")
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")


def messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, digest, blank and short (truncated) of each row; null roles and texts are one space."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    return (
        rows.select(
            F.col(conv).alias("conv"), F.col(turn).alias("turn"),
            *[F.coalesce(F.col(was).cast("string"), F.lit(" ")).alias(name) for was, name in ((role, "role"), (text, "text"))],
        )
        .withColumn("trimmed", trimmed)
        .select(
            "conv", "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
            (F.col("trimmed") == "").alias("blank"), (~F.substring("trimmed", -1, 1).isin(".", "!", "?")).alias("short"),
        )
    )


def records(said: DataFrame) -> DataFrame:
    """part, conv, turn, role, digest, n, blank and short: one record for equal rows, in ranges of the order.

    A record with n = 0 goes before the one that is its conversation's first with this role and text. Texts stay where they
    are; ranges are of (conv, turn, role, digest), so a conversation with most of the rows is spread over many, and rows that
    are equal in all are counted before they move.
    """
    same = ["conv", "turn", "role", "digest"]
    counted = cut(said.groupBy(*same, "blank", "short").agg(F.count("*").alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns come first
    firsts = (
        counted.where("not blank").groupBy("conv", "role", "digest").agg(F.min(place).alias("at"))
        .select("conv", F.col("at.turn").alias("turn"), "role", "digest", F.lit(False).alias("blank"), F.lit(False).alias("short"), F.lit(0).cast("long").alias("n"))
    )
    ranged = counted.unionByName(firsts).repartitionByRange(*same).withColumn("part", F.spark_partition_id().cast("long"))
    return cut(ranged.sortWithinPartitions(*same, "n").select(*_RECORD))


def _crossing(sorted_records: DataFrame, most: int) -> dict[tuple[int, int], tuple[int, Vector, bool]]:
    """For each slice of the conversations that have several: state before it, costs to the end after it, and if it is the last.

    Only the first and the last conversation of a partition, and those longer than a slice, can have several, so what reaches the
    driver is two rows for each partition and one for each ``most`` records, of 16 numbers.
    """
    kind = sorted_records.schema["conv"].dataType.simpleString()

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[Slice]) -> pa.RecordBatch:
            table = [{"part": s.part, "nth": s.nth, "conv": s.conv, "matrix": [float(x) for row in s.matrix() for x in row]} for s in found]
            return pa.RecordBatch.from_pylist(table, pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("conv", type_of[0]), ("matrix", pa.list_(pa.float64()))]))

        type_of: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                type_of[:] = [batch.schema.field("conv").type]
                yield batch

        held: list[Slice] = []
        leading = True
        for now in slices(typed(), most):
            if held and held[-1].conv != now.conv:
                if leading or len(held) > 1:
                    yield rows(held)
                leading, held = False, []
            held.append(now)
        if held:
            yield rows(held)

    by_conv: dict[object, list] = {}
    for row in sorted_records.mapInArrow(matrices, f"part long, nth long, conv {kind}, matrix array<double>").orderBy("part", "nth").collect():
        by_conv.setdefault(row["conv"], []).append(row)
    several = [found for found in by_conv.values() if len(found) > 1]
    ends: dict[tuple[int, int], Vector] = {}
    for found in several:
        end = END
        for row in reversed(found):
            ends[row["part"], row["nth"]] = end
            end = before([row["matrix"][i : i + 4] for i in range(0, 16, 4)], end)
    if not ends:
        return {}
    sent = sorted_records.sparkSession.sparkContext.broadcast(ends)

    def outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in slices(batches, most):
            end = sent.value.get((now.part, now.nth))
            if end is not None:
                ahead = now.ahead(end)
                yield pa.RecordBatch.from_pylist([{"part": now.part, "nth": now.nth, "after": [now.unroll(state, ahead, False)[2] for state in range(4)]}])

    after = {(r["part"], r["nth"]): r["after"] for r in sorted_records.mapInArrow(outcomes, "part long, nth long, after array<long>").collect()}
    plan = {}
    for found in several:
        state = START
        for row in found:
            key = row["part"], row["nth"]
            plan[key] = state, ends[key], row is found[-1]
            state = after[key][state]
    return plan


def repaired_slices(sorted_records: DataFrame, most: int = SLICE) -> DataFrame:
    """One row for each slice of a conversation: its counts, cost, audit, and the rows that remain."""
    sent = sorted_records.sparkSession.sparkContext.broadcast(_crossing(sorted_records, most))
    kind = sorted_records.schema["conv"].dataType.simpleString()
    made = pa.list_(pa.struct([("role", pa.string()), ("was", pa.string()), ("turn", pa.int64()), ("digest", pa.binary())]))
    types = {"first_initial": pa.string(), "last_initial": pa.string()}

    def mended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: list[pa.Schema] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [(name, types.get(name, pa.int64())) for name in _COUNTS]
                schema[:] = [pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("conv", batch.schema.field("conv").type), *counts, ("cost", pa.int64()), ("audit", pa.string()), ("rows", made)])]
                yield batch

        held, size = [], 0
        for now in slices(typed(), most):
            state, end, last = sent.value.get((now.part, now.nth), (START, END, True))
            ahead = now.ahead(end)
            audit, rows, after = now.unroll(state, ahead, last)
            cost = int(ahead[0][state] - (0 if last else end[after]))
            held.append({"part": now.part, "nth": now.nth, "conv": now.conv, **{n: getattr(now, n) for n in _COUNTS}, "cost": cost, "audit": audit, "rows": rows})
            size += len(audit) + 20
            if size > 20_000:
                yield pa.RecordBatch.from_pylist(held, schema[0])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema[0])

    counts = ", ".join(f"{name} {'string' if name in types else 'long'}" for name in _COUNTS)
    out = f"part long, nth long, conv {kind}, {counts}, cost long, audit string, rows array<struct<role:string,was:string,turn:long,digest:binary>>"
    return cut(sorted_records.mapInArrow(mended, out))


def summaries(mended: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation from its slices."""
    slice_ = F.struct("part", "nth", *_COUNTS, "cost", "audit")
    found = mended.groupBy("conv").agg(F.array_sort(F.collect_list(slice_)).alias("s"))
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))).alias("a"), F.slice("s", F.lit(2), F.size("s")).alias("b"))
    zero = F.lit(0).cast("long")

    def total(name: str) -> Column:
        return F.aggregate("s", zero, lambda sum_, one: sum_ + one[name])

    def seams(holds) -> Column:
        return F.size(F.filter(F.col("pairs"), lambda p: holds(p["a"], p["b"]))).cast("long")

    broken = seams(lambda a, b: ~F.concat(a["last_initial"], b["first_initial"]).isin("su", "ua", "au"))
    same_turn = seams(lambda a, b: F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)))
    lowest, highest = F.array_min(F.transform("s", lambda one: one["first_turn"])), F.array_max(F.transform("s", lambda one: one["last_turn"]))
    return found.withColumn("pairs", pairs).select(
        "conv",
        F.coalesce(highest - lowest + 1 - (total("turns") - same_turn), zero).alias("gaps"),
        *[total(name).alias(name) for name in ("blank", "duplicate", "truncated")],
        (total("illegal") + broken).alias("illegal"),
        total("cost").alias("cost"),
        F.array_join(F.transform("s", lambda one: one["audit"]), "").alias("audit"),
    )


def _message_key() -> Column:
    return F.md5(F.concat(*map(manifest.field, (F.col("conv"), F.col("turn"), F.col("was"))), F.hex("digest")).cast("binary"))


def repaired_rows(mended: DataFrame, said: DataFrame) -> DataFrame:
    """conv, part, nth, place, role and text of all rows that remain or are inserted, in that order.

    The texts of the rows that remain are fetched by a digest of the message; equal rows meet before they move.
    """
    rows = mended.select("conv", "part", "nth", F.posexplode("rows").alias("place", "row")).select("conv", "part", "nth", "place", "row.*")
    texts = said.where("not blank").withColumnRenamed("role", "was").select(_message_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    kept = rows.where("digest is not null").withColumn("key", _message_key()).drop("was", "turn", "digest").join(texts, "key")
    columns = ["conv", "part", "nth", "place", "role", "text"]
    return kept.select(*columns).union(rows.where("digest is null").withColumn("text", F.lit("")).select(*columns))


def digests(rows: DataFrame) -> DataFrame:
    """conv and repaired_sha256 over the rows of ``repaired_rows``: ``role:text``, joined by line feeds.

    A digest of a whole conversation is a chain, so one task feeds a conversation's rows to it, in order and a batch at a
    time; it holds no more of a long conversation than of any other.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain, done, type_ = None, None, [], None

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, pa.schema([("conv", type_), ("repaired_sha256", pa.string())]))

        for batch in batches:
            type_ = batch.schema.field("conv").type
            for now, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv", "role", "text"))):
                if chain is None or now != conv:
                    if chain is not None:
                        done.append({"conv": conv, "repaired_sha256": chain.hexdigest()})
                    conv, chain = now, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield flushed()
                done = []
        if chain is not None:
            done.append({"conv": conv, "repaired_sha256": chain.hexdigest()})
            yield flushed()

    ordered = bounded_batches(rows).repartition("conv").sortWithinPartitions("conv", "part", "nth", "place").select("conv", "role", "text")
    return ordered.mapInArrow(chained, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_records: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Two tables: the audit of each conversation of ``rows``, and the rows of the repaired conversations.

    Roles of a repaired conversation begin with one system row or none, and then user and assistant take turns, the assistant
    last; or nothing is left. Rows are blank (no character but ASCII white space), else duplicate (role and text were there
    before), else truncated (the last other character is none of .!?); blank and duplicate ones are deleted. Rows may be kept,
    deleted, given the role user or assistant, and empty rows of these roles inserted; the cheapest edits are taken, and of those
    the ones whose initials D, I, K, R read least. Of a role only its initial counts.

    Null turns come first; rows that share a turn go by role and the md5 of their text. Null roles and texts are one space, so
    such texts are blank. A null conversation is one. Turns are whole numbers. Other columns are left out; an empty table gives
    no rows. Order, faults and edits are found on digests, in slices of at most ``slice_records`` records, so a conversation with most of the
    rows is spread; equal consecutive symbols are one run, which is passed by cached powers of its min-plus matrix, and slices
    are joined by their matrices. Texts of rows that remain move twice.
    """
    said = messages(rows, conv, turn, role, text)
    mended = repaired_slices(records(said), slice_records)
    return summaries(mended).withColumnRenamed("conv", conv), repaired_rows(mended, said)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``conversations`` after the faults that crc32 of ``conv_id:turn`` calls for."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    name, fault = F.concat(conv, F.lit(":"), turn), F.col("fault")
    return (
        rows.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("fault"))
        .where("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(role).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def repair_damaged(rows: DataFrame, slice_records: int = SLICE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of ``rows``.

    They are damaged by ``damage`` and repaired by ``repair``. One that has lost all its rows has zeros, an empty audit and the
    digest of the empty string.
    """
    audits, mended = repair(damage(rows), slice_records=slice_records)
    every = rows.select("conv_id").distinct()
    hashes = digests(mended).withColumnRenamed("conv", "conv_id")
    both = audits.unionByName(hashes, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")])
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _steps_sql() -> str:
    """(symbol, state, cost, piece, after): up to three inserts and then the edit of a row, from each state."""
    rows = []
    for symbol in (GONE, *SYMBOLS.values()):
        for start in range(4):
            state = start
            for inserts in range(4):
                rows += [f"({symbol}, {start}, {INSERT * inserts + cost}, '{'I' * inserts + edit}', {after})" for edit, cost, after in choices(symbol)[state]]
                state = WRITTEN[state]
    return ", ".join(rows)


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(name)), lambda i: ascii(substr(name, i + 1, 1))::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

#: DuckDB SQL for ``repair_damaged`` over conversations: the same edits by a table that grows row by row.
ORACLE = f"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (SELECT *, {_CRC} % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), md5(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS mark FROM d),
t AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS told FROM o),
y AS (SELECT *, left(role, 1) AS initial, CASE WHEN told IN ('blank', 'duplicate') THEN {GONE}
  ELSE 1 + 2 * CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CAST(told = 'truncated' AS INT) END AS symbol FROM t),
steps(symbol, state, cost, piece, after) AS (VALUES {_steps_sql()}),
r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM y
  UNION ALL
  SELECT r.conv_id, y.i, s.after, min({{'cost': r.best.cost + s.cost, 'audit': r.best.audit || s.piece}})
  FROM r JOIN y ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = r.i + 1 JOIN steps s ON s.symbol = y.symbol AND s.state = r.state
  GROUP BY r.conv_id, y.i, s.after),
n AS (SELECT conv_id, max(i) AS i, greatest(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0), 0) AS gaps,
  count(*) FILTER (told = 'blank') AS blank, count(*) FILTER (told = 'duplicate') AS duplicate, count(*) FILTER (told = 'truncated') AS truncated FROM y GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM y) GROUP BY conv_id),
e AS (SELECT r.conv_id, min({{'cost': r.best.cost + {INSERT} * z.tail, 'audit': r.best.audit || repeat('I', z.tail)}}) AS best
  FROM r JOIN n ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.i JOIN (VALUES ({START}, 0), ({SYSTEM}, 2), ({ASKED}, 1), ({ANSWERED}, 0)) z(state, tail) ON z.state = r.state
  GROUP BY r.conv_id),
a AS (SELECT conv_id, p, substr(audit, p, 1) AS edit FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS p FROM e)),
b AS (SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER w AS i, sum(CAST(edit <> 'D' AS INT)) OVER w AS place FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
c AS (SELECT b.*, y.role, y.text, max(CASE WHEN place = 1 AND edit = 'K' AND y.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY b.conv_id) AS systems
  FROM b JOIN y ON b.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = greatest(b.i, 1) WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS hash FROM c GROUP BY conv_id)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id
  LEFT JOIN e ON v.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN h ON v.conv_id IS NOT DISTINCT FROM h.conv_id
"""
