"""Conversation repair against plain restatements: every sequence of edits, and a table of the best by state."""

import random
from hashlib import md5, sha256
from zlib import crc32

import duckdb
import pytest

from proofline.llm import conversations, queries

SPACES = " \t\n\x0b\f\r"
INSERT = {"user": "u", "assistant": "a"}


def faults(rows):
    """blank, duplicate, truncated or None for each (role, text)."""
    seen, found = set(), []
    for role, text in rows:
        stripped = text.strip(SPACES)
        found.append("blank" if not stripped else "duplicate" if (role, text) in seen else None if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def plain_repair(rows):
    """(cost, audit, repaired rows) by a table over the whole prefix: for each end of it, the least cost and then audit."""
    now = {"": (0, "", [])}  # role initials of a valid beginning, shortened to what matters

    def after(shape, initial):
        if initial == "s":
            return "s" if shape == "" else None
        if initial == "u":
            return "u" if shape in ("", "s", "ua") else None
        return "ua" if initial == "a" and shape == "u" else None

    def least(table, shape, option):
        if shape is not None and (shape not in table or option[:2] < table[shape][:2]):
            table[shape] = option

    def inserted(table):
        for _ in range(4):
            for shape, (cost, audit, made) in list(table.items()):
                for role in INSERT:
                    least(table, after(shape, role[0]), (cost + 3, audit + "I", [*made, (role, "")]))
        return table

    for (role, text), fault in zip(rows, faults(rows)):
        late, new = 3 * (fault == "truncated"), {}
        for shape, (cost, audit, made) in inserted(now).items():
            least(new, shape, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            least(new, after(shape, role[:1]), (cost + late, audit + "K", [*made, (role, text)]))
            for other in INSERT:
                least(new, after(shape, other[0]), (cost + 3 + late, audit + "R", [*made, (other, text)]))
        now = new
    return min((v for k, v in inserted(now).items() if k in ("", "ua")), key=lambda v: v[:2])


def every_repair(rows, most):
    """The same by trying all edit sequences of at most ``most`` inserts."""
    import re

    found, told = [], faults(rows)

    def go(i, left, cost, audit, made):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            found.append((cost, audit, made))
        if left:
            for role in INSERT:
                go(i, left - 1, cost + 3, audit + "I", [*made, (role, "")])
        if i < len(rows):
            (role, text), late = rows[i], 3 * (told[i] == "truncated")
            go(i + 1, left, cost + 4, audit + "D", made)
            if told[i] in ("blank", "duplicate"):
                return
            go(i + 1, left, cost + late, audit + "K", [*made, (role, text)])
            for other in INSERT:
                go(i + 1, left, cost + 3 + late, audit + "R", [*made, (other, text)])

    go(0, most, 0, "", [])
    return min(found, key=lambda v: v[:2])


def plain_audit(rows):
    """The row of the query for the damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2].encode()).digest()))
    turns, said = [t for t, _, _ in rows if t is not None], [r[1:] for r in rows]
    told, initials = faults(said), [r[:1] for _, r, _ in rows]
    cost, audit, made = plain_repair(said)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(told.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    )


def damaged(conv, turn, role, text):
    shown = lambda v: " " if v is None else str(v)
    fault, role, text = crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
    if fault == 0:
        return []
    if fault == 1:
        text = ""
    if fault == 2:
        text = text.translate({ord(c): None for c in ".!?"})
    return [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def plain_query(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).extend(damaged(*row))
    return sorted(((conv, *plain_audit(said)) for conv, said in found.items()), key=repr)


def by_hand(rows):
    """Slice and unroll without Spark, in slices of two records."""
    cut = [conversations.Slice(0, 0, None)]
    for (role, text), fault in zip(rows, faults(rows)):
        if cut[-1].records == 2:
            cut.append(conversations.Slice(0, len(cut), None))
        cut[-1].add(1, role, text.encode(), 1, fault not in ("blank", "duplicate"), fault == "blank", fault == "truncated")
    ends = [conversations.END]
    for one in reversed(cut):
        assert conversations.before(one.matrix(), ends[0]) == one.ahead(ends[0])[0]
        ends.insert(0, one.ahead(ends[0])[0])
    state, audit, made = 0, "", []
    for one, end in zip(cut, ends[1:]):
        part, rows_, state = one.unroll(state, one.ahead(end), one is cut[-1])
        audit, made = audit + part, made + [(r["role"], (r["digest"] or b"").decode()) for r in rows_]
    return ends[0][0], audit, made


def chances(seed, n, most):
    chance = random.Random(seed)
    for _ in range(n):
        roles = chance.choices(["system", "user", "assistant", "tool", ""], [2, 5, 5, 1, 1], k=chance.randint(0, most))
        yield [(r, chance.choice(["One.", "Two", f"{chance.random()}.", f"{chance.random()}", " ", ""])) for r in roles]


def test_edits_are_the_cheapest_and_least():
    for rows in chances(1, 60, 3):
        assert every_repair(rows, 4)[:2] == plain_repair(rows)[:2]
    for rows in chances(2, 3000, 14):
        if rows:
            cost, audit, made = plain_repair(rows)
            assert by_hand(rows) == (cost, audit, made), rows


def test_long_runs_go_by_powers():
    one = conversations.Slice(0, 0, None)
    symbol = conversations.SYMBOLS["u", 0]
    one.run(symbol, 1_000_003)
    slow = conversations.END
    for _ in range(50):
        slow = conversations.before(conversations.power(symbol, 0), slow)
    short = conversations.Slice(0, 0, None)
    short.run(symbol, 20)
    short.run(symbol, 30)
    assert short.lengths == [50] and short.ahead(conversations.END)[0] == slow == conversations.before(short.matrix(), conversations.END)
    assert one.ahead(conversations.END)[0] == conversations.before(one.matrix(), conversations.END)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, an empty and a long text, many conversations and a long one."""
    chance = random.Random(4)
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (None, 1, "user", "Any?"), (None, None, "assistant", "Yes!"), (None, 1, None, None), (None, None, None, None)]
    rows += [(2, None, "user", "x. " * 50_000), (2, None, "assistant", ""), (2, 3, "", "No role."), (3, 5, "user", " "), (4, 0, "assistant", "é?")]
    for conv in range(10, 60):
        for turn in range(chance.randint(1, 9)):
            rows.append((conv, chance.choice([turn, turn, turn, None, 3]), chance.choice(["system", "user", "assistant", "tool"]), chance.choice(["A.", "B", f"{turn}?", " \n"])))
    for turn in range(900):
        rows.append((77, turn - turn % 2 * (turn % 5 == 0), ("user", "assistant")[turn % 2] if turn % 11 else "user", chance.choice(["A.", "B", f"{turn}?", f"{turn}", ""])))
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, digest string"), rows


@pytest.mark.parametrize("slice_records", [7, conversations.SLICE])
def test_repair_equals_a_plain_one(odd, slice_records):
    docs, rows = odd
    found = conversations.repair_damaged(docs, slice_records)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_query(rows)
    assert conversations.repair_damaged(docs.limit(0)).count() == 0


def test_equal_rows_are_counted_before_they_move(spark):
    """A message that a conversation repeats very often is one record, and one row of the repaired conversation."""
    said = spark.range(5000).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "'Again.' AS text")
    assert conversations.records(conversations.messages(said, "conv_id", "turn", "role", "text")).count() == 2
    audits, rows = conversations.repair(said)
    one = audits.first()
    assert (one["duplicate"], one["illegal"], one["cost"], one["audit"]) == (4999, 4999, 4999 * 4 + 3, "K" + "D" * 4999 + "I")
    assert [(r["role"], r["text"]) for r in rows.orderBy("place").collect()] == [("user", "Again."), ("assistant", "")]


def test_sql_equals_a_plain_one(odd, sf_dir):
    """The SQL of the query, on the given table and on odd rows, but for the long conversation, over which it would recurse."""
    rows = [r for r in odd[1] if r[0] != 77]
    duck = duckdb.connect()
    duck.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(duck.sql(queries.ORACLES["op12_conversation_repair"]).fetchall(), key=repr) == plain_query(rows)


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, sf_dir).collect()), key=repr) == plain_query(rows)
