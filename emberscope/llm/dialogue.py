"""Repair of the structure of conversations by weighted CYK interval parsing.

A good conversation is ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn, or nothing. Its grammar in
Chomsky normal form has a symbol for every pair of states (p, q), "what leads from p to q", the rules
(p, q) -> (p, r) (r, q), and each row's edits as terminals: keep it, give it another role, delete it. Inserted turns need no row; their
closure, the cheapest insertions from p to q, stands before and behind every terminal. A cell of the chart holds for
a span of rows and each symbol the least (cost, audit). Cells are combined bottom-up by span length: rows, pairs of rows,
four rows and so on. The symbols are closed under the rules, so a span's cell is the same wherever it is cut: one cut
for each span will do, and the work is in proportion to the rows.

The least audit of two parts is the parts' least audits: of equally dear edits of the same rows none is the beginning of
another, since the rest would be insertions, which cost.

Spark groups, orders and judges the turns and puts the repaired ones together; Python sees a character and a hash of each row.
A conversation is one row on the way, as its repair depends on all of it, so its text must stay below Spark's
2 GB for a value. Conversations of every length take the same way.

Null roles and texts are one space. Turns are ordered by number (nulls first), then role and text. Rows that repeat a role and text are duplicates, whatever
their number. A null conversation is one of its own. Roles count by their first character: other than s, u, a fits nowhere.
A gap beyond 64 bits is null. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship

#: State reached from a state (0: nothing yet, 1: system, 2: user, 3: assistant) by a role's initial.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
#: Rows whose cells are kept for the next conversation with the same ones.
SHORT = 4

Cell = dict[tuple[int, int], tuple[int, str]]


def _put(cell: Cell, symbol: tuple[int, int], cost: int, audit: str) -> None:
    have = cell.get(symbol)
    if have is None or (cost, audit) < have:
        cell[symbol] = (cost, audit)


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans, by the rules (p, q) -> (p, r) (r, q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            other = right.get((r, q))
            if other is not None:
                both, have = cost + other[0], out.get((p, q))
                if have is None or both < have[0] or (both == have[0] and audit + other[1] < have[1]):
                    out[p, q] = (both, audit + other[1])
    return out


def insertions() -> Cell:
    """The closure of insertions: the cheapest ones from each state to each."""
    one: Cell = {(p, p): (0, "") for p in STATES}
    for (p, initial), q in STEPS.items():
        if initial in ROLES:
            _put(one, (p, q), INSERT, "I")
    closure = one
    for _ in STATES:
        closure = combine(closure, one)
    return closure


_CLOSURE = insertions()


@lru_cache(maxsize=None)
def terminal(code: str) -> Cell:
    """The cell of one row. ``code``: x for one that must go, else the initial (? for others), a capital if the text is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if code != "x":
        more = TRUNCATED if code.isupper() or code == "!" else 0
        for (p, initial), q in STEPS.items():
            if initial == code.lower():
                _put(cell, (p, q), more, "K")
            if initial in ROLES:
                _put(cell, (p, q), REROLE + more, "R")
    return combine(combine(_CLOSURE, cell), _CLOSURE)


@lru_cache(maxsize=1 << 15)
def _short(codes: str) -> Cell:
    return chart([terminal(c) for c in codes])


def chart(cells: list[Cell]) -> Cell:
    """The cell of the whole span, bottom-up by span length."""
    while len(cells) > 1:
        cells = [combine(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows with these codes."""
    if not codes:
        return 0, ""
    whole = chart([_short(codes[i : i + SHORT]) for i in range(0, len(codes), SHORT)])
    return min(whole[0, q] for q in ENDS if (0, q) in whole)


def applied(initials: str, audit: str) -> list[tuple[int, str | None]]:
    """The turns after an audit: place of the row (-1: inserted) and its new role (None: its own)."""
    out: list[tuple[int, str | None]] = []
    state = place = 0
    for edit in audit:
        if edit == "D":
            place += 1
            continue
        initial = initials[place] if edit == "K" else ("a" if state == 2 else "u")
        out.append((-1 if edit == "I" else place, None if edit == "K" else ROLES[initial]))
        place += edit != "I"
        state = STEPS[state, initial]
    return out


_FOUND = pa.struct(
    [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string())])))]
)
_FOUND_DDL = "struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string, turns: array<struct<place: int, role: string>>>"


def judged(marks: list[dict]) -> dict:
    """What is found in one conversation; ``marks``: initial, fault (b, t or none) and hash of each row."""
    seen, codes = set(), []
    count = dict.fromkeys("bdt", 0)
    for mark in marks:
        fault, own = mark["fault"], mark["own"]
        if fault != "b" and own in seen:
            fault = "d"
        seen.add(own)
        if fault:
            count[fault] += 1
        initial = mark["initial"]
        codes.append("x" if fault in ("b", "d") else {"?": "!"}.get(initial, initial.upper()) if fault else initial)
    initials = "".join(m["initial"] for m in marks)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    cost, audit = parse("".join(codes))
    turns = [{"place": p, "role": r} for p, r in applied(initials, audit)]
    return {"blank": count["b"], "duplicate": count["d"], "truncated": count["t"], "illegal": illegal, "cost": cost, "audit": audit, "turns": turns}


def _mark(row: Column) -> Column:
    bare = F.rtrim(row["text"], F.lit(WHITE))
    initial = F.substring(row["role"], 1, 1)
    fault = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    own = F.unhex(F.md5(F.concat(F.length(row["role"]), F.lit(":"), row["role"], row["text"]).cast("binary")))
    return F.struct(F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), fault.alias("fault"), own.alias("own"))


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one row for each conversation.

    ``repaired`` holds the turns as structs of role and text. Rows for which ``present`` is not true are no part of their
    conversation, but keep it in the result.
    """
    ship(rows.sparkSession)

    @F.arrow_udf(_FOUND_DDL)
    def parsed(marks: pa.Array) -> pa.Array:
        return pa.array([judged(m) for m in marks.to_pylist()], _FOUND)

    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    own = row if present is None else F.when(present, row)
    each = rows.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(own)).alias("__rows"))
    each = each.withColumn("__found", parsed(F.transform("__rows", _mark)))
    turns = F.filter(F.col("__rows.turn"), lambda t: t.isNotNull())
    ends = [F.try_subtract(F.array_max(turns), F.array_min(turns)), F.lit(1) - F.size(F.array_distinct(turns))]
    gaps = F.when(F.size(turns) == 0, F.lit(0).cast("long")).otherwise(F.try_add(*ends))

    def put(turn_made: Column) -> Column:
        source = F.get(F.col("__rows"), turn_made["place"])
        return F.struct(F.coalesce(turn_made["role"], source["role"]).alias("role"), F.coalesce(source["text"], F.lit("")).alias("text"))

    found = [F.col(f"__found.{n}").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    return each.select(conversation, gaps.alias("gaps"), *found, F.transform(F.col("__found.turns"), put).alias("repaired"))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by crc32 of ``conv_id:turn`` modulo 20, and which of their rows are there.

    0: the row is gone; 1: its text is empty; 2: it has no ``.!?``; 3: it comes twice; 4: its role is user.
    """
    copy = free_name(rows, "__copy")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *keys).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    out = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array(F.lit(0))).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(copy),
    )
    return out, F.col(copy) > 0
