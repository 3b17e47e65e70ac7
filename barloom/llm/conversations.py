"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by Hirschberg's division.

A conversation is a walk through four states: nothing yet (0), after a system message (1), a user's (2), an assistant's
(3); it may end in 0 or 3. Each row is kept, given another role or deleted, with inserted messages before it. For half of
the rows a pass forward gives the least cost of coming to each state, for the other half a pass backward the least cost of
going on from it; where they meet, the state of least sum is on the best walk, and both halves are solved in the same way.
No pass holds more than four costs. Among equal costs the walk whose edits' initials are least in ASCII is wanted: the
pass forward also orders its four states by the initials that lead to them, which no later edit can turn around, since
each of them ends with a row's own edit.

Rows are dealt by ranges of their order, so a conversation of any length is cut into blocks. What a block can do is a table
of 4 x 4 costs and orders; the same division over these tables finds the states at the blocks' borders, and each block is
then solved on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

DELETE, INSERT, RENAME, SHORTEN = 4, 3, 3, 3
#: Costs of ending in each state, and the messages that are then added.
END, ADDED = (0, 6, 3, 0), (0, 2, 1, 0)
NEVER = 1 << 40
SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
#: Characters of role and text by which the rows of one turn are ordered; a digest orders the rest.
SHOWN = 64


def said_next(state: int) -> int:
    """The state after a user's or an assistant's message, whichever may come."""
    return 3 if state == 2 else 2


def _row_table(initial: str, cut: bool, must_go: bool) -> tuple[list[list[int]], list[list[int]], list[list[str]]]:
    """From each state to each other: the least cost of a row, the order of the edits among those from that state, the edits."""
    cost, edits = [[NEVER] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):
            found = [(state, DELETE, "D")]
            if not must_go:
                found.append((said_next(state), RENAME + SHORTEN * cut, "R"))
                kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)
                if kept is not None:
                    found.append((kept, SHORTEN * cut, "K"))
            for to, price, name in found:
                new = (price + INSERT * inserted, "I" * inserted + name)
                if new < (cost[start][to], edits[start][to]):
                    cost[start][to], edits[start][to] = new
            state = said_next(state)
    order = [[sorted(row).index(x) for x in row] for row in edits]
    return cost, order, edits


#: By kind of row: 0 must go, else 1 + 2 * (initial s, u, a, other) + whether it is cut short.
TABLES = [_row_table("", False, True)] + [_row_table(i, cut, False) for i in ("s", "u", "a", "") for cut in (False, True)]


def kind_of(role: str, cut: bool, must_go: bool) -> int:
    return 0 if must_go else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + cut


def onward(cost: list[int], order: list[int], table: tuple) -> tuple[list[int], list[int]]:
    """Least costs of the four states after one more row or block, and the order of the edits that lead there."""
    step, rank = table[0], table[1]
    best = [min((cost[p] + step[p][q], order[p], rank[p][q]) for p in range(4)) for q in range(4)]
    by_edits = sorted(b[1:] for b in best)
    return [min(b[0], NEVER) for b in best], [by_edits.index(b[1:]) for b in best]


def walk(tables: list, start: int, end: tuple[int, ...]) -> list[int]:
    """The state after each row or block on the best walk from start; end: the cost of ending in each state."""

    def solve(lo: int, hi: int, start: int, end: tuple[int, ...]) -> int:
        if hi - lo == 1:
            step, rank = tables[lo][0][start], tables[lo][1][start]
            states[lo] = min(range(4), key=lambda q: (step[q] + end[q], rank[q]))
            return states[lo]
        mid = (lo + hi) // 2
        cost, order = [0 if q == start else NEVER for q in range(4)], [0] * 4
        for i in range(lo, mid):
            cost, order = onward(cost, order, tables[i])
        rest = list(end)
        for i in range(hi - 1, mid - 1, -1):
            step = tables[i][0]
            rest = [min(step[p][q] + rest[q] for q in range(4)) for p in range(4)]
        meet = min(range(4), key=lambda q: (cost[q] + rest[q], order[q]))
        solve(lo, mid, start, tuple(0 if q == meet else NEVER for q in range(4)))
        return solve(mid, hi, meet, end)

    states = [0] * len(tables)
    if tables:
        solve(0, len(tables), start, end)
    return states


def block_table(kinds: bytes) -> tuple[list[list[int]], list[list[int]]]:
    """What a block of rows can do: least costs from each state to each other, and the order of the edits."""
    costs, orders = [], []
    for start in range(4):
        cost, order = [0 if q == start else NEVER for q in range(4)], [0] * 4
        for k in kinds:
            cost, order = onward(cost, order, TABLES[k])
        costs.append(cost)
        orders.append(order)
    return costs, orders


def edits_of(kinds: bytes, start: int = 0, end: tuple[int, ...] = END) -> tuple[list[str], int]:
    """For each row the initials of the edits before it and of its own; the state at the end."""
    states = walk([TABLES[k] for k in kinds], start, end)
    return [TABLES[k][2][p][q] for k, p, q in zip(kinds, [start, *states], states, strict=False)], states[-1] if states else start


@lru_cache(maxsize=100_000)
def _short_edits(kinds: bytes) -> tuple[list[str], int]:
    return edits_of(kinds)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a checksum of ``conv_id:turn``: rows dropped, emptied, robbed of
    their full stops, repeated or given to the user. Nulls are one space in what is hashed, in roles and in texts."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(fault == 4, "user").otherwise(as_text("role"))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    made = rows.where(fault != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("_copy"))
    return made.drop("_copy")


_EDITS = "conv_id long, place long, turn long, action string, fault string, before string, role string, text string"
_NAMES = [f.split()[0] for f in _EDITS.split(", ")]
_RAW = f"{_EDITS}, block int, digest string, blank boolean, cut boolean"


class _Rows:
    """Rows to hand on, as batches of a bounded number."""

    def __init__(self, names: list[str], types: list[pa.DataType], most: int = 2000):
        self.schema, self.most, self.rows = pa.schema(zip(names, types, strict=True)), most, []

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


_EDIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]


def _applied(conv, rows: list[tuple], faults: list[str | None], tails: list[str], state: int, last: bool) -> Iterator[tuple]:
    """Rows of ``_EDITS``. rows: (place, turn, role, text); state: before the first; last: whether the conversation ends here."""
    place = -1
    for (place, turn, role, text), fault, tail in zip(rows, faults, tails, strict=True):
        for i, edit in enumerate(tail):
            if edit == "I":
                state = said_next(state)
                yield conv, place - 3 + i, None, "I", None, None, "user" if state == 2 else "assistant", ""
            elif edit == "D":
                yield conv, place, turn, "D", fault, role, None, text
            elif edit == "R":
                state = said_next(state)
                yield conv, place, turn, "R", fault, role, "user" if state == 2 else "assistant", text
            else:
                state = {"s": 1, "u": 2}.get(role[:1], 3)
                yield conv, place, turn, "K", fault, role, role, text
    for i in range(ADDED[state] if last else 0):
        state = said_next(state)
        yield conv, place + 1 + i, None, "I", None, None, "user" if state == 2 else "assistant", ""


def _fault(blank: bool, repeated: bool, cut: bool) -> str | None:
    return "blank" if blank else "duplicate" if repeated else "truncated" if cut else None


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the conversations that lie within a task's range; rows of its first and last one, which may go on in
    other tasks, without an action."""
    block = TaskContext.get().partitionId()
    out = _Rows([*_NAMES, "block", "digest", "blank", "cut"], [*_EDIT_TYPES, pa.int32(), pa.string(), pa.bool_(), pa.bool_()])
    number, conv, first, held = 0, None, None, []

    def done() -> None:
        seen: set[str] = set()
        faults, kinds = [], bytearray()
        for _, _, role, _, digest, blank, cut in held:
            repeated = digest in seen
            seen.add(digest)
            faults.append(_fault(blank, repeated, cut))
            kinds.append(kind_of(role, cut, blank or repeated))
        tails, _ = _short_edits(bytes(kinds)) if len(kinds) <= 64 else edits_of(bytes(kinds))
        out.rows += [(*e, block, None, None, None) for e in _applied(conv, [h[:4] for h in held], faults, tails, 0, True)]

    raw = lambda h: (conv, h[0], h[1], None, None, None, *h[2:4], block, *h[4:])
    for b in batches:
        for own, turn, role, text, digest, blank, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if number and own != conv:
                if not first:
                    done()
                conv, first, held = own, False, []
            elif not number:
                conv, first = own, True
            # room for inserted rows before each row, and for two behind the last
            row = ((block << 40) + 8 * number + 4, turn, role, text, digest, blank, cut)
            number += 1
            if first:
                out.rows.append(raw(row))
            else:
                held.append(row)
            yield from out.full()
    out.rows += map(raw, held)
    yield from out.rest()


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """((conv_id, block), rows) of batches that are sorted by them."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block (conv_id, block, place, kind): what it can do."""
    out = _Rows(["conv_id", "block", "costs", "orders"], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())])
    for key, rows in _by_block(batches):
        costs, orders = block_table(bytes(r[3] for r in rows))
        out.rows.append((*key, sum(costs, []), sum(orders, [])))
        yield from out.full()
    yield from out.rest()


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before and after each block on its conversation's best walk, from all its blocks' tables in order."""
    out = _Rows(["conv_id", "block", "start", "end", "last"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()])
    square = lambda v: [v[i : i + 4] for i in (0, 4, 8, 12)]

    def done(rows: list[tuple]) -> None:
        states = walk([(square(r[2]), square(r[3])) for r in rows], 0, END)
        for i, (r, s, e) in enumerate(zip(rows, [0, *states], states, strict=False)):
            out.rows.append((r[0], r[1], s, e, i == len(rows) - 1))

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                done(held)
                held = []
                yield from out.full()
            held.append(row)
    if held:
        done(held)
    yield from out.rest()


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each block between the states at its borders, which its first row brings."""
    out = _Rows(_NAMES, _EDIT_TYPES)
    for (conv, _), rows in _by_block(batches):
        _, _, _, _, _, _, _, _, start, end, last = rows[0]
        kinds = bytes(r[6] for r in rows[1:])
        tails, _ = edits_of(kinds, start, tuple(0 if q == end else NEVER for q in range(4)))
        for e in _applied(conv, [(r[2], r[3], r[4], r[5]) for r in rows[1:]], [r[7] for r in rows[1:]], tails, start, last):
            out.rows.append(e)
            yield from out.full()
    yield from out.rest()


def repaired(rows: DataFrame) -> DataFrame:
    """The edits (conv_id, place, turn, action, fault, before, role, text) of all conversations; place orders them.

    action: K keeps a row, R gives it another role, D deletes it, I inserts an empty one (without turn, fault, before).
    fault: blank (white space at most), duplicate (role and text seen earlier in the conversation) or truncated (the last
    character other than white space is none of ``.!?``), the first that holds. before and role are the role before and
    after; a deleted row has no role. The repaired conversation is the rows other than D.

    Rows of a conversation are taken by turn, null turns first; of one turn by the first 64 characters of role and of
    text, then by a digest; rows that are equal in all are one after the other. A null role or text is one space. Rows
    without conv_id are a conversation. Only roles that begin with s, u or a can be kept. Other columns are left aside,
    whatever their names; an empty table gives no rows. Long texts and conversations are no special case: a task holds
    the rows of its range. Runs two checkpoints.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = own.select(
        "*",
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.substring("role", 1, SHOWN).alias("_role"),
        F.substring("text", 1, SHOWN).alias("_text"),
        F.monotonically_increasing_id().alias("_salt"),  # lets equal rows lie in several ranges
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_role", "_text", "digest", "_salt"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    first = checkpointed(dealt.select("conv_id", "turn", "role", "text", "digest", "blank", "cut").mapInArrow(_inner, _RAW))
    whole, open_ = first.where("action is not null").select(*_NAMES), first.where("action is null")

    # place is unique, so that neither this join nor the next ones have a hot key
    new = open_.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    known = open_.join(new, "place", "left")
    repeated = F.col("new").isNull()
    initial = F.left(F.col("role"), F.lit(1))
    by_initial = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    kind = F.when(F.col("blank") | repeated, 0).otherwise(1 + by_initial + F.col("cut").cast("int"))
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("cut"), "truncated")
    known = checkpointed(known.select("conv_id", "block", "place", "turn", "role", "text", kind.cast("int").alias("kind"), fault.alias("fault")))
    key = ["conv_id", "block"]
    tables = known.select(*key, "place", "kind").repartition(*key).sortWithinPartitions(*key, "place").mapInArrow(_tables, "conv_id long, block int, costs array<long>, orders array<long>")
    borders = tables.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(_borders, "conv_id long, block int, start int, end int, last boolean")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    control = borders.select(*key, F.lit(-1).cast("long").alias("place"), none("long", "turn"), none("string", "role"), none("string", "text"), none("int", "kind"), none("string", "fault"), "start", "end", "last")
    both = known.select("*", none("int", "start"), none("int", "end"), none("boolean", "last")).unionByName(control)
    return whole.unionByName(both.repartition(*key).sortWithinPartitions(*key, "place").mapInArrow(_outer, _EDITS))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its edits in order, which go through one at a time."""
    out = _Rows([f.split()[0] for f in _REPORT.split(", ")], [pa.int64()] * 7 + [pa.string()] * 2)
    conv, begun = None, False

    def fresh() -> None:
        nonlocal turns, low, high, faults, illegal, cost, audit, digest, empty, before
        turns, low, high, faults, illegal, cost, audit, digest, empty, before = 0, None, None, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256(), True, None

    turns = low = high = faults = illegal = cost = audit = digest = empty = before = None
    close = lambda: out.rows.append((conv, high - low + 1 - turns if turns else 0, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()))
    for b in batches:
        for own, turn, action, fault, was, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not begun or own != conv:
                if begun:
                    close()
                    yield from out.full()
                conv, begun = own, True
                fresh()
            audit.append(action)
            cost += {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}[action] + (SHORTEN if fault == "truncated" and action != "D" else 0)
            if action != "I":
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
                if fault:
                    faults[fault] += 1
                illegal += before is not None and (before, was[:1]) not in (("s", "u"), ("u", "a"), ("a", "u"))
                before = was[:1]
            if action != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
    if begun:
        close()
    yield from out.rest()


def reports(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: counts of faults, the edits' cost and initials, the repaired rows' digest.

    gaps: turns that are missing between the first and the last. illegal: neighbours, before the repair, whose initials are
    none of su, ua, au. A digest is made in one pass, so a conversation's edits go through one task, one after the other.
    """
    rows = edits.select("conv_id", "turn", "action", "fault", "before", "role", "text", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    found = rows.drop("place").mapInArrow(_reports, _REPORT)
    names = [f.split()[0] for f in _REPORT.split(", ")][1:]
    zero = [F.lit(0).cast("long").alias(n) for n in names[:6]] + [F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")]
    none = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(0).alias("_real"), *zero)
    both = none.unionByName(found.select("conv_id", F.lit(1).alias("_real"), *names))
    return both.groupBy("conv_id").agg(F.max(F.struct("_real", *names)).alias("r")).select("conv_id", *[F.col(f"r.{n}").alias(n) for n in names])


def query(conversations: DataFrame) -> DataFrame:
    return reports(conversations, repaired(damaged(conversations)))


def _oracle() -> str:
    """Four columns, one for each state, carried from row to row: the cost (9 digits) and the edits' initials, so that the
    least string is the cheapest and then the ASCII-least."""
    spaces = "chr(32) || " + " || ".join(f"chr({c})" for c in range(9, 14))
    crc = """xor(4294967295, list_reduce([4294967295] || [ord(x)::bigint for x in string_split(k, '')], lambda c, b:
      list_reduce([xor(c, b)] || range(8), lambda v, _: xor(v >> 1, (v & 1) * 3988292384))))"""
    after = {0: (0, 2, 3), 1: (1, 2, 3), 2: (2, 3, 2), 3: (3, 2, 3)}
    ways: dict[int, list[str]] = {q: ["'9'"] for q in range(4)}
    for p, states in after.items():
        for j, s in enumerate(states):
            said = 3 if s == 2 else 2
            way = lambda price, name: f"lpad((left(w.s{p}, 9)::bigint + {3 * j} + {price})::varchar, 9, '0') || substr(w.s{p}, 10) || '{'I' * j}{name}'"  # noqa: B023, E731
            ways[s].append(way("4", "D"))
            ways[said].append(f"case when not f.must then {way('3 + f.cut', 'R')} else '9' end")
            if s == 0:
                ways[1].append(f"case when not f.must and f.init = 's' then {way('f.cut', 'K')} else '9' end")
            ways[said].append(f"case when not f.must and f.init = '{'a' if said == 3 else 'u'}' then {way('f.cut', 'K')} else '9' end")
    steps = ", ".join(f"least({', '.join(ways[q])})" for q in range(4))
    return f"""with recursive raw as (
      select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations
    ), hashed as (select *, ({crc}) % 20 h from raw),
    made as (
      select conv_id, turn, case h when 4 then 'user' else r end r, case h when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x,
        unnest(case h when 3 then [0, 1] else [0] end) n from hashed where h <> 0
    ), f as (
      select *, b = '' or nth > 1 must, case when b <> '' and right(b, 1) not in ('.', '!', '?') then 3 else 0 end cut, left(r, 1) init from (
        select *, rtrim(x, {spaces}) b, row_number() over (partition by conv_id, r, x order by i) nth from (
          select *, row_number() over (partition by conv_id order by turn nulls first, left(r, 64), left(x, 64), sha256(length(r) || ':' || r || ':' || x)) i from made))
    ), w as (
      select conv_id, 0::bigint i, '000000000' s0, '900000000' s1, '900000000' s2, '900000000' s3 from (select distinct conv_id from conversations)
      union all
      select w.conv_id, w.i + 1, {steps} from w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
    ), best as (
      select conv_id, max(i) n, arg_max(least(s0, lpad((left(s1, 9)::bigint + 6)::varchar, 9, '0') || substr(s1, 10) || 'II',
        lpad((left(s2, 9)::bigint + 3)::varchar, 9, '0') || substr(s2, 10) || 'I', s3), i) s from w group by conv_id
    ), edit as (
      select conv_id, pos, e, count(*) filter (e <> 'I') over (partition by conv_id order by pos) i, count(*) filter (e <> 'D') over (partition by conv_id order by pos) m
      from (select conv_id, unnest(range(1, length(s) - 8)) pos, unnest(string_split(substr(s, 10), '')) e from best where length(s) > 9)
    ), told as (
      select edit.*, f.r, f.x, bool_or(edit.e = 'K' and f.init = 's') over (partition by edit.conv_id) led
      from edit left join f on f.conv_id is not distinct from edit.conv_id and f.i = edit.i and edit.e <> 'I'
    ), written as (
      select conv_id, sha256(string_agg(case when e = 'K' then r when (m - led::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(x, ''), chr(10) order by pos)) sha
      from told where e <> 'D' group by conv_id
    ), tally as (
      select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (b = '') blank, count(*) filter (b <> '' and nth > 1) dup,
        count(*) filter (b <> '' and nth = 1 and cut > 0) trunc, count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) illegal
      from (select *, lag(init) over (partition by conv_id order by i) || init pair from f) group by conv_id
    )
    select best.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint duplicate, coalesce(trunc, 0)::bigint truncated,
      coalesce(illegal, 0)::bigint illegal, left(s, 9)::bigint cost, substr(s, 10) audit, coalesce(sha, sha256('')) repaired_sha256
    from best left join tally on tally.conv_id is not distinct from best.conv_id left join written on written.conv_id is not distinct from best.conv_id"""


ORACLE = _oracle()
