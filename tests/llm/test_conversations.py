"""Conversation repair against all sequences of edits, plain Python and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from barloom.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")


def all_repairs(rows, must_go, cut):
    """(cost, audit, repaired) of every way with at most two inserted rows in a place, cheapest and ASCII-least first."""
    found = []
    gaps = [[""], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    gaps = [g if g != [""] else [] for g in gaps]
    for names in itertools.product("KRD", repeat=len(rows)):
        if any(m and n != "D" for m, n in zip(must_go, names, strict=True)):
            continue
        for roles in itertools.product(*[("user", "assistant") if n == "R" else (None,) for n in names]):
            for inserted in itertools.product(gaps, repeat=len(rows) + 1):
                cost, audit, out = 0, "", []
                for i in range(len(rows) + 1):
                    for x in inserted[i]:
                        cost, audit = cost + 3, audit + "I"
                        out.append(("user" if x == "u" else "assistant", ""))
                    if i < len(rows):
                        audit += names[i]
                        cost += {"K": 0, "R": 3, "D": 4}[names[i]] + 3 * (cut[i] and names[i] != "D")
                        if names[i] != "D":
                            out.append((roles[i] or rows[i][0], rows[i][1]))
                initials = "".join(r[:1] or "?" for r, _ in out)
                if SHAPE.fullmatch(initials):
                    found.append((cost, audit, out))
    return min(found)


def faults_of(rows):
    seen, faults = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    return faults


@pytest.mark.parametrize("seed", range(12))
def test_edits_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!", "d? "])) for _ in range(n)]
        faults = faults_of(rows)
        must_go, cut = [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults]
        kinds = bytes(cv.kind_of(r[0], c, m) for r, c, m in zip(rows, cut, must_go, strict=True))
        tails, state = cv.edits_of(kinds)
        cost, audit, out = all_repairs(rows, must_go, cut)
        assert "".join(tails) + "I" * cv.ADDED[state] == audit
        edits = list(cv._applied(1, [(8 * i, i, *r) for i, r in enumerate(rows)], faults, tails, 0, True))
        assert [(e[6], e[7]) for e in edits if e[3] != "D"] == out
        assert [e[1] for e in edits] == sorted({e[1] for e in edits})


def straight(kinds):
    """(cost, audit) by one pass that carries the edits themselves."""
    best = [(0, ""), *[(cv.NEVER, "")] * 3]
    for k in kinds:
        cost, _, edits = cv.TABLES[k]
        best = [min((best[p][0] + cost[p][q], best[p][1] + edits[p][q]) for p in range(4)) for q in range(4)]
    return min((c + cv.END[q], e + "I" * cv.ADDED[q]) for q, (c, e) in enumerate(best))


def test_division_equals_one_pass_and_blocks_equal_the_whole():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 50, 301):
        kinds = bytes(rng.choice([0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(n))
        tails, state = cv.edits_of(kinds)
        want = straight(kinds)
        assert "".join(tails) + "I" * cv.ADDED[state] == want[1]
        borders = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
        blocks = [kinds[a:b] for a, b in zip(borders, borders[1:], strict=False)]
        states = cv.walk([cv.block_table(b) for b in blocks], 0, cv.END)
        parts = [cv.edits_of(b, s, tuple(0 if q == e else cv.NEVER for q in range(4)))[0] for b, s, e in zip(blocks, [0, *states], states, strict=False)]
        assert "".join(t for p in parts for t in p) + "I" * cv.ADDED[states[-1]] == want[1]


def plain_report(conv, rows):
    """The query's row from rows (turn, role, text) as they are given."""
    made = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            made += [row] * (2 if h == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64].encode(), r[2][:64].encode(), digest(r)))
    faults = faults_of([r[1:] for r in made])
    kinds = bytes(cv.kind_of(r[1], f == "truncated", f in ("blank", "duplicate")) for r, f in zip(made, faults, strict=True))
    cost, audit = straight(kinds)
    out, i, state = [], 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        role = ("assistant" if state == 2 else "user") if e in "IR" else made[i][1]
        out.append(f"{role}:{'' if e == 'I' else made[i][2]}")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        i += e != "I"
    turns = {r[0] for r in made if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:], strict=False))
    n = lambda f: faults.count(f)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    text = lambda: rng.choice(["a.", "b", "", "  ", "c!\n", "d?", None, "e ", " . ", "long " * 30 + "x.", "long " * 30 + "y.", "x" * 20_000])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
    many = [(1, rng.choice([None, *range(-3, 200)]), role(), text()) for _ in range(900)] + [(1, 7, "user", "same.")] * 200
    return many + [(rng.choice([None, *range(2, 80)]), rng.choice([None, *range(9)]), role(), text()) for _ in range(500)] + [(500 + i, 0, "user", "hi.") for i in range(60)]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_reports_equal_plain_ones(spark, odd_rows, partitions):
    """With many partitions the one long conversation, a row of which is repeated 200 times, lies in many blocks."""
    extra = spark.createDataFrame([(*r, "x") for r in odd_rows], f"{ROWS}, action string").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in cv.query(extra).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by: dict = {}
    for conv, *row in odd_rows:
        by.setdefault(conv, []).append(tuple(row))
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=order) == sorted((plain_report(c, r) for c, r in by.items()), key=order)


def test_reports_equal_sql_on_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, ROWS)
    c = duckdb.connect()
    conversations = df.toArrow()  # noqa: F841
    c.register("conversations", conversations)
    plain = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    assert plain(cv.query(df).collect()) == plain(c.sql(cv.ORACLE).fetchall())


def test_edits_of_odd_tables(spark):
    assert cv.query(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(None, None, None, None), (None, None, None, None), (7, 3, "user", "Hi"), (7, 1, "assistant", "Yes.")]
    edits = cv.repaired(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "place").collect()
    assert [(e.action, e.fault, e.before, e.role, e.text) for e in edits if e.conv_id is None] == [("D", "blank", " ", None, " ")] * 2
    kinds = bytes([cv.kind_of("assistant", False, False), cv.kind_of("user", True, False)])
    assert "".join(e.action for e in edits if e.conv_id == 7) == straight(kinds)[1] == "IKD"
    assert [(e.turn, e.fault) for e in edits if e.conv_id == 7 and e.turn is not None] == [(1, None), (3, "truncated")]
