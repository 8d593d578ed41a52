"""Conversation repair against a search over all edits, and rows that are odd."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from auditspark.llm import conversation_repair as repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, _fault int, cost string, place string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _order(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def _cheapest(rows, faults):
    """Least (cost, audit) over all edits by a search that extends whole sequences, with the repaired rows."""
    best, queue = {}, [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, roles, kept = heapq.heappop(queue)
        tail = roles[-1:] if roles else ""
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, kept
        if best.setdefault((i, tail), (cost, audit)) < (cost, audit):
            continue
        steps = []
        for r in ("user", "assistant"):
            steps.append((3, "I", i, r[0], ((r, ""),)))
        if i < len(rows):
            steps.append((4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                steps.append((more, "K", i + 1, rows[i][2][:1], ((rows[i][2], rows[i][3]),)))
                steps += [(3 + more, "R", i + 1, r[0], ((r, rows[i][3]),)) for r in ("user", "assistant")]
        for c, letter, j, role, row in steps:
            if letter != "D" and not re.fullmatch(r"s?(ua)*u?", roles + role) or letter != "D" and not role:
                continue
            heapq.heappush(queue, (cost + c, audit + letter, j, roles + role, kept + row))
    raise AssertionError


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in _damage(rows) if r[0] == conv), key=_order)
        seen, faults = set(), []
        for _, _, role, text in mine:
            visible = [c for c in text if BLANK.fullmatch(c)]
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, kept = _cheapest(mine, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def _audited(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = repair.audited(repair.damaged(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def test_cheapest_edits(spark):
    rnd, rows = random.Random(2), []
    texts = ["Yes.", "no", "Why?", " \t", "", "Stop! ", "a. b", "é…", "Ok.\n"]
    for conv in range(300):
        for turn in range(rnd.randint(1, 7)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "User"])
            rows.append((conv, turn * rnd.choice([1, 1, 3]), role, rnd.choice(texts)))
    assert _audited(spark, rows) == _expected(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (1, None, "user", "Hi."), (1, 4, "user", "Hi."), (2, 1, "", "x."),
            (2, 2, "user", None), (3, 9, "user", "long. " * 50_000), (3, 10, "assistant", "fine " * 50_000), (4, 0, "user", "A."), (4, 0, "user", "A."), (4, 0, "assistant", "A.")]
    rows += [(c, 0, "system", "Be kind.") for c in range(50, 120)]  # some lose all their rows
    got = _audited(spark, rows)
    assert got == _expected(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    assert _audited(spark, rows[:1])[None][1] == 0
    assert repair.audited(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("size", [7, 1000])
def test_a_long_conversation_streams_over_many_batches(spark, size):
    rnd = random.Random(size)
    rows = [(5, t, rnd.choice(["user", "assistant"]), f"{rnd.choice(['a', 'b'])}{rnd.randrange(1500)}{rnd.choice(['.', '.', ''])}") for t in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
        found = [r for r in repair.edits(repair.damaged(df)).collect() if r.edit]
        fixed = repair.repaired(repair.damaged(df)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(r.edit != "I" for r in found) == len(_damage(rows))
    assert GOOD.fullmatch("".join(r.role[0] for r in fixed)) and [r.place for r in found] == list(range(len(found)))
    faults = [(r.initial, {"blank": 1, "duplicate": 2, "truncated": 3}.get(r.fault, 0)) for r in found if r.edit != "I"]
    cost = list(repair.END)  # plain table of costs, state by state
    for initial, fault in reversed(faults):
        cost = repair.step(initial, fault, repair.with_inserts(cost))[0]
    assert sum(r.cost for r in found) == cost[0]
