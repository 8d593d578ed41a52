"""Repair of the turn structure of conversations by secondary-sorted streaming.

A well-formed conversation gives the role initials (s?(ua)+)?: an optional system turn, then user and assistant in turn.
The cheapest edits are found by dynamic programming over the rows and the four states of that pattern. Rows are dealt by
conversation and sorted by turn from the last to the first; a pass over the Arrow batches carries the costs of what
is still to come and gives each row one byte, the best edit in each state (two bits each). Those backpointers travel with the
rows through Spark's local sort into ascending order, which spills them and the texts to disk as needed, so a
conversation of any length takes no more memory than a batch. A second pass over the batches follows the
backpointers from the first row on and gives the edits.

Costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an empty
user or assistant turn anywhere 3; a truncated row that stays costs 3 more. Of equally cheap edits the ASCII-least string of
their initials is taken. A row's first fault counts: blank (white space only), duplicate (role and text
seen earlier in the conversation), truncated (does not end in . ! or ?).

Defined cases: a null role or text is one space; rows without a conv_id are one conversation; rows are taken by turn, nulls
first, rows of one turn by role and text; a role without letters can't be kept; empty texts are blank; very long texts and
conversations stream; an empty table gives no rows; other columns are ignored.

A conversation is handled by one task, since its repaired text is hashed in order; tasks keep no rows of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.session import ship_package

#: ASCII white space, as trim() takes it.
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row; DROPPED marks the place of a row that is gone, so that its conversation is still known.
SOUND, BLANK, DUPLICATE, CUT, DROPPED = range(5)
FAULTS = ("", "blank", "duplicate", "truncated")
#: States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
NEXT = ("u", "u", "a", "u")  # the role that may be inserted or given
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = tuple(AFTER[s, NEXT[s]] for s in range(4))
ROLES = {"u": "user", "a": "assistant"}
#: Costs of ending in each state: a user turn lacks its answer, a system turn lacks both.
END = (0, 2 * INSERT, INSERT, 0)
LETTERS = "DIKR"  # ASCII order decides ties
FAR = 1 << 62


def with_inserts(cost: list[int]) -> list[int]:
    """Least costs when turns may be inserted first; two inserts reach any state that inserts can reach."""
    for _ in range(2):
        cost = [min(cost[s], INSERT + cost[GIVEN[s]]) for s in range(4)]
    return cost


def step(initial: str, fault: int, after: list[int]) -> tuple[list[int], int]:
    """Costs from a row on by state, given those after the row, and the best first edit by state in one byte."""
    more = TRUNCATED if fault == CUT else 0
    stays = fault in (SOUND, CUT)
    options = []
    for s in range(4):
        kept = AFTER.get((s, initial)) if stays else None
        options.append((DELETE + after[s], FAR, KEEP + more + after[kept] if kept is not None else FAR,
                        REROLE + more + after[GIVEN[s]] if stays else FAR))
    cost = with_inserts([min(o) for o in options])
    best = 0
    for s in range(4):
        found = (options[s][0], INSERT + cost[GIVEN[s]], options[s][2], options[s][3])
        best |= found.index(cost[s]) << 2 * s
    return cost, best


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations as given, damaged by the checksum of their place: 0 dropped, 1 emptied, 2 without sentence ends, 3 twice, 4 as user."""
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kind = F.col("_kind")
    placed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("_kind"))
    return placed.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and _fault; duplicates are told from a narrow count, as texts of a conversation that come twice are few."""
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    own = filled.withColumn("_said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))  # nulls come first
    again = own.where(~F.col("dropped")).groupBy("conv_id", "_said").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    again = again.where(F.col("_first") != F.col("_last")).select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_again"), "_first")
    joined = own.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_again")), "left")
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = (F.when(F.col("dropped"), DROPPED).when(end == "", BLANK).when(F.col("_first").isNotNull() & (F.col("_first") != at), DUPLICATE)
             .when(~end.isin(".", "!", "?"), CUT).otherwise(SOUND))
    return joined.select("conv_id", "turn", F.when(~F.col("dropped"), F.col("role")).alias("role"),
                         F.when(~F.col("dropped"), F.col("text")).alias("text"), fault.cast("int").alias("_fault"))


def _with_backpointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last to the first of each conversation, each with the best edits by state.

    Rows that say the same in one turn are neighbours here; all but the one that comes first then are duplicates. Which
    of two equal rows is the first doesn't matter, so the row above decides: a row is a duplicate if the next one equals it.
    """
    conv, cost, waiting, seen = object(), None, None, 0  # a row waits until the next one tells whether it is a repeat

    def close(row, repeat):
        nonlocal cost
        index, initial, fault = row
        fault = DUPLICATE if repeat and fault in (SOUND, CUT) else fault
        if fault == DROPPED:
            return index, fault, 0
        cost, best = step(initial, fault, cost)
        return index, fault, best

    held = None  # the batch of the waiting row, and what is known of its rows
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, turns, roles, texts, faults = (batch.column(i).to_pylist() for i in range(5))
        faults_out, bests, places = [0] * len(convs), [0] * len(convs), [0] * len(convs)
        for i, (c, t, r, x, f) in enumerate(zip(convs, turns, roles, texts, faults)):
            if waiting is not None:
                (last, where), into = waiting
                same = c == conv and f != DROPPED and where[1:] == (t, r, x)
                index, fault, best = close(last, same)
                into[0][index], into[1][index] = fault, best
            if c != conv:
                conv, cost, seen = c, with_inserts(list(END)), 0
            seen = places[i] = seen + 1
            waiting = (((i, (r or "")[:1], f), (f, t, r, x)), (faults_out, bests))
            if i == 0 and held is not None:
                yield _with(held)
                held = None
        held = (batch, faults_out, bests, places)
    if waiting is not None:
        (last, _), into = waiting
        index, fault, best = close(last, False)
        into[0][index], into[1][index] = fault, best
        yield _with(held)


def _with(held: tuple[pa.RecordBatch, list[int], list[int], list[int]]) -> pa.RecordBatch:
    batch, faults, bests, places = held
    new = [pa.array(faults, pa.int32()), pa.array(bests, pa.int32()), pa.array(places, pa.int64())]
    return pa.RecordBatch.from_arrays([*batch.columns[:4], *new], ["conv_id", "turn", "role", "text", "_fault", "_best", "_to_end"])


class _Edits:
    """Columns of edit rows that wait to be given out as a batch."""

    def __init__(self, kind: pa.DataType, turn: pa.DataType):
        self.types = {"conv_id": kind, "place": pa.int64(), "edit": pa.string(), "fault": pa.string(), "turn": turn, "initial": pa.string(),
                      "role": pa.string(), "text": pa.string(), "cost": pa.int32()}
        self.columns = {name: [] for name in self.types}
        self.size = 0

    def add(self, *values) -> None:
        for column, value in zip(self.columns.values(), values):
            column.append(value)
        self.size += len(values[7] or "") + 40

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, self.types[k]) for k, v in self.columns.items()], list(self.types))
        self.columns, self.size = {name: [] for name in self.types}, 0
        return made


#: Bytes of text in a batch that a pass gives out.
BATCH = 4 << 20


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the backpointers from the first row of each conversation on; turns that end it are inserted when the next one begins."""
    conv, state, place, out, began = None, 0, 0, None, False

    def inserted():
        nonlocal state, place
        role = ROLES[NEXT[state]]
        out.add(conv, place, "I", None, None, None, role, "", INSERT)
        state, place = GIVEN[state], place + 1

    def ended():
        while END[state]:
            inserted()

    for batch in batches:
        if out is None and batch.num_rows:
            out = _Edits(batch.schema.field(0).type, batch.schema.field(1).type)
        for c, turn, role, text, fault, best in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if not began or c != conv:
                if began:
                    ended()
                conv, state, place, began = c, 0, 0, True
            if fault == DROPPED:
                out.add(c, None, None, None, None, None, None, None, 0)
                continue
            letter = LETTERS[best >> 2 * state & 3]
            while letter == "I":
                inserted()
                letter = LETTERS[best >> 2 * state & 3]
            more = TRUNCATED if fault == CUT else 0
            if letter == "D":
                out.add(c, place, "D", FAULTS[fault] or None, turn, role[:1], None, None, DELETE)
            elif letter == "K":
                out.add(c, place, "K", FAULTS[fault] or None, turn, role[:1], role, text, KEEP + more)
                state = AFTER[state, role[:1]]
            else:
                out.add(c, place, "R", FAULTS[fault] or None, turn, role[:1], ROLES[NEXT[state]], text, REROLE + more)
                state = GIVEN[state]
            place += 1
            if out.size >= BATCH:
                yield out.batch()
    if began:
        ended()
        yield out.batch()


def edits(rows: DataFrame) -> DataFrame:
    """The edits of every conversation, in order within partitions that hold whole conversations.

    conv_id, place (of the edit, from 0), edit (D, I, K or R), fault, turn and initial (of the row; null if inserted), role
    and text (after the edit; null if deleted), cost. A conversation's dropped rows give rows of conv_id alone.
    """
    spark = rows.sparkSession
    ship_package(spark)
    told = with_faults(rows)
    kinds = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    four = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, _fault int"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last_first = [F.col(c).desc_nulls_last() for c in ("turn", "role", "text")]  # dropped rows have neither role nor text
    down = told.repartition(n, "conv_id").sortWithinPartitions("conv_id", *last_first).mapInArrow(_with_backpointers, four + ", _best int, _to_end long")
    up = down.sortWithinPartitions("conv_id", F.desc("_to_end"))  # no shuffle: the same partitions, sorted the other way
    return up.mapInArrow(_with_edits, f"conv_id {kinds['conv_id']}, place long, edit string, fault string, turn {kinds['turn']}, initial string, "
                                      "role string, text string, cost int")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0, gapless but for deleted rows), role and text of the repaired conversations."""
    return edits(rows).where(F.col("role").isNotNull()).select("conv_id", "place", "role", "text")


LEGAL = {"su", "ua", "au"}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, began, kind = None, False, None
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def fresh():
        return dict.fromkeys(names, 0) | {"first": None, "last": None, "distinct": 0, "initial": None, "audit": [], "hash": hashlib.sha256(), "lines": 0}

    def result(c, s):
        gaps = min(s["last"] - s["first"] + 1 - s["distinct"], (1 << 63) - 1) if s["distinct"] else 0
        return (c, gaps, *(s[k] for k in names[1:]), "".join(s["audit"]), s["hash"].hexdigest())

    def made(done):
        columns = list(zip(*done))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *names, "audit", "repaired_sha256"])

    s = fresh()
    for batch in batches:
        done, kind = [], batch.schema.field(0).type
        for c, place, edit, fault, turn, initial, role, text, cost in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if not began or c != conv:
                if began:
                    done.append(result(conv, s))
                conv, began, s = c, True, fresh()
            if edit is None:
                continue
            s["audit"].append(edit)
            s["cost"] += cost
            if fault:
                s[fault] += 1
            if edit != "I":
                if s["initial"] is not None and s["initial"] + initial not in LEGAL:
                    s["illegal"] += 1
                s["initial"] = initial
                if turn is not None and turn != s["last"]:
                    s["first"] = turn if s["first"] is None else s["first"]
                    s["last"], s["distinct"] = turn, s["distinct"] + 1
            if role is not None:
                s["hash"].update(f"{chr(10) * (s['lines'] > 0)}{role}:{text}".encode())
                s["lines"] += 1
        if done:
            yield made(done)
    if began:
        yield made([result(conv, s)])


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its turns, rows by fault, illegal neighbours, cost and initials of the edits, digest of the repaired text."""
    found = edits(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    return found.mapInArrow(_digests, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
