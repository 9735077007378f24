"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation is a lattice: a node for each number of rows read and each state of the role pattern `(s?(ua)+)?`
(nothing yet, after s, u or a), and an arc for each edit with its whole cost. Keep costs 0, Rerole to user or
assistant 1, Delete 2 (the only edit of a blank or repeated row), Insert of an empty user or assistant row 5; a
truncated row that is not deleted costs 5 more. Every node has a price, at most the cost of any arc out of it plus
the price behind it. From one origin after the other, last rows first, a path is extended along an arc that is
tight and contracted where there is none, its last node's price raised to the least that leaves it. A path that
meets a node of an earlier path is tight to the end, so the prices on it are the exact costs of what is left. The audit is
traced from the start over tight arcs, at each step the least letter that any of the nodes reached so far offers.

Faults, edits and digests are per conversation in the order of (turn, role, text), null turns first. Null role and
text are one space; rows with null conv_id are one conversation; rows that repeat turn, role and text are
duplicates but the first. A role counts by its first character. Extra columns are ignored. A conversation of any length streams through
its task: held at once are four prices and a letter for each of its rows, never their texts. An audit is one string and
a digest runs over the repaired rows in order, so both are made in one task by their definition.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored

#: States of the role pattern: nothing written, after a system, user or assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
FOLLOWS = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,)}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
RISE = 5
INSERT = 5
DELETE = 2
REROLE = 1


def arcs_of(code: str) -> list[list[tuple[int, str, int, int]]]:
    """For each state the arcs (cost, letter, rows read, state) at a row; `code`: x must go, else the role's initial (o: other), a capital for a truncated row."""
    out: list[list[tuple[int, str, int, int]]] = [[] for _ in range(4)]
    for role in "ua":
        for state in FOLLOWS[role]:
            out[state].append((INSERT, "I", 0, STATE_OF[role]))
    if not code:
        return out
    for state in range(4):
        out[state].append((DELETE, "D", 1, state))
    if code != "x":
        more, initial = RISE if code.isupper() else 0, code.lower()
        for state in FOLLOWS.get(initial, ()):
            out[state].append((more, "K", 1, STATE_OF[initial]))
        for role in "ua":
            for state in FOLLOWS[role]:
                out[state].append((more + REROLE, "R", 1, STATE_OF[role]))
    return out


#: Arcs by row code; the empty code is the place behind the last row.
ARCS = {code: arcs_of(code) for code in ("", "x", *"suaoSUAO")}


def converged_prices(codes: str) -> array:
    """Prices of all nodes (4 * rows read + state) after auctions from every origin."""
    n = len(codes)
    price, settled = array("q", bytes(32 * (n + 1))), bytearray(4 * (n + 1))
    for state in ENDS:
        settled[4 * n + state] = 1
    for origin in range(4 * n + 3, -1, -1):
        if origin & 3 == 3 and origin < 4 * n:
            # the least price of the next row is a start that no arc of this row undercuts: bids do not begin at zero
            price[origin - 3 : origin + 1] = array("q", [min(price[origin + 1 : origin + 5])] * 4)
        path = [origin]
        while not settled[path[-1]]:
            node = path[-1]
            row, state = node >> 2, node & 3
            least, to = None, 0
            for cost, _, read, state_after in ARCS[codes[row : row + 1]][state]:
                after = (row + read) * 4 + state_after
                value = cost + price[after]
                if least is None or value < least:
                    least, to = value, after
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            settled[node] = 1
    return price


def repair_plan(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of several the letters that come first in ASCII."""
    price, n = converged_prices(codes), len(codes)
    row, states, letters = 0, {NOTHING}, []
    while row < n or states.isdisjoint(ENDS):
        tight = [
            (letter, read, after) for state in states for cost, letter, read, after in ARCS[codes[row : row + 1]][state]
            if price[4 * row + state] == cost + price[4 * (row + read) + after]]
        letter, read, _ = min(tight)
        letters.append(letter)
        states = {after for x, _, after in tight if x == letter}
        row += read
    return price[NOTHING], "".join(letters)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` asks for; nulls become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    copies = F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def placed(turns: DataFrame) -> DataFrame:
    """Stored rows of `turns` (conv_id, turn, role, text) with `pos` (from 1), `fault`, `illegal` and `new_turn`.

    One shuffle by conv_id; the windows read a conversation in order and spill.
    """
    empty = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    pair = F.concat(F.lag(initial).over(by_pos), initial)
    rows = rows.withColumn("illegal", F.coalesce(F.when(F.col("pos") > 1, ~pair.isin("su", "ua", "au")), F.lit(False)))
    rows = rows.withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(by_pos)))
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", "blank").when(copy, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    return stored(rows.withColumn("fault", fault), "placed-turns")


def code_of(fault: Column, role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(letter)).otherwise(letter)


def repair_plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Stored (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of `placed` rows, and of the conversations of `ids` without rows."""
    known = rows.select("conv_id", "turn", "pos", "new_turn", "fault", "illegal", code_of(F.col("fault"), F.col("role")).alias("code"))
    if ids is not None:
        bare = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        known = known.unionByName(bare, allowMissingColumns=True)
    count = lambda condition: F.coalesce(F.count_if(condition), F.lit(0))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_if("new_turn"))
    talks = known.groupBy("conv_id").agg(
        # `least` passes over nulls, so the case without any turn comes first
        F.when(F.max("turn").isNull(), 0).otherwise(F.least(gaps, wide(F.lit((1 << 63) - 1)))).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "code")))), lambda x: x["code"]), "").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repair_plan(c.as_py()) for c in batch.column("codes")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=[*batch.schema.names[:-1], "cost", "audit"])

    return stored(talks.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "repair-plans")


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: `place` from 1, the `edit` that made the row (K, R or I), `turn` (null if inserted), role and text.

    A conversation is whole in its partition, its rows in order. Its plan comes first and its rows stream past it.
    """
    columns = ["conv_id", "pos", "turn", "role", "text"]
    leaders = plans.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = rows.select(columns).unionByName(leaders).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = audit = None
        at = place = 0
        state = NOTHING
        out: list[tuple] = []

        def write(edit: str, turn: int | None, role: str | None, text: str) -> None:
            nonlocal place, state
            if edit == "K":
                state = STATE_OF[role[0]]
            else:
                state = USER if state != USER else ASSISTANT
                role = "user" if state == USER else "assistant"
            place += 1
            out.append((talk, place, edit, turn, role, text))

        def insert() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                write("I", None, None, "")
                at += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[n.split()[0] for n in REPAIRED.split(", ")])

        for batch in batches:
            for conv_id, pos, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if pos == 0:
                    if audit is not None:
                        insert()
                    talk, audit, at, place, state = conv_id, text, 0, 0, NOTHING
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit != "D":
                    write(edit, turn, role, text)
            yield batch_of()
        if audit is not None:
            insert()
        yield batch_of()

    return dealt.mapInArrow(run, REPAIRED)


def talk_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of `repaired`, `role:text` lines hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, digest = None, None
        for batch in batches:
            done = []
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 1:
                    if digest is not None:
                        done.append((talk, digest.hexdigest()))
                    talk, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        last = [] if digest is None else [(talk, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in last], pa.int64()), pa.array([d for _, d in last], pa.string())], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `turns` (and of `ids`): faults, cost, audit and the digest of what `repaired` gives."""
    rows = placed(turns)
    plans = repair_plans(rows, ids)
    digests = talk_digests(repaired(rows, plans)).withColumnRenamed("conv_id", "talk")
    joined = plans.join(digests, plans["conv_id"].eqNullSafe(digests["talk"]), "left")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).drop("talk")
