"""Minimum-cost role repair of conversations, and their rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import stored

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
START = len(ROLES)  # the state before the first turn
UNKNOWN = len(ROLES)  # an observed role that is none of these
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 1, 2, 3, 1
NEVER = 1 << 40
RUN = 1024  # turns that one dynamic programme handles
# Empty turns that a legal sequence needs between two states. Legal: an optional system turn, then
# user and assistant in turn, from user to assistant.
BETWEEN = {
    (3, 0): (), (3, 1): (), (3, 2): (1,), (0, 1): (), (0, 2): (1,), (1, 2): (), (2, 1): (),
}
CLOSING = {0: (1, 2), 1: (2,), 2: ()}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _costs() -> np.ndarray:
    """Cost of going from a state (the last is the start) to an output role, by observed role."""
    out = np.full((len(ROLES) + 1, len(ROLES) + 1, len(ROLES)), NEVER, np.int64)
    for seen in range(len(ROLES) + 1):
        for to in range(len(ROLES)):
            label = 0 if seen == to else RELABEL_UNKNOWN if seen == UNKNOWN else RELABEL
            for state in range(len(ROLES) + 1):
                if state == to:
                    out[seen, state, to] = MERGE + label
                elif (state, to) in BETWEEN:
                    out[seen, state, to] = INSERT * len(BETWEEN[state, to]) + label
    return out


COSTS = _costs()
END_COSTS = np.array([INSERT * len(CLOSING[r]) for r in range(len(ROLES))])


def forward(seen: list[int], entry: np.ndarray) -> np.ndarray:
    """Least cost of every role after the turns, from costs of the four states before them."""
    at = entry
    for role in seen:
        step = (at[:, None] + COSTS[role]).min(axis=0)
        at = np.append(np.minimum(step, NEVER), NEVER)
    return at[: len(ROLES)]


def matrix(seen: list[int]) -> np.ndarray:
    """The run as one step: cost from each state to each role. Runs compose by (min, +)."""
    return np.stack([forward(seen, np.where(np.arange(len(ROLES) + 1) == s, 0, NEVER)) for s in range(len(ROLES) + 1)])


def paths(seen: list[int], entry: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For each last role the cheapest roles of the run, and the state before it; ties to the least role, last turn first."""
    at, back = entry, []
    for role in seen:
        total = at[:, None] + COSTS[role]
        back.append(total.argmin(axis=0))
        at = np.append(np.minimum(total.min(axis=0), NEVER), NEVER)
    out, before = np.zeros((len(ROLES), len(seen)), np.int8), []
    for last in range(len(ROLES)):
        state = last
        for i in range(len(seen) - 1, -1, -1):
            out[last, i] = state
            state = int(back[i][state])
        before.append(state)
    return out, before


FIRST = np.array([NEVER, NEVER, NEVER, 0])


def _ends(befores: list[list[int]], last: np.ndarray) -> list[int]:
    """The role at the end of each run of one conversation, from the last run backwards."""
    out = [int(np.argmin(last + END_COSTS))]
    for before in reversed(befores[1:]):
        out.append(before[out[-1]])
    return out[::-1]


def _runs(turns: DataFrame) -> DataFrame:
    """Runs of at most RUN consecutive turns of a conversation, with the observed roles."""
    grouped = turns.groupBy("conv_id", F.shiftright("rid", RUN.bit_length() - 1).alias("run")).agg(F.sort_array(F.collect_list(F.struct("rid", "seen"))).alias("x"))
    return grouped.select("conv_id", "run", F.col("x.rid").alias("rids"), F.col("x.seen").alias("seen"))


def _entries(runs: DataFrame) -> DataFrame:
    """Costs of the states before each run, for conversations of several: runs as matrices, composed in order.

    A conversation's group has one small row for a thousand turns.
    """
    def to_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [matrix(seen).ravel().tolist() for seen in batch.column("seen").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("run"), pa.array(cells, pa.list_(pa.int64()))], names=["conv_id", "run", "m"])

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("run")
        at, out = FIRST, []
        for cells in rows.column("m").to_pylist():
            out.append(at.tolist())
            step = (at[:, None] + np.array(cells).reshape(len(ROLES) + 1, len(ROLES))).min(axis=0)
            at = np.append(np.minimum(step, NEVER), NEVER)
        return pa.table({"run": rows.column("run"), "conv_id": rows.column("conv_id"), "entry": out})

    cells = runs.select("conv_id", "run", "seen").mapInArrow(to_matrix, "conv_id long, run long, m array<long>")
    return cells.groupBy("conv_id").applyInArrow(compose, "run long, conv_id long, entry array<long>")


def _decide(runs: DataFrame) -> DataFrame:
    """(rid, position, before, role_out, ends): place in the conversation, state before, role, and whether it is the last."""
    kind = "rid long, position long, before int, role_out int, ends boolean"

    def rows(rids, first, path, before, final) -> pa.RecordBatch:
        n = len(rids)
        states = np.append(before, path[:-1]).astype(np.int32)
        ends = np.zeros(n, bool)
        ends[-1] = final
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(np.arange(first, first + n)), pa.array(states), pa.array(path.astype(np.int32)), pa.array(ends)], names=["rid", "position", "before", "role_out", "ends"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rids, seen in zip(batch.column("rids").to_pylist(), batch.column("seen").to_pylist()):
                found, before = paths(seen, FIRST)
                last = _ends([before], forward(seen, FIRST))[0]
                parts.append(rows(rids, 0, found[last], before[last], True))
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [paths(seen, np.array(entry)) for seen, entry in zip(batch.column("seen").to_pylist(), batch.column("entry").to_pylist())]
            after = [forward(seen, np.array(entry)).tolist() for seen, entry in zip(batch.column("seen").to_pylist(), batch.column("entry").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("run"), batch.column("rids"), pa.array([f.ravel().tolist() for f, _ in solved], pa.list_(pa.int32())),
                 pa.array([b for _, b in solved], pa.list_(pa.int32())), pa.array(after, pa.list_(pa.int64()))],
                names=["conv_id", "run", "rids", "paths", "before", "after"])

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        before = table.column("before").to_pylist()
        last = np.array(table.column("after")[-1].as_py())
        ends = _ends(before, last)
        final = [i == len(ends) - 1 for i in range(len(ends))]
        first = np.cumsum([0, *table.column("n").to_pylist()])[:-1]
        return pa.table({"conv_id": table.column("conv_id"), "run": table.column("run"), "last": pa.array(ends, pa.int32()), "final": final, "first": first})

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, path, before, last, final, first in zip(*(batch.column(c).to_pylist() for c in ("rids", "paths", "before", "last", "final", "first"))):
                yield rows(rids, first, np.array(path).reshape(len(ROLES), -1)[last], before[last], final)

    of = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("of")
    counts = runs.groupBy(of).agg(F.count("*").alias("k"), F.min("run").alias("only"))
    one = runs.select("*", of).join(counts.filter("k = 1").select("of"), "of", "left_semi").select("rids", "seen").mapInArrow(alone, kind)
    many = stored(runs.select("*", of).join(counts.filter("k > 1").select("of"), "of", "left_semi").drop("of"), "chat-long")
    entries = _entries(many).select("conv_id", "run", "entry")
    same = many["conv_id"].eqNullSafe(entries["conv_id"]) & (many["run"] == entries["run"])
    tried = stored(many.join(entries, same).select(many["conv_id"], many["run"], "rids", "seen", "entry").mapInArrow(
        options, "conv_id long, run long, rids array<long>, paths array<int>, before array<int>, after array<long>"), "chat-options")
    # A conversation's group has, again, one small row for a thousand turns.
    chosen = tried.select("conv_id", "run", "before", "after", F.size("rids").alias("n")).groupBy("conv_id").applyInArrow(
        choose, "conv_id long, run long, last int, final boolean, first long")
    same = tried["conv_id"].eqNullSafe(chosen["conv_id"]) & (tried["run"] == chosen["run"])
    rest = tried.join(chosen, same).select("rids", "paths", tried["before"], "last", "final", "first").mapInArrow(expand, kind)
    return one.unionByName(rest)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position, turn, role, role_out, action, inserted, copies, piece.

    A dynamic programme over the automaton of legal sequences (system first if at all, then user
    and assistant in turn, ending with assistant) chooses for every conversation the cheapest mix
    of merging a turn into the one before (1), inserting an empty turn (2), and relabelling
    (3; 1 for a role that is none of the known ones or null). Ties go to system, user, assistant in
    this order, deciding from the last turn back. Joined in order of ``position`` the pieces are
    the rendered conversation; ``inserted`` names the empty turns rendered before the turn and, at the
    end, after it.

    Turns are ordered by turn (null last), role and the text's md5; rows equal in turn, role and text
    are one turn with ``copies``. Null text is empty; a null conv_id is a conversation of its own; marker strings
    in texts are broken by a blank. Turns are sorted by range, so a conversation of any length is
    spread over tasks; it is solved in runs of ``RUN`` turns, each a (min, +) matrix, which compose.
    Other columns are not read.
    """
    named = conversations.toDF(*[c.lower() for c in conversations.columns])
    turns = named.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    tidy = F.lower(F.trim("role"))
    for alias, role in ALIASES.items():
        tidy = F.when(tidy == alias, role).otherwise(tidy)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), tidy) - 1, F.lit(-1))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.md5("text").asc()]
    wanted = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.withColumn("seen", F.when(code < 0, UNKNOWN).otherwise(code).cast("int")).repartitionByRange(wanted, *order)
    turns = stored(turns.sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()), "chat")
    solved = turns.join(_decide(stored(_runs(turns), "chat-runs")), "rid")
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role_out") + 1)
    merged = F.col("before") == F.col("role_out")

    def empties(names: tuple[int, ...]) -> str:
        return "".join(OPEN.format(ROLES[r]) + CLOSE for r in names)

    inserted, gap = F.array().cast("array<string>"), F.lit("")
    for (state, to), names in BETWEEN.items():
        if names:
            here = (F.col("before") == state) & (F.col("role_out") == to)
            inserted = F.when(here, F.array(*[F.lit(ROLES[r]) for r in names])).otherwise(inserted)
            gap = F.when(here, F.lit(empties(names))).otherwise(gap)
    tail, tail_names = F.lit(""), F.array().cast("array<string>")
    for role, names in CLOSING.items():
        here = F.col("ends") & (F.col("role_out") == role)
        tail = F.when(here, F.lit(CLOSE + empties(names))).otherwise(tail)
        tail_names = F.when(here, F.array(*[F.lit(ROLES[r]) for r in names]).cast("array<string>")).otherwise(tail_names)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    head = F.when(merged, F.lit(JOIN)).otherwise(F.concat(
        F.when(F.col("before") == START, F.lit("")).otherwise(F.lit(CLOSE)), gap, F.lit("<|im_start|>"), name, F.lit("\n")))
    return solved.select(
        "conv_id", "position", "turn", "role", name.alias("role_out"),
        F.when(merged, "merge").when(F.col("seen") != F.col("role_out"), "relabel").otherwise("keep").alias("action"),
        F.array_join(F.concat(inserted, tail_names), ",").alias("inserted"), "copies", F.concat(head, text, tail).alias("piece"))
