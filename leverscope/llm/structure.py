"""Repair of conversation structure: alignment of turns with the alternating grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverscope.llm.common import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what a repaired sequence ends with; START: nothing yet
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that a legal end needs
NEVER = 1 << 30
RUN = 1024  # turns that one alignment handles
SPACE = " \t\n\v\f\r"

# A turn is one letter for the alignment: its initial where the grammar has it, else 'x'; in upper
# case if it is truncated; '-' if it must go.
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT, "x": START}


class Alignment:
    """Edit costs of a run of turns against all targets that end with one role.

    ``cost[i, k]`` is the least cost of turning the turns from i on into the last k roles of
    the grammar string ..., user, assistant, user, assistant (or one role less). Grammar strings
    of different length are suffixes of one another, so column k of row 0 is the alignment with
    the string of length k, and one matrix holds every feasible length. Insertions stand before a
    turn; the run's end has none.

    The plain repair, each turn kept or relabelled in place, costs no more than the incumbent.
    A cell whose lead of roles over turns (or lag) alone costs more is outside the band (Ukkonen).
    """

    def __init__(self, codes: str, last: int):
        self.codes, self.last, n = codes, last, len(codes)
        forced = np.array([c == "-" for c in codes], bool)
        free = np.append(np.cumsum(~forced[::-1])[::-1], 0)  # turns from i on that may stay
        roles = [INITIALS[c.lower()] if c != "-" else -1 for c in codes]
        self.extra = [TRUNCATED_COST if c.isupper() else 0 for c in codes]
        misses = sum(r >= 0 and r != self.role(int(k)) for r, k in zip(roles, free))
        # One insertion in front gives the other parity.
        spare = REROLE_COST * misses + sum(self.extra) + INSERT_COST
        lead, lag = spare // INSERT_COST, spare // DELETE_COST
        self.low = np.maximum(free - lag, 0)
        width = lead + lag + 1
        self.cost = np.full((n + 1, width), NEVER, np.int64)  # row i begins at column low[i]
        self.cost[n, 0] = 0
        ramp = INSERT_COST * np.arange(width)
        for i in range(n - 1, -1, -1):
            k = self.low[i] + np.arange(width)
            below = self.cost[i + 1]
            shift = int(self.low[i] - self.low[i + 1])  # 0 or 1
            deleted = np.append(below[shift:], np.full(shift, NEVER)) + DELETE_COST
            if forced[i]:
                base = deleted
            else:
                paired = (below if shift else np.append(NEVER, below[:-1])) + self.extra[i]
                same = (k % 2 == 1) if roles[i] == last else (k % 2 == 0) if roles[i] == self.other else np.zeros(width, bool)
                base = np.minimum(deleted, paired + np.where(same, 0, REROLE_COST))
            base = np.where(k <= free[i] + lead, base, NEVER)
            self.cost[i] = np.minimum(np.minimum.accumulate(base - ramp) + ramp, NEVER)

    @property
    def other(self) -> int:
        return USER + ASSISTANT - self.last

    def role(self, k: int) -> int:
        """The k-th role from the end."""
        return self.last if k % 2 else self.other

    def at(self, i: int, k: int) -> int:
        j = k - self.low[i]
        return int(self.cost[i, j]) if 0 <= j < self.cost.shape[1] else NEVER

    def best(self, i: int, first: int) -> tuple[int, list[int]]:
        """Least cost of turns i on over the targets that begin with this role, and the lengths that reach it."""
        k = self.low[i] + np.arange(self.cost.shape[1])
        fits = (k > 0) & (k % 2 == (1 if first == self.last else 0))
        costs = np.where(fits, self.cost[i], NEVER)
        least = int(costs.min())
        return (least, k[costs == least].tolist()) if least < NEVER else (NEVER, [])


def _options(at: Alignment, i: int, k: int) -> dict[str, tuple[int, int]]:
    """Edits that lead on from a cell at its least cost, with the cell after each."""
    code, need = at.codes[i], at.at(i, k)
    out = {}
    if at.at(i + 1, k) + DELETE_COST == need:
        out[DELETE] = (i + 1, k)
    if k and at.at(i, k - 1) + INSERT_COST == need:
        out[INSERT] = (i, k - 1)
    if k and code != "-":
        rest = at.at(i + 1, k - 1) + at.extra[i]
        if INITIALS[code.lower()] == at.role(k) and rest == need:
            out[KEEP] = (i + 1, k - 1)
        elif rest + REROLE_COST == need:
            out[REROLE] = (i + 1, k - 1)
    return out


def _least_audit(at: Alignment, cells: set[tuple[int, int]], opening: list[int] | None) -> str:
    """The ASCII-least of the audits that all tying lengths (cells) trace back, compared letter by letter.

    ``opening``: cost of still having nothing but deletions before a kept system turn, by turn.
    """
    n, out, waiting = len(at.codes), [], 0 if opening is not None else None
    while True:
        done = [c for c in cells if c[0] == n]
        if done:  # an audit that ends here is alone: every turn takes a letter and none follows the last
            return "".join(out)
        steps: dict[str, set[tuple[int, int]]] = {}
        for i, k in cells:
            for letter, after in _options(at, i, k).items():
                steps.setdefault(letter, set()).add(after)
        waits = False
        if waiting is not None and waiting < n:
            need = opening[waiting]
            if opening[waiting + 1] + DELETE_COST == need:
                steps.setdefault(DELETE, set())
                waits = True
            if at.codes[waiting] in "sS":
                rest, lengths = _after_system(at, waiting)
                if rest == need:
                    steps.setdefault(KEEP, set()).update((waiting + 1, k) for k in lengths)
        letter = min(steps)
        out.append(letter)
        cells = steps[letter]
        waiting = waiting + 1 if letter == DELETE and waits else None


def _after_system(at: Alignment, i: int) -> tuple[int, list[int]]:
    """Cost of keeping turn i as the system turn and aligning what follows, and the lengths that reach it."""
    cost, lengths = at.best(i + 1, USER)
    return cost + at.extra[i], lengths


def _system_alone(codes: str) -> tuple[int, str]:
    """Cheapest way to keep one system turn and nothing else."""
    kept = [(TRUNCATED_COST if c == "S" else 0, DELETE * i + KEEP + DELETE * (len(codes) - i - 1)) for i, c in enumerate(codes) if c in "sS"]
    return min(((DELETE_COST * (len(codes) - 1) + extra, audit) for extra, audit in kept), default=(NEVER, ""))


@lru_cache(maxsize=20_000)
def solve(codes: str, entry: int) -> dict[int, tuple[int, str]]:
    """For each role a run may end with after ``entry``: least cost and ASCII-least audit."""
    out = {entry: (DELETE_COST * len(codes), DELETE * len(codes))}
    if entry == START:
        alone = _system_alone(codes)
        if alone[0] < NEVER:
            out[SYSTEM] = alone
    for last in (USER, ASSISTANT):
        at = Alignment(codes, last)
        cost, lengths = at.best(0, NEXT[entry])
        opening = None
        if entry == START:
            opening = [NEVER] * (len(codes) + 1)
            for i in range(len(codes) - 1, -1, -1):
                opening[i] = opening[i + 1] + DELETE_COST
                if codes[i] in "sS":
                    opening[i] = min(opening[i], _after_system(at, i)[0])
                opening[i] = min(opening[i], NEVER)
        found = min(cost, opening[0] if opening else NEVER)
        if found < NEVER:
            cells = {(0, k) for k in lengths} if cost == found else set()
            audit = _least_audit(at, cells, opening if opening and opening[0] == found else None)
            if last not in out or (found, audit) < out[last]:
                out[last] = (found, audit)
    return out


def _table(codes: str) -> tuple[list[int], list[int]]:
    """Costs from each entry to each exit, and the place of the exit's audit among those of its entry."""
    costs, places = [], []
    for entry in range(4):
        found = solve(codes, entry)
        order = sorted(found, key=lambda x: found[x][1])
        costs += [found[x][0] if x in found else NEVER for x in range(4)]
        places += [order.index(x) if x in found else 4 for x in range(4)]
    return costs, places


def _route(runs: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation and (entry, exit) of each run: cost to go from the back, then forwards, ties by audit.

    Audits of one run never begin with one another, since each turn takes a letter and the last
    letter is a turn's; so the first run in which two repairs differ decides between them.
    """
    togo = [INSERT_COST * CLOSING[x] for x in range(4)]
    after = []
    for run in reversed(runs):
        after.append(togo)
        togo = [min(min(run["costs"][4 * e + x] + togo[x] for x in range(4)), NEVER) for e in range(4)]
    entry, way = START, []
    for run, rest in zip(runs, reversed(after)):
        total = [(run["costs"][4 * entry + x] + rest[x], run["places"][4 * entry + x], x) for x in range(4)]
        leave = min(total)[2]
        way.append((entry, leave))
        entry = leave
    return togo[START], way


def _edits(codes: str, entry: int, leave: int) -> list[tuple[str, str, str | None]]:
    """For each turn: inserted roles before it, its edit, and the role it gets."""
    out, state, before = [], entry, []
    for letter in solve(codes, entry)[leave][1]:
        if letter == DELETE:
            out.append((before, letter, None))
            before = []
            continue
        if letter == KEEP and codes[len(out)].lower() == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
        if letter == INSERT:
            before = [*before, NAMES[state]]
        else:
            out.append((before, letter, None if letter == KEEP else NAMES[state]))
            before = []
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn`` modulo 20; ``copy`` counts a repeated row's places.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it beside itself, 4 makes it a user's. Null cells count as one space; turn stays null.
    """
    named = conversations.toDF(*[c.lower() for c in conversations.columns])
    rows = named.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(key.cast("binary")) % 20
    rows = rows.withColumn("draw", draw).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns in order of (turn, role, text), spread by range, with a number ``rid`` that ascends in that order."""
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.md5("text").asc()]
    wanted = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(wanted, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("rid", F.monotonically_increasing_id()), "structure")


def _faults(placed: DataFrame) -> DataFrame:
    """Each turn with its first fault, initial, and letter for the alignment.

    The first turn of each role and text is found by a minimum summed map-side; no window holds a conversation.
    """
    same = ["conv_id", "role", F.md5("text").alias("digest"), F.length("text").alias("length")]
    first = placed.groupBy(*same).agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    blank = bare == ""
    fault = (F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(~bare.rlike(r"[.!?]\z"), "truncated"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    rows = placed.join(first, "rid", "left").withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})
    return rows.withColumn("code", F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))


def _runs(turns: DataFrame) -> DataFrame:
    """Runs of at most RUN turns of a conversation: letters in order, first and last initial, illegal neighbours inside."""
    grouped = turns.groupBy("conv_id", F.shiftright("rid", RUN.bit_length() - 1).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("rid", "code", "initial"))).alias("x"))
    legal = ["su", "ua", "au"]
    pair = F.expr("transform(sequence(1, size(x) - 1), i -> concat(x[i - 1].initial, x[i].initial))")
    pairs = F.when(F.size("x") > 1, pair).otherwise(F.array().cast("array<string>"))
    inside = F.size(F.filter(pairs, lambda p: ~p.isin(*legal)))
    return grouped.select("conv_id", "run", F.array_join("x.code", "").alias("codes"), F.col("x.rid").alias("rids"),
                          inside.alias("illegal"), F.col("x")[0]["initial"].alias("head"), F.element_at("x", -1)["initial"].alias("tail"))


def _solved(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversation table: conv_id, illegal, cost, closing) and (turn table: rid, conv_id, run, inserted, edit, role_out)."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_table(codes) for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "run", "illegal", "head", "tail")], pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32()))],
                names=["conv_id", "run", "illegal", "head", "tail", "costs", "places"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"conv_id": [], "illegal": [], "cost": [], "closing": [], "way": []}
            for conv_id, runs_ in zip(batch.column("conv_id").to_pylist(), batch.column("runs").to_pylist()):
                cost, way = _route(runs_)
                between = sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(runs_, runs_[1:]))
                closing = [NAMES[USER], NAMES[ASSISTANT]][2 - CLOSING[way[-1][1]] :]
                for name, value in zip(rows, (conv_id, sum(r["illegal"] for r in runs_) + between, cost, closing,
                                              [{"run": r["run"], "entry": e, "leave": x} for r, (e, x) in zip(runs_, way)])):
                    rows[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("run", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
        for batch in batches:
            rows = ([], [], [], [])
            for codes, rids, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("codes", "rids", "entry", "leave"))):
                for rid, edit in zip(rids, _edits(codes, entry, leave)):
                    for column, value in zip(rows, (rid, *edit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], names=["rid", "inserted", "edit", "role_out"])

    costs = runs.mapInArrow(tables, "conv_id long, run long, illegal int, head string, tail string, costs array<long>, places array<int>")
    # One row of a few hundred bytes for a thousand turns.
    whole = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "illegal", "head", "tail", "costs", "places"))).alias("runs"))
    routed = stored(whole.mapInArrow(route, "conv_id long, illegal long, cost long, closing array<string>, way array<struct<run: long, entry: int, leave: int>>"), "structure-routes")
    way = routed.select("conv_id", F.explode("way").alias("w")).select(F.col("conv_id").alias("c"), "w.*")
    chosen = runs.join(way, runs["conv_id"].eqNullSafe(way["c"]) & (runs["run"] == way["run"])).select("codes", "rids", "entry", "leave")
    return routed.drop("way"), chosen.mapInArrow(edits, "rid long, inserted array<string>, edit string, role_out string")


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) from rows sorted by conversation, streamed: a digest needs its input in order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, audit, first, held = None, None, [], True, []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*held))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for conv_id, letters, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letters", "lines"))):
                if state is None or conv_id != conv:
                    if state is not None:
                        held.append((conv, "".join(audit), state.hexdigest()))
                        if len(held) >= 2000:
                            yield from flush()
                    conv, state, audit, first = conv_id, hashlib.sha256(), [], True
                audit.append(letters)
                for line in lines:
                    state.update(line.encode() if first else b"\n" + line.encode())
                    first = False
        if state is not None:
            held.append((conv, "".join(audit), state.hexdigest()))
        if held:
            yield from flush()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "rid")
    return dealt.select("conv_id", "letters", "lines").mapInArrow(task, "conv_id long, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text) into ``(s?(ua)+)?`` by the cheapest edits.

    Gives (turns, conversations). Turns: conv_id, rid (ascending in order), turn, role, text, fault,
    edit (K, R, D), role_out, inserted (roles of empty turns before it). Conversations: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, closing (roles inserted at the end). Kept turns cost 0, relabelled
    ones 2, deleted ones 3, inserted ones 2, a truncated turn that stays 1 more; blank turns and
    those whose role and text came before must go. Of equally cheap repairs the one whose audit is least
    in ASCII order stands.

    Turns are taken by turn (null first), then role and the text's md5. They are aligned with the
    grammar string of every feasible length in runs of RUN turns; a run gives the cost from each
    role before it to each role after it, and runs compose, so one conversation may hold
    any share of the rows. Null role and text count as one space; a null conv_id is a conversation of its own;
    repeated rows are duplicates; no turns give no rows; other columns are not read.
    """
    named = turns.toDF(*[c.lower() for c in turns.columns])
    rows = named.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    faulty = stored(_faults(_placed(rows)), "structure-faults")
    routed, edits = _solved(stored(_runs(faulty), "structure-runs"))
    count = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    counts = faulty.groupBy("conv_id", "turn").agg(*count).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    same = counts["conv_id"].eqNullSafe(routed["conv_id"])
    conversations = counts.join(routed, same).select(counts["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "closing")
    return faulty.join(edits, "rid").drop("first", "initial", "code"), conversations


def audit(conversations: DataFrame) -> DataFrame:
    """Damage conversations, repair them, and give per original conv_id the faults, cost, audit and digest of the repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A
    conversation that lost all turns has zeros, an empty audit and the digest of the empty string.
    The digest streams over a conversation's turns in order, which is one task by nature; its
    memory is that of the audit.
    """
    named = conversations.toDF(*[c.lower() for c in conversations.columns])
    turns, found = repair(damaged(named).drop("copy"))
    turns, found = stored(turns, "structure-turns"), stored(found, "structure-conversations")
    kept = F.concat(F.coalesce("role_out", "role"), F.lit(":"), F.col("text"))
    lines = F.concat(F.transform("inserted", lambda r: F.concat(r, F.lit(":"))), F.when(F.col("edit") == DELETE, F.array().cast("array<string>")).otherwise(F.array(kept)))
    pieces = turns.select("conv_id", "rid", F.concat(F.repeat(F.lit(INSERT), F.size("inserted")), "edit").alias("letters"), lines.alias("lines"))
    ends = found.select("conv_id", F.lit((1 << 63) - 1).alias("rid"), F.repeat(F.lit(INSERT), F.size("closing")).alias("letters"),
                        F.transform("closing", lambda r: F.concat(r, F.lit(":"))).alias("lines"))
    digests = _digests(pieces.unionByName(ends))
    all_ = named.select(F.col("conv_id").cast("long")).distinct()
    out = all_.join(found.drop("closing").withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    out = out.join(digests.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
