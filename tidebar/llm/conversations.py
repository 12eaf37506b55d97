"""Repair of the structure of conversations (operator 13) by a min-plus matrix scan.

Turns of a conversation are kept, given another role, deleted, or others are inserted, such that the initials of the roles
become `(s?(ua)+)?` at the least cost, and among the cheapest ways the one whose initials of edits are least in ASCII.
The states of that pattern are four, so a turn is a 4x4 matrix of elements (cost, edits), with what can be inserted behind
it closed over; the product of two matrices takes the least sum for each pair of states. Of one way between two states no
other of the same cost is a beginning (roles follow from state and edits), so least elements stay least in products, and
the product is associative: blocks of BLOCK turns are multiplied where they lie, and long conversations, over any number of
blocks and partitions, by a reduction tree of FAN matrices a node.

Turns are ordered by a range partition of the whole table, so a conversation may lie in many partitions. The one thing
that needs a conversation in one task is its list of edits, one byte a turn.

Defined cases: order is by turn, null first; turns of the same number by role, then by a hash of the text; repeated rows
follow each other; null roles and texts count as one space, a null conv_id is a conversation of its own; a role that begins
with none of s, u and a can be given another or deleted, and makes a pair with a neighbour illegal.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget, keep, workers_find_us

BLOCK = 1024
FAN = 32
SPACE = r"[^\x20\x09-\x0D]"
#: A turn as one letter: the initial of its role, by row: as it is, cut off at its end, to be deleted.
CODES = {"fine": "suao", "cut": "SUAO", "gone": "wxyz"}
PAIRS = {"su", "ua", "au"}
#: States: nothing yet, behind s, behind u, behind a. Next state of a role from each.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
INSERTED = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
for _i in (0, 1, 3):
    INSERTED[_i][2], INSERTED[_i][3] = (5, "I"), INSERTED[_i][3] or (10, "II")
INSERTED[2][3] = (5, "I")
Matrix = list[list[tuple[int, str] | None]]


def _initial(code: str) -> str:
    return next("suao"[of.index(code)] for of in CODES.values() if code in of)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: elements are (cost, edits), sums are by cost and by putting edits after one another."""
    out = []
    for row in a:
        least = []
        for j in range(4):
            ways = [(x[0] + y[j][0], x[1] + y[j][1]) for x, y in zip(row, b) if x is not None and y[j] is not None]
            least.append(min(ways, default=None))
        out.append(least)
    return out


@lru_cache(None)
def turn_matrix(code: str) -> Matrix:
    """What one turn can become, and what can be inserted behind it."""
    of, more = _initial(code), 5 if code in CODES["cut"] else 0
    edits: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        ways = {i: [(2, "D")]}
        if code not in CODES["gone"]:
            for role, edit, cost in ((of, "K", 0), ("u", "R", 1), ("a", "R", 1)):
                if i in NEXT[role]:
                    ways.setdefault(NEXT[role][i], []).append((cost + more, edit))
        for j, w in ways.items():
            edits[i][j] = min(w)
    return times(edits, INSERTED)


def _illegal(codes: str) -> int:
    roles = [_initial(c) for c in codes]
    return sum(a + b not in PAIRS for a, b in zip(roles, roles[1:]))


@lru_cache(5_000)
def block_matrix(codes: str) -> Matrix:
    """Product of the turns of a block, by halves."""
    if len(codes) == 1:
        return turn_matrix(codes)
    half = len(codes) // 2
    return times(block_matrix(codes[:half]), block_matrix(codes[half:]))


def cheapest(product: Matrix) -> tuple[int, str]:
    """The best way of a whole conversation, with what is inserted before its first turn."""
    whole = times([INSERTED[0]], product)[0]
    return min(x for x in (whole[0], whole[3]) if x is not None)


def actions(codes: str, edits: str, state: int) -> tuple[list[str], int]:
    """For each turn of a block what it becomes, and the state behind it.

    k: kept, U and A: given the role user or assistant, u and a: inserted, d: deleted. Edits before the first turn's own
    belong to it, those behind a turn's own to that turn.
    """
    out: list[str] = []
    before = ""
    own = 0
    for e in edits:
        if e == "I":
            role = "a" if state == 2 else "u"
            state = NEXT[role][state]
            if own:
                out[-1] += role
            else:
                before += role
            continue
        code = codes[own]
        own += 1
        if e == "D":
            act = "d"
        else:
            role = _initial(code) if e == "K" else "a" if state == 2 else "u"
            state = NEXT[role][state]
            act = "k" if e == "K" else role.upper()
        out.append(before + act)
        before = ""
    return out, state


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (a number in the order of conversations and turns, without gaps in a partition),
    block, size of the table's blocks, and code; written to the shared folder.

    Rows are dealt by ranges of everything they are ordered by, so many turns, or copies, of one conversation spread.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_h", "_copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    blank, last = ~F.col("text").rlike(SPACE), F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(last, "cut").otherwise("fine")
    return keep(rows.select("conv_id", "turn", "role", "text", "place", F.shiftright("place", 10).alias("block"), fault.alias("fault"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("_h").alias("h1")))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, block, fault (of which the first counts), code: no texts."""
    short = rows.select("conv_id", "turn", "role", "place", "block", "fault", "h1", "h2")
    same = ["conv_id", "role", "h1", "h2"]
    first = short.groupBy(*same).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same]
    short = short.alias("l").join(first.alias("r"), on, "left").select("l.*", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("again"))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("again"), "duplicate").otherwise(F.when(F.col("fault") == "cut", "truncated"))
    short = short.withColumn("fault", fault)
    kind = F.when(F.col("fault") == "truncated", CODES["cut"]).when(F.col("fault").isNotNull(), CODES["gone"]).otherwise(CODES["fine"])
    at = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(4)
    return short.select("conv_id", "turn", "place", "block", "fault", F.substring(kind, at, F.lit(1)).alias("code"))


def _flat(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    return [x and x[0] for row in m for x in row], [x and x[1] for row in m for x in row]


def _matrix(costs, edits) -> Matrix:
    cells = [None if e is None else (int(c), e) for c, e in zip(costs, edits)]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


_PART = "conv_id long, at long, illegal long, head string, tail string, costs array<long>, edits array<string>"


def _multiplied(parts: DataFrame) -> DataFrame:
    """One level of the tree: matrices of a conversation, FAN neighbours at a time."""

    def run(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("at")
        total, illegal, tail = None, 0, ""
        for x in some.itertuples():
            m = _matrix(x.costs, x.edits)
            illegal += x.illegal + (total is not None and tail + x.head not in PAIRS)
            total, tail = m if total is None else times(total, m), x.tail
        first = some.iloc[0]
        costs, edits = _flat(total)
        return pd.DataFrame({"conv_id": [first.conv_id], "at": [first["at"] // FAN], "illegal": [illegal], "head": [first["head"]], "tail": [tail], "costs": [costs], "edits": [edits]}).astype({"conv_id": "Int64"})

    return parts.groupBy("conv_id", F.floor(F.col("at") / FAN)).applyInPandas(run, _PART)


def _several(blocks: DataFrame) -> DataFrame:
    """conv_id of the conversations with more than one row."""
    return blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")


def _among(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.alias("l").join(right.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), how)


def _solve(blocks: DataFrame, of: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For all conversations conv_id, cost, audit, illegal; for all blocks conv_id, block, first, acts (one for each turn)."""
    several = scratch.keep(_several(blocks))
    short = _among(blocks, several, "left_anti")
    out = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("acts", pa.list_(pa.string()))])

    def run(batches):
        solve = lru_cache(20_000)(lambda codes: (best := cheapest(block_matrix(codes)), _illegal(codes), actions(codes, best[1], 0)[0]))
        for b in batches:
            got = [solve(c) for c in b.column("codes").to_pylist()]
            columns = [b.column("conv_id"), b.column("block"), b.column("first"), [x[0][0] for x in got], [x[0][1] for x in got], [x[1] for x in got], [x[2] for x in got]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    short = scratch.keep(short.select("conv_id", "block", "first", "codes").mapInArrow(run, "conv_id long, block long, first long, cost long, audit string, illegal long, acts array<string>"))
    reports, acts = short.select("conv_id", "cost", "audit", "illegal"), short.select("conv_id", "block", "first", "acts")
    if several.isEmpty():
        return reports, acts
    long = scratch.keep(_among(blocks, several, "left_semi"))

    def start(batches):
        for b in batches:
            codes = b.column("codes").to_pylist()
            flat = [_flat(block_matrix(c)) for c in codes]
            columns = [pa.array([_illegal(c) for c in codes], pa.int64()), pa.array([_initial(c[0]) for c in codes]), pa.array([_initial(c[-1]) for c in codes])]
            columns += [pa.array([x[0] for x in flat], pa.list_(pa.int64())), pa.array([x[1] for x in flat], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), *columns], ["conv_id", "at", "illegal", "head", "tail", "costs", "edits"])

    dense = F.shiftright("block", 23) * F.lit(of) + F.col("block").bitwiseAND((1 << 23) - 1)
    level = keep(long.select("conv_id", dense.alias("at"), "codes").mapInArrow(start, _PART))
    while True:
        up = keep(_multiplied(level))
        forget(level)
        level = up
        if _several(level).isEmpty():
            break
    scratch.frames.append(level)

    def whole(some: pd.DataFrame) -> pd.DataFrame:
        got = [cheapest(_matrix(x.costs, x.edits)) for x in some.itertuples()]
        return pd.DataFrame({"conv_id": some.conv_id, "cost": [x[0] for x in got], "audit": [x[1] for x in got], "illegal": some.illegal}).astype({"conv_id": "Int64"})

    solved = scratch.keep(level.mapInPandas(lambda it: map(whole, it), "conv_id long, cost long, audit string, illegal long"))

    def share(parts: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        """The edits of a conversation, dealt to its blocks."""
        edits, at, state, made = best["audit"].iloc[0], 0, 0, []
        parts = parts.sort_values("block")
        for i, codes in enumerate(parts.codes):
            end, left = at, len(codes)
            last = i + 1 == len(parts)
            while end < len(edits) and (left or last or edits[end] == "I"):
                left -= edits[end] != "I"
                end += 1
            done, state = actions(codes, edits[at:end], state)
            at = end
            made.append(done)
        return pd.DataFrame({"conv_id": parts.conv_id, "block": parts.block, "first": parts["first"], "acts": made}).astype({"conv_id": "Int64"})

    dealt = long.select("conv_id", "block", "first", "codes").groupBy("conv_id").cogroup(solved.groupBy("conv_id")).applyInPandas(share, "conv_id long, block long, first long, acts array<string>")
    return reports.unionByName(solved), acts.unionByName(dealt)


class Repair:
    """A repair of all conversations: report, a row for each, and turns, the repaired ones."""

    def __init__(self, turns: DataFrame):
        workers_find_us(turns.sparkSession)
        with Scratch() as scratch:
            rows = ordered_turns(turns)
            coded = scratch.keep(_coded(rows))
            of = (coded.agg(F.max(F.col("block").bitwiseAND((1 << 23) - 1))).first()[0] or 0) + 1
            codes = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]))
            blocks = scratch.keep(coded.groupBy("conv_id", "block").agg(F.min("place").alias("first"), codes.alias("codes")))
            reports, acts = _solve(blocks, of, scratch)
            self.acts = keep(acts)
            wide = lambda c: c.cast("decimal(38,0)")
            count = lambda name: F.sum((F.coalesce("fault", F.lit("")) == name).cast("long")).alias(name)
            faults = coded.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *map(count, ("blank", "duplicate", "truncated")))
            span = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")
            faults = faults.groupBy("conv_id").agg(F.coalesce(span.try_cast("long"), F.lit(0).cast("long")).alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
            self.report = keep(_among(faults, reports, "inner").select("l.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
        self.rows = rows

    def turns(self) -> DataFrame:
        """conv_id, place, step (order in the conversation is by these), turn (null if inserted), role, text, edit."""
        on = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.block") == F.col("r.block"))
        rows = self.rows.alias("l").join(self.acts.alias("r"), on).select("l.*", F.element_at("r.acts", (F.col("l.place") - F.col("r.first") + 1).cast("int")).alias("act"))
        rows = rows.select("*", F.posexplode(F.split("act", "")).alias("step", "edit")).where("edit not in ('', 'd')")
        inserted, kept = F.col("edit").isin("u", "a"), F.col("edit") == "k"
        role = F.when(kept, F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
        name = F.when(kept, "keep").when(inserted, "insert").otherwise("rerole")
        return rows.select("conv_id", "place", "step", F.when(~inserted, F.col("turn")).alias("turn"), role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"), name.alias("edit"))

    def hashes(self) -> DataFrame:
        """conv_id, repaired_sha256 of `role:text` of the repaired turns, joined by newlines; those without turns are not in it.

        A hash follows its text from beginning to end, so a conversation passes one task, in a stream: no more than a batch
        is held.
        """
        out = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

        def run(batches):
            held, digest = None, None
            for b in batches:
                done = []
                for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if digest is None or conv_id != held:
                        if digest is not None:
                            done.append((held, digest.hexdigest()))
                        held, digest = conv_id, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:{text}".encode())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(out)], schema=out)
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([digest.hexdigest()])], schema=out)

        turns = self.turns().select("conv_id", "place", "step", "role", "text")
        return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a CRC-32 of `conv_id:turn` decides; nulls are read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).where("h != 0")
    body = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), twice.alias("copy")).drop("copy")


#: SHA-256 of nothing.
EMPTY = hashlib.sha256().hexdigest()


def report_of_damaged(conversations: DataFrame) -> DataFrame:
    """The report of the damaged and repaired conversations; those that lost all their rows have zeros."""
    ids = conversations.select("conv_id").distinct()
    made = Repair(damage(conversations))
    both = _among(ids, made.report, "left").select("l.conv_id", *[F.coalesce(f"r.{n}", F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("r.audit", F.lit("")).alias("audit"))
    return _among(both, made.hashes(), "left").select("l.*", F.coalesce("r.repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
