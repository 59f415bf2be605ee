"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Dynamic
programming over that automaton chooses, for every input turn, the cheapest of: keep it, merge it into the turn before,
relabel it (and keep or merge it), or put an empty turn before it; an empty assistant turn may close the end.

Rows are range-partitioned and sorted by (conversation, turn, role, text), so partitions have even sizes whatever the
longest conversation. Conversations inside a partition are repaired at once. One that crosses partitions is cut into
segments: each is summed up as a matrix of least costs between states (min-plus products compose), the matrices of a
conversation, one for each partition it touches, fix the state at each cut, and every segment is then repaired on its own.

The result has a row per input turn: ``rendered`` is its share of the formatted conversation, which is the concatenation
of the shares by ``seq``. Turns with the same number, and null turns (which come last), are ordered by role and text.
Roles are trimmed and lower-cased; an unknown or null role is relabelled at a lower price. Null texts count as empty. A
null conversation id is one conversation. Repeated rows are turns of their own. Empty tables give no rows. Only the four
columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written

ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States: nothing yet, or the role of the last turn.
START = 3
STATES = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Costs of the repairs.
MERGE, INSERT, RELABEL, RELABEL_OTHER = 1.0, 2.0, 3.0, 0.5
INF = float("inf")

Step = tuple[float, str, int | None]  # cost, action, role of the empty turn put before


def _moves(role: int) -> list[list[Step]]:
    """The cheapest step between each two states for a turn of this role."""
    table = [[(INF, "", None) for _ in STATES] for _ in STATES]

    def offer(a: int, b: int, step: Step) -> None:
        if step[0] < table[a][b][0]:
            table[a][b] = step

    for a in STATES:
        for to in (SYSTEM, USER, ASSISTANT):
            label = 0.0 if to == role else RELABEL_OTHER if role == OTHER else RELABEL
            name = "keep" if to == role else "relabel"
            if to in LEGAL[a]:
                offer(a, to, (label, name, None))
            if to == a:
                offer(a, to, (label + MERGE, "merge" if to == role else "relabel_merge", None))
            for between in LEGAL[a]:
                if between != SYSTEM and to in LEGAL[between]:
                    offer(a, to, (label + INSERT, f"insert_{name}", between))
    return table


MOVES = [_moves(r) for r in range(4)]
#: Cost of ending in each state; an empty assistant turn is put after a user's, after a lone system turn two empty ones.
FINAL = {ASSISTANT: (0.0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), START: (0.0, ())}


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else OTHER


def cost_matrix(roles: list[int]) -> list[list[float]]:
    """Least cost between each two states over a run of turns."""
    now = [[0.0 if a == b else INF for b in STATES] for a in STATES]
    for role in roles:
        moves = MOVES[role]
        now = [[min(row[m] + moves[m][b][0] for m in STATES) for b in STATES] for row in now]
    return now


def best_path(roles: list[int], entry: int, leave: int | None) -> list[tuple[Step, int]]:
    """(step, state after) for each turn, from ``entry`` to ``leave``, or to the cheapest end of a conversation."""
    cost, back = [0.0 if a == entry else INF for a in STATES], []
    for role in roles:
        moves = MOVES[role]
        came = [min(STATES, key=lambda a: (cost[a] + moves[a][b][0], a)) for b in STATES]  # noqa: B023
        cost = [cost[came[b]] + moves[came[b]][b][0] for b in STATES]
        back.append(came)
    at = min(STATES, key=lambda b: (cost[b] + FINAL[b][0], b)) if leave is None else leave
    out = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        out.append((MOVES[role][came[at]][at], at))
        at = came[at]
    return out[::-1]


def head(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def rendered(texts: list[str | None], path: list[tuple[Step, int]], entry: int, last: bool) -> list[dict]:
    """What each turn adds to the formatted conversation."""
    rows, state = [], entry
    for i, (text, ((cost, action, between), after)) in enumerate(zip(texts, path, strict=True)):
        merged = action.endswith("merge")
        out = "" if state == START or merged else CLOSE
        if between is not None:
            out += head(between) + CLOSE
        out += ("\n" if merged else head(after)) + (text or "")
        if last and i == len(texts) - 1:
            out += CLOSE + "".join(head(x) + CLOSE for x in FINAL[after][1])
        rows.append({"action": action, "out_role": ROLES[after], "starts_turn": not merged, "cost": cost + (FINAL[after][0] if last and i == len(texts) - 1 else 0.0), "rendered": out})
        state = after
    return rows


def repair(roles: list[str | None], texts: list[str | None]) -> list[dict]:
    """One whole conversation."""
    return rendered(texts, best_path([role_number(r) for r in roles], START, None), START, True)


FIELDS = "seq long, action string, out_role string, starts_turn boolean, cost double, rendered string"
_FIELDS = [("seq", pa.int64()), ("action", pa.string()), ("out_role", pa.string()), ("starts_turn", pa.bool_()), ("cost", pa.float64()), ("rendered", pa.string())]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, turn, role, FIELDS for every turn."""
    slim = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string").alias("_text"))
    # The row number parts rows that are equal otherwise, so that any conversation can be cut; which of two equal rows has
    # which number makes no difference.
    keys = ["_conv", F.col("_turn").asc_nulls_last(), "_role", F.xxhash64("_text"), "_text", "_tie"]
    tied = slim.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parallelism(turns.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_part", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    own = ", ".join(f"{n} {kinds[n]}" for n in ("_conv", "_turn", "_role"))
    shape = f"{own}, {FIELDS}, _part int, _open boolean, _text string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, schema = [], True, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([*(batch.schema.field(n) for n in ("_conv", "_turn", "_role")), *_FIELDS, ("_part", pa.int32()), ("_open", pa.bool_()), ("_text", pa.string())])
            done = []
            for row in batch.to_pylist():
                if held and row["_conv"] != held[0]["_conv"]:
                    done += finish(held, first)
                    held, first = [], False
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(finish(held, True), schema=schema)

    def finish(rows: list[dict], is_open: bool) -> list[dict]:
        if is_open:  # may go on in a neighbouring partition
            return [r | {"seq": i, "_open": True} for i, r in enumerate(rows)]
        made = repair([r["_role"] for r in rows], [r["_text"] for r in rows])
        return [r | m | {"seq": i, "_open": False, "_text": None} for i, (r, m) in enumerate(zip(rows, made, strict=True))]

    placed = written(dealt.mapInArrow(stream, shape), "chats")
    open_rows = placed.filter("_open").select("_conv", "_turn", "_role", "_text", "seq", "_part")
    conv = kinds["_conv"]

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        matrix = [x for row in cost_matrix([role_number(r) for r in rows["_role"].to_pylist()]) for x in row]
        return pa.table([rows["_conv"].slice(0, 1), rows["_part"].slice(0, 1), pa.array([rows.num_rows], pa.int64()), pa.array([matrix], pa.list_(pa.float64()))], names=["_conv", "_part", "n", "matrix"])

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_part")
        matrices = [[m[i * 4 : i * 4 + 4] for i in STATES] for m in rows["matrix"].to_pylist()]
        cost, back = [0.0 if a == START else INF for a in STATES], []
        for m in matrices:
            came = [min(STATES, key=lambda a: (cost[a] + m[a][b], a)) for b in STATES]  # noqa: B023
            cost = [cost[came[b]] + m[came[b]][b] for b in STATES]
            back.append(came)
        at, ends = min(STATES, key=lambda b: (cost[b] + FINAL[b][0], b)), []
        for came in reversed(back):
            ends.append((came[at], at))
            at = came[at]
        ends.reverse()
        n = rows["n"].to_numpy()
        last = [i == len(ends) - 1 for i in range(len(ends))]
        return pa.table([rows["_conv"], rows["_part"], pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32()), pa.array(n.cumsum() - n), pa.array(last)], names=["_conv", "_part", "entry", "leave", "before", "last"])

    cuts = open_rows.groupBy("_conv", "_part").applyInArrow(summed, f"_conv {conv}, _part int, n long, matrix array<double>")
    states = written(cuts.groupBy("_conv").applyInArrow(joined, f"_conv {conv}, _part int, entry int, leave int, before long, last boolean"), "cuts")
    facing = open_rows.join(states.withColumnRenamed("_conv", "_c").withColumnRenamed("_part", "_p"), F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        entry, leave, before, last = (rows[c][0].as_py() for c in ("entry", "leave", "before", "last"))
        made = rendered(rows["_text"].to_pylist(), best_path([role_number(r) for r in rows["_role"].to_pylist()], entry, leave), entry, last)
        found = [m | {"seq": before + i} for i, m in enumerate(made)]
        out = pa.Table.from_pylist(found, schema=pa.schema(_FIELDS))
        return pa.table([*(rows[c] for c in ("_conv", "_turn", "_role")), *out.columns], names=["_conv", "_turn", "_role", *out.column_names])

    crossed = facing.groupBy("_conv", "_part").applyInArrow(solve, f"{own}, {FIELDS}")
    inside = placed.filter("not _open").select(crossed.columns)
    return inside.unionByName(crossed).withColumnsRenamed({"_conv": conv_col, "_turn": turn_col, "_role": role_col})
