"""Repair of conversations to legal turns at the least cost, and their rendering.

The automaton of legal turns: a system turn may come first; then user and assistant take turns,
the user first; an assistant ends. What may be done to a turn, and what it costs, is in ACTIONS. A
turn thus maps the automaton's states to states at some cost, and such maps compose (by least sums)
in any grouping. So a conversation, however long, is cut into blocks of turns: each block's map is
computed on its own, the maps of a conversation's blocks are chained, and with the states between
blocks known each block finds its own least-cost actions. No task holds more than a block of turns
and the small maps of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BLOCK = 4096
ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
STATES = ("start", *ROLES)
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Costs of what is done to a turn; an insertion comes on top, before the turn.
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
FAR = 10**12
#: The rendered turn: opening with the role, text, closing. A merged text follows the last one of its turn.
OPEN, CLOSE, GLUE = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _moves(role: str | None) -> list[list[tuple[int, str, tuple[str, ...]] | None]]:
    """moves[state][state after] = cost, action, roles of turns inserted before; the first of the cheapest."""
    out: list[list] = [[None] * len(STATES) for _ in STATES]

    def offer(s: int, role_after: str, cost: int, action: str, inserted: tuple[str, ...]) -> None:
        t = STATES.index(role_after)
        if out[s][t] is None or cost < out[s][t][0]:
            out[s][t] = (cost, action, inserted)

    for s, state in enumerate(STATES):
        for target in NEXT[state]:
            offer(s, target, KEEP if target == role else RELABEL, "keep" if target == role else "relabel", ())
        if state != "start":
            offer(s, state, MERGE if state == role else MERGE + RELABEL, "merge" if state == role else "relabel_merge", ())
        for between in NEXT[state]:
            for target in NEXT[between]:
                offer(s, target, INSERT + (KEEP if target == role else RELABEL), "keep" if target == role else "relabel", (between,))
    return out


MOVES = {role: _moves(role) for role in (*ROLES, None)}
#: What it takes to end in each state, and the turns inserted for it.
ENDINGS = {"start": (0, ()), "system": (2 * INSERT, ("user", "assistant")), "user": (INSERT, ("assistant",)), "assistant": (0, ())}


def _step(costs: list[int], role: str | None) -> tuple[list[int], list[int]]:
    """Least costs after a turn, and the states before that they come from; ties to the first state."""
    moves, out, back = MOVES[role], [FAR] * len(STATES), [0] * len(STATES)
    for s, cost in enumerate(costs):
        for t, move in enumerate(moves[s]):
            if move and cost + move[0] < out[t]:
                out[t], back[t] = cost + move[0], s
    return out, back


def _from(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(len(STATES))]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows come sorted by their first columns; one group at a time."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _emit(held, schema)
            held = []
    if held:
        yield _emit(held, schema)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv, block), group in _grouped(batches, 2):
            costs = [_from(s) for s in range(len(STATES))]
            for row in group:
                costs = [_step(c, row[2])[0] for c in costs]
            yield conv, block, [min(x, FAR) for c in costs for x in c]

    yield from _batched(rows(), pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("map", pa.list_(pa.int64()))]))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the states before and after it on the cheapest way through all blocks."""

    def rows() -> Iterator[tuple]:
        n = len(STATES)
        for (conv,), group in _grouped(batches, 1):
            costs, backs = _from(0), []
            for row in group:
                then, back = [FAR] * n, [0] * n
                for s in range(n):
                    for t in range(n):
                        if costs[s] + row[2][s * n + t] < then[t]:
                            then[t], back[t] = costs[s] + row[2][s * n + t], s
                costs = then
                backs.append(back)
            state = min(range(n), key=lambda t: costs[t] + ENDINGS[STATES[t]][0])
            total, out = costs[state] + ENDINGS[STATES[state]][0], []
            for k in range(len(group) - 1, -1, -1):
                before = backs[k][state]
                out.append((conv, group[k][1], before, state, k == len(group) - 1, total))
                state = before
            yield from out

    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])
    yield from _batched(rows(), schema)


OUT = "conv long, place long, turn long, role string, new_role string, action string, rendered string, cost long"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv, block), group in _grouped(batches, 2):
            enter, leave, last, total = group[0][6:]
            costs, backs = _from(enter), []
            for row in group:
                costs, back = _step(costs, row[2])
                backs.append(back)
            states = [leave]
            for back in reversed(backs):
                states.append(back[states[-1]])
            states.reverse()
            place = block << 32
            for k, row in enumerate(group):
                before, after = states[k], states[k + 1]
                _, action, inserted = MOVES[row[2]][before][after]
                merged, out = action.endswith("merge"), ""
                if before and not merged:
                    out = CLOSE
                for role in inserted:
                    yield conv, place, row[3], None, role, "insert", out + OPEN.format(role), total
                    place, out = place + 1, CLOSE
                out += (GLUE if merged else OPEN.format(STATES[after])) + row[5]
                yield conv, place, row[3], row[4], STATES[after], action, out, total
                place += 1
            if last:
                for role in ENDINGS[STATES[leave]][1]:
                    yield conv, place, None, None, role, "insert", CLOSE + OPEN.format(role), total
                    place += 1
                yield conv, place, None, None, None, "end", CLOSE, total

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = ("conv", "place", "turn", "role", "new_role", "action", "rendered", "cost")
    yield from _batched(rows(), pa.schema(list(zip(names, kinds, strict=True))), 512)


def _sorted(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def repair_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The pieces of the repaired conversations: conv, place, turn, role, new_role, action, rendered, cost.

    A conversation's rendered pieces in order of place, joined, are its text. Turns go by turn
    number, nulls first, then role and text; rows that repeat one another are one turn. Roles are
    compared in lower case and trimmed; null and other roles must be relabelled. A null text is
    empty. Rows with a null conversation are one conversation. Of equally cheap repairs the one
    that prefers earlier states (start, system, user, assistant), from the end, is taken. An empty
    table gives an empty result. Ids and turns are whole numbers; other columns are not read.
    """
    role = F.lower(F.trim(F.col(role_col)))
    # A piece's place has its block above the lower 32 bits: null turns have the first block, those far out the outermost.
    number = F.least(F.greatest(F.floor(F.col(turn_col) / block).cast("long"), F.lit(1 - (1 << 31))), F.lit((1 << 31) - 1))
    number = F.when(F.col(turn_col).isNull(), F.lit(-(1 << 31))).otherwise(number)
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"), number.cast("long").alias("block"),
        F.when(role.isin(*ROLES), role).alias("known"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("text"),
    ).distinct()
    then = ("turn", "role", "text")
    maps = _sorted(rows, "conv", "block", then=then).select("conv", "block", "known").mapInArrow(_maps, "conv long, block long, map array<long>")
    chain = _sorted(maps, "conv", then=("block",)).mapInArrow(_chain, "conv long, block long, enter int, leave int, last boolean, cost long")
    chain = chain.select(F.col("conv").alias("c"), F.col("block").alias("b"), "enter", "leave", "last", "cost")
    known = rows.join(chain, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    known = known.select("conv", "block", "known", "turn", "role", "text", "enter", "leave", "last", "cost")
    return _sorted(known, "conv", "block", then=then).mapInArrow(_repaired, OUT).withColumnRenamed("conv", conv_col)
