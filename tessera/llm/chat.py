"""Chat formatting by minimum-cost role repair.

A conversation is legal if it reads [system] (user assistant)+. Each turn may be kept,
relabelled, or merged into the turn before it, and empty turns may be inserted. Dynamic
programming over the automaton of the last turn's role finds the cheapest repair.

One turn's choices are a 4 x 4 matrix of costs between states, and a stretch of turns is the
min-plus product of its turns' matrices. Turns are therefore dealt out by ranges of
(conversation, turn), however long a conversation is: each range tells the driver the products
for the conversations at its two edges (two small matrices per range), the driver chains
them and fixes the states in which each range is entered and left, and each range then repairs
its stretch by itself. Only conversations that cross ranges are chained.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
FOREVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


#: From each state, the states that one more turn may lead to.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _inserted(costs: Costs) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(from, to, cost, inserted empty turns) with at most two insertions."""
    out = []
    for s in FOLLOWS:
        out.append((s, s, 0, ()))
        for t in FOLLOWS[s]:
            if t != SYSTEM:
                out.append((s, t, costs.insert, (t,)))
                out += [(s, u, 2 * costs.insert, (t, u)) for u in FOLLOWS[t]]
    return out


def steps(costs: Costs) -> dict[int, list[list[tuple]]]:
    """By role (0: none of the three), state before and state after: (cost, inserted turns, merged, relabelled). First of the cheapest, in a fixed order."""
    out = {}
    for role in range(4):
        table = [[(FOREVER, (), False, False)] * 4 for _ in range(4)]
        for s, mid, cost, turns in _inserted(costs):
            for t in (SYSTEM, USER, ASSISTANT):
                change = costs.relabel * (t != role)
                if t in FOLLOWS[mid]:
                    option = (cost + change, turns, False, t != role)
                elif t == mid:
                    option = (cost + change + costs.merge, turns, True, t != role)
                else:
                    continue
                if option[0] < table[s][t][0]:
                    table[s][t] = option
        out[role] = table
    return out


def closing(costs: Costs) -> list[tuple[int, tuple[int, ...]]]:
    """By last state: what it takes to end."""
    return [(0, ()), (2 * costs.insert, (USER, ASSISTANT)), (costs.insert, (ASSISTANT,)), (0, ())]


def product(roles: list[int], table: dict) -> np.ndarray:
    """Costs from each state to each state over a stretch of turns."""
    m = np.full((4, 4), FOREVER, np.int64)
    np.fill_diagonal(m, 0)
    one = {r: np.array([[table[r][s][t][0] for t in range(4)] for s in range(4)], np.int64) for r in set(roles)}
    for r in roles:
        m = np.minimum((m[:, :, None] + one[r][None]).min(axis=1), FOREVER)
    return m


def repair(roles: list[int], table: dict, ends: list, entry: int = START, leave: int | None = None) -> tuple[list[tuple], int]:
    """For each turn (state after, inserted turns before, merged, relabelled), and the last state. leave: the state to end in; None ends the conversation."""
    best = [FOREVER] * 4
    best[entry] = 0
    back = []
    for r in roles:
        now, via = [FOREVER] * 4, [0] * 4
        for t in (SYSTEM, USER, ASSISTANT):
            for s in range(4):
                c = best[s] + table[r][s][t][0]
                if c < now[t]:
                    now[t], via[t] = c, s
        back.append(via)
        best = now
    last = leave if leave is not None else min(range(4), key=lambda s: (best[s] + ends[s][0], s))
    out, t = [], last
    for r, via in zip(reversed(roles), reversed(back), strict=True):
        s = via[t]
        out.append((t, *table[r][s][t][1:]))
        t = s
    return out[::-1], last


def _edges(rows: list, table: dict, ends: list) -> dict[int, list[tuple]]:
    """By range: for its first and last conversation (entry, leave, begins here, ends here). rows: in order of the ranges."""
    chains: list[list[tuple[int, int, list]]] = []
    for r in rows:
        first = (r["part"], 0, r["first_costs"])
        if chains and r["opens"] and chains[-1]:
            chains[-1].append(first)
        else:
            chains.append([first])
        if not r["single"]:
            chains.append([(r["part"], 1, r["last_costs"])])
    out: dict[int, list] = {}
    for chain in chains:
        costs, before = np.array([0, FOREVER, FOREVER, FOREVER]), []
        for _, _, m in chain:
            before.append(costs)
            costs = np.minimum((costs[:, None] + np.array(m).reshape(4, 4)).min(axis=0), FOREVER)
        leave = min(range(4), key=lambda s: (int(costs[s]) + ends[s][0], s))
        for k in range(len(chain) - 1, -1, -1):
            part, which, m = chain[k]
            entry = int(np.argmin(before[k] + np.array(m).reshape(4, 4)[:, leave]))
            out.setdefault(part, [None, None])[which] = (entry, leave, k == 0, k == len(chain) - 1)
            leave = entry
    return out


SCHEMA = "conv_id long, pos long, turn long, action string, role string, cost long, piece string"


def format_chats(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations of turns(conv_id, turn, role, text): a row for each turn and each inserted one.

    Columns: conv_id, pos (ascending in a conversation), turn (null if inserted), action (keep,
    relabel, merge, relabel+merge or insert), role after the repair, cost, and piece. The pieces of a
    conversation in order of pos, one after the other, are its rendered text:
    ``<|role|>\\ntext<|end|>\\n`` for each turn, merged texts being joined by a line break.

    Turns are taken in ascending order, null ones first; equal ones by role and text, so
    repeated rows are turns of their own. A null text is empty; a null or unknown role
    is relabelled. Null conv_ids are one conversation. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = turns.sparkSession
    uri = shared_dir(spark, "chat")
    table, ends = steps(costs), closing(costs)
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(*(F.when(F.col("role") == r, k + 1) for k, r in enumerate(ROLES)), F.lit(0)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("role", "text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("text")]
    dealt = clean.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    dealt = materialize(dealt, f"{uri}/dealt")

    def stretches(t: pa.Table) -> tuple[pa.Table, list, np.ndarray]:
        t = t.sort_by("seq")
        conv = t.column("conv_id").to_pylist()
        cut = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        return t, conv, np.array(cut)

    def tell(t: pa.Table) -> pa.Table:
        t, conv, cut = stretches(t)
        roles = t.column("role").to_pylist()
        ends_of = [(0, int(cut[1])), (int(cut[-2]), len(conv))]
        m = [product(roles[i:j], table).ravel().tolist() for i, j in ends_of]
        return pa.table({
            "part": pa.array([t.column("part")[0].as_py()], pa.int32()), "first_conv": pa.array([conv[0]], pa.int64()), "last_conv": pa.array([conv[-1]], pa.int64()),
            "single": [len(cut) == 2], "first_costs": pa.array([m[0]], pa.list_(pa.int64())), "last_costs": pa.array([m[1]], pa.list_(pa.int64())),
        })

    told = dealt.select("conv_id", "role", "part", "seq").groupBy("part").applyInArrow(tell, "part int, first_conv long, last_conv long, single boolean, first_costs array<bigint>, last_costs array<bigint>")
    rows, before = [], None
    for r in sorted(told.collect(), key=lambda r: r["part"]):
        rows.append(r.asDict() | {"opens": before is not None and before["last_conv"] == r["first_conv"]})
        before = r
    edges = _edges(rows, table, ends)

    def write(t: pa.Table) -> pa.Table:
        t, conv, cut = stretches(t)
        part = t.column("part")[0].as_py()
        roles, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
        turn, seq = t.column("turn").to_pylist(), t.column("seq").to_pylist()
        out: list[tuple] = []

        def insert(c, at: int, k: int, role: int, opened: bool, end: bool) -> None:
            out.append((c, (at << 3) + k, None, "insert", ROLES[role - 1], costs.insert, ("<|end|>\n" if opened else "") + f"<|{ROLES[role - 1]}|>\n" + ("<|end|>\n" if end else "")))

        for n, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            entry, leave, begins, finishes = START, None, True, True
            if n == 0 or n == len(cut) - 2:
                entry, leave, begins, finishes = edges[part][0 if n == 0 else 1]
            done, last = repair(roles[i:j], table, ends, entry, leave)
            tail = ends[last][1] if finishes else ()
            opened = not begins
            for k, (state, turns_before, merged, changed) in enumerate(done):
                for e, r in enumerate(turns_before):
                    insert(conv[i], seq[i + k], e, r, opened, False)
                    opened = True
                action = "+".join(["relabel"] * changed + ["merge"] * merged) or "keep"
                piece = ("\n" if merged else ("<|end|>\n" if opened else "") + f"<|{ROLES[state - 1]}|>\n") + texts[i + k]
                opened = True
                if finishes and not tail and k == j - i - 1:
                    piece += "<|end|>\n"
                out.append((conv[i], (seq[i + k] << 3) + 3, turn[i + k], action, ROLES[state - 1], costs.relabel * changed + costs.merge * merged, piece))
            for e, r in enumerate(tail):
                insert(conv[i], seq[j - 1], 4 + e, r, True, e == len(tail) - 1)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.groupBy("part").applyInArrow(write, SCHEMA)
