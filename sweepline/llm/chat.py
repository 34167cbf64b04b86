"""Repairs the roles of conversations at least cost, then renders them.

Legal sequences: an optional system message, then user and assistant in turns, beginning with the
user and ending with the assistant. Dynamic programming over this automaton chooses for every
message whether to keep it, relabel it or merge it into the message before, and where to insert
empty messages, so that the sum of costs is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare, written
from .common import by_blocks

ROLES = ("system", "user", "assistant")
#: Names used for the same roles; they cost nothing. Any other name, and null, is unknown.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: State: role of the last message written, 3 at the start. After it may come:
NEXT = {3: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = 2
#: A known role is hardly ever relabelled: runs of one role are merged however long they are.
COSTS = {"merge": 2, "relabel": 7, "insert": 4, "unknown": 1, "move_merge": 9}


def role_code(role: str | None) -> int:
    """0, 1, 2 for the roles, 3 for an unknown one."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _label_cost(have: int, want: int) -> int:
    return 0 if have == want else COSTS["unknown"] if have == 3 else COSTS["relabel"]


def _inserts() -> dict[int, list[tuple[int, tuple[int, ...]]]]:
    """From each state: the states reachable by inserting empty messages, and which."""
    out = {}
    for s in range(4):
        best = {s: ()}
        front = [s]
        while front:
            front = [t for f in front for t in NEXT[f] if t not in best and not best.update({t: (*best[f], t)})]
        out[s] = sorted(best.items(), key=lambda x: (len(x[1]), x[1]))
    return out


INSERTS = _inserts()


Key = tuple[int, int, int, int]  # cost, insertions, changes, messages: compared in this order, added up along a path


def _add(a: Key, b: Key) -> Key:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def forward(codes: tuple[int, ...], start: int) -> tuple[dict[int, Key], list[dict[int, tuple]]]:
    """From a state: the least key of ending in each state, and per position and state (state before, inserted, action)."""
    best: dict[int, Key] = {start: (0, 0, 0, 0)}
    back: list[dict[int, tuple]] = []
    for have in codes:
        now: dict[int, Key] = {}
        how: dict[int, tuple] = {}
        for s in sorted(best):
            options = []
            if s != 3:
                options.append((s, (), "merge", (COSTS["merge"] if have == s else COSTS["move_merge"], 0, 1, 0)))
            for via, inserted in INSERTS[s]:
                k = len(inserted)
                for t in NEXT[via]:
                    options.append((t, inserted, "keep" if have == t else "relabel", (k * COSTS["insert"] + _label_cost(have, t), k, int(have != t), k + 1)))
            for t, inserted, action, more in options:
                key = _add(best[s], more)
                if t not in now or key < now[t]:
                    now[t], how[t] = key, (s, inserted, action)
        best = now
        back.append(how)
    return best, back


def closing(state: int) -> tuple[Key, tuple[int, ...]]:
    """What it takes to end in FINAL: the key, and the messages to insert."""
    inserted = dict(INSERTS[state])[FINAL]
    k = len(inserted)
    return (k * COSTS["insert"], k, 0, k), inserted


def path(codes: tuple[int, ...], start: int, end: int, last: bool, number: int = -1) -> list[tuple[int | None, int, int, str]]:
    """The cheapest plan from one state to another: (position or None, number of the output message, role, action).

    number is that of the message before; last adds the messages that close the conversation.
    """
    _, back = forward(codes, start)
    steps, state = [], end
    for i in range(len(codes) - 1, -1, -1):
        before, inserted, action = back[i][state]
        steps.append((i, state, inserted, action))
        state = before
    plan = []
    for i, role, inserted, action in reversed(steps):
        for r in inserted:
            number += 1
            plan.append((None, number, r, "insert"))
        number += action != "merge"
        plan.append((i, number, role, action))
    for r in closing(end)[1] if last else ():
        number += 1
        plan.append((None, number, r, "insert"))
    return plan


def route(parts: list[dict[int, dict[int, Key]]]) -> tuple[int, list[tuple[int, int, int]]]:
    """(cost, [(entry, exit, messages before)]) over the parts of one conversation.

    A part gives, for each state that it may be entered in, the least key of each state to end in.
    Keys to go are added up from the end, then the parts are passed through from the front.
    """
    to_go = [{t: closing(t)[0] for t in range(4)}]
    for m in reversed(parts[1:]):
        to_go.append({s: min(_add(k, to_go[-1][t]) for t, k in ends.items()) for s, ends in m.items()})
    state, got, total = 3, [], (0, 0, 0, 0)
    for m, after in zip(parts, reversed(to_go), strict=True):
        key, end = min((_add(k, after[t]), t) for t, k in m[state].items())
        got.append((state, end, total[3]))
        total, state = _add(total, m[state][end]), end
    return _add(total, closing(state)[0])[0], got


def repair(codes: list[int]) -> tuple[int, list[tuple[int | None, int, int, str]]]:
    """(cost, plan) of a conversation's role codes.

    plan: (position of the input message or None, number of the output message, its role, action),
    actions keep, relabel, merge and insert. Of equally cheap plans the one is taken that inserts
    less, then keeps more, then has fewer messages, then takes roles in the order of ROLES. No
    messages give no messages.
    """
    if not codes:
        return 0, []
    cost, [(start, end, _)] = route([{3: forward(tuple(codes), 3)[0]}])
    return cost, path(tuple(codes), start, end, last=True)


def repaired_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_rows: int = 4096) -> DataFrame:
    """One row per message of the repaired conversations.

    Columns: conv_id, message (0, 1, ...), role, text, n_parts (input messages in it; 0 for an
    inserted one), n_relabelled, cost (of the conversation), rendered. Turns are ordered by turn
    (nulls last), ties by role and then by text, the latter by its hash; repeated rows are messages
    like any other. A null text is
    an empty one; texts of merged messages are joined by a blank line, empty ones left out. An
    unknown or null role is given one. Rows with a null conv_id belong to no conversation and
    come out one by one, as message 0 of conv_id null, with their role, or 'user' if unknown. Other columns are
    not read. An empty table gives no rows.

    No task holds a conversation: rows are numbered by ranges of the sorted table, and a
    conversation is cut into parts of part_rows messages. Of each part the costs between any two
    states are found, these small tables are chained per conversation, and each part is then
    planned by itself between the states chosen. Texts are joined to the plan by row and meet only
    in the message into which they are merged.
    """
    spark = prepare(messages.sparkSession)
    src = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = messages.schema[conv_col].dataType.simpleString()
    names = [*ROLES, *ALIASES]
    codes = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(role_code(n)))])
    code = F.coalesce(codes[F.lower(F.trim("role"))], F.lit(3))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.where("conv_id is not null").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # row numbers in ascending order, and the range that a row is in; they hold once they are written
    whole = written(ranged.select("conv_id", code.alias("code"), "text", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("range")))
    held = whole.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a range
    held = held.select("conv_id", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    place = F.col("row") + F.col("shift")
    placed = written(whole.select("conv_id", "range", "row", "code").join(held, ["conv_id", "range"]).select("conv_id", F.floor(place / part_rows).alias("part"), "row", "code"))

    def costs(t: pa.Table) -> dict:
        part = t["part"][0].as_py()
        c, table = _codes(t), []
        for start in (3,) if part == 0 else (0, 1, 2):
            table += [x for end, key in _ends(c, start).items() for x in (start, end, *key)]
        return {"conv_id": [t["conv_id"][0].as_py()], "part": [part], "table": [table]}

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "part", "entry", "exit", "before", "last", "cost")}
            for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tables = []
                for p in parts:
                    m: dict[int, dict[int, Key]] = {}
                    for i in range(0, len(p["table"]), 6):
                        start, end, *key = p["table"][i : i + 6]
                        m.setdefault(start, {})[end] = tuple(key)
                    tables.append(m)
                cost, got = route(tables)
                for p, (start, end, before) in zip(parts, got, strict=True):
                    for k, v in zip(out, (conv, p["part"], start, end, before, p is parts[-1], cost), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], b.schema.field(0).type), *(pa.array(out[k], pa.int64()) for k in ("part", "entry", "exit", "before")), pa.array(out["last"], pa.bool_()), pa.array(out["cost"], pa.int64())], names=list(out))

    def plans(t: pa.Table) -> dict:
        t = t.sort_by("row")
        one = lambda c: t[c][0].as_py()
        plan = path(tuple(t["code"].to_pylist()), one("entry"), one("exit"), one("last"), one("before") - 1)
        rows, n = t["row"].to_pylist(), len(plan)
        cols = list(zip(*plan, strict=True))
        return {"conv_id": [one("conv_id")] * n, "row": [None if i is None else rows[i] for i in cols[0]], "message": cols[1], "code": cols[2], "action": cols[3], "cost": [one("cost")] * n}

    tables = by_blocks(placed, ["conv_id", "part"], costs, f"conv_id {kind}, part long, table array<long>", least=1)
    chained = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "table"))).alias("parts"))
    chosen = map_arrow(chained, chain, f"conv_id {kind}, part long, entry long, exit long, before long, last boolean, cost long")
    plan = written(by_blocks(placed.join(chosen, ["conv_id", "part"]), ["conv_id", "part"], plans, f"conv_id {kind}, row long, message long, code long, action string, cost long", least=1))
    # inserted messages have no row: they stay out of the join, where null would be a hot key
    met = plan.join(whole.select("row", "text"), "row").unionByName(plan.where("row is null"), allowMissingColumns=True)
    parts = F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "text"))))
    done = met.groupBy("conv_id", "message", "code", "cost").agg(parts.alias("parts"), F.count_if(F.col("action") == "relabel").alias("n_relabelled"), F.count("row").alias("n_parts"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("code") + 1).cast("int"))
    done = done.select("conv_id", F.col("message").cast("int").alias("message"), role.alias("role"), text.alias("text"), "n_parts", "n_relabelled", "cost")
    loose = src.where("conv_id is null").select("conv_id", F.lit(0).alias("message"), F.when(code < 3, F.element_at(F.array(*map(F.lit, ROLES)), code + 1)).otherwise("user").alias("role"), "text", F.lit(1).cast("long").alias("n_parts"), F.lit(0).cast("long").alias("n_relabelled"), F.lit(0).cast("long").alias("cost"))
    return done.unionByName(loose).withColumn("rendered", render_message(F.col("role"), F.col("text")))


def _codes(t: pa.Table) -> tuple[int, ...]:
    return tuple(t.sort_by("row")["code"].to_pylist())


@lru_cache(20_000)
def _ends_of_few(codes: tuple[int, ...], start: int) -> dict[int, Key]:
    return forward(codes, start)[0]


def _ends(codes: tuple[int, ...], start: int) -> dict[int, Key]:
    return _ends_of_few(codes, start) if len(codes) <= 32 else forward(codes, start)[0]


def render_message(role, text):
    """The message in the common im_start / im_end form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render_conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, n_messages, rendered): whole conversations as one text each, from repaired_messages()."""
    parts = F.array_sort(F.collect_list(F.struct("message", "rendered")))
    return repaired.where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("rendered"))
