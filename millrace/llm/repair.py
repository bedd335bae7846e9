"""Repair of conversation structure by a run-length dynamic program.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Reading it goes
through four states: nothing yet, after the system turn, after a user turn, after an
assistant turn; it may end in the first and the last. Each row is one of ten symbols
(its initial, and whether it is truncated or has to go), and a symbol is a 4 x 4
min-plus matrix: what the cheapest edits cost from one state to another. Equal
consecutive symbols are one run, and a run of n rows is advanced by the binary powers
of its matrix, which are kept for all conversations. Costs are advanced from the end
to the start; going forward again, the least letter that keeps the cost is the audit,
so of equally cheap audits the least in ASCII comes out.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation that
holds a third of all rows spans many partitions. A conversation inside one partition
is decided there, in one pass. For one that crosses a partition's edge each part
gives its costs between every two states and the order of its audits; one row a part
decides the states between the parts, and then each part writes its own audit and
texts. Rows equal in all columns are counted before they are dealt.

Defined results: a null role or text is one space, as is a null id or turn in the
damage's hash; a null ``conv_id`` is a conversation like any other; turns that are
null come first; rows of one turn are ordered by role, then text, and repeats follow
each other; a conversation without rows after damage has zeros, no audit and the hash
of an empty text; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
NEVER = 1 << 60
#: The state behind a turn with this initial, by the state before it.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that may follow each state besides the system turn: what an insertion or a new role puts there.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Costs at the end of a conversation.
END = (0, NEVER, NEVER, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}

Symbol = tuple[str, bool, bool]  # initial, must be deleted, truncated
Costs = tuple[int, int, int, int]
Matrix = tuple[Costs, Costs, Costs, Costs]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(STATES)), NEVER) for j in range(STATES)) for i in range(STATES))


def before(m: Matrix, costs: Costs) -> Costs:
    """Costs from each state before a step, given those behind it."""
    return tuple(min(min(m[i][j] + costs[j] for j in range(STATES)), NEVER) for i in range(STATES))


@cache
def insertions() -> Matrix:
    """Costs of insertions alone."""
    rows = []
    for i in range(STATES):
        row, at, cost = [NEVER] * STATES, i, 0
        while cost < row[at]:
            row[at] = cost
            at, cost = NEXT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def row_options(state: int, symbol: Symbol) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row itself, least letter first."""
    initial, gone, truncated = symbol
    out = [("D", DELETE, state)]
    if not gone:
        extra = TRUNCATED if truncated else 0
        if state in AFTER.get(initial, {}):
            out.append(("K", extra, AFTER[initial][state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


@cache
def power(symbol: Symbol, exponent: int) -> Matrix:
    """The matrix of 2 ** ``exponent`` rows of a symbol, insertions before each included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    step = [[NEVER] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for _, cost, to in row_options(i, symbol):
            step[i][to] = min(step[i][to], cost)
    return times(insertions(), tuple(map(tuple, step)))


def advanced(symbol: Symbol, count: int, costs: Costs) -> Costs:
    """Costs before a run of ``count`` rows, given those behind it."""
    exponent = 0
    while count:
        if count & 1:
            costs = before(power(symbol, exponent), costs)
        count >>= 1
        exponent += 1
    return costs


def collapse(rows: list[tuple[Symbol, int]]) -> list[tuple[Symbol, int]]:
    """Runs of equal consecutive symbols."""
    runs: list[tuple[Symbol, int]] = []
    for symbol, count in rows:
        if runs and runs[-1][0] == symbol:
            runs[-1] = symbol, runs[-1][1] + count
        elif count:
            runs.append((symbol, count))
    return runs


def unrolled(runs: list[tuple[Symbol, int]], state: int, end: Costs) -> tuple[list[str], int]:
    """The edits of the runs' rows from a state on, each row's letters up to its own, and the state reached.

    ``end`` are the costs behind the runs. A long run is halved by its powers until
    its parts are short, so that costs are held for few rows at a time.
    """
    stack, costs = [], end
    for symbol, count in reversed(runs):
        stack.append((symbol, count, costs))
        costs = advanced(symbol, count, costs)
    letters: list[str] = []
    while stack:
        symbol, count, behind = stack.pop()
        if count > 64:
            half = count // 2
            stack += [(symbol, half, behind), (symbol, count - half, advanced(symbol, half, behind))]
            continue
        after = [behind]
        for _ in range(count - 1):
            after.append(before(power(symbol, 0), after[-1]))
        while after:
            behind = after.pop()
            left = before(power(symbol, 0), behind)[state]
            edits = ""
            while True:
                options = [(x, c, c + behind[to], to) for x, c, to in row_options(state, symbol)]
                options.append(("I", INSERT, INSERT + before(power(symbol, 0), behind)[NEXT[state]], NEXT[state]))
                letter, cost, _, to = min(o for o in options if o[2] == left)
                edits, state, left = edits + letter, to, left - cost
                if letter != "I":
                    break
            letters.append(edits)
    return letters, state


def ending(state: int) -> str:
    """Insertions behind the last row."""
    return "" if END[state] == 0 else "I" * (insertions()[state][ASSISTANT] // INSERT)


def end_costs() -> Costs:
    return before(insertions(), END)


def texts_of(rows: list[tuple[str, str]], letters: list[str], state: int, last: str) -> Iterator[bytes]:
    """The repaired ``role:text`` of each turn that the edits leave or make; ``rows`` has one entry for each element of ``letters``."""
    for (role, text), edits in zip(rows, letters, strict=True):
        for letter in edits:
            if letter == "D":
                continue
            keeps = letter == "K"
            state = AFTER[role[:1]][state] if keeps else NEXT[state]
            yield b"%s:%s" % ((role if keeps else NAMES[state]).encode(), b"" if letter == "I" else text.encode())
    for _ in last:
        state = NEXT[state]
        yield b"%s:" % NAMES[state].encode()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``n``: the rows as damaged; a dropped row stays with ``n`` = 0 and no text."""
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    changed = F.when(h <= 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(conv.alias("conv_id"), turn.alias("turn"), F.when(h == 0, "").when(h == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long").alias("n"))


def as_rows(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("long").alias("n"))


KEYS = ["conv_known", "conv", "turn_known", "turn_key", "k1", "k2"]


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``n``, ``blank``, ``truncated`` and ``first``: no row of an earlier turn has the same role and text.

    The first turns of all (conversation, role, text) are found from hashes alone and
    go into the same aggregate as the rows, so texts are dealt once for it and no join
    is needed.
    """
    zero = F.lit(0).cast("long")
    keyed = rows.select(
        F.col("conv_id").isNotNull().alias("conv_known"), F.coalesce("conv_id", zero).alias("conv"), F.col("turn").isNotNull().alias("turn_known"), F.coalesce("turn", zero).alias("turn_key"),
        F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", F.lit(1), "role").alias("k2"), "role", "text", "n",
    )
    at = F.min(F.struct("turn_known", "turn_key")).alias("at")
    firsts = keyed.where("n > 0").groupBy("conv_known", "conv", "k1", "k2").agg(at)
    none = F.lit(None).cast("string")
    markers = firsts.select("conv_known", "conv", "at.turn_known", "at.turn_key", "k1", "k2", none.alias("role"), none.alias("text"), zero.alias("n"), F.lit(1).alias("mark"))
    both = keyed.withColumn("mark", F.lit(0)).unionByName(markers)
    found = both.groupBy(*KEYS).agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("n").alias("n"), (F.max("mark") == 1).alias("first"))
    trimmed = F.rtrim("text", F.lit(BLANK))
    return found.withColumns({"blank": trimmed == "", "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})


ROW = pa.struct([
    ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("first", pa.bool_()), ("blank", pa.bool_()), ("truncated", pa.bool_()),
])
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DONE = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
PARTS = DONE + ", part int, rows array<struct<turn: long, role: string, text: string, n: long, first: boolean, blank: boolean, truncated: boolean>>"


def symbols_of(rows: list[dict]) -> list[tuple[Symbol, int]]:
    """One symbol for a row's first copy, one for its others, which have to go."""
    out = []
    for r in rows:
        gone = r["blank"] or not r["first"]
        initial = r["role"][:1]
        initial = initial if initial in AFTER else ""
        out.append((("", True, False) if gone else (initial, False, r["truncated"]), 1))
        out.append((("", True, False), r["n"] - 1))
    return out


def copies(rows: list[dict]) -> Iterator[tuple[str, str]]:
    for r in rows:
        for _ in range(r["n"]):
            yield r["role"], r["text"]


def legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au") and len(one) == 1


def counted(rows: list[dict]) -> dict[str, int]:
    """The rows' faults and illegal neighbours, and the number of their distinct known turns with the first and last."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    last = None
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    for r in rows:
        n, initial = r["n"], r["role"][:1]
        if r["blank"]:
            out["blank"] += n
        else:
            out["duplicate"] += n - 1 if r["first"] else n
            out["truncated"] += bool(r["first"] and r["truncated"])
        out["illegal"] += (n - 1) + (last is not None and not legal(last, initial))
        last = initial
    return out | {"turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return high - low + 1 - turns if turns else 0


def decided(rows: list[dict]) -> tuple[list[int], str, str]:
    """Counts and cost, audit and hash of a whole conversation."""
    rows = [r for r in rows if r["n"]]
    c = counted(rows)
    runs = collapse(symbols_of(rows))
    letters, state = unrolled(runs, START, end_costs())
    costs = end_costs()
    for symbol, count in reversed(runs):
        costs = advanced(symbol, count, costs)
    last = ending(state)
    digest = hashlib.sha256()
    for i, line in enumerate(texts_of(list(copies(rows)), letters, START, last)):
        digest.update(b"\n" + line if i else line)
    numbers = [gaps(c["low"], c["high"], c["turns"]), c["blank"], c["duplicate"], c["truncated"], c["illegal"], costs[START]]
    return numbers, "".join(letters) + last, digest.hexdigest()


def read_parts(ranged: DataFrame) -> DataFrame:
    """Conversations inside a partition, decided; of a partition's first and last conversation the rows (``part`` is not null)."""

    def stream(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[dict] = []
        first = True
        done: list[list] = []

        def emit(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.int32(), pa.list_(ROW)]
            names = ["conv_id", *COUNTS, "audit", "repaired_sha256", "part", "rows"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def close(edge: bool) -> None:
            nonlocal held
            conv = held[0]["conv_id"]
            if edge:
                done.append([conv, *[None] * 8, part, [{k: v for k, v in r.items() if k != "conv_id"} for r in held]])
            else:
                numbers, audit, digest = decided(held)
                done.append([conv, *numbers, audit, digest, None, None])
            held = []

        for batch in found:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    close(first)
                    first = False
                held.append(row)
            if len(done) >= 256:
                yield emit(done)
                done = []
        if held:
            close(True)
        if done:
            yield emit(done)

    return ranged.mapInArrow(stream, PARTS)


SUMMARY = "conv_id long, part int, costs array<long>, ranks array<int>, head string, tail string, n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"


def summarise(parts: DataFrame) -> DataFrame:
    """Of each part of a conversation the costs between every two states, the order of its audits from each, and its counts."""

    def summary(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for row in batch.to_pylist():
                rows = [r for r in row["rows"] if r["n"]]
                runs = collapse(symbols_of(rows))
                costs, ranks = [], []
                for i in range(STATES):
                    audits = {}
                    for j in range(STATES):
                        target = tuple(0 if k == j else NEVER for k in range(STATES))
                        before_all = target
                        for symbol, count in reversed(runs):
                            before_all = advanced(symbol, count, before_all)
                        costs.append(before_all[i])
                        if before_all[i] < NEVER:
                            audits[j] = "".join(unrolled(runs, i, target)[0])
                    order = sorted(audits, key=audits.get)
                    ranks += [order.index(j) if j in audits else -1 for j in range(STATES)]
                c = counted(rows)
                head, tail = (rows[0]["role"][:1], rows[-1]["role"][:1]) if rows else (None, None)
                out.append({"conv_id": row["conv_id"], "part": row["part"], "costs": costs, "ranks": ranks, "head": head, "tail": tail, "n_rows": len(rows), **c})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", pa.int64()), ("part", pa.int32()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("head", pa.string()), ("tail", pa.string()), ("n_rows", pa.int64()),
                *[(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")],
            ]))

    return parts.select("conv_id", "part", "rows").mapInArrow(summary, SUMMARY)


ROUTE = "conv_id long, part int, enters int, leaves int, last_part boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def route(table: pa.Table) -> pa.Table:
    """The states between a conversation's parts, a row a part, and the counts of the whole."""
    parts = sorted(table.to_pylist(), key=lambda r: r["part"])
    matrices = [tuple(tuple(r["costs"][i * STATES : (i + 1) * STATES]) for i in range(STATES)) for r in parts]
    costs = [end_costs()]
    for m in reversed(matrices):
        costs.append(before(m, costs[-1]))
    costs.reverse()
    total = {x: sum(r[x] for r in parts) for x in ("blank", "duplicate", "truncated", "illegal", "turns")}
    state, out, tail, high = START, [], None, None
    for i, (r, m) in enumerate(zip(parts, matrices, strict=True)):
        best = [j for j in range(STATES) if m[state][j] < NEVER and m[state][j] + costs[i + 1][j] == costs[i][state]]
        leaves = min(best, key=lambda j: r["ranks"][state * STATES + j])
        out.append({"conv_id": r["conv_id"], "part": r["part"], "enters": state, "leaves": leaves, "last_part": i == len(parts) - 1})
        state = leaves
        if r["n_rows"]:
            total["illegal"] += tail is not None and not legal(tail, r["head"])
            tail = r["tail"]
        if r["turns"]:
            total["turns"] -= high == r["low"]
            high = r["high"]
    lows = [r["low"] for r in parts if r["turns"]]
    whole = {c: total.get(c, 0) for c in COUNTS} | {"gaps": gaps(min(lows, default=None), high, total["turns"]), "cost": costs[0][START]}
    kinds = [("conv_id", pa.int64()), ("part", pa.int32()), ("enters", pa.int32()), ("leaves", pa.int32()), ("last_part", pa.bool_()), *[(c, pa.int64()) for c in COUNTS]]
    return pa.Table.from_pylist([o | whole for o in out], pa.schema(kinds))


WRITTEN = "conv_id long, part int, " + ", ".join(f"{c} long" for c in COUNTS) + ", edits string, lines binary, n_lines long"


def write_parts(routed: DataFrame) -> DataFrame:
    """Each part's audit and repaired lines."""

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("conv_id", pa.int64()), ("part", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("edits", pa.string()), ("lines", pa.binary()), ("n_lines", pa.int64())]
        for batch in found:
            out = []
            for row in batch.to_pylist():
                rows = [r for r in row["rows"] if r["n"]]
                target = tuple(0 if k == row["leaves"] else NEVER for k in range(STATES))
                letters, state = unrolled(collapse(symbols_of(rows)), row["enters"], target)
                last = ending(state) if row["last_part"] else ""
                lines = list(texts_of(list(copies(rows)), letters, row["enters"], last))
                out.append({"conv_id": row["conv_id"], "part": row["part"], **{c: row[c] for c in COUNTS}, "edits": "".join(letters) + last, "lines": b"\n".join(lines), "n_lines": len(lines)})
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return routed.select("conv_id", "part", "rows", "enters", "leaves", "last_part", *COUNTS).mapInArrow(write, WRITTEN)


def joined_parts(written: DataFrame) -> DataFrame:
    """One row a conversation from its parts in order; a part's lines are hashed and let go."""

    def stream(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        open_row: list = []

        def close() -> pa.RecordBatch:
            conv, numbers, edits, digest, _ = open_row.pop()
            values = [conv, *numbers, "".join(edits), digest.hexdigest()]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in found:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if open_row and open_row[0][0] != row["conv_id"]:
                    yield close()
                if not open_row:
                    open_row.append([row["conv_id"], [row[c] for c in COUNTS], [], hashlib.sha256(), False])
                now = open_row[0]
                now[2].append(row["edits"])
                if row["n_lines"]:
                    now[3].update(b"\n" + row["lines"] if now[4] else row["lines"])
                    now[4] = True
        if open_row:
            yield close()

    return written.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(stream, DONE)


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and the repaired text's hash of each conversation of ``damage`` or ``as_rows``."""
    spark = rows.sparkSession
    order = ["conv_known", "conv", "turn_known", "turn_key", "role"]
    ranged = marked(rows).repartitionByRange(partitions(spark), *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    columns = [F.when(F.col("conv_known"), F.col("conv")).alias("conv_id"), F.when(F.col("turn_known"), F.col("turn_key")).alias("turn"), "role", "text", "n", "first", "blank", "truncated"]
    parts = cut(read_parts(ranged.select(*columns)))
    edges = parts.where("part is not null")
    routes = summarise(edges).groupBy("conv_id").applyInArrow(route, ROUTE).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enters", "leaves", "last_part", *COUNTS)
    # two rows a partition at most
    routed = edges.drop(*COUNTS).join(F.broadcast(routes), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    return parts.where("part is null").select(*columns).unionByName(joined_parts(write_parts(routed)).select(*columns))


def report(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations))

