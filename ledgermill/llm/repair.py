"""Repair of the turn structure of conversations at least cost, by divide and conquer.

A repaired conversation has the roles of ``(s?(ua)+)?``: four states (nothing yet, after
system, after user, after assistant). Every row moves the state by zero or more inserted
turns and one edit of its own; a row, and any run of rows, is a table of least costs from
state to state. A run is solved as Hirschberg does: the forward cost vector of its first
half and the backward one of its second half meet in the middle, the cheapest crossing is
taken, and both halves are solved alone, so no table over all rows is ever kept.

Of equally cheap edits the one whose letters come first in ASCII counts. Two paths to
different states over the same rows differ in a letter that both have (each ends with a
row's edit, and a state and a letter tell the next state), so forward vectors need to carry
nothing but the order of their four states' letters.

In Spark, rows get positions by a range-partitioned sort, runs of CHUNK rows are solved to
tables of costs, tables are combined FAN at a time up to one for each conversation, and the
crossings go down the same tree. One conversation can hold any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Rows of a run that one call solves, and runs or tables that are combined at a time.
CHUNK, FAN = 1024, 512
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after an inserted or re-roled turn, and inserts that complete a conversation from each state.
NEXT = [USER, USER, ASSISTANT, USER]
TAIL = ["", "II", "I", ""]
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {USER: "user", ASSISTANT: "assistant"}

Node = tuple[list[list[int]], list[list[int]]]


def kept_state(initial: str, state: int) -> int | None:
    """State after a kept turn with a role of that initial; None where it may not stand."""
    return {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}.get((initial, state))


def moves(symbol: str) -> list[list[tuple[int, str] | None]]:
    """Least (cost, letters) from state to state over one row.

    Symbols: s, u, a for the initial of its role, o for any other; a capital for a truncated
    text; x for a row that must go.
    """
    found: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    more = TRUNCATED if symbol.isupper() else 0
    for p in range(4):
        at = p
        for k in range(3):
            steps = [(at, DELETE, "D")]
            if symbol != "x":
                steps.append((NEXT[at], REROLE + more, "R"))
                kept = kept_state(symbol.lower(), at)
                if kept is not None:
                    steps.append((kept, KEEP + more, "K"))
            for q, cost, letter in steps:
                way = (k * INSERT + cost, "I" * k + letter)
                if found[p][q] is None or way < found[p][q]:
                    found[p][q] = way
            at = NEXT[at]
    return found


MOVES = {c: moves(c) for c in "suaoSUAOx"}


def _node(table: list[list[tuple[int, str] | None]]) -> Node:
    """Costs, and for each first state the place of every last state in the order of its letters."""
    order = [{w: k for k, w in enumerate(sorted(x[1] for x in row if x))} for row in table]
    return [[x[0] if x else FAR for x in row] for row in table], [[order[p][x[1]] if x else 0 for x in row] for p, row in enumerate(table)]


ROWS = {c: _node(t) for c, t in MOVES.items()}


def forward(nodes: list[Node], p: int) -> tuple[list[int], list[int]]:
    """Least costs from state ``p`` to each state, and the order of their letters."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[p] = 0
    for far, order in nodes:
        live = sorted((rank[s], s) for s in range(4) if cost[s] < FAR)
        now, keys = [FAR] * 4, []
        for q in range(4):
            key = None
            for r, s in live:
                c = cost[s] + far[s][q]
                if c < now[q]:
                    now[q], key = c, (r, order[s][q], q)
            if key:
                keys.append(key)
        cost, rank = now, [0] * 4
        for k, (_, _, q) in enumerate(sorted(keys)):
            rank[q] = k
    return cost, rank


def backward(nodes: list[Node], q: int) -> list[int]:
    """Least costs from each state to state ``q``."""
    cost = [FAR] * 4
    cost[q] = 0
    for far, _ in reversed(nodes):
        cost = [min(FAR, *(far[s][t] + cost[t] for t in range(4))) for s in range(4)]
    return cost


def last_state(nodes: list[Node]) -> int:
    """State after the last row of a whole conversation; the inserts of TAIL follow."""
    cost, rank = forward(nodes, START)
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(TAIL[s]), rank[s]))


def crossings(nodes: list[Node], p: int, q: int) -> list[int]:
    """The states before, between and after the nodes on the best way from ``p`` to ``q``."""
    states = [p, *[START] * (len(nodes) - 1), q]
    todo = [(0, len(nodes))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            there, rank = forward(nodes[lo:mid], states[lo])
            back = backward(nodes[mid:hi], states[hi])
            states[mid] = min(range(4), key=lambda s: (there[s] + back[s], rank[s]))
            todo += [(lo, mid), (mid, hi)]
    return states


def combine(nodes: list[Node]) -> Node:
    """One node over all of them."""
    ways = [forward(nodes, p) for p in range(4)]
    return [c for c, _ in ways], [r for _, r in ways]


@lru_cache(1 << 14)
def audit(symbols: str, p: int = START, q: int = -1, last: bool = True) -> str:
    """Letters of the best edits of a run of rows; ``q`` below zero lets the conversation end as is cheapest."""
    nodes = [ROWS[c] for c in symbols]
    q = last_state(nodes) if q < 0 else q
    states = crossings(nodes, p, q)
    return "".join(MOVES[c][a][b][1] for c, a, b in zip(symbols, states, states[1:])) + (TAIL[q] if last else "")


def _pack(node: Node) -> list[int]:
    return [x for part in node for row in part for x in row]


def _unpack(flat: list[int]) -> Node:
    rows = [flat[k : k + 4] for k in range(0, 32, 4)]
    return rows[:4], rows[4:]


def _nodes(value: str | list[list[int]]) -> list[Node]:
    return [ROWS[c] for c in value] if isinstance(value, str) else [_unpack(x) for x in value]


@lru_cache(1 << 12)
def _table(symbols: str) -> list[int]:
    return _pack(combine(_nodes(symbols)))


@F.arrow_udf(returnType=T.ArrayType(T.LongType()))
def _tables(value: pa.Array) -> pa.Array:
    """The costs and orders of a run of symbols, or of a list of such tables."""
    return pa.array([_table(x) if isinstance(x, str) else _pack(combine(_nodes(x))) for x in value.to_pylist()], pa.list_(pa.int64()))


def _descend(fan: int):
    """From a node's first and last state to those of each node below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, node, p, q, last, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = _nodes(value)
                states = crossings(nodes, p, last_state(nodes) if q < 0 else q)
                rows += [(conv, node * fan + k, states[k], states[k + 1], last and k == len(nodes) - 1) for k in range(len(nodes))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv", "node", "p", "q", "last"])

    return run


@F.arrow_udf(returnType=T.StringType())
def _audits(symbols: pa.Array, p: pa.Array, q: pa.Array, last: pa.Array) -> pa.Array:
    return pa.array([audit(*x) for x in zip(symbols.to_pylist(), p.to_pylist(), q.to_pylist(), last.to_pylist(), strict=True)], pa.string())


def damage(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, m: the rows after damage, equal ones as one with their number ``m``.

    A conversation's dropped rows are one row without a role whose ``m`` is zero.
    """
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    words = [F.coalesce(x.cast("string"), F.lit(" ")) for x in (conv, turn, F.col("role"), F.col("text"))]
    what = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    role = F.when(what == 4, F.lit("user")).otherwise(words[2])
    text = F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(words[3], "[.!?]", "")).otherwise(words[3])
    there = what != 0
    rows = turns.select(conv.alias("conv"), *[F.when(there, x).alias(n) for x, n in ((turn, "turn"), (role, "role"), (text, "text"))], F.when(what == 3, 2).when(there, 1).otherwise(0).cast("bigint").alias("m"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("m").alias("m"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``ord``, which rises by turn, role and text, and what their texts show.

    The range of a partition ends at a start of a text, its sort goes by whole texts.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    spread = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    named = spread.withColumn("symbol", F.when(trimmed == "", "x").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), symbol).otherwise(F.upper(symbol)))
    return materialize(named.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1)), "ord": F.monotonically_increasing_id()}))


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the columns of the right side's keys go."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    hold: Column = F.lit(True)
    for n in names:
        hold = hold & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return left.join(other, hold, how).drop(*[f"_{n}" for n in names])


def _chunks(ordered: DataFrame, chunk: int) -> DataFrame:
    """conv, node, first, code: the symbols of each run of ``chunk`` rows, from position zero.

    A row whose role and text stand earlier, and every copy of a row but the first, must go.
    """
    rows = ordered.filter("m > 0").select("conv", "ord", F.shiftright("ord", 33).alias("part"), "m", "symbol", "h1", "h2")
    sums = rows.groupBy("conv", "part").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = _same(rows, base, ["conv", "part"]).withColumn("start", F.col("base") + F.sum("m").over(inside) - F.col("m"))
    seen = rows.filter("symbol <> 'x'").groupBy("conv", "h1", "h2").agg(F.min("ord").alias("seen"))
    judged = _same(placed, seen, ["conv", "h1", "h2"], "left").withColumn("symbol", F.when(F.col("ord") > F.col("seen"), "x").otherwise(F.col("symbol")))
    copies = judged.select("conv", "ord", "symbol", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("copy"))
    each = copies.select("conv", "ord", (F.col("start") + F.col("copy")).alias("pos"), F.when(F.col("copy") > 0, "x").otherwise(F.col("symbol")).alias("symbol"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    return each.groupBy("conv", F.expr(f"pos div {chunk}").alias("node")).agg(F.min("ord").alias("first"), code.alias("code"))


def plans(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """The runs with the letters of their best edits as ``audit``."""
    most = chunks.agg(F.max("node")).first()[0] or 0
    root = [F.lit(START).alias("p"), F.lit(-1).alias("q"), F.lit(True).alias("last")]
    if not most:
        return chunks.select("*", _audits("code", *root).alias("audit"))
    tables, levels = chunks.select("conv", "node", _tables("code").alias("value")), []
    while most:
        most //= fan
        lists = tables.groupBy("conv", F.expr(f"node div {fan}").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "value"))), lambda x: x["value"]).alias("value"))
        levels.append(materialize(lists))
        tables = levels[-1].select("conv", "node", _tables("value").alias("value"))
    below = levels.pop().select("conv", "node", *root, "value").mapInArrow(_descend(fan), "conv bigint, node bigint, p int, q int, last boolean")
    while levels:
        below = _same(below, levels.pop(), ["conv", "node"]).select("conv", "node", "p", "q", "last", "value").mapInArrow(_descend(fan), "conv bigint, node bigint, p int, q int, last boolean")
    return _same(chunks, below, ["conv", "node"]).select("conv", "node", "first", "code", _audits("code", "p", "q", "last").alias("audit"))


class _Conversation:
    """What is told of one conversation, row after row in its order."""

    def __init__(self) -> None:
        self.state, self.letters, self.symbols = START, "", ""
        self.audit: list[str] = []
        self.cost = self.illegal = self.blank = self.duplicate = self.truncated = self.turns = 0
        self.first = self.newest = self.initial = None
        self.sha, self.began = hashlib.sha256(), False

    def say(self, role: str, text: str, state: int) -> None:
        self.sha.update((f"\n{role}:{text}" if self.began else f"{role}:{text}").encode())
        self.state, self.began = state, True

    def insert(self, letters: str) -> None:
        for _ in letters:
            self.cost += INSERT
            self.say(ROLES[NEXT[self.state]], "", NEXT[self.state])

    def plan(self, symbols: str, letters: str) -> None:
        self.symbols += symbols
        self.letters += letters
        self.audit.append(letters)

    def row(self, turn: int | None, role: str, text: str, copies: int, blank: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.newest:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.newest = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial * 2 not in ("su", "ua", "au"))
        self.initial = initial
        for symbol in self.symbols[:copies]:
            own = len(self.letters) - len(self.letters.lstrip("I"))
            self.insert(self.letters[:own])
            letter, self.letters = self.letters[own], self.letters[own + 1 :]
            self.blank += blank
            self.duplicate += symbol == "x" and not blank
            self.truncated += symbol.isupper()
            if letter == "D":
                self.cost += DELETE
                continue
            self.cost += (REROLE if letter == "R" else KEEP) + TRUNCATED * symbol.isupper()
            if letter == "R":
                self.say(ROLES[NEXT[self.state]], text, NEXT[self.state])
            else:
                self.say(role, text, kept_state(initial, self.state))
        self.symbols = self.symbols[copies:]

    def result(self, conv: int | None) -> tuple:
        self.insert(self.letters)
        gaps = min((1 << 63) - 1, self.newest - self.first + 1 - self.turns) if self.turns else 0
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_KINDS = [*[pa.int64()] * 7, pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its sorted rows and plans; a plan stands before its rows.

    Memory holds one batch and one conversation's counts and letters, never its texts.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)

    now, open_conv = None, None
    for batch in batches:
        done = []
        for conv, tag, turn, role, text, m, symbol, code, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != open_conv:
                if now is not None:
                    done.append(now.result(open_conv))
                now, open_conv = _Conversation(), conv
            if tag == 0:
                now.plan(code, letters)
            elif m:
                now.row(turn, role, text, m, symbol == "x")
        yield batch_of(done)
    if now is not None:
        yield batch_of([now.result(open_conv)])


def repair(turns: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row for each conv_id of ``turns``, rows without one together. The rows are damaged
    first (see damage()); null roles and texts are one space, so a null text is blank and a
    null role can't be kept. Rows go by turn, nulls first; rows that share a turn by role
    and then text, in the order of their bytes, so repeated rows stand together and each
    counts. Texts are equal if both of their 64-bit hashes are. An empty table gives no rows; other
    columns are ignored. The hash of a repaired conversation is one running hash, so the task
    that ends a conversation reads its rows one after the other, sorted and in batches; all
    else of a long conversation is spread.
    """
    ordered = _ordered(damage(turns))
    chunks = materialize(_chunks(ordered, chunk))
    plan = plans(chunks, fan).select("conv", F.col("first").alias("ord"), F.lit(0).alias("tag"), "node", "code", F.col("audit").alias("letters"))
    rows = ordered.select("conv", "ord", F.lit(1).alias("tag"), "turn", "role", "text", "m", "symbol")
    both = rows.unionByName(plan, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "ord", "tag", "node")
    return both.select("conv", "tag", "turn", "role", "text", "m", "symbol", "code", "letters").mapInArrow(_tell, RESULT)
