"""Conversation repair against a search over all edits, and odd tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgermill.llm import repair

BLANK = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def least(rows):
    """(cost, audit, repaired turns) by uniform-cost search over all edits; ``rows`` are (role, text, fault)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, turns = heapq.heappop(queue)
        if at == len(rows) and FORM.fullmatch(roles):
            return cost, audit, turns
        state = (at, roles[-1:], "s" in roles, len(roles) > 0)
        if state in seen:
            continue
        seen.add(state)
        steps = [(2, "I", at, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            more = fault == "truncated"
            steps.append((3, "D", at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                steps.append((more, "K", at + 1, role, (role, text)))
                steps += [(2 + more, "R", at + 1, r, (r, text)) for r in ("user", "assistant")]
        for c, letter, to, role, turn in steps:
            now = roles + (role[:1] if role is not None else "")
            if re.fullmatch(r"(s?(ua)*u?)?", now) and (role is None or role):
                heapq.heappush(queue, (cost + c, audit + letter, to, now, turns + ((turn,) if turn else ())))


def plain(table):
    """The contract's row of every conversation, in plain Python."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            rows += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, known = [], set()
        for _, role, text in rows:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in known else "truncated" if bare[-1] not in ".!?" else ""
            known.add((role, text))
            judged.append((role, text, fault))
        cost, audit, turns = least(judged)
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
        out[conv] = (gaps, *count, illegal, cost, audit, sha)
    return out


def got(spark, table, **more):
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    found = [tuple(r) for r in repair.repair(df, **more).collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r[1:] for r in found}


def random_table(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "uncle"])
            text = rng.choice(["Yes.", "no", " ", None, "a! ", "Why?\n", f"word {t}.", f"cut {t}", "é…", "x. "])
            rows.append((conv, rng.choice([t, t, t, t + 5, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_crossings_give_the_least_letters(seed):
    rng = random.Random(seed)
    for _ in range(150):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 7)))
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(role[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in symbols]
        assert repair.audit(symbols) == least(rows)[1], symbols


def test_runs_and_their_tables_give_what_one_run_gives():
    rng = random.Random(5)
    for _ in range(40):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(60))
        parts = [symbols[k : k + 7] for k in range(0, 60, 7)]
        nodes = [repair.combine([repair.ROWS[c] for c in x]) for x in parts]
        states = repair.crossings(nodes, repair.START, repair.last_state(nodes))
        pieces = [repair.audit(x, a, b, k == len(parts) - 1) for k, (x, a, b) in enumerate(zip(parts, states, states[1:]))]
        assert "".join(pieces) == repair.audit(symbols)


def test_against_all_edits(spark):
    table = random_table(1, 120, 8) + random_table(1, 6, 5)  # the second part repeats rows
    table += [(None, k, "user", f"n {k}.") for k in range(4)]
    assert got(spark, table) == plain(table)


def test_one_long_conversation_is_solved_in_runs(spark):
    table = random_table(2, 20, 5)
    rng = random.Random(9)
    table += [(777, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"r {t}.", f"r {t}", "same."])) for t in range(300)]
    table += [(778, 3, "user", "again and again.")] * 60
    whole = got(spark, table)
    assert got(spark, table, chunk=4, fan=3) == whole == plain(table)


def test_dropped_empty_and_null_rows(spark):
    drop = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    table = [(drop, 0, "user", "gone."), (-3, None, None, None), (-4, 5, "assistant", None)]
    found = got(spark, table)
    assert found == plain(table) and found[drop] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got(spark, []) == {}


def test_other_columns_and_long_texts(spark):
    table = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y" * 300_000), (1, 9, "user", "x" * 300_000 + "!")]
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "m", "ord", "part", "node", "symbol", "code")})
    assert {r[0]: tuple(r)[1:] for r in repair.repair(df).collect()} == plain(table)
