from ledgermill.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_turns int"


def slow(rows):
    talks = {}
    for conv, turn, role, text, _ in rows:
        talks.setdefault(conv, []).append((-1 if turn is None else turn, role or "unknown", text or ""))
    talks = {c: [(r, x) for _, r, x in sorted(t)] for c, t in talks.items()}
    first = {}
    for c in sorted(talks, key=lambda c: (c is not None, c)):
        first.setdefault(tuple(talks[c]), c)
    whole = set(first)
    begun = {t[:k] for t in whole for k in range(1, len(t))}
    return {c: (len(t), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in t)) for t, c in first.items() if t not in begun}


def rows():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    out = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)):
        out += [(conv, 10 * k if conv == 4 else k, r, x, 0) for k, (r, x) in enumerate(talk[:n])]
    out += [(6, 0, "user", "hello", 0), (6, 1, "assistant", "hi", 0), (7, 0, None, "", 0)]
    out += [(None, 0, "user", "hi", 0), (None, None, "system", "x", 0)]
    out += [(8, 3, "user", "same", 0)] * 3 + [(9, 3, "user", "same", 0)] * 2
    out += [(10, k, "user", f"t{k}", 0) for k in range(30)] + [(11, k, "user", f"t{k}", 0) for k in range(17)]
    return out


def test_matches_brute_force(spark):
    data = rows()
    got = chat.format_chats(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.conv_id: (r.n_turns, r.text) for r in got} == slow(data)


def test_buckets_only_split_the_rendering(spark):
    data = rows()
    parts = {}
    for r in sorted(chat.format_chats(spark.createDataFrame(data, SCHEMA), bucket=4).collect(), key=lambda r: r.part):
        n, text = parts.get(r.conv_id, (r.n_turns, ""))
        parts[r.conv_id] = (n, text + r.text)
    assert parts == slow(data)


def test_empty_and_native(spark):
    frame = spark.createDataFrame([], SCHEMA)
    out = chat.format_chats(frame)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_turns_that_share_a_number_are_split_and_keep_their_order(spark):
    lines = [("user" if k % 3 else "assistant", f"line {k}") for k in range(200)]
    hashed = spark.createDataFrame(lines, "role string, text string").selectExpr("role", "text", "xxhash64(role, text) AS h").orderBy("h").collect()
    inner = [(r.role, r.text) for r in hashed]
    data = [(1, 7, r, x, 0) for r, x in inner] + [(2, 7, r, x, 0) for r, x in inner[:120]]
    data = [(1, 3, "system", "first", 0), (2, 3, "system", "first", 0), *data, (1, 9, "user", "last", 0)]
    want = [("system", "first"), *inner, ("user", "last")]
    for crowd in (chat.CROWD, 20):
        got = sorted(chat.format_chats(spark.createDataFrame(data, SCHEMA), bucket=16, crowd=crowd).collect(), key=lambda r: r.part)
        assert {r.conv_id for r in got} == {1} and {r.n_turns for r in got} == {202}
        assert [r.text.count("<|end|>") for r in got] == [16] * 12 + [10]
        assert "".join(r.text for r in got) == "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in want)


def test_very_long_text(spark):
    data = [(1, 0, "user", "long " * 400_000, 0), (1, 1, "assistant", "short", 0), (2, 0, "user", "long " * 400_000, 0)]
    got = chat.format_chats(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 2)] and len(got[0].text) > 2_000_000


def test_copies_of_a_turn_are_counted(spark):
    """One turn 5,000 times between others: parts of 16 turns, a snapshot of it dropped, and no window that sorts the copies."""
    head, tail = [(1, 0, "system", "first", 0), (1, 1, "user", "ask", 0)], [(1, 5, "user", "last", 0)]
    many = [(1, 3, "assistant", "same", 0)] * 5_000
    data = head + many + tail + [(2, *r[1:]) for r in head + many[:40]] + [(3, *r[1:]) for r in head + many[:40] + tail]
    frame = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in sorted(chat.format_chats(frame, bucket=16, crowd=20).collect(), key=lambda r: (r.conv_id, r.part)):
        assert r.part == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append(r.text)
    want = slow(data)
    assert {c: "".join(x) for c, x in got.items()} == {c: text for c, (_, text) in want.items()} and set(got) == {1, 3}
    assert [x.count("<|end|>") for x in got[1]] == [16] * 312 + [11]
    assert chat._placed(frame, 16, 20).count() == 4 + 3 + 4
