"""Windows are turn-aligned, within budget, and read back exactly."""

import hashlib
import random

from lumenstep.llm import chat


def rows():
    rng = random.Random(2)
    bits = ["a", "word ", "<end>\n", "<turn ", "<says>", "\\", "\\l", "\\b", "<", "é😀", "\n", " "]
    out = []
    for c in range(40):
        system = rng.random() < 0.5
        for t in range(rng.randint(1, 30)):
            role = "system" if system and t == 0 else ["user", "assistant"][t % 2]
            text = None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40, 400])))
            out.append((c, t, role, text))
    out += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (100, None, None, "x"), (100, 0, "user", "y"), (100, 0, "user", "y")]
    return out + [(200, t, "assistant", f"long {t} " * 20) for t in range(1500)]


def test_round_trip(spark):
    data = rows()
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {r[0] for r in data}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in data if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1]))]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    got = {r.conv_id: r for r in chat.digest(frame).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    wins = chat.windows(frame).collect()
    assert sum(len(w.formatted) for w in wins) == sum(r.formatted_chars for r in got.values())
    for w in wins:
        turns = chat.parse(w.formatted)
        cost = [len(x.split()) + chat.TURN_COST for _, x in turns]
        head = cost[0] if turns[0][0] == "system" and w.n_context else 0
        assert len(cost) > w.n_context and sum(cost[: w.n_context]) - head <= chat.HISTORY
        if len(cost) - w.n_context > 1 and head <= chat.BUDGET - chat.HISTORY - chat.LEAST:
            assert sum(cost) <= chat.BUDGET
    systems = {c for c, t, r, _ in data if t == 0 and r == "system"}
    assert all(chat.parse(w.formatted)[0][0] == "system" for w in wins if w.conv_id in systems)
    assert any(w.n_context > 0 for w in wins)
    assert chat.digest(frame.limit(0)).count() == 0


def test_budget_of_a_real_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for budget, history in ((512, 128), (200, 40), (128, 0)):
        several = 0
        for w in chat.windows(rows, budget, history).collect():
            cost = [len(x.split()) + chat.TURN_COST for _, x in chat.parse(w.formatted)]
            if len(cost) - w.n_context > 1:
                several += 1
                assert sum(cost) <= budget
        assert several


def test_long_system_turn_odd_names_and_repeats(spark):
    data = [(1, 0, "system", "word " * 700), *[(1, t, "user", f"hello {t}") for t in range(1, 40)], (None, 0, "user", "a"), (None, 0, "user", "a")]
    frame = spark.createDataFrame([(*r, 5, "x", 7) for r in data], "conv_id long, turn long, role string, text string, cost int, window string, system int")
    wins = chat.windows(frame).collect()
    assert all(chat.parse(w.formatted)[0][0] == "system" for w in wins if w.conv_id == 1)
    new = [t for w in sorted((w for w in wins if w.conv_id == 1), key=lambda w: w.window) for t in chat.parse(w.formatted)[w.n_context :]]
    assert [x for _, x in new[1:]] == [f"hello {t}" for t in range(1, 40)]
    assert {r.conv_id: r.n_turns for r in chat.digest(frame).collect()} == {1: 40, None: 2}
