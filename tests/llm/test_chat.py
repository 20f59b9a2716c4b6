"""Chat windows: round trip, budgets, masks, and digests against their definition."""

import hashlib
import random

import pytest
from granary.llm import chat
from granary.llm.common import staged
from hypothesis import given
from hypothesis import strategies as st

HARD = ["\\### Assistant: </turn> ok", "###", "####", "\\h", "</turn>\n### User: x </turn>\n", "\\", "", " ", "a\nb", "</turn", "\\\\e</turn>", "É ### :"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "Assistant", "x:y\n", "", "\\x"]), st.text() | st.sampled_from(HARD))))
def test_turns_come_back(turns):
    pieces = [chat.piece(r, t) for r, t in turns]
    assert list(chat.parse("".join(p[0] for p in pieces))) == turns
    for (formatted, a, b), (_, t) in zip(pieces, turns, strict=True):
        assert chat.unescape(formatted[a:b]) == t
        assert "###" not in formatted[a:b] and "</turn>" not in formatted[a:b]


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 12)
        for k, r in enumerate(roles):
            rows.append((c, k, r, rng.choice(HARD) if rng.random() < 0.2 else "w " * rng.randint(0, 60)))
    rows += [(100, 0, "system", "s " * 500), (100, 1, "user", "u " * 300), (100, 2, "assistant", "a " * 300), (101, 0, None, None), (101, 1, "assistant", None), (102, 0, "assistant", "b"), (102, 0, "assistant", "a"), (102, 0, "assistant", "a"), (None, 0, "tool", "x")]
    return rows


@pytest.mark.parametrize("budget,history", [(100, 30), (512, 128), (1, 0), (80, 200)])
def test_windows_and_digests(spark, budget, history):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as conv")
    windows = staged(chat.format_chats(turns, budget, history), "chats")
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k, r or "", t or ""))
    for c in by:
        by[c].sort()
    made = {}
    for w in windows.orderBy("conv", "window").collect():
        made.setdefault(w.conv, []).append(w)
    assert made.keys() == by.keys()
    for c, ws in made.items():
        said, targets = [], []
        for k, w in enumerate(ws):
            parts = list(chat.parse(w.text))
            assert w.window == k and w.first_turn == len(said) and len(parts) == w.n_repeated + w.n_new and w.n_new > 0
            if k and by[c][0][1] == "system":
                assert parts[0] == by[c][0][1:]
            elif k == 0:
                assert w.n_repeated == 0
            lead = 1 if k and by[c][0][1] == "system" else 0
            repeated = parts[lead : w.n_repeated]
            assert repeated == said[len(said) - len(repeated) :]
            sizes = [chat.tokens(chat.piece(*p)[0]) for p in parts]
            assert sum(sizes[lead : w.n_repeated]) <= history
            assert w.tokens == sum(sizes)
            assert w.tokens <= budget or w.n_new == 1 and w.n_repeated == lead
            said += parts[w.n_repeated :]
            targets += [chat.unescape(w.text[s.start : s.end]) for s in w.loss]
        assert said == [x[1:] for x in by[c]]
        assert targets == [t for r, t in said if r == "assistant"]
    got = {r.conv: tuple(r)[1:] for r in chat.digests(windows).collect()}
    for c, turns_of in by.items():
        loss = "".join(t for _, r, t in turns_of if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns_of)
        assert got[c] == (len(turns_of), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(w.text) for w in made[c]))


def test_long_conversation_and_empty(spark):
    rows = spark.range(30000).selectExpr("1 as conv_id", "id as turn", "case id % 2 when 0 then 'user' else 'assistant' end as role", "concat('t', id) as text")
    windows = staged(chat.format_chats(rows, 64, 8), "chats")
    assert windows.agg({"n_new": "sum"}).first()[0] == 30000
    assert chat.digests(windows).first().n_turns == 30000
    assert chat.digests(staged(chat.format_chats(rows.limit(0)), "chats")).count() == 0
    with pytest.raises(ValueError):
        chat.format_chats(rows, 0)
