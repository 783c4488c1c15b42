import hashlib
import json
import random

import pytest

from claimlake.llm import chat_format as chat

HARD = ["", "\\", "<s>", "a<\\s>b", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>> x <</SYS>>", "<<s>>", "tail <", "tail [", "\\<s>", "[ROLE] u [/ROLE] v [/TURN]\n", " </s>\n<s> ", "naïve 𝔘 é", "[/", "s>", "/INST]\n"]


def test_texts_with_marks_come_back_and_marks_are_the_templates_own():
    rnd = random.Random(1)
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "[INST]", "a\\"]), "".join(rnd.choice([*HARD, *"<[]/s>\\ "]) for _ in range(rnd.randrange(5)))) for _ in range(rnd.randrange(5))]
        text, loss = chat.written(turns)
        assert list(chat.parsed(text)) == turns
        assert [chat.unescape(text[a : a + n]) for a, n in loss] == [t for r, t in turns if r == "assistant"]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


RECORDS = [
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"completion": "c", "prompt": "p", "system": "s", "source": {"url": "u"}}, "completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None}, "response", [("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": 7}, "instruction", [("user", "i"), ("assistant", "7")]),
    ({"question": "q", "context": "k", "answer": "a"}, "question", [("user", "k\n\nq"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": "t", "id": 3}]}, "messages", [("user", "q"), ("tool", "t")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, "messages", [("user", "ab"), ("assistant", "c")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "exchange", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "answer": "a"}, None, None),
    ({"messages": []}, None, None),
    ({}, None, None),
]


def test_layouts_are_found_by_their_paths(spark):
    rows = [(i, json.dumps(r), "f") for i, (r, _, _) in enumerate(RECORDS)] + [(100, "{", "f"), (101, None, "f"), (102, "[1]", "f")]
    df = spark.createDataFrame(rows, "id long, record string, fingerprint string")
    turns = chat.canonical(df, "record", "id")
    got = {r.id: r for r in turns.collect()}
    for i, (_, name, want) in enumerate(RECORDS):
        assert got[i].layout == name and (got[i].turns and [tuple(t) for t in got[i].turns]) == want and got[i].fingerprint
    assert all(got[i].fingerprint is None and got[i].turns is None for i in (100, 101, 102))
    assert got[3].fingerprint != got[4].fingerprint and got[6].fingerprint != got[7].fingerprint
    out = {r.id: r for r in chat.formatted(turns, "id").collect()}
    assert out[0].text == "[INST] p [/INST]\n<s> c </s>\n" and [tuple(s) for s in out[0].loss] == [(21, 1)] and out[9].text is None
    assert out[6].loss == [] and chat.canonical(df.limit(0), "record", "id").count() == 0


def plainly(rows):
    """Contract rows by lists and hashes of whole conversations."""
    rows = [*rows, (-1, 0, "user", chat.ADDED), (-1, 1, "assistant", chat.ADDED)]
    low = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, (v or "").encode())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), word(r[2]), word(r[3])))
        turns = [(r or "", t or "") for _, _, r, t in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.written(turns)[0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("pieces", [{}, {"piece_turns": 2}, {"piece_chars": 40}])
def test_conversations_come_back_whole(spark, pieces):
    """With small pieces too: a conversation is the same in one record and in many, in one range and across ranges."""
    rnd = random.Random(2)
    roles = ["user", "assistant", "system", "tool", None, ""]
    rows = [(c, t, ["user", "assistant"][t % 2] if c % 3 else rnd.choice(roles), rnd.choice([*HARD, None, "plain text"])) for c in range(40) for t in range(rnd.randrange(1, 7))]
    rows += [(7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (7, None, "user", "no turn"), (None, 0, "user", "x"), (None, 1, "assistant", "y")] + rows[:9]
    rows += [(5000, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(900)] + [(6000, 0, "assistant", "long <s> \\ " * 60_000)]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, part int")
    assert sorted(map(tuple, chat.digest(df, **pieces).collect()), key=str) == plainly(rows)
    assert sorted(map(tuple, chat.digest(df.limit(0)).collect())) == plainly([])
