import hashlib
import random

import pytest
from helpers import rows

from kvstrata.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, loss string, window_no string"


def expected(cases):
    convs = {}
    for conv, turn, role, text in cases:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip(spark):
    r = random.Random(1)
    parts = ["\\", "###", "</turn>", " ", "\n", ": ", "### assistant: ", " </turn>\n", "wörd", "</tur", "n>", "#"]
    cases = [(c, t, r.choice(["user", "assistant", "system", "a: b\n%", None]), "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for c in range(40) for t in range(r.randint(1, 30))]
    cases += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    cases += [(None, 1, "user", None), (None, None, "assistant", "x"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (98, 1, "assistant", "word " * 5000), (98, 0, "system", "be brief")]
    df = spark.createDataFrame([(*c, "l", "w") for c in cases], SCHEMA)
    out = chat.digests(chat.format_conversations(df, budget=60, history=20))
    assert rows(out, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == expected(cases)
    assert rows(chat.round_trip(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == expected(cases)
    assert chat.round_trip(df.limit(0)).count() == 0


def test_windows():
    r = random.Random(2)
    turns = [("system", "be kind")] + [(("user", "assistant")[i % 2], " ".join("w" for _ in range(r.randint(0, 30)))) for i in range(200)]
    budget, history = 80, 25
    seen = []
    for w in chat.windows_of(iter(turns), budget, history):
        got = [(a, b) for a, b, *_ in chat.parse("".join(w.parts))]
        again, own = got[: w.repeated], got[w.repeated :]
        assert w.tokens == sum(chat.n_tokens(t) for _, t in got)
        assert w.tokens <= budget or len(own) == 1
        assert got[0] == turns[0]
        if w.number:
            tail = again[1:]
            assert tail == seen[len(seen) - len(tail) :]
            assert sum(chat.n_tokens(t) for _, t in tail) <= history
        seen += own
    assert seen == turns


def test_budget_holds_with_a_tokenizer(spark):
    from kvstrata.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    count = chat.counter(path)
    r = random.Random(8)
    turns = [("system", "you are kind " * 5)] + [(("user", "assistant")[i % 2], " ".join(r.choice(["unbelievable", "a", "x1y2", "Größe"]) for _ in range(r.choice([3, 20, 70])))) for i in range(120)]
    df = spark.createDataFrame([(1, i, a, t) for i, (a, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    seen = []
    for w in chat.format_conversations(df, budget=150, history=60, tokenizer=path).orderBy("window_no").collect():
        got = [(a, b) for a, b, *_ in chat.parse(w.formatted)]
        own = got[w.n_repeated :]
        assert w.n_tokens == sum(count(t) for _, t in got)
        assert w.n_tokens <= 150 or len(got) == 1
        assert got[0] == turns[0] or (len(got) == 1 and count(own[0][1]) + count(turns[0][1]) > 150)
        seen += own
    assert seen == turns


def test_malformed_window():
    with pytest.raises(ValueError):
        chat.parse("### user: hi")
