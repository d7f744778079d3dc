import math
import random
import zlib
from collections import Counter

import pytest
from helpers import frame

from kvstrata.llm import ngram_lm, queries


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [x for x in low.replace("\n", " ").split(" ") if x] + ["</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter(w for t in texts for w in toks(t))
        counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["<s>", *toks(t)]
            for i in range(1, len(w)):
                k = min(order, i + 1)
                counts[k][tuple(w[i - k + 1 : i + 1])] += 1
        for k in range(order - 1, 0, -1):
            counts[k].update(Counter(g[1:] for g in counts[k + 1]))
        self.counts = counts
        self.rates = [None] + [ngram_lm.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)]) for k in range(1, order + 1)]
        self.stats = [None] + [{} for _ in range(order)]
        for k in range(1, order + 1):
            for g, c in counts[k].items():
                s = self.stats[k].setdefault(g[:-1], [0, 0, 0, 0])
                s[0] += c
                s[min(c, 3)] += 1

    def p(self, ctx, w):
        k = len(ctx) + 1
        low = self.p(ctx[1:], w) if ctx else 1 / (len(self.raw) + 1)
        s = self.stats[k].get(tuple(ctx))
        if s is None:
            return low
        c, d = self.counts[k].get((*ctx, w), 0), self.rates[k]
        cut = max(c - (d[min(c, 3) - 1] if c else 0), 0)
        return (cut + sum(x * y for x, y in zip(d, s[1:], strict=True)) * low) / s[0]

    def score(self, t):
        w = ["<s>", *toks(t)]
        return sum(math.log10(self.p(w[max(0, i - self.order + 1) : i], w[i])) for i in range(1, len(w)))

    def base(self, t):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))


def cases_of():
    r = random.Random(1)
    vocab = [f"w{int(r.expovariate(0.1))}" for _ in range(400)] + ["É", "The", "the"]
    out = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(150)]
    return out + [(200, None), (201, ""), (None, "the w1"), (3, out[3][1]), (3, out[3][1]), (202, "one\nnew  W1 " * 400)]


@pytest.mark.parametrize("order,passes,group", [(1, 1, 100), (2, 2, 200), (3, 2, 100), (3, 4, 1 << 20), (4, 1, 200)])
def test_against_dictionaries(spark, order, passes, group):
    cases = cases_of()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in cases]
    m = Plain([t for (_, t), h in zip(cases, held, strict=True) if not h], order)
    # Small groups: many of them, and the common words' keys are hot.
    got = ngram_lm.split_and_score(frame(spark, cases), order=order, passes=passes, group_tokens=group, hold=700).collect()
    want = sorted(((i, h, len(toks(t)), sum(m.raw[w] > 0 for w in toks(t)), sum(m.raw.values()), m.base(t), m.score(t)) for (i, t), h in zip(cases, held, strict=True)), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=str), want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    for ctx in ([], ["the"], ["w1"], ["<s>"])[: 1 if order == 1 else 4]:
        assert sum(m.p(ctx, w) for w in m.raw) + m.p(ctx, "never seen") == pytest.approx(1)


def test_empty(spark):
    assert ngram_lm.split_and_score(frame(spark, [])).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngram_lm.split_and_score(frame(spark, [(only_held, "a b")])).collect()
    assert len(r) == 1 and r[0].held_out and r[0].train_tokens == 0 and r[0].score == 0


def test_beats_the_base_on_held_out_texts(spark, small):
    df = ngram_lm.split_and_score(spark.read.parquet(f"{small}/documents.parquet"))
    x = df.where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert x["sum(score)"] > x["sum(base_score)"]


def test_the_query_looks_at_two_words_before_each(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    m = Plain([t for i, t in docs if i not in held], 3)
    got = {x.doc_id: x.score for x in queries.op7_ngram_model(spark, small).collect()}
    assert len(got) == len(docs)
    for i, t in docs[:20]:
        assert got[i] == pytest.approx(m.score(t), rel=1e-9)


def test_tables_keep_large_counts():
    import numpy as np

    r = np.random.default_rng(3)
    key = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) >> np.uint64(2))
    values = [r.integers(0, 300, len(key)), np.full(len(key), 1 << 40)]
    t = ngram_lm.Table(np.frombuffer(ngram_lm.dump(key, 3, values) + b"more", "u1"))
    assert (t.get(key) == np.stack(values, 1)).all() and not t.get(key + np.uint64(1 << 28)).any()
