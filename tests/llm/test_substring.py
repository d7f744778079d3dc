import hashlib
import random
import re

import numpy as np
import pytest
from helpers import frame, rows

from kvstrata.llm import substring


def expected(cases, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in cases]
    first = {}
    for (i, _), w in zip(cases, words, strict=True):
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w in zip(cases, words, strict=True):
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def cases_of(seed, vocab, docs=120):
    r = random.Random(seed)
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [say(r.randint(10, 90)) for _ in range(8)] + [["a"] * 40, ["a", "b"] * 20, ["a"] * 12 + ["c"]]
    out = []
    for i in range(docs):
        w = []
        for _ in range(r.randint(0, 5)):
            w += say(r.randint(0, 30))
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += p[a : r.randint(a, len(p))]
        out.append((i, " ".join(w)))
    out += [(1000 + i, out[r.randrange(docs)][1]) for i in range(20)]
    return out


@pytest.mark.parametrize("seed,vocab", [(1, ["a", "b"]), (2, ["a"]), (3, "a b c d e f g".split()), (4, [f"w{i}" for i in range(300)])])
def test_against_brute_force(spark, seed, vocab, monkeypatch):
    cases = cases_of(seed, vocab)
    cases += [(2000, None), (2001, ""), (None, cases[0][1]), (None, "x " * 50), (5, cases[9][1]), (5, cases[30][1]), (7, cases[7][1]), (-4, "\n\t" + cases[11][1].replace(" ", "\x0b\n"))]
    out = substring.repeats(frame(spark, cases))
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == expected(cases)


@pytest.mark.parametrize("rounds", [1, 2, 4, 30])
def test_small_blocks_and_any_number_of_rounds(spark, rounds):
    cases = cases_of(6, [f"w{i}" for i in range(40)])
    out = substring.repeats(frame(spark, cases), rounds=rounds, block_bytes=700, group_bytes=2000)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == expected(cases)


def test_names_that_clash(monkeypatch):
    """Few names for pairs: what they stand for is told apart all the same, and gets a second name."""
    real = substring.name_of
    monkeypatch.setattr(substring, "name_of", lambda *x: real(*x) & np.uint64(0xF))
    x1 = np.repeat(np.arange(200, dtype=np.uint64), 2)
    one = substring.Question(x1, x1 % np.uint64(7), np.zeros(400, np.int64), np.arange(400), 1)
    assert len(one.name) == 200 and (one.hi - one.lo == 1).all() and (one.x1[one.of] == x1).all()
    x2 = np.arange(150, 250, dtype=np.uint64)
    two = substring.Question(x2, x2 % np.uint64(7), np.zeros(100, np.int64), np.full(100, 1000), 1)
    rows = [(b, [q.x1, q.x2, q.kind, q.lo, q.hi]) for b, q in enumerate((one, two))]
    got = {r["blk"]: np.frombuffer(r["payload"], np.uint8) for b in substring.named(0, rows) for r in b.to_pylist()}
    assert (got[0] % 4 == substring.SHARED).all()
    assert (got[1] % 4 == np.where(two.x1 < 200, substring.EARLIER, substring.ALONE)).all()
    names = {}
    for q, answer in ((one, got[0]), (two, got[1])):
        name = np.where(answer >= 4, substring.second_name(q.x1, q.x2, q.kind), q.name)
        for key, n in zip(q.x1.tolist(), name.tolist(), strict=True):
            assert names.setdefault(key, n) == n
    assert len(set(names.values())) == 250
    word = [(0, [np.array([5, 5], np.uint64), np.array([1, 2], np.uint64), np.full(2, substring.WORD), np.zeros(2, np.int64), np.zeros(2, np.int64)])]
    assert [r["kind"] for b in substring.named(0, word) for r in b.to_pylist()] == [substring._CLASH]


def test_empty(spark):
    assert substring.repeats(frame(spark, [])).count() == 0


def test_symbols_are_alike_in_any_context():
    """Rounds without Spark: what the naming would answer is found by counting."""
    r = random.Random(9)
    shared = " ".join(f"s{r.randrange(50)}" for _ in range(600))
    texts = [(" ".join(f"l{r.randrange(9999)}" for _ in range(r.randint(3, 80))) + " " + shared + " z" * k).encode() for k in range(6)]
    ids = list(range(6))
    words = substring.Words(ids, texts, 0, True)
    seq = substring.Sequence.start(ids, words)
    longest = 0
    for number in range(1, 12):
        q = seq.ask(number, 4)
        found = {g: np.where(q.lo[at] == q.hi[at], substring.ALONE, substring.SHARED).astype(np.uint8).tobytes() for g, at in q.parts()}
        merged, new, *_ = seq.merge(number)
        longest = max([longest, *(merged.n[new][q.hi[q.of] > q.lo[q.of]])])
        before = seq.open.sum()
        seq = seq.rewrite(number, 4, found)
        assert seq.open.sum() <= before
    gone = np.concatenate([seq.gone[seq.doc_of == i] for i in ids[1:]])
    assert longest >= 52 and gone.sum() >= 5 * 500 and not seq.gone[seq.doc_of == 0].any()
    # No window that repeats has dropped out of the first text.
    at = np.flatnonzero(seq.open & (seq.doc_of == 0))
    assert len(at) >= 600 - 12


def test_word_hashes(monkeypatch):
    """Words of any length, wherever blocks are cut, have the hash of their bytes alone."""
    from kvstrata.llm import common

    monkeypatch.setattr(common, "_BLOCK", 1 << 10)
    monkeypatch.setattr(common, "_POWERS", [])
    r, known, names = random.Random(5), {}, {}
    for _ in range(120):
        texts = [None, b"", b"x" * r.choice([63, 64, 65, 1021, 1022, 1023, 1024, 1025, 2047, 5000]) + r.choice([b"", b" ", b"\ny", b" " + b"Z" * 3000])]
        texts += [bytes(r.choice(b"aAbB\xc3\xa9 \t\n\x0b\x0c\r \x1c") for _ in range(r.choice([1, 5, 100, 3000]))) for _ in range(4)]
        r.shuffle(texts)
        for lower, seed in ((False, 0), (True, 0), (False, 1)):
            h, sizes = common.hash_texts(texts, lower, seed)
            words = [((t or b"").translate(common.LOWER) if lower else t or b"").split() for t in texts]
            assert sizes.tolist() == [len(w) for w in words]
            for w, k in zip((w for ws in words for w in ws), h.tolist(), strict=True):
                assert known.setdefault((w, seed), k) == k and names.setdefault(k, w) == w
