import random
import re

import numpy as np
import pytest
from helpers import frame, rows

from kvstrata.llm import neardup


def sets_of(t, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def expected(cases, size):
    nodes = [(i, sets_of(t, size)) for i, t in cases]
    root = {i: i for i, _ in nodes if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(nodes):
        for j, y in nodes[:a]:
            if i is None or j is None or not x or not y:
                continue
            k = len(x & y)
            if 100 * k >= 80 * (len(x) + len(y) - k):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(x), None if i is None else find(i), i is None or find(i) == i) for i, x in nodes), key=lambda r: tuple((x is not None, x) for x in r))


def cases_of(seed):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    out, line = [], say(25)
    for _ in range(25):
        out.append(say(r.randint(1, 80)))
    for base in (say(120), say(60), say(11)):
        now = base
        for _ in range(40):  # drifting copies: chains whose ends are far apart
            now = list(now if r.random() < 0.5 else base)
            for _ in range(r.randint(0, max(1, len(now) // 25))):
                now[r.randrange(len(now))] = f"w{r.randrange(400)}"
            out.append(now)
    out += [line + say(r.randint(0, 20)) for _ in range(25)] + [["a"], ["A"], ["a", "b"], ["b"], ["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "f", "g"]]
    r.shuffle(out)
    cases = [(3 * i, " ".join(w)) for i, w in enumerate(out)]
    cases += [(9000, None), (9001, ""), (9002, " \t"), (None, cases[3][1]), (None, None), (12, cases[4][1]), (15, cases[77][1])]
    cases += [(9100 + i, cases[5][1].upper()) for i in range(10)]
    return cases


@pytest.mark.parametrize("size,chunk,rounds", [(2, 4096, 2), (5, 4096, 2), (2, 7, 0), (2, 8, 2)])
def test_against_brute_force(spark, size, chunk, rounds):
    cases = cases_of(size)
    out = neardup.near_duplicates(frame(spark, cases), shingle=size, chunk=chunk, rounds=rounds, block=4 if chunk < 99 else 1000, block_items=300 if chunk < 99 else 1 << 20)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == expected(cases, size)


def test_filter_and_empty(spark):
    cases = cases_of(5)
    df = frame(spark, cases)
    for name in ("__gone", "__row", "component_id", "first", "n_shingles"):
        df = df.withColumn(name, df.doc_id)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # Every row is a node of its own: numbered in the order in which the first of a group stays.
    order = sorted(cases, key=lambda c: (c[0] is None, c[0] or 0))
    keep = [k for *_, k in sorted(expected([(j, t) for j, (_, t) in enumerate(order)], 5))]
    want = [c for c, k in zip(order, keep, strict=True) if k]
    same_id = lambda rs: sorted((i is None, i or 0, t is None, t or "") for i, t in rs)
    assert same_id(rows(kept, "doc_id", "text")) == same_id(want)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_rows_without_an_id_leave_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = frame(spark, [(7, text), (7, text), (None, text), (None, text), (None, "a b c d e f"), (None, "a b c d e f")])
    assert rows(neardup.drop_near_duplicates(df), "doc_id", "text") == [(None, "a b c d e f"), (7, text)]


def test_the_bitmap_rules_no_link_out():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.85, 0.9, 1.0])], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        bits = [np.frombuffer(neardup.sketch(x), "<u8") for x in (a, b)]
        may = neardup.may_link(len(a), np.array([len(b)]), *neardup.apart(bits[0], bits[1][None, :]), 80)[0]
        assert may or not neardup._similar(a, b, 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 7), (7, 7)] + [(1, k) for k in range(200, 230)]
    got = dict(tuple(r) for r in neardup.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect())
    assert got == {**{k: 100 for k in range(101, 141)}, 5: 3, 9: 3, 7: 3, **{k: 1 for k in range(200, 230)}}
    assert neardup.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_pigeonhole():
    """Signatures that differ in up to 31 symbols share a key, wherever they differ."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (500, 80)).astype("<u2")
    b = a.copy()
    for i in range(500):
        at = rng.choice(80, 31, replace=False) if i % 2 else np.concatenate([np.arange(c * 5, c * 5 + 2) for c in range(16)])[:31]
        b[i, at] ^= 1
    assert (neardup.keys(a) == neardup.keys(b)).any(1).all()


def test_texts_of_one_id_are_one_node(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    cases = [(5, a), (5, b), (5, None), (3, b), (9, a), (9, c), (7, c), (11, None), (11, d), (None, a), (12, d), (12, d)]
    out = neardup.near_duplicates(frame(spark, cases))
    got = rows(out, "doc_id", "n_shingles", "component_id", "kept")
    assert got == expected(cases, 2)
    assert {r[0]: r[2] for r in got} == {3: 3, 5: 3, 7: 3, 9: 3, 11: 11, 12: 11, None: None}
