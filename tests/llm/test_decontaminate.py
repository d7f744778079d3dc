import random
import re

from helpers import frame, rows

from kvstrata.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(docs, items, window=8):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            p = words(text)
            m = min(window, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m and item is not None else ()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), sorted(ids), len(ids) >= 2))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "B", "ç", "d1", "É", "x-y", "z.", "q"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 7, 8, 9, 15, 30]) if i < 6 else 12)) for i in range(30)] + [(None, "a B"), (40, None), (41, ""), (42, "..."), (3, say(9))]
    docs = [(i, say(r.randint(0, 120))) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (None, say(30)), (7, say(30))]
    docs += [(70 + i, say(5) + " " + items[i][1].upper() + "; " + items[i + 1][1]) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = expected(docs, items)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    for block in (1 << 24, 200):  # one pass, and many
        found = d.find_items(frame(spark, docs), bench, keep=["doc_id"], block_bytes=block)
        assert sorted(((x.doc_id, x["__n_words"], x["__n_hit"], len(x["__items"] or []), list(x["__items"] or [])) for x in found.collect()), key=str) == sorted([w[:5] for w in want], key=str)
    assert sorted((tuple(x) for x in d.contamination(frame(spark, docs), bench).select(*cols).collect()), key=str) == want
    kept = d.drop_contaminated(frame(spark, docs), bench, min_items=2)
    assert kept.columns == frame(spark, []).columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(d.contamination(frame(spark, [(1, "a b")]), bench), "doc_id", "n_words", "n_hit", "n_items", "contaminated") == [(1, 2, 0, 0, False)]
    assert d.contamination(frame(spark, []), bench).count() == 0


def test_search_reports_all_overlapping_hits():
    s = d.WuManber({(1, 1, 1): 0, (1, 2, 1): 1}, 3, 9)
    assert list(s.search([1, 1, 1, 1, 2, 1, 0, 1, 1])) == [(0, 0), (1, 0), (3, 1)]
