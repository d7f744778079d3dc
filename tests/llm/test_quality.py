import random
import re
from collections import Counter

from helpers import frame, rows

from kvstrata.llm import quality as q
from kvstrata.llm.common import materialize

COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(i, t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(wins)
    rep = {k + j for k, x in enumerate(wins) if n[x] > 1 for j in range(5)}
    return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))


def cases_of(seed=1):
    r = random.Random(seed)
    vocab = ["a", "bé", "C|", "d.", "ee#", "　x", "g"]
    out = [(i, "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    line = "one two three four five six"
    out += [(500, None), (501, ""), (502, " \n\n "), (None, "x y " * 9), (3, out[4][1]), (3, out[4][1]), (503, "\n".join([line] * 3)), (504, line + "\n" + line + " " + "z " * 40), (505, "same " * 40), (506, "w1 w2 " * 3000)]
    return out


def test_counts(spark):
    cases = cases_of()
    got = rows(q.quality(frame(spark, cases)), *COLS)
    assert got == sorted((base(*c) for c in cases), key=lambda r: tuple((x is not None, x) for x in r))
    assert q.quality(frame(spark, [])).count() == 0


def key(v):
    s = max(len(bin(v)) - 2 - 8, 0)
    return s * 256 + (v >> s)


def test_thresholds_follow_groups(spark):
    r = random.Random(2)
    text = lambda bars, n=60: " ".join(("|" if r.random() < bars else "") + r.choice("abcdefgh") * r.randint(2, 6) + str(r.random())[2:6] for _ in range(n))
    data = []
    for i in range(120):  # tables are common in one source, and odd in the other
        data.append((i, text(0.5), "en", "tables"))
        data.append((1000 + i, text(0.0), "en", "prose"))
    data += [(2000, text(0.6), "en", "prose"), (2001, text(0.6), "en", "tables"), (2002, text(0.0), None, None), (2003, text(0.0), "en", "rare"), (2004, text(0.6), "en", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x.kept for x in q.quality(df, prior=20).collect()}
    assert not got[2000] and got[2001] and got[2002] and got[2003]
    assert all(got[i] and got[1000 + i] for i in range(120))
    kept = q.filter_quality(df, prior=20)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, k in got.items() if k)


def test_sketches_merge(spark):
    r = random.Random(3)
    values = [int(10 ** (r.random() * 6)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = sorted((x[0], x[1]) for x in df.select("v", q.bucket(df.v)).collect())
    assert got == sorted((v, key(v)) for v in values)
    lows = {k: ((k & 255) << (k >> 8)) for _, k in got}
    assert all(lows[k] <= v <= lows[k] * 129 / 128 + 1 for v, k in got)


def test_filter_keeps_columns_and_rows(spark):
    cases = cases_of(4)
    df = frame(spark, cases)
    out = q.filter_quality(df)
    want = Counter(x.doc_id for x in q.quality(df).where("kept").collect())
    assert Counter(x.doc_id for x in out.collect()) == want and out.columns == df.columns
    assert q.filter_quality(df.limit(0)).count() == 0


def test_every_threshold_differs_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counted = materialize(q.features(docs, {"lang": docs.lang, "source": docs.source}), "counted")
    limits = q.limits_of(materialize(q.sketch(counted.where("NOT base_failed"), ["lang", "source"]), "sketch")).collect()
    assert len(limits) == 80
    for m, rule in q.METRICS.items():
        values = {r[f"t_{m}"] for r in limits}
        assert len(values) > 20 and min(values) > rule[-1], m  # the least threshold never decides


def test_a_source_full_of_junk_sets_no_standard(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefgh") * r.randint(2, 6) + str(r.random())[2:6]
    clean = lambda: " ".join(word() + ("," if r.random() < 0.1 else "") for _ in range(60))
    junk = lambda: " ".join("####" + word() for _ in range(60))
    data = [(i, clean(), "en", "good") for i in range(900)] + [(1000 + i, junk() if i % 3 == 0 else clean(), "en", "bad") for i in range(150)]
    kept = {x.doc_id for x in q.quality(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")).where("kept").collect()}
    assert {d[0] for d in data} - kept == {i for i, _, _, s in data if s == "bad" and (i - 1000) % 3 == 0}


def test_filter_takes_any_column_names(spark):
    cases = cases_of(4)
    clash = ["h1", "h2", "__h1", "n_words", "kept", "t_symbols", "g_lang", "__t", "__w", "n", "metric", "bucket"]
    df = frame(spark, cases).select("doc_id", "text", "lang", "source", "n_chars")
    for c in clash:
        df = df.withColumn(c, df.doc_id + 1)
    out = q.filter_quality(df)
    assert out.columns == df.columns and Counter(map(tuple, out.collect())) <= Counter(map(tuple, df.collect())) and out.count() > 0
