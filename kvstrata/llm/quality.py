"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets counts that one pass over its text yields. Documents that pass the
base rules feed quantile sketches, one for each language, source and metric: log-linear
histograms, whose buckets are at most 1/128 of their value wide and which merge by
adding counts. A sketch's two quantiles give a threshold, ``high + factor * (high - low)``:
the middle and the upper quartile where values spread (up to a quarter of outliers
doesn't move them), the middle and the last fiftieth where most documents have none. A
group's threshold leans on its language's, and that on the one of all, the more the
fewer documents it has; and it is at most twice its language's, so that a source full
of junk doesn't set its own standard. A document is kept if none of its metrics is above
its group's threshold.

Defined results: a null text has no words (and so fails the base rules); null languages
and sources are groups of their own; rows are judged one by one, so repeated rows share
a verdict; an empty table gives no rows. Languages and sources are matched exactly. Very
long texts are judged whole; one text's words and windows are what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, owning, release

SPACE = r"[\x20\x09-\x0D]"
#: name -> (per ten thousand words or characters, low and high percentile, factor, least threshold)
METRICS = {
    "symbols": ("10000 * (n_symbols + n_marks) DIV greatest(word_chars, 1)", 50, 75, 12, 100),
    "dup_lines": ("10000 * n_dup_lines DIV greatest(n_lines, 1)", 50, 98, 2, 500),
    "repeats": ("10000 * n_repeat_words DIV greatest(n_words, 1)", 50, 98, 2, 200),
    "capitals": ("10000 * n_capitals DIV greatest(word_chars, 1)", 50, 75, 12, 100),
    "marks": ("10000 * n_marks DIV greatest(word_chars, 1)", 50, 75, 12, 100),
    "word_length": ("100 * word_chars DIV greatest(n_words, 1)", 50, 75, 12, 100),
}
#: Documents of the coarser group that a group's own threshold is averaged with.
PRIOR = 200
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that stand in the text twice or more.

    The windows' hashes tell whether any repeats; only then are they sorted with their
    places, and the places of repeated ones merged into spans. Linear memory in the
    text, nothing is exploded or shuffled."""
    last = F.size(words) - size + 1
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))

    def spans(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda k, j: F.get(p, k)["h"] == F.get(p, j)["h"]
            at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k < F.size(p) - 1) & same(k, k + 1)))
            return F.array_sort(F.transform(at, lambda k: F.get(p, k)["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda s, i: F.struct((i + size).alias("end"), (s["total"] + i + size - F.greatest(i, s["end"])).alias("total"))
        return F.aggregate(_let(pairs, starts), zero, step, lambda s: s["total"])

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(spans(h))

    return F.when(last > 0, _let(hashes, count)).otherwise(0)


def features(docs: DataFrame, keep: dict[str, Column], *, text_col: str = "text", window: int = 5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Columns ``keep`` and the counts of each row's text, and base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(*[c.alias(n) for n, c in keep.items()], text.alias("__t"))
    words = F.array_remove(F.split("__t", SPACE + "+"), "")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    narrow = narrow.withColumn("__w", words).withColumn("__l", lines)
    out = narrow.select(
        *keep,
        F.size("__w").alias("n_words"),
        F.length(F.array_join("__w", "")).alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        _repeated_words(F.col("__w"), window).alias("n_repeat_words"),
        F.size("__l").alias("n_lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count("__t", F.lit("[.,;:!?]")).alias("n_marks"),
    )
    out = out.select(*keep, *[F.col(c).cast("bigint").alias(c) for c in COUNTS])
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative integer: exact below 256, else its top 8 bits."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return shift.cast("bigint") * 256 + F.call_function("shiftright", value, shift)


def sketch(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of all metrics by group: one row for each bucket with its count. Counts
    are summed before the shuffle, so a group of any size sends few rows."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.expr(e).cast("bigint")).alias("bucket")) for m, (e, *_) in METRICS.items()])
    return rows.select(*group, F.explode(values).alias("v")).groupBy(*group, "v.metric", "v.bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets are added."""
    return sketches.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, group: list[str]) -> DataFrame:
    """n (documents) and one threshold for each metric, by group."""
    per = [*group, "metric"]
    buckets = sketches.groupBy(*per).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bucket", F.col("n").alias("c")))).alias("b"))
    of = lambda i: F.create_map(*[F.lit(x) for m, rule in METRICS.items() for x in (m, rule[i])])[F.col("metric")]

    def quantile(percent: Column) -> Column:
        """Lower edge of the first bucket up to which that share of the values lies."""
        zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
        step = lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.coalesce(s["at"], F.when(100 * (s["seen"] + x["c"]) >= percent * F.col("n"), x["bucket"])).alias("at"))
        key = F.aggregate("b", zero, step, lambda s: s["at"])
        return F.call_function("shiftleft", F.pmod(key, F.lit(256)), F.expr("0") + (key / 256).cast("int"))

    edge = buckets.select(*per, "n", quantile(of(1)).alias("lo"), quantile(of(2)).alias("hi"))
    edge = edge.withColumn("t", F.greatest(F.col("hi") + of(3) * (F.col("hi") - F.col("lo")), of(4).cast("bigint")))
    return edge.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.col("t"))).alias(f"t_{m}") for m in METRICS])


def limits_of(fine: DataFrame, prior: int = PRIOR) -> DataFrame:
    """g_lang, g_source and one threshold ``t_`` for each metric, from the sketches by
    language and source; one small row for each group."""
    names = [f"t_{m}" for m in METRICS]
    of_lang = thresholds(merged(fine, ["lang"]), ["lang"])
    overall = thresholds(merged(fine, []), [])
    blend = lambda n, own, other: F.expr(f"({n} * {own} + {prior} * {other}) DIV ({n} + {prior})")
    c = overall.select(*[F.col(x).alias(f"c_{x}") for x in names]).limit(1)
    b = of_lang.join(F.broadcast(c))  # one row
    b = b.select(F.col("lang").alias("b_lang"), *[blend("n", x, f"c_{x}").alias(f"b_{x}") for x in names])
    a = thresholds(fine, ["lang", "source"]).join(b, F.col("lang").eqNullSafe(F.col("b_lang")))
    return a.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[F.least(blend("n", x, f"b_{x}"), 2 * F.col(f"b_{x}")).alias(x) for x in names])


def judge(rows: DataFrame, *, prior: int = PRIOR) -> DataFrame:
    """``rows`` of features with lang and source (one table in the shared folder, as it
    is read twice), with ``kept``. The thresholds are joined to the narrow rows; their
    side is small, and the optimizer broadcasts it only below its size limit."""
    fine = materialize(sketch(rows.where("NOT base_failed"), ["lang", "source"]), "quality-sketch")
    limits = materialize(limits_of(fine, prior), "quality-limits")
    release(fine)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    ok = F.lit(True)
    for m, (e, *_) in METRICS.items():
        ok = ok & (F.expr(e) <= F.col(f"t_{m}"))
    out = joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(ok, F.lit(True))))
    return owning(out.drop("g_lang", "g_source", *[f"t_{m}" for m in METRICS]), limits)


def _col(docs: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", **rules) -> DataFrame:
    """Per row: id, the counts, base_failed and kept."""
    rows = materialize(features(docs, {"__id": _col(docs, id_col), "lang": _col(docs, lang_col), "source": _col(docs, source_col)}, text_col=text_col), "quality-features")
    out = judge(rows, **rules)
    return owning(out.select(F.col("__id").alias(id_col), *COUNTS[:5], "base_failed", "kept", *COUNTS[5:]), rows, out)


def filter_quality(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged, whatever their names.

    One pass over the texts writes the rows with their counts to a table; the sketches
    read its counts, and each row is judged where it lies by its group's thresholds. No
    text is shuffled, no row needs an id, and copies of one text don't meet in a task."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    of = dict(zip(docs.columns, names, strict=True))
    keep = {n: F.col(n) for n in names} | {c: _col(inner, of[x] if x else None) for c, x in (("lang", lang_col), ("source", source_col))}
    rows = materialize(features(inner, keep, text_col=of[text_col]), "quality-features")
    judged = judge(rows, prior=prior)
    kept = judged.where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return owning(kept, rows, judged)
