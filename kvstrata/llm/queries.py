"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm import chat, decontaminate, neardup, ngram_lm, pii, quality, sentencepiece_bpe, substring, token_files, warc
from kvstrata.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False, with_text=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


#: The key of tests and demonstrations.
PII_KEY = "kvstrata-demo-key"


def pii_key(spark: SparkSession) -> str:
    """The session's key, from a setting that Spark's logs redact by its name."""
    return spark.conf.get("spark.kvstrata.pii.secret", PII_KEY)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pii_key(spark))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=80)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.split_and_score(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


#: A conversation that says what the template says.
_CONTROL = r"\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{_CONTROL}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.round_trip(rows.unionByName(extra), tokenizer=tokenizer_path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeats": op5_repeats,
    "op6_warc": op6_warc,
    "op7_ngram_model": op7_ngram_model,
    "op8_token_files": op8_token_files,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}

_WORDS10 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS2 = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_METRICS2 = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {lo} AS plo, {hi} AS phi, {factor} AS factor, {least} AS least, CAST({e.replace('DIV', '//')} AS BIGINT) AS v FROM f WHERE NOT base_failed" for m, (e, lo, hi, factor, least) in quality.METRICS.items())


def _limits2(groups: str) -> str:
    """Thresholds of sketches by group, as one row for each group and metric."""
    per = groups + ", " if groups else ""
    return f"""SELECT {per}metric, max(n) AS n, greatest(max(hi) + max(factor) * (max(hi) - max(lo)), max(least)) AS t FROM (
  SELECT {per}metric, factor, least, n, min(CASE WHEN 100 * cum >= plo * n THEN edge END) OVER g AS lo, min(CASE WHEN 100 * cum >= phi * n THEN edge END) OVER g AS hi FROM (
    SELECT {per}metric, plo, phi, factor, least, edge, sum(c) OVER (PARTITION BY {per}metric ORDER BY k) AS cum, sum(c) OVER (PARTITION BY {per}metric) AS n FROM (
      SELECT {per}metric, plo, phi, factor, least, k, (k % 256) << (k // 256) AS edge, count(*) AS c FROM sk GROUP BY ALL))
  WINDOW g AS (PARTITION BY {per}metric)) GROUP BY ALL"""


_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS2} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT r, p, array_to_string(w[p:p+4], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
q AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals, CAST(len(regexp_extract_all(text, '[.,;:!?]')) AS BIGINT) AS n_marks FROM w LEFT JOIN q USING (r)),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
m AS ({_METRICS2}),
sk AS MATERIALIZED (SELECT *, greatest(length(bin(v)) - 8, 0) * 256 + (v >> greatest(length(bin(v)) - 8, 0)) AS k FROM m),
l1 AS ({_limits2("lang, source")}), l2 AS ({_limits2("lang")}), l3 AS ({_limits2("")}),
b2 AS (SELECT l2.lang, metric, (l2.n * l2.t + {quality.PRIOR} * l3.t) // (l2.n + {quality.PRIOR}) AS t FROM l2 JOIN l3 USING (metric)),
lim AS (SELECT l1.lang, l1.source, metric, least((l1.n * l1.t + {quality.PRIOR} * b2.t) // (l1.n + {quality.PRIOR}), 2 * b2.t) AS t FROM l1 JOIN b2 USING (metric) WHERE l1.lang IS NOT DISTINCT FROM b2.lang),
bad AS (SELECT DISTINCT r FROM (SELECT f.r, f.lang, f.source, u.metric, u.v FROM f, LATERAL ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {e.replace('DIV', '//')} AS v" for m, (e, *_) in quality.METRICS.items())}) u) x JOIN lim ON lim.metric = x.metric AND lim.lang IS NOT DISTINCT FROM x.lang AND lim.source IS NOT DISTINCT FROM x.source WHERE v > t)
SELECT f.* EXCLUDE (r, lang, source), NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f"""

ORACLES: dict[str, str] = {
    "op2_quality": _OP2,
    "op4_near_duplicates": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE CAST([] AS VARCHAR[]) END) AS sh FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""".replace("\\\\", "\\"),
    "op5_repeats": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM v JOIN f USING (win) WHERE first < doc_id),
r AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS10}, CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS10} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS m, unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 2), lambda i: array_to_string(w[i:i+7], ' '))) AS win FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p+m-1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.doc_id, dw.m, dw.p, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
