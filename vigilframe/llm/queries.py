"""Named queries of the operators, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import decontam, dualtree, licenses, lmscore, mixing, neardup, packing, quality, qualityrules, repair, secretscan, suffixes, wrappers
from vigilframe.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).select(
        "doc_id", (fold("doc_id", quality.FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, i, i + 12) AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, bw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def _joined(spans, kinds):
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    named = F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.concat_ws(",", named)


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), spans="all_spans")
    count = lambda kind: F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("all_spans"), secretscan.KINDS[:3]), 256).alias("base_sha256"), _joined(F.col("all_spans"), secretscan.KINDS).alias("spans"),
    )


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = qualityrules.learn(docs, table(spark, sf_dir, "labels"))
    return qualityrules.judged(qualityrules.counted(docs), forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly",
    )


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    part = lambda c: F.col(f"license.{c}")
    return found.select(
        "doc_id", *(part(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word")), F.array_join(part("base_labels"), ",").alias("base_labels"),
        F.array_join(part("labels"), ",").alias("labels"), part("score").alias("score"),
    )


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_source_mixing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


# Damage by CRC-32 in shifts; then a table of least (cost, audit) per state, one row of a conversation after the other. ``ins``: the inserts that can follow.
OP12_SQL = r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: CAST(unicode(substr(k, i, 1)) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS d FROM s),
r AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS twice FROM c)),
o AS (SELECT *, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS old,
  regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(q, q2, ic, ia, it) AS (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', E'\nuser:'), (0, 3, 10, 'II', E'\nuser:\nassistant:'), (1, 1, 0, '', ''), (1, 2, 5, 'I', E'\nuser:'),
  (1, 3, 10, 'II', E'\nuser:\nassistant:'), (2, 2, 0, '', ''), (2, 3, 5, 'I', E'\nassistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', E'\nuser:')),
step(q, q2, need, sc, sa, name) AS (VALUES (0, 1, 's', 0, 'K', NULL), (0, 2, 'u', 0, 'K', NULL), (1, 2, 'u', 0, 'K', NULL), (2, 3, 'a', 0, 'K', NULL), (3, 2, 'u', 0, 'K', NULL),
  (0, 2, NULL, 1, 'R', 'user'), (1, 2, NULL, 1, 'R', 'user'), (2, 3, NULL, 1, 'R', 'assistant'), (3, 2, NULL, 1, 'R', 'user'),
  (0, 0, NULL, 2, 'D', NULL), (1, 1, NULL, 2, 'D', NULL), (2, 2, NULL, 2, 'D', NULL), (3, 3, NULL, 2, 'D', NULL)),
e AS (SELECT step.q, ins.q2, need, sc + ic AS ec, sa, sa || ia AS ea, name, it FROM step JOIN ins ON step.q2 = ins.q),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, q2 AS q, {'c': ic, 'a': ia, 't': it} AS m FROM (SELECT DISTINCT conv_id FROM conversations), ins WHERE ins.q = 0
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, e.q2, min({'c': m.c + ec + CASE WHEN fault = 'truncated' AND sa <> 'D' THEN 5 ELSE 0 END, 'a': m.a || ea,
    't': m.t || CASE WHEN sa = 'D' THEN '' ELSE E'\n' || coalesce(name, role) || ':' || text END || it})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN e ON e.q = dp.q AND (need IS NULL OR need = ini) AND (sa = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY dp.conv_id, dp.i, e.q2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (old IS NOT NULL AND old || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT a.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(min(m).c AS BIGINT) AS cost, min(m).a AS audit, sha256(substr(min(m).t, 2)) AS repaired_sha256
FROM z JOIN dp ON dp.conv_id IS NOT DISTINCT FROM z.conv_id AND dp.i = z.n AND q IN (0, 3) GROUP BY ALL
"""


@query("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(table(spark, sf_dir, "conversations"))


def _codes_sql(rounds: int = dualtree.ROUNDS) -> str:
    """Lloyd rounds written out; distances of integers by scalar products, which are exact."""
    nearest = """SELECT x.r, x.part, min({{'d': CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT), 'k': b.k}}) AS m, any_value(v) AS v
FROM x JOIN b{0} AS b USING (part) GROUP BY x.r, x.part"""
    moved = """a{0} AS (""" + nearest + """),
u{0} AS (SELECT part, k, list(c ORDER BY j) AS c FROM (SELECT part, m.k AS k, j, floor(sum(v[j]) / count(*)) AS c FROM a{0}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{1} AS (SELECT b.part, b.k, coalesce(u.c, b.c) AS c FROM b{0} AS b LEFT JOIN u{0} AS u USING (part, k))"""
    return f"""
WITH g AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda e: floor(CAST(e AS DOUBLE) * {dualtree.SCALE})) AS w FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT r, part, list_slice(w, part * (len(w) // {dualtree.PARTS}) + 1, (part + 1) * (len(w) // {dualtree.PARTS})) AS v FROM g, (SELECT unnest(range({dualtree.PARTS})) AS part)),
b0 AS (SELECT part, r AS k, v AS c FROM x WHERE r < {dualtree.ENTRIES}),
{", ".join(moved.format(k, k + 1) for k in range(rounds))},
z AS ({nearest.format(rounds)}),
t AS (SELECT r, string_agg(printf('%02x', CAST(m.k AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM z GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, k, j)) FROM b{rounds}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS j)) AS codebooks_sha256
FROM t JOIN g USING (r)
"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.compressed(table(spark, sf_dir, "embeddings"))
