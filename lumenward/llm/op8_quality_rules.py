"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.llm.common import read_table, typed
from lumenward.llm.quality_rules import BASE_RULES, BIT, LATEST, POLICIES, ablation, judge, ledger, mask
from lumenward.storage import Scratch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ledger entry, the verdict of each policy, and the latest policy's ablation: the rule
    that alone rejects a document, and how many documents would be kept without it."""
    texts = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    entries = Scratch(spark).table(ledger(texts), "ledger")
    for policy in POLICIES:
        entries = judge(entries, policy, f"kept_v{policy}")
    alone = " ".join(f"WHEN {BIT[rule]}L THEN '{rule}'" for rule in POLICIES[LATEST])
    without = ablation(entries).selectExpr("rule AS _rule", "kept_without")
    return entries.withColumn("sole_rule", F.expr(f"CASE failed & {mask(POLICIES[LATEST])}L {alone} END")).join(
        F.broadcast(without), F.col("sole_rule") == F.col("_rule"), "left").selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"(failed & {mask(BASE_RULES)}L) <> 0 AS base_failed", f"kept_v{LATEST} AS kept", "failed AS failed_bits", "n_lines", "n_upper",
        "n_letters", "kept_v1", "kept_v2", "sole_rule", "kept_without AS sole_rule_documents")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM w, unnest(range(1, len(ws) - 1)) AS r(i) WHERE len(ws) >= 3),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS o(j) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT rid, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM worded GROUP BY rid),
m AS (SELECT d.doc_id, len(w.ws) AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS word_chars,
        length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(per.n_dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
        coalesce(per.n_lines, 0) AS n_lines,
        length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')) AS n_upper,
        length(d.text) - length(regexp_replace(d.text, '[A-Za-z]', '', 'g')) AS n_letters
      FROM d JOIN w USING (rid) LEFT JOIN per USING (rid) LEFT JOIN repeated USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN n_words > 0 AND word_chars > 25 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN n_letters > 0 AND 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, cast(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  bits & 3 <> 0 AS base_failed, bits = 0 AS kept, cast(bits AS BIGINT) AS failed_bits, n_lines, n_upper, n_letters,
  bits & 3 = 0 AS kept_v1, bits & 39 = 0 AS kept_v2,
  CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'short_words'
    WHEN 16 THEN 'long_words' WHEN 32 THEN 'duplicate_lines' WHEN 64 THEN 'shouting' END AS sole_rule,
  CASE WHEN bits IN (1, 2, 4, 8, 16, 32, 64) THEN count(*) OVER (PARTITION BY bits) END AS sole_rule_documents
FROM b
"""
