"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, exact_dedup, html_extract, ngram_join, packing, quality_rules, substring_dedup, token_counts, token_output, toxicity
from lodestone.llm.common import Scratch, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_matrix(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = token_counts.with_revision(table(spark, sf_dir, "documents"))
    return token_counts.counts_after_edits(revised, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op9_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a written ledger: what each rule of the policy fails, alone and in all."""
    entries = quality_rules.write_ledger(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'quality').root}/ledger")
    return quality_rules.ablations(entries)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op9_ablations": op9_ablations,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_LEDGER = f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '{_WORD}')) AS ls FROM documents),
        v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 7]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) >= 8)),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM v, (SELECT unnest(range(8)) AS j) WHERE c > 1 GROUP BY 1),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
                     (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM t LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality_rules.RULES.values()))})::BIGINT AS fail_bits FROM m)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op7_ngram_join": f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
        SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
    "op9_quality_rules": f"""{_LEDGER}        SELECT *, fail_bits & {quality_rules.BASE.mask} <> 0 AS base_failed, fail_bits & {quality_rules.BASE.mask | quality_rules.DEFAULT.mask} = 0 AS kept,
               '{quality_rules.DEFAULT.name}/{quality_rules.DEFAULT.version}' AS policy FROM b""",
    "op9_ablations": f"""{_LEDGER}
        SELECT r.rule, sum((fail_bits & r.bit <> 0)::INT)::BIGINT AS n_failed, sum((fail_bits & {quality_rules.DEFAULT.mask} = r.bit)::INT)::BIGINT AS n_failed_alone,
               sum((fail_bits & {quality_rules.DEFAULT.mask} = 0)::INT)::BIGINT AS n_kept
        FROM b, (VALUES {", ".join(f"('{r}', {1 << list(quality_rules.RULES).index(r)})" for r in quality_rules.DEFAULT.rules)}) r(rule, bit) GROUP BY r.rule""",
}
