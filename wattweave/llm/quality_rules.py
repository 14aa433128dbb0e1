"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import SPACES, WORD, id_and_text, stored, words

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000

#: What a rule rejects, over the columns of signals().
RULES = {
    "symbols": "100 * n_symbols > 20 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "alphabetic": r"2 * size(filter(words, w -> w rlike '\\p{L}')) < n_words",
    "replacement": "1000 * (length(text) - length(translate(text, '�', ''))) > 20 * length(text)",
}


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, n_lines (with a word), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, n = F.col("text"), F.col("n_words")
    rows = id_and_text(docs).withColumn("words", words(text)).withColumn(
        "lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)))
    rows = rows.select(
        "doc_id", "text", "words", F.size("lines").cast("long").alias("n_lines"), F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return rows.withColumn("n_repeat_words", repeat_words(F.col("words")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(all_words: Column) -> Column:
    """Number of words in a 3-word window that is found twice or more.

    Sorted with their places, equal windows are neighbours; texts without a repeat skip the sort.
    """

    def windows(w):
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                                                  lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def in_order(h):
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("window"), i.alias("at"))))

    def covered(s):
        again = F.filter(s, lambda x, i: (F.get(s, i + 1)["window"] == x["window"])
                         | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["window"] == x["window"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    def counted(h):
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(in_order(h), covered)).otherwise(0)

    return F.coalesce(let(all_words, lambda w: let(windows(w), counted)), F.lit(0)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimate(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Per rule (seconds, share rejected) on a sample of about so many rows, chosen by a hash of id and text."""
    total = docs.count()
    if not total:
        return {name: (1.0, 0.0) for name in rules}
    share = min(1.0, rows / total)
    sample = id_and_text(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = stored(signals(sample), "quality-sample").where(~base_failed())
    sample.agg(F.count_if(base_failed())).first()
    found = {}
    for name, rule in rules.items():
        start = time.perf_counter()
        n, bad = sample.agg(F.count(F.lit(1)), F.count_if(F.expr(rule))).first()
        found[name] = (time.perf_counter() - start, bad / n if n else 0.0)
    return found


def order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejection per cost first; of equals the cheaper, then by name."""
    return sorted(estimates, key=lambda r: (-estimates[r][1] / max(estimates[r][0], 1e-6), estimates[r][0], r))


def quality_rules(docs: DataFrame, rules: dict[str, str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every text.

    kept is true if neither the base nor a rule rejects the text. The rules run as one CASE: each text stops at its
    first rejection, and the order comes from estimate(), so it changes the cost and never the verdict. One scan,
    no shuffle. Null and empty texts have no word: the counts are 0, base_failed is true, kept false. Null doc_id and
    repeated rows stay, a row each. Empty table: no rows. Other columns are not read.
    """
    rules = RULES if rules is None else rules
    verdict = F.when(base_failed(), F.lit(False))
    for name in order(estimate(docs, rules, rows)):
        verdict = verdict.when(F.expr(rules[name]), F.lit(False))
    return signals(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), win AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM cut
), trio AS (
  SELECT doc_id, i, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM win WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT * FROM trio WHERE c IS NOT NULL
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY 1
), counted AS (
  SELECT doc_id, text, words, len(words) AS n_words, len(lines) AS n_lines,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 50 * n_lines
            OR 2 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < n_words
            OR 1000 * (length(text) - length(translate(text, chr(65533), ''))) > 20 * length(text)) AS kept
FROM judged
"""
