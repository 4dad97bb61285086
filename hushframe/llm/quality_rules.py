"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, packed, text_of, unpacked, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it was for on are as this by at from an or "
    "der die das und ist von mit sich des dem den nicht ein eine auf für im zu als auch "
    "le la les de des et est que qui dans une un pour pas sur du en au aux avec "
    "el los las y es por con para del se una su lo como más"
).split()

#: Rule name, numerator, denominator (None: the number alone), least and most value allowed.
THRESHOLDS: list[tuple[str, str, str | None, float | None, float | None]] = [
    ("words", "n_words", None, 50, 10_000_000),
    ("word_length", "word_chars", "n_words", 2, 14),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_full_lines", None, 0.5),
]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_full_lines", "n_dup_lines", "n_stop_words"]


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """Each row of docs as `row`, and the counts that the thresholds name. A null text has no words.

    n_repeat_words counts the words inside three-word windows found twice or more in the text. Windows are compared by
    64-bit hashes; sorting (hash, position) inside the row keeps this n log n for very long texts.
    """
    d = docs.select(packed(docs), text_of(text).alias("text"))
    d = d.select("row", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(BLANK.replace("[", "[^"))).alias("lines"))
    w = F.col("words")
    d = d.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_full_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.select("row", *COUNTS, F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    s = F.col("sorted")
    hits = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
    d = d.select("row", *COUNTS, hits.alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    return d.select("row", *COUNTS, F.when(F.col("hits").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def verdict(thresholds=THRESHOLDS) -> Column:
    """True where every threshold holds; a ratio over nothing counts as zero."""
    ok = F.lit(True)
    for _, top, bottom, least, most in thresholds:
        value = F.col(top).cast("double") if bottom is None else F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        if least is not None:
            ok = ok & (value >= F.lit(float(least)))
        if most is not None:
            ok = ok & (value <= F.lit(float(most)))
    return ok


def failed_rules(thresholds=THRESHOLDS) -> Column:
    """The names of the thresholds that a row fails."""
    return F.filter(F.array(*[F.when(~verdict([t]), F.lit(t[0])) for t in thresholds]), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with its counts, `base_failed`, `failed` (rule names) and `kept`.

    Empty and null texts have no words and fail; repeated rows are judged alike; extra columns pass through, but for those
    that have the name of a result, which the result replaces.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    results = {"base_failed": base, "failed": failed_rules(thresholds), "kept": ~base & verdict(thresholds)}
    return unpacked(docs, _measured(docs, text), **{c: F.col(c) for c in [*COUNTS, "n_repeat_words"]}, **results)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_full, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop, coalesce(n_repeat, 0) AS n_repeat_words
      FROM w LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND n_words <= 10000000
       AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
       AND coalesce(n_dup_lines / nullif(n_full, 0), 0) <= 0.5 AS kept
FROM m
"""
