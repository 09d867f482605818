"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import words

WINDOW = 8

#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was with as on be by this are from or "
    "de la que el en y los del se las un por con para una "
    "le les et des du une dans est pour pas qui sur au par "
    "der die und den von das mit dem ist ein eine nicht zu auf"
).split()

#: (rule, measure, least, most): a document fails where the measure lies outside; None is no bound.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("too short", "n_words", 20, None),
    ("repeated passages", "repeat_ratio", None, 0.30),
    ("odd word length", "mean_word_chars", 1.5, 25),
    ("too many symbols", "symbol_ratio", None, 0.10),
    ("repeated lines", "dup_line_ratio", None, 0.50),
    ("no running text", "stop_ratio", 0.005, None),
)
BASE_RULES = ("too short", "repeated passages")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts the ratios need).

    Windows of eight words are compared by their 64-bit hashes. Texts without a repeated window, found
    with one hash set, end there; for the others the windows are sorted by hash to find the equal ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", words(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    hashed = split.select(
        "doc_id", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = hashed.withColumn("ordered", F.when(some, F.sort_array(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("ordered", i - 1)["h"] == x["h"]) | (F.get("ordered", i + 1)["h"] == x["h"])
    found = ordered.withColumn("found", F.sort_array(F.transform(F.filter("ordered", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("found", start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).cast("long").alias("n")))["n"]
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hashes", "ordered", "found")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


RATIOS = {"repeat_ratio": ("n_repeat_words", "n_words"), "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "stop_ratio": ("n_stop_words", "n_words")}


def compiled(thresholds=THRESHOLDS) -> dict[str, Column]:
    """For each rule of the table the condition under which a document fails it."""
    out = {}
    for rule, measure, least, most in thresholds:
        value = _ratio(*RATIOS[measure]) if measure in RATIOS else F.col(measure)
        bounds = [b for b in (value < least if least is not None else None, value > most if most is not None else None) if b is not None]
        out[rule] = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) for each row.

    A null, empty or blank text has no words and fails. Rows are judged one by one: repeated rows get
    repeated results, an empty table none. Columns other than id and text aren't read. ``failed`` lists
    the rules of the table that the document breaks.
    """
    conditions = compiled(thresholds)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in conditions.items())))
    judged = measures(docs, id_col, text_col).withColumn("failed", failed).withColumn("base_failed", base)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


_FAILS = ",\n  ".join(f"CASE WHEN {' OR '.join([f'{m} < {a}'] * (a is not None) + [f'{m} > {b}'] * (b is not None))} THEN '{rule}' END" for rule, m, a, b in THRESHOLDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(step, {WINDOW}))) AS n FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words
  FROM d JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id),
r AS (SELECT *, {", ".join(f"coalesce({a} / nullif({b}, 0), 0) AS {name}" for name, (a, b) in RATIOS.items())} FROM m),
f AS (SELECT *, concat_ws(', ', {_FAILS}) AS failed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f
"""
