"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule is a ratio ``100 * numerator`` against ``denominator`` in whole numbers, with a lower and an upper bound in
percent; a document passes if all rules hold.  Counts come from built-in array and string functions over the whole
text; no user function, shuffle or row limit is involved.  Repeated 5-word windows are found by sorting (hash,
position) within the row, n log n in the text's words, and only in texts that have a repeat at all.

Defined results: null texts are empty (all counts 0, base failed); extra columns are ignored; repeated rows are judged
alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "as", "are", "this", "with", "be", "by", "or", "an", "at"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "en", "que", "est", "dans", "pour", "qui", "du", "au"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "ein", "ist", "mit", "auf", "für", "im", "des", "eine"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "un", "las", "por", "con", "una", "es", "del", "se", "para"],
}


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * numerator / denominator <= high``; a bound of None is open.  An empty denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        """The rule as a column of whole-number comparisons."""
        part, whole = F.lit(100) * F.col(self.numerator), F.col(self.denominator)
        checks = [part >= F.lit(self.low) * whole] if self.low is not None else []
        checks += [part <= F.lit(self.high) * whole] if self.high is not None else []
        out = F.lit(True)
        for x in checks:
            out = out & x
        return (whole == 0) | out

    def sql(self) -> str:
        parts = [f"100 * {self.numerator} >= {self.low} * {self.denominator}"] if self.low is not None else []
        parts += [f"100 * {self.numerator} <= {self.high} * {self.denominator}"] if self.high is not None else []
        return f"({self.denominator} = 0 OR ({' AND '.join(parts) or 'TRUE'}))"


RULES = (
    Rule("word_length", "word_chars", "n_words", 250, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("shouting", "n_shouted", "n_words", None, 30),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_shouted", "n_repeat_words")
RESULTS = {*COUNTS, *(f"rule_{r.name}" for r in RULES), "base_failed", "kept"}


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns (but for those named like a result) and the counts the rules and the base use, all long."""
    keep = [c for c in keep if c not in RESULTS]
    size = lambda c: F.size(c).cast("long")
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    own = [f"_k{i}" for i in range(len(keep))]
    out = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), text_or_empty().alias("_text"))
    out = out.select(
        *own,
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_lines"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        # the capital comes before the look behind it, so few places get that far
        F.regexp_count("_text", F.lit(r"\p{Lu}(?<![^\x20\x09-\x0D]\p{Lu})\p{Lu}+[!?.,]*(?![^\x20\x09-\x0D])")).cast("long").alias("n_shouted"),
    )
    out = out.withColumns(
        {
            "n_words": size("_words"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": size("_lines"),
            "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")),
            "n_stop_words": size(F.filter("_words", lambda x: F.lower(x).isin(stop))),
            "_h": F.transform("_words", lambda x: F.xxhash64(x)),
        }
    ).drop("_lines", "_words")
    # windows of five: every word's hash with the four behind it
    windows = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 4, F.lit(0)))
    out = out.withColumn("_g", F.transform(windows, lambda x, i: F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, 5))))).drop("_h")
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_s", F.when(repeats, F.sort_array(pairs)).otherwise(none)).drop("_g")
    out = out.withColumn("_eq", F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    either = F.zip_with("_eq", F.concat(F.array(F.lit(False)), "_eq"), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    at = F.filter(F.zip_with("_s", either, lambda s, f: F.when(f, s["i"])), lambda x: x.isNotNull())
    out = out.withColumn("_p", F.sort_array(at)).drop("_s", "_eq")
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), *COUNTS)


BASE = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def verdicts(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, a boolean for each rule, base_failed and kept."""
    out = counts(docs, keep).withColumns({f"rule_{r.name}": r.holds() for r in rules} | {"base_failed": F.expr(BASE)})
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"rule_{r.name}")
    return out.withColumn("kept", kept)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return verdicts(read_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *names)


_stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))

SQL = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, regexp_extract_all(t, '{WORD}') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS a, words FROM w WHERE len(words) >= 5),
k AS (SELECT rid, a, array_to_string(words[a:a + 4], ' ') AS h FROM g),
dup AS (SELECT rid, a FROM k QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
rep AS (SELECT rid, count(DISTINCT a + o) AS n FROM dup, range(5) t(o) GROUP BY rid),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({_stop}))) AS n_stop_words,
  len(list_filter(words, lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}[!?.,]*'))) AS n_shouted
  FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed,
  NOT {BASE} AND {" AND ".join(r.sql() for r in RULES)} AS kept FROM c
"""
}
