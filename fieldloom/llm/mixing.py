"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target of words; it passes whole epochs of its documents while they fit, and the rest is a weighted
sample without replacement: a document's key is -ln(u) / w for its quality weight w and a uniform u of its identity,
documents go in ascending order of key and the prefix whose sum comes nearest the budget is taken.

The order within a source is never sorted in one task: keys fall into 4,096 ranges by a monotone function, range sums
are pre-aggregated, and only the documents of the one range where a budget ends are sorted.  Every source so gets one
cut (its largest taken order key), and documents are compared with their source's cut; the text is neither shuffled
nor sorted.  Sources are ranked and summed over ranges of the order too (``accumulated``), so neither their number nor
their size meets in one task.  The table of cuts has one row for a source; Spark broadcasts it only while its files are
below the session's threshold and joins by shuffle beyond.

Defined results: null texts have size 0; a null source is a source and comes last; a key is fixed by doc_id and text, so
rows that share a doc_id (or have none) are drawn apart; rows that tie in key, doc_id and size are counted at a cut, and
as many of them are taken as come nearest the budget (which of them is immaterial, they hold the same document); empty
tables give empty results; a source without words gets target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import private, read_table, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
RANGES = 4096
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols a text has for each word."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 fixed by the seed, doc_id and text."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def with_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with _size and _key."""
    out = docs.withColumn("_size", size_of(text_or_empty(text)))
    return out.withColumn("_key", -F.log(uniform(F.col(doc_id), text_or_empty(text))) / quality_weight(text_or_empty(text), F.col("_size")))


def accumulated(table: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``table`` with ``_rank`` (from 1) and, for each (name, column) of ``sums``, the sum of that column over all rows before.

    Rows are dealt by ranges of ``order``, summed within a range, and each range gets the sums of the ranges before it;
    only one row for each range meets in a single window.
    """
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(table.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in ("_n", *(f"_t_{name}" for name in sums))))
    within = Window.partitionBy("_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({"_rank": F.row_number().over(within)} | {name: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for name, c in sums.items()})
    own = own.join(base, "_range")
    return own.withColumns({"_rank": F.col("_rank") + F.col("_b__n")} | {name: F.col(name) + F.col(f"_b__t_{name}") for name in sums}).select(*table.columns, "_rank", *sums)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target.  ``sizes``: (source, source_size), one row each.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; no target exceeds ``epochs``
    times its source's size, the excess is reshared by weight.  Filling in ascending order of cap / weight settles
    every source in one pass: it is capped if its fair part of what is left reaches its cap.  The first source that is
    not fixes the level of all after it.
    """
    ranked = accumulated(sizes, [F.col("source").asc_nulls_last()], {})
    turn = ((F.col("_rank") - 1) % len(weights)).cast("int")
    weighed = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)).withColumn("cap", F.col("source_size") * epochs).drop("_rank")
    filled = accumulated(weighed.withColumn("fill", F.col("cap") / F.col("w")), [F.col("fill").asc(), F.col("source").asc_nulls_last()], {"capped": "cap", "passed": "w"})
    filled = written(filled, "filled")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    left, among = F.lit(whole["size"] or 0) - F.col("capped"), F.lit(whole["w"] or 0.0) - F.col("passed")
    open_ = filled.withColumns({"left": left, "among": among}).where(F.col("left") * F.col("w") < F.col("cap") * F.col("among"))
    level = open_.agg(F.min(F.struct("_rank", "left", "among")).alias("level")).first()["level"]
    own = F.col("cap").cast("double")
    if level is not None:
        own = F.when(F.col("_rank") >= level["_rank"], F.lit(level["left"]) * F.col("w") / F.lit(level["among"])).otherwise(own)
    return filled.select("source", "source_size", own.alias("target"))


def cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, whole epochs and where the fractional part ends: the last range, the last order key
    (null: none of that range), and of the rows that tie there how many are (_all) and how many are taken (_some).

    keyed: source, doc_id, size, key.
    """
    bucket = F.least(F.floor(F.col("key") / (F.col("key") + 1) * RANGES), F.lit(RANGES - 1))
    keyed = keyed.withColumn("bucket", bucket)
    ranges = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sizes = ranges.groupBy("source").agg(F.sum("sum").alias("source_size"))
    goal = targets(sizes, weights, epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = written(goal.withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "targets")
    by_key = Window.partitionBy("source").orderBy("bucket")
    placed = ranges.withColumn("before", F.coalesce(F.sum("sum").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = goal.select(F.col("source").alias("_source"), "budget")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).where((F.col("before") < F.col("budget")) & (F.col("sum") > 0))
    # the last range that begins below the budget is the one where it ends
    last = placed.groupBy("_source").agg(F.max(F.struct("bucket", "before", "budget")).alias("x")).select("_source", F.col("x.bucket").alias("_bucket"), "x.before", "x.budget")
    last = written(last, "ranges")
    edge = keyed.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    # rows that tie are one step of as many words as they hold together
    edge = edge.groupBy("source", "key", "doc_id", "size", "before", "budget").agg(F.count(F.lit(1)).alias("_all"))
    ordered = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("prefix", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("_all")).over(ordered), F.lit(0)))
    fits = lambda k: 2 * (F.col("prefix") + k * F.col("size")) + F.col("size") < 2 * F.col("budget")  # noqa: E731 - whether the k-th of them, from 0, is taken
    guess = F.ceil(F.try_divide(2 * (F.col("budget") - F.col("prefix")) - F.col("size"), 2 * F.col("size")))
    guess = F.greatest(F.lit(0), F.least(F.coalesce(guess, F.col("_all")), F.col("_all"))).cast("long")
    edge = edge.withColumn("_guess", guess).withColumn("_some", F.when(fits(F.col("_guess")) & (F.col("_guess") < F.col("_all")), F.col("_guess") + 1).when((F.col("_guess") > 0) & ~fits(F.col("_guess") - 1), F.col("_guess") - 1).otherwise(F.col("_guess")))
    taken = edge.where("_some > 0").groupBy("source").agg(F.max(F.struct("key", "doc_id", "size", "_all", "_some")).alias("x"))
    taken = taken.select(F.col("source").alias("_source"), F.struct("x.key", "x.doc_id", "x.size").alias("last"), "x._all", "x._some")
    out = goal.join(taken, goal["source"].eqNullSafe(taken["_source"]), "left").drop("_source")
    # no document of the last range fits: all ranges before it are taken
    none = last.select(F.col("_source").alias("_s"), "_bucket")
    out = out.join(none, out["source"].eqNullSafe(none["_s"]), "left").drop("_s")
    return out.select("source", "source_size", "target", "epochs", "last", F.col("_bucket").alias("last_bucket"), "_all", "_some")


def _counted(tied: DataFrame) -> DataFrame:
    """``tied`` with _copies: of a source's rows at the cut the first ``_some``.  Rows are numbered within the partition they
    are written in, and partitions get the counts of those before them, so a group of any size is nobody's single task."""
    placed = written(tied.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "tied")
    sums = placed.groupBy("_part", "_source").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("_part").alias("_p"), F.col("_source").alias("_s"), before.alias("_before"))
    numbered = placed.join(sums, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part", "_source").orderBy("_row"))
    return numbered.withColumn("_copies", F.col("epochs") + (number <= F.col("_some")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``docs``, columns renamed by ``private``, with _size, _source_size, _target and _copies, the times the mix holds the document."""
    own, name = private(docs)
    doc_id, source = F.col(name["doc_id"]), F.col(name["source"])
    keyed = with_keys(own, name["doc_id"], name["text"])
    narrow = written(keyed.select(source.alias("source"), doc_id.alias("doc_id"), F.col("_size").alias("size"), F.col("_key").alias("key")), "keys")
    found = written(cuts(narrow, weights, epochs), "cuts")
    split = bool(found.where("_some < _all").take(1))
    found = found.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "epochs", "last", "last_bucket", "_all", "_some")
    out = keyed.join(found, source.eqNullSafe(F.col("_source")), "left")
    bucket = F.least(F.floor(F.col("_key") / (F.col("_key") + 1) * RANGES), F.lit(RANGES - 1))
    place = F.struct(F.col("_key").alias("key"), doc_id.alias("doc_id"), F.col("_size").alias("size"))
    inside = F.coalesce((bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & F.coalesce(place <= F.col("last"), F.lit(False))), F.lit(False))
    whole = out.withColumn("_copies", F.col("epochs") + inside.cast("long"))
    columns = [*own.columns, "_size", "_source_size", "_target", "_copies"]
    if not split:  # no tie is cut: every row of a tie has one and the same answer
        return whole.select(*columns)
    at_cut = F.coalesce(place.eqNullSafe(F.col("last")) & (F.col("_some") < F.col("_all")), F.lit(False))
    return whole.where(~at_cut).select(*columns).unionByName(_counted(out.where(at_cut)).select(*columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix: every document as often as it is taken."""
    out = mixed(docs, weights, epochs).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*private(docs)[0].columns).toDF(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    out = mixed(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(F.col("_c0").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


SQL = {
    "op5_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {1 << 52}.0)
  / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g'))) / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
p AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank FROM w),
l AS (SELECT * FROM p WHERE rest * w < cap * among ORDER BY rank LIMIT 1),
t AS (SELECT p.source, p.source_size, CASE WHEN p.rank < coalesce(l.rank, {1 << 60}) THEN p.cap ELSE l.rest * p.w / l.among END AS target FROM p LEFT JOIN l ON TRUE),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
o AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * prefix + size < 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
}
