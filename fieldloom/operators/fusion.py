"""Fusion of fine and coarse scenes: nearest dates, additive delta, leave-one-out agreement.

Scene tables hold one row for each (site_id, scene_date) and are joined by day ranges; pixels are joined on cell keys.
A day range is an equi-join: each fine date is spread over the days it covers, so no pair outside the range is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indices

def spread_days(dates: DataFrame, days: int, name: str) -> DataFrame:
    """(site_id, scene_date, name): every day within ``days`` of a date, and that date."""
    near = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    return dates.select("site_id", F.col("scene_date").alias(name), near.alias("_d")).select("site_id", F.expr(f"date_add({name}, _d)").alias("scene_date"), name)


def uncovered(coarse: DataFrame, fine: DataFrame, days: int = 3) -> DataFrame:
    """Coarse dates without a fine date within ``days``."""
    return coarse.join(spread_days(fine, days, "fine_date"), ["site_id", "scene_date"], "left_anti")


def nearest(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """``left`` dates with the nearest ``right`` date (the earlier on a tie): the last one up to and the first one from the
    day, found by running windows over both tables in order, so the join is linear however many dates a site has."""
    both = left.select("site_id", "scene_date", F.lit(None).cast("date").alias("_d")).unionByName(right.select("site_id", "scene_date", F.col("scene_date").alias("_d")))
    back = Window.partitionBy("site_id").orderBy("scene_date").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("site_id").orderBy("scene_date").rangeBetween(0, Window.unboundedFollowing)
    placed = both.withColumns({"_b": F.max("_d").over(back), "_a": F.min("_d").over(ahead)}).where("_d is null")
    gap = lambda c: F.abs(F.datediff("scene_date", c))
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(gap("_b") <= gap("_a"), F.col("_b")).otherwise(F.col("_a"))
    return placed.select("site_id", "scene_date", pick.alias(name)).where(F.col(name).isNotNull())


def anchored(coarse: DataFrame, fine: DataFrame, apart: int = 3, pad: int = 1) -> DataFrame:
    """(site_id, scene_date, anchor, partner, anchor_days): coarse dates to estimate, their nearest fine date and the coarse date within ``pad`` days of that."""
    out = nearest(uncovered(coarse, fine, apart), fine, "anchor")
    anchors = out.select("site_id", F.col("anchor").alias("scene_date")).distinct()
    partner = nearest(anchors, coarse, "partner").where(F.abs(F.datediff("scene_date", "partner")) <= pad).select("site_id", F.col("scene_date").alias("anchor"), "partner")
    return out.join(partner, ["site_id", "anchor"]).select("site_id", "scene_date", "anchor", "partner", F.abs(F.datediff("scene_date", "anchor")).alias("anchor_days"))


def delta(fine: Column, first: Column, second: Column, largest: Column) -> Column:
    """The fine value moved by the coarse change, less where fine and coarse disagreed at the anchor; clamped to 0..1."""
    top = F.when((largest >= 1e-6) & (largest < float("inf")), largest).otherwise(1.0)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(fine - first) / top)
    return F.when(fine.isNotNull() & first.isNotNull() & second.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), fine + weight * (second - first))))


def fused(pairs: DataFrame, fine: DataFrame, coarse: DataFrame, bands: list[str], index: str | None = None) -> DataFrame:
    """Estimated bands of every pair (site_id, scene_date, anchor, partner) and cell.

    The largest disagreement of a pair and band is a partial aggregate joined back, so no window holds a whole scene.
    With ``index``, a column of both, the result has ``residual``, |fine - coarse| of it at the anchor, and ``anchor_value``, the fine one.
    """
    carried = [*bands, index] if index else bands
    cell = ["site_id", "r", "c"]
    at = lambda frame, day, tag: frame.select(*cell, F.col("scene_date").alias(day), *(F.col(b).alias(f"{tag}_{b}") for b in carried))
    joined = pairs.join(at(fine, "anchor", "f"), ["site_id", "anchor"])
    joined = joined.join(at(coarse, "partner", "p"), [*cell, "partner"]).join(at(coarse, "scene_date", "q"), [*cell, "scene_date"])
    keys = ["site_id", "scene_date"]
    largest = joined.groupBy(*keys).agg(*(F.max(F.abs(F.col(f"f_{b}") - F.col(f"p_{b}"))).alias(f"m_{b}") for b in bands))
    out = joined.join(largest, keys)
    beside = [F.abs(F.col(f"f_{index}") - F.col(f"p_{index}")).alias("residual"), F.col(f"f_{index}").alias("anchor_value")] if index else []
    return out.select(*keys, "r", "c", "anchor", *beside, *(delta(F.col(f"f_{b}"), F.col(f"p_{b}"), F.col(f"q_{b}"), F.col(f"m_{b}")).alias(b) for b in bands))


def agreement(pairs: DataFrame, keys: list[str], least: int = 4, count: str = "n") -> DataFrame:
    """rmse, mae, bias (pred - obs) and r of obs and pred by ``keys``; NULL under ``least`` pairs, r without variance too."""
    d = F.col("pred") - F.col("obs")
    own = pairs.where(F.col("obs").isNotNull() & F.col("pred").isNotNull())
    n, so, sp = F.count(F.lit(1)), F.sum("obs"), F.sum("pred")
    out = own.groupBy(*keys).agg(
        n.alias(count), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        F.covar_pop("obs", "pred").alias("_c"), F.stddev_pop("obs").alias("_o"), F.stddev_pop("pred").alias("_p"), so.alias("_so"), sp.alias("_sp"),
    )
    enough = F.col(count) >= least
    r = F.when((F.col(count) >= 2) & (F.col("_o") > 1e-12) & (F.col("_p") > 1e-12), F.try_divide(F.col("_c"), F.col("_o") * F.col("_p")))
    return out.select(*keys, *(F.when(enough, F.col(x)).alias(x) for x in ("rmse", "mae", "bias")), F.when(enough, r).alias("r"), count)


def leave_one_out(fine: DataFrame, coarse: DataFrame, name: str, pad: int = 1) -> DataFrame:
    """(site_id, scene_date, r, c, obs, pred): every fine date estimated from its nearest other fine date.

    Bands are estimated and the index ``name`` is computed from the estimated ones, as a fused scene's is.
    """
    bands = indices.needed_bands(name)
    dates, others = (x.select("site_id", "scene_date").distinct() for x in (fine, coarse))
    order = Window.partitionBy("site_id").orderBy("scene_date")
    near = dates.withColumns({"_b": F.lag("scene_date").over(order), "_a": F.lead("scene_date").over(order)})
    gap = lambda c: F.coalesce(F.abs(F.datediff("scene_date", c)), F.lit(1 << 30))
    near = near.withColumn("anchor", F.when(gap("_b") <= gap("_a"), F.col("_b")).otherwise(F.col("_a"))).where("anchor is not null").drop("_a", "_b")
    partner = nearest(dates, others, "partner").where(F.abs(F.datediff("scene_date", "partner")) <= pad)
    at = partner.select("site_id", "scene_date", F.col("partner").alias("now"))
    then = partner.select("site_id", F.col("scene_date").alias("anchor"), F.col("partner").alias("then"))
    pairs = near.join(at, ["site_id", "scene_date"]).join(then, ["site_id", "anchor"]).where("now != then")
    cell = ["site_id", "r", "c"]
    held = indices.with_index(fine, name, "obs").select(*cell, "scene_date", "obs")
    v = lambda frame, day, tag: frame.select(*cell, F.col("scene_date").alias(day), *(F.col(b).alias(f"{tag}_{b}") for b in bands))
    out = pairs.join(held, ["site_id", "scene_date"]).join(v(fine, "anchor", "f"), [*cell, "anchor"])
    out = out.join(v(coarse, "then", "p"), [*cell, "then"]).join(v(coarse, "now", "q"), [*cell, "now"])
    top = out.groupBy("site_id", "scene_date").agg(*(F.max(F.abs(F.col(f"f_{b}") - F.col(f"p_{b}"))).alias(f"m_{b}") for b in bands))
    made = out.join(top, ["site_id", "scene_date"]).select(*cell, "scene_date", "obs", *(delta(F.col(f"f_{b}"), F.col(f"p_{b}"), F.col(f"q_{b}"), F.col(f"m_{b}")).alias(b) for b in bands))
    return indices.with_index(made, name, "pred").select(*cell, "scene_date", "obs", "pred")
