"""Many sites in one plan: validation, outcomes and retries as data."""

from __future__ import annotations

import functools
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import stripped_query
from .pipeline import Pipeline

SITE_COLUMNS = ("id", "longitude", "latitude", "start_date", "end_date")
TRANSIENT_STATUS = {408, 429, 500, 502, 503, 504}
_TRANSIENT = re.compile(r"timed? ?out|connection (reset|refused|aborted)|could not resolve|empty reply|temporar|HTTP (408|429|50[0234])", re.I)


def invalid_reason() -> Column:
    """The first reason against a row of sites; NULL if none."""
    start, end = (F.col(c).cast("string").try_cast("date") for c in ("start_date", "end_date"))
    missing = F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")
    return (
        F.when(missing, "id")
        .when(F.coalesce(~F.col("longitude").between(-180, 180), F.lit(True)), "longitude")
        .when(F.coalesce(~F.col("latitude").between(-90, 90), F.lit(True)), "latitude")
        .when(start.isNull() | end.isNull() | (F.datediff(end, start) < 2), "period")
    )


def outcomes(sites: DataFrame, series: DataFrame, failures: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """(id, status, dates, reason): failure, interrupted, empty or success for every site."""
    counted = series.groupBy("id").agg(F.count_distinct("date").alias("n"))
    out = sites.select("id").join(counted, "id", "left").join(failures.select("id", "reason"), "id", "left")
    done = F.lit(True)
    if completed is not None:
        out = out.join(completed.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
        done = F.coalesce("_done", F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "failure").when(~done, "interrupted").when(F.col("n").isNull(), "empty").otherwise("success")
    return out.select("id", status.alias("status"), F.when(status == "success", F.col("n")).otherwise(0).cast("long").alias("dates"), "reason")


def is_transient(error: BaseException) -> bool:
    """Whether another try may help; unknown errors are final."""
    status = getattr(error, "status", None) or getattr(error, "code", None)
    if isinstance(status, int):
        return status in TRANSIENT_STATUS
    return isinstance(error, TimeoutError | ConnectionError) or bool(_TRANSIENT.search(str(error)))


def pause(turn: int, longest: float = 60.0) -> float:
    return min(longest, 2.0**turn)


def fetched(read: Callable[[], DataFrame], tries: int = 10, first: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A reader's result; transient errors are tried again after growing pauses."""
    for k in range(1, tries + 1):
        try:
            return read()
        except Exception as e:
            if k == tries or not is_transient(e):
                raise
            sleep(min(longest, first * 2 ** (k - 1)))
    raise ValueError("tries is a positive whole number")


def request_key(index: str, source: str, pipeline: str, version: str = "1") -> Column:
    """A hash of a site's request: place to seven digits, period, index, source and the pipeline's name."""
    parts = [F.round("longitude", 7).cast("string"), F.round("latitude", 7).cast("string"), F.col("start_date").cast("string"), F.col("end_date").cast("string"), F.lit(index), F.lit(source), F.lit(pipeline), F.lit(version)]
    return F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in parts)), 256)


class SiteCache:
    """Finished sites in two Parquet folders: rows by key, and the keys that are done, for sites without rows too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def done(self) -> DataFrame | None:
        return self._read("done")

    def rows(self) -> DataFrame | None:
        return self._read("rows")

    def add(self, rows: DataFrame, done: DataFrame) -> None:
        """rows: (key, ...); done: (key).  Rows go first, so a key that is done has all its rows."""
        rows.write.mode("append").parquet(f"{self.folder}/rows")
        done.write.mode("append").parquet(f"{self.folder}/done")


def rounds(
    sites: DataFrame, index: str, attempt: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], folder: str, retries: int = 3,
    cache: SiteCache | None = None, source: str = "auto", pipeline: str = "default", on_error: str = "skip", sleep: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, failures, outcomes) of all sites, in rounds: every round is one plan over the sites that are still pending.

    attempt(pending, round) gives rows (id, date, value) and errors (id, reason, retryable) of its sites; a site without an
    error is complete, with or without rows.  Retryable errors are tried again after a pause, ``retries`` times in all; other
    errors and invalid sites are final.  A cached site costs no attempt.  ``folder`` (shared) takes each round's tables, so a
    result is never fetched twice.  on_error: skip, or stop at the first final failure.
    """
    if on_error not in ("skip", "stop"):
        raise ValueError("on_error is skip or stop")
    if retries < 1:
        raise ValueError("retries is a positive whole number")
    spark, base = sites.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def stop(failed: DataFrame) -> None:
        first = failed.take(1) if on_error == "stop" else None
        if first:
            raise RuntimeError(f"{first[0]['id']} / {index}: {first[0]['reason']}")

    checked = kept(sites.withColumns({"reason": invalid_reason(), "key": request_key(index, source, pipeline)}), "sites")
    bad = checked.where("reason is not null").select("id", "reason", F.lit(0).alias("attempts"), F.col("reason").alias("last_error"))
    stop(bad)
    pending, found, failed, complete = checked.where("reason is null").drop("reason"), [], [bad], []
    done = cache.done() if cache else None
    if done is not None:
        hits = kept(pending.join(done.select("key").distinct(), "key", "left_semi").select("id", "key"), "hits")
        stored = cache.rows()
        found.append(hits.join(stored.dropDuplicates(["key", "date"]), "key").select("id", "date", "value"))
        complete.append(hits.select("id", F.lit(0).alias("attempts"), F.lit(True).alias("cached")))
        pending = pending.join(hits, "id", "left_anti")
    for turn in range(1, retries + 1):
        rows, errors = attempt(pending, turn)
        rows, errors = kept(rows.select("id", "date", "value"), f"rows-{turn}"), kept(errors.select("id", "reason", "retryable"), f"errors-{turn}")
        message = stripped_query(F.col("reason"))
        final = errors.where(~F.col("retryable")) if turn < retries else errors
        failed.append(final.select("id", message.alias("reason"), F.lit(turn).alias("attempts"), message.alias("last_error")))
        stop(failed[-1])
        ready = kept(pending.join(errors, "id", "left_anti").select("id", "key"), f"ready-{turn}")
        own = rows.join(ready, "id")
        found.append(own.select("id", "date", "value"))
        complete.append(ready.select("id", F.lit(turn).alias("attempts"), F.lit(False).alias("cached")))
        if cache:
            cache.add(own.select("key", "date", "value"), ready.select("key"))
        again = errors.where("retryable").select("id").distinct()
        if turn == retries or again.isEmpty():
            break
        pending = kept(pending.join(again, "id", "left_semi"), f"pending-{turn}")
        sleep(pause(turn))
    merge = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    series, failures, finished = merge(found), merge(failed), merge(complete)
    counted = series.groupBy("id").agg(F.count_distinct("date").alias("dates"))
    out = sites.select("id").join(finished, "id", "left").join(failures.select("id", "reason", F.col("attempts").alias("_tried")), "id", "left").join(counted, "id", "left")
    status = F.when(F.col("reason").isNotNull(), "failure").when(F.col("attempts").isNull(), "interrupted").when(F.col("dates").isNull(), "empty").otherwise("success")
    outcomes_ = out.select("id", F.lit(index).alias("index"), status.alias("status"), F.when(status == "success", F.col("dates")).otherwise(0).cast("long").alias("dates"), F.coalesce("attempts", "_tried", F.lit(0)).alias("attempts"), F.coalesce("cached", F.lit(False)).alias("cached"))
    return series.withColumn("index", F.lit(index)), failures.select("id", F.lit(index).alias("index"), "reason", "attempts", "last_error"), outcomes_


def default_pipeline(query):
    """Delineation, then the daily series; the union of areas is the value."""
    out = query.boundary_delineation().as_time_series()
    return out.withColumnRenamed("union", "value") if "union" in out.columns else out


def batch(sites: DataFrame, pipeline: Pipeline, **context: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, failures, outcomes) of all valid sites by one plan; invalid sites are failures, not exceptions."""
    missing = [c for c in SITE_COLUMNS if c not in sites.columns]
    if missing:
        raise ValueError(f"sites needs the columns {', '.join(missing)}")
    checked = sites.withColumn("reason", invalid_reason())
    failures = checked.where("reason is not null").select("id", "reason")
    rows = pipeline(checked.where("reason is null").drop("reason"), **context)
    return rows, failures, outcomes(sites, rows, failures)
