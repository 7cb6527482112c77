"""Job progress: latest state, liveness, rolling rate, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds after which a queued job without progress counts as dead.
GRACE_S = 45


def latest(jobs: DataFrame, by: str = "dataset") -> DataFrame:
    """Last started job of each data set, in its last snapshot."""
    w = Window.partitionBy(by).orderBy(F.desc("started_at"), F.desc("updated_at"), F.desc("done_n"), F.desc("job_id"))
    return jobs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def current(jobs: DataFrame) -> DataFrame:
    """Last snapshot of every job; snapshots delivered again or out of order do not matter."""
    w = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("done_n"), F.desc_nulls_last("total_n"), "job_state")
    return jobs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def is_corpse(now: str, grace_s: int = GRACE_S):
    """A job that claims to be alive without process, or that stayed queued beyond the grace period."""
    idle = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("updated_at")
    live = F.col("job_state").isin("running", "queued")
    return live & (((F.col("job_state") == "running") & F.col("pid").isNull()) | ((F.col("job_state") == "queued") & (idle > grace_s)))


def expected_total(jobs: DataFrame) -> DataFrame:
    """Rows still to come over live jobs, and rows done."""
    live = F.col("job_state").isin("running", "queued")
    return jobs.agg(F.sum(F.when(live, F.greatest(F.lit(0), F.coalesce("total_n", F.lit(0)) - F.coalesce("done_n", F.lit(0)))).otherwise(0)).alias("coming"), F.sum(F.coalesce("done_n", F.lit(0))).alias("done"), F.count_if(live).alias("live"))


def rolling(events: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Count and sum of value over the last `seconds` up to each event, and the rate."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum(value).over(w)).withColumn("rate", F.col("n") / seconds)


def changes(events: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null-safe); the first of each key counts as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return events.withColumn("__c", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("__c").drop("__c")
