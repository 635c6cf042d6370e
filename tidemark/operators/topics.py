"""Topic surveillance: daily counts, zero-filled baselines, z-scores, alert ladder, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames


def daily(stories: DataFrame) -> DataFrame:
    """topic, d, stories, domains, tier1, raw of every day with a story; stories(topic, d, story_hash, domain, tier)."""
    return stories.groupBy("topic", "d").agg(
        F.countDistinct("story_hash").alias("stories"), F.countDistinct("domain").alias("domains"), F.countDistinct(F.when(F.col("tier") == "tier1", F.col("story_hash"))).alias("tier1"), F.count(F.lit(1)).alias("raw")
    )


def week_before(stories: DataFrame) -> DataFrame:
    """topic, d, stories_7d: distinct stories of the seven days before d, which a sum of days would overcount."""
    one = stories.where("story_hash is not null").select("topic", "d", "story_hash").distinct()
    days = one.select("topic", "story_hash", F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 7), F.expr("interval 1 day"))).alias("d"))
    return days.groupBy("topic", "d").agg(F.countDistinct("story_hash").alias("stories_7d"))


def baseline(counts: DataFrame, days: int = 30) -> DataFrame:
    """Every calendar day of each topic, zeros filled in, with mean and sample deviation of the `days` rows before it."""
    full = frames.spine(counts, ["topic"], "d").join(counts, ["topic", "d"], "left").na.fill(0)
    w = frames.series(["topic"], ["d"]).rowsBetween(-days, -1)
    whole = F.count(F.lit(1)).over(w) == days
    return full.withColumn("mean", F.when(whole, F.avg("stories").over(w))).withColumn("std", F.when(whole, F.stddev_samp("stories").over(w))).withColumn("tier1_mean", F.when(whole, F.avg("tier1").over(w)))


def z_score(n: Column, mean: Column, std: Column) -> Column:
    """Deviations above the mean; where the deviation is 0.1 or less, the ratio to the mean (0.5 at least), or n itself."""
    return F.when(std > 0.1, (n - mean) / std).when(mean > 0, n / F.greatest(mean, F.lit(0.5))).otherwise(n.cast("double"))


def ladder(z: Column, n: Column, tier1: Column, tier1_mean: Column, ratio: Column, drift: Column, z_level: float = 2.0) -> Column:
    """Struct(severity, reasons). Vocabulary growth leads (2 and 3.5 times), counts and first-tier sources support it, falling tone confirms it."""
    strong, some = F.coalesce(ratio >= 3.5, F.lit(False)), F.coalesce(ratio >= 2.0, F.lit(False))
    often = (z >= z_level) & (n >= 3)
    wide = (tier1 >= 3) & (tier1 >= 2 * F.greatest(tier1_mean, F.lit(0.5)))
    falling = F.coalesce(drift <= -0.10, F.lit(False))
    both = often & wide
    severity = F.when(strong & (often | wide), "hot").when(strong, "warm").when(some & (often | wide | falling), "warm").when(some | both, "watch")
    named = ((some, "cascade_ratio"), (often, "frequency"), (wide, "tier1_diversification"), (falling, "tone_drift"), (both & ~some, "legacy_freq_tier1"))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in named]))
    return F.struct(severity.alias("severity"), reasons.alias("reasons"))


def drift_rows(tone: DataFrame, recent: int = 14) -> DataFrame:
    """By rows: weighted tone of the last `recent` rows less that of the as many before, and the ratio of cascade scores."""
    w = frames.series(["topic"], ["d"])
    now, before = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(2 * recent - 1), -recent)

    def mean(frame):
        return F.try_divide(F.sum(F.col("mean_tone") * F.col("n")).over(frame), F.sum("n").over(frame))

    def score(frame):
        return F.try_divide(F.sum("cascade").over(frame), F.sum("n").over(frame))

    full = F.count(F.lit(1)).over(before) > 0
    ratio = F.when(score(before) > 0, score(now) / score(before))
    return tone.withColumn("tone_drift", F.when(full, mean(now) - mean(before))).withColumn("cascade_ratio", F.when(full, ratio))


def drift_days(tone: DataFrame, recent: int = 14) -> DataFrame:
    """As `drift_rows` over calendar days, with a floor of 0.01 under the earlier score."""
    w = frames.series(["topic"], [frames.day_no("d")])
    now, before = w.rangeBetween(-(recent - 1), 0), w.rangeBetween(-(2 * recent - 1), -recent)
    score = lambda frame: F.try_divide(F.sum("cascade").over(frame), F.sum("n").over(frame))
    mean = lambda frame: F.try_divide(F.sum(F.col("mean_tone") * F.col("n")).over(frame), F.sum("n").over(frame))
    return tone.withColumn("tone_drift", mean(now) - mean(before)).withColumn("cascade_ratio", F.when(score(before) > 0.01, score(now) / score(before)))


def lead_times(alerts: DataFrame) -> DataFrame:
    """First alert of each severity, days from the first watch to the first hot one, alert share."""
    first = lambda s: F.min(F.when(F.col("severity") == s, F.col("d")))
    a = alerts.groupBy("topic").agg(F.count(F.lit(1)).alias("days"), F.count("severity").alias("alert_days"), first("watch").alias("first_watch"), first("warm").alias("first_warm"), first("hot").alias("first_hot"))
    return a.withColumn("lead_days", F.datediff("first_hot", F.least("first_watch", "first_warm"))).withColumn("alert_rate", F.col("alert_days") / F.col("days"))
