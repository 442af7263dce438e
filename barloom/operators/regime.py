"""Market regime from metrics: votes, divergence flags and the state they make, one row a reading, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.persistence import vote

#: Metrics that vote by two thresholds, with whether a higher value is better.
LEVELS = (
    ("breadth_50", "breadth_50_pct", 60.0, 40.0, True),
    ("breadth_200", "breadth_200_pct", 60.0, 40.0, True),
    ("equal_weight", "rsp_spy_pct", 0.5, -0.5, True),
    ("new_highs", "nhnl_pct", 1.0, -1.0, True),
    ("vix", "vix", 17.0, 25.0, False),
    ("credit", "credit_pct", 0.25, -0.25, True),
    ("rotation", "def_off_pct", -0.5, 0.5, False),
)
#: A slope this near to 0 (in %) is flat; the distance from a high that is near it; curve and spike limits.
FLAT_SLOPE, NEAR_HIGH, CONTANGO, INVERTED, SPIKE = -0.05, -3.0, 0.95, 1.0, 20.0
#: Every column that classify() reads; those a frame lacks count as null.
METRICS = ("spy_vs_50_pct", "spy_vs_200_pct", "spy_slope_pct", "spy_from_high_pct", "qqq_vs_50_pct", "qqq_vs_200_pct", "vix_term", "vix_5d_pct", "def_off_prior_pct", *dict.fromkeys(c for _, c, *_ in LEVELS))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def classify(readings: DataFrame) -> DataFrame:
    """readings with votes (a struct of ten), score, n_bull, n_bear, flags (names), n_flags and state.

    A metric that is null, or that the frame lacks, abstains and raises no flag; without the index there is no uptrend. Flags
    are divergences, so they count in an uptrend only: the index over its 200-session mean, which isn't falling.

    States, the first that holds: RISK-OFF without an uptrend; RISK-OFF (internals) with four flags or a score of -3; CAUTION
    with two flags, a score of -2 or under 45 % of names over their 50-session mean; else RISK-ON.
    """
    d = readings.withColumns({c: F.lit(None).cast("double") for c in METRICS if c not in readings.columns})
    c = F.col
    over = c("spy_vs_200_pct") > 0
    up = _yes(over & (c("spy_slope_pct") > FLAT_SLOPE))
    signs = {
        "trend": F.when(_yes(over & (c("spy_vs_50_pct") > 0) & (c("spy_slope_pct") > 0)), 1).when(_yes(~over | (c("spy_slope_pct") <= FLAT_SLOPE)), -1).otherwise(0),
        "second_index": F.when(_yes((c("qqq_vs_200_pct") > 0) & (c("qqq_vs_50_pct") > 0)), 1).when(_yes(c("qqq_vs_200_pct") <= 0), -1).otherwise(0),
        **{name: vote(c(column), good, bad, higher) for name, column, good, bad, higher in LEVELS},
        "vix_curve": F.when(_yes(c("vix_term") < CONTANGO), 1).when(_yes(c("vix_term") > INVERTED), -1).otherwise(0),
    }
    deeper = F.when(c("def_off_prior_pct").isNull(), F.lit(True)).otherwise(c("def_off_pct") - c("def_off_prior_pct") > 0.5)
    alarms = {
        "breadth": (c("breadth_50_pct") < 50) & (c("spy_from_high_pct") >= NEAR_HIGH),
        "narrowing": c("rsp_spy_pct") < -0.5,
        "credit": c("credit_pct") < -0.25,
        "rotation": (c("def_off_pct") > 0.5) & deeper,
        "vix_curve": c("vix_term") > INVERTED,
        "vix_spike": c("vix_5d_pct") > SPIKE,
    }
    d = d.withColumn("uptrend", up).withColumn("votes", F.struct(*[v.cast("int").alias(k) for k, v in signs.items()]))
    d = d.withColumn("flags", F.array_compact(F.array(*[F.when(F.col("uptrend") & _yes(a), F.lit(k)) for k, a in alarms.items()])))
    each = [F.col(f"votes.{k}") for k in signs]
    count = lambda sign: sum((F.when(v == sign, 1).otherwise(0) for v in each), F.lit(0))
    d = d.withColumns({"score": sum(each, F.lit(0)), "n_bull": count(1), "n_bear": count(-1), "n_flags": F.size("flags")})
    state = (
        F.when(~c("uptrend"), "RISK-OFF")
        .when((c("n_flags") >= 4) | (c("score") <= -3), "RISK-OFF (internals)")
        .when((c("n_flags") >= 2) | (c("score") <= -2) | _yes(c("breadth_50_pct") < 45), "CAUTION")
        .otherwise("RISK-ON")
    )
    return d.withColumn("state", state)
