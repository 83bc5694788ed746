"""Health checks, gauges, ratings and recommendations on the latest snapshot per agent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C


def latest_per_agent(df: DataFrame, agent_id=None) -> DataFrame:
    """The newest row of every agent (combined before the shuffle)."""
    if agent_id is not None:
        df = df.where(F.col("agent_id") == agent_id)
    others = [c for c in df.columns if c != "agent_id"]
    newest = F.max_by(F.struct(*others), F.struct("ts", "event_id"))
    return df.groupBy("agent_id").agg(newest.alias("r")).select("agent_id", "r.*").select(*df.columns)


def _penalty(metric: str, critical: float, critical_cost: int, warning: float, warning_cost: int) -> Column:
    value = F.col(metric)
    return F.when(value > critical, critical_cost).when(value > warning, warning_cost).otherwise(0)


def health_check(latest: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Score, status, issue counts and component scores per agent.

    With ``agents``, agents without any snapshot appear as ``insufficient_data``.
    """
    checks = [(name, metric, *rest) for name, metric, *rest in C.HEALTH_CHECKS]
    lost = reduce(lambda a, b: a + b, [_penalty(m, c, cc, w, wc) for _, m, c, cc, w, wc, *_ in checks])
    critical = reduce(lambda a, b: a + b, [F.coalesce(F.col(m) > c, F.lit(False)).cast("int") for _, m, c, *_ in checks])
    warnings = reduce(lambda a, b: a + b, [
        F.coalesce((F.col(m) > w) & (F.col(m) <= c), F.lit(False)).cast("int") for _, m, c, _, w, *_ in checks
    ])
    scores = {
        f"{name}_score": F.when(F.col(m).isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - F.col(m)))
        for name, m, *_ in checks
    }
    out = latest.withColumns({"overall_score": F.lit(100) - lost, "critical_issues": critical, "warnings": warnings, **scores})
    status = F.when(F.col("critical_issues") > 0, "critical").when(F.col("warnings") > 0, "warning").otherwise("healthy")
    columns = ["overall_score", "critical_issues", "warnings", *scores]
    out = out.select("agent_id", status.alias("status"), *columns)
    if agents is None:
        return out
    return agents.select("agent_id").join(out, "agent_id", "left").withColumns({
        "status": F.coalesce("status", F.lit("insufficient_data")),
        "critical_issues": F.coalesce("critical_issues", F.lit(0)),
    })


def health_issues(latest: DataFrame) -> DataFrame:
    """One row per critical issue or warning on the latest snapshot."""
    found = []
    for name, m, critical, _, warning, _, issue, impact, mild in C.HEALTH_CHECKS:
        value = F.col(m)
        record = lambda level, text, effect: F.struct(
            F.lit(level).alias("level"), F.lit(name).alias("component"), F.lit(text).alias("issue"),
            value.alias("value"), F.lit(effect).cast("string").alias("impact"),
        )
        found.append(F.when(value > critical, record("critical", issue, impact))
                     .when(value > warning, record("warning", mild, None)))
    return (
        latest.select("agent_id", "ts", F.explode(F.array(*found)).alias("i"))
        .where(F.col("i").isNotNull())
        .select("agent_id", "ts", "i.*")
    )


def recommendations(latest: DataFrame) -> DataFrame:
    """Advice from the latest snapshot of each agent."""
    found = [
        F.when(F.col(metric) > above, F.struct(
            F.lit(category).alias("category"), F.lit(priority).alias("priority"), F.lit(text).alias("recommendation")))
        for metric, above, category, priority, text in C.RECOMMENDATIONS
    ]
    return (
        latest.select("agent_id", F.explode(F.array(*found)).alias("r"))
        .where(F.col("r").isNotNull())
        .select("agent_id", "r.*")
    )


def gauge_band(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("healthy")


def gauge_bands(latest: DataFrame, limits: list[tuple[str, float, float]] = C.GAUGE_LIMITS) -> DataFrame:
    """Long form: one row per agent and metric with its band. A latency of 0 has no gauge."""
    gauges = [
        F.struct(
            F.lit(metric).alias("metric"), F.col(metric).alias("value"),
            gauge_band(F.col(metric), warning, critical).alias("band"),
            F.round(F.col(metric) - warning, 6).alias("over_warning"),
        )
        for metric, warning, critical in limits
    ]
    return (
        latest.select("agent_id", F.explode(F.array(*gauges)).alias("g"))
        .select("agent_id", "g.*")
        .where((F.col("metric") != "network_latency") | (F.coalesce("value", F.lit(0.0)) != 0))
    )


def rating(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").otherwise("Needs Attention")


def fleet_score(agents: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: healthy agents weigh 60 %, normal snapshots 40 %."""
    a = agents.agg(F.count("*").alias("agents"), F.count_if(F.col("status") == "healthy").alias("healthy_agents"))
    m = metrics.agg(F.count("*").alias("metrics"), F.count_if("is_anomaly").alias("anomalies"))
    healthy = F.col("healthy_agents") / F.nullif("agents", F.lit(0))
    normal = F.when(F.col("metrics") == 0, 1.0).otherwise(1 - F.col("anomalies") / F.nullif("metrics", F.lit(0)))
    both = a.select("*", *[m.select(c).scalar().alias(c) for c in ("metrics", "anomalies")])
    scored = both.withColumn("health_score", (healthy * 0.6 + normal * 0.4) * 100)
    return scored.withColumn("rating", rating(F.col("health_score")))
