"""Detection quality as multiset joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["case_id", "entity_type", "start", "end"]


def outcomes(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """True positives, false positives and misses of each case and type, by exact spans with their multiplicity."""
    e = expected.groupBy(*KEY).agg(F.count("*").alias("e"))
    p = predicted.groupBy(*KEY).agg(F.count("*").alias("p"))
    both = e.join(p, KEY, "full_outer").fillna(0, ["e", "p"])
    return both.groupBy("case_id", "entity_type").agg(F.sum(F.least("e", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("p"), F.lit(0))).alias("fn"))


def metrics(result: DataFrame, cases: DataFrame) -> DataFrame:
    """One row overall and for each tier, category and type; precision and recall in parts per million, null without a denominator."""
    joined = result.join(cases.select("case_id", "tier", "category"), "case_id")
    joined.createOrReplaceTempView("hushlake_outcomes")
    ppm = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN ({a} * 1000000) DIV ({a} + {b}) END"
    return joined.sparkSession.sql(f"""
        SELECT CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(entity_type) = 0 THEN 'entity_type' ELSE 'all' END AS level,
          coalesce(tier, category, entity_type, '') AS value, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
          {ppm("sum(tp)", "sum(fp)")} AS precision_ppm, {ppm("sum(tp)", "sum(fn)")} AS recall_ppm
        FROM hushlake_outcomes GROUP BY GROUPING SETS ((), (tier), (category), (entity_type))""")


def gate_failures(found: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates (level, value, min_tp, max_fp, max_fn) that the metrics miss, and groups that only one side has."""
    j = gates.join(found, ["level", "value"], "full_outer")
    missed = F.col("tp").isNull() | F.col("min_tp").isNull() | (F.col("tp") < F.col("min_tp")) | (F.col("fp") > F.col("max_fp")) | (F.col("fn") > F.col("max_fn"))
    return j.where(missed).select("level", "value", "tp", "fp", "fn", "min_tp", "max_fp", "max_fn")


def share_summary(detected: DataFrame) -> DataFrame:
    """Distinct values of each entity type, without the values."""
    return detected.select("entity_type", "original").distinct().groupBy("entity_type").agg(F.count("*").alias("n"))


def masked_report(detected: DataFrame) -> DataFrame:
    """Distinct detections with their values masked to the first and last character."""
    o = F.col("original")
    return detected.select("entity_type", "original", F.round("score", 2).alias("score")).distinct().select("entity_type", F.when(F.length(o) <= 2, F.repeat(F.lit("*"), F.length(o))).otherwise(F.concat(F.left(o, F.lit(1)), F.lit("***"), F.right(o, F.lit(1)))).alias("masked"), "score")
