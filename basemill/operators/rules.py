"""Rules over the distributions: observations, thresholds, statuses."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M

SEVERITY = ("pass", "warning", "fail")
OPERATORS = ("<", "<=", ">", ">=")

# Metric, observation, unit, warning operator and value, fail operator and value.
STANDARD = (
    ("per_base_quality", "minimum_lower_quartile", "Phred", "<", 10.0, "<", 5.0),
    ("per_base_quality", "minimum_median", "Phred", "<", 25.0, "<", 20.0),
    ("per_sequence_quality", "modal_mean_quality", "Phred", "<", 27.0, "<", 20.0),
    ("per_base_sequence_content", "maximum_base_difference_percent", "%", ">", 10.0, ">", 20.0),
    ("per_sequence_gc_content", "modeled_deviation_percent", "%", ">", 15.0, ">", 30.0),
    ("per_base_n_content", "maximum_n_percent", "%", ">", 5.0, ">", 20.0),
    ("sequence_length_distribution", "observed_length_count", "", ">", 1.0, None, None),
    ("sequence_length_distribution", "minimum_length", "nt", None, None, "<=", 0.0),
    ("sequence_duplication_levels", "deduplicated_loss_percent", "%", ">", 20.0, ">", 50.0),
    ("adapter_content", "maximum_adapter_percent", "%", ">", 5.0, ">", 10.0),
)
SCHEMA = "ord int, metric_id string, observation string, unit string, warn_op string, warn_value double, fail_op string, fail_value double"


@dataclass(frozen=True)
class Ruleset:
    """id, version and rows like STANDARD."""

    id: str
    version: str
    rules: tuple

    @classmethod
    def from_json(cls, text: str) -> Ruleset:
        """A ruleset of schema version 1; every check needs a threshold, numbers must not be booleans."""
        data = json.loads(text)
        if data.get("schema_version") != 1:
            raise ValueError("schema_version must be 1")
        rows = []
        for metric, rule in data["rules"].items():
            if not rule.get("checks"):
                raise ValueError(f"{metric} has no checks")
            for check in rule["checks"]:
                found = []
                for kind in ("warning", "fail"):
                    t = check.get(kind)
                    if t is not None and (t.get("operator") not in OPERATORS or isinstance(t.get("value"), bool) or not isinstance(t.get("value"), int | float)):
                        raise ValueError(f"{metric}: not a threshold: {t}")
                    found += [t["operator"], float(t["value"])] if t is not None else [None, None]
                if found == [None] * 4:
                    raise ValueError(f"{metric}: a check needs a threshold")
                rows.append((metric, check["observation"], check.get("unit", ""), *found))
        return cls(str(data["id"]), str(data["version"]), tuple(rows))


def rule_table(spark: SparkSession, rules: tuple = STANDARD) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], SCHEMA)


def observations(reads: DataFrame, keys=M.KEYS) -> DataFrame:
    """(KEYS, observation, value) of every metric, from full-precision distributions; null where it can't be evaluated.

    Reads are scanned twice: for the profile, from which all metrics but one come, and for the keys of duplication. The
    values are one row a key until the last step.
    """
    profile = M.profile(reads, keys)
    gap = F.greatest(F.abs(F.col("a_percent") - F.col("t_percent")), F.abs(F.col("g_percent") - F.col("c_percent")))
    modal = F.max_by(F.col("mean_quality"), F.struct(F.col("read_count_truncate"), -F.col("mean_quality")))
    found = [
        (M.quality_by_group(M.quality_by_position(M.quality_histogram(profile, keys), keys), keys), [("minimum_lower_quartile", F.min("lower_quartile")), ("minimum_median", F.min("median"))]),
        (M.read_quality(profile, keys), [("modal_mean_quality", modal)]),
        (M.base_content(profile, keys), [("maximum_base_difference_percent", F.max(gap)), ("maximum_n_percent", F.max("n_percent"))]),
        (M.gc_deviation(M.gc_distribution(profile, keys), keys), [("modeled_deviation_percent", F.max("deviation_percent"))]),
        (M.length_distribution(profile, keys), [("observed_length_count", F.count("*")), ("minimum_length", F.min("length"))]),
        (M.duplication_summary(M.duplication_counts(reads, keys), keys), [("deduplicated_loss_percent", 100 - F.max("deduplicated_remaining_percent"))]),
        (M.adapter_content(profile, keys), [("maximum_adapter_percent", F.max("percent"))]),
    ]
    out = None
    for rows, values in found:
        wide = rows.groupBy(*keys).agg(*[v.cast("double").alias(n) for n, v in values])
        long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("observation"), F.round(F.col(n), 6).alias("value")) for n, _ in values])).alias("x")).select(*keys, "x.*")
        out = long if out is None else out.unionByName(long)
    return out


def _meets(op: str, value: str):
    out = F.lit(False)
    for o, test in (("<", F.col("value") < F.col(value)), ("<=", F.col("value") <= F.col(value)), (">", F.col("value") > F.col(value)), (">=", F.col("value") >= F.col(value))):
        out = F.when(F.col(op) == o, test).otherwise(out)
    return F.coalesce(out, F.lit(False))


def evaluate(observed: DataFrame, rules: DataFrame, keys=M.KEYS) -> DataFrame:
    """One row a check: (KEYS, ord, metric_id, observation, value, status); fail is tested before warning. The rule table
    is a few rows."""
    status = F.when(F.col("value").isNull(), "not_evaluated").when(_meets("fail_op", "fail_value"), "fail").when(_meets("warn_op", "warn_value"), "warning").otherwise("pass")
    values = observed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("observation", "value"))).alias("values"))  # ten a key
    every = values.join(F.broadcast(rules)).withColumn("value", F.col("values")[F.col("observation")])
    return every.select(*keys, "ord", "metric_id", "observation", "value", status.alias("status"))


def severity(status) -> F.Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status)


def _worst(column: str = "status"):
    top = F.max(severity(F.col(column)))
    return F.when(top > 0, F.element_at(F.array(*map(F.lit, SEVERITY)), F.greatest(top, F.lit(1)).cast("int"))).otherwise("not_evaluated")


def metric_status(evaluated: DataFrame, keys=M.KEYS) -> DataFrame:
    """The worst status of a metric's checks, not_evaluated if one of them is."""
    worst = F.when(F.max(F.col("status") == "not_evaluated"), "not_evaluated").otherwise(_worst())
    return evaluated.groupBy(*keys, "metric_id").agg(worst.alias("status"))


def status_summary(by_metric: DataFrame) -> DataFrame:
    """Number of metrics by status, and the overall status: the worst among the evaluated."""
    counts = by_metric.agg(*[F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0).cast("long")).alias(f"n_{s}") for s in (*SEVERITY, "not_evaluated")], _worst().alias("overall"))
    return counts


def module_status(by_metric: DataFrame) -> DataFrame:
    """The worst status of a metric over the mates."""
    return by_metric.groupBy("metric_id").agg(_worst().alias("status"))


def reasons(evaluated: list) -> list[str]:
    """A sentence for each triggered check (rows of ``evaluate``)."""
    found = [f"{r['observation']} = {r['value']:.4g} ({r['status']})" for r in evaluated if r["status"] in ("warning", "fail")]
    return found or ["within thresholds"]
