"""Threshold rules over metrics, cohesion and cycles, and the gate they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; the defaults are the documented ones."""

    max_instability: float = 0.4
    min_afferent: int = 3
    max_efferent: int = 20
    max_lcom4: int = 1
    min_methods: int = 3
    fail_on_cycles: bool = True


ERROR, WARNING = "error", "warning"


def _rows(df: DataFrame, rule: str, ordinal: int, severity: str, subject, message, measured, threshold: float, *order) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), message.alias("message"),
        measured.cast("double").alias("measured"), F.lit(float(threshold)).alias("threshold"), F.lit(ordinal).alias("rule_ordinal"),
        F.struct(*order).alias("within"),
    )


def _key(a, b, c, d):
    """The same sort key for all rules: three descending numbers as negatives, then a text."""
    return [a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("string").alias("c"), d.cast("string").alias("d")]


def cycle_violations(cycles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    shown = F.array_join(F.slice(F.coalesce("members", F.array("component")), 1, 5), " -> ")
    message = F.concat(F.lit("Dependency cycle of "), F.col("size").cast("string"), F.lit(" files: "), shown, F.when(F.col("size") > 5, " ...").otherwise(""))
    return _rows(cycles, "cycle", 0, ERROR if t.fail_on_cycles else WARNING, F.col("component"), message, F.col("size"), 0.0, *_key(-F.col("size"), F.lit(0), F.col("component"), F.lit("")))


def instability_violations(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    hit = metrics.where((F.col("ca") >= t.min_afferent) & (F.col("instability") > t.max_instability))
    message = F.concat(F.lit("Instability "), F.format_number("instability", 2), F.lit(f" exceeds {t.max_instability:.2f} with "), F.col("ca").cast("string"), F.lit(" dependents"))
    return _rows(hit, "instability", 1, ERROR, F.col("path"), message, F.col("instability"), t.max_instability, *_key(-F.col("instability"), -F.col("ca"), F.col("path"), F.lit("")))


def efferent_violations(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    hit = metrics.where(F.col("ce") > t.max_efferent)
    message = F.concat(F.lit("Depends on "), F.col("ce").cast("string"), F.lit(f" files, more than {t.max_efferent}"))
    return _rows(hit, "efferent", 2, WARNING, F.col("path"), message, F.col("ce"), t.max_efferent, *_key(-F.col("instability"), -F.col("ca"), F.col("path"), F.lit("")))


def cohesion_violations(cohesion: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    hit = cohesion.where((F.col("method_count") >= t.min_methods) & (F.col("lcom4") > t.max_lcom4))
    group = lambda g: F.concat(F.lit("{"), F.array_join(F.slice(g, 1, 3), ", "), F.when(F.size(g) > 3, ", ...}").otherwise("}"))
    shown = F.array_join(F.transform(F.slice("components", 1, 3), group), " ")
    message = F.concat(F.lit("Class splits into "), F.col("lcom4").cast("string"), F.lit(" groups: "), shown, F.when(F.size("components") > 3, " ...").otherwise(""))
    subject = F.concat(F.col("path"), F.lit("::"), F.col("class_name"))
    return _rows(hit, "cohesion", 3, WARNING, subject, message, F.col("lcom4"), t.max_lcom4, *_key(-F.col("lcom4"), -F.col("method_count"), F.col("path"), F.col("class_name")))


def violations(metrics: DataFrame, cohesion: DataFrame | None = None, cycles: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """All violations with ``rank``-able order columns; :func:`ranked` sorts them."""
    parts = [instability_violations(metrics, t), efferent_violations(metrics, t)]
    if cycles is not None:
        parts.insert(0, cycle_violations(cycles, t))
    if cohesion is not None:
        parts.append(cohesion_violations(cohesion, t))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranked(found: DataFrame) -> DataFrame:
    """Errors first, then by how far the threshold is passed, then in the order of the rules and within each."""
    return found.orderBy(F.col("severity") != ERROR, F.desc(F.col("measured") - F.col("threshold")), "rule_ordinal", "within").select("rule", "severity", "subject", "message", "measured", "threshold")


def gate(found: DataFrame) -> DataFrame:
    """One row: errors, warnings and whether the gate is passed."""
    counts = found.agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    return counts.withColumn("passed", F.col("errors") == 0)
