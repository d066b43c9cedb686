"""Risk levels, advice and expert rules as row-level expressions.

A rule is a struct (rule_id, name, description, triggered, severity, message,
threshold_note). A missing input never triggers a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.functions.scalar import risk_level, risk_score

# Rule thresholds.
EXTREME_PLAINS, EXTREME_COASTAL = 45.0, 40.0
PERSISTENT_TMAX, PERSISTENT_ROLL7 = 40.0, 37.0
NIGHT_TMIN = 28.0
COMPOUND_TMAX, COMPOUND_DEPARTURE, COMPOUND_Z = 40.0, 4.5, 1.5
HYDRATION_P, HYDRATION_TMAX = 0.30, 35.0
WARM_DEPARTURE, OVERLAY_P, OVERLAY_CRITICAL = 3.0, 0.6, 0.8
SEVERITY_ORDER = ("INFO", "WARNING", "CRITICAL")

# Advice categories per level, in order. The messages are a table of the caller.
ADVICE_CATEGORIES = {
    "LOW": ("Hydration", "Outdoor Exposure", "Public Awareness"),
    "MODERATE": ("Hydration", "Outdoor Exposure", "Cooling", "Vulnerable Populations", "Public Awareness"),
    "HIGH": ("Hydration", "Outdoor Exposure", "Cooling", "Vulnerable Populations", "Workplace", "Public Awareness"),
    "EXTREME": ("Hydration", "Outdoor Exposure", "Cooling", "Vulnerable Populations", "Workplace", "Emergency Preparedness",
                "Public Awareness"),
}


def advice_table(spark: SparkSession, messages: dict[tuple[str, str], str]) -> DataFrame:
    """(level, ordinal, category, message) of the fixed categories; ``messages`` by level and category, missing ones are NULL."""
    rows = [(level, i, c, messages.get((level, c))) for level, names in ADVICE_CATEGORIES.items() for i, c in enumerate(names, 1)]
    return spark.createDataFrame(rows, "level string, ordinal int, category string, message string")


def advice(level: Column, messages: dict[tuple[str, str], str]) -> Column:
    """The ordered advice of a level as an array of structs (a literal lookup, no join)."""
    out = F.when(level.isNull(), None)
    for name, categories in ADVICE_CATEGORIES.items():
        out = out.when(level == name, F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(messages.get((name, c))).cast("string").alias("message")) for c in categories]))
    return out


def recommend(df: DataFrame, messages: dict[tuple[str, str], str], level: str = "risk_level") -> DataFrame:
    """One row per input row and recommendation."""
    table = advice_table(df.sparkSession, messages).withColumnRenamed("level", level)
    return df.join(F.broadcast(table), level)  # 21 rows


def _rule(number: str, name: str, when: Column, severity: Column | str, text: Column, note: str) -> Column:
    """``note`` names the inputs and limits; the description is made of it."""
    hit = F.coalesce(when, F.lit(False))
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(number).alias("rule_id"), F.lit(name).alias("name"), F.lit(f"{name}: fires if {note}.").alias("description"),
                    hit.alias("triggered"), sev.alias("severity"), F.when(hit, text).otherwise("").alias("message"),
                    F.lit(note).alias("threshold_note"))


def absolute_rules(zone: Column, tmax: Column, tmin: Column, roll7: Column, departure: Column, zscore: Column,
                   level: Column, p: Column) -> Column:
    """The seven rules of the absolute definition, in fixed order."""
    limit = F.when(zone == "coastal", EXTREME_COASTAL).otherwise(EXTREME_PLAINS)
    elevated = level.isin("HIGH", "EXTREME")
    graded = F.when(level == "EXTREME", "CRITICAL").otherwise("WARNING")
    return F.array(
        _rule("RULE_01", "Extreme Temperature", tmax >= limit, "CRITICAL",
              F.format_string("Maximum %.1f reaches the extreme limit of %.0f.", tmax, limit),
              f"tmax >= {EXTREME_PLAINS:g} (coastal {EXTREME_COASTAL:g})"),
        _rule("RULE_02", "Persistent Heat", (tmax >= PERSISTENT_TMAX) & (roll7 >= PERSISTENT_ROLL7), "WARNING",
              F.format_string("Maximum %.1f after a week averaging %.1f.", tmax, roll7),
              f"tmax >= {PERSISTENT_TMAX:g} and 7-day mean >= {PERSISTENT_ROLL7:g}"),
        _rule("RULE_03", "High Nighttime Temperature", tmin >= NIGHT_TMIN, "WARNING",
              F.format_string("Night minimum %.1f gives little recovery.", tmin), f"tmin >= {NIGHT_TMIN:g}"),
        _rule("RULE_04", "Compounded Heat Stress",
              (tmax >= COMPOUND_TMAX) & (departure >= COMPOUND_DEPARTURE) & (zscore >= COMPOUND_Z), "WARNING",
              F.format_string("Maximum %.1f, departure %.2f and z-score %.2f are high together.", tmax, departure, zscore),
              f"tmax >= {COMPOUND_TMAX:g}, departure >= {COMPOUND_DEPARTURE:g} and z-score >= {COMPOUND_Z:g}"),
        _rule("RULE_05", "Vulnerable Population Alert", elevated, graded,
              F.concat(F.lit("Risk is "), level, F.lit(": check on people at risk.")), "risk level is HIGH or EXTREME"),
        _rule("RULE_06", "Outdoor Exposure Warning", elevated, graded,
              F.concat(F.lit("Risk is "), level, F.lit(": avoid the hours from 11:00 to 17:00 outdoors.")), "risk level is HIGH or EXTREME"),
        _rule("RULE_07", "Hydration and Cooling Reminder",
              F.coalesce(p >= HYDRATION_P, F.lit(False)) | F.coalesce(tmax >= HYDRATION_TMAX, F.lit(False)), "INFO",
              F.lit("Drink regularly and keep cool."), f"probability >= {HYDRATION_P:g} or tmax >= {HYDRATION_TMAX:g}"))


def relative_rules(qualifying: Column, lagged: Column, tmax: Column, p90: Column, departure: Column, p: Column) -> Column:
    """The four rules of the percentile definition."""
    hot = qualifying == 1
    return F.array(
        _rule("EU_01", "Above local hot-day percentile", hot, "WARNING",
              F.format_string("Maximum %.1f is above the local percentile %.1f.", tmax, p90), "the day qualifies by the local percentile"),
        _rule("EU_02", "Persistent local heat", hot & (F.coalesce(lagged, F.lit(0)) != 0), "CRITICAL",
              F.lit("Locally exceptional heat continues."), "the day qualifies and the day before was labelled"),
        _rule("EU_03", "Unusually warm conditions", departure >= WARM_DEPARTURE, "WARNING",
              F.format_string("Maximum is %.1f above the local normal.", departure), f"departure >= {WARM_DEPARTURE:g}"),
        _rule("EU_04", "Model risk overlay", p >= OVERLAY_P, F.when(p >= OVERLAY_CRITICAL, "CRITICAL").otherwise("WARNING"),
              F.lit("The model sees an elevated risk for the next day."), f"probability >= {OVERLAY_P:g} (critical from {OVERLAY_CRITICAL:g})"))


def fired(rules: Column, severity: str | None = None) -> Column:
    hits = F.filter(rules, lambda r: r["triggered"])
    return F.filter(hits, lambda r: r["severity"] == severity) if severity else hits


def highest_severity(rules: Column) -> Column:
    """NULL if no rule fired."""
    rank = F.aggregate(rules, F.lit(0), lambda top, r: F.greatest(top, F.when(r["triggered"], F.when(r["severity"] == "CRITICAL", 3)
                       .when(r["severity"] == "WARNING", 2).otherwise(1)).otherwise(0)))
    return F.when(rank == 3, SEVERITY_ORDER[2]).when(rank == 2, SEVERITY_ORDER[1]).when(rank == 1, SEVERITY_ORDER[0])


def summarise(df: DataFrame, rules: str = "rules") -> DataFrame:
    hits = fired(F.col(rules))
    return df.withColumns({"triggered_ids": F.transform(hits, lambda r: r["rule_id"]),
                           "triggered_count": F.size(hits), "highest_severity": highest_severity(F.col(rules))})


def assess_risk(df: DataFrame, p: str = "probability") -> DataFrame:
    """Level, 0-100 score, and an error text for an unusable probability."""
    x = df.withColumns({"risk_level": risk_level(F.col(p))})
    ok = F.col("risk_level").isNotNull()
    return x.withColumns({"risk_score": F.when(ok, risk_score(F.col(p))),
                          "risk_error": F.when(~ok, F.lit("probability missing or outside [0, 1]"))})
