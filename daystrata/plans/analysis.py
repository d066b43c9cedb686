"""Batch analysis: validate, score, grade, advise and apply the rules in one projection.

No shuffle is needed: invalid rows keep nulls, and everything else is a column
expression on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.operators import rules as rl
from daystrata.spec import DECISION_THRESHOLD


def analyse(validated: DataFrame, probability: Column, inputs: dict[str, str], messages: dict[tuple[str, str], str]) -> DataFrame:
    """``validated`` carries valid, errors and warnings. ``inputs`` maps zone, tmax, tmin,
    roll7, departure and zscore to columns; ``messages`` are the advice texts by level and category."""
    ok = F.col("valid")
    x = validated.withColumn("probability", F.when(ok, probability))
    x = rl.assess_risk(x)
    x = x.withColumn("prediction", (F.col("probability") >= DECISION_THRESHOLD).cast("int"))
    x = x.withColumn("recommendations", rl.advice(F.col("risk_level"), messages))
    rules = rl.absolute_rules(*[F.col(inputs[k]) for k in ("zone", "tmax", "tmin", "roll7", "departure", "zscore")],
                              F.col("risk_level"), F.col("probability"))
    x = rl.summarise(x.withColumn("rules", F.when(ok, rules)))
    loud = F.filter(rl.fired(F.col("rules")), lambda r: r["severity"].isin("WARNING", "CRITICAL"))
    spoken = F.transform(loud, lambda r: F.concat(r["rule_id"], F.lit(": "), r["message"]))
    return x.withColumn("warnings", F.concat("warnings", F.coalesce(spoken, F.array().cast("array<string>"))))


def as_document(analysed: DataFrame, keys: list[str]) -> DataFrame:
    """Nested result per row as JSON text."""
    doc = F.struct(*keys, "valid", "errors", "warnings", "probability", "prediction", "risk_level", "risk_score",
                   "recommendations", "rules")
    return analysed.select(*keys, F.to_json(doc).alias("document"))
