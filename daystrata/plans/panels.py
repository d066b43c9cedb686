"""The derived stages of the supplier panel, shared by many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daystrata.operators import climatology, features, runs
from daystrata.plans.bindings import BASE_END, BASE_START, SUPPLIER, supplier_daily, supplier_dim
from daystrata.spec import PanelSpec


def departed(spark, sf, spec: PanelSpec = SUPPLIER) -> DataFrame:
    panel = supplier_daily(spark, sf)
    table = climatology.curves(panel, spec, BASE_START, BASE_END)
    return climatology.attach_curves(panel, table, spec).join(
        supplier_dim(spark, sf).select("entity", "region_type", "latitude", "longitude"), "entity", "left")


def qualified(spark, sf) -> DataFrame:
    return climatology.qualifying_absolute(departed(spark, sf), SUPPLIER)


def labelled(spark, sf) -> DataFrame:
    return runs.label_runs(qualified(spark, sf), SUPPLIER)


def featured(spark, sf) -> DataFrame:
    """Untrimmed features; the entity key itself is the numeric entity code."""
    return features.build(labelled(spark, sf), SUPPLIER).withColumn("entity_code", F.col("entity").cast("double"))


def splits_by_year(df: DataFrame) -> DataFrame:
    from daystrata.operators.splits import by_year
    return by_year(df, SUPPLIER, train_until=1999, val_until=2000)
