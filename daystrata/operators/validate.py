"""Record validation: errors block a row, warnings do not.

Input fields may arrive as text. Every check is a column expression, and one
pass yields ``errors`` and ``warnings`` arrays plus the cleaned values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.spec import ENTITY_ALIASES, SANITY_BOUNDS, YEAR_RANGE


def normalise_entity(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical key of an entity name; NULL when unknown. For large registries join
    the alias table on lower(trim(name)) instead."""
    table = F.create_map(*[F.lit(x) for kv in (aliases or ENTITY_ALIASES).items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(c.cast("string"))))


def strict_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def as_number(c: Column) -> Column:
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def _names(flags: dict[str, Column]) -> Column:
    """All of them; a caller may shorten the list."""
    names = [F.when(f, F.lit(c)) for c, f in flags.items()]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def validate(df: DataFrame, entity: str, date: str, fields: list[str], required: list[str] | None = None,
             aliases: dict[str, str] | None = None, bounds: dict[str, tuple[float, float]] | None = None,
             known_entity: Column | None = None) -> DataFrame:
    """Add valid, errors, warnings, entity_clean, date_clean and ``<field>_num``."""
    bounds = SANITY_BOUNDS if bounds is None else bounds
    required = required or [entity, date, *fields[:1]]
    absent = [c for c in required if c not in df.columns]
    present = [c for c in fields if c in df.columns]
    if absent:  # a schema-level fault: no further checks
        return df.withColumns({"errors": F.array(F.lit("missing_field:" + ",".join(absent))),
                               "warnings": F.array().cast("array<string>"), "valid": F.lit(False)})
    clean = df.withColumns({"entity_clean": normalise_entity(F.col(entity), aliases) if known_entity is None else known_entity,
                            "date_clean": strict_date(F.col(date)),
                            **{f"{c}_num": as_number(F.col(c)) for c in present}})
    raw = {c: F.trim(F.col(c).cast("string")) for c in present}
    lost = {c: raw[c].isNull() | (F.lower(raw[c]) == "nan") for c in present}
    text = {c: F.col(f"{c}_num").isNull() & ~lost[c] for c in present}
    out = {c: ~F.col(f"{c}_num").between(*bounds[c]) for c in present if c in bounds}
    listed = lambda kind, names: F.when(F.size(names) > 0, F.concat(F.lit(kind + ":"), F.array_join(names, ",")))
    errors = F.array_compact(F.array(
        F.when(F.col("entity_clean").isNull(), F.concat(F.lit("unknown_entity:"), F.coalesce(F.col(entity).cast("string"), F.lit("")))),
        F.when(F.col("date_clean").isNull(), F.concat(F.lit("bad_date:"), F.coalesce(F.col(date).cast("string"), F.lit("")))),
        listed("missing_value", _names(lost)), listed("not_numeric", _names(text))))
    year = F.year("date_clean")
    warnings = F.array_compact(F.array(
        F.when(~year.between(*YEAR_RANGE), F.concat(F.lit("year_out_of_range:"), year.cast("string"))),
        listed("out_of_range", _names(out))))
    return clean.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0)


def flag_duplicates(validated: DataFrame, salts: int = 16) -> DataFrame:
    """Warn on repeated (entity, date). Counted by aggregation and joined back on the key and a salt (a hash of the row), so
    that the copies of one key are dealt over ``salts`` tasks."""
    keys = ["entity_clean", "date_clean"]
    copies = validated.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[c for c, t in validated.dtypes if "map<" not in t]), F.lit(salts)).cast("int")
    marked = validated.withColumn("_salt", salt).join(copies, [*keys, "_salt"], "left").drop("_salt")
    return marked.withColumn("warnings", F.when(F.col("_copies") > 1, F.array_append("warnings", F.lit("duplicate_key")))
                             .otherwise(F.col("warnings"))).drop("_copies")


def route(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    return validated.filter("valid"), validated.filter("NOT valid")


def batch_outcome(validated: DataFrame) -> DataFrame:
    """One row: the batch is valid only if no row has an error; good rows are usable anyway."""
    return validated.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("valid")).alias("valid_rows"),
                         F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"),
                         F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings")).withColumn(
        "valid", (F.col("errors") == 0) & (F.col("rows") > 0))
