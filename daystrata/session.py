"""Session settings the operators are tuned for. None of them changes a result."""

from pyspark.sql import SparkSession

SETTINGS = {
    # dates come from UTC timestamps
    "spark.sql.session.timeZone": "UTC",
    # join strategies, partition counts and skewed joins are decided at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods above 8000 bytes of byte code; without this, a
    # feature projection fused into one larger method would run interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Shuffle partitions are left to the caller: about 128 MB each, at least the core count."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
