"""Small fixtures with the awkward rows that every operator has to take."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def documents(spark, rows, extra=()):
    """rows of (doc_id, text) or (doc_id, text, source); ``extra`` are names of further columns, which may clash."""
    schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * len(extra)) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
