"""Row types of the tables, checked at the public boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
DOC_STATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("dl", T.LongType())])
FETCHED = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("html", T.StringType()), T.StructField("error", T.StringType())]
)
FRONTIER = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("priority", T.IntegerType()), T.StructField("seq", T.LongType())]
)
ROBOTS = T.StructType(
    [T.StructField("origin", T.StringType()), T.StructField("rule_no", T.IntegerType()), T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())]
)
ACTIVITY = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`, cast and in its order; others are dropped, a missing one is an error."""
    have = {c.lower() for c in df.columns}
    missing = [f.name for f in schema if f.name.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
