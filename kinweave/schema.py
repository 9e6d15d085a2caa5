"""The three input tables. Text files carry no header; columns are known by position."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("nick_name", T.StringType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("region_code", T.IntegerType()),
        T.StructField("favorite_hobby", T.StringType()),
    ]
)
FOLLOWS = T.StructType(
    [
        T.StructField("col_rel", T.LongType()),
        T.StructField("id1", T.LongType()),
        T.StructField("id2", T.LongType()),
        T.StructField("date_of_relation", T.IntegerType()),
        T.StructField("description", T.StringType()),
    ]
)
ACTIVITY = T.StructType(
    [
        T.StructField("action_id", T.LongType()),
        T.StructField("by_who", T.LongType()),
        T.StructField("what_page", T.LongType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("action_time", T.IntegerType()),
    ]
)
