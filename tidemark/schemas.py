"""Schemas of the streams, lookups and configuration that the jobs read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


#: A change of a database row: its new values, and the old ones of the columns that changed.
CDC = T.StructType([
    *strings("database", "table", "type").fields,
    T.StructField("data", T.MapType(_S, _S)),
    T.StructField("old", T.MapType(_S, _S)),
    T.StructField("ts", _S),
])

COMMON = strings("mid", "uid", "is_new", "vc", "ch", "ar")
PAGE = T.StructType([*strings("page_id", "last_page_id", "item", "item_type").fields, T.StructField("during_time", _L)])
DISPLAY = T.StructType([*strings("item", "item_type").fields, T.StructField("order", _L)])
ACTION = T.StructType([*strings("action_id", "item").fields, T.StructField("ts", _L)])

#: An application log message; ``action`` and ``actions`` are two spellings of one array.
LOG = T.StructType([
    T.StructField("common", COMMON),
    T.StructField("page", PAGE),
    T.StructField("start", T.StructType([*strings("entry").fields, T.StructField("loading_time", _L)])),
    T.StructField("err", T.StructType([T.StructField("error_code", _L), *strings("msg").fields])),
    T.StructField("displays", T.ArrayType(DISPLAY)),
    T.StructField("action", T.ArrayType(ACTION)),
    T.StructField("actions", T.ArrayType(ACTION)),
    T.StructField("ts", _L),
])

DICTIONARY = strings("dic_code", "dic_name", "parent_code")
CONFIG = strings("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend")
#: A change of the configuration, as a change-data connector writes it.
CONFIG_CHANGE = T.StructType([T.StructField("op", _S), T.StructField("before", CONFIG), T.StructField("after", CONFIG)])
