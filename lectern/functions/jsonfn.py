"""JSON value helpers (TXT6 re-typing, JSN1-JSN3, MAP1)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import unescape_text


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def retype(c: str | Column) -> Column:
    """TXT6: a string that parses as JSON becomes that value (VARIANT); other text
    gives NULL (keep the original string alongside)."""
    return F.try_parse_json(_col(c))


def json_kind(v: Column) -> Column:
    """Coarse kind of a VARIANT value: number, string, boolean, array, object, null."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(s.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit("number"))
            .when(s == "STRING", F.lit("string"))
            .when(s == "BOOLEAN", F.lit("boolean"))
            .when(s.startswith("ARRAY"), F.lit("array"))
            .when(s.startswith("OBJECT"), F.lit("object"))
            .otherwise(F.lit("null")))


def json_or_text(c: str | Column) -> Column:
    """JSN2: compact JSON when the text parses, the raw text otherwise."""
    return F.coalesce(F.to_json(F.try_parse_json(_col(c))), _col(c))


def flatten_object(c: str | Column) -> Column:
    """JSN1 (one level): a JSON object text -> ``ARRAY<STRUCT<path, value>>`` in
    document order; nested values stay as JSON text."""
    m = F.from_json(_col(c), "map<string,string>")
    return F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit("$."), e["key"]).alias("path"),
                                                            e["value"].alias("value")))


def falsy_to_empty(c: str | Column) -> Column:
    """JSN3: NULL or empty text -> ``""``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(""))


def map_update(base: Column, *updates: Column) -> Column:
    """MAP1: ``dict.update`` on maps; later maps win (needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN``, set by the session helpers)."""
    return F.map_concat(base, *updates)


def json_depth(c: str | Column) -> Column:
    """How deep objects and lists are nested in a JSON text (0 for a scalar or NULL):
    the largest number of open brackets outside string literals."""
    marks = F.regexp_replace(F.regexp_replace(_col(c), r'(?s)"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.split(marks, "")
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc, x):
        now = acc["open"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"))

    return F.coalesce(F.aggregate(steps, zero, step, lambda acc: acc["most"]), F.lit(0))


def flatten_json_tree(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """JSN1: a JSON document -> ``(path, value)`` leaf rows, dict keys as ``.key``
    and list items as ``[i]`` (``$.a.b[1].c``), in document order.

    Each level is one projection: a node's children (object entries or list
    items) or the node itself when it is a leaf go through one ``inline``.  As many
    levels are made as the deepest document has: one aggregate over the data finds
    that number, so the plan grows linearly with it.  Scalars come out as text;
    empty containers stay as ``{}`` / ``[]`` leaves.
    """
    keep = list(keep)
    cur = df.select(*keep, F.lit("$").alias("path"), F.col(json_col).alias("value"), F.lit(False).alias("leaf"))
    depth = df.agg(F.max(json_depth(json_col))).first()[0] or 0
    for _ in range(depth):
        v = F.ltrim(F.col("value"))
        m = F.from_json(F.col("value"), "map<string,string>")
        a = F.from_json(F.col("value"), "array<string>")
        kids_obj = F.transform(F.map_entries(m), lambda e: F.struct(
            F.concat(F.col("path"), F.lit("."), e["key"]).alias("path"), e["value"].alias("value"),
            F.lit(False).alias("leaf")))
        kids_arr = F.transform(a, lambda x, i: F.struct(
            F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("value"),
            F.lit(False).alias("leaf")))
        itself = F.array(F.struct(F.col("path").alias("path"), F.col("value").alias("value"),
                                  F.lit(True).alias("leaf")))
        children = (F.when(F.col("leaf"), itself)
                    .when(v.startswith("{") & (F.coalesce(F.size(kids_obj), F.lit(-1)) > 0), kids_obj)
                    .when(v.startswith("[") & (F.coalesce(F.size(kids_arr), F.lit(-1)) > 0), kids_arr)
                    .otherwise(itself))
        cur = cur.select(*keep, F.inline(children))
    return cur.select(*keep, "path", "value")


def clean_string_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """TXT6 applied through a paper: literal ``\\r\\n`` removed and ``\\"`` unescaped in
    every string column, map value and list item (nested one level)."""
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if cols is not None and f.name not in cols:
            out.append(c)
        elif isinstance(dt, T.StringType):
            out.append(unescape_text(c).alias(f.name))
        elif isinstance(dt, T.MapType) and isinstance(dt.valueType, T.StringType):
            out.append(F.transform_values(c, lambda k, v: unescape_text(v)).alias(f.name))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
            out.append(F.transform(c, lambda x: unescape_text(x)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def retype_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """TXT6 re-typing: ``{col}_value`` VARIANT columns holding the parsed JSON value of
    each listed string column (NULL when the text is not JSON)."""
    return df.withColumns({f"{c}_value": retype(F.replace(F.col(c), F.lit("\\r\\n"), F.lit("")))
                           for c in columns})
