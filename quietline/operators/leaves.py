"""Leaves of JSON documents at any depth, and values at paths with wildcards, through variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

_STEP = re.compile(r'\.([^.\[\]*"]+)|\["([^"]*)"\]|\[(\d+)\]|(\[\*\]|\.\*)')


def _spelt(key: Column, pos: Column) -> Column:
    """The step of a path to a field or an element."""
    bare = key.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).when(bare, F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), key, F.lit('"')))


def _is_container(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _exploded(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, v): one row for each field or element of `v`."""
    x = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return x.select(*keys, F.concat("path", _spelt(F.col("key"), F.col("pos"))).alias("path"), F.col("value").alias("v"))


#: Levels that a round opens.
LEVELS = 4


def _opened(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` (keys, path, v) with the fields or elements of `v` in its place, or as it is if it has none; `_p` says which."""
    x = df.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    path = F.when(F.col("pos").isNull(), F.col("path")).otherwise(F.concat("path", _spelt(F.col("key"), F.col("pos"))))
    return x.select(*keys, path.alias("path"), F.coalesce("value", "v").alias("v"), F.col("pos").isNotNull().alias("_p"))


def leaves(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, value): every value of a document that is no object and no array; a null has no value.

    Containers are opened in rounds, each LEVELS levels down, until none is left; so depth costs rounds and size costs none.
    What is no JSON, empty documents and empty containers have no leaves. Paths are those that SQL/JSON writes.
    """
    left = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        for _ in range(LEVELS):
            left = _opened(left, keys)
        # A container that the last step found nothing in is empty.
        marked = left.withColumn("_c", _is_container(F.col("v"))).where("_p OR NOT _c")
        value = F.when(~F.col("_c"), F.try_variant_get("v", "$", "string"))
        marked = cut(marked.select(*keys, "path", value.alias("value"), F.when(F.col("_c"), F.col("v")).alias("v"), "_c"))
        flat = marked.where("NOT _c").select(*keys, "path", "value")
        out = flat if out is None else out.unionByName(flat)
        left = marked.where("_c").select(*keys, "path", "v")
        if left.isEmpty():
            return out


def at_path(df: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """(keys, path, value): what a path leads to, with the wildcards [*] (elements) and .* (fields) anywhere in it.

    Strings come without quotes, containers as JSON. Paths that lead nowhere give no row.
    """
    if not path.startswith("$") or "".join(m.group(0) for m in _STEP.finditer(path)) != path[1:]:
        raise ValueError(f"not a path: {path}")
    x = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("v"))
    for name, quoted, index, every in (m.groups() for m in _STEP.finditer(path)):
        x = x.where("v IS NOT NULL")
        if every:
            kind = "ARRAY" if every == "[*]" else "OBJECT"
            x = _exploded(x.where(F.schema_of_variant("v").startswith(kind)), keys)
        else:
            key = F.lit(name or quoted) if index is None else F.lit(None).cast("string")
            step = f"[{index}]" if index is not None else f'["{name or quoted}"]'
            x = x.select(*keys, F.concat("path", _spelt(key, F.lit(index))).alias("path"), F.try_variant_get("v", f"${step}", "variant").alias("v"))
    return x.where("v IS NOT NULL").select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value"))
