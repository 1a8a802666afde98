"""Table sources and sinks: typed scans, contracts, versioned snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a local session without one gets one of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return f"{root}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and kept in the shared folder, without its lineage."""
    shared_path(df.sparkSession)
    return df.checkpoint()


def csv_table(spark: SparkSession, path: str, schema: str, gate_hours: int | None = None, as_of: str | None = None) -> DataFrame:
    """A CSV with a header and a declared schema; rows that don't fit it fail the read.

    With `gate_hours`, files older than that at `as_of`, or newer than `as_of`, fail it too.
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if gate_hours is None:
        return df
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("_metadata.file_modification_time"))
    return df.where(F.assert_true((age >= 0) & (age <= gate_hours * 3600), F.lit("a file is too old, or from the future")).isNull())


def violations(df: DataFrame, key: str, rules: dict[str, Column], single: tuple[str, ...] = ()) -> DataFrame:
    """(rule, n): rows that break a row rule, and keys with several values of a column that may have one. One pass of each kind."""
    rows = df.agg(*(F.count_if(F.coalesce(~c, F.lit(True))).alias(n) for n, c in rules.items()))
    out = rows.unpivot([], list(rules), "rule", "n") if rules else None
    if single:
        per_key = df.groupBy(key).agg(*(F.count_distinct(F.struct(c)).alias(c) for c in single))
        keys = per_key.agg(*(F.count_if(F.col(c) > 1).alias(f"one_{c}") for c in single)).unpivot([], [f"one_{c}" for c in single], "rule", "n")
        out = out.unionByName(keys) if out is not None else keys
    return out


def require(found: DataFrame) -> None:
    """Raise if a table of violations has any."""
    if bad := {r.rule: r.n for r in found.where("n > 0").collect()}:
        raise ValueError(f"the input breaks its contract: {bad}")


#: Names that never leave in an aggregate.
PRIVATE = ("name", "mobile", "phone", "address", "latitude", "longitude", "email")


def guard(df: DataFrame, private=PRIVATE) -> DataFrame:
    """`df` if no column or nested field has a private name (whole words between underscores), else an error."""

    def walk(kind, path):
        for f in getattr(kind, "fields", []):
            if set(f.name.lower().split("_")) & set(private):
                raise ValueError(f"private column {path + f.name}")
            walk(f.dataType, path + f.name + ".")
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner), path)

    walk(df.schema, "")
    return df


def revised(new: DataFrame, old: DataFrame, key: str, content: list[str]) -> DataFrame:
    """`new` with `revision`: 1 for a new key, that of `old` if the content is the same, else one more. Nulls equal nulls."""
    o = old.select(key, *(F.col(c).alias(f"_{c}") for c in content), F.col("revision").alias("_revision"))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    j = new.join(o, key, "left")
    return j.select(key, *content, F.when(F.col("_revision").isNull(), 1).when(same, F.col("_revision")).otherwise(F.col("_revision") + 1).cast("long").alias("revision"))


def geojson(df: DataFrame, geometry: str, properties: list[str], order: list[str]) -> DataFrame:
    """(value): one GeoJSON feature a line, in order."""
    feature = F.struct(F.lit("Feature").alias("type"), F.from_json(geometry, "type string, coordinates array<array<array<double>>>").alias("geometry"), F.struct(*properties).alias("properties"))
    return df.orderBy(*order).select(F.to_json(feature).alias("value"))
