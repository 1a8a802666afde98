"""Sources with contracts and sinks: registries, JSON feeds, status lookups, bundles, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunks(events: DataFrame, ids: DataFrame, ident: str, start: str, end: str, days: int = 7, at: str = "ts") -> list[DataFrame]:
    """The rows of the given ids by stretches of `days` from start to end: each filter on time reaches the scan."""
    spark = events.sparkSession
    span = f"SELECT explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - INTERVAL 1 SECOND, INTERVAL {days} DAYS)) AS s"
    out = []
    for r in spark.sql(span).collect():
        s = F.lit(str(r.s)).cast("timestamp_ntz")
        stop = F.least(s + F.expr(f"INTERVAL {days} DAYS"), F.lit(end).cast("timestamp_ntz"))
        out.append(events.where((F.col(at) >= s) & (F.col(at) < stop)).join(ids, ident, "left_semi"))
    return out


def registry(rows: DataFrame, key: str, required: list[str], active: str) -> tuple[DataFrame, DataFrame]:
    """(registry, violations): active rows, equal ones once; (key, reason) for rows without a required value, a readable flag, or a single version.

    The flag counts as true where it is missing. A registry with violations isn't to be used: see `tables.require`.
    """
    flag = F.coalesce(F.lower(F.trim(active)), F.lit("true"))
    rest = [c for c in rows.columns if c != active]
    clean = rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes if c != active), flag.alias("_on"))
    odd = clean.where(~F.col("_on").isin("true", "1", "false", "0")).select(key, F.lit("invalid_flag").alias("reason"))
    kept = clean.where(F.col("_on").isin("true", "1")).select(*rest).distinct()
    none = F.lit(False)
    for c in required:
        none = none | F.col(c).isNull()
    lacks = kept.where(none).select(key, F.lit("missing_value").alias("reason"))
    twice = kept.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("conflict").alias("reason"))
    return kept, odd.unionByName(lacks).unionByName(twice)


FEED = "as_of string, count long, outages array<struct<outage_id:string,devices:array<string>>>"


def feed_reason(payload: Column, now: int, tolerance_s: int = 600) -> Column:
    """Why a JSON feed is refused, else OK: its shape, its time, its count, repeated ids."""
    f = F.from_json(payload, FEED)
    as_of = F.regexp_extract(F.get_json_object(payload, "$.as_of"), r"^-?[0-9]+(\.[0-9]+)?$", 0)
    listed = F.get_json_object(payload, "$.outages").startswith("[")
    ids = F.transform(f["outages"], lambda o: o["outage_id"])
    number = F.coalesce(as_of != "", F.lit(False)) & ~F.coalesce(payload.rlike(r'"as_of"\s*:\s*"'), F.lit(False))
    rules = (
        ("not_an_object", ~F.coalesce(F.trim(payload).startswith("{"), F.lit(False))),
        ("no_list", ~F.coalesce(listed, F.lit(False))),
        ("no_epoch", ~number),
        ("stale", F.abs(F.try_to_number(F.split_part(as_of, F.lit("."), F.lit(1)), F.lit("S999999999999")) - now) > tolerance_s),
        ("count", ~F.coalesce(f["count"] == F.size(f["outages"]), F.lit(False))),
        ("duplicate", F.size(F.array_distinct(ids)) < F.size(ids)),
    )
    out = F.lit("OK")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def status(devices: DataFrame, snapshot: DataFrame, ident: str) -> DataFrame:
    """Each device once with its row of the snapshot; those that it lacks have nulls. A snapshot has one row an id, or the query fails."""
    once = snapshot.groupBy(ident).agg(*(F.first(c).alias(c) for c in snapshot.columns if c != ident), F.count("*").alias("_n"))
    once = once.where(F.assert_true(F.col("_n") == 1, F.lit("a status twice")).isNull()).drop("_n")
    return devices.select(ident).distinct().join(once, ident, "left")


def bitmap64(bits: Column, n_bytes: int) -> Column:
    """Base64 of whole numbers that are the words of a bitmap, 60 bits each, lowest first, as little-endian bytes; empty if no bit is set."""
    words = F.zip_with(bits, F.sequence(F.lit(0), F.size(bits) - 1), lambda w, i: F.lpad(F.conv(F.coalesce(w, F.lit(0)).cast("string"), 10, 2), 60, "0"))
    big = F.lpad(F.array_join(F.reverse(words), ""), 8 * n_bytes + 240, "0")
    byte = lambda k: F.lpad(F.conv(F.substring(big, F.length(big) - 8 * (k + 1) + 1, F.lit(8)), 2, 16), 2, "0")
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_bytes - 1)), byte), "")
    return F.when(F.exists(bits, lambda w: w != 0), F.base64(F.unhex(hexes))).otherwise("")


def bundle(frames: dict[str, DataFrame], path: str, order: dict[str, list[str]]) -> DataFrame:
    """Write frames as gzip CSV folders below a path that must not exist, and give (name, rows, sha256) as their manifest.

    The hash is that of the rows' own hashes in order of the keys, so it says what is in a table, not how it was split into files.
    """
    out = None
    for name, df in frames.items():
        df.write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
        line = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        bins = df.withColumn("_h", line).groupBy(F.substring("_h", 1, 3).alias("_b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("h"))
        one = bins.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))
        one = one.select(F.lit(name).alias("name"), "rows", "sha256")
        out = one if out is None else out.unionByName(one)
    out.write.mode("errorifexists").json(f"{path}/manifest")
    return out.sparkSession.read.schema("name string, rows long, sha256 string").json(f"{path}/manifest")


def snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write a version of a table as one folder, and then say that it is finished; readers never see a half-written one."""
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    df.sparkSession.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{root}/finished")


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version; one that failed before its end stays unseen, and the last good one is read."""
    last = spark.read.schema("version long").parquet(f"{root}/finished").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/versions/{last}")


def publish(frames: dict[str, DataFrame], root: str, version: int) -> None:
    """Write several tables as one version. One entry of the ledger, last, makes all of them visible at once.

    What an attempt that failed has left of a version isn't in the ledger and gives way. A version in the ledger stays.
    """
    spark = next(iter(frames.values())).sparkSession
    if published(spark, root).where(F.col("version") >= version).count():
        raise ValueError(f"version {version} or a later one is published")
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    entry = spark.createDataFrame([(version, sorted(frames))], "version long, tables array<string>")
    entry.coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The ledger: (version, tables)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "version long, tables array<string>")
    return spark.read.schema("version long, tables array<string>").parquet(f"{root}/ledger")


def newest_of(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest published version, all of the same one; empty before the first."""
    last = published(spark, root).orderBy(F.desc("version")).first()
    return {} if last is None else {t: spark.read.parquet(f"{root}/versions/{last['version']}/{t}") for t in last["tables"]}


def texts(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """(path, found): every match of a pattern in whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("found"))


def rings(devices: DataFrame, key: str, ident: str, lat: float = 20.0, lon: float = 77.0, radius: float = 0.001) -> DataFrame:
    """(key, ident, lat, lon): a fixture that puts the devices of each whole-numbered key on a circle of its own, evenly, in order of ident."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(ident)) - 1
    angle = place * (2 * 3.141592653589793 / F.count("*").over(Window.partitionBy(key)))
    x = devices.select(key, ident, angle.alias("_t"))
    return x.select(key, ident, (lat + F.col(key) * 0.1 + radius * F.sin("_t")).alias("lat"), (lon + radius * F.cos("_t")).alias("lon"))
