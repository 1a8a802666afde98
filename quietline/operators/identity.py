"""Identity and quality: quarantined keys, consistent collapse, one-to-one bridges, latest rows, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normal(c: Column | str) -> Column:
    """Trimmed, upper-cased, blanks as null."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def serial(c: Column | str) -> Column:
    """The letters and digits of an identifier."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", ""), F.lit(""))


def quarantined(df: DataFrame, keys: list[str], values: list[str], valid: Column) -> DataFrame:
    """(keys, n, variants, invalid, kept): a key is kept if it has one variant of the values and no invalid row.

    Variants are distinct structs; hashes or several columns would let nulls fall together.
    """
    x = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.when(valid, F.struct(*values))).alias("variants"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
    return x.withColumn("kept", (F.col("variants") == 1) & (F.col("invalid") == 0))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def consistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status): the value where all non-null ones agree; status says why not."""
    x = df.groupBy(key).agg(F.count_distinct(value).alias("d"), F.min(value).alias("v"))
    return x.select(key, F.when(F.col("d") == 1, F.col("v")).alias(value), F.when(F.col("d") == 0, "MISSING").when(F.col("d") > 1, "CONFLICT").otherwise("OK").alias("status"))


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both sides occur with one partner only. Degrees are aggregates, not gathered sets."""
    p = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()
    single = lambda c: p.groupBy(c).agg(F.count("*").alias("d")).where("d = 1").select(c)
    return p.join(single(left), left, "left_semi").join(single(right), right, "left_semi").select(left, right)


def pseudonyms(df: DataFrame, ident: str, prefix: str = "D", digits: int = 6) -> DataFrame:
    """(id, pseudonym): numbers by the order of the hashes of the ids.

    Ranks come from sorted ranges with the counts of the ranges before, so no single task holds all ids.
    """
    x = df.select(ident).distinct().withColumn("h", F.sha2(F.col(ident).cast("string"), 256)).withColumn("bin", F.substring("h", 1, 3))
    base = x.groupBy("bin").agg(F.count("*").alias("c"))  # at most 4,096 rows
    base = base.select("bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("h"))
    return x.join(F.broadcast(base), "bin").select(ident, F.concat(F.lit(prefix), F.lpad(rank.cast("string"), digits, "0")).alias("pseudonym"))


def hash_sample(df: DataFrame, ident: str, modulus: int) -> DataFrame:
    """A stable sample by key: the first 32 bits of the key's hash, modulo `modulus`, are 0."""
    return df.where(F.conv(F.substring(F.md5(F.col(ident).cast("string")), 1, 8), 16, 10).cast("long") % modulus == 0)
