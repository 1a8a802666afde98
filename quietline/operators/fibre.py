"""Fibre evidence of outages: a shared address with healthy devices beside it, a shared locality, or a line of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import contrasts, geo
from .rules import decide

#: Controls that a comparison needs, and the share of them that is up.
CONTROLS, UP_SHARE = 5, 0.7


def entities(devices: DataFrame, group: Column) -> DataFrame:
    """(group, device, kind, value, score) of what is known of the devices' addresses."""
    kinds = (("house_details", "house"), ("road", "road"), ("locality", "locality"))
    rows = F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"), F.lit(1.0).alias("score")) for kind, c in kinds)))
    return devices.select(group.alias("g"), "device", rows).where("value IS NOT NULL")


def best_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def address_match(pop: DataFrame) -> DataFrame:
    """(outage, scope, confidence, device): the largest shared address within a cluster that also has a healthy device."""
    mixed = pop.join(geo.clusters(pop, "outage", "device"), ["outage", "device"])
    addressed = (F.col("state") == "DOWN") & F.col("addressed")
    fit = mixed.groupBy("outage", "cluster").agg(F.count_if(F.col("state") == "UP").alias("up"), F.count_if(addressed).alias("down"))
    down = mixed.where(addressed).join(fit.where("up > 0 AND down > 1"), ["outage", "cluster"], "left_semi")
    e = entities(down, F.struct("outage", "cluster"))
    found = contrasts.address_groups(e, "g", "device").select(F.col("g.outage").alias("outage"), "g", "scope", "part", "context", "n", "confidence")
    one = best_of(found, "outage", [F.desc("n"), F.desc("confidence"), F.col("g")])
    part = e.where("kind IN ('house_details', 'road')").select("g", "device", "kind", F.col("value").alias("part"))
    context = e.where("kind IN ('road', 'locality')").select("g", "device", F.col("value").alias("context"))
    kind = F.when(F.col("scope") == "HOUSE", "house_details").otherwise("road")
    members = one.withColumn("kind", kind).join(part, ["g", "kind", "part"]).join(context, ["g", "device", "context"])
    return members.select("outage", "scope", "confidence", "device").distinct()


def locality_match(pop: DataFrame, least: int = 3) -> DataFrame:
    """(outage, device): the failed devices of the locality that most of an outage's share, `least` or more."""
    down = pop.where("state = 'DOWN' AND locality IS NOT NULL")
    n = down.groupBy("outage", "locality").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    one = best_of(n, "outage", [F.desc("n"), F.col("locality")])
    return down.join(one, ["outage", "locality"]).select("outage", "device")


def line_match(pop: DataFrame) -> DataFrame:
    """(outage, n, length_m, across_p90_m, ratio, matched, cluster): the best group of failures by the shape of a line."""
    down = pop.where("state = 'DOWN'")
    c = down.join(geo.clusters(down, "outage", "device", scale=0.5, most=250.0), ["outage", "device"]).withColumn("g", F.struct("outage", "cluster"))
    totals = pop.groupBy("outage").agg(F.count("*").alias("all"), F.count_if(F.col("state") == "UP").alias("up"))
    x = geo.profile(c, "g").withColumns({"outage": F.col("g.outage"), "cluster": F.col("g.cluster")}).join(totals, "outage")
    controls = F.col("all") - F.col("n")  # members have failed, so all that are up are controls
    line = (F.col("n") >= 5) & F.col("length_m").between(50, 500) & (F.col("ratio") >= 3) & (F.col("across_p90_m") <= 50)
    x = x.withColumn("matched", line & (controls >= CONTROLS) & (F.round(F.col("up") / controls, 4) >= UP_SHARE))
    order = [F.desc("matched"), F.desc("n"), F.desc("ratio"), F.col("across_p90_m"), F.col("cluster")]
    return best_of(x, "outage", order).select("outage", "n", "length_m", "across_p90_m", "ratio", "matched", "cluster")


def evidence(devices: DataFrame) -> DataFrame:
    """(outage, path, scope, affected, confidence, r90_m, controls, control_up_share) for each outage that has failed devices.

    `devices`: (outage, device, state, lat, lon, house, road, locality), the outage's members and those it is compared with;
    states other than UP and DOWN don't count. RULE_4A is a shared address, 4B a shared locality within 500 m, 4C a line.
    """
    known = F.coalesce("house", "road", "locality").isNotNull()
    pop = devices.where(F.col("state").isin("UP", "DOWN") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("addressed", known)
    address, local, line = address_match(pop), locality_match(pop), line_match(pop)
    by_address = address.groupBy("outage").agg(F.first("scope").alias("scope"), F.first("confidence").alias("confidence"), F.count("*").alias("by_address"))
    by_place = local.groupBy("outage").agg(F.count("*").alias("by_place"))
    # What is measured are the members of the address, else of the locality, else all that failed.
    down = pop.where("state = 'DOWN'").join(by_address, "outage", "left").join(by_place, "outage", "left")
    marks = address.select("outage", "device", F.lit(True).alias("a")), local.select("outage", "device", F.lit(True).alias("l"))
    down = down.join(marks[0], ["outage", "device"], "left").join(marks[1], ["outage", "device"], "left")
    measured = down.where("CASE WHEN by_address IS NOT NULL THEN a WHEN by_place IS NOT NULL THEN l ELSE true END")
    r = geo.radii(geo.from_centre(measured.select("outage", "device", "lat", "lon"), ["outage"], "device"), ["outage"]).select("outage", F.col("n").alias("size"), F.col("r90").alias("r90_m"))
    totals = pop.groupBy("outage").agg(F.count("*").alias("all"), F.count_if(F.col("state") == "UP").alias("up"))
    x = r.join(totals, "outage").join(by_address, "outage", "left").join(by_place, "outage", "left").join(line.select("outage", F.col("n").alias("in_line"), "matched"), "outage", "left")
    controls = F.col("all") - F.col("size")
    x = x.withColumn("controls", controls).withColumn("control_up_share", F.when(controls > 0, F.round(F.col("up") / controls, 4)).otherwise(0.0))
    fallback = F.expr(f"by_place IS NOT NULL AND size >= 3 AND r90_m <= 500 AND controls >= {CONTROLS} AND control_up_share >= {UP_SHARE}")
    path = decide([("RULE_4A", F.col("by_address").isNotNull()), ("RULE_4B", fallback), ("RULE_4C", F.col("matched"))], "NONE")
    pick = lambda a, b, c, none: F.when(F.col("path") == "RULE_4A", a).when(F.col("path") == "RULE_4B", b).when(F.col("path") == "RULE_4C", c).otherwise(none)
    x = x.withColumn("path", path)
    scope = pick(F.col("scope"), F.lit("LOCALITY"), F.lit("DIRECTIONAL"), F.lit("UNKNOWN"))
    affected = pick(F.col("by_address"), F.col("by_place"), F.col("in_line"), F.lit(0).cast("long"))
    confidence = pick(F.col("confidence"), F.lit(0.6), F.lit(0.6), F.lit(0.0))
    return x.select("outage", "path", scope.alias("scope"), affected.alias("affected"), confidence.alias("confidence"), "r90_m", "controls", "control_up_share")
