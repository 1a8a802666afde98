"""Attribution of outages by ordered rules over the cells of their event, and of live outages by provider shares.

Batch: outages that begin within a window are an event. In an event, each cell of a provider is DOWN from a share of its devices
on. An outage's target is a cell of its provider; rules compare the providers that are down there with where else they are down
("all of them are", a division over sets, is a `bool_and` after a join by event and provider). Shares are compared as whole
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut
from . import geo, rules, scores, timeline
from .timeline import seconds

#: Shares as tenths, and the fewest devices of a provider that counts.
DOWN_TENTHS, WIDE_TENTHS, LEAST_DEVICES = 7, 8, 5


def event_groups(outages: DataFrame, window_s: int = 1800) -> DataFrame:
    """(outage, csp, trigger, event): an outage joins the event whose first outage began at most `window_s` seconds before.

    A trigger with none in the window before it begins an event for sure. Such triggers are found by an equality join on
    buckets of the window's width; what follows one, up to the next, is folded apart from the rest (`timeline.anchored`).
    """
    x = outages.select("outage", "csp", "trigger", seconds("trigger").alias("_s")).withColumn("_b", F.floor(F.col("_s") / max(1, window_s)))
    ends = x.groupBy((F.col("_b") + 1).alias("_b")).agg(F.max("_s").alias("_before"))
    prior = F.coalesce(F.lag("_s").over(Window.partitionBy("_b").orderBy("_s", "outage")), F.col("_before"))
    x = x.join(ends, "_b", "left").withColumn("_prior", prior)
    x = x.withColumn("_first", F.when(F.col("_prior").isNull() | (F.col("_s") - F.col("_prior") > window_s), F.col("_s")))
    # The last sure begin of every bucket and of the buckets before it: rows follow time, not outages.
    own = x.groupBy("_b").agg(F.max("_first").alias("_last"))
    own = own.withColumn("_run", F.max("_last").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_run")
    here = F.max("_first").over(Window.partitionBy("_b").orderBy("_s", "outage").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_here", here).join(own, "_b").withColumn("_run", F.coalesce("_here", "_run"))
    anchored = timeline.anchored(x.select("_run", "trigger", "outage"), "_run", "trigger", "outage", window_s).select("outage", "anchor")
    number = scores.running(anchored.select("anchor").distinct(), [F.col("anchor")], {"n": F.lit(1)})
    named = anchored.join(number.select("anchor", F.concat(F.lit("AE"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("event")), "anchor")
    return outages.select("outage", "csp", "trigger").join(named.select("outage", "event"), "outage")


def cell_states(fleet: DataFrame, hits: DataFrame) -> DataFrame:
    """(event, csp, cell, failed, eligible, down) of every cell that an event concerns.

    Those are cells with an affected device, all cells of an affected provider, and all providers of an affected cell. An
    affected device counts as eligible even if it isn't active.
    """
    base = fleet.where("active AND cell IS NOT NULL").groupBy("csp", "cell").agg(F.count("*").alias("n"))
    located = hits.where("cell IS NOT NULL").select("event", "csp", "cell", "device", "active").distinct()
    failed = located.groupBy("event", "csp", "cell").agg(F.count("*").alias("failed"), F.count_if(~F.col("active")).alias("extra"))
    by_csp = hits.select("event", "csp").distinct().join(base, "csp").select("event", "csp", "cell")
    by_cell = failed.select("event", "cell").distinct().join(base, "cell").select("event", "csp", "cell")
    every = failed.select("event", "csp", "cell").union(by_csp).union(by_cell).distinct()
    x = every.join(base, ["csp", "cell"], "left").join(failed, ["event", "csp", "cell"], "left").fillna(0, ["n", "failed", "extra"])
    x = x.select("event", "csp", "cell", "failed", (F.col("n") + F.col("extra")).alias("eligible"))
    return x.withColumn("down", F.col("failed") * 10 >= F.col("eligible") * DOWN_TENTHS)


def peers_inside(fleet: DataFrame, outages: DataFrame, hits: DataFrame) -> DataFrame:
    """(outage, others, others_down): providers besides its own with an active device in the hull of an outage's members.

    Only outages with a hull: three places or more that aren't on one line. The border counts as inside.
    """
    rings = geo.hulls(hits, "outage")
    area = F.aggregate(F.transform("ring", lambda p, k: p["lon"] * F.get("ring", (k + 1) % F.size("ring"))["lat"] - p["lat"] * F.get("ring", (k + 1) % F.size("ring"))["lon"]), F.lit(0.0), lambda a, b: a + b)
    rings = rings.where((F.size("ring") > 2) & (F.abs(area) > 1e-12)).join(outages.select("outage", "event", F.col("csp").alias("own")), "outage")
    points = fleet.where("active AND cell IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("device", "csp", "lat", "lon")
    inside = geo.inside_rings(points, rings, "ring").select("outage", "event", "own", "device", "csp")
    down = hits.select("event", "device").distinct().withColumn("hit", F.lit(True))
    other = inside.where("csp <> own").join(down, ["event", "device"], "left").groupBy("outage").agg(F.count_distinct("csp").alias("others"), F.count_distinct(F.when(F.col("hit"), F.col("csp"))).alias("others_down"))
    return rings.select("outage").join(other, "outage", "left").fillna(0)


def attributed(fleet: DataFrame, outages: DataFrame, members: DataFrame, window_s: int = 1800) -> DataFrame:
    """One row an outage: its event, target cell, evidence, the rule that matched first, cause, extent and confidence.

    fleet (device, csp, cell, lat, lon, active), outages (outage, csp, trigger), members (outage, device). Devices without a
    cell count for an outage's own provider and for nothing else.
    """
    events = cut(event_groups(outages, window_s))
    hits = cut(members.join(events.select("outage", "event"), "outage").join(fleet, "device"))
    states = cut(cell_states(fleet, hits))
    base = fleet.where("active AND cell IS NOT NULL")
    cells_of = base.groupBy("csp").agg(F.count_distinct("cell").alias("n_cells"), F.count("*").alias("eligible_csp"))
    down = states.where("down")
    by_csp = down.groupBy("event", "csp").agg(F.count("*").alias("n_down"), F.bool_and(F.col("failed") * 10 > F.col("eligible") * DOWN_TENTHS).alias("above"))
    by_cell = down.groupBy("event", "cell").agg(F.count("*").alias("n_here"))

    # The target: of the provider's DOWN cells (else the members' cells) that with the most providers down, then the largest share.
    own = hits.where("cell IS NOT NULL").select("outage", "event", "csp", "cell").distinct()
    bare = own.join(by_csp.select("event", "csp"), ["event", "csp"], "left_anti")
    found = events.select("outage", "event", "csp").join(down.select("event", "csp", "cell"), ["event", "csp"]).select("outage", "event", "csp", "cell").unionByName(bare)
    found = found.join(states, ["event", "csp", "cell"]).join(by_cell, ["event", "cell"], "left").fillna(0, ["n_here"])
    best = F.min(F.struct((-F.col("n_here")).alias("a"), (-F.col("failed") / F.col("eligible")).alias("b"), "cell", "failed", "eligible", "n_here")).alias("t")
    target = found.groupBy("outage").agg(best).select("outage", F.col("t.cell").alias("cell"), "t.failed", "t.eligible", "t.n_here")

    # Members without any cell have no target, and rules that need one don't see them.
    located = own.select("outage").distinct().withColumn("located", F.lit(True))
    keyed = target.join(events.select("outage", "event", "csp"), "outage").select("outage", "event", "cell", F.col("csp").alias("own"))
    others = down.select("event", "cell", "csp").join(cells_of, "csp", "left").join(by_csp, ["event", "csp"])
    shared = keyed.join(others, ["event", "cell"]).groupBy("outage").agg(F.bool_and(F.coalesce("n_cells", F.lit(0)) >= 2).alias("all_wide"), F.bool_and(F.col("n_down") >= 2).alias("all_elsewhere"))
    near = keyed.join(base.select("cell", "csp").distinct(), "cell").groupBy("outage").agg(F.count_if(F.expr("csp <> own")).alias("neighbours"), F.count("*").alias("compared"))
    up = keyed.join(base.select("cell", "csp").distinct(), "cell").where("csp <> own").join(states, ["event", "csp", "cell"]).groupBy("outage").agg(F.bool_or(~F.col("down")).alias("neighbour_up"))
    gone = hits.where("active AND cell IS NOT NULL").groupBy("event", "csp").agg(F.count_distinct("device").alias("down_csp"))

    x = events.join(gone, ["event", "csp"], "left").join(cells_of, "csp", "left").join(by_csp, ["event", "csp"], "left")
    for more in (peers_inside(fleet, events, hits).withColumn("polygon", F.lit(True)), located, target, shared, near, up):
        x = x.join(more, "outage", "left")
    x = x.fillna(0, ["down_csp", "eligible_csp", "n_cells", "n_down", "n_here", "neighbours"])
    x = x.fillna(True, ["above", "all_wide"]).fillna(False, ["all_elsewhere", "neighbour_up", "located", "polygon"])
    e = F.expr
    wide = f"n_down * 10 >= n_cells * {WIDE_TENTHS}"
    chain = [
        ("R0_GEOMETRY_QUALITY_FAILURE", e("NOT polygon")),
        ("R0_CSP_DOWN_SHARE", e(f"eligible_csp > 0 AND down_csp * 10 >= eligible_csp * {WIDE_TENTHS}")),
        ("R0_POLYGON_PEER_UP", e("others > 0 AND others_down = 0")),
        ("R0_NO_LOCATED_H3", e("NOT located")),
        ("R1_NO_DOWN_CSP_H3", e("n_down = 0")),
        ("R2_MULTI_CSP_ONE_H3", e("n_here >= 2 AND all_wide AND NOT all_elsewhere")),
        ("R3_MULTI_CSP_MULTI_H3", e("n_here >= 2 AND all_wide AND all_elsewhere")),
        ("R4_CSP_WIDE", e(f"n_here < 2 AND n_cells >= 2 AND {wide} AND neighbours > 0")),
        ("R5_NEIGHBOR_CSP_UP", e(f"n_here < 2 AND n_cells >= 2 AND NOT ({wide}) AND neighbour_up")),
        ("R6_NO_CROSS_H3_COMPARISON", e("n_here >= 2 OR n_cells < 2")),
        ("R6_NO_NEIGHBOR_CSP", e("neighbours = 0")),
    ]
    rule = F.col("rule")
    x = x.withColumn("rule", rules.decide(chain, "R6_AMBIGUOUS_PATTERN"))
    side = rule.isin("R0_CSP_DOWN_SHARE", "R0_POLYGON_PEER_UP", "R4_CSP_WIDE", "R5_NEIGHBOR_CSP_UP")
    high = F.when(rule == "R0_CSP_DOWN_SHARE", e(f"down_csp * 10 > eligible_csp * {WIDE_TENTHS}")).when(rule.isin("R4_CSP_WIDE", "R5_NEIGHBOR_CSP_UP"), F.col("above")).otherwise(False)
    early = rule.startswith("R0")
    return x.select(
        "outage", "event", "csp", F.when(~early, F.col("cell")).alias("target_cell"), "down_csp", "eligible_csp",
        *(F.when(early, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("failed", "eligible", "compared")),
        F.col("n_down").alias("affected_cells"), F.col("n_cells").alias("eligible_cells"), "rule",
        F.when(side, "CSP_SIDE").otherwise("UNKNOWN").alias("cause"),
        F.when(rule.isin("R0_CSP_DOWN_SHARE", "R3_MULTI_CSP_MULTI_H3", "R4_CSP_WIDE"), "REGIONAL").otherwise("LOCAL").alias("extent"),
        F.when(~side, "LOW").when(high, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def providers(devices: DataFrame, keys: list[str], least: int = LEAST_DEVICES) -> DataFrame:
    """(keys, csp, down, up, unknown, eligible, down_share, up_share, qualified, reason): UNKNOWN devices stay in the denominator."""
    x = rules.shares(devices, [*keys, "csp"])
    x = x.withColumn("up_share", F.round(F.col("up") / F.col("eligible"), 4)).withColumn("qualified", F.col("eligible") >= least)
    return x.withColumn("reason", F.when(F.col("qualified"), "ELIGIBLE").otherwise("BELOW_MINIMUM"))


def provider_gate(devices: DataFrame) -> DataFrame:
    """(csp, down, up, unknown, eligible, down_share, matched, confidence): whether a whole provider is down.

    The share is rounded to four decimals before it is compared; the confidence, 0.8 or null, follows the share itself.
    """
    x = rules.shares(devices, ["csp"]).withColumn("matched", F.col("down_share") >= DOWN_TENTHS / 10)
    return x.withColumn("confidence", F.when(F.col("down") * 10 >= F.col("eligible") * DOWN_TENTHS, 0.8))


def local_decisions(table: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, cause, confidence, rule) of groups (keys, target) from their table of `providers`.

    Only qualified providers count, the target included; a group without any, or without a target, can match less.
    """
    q = table.where("qualified").join(targets, keys)
    own = F.coalesce(F.col("csp") == F.col("target"), F.lit(False))
    s = F.col("down_share")
    g = q.groupBy(*keys).agg(F.max(F.when(own, s)).alias("t"), F.count_if(~own).alias("peers"), F.max(F.when(~own, s)).alias("top"), F.min(s).alias("low"), F.count("*").alias("n"))
    x = targets.join(g, keys, "left").fillna(0, ["peers", "n"])
    e = F.expr
    chain = [
        ("RULE_2A_LOCAL_CSP_PEERS", e("t >= 0.8 AND peers > 0 AND top <= 0.2")),
        ("RULE_2B_LOCAL_CSP_MONOPOLY", e("peers = 0 AND t >= 0.9")),
        ("RULE_3A_POWER_MULTI_CSP", e("n >= 2 AND low >= 0.7")),
        ("RULE_3B_POWER_MONOPOLY", e("peers = 0 AND t >= 0.7")),
    ]
    x = x.withColumn("rule", rules.decide(chain, "RULE_4_FIBRE_CHECK"))
    rule = F.col("rule")
    cause = F.when(rule.startswith("RULE_2"), "CSP_SPECIFIC_LOCAL").when(rule.startswith("RULE_3"), "PREMISE_POWER").otherwise("UNKNOWN")
    fixed = {"RULE_2A_LOCAL_CSP_PEERS": 0.8, "RULE_2B_LOCAL_CSP_MONOPOLY": 0.6, "RULE_3B_POWER_MONOPOLY": 0.6}
    confidence = F.when(rule == "RULE_3A_POWER_MULTI_CSP", F.round(F.least(F.lit(0.9), F.col("low")), 2))
    for name, value in fixed.items():
        confidence = confidence.when(rule == name, value)
    return x.select(*keys, "target", cause.alias("cause"), confidence.otherwise(0.0).alias("confidence"), "rule")


def rolled_up(outages: DataFrame, groups: DataFrame) -> DataFrame:
    """(outage, cause, confidence, rule): what an outage's groups agree on.

    outages (outage, known: members in the inventory, located_down: members that are down at a known place and time, matched
    and gate_confidence: the gate of its single provider, null if it has several). groups (outage, index, supported, cause,
    confidence, rule). A group counts if it is supported or its cause is FIBRE_CUT.
    """
    counts = F.coalesce(F.col("supported"), F.lit(False)) | (F.col("cause") == "FIBRE_CUT")
    first = F.min(F.when(counts, F.struct("index", "rule"))).alias("first")
    g = groups.groupBy("outage").agg(
        F.count_distinct(F.when(counts, F.col("cause"))).alias("causes"), F.min(F.when(counts, F.col("cause"))).alias("one"), F.min(F.when(counts, F.col("confidence"))).alias("least"), first,
        F.count_if(F.col("supported")).alias("n_supported"), F.min(F.when(F.col("supported"), F.struct("index", "rule"))).alias("sure"),
    )
    x = outages.join(g, "outage", "left").fillna(0, ["causes", "n_supported"])
    gate = F.coalesce(F.col("matched"), F.lit(False))
    agreed = (F.col("causes") == 1) & (F.col("one") != "UNKNOWN")
    rule = F.when(F.col("known") == 0, "CUSTOMER_V2_MISSING").when(gate, "CSP_DOWN_SHARE").when(agreed, F.col("first.rule")).when(F.col("located_down") == 0, "NO_CURRENT_DOWN_MEMBERS")
    rule = rule.when(F.col("n_supported") == 0, "SUB_OUTAGE_REVIEW_ONLY").when(F.col("causes") > 1, "LOCAL_GROUPS_DISAGREE").otherwise(F.coalesce("sure.rule", F.lit("LOCAL_PATTERN_AMBIGUOUS")))
    sure = F.col("known") > 0
    cause = F.when(sure & gate, "ISP_OLT_CSP_SIDE").when(sure & agreed, F.col("one")).otherwise("UNKNOWN")
    confidence = F.when(sure & gate, F.col("gate_confidence")).when(sure & agreed, F.col("least")).otherwise(0.0)
    return x.select("outage", cause.alias("cause"), confidence.alias("confidence"), rule.alias("rule"))
