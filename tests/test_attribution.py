"""Attribution: a case for every branch of the rules, event groups and local decisions against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from quietline.operators import attribution

START = dt.datetime(2026, 1, 2)
FLEET = "device string, csp string, cell string, lat double, lon double, active boolean"


class World:
    """Providers with cells of ten devices, each cell at a place of its own, and outages of some of them."""

    def __init__(self):
        self.devices, self.members, self.outages, self.at, self.hour = {}, [], {}, 0, 0

    def cell(self, csp, cell, n=10, near=None, located=True, active=True):
        self.at += 1
        lat, lon = near or (20 + self.at * 0.1, 75.0)
        for i in range(n):
            place = (lat + 0.01 * (i % 3 == 1), lon + 0.01 * (i % 3 == 2)) if located else (None, None)
            self.devices[f"{csp}.{cell}.{i}"] = (csp, None if cell.startswith("-") else cell, *place, active)
        return lat, lon

    def fail(self, outage, csp, minute=0, **cells):
        self.outages[outage] = (csp, START + dt.timedelta(hours=self.hour, minutes=minute))
        self.members += [(outage, f"{csp}.{c.replace('none', '-')}.{i}") for c, n in cells.items() for i in range(n)]

    def rows(self, spark):
        fleet = spark.createDataFrame([(d, *v) for d, v in self.devices.items()], FLEET)
        outages = spark.createDataFrame([(o, *v) for o, v in self.outages.items()], "outage string, csp string, trigger timestamp_ntz")
        got = attribution.attributed(fleet, outages, spark.createDataFrame(self.members, "outage string, device string")).collect()
        return {r.outage: r for r in got}


@pytest.fixture(scope="module")
def ruled(spark):
    w = World()
    for csp, cells in {
        "ALPHA": "a1 a2", "BETA": "a1 a2", "GAMMA": "r1 r2", "DELTA": "r1 r2", "ECHO": "e1 e2", "FOX": "e1 e2", "GOLF": "g1 g2", "HOTEL": "g1 g2", "INDIA": "i1", "IRIS": "i1 i2",
        "JULIET": "j1 j2", "KILO": "k1 k2", "MIKE": "m1 m2", "NOVA": "n1 n2", "OSCAR": "o1 o2", "PAPA": "p1 p2", "QUEBEC": "q1 q2", "ROMEO": "q1 q2", "SIERRA": "s1",
    }.items():
        for c in cells.split():
            place = w.cell(csp, c)
            if (csp, c) == ("KILO", "k1"):
                w.cell("LIMA", "k1", n=1, near=place)
    w.cell("TANGO", "-", n=3)
    w.cell("TANGO", "t1", n=10)
    w.cell("UNIT", "u1", n=3, active=False)
    w.cell("UNIT", "u2")
    for hour, outages in enumerate(
        [
            [("area A", "ALPHA", {"a1": 8}), ("area B", "BETA", {"a1": 8})],
            [("both G", "GAMMA", {"r1": 7, "r2": 7}), ("both D", "DELTA", {"r1": 7, "r2": 7})],
            [("share", "ECHO", {"e1": 8, "e2": 8})],
            [("share+", "ECHO", {"e1": 9, "e2": 8})],
            [("wide", "QUEBEC", {"q1": 7, "q2": 7})],
            [("wide+", "QUEBEC", {"q1": 8, "q2": 7})],
            [("near", "GOLF", {"g1": 7})],
            [("near+", "GOLF", {"g1": 8})],
            [("noise", "JULIET", {"j1": 6})],
            [("two", "MIKE", {"m1": 2})],
            [("peer", "KILO", {"k1": 3})],
            [("alone", "NOVA", {"n1": 7})],
            [("single", "INDIA", {"i1": 7}), ("single I", "IRIS", {"i1": 7})],
            [("one cell", "SIERRA", {"s1": 7})],
            [("no cell", "TANGO", {"none": 3})],
            [("inactive", "UNIT", {"u1": 3})],
        ]
    ):
        w.hour = hour
        for k, (name, csp, cells) in enumerate(outages):
            w.fail(name, csp, minute=10 * k, **cells)
    return w.rows(spark)


@pytest.mark.parametrize(
    ("outage", "rule", "cause", "extent", "confidence"),
    [
        ("two", "R0_GEOMETRY_QUALITY_FAILURE", "UNKNOWN", "LOCAL", "LOW"),
        ("share", "R0_CSP_DOWN_SHARE", "CSP_SIDE", "REGIONAL", "MEDIUM"),
        ("share+", "R0_CSP_DOWN_SHARE", "CSP_SIDE", "REGIONAL", "HIGH"),
        ("peer", "R0_POLYGON_PEER_UP", "CSP_SIDE", "LOCAL", "MEDIUM"),
        ("no cell", "R0_NO_LOCATED_H3", "UNKNOWN", "LOCAL", "LOW"),
        ("noise", "R1_NO_DOWN_CSP_H3", "UNKNOWN", "LOCAL", "LOW"),
        ("area A", "R2_MULTI_CSP_ONE_H3", "UNKNOWN", "LOCAL", "LOW"),
        ("area B", "R2_MULTI_CSP_ONE_H3", "UNKNOWN", "LOCAL", "LOW"),
        ("both G", "R3_MULTI_CSP_MULTI_H3", "UNKNOWN", "REGIONAL", "LOW"),
        ("both D", "R3_MULTI_CSP_MULTI_H3", "UNKNOWN", "REGIONAL", "LOW"),
        ("wide", "R4_CSP_WIDE", "CSP_SIDE", "REGIONAL", "MEDIUM"),
        ("wide+", "R4_CSP_WIDE", "CSP_SIDE", "REGIONAL", "MEDIUM"),
        ("near", "R5_NEIGHBOR_CSP_UP", "CSP_SIDE", "LOCAL", "MEDIUM"),
        ("near+", "R5_NEIGHBOR_CSP_UP", "CSP_SIDE", "LOCAL", "HIGH"),
        ("alone", "R6_NO_NEIGHBOR_CSP", "UNKNOWN", "LOCAL", "LOW"),
        ("single", "R6_NO_CROSS_H3_COMPARISON", "UNKNOWN", "LOCAL", "LOW"),
        ("single I", "R6_NO_CROSS_H3_COMPARISON", "UNKNOWN", "LOCAL", "LOW"),
        ("one cell", "R6_NO_CROSS_H3_COMPARISON", "UNKNOWN", "LOCAL", "LOW"),
        ("inactive", "R6_NO_CROSS_H3_COMPARISON", "UNKNOWN", "LOCAL", "LOW"),
    ],
)
def test_branches(ruled, outage, rule, cause, extent, confidence):
    r = ruled[outage]
    assert (r.rule, r.cause, r.extent, r.confidence) == (rule, cause, extent, confidence)


def test_evidence(ruled):
    assert ruled["area A"].event == ruled["area B"].event == "AE000001" and ruled["inactive"].event == "AE000016"
    r = ruled["wide+"]
    assert (r.target_cell, r.failed, r.eligible, r.affected_cells, r.eligible_cells, r.compared, r.down_csp, r.eligible_csp) == ("q1", 8, 10, 2, 2, 2, 15, 20)
    assert ruled["share"].target_cell is None and ruled["two"].eligible == 0


@pytest.mark.parametrize("seed", range(3))
def test_event_groups(spark, seed):
    r = random.Random(seed)
    window = 1800
    rows = [(f"o{i:03}", "c", START + dt.timedelta(seconds=int(r.choice([60, 3600, 90_000]) * r.random() * 40))) for i in range(150)]
    want, anchor, n = {}, None, 0
    for o, _, t in sorted(rows, key=lambda x: (x[2], x[0])):
        if anchor is None or (t - anchor).total_seconds() > window:
            anchor, n = t, n + 1
        want[o] = f"AE{n:06d}"
    df = spark.createDataFrame(rows, "outage string, csp string, trigger timestamp_ntz").repartition(5)
    assert {x.outage: x.event for x in attribution.event_groups(df, window).collect()} == want


def decide(target, table):
    """The local rules, read one by one. table: csp to (down, up, unknown)."""
    share = {c: round(d / (d + u + k), 4) for c, (d, u, k) in table.items() if d + u + k >= 5}
    peers = [s for c, s in share.items() if c != target]
    own = share.get(target)
    if own is not None and own >= 0.8 and peers and all(s <= 0.2 for s in peers):
        return "CSP_SPECIFIC_LOCAL", 0.8, "RULE_2A_LOCAL_CSP_PEERS"
    if own is not None and not peers and own >= 0.9:
        return "CSP_SPECIFIC_LOCAL", 0.6, "RULE_2B_LOCAL_CSP_MONOPOLY"
    if len(share) >= 2 and all(s >= 0.7 for s in share.values()):
        return "PREMISE_POWER", round(min(0.9, *share.values()), 2), "RULE_3A_POWER_MULTI_CSP"
    if own is not None and not peers and own >= 0.7:
        return "PREMISE_POWER", 0.6, "RULE_3B_POWER_MONOPOLY"
    return "UNKNOWN", 0.0, "RULE_4_FIBRE_CHECK"


def test_local_decisions(spark):
    r = random.Random(3)
    groups = {}
    for g in range(300):
        n = lambda: r.choice([4, 5, 10])
        table = {}
        for c in "abc"[: r.randrange(1, 4)]:
            size, bias = n(), r.choice([0, 0.2, 0.7, 0.8, 0.9, 1])
            down = round(size * bias)
            unknown = r.randrange(size - down + 1)
            table[c] = (down, size - down - unknown, unknown)
        groups[g] = (r.choice(["a", "a", "a", "z", None]), table)
    rows = [(g, c, s) for g, (_, t) in groups.items() for c, counts in t.items() for s, k in zip(("DOWN", "UP", "UNKNOWN"), counts, strict=True) for _ in range(k)]
    devices = spark.createDataFrame(rows, "g int, csp string, state string")
    targets = spark.createDataFrame([(g, t) for g, (t, _) in groups.items()], "g int, target string")
    got = {x.g: (x.cause, x.confidence, x.rule) for x in attribution.local_decisions(attribution.providers(devices, ["g"]), targets, ["g"]).collect()}
    want = {g: decide(*v) for g, v in groups.items()}
    assert got == want and len({w[2] for w in want.values()}) == 5


def test_rolled_up(spark):
    outages = [("gate", 5, 5, True, 0.8), ("gone", 0, 0, None, None), ("agree", 5, 5, False, None), ("fibre", 5, 5, None, None), ("up", 5, 0, False, None), ("review", 5, 3, False, None), ("differ", 5, 5, False, None), ("open", 5, 5, False, None)]
    groups = defaultdict(list)
    groups["gate"] = [(1, True, "PREMISE_POWER", 0.9, "RULE_3A")]
    groups["agree"] = [(1, True, "PREMISE_POWER", 0.9, "RULE_3A"), (2, True, "PREMISE_POWER", 0.6, "RULE_3B"), (3, False, "UNKNOWN", 0.0, "SPATIAL_REVIEW")]
    groups["fibre"] = [(1, False, "FIBRE_CUT", 0.75, "RULE_4A"), (2, False, "UNKNOWN", 0.0, "SPATIAL_REVIEW")]
    groups["review"] = [(1, False, "UNKNOWN", 0.0, "SPATIAL_REVIEW")]
    groups["differ"] = [(1, True, "PREMISE_POWER", 0.9, "RULE_3A"), (2, True, "UNKNOWN", 0.0, "RULE_5")]
    groups["open"] = [(2, True, "UNKNOWN", 0.0, "RULE_5B"), (1, True, "UNKNOWN", 0.0, "RULE_5A")]
    o = spark.createDataFrame(outages, "outage string, known long, located_down long, matched boolean, gate_confidence double")
    g = spark.createDataFrame([(k, *x) for k, v in groups.items() for x in v], "outage string, index int, supported boolean, cause string, confidence double, rule string")
    got = {x.outage: (x.cause, x.confidence, x.rule) for x in attribution.rolled_up(o, g).collect()}
    assert got == {
        "gate": ("ISP_OLT_CSP_SIDE", 0.8, "CSP_DOWN_SHARE"), "gone": ("UNKNOWN", 0.0, "CUSTOMER_V2_MISSING"), "agree": ("PREMISE_POWER", 0.6, "RULE_3A"), "fibre": ("FIBRE_CUT", 0.75, "RULE_4A"),
        "up": ("UNKNOWN", 0.0, "NO_CURRENT_DOWN_MEMBERS"), "review": ("UNKNOWN", 0.0, "SUB_OUTAGE_REVIEW_ONLY"), "differ": ("UNKNOWN", 0.0, "LOCAL_GROUPS_DISAGREE"), "open": ("UNKNOWN", 0.0, "RULE_5A"),
    }
