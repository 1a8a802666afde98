"""Fibre evidence: each rule where it holds, and none where it just doesn't."""

from quietline.operators import fibre

METRE = 1 / 111_195


def device(outage, k, north, east, state, house=None, road=None, locality=None):
    return (outage, outage * 1000 + k, state, 20 + north * METRE, 77 + east * METRE / 0.9397, house, road, locality)


def rows():
    out = []
    # 1: three devices of a lane fail beside healthy ones.
    out += [device(1, k, 20 * k, 0, "DOWN", None, "r1", "l1") for k in range(3)] + [device(1, 10 + k, 20 * k, 30, "UP") for k in range(3)]
    # 2: a house of two, which goes before the lane of three.
    out += [device(2, k, 10 * k, 0, "DOWN", "h1" if k < 2 else None, "r1", "l1") for k in range(3)] + [device(2, 10, 0, 30, "UP")]
    # 3: a locality without roads within 500 m, and controls that are up, but far from it.
    out += [device(3, k, 60 * k, 0, "DOWN", None, None, "l3") for k in range(4)] + [device(3, 10 + k, 50_000 + k, 0, "UP") for k in range(6)]
    # 4: the same with too few controls.
    out += [device(4, k, 60 * k, 0, "DOWN", None, None, "l3") for k in range(4)] + [device(4, 10 + k, 50_000 + k, 0, "UP") for k in range(4)]
    # 5: a line of failures without addresses.
    out += [device(5, k, 40 * k, (k % 2) * 5, "DOWN") for k in range(8)] + [device(5, 20 + k, 9_000, 40 * k, "UP") for k in range(6)]
    # 6: a heap instead of a line.
    out += [device(6, 3 * i + j, 30 * i, 30 * j, "DOWN") for i in range(3) for j in range(3)] + [device(6, 20 + k, 9_000, 40 * k, "UP") for k in range(6)]
    # 7: of unknown state, or without a place.
    out += [device(7, 1, 0, 0, "DOWN"), device(7, 2, 5, 0, "UNKNOWN", "h", "r", "l"), (7, 7003, "DOWN", None, None, "h", "r", "l")]
    return out


def test_rules(spark):
    df = spark.createDataFrame(rows(), "outage long, device long, state string, lat double, lon double, house string, road string, locality string").repartition(3)
    got = {r.outage: r for r in fibre.evidence(df).collect()}
    assert {k: (r.path, r.scope, r.affected, r.confidence) for k, r in got.items()} == {
        1: ("RULE_4A", "GALI", 3, 0.9), 2: ("RULE_4A", "HOUSE", 2, 0.9), 3: ("RULE_4B", "LOCALITY", 4, 0.6), 4: ("NONE", "UNKNOWN", 0, 0.0),
        5: ("RULE_4C", "DIRECTIONAL", 8, 0.6), 6: ("NONE", "UNKNOWN", 0, 0.0), 7: ("NONE", "UNKNOWN", 0, 0.0),
    }
    assert (got[1].controls, got[1].control_up_share) == (3, 1.0) and got[7].controls == 0 and got[3].r90_m <= 500
