"""Several tables published as one version, whatever fails between; Shapiro and Wilk's test against published values."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quietline.operators import contrasts
from quietline.sources import feeds


class Fault(Exception):
    pass


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_fault_between_writes(spark, tmp_path, after):
    """A run that breaks after any of its writes hides nothing and shows nothing; the next attempt publishes all four."""
    root = str(tmp_path)
    names = ["attributions", "cell_states", "events", "evidence"]
    make = lambda v: {n: spark.createDataFrame([(v, n)], "v int, name string") for n in names}
    feeds.publish(make(1), root, 1)

    class Broken(dict):
        def items(self):
            for k, pair in enumerate(super().items()):
                if k == after:
                    raise Fault
                yield pair

    with pytest.raises(Fault):
        feeds.publish(Broken(make(2)), root, 2)
    now = feeds.newest_of(spark, root)
    assert sorted(now) == names and {df.first()["v"] for df in now.values()} == {1}
    feeds.publish(make(3), root, 2)  # the attempt's leftovers give way
    assert {df.first()["v"] for df in feeds.newest_of(spark, root).values()} == {3}
    with pytest.raises(ValueError, match="published"):
        feeds.publish(make(4), root, 2)
    assert {df.first()["v"] for df in feeds.newest_of(spark, root).values()} == {3}


def test_nothing_published(spark, tmp_path):
    assert feeds.newest_of(spark, str(tmp_path / "none")) == {}


def weights(n):
    """Royston's weights, from exact normal quantiles."""
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(x * x for x in m), 1 / math.sqrt(n)
    a = [x / math.sqrt(mm) for x in m]
    a[-1] += sum(c * u**k for k, c in enumerate((0.221157, -0.147981, -2.071190, 4.434685, -2.706056), 1))
    edge = 1
    if n > 5:
        a[-2] += sum(c * u**k for k, c in enumerate((0.042981, -0.293762, -1.752461, 5.682633, -3.582633), 1))
        edge = 2
    phi = (mm - 2 * sum(x * x for x in m[-edge:])) / (1 - 2 * sum(x * x for x in a[-edge:]))
    for i in range(edge, n - edge):
        a[i] = m[i] / math.sqrt(phi)
    for i in range(edge):
        a[i] = -a[-1 - i]
    return a


def test_shapiro(spark):
    r = random.Random(3)
    groups = {
        "men": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236],
        "five": [1, 2, 3, 4, 5],
        "normal": [r.gauss(0, 1) for _ in range(50)],
        "large": [r.expovariate(1) for _ in range(2000)],
        "three": [1, 2, 9],
        "same": [4, 4, 4, 4],
        "two": [1, 2],
    }
    rows = [(g, float(x), k) for g, xs in groups.items() for k, x in enumerate(xs)] + [("men", None, 99), (None, 1.0, 1)]
    got = {x.g: x for x in contrasts.shapiro(spark.createDataFrame(rows, "g string, x double, id int").repartition(5), "g", "x", "id").collect()}
    assert set(got) == {"men", "five", "normal", "large", "three"}
    for g in ("men", "five", "normal", "large"):
        xs, a = sorted(groups[g]), weights(len(groups[g]))
        mean = sum(xs) / len(xs)
        assert got[g].w == pytest.approx(sum(p * q for p, q in zip(a, xs, strict=True)) ** 2 / sum((x - mean) ** 2 for x in xs), abs=1e-7)
    assert got["men"].w == pytest.approx(0.78881, abs=1e-4) and got["men"].p == pytest.approx(0.0067, abs=1e-4)  # published
    assert got["five"].w == pytest.approx(0.98676, abs=1e-4) and got["five"].p == pytest.approx(0.9672, abs=1e-4)  # published
    assert got["normal"].p > 0.01 and got["large"].p < 1e-10 and got["large"].n == 2000


def test_quantile(spark):
    x = spark.range(1, 10_000).select((F.col("id") / 10_000).alias("p")).select("p", contrasts.normal_quantile(F.col("p")).alias("z")).collect()
    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in x) < 1e-7
