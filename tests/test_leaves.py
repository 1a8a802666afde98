"""Leaves and wildcard paths of JSON against a walk in Python."""

import json
import random

import pytest

from quietline.operators import leaves


def made(r, depth):
    if depth and r.random() < 0.7:
        n = r.randrange(4)
        if r.random() < 0.5:
            return [made(r, depth - 1) for _ in range(n)]
        return {r.choice(["a", "b", "c d", "é", "x1"]): made(r, depth - 1) for _ in range(n)}
    return r.choice([None, True, 7, "text", 'q"uote', ""])


def said(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def walk(v, path="$"):
    if isinstance(v, dict):
        for k, x in v.items():
            bare = k.replace("1", "").isascii() and k.isalnum()
            yield from walk(x, path + (f".{k}" if bare else f'."{k}"'))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    else:
        yield path, said(v)


def test_leaves(spark):
    r = random.Random(4)
    docs = [(k, made(r, 5)) for k in range(200)]
    rows = [(k, json.dumps(v)) for k, v in docs] + [(900, None), (901, ""), (902, "{no json"), (903, "{}"), (904, "[]"), (905, '[[[[[[[["deep"]]]]]]]]')]
    got = leaves.leaves(spark.createDataFrame(rows, "k int, j string"), ["k"], "j").collect()
    want = [(k, *x) for k, v in docs for x in walk(v)] + [(905, "$" + "[0]" * 8, "deep")]
    assert sorted(((x.k, x.path, x.value) for x in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.a[*].b", {("$.a[0].b", "1"), ("$.a[2].b", None)}),
        ("$.*[1]", {("$.a[1]", "5")}),
        ("$.c.*", {('$.c."x y"', "in"), ("$.c.z", '{"b":2}')}),
        ('$.c["x y"]', {('$.c."x y"', "in")}),
        ("$.*.*.b", {("$.c.z.b", "2")}),
        ("$.gone[*]", set()),
        ("$", {("$", '{"a":[{"b":1},5,{"b":null}],"c":{"x y":"in","z":{"b":2}}}')}),
    ],
)
def test_paths(spark, path, want):
    doc = '{"a": [{"b": 1}, 5, {"b": null}], "c": {"x y": "in", "z": {"b": 2}}}'
    df = spark.createDataFrame([(1, doc), (2, None), (3, "no")], "k int, j string")
    got = leaves.at_path(df, ["k"], "j", path).collect()
    assert {(x.path, x.value) for x in got} == want and {x.k for x in got} <= {1}


def test_no_path(spark):
    with pytest.raises(ValueError, match="not a path"):
        leaves.at_path(spark.range(1), ["id"], "id", "$.a[")
