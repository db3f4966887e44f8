"""As-of joins against a plain walk; JSON rows against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.operators.asof import as_of
from parsefold.sources.json_rows import NO_ROW, NOT_JSON, NOT_OBJECT, checked_json


def walk(left, right, strict):
    out = []
    for k, t, x in left:
        before = [(u, a, b) for j, u, a, b in right if k is not None and t is not None and j == k and u is not None and (u < t or (u == t and not strict))]
        key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)  # noqa: E731  nulls first
        out.append((k, t, x, *(max(before, key=key) if before else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_rows", [1 << 18, 40])
def test_every_row_finds_the_last_before_it(spark, strict, slice_rows):
    draw = random.Random(3)
    # One key has most rows: it is cut into slices, some of which hold no right row.
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", None, "only left" if draw.random() < 0.1 else "c"])
    left = [(key(), draw.choice([None, *range(60)]), i) for i in range(400)]
    right = [(key(), draw.choice([None, *range(0, 12), *range(40, 50)]), draw.choice([None, 1, 2]), f"r{draw.randrange(9)}") for _ in range(150)]
    left += left[:5]
    found = as_of(spark.createDataFrame(left, "k string, t int, x int").repartition(5), spark.createDataFrame(right, "k string, t int, a int, b string").repartition(3), "k", "t", strict=strict, slice_rows=slice_rows)
    assert found.columns == ["k", "t", "x", "last_t", "last_a", "last_b"]
    assert sorted(map(tuple, found.collect()), key=repr) == walk(left, right, strict)


def test_no_rows_and_clashing_names(spark):
    one = spark.createDataFrame([("a", 1, 2)], "k string, t int, last_t int")
    with pytest.raises(ValueError, match="last_t"):
        as_of(one, one, "k", "t")
    got = as_of(one, one.limit(0), "k", "t", prefix="r_").collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, None, None)] and as_of(one.limit(0), one, "k", "t", prefix="r_").count() == 0


SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType(), False),
        T.StructField("s", T.StringType()),
        T.StructField("o", T.StructType([T.StructField("deep", T.StructType([T.StructField("x", T.DoubleType(), False)]), False), T.StructField("flag", T.BooleanType())])),
        T.StructField("l", T.ArrayType(T.LongType())),
    ]
)
CASES = {
    '{"n": 1, "s": "é\\n", "o": {"deep": {"x": 2}, "flag": true}, "l": [1, 2]}': (None, [], 1, "é\n", 2.0, True, [1, 2]),
    '{"n": 1}': (None, [], 1, None, None, None, None),
    '{"n": null}': ("n: missing", [], None, None, None, None, None),
    '{"n": "1", "s": 1}': ("n: not bigint; s: not string", [], None, None, None, None, None),
    '{"n": 1, "o": {}}': ("o.deep: missing", [], 1, None, None, None, None),
    '{"n": 1, "o": {"deep": {}}}': ("o.deep.x: missing", [], 1, None, None, None, None),
    '{"n": 1, "o": {"deep": 3, "flag": "no"}}': ("o.deep: not an object; o.flag: not boolean", [], 1, None, None, None, None),
    '{"n": 1, "o": [1]}': ("o: not an object", [], 1, None, None, None, None),
    '{"n": 1, "l": [1, "x"]}': ("l: not array<bigint>", [], 1, None, None, None, None),
    '{"n": 1, "z": 1, "a": {"b": 1}, "o": {"deep": {"x": 1, "y": 1}, "w": []}}': (None, ["a", "o.deep.y", "o.w", "z"], 1, None, 1.0, None, None),
    '{"n": 99999999999999999999}': ("n: not bigint", [], None, None, None, None, None),
    "[1]": (NOT_OBJECT, [], None, None, None, None, None),
    '"x"': (NOT_OBJECT, [], None, None, None, None, None),
    "null": (NOT_OBJECT, [], None, None, None, None, None),
    '{"n": 1': (NOT_JSON, [], None, None, None, None, None),
    "": (NOT_JSON, [], None, None, None, None, None),
    None: (NO_ROW, [], None, None, None, None, None),
}


def test_every_row_has_a_value_or_an_error(spark):
    rows = spark.createDataFrame([(i, text, "kept") for i, text in enumerate([*CASES, None])], "i int, json string, __variant string")
    got = checked_json(rows, "json", SCHEMA).orderBy("i").collect()
    assert len(got) == len(CASES) + 1 and all(r["__variant"] == "kept" for r in got)
    for r, want in zip(got, CASES.values()):
        assert (r.json_error, r.json_unknown, r.n, r.s, r.o_deep_x, r.o_flag, r.l) == want, r.json


def test_names_are_replaced_and_no_rows_give_none(spark):
    rows = spark.createDataFrame([('{"n": 2}', "old")], "json string, n string")
    assert checked_json(rows, "json", SCHEMA, separator=".").select("n", "`o.deep.x`").first() == (2, None)
    assert checked_json(rows.limit(0), "json", SCHEMA).count() == 0


def test_values_equal_those_of_another_reader(spark):
    draw = random.Random(1)
    made = [{"n": draw.randrange(-(1 << 62), 1 << 62), "s": "".join(draw.choices('é"\\\n\t\u2028😀 a', k=9)), "o": {"deep": {"x": draw.random() * 10 ** draw.randrange(-9, 9)}}} for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(m, ensure_ascii=bool(i % 2))) for i, m in enumerate(made)], "i int, json string")
    for r, m in zip(checked_json(rows, "json", SCHEMA).orderBy("i").collect(), made):
        assert (r.json_error, r.n, r.s) == (None, m["n"], m["s"]) and r.o_deep_x == pytest.approx(m["o"]["deep"]["x"], rel=1e-15)
