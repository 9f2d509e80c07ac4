"""The language's grammar, errors, and no-data rules on hand-made cubes."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronogrid.lang import Cube, CubeError, evaluate, parse
from chronogrid.lang.parser import render

DAY = datetime.datetime(2020, 1, 1)


def cube(spark, values, step=10, **more):
    rows = [(1, DAY + datetime.timedelta(days=step * i), v, *(m[i] for m in more.values())) for i, v in enumerate(values)]
    return Cube(spark.createDataFrame(rows, "px long, ts timestamp, s double" + "".join(f", {k} double" for k in more)))


def series(spark, values, program, **more):
    return [r["value"] for r in evaluate(cube(spark, values, **more), program).orderBy("ts").collect()]


def image(spark, values, program, **more):
    return evaluate(cube(spark, values, **more), program).first()["value"]


@pytest.mark.parametrize(
    "text, tree",
    [
        ("1 + 2 * 3", "(1 + (2 * 3))"),
        ("-2 ^ 2", "(-(2 ^ 2))"),
        ("2 ^ 3 ^ 2", "(2 ^ (3 ^ 2))"),
        ("not a and b or c", "(((not a) and b) or c)"),
        ("a < b and c >= 1", "((a < b) and (c >= 1))"),
        ("mean(s[2019-06 .. 2019-09]) by year", "mean(s[2019-06 .. 2019-09]) by year"),
        ("s[-2]", "s[(-2)]"),
        ('"my layer".red', '"my layer".red'),
        ("lag(s, 3m) # back", "lag(s, 3m)"),
        ("anomaly(s, base=2001 .. 2003, by=month)", "anomaly(s, base=2001 .. 2003, by=month)"),
        ("f(1,\n 2)", "f(1, 2)"),
        ("a = 1\nb = a; b", "a = 1; b = a; b"),
    ],
)
def test_grammar(text, tree):
    assert render(parse(text)) == tree
    assert render(parse(tree)) == tree


@given(st.text(alphabet="ab1.+-*/^()[]<>=!, \n\"$#;dwy", max_size=30))
@settings(max_examples=400, deadline=None)
def test_any_text_parses_or_says_why(text):
    try:
        assert parse(render(parse(text)))
    except CubeError as e:
        assert str(e)


@pytest.mark.parametrize(
    "program, said",
    [
        ("mean(t0)", "no band 't0'"),
        ("men(s)", "did you mean 'mean'"),
        ("sqrt(s, 2)", "sqrt takes 1 arguments, not 2"),
        ("s - max(s) by year", "can't be combined"),
        ("s +", "unexpected 'end' (line 1, column 4)"),
        ("s[3 + 1]", "square brackets"),
        ("percentile(s, 200)", "0 to 100"),
        ('qa(s, s, "nope")', "no quality rule"),
        ("", "empty"),
        ("$3", "no input"),
        ("lag(s, month)", "lag takes"),
    ],
)
def test_errors_say_where(spark, program, said):
    with pytest.raises(CubeError, match="(?s).*" + said.replace("(", r"\(").replace(")", r"\)")):
        evaluate(cube(spark, [1.0]), program)


def test_no_data_rules(spark):
    x = [1.0, None, 3.0]
    assert series(spark, x, "where(s > 2, 10, 20)") == [20.0, None, 10.0]
    assert series(spark, x, "s > 2 = 10") == [1.0, None, 10.0]
    assert series(spark, x, "max(s, 2)") == [2.0, None, 3.0]
    assert series(spark, x, "s / (s - 1)") == [None, None, 1.5]
    assert series(spark, x, "(s > 2) and (1 == 2)") == [0.0, 0.0, 0.0]
    assert series(spark, x, "(s > 2) or (1 == 1)") == [1.0, 1.0, 1.0]
    assert series(spark, x, "s == nan") == [0.0, 1.0, 0.0]
    assert series(spark, [7.0, -7.0], "s % (0 - 3)") == [-2.0, -1.0]
    assert series(spark, [0.5, 1.5, 2.5], "round(s)") == [0.0, 2.0, 2.0]


def test_reductions_skip_no_data(spark):
    x = [None, 4.0, 1.0, None, 4.0]
    assert image(spark, x, "mean(s)") == 3.0
    assert image(spark, x, "count(s > 2)") == 2.0
    assert image(spark, [None, None], "count(s > 2)") == 0.0
    assert image(spark, [None, None], "sum(s)") is None
    assert image(spark, [5.0], "std(s)") == 0.0
    assert image(spark, x, "argmax(s)") == pytest.approx(2020 + 10 / 366)  # the first on ties
    assert image(spark, [1.0, 1.0], "corr(s, s)") is None
    assert image(spark, [1.0, 2.0, 3.0], "corr(s, b)", b=[2.0, 4.0, 6.0]) == pytest.approx(1.0)


def test_runs_and_lags(spark):
    x = [5.0, 5.0, None, 5.0, 0.0, 5.0]
    assert image(spark, x, "longest(s > 1)") == 40.0  # from the first date to the next valid one that isn't true
    assert image(spark, [5.0, 5.0], "longest(s > 1)") == 10.0
    assert image(spark, [0.0], "longest(s > 1)") == 0.0
    assert series(spark, x, "persist(s > 1, 2)") == [None, 1.0, 1.0, 1.0, 0.0, 0.0]
    assert series(spark, x, "s[-1]") == [None, 5.0, 5.0, 5.0, 5.0, 0.0]
    assert series(spark, [1.0, 2.0, 3.0, 4.0], "lag(s, 20d)") == [None, None, 1.0, 2.0]  # within half a step or 8 days
    assert series(spark, [1.0, 2.0, 4.0], "sum(s, 20d)") == [1.0, 3.0, 6.0]


def test_empty_cube(spark):
    empty = Cube(spark.createDataFrame([], "px long, ts timestamp, s double"))
    for program in ("s + 1", "mean(s)", "max(s) by year", "mean(s, 90d)", "lag(s, 1y)", "longest(s > 0)", "anomaly(s, by=doy, window=5d)"):
        assert evaluate(empty, program).collect() == []


def test_plan_reads_only_what_is_needed(spark, sf_dir):
    from chronogrid.plans import bindings

    plan = evaluate(bindings.items(spark, sf_dir), "mean(quantity[1996 .. 1997]) by month")._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "l_tax" not in physical and "l_comment" not in physical
    assert "Python" not in physical


def test_count_without_a_valid_date_is_no_data(spark):
    rows = spark.createDataFrame([(1, "2020-01-01", None), (1, "2020-02-01", None), (2, "2020-01-01", 3.0), (2, "2020-02-01", None), (3, "2020-01-01", 7.0)], "px long, ts string, s double")
    cube = Cube(rows.withColumn("ts", F.to_timestamp("ts")))
    assert {r["px"]: r["value"] for r in evaluate(cube, "count(s > 5)").collect()} == {1: None, 2: 0.0, 3: 1.0}
    assert {r["px"]: r["value"] for r in evaluate(cube, "count(s > 5) by year").collect()} == {1: None, 2: 0.0, 3: 1.0}
