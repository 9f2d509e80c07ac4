"""Queries run on all rows of their tables; what is expected is written here, without the registry's SQL."""

import calendar
import collections
import datetime
import re

import duckdb
import numpy as np
import pytest

from chronogrid import queries as Q
from chronogrid.kernels import changes as C


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_index_of_every_line_item(spark, duck, sf_dir):
    found = sorted((r["px"], r["ts"].isoformat()[:10], r["value"]) for r in Q.queries()["index_ndvi"](spark, sf_dir).collect())
    rows = duck.execute("SELECT l_orderkey * 10 + l_linenumber AS px, strftime(l_shipdate, '%Y-%m-%d') AS ts, (l_discount + 0.3 - l_tax - 0.05) / (l_discount + 0.3 + l_tax + 0.05) AS value FROM lineitem ORDER BY ALL").fetchall()
    assert len(found) == len(rows)
    for (px, ts, value), (own_px, own_ts, own) in zip(found, rows, strict=True):
        assert (px, ts) == (own_px, own_ts) and abs(value - own) < 2e-5
    every = [name for name in Q.queries() if name.startswith("index_")]
    assert every
    for name in every:
        assert Q.queries()[name](spark, sf_dir).count() == len(rows), name


def test_fractions_of_every_key(spark, duck, sf_dir):
    dates = "SELECT l_suppkey, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING bool_and(isfinite(l_quantity) AND isfinite(l_discount) AND isfinite(l_tax))"
    n, keys = duck.execute(f"SELECT count(*), count(DISTINCT l_suppkey) FROM ({dates})").fetchone()
    for name in ("unmix", "ndfi"):
        rows = Q.queries()[name](spark, sf_dir).collect()
        assert len(rows) == n and len({r["px"] for r in rows}) == keys, name
        assert all(min(r["f_low"], r["f_high"], r["f_sale"]) >= 0 for r in rows)


@pytest.mark.parametrize("sum_to_one", [True, False])
@pytest.mark.parametrize("n", [1, 3, 7])
def test_batched_fractions_equal_active_sets(n, sum_to_one):
    rng = np.random.default_rng(n)
    members = {f"m{k}": rng.uniform(0, 50, 4).tolist() for k in range(n)}
    e = np.array(list(members.values())).T
    y = rng.uniform(-10, 60, (200, 4))
    weight = 1e3 * max(1.0, np.abs(e).max())
    a = np.vstack([e, np.full(n, weight)]) if sum_to_one else e
    f, rmse = C.unmixed(members, sum_to_one)(y)
    for row, own, error in zip(y, f, rmse, strict=True):
        target = np.append(row, weight) if sum_to_one else row
        x = C.nonnegative(a, target)
        assert np.linalg.norm(a @ own - target) <= np.linalg.norm(a @ x - target) + 1e-6
        assert np.isclose(error, np.sqrt(np.mean((row - e @ own) ** 2)))
        if n <= 4:
            assert np.allclose(own, x, atol=1e-5)


def test_natural_order_of_every_name(spark, duck, sf_dir):
    found = {r["id"]: r["k"] for r in Q.queries()["natural_order"](spark, sf_dir).collect()}
    rows = duck.execute("SELECT o_orderkey, o_orderdate FROM orders").fetchall()
    assert set(found) == {i for i, _ in rows}
    for i, t in rows:
        name = (f"scene_{t:%Y%m%d}_B{i % 13}.tif", f"p{t:%Y-%m-%d}", f"MOD13.A{t:%Y%j}.hdf", f"map_{t:%Y}")[i % 4].lower()
        assert found[i] == "".join(x.lstrip("0").rjust(20, "0") if x.isdigit() else x for x in re.findall(r"\d+|\D+", name)), name


@pytest.mark.parametrize("unit", ["month", "year"])
def test_matches_of_every_key(spark, duck, sf_dir, unit):
    found = Q.queries()[f"match_same_{unit}"](spark, sf_dir).collect()
    rows = duck.execute("SELECT o_custkey, o_orderdate::TIMESTAMP, max(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) FROM orders GROUP BY 1, 2").fetchall()
    right = collections.defaultdict(list)
    period = lambda t: (t.year, t.month if unit == "month" else 0)
    for px, t, value in rows:
        right[px - 1, period(t)].append((t, value))
    own = {(r["px"], r["ts"].replace(tzinfo=None)): r["other"] for r in found}
    assert len(found) == len(rows) == len(own)
    for px, t, _ in rows:
        there = right[px, period(t)]
        value = min(there, key=lambda x: (abs(x[0] - t), x[0]))[1] if there else None
        other = own[px, t]
        assert other is None and value is None or abs(other - value) < 1e-3


def test_every_day_of_the_360_day_calendar(spark, duck, sf_dir):
    found = {r["o_orderkey"]: r["ts"] for r in Q.queries()["cf_time_360"](spark, sf_dir).collect()}
    keys = [k for (k,) in duck.execute("SELECT o_orderkey FROM orders").fetchall()]
    assert set(found) == set(keys) and any(k % 360 in (58, 59) for k in keys)
    for k in keys:
        year, month, day = 2000 + k // 360, k % 360 // 30 + 1, k % 30 + 1
        last = calendar.monthrange(year, month)[1]
        assert found[k].replace(tzinfo=None) == datetime.datetime(year, month, min(day, last))
    assert found[58].day == found[59].day == 29 and found[418].day == 28
