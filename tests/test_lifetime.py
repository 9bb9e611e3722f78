"""Fits of the lifetime value models: derivatives, recovery, moved starts, bounds, and SQL at the fitted point."""

import math

import duckdb
import numpy as np
import pytest

from ledgerloom.functions import kernels as K
from ledgerloom.operators import clv

SCHEMA = "CustomerID long, frequency long, recency long, T long, monetary_value double"


@pytest.fixture(scope="module")
def people():
    """Customers drawn from the models with r 0.7, alpha 60, a 0.5, b 2.5 and p 2.2, q 3.5, v 440."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        rate, leave, end, nu = rng.gamma(0.7, 1 / 60), rng.beta(0.5, 2.5), int(rng.integers(100, 700)), rng.gamma(3.5, 1 / 440)
        t, x, last = 0.0, 0, 0.0
        while (t := t + rng.exponential(1 / rate)) <= end:
            x, last = x + 1, t
            if rng.random() < leave:
                break
        rows.append((i, x, int(last), end, float(rng.gamma(2.2 * x, 1 / (nu * x))) if x else 0.0))
    return rows


@pytest.fixture(scope="module")
def summary(spark, people):
    return spark.createDataFrame(people, SCHEMA).persist()


def loss_of(rows, log_params):
    """The published likelihood, term by term."""
    r, alpha, a, b = np.exp(log_params)
    x, t_x, T = (np.array([row[k] for row in rows], float) for k in (1, 2, 3))
    head = K.gammaln(r + x) - K.gammaln(r) + r * np.log(alpha) + K.gammaln(a + b) + K.gammaln(b + x) - K.gammaln(b) - K.gammaln(a + b + x)
    gone = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + t_x), -np.inf)
    return -float((head + np.logaddexp(-(r + x) * np.log(alpha + T), gone)).sum()) / len(rows)


def value_loss(rows, log_params, scale):
    p, q, v = np.exp(log_params)
    x, m = (np.array([row[k] for row in rows if row[1] and row[4] > 0], float) for k in (1, 4))
    z = m / scale
    ll = K.gammaln(p * x + q) - K.gammaln(p * x) - K.gammaln(q) + q * np.log(v) + (p * x - 1) * np.log(z) + p * x * np.log(x) - (p * x + q) * np.log(x * z + v)
    return -float(ll.mean())


def differences(f, at, e=1e-5):
    return np.array([(f(at + e * d) - f(at - e * d)) / (2 * e) for d in np.eye(len(at))])


def test_steps_against_differences(people, summary):
    counted = summary.selectExpr("double(frequency) AS x", "double(recency) AS t_x", "double(T) AS T", "1L AS n").persist()
    tails = clv._tails([(x, n) for x, n in counted.selectExpr("int(x) AS x").groupBy("x").count().collect()])
    f = lambda z: clv.bgnbd_step(counted, tails, len(people), z)
    at = np.array([0.1, 2.0, -0.5, 0.7])
    value, g, h = f(at)
    assert math.isclose(value, loss_of(people, at), rel_tol=1e-10)
    assert np.allclose(g, differences(lambda z: loss_of(people, z), at), atol=1e-7)
    assert np.allclose(h, differences(lambda z: f(z)[1], at), atol=1e-7) and np.allclose(h, h.T)
    own = [r for r in people if r[1] and r[4] > 0]
    scale = sum(r[4] for r in own) / len(own)
    rows = summary.where("frequency > 0").selectExpr("double(frequency) AS x", f"monetary_value / {scale!r}D AS z", "1L AS n").persist()
    by_x = np.array(sorted((x, n) for x, n in rows.groupBy("x").count().collect()), float)
    log_z = sum(math.log(r[4] / scale) for r in own)
    f = lambda z: clv.gamma_gamma_step(rows, by_x, log_z, z)
    at = np.array([0.4, 0.9, -0.3])
    value, g, h = f(at)
    assert math.isclose(value, value_loss(people, at, scale), rel_tol=1e-10)
    assert np.allclose(g, differences(lambda z: value_loss(people, z, scale), at), atol=1e-7)
    assert np.allclose(h, differences(lambda z: f(z)[1], at), atol=1e-7) and np.allclose(h, h.T)


def test_fits_do_not_depend_on_the_start(people, summary):
    p, moved, far = clv.fit_bgnbd(summary), clv.fit_bgnbd(summary, (1e-9,) * 4), clv.fit_bgnbd(summary, (1.0, 2.0, -1.0, 0.5))
    for other in (moved, far):
        assert other.converged and all(math.isclose(getattr(p, k), getattr(other, k), rel_tol=1e-4) for k in ("r", "alpha", "a", "b"))
    assert p.converged and p.evaluations < 30
    assert math.isclose(-p.log_likelihood / len(people), loss_of(people, np.log([p.r, p.alpha, p.a, p.b])), rel_tol=1e-10)
    assert 0.5 < p.r < 0.9 and 45 < p.alpha < 80 and 0.3 < p.a < 0.8
    g, other = clv.fit_gamma_gamma(summary), clv.fit_gamma_gamma(summary, (1.0, 1.0, -1.0))
    assert g.converged and all(math.isclose(getattr(g, k), getattr(other, k), rel_tol=1e-4) for k in ("p", "q", "v"))
    assert 1.7 < g.p < 2.8 and 2.8 < g.q < 4.5
    own = [r for r in people if r[1] and r[4] > 0]
    assert math.isclose(-g.log_likelihood / len(own), value_loss(people, np.log([g.p, g.q, g.v]), 1.0), rel_tol=1e-10)


def test_likelihood_at_the_fit_in_sql(people, summary):
    p, con = clv.fit_bgnbd(summary), duckdb.connect()
    con.execute("CREATE TABLE s (c BIGINT, x BIGINT, t_x BIGINT, t BIGINT, m DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?)", people)
    sql = """SELECT sum(lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
      + ln(pow(alpha + t, -(r + x)) + CASE WHEN x > 0 THEN a / (b + x - 1) * pow(alpha + t_x, -(r + x)) ELSE 0 END)) FROM s, (SELECT ? AS r, ? AS alpha, ? AS a, ? AS b)"""
    assert math.isclose(con.execute(sql, [p.r, p.alpha, p.a, p.b]).fetchone()[0], p.log_likelihood, rel_tol=1e-9)
    assert math.isclose(clv.log_likelihood(summary, p).first().ll, p.log_likelihood, rel_tol=1e-9)


def test_no_maximum_inside(spark):
    """Nobody leaves and all buy alike: parameters run to their bounds, which is said, and the result does not depend on rounding."""
    rng = np.random.default_rng(2)
    rows = [(i, int(x), int(300 * x / (x + 1)), 300, 10.0) for i, x in enumerate(rng.poisson(30, 400) + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    p, moved = clv.fit_bgnbd(df), clv.fit_bgnbd(df, (1e-9,) * 4)
    assert not p.converged and p.evaluations < 100
    assert all(math.isclose(getattr(p, k), getattr(moved, k), rel_tol=1e-4) for k in ("r", "alpha", "a", "b"))
    assert not clv.fit_gamma_gamma(df).converged  # one value only
    for fit in (clv.fit_bgnbd, clv.fit_gamma_gamma):
        with pytest.raises(ValueError):
            fit(df.limit(0))


def test_holdout_accuracy_and_headline(spark, summary):
    rows = spark.createDataFrame([(1.0, 2, 0), (3.0, 3, 1), (2.0, 1, 7)], "predicted double, actual long, frequency long")
    got = clv.accuracy(rows).first()
    assert (got.customers, got.predicted_total, got.actual_total, got.ratio) == (3, 6.0, 6, 1.0)
    assert math.isclose(got.mae, 2 / 3) and math.isclose(got.correlation, np.corrcoef([1, 3, 2], [2, 3, 1])[0, 1])
    none = clv.accuracy(rows.limit(0)).first()
    assert none.customers == 0 and none.ratio is None and none.mae is None and none.correlation is None
    table = clv.clv_table(summary, clv.BgNbd(0.7, 60, 0.5, 2.5), clv.GammaGamma(2.2, 3.5, 440.0))
    said = clv.headline(table, checked=rows)
    assert "3,000 known customers" in said and "the top tenth (300)" in said and "6 purchases were predicted and 6 made (0.0% over), correlation 0.50" in said


def test_tracking_and_value_likelihood(spark, summary, people):
    p, g = clv.BgNbd(0.7, 60, 0.5, 2.5), clv.GammaGamma(2.2, 3.5, 440.0)
    got = {r.age: r for r in clv.tracking(summary, p).collect()}
    for age, r in got.items():
        own = [x for x in people if x[3] // 90 == age]
        assert r.customers == len(own) and r.actual == sum(x[1] for x in own)
        assert math.isclose(r.expected, sum(float(clv.expected_purchases_of_new(p, x[3])) for x in own), rel_tol=1e-9)
    # The customers were drawn with these parameters.
    assert math.isclose(sum(r.expected for r in got.values()), sum(r.actual for r in got.values()), rel_tol=0.1)
    assert clv.tracking(summary.limit(0), p).count() == 0
    row, n = clv.value_log_likelihood(summary, g).first(), sum(1 for x in people if x[1] and x[4] > 0)
    assert row.customers == n and math.isclose(row.ll, -n * value_loss(people, np.log([2.2, 3.5, 440.0]), 1.0), rel_tol=1e-9)
    some = np.array([(x[1], x[4]) for x in people if x[1] and x[4] > 0])
    assert math.isclose(row.correlation, np.corrcoef(some.T)[0, 1], rel_tol=1e-6) and row.population_mean == g.population_mean()
    none = clv.value_log_likelihood(summary.limit(0), g).first()
    assert none.customers == 0 and none.ll is None and none.correlation is None


def test_kernels():
    z = np.array([1e-3, 0.3, 1.0, 2.5, 9.99, 10.0, 57.0, 1e6])
    assert np.allclose(K.digamma(z), [(math.lgamma(x * (1 + 1e-6)) - math.lgamma(x * (1 - 1e-6))) / (2e-6 * x) for x in z], rtol=1e-4)
    assert math.isclose(float(K.digamma(1.0)), -0.5772156649015329, rel_tol=1e-13) and math.isclose(float(K.trigamma(1.0)), math.pi**2 / 6, rel_tol=1e-12)
    assert np.allclose(K.log_rise(z, 3.0), np.log(z * (z + 1) * (z + 2)), rtol=1e-12, atol=1e-12)
    assert math.isclose(float(K.log_beta(2.0, 3.0)), math.log(1 / 12), rel_tol=1e-12) and math.isclose(float(K.log_beta(1e9, 1.0)), -math.log(1e9), rel_tol=1e-12)
    def bowl(x):  # noqa: E306
        return (x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2, np.array([2 * (x[0] - 1), 20 * (x[1] + 2)]), np.diag([2.0, 20.0])
    x, v, ok, n = K.newton(bowl, [0, 0], 5.0)
    assert ok and np.allclose(x, [1, -2]) and v < 1e-20 and n < 8
    x, _, ok, _ = K.newton(bowl, [0, 0], 1.5)
    assert not ok and np.allclose(x, [1, -1.5])
