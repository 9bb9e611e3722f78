"""Customer lifetime value: BG/NBD purchases (Fader, Hardie and Lee 2005) times Gamma-Gamma values (Fader and Hardie 2013)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import digamma, log_beta, log_hyp2f1, newton, trigamma
from ..functions.ranks import ranked
from ..functions.timeutil import last_complete_month, total


def summarize(sales: DataFrame, observation_end=None, calibration_end=None) -> DataFrame:
    """frequency (repeat purchase days), recency and T in calendar days, and the mean revenue of repeat days.

    Lines are reduced to customer days first. Unknown customers are left out.
    """
    days = sales.where("CustomerID is not null").groupBy("CustomerID", F.to_date("InvoiceDate").alias("Day")).agg(total("Revenue").alias("rev"))
    if calibration_end is not None:
        days = days.where(F.col("Day") <= F.lit(calibration_end).cast("date"))
    per = days.groupBy("CustomerID").agg(F.count("*").alias("n"), F.min("Day").alias("a"), F.max("Day").alias("b"), total("rev").alias("all"), F.min_by("rev", "Day").alias("first"))
    if observation_end is None:
        per = per.crossJoin(F.broadcast(days.agg(F.max("Day").alias("end"))))
    else:
        per = per.withColumn("end", F.lit(observation_end).cast("date"))
    rest = (F.col("all").cast("decimal(18,6)") - F.col("first").cast("decimal(18,6)")).cast("double")
    return per.select("CustomerID", (F.col("n") - 1).alias("frequency"), F.datediff("b", "a").cast("long").alias("recency"), F.datediff("end", "a").cast("long").alias("T"), F.when(F.col("n") > 1, rest / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0).alias("monetary_value"))


@dataclass(frozen=True)
class BgNbd:
    r: float
    alpha: float
    a: float
    b: float
    log_likelihood: float = float("nan")
    converged: bool = True
    evaluations: int = 0


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float
    log_likelihood: float = float("nan")
    converged: bool = True
    corr: float = float("nan")
    evaluations: int = 0

    def population_mean(self) -> float:
        return self.v * self.p / (self.q - 1) if self.q > 1 else float("nan")


#: Logs of parameters stay within this: e**12 is 160,000. A likelihood that still grows there has no maximum inside.
BOUND = 12.0


def _row(spark, **values: float) -> DataFrame:
    """One row of numbers. As a table, not as literals, it leaves the compiled code of a step the same."""
    return spark.sql(f"SELECT * FROM VALUES ({', '.join(f'{float(v)!r}D' for v in values.values())}) AS t({', '.join(values)})")


def _logs(theta: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by the logs of the parameters."""
    return theta * g, np.outer(theta, theta) * h + np.diag(theta * g)


#: What a row (x, t_x, T, n customers) adds to the log-likelihood beside its gamma functions, and to its derivatives.
#: u is the log odds that a customer who bought again is gone, s their probability.
_BGNBD_SUMS = {
    "v": "-r * ln1 - x * log(alpha + T) + if(x > 0, greatest(u, 0D) + log1p(exp(-abs(u))), 0D)",
    "g_r": "-ln1 + s * d",
    "g_alpha": "(r * T / alpha - x) / (alpha + T) + s * (r + x) * e",
    "g_a": "s / a",
    "g_b": "-s / m",
    "h_r_r": "s * (1 - s) * d * d",
    "h_r_alpha": "T / (alpha * (alpha + T)) + s * e + s * (1 - s) * d * (r + x) * e",
    "h_r_a": "s * (1 - s) * d / a",
    "h_r_b": "-s * (1 - s) * d / m",
    "h_alpha_alpha": "(x - r * T * (2 * alpha + T) / (alpha * alpha)) / ((alpha + T) * (alpha + T)) + s * (r + x) * e2 + s * (1 - s) * (r + x) * (r + x) * e * e",
    "h_alpha_a": "s * (1 - s) * (r + x) * e / a",
    "h_alpha_b": "-s * (1 - s) * (r + x) * e / m",
    "h_a_a": "(s * (1 - s) - s) / (a * a)",
    "h_a_b": "-s * (1 - s) / (a * m)",
    "h_b_b": "(s * (1 - s) + s) / (m * m)",
}
_NAMES = ("r", "alpha", "a", "b")


def bgnbd_step(counted: DataFrame, tails: np.ndarray, customers: int, log_params) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood a customer with its gradient and Hessian by the logs of (r, alpha, a, b), in one aggregation.

    ``counted`` has x, t_x, T and n; ``tails[i]`` is the number of customers with
    more than i repeat purchases. As x is whole, differences of log-gamma are sums
    of logs over the tails, so no digits cancel however large a parameter is.
    """
    theta = np.exp(np.asarray(log_params, float))
    r, alpha, a, b = theta
    rows = counted.crossJoin(F.broadcast(_row(counted.sparkSession, r=r, alpha=alpha, a=a, b=b)))
    rows = rows.selectExpr("*", "log1p(T / alpha) AS ln1", "log1p((T - t_x) / (alpha + t_x)) AS d", "(t_x - T) / ((alpha + T) * (alpha + t_x)) AS e", "greatest(b + x - 1, b) AS m")
    rows = rows.selectExpr("*", "log(a) - log(m) + (r + x) * d AS u", "1 / ((alpha + t_x) * (alpha + t_x)) - 1 / ((alpha + T) * (alpha + T)) AS e2")
    rows = rows.selectExpr("*", "if(x > 0, 1 / (1 + exp(-u)), 0D) AS s")
    got = rows.agg(*[F.expr(f"sum(n * ({e}))").alias(k) for k, e in _BGNBD_SUMS.items()]).first().asDict()
    i = np.arange(len(tails))
    value = got["v"] + (tails * (np.log(r + i) - np.log1p(a / (b + i)))).sum()
    g = np.array([got[f"g_{p}"] for p in _NAMES])
    g += [(tails / (r + i)).sum(), 0.0, -(tails / (a + b + i)).sum(), (tails * a / ((b + i) * (a + b + i))).sum()]
    h = np.array([[got[f"h_{p}_{q}" if f"h_{p}_{q}" in got else f"h_{q}_{p}"] for q in _NAMES] for p in _NAMES])
    ab = (tails / (a + b + i) ** 2).sum()
    h[0, 0] -= (tails / (r + i) ** 2).sum()
    h[2:, 2:] += [[ab, ab], [ab, ab - (tails / (b + i) ** 2).sum()]]
    g, h = _logs(theta, g, h)
    return -value / customers, -g / customers, -h / customers


def _tails(by_x: list) -> np.ndarray:
    """From (x, customers), how many have more than 0, 1, 2, ... repeat purchases; as long as the largest x, a number of days."""
    count = np.zeros(max((x for x, _ in by_x), default=0) + 1)
    for x, n in by_x:
        count[x] += n
    return count[::-1].cumsum()[::-1][1:]


def fit_bgnbd(summary: DataFrame, start=(0.0, 0.0, 0.0, 0.0)) -> BgNbd:
    """Maximum likelihood by Newton steps on the logs of the parameters, each step one aggregation over the customers counted by (x, t_x, T).

    ``converged`` is False where a parameter runs into its bound: the likelihood
    then grows towards a simpler model (no one leaves, or all buy alike).
    """
    counted = summary.groupBy(F.col("frequency").cast("double").alias("x"), F.col("recency").cast("double").alias("t_x"), F.col("T").cast("double").alias("T")).agg(F.count("*").alias("n")).persist()
    try:
        by_x = [(int(x), n) for x, n in counted.groupBy("x").agg(F.sum("n")).collect()]
        if not by_x:
            raise ValueError("no customers to fit")
        customers, tails = sum(n for _, n in by_x), _tails(by_x)
        best, loss, ok, steps = newton(lambda p: bgnbd_step(counted, tails, customers, p), np.asarray(start, float), BOUND)
    finally:
        counted.unpersist()
    return BgNbd(*map(float, np.exp(best)), -float(loss) * customers, ok, steps)


#: What a repeat customer's row (x, z = value over the mean, n customers) adds; w is the share of the own purchases' weight.
_GAMMA_SUMS = {"A": "log1p(x * z / v)", "B": "x * log1p(v / (x * z))", "W": "w", "WX": "x * (1 - w)", "V": "w * (1 - w)", "VX": "x * w * (1 - w)"}


def gamma_gamma_step(counted: DataFrame, by_x: np.ndarray, log_z: float, log_params) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood a customer with its gradient and Hessian by the logs of (p, q, v), in one aggregation.

    ``by_x`` has x and customers; ``log_z`` is the sum of the logs of the values.
    Gamma functions depend on x alone and are summed over its few values.
    """
    p, q, v = np.exp(np.asarray(log_params, float))
    rows = counted.crossJoin(F.broadcast(_row(counted.sparkSession, v=v))).selectExpr("*", "x * z / (v + x * z) AS w")
    s = rows.agg(*[F.expr(f"sum(n * ({e}))").alias(k) for k, e in _GAMMA_SUMS.items()]).first().asDict()
    x, n = by_x[:, 0], by_x[:, 1]
    customers = n.sum()
    d1, d2, own1, own2 = digamma(p * x + q), trigamma(p * x + q), digamma(p * x), trigamma(p * x)
    value = -(n * log_beta(p * x, q)).sum() - q * s["A"] - p * s["B"] - log_z
    g = np.array([p * ((n * x * (d1 - own1)).sum() - s["B"]), q * ((n * d1).sum() - customers * digamma(q) - s["A"]), q * s["W"] - p * s["WX"]])
    pq = p * q * (n * x * d2).sum()
    h = np.array(
        [
            [p * p * (n * x * x * (d2 - own2)).sum() + g[0], pq, -p * s["WX"]],
            [pq, q * q * ((n * d2).sum() - customers * trigamma(q)) + g[1], q * s["W"]],
            [-p * s["WX"], q * s["W"], -q * s["V"] - p * s["VX"]],
        ]
    )
    return float(-value / customers), -g / customers, -h / customers


def fit_gamma_gamma(summary: DataFrame, start=(0.0, 0.0, 0.0)) -> GammaGamma:
    """Maximum likelihood over repeat customers with a positive value, on values scaled to mean 1, by Newton steps as ``fit_bgnbd``."""
    own = summary.where("frequency > 0 and monetary_value > 0")
    sums = own.agg(F.count("*"), F.sum(F.col("monetary_value").cast("decimal(38,10)")).cast("double"), (F.covar_pop("frequency", "monetary_value") / F.nullif(F.stddev_pop("frequency") * F.stddev_pop("monetary_value"), F.lit(0.0)))).first()
    customers, whole, corr = sums
    if not customers:
        raise ValueError("no repeat customers to fit")
    scale = whole / customers
    counted = own.groupBy(F.col("frequency").cast("double").alias("x"), (F.col("monetary_value") / scale).alias("z")).agg(F.count("*").alias("n")).persist()
    try:
        got = counted.groupBy("x").agg(F.sum("n"), F.sum(F.col("n") * F.log("z"))).collect()
        by_x = np.array(sorted((x, n) for x, n, _ in got), float)
        log_z = float(sum(lz for *_, lz in got))
        best, loss, ok, steps = newton(lambda t: gamma_gamma_step(counted, by_x, log_z, t), np.asarray(start, float), BOUND)
    finally:
        counted.unpersist()
    p, q, v = map(float, np.exp(best))
    return GammaGamma(p, q, v * scale, -float(loss) * customers - customers * float(np.log(scale)), ok, 0.0 if corr is None else corr, steps)


def expected_purchases(p: BgNbd, t: float, x, t_x, T) -> np.ndarray:
    """E[Y(t) | x, t_x, T], in logs where numbers are large."""
    x, t_x, T = (np.asarray(v, float) for v in (x, t_x, T))
    lead = (p.a + p.b + x - 1) / (p.a - 1)
    # Hypergeometric arguments (r + x, b + x; a + b + x - 1; z) are positive where a + b + x > 1.
    z = t / (p.alpha + T + t)
    log_tail = (p.r + x) * (np.log(p.alpha + T) - np.log(p.alpha + T + t)) + log_hyp2f1(p.r + x, p.b + x, p.a + p.b + x - 1, z)
    odds = np.where(x > 0, p.a / (p.b + np.maximum(x, 1) - 1) * np.exp((p.r + x) * (np.log(p.alpha + T) - np.log(p.alpha + t_x))), 0.0)
    return lead * -np.expm1(log_tail) / (1 + odds)


def expected_purchases_of_new(p: BgNbd, t):
    """E[X(t)] of a customer just acquired, for one number of days or many."""
    t = np.asarray(t, float)
    z = t / (p.alpha + t)
    log_tail = p.r * (np.log(p.alpha) - np.log(p.alpha + t)) + log_hyp2f1(p.r, p.b, p.a + p.b - 1, z)
    return (p.a + p.b - 1) / (p.a - 1) * -np.expm1(log_tail)


def prob_alive(p: BgNbd, x: Column, t_x: Column, T: Column) -> Column:
    odds = F.lit(p.a) / (F.lit(p.b) + x - 1) * F.pow((F.lit(p.alpha) + T) / (F.lit(p.alpha) + t_x), F.lit(p.r) + x)
    return F.when(x > 0, 1 / (1 + odds)).otherwise(1.0)


def log_likelihood(summary: DataFrame, p: BgNbd) -> DataFrame:
    """Log-likelihood of fixed parameters, with gamma terms as sums of logs (x is whole)."""
    x, t_x, T = F.col("frequency"), F.col("recency"), F.col("T")
    rise = lambda base: F.aggregate(F.when(x > 0, F.sequence(F.lit(0), (x - 1).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln(F.lit(base) + i))
    alive = -(F.lit(p.r) + x) * F.ln(F.lit(p.alpha) + T)
    gone = F.lit(float(np.log(p.a))) - F.ln(F.lit(p.b) + x - 1) - (F.lit(p.r) + x) * F.ln(F.lit(p.alpha) + t_x)
    top = F.greatest(alive, gone)
    both = F.when(x > 0, top + F.ln(F.exp(alive - top) + F.exp(gone - top))).otherwise(alive)
    ll = rise(p.r) + F.lit(p.r * float(np.log(p.alpha))) + rise(p.b) - rise(p.a + p.b) + both
    return summary.agg(F.count("*").alias("customers"), F.sum(ll.cast("decimal(28,10)")).cast("double").alias("ll"))


def value_log_likelihood(summary: DataFrame, g: GammaGamma) -> DataFrame:
    """One row on repeat customers with a positive value: log-likelihood of fixed parameters, correlation of frequency and value, population mean.

    Gamma functions depend on the frequency alone and are worked out once for each.
    """
    x, m = F.col("frequency").cast("double"), F.col("monetary_value")
    exact = lambda c: F.sum(c.cast("decimal(38,10)"))
    own = summary.where("frequency > 0 and monetary_value > 0")

    @F.pandas_udf("double")
    def beta(x: pd.Series) -> pd.Series:
        return pd.Series(log_beta(g.p * x.to_numpy(float), g.q))

    part = F.lit(g.q * float(np.log(g.v))) + (g.p * x - 1) * F.ln(m) + g.p * x * F.ln(x) - (g.p * x + g.q) * F.ln(g.v + x * m)
    by_x = own.groupBy(x.alias("x")).agg(F.count("*").alias("n"), exact(part).alias("s"))
    ll = by_x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customers"), (F.sum("s").cast("double") - exact(F.col("n") * beta("x")).cast("double")).alias("ll"))
    same = own.agg((F.covar_pop(x, m) / F.nullif(F.stddev_pop(x) * F.stddev_pop(m), F.lit(0.0))).alias("correlation"))
    return ll.crossJoin(same).withColumn("population_mean", F.lit(g.population_mean()))


def tracking(summary: DataFrame, p: BgNbd, days: int = 90) -> DataFrame:
    """(age, customers, expected, actual) by age in spans of ``days``: repeat purchases that new customers would have made by now, and those made."""

    @F.pandas_udf("double")
    def since_first(T: pd.Series) -> pd.Series:
        return pd.Series(expected_purchases_of_new(p, T.to_numpy(float)))

    ages = summary.groupBy("T").agg(F.count("*").alias("n"), F.sum("frequency").alias("x"))  # one row a day at most
    rows = ages.withColumn("e", F.col("n") * since_first("T"))
    return rows.groupBy(F.floor(F.col("T") / days).cast("int").alias("age")).agg(F.sum("n").alias("customers"), F.sum(F.col("e").cast("decimal(28,10)")).cast("double").alias("expected"), F.sum("x").alias("actual"))


def expected_value(g: GammaGamma, x: Column, m: Column) -> Column:
    """Own mean drawn towards the population's; the more repeat purchases, the less."""
    weight = F.lit(g.p) * x / (F.lit(g.p) * x + F.lit(g.q - 1))
    return F.when(x > 0, (1 - weight) * F.lit(g.population_mean()) + weight * m).otherwise(F.lit(g.population_mean()))


def _predict(p: BgNbd, t: float):
    @F.pandas_udf("double")
    def run(x: pd.Series, t_x: pd.Series, T: pd.Series) -> pd.Series:
        return pd.Series(expected_purchases(p, t, x, t_x, T))

    return run


def clv_table(summary: DataFrame, p: BgNbd, g: GammaGamma, horizon: int = 180) -> DataFrame:
    x, t_x, T, m = (F.col(c) for c in ("frequency", "recency", "T", "monetary_value"))
    out = summary.select("*", prob_alive(p, x, t_x, T).alias("prob_alive"), _predict(p, horizon)(x, t_x, T).alias("pred_purchases"), expected_value(g, x, m).alias("pred_avg_value"))
    out = out.withColumn("clv", F.bround(F.col("pred_purchases") * F.col("pred_avg_value"), 2))
    return out.withColumns({"prob_alive": F.bround("prob_alive", 4), "pred_purchases": F.bround("pred_purchases", 4), "pred_avg_value": F.bround("pred_avg_value", 2)})


def window(sales: DataFrame) -> DataFrame:
    """calibration_end and holdout_end: six months up to the last complete month; none where nothing was sold by then."""
    own = sales.where("CustomerID is not null").agg(F.max("InvoiceDate").alias("b"), F.min("InvoiceDate").alias("a"))
    last = last_complete_month(F.col("b"))
    end = lambda i: F.last_day(F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1)))
    return own.where("b is not null").select(end(last - 6).alias("calibration_end"), end(last).alias("holdout_end"), "a").where("to_date(a) <= calibration_end").drop("a")


def holdout_actuals(sales: DataFrame, calibration_end, holdout_end) -> DataFrame:
    """Each calibrated customer's summary with the purchase days of the holdout window."""
    cal = summarize(sales, calibration_end, calibration_end)
    day = F.to_date("InvoiceDate")
    later = sales.where("CustomerID is not null").where((day > F.lit(calibration_end).cast("date")) & (day <= F.lit(holdout_end).cast("date"))).groupBy("CustomerID").agg(F.count_distinct(day).alias("actual"))
    return cal.join(later, "CustomerID", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def validate(sales: DataFrame, calibration_end, holdout_end) -> tuple[BgNbd, DataFrame]:
    """Parameters fitted on the calibration window, and actual and predicted holdout purchases."""
    rows = holdout_actuals(sales, calibration_end, holdout_end)
    p = fit_bgnbd(rows)
    days = (pd.Timestamp(holdout_end) - pd.Timestamp(calibration_end)).days
    return p, predicted(rows, p, days)


def predicted(rows: DataFrame, p: BgNbd, days: float) -> DataFrame:
    """``rows`` with E[purchases in the next ``days``] of each customer as ``predicted``."""
    return rows.withColumn("predicted", _predict(p, float(days))("frequency", "recency", "T"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: customers, predicted and actual total, their ratio, the mean absolute error and the correlation across customers.

    Ratios are null where nothing was bought, the correlation where either side is the same for all.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,10)")).cast("double")
    n, a, b = F.count("*"), exact(F.col("predicted")), F.sum("actual")
    spread = F.stddev_pop("predicted") * F.stddev_pop("actual")
    return rows.agg(
        n.alias("customers"), a.alias("predicted_total"), b.alias("actual_total"), (a / F.nullif(b, F.lit(0))).alias("ratio"),
        (exact(F.abs(F.col("predicted") - F.col("actual"))) / F.nullif(n, F.lit(0))).alias("mae"),
        (F.covar_pop("predicted", F.col("actual").cast("double")) / F.nullif(spread, F.lit(0.0))).alias("correlation"),
    )


def headline(table: DataFrame, horizon: int = 180, checked: DataFrame | None = None) -> str:
    """A sentence on the customers, how much of the predicted value the top tenth hold, and, with ``checked``, how the holdout came out."""
    n, repeat, total_clv = table.agg(F.count("*"), F.count_if(F.col("frequency") > 0), F.sum("clv")).first()
    out = f"{n:,} known customers, {repeat:,} of them repeat buyers"
    if total_clv:
        top = concentration(table.where("clv is not null"), "clv").first()
        out += f"; the top tenth ({top['k']:,}) hold {100 * top['top_share']:.1f}% of {total_clv:,.0f} predicted for {horizon} days"
    row = None if checked is None else accuracy(checked).first()
    if row is not None and row["actual_total"]:
        off = 100 * (row["ratio"] - 1)
        same = "" if row["correlation"] is None else f", correlation {row['correlation']:.2f}"
        out += f"; in the holdout {row['predicted_total']:,.0f} purchases were predicted and {row['actual_total']:,} made ({abs(off):.1f}% {'over' if off >= 0 else 'under'}){same}"
    return out + "."


def by_frequency(rows: DataFrame, *measures: str) -> DataFrame:
    label = F.when(F.col("frequency") >= 5, "5+").otherwise(F.col("frequency").cast("string"))
    return rows.groupBy(label.alias("cal_frequency")).agg(F.count("*").alias("customers"), *[(F.sum(F.col(m).cast("decimal(28,10)")).cast("double") / F.count("*")).alias(f"{m}_mean") for m in measures])


def concentration(rows: DataFrame, value: str, share: float = 0.1) -> DataFrame:
    """Share of the value of the top tenth of customers."""
    v = F.col(value).cast("decimal(18,6)")
    own = ranked(rows.select(v.alias("v"), (-F.col(value)).alias("by"), "CustomerID"), {"rn": "by"}, "CustomerID")
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share), 0).cast("long"))
    return own.agg(F.max(k).alias("k"), (F.sum(F.when(F.col("rn") <= k, F.col("v"))).cast("double") / F.nullif(F.sum("v").cast("double"), F.lit(0.0))).alias("top_share"))


def lorenz(rows: DataFrame, value: str, points: int = 20) -> DataFrame:
    """Cumulative shares of customers and value, ascending, at every 1/points of customers, with (0, 0).

    Values are summed between the points; running sums are made of those few rows.
    """
    v = F.col(value).cast("decimal(18,6)")
    own = ranked(rows.select(v.alias("v"), F.col(value).alias("by"), "CustomerID"), {"rn": "by"}, "CustomerID")
    at = own.groupBy(F.ceil(F.col("rn") * points / F.col("n")).cast("int").alias("point")).agg(F.max("rn").alias("rn"), F.max("n").alias("n"), F.sum("v").alias("v"))
    upto = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    out = at.select("point", (F.col("rn") / F.col("n")).alias("customer_share"), (F.sum("v").over(upto).cast("double") / F.sum("v").over(Window.partitionBy()).cast("double")).alias("value_share"))
    return out.unionAll(rows.sparkSession.range(1).select(F.lit(0).alias("point"), F.lit(0.0).alias("customer_share"), F.lit(0.0).alias("value_share")))
