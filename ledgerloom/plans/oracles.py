"""SQL of the retail queries, written independently of the DataFrame operators, for DuckDB."""

from __future__ import annotations

_CODES = "'POST','DOT','C2','D','M','m','S','B','BANK CHARGES','AMAZONFEE','ADJUST','ADJUST2','CRUK','TEST001','TEST002','PADS'"
_KEY = "Invoice, StockCode, Description, Quantity, InvoiceDate, Price, CustomerID, Country"
BASE = f"""
lines AS (
  SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS Invoice,
         CASE WHEN l_orderkey % 89 = 0 THEN 'POST' WHEN l_orderkey % 83 = 0 THEN 'gift_0001_10' ELSE p_brand END AS StockCode,
         CASE WHEN l_orderkey % 71 = 0 THEN NULL ELSE p_name END AS Description,
         CAST(l_quantity AS BIGINT) * (CASE WHEN l_returnflag = 'R' OR l_orderkey % 73 = 0 THEN -1 ELSE 1 END) AS Quantity,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END AS TIMESTAMP) AS InvoiceDate,
         CASE WHEN l_orderkey % 79 = 0 THEN 0.0 ELSE round((10 + CAST(substr(p_brand, 7) AS INTEGER)) * (1 - l_discount), 2) END AS Price,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS CustomerID,
         n_name AS Country, l_orderkey AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT {_KEY} FROM lines UNION ALL SELECT {_KEY} FROM lines WHERE k % 97 = 0),
base AS (SELECT DISTINCT {_KEY} FROM raw),
cleaned AS (
  SELECT *, CustomerID IS NOT NULL AS KnownCustomer, Quantity * Price AS Revenue, CAST(InvoiceDate AS DATE) AS d,
         year(InvoiceDate) AS Year, month(InvoiceDate) AS Month, strftime(InvoiceDate, '%Y-%m') AS YearMonth,
         isoyear(InvoiceDate) AS ISOYear, weekofyear(InvoiceDate) AS ISOWeek, year(InvoiceDate) * 12 + month(InvoiceDate) - 1 AS ym,
         Invoice LIKE 'C%' AS back
  FROM base WHERE NOT (StockCode IN ({_CODES}) OR lower(StockCode) LIKE 'gift!_%' ESCAPE '!')),
sales AS (SELECT * FROM cleaned WHERE NOT back AND Price > 0 AND Quantity > 0),
rets AS (SELECT * FROM cleaned WHERE back)"""


def m(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


_NONPROD = f"(StockCode IN ({_CODES}) OR lower(StockCode) LIKE 'gift!_%' ESCAPE '!')"
_MATCH = f"""
matched AS (
  SELECT r.Invoice, r.CustomerID, r.StockCode, r.InvoiceDate, -r.Revenue AS returned_value, s.at AS SaleDate,
         date_diff('day', s.at, r.InvoiceDate) AS days_to_return
  FROM (SELECT * FROM rets WHERE CustomerID IS NOT NULL) r
  ASOF LEFT JOIN (SELECT DISTINCT CustomerID, StockCode, InvoiceDate AS at FROM sales WHERE CustomerID IS NOT NULL) s
  ON r.CustomerID = s.CustomerID AND r.StockCode = s.StockCode AND r.InvoiceDate >= s.at)"""
_DESC = """
desc_all AS (SELECT StockCode, trim(Description) AS t, count(*) AS n FROM (SELECT StockCode, Description FROM sales UNION ALL SELECT StockCode, Description FROM rets) WHERE Description IS NOT NULL GROUP BY ALL),
descs AS (SELECT StockCode, t AS Description FROM desc_all QUALIFY row_number() OVER (PARTITION BY StockCode ORDER BY n DESC, t) = 1)"""
_SDESC = """
sdesc_all AS (SELECT StockCode, trim(Description) AS t, count(*) AS n FROM sales WHERE Description IS NOT NULL GROUP BY ALL),
sdescs AS (SELECT StockCode, t AS Description FROM sdesc_all QUALIFY row_number() OVER (PARTITION BY StockCode ORDER BY n DESC, t) = 1)"""
_SKU = f"""
sold AS (SELECT StockCode, CAST(sum(Quantity) AS BIGINT) AS su, {m("Revenue")} AS sv FROM sales GROUP BY 1),
given AS (SELECT StockCode, -CAST(sum(Quantity) AS BIGINT) AS ru, -{m("Revenue")} AS rv FROM rets GROUP BY 1),
skus AS (SELECT g.StockCode, coalesce(d.Description, '') AS Description, coalesce(su, 0) AS sold_units, coalesce(sv, 0.0) AS sold_value, ru AS returned_units, rv AS returned_value,
  CASE WHEN coalesce(su, 0) > 0 THEN ru / su END AS unit_return_rate, CASE WHEN coalesce(sv, 0) > 0 THEN rv / sv END AS value_return_rate
  FROM given g LEFT JOIN sold USING (StockCode) LEFT JOIN descs d USING (StockCode))"""
_RFM = f"""
own AS (SELECT * FROM sales WHERE CustomerID IS NOT NULL),
rfm0 AS (SELECT CustomerID, date_diff('day', max(InvoiceDate), (SELECT max(InvoiceDate) + INTERVAL 1 DAY FROM own)) AS RecencyDays, count(DISTINCT Invoice) AS Frequency, {m("Revenue")} AS Monetary FROM own GROUP BY 1),
ranked AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY RecencyDays DESC, CustomerID) AS a, row_number() OVER (ORDER BY Frequency, CustomerID) AS b, row_number() OVER (ORDER BY Monetary, CustomerID) AS c FROM rfm0),
-- a rank's fifth: how many of the inner quintile edges of 1..n, linear between neighbours, are below it
rfm1 AS (SELECT CustomerID, RecencyDays, Frequency, Monetary,
  CAST(len(list_filter([1, 2, 3, 4], lambda k: a > 1 + k * (n - 1) / 5)) + 1 AS INTEGER) AS R,
  CAST(len(list_filter([1, 2, 3, 4], lambda k: b > 1 + k * (n - 1) / 5)) + 1 AS INTEGER) AS F,
  CAST(len(list_filter([1, 2, 3, 4], lambda k: c > 1 + k * (n - 1) / 5)) + 1 AS INTEGER) AS M FROM ranked),
rfm2 AS (SELECT *, CASE WHEN R >= 4 AND F >= 4 THEN 'Champions' WHEN R = 3 AND F >= 4 THEN 'Loyal Customers' WHEN R >= 4 AND F >= 2 THEN 'Potential Loyalist'
  WHEN R >= 4 THEN 'New Customers' WHEN R = 3 AND F >= 2 THEN 'Need Attention' WHEN R = 3 THEN 'About to Sleep' WHEN R = 1 AND F = 5 THEN 'Can''t Lose Them'
  WHEN F >= 4 THEN 'At Risk' WHEN F >= 2 THEN 'Hibernating' ELSE 'Lost' END AS Segment FROM rfm1)"""
_COH = """
cm AS (SELECT DISTINCT CustomerID, ym FROM sales WHERE CustomerID IS NOT NULL),
ca AS (SELECT *, min(ym) OVER (PARTITION BY CustomerID) AS cohort FROM cm),
cc AS (SELECT cohort, ym - cohort AS k, count(*) AS active FROM ca GROUP BY ALL),
csize AS (SELECT cohort, active AS size FROM cc WHERE k = 0),
lastc AS (SELECT max(ym) - 1 AS last_complete FROM sales WHERE CustomerID IS NOT NULL),
cgrid AS (SELECT cohort, size, last_complete, unnest(range(0, last_complete - (SELECT min(cohort) FROM csize) + 1)) AS k FROM csize, lastc),
tri AS (SELECT g.cohort, lpad(CAST(g.cohort // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(g.cohort % 12 + 1 AS VARCHAR), 2, '0') AS label, g.k, g.size,
  CASE WHEN g.cohort + g.k <= last_complete OR g.k = 0 THEN coalesce(active, 0) END AS active,
  CASE WHEN g.k = 0 THEN 1.0::DOUBLE WHEN g.cohort + g.k <= last_complete THEN coalesce(active, 0) / size END AS retention
  FROM cgrid g LEFT JOIN cc ON g.cohort = cc.cohort AND g.k = cc.k)"""
_LIF = f"""
la AS (SELECT CustomerID, ym, {m("Revenue")} AS revenue FROM sales WHERE CustomerID IS NOT NULL GROUP BY 1, 2),
llast AS (SELECT max(ym) - 1 AS last FROM sales WHERE CustomerID IS NOT NULL),
lact AS (SELECT la.* FROM la, llast WHERE ym <= last),
lfirst AS (SELECT CustomerID, min(ym) AS f FROM lact GROUP BY 1),
lgrid AS (SELECT CustomerID, f, unnest(range(f, last + 1)) AS ym FROM lfirst, llast),
lfill AS (SELECT g.CustomerID, g.ym, g.f, a.ym IS NOT NULL AS active, coalesce(a.revenue, 0.0) AS revenue FROM lgrid g LEFT JOIN lact a ON g.CustomerID = a.CustomerID AND g.ym = a.ym),
lgap AS (SELECT *, ym - max(CASE WHEN active THEN ym END) OVER w AS gap, lag(active) OVER w AS prev FROM lfill WINDOW w AS (PARTITION BY CustomerID ORDER BY ym)),
cells AS (SELECT CustomerID, ym, gap, CASE WHEN active AND ym = f THEN 'new' WHEN active AND prev THEN 'retained' WHEN active THEN 'resurrected' WHEN gap <= 3 THEN 'at_risk' ELSE 'dormant' END AS stage, revenue FROM lgap),
lmon AS (SELECT ym, count(*) FILTER (stage = 'new') AS new, count(*) FILTER (stage = 'retained') AS retained, count(*) FILTER (stage = 'resurrected') AS resurrected,
  count(*) FILTER (stage = 'at_risk') AS at_risk, count(*) FILTER (stage = 'dormant') AS dormant, count(*) AS base,
  {m("CASE WHEN stage = 'new' THEN revenue ELSE 0 END")} AS new_revenue, {m("CASE WHEN stage = 'retained' THEN revenue ELSE 0 END")} AS retained_revenue,
  {m("CASE WHEN stage = 'resurrected' THEN revenue ELSE 0 END")} AS resurrected_revenue, {m("revenue")} AS active_revenue FROM cells GROUP BY 1),
lmon2 AS (SELECT *, new + retained + resurrected AS active, lag(new + retained + resurrected) OVER (ORDER BY ym) - retained AS churned FROM lmon),
lmon3 AS (SELECT lpad(CAST(ym // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(ym % 12 + 1 AS VARCHAR), 2, '0') AS month, new, retained, resurrected, active, churned,
  CASE WHEN churned > 0 THEN (new + resurrected) / churned END AS quick_ratio, at_risk, dormant, base, new_revenue, retained_revenue, resurrected_revenue, active_revenue FROM lmon2)"""
_CLV = f"""
days AS (SELECT CustomerID, d, {m("Revenue")} AS rev FROM sales WHERE CustomerID IS NOT NULL GROUP BY 1, 2),
summ AS (SELECT CustomerID, count(*) - 1 AS frequency, date_diff('day', min(d), max(d)) AS recency, date_diff('day', min(d), (SELECT max(d) FROM days)) AS T,
  CASE WHEN count(*) > 1 THEN CAST(sum(CAST(rev AS DECIMAL(18,6))) - CAST(arg_min(rev, d) AS DECIMAL(18,6)) AS DOUBLE) / (count(*) - 1) ELSE 0.0 END AS monetary_value FROM days GROUP BY 1)"""
_WIN = """
win AS (SELECT last_day(make_date(CAST((y - 6) // 12 AS INTEGER), CAST((y - 6) % 12 + 1 AS INTEGER), 1)) AS calibration_end, last_day(make_date(CAST(y // 12 AS INTEGER), CAST(y % 12 + 1 AS INTEGER), 1)) AS holdout_end
  FROM (SELECT max(ym) - 1 AS y FROM sales WHERE CustomerID IS NOT NULL))"""
_HOLD = f"""
cdays AS (SELECT CustomerID, d, {m("Revenue")} AS rev FROM sales, win WHERE CustomerID IS NOT NULL AND d <= calibration_end GROUP BY 1, 2),
csumm AS (SELECT CustomerID, count(*) - 1 AS frequency, date_diff('day', min(d), max(d)) AS recency, date_diff('day', min(d), (SELECT calibration_end FROM win)) AS T FROM cdays GROUP BY 1),
act AS (SELECT CustomerID, count(DISTINCT d) AS actual FROM sales, win WHERE CustomerID IS NOT NULL AND d > calibration_end AND d <= holdout_end GROUP BY 1),
hold AS (SELECT c.*, coalesce(actual, 0) AS actual FROM csumm c LEFT JOIN act USING (CustomerID))"""


def _expected(rows: str, t: str) -> str:
    """CTEs up to ``expected`` (CustomerID, x, T, predicted): E[purchases in t days] with r 0.55, alpha 12, a 0.8, b 2.5; Gauss's series summed term by term."""
    return f"""
custs AS (SELECT CustomerID, frequency AS x, recency AS t_x, T, CAST({t} AS DOUBLE) AS ahead FROM {rows}),
steps AS (SELECT x, T, sum(ln((0.55 + x + k) * (2.5 + x + k) / ((2.3 + x + k) * (k + 1)) * ahead / (12.0 + T + ahead))) OVER (PARTITION BY x, T ORDER BY k) AS s FROM (SELECT DISTINCT x, T, ahead FROM custs), range(0, 1500) q(k)),
gauss AS (SELECT x, T, 1 + sum(exp(s)) AS h FROM steps GROUP BY x, T),
expected AS (SELECT CustomerID, (2.3 + x) / (0.8 - 1) * (1 - pow((12.0 + T) / (12.0 + T + ahead), 0.55 + x) * h)
  / (1 + CASE WHEN x > 0 THEN 0.8 / (2.5 + x - 1) * pow((12.0 + T) / (12.0 + t_x), 0.55 + x) ELSE 0 END) AS predicted FROM custs JOIN gauss USING (x, T))"""


_WEEKS = f"""
wk AS (SELECT CAST(date_trunc('week', InvoiceDate) AS DATE) + 6 AS week, {m("Revenue")} AS v FROM sales GROUP BY 1),
wspan AS (SELECT CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP) + INTERVAL 7 DAY, CAST(max(week) AS TIMESTAMP) - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS DATE) AS week FROM wk),
weeks AS (SELECT s.week, coalesce(v, 0.0) AS value, row_number() OVER (ORDER BY s.week) - 1 AS t FROM wspan s LEFT JOIN wk USING (week))"""
_FOLDS = """
nf AS (SELECT count(*) AS n FROM weeks),
folds AS (SELECT row_number() OVER (ORDER BY origin) AS fold, origin FROM (SELECT n - 8 - (4 - k) * 8 AS origin FROM nf, range(5) r(k)) WHERE origin >= 56)"""
_BERR = """
y AS (SELECT t, CAST(value AS DECIMAL(28,6)) AS y FROM weeks),
tests AS (SELECT fold, origin, t, y, t - origin AS i FROM y, folds WHERE t >= origin AND t < origin + 8),
preds AS (
  SELECT fold, 'naive' AS model, i, CAST(tests.y AS DOUBLE) AS y, CAST(p.y AS DOUBLE) AS f FROM tests JOIN y p ON p.t = origin - 1
  UNION ALL SELECT fold, 'seasonal_naive', i, CAST(tests.y AS DOUBLE), CAST(p.y AS DOUBLE) FROM tests JOIN y p ON p.t = CASE WHEN origin >= 52 THEN origin - 52 + i % 52 ELSE origin - 1 END
  UNION ALL SELECT fold, 'ma4', i, CAST(any_value(tests.y) AS DOUBLE), CAST(sum(p.y) AS DOUBLE) / 4 FROM tests JOIN y p ON p.t >= origin - 4 AND p.t < origin GROUP BY fold, i),
scale AS (SELECT fold, CAST(sum(abs(a.y - b.y)) AS DOUBLE) / count(*) AS scale FROM folds JOIN y a ON a.t < origin JOIN y b ON b.t = a.t - CASE WHEN origin > 52 THEN 52 ELSE 1 END GROUP BY fold),
berr AS (SELECT fold, model, mae, CASE WHEN scale > 0 THEN mae / scale END AS mase FROM (SELECT fold, model, CAST(sum(CAST(abs(y - f) AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mae FROM preds GROUP BY 1, 2) JOIN scale USING (fold))"""
_CODE_WEEKS = (
    _WEEKS,
    "topc AS (SELECT StockCode, sum(Quantity) AS n FROM sales GROUP BY 1 ORDER BY n DESC, StockCode LIMIT 10)",
    """cweeks AS (SELECT StockCode, CAST(t AS INTEGER) AS t, units FROM (SELECT StockCode, t, units, coalesce(min(CASE WHEN units <> 0 THEN t END) OVER (PARTITION BY StockCode), min(t) OVER (PARTITION BY StockCode)) AS f FROM (
 SELECT topc.StockCode, weeks.t, coalesce(u.units, 0) AS units FROM topc, weeks LEFT JOIN (SELECT StockCode, CAST(date_trunc('week', InvoiceDate) AS DATE) + 6 AS week, CAST(sum(Quantity) AS BIGINT) AS units FROM sales GROUP BY 1, 2) u ON u.StockCode = topc.StockCode AND u.week = weeks.week)) WHERE t >= f)""",
)
_CODE_ROWS = "cy AS (SELECT StockCode, units, row_number() OVER (PARTITION BY StockCode ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY StockCode) AS len FROM cweeks)"
# The last 12 weeks of each code are held back; errors are scaled by the mean step of the weeks before.
_CODE_ERRORS = f"""
{_CODE_ROWS},
cut AS (SELECT *, len - 12 AS c FROM cy WHERE len > 16),
cerr AS (SELECT a.StockCode, max(a.len) AS len, count(*) FILTER (a.units = 0) AS zeros,
  avg(abs(a.units - b.last)) FILTER (a.k >= a.c) AS e1, avg(abs(a.units - CASE WHEN a.c >= 52 THEN p.units ELSE b.last END)) FILTER (a.k >= a.c) AS e2, avg(abs(a.units - b.mean)) FILTER (a.k >= a.c) AS e3, any_value(b.walk) AS walk
  FROM cut a JOIN (SELECT StockCode, any_value(units) FILTER (k = c - 1) AS last, avg(units) FILTER (k >= c - 4 AND k < c) AS mean, avg(abs(units - prev)) FILTER (k < c) AS walk
    FROM (SELECT *, lag(units) OVER (PARTITION BY StockCode ORDER BY k) AS prev FROM cut) GROUP BY 1) b USING (StockCode)
  LEFT JOIN cut p ON p.StockCode = a.StockCode AND p.k = a.c - 52 + (a.k - a.c) % 52 GROUP BY 1)"""
_GRID = "(VALUES " + ", ".join(f"({n}, {x})" for n, x in enumerate(["0.1, 0.01, 0.05", "0.1, 0.01, 0.2", "0.1, 0.1, 0.05", "0.1, 0.1, 0.2", "0.3, 0.01, 0.05", "0.3, 0.01, 0.2", "0.3, 0.1, 0.05", "0.3, 0.1, 0.2", "0.5, 0.01, 0.05", "0.5, 0.01, 0.2", "0.5, 0.1, 0.05", "0.5, 0.1, 0.2"], 1)) + ", (0, 0.3, 0.05, 0.1)) AS grid(n, al, be, ga)"
_SERIES = "ys AS (SELECT StockCode, list(CAST(units AS DOUBLE) ORDER BY k) AS y FROM cy GROUP BY 1)"
# Smoothing week by week over jobs(job, y, al, be, ga): level, slope and the 52 offsets to come.
_SMOOTH = """
hws AS (SELECT *, list_avg(y[1:52]) AS base, CASE WHEN len(y) >= 104 THEN (list_avg(y[53:104]) - list_avg(y[1:52])) / 52 ELSE list_sum([(i - 25.5) * y[i + 1] FOR i IN range(0, 52)]) / 11713 END AS drift
  FROM (SELECT job, y, CAST(al AS DOUBLE) AS al, CAST(be AS DOUBLE) AS be, CAST(ga AS DOUBLE) AS ga FROM jobs)),
hw AS (SELECT job, 0 AS k, base AS level, drift AS slope, [v - base FOR v IN y[1:52]] AS ring FROM hws WHERE len(y) >= 56
  UNION ALL SELECT job, k + 1, level + slope + al * e, slope + al * be * e, list_append(ring[2:52], ring[1] + ga * (1 - al) * e)
  FROM (SELECT hw.*, al, be, ga, y[k + 1] - level - slope - ring[1] AS e FROM hw JOIN hws USING (job) WHERE k < len(y))),
ahead AS (SELECT job, i AS step, level + i * slope + ring[(i - 1) % 52 + 1] AS forecast FROM hw JOIN hws USING (job), range(1, 13) s(i) WHERE k = len(y)
  UNION ALL SELECT job, i, y[len(y)] FROM hws, range(1, 13) s(i) WHERE len(y) < 56)"""
_TUNED = f"""
tried AS (SELECT StockCode, n, whole, StockCode || '/' || n || '/' || whole AS job, y AS known, CASE WHEN whole THEN y ELSE y[1:len(y) - 8] END AS y, al, be, ga FROM ys, {_GRID}, (VALUES (true), (false)) w(whole)),
jobs AS (SELECT job, y, al, be, ga FROM tried WHERE whole OR len(y) >= 56)"""
_BEST = """
losses AS (SELECT StockCode, n, avg(abs(known[len(known) - 8 + step] - forecast)) AS loss FROM tried JOIN ahead USING (job) WHERE NOT whole AND n > 0 AND step <= 8 GROUP BY 1, 2),
best AS (SELECT StockCode, arg_min(n, (loss, n)) AS n FROM losses GROUP BY 1)"""
_ITEMS = f"""
norm AS (SELECT Invoice, StockCode, Revenue, regexp_replace(trim(upper(Description)), '\\s+', ' ', 'g') AS Item FROM sales WHERE length(trim(Description)) > 0),
bestc AS (SELECT StockCode FROM norm GROUP BY 1 ORDER BY {m("Revenue")} DESC, StockCode LIMIT 25),
cat AS (SELECT StockCode, Item FROM (SELECT StockCode, Item, count(*) AS n FROM norm SEMI JOIN bestc USING (StockCode) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY StockCode ORDER BY n DESC, Item) = 1),
items AS (SELECT DISTINCT Invoice, Item FROM sales JOIN cat USING (StockCode)),
bask AS (SELECT Invoice, Item FROM items QUALIFY count(*) OVER (PARTITION BY Invoice) >= 2),
nb AS (SELECT count(DISTINCT Invoice) AS n, greatest(1, CAST(ceil(0.005 * count(DISTINCT Invoice) - 1e-9) AS BIGINT)) AS least FROM bask),
s1 AS (SELECT Item AS a, count(*) AS c FROM bask, nb GROUP BY Item, least HAVING count(*) >= least),
s2 AS (SELECT x.Item AS a, y.Item AS b, count(*) AS c FROM bask x JOIN bask y ON x.Invoice = y.Invoice AND x.Item < y.Item, nb GROUP BY x.Item, y.Item, least HAVING count(*) >= least),
s3 AS (SELECT x.Item AS a, y.Item AS b, z.Item AS c3, count(*) AS c FROM bask x JOIN bask y ON x.Invoice = y.Invoice AND x.Item < y.Item JOIN bask z ON x.Invoice = z.Invoice AND y.Item < z.Item, nb GROUP BY ALL HAVING count(*) >= any_value(least)),
sets AS (SELECT 1 AS size, a, NULL AS b, NULL AS c, s1.c AS count, [a] AS items FROM s1 UNION ALL SELECT 2, a, b, NULL, s2.c, [a, b] FROM s2 UNION ALL SELECT 3, a, b, c3, s3.c, [a, b, c3] FROM s3)"""
_RULES = """
splits AS (SELECT items, count AS nxy, [a] AS x, [b] AS y FROM sets WHERE size = 2 UNION ALL SELECT items, count, [b], [a] FROM sets WHERE size = 2
  UNION ALL SELECT items, count, [a], [b, c] FROM sets WHERE size = 3 UNION ALL SELECT items, count, [b], [a, c] FROM sets WHERE size = 3 UNION ALL SELECT items, count, [c], [a, b] FROM sets WHERE size = 3
  UNION ALL SELECT items, count, [b, c], [a] FROM sets WHERE size = 3 UNION ALL SELECT items, count, [a, c], [b] FROM sets WHERE size = 3 UNION ALL SELECT items, count, [a, b], [c] FROM sets WHERE size = 3),
ru0 AS (SELECT s.items, s.x, s.y, nxy, nxy / n::DOUBLE AS support, px.count / n::DOUBLE AS sx, py.count / n::DOUBLE AS sy FROM splits s JOIN sets px ON px.items = s.x JOIN sets py ON py.items = s.y, nb),
ru1 AS (SELECT *, support / sx AS confidence, support / sx / sy AS lift FROM ru0),
rules AS (SELECT array_to_string(x, ' + ') AS antecedent, array_to_string(y, ' + ') AS consequent, array_to_string(items, ' + ') AS itemset, support, confidence, lift, support - sx * sy AS leverage,
  CASE WHEN confidence < 1 THEN (1 - sy) / (1 - confidence) ELSE 'inf'::DOUBLE END AS conviction, nxy AS support_count, nxy < 30 AS thin_support FROM ru1 WHERE confidence >= 0.03 AND lift >= 1.0)"""
_PR = f"""
qual AS (SELECT StockCode FROM sales GROUP BY 1 HAVING count(DISTINCT Price) >= 4 AND count(*) >= 100),
sub AS (SELECT *, ISOYear * 100 + ISOWeek AS week FROM sales SEMI JOIN qual USING (StockCode)),
rungs AS (SELECT StockCode, Price, count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS units, {m("Revenue")} AS revenue FROM sub GROUP BY 1, 2),
posted AS (SELECT StockCode, Price AS posted_price FROM rungs QUALIFY row_number() OVER (PARTITION BY StockCode ORDER BY lines DESC, Price) = 1),
lad AS (SELECT StockCode, Price, lines, units, revenue, units / sum(units) OVER (PARTITION BY StockCode) AS unit_share, abs(Price - posted_price) <= 1e-8 + 1e-5 * abs(posted_price) AS is_posted, posted_price FROM rungs JOIN posted USING (StockCode)),
agg AS (SELECT StockCode, count(DISTINCT Price) AS rungs, count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS units, {m("Revenue")} AS revenue, quantile_cont(Price, 0.1) AS price_p10, quantile_cont(Price, 0.9) AS price_p90 FROM sub GROUP BY 1),
side AS (SELECT StockCode, sum(CASE WHEN NOT is_posted AND Price < posted_price THEN units ELSE 0 END) AS bu, sum(CASE WHEN is_posted THEN units ELSE 0 END) AS au, sum(CASE WHEN NOT is_posted AND Price > posted_price THEN units ELSE 0 END) AS ou FROM lad GROUP BY 1),
prof AS (SELECT a.StockCode, coalesce(Description, '') AS Description, rungs, lines, units, revenue, posted_price, revenue / units AS realized_price, revenue / units / posted_price AS realization, price_p10, price_p90,
  price_p90 / price_p10 AS spread, bu / units AS unit_share_below, au / units AS unit_share_at, ou / units AS unit_share_above FROM agg a JOIN posted USING (StockCode) JOIN side USING (StockCode) LEFT JOIN sdescs USING (StockCode))"""
_PANEL = """
wp AS (SELECT StockCode, week, Price AS posted_price FROM (SELECT StockCode, week, Price, count(*) AS n FROM sub GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY StockCode, week ORDER BY n DESC, Price) = 1),
wu AS (SELECT StockCode, week, CAST(sum(Quantity) AS BIGINT) AS units FROM sub GROUP BY ALL),
mk AS (SELECT ISOYear * 100 + ISOWeek AS week, ln(sum(Quantity)) AS lm FROM sales GROUP BY 1),
panel AS (SELECT StockCode, week, posted_price, units, ln(posted_price) AS log_price, ln(units) AS log_units, ln(units) - (lm - (SELECT avg(lm) FROM mk)) AS log_units_adj FROM wp JOIN wu USING (StockCode, week) JOIN mk USING (week) WHERE units > 0),
fit AS (SELECT StockCode, count(*) AS weeks, count(DISTINCT posted_price) AS week_prices, regr_slope(log_units, log_price) AS slope_between_week, regr_slope(log_units_adj, log_price) AS slope_market_adj FROM panel GROUP BY 1 HAVING count(*) >= 12 AND count(DISTINCT posted_price) >= 3),
dm AS (SELECT StockCode, ln(Price) - avg(ln(Price)) OVER (PARTITION BY StockCode, week) AS x, ln(Quantity) - avg(ln(Quantity)) OVER (PARTITION BY StockCode, week) AS y FROM sub),
within_week AS (SELECT StockCode, CASE WHEN sum(x * x) > 1e-12 THEN sum(x * y) / sum(x * x) END AS slope_within_week FROM dm GROUP BY 1),
sl AS (SELECT StockCode, weeks, week_prices, slope_within_week, slope_between_week, slope_market_adj FROM fit LEFT JOIN within_week USING (StockCode))"""
_FIND = """
qrows AS (SELECT * FROM raw),
found AS (
  SELECT 'Completeness' AS dimension, 'required: Invoice' AS "check", count(*) FILTER (Invoice IS NULL) AS violations, count(*) AS evaluated FROM qrows
  UNION ALL SELECT 'Completeness', 'required: StockCode', count(*) FILTER (StockCode IS NULL), count(*) FROM qrows
  UNION ALL SELECT 'Completeness', 'required: Quantity', count(*) FILTER (Quantity IS NULL), count(*) FROM qrows
  UNION ALL SELECT 'Completeness', 'required: InvoiceDate', count(*) FILTER (InvoiceDate IS NULL), count(*) FROM qrows
  UNION ALL SELECT 'Completeness', 'required: Price', count(*) FILTER (Price IS NULL), count(*) FROM qrows
  UNION ALL SELECT 'Completeness', 'required: Country', count(*) FILTER (Country IS NULL), count(*) FROM qrows
  UNION ALL SELECT 'Completeness', 'all required cells', count(*) FILTER (Invoice IS NULL) + count(*) FILTER (StockCode IS NULL) + count(*) FILTER (Quantity IS NULL) + count(*) FILTER (InvoiceDate IS NULL) + count(*) FILTER (Price IS NULL) + count(*) FILTER (Country IS NULL), 6 * count(*) FROM qrows
  UNION ALL SELECT 'Validity', 'type=string: Invoice', 0, count(Invoice) FROM qrows
  UNION ALL SELECT 'Validity', 'regex: Invoice', count(*) FILTER (NOT regexp_full_match(Invoice, '[A-Za-z]?[0-9]+')), count(Invoice) FROM qrows
  UNION ALL SELECT 'Validity', 'type=string: StockCode', 0, count(StockCode) FROM qrows
  UNION ALL SELECT 'Validity', 'type=string: Description', 0, count(Description) FROM qrows
  UNION ALL SELECT 'Validity', 'type=integer: Quantity', 0, count(Quantity) FROM qrows
  UNION ALL SELECT 'Validity', 'type=datetime: InvoiceDate', 0, count(InvoiceDate) FROM qrows
  UNION ALL SELECT 'Validity', 'type=numeric: Price', 0, count(Price) FROM qrows
  UNION ALL SELECT 'Validity', 'range [0.0, None]: Price', count(*) FILTER (Price < 0), count(Price) FROM qrows
  UNION ALL SELECT 'Validity', 'type=numeric: CustomerID', 0, count(CustomerID) FROM qrows
  UNION ALL SELECT 'Validity', 'type=string: Country', 0, count(Country) FROM qrows
  UNION ALL SELECT 'Consistency', 'Quantity is positive', count(*) FILTER (Quantity <= 0), count(Quantity) FROM qrows
  UNION ALL SELECT 'Consistency', 'Price is positive', count(*) FILTER (Price <= 0), count(Price) FROM qrows
  UNION ALL SELECT 'Consistency', 'InvoiceDate within window', count(*) FILTER (InvoiceDate < TIMESTAMP '1996-01-01' OR InvoiceDate > TIMESTAMP '2001-01-01'), count(InvoiceDate) FROM qrows
  UNION ALL SELECT 'Uniqueness', 'duplicate rows', (SELECT count(*) FROM qrows) - (SELECT count(*) FROM base), (SELECT count(*) FROM qrows)
  UNION ALL SELECT 'Plausibility', '3xIQR: Quantity', (SELECT count(*) FILTER (Quantity < q1 - 3 * (q3 - q1) OR Quantity > q3 + 3 * (q3 - q1)) FROM qrows, (SELECT quantile_cont(CAST(Quantity AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(Quantity AS DOUBLE), 0.75) AS q3 FROM qrows)), count(Quantity) FROM qrows
  UNION ALL SELECT 'Plausibility', '3xIQR: Price', (SELECT count(*) FILTER (Price < q1 - 3 * (q3 - q1) OR Price > q3 + 3 * (q3 - q1)) FROM qrows, (SELECT quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.75) AS q3 FROM qrows)), count(Price) FROM qrows),
sc AS (SELECT *, CASE WHEN evaluated > 0 THEN round_even(100.0 * (1.0 - violations / evaluated), 1) ELSE 100.0 END AS score FROM found),
st AS (SELECT *, CASE WHEN score < 97 THEN CASE WHEN dimension = 'Plausibility' THEN 'warn' ELSE 'fail' END WHEN score < 99.5 THEN 'warn' ELSE 'pass' END AS status FROM sc)"""


#: The countries of Europe in the test tables.
EUROPE = ("FRANCE", "GERMANY", "ROMANIA", "RUSSIA", "UNITED KINGDOM")


def _inferred_findings() -> str:
    """Findings under a config inferred from types: every column required, numbers finite and plausible."""
    kinds = {"Invoice": "string", "StockCode": "string", "Description": "string", "Quantity": "integer", "InvoiceDate": "datetime", "Price": "numeric", "CustomerID": "integer", "Country": "string"}
    rows = [("Completeness", "all required cells", " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in kinds), f"{len(kinds)} * count(*)")]
    for c, kind in kinds.items():
        rows += [("Completeness", f"required: {c}", f"count(*) FILTER ({c} IS NULL)", "count(*)"), ("Validity", f"type={kind}: {c}", "0", f"count({c})")]
    rows.append(("Uniqueness", "duplicate rows", "count(*) - (SELECT count(*) FROM base)", "count(*)"))
    for c in ("Quantity", "Price", "CustomerID"):
        edges = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM raw)"
        far = f"(SELECT count(*) FILTER (q3 > q1 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))) FROM raw, {edges})"
        rows += [("Consistency", f"{c} is finite", "0", f"count({c})"), ("Plausibility", f"3xIQR: {c}", far, f"count({c})")]
    return " UNION ALL ".join(f"""SELECT '{d}' AS dimension, '{name}' AS "check", CAST({bad} AS BIGINT) AS violations, CAST({seen} AS BIGINT) AS evaluated FROM raw""" for d, name, bad, seen in rows)


def _card(rows: str) -> str:
    """The findings of another table, its dimensions with weights, and the total; dates within the default window."""
    found = _FIND.replace("qrows AS (SELECT * FROM raw)", f"qrows AS (SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price, CustomerID, Country FROM {rows})")
    found = found.replace("(SELECT count(*) FROM base)", "(SELECT count(*) FROM (SELECT DISTINCT * FROM qrows))").replace("1996-01-01", "2009-01-01").replace("2001-01-01", "2012-01-01")
    return found + """,
dims AS (SELECT dimension, CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS score, max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS level FROM st GROUP BY 1),
weighed AS (SELECT *, CAST(CASE dimension WHEN 'Completeness' THEN 0.30 WHEN 'Validity' THEN 0.25 WHEN 'Consistency' THEN 0.20 WHEN 'Uniqueness' THEN 0.15 ELSE 0.10 END AS DOUBLE) AS w FROM dims),
tot AS (SELECT round_even(sum(w * score) / sum(w), 1) AS total, max(level) FILTER (dimension <> 'Plausibility') AS worst FROM weighed)"""


_GRADED = """SELECT dimension, score, CASE level WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS status, total,
greatest(CASE WHEN total >= 95 THEN 'A' WHEN total >= 90 THEN 'B' WHEN total >= 80 THEN 'C' WHEN total >= 70 THEN 'D' ELSE 'F' END, CASE worst WHEN 3 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END) AS grade FROM weighed, tot"""

ORACLES = {
    "src3_typed_lines": q("""SELECT SourceSheet, count(*) AS lines, count(Description) AS described, CAST(sum(Quantity) AS BIGINT) AS units, CAST(sum(CAST(Price AS DECIMAL(18,6))) AS DOUBLE) AS prices, count(CustomerID) AS known, CAST(sum(CustomerID) AS BIGINT) AS customers, strftime(min(InvoiceDate), '%Y-%m-%d') AS first, strftime(max(InvoiceDate), '%Y-%m-%d') AS last
 FROM (SELECT *, 'first' AS SourceSheet FROM lines UNION ALL SELECT *, 'again' FROM lines WHERE k % 97 = 0) GROUP BY 1"""),
    "ing1_raw_quality_report": q(f"""
SELECT CAST((SELECT count(*) FROM raw) AS BIGINT) AS rows, count(DISTINCT Invoice) AS invoices, count(DISTINCT StockCode) AS stock_codes, strftime(min(InvoiceDate), '%Y-%m-%d') AS date_min, strftime(max(InvoiceDate), '%Y-%m-%d') AS date_max,
 (SELECT count(*) FROM raw) - (SELECT count(*) FROM base) AS exact_duplicate_rows, count(*) FILTER (CustomerID IS NULL) AS missing_customer_id, count(*) FILTER (CustomerID IS NULL) / count(*) AS missing_customer_id_pct,
 count(*) FILTER (Invoice LIKE 'C%') AS cancellation_rows, count(*) FILTER (Invoice LIKE 'C%') / count(*) AS cancellation_rows_pct, count(*) FILTER (Quantity < 0) AS negative_quantity_rows, count(*) FILTER (Price = 0) AS zero_price_rows,
 count(*) FILTER (Price < 0) AS negative_price_rows, count(*) FILTER ({_NONPROD}) AS non_product_code_rows, count(DISTINCT Country) AS countries FROM raw"""),
    "cln1_dedup": q(f"SELECT {_KEY.replace('InvoiceDate', 'strftime(InvoiceDate, $$%Y-%m-%d$$) AS InvoiceDate')} FROM base"),
    "cln2_cancellations": q("SELECT Invoice LIKE 'C%' AS cancelled, Country, count(*) AS n, CAST(sum(Quantity) AS BIGINT) AS units FROM base GROUP BY ALL"),
    "cln3_non_product": q(f"SELECT StockCode, {_NONPROD} AS non_product, count(*) AS n FROM base GROUP BY ALL"),
    "cln6_known_customers": q("SELECT KnownCustomer, count(*) AS n FROM sales GROUP BY 1"),
    "cln7_derived": q("SELECT Invoice, StockCode, Description, Quantity, Price, CustomerID, Country, KnownCustomer, Revenue, strftime(d, '%Y-%m-%d') AS Date, Year, Month, YearMonth, ISOYear, ISOWeek FROM sales"),
    "cln8_step_log": q(f"""
SELECT CAST(step AS INTEGER) AS step, ['exact duplicates','cancellations','bookkeeping codes','price not positive','quantity not positive','unknown customers flagged'][step] AS step_name, CAST(rows_in AS BIGINT) AS rows_in, CAST(rows_in - gone AS BIGINT) AS rows_out, CAST(gone AS BIGINT) AS rows_removed, round(100.0 * gone / rows_in, 2) AS pct_removed
FROM (SELECT step, gone, (SELECT count(*) FROM raw) - coalesce(sum(gone) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_in FROM (
 SELECT 1 AS step, (SELECT count(*) FROM raw) - (SELECT count(*) FROM base) AS gone UNION ALL SELECT 2, count(*) FROM base WHERE Invoice LIKE 'C%'
 UNION ALL SELECT 3, count(*) FROM base WHERE NOT Invoice LIKE 'C%' AND {_NONPROD}
 UNION ALL SELECT 4, count(*) FROM base WHERE NOT Invoice LIKE 'C%' AND NOT {_NONPROD} AND NOT Price > 0
 UNION ALL SELECT 5, count(*) FROM base WHERE NOT Invoice LIKE 'C%' AND NOT {_NONPROD} AND Price > 0 AND NOT Quantity > 0 UNION ALL SELECT 6, 0))"""),
    "cln9_returns": q("SELECT Invoice, StockCode, Quantity, Price, CustomerID, Country, Revenue, YearMonth FROM rets"),
    "eda1_monthly_revenue": q(f"SELECT YearMonth, {m('Revenue')} AS revenue, count(DISTINCT Invoice) AS invoices, count(*) AS lines FROM sales GROUP BY 1"),
    "eda2_top_products": q(f"SELECT StockCode, Description, {m('Revenue')} AS revenue, CAST(sum(Quantity) AS BIGINT) AS units FROM sales WHERE Description IS NOT NULL GROUP BY 1, 2 ORDER BY revenue DESC, StockCode, Description LIMIT 10"),
    "eda3_top_countries": q(f"SELECT Country, {m('Revenue')} AS revenue, {m('Revenue')} / (SELECT {m('Revenue')} FROM sales) AS share FROM sales GROUP BY 1 ORDER BY revenue DESC, Country LIMIT 10"),
    "eda4_order_values": q(f"SELECT CASE WHEN top > 1 THEN CAST(least(floor(log10(v) / log10(top) * 59), 58) AS INTEGER) ELSE 0 END AS bin, count(*) AS orders, {m('v')} AS revenue FROM ov, (SELECT max(v) AS top FROM ov) WHERE v >= 1 GROUP BY 1", f"ov AS (SELECT Invoice, {m('Revenue')} AS v FROM sales GROUP BY 1 HAVING {m('Revenue')} > 0)"),
    "eda4_order_value_summary": q("SELECT count(*) AS orders, median(v) AS median_value, max(v) AS max_value FROM ov", f"ov AS (SELECT Invoice, {m('Revenue')} AS v FROM sales GROUP BY 1 HAVING {m('Revenue')} > 0)"),
    "eda5_returns_rate": q("SELECT g.YearMonth, coalesce(r / g, 0.0) AS returns_rate FROM (SELECT YearMonth, " + m("Revenue") + " AS g FROM sales GROUP BY 1) g LEFT JOIN (SELECT YearMonth, -" + m("Revenue") + " AS r FROM rets GROUP BY 1) USING (YearMonth)"),
    "eda6_missing_customers": q("SELECT YearMonth, 100.0 * count(*) FILTER (NOT KnownCustomer) / count(*) AS missing_pct FROM sales GROUP BY 1"),
    "ret1_overview": q(f"""SELECT *, gross_value - returned_value AS net_value, returned_value / gross_value AS value_return_rate, returned_units / gross_units AS unit_return_rate FROM
 (SELECT {m('Revenue')} AS gross_value, CAST(sum(Quantity) AS BIGINT) AS gross_units, count(*) AS gross_lines, count(DISTINCT Invoice) AS gross_invoices FROM sales),
 (SELECT -{m('Revenue')} AS returned_value, -CAST(sum(Quantity) AS BIGINT) AS returned_units, count(*) AS return_lines, count(DISTINCT Invoice) AS cancellation_invoices FROM rets)"""),
    "ret2_descriptions": q("SELECT * FROM descs", _DESC),
    "ret3_by_sku": q("SELECT * FROM skus", _DESC, _SKU),
    "ret4_matched_lines": q("SELECT Invoice, CustomerID, StockCode, strftime(InvoiceDate, '%Y-%m-%d') AS InvoiceDate, returned_value, strftime(SaleDate, '%Y-%m-%d') AS SaleDate, days_to_return FROM matched", _MATCH),
    "ret4_match_stats": q(f"""SELECT *, matched_lines / return_lines AS matched_line_share, matched_value / returned_value AS matched_value_share FROM
 (SELECT count(*) AS return_lines, count(CustomerID) AS identified_lines, -{m('Revenue')} AS returned_value FROM rets),
 (SELECT count(*) AS matched_lines, {m('returned_value')} AS matched_value, CAST(sum(days_to_return) AS BIGINT) AS total_lag_days, median(CAST(days_to_return AS DOUBLE)) AS median_lag_days, sum(days_to_return) / count(*) AS mean_lag_days, quantile_cont(CAST(days_to_return AS DOUBLE), 0.25) AS p25_lag_days, quantile_cont(CAST(days_to_return AS DOUBLE), 0.75) AS p75_lag_days FROM matched WHERE SaleDate IS NOT NULL)""", _MATCH),
    "ret5_lag_buckets": q(f"""SELECT CAST(pos AS INTEGER) AS pos, lag_bucket, count(SaleDate) AS lines, coalesce({m('returned_value')}, 0.0) AS returned_value, count(SaleDate) / (SELECT count(*) FROM matched WHERE SaleDate IS NOT NULL) AS line_share
 FROM (VALUES (0, 'same day', 0, 0), (1, '1-7 days', 1, 7), (2, '8-30 days', 8, 30), (3, '31-90 days', 31, 90), (4, '91-365 days', 91, 365), (5, 'over 365 days', 366, 2000000000)) b(pos, lag_bucket, lo, hi) LEFT JOIN matched ON days_to_return BETWEEN lo AND hi GROUP BY 1, 2""", _MATCH),
    "ret6_by_country": q("SELECT Country, sold_value, coalesce(r, 0.0) AS returned_value, coalesce(r, 0.0) / sold_value AS value_return_rate FROM (SELECT Country, " + m("Revenue") + " AS sold_value FROM sales GROUP BY 1) LEFT JOIN (SELECT Country, -" + m("Revenue") + " AS r FROM rets GROUP BY 1) USING (Country) ORDER BY sold_value DESC, Country LIMIT 10"),
    "ret7_monthly": q("SELECT YearMonth, gross, coalesce(r, 0.0) AS returned, gross - coalesce(r, 0.0) AS net, coalesce(r, 0.0) / gross AS value_return_rate FROM (SELECT YearMonth, " + m("Revenue") + " AS gross FROM sales GROUP BY 1) LEFT JOIN (SELECT YearMonth, -" + m("Revenue") + " AS r FROM rets GROUP BY 1) USING (YearMonth)"),
    "ret8_concentration": q("""SELECT 10 AS top_n, CAST(sum(v) FILTER (rn <= 10) AS DOUBLE) / CAST(any_value(tot) AS DOUBLE) AS top_n_share, min(rn) FILTER (CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) >= 0.8) AS skus_to_80pct, count(*) AS n_returned_skus FROM
 (SELECT CAST(returned_value AS DECIMAL(18,6)) AS v, row_number() OVER w AS rn, sum(CAST(returned_value AS DECIMAL(18,6))) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(CAST(returned_value AS DECIMAL(18,6))) OVER () AS tot FROM skus WINDOW w AS (ORDER BY returned_value DESC, StockCode))""", _DESC, _SKU),
    "ret9_sku_export": q("SELECT StockCode, Description, sold_units, round_even(sold_value, 2) AS sold_value, returned_units, round_even(returned_value, 2) AS returned_value, round_even(100 * unit_return_rate, 2) AS unit_return_rate, round_even(100 * value_return_rate, 2) AS value_return_rate FROM skus", _DESC, _SKU),
    "rfm1_table": q("SELECT * FROM rfm0", _RFM),
    "rfm2_scores": q("SELECT * FROM rfm1", _RFM),
    "rfm3_segments": q("SELECT CustomerID, R, F, Segment FROM rfm2", _RFM),
    "rfm4_summary": q(f"""SELECT Segment, count(*) AS Customers, {m('Monetary')} AS Revenue, sum(RecencyDays) / count(*) AS AvgRecencyDays, sum(Frequency) / count(*) AS AvgFrequency, {m('Monetary')} / count(*) AS AvgMonetary, {m('Monetary')} / (SELECT {m('Monetary')} FROM rfm2) AS RevenueShare,
 CAST(list_position(['Champions','Loyal Customers','Potential Loyalist','New Customers','Need Attention','About to Sleep','At Risk','Can''t Lose Them','Hibernating','Lost'], Segment) AS INTEGER) AS pos FROM rfm2 GROUP BY 1""", _RFM),
    "coh1_assignment": q("SELECT CustomerID, CAST(ym AS INTEGER) AS ym, CAST(cohort AS INTEGER) AS cohort FROM ca", _COH),
    "coh2_last_complete_month": q("SELECT CAST(last_complete AS INTEGER) AS last_complete FROM lastc", _COH),
    "coh3_sizes": q("SELECT CAST(cohort AS INTEGER) AS cohort, size FROM csize", _COH),
    "coh4_triangle": q("SELECT CAST(cohort AS INTEGER) AS cohort, label, CAST(k AS INTEGER) AS k, size, active, retention FROM tri", _COH),
    "coh5_curve": q("SELECT CAST(k AS INTEGER) AS k, count(*) AS cohorts, CAST(sum(size) AS BIGINT) AS customers, sum(CASE WHEN k = 0 THEN size ELSE active END) / sum(size) AS retention FROM tri WHERE retention IS NOT NULL GROUP BY 1", _COH),
    "coh6_wide": q("SELECT CAST(cohort AS INTEGER) AS cohort, label, any_value(size) AS size, " + ", ".join(f"max(CASE WHEN k = {k} THEN retention * 100 END) AS m{k}" for k in range(13)) + " FROM tri GROUP BY 1, 2", _COH),
    "coh7_movement": q("""SELECT round(month_1, 10) AS month_1, round(month_6, 10) AS month_6, round(100 * (month_6 - month_1), 10) AS points, CASE WHEN abs(100 * (month_6 - month_1)) < 2 THEN 'holds' WHEN month_6 > month_1 THEN 'rises' WHEN month_6 < month_1 THEN 'falls' END AS verb
 FROM (SELECT sum(active) FILTER (k = 1) / sum(size) FILTER (k = 1) AS month_1, sum(active) FILTER (k = 6) / sum(size) FILTER (k = 6) AS month_6 FROM tri WHERE retention IS NOT NULL)""", _COH),
    "lif1_coverage": q("SELECT count(*) FILTER (f <= last) AS scored, count(*) FILTER (f > last) AS excluded FROM (SELECT CustomerID, min(ym) AS f FROM la GROUP BY 1), llast", _LIF),
    "lif4_stages": q("SELECT CustomerID, CAST(ym AS INTEGER) AS ym, stage, CAST(gap AS INTEGER) AS gap FROM cells", _LIF),
    "lif5_monthly": q("SELECT * FROM lmon3", _LIF),
    "lif6_flows": q("""SELECT f."from", t."to", count(c.stage) AS n FROM (VALUES ('(pre-acquisition)'), ('new'), ('retained'), ('resurrected'), ('at_risk'), ('dormant')) f("from"), (VALUES ('new'), ('retained'), ('resurrected'), ('at_risk'), ('dormant')) t("to")
 LEFT JOIN (SELECT stage, coalesce(lag(stage) OVER (PARTITION BY CustomerID ORDER BY ym), '(pre-acquisition)') AS src, ym FROM cells) c ON c.src = f."from" AND c.stage = t."to" AND c.ym > (SELECT min(ym) FROM cells) GROUP BY 1, 2""", _LIF),
    "lif7_gaps": q("SELECT count(*) AS n_gaps, quantile_cont(CAST(g AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(g AS DOUBLE), 0.75) AS p75, quantile_cont(CAST(g AS DOUBLE), 0.9) AS p90, count(*) FILTER (g <= 3) / count(*) AS share_within_dormancy FROM (SELECT ym - lag(ym) OVER (PARTITION BY CustomerID ORDER BY ym) AS g FROM lact) WHERE g IS NOT NULL", _LIF),
    "lif8_headline": q("SELECT count(*) AS months, sum(active) / count(*) AS mean_active, sum(new + resurrected) / sum(churned) AS pooled_quick_ratio, count(*) FILTER (quick_ratio >= 1) AS months_at_least_1 FROM (SELECT *, row_number() OVER (ORDER BY month) AS rn FROM lmon3) WHERE rn > 1", _LIF),
    "clv1_summary": q("SELECT * FROM summ", _CLV),
    "clv2_log_likelihood": q("""SELECT count(*) AS customers, round(sum(lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
 + CASE WHEN x > 0 THEN ln(exp(-(r + x) * ln(alpha + T) + (r + x) * ln(alpha + t_x)) + a / (b + x - 1)) - (r + x) * ln(alpha + t_x) ELSE -(r + x) * ln(alpha + T) END), 4) AS ll
 FROM (SELECT frequency AS x, recency AS t_x, T, 0.55 AS r, 12.0 AS alpha, 0.8 AS a, 2.5 AS b FROM summ)""", _CLV),
    "clv4_expected_purchases": q("SELECT CustomerID, round(predicted, 6) AS predicted FROM expected", _CLV, _expected("summ", "180").strip()),
    "clv5_tracking": q("""SELECT CAST(T // 90 AS INTEGER) AS age, CAST(sum(n) AS BIGINT) AS customers, round(sum(n * 2.3 / (0.8 - 1) * (1 - pow(12.0 / (12.0 + T), 0.55) * h)), 5) AS expected, CAST(sum(x) AS BIGINT) AS actual FROM ages JOIN gauss USING (T) GROUP BY 1""", _CLV,
      "ages AS (SELECT T, count(*) AS n, sum(frequency) AS x FROM summ GROUP BY 1)",
      "steps AS (SELECT T, CASE WHEN T > 0 THEN sum(ln((0.55 + k) * (2.5 + k) / ((2.3 + k) * (k + 1)) * T / (12.0 + T))) OVER (PARTITION BY T ORDER BY k) END AS s FROM ages, range(0, 9000) q(k) WHERE T > 0 OR k = 0)",
      "gauss AS (SELECT T, 1 + coalesce(sum(exp(s)), 0) AS h FROM steps GROUP BY T)"),
    "clv6_prob_alive": q("SELECT CustomerID, round(CASE WHEN x > 0 THEN 1 / (1 + 0.8 / (2.5 + x - 1) * pow((12.0 + T) / (12.0 + t_x), 0.55 + x)) ELSE 1.0 END, 8) AS prob_alive FROM (SELECT CustomerID, frequency AS x, recency AS t_x, T FROM summ)", _CLV),
    "clv7_value_log_likelihood": q("""SELECT count(*) AS customers, round(sum(lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1) * ln(z) + p * x * ln(x) - (p * x + q) * ln(v + x * z)), 4) AS ll, round(corr(x, z), 4) AS correlation, round(440.0 * 2.2 / 2.5, 4) AS population_mean
 FROM (SELECT frequency AS x, monetary_value AS z, 2.2 AS p, 3.5 AS q, 440.0 AS v FROM summ WHERE frequency > 0 AND monetary_value > 0)""", _CLV),
    "clv8_expected_value": q("SELECT CustomerID, round(CASE WHEN x > 0 THEN (1 - 2.2 * x / (2.2 * x + 2.5)) * (440.0 * 2.2 / 2.5) + 2.2 * x / (2.2 * x + 2.5) * mv ELSE 440.0 * 2.2 / 2.5 END, 6) AS expected_value FROM (SELECT CustomerID, frequency AS x, monetary_value AS mv FROM summ)", _CLV),
    "clv10_holdout_actuals": q("SELECT CustomerID, frequency, recency, T, actual FROM hold", _WIN, _HOLD),
    "clv10_accuracy": q("SELECT count(*) AS customers, round(sum(predicted), 6) AS predicted_total, CAST(sum(actual) AS BIGINT) AS actual_total, round(sum(predicted) / sum(actual), 6) AS ratio, round(sum(abs(predicted - actual)) / count(*), 6) AS mae, round(corr(predicted, actual), 6) AS correlation FROM expected JOIN hold USING (CustomerID)", _WIN, _HOLD, _expected("hold", "date_diff('day', (SELECT calibration_end FROM win), (SELECT holdout_end FROM win))").strip()),
    "clv11_by_frequency": q("SELECT CASE WHEN frequency >= 5 THEN '5+' ELSE CAST(frequency AS VARCHAR) END AS cal_frequency, count(*) AS customers, sum(actual) / count(*) AS actual_mean FROM hold GROUP BY 1", _WIN, _HOLD),
    "clv12_window": q("SELECT strftime(calibration_end, '%Y-%m-%d') AS calibration_end, strftime(holdout_end, '%Y-%m-%d') AS holdout_end FROM win", _WIN),
    "clv13_concentration": q("""SELECT CAST(max(k) AS BIGINT) AS k, CAST(sum(v) FILTER (rn <= k) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top_share FROM (SELECT CAST(Monetary AS DECIMAL(18,6)) AS v, row_number() OVER (ORDER BY Monetary DESC, CustomerID) AS rn, greatest(1, CAST(round_even(0.1 * count(*) OVER (), 0) AS BIGINT)) AS k FROM rfm0)""", _RFM),
    "clv14_lorenz": q("""SELECT CAST(point AS INTEGER) AS point, max(rn) / max(n) AS customer_share, CAST(max(c) AS DOUBLE) / CAST(max(tot) AS DOUBLE) AS value_share FROM (SELECT CAST(ceil(rn * 20 / n) AS INTEGER) AS point, rn, n, c, tot FROM (SELECT row_number() OVER w AS rn, count(*) OVER () AS n, sum(CAST(Monetary AS DECIMAL(18,6))) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(CAST(Monetary AS DECIMAL(18,6))) OVER () AS tot FROM rfm0 WINDOW w AS (ORDER BY Monetary, CustomerID))) GROUP BY 1 UNION ALL SELECT 0, 0.0, 0.0""", _RFM),
    "fc1_weekly_revenue": q("SELECT strftime(week, '%Y-%m-%d') AS week, value, CAST(t AS INTEGER) AS t FROM weeks", _WEEKS),
    "fc7_folds": q("SELECT CAST(fold AS INTEGER) AS fold, CAST(origin AS INTEGER) AS origin FROM folds", _WEEKS, _FOLDS),
    "fc3_holt_winters": q("SELECT job AS series, 'holt_winters_fixed' AS model, CAST(step AS INTEGER) AS step, round(forecast, 6) AS forecast FROM ahead", *_CODE_WEEKS, _CODE_ROWS, _SERIES, f"jobs AS (SELECT StockCode AS job, y, al, be, ga FROM ys, {_GRID} WHERE n = 0)", _SMOOTH.strip()).replace("WITH", "WITH RECURSIVE", 1),
    "fc4_tuned_holt_winters": q("SELECT StockCode AS series, 'holt_winters' AS model, CAST(step AS INTEGER) AS step, round(forecast, 6) AS forecast FROM tried LEFT JOIN best USING (StockCode) JOIN ahead USING (job) WHERE whole AND tried.n = coalesce(best.n, 0)", *_CODE_WEEKS, _CODE_ROWS, _SERIES, _TUNED.strip(), _SMOOTH.strip(), _BEST.strip()).replace("WITH", "WITH RECURSIVE", 1),
    "fc6_baseline_errors": q("SELECT CAST(fold AS INTEGER) AS fold, model, round(mae, 2) AS mae, round(mase, 6) AS mase FROM berr", _WEEKS, _FOLDS, _BERR),
    "fc8_baseline_summary": q("""SELECT s.*, coalesce(w.fold_wins, 0) AS fold_wins FROM (SELECT model, count(DISTINCT fold) AS folds, round(avg(mase), 6) AS mean_mase, round(max(mase), 6) AS worst_mase, round(avg(mae), 2) AS mean_mae FROM berr GROUP BY 1) s
 LEFT JOIN (SELECT model, count(*) AS fold_wins FROM (SELECT fold, model FROM berr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mase, model) = 1) GROUP BY 1) w USING (model)""", _WEEKS, _FOLDS, _BERR),
    "fc10_code_weeks": q("SELECT * FROM cweeks", *_CODE_WEEKS),
    "fc10_top_code_forecasts": q("""SELECT StockCode, coalesce(Description, '') AS Description, CAST(n AS BIGINT) AS TotalUnits, CAST(len AS INTEGER) AS WeeksActive, round(zeros / len, 6) AS ZeroWeekShare,
      round(e1 / nullif(walk, 0), 6) AS mase_naive, round(e2 / nullif(walk, 0), 6) AS mase_seasonal_naive, round(e3 / nullif(walk, 0), 6) AS mase_ma4,
      CASE WHEN coalesce(walk, 0) = 0 THEN 'n/a (single-spike demand)' WHEN e1 <= e2 AND e1 <= e3 THEN 'naive' WHEN e2 <= e3 THEN 'seasonal_naive' ELSE 'ma4' END AS best_model
      FROM cerr JOIN topc USING (StockCode) LEFT JOIN sdescs USING (StockCode)""", *_CODE_WEEKS, _SDESC.strip(), _CODE_ERRORS.strip()),
    "fc10_series_forecasts": q("""SELECT StockCode AS series, model, CAST(step AS INTEGER) AS step, round(forecast, 6) AS forecast FROM (
      SELECT StockCode, 'naive' AS model, i AS step, CAST(units AS DOUBLE) AS forecast FROM cy, range(1, 13) s(i) WHERE k = len - 1
      UNION ALL SELECT StockCode, 'seasonal_naive', i, CAST(units AS DOUBLE) FROM cy, range(1, 13) s(i) WHERE k = CASE WHEN len >= 52 THEN len - 52 + (i - 1) % 52 ELSE len - 1 END
      UNION ALL SELECT StockCode, 'ma4', any_value(i), avg(units) FROM cy, range(1, 13) s(i) WHERE k >= len - 4 GROUP BY StockCode, i)""", *_CODE_WEEKS, _CODE_ROWS),
    "bsk2_catalog": q("SELECT * FROM cat", _ITEMS),
    "bsk3_survivors": q("""SELECT (SELECT count(DISTINCT Invoice) FROM sales) AS invoices_total, count(*) AS invoices_with_tracked_item, count(*) FILTER (n >= 2) AS baskets_mined, (SELECT count(*) FROM cat) AS stock_codes_tracked, (SELECT count(DISTINCT Item) FROM cat) AS items_after_description_merge,
 coalesce(sum(n) FILTER (n >= 2) / count(*) FILTER (n >= 2), 0.0) AS mean_basket_size FROM (SELECT Invoice, count(*) AS n FROM items GROUP BY 1)""", _ITEMS),
    "bsk5_itemsets": q("SELECT size, a, b, c, count, count / (SELECT n FROM nb)::DOUBLE AS support FROM sets", _ITEMS),
    "bsk9_fp_growth": q("SELECT size, a, b, c, count FROM sets", _ITEMS),
    "bsk7_rules": q("SELECT antecedent, consequent, itemset, round(support, 8) AS support, round(confidence, 8) AS confidence, round(lift, 8) AS lift, round(leverage, 8) AS leverage, round(conviction, 8) AS conviction, support_count, thin_support FROM rules", _ITEMS, _RULES),
    "bsk8_best_rules": q("SELECT antecedent, consequent, itemset, round(lift, 8) AS lift FROM rules QUALIFY row_number() OVER (PARTITION BY itemset ORDER BY lift DESC, confidence DESC, antecedent, consequent) = 1", _ITEMS, _RULES),
    "prc4_qualifying": q("SELECT * FROM qual", _SDESC, _PR),
    "prc5_ladder": q("SELECT StockCode, Price, lines, units, revenue, unit_share, is_posted FROM lad", _SDESC, _PR),
    "prc6_profile": q("SELECT StockCode, Description, rungs, lines, units, revenue, posted_price, realized_price, realization, round(price_p10, 8) AS price_p10, round(price_p90, 8) AS price_p90, round(spread, 8) AS spread, unit_share_below, unit_share_at, unit_share_above FROM prof", _SDESC, _PR),
    "prc7_weekly": q("SELECT StockCode, week, posted_price, units, round(log_price, 8) AS log_price, round(log_units, 8) AS log_units, round(log_units_adj, 8) AS log_units_adj FROM panel", _SDESC, _PR, _PANEL),
    "prc8_within_week": q("SELECT StockCode, round(slope_within_week, 6) AS slope_within_week FROM within_week", _SDESC, _PR, _PANEL),
    "prc10_slopes": q("SELECT StockCode, weeks, week_prices, round(slope_within_week, 6) AS slope_within_week, round(slope_between_week, 6) AS slope_between_week, round(slope_market_adj, 6) AS slope_market_adj FROM sl", _SDESC, _PR, _PANEL),
    "prc11_overview": q("""SELECT n_skus, n_multi_price_skus, n_multi_price_skus / n_skus AS multi_price_share, n_qualifying, qualifying_revenue, qualifying_revenue / all_revenue AS qualifying_revenue_share, median_rungs, round(median_spread, 8) AS median_spread, round(b, 8) AS unit_share_below, round(a, 8) AS unit_share_at, round(o, 8) AS unit_share_above,
 round(revenue_at_posted, 4) AS revenue_at_posted, round(qualifying_revenue / revenue_at_posted, 8) AS realization, n_fitted, round(ms, 6) AS median_slope_within_week, round(mb, 6) AS median_slope_between_week, round(ma, 6) AS median_slope_market_adj, share_slope_negative, round(cor, 6) AS slope_agreement_corr
 FROM (SELECT count(*) AS n_skus, count(*) FILTER (p > 1) AS n_multi_price_skus FROM (SELECT StockCode, count(DISTINCT Price) AS p FROM sales GROUP BY 1)), (SELECT """ + m("Revenue") + """ AS all_revenue FROM sales),
 (SELECT count(*) AS n_qualifying, """ + m("revenue") + """ AS qualifying_revenue, median(rungs)::DOUBLE AS median_rungs, median(spread) AS median_spread, sum(unit_share_below * units) / sum(units) AS b, sum(unit_share_at * units) / sum(units) AS a, sum(unit_share_above * units) / sum(units) AS o, sum(posted_price * units) AS revenue_at_posted FROM prof),
 (SELECT count(*) AS n_fitted, median(slope_within_week) AS ms, median(slope_between_week) AS mb, median(slope_market_adj) AS ma, count(*) FILTER (slope_market_adj < 0) / count(*) AS share_slope_negative, corr(slope_within_week, slope_market_adj) AS cor FROM sl WHERE slope_within_week IS NOT NULL AND slope_market_adj IS NOT NULL)""", _SDESC, _PR, _PANEL),
    "prc12_export": q("""SELECT StockCode, Description, rungs, lines, units, round_even(revenue, 2) AS revenue, round_even(posted_price, 4) AS posted_price, round_even(realized_price, 4) AS realized_price, round_even(100 * realization, 2) AS realization_pct, round_even(price_p10, 4) AS price_p10, round_even(price_p90, 4) AS price_p90, round_even(spread, 3) AS spread,
 round_even(100 * unit_share_below, 2) AS unit_share_below_pct, round_even(100 * unit_share_at, 2) AS unit_share_at_pct, round_even(100 * unit_share_above, 2) AS unit_share_above_pct, weeks, round_even(slope_within_week, 4) AS slope_within_week, round_even(slope_between_week, 4) AS slope_between_week, round_even(slope_market_adj, 4) AS slope_market_adj FROM prof LEFT JOIN sl USING (StockCode)""", _SDESC, _PR, _PANEL),
    "qlt5_domain": q(f"""SELECT 'Validity' AS dimension, 'domain: Country' AS "check", count(*) FILTER (Country NOT IN {EUROPE}) AS violations, count(Country) AS evaluated FROM raw"""),
    "qlt7_inferred_findings": q(_inferred_findings()),
    "qlt_findings": q('SELECT dimension, "check", violations, evaluated FROM found', _FIND),
    "qlt_scores": q('SELECT dimension, "check", CAST(score AS DOUBLE) AS score, status FROM st', _FIND),
    "qlt13_dimensions": q("SELECT dimension, count(*) AS checks, CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS score, CASE max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS status FROM st GROUP BY 1", _FIND),
    "qlt13_raw_scorecard": q(_GRADED, _card("raw")),
    "qlt13_sales_scorecard": q(_GRADED, _card("sales")),
}
ORACLES["qlt14_compared"] = f"""SELECT coalesce(a.dimension, b.dimension) AS dimension, a.score AS before, b.score AS after FROM
 (SELECT dimension, score FROM ({ORACLES["qlt13_raw_scorecard"]}) UNION ALL SELECT 'overall', any_value(total) FROM ({ORACLES["qlt13_raw_scorecard"]})) a FULL JOIN
 (SELECT dimension, score FROM ({ORACLES["qlt13_sales_scorecard"]}) UNION ALL SELECT 'overall', any_value(total) FROM ({ORACLES["qlt13_sales_scorecard"]})) b ON a.dimension = b.dimension"""
