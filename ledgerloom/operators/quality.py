"""A scorecard for any table: declared expectations compile to one aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import percentiles

# Dimensions with weights, thresholds, grades.
WEIGHTS = {"Completeness": 0.30, "Validity": 0.25, "Consistency": 0.20, "Uniqueness": 0.15, "Plausibility": 0.10}
HARD = ("Completeness", "Validity", "Uniqueness", "Consistency")
WARN_BELOW, FAIL_BELOW = 99.5, 97.0
GRADES = ((95.0, "A"), (90.0, "B"), (80.0, "C"), (70.0, "D"), (0.0, "F"))
CAP = {"warn": "B", "fail": "C"}
ORDER = ("pass", "warn", "fail")
NUMBERS = ("numeric", "float", "integer", "int", "number")


@dataclass(frozen=True)
class ColumnRule:
    expected_type: str | None = None
    required: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    op: str
    value: object = None
    other_column: str | None = None
    typed: bool = False  # compare as the column's own type, not as numbers


@dataclass(frozen=True)
class QualityConfig:
    columns: Mapping[str, ColumnRule] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    key_columns: tuple[str, ...] | None = None
    dedup_columns: tuple[str, ...] | None = None
    plausibility_columns: tuple[str, ...] | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    warn_below: float = WARN_BELOW
    fail_below: float = FAIL_BELOW


def score(bad: int, n: int) -> float:
    return 100.0 if n <= 0 else round(100.0 * (1.0 - bad / n), 1)


def status(value: float, warn: float = WARN_BELOW, fail: float = FAIL_BELOW) -> str:
    return "fail" if value < fail else "warn" if value < warn else "pass"


def grade(value: float) -> str:
    return next((g for cut, g in GRADES if value >= cut), "F")


def capped(letter: str, worst: str) -> str:
    return max(letter, CAP.get(worst, letter))  # letters grow worse in order


def _number(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def default_config(df: DataFrame) -> QualityConfig:
    """Every column required, of its own type; numbers finite and plausible."""
    kinds, numbers = {}, []
    for f in df.schema.fields:
        d = f.dataType
        kind = "boolean" if isinstance(d, T.BooleanType) else "integer" if isinstance(d, T.IntegralType) else "numeric" if isinstance(d, T.NumericType) else "datetime" if isinstance(d, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "string"
        kinds[f.name] = ColumnRule(expected_type=kind, required=True)
        if isinstance(d, T.NumericType):
            numbers.append(f.name)
    return QualityConfig(columns=kinds, rules=tuple(Rule(f"{c} is finite", c, "finite") for c in numbers), plausibility_columns=tuple(numbers))


def type_violation(c: Column, expected: str) -> Column:
    kind = expected.lower()
    if kind in NUMBERS:
        n = _number(c.cast("string"))
        bad = n.isNull()
        return bad | (n != F.bround(n, 0)) if kind in ("integer", "int") else bad
    if kind in ("datetime", "date", "timestamp"):
        return c.cast("string").try_cast("timestamp").isNull()
    if kind in ("boolean", "bool"):
        return ~F.lower(c.cast("string")).isin("true", "false", "0", "1", "0.0", "1.0")
    return F.lit(False)


def _outside(n: Column, lo, hi) -> Column:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (n < F.lit(float(lo)))
    if hi is not None:
        bad = bad | (n > F.lit(float(hi)))
    return bad


def _full(pattern: str, c: Column) -> Column:
    return c.cast("string").rlike(f"^(?:{pattern})$")


def _rule(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """(violation, evaluated) of a consistency rule."""
    if rule.column not in df.columns or (rule.other_column is not None and rule.other_column not in df.columns):
        return F.lit(True), F.lit(True)
    c = _present(df, rule.column)
    if rule.op == "notnull":
        return c.isNull(), F.lit(True)
    if rule.op == "finite":
        n = _number(c)
        return F.abs(n) == float("inf"), n.isNotNull()
    if rule.op == "regex":
        return ~_full(str(rule.value), c), c.isNotNull()
    if rule.op == "in":
        return ~c.isin(*rule.value), c.isNotNull()
    if rule.op == "between":
        lo, hi = rule.value
        if isinstance(df.schema[rule.column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            t = c.cast("timestamp")
            return (t < F.lit(lo).cast("timestamp")) | (t > F.lit(hi).cast("timestamp")), t.isNotNull()
        n = _number(c)
        return _outside(n, lo, hi), n.isNotNull()
    tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    if rule.op not in tests:
        raise ValueError(f"unknown consistency op: {rule.op!r}")
    if rule.typed:
        a, b = c, _present(df, rule.other_column) if rule.other_column is not None else F.lit(rule.value)
    else:
        a = _number(c.cast("string"))
        b = _number(_present(df, rule.other_column).cast("string")) if rule.other_column is not None else _number(F.lit(rule.value).cast("string"))
    return ~tests[rule.op](a, b), a.isNotNull() & b.isNotNull()


def checks(df: DataFrame, config: QualityConfig) -> list[tuple[str, str, Column, Column]]:
    """(dimension, check, violations, evaluated) as aggregates over one pass, outliers and duplicates aside."""
    out = []
    add = lambda dim, name, bad, seen: out.append((dim, name, F.count_if(bad & seen), F.count_if(seen)))
    every, required = F.lit(True), []
    for name, rule in config.columns.items():
        if name not in df.columns:
            if rule.required:
                required.append((F.count("*"), F.count("*")))
                out.append(("Completeness", f"required: {name}", F.count("*"), F.count("*")))
            out.append(("Validity", f"column present: {name}", F.lit(1), F.lit(1)))
            continue
        c = _present(df, name)
        some = c.isNotNull()
        if rule.required:
            required.append((F.count_if(c.isNull()), F.count("*")))
            add("Completeness", f"required: {name}", c.isNull(), every)
        if rule.expected_type:
            add("Validity", f"type={rule.expected_type}: {name}", type_violation(c, rule.expected_type), some)
        if rule.min_value is not None or rule.max_value is not None:
            n = _number(c.cast("string"))
            add("Validity", f"range [{rule.min_value}, {rule.max_value}]: {name}", _outside(n, rule.min_value, rule.max_value), n.isNotNull())
        if rule.allowed is not None:
            add("Validity", f"domain: {name}", ~c.isin(*rule.allowed), some)
        if rule.regex is not None:
            add("Validity", f"regex: {name}", ~_full(rule.regex, c), some)
    if required:
        bad, seen = required[0]
        for b, s in required[1:]:
            bad, seen = bad + b, seen + s
        out.append(("Completeness", "all required cells", bad, seen))
    for rule in config.rules:
        add("Consistency", rule.name, *_rule(df, rule))
    return out


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: (bad, n): rows beyond the first of each group, nulls being equal."""
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("bad"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: for each column, values beyond three interquartile ranges and values seen; none with fewer than 4 values or no spread."""
    num = {c: _number(_present(df, c).cast("string")) for c in names}
    both = df.select(*[num[c].alias(f"v{i}") for i, c in enumerate(names)]).crossJoin(F.broadcast(percentiles(df, list(num.values()), [0.25, 0.75])))  # one row

    def far(i):
        a, b = F.get(f"q{i}", F.lit(0)), F.get(f"q{i}", F.lit(1))
        return (F.col(f"n{i}") >= 4) & (b > a) & ((F.col(f"v{i}") < a - 3 * (b - a)) | (F.col(f"v{i}") > b + 3 * (b - a)))

    return both.agg(*[e for i in range(len(names)) for e in (F.count_if(far(i)).alias(f"bad{i}"), F.count(f"v{i}").alias(f"n{i}"))])


def findings(df: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """(dimension, check, violations, evaluated): all checks; column checks in one aggregation."""
    config = config or default_config(df)
    spark = df.sparkSession
    parts = []
    if listed := checks(df, config):
        row = df.agg(*[e for i, (_, _, bad, n) in enumerate(listed) for e in (bad.cast("long").alias(f"b{i}"), n.cast("long").alias(f"n{i}"))])
        each = [F.struct(F.lit(d).alias("dimension"), F.lit(name).alias("check"), F.col(f"b{i}").alias("violations"), F.col(f"n{i}").alias("evaluated")) for i, (d, name, _, _) in enumerate(listed)]
        parts.append(row.select(F.explode(F.array(*each)).alias("x")).select("x.*"))
    one = lambda frame, name: frame.where("n > 0").select(F.lit("Uniqueness").alias("dimension"), F.lit(name).alias("check"), F.col("bad").cast("long").alias("violations"), F.col("n").cast("long").alias("evaluated"))
    unique = df.columns if config.dedup_columns is None else [c for c in config.dedup_columns if c in df.columns]
    if unique:
        parts.append(one(duplicates(df, list(unique)), "duplicate rows"))
    if keys := [c for c in config.key_columns or () if c in df.columns]:
        parts.append(one(duplicates(df, keys), f"unique key: {'+'.join(keys)}"))
    if names := [c for c in config.plausibility_columns or () if c in df.columns]:
        each = [F.struct(F.lit("Plausibility").alias("dimension"), F.lit(f"3xIQR: {c}").alias("check"), F.col(f"bad{i}").alias("violations"), F.col(f"n{i}").alias("evaluated")) for i, c in enumerate(names)]
        parts.append(outliers(df, names).select(F.explode(F.array(*each)).alias("x")).select("x.*"))
    if not parts:
        return spark.createDataFrame([], "dimension string, check string, violations long, evaluated long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(found: DataFrame, config: QualityConfig) -> DataFrame:
    """Findings with score and status; plausibility never fails."""
    s = F.when(F.col("evaluated") > 0, F.bround(100.0 * (1.0 - F.col("violations") / F.nullif(F.col("evaluated"), F.lit(0))), 1)).otherwise(100.0)
    level = F.when(F.col("score") < config.fail_below, "fail").when(F.col("score") < config.warn_below, "warn").otherwise("pass")
    return found.withColumn("score", s).withColumn("status", F.when((F.col("dimension") == "Plausibility") & (level == "fail"), "warn").otherwise(level))


def by_dimension(rows: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("status"))
    return rows.groupBy("dimension").agg(F.count("*").alias("checks"), (F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("score"), F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.max(rank).cast("int")).alias("status"))


@dataclass(frozen=True)
class Scorecard:
    score: float
    grade: str
    dimensions: dict[str, tuple[float, str]]
    findings: list[dict]
    thresholds: tuple[float, float] = (WARN_BELOW, FAIL_BELOW)

    def render(self) -> str:
        lines = [f"Quality {self.grade} ({self.score:.1f}); pass from {self.thresholds[0]}, fail below {self.thresholds[1]}. A heuristic card of declared checks, no proof of correctness."]
        lines += [f"  {d}: {s:.1f} {st}" for d, (s, st) in self.dimensions.items()]
        return "\n".join(lines + [f"    {f['dimension']} / {f['check']}: {f['violations']} of {f['evaluated']} ({f['status']})" for f in self.findings if f["status"] != "pass"])


def assess(df: DataFrame, config: QualityConfig | None = None) -> Scorecard:
    """Weighted score and capped grade. An empty table scores 0, grade F."""
    config = config or default_config(df)
    if not df.take(1):
        return Scorecard(0.0, "F", {}, [], (config.warn_below, config.fail_below))
    rows = [r.asDict() for r in scored(findings(df, config), config).collect()]
    dims: dict[str, tuple[float, str]] = {}
    for d in WEIGHTS:
        own = [r for r in rows if r["dimension"] == d]
        if own:
            dims[d] = (sum(r["score"] for r in own) / len(own), max((r["status"] for r in own), key=ORDER.index))
    weight = sum(config.weights.get(d, 0.0) for d in dims)
    value = round(sum(config.weights.get(d, 0.0) * s for d, (s, _) in dims.items()) / weight, 1) if weight else 0.0
    worst = max((st for d, (_, st) in dims.items() if d in HARD), key=ORDER.index, default="pass")
    return Scorecard(value, capped(grade(value), worst), dims, rows, (config.warn_below, config.fail_below))


def compare(before: Scorecard, after: Scorecard) -> list[tuple[str, float | None, float | None]]:
    """(dimension, score before, score after), the total first."""
    dims = [d for d in WEIGHTS if d in before.dimensions or d in after.dimensions]
    return [("overall", before.score, after.score), *[(d, before.dimensions.get(d, (None,))[0], after.dimensions.get(d, (None,))[0]) for d in dims]]


def retail_config() -> QualityConfig:
    """Expectations on transaction lines; unknown customers and descriptions may be null."""
    from .cleaning import KEY

    return QualityConfig(
        columns={
            "Invoice": ColumnRule("string", True, regex=r"[A-Za-z]?\d+"),
            "StockCode": ColumnRule("string", True),
            "Description": ColumnRule("string"),
            "Quantity": ColumnRule("integer", True),
            "InvoiceDate": ColumnRule("datetime", True),
            "Price": ColumnRule("numeric", True, min_value=0.0),
            "CustomerID": ColumnRule("numeric"),
            "Country": ColumnRule("string", True),
        },
        rules=(Rule("Quantity is positive", "Quantity", ">", 0), Rule("Price is positive", "Price", ">", 0), Rule("InvoiceDate within window", "InvoiceDate", "between", ("2009-01-01", "2012-01-01"))),
        dedup_columns=tuple(KEY),
        plausibility_columns=("Quantity", "Price"),
    )
