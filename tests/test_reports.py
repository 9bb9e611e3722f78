import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.__main__ import main
from ledgerloom.operators import cohort, pricing
from ledgerloom.plans import reports
from ledgerloom.sources.adapter import raw_lines
from ledgerloom.sources.lines import sample_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "raw.parquet")
    raw_lines(spark, SF).write.parquet(path)
    return path


def test_all_reports_are_written(spark, lines, tmp_path, capsys):
    assert main([str(tmp_path / "absent.parquet"), str(tmp_path / "out"), "--sample", lines]) == 0
    said = capsys.readouterr().out
    assert "does not exist" in said
    made = {os.path.basename(p) for p in glob.glob(str(tmp_path / "out" / "*"))}
    assert made == {"cohort_triangle.csv", "lifecycle_monthly.csv", "lifecycle_flows.csv", "customer_value.csv", "returns_by_sku.csv", "price_profile.csv", "workbook", "report_card", "headlines"}
    card = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "report_card")).collect())
    assert "# Data quality" in card and "| overall |" in card
    assert len(spark.read.text(str(tmp_path / "out" / "headlines")).collect()) >= 3
    assert {os.path.basename(p) for p in glob.glob(str(tmp_path / "out" / "workbook" / "*"))} >= {"CleaningReport", "RFM", "Cohort", "CLV", "DataQuality", "WeeklyRevenue"}
    first = spark.read.option("header", True).csv(str(tmp_path / "out" / "returns_by_sku.csv"))
    prices = spark.read.option("header", True).csv(str(tmp_path / "out" / "price_profile.csv"))
    assert prices.columns[:6] == ["StockCode", "Description", "rungs", "lines", "units", "revenue"] and prices.columns[-1] == "perm_p" and "realization_pct" in prices.columns
    assert first.count() == reports.sku_export(reports.frames_of(spark.read.parquet(lines))).count()


def test_absent_lines_without_a_sample_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reports.load_or_sample(spark, str(tmp_path / "absent.parquet"))


def test_a_sample_keeps_every_stratum(spark):
    df = spark.createDataFrame([(i, "common") for i in range(2000)] + [(1, "rare"), (2, "none"), (3, None)], "id long, kind string")
    got = sample_lines(df, 0.1, 42, "kind").groupBy("kind").count().collect()
    count = {r["kind"]: r["count"] for r in got}
    assert set(count) == {"common", "rare", "none", None} and 120 < count["common"] < 280
    assert sample_lines(df, 0.1, 42, "kind").count() == sum(count.values())


def test_a_cached_run_of_one_analysis(spark, lines, tmp_path, capsys):
    """The second run reads the store and writes the same bytes."""
    said, bytes_ = [], []
    for out in ("a", "b"):
        assert main([lines, str(tmp_path / out), "--cache", str(tmp_path / "cache"), "--only", "returns", "cohort"]) == 0
        said.append(capsys.readouterr().out)
        assert sorted(os.listdir(tmp_path / out)) == ["cohort_triangle.csv", "returns_by_sku.csv"]
        bytes_.append([(tmp_path / out / n).read_bytes() for n in sorted(os.listdir(tmp_path / out))])
    assert "stored at" in said[0] and said[1].startswith("the store at") and bytes_[0] == bytes_[1]
    assert bytes_[0][1].startswith(b"StockCode,Description,sold_units,sold_value,returned_units,returned_value")
    assert main([str(tmp_path / "none.parquet"), str(tmp_path / "c"), "--cache", str(tmp_path / "other"), "--sample", lines, "--only", "cohort"]) == 0
    assert "does not exist" in capsys.readouterr().out and not os.path.exists(tmp_path / "other")


def test_movement_of_retention(spark):
    cells = lambda *rows: cohort.movement(spark.createDataFrame([(24000, k, 100, a, a / 100) for k, a in rows], "cohort int, k int, size long, active long, retention double"))
    assert cells((1, 40), (6, 30)).first().verb == "falls" and cells((1, 30), (6, 40)).first().verb == "rises"
    held = cells((1, 40), (6, 41)).first()
    assert held.verb == "holds" and abs(held.points - 1) < 1e-9
    none = cells((1, 40)).first()
    assert none.points is None and none.verb is None and none.month_1 == 0.4


def test_price_export_without_its_permutation_test(spark, lines):
    f = reports.frames_of(spark.read.parquet(lines))
    config = pricing.PricingConfig(min_lines=100)
    with_p, without_p = reports.price_export(f, config), reports.price_export(f, config, permute=False)
    assert with_p.columns == [*without_p.columns, "perm_p"]
    assert sorted(map(tuple, with_p.drop("perm_p").collect()), key=str) == sorted(map(tuple, without_p.collect()), key=str)
