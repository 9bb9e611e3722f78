"""Workbooks, the store of cleaned lines and what it spares."""

import io
import os
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning, clv, cohort, rfm
from ledgerloom.sources import lines, store, workbook
from ledgerloom.sources.adapter import raw_lines

SF = "/root/testdata/sf0.001"
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made_book(path, date1904=False):
    """Two sheets: shared and inline strings, dates, gaps, rich text, an error, a column that one sheet lacks, and an empty row."""
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN}><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="Year 1" sheetId="1" r:id="rId1"/><sheet name="Year 2" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {MAIN}>" + "".join(f"<si>{x}</si>" for x in ["<t>Invoice</t>", "<t>StockCode</t>", "<t>Description</t>", "<t>Quantity</t>", "<t>InvoiceDate</t>", "<t>Price</t>", "<t>Customer ID</t>", "<t>Country</t>", "<r><t>Rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t>UK</t>"]) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>"
        '<row r="1">' + "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDEFGH")) + "</row>"
        '<row r="2"><c r="A2"><v>489434</v></c><c r="B2" t="inlineStr"><is><t>85048</t></is></c><c r="C2" t="s"><v>8</v></c><c r="D2"><v>12.0</v></c><c r="E2" s="1"><v>40148.322916666664</v></c><c r="F2" s="2"><v>6.95</v></c><c r="G2"><v>13085</v></c><c r="H2" t="s"><v>9</v></c></row>'
        '<row r="3"/>'
        '<row r="4"><c r="A4" t="str"><v>C489449</v></c><c r="B4"><v>22087</v></c><c r="D4"><v>-12</v></c><c r="E4" s="3"><v>40148.5</v></c><c r="F4"><v>2.95</v></c><c r="G4" t="e"><v>#N/A</v></c><c r="H4" t="s"><v>9</v></c></row>'
        "</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {MAIN}><sheetData>"
        '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>3</v></c><c t="s"><v>4</v></c><c t="s"><v>5</v></c><c t="s"><v>7</v></c></row>'
        '<row><c><v>536365</v></c><c t="inlineStr"><is><t>DOT</t></is></c><c><v>6</v></c><c s="1"><v>40513</v></c><c><v>2.55</v></c><c t="s"><v>9</v></c></row>'
        "</sheetData></worksheet>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


@pytest.mark.parametrize("date1904", [False, True])
def test_workbook(spark, tmp_path, date1904):
    path = str(tmp_path / "lines.xlsx")
    made_book(path, date1904)
    df = workbook.read_workbook(spark, path)
    assert df.columns == ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country", "SourceSheet"]
    assert df.rdd.getNumPartitions() == 2  # a sheet each
    got = sorted(tuple(r) for r in df.fillna("-").collect())
    year = "2013-12-02" if date1904 else "2009-12-01"
    assert got[0] == ("489434", "85048", "Rich text", "12", f"{year} 07:45:00", "6.95", "13085", "UK", "Year 1")
    assert got[2] == ("C489449", "22087", "-", "-12", f"{year} 12:00:00", "2.95", "-", "UK", "Year 1")
    assert got[1][2] == "-" and got[1][8] == "Year 2" and len(got) == 3
    assert workbook.read_workbook(spark, path, "Year 2").count() == 1
    typed = lines.load_lines(spark, path)
    rows = {r["Invoice"]: r for r in typed.collect()}
    assert rows["489434"]["Quantity"] == 12 and rows["489434"]["CustomerID"] == 13085 and rows["489434"]["SourceSheet"] == "Year 1"
    assert rows["536365"]["CustomerID"] is None and rows["536365"]["InvoiceDate"].year == (2014 if date1904 else 2010)


def test_workbooks_without_strings_and_absent_ones(spark, tmp_path):
    path = tmp_path / "bare.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
    assert workbook.read_workbook(spark, f"file://{path}").collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        workbook.read_workbook(spark, str(tmp_path / "none.xlsx"))
    assert [workbook._column(c) for c in ("A1", "Z9", "AA10", "BC2")] == [0, 25, 26, 54]


def test_rows_stream(tmp_path):
    """A long sheet is read without being held: the tree stays small."""
    path = str(tmp_path / "long.xlsx")
    body = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(20_000))
    stream = io.BytesIO(f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>".encode())
    kept = []
    for e in workbook._rows_of(stream, "row"):
        kept.append(next(iter(e))[0].text)
    assert kept == [str(i) for i in range(20_000)]
    assert not os.path.exists(path)


# ---- the store ---------------------------------------------------------------


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "raw.parquet")
    raw_lines(spark, SF).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def at(spark, source, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store") / "cleaned")
    store.stored(spark, at, [source], lambda: lines.load_lines(spark, source), buckets=4)
    return at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_second_run_reads_the_store(spark, source, at):
    def never():
        raise AssertionError("the source was read")

    f, said = store.stored(spark, at, [source], never)
    assert said.startswith("the store at")
    fresh = cleaning.clean(lines.load_lines(spark, source))
    for name in ("sales", "returns"):
        mine, want = getattr(f, name), getattr(fresh, name)
        assert mine.columns == want.columns and mine.dtypes == want.dtypes
        assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0
    assert sorted(map(tuple, f.log.collect()), key=repr) == sorted(map(tuple, fresh.log.collect()), key=repr)
    assert f.raw.count() == lines.load_lines(spark, source).count()


def test_a_new_session_declares_the_tables_again(spark, source, at):
    before = dict(store._TABLES)
    store._TABLES.clear()
    try:
        f = store.read(spark, at)
        assert f.sales.count() == cleaning.clean(lines.load_lines(spark, source)).sales.count()
        assert "Exchange" not in plan(f.sales.where("CustomerID IS NOT NULL").groupBy("CustomerID").count()).split("Initial Plan")[-1]
    finally:
        store._TABLES.update(before)


def test_a_changed_source_is_read_again(spark, source, tmp_path):
    mine, at = str(tmp_path / "raw.parquet"), str(tmp_path / "store")
    part = spark.read.parquet(source).limit(40)
    part.write.parquet(mine)
    calls = []

    def load():
        calls.append(1)
        return lines.load_lines(spark, mine)

    f, _ = store.stored(spark, at, [mine], load, buckets=2)
    n, first = f.raw.count(), store.manifest(spark, at)["data"]
    store.stored(spark, at, [mine], load)
    assert calls == [1]
    time.sleep(0.01)
    part.limit(15).write.mode("append").parquet(mine)
    f, said = store.stored(spark, at, [mine], load)
    assert calls == [1, 1] and f.raw.count() > n and "stored at" in said
    assert not os.path.exists(f"{at}/{first}")  # the old data are gone
    store.stored(spark, at, [mine], load, buckets=3)
    assert len(calls) == 3  # another layout was asked for
    os.rename(mine, mine + ".gone")
    f, said = store.stored(spark, at, [mine], load)
    assert "gone" in said and f.raw.count() > n


def test_a_failed_build_leaves_the_store_as_it_was(spark, source, tmp_path):
    at = str(tmp_path / "store")
    part = spark.read.parquet(source).limit(30)
    store.build(lines.typed(part), at, [["a", 1, 1]], 2)
    before, n = store.manifest(spark, at), store.read(spark, at).raw.count()
    with pytest.raises(Exception, match="not a quantity"):
        store.build(lines.typed(part.withColumn("Quantity", F.lit("many"))), at, [["b", 1, 1]], 2)
    assert store.manifest(spark, at) == before and store.read(spark, at).raw.count() == n


def test_customer_groupings_do_not_shuffle_and_months_are_pruned(spark, at):
    f = store.read(spark, at)
    by_customer = re.compile(r"Exchange hashpartitioning\(CustomerID#")
    plain = cleaning.clean(f.raw).sales
    assert by_customer.search(plan(rfm.rfm_table(plain)))  # so the pattern finds what the store spares
    for df in (rfm.rfm_table(f.sales), cohort.activity(f.sales), clv.summarize(f.sales)):
        assert not by_customer.search(plan(df)) and "unknown" not in plan(df)
    month = f.sales.select(F.max("YearMonth")).first()[0]
    p = plan(f.sales.where(F.col("YearMonth") == month))
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(YearMonth#\d+\), \(YearMonth#\d+ = ", p)) == 2  # known and unknown
    assert sorted(map(tuple, rfm.rfm_table(f.sales).collect())) == sorted(map(tuple, rfm.rfm_table(plain).collect()))
