"""The stored form of cleaned lines: partitioned by month, bucketed by customer, with a manifest of its source.

A store is a folder with ``manifest.json`` and the data it names. Data go to a
fresh folder first and count only once the manifest names them, so a build that
fails leaves the store as it was. The manifest has the size, time and path of each
source file; when any differs, or the layout asked for does, the store is built
anew.

Lines of known customers are bucketed: groupings and joins by customer then need
no shuffle, and a filter on YearMonth reads those months alone. Lines without a
customer, which may be a third of all, lie beside them without buckets, so no
bucket is theirs; an operator that asks for known customers doesn't read them.
"""

from __future__ import annotations

import json
import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from .scratch import filesystem

MANIFEST = "manifest.json"
LAYOUT = 1
_TABLES: dict[tuple[str, str], str] = {}


def fingerprint(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, size and time of every file under ``paths``, in order."""
    found = []
    for path in paths:
        fs, where = filesystem(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then put in its place."""
    fs, where = filesystem(spark, path)
    _, beside = filesystem(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} can't be written")


def manifest(spark: SparkSession, at: str) -> dict | None:
    """What the store at ``at`` holds; None where there is none."""
    text = _read_text(spark, f"{at}/{MANIFEST}")
    return None if text is None else json.loads(text)


def default_buckets(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _write_lines(df: DataFrame, path: str, buckets: int) -> dict:
    """Known customers' lines bucketed, others without buckets; what is needed to read them again."""
    spark, known = df.sparkSession, F.col("CustomerID").isNotNull()
    name = f"ledgerloom_{uuid.uuid4().hex}"
    # A task holds one bucket and writes a file a month.
    df.where(known).repartition(buckets, "CustomerID").write.partitionBy("YearMonth").bucketBy(buckets, "CustomerID").sortBy("CustomerID").option("path", f"{path}/known").saveAsTable(name)
    _TABLES[spark.sparkContext.applicationId, f"{path}/known"] = name
    df.where(~known).drop("CustomerID").repartition("YearMonth", F.pmod(F.xxhash64("Invoice"), F.lit(buckets))).write.partitionBy("YearMonth").parquet(f"{path}/unknown")
    return {"schema": df.schema.jsonValue(), "buckets": buckets}


def _read_lines(spark: SparkSession, path: str, how: dict) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(how["schema"])
    key = (spark.sparkContext.applicationId, f"{path}/known")
    if key not in _TABLES or not spark.catalog.tableExists(_TABLES[key]):
        # The catalog of a session ends with it; the files and the manifest say all that it needs.
        name = f"ledgerloom_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (YearMonth) CLUSTERED BY (CustomerID) SORTED BY (CustomerID) INTO {int(how['buckets'])} BUCKETS LOCATION '{path}/known'")
        spark.catalog.recoverPartitions(name)
        _TABLES[key] = name
    order = schema.fieldNames()
    rest = StructType([f for f in schema if f.name != "CustomerID"])
    unknown = spark.read.schema(rest).parquet(f"{path}/unknown").withColumn("CustomerID", F.lit(None).cast("long"))
    return spark.table(_TABLES[key]).select(order).unionAll(unknown.select(order))


def build(raw: DataFrame, at: str, source: list[list] | None = None, buckets: int | None = None) -> SimpleNamespace:
    """Clean ``raw`` and store raw lines, sales, returns and the step log at ``at``; the frames read from the store."""
    spark = raw.sparkSession
    buckets = buckets or default_buckets(spark)
    before = manifest(spark, at)
    data = f"data-{uuid.uuid4().hex}"
    path = f"{at}/{data}"
    raw.write.parquet(f"{path}/raw")
    out = cleaning.clean(spark.read.schema(raw.schema).parquet(f"{path}/raw"))
    made = {"layout": LAYOUT, "buckets": buckets, "source": source, "data": data, "raw": raw.schema.jsonValue()}
    made["sales"], made["returns"] = (_write_lines(df, f"{path}/{name}", buckets) for name, df in (("sales", out.sales), ("returns", out.returns)))
    out.log.write.parquet(f"{path}/log")
    made["log"] = out.log.schema.jsonValue()
    _write_text(spark, f"{at}/{MANIFEST}", json.dumps(made))
    if before and before["data"] != data:
        fs, where = filesystem(spark, f"{at}/{before['data']}")
        fs.delete(where, True)
    return read(spark, at)


def read(spark: SparkSession, at: str) -> SimpleNamespace:
    """Raw lines, sales, returns and the step log of the store at ``at``."""
    from pyspark.sql.types import StructType

    made = manifest(spark, at)
    if made is None:
        raise FileNotFoundError(f"no store at {at}")
    path = f"{at}/{made['data']}"
    plain = lambda name: spark.read.schema(StructType.fromJson(made[name])).parquet(f"{path}/{name}")
    return SimpleNamespace(raw=plain("raw"), log=plain("log"), sales=_read_lines(spark, f"{path}/sales", made["sales"]), returns=_read_lines(spark, f"{path}/returns", made["returns"]))


def stored(spark: SparkSession, at: str, paths: list[str], load, buckets: int | None = None, force: bool = False) -> tuple[SimpleNamespace, str]:
    """The frames of the store at ``at``, and where they came from.

    In this order: the store, where its manifest agrees with the files at
    ``paths`` and the number of ``buckets``, if given; then ``load()``, whose lines
    are cleaned and stored. ``force`` passes the store over. Where the files are
    gone, a store made from these paths still serves, and that is said.
    """
    made = manifest(spark, at)
    fits = made is not None and made["layout"] == LAYOUT and buckets in (None, made["buckets"]) and not force
    try:
        now = fingerprint(spark, paths)
    except Exception as e:
        if "FileNotFoundException" not in str(e) or not fits:
            raise
        return read(spark, at), f"the store at {at}; its source is gone"
    if fits and made["source"] == now:
        return read(spark, at), f"the store at {at}"
    return build(load(), at, now, buckets), f"lines of {', '.join(paths)}, stored at {at}"
