"""One named CSV file as a Spark sink, put in place by its commit.

    spark.dataSource.register(CsvFile)
    df.orderBy(...).write.format("csvfile").mode("overwrite").save("report.csv")

Each task writes its rows to a file of its own beside the target; the commit joins
them in the order of the partitions and renames the result, so readers see the old
file or the whole new one. A failed job deletes what its tasks wrote and leaves the
old file. Equal rows in equal order give equal bytes: UTF-8, a line feed after each
row, quotes only where needed, doubles as their shortest form, nulls empty. The
folder must be one that the driver and all executors share. For results small
enough for one file.
"""

from __future__ import annotations

import csv
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def shown(value) -> str:
    """A value as it stands in the file."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, float):
        return "" if value != value else repr(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (datetime, date)):
        return str(value)
    return str(value)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str


class CsvFileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.beside = f"{path}.{uuid.uuid4().hex}"
        if not overwrite and os.path.exists(path):
            raise FileExistsError(f"{path} exists; write with mode overwrite to replace it")

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        os.makedirs(self.beside, exist_ok=True)
        part = f"{self.beside}/{task.partitionId():06d}-{task.taskAttemptId()}"
        with open(part, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            for row in iterator:
                out.writerow([shown(v) for v in row])
        return Written(task.partitionId(), part)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        whole = f"{self.beside}.whole"
        with open(whole, "w", encoding="utf-8", newline="") as f:
            csv.writer(f, lineterminator="\n").writerow(self.names)
        with open(whole, "ab") as f:
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f)
        os.replace(whole, self.path)
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)
        if os.path.exists(f"{self.beside}.whole"):
            os.remove(f"{self.beside}.whole")


class CsvFile(DataSource):
    """Option: ``path``, the name of the file."""

    @classmethod
    def name(cls) -> str:
        return "csvfile"

    def writer(self, schema: StructType, overwrite: bool) -> CsvFileWriter:
        return CsvFileWriter(_local(self.options["path"]), schema.fieldNames(), overwrite)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """``df`` as the named file, its rows in the given order."""
    df.sparkSession.dataSource.register(CsvFile)
    (df.orderBy(*order) if order else df).write.format("csvfile").mode("overwrite").save(path)
