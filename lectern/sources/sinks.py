"""Sinks: keyed table folders with append, upsert, update and delete, reports and quarantined captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import insert_absent, upsert


class Table:
    """A keyed table of Parquet files in buckets of the key, written by generations.

    An append adds files and reads none.  A write by key reads and replaces only the buckets its keys fall
    into.  A generation counts once its marker is there, so readers see none or all of it, and a writer
    that dies leaves the table as it was.  ``vacuum`` deletes what later generations have replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, list(key), buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _generations(self) -> list[tuple[str, list[int] | None]]:
        """Names in order, and the buckets each replaces, None for one that adds; the marker's name tells."""
        out = []
        for name in self._names(self.folder):
            marks = [n for n in self._names(f"{self.folder}/{name}") if n.startswith("_done")]
            if name.startswith("gen-") and marks:
                told = marks[0].removeprefix("_done-")
                out.append((name, None if told == "add" else [int(x) for x in told.split("_") if x]))
        return out

    def _files(self) -> dict[int, list[str]]:
        """The folders that make up each bucket now."""
        found: dict[int, list[str]] = {}
        for name, replaced in self._generations():
            for k in replaced or ():
                found[k] = []
            for part in self._names(f"{self.folder}/{name}"):
                if part.startswith("_bucket="):
                    found.setdefault(int(part.removeprefix("_bucket=")), []).append(f"{self.folder}/{name}/{part}")
        return found

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        paths = [p for k, some in self._files().items() if buckets is None or k in buckets for p in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, told: str) -> None:
        names = [n for n in self._names(self.folder) if n.startswith("gen-")]
        folder = f"{self.folder}/gen-{int(names[-1][4:]) + 1 if names else 0:09d}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(folder)
        self._fs.create(self._path(f"{folder}/_done-{told}")).close()

    def _change(self, keys: DataFrame | None, make) -> None:
        """Replace the buckets of ``keys`` (all without) by what ``make`` gives for their rows."""
        touched = list(range(self.buckets)) if keys is None else sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        if touched:
            self._write(make(self.read(touched)), "_".join(map(str, touched)))

    def replace(self, rows: DataFrame) -> None:
        self._change(None, lambda old: rows)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "add")

    def upsert(self, rows: DataFrame) -> None:
        self._change(rows, lambda old: upsert(old, rows, self.key))

    def insert_absent(self, rows: DataFrame) -> None:
        self._change(rows, lambda old: insert_absent(old, rows, self.key))

    def update(self, where: Column, values: dict[str, Column]) -> None:
        """Set columns, not of the key, of the rows that meet ``where``; buckets without any stay as they are."""
        self._change(self.read().filter(where), lambda old: old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> int:
        """Take out the rows that meet ``where``; gives their number."""
        gone = self.read().filter(where)
        count = gone.count()
        self._change(gone, lambda old: old.filter(~F.coalesce(where, F.lit(False))))
        return count

    def vacuum(self) -> None:
        """Delete folders of buckets that later generations have replaced, and those of writers that died."""
        live = {p for some in self._files().values() for p in some}
        done = {name for name, _ in self._generations()}
        for name in self._names(self.folder):
            if name not in done:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
                continue
            for part in self._names(f"{self.folder}/{name}"):
                if part.startswith("_bucket=") and f"{self.folder}/{name}/{part}" not in live:
                    self._fs.delete(self._path(f"{self.folder}/{name}/{part}"), True)


def write_reports(reports: DataFrame, folder: str) -> None:
    """One text line for each report row, its line breaks kept as \\n."""
    reports.select(F.replace("report", F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("append").text(folder)


CAPTURE = "source_url string, source_title string, timestamp_seconds double, mode string, annotation string, captured_at timestamp, _bad string"


def captures_of(spark: SparkSession, folder: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) capture rows of JSON files; bad ones are malformed or lack a URL or known mode."""
    reader = (spark.readStream if stream else spark.read).schema(CAPTURE).option("columnNameOfCorruptRecord", "_bad")
    rows = reader.json(folder)
    ok = F.col("_bad").isNull() & F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)) & F.coalesce(F.col("mode").isin("quick", "deep", "visual"), F.lit(False))
    return rows.filter(ok).drop("_bad"), rows.filter(~ok)
