"""Tables in parts by month under one chain of commits.

A commit is a small file that names, for every table, the folders its parts lie in. It is written last and by a rename
that never replaces a file, so all tables of a commit change at once or not at all, and what a job that failed has
written is in no commit. An upsert reads and writes the parts that its rows fall into, no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import upsert

#: The part of tables without a date.
WHOLE = "all"
#: How often a commit is tried when others are faster.
TRIES = 5


@dataclass(frozen=True)
class Spec:
    """Columns (as a schema string), key and the date column of a table (none: it is one part)."""

    columns: str
    key: tuple[str, ...]
    by: str | None = "date"


@dataclass(frozen=True)
class Change:
    """Rows for a table; those of equal keys are replaced. ``without`` is a condition on rows that go, ``parts`` the
    months they are in."""

    rows: DataFrame
    without: F.Column | None = None
    parts: tuple[str, ...] = ()


class Ledger:
    """The tables ``specs`` below the folder ``root``, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec]):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # commits

    def head(self) -> tuple[int, dict]:
        """Number and content of the newest commit; (0, an empty one) if there is none."""
        at = self.path(f"{self.root}/_commits")
        done = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        numbers = [int(x.removesuffix(".json")) for x in done if x.endswith(".json")]
        if not numbers:
            return 0, {"tables": {}, "runs": {}, "batches": {}}
        text = self.spark.read.text(f"{self.root}/_commits/{max(numbers):012d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _publish(self, number: int, content: dict) -> bool:
        """Whether ``content`` became commit ``number``: false if there is one by now."""
        jvm, final = self.spark._jvm, self.path(f"{self.root}/_commits/{number:012d}.json")
        draft = self.path(f"{self.root}/_commits/_{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, kinds)
            return True
        except Py4JJavaError:
            if not self.fs.exists(final):
                raise
            self.fs.delete(draft, False)
            return False

    def commit(self, changes: dict[str, Change | DataFrame], batch: tuple[str, int] | None = None, run: tuple[str, dict] | None = None, ended: tuple[str, ...] = ()) -> int:
        """All ``changes`` at once; the number of the commit.

        ``batch`` (name of a stream, number) makes a batch count once: one that is in a commit changes nothing. ``run``
        (id, what is known of it) is kept with the months that its changes wrote; the runs ``ended`` are no longer.
        """
        changes = {t: c if isinstance(c, Change) else Change(c) for t, c in changes.items()}
        for _ in range(TRIES):
            number, content = self.head()
            if batch and content["batches"].get(batch[0], -1) >= batch[1]:
                return number
            wrote = {}
            for table, change in changes.items():
                parts = self._write(table, change, content["tables"].get(table, {}))
                content["tables"][table] = {k: v for k, v in {**content["tables"].get(table, {}), **parts}.items() if v}
                wrote[table] = sorted(parts)
            if batch:
                content["batches"][batch[0]] = batch[1]
            for old in ended:
                content["runs"].pop(old, None)
            if run:
                content["runs"][run[0]] = {**run[1], "parts": wrote}
            if self._publish(number + 1, content):
                return number + 1
        raise RuntimeError(f"{TRIES} commits by others came first")

    # parts

    def _part(self, table: str) -> F.Column:
        by = self.specs[table].by
        return F.date_format(by, "yyyy-MM") if by else F.lit(WHOLE)

    def _fitted(self, table: str, rows: DataFrame) -> DataFrame:
        """The table's columns: others are left out, absent ones are null."""
        empty = self.spark.createDataFrame([], self.specs[table].columns)
        return empty.unionByName(rows.select(*[c for c in rows.columns if c in empty.columns]), allowMissingColumns=True)

    def _write(self, table: str, change: Change, now: dict[str, str]) -> dict[str, str]:
        """The folders of the parts that ``change`` touches, new or (for a part that has no rows left) empty."""
        rows = self._fitted(table, change.rows).withColumn("_part", self._part(table))
        touched = {r[0] for r in rows.select("_part").distinct().collect()} | {p for p in change.parts if p in now}  # a row a month
        if None in touched:
            raise ValueError(f"{table}: rows without {self.specs[table].by}")
        if not touched:
            return {}
        old = self._read(table, {p: now[p] for p in touched if p in now}).drop("part")
        if change.without is not None:
            old = old.where(~F.coalesce(change.without, F.lit(False)))
        merged = upsert(old, rows.drop("_part"), list(self.specs[table].key)).withColumn("part", self._part(table))
        folder = f"{table}/write={uuid.uuid4().hex}"
        merged.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
        there = {s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{folder}"))}
        return {p: f"{folder}/part={p}" if f"part={p}" in there else "" for p in touched}

    def _read(self, table: str, parts: dict[str, str]) -> DataFrame:
        """Rows of ``parts`` with the column ``part``, by which Spark prunes folders."""
        schema = self.spark.createDataFrame([], self.specs[table].columns + ", part string").schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema.add("write", "string"))
        return reader.parquet(*[f"{self.root}/{f}" for f in parts.values()]).drop("write")

    def parts(self, table: str) -> dict[str, str]:
        """Month to folder of the table's parts in the newest commit."""
        return self.head()[1]["tables"].get(table, {})

    def read(self, table: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """The table, or its rows from ``start`` to ``end``: only folders of these months are listed and read."""
        by, parts = self.specs[table].by, self.parts(table)
        if by and start:
            parts = {p: f for p, f in parts.items() if p >= f"{start:%Y-%m}"}
        if by and end:
            parts = {p: f for p, f in parts.items() if p <= f"{end:%Y-%m}"}
        rows = self._read(table, parts)
        if by and start:
            rows = rows.where((F.col("part") >= f"{start:%Y-%m}") & (F.col(by) >= F.lit(start)))
        if by and end:
            rows = rows.where((F.col("part") <= f"{end:%Y-%m}") & (F.to_date(by) <= F.lit(end)))
        return rows.drop("part")

    def read_parts(self, table: str, parts: list[str]) -> DataFrame:
        """The rows of some months."""
        now = self.parts(table)
        return self._read(table, {p: now[p] for p in parts}).drop("part")

    def vacuum(self) -> int:
        """Deletes parts that the newest commit doesn't name; how many. Not while others write or read old commits."""
        used = {f for parts in self.head()[1]["tables"].values() for f in parts.values()}
        names = lambda at: [s.getPath().getName() for s in self.fs.listStatus(self.path(at))] if self.fs.exists(self.path(at)) else []
        gone = 0
        for table in self.specs:
            for write in names(f"{self.root}/{table}"):
                folder = f"{table}/{write}"
                parts = [f"{folder}/{p}" for p in names(f"{self.root}/{folder}") if p.startswith("part=")]
                unused = [f for f in parts if f not in used]
                for f in unused if len(unused) < len(parts) else [folder]:
                    self.fs.delete(self.path(f"{self.root}/{f}"), True)
                gone += len(unused)
        return gone
