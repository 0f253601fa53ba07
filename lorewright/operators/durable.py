"""A store that lasts: a log of changes as Parquet batches, read by replay, folded into a snapshot by compaction.

A batch counts once its _SUCCESS file stands, so one cut off by a lost writer is as if never written, and its number is used again.
Replay is one aggregation by id over the last snapshot and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreError(ValueError):
    """No such store, or a batch that doesn't fit it."""


class Log:
    """Rows (ord, id, ...) under a folder; drop takes (id)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        if not {"ord", "id"} <= set(self.schema.names):
            raise StoreError("rows need ord and id")

    def _fs(self, name: str) -> tuple:
        own = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), own

    def _list(self, kind: str) -> list[int]:
        """Numbers of the whole batches or snapshots."""
        fs, own = self._fs(kind)
        if not fs.exists(own):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(own)]
        done = [n for n in names if n.isdigit() and fs.exists(self._fs(f"{kind}/{n}/_SUCCESS")[1])]
        return sorted(map(int, done))

    def _last(self) -> int:
        return max([0, *self._list("log"), *self._list("snapshot")])

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}/{number:012d}")

    def put(self, rows: DataFrame) -> int:
        """Appends rows, and returns the batch's number."""
        missing = set(self.schema.names) - set(rows.columns)
        if missing:
            raise StoreError(f"no column {sorted(missing)[0]}")
        number = self._last() + 1
        self._write("log", number, rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], F.lit("put").alias("op")))
        return number

    def drop(self, ids: DataFrame) -> int:
        number = self._last() + 1
        empty = [F.col("id") if f.name == "id" else F.lit(0).cast(f.dataType).alias("ord") if f.name == "ord" else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self._write("log", number, ids.select(*empty, F.lit("drop").alias("op")))
        return number

    def rows(self, until: int | None = None) -> DataFrame:
        """What is stored, or was after a batch: an id keeps the place of its first put since it was last dropped, and the values of its last."""
        snap = [n for n in self._list("snapshot") if until is None or n <= until]
        base, parts = snap[-1] if snap else 0, []
        logs = [n for n in self._list("log") if n > base and (until is None or n <= until)]
        names = self.schema.names
        for kind, numbers in (("snapshot", snap[-1:]), ("log", logs)):
            for n in numbers:
                own = self.spark.read.parquet(f"{self.path}/{kind}/{n:012d}")
                parts.append(own.select(*names, own["op"] if kind == "log" else F.lit("put").alias("op"), F.lit(n).cast("long").alias("seq")))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        rest = [n for n in names if n != "id"]
        gone = F.coalesce(F.max(F.when(F.col("op") == "drop", F.col("seq"))), F.lit(-1))
        own = every.groupBy("id").agg(gone.alias("gone"), F.array_sort(F.collect_list(F.when(F.col("op") == "put", F.struct("seq", "ord")))).alias("puts"), F.max_by(F.struct(*rest), F.struct("seq", "ord")).alias("v"), F.max_by("op", F.struct("seq", "ord")).alias("last"))
        first = F.filter("puts", lambda x: x["seq"] > F.col("gone"))[0]["ord"]
        return own.where("last = 'put'").withColumn("ord", first).select(*[F.col(n) if n in ("id", "ord") else F.col(f"v.{n}").alias(n) for n in names])

    def get(self, *ids: str) -> DataFrame:
        return self.rows().where(F.col("id").isin(list(ids)))

    def compact(self) -> int:
        """Folds all into a snapshot, and then lets older batches and snapshots go. Cut off in between, replay gives the same."""
        number = self._last()
        if number and number not in self._list("snapshot"):
            self._write("snapshot", number, self.rows())
        for kind in ("log", "snapshot"):
            for n in self._list(kind):
                if kind == "log" and n <= number or n < number:
                    fs, own = self._fs(f"{kind}/{n:012d}")
                    fs.delete(own, True)
        return number

    def stat(self) -> DataFrame:
        """One row: rows stored, batches in the log, and the last number."""
        return self.rows().agg(F.count("*").alias("rows")).withColumns({"batches": F.lit(len(self._list("log"))), "last": F.lit(self._last()).cast("long")})

    def dump(self, path: str) -> None:
        self.rows().write.mode("overwrite").parquet(path)

    def load(self, path: str) -> int:
        """Takes the place of all that is stored."""
        self.drop(self.rows().select("id"))
        return self.put(self.spark.read.parquet(path))


DRIVERS: dict[str, Callable[..., object]] = {"log": Log}


def register(name: str, driver: Callable[..., object]) -> None:
    DRIVERS[name] = driver


def opened(name: str, *args: object, **options: object) -> object:
    """A store by its driver's name."""
    if name not in DRIVERS:
        raise StoreError(f"no driver {name}")
    return DRIVERS[name](*args, **options)
