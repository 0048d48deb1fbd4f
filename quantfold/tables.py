"""Shared scratch tables: where a plan is cut, its result is written and read back.

Stages live under the folder named by ``spark.checkpoint.dir`` so that they are
visible to every executor and survive the loss of any of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables, taken from the session's ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-quantfold-")
    return _LOCAL_ROOT[app]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class Stage:
    """Named tables of one run, written once and read many times."""

    def __init__(self, spark: SparkSession, label: str, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or shuffle_partitions(spark)
        self.uid = uuid.uuid4().hex[:10]
        self.root = f"{scratch_root(spark)}/quantfold/{spark.sparkContext.applicationId}/{label}-{self.uid}"
        self._tables: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame | None:
        return self._tables.get(name)

    def bucketed(self, name: str, df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
        """Write ``df`` hash-bucketed on ``key``; later windows and joins on it need no exchange.

        The caller hands in rows already partitioned on ``key`` (see
        ``spread``) so each task writes one file per bucket it owns.
        """
        table = f"qf_{name}_{self.uid}"
        (
            df.write.bucketBy(self.buckets, key)
            .sortBy(*order)
            .option("path", f"{self.root}/{name}")
            .mode("overwrite")
            .saveAsTable(table)
        )
        self._tables[name] = self.spark.table(table)
        return self._tables[name]

    def ranged(self, name: str, df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
        """Write ``df`` clustered by ranges of ``key`` so filters on it skip row groups."""
        out = df.repartitionByRange(self.buckets, key, *order).sortWithinPartitions(key, *order)
        return self.plain(name, out)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write an intermediate result and read it back, ending its lineage."""
        self._n = getattr(self, "_n", 0) + 1
        return self.plain(f"cut_{self._n}", df)

    def plain(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[name]

    def drop(self, name: str) -> None:
        """Delete a plain table that no later plan reads."""
        del self._tables[name]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def clear(self) -> None:
        """Delete all plain tables once their last plan has run."""
        for name in list(self._tables):
            self.drop(name)

    def together(self, names: Sequence[str]) -> DataFrame:
        """The columns of the first of several plain tables from all of them, in one scan: a union would copy what is joined to it."""
        return self.spark.read.schema(self._tables[names[0]].schema).parquet(*[f"{self.root}/{name}" for name in names])


#: Trade lines per bucket; the panel has about four rows a line, which one task then sorts in memory.
BUCKET_LINES = 1_000_000


def bucket_count(lines: DataFrame) -> int:
    """Buckets for tables derived from ``lines``: one per ``BUCKET_LINES`` of its rows (counted from the
    files' footers), at least one per core, of as many as the session has shuffle partitions."""
    spark = lines.sparkSession
    least = min(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    return max(1, -(-lines.count() // BUCKET_LINES), least)


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` into ``n`` parts (the bucket count of the table they go to)."""
    return df.repartition(n, *keys)


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by the calendar or a fixed parameter list.

    Only used for: one row per trading day, one row per month end, one row per
    (month end, day of a fixed-length look-back), or literal parameter rows.
    None of these grows with the number of stocks, users or ticks.
    """
    return F.broadcast(df)


def literal_rows(spark: SparkSession, columns: Sequence[tuple[str, str]], rows: Sequence[Sequence]) -> DataFrame:
    """Parameter rows as a local relation with typed columns."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"{v!r}D"
        if hasattr(v, "isoformat"):
            return f"'{v.isoformat()}'"
        return str(v)

    names = ", ".join(n for n, _ in columns)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    if not rows:
        empty = ", ".join("NULL" for _ in columns)
        return spark.sql(f"SELECT {casts} FROM VALUES ({empty}) AS t({names}) WHERE false")
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
