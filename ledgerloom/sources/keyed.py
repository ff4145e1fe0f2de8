"""Tables with a key, kept in partitions by a hash of the key, that changes rewrite in part."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators.merge import insert_missing, replace_slice, upsert
from ledgerloom.session import remove_folder, scratch_path, setting

#: The partition column and the column that the files of a partition are bucketed by; tables have no columns of these names.
PART, LANE = "key_part", "key_lane"


@dataclass(frozen=True)
class Staged:
    """A change that lies the way its table does, ready to be merged into it, also more than once."""

    path: str
    schema: StructType


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet folder with one partition per hash value of the leading key columns.

    The rows of a partition lie in buckets by another hash of these columns, a file or two each. A change is staged the
    same way, so that the two are joined bucket by bucket: rows of the table never move, those of the change once, when
    it is staged. A change reads and writes only the partitions its keys fall into. What they are to hold is first
    written next to the table, then takes their place folder by folder, moved and not written again, so the table may be
    read to work out the change, and a change that is cut off in between is finished by :meth:`recover`, which every
    later change calls first. Applying a change twice gives the table that applying it once gives.

    ``parts`` and ``buckets`` are fixed when the table is made: more parts than most changes touch, for slices replaced
    by an id up to one per id; ``buckets``, of all parts together, as many as make one fit a task. One writer at a time;
    readers that must not see a change half done read before or after it.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    parts: int
    #: The leading key columns, which choose the partition; all keys if not given.
    by: tuple[str, ...] = ()
    buckets: int = 256

    @property
    def _buckets(self) -> int:
        """As many for each part."""
        return self.parts * max(1, self.buckets // self.parts)

    def _laned(self, rows: DataFrame) -> DataFrame:
        values = [F.col(key).cast(self.schema[key].dataType) for key in self.by or self.keys]
        # Many lane numbers to a bucket make buckets alike.
        return rows.withColumn(LANE, F.pmod(F.xxhash64(*values), F.lit(64 * self._buckets)).cast("int"))

    def _parted(self, rows: DataFrame) -> DataFrame:
        # Spark chooses the bucket by the same hash, so all rows of a bucket are in one partition.
        return rows.withColumn(PART, F.pmod(F.hash(LANE), F.lit(self.parts)))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self._parted(self._laned(rows))

    def _shaped(self, rows: DataFrame) -> DataFrame:
        placed = [LANE] if LANE in rows.columns else []
        return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in self.schema], *placed)

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField(PART, IntegerType())])).parquet(path)

    @contextmanager
    def _entered(self) -> Iterator[str]:
        """A name for a table of the catalogue, which alone knows buckets; it is forgotten again, its files stay."""
        name = f"keyed_{uuid.uuid4().hex}"
        # Its partitions are those found in the folder.
        with setting(self.spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
            try:
                yield name
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _laid(self, path: str, schema: StructType) -> DataFrame:
        """The rows of a folder with their lanes, known to lie in buckets."""
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        with self._entered() as name:
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {LANE} int, {PART} int) USING parquet PARTITIONED BY ({PART}) "
                f"CLUSTERED BY ({LANE}) INTO {self._buckets} BUCKETS LOCATION '{location}'"
            )
            return self.spark.table(name)

    def _lay(self, rows: DataFrame, path: str) -> None:
        """Write rows whose buckets are whole in a task, a file for each."""
        with self._entered() as name:
            writer = rows.write.format("parquet").mode("overwrite").option("path", path)
            writer.partitionBy(PART).bucketBy(self._buckets, LANE).saveAsTable(name)

    def create(self, rows: DataFrame) -> None:
        """Make the table from rows with unique keys, replacing one that is there."""
        remove_folder(self.spark, self._change)
        moved = self._laned(self._shaped(rows)).repartition(self._buckets, LANE)
        self._lay(self._parted(moved), self.path)

    def staged(self, delta: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> Staged:
        """Write a change the way the table lies, with the columns the table has.

        ``finish`` works columns out of others when the rows have moved; it leaves the leading key as it is.
        """
        moved = self._laned(delta).repartition(self._buckets, LANE)
        rows = self._laned(finish(moved.drop(LANE))) if finish else moved
        schema = StructType([field for field in self.schema if field.name in rows.columns])
        columns = [F.col(field.name).cast(field.dataType).alias(field.name) for field in schema]
        change = Staged(scratch_path(self.spark, "change"), schema)
        self._lay(self._parted(rows.select(*columns, LANE)), change.path)
        return change

    def read(self) -> DataFrame:
        """All rows."""
        return self._stored(self.path).drop(PART)

    def near(self, rows: DataFrame) -> DataFrame:
        """The rows in the partitions that the keys of ``rows`` fall into: all that could match one of them."""
        touched = self._touched(self._placed(rows))
        return self._stored(self.path).where(F.col(PART).isin(touched)).drop(PART)

    @staticmethod
    def _touched(placed: DataFrame) -> list[int]:
        """Partition numbers of rows: at most one for each partition of the table."""
        return sorted(row[0] for row in placed.select(PART).distinct().collect())

    def upsert(self, delta: DataFrame | Staged, defaults: Mapping[str, Column] | None = None) -> list[int]:
        """Insert new keys and set, in existing ones, the columns ``delta`` has. Returns the partitions rewritten."""
        return self._changed(delta, lambda base, change: upsert(base, change, self.keys, defaults, LANE))

    def insert_missing(self, delta: DataFrame | Staged) -> list[int]:
        """Add the rows whose key is not there yet."""
        return self._changed(delta, lambda base, change: insert_missing(base, self._shaped(change), self.keys, LANE))

    def replace_slices(self, delta: DataFrame | Staged) -> list[int]:
        """Put ``delta`` in the place of all rows that share its leading keys."""
        keys = self.by or self.keys
        return self._changed(delta, lambda base, change: replace_slice(base, self._shaped(change), keys, place=LANE))

    def delete_slices(self, ids: DataFrame) -> list[int]:
        """Remove all rows of the leading keys in ``ids``."""
        keys = self.by or self.keys
        return self._changed(ids.select(*keys), lambda base, change: replace_slice(base, change, keys, append=False, place=LANE))

    @property
    def _change(self) -> str:
        return f"{self.path.rstrip('/')}.change"

    def _changed(self, delta: DataFrame | Staged, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        self.recover()
        staged = delta if isinstance(delta, Staged) else self.staged(delta)
        change = self._laid(staged.path, staged.schema)
        touched = self._touched(change)
        if not touched:
            return touched
        base = self._laid(self.path, self.schema).where(F.col(PART).isin(touched)).drop(PART)
        # Rows with the same keys are found where those of their bucket are.
        with setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            self._lay(self._parted(combine(base, change.drop(PART))), f"{self._change}/rows")
        # Written last: from here on the change is whole.
        filled = [(part, self._exists(f"{self._change}/rows/{PART}={part}")) for part in touched]
        numbers = self.spark.createDataFrame(filled, f"{PART} int, filled boolean")
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{self._change}/parts")
        self.recover()
        return touched

    def recover(self) -> None:
        """Finish a change that was written but not yet in place, and forget one that was not written to its end."""
        if self._exists(f"{self._change}/parts/_SUCCESS"):
            for part, filled in self.spark.read.parquet(f"{self._change}/parts").collect():
                place, written = f"{self.path}/{PART}={part}", f"{self._change}/rows/{PART}={part}"
                # What is no longer there was moved before this change was cut off.
                if not filled or self._exists(written):
                    remove_folder(self.spark, place)
                if filled:
                    self._move(written, place)
        remove_folder(self.spark, self._change)

    def _move(self, path: str, to: str) -> None:
        """Rename a folder that is there."""
        if self._exists(path):
            found = self.spark._jvm.org.apache.hadoop.fs.Path
            store = found(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not store.rename(found(path), found(to)):
                raise OSError(f"{path} could not be moved to {to}")

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)
