"""Salts by measured group sizes.

``Spread.measure`` counts the rows of each group (keys alone, combined before the
shuffle).  Groups of at most ``least`` rows keep salt 0; a larger one gets a salt for
every ``least`` rows.  The list of larger groups is broadcast.  It has at most ``most_hot``
entries: where more groups are larger, those that hold more than one ``most_hot``-th of
all rows are listed, and there can't be more of them.

Defined results of edge cases
* null keys: a group of their own; no large group, empty table: salt 0 everywhere
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1 << 16
MOST_HOT = 100_000


@dataclass
class Spread:
    keys: list[str]
    hot: DataFrame | None

    @classmethod
    def measure(cls, rows: DataFrame, keys: list[str], least: int | None = None, most_hot: int = MOST_HOT) -> Spread:
        least = LEAST if least is None else least
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        wide = lambda n: sizes.where(F.col("_n") > n).select(*keys, F.ceil(F.col("_n") / max(n, 1)).cast("int").alias("_salts"))
        found = wide(least).limit(most_hot + 1).collect()
        if len(found) > most_hot:
            found = wide(max(least, rows.count() // most_hot)).collect()  # at most most_hot
        return cls(keys, rows.sparkSession.createDataFrame(found, wide(least).schema) if found else None)

    def _counted(self, rows: DataFrame) -> DataFrame:
        names = {k: f"_hot_{i}" for i, k in enumerate(self.keys)}
        hot = F.broadcast(self.hot.withColumnsRenamed(names))
        on = [F.col(k).eqNullSafe(F.col(names[k])) for k in self.keys]
        return rows.join(hot, on, "left").drop(*names.values())

    def mark(self, rows: DataFrame) -> DataFrame:
        """Adds ``_salts``, null outside large groups."""
        return rows.withColumn("_salts", F.lit(None).cast("int")) if self.hot is None else self._counted(rows)

    def facts(self, rows: DataFrame, by: Column) -> DataFrame:
        """Adds ``_salt``: rows of a large group are spread by ``by``."""
        if self.hot is None:
            return rows.withColumn("_salt", F.lit(0))
        salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts"))).cast("int")
        return self._counted(rows).withColumn("_salt", salt).drop("_salts")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Repeats each row once for every ``_salt`` of its group."""
        if self.hot is None:
            return rows.withColumn("_salt", F.lit(0))
        last = F.coalesce(F.col("_salts") - 1, F.lit(0))
        return self._counted(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
