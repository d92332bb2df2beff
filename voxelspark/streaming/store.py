"""A map kept as versions of changed blocks in a folder that all executors see.

A version holds all voxels of the blocks that it changed and nothing else, so a batch
writes in proportion to what it touches. Reading merges: a block is what its latest
version says. compact() writes the merged map as a base, from which later reads start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockStore:
    """Tables by version under path; schema's first len(keys) columns are the block's."""

    path: str
    schema: str
    keys: tuple[str, ...] = ("b",)

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version:010d}"

    def versions(self, spark: SparkSession, kind: str, up_to: int) -> list[int]:
        """Whole versions (those whose writing was committed) up to one."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [p.getPath() for p in fs.listStatus(root)]
        done = [int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(v for v in done if v <= up_to)

    def write(self, changed: DataFrame, version: int) -> None:
        """A version: all voxels of each changed block. Written again it replaces itself; a block must not vanish."""
        changed.write.mode("overwrite").parquet(self._folder("changes", version))

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """The map as of a version; empty before the first."""
        base = self.versions(spark, "base", version)
        later = [v for v in self.versions(spark, "changes", version) if not base or v > base[-1]]
        parts = [(v, self._folder("changes", v)) for v in later] + [(v, self._folder("base", v)) for v in base[-1:]]
        tables = [spark.read.schema(self.schema).parquet(p).withColumn("_version", F.lit(v)) for v, p in parts]
        if not tables:
            return spark.createDataFrame([], self.schema)
        if len(tables) == 1:
            return tables[0].drop("_version")
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        # Which version a block is read from takes only its key and version, read from the files' columns of these.
        latest = rows.groupBy(*self.keys).agg(F.max("_version").alias("_latest"))
        latest = latest.select(*[F.col(k).alias(f"_{k}") for k in self.keys], "_latest")
        same = F.col("_version") == F.col("_latest")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(latest, same, "left_semi").drop("_version")

    def compact(self, spark: SparkSession, version: int) -> None:
        """Write the map as of a version as a base, if it isn't there; earlier versions stay readable."""
        if version in self.versions(spark, "base", version):
            return
        self.read(spark, version).write.mode("overwrite").parquet(self._folder("base", version))
