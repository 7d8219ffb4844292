"""A written panel that is changed in place of its touched parts only.

Series are dealt to buckets by a hash of their keys. A version writes the buckets
that its rows touch into folders of its own, and a manifest that names, for every
bucket, the version whose folder holds it. A reader takes the buckets of one manifest
and nothing else, so neither what a change reads and writes nor what a reader
opens depends on how many changes came before. The manifest is written last: a
change that fails before leaves the panel as it was, and repeating it is harmless.
One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a bucket, on average, and the largest number of buckets; the manifest has a row for each.
ROWS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 4_096

_VERSION = re.compile(r"version=(\d+)$")


@dataclass
class Manifest:
    version: int
    n_buckets: int
    schema: StructType
    #: Version that holds each bucket; buckets without rows are absent.
    held: dict[int, int] = field(default_factory=dict)


class PanelStore:
    """Rows of ``keys…, ids…`` under ``path``; the last row written of each counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ids: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.ids = ["ds"] if ids is None else list(ids)

    # ---- reading --------------------------------------------------------

    def versions(self) -> list[int]:
        """Written versions, oldest first."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [_VERSION.search(s.getPath().toString()) for s in files.listStatus(folder)]
        done = [int(m[1]) for m in found if m]
        return sorted(v for v in done if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/version={v}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path}, version {version}")
        version = known[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()
        held = {r["bucket"]: r["held"] for r in rows if r["bucket"] is not None}
        return Manifest(version, rows[0]["n_buckets"], StructType.fromJson(json.loads(rows[0]["schema"])), held)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The panel after a version, by default the last, or some buckets of it."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        wanted = manifest.held if buckets is None else {b: manifest.held[b] for b in buckets if b in manifest.held}
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
        if not paths:
            return self.spark.createDataFrame([], manifest.schema)
        # the folders are named one by one, so their names are no columns
        return self.spark.read.schema(manifest.schema).parquet(*paths)

    def bucket(self, n_buckets: int) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(n_buckets)) if self.keys else F.lit(0)

    # ---- writing --------------------------------------------------------

    def create(self, panel: DataFrame, n_buckets: int | None = None) -> PanelStore:
        """Writes the first version, or one that replaces everything before it."""
        number = self._next()
        if n_buckets is None:
            n_buckets = min(MOST_BUCKETS, 1 + panel.count() // ROWS_PER_BUCKET) if self.keys else 1
        manifest = Manifest(number, n_buckets, panel.schema)
        manifest.held = {b: number for b in self._write(panel, manifest)}
        self._commit(manifest)
        return self

    def upsert(self, arrived: DataFrame, order: list[str] | None = None) -> list[int]:
        """Adds rows or replaces those of the same keys and ids; gives the touched buckets.

        Of several arrivals of a row the last by ``order`` (then by the other
        columns) counts. Only the buckets that arrivals fall into are read and written.
        """
        manifest = self.manifest()
        number = self._next()
        columns = manifest.schema.names
        staged_path = f"{self.path}/arrived/version={number}"
        staged = arrived.withColumn("_bucket", self.bucket(manifest.n_buckets))
        lead = [c for c in order or [] if c not in columns]
        staged.select(*columns, *lead, "_bucket").write.mode("overwrite").parquet(staged_path)
        # the stored arrivals decide what is touched, also if this is a second try
        staged = self.spark.read.parquet(staged_path)
        touched = sorted(r["_bucket"] for r in staged.select("_bucket").distinct().collect())
        if not touched:
            return []
        old = self._rows(manifest, touched).withColumn("_new", F.lit(0))
        new = staged.drop("_bucket").withColumn("_new", F.lit(1))
        both = old.unionByName(new, allowMissingColumns=True)
        self._replace(manifest, number, _last(both, [*self.keys, *self.ids], ["_new", *(order or [])]).select(*columns), touched)
        return touched

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Writes ``buckets`` anew; ``rows`` are all their rows."""
        self._replace(self.manifest(), self._next(), rows, buckets)

    def _replace(self, manifest: Manifest, number: int, rows: DataFrame, buckets: list[int]) -> None:
        written = self._write(rows, Manifest(number, manifest.n_buckets, manifest.schema))
        held = {b: v for b, v in manifest.held.items() if b not in buckets}
        self._commit(Manifest(number, manifest.n_buckets, manifest.schema, held | {b: number for b in written}))

    def _next(self) -> int:
        return 1 + max(self.versions(), default=0)

    def _write(self, rows: DataFrame, manifest: Manifest) -> list[int]:
        """Writes rows by bucket, a bucket's rows together; gives the buckets that have any."""
        path = f"{self.path}/data/version={manifest.version}"
        dealt = rows.select(*manifest.schema.names).withColumn("bucket", self.bucket(manifest.n_buckets))
        # AQE still splits an oversized bucket
        dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(StructType([*manifest.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
        return [r["bucket"] for r in written.select("bucket").distinct().collect()]

    def _commit(self, manifest: Manifest) -> None:
        rows = [(b, v, manifest.n_buckets, manifest.schema.json()) for b, v in sorted(manifest.held.items())]
        rows = rows or [(None, None, manifest.n_buckets, manifest.schema.json())]
        table = self.spark.createDataFrame(rows, "bucket int, held int, n_buckets int, schema string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={manifest.version}")

    def vacuum(self, keep: int = 1) -> list[int]:
        """Deletes all but the last ``keep`` versions, and the folders that none of those names; gives the deleted versions."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        held = {(b, v) for k in kept for b, v in self.manifest(k).held.items()}
        dropped = {(b, v) for g in gone for b, v in self.manifest(g).held.items()} - held
        paths = [f"data/version={v}/bucket={b}" for b, v in sorted(dropped)]
        paths += [f"{folder}/version={g}" for g in gone for folder in ("arrived", "manifest")]
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
        return gone


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so that a key with many versions is no hot key."""
    columns = [c for c in rows.columns if c not in keys]
    lead = [*order, *[c for c in columns if c not in order]]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_last"))
    return newest.select(*keys, "_last.*")
