"""Stored tables whose pieces can be replaced: readers see all of one version or all of the next.

A table's folder holds data folders, each written once, and one small manifest per
version that names the folder of every piece (a hash bucket, or a date).  A change
writes the pieces that it touches to a new data folder and then publishes a manifest;
until that is there, readers see the version before, and a job that dies half-way has
changed nothing.  Pieces that a change does not touch keep their files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.addresses import is_private
from trapline.operators.addresses import merge_scores
from trapline.schemas import TABLES

PIECE = "piece"
# Hash buckets of a table without dates.
BUCKETS = 64


def bucket_of(column: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("string")


def date_of(column: str) -> Column:
    return F.col(column).cast("date").cast("string")


class VersionedTable:
    """A table in ``folder`` with a schema and the piece that each row belongs to.

    Changes come from one job at a time; of two that publish the same version, the second fails and may be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, piece: Column):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.piece = F.coalesce(piece, F.lit("none"))
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = self._path(self.folder)
        self._system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def version(self) -> int:
        """The newest published version; 0 for a table that is not there yet."""
        path = self._path(f"{self.folder}/manifest")
        if not self._system.exists(path):
            return 0
        names = (status.getPath().getName() for status in self._system.listStatus(path))
        return max((int(found[1]) for name in names if (found := re.fullmatch(r"(\d+)\.json", name))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"pieces": {}, "done": {}}
        stream = self._system.open(self._path(f"{self.folder}/manifest/{version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict, version: int) -> None:
        """Written beside and renamed, so that a manifest is there whole or not at all; fails if the version is taken."""
        beside = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        stream = self._system.create(beside, False)
        stream.write(json.dumps(manifest, sort_keys=True).encode())
        stream.close()
        target = self._path(f"{self.folder}/manifest/{version}.json")
        if self._system.exists(target) or not self._system.rename(beside, target):
            raise RuntimeError(f"version {version} of {self.folder} was published by another job")

    # Rows

    def read(self, pieces: list[str] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some pieces, whose files alone are then opened."""
        listed = self.manifest(version)["pieces"]
        folders = [f"{self.folder}/data/{at}" for piece, at in sorted(listed.items()) if pieces is None or piece in pieces]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def pieces_of(self, rows: DataFrame) -> list[str]:
        """The pieces of the rows: buckets or dates, of which there are few."""
        return sorted(row[0] for row in rows.select(self.piece.alias(PIECE)).distinct().collect())

    def replace(self, rows: DataFrame, pieces: list[str], done: dict[str, int] | None = None) -> None:
        """Put ``rows`` in the place of the given pieces, to which they must belong; a piece without rows is gone.

        ``done`` is noted with the version: by name of a stream, its last batch.
        """
        version = self.version()
        manifest = self.manifest(version)
        name = uuid.uuid4().hex
        kept = {piece: at for piece, at in manifest["pieces"].items() if piece not in set(pieces)}
        dated = rows.withColumn(PIECE, self.piece)
        # Rows of a piece come together; large pieces are split and small ones joined.
        dated.hint("rebalance", PIECE).write.partitionBy(PIECE).parquet(f"{self.folder}/data/{name}")
        for status in self._system.listStatus(self._path(f"{self.folder}/data/{name}")):
            folder = status.getPath().getName()
            if folder.startswith(f"{PIECE}="):
                piece = folder.removeprefix(f"{PIECE}=")
                if piece in kept:
                    raise ValueError(f"piece {piece} is there and was not to be replaced")
                kept[piece] = f"{name}/{folder}"
        self._publish({"pieces": kept, "done": manifest["done"] | (done or {})}, version + 1)

    def change(self, touched: list[str], change: Callable[[DataFrame], DataFrame], done: dict[str, int] | None = None) -> None:
        """Replace the touched pieces by what ``change`` makes of their rows."""
        if touched:
            self.replace(change(self.read(touched)), touched, done)


def score_store(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable(spark, folder, TABLES["ip_scores"], bucket_of("ip", buckets))


def attempt_store(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, folder, TABLES["attempts"], date_of("timestamp"))


def captured_store(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, folder, TABLES["captured_files"], date_of("timestamp"))


def upsert_scores(store: VersionedTable, updates: DataFrame, done: dict[str, int] | None = None) -> None:
    """Merge updates into the stored scores; only the buckets that they fall into are rewritten."""
    store.change(store.pieces_of(updates), lambda current: merge_scores(current, updates.select(*current.columns)), done)


def stream_scores(updates: DataFrame, store: VersionedTable, checkpoint: str):
    """Writer that merges the scores of each batch once: the manifest knows the last batch of each checkpoint."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if store.manifest()["done"].get(checkpoint, -1) < batch_id:
            upsert_scores(store, batch, {checkpoint: batch_id})

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def purge_store(attempts: VersionedTable, files: VersionedTable | None = None) -> None:
    """Drop private sources from stored attempts, and first their captured files; only dates that hold some are rewritten.

    A purge that died half-way may be repeated: files are matched by the attempts, which go last.
    """
    private = attempts.read().filter(is_private(F.col("src_ip")))
    if files is not None:
        keys = private.select(F.col("id").alias("attempt_id"), "session_id").distinct()
        hit = files.read().join(keys, ["attempt_id", "session_id"], "left_semi")
        files.change(
            files.pieces_of(hit),
            lambda rows: rows.join(keys, ["attempt_id", "session_id"], "left_anti").select(*rows.columns),
        )
    attempts.change(attempts.pieces_of(private), lambda rows: rows.filter(~is_private(F.col("src_ip"))))
