"""Keeping collections current while they are served.

Watcher reloads a catalog when a new version of a collection appears. follow() is the other side: a
Structured Streaming query over the files of a source folder that builds a new version of the
collection when files have come. A collection is never changed in place, so readers see either
version whole."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from frostline.plans.catalog import Catalog
from frostline.plans.stage import build
from frostline.sources.profile import Profile

log = logging.getLogger(__name__)


class Watcher:
    """Looks at the versions of all collections every so many seconds and refreshes on a change."""

    def __init__(self, catalog: Catalog, seconds: float = 2.0) -> None:
        self.catalog, self.seconds, self.seen = catalog, seconds, catalog.versions()
        self.stopped, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def look(self) -> bool:
        """One look; if it reloaded."""
        now = self.catalog.versions()
        if now == self.seen:
            return False
        self.catalog.refresh()
        self.seen = now
        return True

    def _run(self) -> None:
        while not self.stopped.wait(self.seconds):
            try:
                self.look()
            except Exception as e:  # noqa: BLE001  a later look may succeed
                log.warning("the collections could not be looked at: %s", e)

    def start(self) -> Watcher:
        self.thread.start()
        return self

    def stop(self) -> None:
        self.stopped.set()


def follow(spark: SparkSession, profile: Profile, output: str, checkpoint: str, schema: StructType, file_format: str = "parquet", every: str = "10 seconds", once: bool = False) -> StreamingQuery:
    """Builds the collection anew for each batch of files that come to the folder profile.path. once: takes
    what there is and ends."""

    def rebuild(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            build(batch.sparkSession, profile, output)

    files = spark.readStream.schema(schema).format(file_format).load(profile.path)
    writer = files.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
