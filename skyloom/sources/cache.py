"""Tables kept under a digest, for several writers and after crashes.

A folder under the digest has data folders, one a writer, and a marker that names the one that counts. A
writer holds a lease, a file that only one can create, and renews it while it computes; others wait for the
marker, and take over a lease that wasn't renewed for ``LEASE`` seconds. What a crashed write leaves is in a
data folder that no marker names, and is never read.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.sources import files_api as files

#: Seconds after which a lease that isn't renewed is free; it is renewed four times as often.
LEASE = 60.0
_WAIT = 0.2


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table whose marker is there."""
    if not files.exists(spark, f"{path}/_committed"):
        return None
    return spark.read.parquet(f"{path}/{files.read(spark, f'{path}/_committed')}")


class _Lease:
    """A lease that is held, renewed in the background; ``lost`` once another owner has it."""

    def __init__(self, spark: SparkSession, path: str, owner: str, seconds: float):
        self.spark, self.path, self.owner = spark, path, owner
        self.ended = threading.Event()
        self.renewer = threading.Thread(target=self._renew, args=(seconds / 4,), daemon=True)
        self.renewer.start()

    def _renew(self, every: float) -> None:
        while not self.ended.wait(every):
            if self.held():
                files.touch(self.spark, self.path)

    def held(self) -> bool:
        return files.exists(self.spark, self.path) and files.read(self.spark, self.path) == self.owner

    def end(self) -> None:
        self.ended.set()
        self.renewer.join()
        if self.held():
            files.delete(self.spark, self.path)


def _take(spark: SparkSession, path: str, owner: str, seconds: float) -> bool:
    """Create the lease; one that wasn't renewed goes first. Of several callers that find it so, one renames it away."""
    if files.create(spark, path, owner):
        return True
    old = files.age(spark, path)
    if old is not None and old > seconds:
        stale = f"{path}.{uuid.uuid4().hex}"
        fs, source = files._at(spark, path)
        if fs.rename(source, files._at(spark, stale)[1]):
            files.delete(spark, stale)
    return False


def kept(spark: SparkSession, path: str, compute: Callable[[], DataFrame], lease: float = LEASE, patience: float = 86400.0) -> DataFrame:
    """The table committed under a path; where there is none, one caller computes and commits it and all read that."""
    owner, began = uuid.uuid4().hex, time.monotonic()
    while True:
        done = committed(spark, path)
        if done is not None:
            return done
        if _take(spark, f"{path}/_lease", owner, lease):
            break
        if time.monotonic() - began > patience:
            raise TimeoutError(f"{path} is neither committed nor free")
        time.sleep(_WAIT)
    held = _Lease(spark, f"{path}/_lease", owner, lease)
    try:
        # the one before may have committed between our look and our lease
        if committed(spark, path) is None:
            compute().write.parquet(f"{path}/data-{owner}")
            files.publish(spark, f"{path}/_committed", f"data-{owner}")
    finally:
        held.end()
    return committed(spark, path)


def sweep(spark: SparkSession, path: str) -> int:
    """Remove the data folders that the marker doesn't name; only where it is there and no lease is held."""
    if not files.exists(spark, f"{path}/_committed") or files.exists(spark, f"{path}/_lease"):
        return 0
    kept_name = files.read(spark, f"{path}/_committed")
    stray = [n for n in files.names(spark, path) if n.startswith("data-") and n != kept_name]
    for n in stray:
        files.delete(spark, f"{path}/{n}")
    return len(stray)
