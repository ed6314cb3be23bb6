"""One active run for an output folder: numbered leases, made by a create that succeeds once.

The greatest number holds the folder until it is given back, or until its holder has not been heard of for `patience`
seconds. A run whose lease was taken over finds a greater number when it is about to commit, and writes nothing more.
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from quoin import storage

PATIENCE = 3600.0


class RunActive(RuntimeError):
    """The output folder belongs to another run."""


class Lease:
    def __init__(self, spark: SparkSession, output_dir: str, job: str, patience: float = PATIENCE):
        self.spark, self.folder, self.job, self.patience = spark, f"{output_dir}/leases", job, patience
        self.number = self._take()

    def _numbers(self) -> list[int]:
        return sorted({int(n.partition(".")[0]) for n in storage.names(self.spark, self.folder) if n.endswith(".json")})

    def _take(self) -> int:
        have = self._numbers()
        if have:
            last = have[-1]
            held = f"{self.folder}/{last:012d}"
            ended = f"{last:012d}.ended" in storage.names(self.spark, self.folder)
            heard = storage.latest(self.spark, f"{held}.heard")
            at = heard["at"] if heard else storage.modified(self.spark, f"{held}.json")
            if not ended and time.time() - at < self.patience:
                raise RunActive(f"job {storage.read_text(self.spark, f'{held}.json') or '?'} is writing to this folder")
        number = have[-1] + 1 if have else 0
        if not storage.create_new(self.spark, f"{self.folder}/{number:012d}.json", self.job):
            raise RunActive("another job has just taken this folder")
        return number

    def held(self) -> None:
        """To be called before each commit: raises if a later run has taken over, else tells that this one is alive."""
        if self._numbers()[-1] != self.number:
            raise RunActive(f"a later run has taken over from job {self.job}")
        storage.publish(self.spark, f"{self.folder}/{self.number:012d}.heard", {"at": time.time()})

    def end(self) -> None:
        storage.create_new(self.spark, f"{self.folder}/{self.number:012d}.ended", "")
