"""A pass over items that can be resumed: what is done stays done, failures are counted, items that always fail are set aside.

Items are dealt into chunks by the leading bits of a hash of their key. A chunk is one Spark job that writes its
results to a folder of its own; then a line of the ledger, which appears whole, says so. A pass that
is started again leaves out the chunks whose lines are there, whatever killed it, and overwrites what an
unfinished chunk has left. A chunk that fails is tried again; after ``attempts`` failures it is halved by one more bit,
until what fails is a single key: its items are set aside with the error, and the pass goes on.

Only results of chunks that the ledger calls done are read, so a pass that was killed anywhere gives the same
table as one that wasn't. The ledger has a line a chunk and attempt, no matter how many items there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources import files_api as files

#: Bits of the hash; chunks of so many bits that hold several keys are set aside whole.
BITS = 62


@dataclass(frozen=True)
class Progress:
    """Chunks done and set aside, failed attempts, and whether all items are one or the other."""

    done: int
    aside: int
    failures: int
    complete: bool


class Pass:
    """A pass over the items of a table under a folder; ``process`` maps items to results."""

    def __init__(self, spark: SparkSession, folder: str, items: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], chunks: int = 16, attempts: int = 2):
        if chunks < 1 or chunks & (chunks - 1) or attempts < 1:
            raise ValueError("chunks are a power of two, attempts at least one")
        self.spark, self.folder, self.items, self.key, self.process = spark, folder.rstrip("/"), items, key, process
        self.depth, self.attempts = chunks.bit_length() - 1, attempts

    def _in(self, chunk: str) -> Column:
        bits = F.pmod(F.xxhash64(F.col(self.key)), F.lit(1 << BITS))
        return F.shiftright(bits, BITS - len(chunk)) == int(chunk, 2) if chunk else F.lit(True)

    def ledger(self) -> list[dict]:
        """All lines: chunk, what happened (done, failed, halved, aside) and the error."""
        found = [n for n in files.names(self.spark, f"{self.folder}/ledger") if n.endswith(".json")]
        return [json.loads(files.read(self.spark, f"{self.folder}/ledger/{n}")) for n in found]

    def _note(self, chunk: str, what: str, **more) -> None:
        files.publish(self.spark, f"{self.folder}/ledger/c{chunk}-{what}-{uuid.uuid4().hex}.json", json.dumps({"chunk": chunk, "what": what} | more))

    def run(self, most: int | None = None) -> Progress:
        """Do what isn't done, at most so many chunks; a restart is another call of the same pass."""
        lines = self.ledger()
        ended = {x["chunk"]: x["what"] for x in lines if x["what"] in ("done", "aside", "halved")}
        failed: dict[str, int] = {}
        for x in lines:
            if x["what"] == "failed":
                failed[x["chunk"]] = failed.get(x["chunk"], 0) + 1
        todo, tried = [format(i, f"0{self.depth}b") if self.depth else "" for i in range(1 << self.depth)][::-1], 0
        while todo:
            chunk = todo.pop()
            if ended.get(chunk) == "halved":
                todo += [chunk + "1", chunk + "0"]
                continue
            if chunk in ended:
                continue
            if most is not None and tried >= most:
                return self.progress()
            tried += 1
            part = self.items.where(self._in(chunk))
            try:
                # what an attempt that was killed has left goes
                self.process(part).write.mode("overwrite").parquet(f"{self.folder}/results/c{chunk}")
                self._note(chunk, "done")
                ended[chunk] = "done"
            except Exception as e:
                failed[chunk] = failed.get(chunk, 0) + 1
                self._note(chunk, "failed", error=f"{type(e).__name__}: {e}"[:2000])
                if failed[chunk] < self.attempts:
                    todo.append(chunk)
                elif len(chunk) < BITS and part.select(self.key).distinct().limit(2).count() > 1:
                    self._note(chunk, "halved")
                    ended[chunk] = "halved"
                    todo.append(chunk)
                else:
                    part.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:2000])).write.mode("overwrite").parquet(f"{self.folder}/aside/c{chunk}")
                    self._note(chunk, "aside")
                    ended[chunk] = "aside"
        return self.progress()

    def progress(self) -> Progress:
        lines = self.ledger()
        ends = {x["chunk"]: x["what"] for x in lines if x["what"] != "failed"}
        open_, todo = 0, [format(i, f"0{self.depth}b") if self.depth else "" for i in range(1 << self.depth)]
        while todo:
            chunk = todo.pop()
            if ends.get(chunk) == "halved":
                todo += [chunk + "0", chunk + "1"]
            elif chunk not in ends:
                open_ += 1
        counts = list(ends.values())
        return Progress(counts.count("done"), counts.count("aside"), sum(x["what"] == "failed" for x in lines), not open_)

    def _read(self, what: str, folder: str) -> DataFrame | None:
        paths = sorted(f"{self.folder}/{folder}/c{x['chunk']}" for x in self.ledger() if x["what"] == what)
        return self.spark.read.parquet(*dict.fromkeys(paths)) if paths else None

    def results(self) -> DataFrame | None:
        """Results of all chunks that are done; None before the first."""
        return self._read("done", "results")

    def set_aside(self) -> DataFrame | None:
        """Items that failed alone, with ``error``; None if there are none."""
        return self._read("aside", "aside")
