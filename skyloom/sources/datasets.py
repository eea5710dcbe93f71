"""Named datasets: a table, its columns by key, side inputs and digest, from the library's hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.catalog import datasets, digests, side_inputs
from skyloom.functions.text import hex_digest, state_text
from skyloom.operators.splits import split_by_rank
from skyloom.plans.config import DatasetConfig
from skyloom.sources.samples import project, read_through, with_fixed


@dataclass(frozen=True)
class Dataset:
    """Samples of a source under a configuration; ``source`` gives the table, ``order`` ranks it for the splits."""

    name: str
    config: DatasetConfig
    source: Callable[[SparkSession], DataFrame]
    order: str
    fixed: str | None = None

    def active(self, split: str) -> Dataset:
        """The same dataset with another active split."""
        return replace(self, config=replace(self.config, split=split))

    def digest(self, spark: SparkSession) -> str:
        """First eight hex digits of the state: the split, the keys or what a registered provider names, and the save size."""
        named = digests.build(self.name, self.config) if self.name in digests else list(self.config.keys)
        return spark.range(1).select(hex_digest(state_text(F.lit(self.config.split), named, F.lit(self.config.save_batch_size)))).first()[0]

    def samples(self, spark: SparkSession) -> DataFrame:
        """Rows of the active split: computed from the source and saved under the digest, or read where they are saved."""

        def compute() -> DataFrame:
            rows = split_by_rank(self.source(spark), [self.order]).where(F.col("split") == self.config.split)
            rows = project(rows, list(self.config.keys), (self.order,)) if self.config.keys else rows.drop("idx", "split")
            return with_fixed(rows, side_inputs.build(self.fixed, spark)) if self.fixed else rows

        return read_through(spark, str(self.config.path), self.digest(spark), compute, only_saved=self.config.only_saved)

    def view(self, spark: SparkSession) -> str:
        """Make the active split a temporary view; its name."""
        self.samples(spark).createOrReplaceTempView(view := f"{self.name}_{self.config.split}")
        return view


def dataset(name: str, config: DatasetConfig) -> Dataset:
    """A registered dataset under a configuration."""
    return datasets.build(name, config)


# The columns of stored downscaling samples.
SAMPLE_KEYS = (
    "height_in_idx", "width_in_idx", "height_out_idx", "width_out_idx", "lat", "lon", "year", "month", "day", "hour", "use_hrdps_upscale", "input_first_block", "input_last_layer", "target",
)


@datasets.register("downscaling")
def downscaling(config: DatasetConfig, table: str = "samples", order: str = "sample_id") -> Dataset:
    """Samples in a table of the session, with the keys of the configuration or all."""
    return Dataset("downscaling", config if config.keys else replace(config, keys=SAMPLE_KEYS), lambda spark: spark.table(table), order)
