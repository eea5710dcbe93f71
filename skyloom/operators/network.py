"""Weight layouts of U-shaped networks as tables, and their parameter counts.

Networks aren't run here: training and inference are no work for this library.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.files import latest_save
from skyloom.plans.config import ManagerConfig
from skyloom.sources.samples import load_weights

Shape = tuple[int, ...]


class Layout:
    """Builds a network: each method names a step's weights; the steps are run by ``Network``."""

    def __init__(self):
        self.weights: dict[str, Shape] = {}
        self.fixed: dict[str, Shape] = {}  # running statistics, no parameters

    def conv(self, name: str, cin: int, cout: int, k: int, bias: bool = False) -> None:
        if k % 2 == 0:
            raise ValueError("kernels have an odd size")
        self.weights[f"{name}.weight"] = (cout, cin, k, k)
        if bias:
            self.weights[f"{name}.bias"] = (cout,)

    def norm(self, name: str, c: int) -> None:
        self.weights |= {f"{name}.weight": (c,), f"{name}.bias": (c,)}
        self.fixed |= {f"{name}.mean": (c,), f"{name}.var": (c,)}

    def transpose(self, name: str, cin: int, cout: int, h: int = 2, w: int = 2) -> None:
        self.weights |= {f"{name}.weight": (cin, cout, h, w), f"{name}.bias": (cout,)}

    def double(self, name: str, cin: int, cout: int, k: int) -> None:
        self.conv(f"{name}.c1", cin, cout, k)
        self.norm(f"{name}.n1", cout)
        self.conv(f"{name}.c2", cout, cout, k)
        self.norm(f"{name}.n2", cout)

    def dense(self, name: str, cin: int, more: int, layers: int, k: int, first: int | None = None) -> int:
        c = cin
        for i in range(layers):
            add = first if i == 0 and first is not None else more
            self.norm(f"{name}.{i}.n", c)
            self.conv(f"{name}.{i}.c", c, add, k)
            c += add
        return c

    def gate(self, name: str, c: int, ratio: int | None) -> None:
        if ratio is not None:
            r = max(c // ratio, 2)
            self.weights |= {f"{name}.a": (r, c), f"{name}.b": (c, r)}


class Network:
    """A U-Net (``dense=False``) or dense U-Net with the given sizes."""

    def __init__(self, cin: int, cout: int, hidden: int = 64, depth: int = 3, kernel: int = 3, resolution_increase: int = 0, ratio: int | None = None, last_inputs: int = 0, dense: bool = False, more: int = 16, layers: int = 2, bottom: tuple[int, int, int] | None = None):
        """``bottom``: height and width of the input and size of a linear input that joins at a 1x1 bottom."""
        self.depth, self.steps, self.kernel, self.ratio, self.is_dense, self.layers = depth, depth + resolution_increase, kernel, ratio, dense, layers
        self.bottom = None
        lay = Layout()
        if bottom is not None:
            h, w, linear = bottom
            if h % (1 << depth) or w % (1 << depth):
                raise ValueError("height and width divide by 2 down to the bottom")
            self.bottom = (h >> depth, w >> depth)
        if dense:
            if more <= cin or more % (1 << depth):
                raise ValueError("added channels exceed the inputs and divide by 2 at each depth")
            sizes = [lay.dense("in", cin, more, layers, kernel, more - cin)]
        else:
            lay.double("in", cin, hidden, kernel)
            sizes = [hidden]
        for d in range(depth):
            if dense:
                sizes.append(lay.dense(f"down{d}", sizes[-1], more, layers, kernel))
            else:
                sizes.append(2 * sizes[-1])
                lay.double(f"down{d}", sizes[-2], sizes[-1], kernel)
            lay.gate(f"down{d}.gate", sizes[-1], ratio)
        c = sizes[-1]
        if self.bottom:
            lay.transpose("bottom", c + linear, c, *self.bottom)
        for u in range(self.steps):
            skip = sizes[depth - 1 - u] if u < depth else 0
            extra = last_inputs if u == self.steps - 1 else 0
            lay.transpose(f"up{u}.t", c, c // 2)
            inner = c // 2 + skip + extra
            if dense:
                c = lay.dense(f"up{u}", inner, more, layers, kernel)
            else:
                c = c // 2
                lay.double(f"up{u}", inner, c, kernel)
            lay.gate(f"up{u}.gate", c, ratio)
        lay.conv("out", c, cout, kernel, bias=True)
        self.layout = lay

    def parameter_rows(self) -> list[tuple[str, list[int]]]:
        return [(n, list(s)) for n, s in self.layout.weights.items()]


def networks_of(manager: ManagerConfig) -> dict[str, Network]:
    """Layouts of a manager's networks by name."""
    return {name: Network(c.in_channels, c.out_channels, c.hidden, c.depth, resolution_increase=c.resolution_increase_layers, ratio=c.reduction_ratio) for name, c in manager.networks.items()}


def restored(spark: SparkSession, manager: ManagerConfig, files: DataFrame, saves: DataFrame) -> DataFrame:
    """The weights of the manager's last save: a row an array, with its network. Networks are few."""
    found = latest_save(files, saves, manager.experiment or None, str(manager.path)).where(F.col("network").isin(list(manager.networks))).collect()
    rows = [load_weights(spark, r["path"], r["network"]) for r in found]
    if not rows:
        raise FileNotFoundError(f"no checkpoint of {sorted(manager.networks)} in {manager.path}")
    return reduce(DataFrame.unionByName, rows)


def parameter_counts(layers: DataFrame) -> DataFrame:
    """network, parameters and trainable ones from rows (network, name, shape, trainable), with a row ``total`` over all networks."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n.cast("long"))
    sized = layers.select("network", size.alias("n"), F.when(F.col("trainable"), size).otherwise(0).alias("t"))
    return sized.rollup("network").agg(F.sum("n").alias("parameters"), F.sum("t").cast("long").alias("trainable")).withColumn("network", F.coalesce("network", F.lit("total")))


def layout_table(spark: SparkSession, networks: dict[str, Network], frozen: tuple[str, ...] = ()) -> DataFrame:
    """A row a weight array: network, name, shape and whether it is trainable (its name begins with none of ``frozen``)."""
    rows = [(n, name, shape, not name.startswith(frozen) if frozen else True) for n, net in networks.items() for name, shape in net.parameter_rows()]
    return spark.createDataFrame(rows, "network string, name string, shape array<int>, trainable boolean").coalesce(1)
