"""Cells gathered into bags as they arrive, with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such queries need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def split_malformed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of cells(key, cell_id, values), streaming or not, those that can be bagged, and the others with a problem."""
    problem = (
        F.when(F.col("key").isNull(), "no key").when(F.col("cell_id").isNull(), "no cell").when(F.col("values").isNull(), "no values").when(F.exists("values", lambda x: x.isNull()), "a value is null")
    )
    marked = cells.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


class BagProcessor(StatefulProcessor):
    """Holds the cells of a key that don't fill a bag yet, and the number of bags given."""

    def __init__(self, num_cells: int):
        self.num_cells = num_cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "cell_id long, values array<int>")
        self.given = handle.getValueState("given", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        """The bags that are full now: the cells that wait, then those that arrived, in order of their ids."""
        arrived = pd.concat(rows, ignore_index=True).sort_values("cell_id", kind="stable")
        cells = [(c, list(v)) for c, v in self.waiting.get()] if self.waiting.exists() else []
        cells += [(int(c), [int(x) for x in v]) for c, v in zip(arrived["cell_id"], arrived["values"])]
        given, n = int(self.given.get()[0]) if self.given.exists() else 0, self.num_cells
        full = len(cells) // n
        bags = [(key[0], given + i, [c for c, _ in cells[i * n : (i + 1) * n]], [x for _, v in cells[i * n : (i + 1) * n] for x in v]) for i in range(full)]
        rest = cells[full * n :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.given.update((given + full,))
        yield pd.DataFrame(bags, columns=["key", "bag_no", "cell_ids", "values"])

    def close(self) -> None:
        pass


def bag_stream(cells: DataFrame, num_cells: int) -> DataFrame:
    """(key, bag_no, cell_ids, values): of a stream of cells(key, cell_id, values) num_cells each, as soon as they are there.

    Each key has bags of its own, filled in the order of arrival, by id within a micro-batch; cells that don't fill a bag wait in the state store, also over
    restarts. Keys are dealt to tasks, so a source with very many cells should have several, such as a hash of the cell added to its name.
    Malformed cells must be split off before.
    """
    kind = cells.schema["key"].dataType.simpleString()
    return cells.select("key", "cell_id", F.col("values").cast("array<int>").alias("values")).groupBy("key").transformWithStateInPandas(
        statefulProcessor=BagProcessor(num_cells), outputStructType=f"key {kind}, bag_no long, cell_ids array<long>, values array<int>", outputMode="Append", timeMode="None"
    )


def write_bags(cells: DataFrame, num_cells: int, path: str, side_path: str, checkpoint: str) -> list:
    """Start the queries that append the bags of a stream to Parquet files below path, and its malformed cells to those below side_path.

    They end when all that is there has been read, and go on from there when started again with the same checkpoint folder.
    """
    spark = cells.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    good, bad = split_malformed(cells)
    start = lambda rows, to, at: rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{checkpoint}/{at}").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set(name, PROVIDER)
    try:
        return [start(bag_stream(good, num_cells), path, "bags"), start(bad, side_path, "side")]
    finally:
        spark.conf.set(name, before)
