"""Incremental ingest: new files become appends to a store, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..dataset import Loaded, VDataset
from ..functions import keys
from ..sinks.store import Store


def _done(store: Store, name: str, batch: int) -> bool:
    return any(c["properties"].get("ingest") == name and c["properties"].get("batch", -1) >= batch for c in store.commits())


def append_batch(store: Store, datasets: list[VDataset], dim: str, name: str, batch: int, group: str = "", validate_containers: bool = True) -> str | None:
    """Append datasets in order of their first label on ``dim``, in one commit; None if the batch was written before.

    Labels below the last stored one are late: they are refused, and belong into a region write.
    """
    from ..dataset import concat

    if not datasets or _done(store, name, batch):
        return None
    labelled = all(isinstance(d.variables.get(dim), Loaded) for d in datasets)
    if labelled:
        datasets = sorted(datasets, key=lambda d: d.variables[dim].values[0])
    whole = datasets[0] if len(datasets) == 1 else concat(datasets, dim)
    exists = bool(store.snapshot()["nodes"].get(group.strip("/"), {}).get("arrays"))
    if exists and labelled:
        have = store.open(group=group or None).arrays.get(dim)
        if isinstance(have, Loaded) and have.values.size and whole.variables[dim].values[0] <= have.values[-1]:
            raise ValueError(f"late labels on {dim!r}: {whole.variables[dim].values[0]} isn't after {have.values[-1]}; write them as a region")
    return store.write(whole, group=group, append_dim=dim if exists else None, validate_containers=validate_containers, message=f"{name} batch {batch}", properties={"ingest": name, "batch": batch})


def ingest(spark: SparkSession, folder: str, pattern: str, open_file: Callable[[str], VDataset], store: Store, dim: str, checkpoint: str, name: str = "ingest", group: str = "", max_files: int | None = None) -> StreamingQuery:
    """A query that appends the files which appear in a folder; batches written before a failure aren't written again."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, number: int) -> None:
        # names alone: the column of contents isn't read
        files = sorted(keys.uri("/" + r["path"].removeprefix("file:").lstrip("/")) if r["path"].startswith("file:") else r["path"] for r in batch.select("path").collect())
        append_batch(store, [open_file(f) for f in files], dim, name, number, group)

    return source.load(keys.uri(folder)).select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(store: Store, planned: DataFrame, name: str) -> DataFrame:
    """Rows of ``planned`` (batch, ...) that no commit of this ingest has."""
    done = [(c["properties"]["batch"],) for c in store.commits() if c["properties"].get("ingest") == name]
    return planned.join(planned.sparkSession.createDataFrame(done, "batch bigint"), "batch", "left_anti")
