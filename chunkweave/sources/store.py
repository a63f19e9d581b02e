"""Groups out of a transactional store, as a parser."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dataset import VGroup
from ..sinks.store import Store


class StoreParser:
    """``parser(spark, url)`` of a store at a branch, tag or snapshot; one of these at most."""

    def __init__(self, branch: str | None = None, tag: str | None = None, snapshot_id: str | None = None, group: str | None = None, skip_variables=()):
        if sum(x is not None for x in (branch, tag, snapshot_id)) > 1:
            raise ValueError("give one of branch, tag and snapshot_id at most")
        self.where = {"branch": branch, "tag": tag, "snapshot_id": snapshot_id}
        self.group, self.skip_variables = group, tuple(skip_variables or ())

    def __call__(self, spark: SparkSession, url: str) -> VGroup:
        return Store(spark, url, read_only=True).open(self.group, skip_variables=self.skip_variables, **self.where)
