"""A Python data source over stored answers: format("replay").

The folder holds one file per request, <keyword>/<platform>/<step>-<page>.<ext>. Each file is
one input partition. A file that cannot be read yields no rows and one row in `error`, so one
failure never ends a run."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "keyword string, platform string, step int, page int, payload string, error string"


class _Answer(InputPartition):
    def __init__(self, path: str, key: tuple[str, str, int, int]) -> None:
        self.path, self.key = path, key


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("maxpages", options.get("maxPages", 0)) or 0)

    def partitions(self):
        found = []
        for keyword in sorted(os.listdir(self.root)):
            for platform in sorted(os.listdir(os.path.join(self.root, keyword))):
                for name in sorted(os.listdir(os.path.join(self.root, keyword, platform))):
                    step, _, page = name.partition(".")[0].partition("-")
                    if step.isdigit() and page.isdigit() and (not self.most or int(page) <= self.most):
                        found.append(_Answer(os.path.join(self.root, keyword, platform, name), (keyword, platform, int(step), int(page))))
        return found

    def read(self, partition):
        try:
            with open(partition.path, encoding="utf-8") as f:
                yield (*partition.key, f.read(), None)
        except (OSError, UnicodeError) as e:
            yield (*partition.key, None, f"{type(e).__name__}: {e}")


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
