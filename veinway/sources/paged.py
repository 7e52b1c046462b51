"""Connectors to paged services as a PySpark data source, in batch and as a stream whose offset is the cursor."""

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, title string, body string, updated_at long"


def client(options: dict[str, str]):
    """The object named by the option `client` ("module:name"): pages() -> int and page(i, since) -> rows as tuples."""
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(client(self.options).pages())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from client(self.options).page(partition.value, int(self.options.get("since", 0)))


class PagedStreamReader(SimpleDataSourceStreamReader):
    """Each batch reads what is newer than the cursor; the cursor is the latest updated_at that was seen."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": int(self.options.get("since", 0))}

    def _rows(self, since: int) -> list[tuple]:
        c = client(self.options)
        return [row for i in range(c.pages()) for row in c.page(i, since)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["since"])
        return iter(rows), {"since": max([start["since"], *(r[3] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for r in self._rows(start["since"]) if r[3] <= end["since"]])


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("client", "module:name").load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return PagedStreamReader(self.options)
