"""Register services as a Spark data source: an adapter turns a name into rows; without a network, saved payloads stand in for the service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "asked string, name string, identifier string, lei string, registered_as string, jurisdiction string, status string"
#: Makes a payload, as JSON text, of a name that is asked for.
Opener = Callable[[str, int], str]
_ADAPTERS: dict[str, Opener] = {}


def register_adapter(name: str, opener: Opener) -> None:
    _ADAPTERS[name] = opener


def adapters() -> list[str]:
    return sorted(_ADAPTERS)


def records(asked: str, payload: str) -> Iterator[tuple]:
    """Rows of a payload of legal-entity records; those without a name or any identifier are none."""
    for record in (json.loads(payload or "{}") or {}).get("data") or []:
        told = record.get("attributes") or {}
        entity = told.get("entity") or {}
        name, number = (entity.get("legalName") or {}).get("name"), entity.get("registeredAs")
        if name and (number or told.get("lei")):
            yield asked, name, number or told.get("lei"), told.get("lei"), number, entity.get("jurisdiction"), entity.get("status") or ""


class _Asked(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    """One partition for each name, so that a slow answer holds up no other."""

    def __init__(self, opener: Opener, names: list[str], limit: int) -> None:
        self.opener, self.names, self.limit = opener, names, limit

    def partitions(self) -> list[InputPartition]:
        return [_Asked(n) for n in self.names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(partition.name, self.opener(partition.name, self.limit))


def source(name: str) -> type[DataSource]:
    """The data source of a registered adapter, to be read with the options ``names`` (a JSON list) and ``limit``."""
    opener = _ADAPTERS[name]

    class Register(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"register_{name}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(opener, json.loads(self.options.get("names", "[]")), int(self.options.get("limit", "10")))

    return Register


def fetch(spark: SparkSession, adapter: str, names: list[str], limit: int = 10):
    """Rows that a service has for names; they are for a person to look at, and become a staged register only by ``register_rows``."""
    spark.dataSource.register(source(adapter))
    return spark.read.format(f"register_{adapter}").option("names", json.dumps(names)).option("limit", str(limit)).load()
