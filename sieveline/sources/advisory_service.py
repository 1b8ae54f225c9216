"""Advisories straight from a service that speaks the public OSV query protocol, as a Spark data source.

Packages are dealt over partitions and each is asked for in its task, so that a long list is fetched by many executors and a
lost one only repeats its own packages. A package that can't be had is a row with an error, not a failed job.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.sources import advisories

#: Seconds before each repetition, of a request and between packages; pages of a package.
WAITS, PAUSE, TIMEOUT, PAGES = (1, 2, 4), 0.1, 30, 10
#: The ecosystems that can be asked for.
ECOSYSTEMS = ("PyPI", "npm", "Go", "Packagist")


class Packages(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url = options["url"]
        self.ecosystem = options["ecosystem"]
        self.names = json.loads(options.get("packages", "[]"))
        self.parts = max(1, int(options.get("partitions", "8")))

    def partitions(self) -> list[Packages]:
        return [Packages(self.names[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.names))))]

    def read(self, partition: Packages) -> Iterator[tuple]:
        for k, name in enumerate(partition.names):
            if k:
                time.sleep(PAUSE)
            try:
                for record in self._records(name):
                    yield self.ecosystem, name, json.dumps(record), None
            except (OSError, ValueError) as e:  # no connection, refused, or no JSON
                yield self.ecosystem, name, None, str(e)

    def _records(self, name: str) -> Iterator[dict]:
        ask = {"package": {"ecosystem": self.ecosystem, "name": name}}
        for _ in range(PAGES):
            page = self._post(ask)
            yield from page.get("vulns", ())
            if not page.get("next_page_token"):
                return
            ask["page_token"] = page["next_page_token"]

    def _post(self, ask: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(ask).encode(), {"Content-Type": "application/json"})
        waits = iter(WAITS)
        while True:
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                wait = next(waits, None) if e.code == 429 or e.code >= 500 else None
                if wait is None:
                    raise
                time.sleep(wait)


class AdvisoryService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "advisory_service"

    def schema(self) -> str:
        return "ecosystem string, package string, record string, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def fetch(spark: SparkSession, url: str, ecosystem: str, packages: list[str], partitions: int = 8) -> DataFrame:
    """ecosystem, package, record (JSON) and error; a row for each advisory and for each package that couldn't be had."""
    if ecosystem not in ECOSYSTEMS:
        raise ValueError(f"unknown ecosystem {ecosystem}; there are {', '.join(ECOSYSTEMS)}")
    spark.dataSource.register(AdvisoryService)
    said = {"url": url, "ecosystem": ecosystem, "packages": json.dumps(packages), "partitions": str(partitions)}
    return spark.read.format("advisory_service").options(**said).load()


def read(fetched: DataFrame) -> DataFrame:
    """The fetched advisories, flattened."""
    return advisories.flatten(fetched.where("record is not null").select(F.from_json("record", advisories.SCHEMA).alias("r")).select("r.*"))
