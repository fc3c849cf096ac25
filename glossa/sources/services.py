"""Term services as sources: an injected client answers terms, dealt over tasks, with retries.

A client is a function of one term that returns its answers; it must be picklable, and nothing here knows a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Client = Callable[[str], list[str]]
SCHEMA = "term string, answer string"


def ask(client: Client, term: str, retries: int = 3, delay: float = 0.5) -> list[str]:
    """What a client answers, asked again up to ``retries`` times, after twice the wait each time; then its error."""
    for n in range(retries + 1):
        try:
            return client(term)
        except Exception:
            if n == retries:
                raise
            time.sleep(delay * 2**n)
    return []


def answers(terms: DataFrame, client: Client, term: str = "sf", tasks: int = 8, pattern: str = "{}", retries: int = 3, delay: float = 0.5) -> DataFrame:
    """(term, answer): each distinct term of a table asked once in a run of its task; a term without answers gives no row.

    ``tasks`` bounds how many clients ask at a time. ``pattern`` is how the service names a term, as in
    ``{}_(disambiguation)``. Null terms aren't asked. A task that is run again asks its terms again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, a) for t in batch["term"] for a in ask(client, pattern.format(t), retries, delay)]
            yield pd.DataFrame(rows, columns=["term", "answer"])

    asked = terms.select(F.col(term).cast("string").alias("term")).where("term is not null").distinct()
    return asked.repartition(tasks, "term").mapInPandas(run, SCHEMA)


class _Share(InputPartition):
    def __init__(self, terms: list[str]) -> None:
        super().__init__(None)
        self.terms = terms


class _Reader(DataSourceReader):
    def __init__(self, client: Client, options: dict[str, str]) -> None:
        self.client, self.pattern = client, options.get("pattern", "{}")
        self.terms = sorted(set(json.loads(options["terms"])))
        self.tasks = int(options.get("tasks", "8"))
        self.retries, self.delay = int(options.get("retries", "3")), float(options.get("delay", "0.5"))

    def partitions(self) -> list[InputPartition]:
        dealt = [self.terms[i :: self.tasks] for i in range(self.tasks)]
        return [_Share(terms) for terms in dealt if terms] or [_Share([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for term in partition.terms:
            for answer in ask(self.client, self.pattern.format(term), self.retries, self.delay):
                yield term, answer


def register(spark: SparkSession, name: str, client: Client) -> None:
    """Make ``spark.read.format(name)`` read (term, answer) from a client.

    Options: ``terms`` (a JSON list; a table of terms goes through ``answers``), ``pattern``, ``tasks``, ``retries``,
    ``delay`` in seconds.
    """

    class TermService(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(client, self.options)

    spark.dataSource.register(TermService)
