"""Records from services: pages as a data source with one partition a page, answers to ids in chunks, bounded retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, WAIT, TIMEOUT = 5, 1.0, 60.0  # attempts, seconds before the second (doubled each time), seconds for one


def fetch(url: str, body: bytes | None = None, tries: int = TRIES, wait: float = WAIT) -> bytes:
    """What the service answers. Refused connections, time-outs, 429 and errors of the server are tried again; other
    refusals, and the last failure, raise, which fails the task, which Spark starts again elsewhere."""
    for i in range(1, tries + 1):
        try:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"} if body is not None else {})
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if i == tries or e.code < 500 and e.code != 429:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if i == tries:
                raise
        time.sleep(wait * 2 ** (i - 1))
    raise AssertionError


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.pages = options["url"], int(options["pages"])
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))
        self.field = options.get("field")

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple[int, int, str]]:
        answer = json.loads(fetch(self.url.replace("{page}", str(partition.number)), None, self.tries, self.wait))
        for i, record in enumerate(answer[self.field] if self.field else answer):
            yield partition.number, i, json.dumps(record, sort_keys=True)


class PagedJson(DataSource):
    """``spark.dataSource.register(PagedJson)``, then ``spark.read.format("paged_json")`` with the options ``url`` (holds
    ``{page}``), ``pages``, and where they aren't the defaults ``field`` (of the answer, with the records), ``tries`` and
    ``wait``. Rows: page, place, record (JSON text, for from_json). Each page is a partition, so pages are fetched by as
    many tasks as the cluster runs, and a lost task fetches its own page again."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, place int, record string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def fetch_by_ids(df: DataFrame, key: str, url: str, chunk: int = 50_000, tries: int = TRIES, wait: float = WAIT, chunks_at_once: int | None = None) -> DataFrame:
    """Each different id with the service's record (JSON text; null if it has none): key, record.

    A request posts a JSON list of at most ``chunk`` ids and gets an object from ids to records. ``chunks_at_once``
    bounds the tasks, and so the requests at a time. Null ids aren't asked for.
    """
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def answer(ids: list[str]) -> pd.DataFrame:
            found = json.loads(fetch(url, json.dumps(ids).encode(), tries, wait))
            return pd.DataFrame({key: ids, "record": [json.dumps(found[i], sort_keys=True) if found.get(i) is not None else None for i in ids]})

        for b in batches:
            held += b[key].tolist()
            while len(held) >= chunk:
                yield answer(held[:chunk])
                held = held[chunk:]
        if held:
            yield answer(held)

    ids = df.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return (ids.repartition(chunks_at_once) if chunks_at_once else ids).mapInPandas(ask, f"`{key}` string, record string")
