"""Tables behind HTTP: a data source that reads JSON rows in parallel pages, with retries.

    spark.dataSource.register(HttpJsonSource)
    spark.read.format("http_json").schema("id long, name string").option("url", "https://.../api/vehicles").load()

The first request asks for no rows, only how many there are (``total_header``); pages of ``page_rows`` rows are then partitions
of their own (``offset`` and ``limit`` in the address). A server that gives no total is read by one partition, page after page until one
comes short, or, where ``paged`` is false, in one request. The names of the schema go along as ``fields``, so only these columns travel.
Requests that fail, time out or come back with 429 or 5xx are repeated ``retries`` times, each after twice the wait.

Values become the schema's types; what can't is null, as are missing fields. Rows may stand in a field (``rows``) of the answer. A request that
still fails ends the query: a table is whole or not there.
"""

from __future__ import annotations

import datetime
import decimal
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULTS = {"page_rows": "1000", "retries": "4", "wait": "0.2", "timeout": "30", "total_header": "X-Total-Count", "paged": "true", "rows": "", "token": ""}


class Page(InputPartition):
    def __init__(self, offset: int | None, limit: int | None) -> None:
        super().__init__((offset, limit))
        self.offset, self.limit = offset, limit


class HttpJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        raise ValueError("http_json reads a given schema: .schema(...) before .load()")

    def reader(self, schema: T.StructType) -> HttpJsonReader:
        return HttpJsonReader(schema, DEFAULTS | {k.lower(): v for k, v in self.options.items()})


class HttpJsonReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.fields, self.options = schema, options
        self.url, self.rows_at = options["url"], int(options["page_rows"])

    def partitions(self) -> list[Page]:
        if self.options["paged"] != "true":
            return [Page(None, None)]
        _, headers = self._asked(0, 0)
        total = headers.get(self.options["total_header"])
        if total is None:
            return [Page(0, None)]
        return [Page(a, min(self.rows_at, int(total) - a)) for a in range(0, int(total), self.rows_at)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.offset is None or partition.limit is not None:
            rows, _ = self._asked(partition.offset, partition.limit)
            if partition.limit is not None and len(rows) != partition.limit:
                raise OSError(f"{self.url}: {len(rows)} rows from {partition.offset} on, not {partition.limit}")
            yield from map(self._row, rows)
            return
        at = partition.offset
        while True:
            rows, _ = self._asked(at, self.rows_at)
            yield from map(self._row, rows)
            at += len(rows)
            if len(rows) < self.rows_at:
                return

    def _asked(self, offset: int | None, limit: int | None) -> tuple[list, dict]:
        query = {"fields": ",".join(self.fields.names)} | ({} if offset is None else {"offset": offset, "limit": limit})
        address = f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode(query)}"
        request = urllib.request.Request(address, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {self.options['token']}"} if self.options["token"] else {}))
        tries, wait = int(self.options["retries"]), float(self.options["wait"])
        for k in range(tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=float(self.options["timeout"])) as answer:
                    found = json.loads(answer.read() or b"[]", parse_float=decimal.Decimal)
                    return found[self.options["rows"]] if self.options["rows"] else found, dict(answer.headers)
            except urllib.error.HTTPError as e:
                if k == tries or e.code != 429 and e.code < 500:
                    raise
            except (OSError, ValueError):
                if k == tries:
                    raise
            time.sleep(wait * 2**k)
        raise AssertionError

    def _row(self, row: dict) -> tuple:
        return tuple(converted(row.get(f.name), f.dataType) for f in self.fields)


def converted(value: object, kind: T.DataType) -> object:
    """A JSON value as the type's; null if it can't be."""
    try:
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value, default=float)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
        if isinstance(kind, T.IntegralType):
            number = int(decimal.Decimal(str(value)))
            return number if -(1 << 63) <= number < 1 << 63 else None
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(value[:10])
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return datetime.datetime.fromisoformat(value)
        if isinstance(kind, T.ArrayType):
            return [converted(x, kind.elementType) for x in value]
        if isinstance(kind, T.MapType):
            return {k: converted(x, kind.valueType) for k, x in value.items()}
        if isinstance(kind, T.StructType):
            return tuple(converted(value.get(f.name), f.dataType) for f in kind)
    except (TypeError, ValueError, ArithmeticError, AttributeError):
        return None
    return None


def read_http(spark: SparkSession, url: str, schema: str, **options: object) -> DataFrame:
    """The rows behind an address."""
    spark.dataSource.register(HttpJsonSource)
    return spark.read.format("http_json").schema(schema).options(url=url, **options).load()


def read_all(spark: SparkSession, tables: dict[str, tuple[str, str]], **options: object) -> dict[str, DataFrame]:
    """Several tables, {name: (url, schema)}: each is read page by page by the tasks of whatever query uses it."""
    return {name: read_http(spark, url, schema, **options) for name, (url, schema) in tables.items()}
