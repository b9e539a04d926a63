"""Paged JSON APIs as a Spark data source: pages are input partitions, fetched where they are read, with bounded retry.

spark.dataSource.register(PagedSource); spark.read.format("paged").schema(...).options(url=..., total=..., page=...).load()

Options: url (with or without a query), page (rows per page, 1000), total (rows to fetch, an upper bound: a partition a page) or, where the number is
unknown, readers (4: reader i takes pages i, i + readers, ... to its first short page) and cap (rows at most); offset_name and limit_name
(the query's names, `$offset` and `$limit`), rows (dotted path to the list inside the answer, numbers for places of an array; none: the answer is
the list), filter.NAME (put into the query), push (comma-separated columns, or *, that the server filters: with spark.sql.python.filterPushdown.enabled an
equality of a DataFrame filter becomes a parameter of the query and is left to the server), where (the name of a parameter for conditions, such as `$where`:
ranges, lists, prefixes and repeated equalities of pushed columns go there, joined by AND), body (posted as JSON instead of the query; {page}, {offset} and {size} in it are filled in, pages
count from 1), wrapped (a field of the answer that holds JSON once more as a string, or true for the whole answer), keys (comma-separated names of positional
records), retries (4) and pause (seconds, growing with each try). Records are objects; columns are taken by name, as text, numbers or
booleans; missing ones are null.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType


class Page(InputPartition):
    """Pages from `offset` on, `step` rows apart (0: this one only), `size` rows each."""

    def __init__(self, offset: int, size: int, step: int = 0):
        self.offset, self.size, self.step = offset, size, step


def fetched(url: str, retries: int = 4, pause: float = 1.0, body: bytes | None = None) -> object:
    """The JSON at url; tries again after growing pauses where the server fails, not where it refuses."""
    for turn in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Accept": "application/json"} | ({"Content-Type": "application/json"} if body else {})), timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if turn == retries - 1 or e.code < 500 and e.code != 429:
                raise
        except OSError:
            if turn == retries - 1:
                raise
        time.sleep(pause * (turn + 1))
    raise ValueError("retries must be at least 1")


def _as(value: object, kind: object) -> object:
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    try:
        if isinstance(kind, LongType):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
    except (TypeError, ValueError):
        return None
    return bool(value) if isinstance(kind, BooleanType) else value


def _literal(value: object) -> str:
    """A value as a condition has it."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


_SIGNS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}


def condition(f: Filter) -> str | None:
    """A filter as a condition of the server's query; none if it has no such form."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column is None:
        return None
    if type(f) in _SIGNS:
        return f"{column} {_SIGNS[type(f)]} {_literal(f.value)}"
    if isinstance(f, In) and f.value and None not in f.value:
        return f"{column} in ({', '.join(map(_literal, f.value))})"
    if isinstance(f, StringStartsWith):
        return f"starts_with({column}, {_literal(f.value)})"
    return f"{column} IS NOT NULL" if isinstance(f, IsNotNull) else None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.pushed: dict[str, str] = {}

    def partitions(self) -> list[Page]:
        size = int(self.options.get("page", 1000))
        if "total" in self.options:
            total = int(self.options["total"])
            return [Page(at, min(size, total - at)) for at in range(0, total, size)]
        readers = int(self.options.get("readers", 4))
        return [Page(k * size, size, readers * size) for k in range(readers)]

    def _page(self, offset: int, size: int) -> list:
        o = self.options
        url, body = o["url"], None
        if "body" in o:
            text = o["body"]
            for name, value in (("page", offset // int(o.get("page", 1000)) + 1), ("offset", offset), ("size", size)):
                text = text.replace("{" + name + "}", str(value))
            body = text.encode()
        else:
            query = {k.removeprefix("filter."): v for k, v in o.items() if k.startswith("filter.")}
            query |= self.pushed | {o.get("offset_name", "$offset"): str(offset), o.get("limit_name", "$limit"): str(size)}
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query)
        answer = fetched(url, int(o.get("retries", 4)), float(o.get("pause", 1)), body)
        wrapped = o.get("wrapped", "")
        if wrapped and wrapped.lower() != "true":
            answer = answer[wrapped]
        if wrapped and isinstance(answer, str):
            answer = json.loads(answer)
        for step in filter(None, o.get("rows", "").split(".")):
            answer = ((answer[int(step)] if len(answer) > int(step) else None) if isinstance(answer, list) else answer.get(step)) or []
        keys = o.get("keys")
        return [dict(zip(keys.split(","), r, strict=False)) for r in answer] if keys else answer

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no page at all
            return
        at, cap = partition.offset, int(self.options.get("cap", 1 << 62))
        while at < cap:
            size = min(partition.size, cap - at)
            records = self._page(at, size)
            for record in records[:size]:
                yield tuple(_as(record.get(f.name), f.dataType) for f in self.schema.fields)
            if not partition.step or len(records) < size:
                return
            at += partition.step


class PushingReader(Reader):
    """A reader whose server filters. Spark refuses a reader that takes filters while its setting for them is off, so only `push` makes one."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what the server can filter by; the rest stays with Spark."""
        columns, where, conditions = self.options.get("push", "").split(","), self.options.get("where"), []
        equal = {f.attribute[0] for f in filters if isinstance(f, EqualTo) and len(f.attribute) == 1}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            known = column is not None and "body" not in self.options and ("*" in columns or column in columns)
            if known and isinstance(f, EqualTo) and column not in self.pushed:
                self.pushed[column] = _literal(f.value).strip("'") if not isinstance(f.value, str) else f.value
            elif known and isinstance(f, IsNotNull) and column in equal:
                continue  # an equality says as much
            elif known and where and (text := condition(f)):
                conditions.append(text)
            else:
                yield f
        if conditions:
            self.pushed[where] = " AND ".join(conditions)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the columns to read with schema()")

    def reader(self, schema: StructType) -> Reader:
        options = dict(self.options)
        return (PushingReader if options.get("push") else Reader)(schema, options)
