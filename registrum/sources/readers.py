"""Readers and projections of public registries' files into entities. Headers are found by hints, so yearly layouts can differ."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions.text import blank, money, number

from .archives import archive

COLUMNS = ["source", "source_id", "name", "dba", "entity_type", "status", "address", "city", "state", "zip", "county", "lat", "lon", "amount", "source_url"]


def entities(rows: DataFrame, source: str, columns: dict[str, str | Column], order: str | Column | None = None) -> DataFrame:
    """rows as entities: `columns` maps entity columns to source columns or expressions; rows without an id go, of an id the first by `order` stays
    (none given: the first by a hash of the row, the same in every run). All source columns are kept in `raw`."""
    given = {k: F.col(f"`{v}`") if isinstance(v, str) else v for k, v in columns.items()}
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    out = []
    for c in COLUMNS:
        if c == "source":
            out.append(F.lit(source).alias(c))
        elif c in ("lat", "lon"):
            out.append((number(given[c].cast("string")) if c in given else F.lit(None).cast("double")).alias(c))
        elif c == "amount":
            out.append((money(given[c].cast("string")) if c in given else F.lit(None).cast("double")).alias(c))
        else:
            out.append((blank(given[c].cast("string")) if c in given else F.lit("")).alias(c))
    turn = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns]) if order is None else F.col(order) if isinstance(order, str) else order
    kept = rows.select(*out, raw.alias("raw"), turn.alias("__turn")).where("source_id <> ''")
    whole = [*COLUMNS, "raw"]
    found = kept.groupBy(F.col("source_id").alias("__id")).agg(F.min_by(F.struct(*whole), "__turn").alias("e")).select("e.*")
    return found.withColumn("uid", F.concat_ws(":", "source", "source_id"))


def detect(header: list[str], hints: list[str]) -> str | None:
    """The first column that equals, else contains, one of the hints, whatever its case and punctuation."""
    plain = {c: re.sub("[^a-z0-9]", "", c.lower()) for c in header}
    for test in (lambda c, h: plain[c] == h, lambda c, h: h in plain[c]):
        for h in hints:
            h = re.sub("[^a-z0-9]", "", h.lower())
            for c in header:
                if test(c, h):
                    return c
    return None


def csv(spark: SparkSession, path: str, hints: dict[str, list[str]] | None = None, **options: str) -> DataFrame:
    """A CSV file or folder; with hints, the columns found by them under the hints' names (blank where none is found)."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', **options).csv(path)
    if hints is None:
        return rows
    header = [c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*header)
    where = {name: detect(header, h) for name, h in hints.items()}
    return rows.select(*[(blank(F.col(f"`{c}`")) if c else F.lit("")).alias(name) for name, c in where.items()])


def officers(c: Column) -> Column:
    """Names of a list, split at the first of `;`, `|` and `/` that it holds."""
    cut = F.when(c.contains(";"), F.split(c, ";")).when(c.contains("|"), F.split(c, r"\|")).otherwise(F.split(c, "/"))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an API as saved: one JSON array or object per line or file."""
    return spark.read.option("multiLine", True).json(path)


def license_rows(c: Column) -> Column:
    """Objects of a licence field that holds an array, an object, or objects strung together; an array of variants."""
    whole = F.when(F.ltrim(c).startswith("["), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    return F.try_parse_json(whole).cast("array<variant>")


def extracted(rows: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """The other columns and `name`, a row for every match of the pattern in a text."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != text]
    return rows.select(*others, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(name))


def xlsx(spark: SparkSession, path: str, sheet: int | None = 0) -> DataFrame:
    """path, row (from 0 in each sheet) and cells of one sheet of spreadsheet files, or of all of them; `member` tells the sheets apart."""
    rows = archive(spark, path, "cells", **({} if sheet is None else {"sheet": str(sheet)}))
    return rows.select("path", "member", "row", "cells") if sheet is None else rows.select("path", "row", "cells")


def feed(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Items of a news feed whose title or description has one of the words."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return rows.where(F.lower(F.concat_ws(" ", "title", "description")).rlike("|".join(words)))


def named_entries(c: Column) -> Column:
    """Structs name, credential of every `Name Name (AA12345678)` in a text."""
    pattern = r"([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+)+) \(([A-Z]{2}\d{6,8})\)"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("credential"))


def pane_dates(html: Column, pane: str) -> Column:
    """Date cells in the pane of an id; 0 where it says that none are available."""
    body = F.regexp_extract(html, rf'(?s)id="{pane}"(.*?)(?:<div class="tab-pane|$)', 1)
    return F.when(body.rlike(r"(?i)no [a-z ]*available"), 0).otherwise(F.regexp_count(body, F.lit(r"<td>\s*\d{1,2}/\d{1,2}/\d{4}")))
