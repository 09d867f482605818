"""Writers: flat CSV, keyed JSON and text files, linked-data documents, sitemaps, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """RFC 4180 with a header, CRLF and nulls as empty cells; ``single`` for one file, which one task writes."""
    flat = df.coalesce(1) if single else df
    flat.write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue="", lineSep="\r\n").csv(path)


def csv_lines(df: DataFrame) -> Column:
    """A row as a line of CSV, without its end."""
    from sagaframe.functions.text import csv_cell

    return F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns))


def csv_with_bom(df: DataFrame, path: str) -> None:
    """One CSV file for spreadsheets: a byte-order mark, the header and the rows, in one text file."""
    head = df.sparkSession.createDataFrame([(0, BOM + ",".join(df.columns))], "_o int, value string")
    body = df.select(F.lit(1).alias("_o"), csv_lines(df).alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("_o").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def keyed_json(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key with its rows as JSON; for point lookups by partition."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def keyed_text(df: DataFrame, key: str, text: str, path: str) -> None:
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def copy(spark, source: str, target: str) -> None:
    """A file byte for byte."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def ledger(df: DataFrame, key: str, path: str) -> None:
    """A ledger sorted by key, one JSON object a line."""
    df.sort(key).write.mode("overwrite").json(path)


def person_document(name: Column, aliases: Column, born: Column, died: Column, url: Column) -> Column:
    """Linked data about a person; fields that are null are left out, one alias is no list."""
    listed = F.to_json(aliases)
    one = F.when(F.size(aliases) == 1, F.substring(listed, F.lit(2), F.length(listed) - 2)).when(F.size(aliases) > 1, listed)
    rest = F.to_json(F.struct(F.lit("Person").alias("@type"), name.alias("name"), born.alias("birthDate"), died.alias("deathDate"), url.alias("url")))
    return F.when(one.isNull(), rest).otherwise(F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"alternateName":'), one, F.lit("}")))


def breadcrumbs(items: Column) -> Column:
    """Linked data of a trail, from an array of struct(name, url)."""
    listed = F.transform(items, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["url"].alias("item")))
    return F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), listed.alias("itemListElement")))


def dataset_document(title: Column, modified: Column, n: Column, version: Column, coverage: Column) -> Column:
    return F.to_json(F.struct(F.lit("Dataset").alias("@type"), title.alias("name"), modified.alias("dateModified"), n.alias("size"), version.alias("version"), coverage.alias("temporalCoverage")))


def website_document(name: Column, url: Column) -> Column:
    return F.to_json(F.struct(F.lit("WebSite").alias("@type"), name.alias("name"), url.alias("url")))


def sitemap(sections: list[str], ids: DataFrame, base: str) -> DataFrame:
    """(url, priority): fixed sections, then a page for each id."""
    fixed = ids.sparkSession.createDataFrame([(base + s, 1.0 if s == "/" else 0.8) for s in sections], "url string, priority double")
    return fixed.union(ids.select(F.concat(F.lit(f"{base}/"), "id", F.lit("/")).alias("url"), F.lit(0.6).alias("priority")))


def asset_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(id, action) to bring target files (id, modified) in line with source files: write, delete or keep."""
    a, b = source.alias("a"), target.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    action = F.when(F.col("a.id").isNull(), "delete").when(F.col("b.id").isNull() | (F.col("b.modified") < F.col("a.modified")), "write").otherwise("keep")
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), action.alias("action"))
