"""Text corpora: chapters in HTML, books as numbered lines, and passages cut out of them by declaration."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from sagaframe.functions import text as T
from sagaframe.functions.numbers import NUMERALS, kanji_number

NUMBERED = r"([〇一二三四五六七八九十\d]+)"


def chapters(spark: SparkSession, folder: str, pattern: str = NUMBERED, html: bool = True) -> DataFrame:
    """(n, path, text) of a folder's files, numbered by the numeral in their names."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    name = F.regexp_extract(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)), pattern, 1)
    text = T.unescaped(T.strip_html(F.col("value"))) if html else F.col("value")
    return raw.select(F.coalesce(name.try_cast("int"), kanji_number(name)).alias("n"), "path", text.alias("text"))


def chapter_range(chapters: DataFrame, first: int, last: int) -> DataFrame:
    """One row with the texts of chapters first to last, an empty line between them."""
    kept = chapters.where(F.col("n").between(first, last))
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def lines(text: Column) -> Column:
    """array<struct(n, line)>, numbered from 1."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))


def line_range(text: Column, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


@dataclass(frozen=True)
class Extract:
    """The passage of a record: chapters [first, last], then from one marker to another, both or either."""

    id: str
    first: int
    last: int
    start: str | None = None
    end: str | None = None


def extracts(chapters: DataFrame, specs: list[Extract]) -> DataFrame:
    """(id, text) of all specs: chapters are joined to the specs that cover them, and each passage is cut by its markers."""
    spark = chapters.sparkSession
    wanted = spark.createDataFrame([(s.id, s.first, s.last, s.start, s.end) for s in specs], "id string, first int, last int, start string, end string")
    each = wanted.withColumn("n", F.explode(F.sequence("first", "last"))).join(chapters.select("n", "text"), "n")
    joined = each.groupBy("id", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    a = F.when(F.col("start").isNull(), 1).otherwise(F.expr("instr(text, start)"))
    after = F.expr("substring(text, instr(text, coalesce(start, '')) + length(coalesce(start, '')))")
    b = F.when(F.col("end").isNull(), F.length("text")).otherwise(a + F.length(F.coalesce("start", F.lit(""))) + F.instr(after, F.col("end")) + F.length("end") - 2)
    lost = (a == 0) | (F.col("end").isNotNull() & (F.instr(after, F.col("end")) == 0))
    cut = F.substring(F.col("text"), a, b - a + 1)
    return joined.select("id", F.when(lost, F.raise_error(F.concat(F.lit("a marker is missing for "), "id"))).otherwise(cut).alias("text"))


def provenance(corpus: DataFrame, fragments: DataFrame, variants: dict[str, str]) -> DataFrame:
    """(fragment, path): the first file, by path, that holds each fragment; both are normalised the same way."""
    from sagaframe.operators.search import contained

    texts = corpus.select("path", T.for_match(F.col("text"), variants).alias("_t"))
    wanted = fragments.select("fragment", T.for_match(F.col("fragment"), variants).alias("_f"))
    return contained(wanted, texts, "fragment", "_f", "path", "_t", 4).groupBy("fragment").agg(F.min("path").alias("path"))


def available(roots: list[str]) -> list[str]:
    """The roots (paths or addresses of a shared file system) that exist."""
    found = [fs.FileSystem.from_uri(root) for root in roots]
    return [root for root, (system, path) in zip(roots, found) if system.get_file_info(path).type == fs.FileType.Directory]


def _number(name: str, pattern: str) -> int | None:
    found = re.search(pattern, name)
    if found is None:
        return None
    tens, ten, units = found[1].translate(str.maketrans(NUMERALS, "0123456789")).partition("十")
    if not ten:
        return int(tens)
    return None if "十" in units else int(tens or 1) * 10 + int(units or 0)


def _read(system: fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as stream:
        return stream.read().decode("utf-8", errors="ignore")


#: The comparisons that choose files before any is opened.
_CHOOSE = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str, int | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.suffix = json.loads(options["roots"]), options.get("suffix", "")
        self.pattern, self.size = options.get("pattern", NUMBERED), int(options.get("bytes", 64 << 20))
        self.chosen: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _CHOOSE and f.attribute[0] in ("root", "path", "n"):
                self.chosen.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files of at most ``size`` bytes together, or one that is larger."""
        parts, room = [], 0
        for root in available(self.roots):
            system, base = fs.FileSystem.from_uri(root)
            for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
                path = info.path[len(base.rstrip("/")) + 1 :]
                own = {"root": root, "path": path, "n": _number(info.base_name, self.pattern)}
                wanted = all(own[c] is not None and _CHOOSE[kind](own[c], v) for c, kind, v in self.chosen)
                if info.type != fs.FileType.File or not path.endswith(self.suffix) or not wanted:
                    continue
                if not parts or info.size > room:
                    parts.append(_Files([]))
                    room = self.size
                parts[-1].files.append(tuple(own.values()))
                room -= info.size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for root, path, n in partition.files:
            system, base = fs.FileSystem.from_uri(root)
            yield root, path, n, _read(system, f"{base.rstrip('/')}/{path}")


class _Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_corpus"

    def schema(self) -> str:
        return "root string, path string, n int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def files(spark: SparkSession, roots: list[str], suffix: str = "", pattern: str = NUMBERED) -> DataFrame:
    """(root, path, n, text) of all files below the roots, path counted from the root, n the numeral in the name or null.

    A root that doesn't exist has no rows. Comparisons of root, path and n with constants choose the files by
    their names, so that no other is opened.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_Source)
    return spark.read.format("text_corpus").options(roots=json.dumps(roots), suffix=suffix, pattern=pattern).load()


def keyed(paths: DataFrame, roots: list[str]) -> DataFrame:
    """(path, text) of the paths that are asked for, each read once, by the task that gets its key, from the first root that has it; without a file the text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(system, base.rstrip("/")) for system, base in map(fs.FileSystem.from_uri, available(roots))]
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            held = (s for s in found if path and s[0].get_file_info(f"{s[1]}/{path}").type == fs.FileType.File)
            text = next((_read(system, f"{base}/{path}") for system, base in held), "")
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], ["path", "text"])

    return paths.select(F.col("path").cast("string").alias("path")).distinct().mapInArrow(run, "path string, text string")
