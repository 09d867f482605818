"""Fill-in-the-middle: texts cut at two seeded boundaries of their units and put together in another order.

Units are words with the white space before them; white space at a text's end is a unit of its own. A text's
boundaries are a rising list of code points, kept as Elias-Fano: the low bits of each as they are, the rest in
unary, some five bits for a boundary, and any of them is found without the others.

Copies of a text share one list. Which texts have copies is told by their hashes alone, so that only those texts
are grouped, by their content, and only they meet their list again in a join, which AQE can split where one text
is a third of all rows. A text without copies gets its list in the task that reads it and never moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, portions

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hashes of texts with copies that are sent to all tasks (8 MB); beyond, they are joined.
BROADCAST_HASHES = 1_000_000
INDEX = "n long, chars long, low binary, high binary"


def boundaries(text: bytes) -> np.ndarray:
    """The code points after which each unit of a UTF-8 text ends."""
    x = np.frombuffer(text, np.uint8)
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    if len(x) and blank[-1]:
        ends = np.append(ends, len(x))
    return np.cumsum((x & 0xC0) != 0x80)[ends - 1]


def low_bits(n: int, chars: int) -> int:
    return max(0, (chars // n).bit_length() - 1) if n else 0


def elias_fano(ends: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(n, chars, low, high) of a rising list whose last member is ``chars``."""
    n, chars = len(ends), int(ends[-1]) if len(ends) else 0
    width = low_bits(n, chars)
    low = np.packbits(ends[:, None] >> np.arange(width) & 1) if width else np.zeros(0, np.uint8)
    high = np.zeros(n + (chars >> width) + 1, bool)
    high[(ends >> width) + np.arange(n)] = True
    return n, chars, low.tobytes(), np.packbits(high).tobytes()


def select(n: int, chars: int, low: bytes, high: bytes, i: int) -> int:
    """The boundary after ``i`` units, from the list's parts."""
    if not i:
        return 0
    ones = np.cumsum(np.bitwise_count(np.frombuffer(high, np.uint8)), dtype=np.int64)
    byte = int(np.searchsorted(ones, i))
    place = i - int(ones[byte - 1] if byte else 0)
    bit = [b for b in range(8) if high[byte] >> (7 - b) & 1][place - 1]
    width = low_bits(n, chars)
    rest = sum((low[at >> 3] >> (7 - (at & 7)) & 1) << k for k, at in enumerate(range((i - 1) * width, i * width)))
    return (8 * byte + bit - (i - 1) << width) | rest


def index(texts: DataFrame) -> DataFrame:
    """(text, n, chars, low, high) for each different ``text``: grouped by content, the list computed once.

    Copies combine in the tasks that read them, so a text moves once for each task that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            lists = [elias_fano(boundaries(x.as_buffer())) for x in batch.column("text").cast(pa.binary())]
            n, chars, low, high = zip(*lists)
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["text", "n", "chars", "low", "high"])

    return texts.select("text").distinct().mapInArrow(run, f"text string, {INDEX}")


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cut(rows: DataFrame, indexed: bool) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of rows with their draws, and their list if they are indexed."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def put(text: str, form: str, a: int, b: int) -> str:
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            text, form = batch.column("text"), batch.column("form").to_pylist()
            lists = zip(*(batch.column(c).to_pylist() for c in ("n", "chars", "low", "high"))) if indexed else (elias_fano(boundaries(x.as_buffer())) for x in text.cast(pa.binary()))
            out: list[tuple] = []
            for x, f, h1, h2, own in zip(text, form, batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), lists):
                if f == "plain":
                    out.append((own[0], None, None, x.as_py()))
                else:
                    a, b = (select(*own, h % (own[0] + 1)) for h in sorted((h1 % (own[0] + 1), h2 % (own[0] + 1))))
                    out.append((own[0], a, b - a, put(x.as_py(), f, a, b)))
            made = (pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string())))
            n, prefix, middle, output = made
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, batch.column("form"), prefix, middle, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {doc_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    Of the texts ``rate`` in a hundred are cut, of these ``spm`` in a hundred with the suffix first; draws come
    from the SHA-256 of ``seed:doc_id``, so that reruns agree whatever the partitions. Empty and null texts, and
    those that hold one of the marks, stay plain: output is the text (null: empty), the two lengths are null.
    Rows that repeat an id with the same text give equal rows; a null id draws as an empty one. A text of any
    length is one row that a task holds with its output. An empty table gives no rows. Other columns aren't read.
    """
    h1, h2, h3, h4 = _drawn(F.col("doc_id"), seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    named = slim.withColumn("hash", F.xxhash64("text"))
    told = cut(named.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    few = F.broadcast(told) if told.count() <= BROADCAST_HASHES else told
    draws = ["doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2")]
    copied = named.join(few, "hash", "left_semi").select("doc_id", "text")
    single = named.join(few, "hash", "left_anti").select(*draws)
    lists = cut(index(copied))
    return _cut(single, False).union(_cut(copied.select(*draws).join(lists, "text"), True))


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form: each mark stands once, as texts that hold one stay plain."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.char_length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


_MARKED = " OR ".join(f"contains(t, '{x}')" for x in (PREFIX, SUFFIX, MIDDLE))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""
