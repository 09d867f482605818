"""Text search and the provenance of quotations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sagaframe.functions import text as T
from sagaframe.session import cut


def multi_token(df: DataFrame, target: Column, query: str) -> DataFrame:
    """Rows of which every token of the query, or its hiragana form, is part of ``target``."""
    import unicodedata

    tokens = unicodedata.normalize("NFKC", query).split()
    for token in tokens:
        df = df.where(target.contains(token) | target.contains(T.hiragana(F.lit(token))))
    return df


def keyword(df: DataFrame, value: Column, keywords: Column, query: str) -> DataFrame:
    """Rows of which the query is part of value or keywords."""
    return df.where(F.concat_ws(" ", value, keywords).contains(query))


CHUNK = 256
#: Bytes of needles that go to the tasks, and of one automaton, which takes some fifty times as much.
NEEDLE_BYTES, BLOCK_BYTES = 16 << 20, 2 << 20


def grams(df: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """(key, gram): the substrings of ``size`` characters, repeats within a chunk left out.

    A substring is found by walking from the start of its text, so texts are cut into overlapping chunks first.
    """
    starts = F.sequence(F.lit(1), F.length(text) - size + 1, F.lit(CHUNK))
    chunks = df.where(F.length(text) >= size).select(key, F.explode(F.transform(starts, lambda i: F.substring(text, i, F.lit(CHUNK + size - 1)))).alias("_c"))
    every = F.transform(F.sequence(F.lit(1), F.length("_c") - size + 1), lambda i: F.substring("_c", i, F.lit(size)))
    return chunks.select(key, F.explode(F.array_distinct(every)).alias("gram"))


def contained(needles: DataFrame, hay: DataFrame, needle_id: str, needle: str, hay_id: str, text: str, gram: int = 12, broadcast_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """(needle_id, hay_id) where the needle is part of the text; null and empty ones are part of none.

    Needles of at most ``broadcast_bytes`` go to the tasks in blocks; each block becomes an Aho-Corasick automaton that
    the texts are streamed through, so that only hits leave the scan. More needles are joined by ``by_grams``.
    """
    wanted = needles.select(needle_id, F.col(needle).alias("_n")).where(F.length("_n") > 0)
    texts = wanted.select("_n").distinct()
    if (texts.agg(F.sum(F.octet_length("_n"))).first()[0] or 0) > broadcast_bytes:
        return by_grams(needles, hay, needle_id, needle, hay_id, text, gram)
    slim, hits = hay.select(hay_id, F.col(text).alias("_t")).where(F.col("_t").isNotNull()), None
    schema = f"`{hay_id}` {slim.schema[hay_id].dataType.simpleString()}, _n string"
    for block in blocks(sorted(r["_n"] for r in texts.collect()), BLOCK_BYTES):
        found = slim.mapInArrow(searched(slim.sparkSession.sparkContext.broadcast(block)), schema)
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return hay.sparkSession.createDataFrame([], StructType([wanted.schema[needle_id], hay.schema[hay_id]]))
    return hits.join(wanted, "_n").select(needle_id, hay_id).distinct()


def blocks(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts with about ``limit`` bytes each."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text.encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def searched(block: Broadcast) -> Callable:
    """For ``mapInArrow`` over (id, text): (id, needle) for each needle of the block in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle in block.value:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        for batch in batches:
            hits = [(n, needle) for n, text in enumerate(batch.column(1)) for needle in {x for _, x in automaton.iter(text.as_py())}]
            if hits:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n for n, _ in hits])), pa.array([x for _, x in hits])], [batch.schema.names[0], "_n"])

    return run


def by_grams(needles: DataFrame, hay: DataFrame, needle_id: str, needle: str, hay_id: str, text: str, gram: int = 12) -> DataFrame:
    """``contained`` for needles of any number, by joins alone; a row for each character of the texts.

    Of each needle one gram, its rarest, is looked up among the texts' grams; only texts that have it
    are searched. Needles shorter than a gram are matched by themselves as grams of their length.
    """
    out = None
    lengths = [r[0] for r in needles.where(F.length(needle).between(1, gram)).select(F.length(needle)).distinct().collect()] if gram > 1 else []
    for size in sorted({*(n for n in lengths if n < gram), gram}):
        mine = needles.where(F.length(needle) == size if size < gram else F.length(needle) >= size)
        wanted = grams(mine.select(needle_id, F.col(needle).alias("_n")), needle_id, F.col("_n"), size)
        there = cut(grams(hay.select(hay_id, F.col(text).alias("_t")), hay_id, F.col("_t"), size).join(wanted.select("gram").distinct(), "gram", "left_semi").distinct())
        often = there.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = wanted.join(often, "gram", "left").groupBy(needle_id).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
        pairs = rarest.join(there, "gram").select(needle_id, hay_id)
        found = pairs.join(mine.select(needle_id, F.col(needle).alias("_n")), needle_id).join(hay.select(hay_id, F.col(text).alias("_t")), hay_id).where(F.contains("_t", "_n")).select(needle_id, hay_id).distinct()
        out = found if out is None else out.union(found)
    return out


def staged(units: DataFrame, corpus: DataFrame, unit_id: str, span: str, doc_id: str, text: str, own: DataFrame | None = None, normal: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(unit_id, stage, doc_id): the first stage that finds a unit, and the document that its first found part is in (of several the least).

    Stages go from whole spans over fixed fragments to short shingles; a later one only sees what is left.
    Parts are looked for in the whole corpus, not in one document: one must be found if there are one or
    two, else half, rounded up. With ``own`` texts (unit_id, text) a stage of that name comes first: half
    of a unit's fragments in its own text; it has no document. Spans and texts are compared by ``normal``.
    """
    stages = [("whole", lambda c: F.array(normal(c))), ("fragment", lambda c: T.fragments(c, normal)), ("shingle", lambda c: T.sliding_fragments(normal(c)))]
    texts = corpus.select(doc_id, normal(F.col(text)).alias("_text"))
    left, out = units.select(unit_id, F.col(span).alias("_span")), None
    if own is not None:
        mine = left.join(own.select(unit_id, normal(F.col("text")).alias("_own")), unit_id).withColumn("_parts", T.fragments(F.col("_span"), normal))
        half = F.size(F.filter("_parts", lambda x: F.contains("_own", x))) * 2 >= F.size("_parts")
        out = cut(mine.where((F.size("_parts") > 0) & half).select(unit_id, F.lit("own").alias("stage"), F.lit(None).cast(corpus.schema[doc_id].dataType).alias(doc_id)).distinct())
        left = left.join(out.select(unit_id), unit_id, "left_anti")
    for stage, split in stages:
        parts = cut(left.select(unit_id, F.posexplode(split(F.col("_span"))).alias("_i", "_part")).withColumn("_key", F.concat_ws("#", F.col(unit_id).cast("string"), "_i")))
        hits = contained(parts, texts, "_key", "_part", doc_id, "_text", 6 if stage == "shingle" else 10)
        need = parts.groupBy(unit_id).agg(F.when(F.count("*") <= 2, 1).otherwise(F.ceil(F.count("*") / 2)).alias("_need"))
        first = hits.groupBy("_key").agg(F.min(doc_id).alias(doc_id)).join(parts.select("_key", "_i", unit_id), "_key")
        per = first.groupBy(unit_id).agg(F.count("*").alias("_n"), F.min_by(doc_id, "_i").alias(doc_id))
        best = cut(per.join(need, unit_id).where("_n >= _need").select(unit_id, F.lit(stage).alias("stage"), doc_id))
        out = best if out is None else out.union(best)
        left = left.join(best.select(unit_id), unit_id, "left_anti")
    return out


def in_context(df: DataFrame, key: str, text: str, pattern: str, context: int = 20) -> DataFrame:
    """(key, line, excerpt) of the first match of a pattern in each text."""
    at = F.regexp_instr(text, F.lit(pattern))
    return df.where(F.col(text).rlike(pattern)).select(
        key, (F.length(F.substring(F.col(text), F.lit(1), at - 1)) - F.length(F.replace(F.substring(F.col(text), F.lit(1), at - 1), F.lit("\n"))) + 1).alias("line"),
        F.substring(F.col(text), F.greatest(F.lit(1), at - context), F.lit(2 * context)).alias("excerpt"),
    )
