"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The words of the documents that
hold such an entity are then weighed over the whole corpus: P(entity | term), from the documents that
hold both and those that hold the term at all, tells how strongly the term reveals it. Terms beyond the
disclosure thresholds are spans of kind ``term`` wherever they stand, in documents without the entity too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, keyed, portions

KINDS = ("email", "ip", "card", "phone")
REACH, BROADCAST_TERMS, HELD_TERMS = 5, 200_000, 200_000
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside a run of digits fails where the run's start does
_CARD, _PHONE = re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _TERM = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches in order of kind and start; code points, end exclusive."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(x.isascii() and x.isdigit() for x in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _inside(spans: list[tuple[str, int, int]]):
    """Whether a place meets one of the spans."""
    covered, ends = sorted((s, e) for _, s, e in spans), []
    for _, e in covered:
        ends.append(max(e, ends[-1]) if ends else e)
    return lambda a, b: (i := bisect_left(covered, (b,))) and ends[i - 1] > a


def contexts(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[dict], list[dict]]:
    """The text's distinct entities and, outside of them, its distinct terms; each with the hash of the terms
    within REACH of its first place, so that a text is one piece of evidence however often it repeats itself."""
    if not spans:
        return [], []
    inside = _inside(spans)
    terms = [(m[0].lower(), *m.span()) for m in _TERM.finditer(text) if not inside(*m.span())]
    words, starts = [x[0] for x in terms], [x[1] for x in terms]
    around = lambda i, j: xxhash.xxh64_intdigest(" ".join([*words[max(0, i - REACH) : i], "", *words[j : j + REACH]]), 0) >> 1
    entities, met = {}, {}
    for kind, start, end in spans:
        value = text[start:end].lower()
        entity = f"{kind}:{value if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"
        if entity not in entities:
            i = bisect_left(starts, start)
            entities[entity] = around(i, i)
    for i, word in enumerate(words):
        if word not in met:
            met[word] = around(i, i + 1)
    return [{"entity": e, "context": c} for e, c in entities.items()], [{"term": t, "around": c} for t, c in met.items()]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ENTITY = pa.struct([("entity", pa.string()), ("context", pa.int64())])
_TERMS = pa.struct([("term", pa.string()), ("around", pa.int64())])


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, base, entities, terms) for each row."""
    slim = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            spans = [base_spans(x) for x in texts]
            near = [contexts(x, s) for x, s in zip(texts, spans)]
            base = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(base, pa.list_(_SPAN)), pa.array([x for x, _ in near], pa.list_(_ENTITY)), pa.array([x for _, x in near], pa.list_(_TERMS))], ["doc_id", "key", "base", "entities", "terms"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, key long, base array<struct<kind:string,start:int,end:int>>, entities array<struct<entity:string,context:long>>, terms array<struct<term:string,around:long>>")


def documents_with(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): in how many rows each of ``terms`` occurs. The terms are broadcast if few, else counted by a join.

    Tasks count for themselves first and give a row for each term, however many documents have it.
    """
    spark, few = docs.sparkSession, terms.count() <= BROADCAST_TERMS
    held = spark.sparkContext.broadcast({r[0] for r in terms.toLocalIterator()}) if few else None

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = {m.lower() for m in _TERM.findall((text.as_py() or b"").decode("utf-8", "replace"))}
                counts.update(found & held.value if held else found)
                if len(counts) > HELD_TERMS:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    met = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "term string, n long")
    return (met if few else met.join(terms, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(doc_id, key, start, end): each occurrence of ``terms`` in the whole texts that doesn't meet a base span.

    The terms are broadcast if few, else joined with all the occurrences.
    """
    slim, few = keyed(docs, id_col, text_col), terms.count() <= BROADCAST_TERMS
    held = docs.sparkSession.sparkContext.broadcast({r[0] for r in terms.toLocalIterator()}) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                at, found = [], []
                for i, raw in enumerate(batch.column("text").to_pylist()):
                    text = (raw or b"").decode("utf-8", "replace")
                    hits = [(t, *m.span()) for m in _TERM.finditer(text) if (t := m[0].lower()) in held.value] if held else [(m[0].lower(), *m.span()) for m in _TERM.finditer(text)]
                    inside = _inside(base_spans(text)) if hits else None
                    mine = [x for x in hits if not inside(*x[1:])]
                    at += [i] * len(mine)
                    found += mine
                if found:
                    rows = batch.take(pa.array(at))
                    term, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "key", "term", "start", "end"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    met = slim.mapInArrow(run, f"doc_id {kind}, key long, term string, start int, end int")
    return (met if few else met.join(terms, "term", "left_semi")).drop("term")


def disclosing(docs: DataFrame, text_col: str, found: DataFrame, min_contexts: int, min_share: float, min_bits: float) -> DataFrame | None:
    """(entity, term, share, bits) of the terms that reveal an entity; None where none has the contexts for it.

    ``share`` is P(entity | term) over documents and ``bits`` its logarithm against P(entity). Copies are
    no evidence, of whole texts or of a passage, nor is a text that repeats itself: of the documents that
    hold both there must be ``min_contexts`` with different surroundings of the entity, and as many with
    different surroundings of the term, each taken at its first place. What can't reach that is left out
    before pairs are made: entities with too few surroundings, terms in too few of the documents with any
    entity, and pairs whose share is too small even by that number, a lower bound of those with the term.
    ``found`` must be checkpointed, as its rows are numbered.
    """
    held = found.where(F.size("entities") > 0).select(F.monotonically_increasing_id().alias("_row"), "entities", "terms")
    placed = held.select("_row", F.inline("entities"))
    known = cut(placed.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("context").alias("kinds")).where(F.col("kinds") >= min_contexts).drop("kinds"))
    if known.isEmpty():
        return None
    placed, listed_terms = placed.join(known, "entity"), held.select("_row", F.inline("terms"))
    least = listed_terms.groupBy("term").agg(F.count("*").alias("least")).where(F.col("least") >= min_contexts)
    near = placed.join(listed_terms.join(placed.select("_row").distinct(), "_row", "left_semi").join(least, "term"), "_row").where(F.col("n_entity") >= min_share * F.col("least"))
    pairs = near.groupBy("entity", "term", "n_entity", "least").agg(F.count("*").alias("both"), F.count_distinct("context").alias("kinds"), F.count_distinct("around").alias("places"))
    enough = (F.least("kinds", "places") >= min_contexts) & (F.col("both") >= min_share * F.col("least"))
    candidates = cut(pairs.where(enough).select("entity", "term", "n_entity", "both"))
    if candidates.isEmpty():
        return None
    counted = documents_with(docs, text_col, candidates.select("term").distinct())
    total = docs.count()
    told = candidates.join(counted, "term").withColumn("share", F.col("both") / F.col("n")).withColumn("bits", F.log2(F.col("share") * total / F.col("n_entity")))
    return told.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).select("entity", "term", "share", "bits")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = 3, min_share: float = 0.5, min_bits: float = 4.0) -> DataFrame:
    """(doc_id, key, base, spans) for each row: arrays of struct(kind, start, end) in order of kind and start.

    Null texts are empty and have no spans; whole texts are searched, however long. Rows that repeat an
    id or a text are rows of their own, as are rows without an id. An empty table gives no rows. Columns
    other than id and text aren't read.
    """
    found = cut(find(docs, id_col, text_col))
    telling = disclosing(docs, text_col, found, min_contexts, min_share, min_bits)
    if telling is None:
        return found.select("doc_id", "key", "base", F.col("base").alias("spans"))
    span = F.struct(F.lit("term").alias("kind"), "start", "end")
    more = places(docs, id_col, text_col, cut(telling.select("term").distinct())).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("more"))
    a, b = found.alias("a"), more.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    both = F.when(F.col("b.more").isNull(), F.col("a.base")).otherwise(F.concat("a.base", "b.more"))
    return joined.select("a.doc_id", "a.key", "a.base", both.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each entity generalised to its kind and each telling term removed; of overlapping spans the first counts."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], "[...]" if kind == "term" else f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, text) for each row, entities generalised and telling terms removed; a null text stays null."""
    slim, spans = keyed(docs, id_col, text_col), personal_data(docs, id_col, text_col, **limits).dropDuplicates(["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            made = [None if t is None else masked(t.decode("utf-8", "replace"), [(x["kind"], x["start"], x["end"]) for x in s or []]) for t, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    a, b = slim.alias("a"), spans.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return joined.select("a.doc_id", "a.text", "b.spans").mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")
