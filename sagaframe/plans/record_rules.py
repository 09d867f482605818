"""The rule suite on nested records: each rule is a query of violations, and lists of known exceptions go stale.

What a rule can't know (patterns, vocabularies, keywords, exceptions) is in ``Settings``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.functions import dates as D
from sagaframe.functions import text as T
from sagaframe.operators import aggregates, matching, quality
from sagaframe.operators.quality import Rule
from sagaframe.sources.records import GROUPS, children, events


@dataclass(frozen=True)
class Settings:
    id_pattern: str = "^[a-z0-9]+(-[a-z0-9]+)*$"
    item_pattern: str = r"^Q[1-9]\d*$"
    precisions: tuple[str, ...] = ("day", "month", "year")
    confidences: tuple[str, ...] = ("high", "medium", "low")
    coexistence: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    allowed_sources: tuple[str, ...] = ()
    age_tolerance: int = 1
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _strict(c) -> Column:
    return D.parse_strict(F.col(c) if isinstance(c, str) else c)


def _day(precision: str) -> Column:
    return F.coalesce(F.col(precision) == "day", F.lit(False))


def _need(precision: Column) -> Column:
    return F.when(precision == "day", 3).when(precision == "month", 2).otherwise(1)


def _reigns(records: DataFrame) -> DataFrame:
    own = "startDate endDate startYear endYear note".split()
    flat = children(records).select("id", "reign_ix", F.col("dynasty.name").alias("group"), *own, F.col("datePrecision.start").alias("p_start"), F.col("datePrecision.end").alias("p_end"), "duration.approxDays", "duration.exactDays", "duration.needsPreciseDays", F.col("duration.source.note").alias("source_note"))
    return flat.withColumn("key", F.concat_ws("#", "id", "reign_ix")).withColumn("d_start", _strict("startDate")).withColumn("d_end", _strict("endDate"))


def reign_dates(records: DataFrame, settings: Settings) -> DataFrame:
    """Precision words, formats, depth, years, order within and between reigns, and which lengths must be given."""
    r = _reigns(records)
    before = Window.partitionBy("id").orderBy("reign_ix").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("last_end", F.last("d_end", ignorenulls=True).over(before))
    checks = []
    for side in ("start", "end"):
        text, date, precision, year = F.col(f"{side}Date"), F.col(f"d_{side}"), F.col(f"p_{side}"), F.col(f"{side}Year")
        checks += [
            (precision.isNotNull() & ~precision.isin(*settings.precisions), f"{side} precision is unknown"),
            (text.isNotNull() & date.isNull(), f"{side} is no date"),
            (date.isNotNull() & (D.depth(date) < _need(precision)), f"{side} isn't as precise as it says"),
            (date.isNotNull() & ~D.year_matches_date(year, date), f"{side} and its year differ"),
        ]
    both = _day("p_start") & _day("p_end")
    checks += [
        (D.compare(F.col("d_start"), F.col("d_end")) > 0, "it ends before it starts"),
        (D.compare(F.col("last_end"), F.col("d_start")) > 0, "it starts before the one before ends"),
        (both & F.col("exactDays").isNull() | ~both & F.col("exactDays").isNotNull(), "exact days go with two days"),
        (F.col("exactDays").isNotNull() == F.coalesce("needsPreciseDays", F.lit(False)), "exact days are either given or needed"),
        (F.col("approxDays").isNull(), "there is no length"),
        (D.exact_days(F.col("d_start"), F.col("d_end")) != F.col("exactDays"), "exact days are miscounted"),
    ]
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks)))
    return r.select("key", F.explode(told).alias("detail"))


def group_counts(records: DataFrame) -> DataFrame:
    """Counts that aren't the number of events."""
    size = lambda g: F.greatest(F.coalesce(F.size(f"{g}.events"), F.lit(0)), F.lit(0))
    parts = [quality.where(records, "id", F.col(g).isNotNull() & ~F.col(f"{g}.count").eqNullSafe(size(g)), f"{g} is miscounted") for g in GROUPS]
    return reduce(DataFrame.union, parts)


def bce_years(records: DataFrame) -> DataFrame:
    """Events whose date goes by another convention than the BCE year in their note."""
    e = events(records).withColumn("d", D.parse_loose(F.col("date"))).withColumn("key", F.concat_ws("#", "id", "kind", "ev_ix"))
    return quality.where(e, "key", F.coalesce(~D.bce_convention(F.col("note"), F.col("d")), F.lit(False)) & (F.col("d.y") <= 0), "its year isn't the note's")


def event_years(records: DataFrame) -> DataFrame:
    """CE events more than a year outside of the reigns."""
    spans = children(records).groupBy("id").agg((F.min("startYear") - 1).alias("lo"), (F.max("endYear") + 1).alias("hi"))
    e = events(records).select("id", F.concat_ws("#", "id", "kind", "ev_ix").alias("key"), D.parse_loose(F.coalesce("date", "startDate"))["y"].alias("y")).where("y > 0")
    return quality.where(e.join(spans, "id"), "key", ~F.col("y").between(F.col("lo"), F.col("hi")), F.concat(F.lit("in "), F.col("y")))


def overlaps(records: DataFrame, settings: Settings) -> DataFrame:
    """Neighbouring reigns of one group name that overlap though neither note says that both reigned."""
    r = _reigns(records).withColumn("a", D.sort_key(F.coalesce("d_start", F.struct(D.astronomical(F.col("startYear")).cast("int").alias("y"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("d")))))
    said = F.concat_ws(" ", "note", "source_note")
    known = reduce(lambda x, k: x | F.contains(said, F.lit(k)), settings.coexistence, F.lit(False))
    w = Window.partitionBy("group").orderBy("a", "id", "reign_ix")
    after = lambda c: F.lead(c).over(w)
    paired = r.withColumn("known", known).withColumn("next", after("key")).withColumn("next_id", after("id")).withColumn("next_d", after("d_start")).withColumn("next_known", after("known"))
    return quality.where(paired, "key", (F.col("next_id") != F.col("id")) & (D.compare(F.col("d_end"), F.col("next_d")) > 0) & ~F.col("known") & ~F.col("next_known"), F.concat(F.lit("overlaps "), F.col("next")))


def ages(records: DataFrame, settings: Settings) -> DataFrame:
    """Counted ages that the years don't give, births after deaths, deaths before the last reign's end."""
    last = _reigns(records).where("d_end IS NOT NULL").groupBy("id").agg(F.max_by("d_end", D.sort_key(F.col("d_end"))).alias("last_end"), F.min(D.astronomical(F.col("startYear"))).alias("first_year"))
    r = records.select("id", "ages", _strict(F.col("ages.birthDate")).alias("b"), _strict(F.col("ages.deathDate")).alias("d")).join(last, "id", "left")
    off = lambda age, year: F.abs(F.col(f"ages.{age}") - D.counted_age(F.col("b.y"), year)) > settings.age_tolerance
    checks = [
        (off("accessionAge", F.col("first_year")), "age at accession"),
        (off("deathAge", F.col("d.y")), "age at death"),
        (D.compare(F.col("b"), F.col("d")) > 0, "born after death"),
        (D.compare(F.col("d"), F.col("last_end")) < 0, "reigned after death"),
        ((F.col("ages.birthDate").isNotNull() & F.col("b").isNull()) | (F.col("ages.deathDate").isNotNull() & F.col("d").isNull()), "no date"),
    ]
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks)))
    return r.select(F.col("id").alias("key"), F.explode(told).alias("detail"))


def null_notes(records: DataFrame, fields: tuple[str, ...] = ("accessionAge", "deathAge", "birthDate", "deathDate")) -> DataFrame:
    """Values whose note says that they are null."""
    parts = [quality.where(records, "id", T.null_claim(F.col("ages.note"), f) & F.col(f"ages.{f}").isNotNull(), f"{f} is set, its note says null") for f in fields]
    return reduce(DataFrame.union, parts)


def title_years(records: DataFrame) -> DataFrame:
    used, first = F.col("flags.usedEmperorTitleFrom"), F.col("reignSummary.firstStartYear")
    return quality.where(records, "id", used.isNotNull() & ~((used == first) | (used == first - 1)), "the title is used from another year")


def summaries(records: DataFrame) -> DataFrame:
    """Stored summaries that the reigns don't give."""
    own = children(records).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("duration.approxDays").alias("days"), F.min_by("startYear", "reign_ix").alias("first"), F.max_by("endYear", "reign_ix").alias("last"),
        F.bool_and(F.col("duration.exactDays").isNotNull()).alias("exact"), F.sum("duration.exactDays").alias("exact_days"),
    )
    s, t = "reignSummary", "reignSummary.totalReignDuration"
    differ = lambda stored, made: ~F.col(stored).eqNullSafe(F.col(made))
    total = F.when(F.col("exact"), F.col("exact_days")).otherwise(F.col("days"))
    checks = [
        (differ(f"{s}.reignCount", "n"), "number of reigns"), (differ(f"{s}.firstStartYear", "first"), "first year"), (differ(f"{s}.lastEndYear", "last"), "last year"), (differ(f"{t}.approxDays", "days"), "days"),
        (differ(f"{t}.isExact", "exact"), "exactness"), (~F.col(f"{t}.exactDays").eqNullSafe(F.when(F.col("exact"), F.col("exact_days"))), "exact days"),
        (F.col(f"{t}.displayYears").isNotNull() & ~D.display_years_fit(total, F.col(f"{t}.displayYears")), "years"),
    ]
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks)))
    return records.join(own, "id").select(F.col("id").alias("key"), F.explode(told).alias("detail"))


def members(records: DataFrame) -> DataFrame:
    """(key, path, name, text): every member of every record, however deep."""
    return quality.walk(records.select("id", F.parse_json(F.to_json(F.struct(*(c for c in records.columns if c != "ord")))).alias("_doc")), F.col("_doc"), "id")


def vocabulary(records: DataFrame, settings: Settings) -> DataFrame:
    """Members called confidence with another word, wherever they are."""
    found = members(records).where("name = 'confidence'")
    return quality.where(found, "key", ~F.coalesce(F.col("text").isin(*settings.confidences), F.lit(False)), F.concat("path", F.lit(" is "), F.coalesce("text", F.lit("null"))))


def forbidden_sources(records: DataFrame, settings: Settings) -> DataFrame:
    """Pages of sources with a forbidden word that aren't allowed, wherever they are."""
    found = members(records).where(F.col("path").rlike("[sS]ource/page$"))
    bad = reduce(lambda x, k: x | F.contains("text", F.lit(k)), settings.forbidden, F.lit(False)) & ~F.col("text").isin(*settings.allowed_sources)
    return quality.where(found, "key", F.coalesce(bad, F.lit(False)), F.concat("path", F.lit(" is "), "text"))


def event_dates(records: DataFrame) -> DataFrame:
    """Dates of events that are none, precisions that are finer than the date, and objects with other sides than start and end."""
    sides = [("date", "start"), ("startDate", "start"), ("endDate", "end")]
    e = events(records).withColumn("key", F.concat_ws("#", "id", "kind", "ev_ix"))
    json = F.col("datePrecision")
    checks = []
    for c, side in sides:
        checks += [(F.col(c).isNotNull() & _strict(c).isNull(), f"{c} is no date"), (F.col(c).isNotNull() & (D.depth(_strict(c)) < _need(D.precision(D.precision_of(json, side)))), f"{c} isn't as precise as it says")]
    shape = json.startswith("{") & (F.size(F.array_except(F.json_object_keys(json), F.array(F.lit("start"), F.lit("end")))) > 0)
    checks.append((shape, "the precision has other sides"))
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks)))
    return e.select("key", F.explode(told).alias("detail"))


def portraits(manifest: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """A manifest (id, localFile) against files (name, md5) and the records' ids: repeated, orphaned, missing and equal files."""
    note = lambda df, key, what: df.select(F.col(key).cast("string").alias("key"), F.lit(what).alias("detail"))
    parts = [
        note(aggregates.duplicates(manifest, "id"), "id", "listed twice"), note(matching.orphans(manifest, ids, ["id"]), "id", "no such record"),
        note(matching.orphans(manifest.select(F.col("localFile").alias("name")), files, ["name"]), "name", "no such file"), note(matching.orphans(files, manifest.select(F.col("localFile").alias("name")), ["name"]), "name", "not listed"),
        note(files.join(aggregates.duplicates(files, "md5"), "md5", "left_semi"), "name", "equal to another"),
    ]
    return reduce(DataFrame.union, parts)


def rules(records: DataFrame, meta: DataFrame, settings: Settings = Settings(), manifest: DataFrame | None = None, files: DataFrame | None = None) -> list[Rule]:
    """The suite; the portraits' rule only where a manifest and files are given."""
    ids = records.select("id")

    def count() -> DataFrame:
        told = records.agg(F.count("*").alias("n")).join(meta.select("count"))  # one row each
        return quality.where(told.withColumn("key", F.lit("meta")), "key", F.col("n") != F.col("count"), F.concat(F.lit("there are "), "n"))

    made = {
        "id": lambda: quality.matches(ids, "id", "id", settings.id_pattern), "id unique": lambda: quality.unique(ids, "id"), "count": count,
        "name": lambda: quality.where(records, "id", F.trim(F.coalesce("name.commonName", F.lit(""))) == "", "no name"),
        "item": lambda: quality.matches(records.select("id", "sources.wikidata"), "id", "wikidata", settings.item_pattern), "item unique": lambda: quality.unique(records.select("sources.wikidata"), "wikidata"),
        "reign dates": lambda: reign_dates(records, settings), "counts": lambda: group_counts(records), "bce years": lambda: bce_years(records), "event years": lambda: event_years(records),
        "overlaps": lambda: overlaps(records, settings), "ages": lambda: ages(records, settings), "null notes": lambda: null_notes(records), "title year": lambda: title_years(records),
        "summary": lambda: summaries(records), "vocabulary": lambda: vocabulary(records, settings), "event dates": lambda: event_dates(records), "sources": lambda: forbidden_sources(records, settings),
    }
    if manifest is not None and files is not None:
        made["portraits"] = lambda: portraits(manifest, files, ids)
    soft = {"event years", "overlaps", "ages", "null notes"}
    return [Rule(name, "warning" if name in soft else "error", find, settings.allowed.get(name, ())) for name, find in made.items()]
