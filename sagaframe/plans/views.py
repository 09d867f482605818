"""Analysis-ready views of nested records: wide and light rows, narratives, dated events, timelines, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.functions import dates as D
from sagaframe.functions import text as T
from sagaframe.operators import aggregates, asserting, intervals, lanes, matching, paths, ranking
from sagaframe.sources.records import GROUPS, children, events

UNNAMED, UNKNOWN = "名不詳", "不詳"
RANKED = ("days", "accession_age", "death_age", *(f"n_{g}" for g in GROUPS))


def title(name: str = "name") -> Column:
    return T.display_name(*(F.col(f"{name}.{c}") for c in ("commonName", "personalName", "templeName", "posthumousName")), default=UNNAMED)


def section_key(dynasty: str = "dynasty") -> Column:
    """Name and section; a name alone isn't unique."""
    return F.concat_ws("__", f"{dynasty}.name", f"{dynasty}.section")


def labels(records: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """(key, label, section): a group's name, with its section's suffix where several sections have that name."""
    groups = records.select(section_key().alias("key"), F.col("dynasty.name").alias("name"), F.col("dynasty.section").alias("section")).distinct()
    several = groups.groupBy("name").agg((F.count_distinct("section") > 1).alias("several"))
    listed = F.create_map(*(x for k, v in suffixes.items() for x in (F.lit(k), F.lit(v)))) if suffixes else None
    suffix = F.coalesce(F.element_at(listed, F.col("section")), F.col("section")) if suffixes else F.col("section")
    return groups.join(several, "name").select("key", T.qualified(F.col("name"), F.col("several"), suffix).alias("label"), "section")


def wide(records: DataFrame) -> DataFrame:
    """One flat row for each record. A missing count group counts 0; other missing values stay null."""
    span = lambda r: D.period(r["startYear"], r["endYear"])
    return records.select(
        "id", "ord", title().alias("title"), T.subtitle(F.coalesce(F.col("name.personalName"), F.lit("")), title()).alias("subtitle"), section_key().alias("key"),
        F.col("dynasty.name").alias("dynasty"), F.col("dynasty.category").alias("category"), F.col("dynasty.section").alias("section"),
        F.col("reignSummary.firstStartYear").alias("first_year"), F.col("reignSummary.lastEndYear").alias("last_year"), F.size(F.coalesce("reigns", F.array())).alias("n_reigns"),
        F.array_join(F.transform("reigns", span), " / ").alias("periods"),
        F.col("reignSummary.totalReignDuration.approxDays").alias("days"), (F.col("reignSummary.totalReignDuration.approxDays") / 365).alias("years"),
        F.coalesce("deathCause.category", F.lit(UNKNOWN)).alias("death_cause"), F.coalesce("accessionRoute.category", F.lit(UNKNOWN)).alias("accession_route"),
        F.col("ages.accessionAge").alias("accession_age"), F.col("ages.deathAge").alias("death_age"),
        *(F.coalesce(f"{g}.count", F.lit(0)).alias(f"n_{g}") for g in GROUPS),
        F.coalesce("flags.isFemale", F.lit(False)).alias("is_female"), F.coalesce("flags.selfProclaimed", F.lit(False)).alias("self_proclaimed"),
        T.search_text(title(), "name.personalName", "name.templeName", "name.posthumousName", "name.regnalTitle", F.array_join("name.aliases", " ")).alias("search_text"),
    )


def with_ranks(flat: DataFrame, metrics: tuple[str, ...] = RANKED) -> DataFrame:
    """``wide`` with rank_<metric> and total_<metric>: the longest first; counts of 0 aren't ranked."""
    for m in metrics:
        eligible = F.col(m) > 0 if m.startswith("n_") else F.lit(True)
        flat = ranking.competition_rank(flat, m, eligible=eligible).withColumnsRenamed({"rank": f"rank_{m}", "total": f"total_{m}"}).drop("tied")
    return flat


def light(flat: DataFrame) -> DataFrame:
    """The columns that a list needs. A subtitle that the search text lacks fails the query: it could be seen but not found."""
    found = F.coalesce(F.contains("search_text", "subtitle"), F.lit(True))
    checked = F.when(found, F.col("search_text")).otherwise(F.raise_error(F.concat(F.lit("no search text has the subtitle of "), "id")))
    return flat.select("id", "ord", "title", "subtitle", "key", "category", "section", "periods", "first_year", "days", checked.alias("search_text"))


def restorations(flat: DataFrame) -> DataFrame:
    """Records of several reigns."""
    return flat.where("n_reigns >= 2").select("id", "title", "key", "n_reigns", "periods")


def _section(field: str) -> Column:
    """A narrative section is there if it has both a note and a source."""
    return F.when((F.col(f"{field}.note") != "") & F.col(f"{field}.source").isNotNull(), F.struct(f"{field}.category", f"{field}.note", T.first_sentence(F.col(f"{field}.note")).alias("lead"), f"{field}.source"))


def narratives(records: DataFrame) -> DataFrame:
    """(id, death, accession, restorations, memos): sections, the notes of restored reigns and of counted groups."""
    restored = F.transform(F.filter("reigns", lambda r: r["isRestoration"]), lambda r: F.struct(D.period(r["startYear"], r["endYear"]).alias("period"), T.null_if_empty(r["note"]).alias("note")))
    memos = F.array_compact(F.array(*(F.when(F.col(f"{g}.note") != "", F.struct(F.lit(g).alias("kind"), F.col(f"{g}.note").alias("note"))) for g in GROUPS)))
    return records.select("id", _section("deathCause").alias("death"), _section("accessionRoute").alias("accession"), restored.alias("restorations"), memos.alias("memos"))


def structured_dates(records: DataFrame) -> DataFrame:
    """(id, birth, death) as ISO texts of the precision that is known; null where nothing can be parsed."""
    at = lambda side: D.iso(D.clamp(D.parse_loose(F.col(f"ages.{side}Date")), D.precision(F.col(f"ages.{side}DatePrecision"))))
    return records.select("id", at("birth").alias("birth"), at("death").alias("death"))


def event_rows(records: DataFrame) -> DataFrame:
    """(id, kind, kind_ord, ev_ix, label, end_label, sort_key, facts): the events of all groups.

    A date that can't be parsed is its own label and has no sort key; those come last, within a kind in
    their order. An end that reads like the start isn't told.
    """
    start, end = F.coalesce("date", "startDate"), F.col("endDate")
    clamped = lambda c, side: D.clamp(D.parse_loose(c), D.precision(F.coalesce(D.precision_of(F.col("datePrecision"), side), F.lit("year"))))
    first, last = clamped(start, "start"), clamped(end, "end")
    told = lambda d, raw: F.coalesce(D.iso(d), raw)
    facts = F.array_compact(F.array(*(F.when(F.col(c) != "", F.struct(F.lit(c).alias("name"), F.col(c).alias("value"))) for c in ("name", "target", "outcome", "leader", "from", "to"))))
    rows = events(records).select("id", "kind", "kind_ord", "ev_ix", told(first, start).alias("label"), told(last, end).alias("_end"), D.sort_key(first).alias("sort_key"), facts.alias("facts"))
    return rows.withColumn("end_label", F.when(~F.col("_end").eqNullSafe(F.col("label")), F.col("_end"))).drop("_end")


def event_summaries(records: DataFrame) -> DataFrame:
    """(id, kind, ev_ix, summary): one line for each event, by its kind: what a campaign was against, a rebellion's name or
    leader, a capital's move; of other kinds the first sentence of the note."""
    revolt = F.coalesce("name", F.concat(F.when(F.col("leader") != "", F.col("leader")), F.lit("の反乱")), F.lit("反乱"))
    moved = F.concat(F.coalesce("from", F.lit("?")), F.lit(" → "), F.coalesce("to", F.lit("?")))
    of = lambda *kinds: F.col("kind").isin(*(f"{k}Count" for k in kinds))
    summary = F.when(of("personalCampaign"), F.coalesce("target", F.lit("親征"))).when(of("rebellionSuppression", "rebellionSuffered"), revolt).when(of("capitalRelocation"), moved)
    return events(records).select("id", "kind", "ev_ix", summary.otherwise(F.coalesce(T.first_sentence(F.col("note")), F.lit("（記録なし）"))).alias("summary"))


def detail_rows(metric: str) -> Column:
    """Labels and values of a record of ``wide`` beside the metric shown, which isn't told twice; missing ages are left out."""
    rows = [] if metric == "days" else [("在位期間", D.duration(F.col("days")))]
    rows += [("死因", F.col("death_cause")), ("即位経路", F.col("accession_route"))]
    if metric != "death_age":
        rows.append(("没年齢", F.concat(F.col("death_age").cast("string"), F.lit("歳"))))
    told = F.array(*(F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in rows))
    return F.filter(told, lambda x: (x["label"] != "没年齢") | x["value"].isNotNull())


def event_order() -> list[Column]:
    return [F.asc_nulls_last("sort_key"), F.asc("kind_ord"), F.asc("ev_ix")]


def event_facets(records: DataFrame) -> DataFrame:
    """(id, kind, n) of the kinds that a record has events of, in the groups' order."""
    return event_rows(records).groupBy("id", "kind", "kind_ord").agg(F.count("*").alias("n")).select("id", "kind", "kind_ord", "n")


def bounds(records: DataFrame) -> tuple[int, int] | None:
    """The first and last historic year of all reigns."""
    row = children(records).agg(F.min("startYear"), F.max("endYear")).first()
    return None if row[0] is None else (row[0], row[1])


def reign_years(records: DataFrame) -> DataFrame:
    """(id, key, category, section, a, b): reigns in astronomical years."""
    each = children(records).select("id", section_key().alias("key"), F.col("dynasty.category").alias("category"), F.col("dynasty.section").alias("section"), "startYear", "endYear")
    return each.withColumn("a", D.astronomical(F.col("startYear")).cast("long")).withColumn("b", D.astronomical(F.col("endYear")).cast("long")).drop("startYear", "endYear")


def bands(records: DataFrame, priority: list[str]) -> DataFrame:
    """(key, a, b, n_spans, n_records, category, segments) for each group: merged spans and the ordered reigns in them.

    Of several categories the one that comes first in ``priority`` counts.
    """
    years = reign_years(records)
    spans = intervals.merge(years, ["key"]).groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n_spans"))
    place = F.coalesce(*(F.when(F.col("category") == c, i) for i, c in enumerate(priority)), F.lit(len(priority)))
    own = years.groupBy("key").agg(F.count_distinct("id").alias("n_records"), F.min_by("category", F.struct(place, "category")).alias("category"), F.sort_array(F.collect_list(F.struct("a", "b", "id"))).alias("segments"))
    return spans.join(own, "key")


def laned_bands(found: DataFrame, main: str | None = None) -> DataFrame:
    """Bands with a lane and a colour slot; neighbours in a lane may share the year of a hand-over. Those of the
    category ``main`` are packed first, the others into lanes behind theirs. All bands are coloured as one
    group, which is small: a row for each group of records."""
    apart = F.lit(0) if main is None else F.coalesce((F.col("category") != main).cast("int"), F.lit(1))
    items = found.select(F.lit(0).alias("_all"), apart.alias("_block"), F.xxhash64("key").alias("id"), "a", "b")
    packed = lanes.pack_blocks(items, ["_all"], "_block")
    slots = lanes.colour(packed, ["_all"]).select("id", "slot")
    return found.withColumn("id", F.xxhash64("key")).join(packed.select("id", "lane"), "id").join(slots, "id").drop("id")


def eras(records: DataFrame) -> DataFrame:
    """(section, a, b, n): the envelope of each section."""
    return reign_years(records).groupBy("section").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count_distinct("id").alias("n"))


def vacancies(records: DataFrame, named: dict[tuple[int, int], str] | None = None, default: str = "空位") -> DataFrame:
    """(a, b, label): the years between the first and the last that no reign covers. What meets in one task are
    distinct years, of which there are as many as the calendar has."""
    years = intervals.units(reign_years(records)).select(F.lit(0).alias("_all"), F.col("at").alias("a"), F.col("at").alias("b")).distinct()
    gaps = intervals.gaps(intervals.merge(years, ["_all"]), ["_all"]).select("a", "b")
    known = reduce(lambda c, kv: F.when((F.col("a") == kv[0][0]) & (F.col("b") == kv[0][1]), kv[1]).otherwise(c), (named or {}).items(), F.lit(default))
    return gaps.withColumn("label", known)


def states(records: DataFrame, sole_until: int | None = None) -> DataFrame:
    """(run, state, first, last, n): runs of years that are vacant, of one group or split between several; a row for each year meets in one task."""
    years = intervals.units(reign_years(records)).groupBy("at").agg(F.count_distinct("key").alias("k"))
    spine = years.agg(F.min("at").alias("a"), F.max("at").alias("b")).select(F.explode(F.sequence("a", "b")).alias("at"))
    sole = (F.col("k") == 1) & (F.col("at") <= sole_until if sole_until is not None else F.lit(True))
    state = F.when(F.col("k").isNull(), "vacant").when(sole, "sole").otherwise("split")
    return aggregates.runs(spine.join(years, "at", "left").withColumn("state", state).withColumn("_all", F.lit(0)), ["_all"], ["at"], "state").drop("_all")


def streams(records: DataFrame, mapping: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """(stream, pa, pb, n): spans of the groups that ``mapping`` (key, stream) puts into each stream, cut before the years ``cuts``.

    The mapping must name every group once, and no other.
    """
    years = reign_years(records)
    wrong = matching.coverage(mapping, years.select("key").distinct(), "key").where("status <> 'both'").select("key", "status").limit(5).collect()
    if wrong:
        raise ValueError(f"groups and streams don't match: {[tuple(r) for r in wrong]}")
    merged = intervals.merge(years.join(mapping, "key"), ["stream"])
    return intervals.cut(merged, F.array(*map(F.lit, cuts or [])).cast("array<bigint>")).select("stream", "pa", "pb", "n")


def sole_pieces(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """(stream, run, first, last, n): runs of years in which all reigning groups belong to the stream."""
    years = intervals.units(reign_years(records)).select("at", "key").distinct().join(mapping, "key")
    alone = years.groupBy("at").agg(F.min("stream").alias("stream"), F.count_distinct("stream").alias("k")).where("k = 1")
    return intervals.merge(alone.select("stream", F.col("at").alias("a"), F.col("at").alias("b")), ["stream"]).withColumnsRenamed({"a": "first", "b": "last"})


def peers(flat: DataFrame, least: int = 5) -> DataFrame:
    """(key, n, mean): groups of at least so many records; means of fewer say little."""
    return flat.groupBy("key").agg(F.count("*").alias("n"), F.avg("days").alias("mean")).where(F.col("n") >= least)


def flat_csv(records: DataFrame) -> DataFrame:
    """A plain flattening for distribution: nothing is inferred, missing values stay empty."""
    first = F.get("reigns", F.lit(0))
    return records.select(
        "id", *(F.col(f"name.{c}").alias(c) for c in ("personalName", "commonName", "templeName", "posthumousName", "regnalTitle")), F.array_join("name.aliases", "|").alias("aliases"),
        F.col("dynasty.name").alias("dynasty"), "dynasty.category", "dynasty.section", first["startYear"].alias("startYear"), first["endYear"].alias("endYear"), first["startDate"].alias("startDate"), first["endDate"].alias("endDate"),
        "reignSummary.firstStartYear", "reignSummary.lastEndYear", "reignSummary.reignCount", "reignSummary.totalReignDuration.approxDays", "reignSummary.totalReignDuration.exactDays", "reignSummary.totalReignDuration.displayYears",
        "flags.isFemale", "flags.selfProclaimed", "flags.usedEmperorTitleFrom", "sources.wikidata", "sources.cbdb", "verification.emperorTitleConfirmed", F.col("verification.confidence").alias("confidence"),
        F.col("deathCause.category").alias("deathCause"), F.col("accessionRoute.category").alias("accessionRoute"), "ages.birthDate", "ages.deathDate", "ages.accessionAge", "ages.deathAge", *(F.col(f"{g}.count").alias(g) for g in GROUPS),
    )


def scoped(records: DataFrame, sections: list[str], extra: list[str] = (), size: int | None = None) -> DataFrame:
    """Records of some sections, and others by id; the plan fails where they aren't ``size``."""
    inside = records.where(F.col("dynasty.section").isin(*sections) | F.col("id").isin(*extra))
    return inside if size is None else asserting.sized(inside, size, "records in scope")


def graph_source(records: DataFrame, people: DataFrame, edges: DataFrame, sections: list[str], extra: list[str] = (), size: int | None = None, types: tuple[str, ...] = ("succession", "kinship"), excerpt: int = 160) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, people, edges) of a graph cut to a scope; edges with an end outside of it go.

    Years of records become astronomical, those of people are so already. A record with a reign's year
    missing or not exactly one reign, and an edge of another type, fail in the plan.
    """
    known = F.forall("reigns", lambda r: r["startYear"].isNotNull() & r["endYear"].isNotNull())
    one = asserting.each(scoped(records, sections, extra, size), (F.size("reigns") == 1) & known, F.concat(F.lit("not one reign of known years: "), "id"))
    reign = F.get("reigns", F.lit(0))
    held = one.select(
        "id", title().alias("name"), section_key().alias("key"), F.col("dynasty.section").alias("section"), F.coalesce("accessionRoute.category", F.lit(UNKNOWN)).alias("route"),
        D.astronomical(reign["startYear"]).cast("long").alias("a"), D.astronomical(reign["endYear"]).cast("long").alias("b"), reign["isRestoration"].alias("restoration"),
    )
    there = people.where(F.col("section").isin(*sections)).select("id", "name", "kind", "section", "birthYear", "deathYear", "yearsApproximate")
    ends = held.select("id").union(there.select("id"))
    kept = edges.join(ends.select(F.col("id").alias("from")), "from", "left_semi").join(ends.select(F.col("id").alias("to")), "to", "left_semi")
    typed = asserting.each(kept, F.col("type").isin(*types), F.concat(F.lit("no such type of edge: "), F.coalesce("type", F.lit("null"))))
    return held, there, typed.select("type", "from", "to", "category", "relationToPredecessor", "relation", "veracity", "confidence", T.truncated(F.col("note"), excerpt).alias("excerpt"), F.col("source.page").alias("page"))


def _spoken(c: Column) -> Column:
    """Quoted spans with six Han characters and no kana."""
    return T.quoted(c, not_kind="ぁ-んァ-ヶ")


def _cited(c: Column) -> Column:
    """The parts between slashes without their short bracketed notes; null for a part with less than six Han characters."""
    parts = F.transform(F.split(c, "[／/]"), lambda x: F.regexp_replace(x, "（[^）]{0,30}）|【[^】]{0,30}】", ""))
    return F.transform(parts, lambda x: F.when(F.length(T.han_only(x)) >= 6, x))


#: The members of a record that hold quotations, with the names that keys of the ledger give them.
QUOTATIONS = [
    paths.Path("reigns[*].duration.source.quote", "reigns[{}].quote", _cited, numbered=True), paths.Path("reigns[*].duration.source.conversion", "reigns[{}].conversion", _spoken), paths.Path("reigns[*].note", "reigns[{}].note", _spoken),
    *(p for g in GROUPS for p in (paths.Path(f"{g}.note", f"{g}.note", _spoken), paths.Path(f"{g}.events[*].note", f"{g}[{{}}].note", _spoken))),
    *(paths.Path(f"{c}.note", f"{c}.note", _spoken) for c in ("deathCause", "accessionRoute", "ages")),
]


def quotation_units(records: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    """(id, path, span, key) of every quotation in the records; keys are those of the ledger."""
    found = paths.values(records, "id", QUOTATIONS).withColumnRenamed("value", "span")
    return found.withColumn("key", T.unit_key(F.col("id"), F.col("path"), T.for_match(F.col("span"), variants or {})))
