"""The rule suite on typed graphs of persons and edges (succession, kinship, marriage), and on calendar claims and quotations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.functions import dates as D
from sagaframe.functions import text as T
from sagaframe.operators import graph, matching, quality, search
from sagaframe.operators.quality import Rule
from sagaframe.sources import corpus as corpora


@dataclass(frozen=True)
class Relations:
    """The words of a graph for kinship, and the category of a restoration (None: categories of restorations aren't looked at)."""

    father: str = "father"
    fathers: tuple[str, ...] = ("father",)
    mothers: tuple[str, ...] = ("mother",)
    siblings: tuple[str, ...] = ("sibling",)
    restoration: str | None = None

    @property
    def parents(self) -> tuple[str, ...]:
        return self.fathers + self.mothers


WORDS = Relations()
#: The words of the data format. Two of the four parents are adoptive.
FORMAT = Relations("実父", ("実父", "養父"), ("実母", "養母"), ("兄弟姉妹",), "復位")


def _restores() -> Column:
    return F.coalesce("isRestoration", F.lit(False))


def _disputed() -> Column:
    return F.coalesce(F.col("veracity") == "disputed", F.lit(False))


def _succeeds() -> Column:
    return F.col("type") == "succession"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def persons(people: DataFrame, ids: DataFrame, pattern: str = "^p-", vocabularies: dict[str, list[str]] | None = None) -> DataFrame:
    """Ids of the wrong form or already taken by ``ids``, words outside of vocabularies, births after deaths."""
    parts = [
        quality.matches(people, "id", "id", pattern), quality.unique(people, "id"),
        people.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("key"), F.lit("taken").alias("detail")),
        quality.where(people, "id", F.coalesce(F.col("birthYear") > F.col("deathYear"), F.lit(False)), "born after death"),
        *(quality.vocabulary(people, "id", c, values) for c, values in (vocabularies or {}).items()),
    ]
    return _union(parts)


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("key", F.concat_ws(">", F.coalesce("from", F.lit("-")), F.col("type"), F.coalesce("to", F.lit("-"))))


def endpoints(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ends that nobody has. A restoration may come from nowhere."""
    e = _keyed(edges)
    sides = []
    for side in ("from", "to"):
        lost = e.where(F.col(side).isNotNull()).join(ids.select(F.col("id").alias(side)), side, "left_anti")
        sides.append(lost.select("key", F.concat(F.lit(f"no {side} "), F.col(side)).alias("detail")))
    free = F.coalesce("isRestoration", F.lit(False)) & (F.col("type") == "succession")
    return _union([*sides, quality.where(e, "key", F.col("to").isNull() | (F.col("from").isNull() & ~free), "an end is missing"), quality.where(e, "key", F.coalesce(F.col("from") == F.col("to"), F.lit(False)), "goes to itself")])


def repeated(edges: DataFrame, words: Relations = WORDS) -> DataFrame:
    """Edges told twice. Marriages and siblings have no direction; a succession is another one where it restores or is disputed; restorations from nowhere may be several."""
    told = edges.where(~(_succeeds() & _restores() & F.col("from").isNull()))
    both = (F.col("type") == "marriage") | F.coalesce(F.col("relation").isin(*words.siblings), F.lit(False))
    marks = F.when(_succeeds() & _restores(), "restored"), F.when(_succeeds() & _disputed(), "disputed")
    ends = F.when(both, F.least("from", "to")).otherwise(F.coalesce("from", F.lit("-"))), F.when(both, F.greatest("from", "to")).otherwise(F.col("to"))
    return quality.unique(told.select(F.concat_ws(">", ends[0], "type", F.coalesce("relation", F.lit("")), ends[1], *marks).alias("key")), "key")


def limits(edges: DataFrame, words: Relations = WORDS) -> DataFrame:
    """More than one first succession that isn't disputed, verified natural father, or primary lineage into one person."""
    kinds = F.array_compact(F.array(
        F.when(_succeeds() & ~_restores() & ~_disputed(), "succession"),
        F.when((F.col("relation") == words.father) & (F.col("veracity") == "verified"), "father"),
        F.when(F.coalesce("primaryLineage", F.lit(False)) & F.col("relation").isin(*words.parents), "lineage"),
    ))
    each = edges.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.explode(kinds).alias("kind"))
    over = graph.cardinality(each, {"succession": 1, "father": 1, "lineage": 1})
    return over.select(F.col("id").alias("key"), F.concat_ws(" ", "n", "kind").alias("detail"))


def restorations(edges: DataFrame, records: DataFrame, words: Relations = FORMAT) -> DataFrame:
    """Restorations of another category than theirs, and persons with more of them than restored reigns."""
    told = _keyed(edges).where(_succeeds() & _restores())
    reigns = records.select(F.col("id").alias("to"), F.size(F.filter("reigns", lambda r: r["isRestoration"])).alias("reigns"))
    counts = told.groupBy("to").agg(F.count("*").alias("n")).join(reigns, "to", "left").withColumn("reigns", F.greatest(F.coalesce("reigns", F.lit(0)), F.lit(0)))
    over = quality.where(counts, "to", F.col("n") > F.col("reigns"), F.concat_ws(" ", "n", F.lit("restorations for"), "reigns", F.lit("restored reigns")))
    return over.union(quality.where(told, "key", ~F.col("category").eqNullSafe(F.lit(words.restoration)), F.concat(F.lit("a restoration as "), F.coalesce("category", F.lit("nothing")))))


def parents(edges: DataFrame, words: Relations = WORDS) -> DataFrame:
    return edges.where(F.col("relation").isin(*words.parents)).select(F.col("from").alias("src"), F.col("to").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def cyclic(edges: DataFrame, words: Relations = WORDS) -> DataFrame:
    """Persons that descend from themselves, or lie between those who do."""
    return graph.acyclic_violations(parents(edges, words)).select(F.col("id").alias("key"), F.lit("descends from itself").alias("detail"))


def descents(edges: DataFrame, words: Relations = WORDS, max_length: int = 8) -> DataFrame:
    """The cycles of descent themselves, up to ``max_length`` persons, each from its least person."""
    found = graph.cycle_paths(parents(edges, words), max_length)
    return found.select(F.get("path", F.lit(0)).alias("key"), F.array_join(F.concat("path", F.slice("path", 1, 1)), " > ").alias("detail"))


def genders(edges: DataFrame, people: DataFrame, words: Relations = WORDS) -> DataFrame:
    """Fathers who aren't male, mothers who aren't female, as far as persons tell; records tell nothing."""
    told = _keyed(edges).where(F.col("relation").isin(*words.parents)).join(people.select(F.col("id").alias("from"), "gender"), "from")
    return quality.where(told, "key", F.col("gender").isNotNull() & (F.col("gender") != F.when(F.col("relation").isin(*words.fathers), "male").otherwise("female")), F.concat_ws(" ", "gender", "relation"))


def siblings(edges: DataFrame, words: Relations = WORDS) -> DataFrame:
    """Edges between siblings whose common parent already tells it."""
    found = graph.common_parents(parents(edges, words)).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    told = _keyed(edges).where(F.col("relation").isin(*words.siblings)).withColumn("lo", F.least("from", "to")).withColumn("hi", F.greatest("from", "to"))
    return told.join(found, ["lo", "hi"], "left_semi").select("key", F.lit("follows from a common parent").alias("detail"))


def routes(edges: DataFrame, records: DataFrame, words: Relations = WORDS) -> DataFrame:
    """First successions, but for disputed ones, whose category isn't the record's route of accession; of a restored ruler any but the restoration's."""
    told = _keyed(edges).where(_succeeds() & ~_restores() & ~_disputed()).join(records.select(F.col("id").alias("to"), F.col("accessionRoute.category").alias("route")), "to")
    back = F.coalesce(F.col("route") == F.lit(words.restoration), F.lit(False))
    bad = F.when(back, F.coalesce(F.col("category") == F.col("route"), F.lit(False))).otherwise(~F.col("category").eqNullSafe(F.col("route")))
    return quality.where(told, "key", bad, F.concat_ws(" ", "category", F.lit("for"), "route"))


#: Routes of accession that need no succession.
ROOTS = ("建国", "不詳", "諸説あり")


def coverage(records: DataFrame, edges: DataFrame, phases: DataFrame, rootless: DataFrame, fatherless: DataFrame, words: Relations = FORMAT, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """What a graph lacks by its phases (phase, status), evaluated in the plan: a rule of a phase that isn't completed finds nothing.

    Once succession is completed every record needs one, but for those with a route in ``roots`` or listed as
    ``rootless`` (id, reason); once parentage is, every record needs a father or a place in ``fatherless``. The
    two lists are checked in any phase: ids that no record has, without a reason, listed twice, or stale, as
    the edge is there after all.
    """
    every = records.select("id", F.col("accessionRoute.category").alias("route"))
    gates = (
        ("succession", edges.where(_succeeds()), rootless, ~F.coalesce(F.col("route").isin(*roots), F.lit(False))),
        ("parentage", edges.where(F.col("relation").isin(*words.fathers)), fatherless, F.lit(True)),
    )
    parts = []
    for phase, into, listed, needs in gates:
        covered = into.select(F.col("to").alias("id")).distinct()
        done = phases.where((F.col("phase") == phase) & (F.col("status") == "completed")).select("phase").distinct()
        lacking = every.where(needs).join(covered, "id", "left_anti").join(listed, "id", "left_anti").withColumn("phase", F.lit(phase))
        parts.append(lacking.join(done, "phase", "left_semi").select(F.col("id").alias("key"), F.lit(f"{phase} is completed without it").alias("detail")))
        known = listed.join(records.select("id"), "id", "left_semi")
        parts.append(listed.join(records.select("id"), "id", "left_anti").select(F.col("id").alias("key"), F.lit(f"listed for {phase}, but no record").alias("detail")))
        parts.append(quality.where(known, "id", F.coalesce(F.col("reason"), F.lit("")) == "", f"listed for {phase} without a reason"))
        parts.append(quality.unique(known, "id"))
        parts.append(known.join(covered, "id", "left_semi").select(F.col("id").alias("key"), F.lit(f"listed for {phase}, but stale").alias("detail")))
    return _union(parts)


def uncovered(ids: DataFrame, edges: DataFrame, rootless: list[str]) -> DataFrame:
    """Ids into which no edge goes and that aren't known to have none. For ``Rule.allowed`` see ``rules``."""
    return ids.join(edges.select(F.col("to").alias("id")), "id", "left_anti").where(~F.col("id").isin(rootless) if rootless else F.lit(True)).select(F.col("id").alias("key"), F.lit("no edge leads here").alias("detail"))


def orphans(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Persons that no edge touches."""
    touched = edges.select(F.col("from").alias("id")).union(edges.select("to"))
    return people.join(touched, "id", "left_anti").select(F.col("id").alias("key"), F.lit("touched by no edge").alias("detail"))


def sources(rows: DataFrame, recognised: Column, required: bool = True) -> DataFrame:
    """Rows (key, page) with a source that is missing, if it is ``required``, empty, or not ``recognised``; ``source`` tells whether there is one."""
    none = ~F.coalesce("source", F.lit(False))
    empty = F.coalesce(F.col("page"), F.lit("")) == ""
    parts = [quality.where(rows, "key", ~none & empty, "the source names no page"), quality.where(rows, "key", ~none & ~empty & ~F.coalesce(recognised, F.lit(False)), "a source that isn't recognised")]
    return _union([*parts, quality.where(rows, "key", none, "no source")] if required else parts)


def claims(told: DataFrame, records: DataFrame, recognised: Column) -> DataFrame:
    """Claims (claimant, claimedAncestry, source, page) by nobody known, of nothing, or without a recognised source."""
    each = told.withColumn("key", F.coalesce("claimant", F.lit("-")))
    lost = each.join(records.select(F.col("id").alias("claimant")), "claimant", "left_anti")
    empty = F.coalesce(F.col("claimedAncestry"), F.lit("")) == ""
    return _union([lost.select("key", F.lit("nobody's claim").alias("detail")), quality.where(each, "key", empty, "claims nothing"), sources(each, recognised)])


#: The members of a graph document, and its phases.
MEMBERS = ("meta", "persons", "edges", "genealogicalClaims")
PHASES = ("succession", "parentage", "interdynastic", "crosscheck")


def _named(kind: str):
    return lambda name: F.concat(F.lit(kind), name)


def structure(documents: DataFrame) -> DataFrame:
    """Members and phases that a graph document (path, text as JSON) lacks."""
    inside = [(F.json_object_keys("text"), MEMBERS, ""), (F.json_object_keys(F.get_json_object("text", "$.meta.status.phases")), PHASES, "phase ")]
    lacking = F.flatten(F.array(*(F.transform(F.array_except(F.array(*map(F.lit, names)), F.coalesce(found, F.array().cast("array<string>"))), _named(kind)) for found, names, kind in inside)))
    return documents.select(F.col("path").alias("key"), F.explode(lacking).alias("detail"))


def rules(people: DataFrame, edges: DataFrame, records: DataFrame, rootless: tuple[str, ...] = (), complete: bool = True, vocabularies: dict[str, list[str]] | None = None, words: Relations = WORDS, told: DataFrame | None = None, recognised: Column | None = None, documents: DataFrame | None = None, gated: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> list[Rule]:
    """The suite. Coverage is only asked for a ``complete`` graph; the ids in ``rootless`` may lack an edge and go stale.

    With claims ``told`` and what is ``recognised`` as a source, claims and the edges' sources (source, page) are checked
    too; with ``documents`` (path, text) their structure; with ``gated`` (phases, rootless, fatherless) coverage by phase.
    """
    every = records.select("id").union(people.select("id"))
    out = [
        Rule("persons", "error", lambda: persons(people, records, vocabularies=vocabularies)), Rule("ends", "error", lambda: endpoints(edges, every)), Rule("repeated", "error", lambda: repeated(edges, words)),
        Rule("limits", "error", lambda: limits(edges, words)), Rule("cycles", "error", lambda: cyclic(edges, words)), Rule("descents", "error", lambda: descents(edges, words)), Rule("genders", "error", lambda: genders(edges, people, words)), Rule("siblings", "warning", lambda: siblings(edges, words)),
        Rule("routes", "error", lambda: routes(edges, records, words)), Rule("orphans", "warning", lambda: orphans(people, edges)),
    ]
    if words.restoration is not None:
        out.append(Rule("restorations", "error", lambda: restorations(edges, records, words)))
    if told is not None and recognised is not None:
        out.append(Rule("claims", "error", lambda: claims(told, records, recognised)))
        if {"source", "page"} <= set(edges.columns):
            out.append(Rule("sources", "error", lambda: sources(_keyed(edges), recognised)))
    if documents is not None:
        out.append(Rule("structure", "error", lambda: structure(documents)))
    if gated is not None:
        out.append(Rule("phases", "error", lambda: coverage(records, edges, *gated, words)))
    return out + ([Rule("coverage", "error", lambda: uncovered(records.select("id"), edges, []), rootless)] if complete else [])


def calendar_claims(claims: DataFrame, stored: DataFrame, days: int = 3) -> DataFrame:
    """(id, claim, stored_jdn, off): of each claimed date (id, note) the nearest stored date (id, date) within ``days``; a near miss is off by some."""
    told = claims.select("id", F.explode(D.claims(F.col("note"))).alias("d")).select("id", D.iso(F.col("d")).alias("claim"), D.jdn(F.col("d.y"), F.col("d.m"), F.col("d.d")).alias("x"))
    known = stored.withColumn("d", D.parse_strict(F.col("date"))).where(D.depth(F.col("d")) == 3).select("id", D.jdn(F.col("d.y"), F.col("d.m"), F.col("d.d")).alias("y"))
    near = matching.near(told, known, "x", "y", ["id"], days)
    return near.groupBy("id", "claim").agg(F.min_by("y", F.struct(F.abs(F.col("x") - F.col("y")), "y")).alias("stored_jdn"), F.min(F.abs(F.col("x") - F.col("y"))).alias("off"))


def quotations(units: DataFrame, known: DataFrame, corpus: DataFrame) -> DataFrame:
    """A ledger (key, status, doc_id) brought up to date: new and unresolved units (key, span) are searched in the corpus
    (doc_id, text), found ones keep what they had, and units that are gone drop out."""
    states = matching.ledger(units.select("key").distinct(), known, "key").where("state <> 'stale'")
    open_ = units.join(states.where("state IN ('new', 'retry')").select("key"), "key", "left_semi").dropDuplicates(["key"])
    found = search.staged(open_, corpus, "key", "span", "doc_id", "text")
    fresh = states.join(found, "key", "left")
    status = F.when(F.col("state") == "known", F.col("status")).otherwise(F.coalesce("stage", F.lit("unresolved")))
    return fresh.select("key", status.alias("status"), "doc_id")


def quotation_check(units: DataFrame, known: DataFrame, corpus: DataFrame | Callable[[DataFrame], DataFrame] | None = None, variants: dict[str, str] | None = None) -> DataFrame:
    """Violations (rule, severity, key, detail) of a ledger (key, status, corpusFile, frags) against the units (key, span).

    Units that it lacks or left unresolved are errors, entries without a unit, defects and gaps of the
    corpus warnings. With a ``corpus`` (path, text) the found ones are looked up again in the file that
    the ledger names: an unreadable file is a warning, one with none of the stored fragments an error.
    A ledger without fragments of a unit isn't held against it. Without a corpus only coverage is checked.
    A corpus may also be a function that reads the files of given paths, such as that of ``rooted``.
    """
    want = units.select("key", "span").dropDuplicates(["key"])
    held = want.join(known.select("key", "status", "corpusFile", "frags").dropDuplicates(["key"]).withColumn("_there", F.lit(True)), "key", "left")
    told = lambda df, rule, severity, detail: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key", detail.cast("string").alias("detail"))
    of = lambda status: held.where(F.col("status") == status)
    out = [
        told(held.where("_there IS NULL"), "unregistered", "error", F.col("span")), told(of("unresolved"), "unresolved", "error", F.col("span")),
        told(of("defect"), "defect", "warning", F.col("span")), told(of("lacuna"), "lacuna", "warning", F.col("span")),
        told(known.select("key").distinct().join(want, "key", "left_anti"), "stale", "warning", F.lit(None)),
    ]
    if corpus is not None:
        again = held.where(F.col("status").isin("cache", "corpus")).select("key", F.coalesce("corpusFile", F.lit("")).alias("path"), "frags")
        asked = again.select("path").distinct()
        own = corpus(asked) if callable(corpus) else corpus.join(asked, "path", "left_semi")
        named = own.select("path", T.for_match(F.col("text"), variants or {}).alias("_text")).dropDuplicates(["path"])
        looked = again.join(named, "path", "left")
        unread = F.coalesce(F.col("_text"), F.lit("")) == ""
        lost = ~unread & (F.size("frags") > 0) & ~F.exists("frags", lambda f: F.contains("_text", f))
        out += [told(looked.where(unread), "unreadable", "warning", F.col("path")), told(looked.where(lost), "lost", "error", F.col("path"))]
    return reduce(DataFrame.union, out)


def rooted(roots: list[str]) -> Callable[[DataFrame], DataFrame] | None:
    """The corpus of ``quotation_check`` below some roots, read file by file as the ledger asks; None, so that the
    files' rules are left out, where no root exists."""
    there = corpora.available(roots)
    return (lambda paths: corpora.keyed(paths, there)) if there else None


def status_counts(units: DataFrame, known: DataFrame) -> DataFrame:
    """(status, n) of the units that the ledger has."""
    return units.select("key").join(known.select("key", "status").dropDuplicates(["key"]), "key").groupBy("status").agg(F.count("*").alias("n"))
