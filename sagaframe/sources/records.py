"""Nested record documents, graphs, maps and manifests as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<page:string,lang:string,note:string,quote:string,conversion:string>"
EVENT = f"struct<date:string,startDate:string,endDate:string,datePrecision:string,note:string,source:{SOURCE},target:string,outcome:string,name:string,leader:string,`from`:string,`to`:string>"
GROUP = f"struct<count:int,events:array<{EVENT}>,confidence:string,note:string>"
#: The counted event groups of a record, in the order in which their events are listed.
GROUPS = ("eraChangeCount", "amnestyCount", "empressInstallationCount", "crownPrinceDepositionCount", "personalCampaignCount", "rebellionSuppressionCount", "rebellionSufferedCount", "capitalRelocationCount")
_CATEGORY = f"struct<category:string,note:string,confidence:string,source:{SOURCE}>"
RECORD = (
    "struct<id:string,name:struct<personalName:string,commonName:string,templeName:string,posthumousName:string,regnalTitle:string,aliases:array<string>>,"
    "dynasty:struct<name:string,category:string,section:string>,"
    "reigns:array<struct<startYear:int,endYear:int,startDate:string,endDate:string,startDateRaw:string,endDateRaw:string,datePrecision:struct<start:string,end:string>,dynastyOrder:int,isRestoration:boolean,"
    f"duration:struct<value:double,unit:string,approxDays:int,exactDays:int,needsPreciseDays:boolean,source:{SOURCE}>,durationRaw:string,raw:string,note:string>>,"
    "reignSummary:struct<firstStartYear:int,lastEndYear:int,reignCount:int,totalReignDuration:struct<approxDays:int,exactDays:int,displayYears:double,isExact:boolean,needsPreciseDays:boolean>>,"
    "flags:struct<isFemale:boolean,selfProclaimed:boolean,usedEmperorTitleFrom:int>,sources:struct<wikidata:string,cbdb:string>,"
    "verification:struct<emperorTitleConfirmed:boolean,confidence:string,notes:string>,"
    f"deathCause:{_CATEGORY},accessionRoute:{_CATEGORY},"
    "ages:struct<birthDate:string,birthDatePrecision:string,deathDate:string,deathDatePrecision:string,accessionAge:int,deathAge:int,confidence:string,note:string>,"
    + ",".join(f"{g}:{GROUP}" for g in GROUPS) + ">"
)
META = "struct<title:string,count:int,schemaVersion:string,generatedAt:string,version:string>"
PERSON = f"struct<id:string,name:string,kana:string,aliases:array<string>,kind:string,gender:string,section:string,birthYear:int,deathYear:int,yearsApproximate:boolean,inclusionReason:array<string>,note:string,wikidata:string,source:{SOURCE}>"
EDGE = f"struct<type:string,`from`:string,`to`:string,category:string,relationToPredecessor:string,isRestoration:boolean,relation:string,childOrder:int,primaryLineage:boolean,veracity:string,confidence:string,note:string,source:{SOURCE}>"


def documents(spark: SparkSession, path: str, records: str = "records") -> tuple[DataFrame, DataFrame]:
    """(meta, records) of a document {meta, <records>: [...]}; ``ord`` is a record's place, which breaks ties.

    A precision that is a string or an object is read as its JSON text.
    """
    raw = spark.read.schema(f"meta {META}, {records} array<{RECORD}>").option("multiLine", True).json(path)
    return raw.select("meta.*"), raw.select(F.posexplode(records).alias("ord", "_r")).select("ord", "_r.*")


def children(records: DataFrame) -> DataFrame:
    """(id, ord, reign_ix, reign fields): one row for each reign."""
    return records.select("id", "ord", "dynasty", F.posexplode("reigns").alias("reign_ix", "_r")).select("id", "ord", "dynasty", "reign_ix", "_r.*")


def events(records: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(id, kind, kind_ord, ev_ix, event fields): the events of all groups, one after the other."""
    listed = F.array(*(F.struct(F.lit(g).alias("kind"), F.lit(i).alias("kind_ord"), F.col(f"{g}.events").alias("events")) for i, g in enumerate(groups)))
    each = records.select("id", F.inline(listed)).select("id", "kind", "kind_ord", F.posexplode("events").alias("ev_ix", "_e"))
    return each.select("id", "kind", "kind_ord", "ev_ix", "_e.*")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(persons, edges) of a document {persons, edges}."""
    raw = spark.read.schema(f"persons array<{PERSON}>, edges array<{EDGE}>").option("multiLine", True).json(path)
    return raw.select(F.inline("persons")), raw.select(F.posexplode("edges").alias("ord", "_e")).select("ord", "_e.*")


def map_of_lists(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(id, pos, value) of a document {<field>: {id: [values]}}; the order of each list is kept."""
    raw = spark.read.schema(f"{field} map<string, array<string>>").option("multiLine", True).json(path)
    return raw.select(F.explode(field).alias("id", "_vs")).select("id", F.posexplode("_vs").alias("pos", "value"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a document that is one array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ledger(spark: SparkSession, path: str, schema: str = "key string, id string, path string, span string, status string, corpusFile string, frags array<string>") -> DataFrame:
    """A ledger of one JSON object a line; empty where there is none yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def file_ids(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(id, path): the names, without suffix, of a folder's files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]+){suffix.replace('.', chr(92) + '.')}$", 1).alias("id"), "path")


def unknown_members(spark: SparkSession, path: str, records: str, known: list[str]) -> DataFrame:
    """(ord, member): members of records that the strict schema doesn't have."""
    raw = spark.read.schema(f"{records} array<string>").option("multiLine", True).json(path)
    each = raw.select(F.posexplode(records).alias("ord", "_json"))
    return each.select("ord", F.explode(F.array_except(F.json_object_keys("_json"), F.array(*map(F.lit, known)))).alias("member"))
