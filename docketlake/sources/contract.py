"""The source's contract from its metadata document: entity sets and their properties, read from XML."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
#: The properties that the mapping of each entity set needs, two of them misspelt by the source.
REQUIRED = {
    "LegislativeSessions": "SessionKey SessionName BeginDate EndDate CreatedDate ModifiedDate",
    "Measures": "SessionKey MeasurePrefix MeasureNumber RelatingTo RelatingToFull CreatedDate ModifiedDate",
    "Legislators": "SessionKey LegislatorCode FirstName LastName CreatedDate ModifiedDate",
    "Committees": "SessionKey CommitteeCode CommitteeName CreatedDate ModifiedDate",
    "MeasureSponsors": "SessionKey MeasurePrefix MeasureNumber MeasureSponsorId LegislatoreCode CreatedDate ModifiedDate",
    "CommitteeMeetings": "SessionKey CommitteeCode MeetingDate CreatedDate ModifiedDate",
    "CommitteeAgendaItems": "SessionKey MeasurePrefix MeasureNumber CommitteeAgendaItemId CommitteCode CreatedDate ModifiedDate",
    "CommitteeMeetingDocuments": "SessionKey MeasurePrefix MeasureNumber CommitteeMeetingDocumentId DocumentType CreatedDate ModifiedDate",
    "CommitteePublicTestimonies": "SessionKey MeasurePrefix MeasureNumber CommTestId PdfCreatedFlag CreatedDate ModifiedDate",
    "FloorLetters": "SessionKey MeasurePrefix MeasureNumber FloorLetterId FloorLetterUrl",
}
_TYPES = "array<struct<_Name: string, Property: array<struct<_Name: string>>>>"
_SETS = "array<struct<EntitySet: array<struct<_Name: string, _EntityType: string>>>>"
SCHEMA = f"DataServices struct<Schema: array<struct<EntityType: {_TYPES}, EntityContainer: {_SETS}>>>, broken_ string"


def properties(documents: DataFrame, key: str, xml: str) -> tuple[DataFrame, DataFrame]:
    """((key, entity, property), (key) of documents that are no XML): the properties of each entity set of each metadata document; property is null for a set whose type has none.

    A set names its type with a namespace, which is not compared. Null and empty documents are no XML; one that is XML without entity sets has no rows. XML is read by Spark, a document a row,
    once for both frames and over all partitions.
    """
    spread = documents.select(key, C(xml).alias("xml_")).repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = spread.select(key, "xml_", F.from_xml("xml_", SCHEMA, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken_", "mode": "PERMISSIVE"}).alias("m"))
    bad = F.coalesce(F.trim("xml_") == "", F.lit(True)) | C("m").isNull() | C("m.broken_").isNotNull()
    parsed = read.select(key, bad.alias("bad_"), C("m.DataServices").alias("m")).persist(StorageLevel.DISK_ONLY)
    broken, fine = parsed.where("bad_").select(key), parsed.where("not bad_")
    schemas = fine.select(key, F.explode("m.Schema").alias("s"))
    types = schemas.select(key, F.explode("s.EntityType").alias("t")).select(key, C("t._Name").alias("type_"), F.explode_outer("t.Property._Name").alias("property"))
    sets = schemas.select(key, F.explode("s.EntityContainer").alias("c")).select(key, F.explode("c.EntitySet").alias("e")).select(key, C("e._Name").alias("entity"), F.substring_index("e._EntityType", ".", -1).alias("type_")).where("entity is not null")
    return sets.join(types, [key, "type_"], "left").select(key, "entity", "property").distinct(), broken


def report(documents: DataFrame, key: str, xml: str, required: dict[str, str] = REQUIRED) -> DataFrame:
    """(key, finding, entity, property, material): what each metadata document lacks.

    A document that is no XML has one finding, metadata_parse_error; else each entity set that is not there is one missing_entity_set, and each missing property of the others one missing_property. All
    are material to completeness; a document without findings is compatible. Equal keys are one document.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(p).alias("property")) for e, ps in required.items() for p in ps.split()]))
    found, broken = properties(documents, key, xml)
    sound = documents.select(key).distinct().join(broken, key, "left_anti")
    missing = sound.select(key, wanted.alias("r_")).select(key, "r_.*").join(found, [key, "entity", "property"], "left_anti")
    missing = missing.join(found.select(key, "entity", F.lit(True).alias("there_")).distinct(), [key, "entity"], "left")
    whole = missing.where("there_ is null").select(key, F.lit("missing_entity_set").alias("finding"), "entity", F.lit(None).cast("string").alias("property")).distinct()
    some = missing.where("there_").select(key, F.lit("missing_property").alias("finding"), "entity", "property")
    none = broken.distinct().select(key, F.lit("metadata_parse_error").alias("finding"), F.lit("$metadata").alias("entity"), F.lit(None).cast("string").alias("property"))
    return none.union(whole).union(some).withColumn("material", F.lit(True))
