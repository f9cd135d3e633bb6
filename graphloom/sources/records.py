"""Line-delimited JSON, CSV and XML in and out. Readers take fixed schemas: nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import markup as M
from graphloom.functions.text import clean_text, publication_date

PAPER = "pmid string, title string, abstract string, journal string, publication_date string, mesh_terms array<string>, query_pack string, query_pack_source string, matched_queries array<string>"
MENTION = "text string, label string, start int, end int, confidence double, normalized_text string"
ENTITIES = "pmid string, entities array<struct<" + ",".join(x.strip().replace(" ", ":") for x in MENTION.split(",")) + ">>"
CLAIM = "claim string, source_pmid string, evidence_level int, confidence double, classification_method string, evidence_cues array<string>"
_NODE = "struct<label:string,key_value:string,properties:map<string,string>>"
RECORD = (
    f"pmid string, nct_id string, paper_properties map<string,string>, trial_properties map<string,string>, nodes array<{_NODE}>, relations array<struct<head:{_NODE},relation:string,tail:{_NODE},source_pmid:string,source_id:string,evidence_tier:int,confidence:double,qualifiers:map<string,string>,properties:map<string,string>>>"
)
TRIAL = "nct_id string, brief_title string, official_title string, overall_status string, phases array<string>, study_type string, conditions array<string>, interventions array<string>, start_date string, primary_completion_date string, completion_date string, enrollment_count int, sponsor string, has_results boolean, last_update_posted string, source_url string, query string"


def read_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Strict: a line that isn't valid fails the job. Several paths are one table."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def line_numbers(lines: DataFrame) -> DataFrame:
    """First number (from 1) of each file block's lines: file, block, first (its least `at`), before (lines of the file's earlier
    blocks). A file is read in blocks by many tasks; each counts its own lines, and the counts of a file's blocks add up."""
    blocks = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def read_json_permissive(spark: SparkSession, paths: str | list[str], schema: str, required: Iterable[str] = (), checks: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows; and every rejected line: file, line (its number in the file, blank ones counted), kind, message, text.

    kind is `json` for a line that is no JSON, `schema` for JSON that is no object, lacks a required field, has a field of
    another type or fails one of the checks (message: SQL condition over the fields that must not hold). Blank lines are skipped.
    Only rejects are numbered, by their place in their file block; no task holds a file.
    """
    meta = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = spark.read.text(paths).select(*meta, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_text"))
    filled = lines.where(F.trim(F.regexp_replace("_text", r"[\t\x0b\f\r]", " ")) != "")
    fields = StructType.fromDDL(schema).fields
    rows = filled.withColumn("_r", F.from_json("_text", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = rows.select("_file", "_block", "_at", "_text", F.try_parse_json("_text").isNotNull().alias("_json"), "_r", "_r.*")
    there = lambda f: F.get_json_object("_text", f"$['{f}']").isNotNull()
    wanted = set(required)
    found = [(~F.trim("_text").startswith("{"), "expected an object")]
    found += [(F.col(f.name).isNull() & there(f.name), f"{f.name}: expected {f.dataType.simpleString()}") for f in fields]
    found += [(~there(f.name), f"{f.name}: field required") for f in fields if f.name in wanted]
    found += [(F.expr(condition), message) for message, condition in (checks or {}).items()]
    said_of = F.array_compact(F.array(*[F.when(c, m) for c, m in found]))
    told = F.when(~F.col("_json"), F.array(F.lit("invalid JSON"))).when(F.size(said_of) > 0, said_of).when(F.col("_r._corrupt_record").isNotNull(), F.array(F.lit("not of the schema")))
    rows = rows.withColumn("_told", told)
    bad = rows.where(F.col("_told").isNotNull()).select("_file", "_block", "_at", "_text", "_json", "_told")
    numbered = bad.join(line_numbers(lines), ["_file", "_block"]).select(
        F.col("_file").alias("file"),
        (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line"),
        F.when(F.col("_json"), "schema").otherwise("json").alias("kind"),
        F.array_join("_told", "; ").alias("message"),
        F.col("_text").alias("text"),
    )
    return rows.where(F.col("_told").isNull()).select(*(f.name for f in fields)), numbered


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Columns in name order; a folder for each value of the `by` columns."""
    out = df.select(*sorted(df.columns)).write.mode(mode)
    (out.partitionBy(*by) if by else out).json(path)


def read_mentions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_json(spark, paths, ENTITIES).select("pmid", F.inline("entities"))


def read_graph(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """edges and nodes of paper and trial records, told apart row by row."""
    rows = read_json(spark, paths, RECORD).withColumn("record_type", F.when(F.col("nct_id").isNotNull(), "trial").otherwise("pubmed")).withColumn("record_id", F.coalesce("nct_id", "pmid"))
    r = rows.select("record_type", "record_id", F.posexplode("relations").alias("i", "r"))
    edges = r.select(
        "record_type", "record_id", (F.col("i") + 1).alias("relation_index"), F.col("r.head.label").alias("head_label"), F.col("r.head.key_value").alias("head_key"), F.col("r.relation").alias("relation"),
        F.col("r.tail.label").alias("tail_label"), F.col("r.tail.key_value").alias("tail_key"), F.coalesce("r.source_id", "r.source_pmid").alias("source_id"), F.col("r.evidence_tier").alias("evidence_tier"),
        F.col("r.confidence").alias("confidence"), F.coalesce("r.properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )
    n = rows.select("record_type", "record_id", F.posexplode("nodes").alias("ord", "n"))
    nodes = n.select("record_type", "record_id", "ord", F.col("n.label").alias("label"), F.col("n.key_value").alias("key"), F.coalesce("n.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    return edges, nodes


def record_type(spark: SparkSession, path: str) -> str:
    """trial if the first line that isn't blank has an nct_id, else pubmed."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.get_json_object("value", "$.nct_id").alias("nct")).head()
    return "trial" if first is not None and first.nct is not None else "pubmed"


def write_queue_csv(queue: DataFrame, path: str, mode: str = "errorifexists") -> None:
    queue.withColumn("reasons", F.array_join("reasons", "; ")).write.mode(mode).option("header", True).csv(path)


def read_review_csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Reviewed rows: reasons as an array, tiers and confidences as numbers (null where they aren't), blanks as null."""
    from graphloom.functions.text import blank_to_null, evidence_tier, split_reasons

    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    out = rows.select(*[blank_to_null(c).alias(c) for c in columns])
    for c in columns:
        if c.endswith("evidence_tier"):
            out = out.withColumn(c, evidence_tier(c))
        elif c == "confidence":
            out = out.withColumn(c, F.expr("try_cast(confidence as double)"))
    return out.withColumn("reasons", split_reasons("reasons")) if "reasons" in columns else out


def read_elements(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """xml: each element of this name in the files, as it stands there. Files are split across tasks at the element's end tag,
    no file is read as a whole."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(paths)
    found = F.regexp_extract("value", rf"(?s)<{tag}(?=[\s>]).*$", 0)
    return rows.select(F.concat(found, F.lit(f"</{tag}>")).alias("xml")).where(~F.col("xml").startswith("</"))


def parse_articles(articles: DataFrame, column: str = "xml") -> DataFrame:
    """Article XML texts to papers; rows without an id go. A field is all text within its element, whatever elements, CDATA
    sections or comments stand in it; its references are resolved, then it is cleaned."""
    a = articles.select(M.normalized(F.col(column)).alias("x")).select(M.element(F.col("x"), "MedlineCitation").alias("m"))
    a = a.select("m", M.element(F.col("m"), "Article").alias("a")).select("m", "a", M.element(F.col("a"), "Journal", "JournalIssue", "PubDate").alias("d"))
    fields = {"pmid": ("m", "PMID"), "title": ("a", "ArticleTitle"), "journal": ("a", "Journal", "Title")}
    fields |= {part: ("d", part) for part in ("MedlineDate", "Year", "Month", "Day")}
    texts = lambda parts: F.transform(parts, M.text_of)
    cleaned = lambda parts: F.filter(F.transform(parts, clean_text), lambda p: p != "")
    headings = F.flatten(F.transform(M.elements(F.col("m"), "MeshHeading"), lambda h: M.elements(h, "DescriptorName")))
    a = a.select(
        *(M.text_of(M.element(F.col(x), *path)).alias(name) for name, (x, *path) in fields.items()),
        texts(M.elements(M.element(F.col("a"), "Abstract"), "AbstractText")).alias("sections"),
        texts(headings).alias("headings"),
    )
    a = a.select(*(clean_text(name).alias(name) for name in fields), F.array_join(cleaned("sections"), " ").alias("abstract"), cleaned("headings").alias("mesh_terms")).where("pmid <> ''")
    date = publication_date(*(F.col(part) for part in ("MedlineDate", "Year", "Month", "Day")))
    return a.select("pmid", "title", clean_text("abstract").alias("abstract"), "journal", date.alias("publication_date"), "mesh_terms")


_STUDY = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,primaryCompletionDateStruct:struct<date:string>,completionDateStruct:struct<date:string>,lastUpdatePostDateStruct:struct<date:string>>,"
    "designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:int>>,conditionsModule:struct<conditions:array<string>>,armsInterventionsModule:struct<interventions:array<struct<name:string>>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>>, hasResults boolean"
)


def flatten_studies(studies: DataFrame, column: str = "json", query: str = "") -> DataFrame:
    """Registry payloads (JSON texts) to flat trial rows."""
    s = studies.select(F.from_json(column, _STUDY).alias("s")).select("s.*")
    p = lambda path: F.col(f"protocolSection.{path}")
    text = lambda path: F.coalesce(p(path), F.lit(""))
    many = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    names = F.transform(p("armsInterventionsModule.interventions"), lambda i: F.coalesce(i["name"], F.lit("")))
    return s.select(
        text("identificationModule.nctId").alias("nct_id"), text("identificationModule.briefTitle").alias("brief_title"), text("statusModule.overallStatus").alias("overall_status"), many(p("designModule.phases")).alias("phases"),
        text("designModule.studyType").alias("study_type"), many(p("conditionsModule.conditions")).alias("conditions"), many(F.filter(names, lambda x: x != "")).alias("interventions"), text("statusModule.startDateStruct.date").alias("start_date"),
        text("statusModule.completionDateStruct.date").alias("completion_date"), p("designModule.enrollmentInfo.count").alias("enrollment_count"), text("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        F.coalesce("hasResults", F.lit(False)).alias("has_results"), F.concat(F.lit("https://clinicaltrials.gov/study/"), text("identificationModule.nctId")).alias("source_url"), F.lit(query).alias("query"),
    )


def query_packs(spark: SparkSession, path: str) -> DataFrame:
    """name, query of each pack file; blank queries go."""
    rows = spark.read.schema("name string, description string, source string, queries array<string>").option("multiLine", True).json(path)
    return rows.select("name", F.explode(F.filter(F.transform("queries", lambda x: F.trim(x)), lambda x: x != "")).alias("query"))


def lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("entries array<struct<term:string,label:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("entries"))


def synonym_table(spark: SparkSession, path: str) -> DataFrame:
    """label_key, text_key, canonical_id, canonical_name; of entries for one key the last wins."""
    from graphloom.functions.text import match_label, match_text

    rows = spark.read.schema("entities array<struct<canonical_id:string,canonical_name:string,labels:array<string>,synonyms:array<string>>>").option("multiLine", True).json(path)
    e = rows.select(F.posexplode("entities").alias("ord", "e")).select("ord", "e.*")
    names = e.select("ord", "canonical_id", "canonical_name", F.explode("labels").alias("label"), F.concat(F.array("canonical_name", "canonical_id"), "synonyms").alias("texts")).select("*", F.explode("texts").alias("text"))
    keyed = names.groupBy(match_label("label").alias("label_key"), match_text("text").alias("text_key")).agg(F.max_by(F.struct("canonical_id", "canonical_name"), "ord").alias("c"))
    return keyed.select("label_key", "text_key", "c.*")
