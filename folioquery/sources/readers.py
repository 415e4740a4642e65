"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery import fixed

RECONCILIATION = (
    "yours_only array<struct<date:string,pages:array<int>,header:string>>, theirs_only array<struct<date:string,pages:array<int>,header:string>>, "
    "same_dates array<struct<date:string,your_pages:array<int>,their_pages:array<int>,your_header:string,their_header:string>>"
)
EXECUTIONS = "run_id string, iteration int, status string, output string, result string, prompt string, step_name string, started string, finished string"
LETTERS = "id string, index int, date string, provider string, category array<string>, subcategory array<string>, pageCount int, pages array<struct<pageNumber:int>>, content string"
STEPS = "id string, name string, kind string, priority int, action struct<model:string,temperature:double,messages:array<struct<role:string,template:string>>,overKey:string,iterationLimit:int,batchSize:int,json:string,template:string>"
PROJECTS = "id string, name string, documents array<struct<id:string,status:string,kind:string,file:struct<filename:string,url:string,bytesize:bigint,type:string>>>, runs array<struct<id:string,status:string,finished:string>>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path and text of whole files; invalid bytes become the replacement character."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def page_map(spark: SparkSession, path: str, side: str) -> DataFrame:
    """side, logical, physical of a JSON object; a missing file is an empty map."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "side string, logical int, physical int")
    pairs = raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("logical", "physical"))
    return pairs.select(F.lit(side).alias("side"), F.col("logical").try_cast("int").alias("logical"), "physical").filter("logical is not null")


def reconciliation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """same_dates, yours_only and theirs_only of a reconciliation file."""
    raw = spark.read.schema(RECONCILIATION).json(path, multiLine=True)

    def rows(name: str) -> DataFrame:
        return raw.select(F.posexplode(name).alias("ordinal", "e")).select(F.col("ordinal").cast("string").alias("entry_id"), "ordinal", "e.*")

    return rows("same_dates"), rows("yours_only"), rows("theirs_only")


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines snapshot of a run's table: EXECUTIONS, LETTERS, STEPS or PROJECTS."""
    return spark.read.schema(schema).json(path)


def letters(spark: SparkSession, path: str) -> DataFrame:
    """Letters in the shape that the checks take."""
    rows = snapshot(spark, path, LETTERS)
    return rows.select("id", "index", "date", "provider", "category", "subcategory", F.col("pageCount").alias("page_count"), F.transform("pages", lambda p: p["pageNumber"]).alias("pages"), "content")


def processed_documents(projects: DataFrame) -> DataFrame:
    """Files of documents whose status is processed, in any case."""
    d = projects.select(F.col("id").alias("project_id"), F.explode("documents").alias("d"))
    return d.filter(F.lower("d.status") == "processed").select("project_id", F.col("d.id").alias("document_id"), "d.file.*")


def index_texts(pages: DataFrame, most: int = fixed.INDEX_PDF_PAGES) -> DataFrame:
    """doc_id and text of indexes whose pages are at hand as (doc_id, page, text): the first pages, line after line."""
    first = pages.filter(F.col("page") <= most).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return first.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
