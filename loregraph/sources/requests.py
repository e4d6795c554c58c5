"""Request and reference-data sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loregraph import schemas
from loregraph.functions import domains, labels

SCHEMAS = {
    "episode": schemas.EPISODE_REQUEST,
    "bootstrap": schemas.BOOTSTRAP_REQUEST,
    "structured": schemas.STRUCTURED_REQUEST,
    "search": schemas.SEARCH_REQUEST,
    "admin": schemas.ADMIN_REQUEST,
    "finding": schemas.FINDING,
}


def read_requests(
    spark: SparkSession, kind: str, path: str, fmt: str = "json", stream: bool = False, **options: str
) -> DataFrame:
    """Requests of one kind from JSON or Parquet files, with a fixed schema and defaults filled in."""
    reader = spark.readStream if stream else spark.read
    return with_defaults(reader.schema(SCHEMAS[kind]).format(fmt).options(**options).load(path), SCHEMAS[kind])


def with_defaults(requests: DataFrame, schema: StructType) -> DataFrame:
    """Defaults of missing optional fields; required fields stay NULL and fail validation."""
    now = F.current_timestamp()
    empty = {
        "metadata": F.create_map().cast("map<string,string>"),
        "entities": F.array().cast(schemas.STRUCTURED_REQUEST["entities"].dataType),
        "relationships": F.array().cast(schemas.STRUCTURED_REQUEST["relationships"].dataType),
        "timestamp": now,
        "source_description": F.lit(""),
        "max_results": F.lit(10),
        "include_segment": F.lit(True),
        "industry": F.lit(domains.DEFAULT_INDUSTRY),
        "title": F.lit(""),
        "type": F.lit(""),
    }
    if "title" in schema.fieldNames():
        empty["content"] = F.lit("")
    return requests.select(
        *[F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in schema.fieldNames()]
    )


def episode_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in domains.EPISODE_TYPES], "episode_type string")


def entity_types(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The entity-type taxonomy, by default the built-in one; a file that cannot be read gives no rows."""
    schema = "name string, description string"
    if path is None:
        return spark.createDataFrame(domains.ENTITY_TYPES, schema)
    try:
        return spark.read.schema(schema).json(path).filter("name IS NOT NULL")
    except Exception:  # noqa: BLE001 - any failure means an empty taxonomy
        return spark.createDataFrame([], schema)


def rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """Typing rules of tenants from JSON lines: rule_set (missing: for all tenants), priority, field, op, term, result."""
    return spark.read.schema(labels.RULE_SCHEMA).json(path)
