"""Sources: rows to ingested documents with content-derived identity; readers and stores around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, validate

INPUT = T.StructType([T.StructField(n, T.StringType()) for n in ("tenantId", "workspaceId", "projectId", "sourceType", "namespace", "key", "content", "title", "createdAt", "updatedAt", "metadata")])
DOCUMENT = ("id", "schemaVersion", "tenantId", "workspaceId", "projectId", "sourceType", "title", "contentHash", "createdAt", "updatedAt", "metadata", "content")


def ingest(sources: DataFrame) -> DataFrame:
    """Documents of valid input rows: namespace and key are hashed into the id and not kept; the content is unchanged."""
    out = sources.withColumn("id", identity.document_id("tenantId", "workspaceId", "projectId", "sourceType", "namespace", "key"))
    return out.withColumn("schemaVersion", F.lit(1)).withColumn("contentHash", identity.digest("content")).select(*DOCUMENT)


def ingest_checked(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the valid rows, and the rejected rows with their issues."""
    good, bad = validate.split(sources, validate.ingestion_rules())
    return ingest(good), bad


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Input rows from Python values; unknown fields and unpaired surrogates are errors here, before Spark could repair them."""
    for row in rows:
        unknown = set(row) - set(INPUT.names)
        if unknown:
            raise validate.IngestionError("unknown fields", [validate.Issue("unrecognized_keys", (k,), "is not a field") for k in sorted(unknown)])
        issues = validate.malformed_unicode(row.get("namespace") or "", row.get("key") or "", row.get("content") or "")
        if issues:
            raise validate.IngestionError("source is malformed", issues)
    return spark.createDataFrame([{n: row.get(n) for n in INPUT.names} for row in rows], INPUT)


def read_files(spark: SparkSession, path: str, tenant: str, workspace: str, namespace: str, source_type: str = "markdown", pattern: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """Input rows of all files below `path`, keyed by their relative path; files that aren't UTF-8 come back as the second frame."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    named = raw.withColumn("key", F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", ""))
    good, bad = named.where(F.is_valid_utf8(F.col("content").cast("string"))), named.where(~F.is_valid_utf8(F.col("content").cast("string")))
    rows = good.select(
        F.lit(tenant).alias("tenantId"), F.lit(workspace).alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.lit(source_type).alias("sourceType"), F.lit(namespace).alias("namespace"), "key",
        F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("createdAt"), F.lit(None).cast("string").alias("updatedAt"),
        F.to_json(F.struct(F.col("key").alias("path"), F.col("length"))).alias("metadata"),
    )
    return rows, bad.select("path", "length")


def vault(spark: SparkSession, path: str, tenant: str, workspace: str, vault_id: str) -> DataFrame:
    """A vault of Markdown notes: relative path, tags and wiki links as metadata, the note's name as title."""
    rows, _ = read_files(spark, path, tenant, workspace, f"vault:{vault_id}")
    tags = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/-]*)"), F.lit(1)))
    links = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))
    title = F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"\.md$", "")
    return rows.withColumn("metadata", F.to_json(F.struct(F.lit(vault_id).alias("vaultId"), F.col("key").alias("path"), tags.alias("tags"), links.alias("links")))).withColumn("title", title)


def conversations(messages: DataFrame, tenant: str = "local", workspace: str = "default") -> DataFrame:
    """One block for each message of (conv_id, turn, role, text), located by message id and index."""
    key = F.col("conv_id").cast("string")
    out = messages.select(
        F.lit(tenant).alias("tenantId"), F.lit(workspace).alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.lit("conversation").alias("sourceType"),
        F.lit("conversations").alias("namespace"), key.alias("key"), F.concat_ws("/", key, "turn").alias("messageId"), F.col("turn").cast("long").alias("messageIndex"), "role", F.col("text").alias("content"),
    )
    out = out.withColumn("sourceDocumentId", identity.document_id("tenantId", "workspaceId", "projectId", "sourceType", "namespace", "key"))
    return out.withColumn("kind", F.lit("conversation-message")).withColumn("normalizedContentHash", identity.normalised_hash("content"))


class ParquetStore:
    """Rows kept by tenant in a folder, for traces and for control records; save appends, get finds by id within a scope."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("tenantId").parquet(self.path)

    def get(self, tenant: str, id_column: str, id: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where((F.col("tenantId") == tenant) & (F.col(id_column) == id))
