"""Content-derived hashes and identities as Columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import json_string, json_text

# What is hashed with an identity's data, so that stored identities stay comparable.
DOCUMENT_KIND = "blockwise-source-document"
BLOCK_KIND = "blockwise-context-block"
ALGORITHM = 1


def digest(column: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def digest_text(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def document_id(tenant: str, workspace: str, project: str, source_type: str, namespace: str, key: str, kind: str = DOCUMENT_KIND) -> Column:
    """Identity of a source: its scope, type, namespace and key; never its content."""
    parts = [F.lit(json_text(kind)), F.lit(str(ALGORITHM)), json_string(tenant), json_string(workspace), F.coalesce(json_string(project), F.lit("null")), *map(json_string, (source_type, namespace, key))]
    return F.concat(F.lit("source-document:"), digest(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))))


def normalised_hash(content: str | Column) -> Column:
    """Digest of the content with every line ending as LF."""
    return digest(F.regexp_replace(content, r"\r\n?", "\n"))


def block_id(document: str, heading_json: str, content_hash: str, occurrence: str, kind: str = BLOCK_KIND) -> Column:
    """Identity of a block: its document, heading path (as JSON, or null), content, and how many like it come before."""
    parts = [F.lit(json_text(kind)), F.lit(str(ALGORITHM)), json_string(document), F.coalesce(heading_json, F.lit("null")), json_string(content_hash), F.col(occurrence).cast("string")]
    return F.concat(F.lit("context-block:"), digest(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))))
