"""Validation rules: every rule is a Column that is null or an issue; frames are split by them."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import budget
from .text import SAFE_INTEGER, is_blank, lone_surrogate

SOURCE_TYPES = ("markdown", "text", "conversation")
LOCATION_KINDS = ("text-range", "conversation-message")
ISSUE = "struct<code: string, path: array<string>, pointer: string, message: string>"


def pointer(path: list[str | int]) -> str:
    """a.b[0].c"""
    out = ""
    for part in path:
        out += f"[{part}]" if isinstance(part, int) else f".{part}" if out else part
    return out


@dataclass(frozen=True)
class Issue:
    code: str
    path: tuple
    message: str

    @property
    def pointer(self) -> str:
        return pointer(list(self.path))


class EngineError(Exception):
    """An error with a stable code."""

    code = "ENGINE_ERROR"

    def __init__(self, message: str, issues: list[Issue] | None = None) -> None:
        self.issues = issues or []
        super().__init__(message + "".join(f"; {i.pointer or '<root>'}: {i.message}" for i in self.issues))


class DomainValidationError(EngineError):
    code = "DOMAIN_INVALID"


class IngestionError(EngineError):
    code = "SOURCE_INGESTION_INVALID_INPUT"


class ChunkingInputError(EngineError):
    code = "MARKDOWN_CHUNKING_INVALID_INPUT"


class ChunkingError(EngineError):
    def __init__(self, code: str, message: str, span: tuple[int, int] | None = None) -> None:
        super().__init__(message)
        self.code, self.span = code, span


class TokenizerError(EngineError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def issue(code: str, path: list[str | int], message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.array(*[F.lit(str(p)) for p in path]).alias("path"), F.lit(pointer(path)).alias("pointer"), F.lit(message).alias("message"))


def unless(good: Column, path: list[str | int], message: str, code: str = "invalid_value") -> Column:
    """The issue where `good` is not true; null counts as not true."""
    return F.when(~F.coalesce(good, F.lit(False)), issue(code, path, message))


def filled(column: str, path: list[str | int] | None = None, optional: bool = False) -> Column:
    from .text import blank

    good = ~blank(column)
    return unless(F.col(column).isNull() | good if optional else good, path or [column], "must not be empty or whitespace-only")


def hash_rule(column: str) -> Column:
    return unless(F.col(column).rlike(r"\Asha256:[0-9a-f]{64}\z"), [column], "must be sha256: and 64 lowercase hex digits")


def one_of(column: str, values: tuple[str, ...]) -> Column:
    return unless(F.col(column).isin(*values), [column], f"must be one of {', '.join(values)}", "invalid_enum_value")


def is_instant(column: str) -> Column:
    """YYYY-MM-DDTHH:MM:SS[.1-9 digits]Z, a real instant from year 100 on."""
    shape = F.col(column).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z\z")
    parts = F.regexp_extract(column, r"\A([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    real = F.try_to_timestamp(parts, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return shape & real & (F.substring(column, 1, 4) >= "0100")


def instant_rule(column: str) -> Column:
    return unless(F.col(column).isNull() | is_instant(column), [column], "must be a real UTC instant")


def json_object_rule(column: str) -> Column:
    parsed = F.try_parse_json(column)
    return unless(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), [column], "must be a JSON object")


def count_rule(column: str, optional: bool = False) -> Column:
    good = budget.is_safe_count(column)
    return unless(F.col(column).isNull() | good if optional else good, [column], "must be a safe integer of at least 0")


def scope_rules() -> list[Column]:
    return [filled("tenantId"), filled("workspaceId"), filled("projectId", optional=True)]


def ingestion_rules() -> list[Column]:
    """Rules of source-ingestion input: scope, identity, type, title and times as columns."""
    return [
        *scope_rules(), one_of("sourceType", SOURCE_TYPES), filled("namespace"), filled("key"), unless(F.col("content").isNotNull(), ["content"], "must be a string"),
        instant_rule("createdAt"), instant_rule("updatedAt"), json_object_rule("metadata"),
    ]


def document_rules() -> list[Column]:
    return [
        filled("id"), unless(F.col("schemaVersion") == 1, ["schemaVersion"], "must be 1"), *scope_rules(), one_of("sourceType", SOURCE_TYPES),
        hash_rule("contentHash"), instant_rule("createdAt"), instant_rule("updatedAt"), json_object_rule("metadata"),
    ]


def location_rules() -> list[Column]:
    """A tagged union in flat columns: each kind has its own fields, and none of the other's."""
    ranged, message = F.col("kind") == "text-range", F.col("kind") == "conversation-message"
    offsets = F.col("startOffset").between(0, SAFE_INTEGER) & F.col("endOffset").between(0, SAFE_INTEGER)
    lines = (F.col("startLine").isNull() | (F.col("startLine") >= 1)) & (F.col("endLine").isNull() | (F.col("endLine") >= 1))
    from .text import blank

    named = ~blank("messageId") & (F.col("messageIndex").isNull() | F.col("messageIndex").between(0, SAFE_INTEGER))
    return [
        one_of("kind", LOCATION_KINDS),
        F.when(ranged, unless(offsets & lines, ["startOffset"], "offsets must be at least 0 and lines at least 1")),
        F.when(ranged & (F.col("endOffset") < F.col("startOffset")), issue("invalid_value", ["endOffset"], "must not be before startOffset")),
        F.when(ranged & (F.col("endLine") < F.col("startLine")), issue("invalid_value", ["endLine"], "must not be before startLine")),
        F.when(ranged & F.coalesce(F.col("messageId"), F.col("messageIndex").cast("string")).isNotNull(), issue("unrecognized_keys", ["messageId"], "belongs to another kind")),
        F.when(message, unless(named, ["messageId"], "must not be empty, and its index at least 0")),
        F.when(message & F.coalesce("startOffset", "endOffset", F.col("startLine").cast("long"), F.col("endLine").cast("long")).isNotNull(), issue("unrecognized_keys", ["startOffset"], "belongs to another kind")),
    ]


def block_rules() -> list[Column]:
    return [
        filled("id"), unless(F.col("schemaVersion") == 1, ["schemaVersion"], "must be 1"), *scope_rules(), filled("sourceDocumentId"), one_of("sourceType", SOURCE_TYPES), filled("content"),
        hash_rule("normalizedContentHash"), count_rule("tokenCount"), instant_rule("createdAt"), instant_rule("updatedAt"),
        unless(F.col("headingPath").isNull() | (F.size("headingPath") > 0), ["headingPath"], "must be absent rather than empty"), json_object_rule("metadata"),
    ]


def budget_rules() -> list[Column]:
    return [
        count_rule("totalTokens"), count_rule("reservedOutputTokens"), *[count_rule(c, optional=True) for c in budget.RESERVES[1:]],
        F.when(~F.coalesce(budget.fits(), F.lit(True)), issue("invalid_value", ["totalTokens"], "must hold all reserves")),
    ]


def only_keys(column: str, allowed: tuple[str, ...]) -> Column:
    """Rejects a JSON object with keys that the record doesn't have; schema-on-read would drop them."""
    extra = F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    return F.when(F.size(extra) > 0, F.struct(F.lit("unrecognized_keys").alias("code"), extra.alias("path"), F.lit("").alias("pointer"), F.lit("has unknown keys").alias("message")))


def checked(df: DataFrame, rules: list[Column]) -> DataFrame:
    """df with `issues`: all that its rows violate, in the order of the rules."""
    return df.withColumn("issues", F.filter(F.array(*rules).cast(f"array<{ISSUE}>"), lambda x: x.isNotNull()))


def split(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, without issues, and the rejected ones with theirs."""
    both = checked(df, rules)
    return both.where(F.size("issues") == 0).drop("issues"), both.where(F.size("issues") > 0)


def require(df: DataFrame, rules: list[Column]) -> DataFrame:
    """df, which fails at run time at its first invalid row."""
    both = checked(df, rules)
    return both.where(F.when(F.size("issues") > 0, F.raise_error(F.to_json("issues")).cast("boolean")).otherwise(True)).drop("issues")


def scopes_equal(left: str, right: str) -> Column:
    return (F.col(f"{left}tenantId") == F.col(f"{right}tenantId")) & (F.col(f"{left}workspaceId") == F.col(f"{right}workspaceId")) & F.col(f"{left}projectId").eqNullSafe(F.col(f"{right}projectId"))


def malformed_unicode(namespace: str, key: str, content: str) -> list[Issue]:
    """Issues of unpaired surrogates, in this order; for strings before they become a DataFrame."""
    out = []
    for path, text in ((("identity", "namespace"), namespace), (("identity", "key"), key), (("content",), content)):
        at = lone_surrogate(text)
        if at is not None:
            out.append(Issue("invalid_unicode", path, f"must be well-formed UTF-16: lone surrogate at code unit {at}"))
    return out


@dataclass(frozen=True)
class ChunkOptions:
    """Token policy: a preferred size, and a limit for all but indivisible content."""

    targetTokens: int
    maxTokens: int

    def __post_init__(self) -> None:
        issues = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, int) or not 0 < v <= SAFE_INTEGER:
                issues.append(Issue("invalid_value", ("options", f.name), "must be a positive safe integer"))
        if not issues and self.targetTokens > self.maxTokens:
            issues.append(Issue("invalid_value", ("options", "targetTokens"), "must not be greater than maxTokens"))
        if issues:
            raise ChunkingInputError("chunking options are invalid", issues)


def check_tokenizer(tokenizer: object) -> None:
    issues = [Issue("invalid_value", ("tokenizer", f), "must not be empty or whitespace-only") for f in ("id", "version") if not isinstance(getattr(tokenizer, f, None), str) or is_blank(getattr(tokenizer, f))]
    if not callable(getattr(tokenizer, "count", None)):
        issues.append(Issue("invalid_type", ("tokenizer", "count"), "must be a function"))
    if issues:
        raise ChunkingInputError("tokenizer is invalid", issues)


IDENTIFIER = re.compile(r"sha256:[0-9a-f]{64}\Z")
