"""Templates: what many requests have in common once ids, literals and numbers are blanked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The patterns of the three templates. They mean the same to Java's engine and to RE2.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SQL_LITERAL = "'[^']*(?:'|\\z)|\"[^\"]*(?:\"|\\z)|(^|[ =(,\\t\\n><])[0-9][0-9.]*"
TEXT_LITERAL = "\"[^\"]*(?:\"|\\z)|'[^']*(?:'|\\z)|[0-9][0-9.-]*"
HTTP, SQL = ("http1", "http2", "grpc"), ("mysql", "postgres")


def http_template(path: Column) -> Column:
    """A path without UUIDs and numeric segments."""
    parts = F.split(F.regexp_replace(path, UUID, "?"), "/", -1)
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike("^[0-9]+\\z"), F.lit("?")).otherwise(s)), "/")


def sql_template(statement: Column) -> Column:
    """A statement without string literals and numbers."""
    return F.regexp_replace(statement, SQL_LITERAL, "$1?")


def text_template(text: Column) -> Column:
    """A text without quoted parts and numbers."""
    return F.regexp_replace(text, TEXT_LITERAL, "?")


def request_template(protocol: Column, method: Column, path: Column) -> Column:
    """The template of a message by its protocol: of a statement the path alone, else method and path; empty for neither."""
    method, path = F.coalesce(method, F.lit("")), F.coalesce(path, F.lit(""))
    shown = F.when(protocol.isin(*HTTP), http_template(path)).otherwise(path)
    return F.when(protocol.isin(*SQL), sql_template(path)).when(method == "", shown).otherwise(F.concat_ws(" ", method, shown))
