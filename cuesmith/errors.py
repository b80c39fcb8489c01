"""Errors as a column: a row is never failed by an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<status: int, code: string, message: string>"

#: The status of each code.
STATUS = {
    "INVALID_URL": 400, "UPSTREAM_TOO_LARGE": 502, "UPSTREAM_ERROR": 502, "INVALID_REDIRECT": 502,
    "UPSTREAM_NOT_FOUND": 404, "TOO_MANY_REDIRECTS": 502, "UPSTREAM_TIMEOUT": 504, "SUBTITLE_NOT_FOUND": 404,
    "INVALID_ID": 400, "INVALID_ARCHIVE": 422, "SRT_TOO_LARGE": 422, "INVALID_PAGE": 400, "INVALID_QUERY": 400,
    "METHOD_NOT_ALLOWED": 405, "NOT_FOUND": 404, "INTERNAL_ERROR": 500,
}


def error(code: str, message: str | Column | None = None) -> Column:
    text = message if isinstance(message, Column) else F.lit(message if message is not None else code.lower().replace("_", " "))
    return F.struct(F.lit(STATUS[code]).alias("status"), F.lit(code).alias("code"), text.alias("message"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR)
