"""Request logs: sanitised contexts, redaction, outcomes, error envelopes."""

from __future__ import annotations

import json
import traceback

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed value: paths of a log record whose values aren't logged.
REDACTED = (
    "authorization", "Authorization", "cookie", "Cookie", "cookies", "req.headers.authorization", "req.headers.Authorization", "req.headers.cookie", "req.headers.Cookie",
    "headers.authorization", "headers.Authorization", "headers.cookie", "headers.Cookie", "response.headers.set-cookie", "response.headers.Set-Cookie",
    "jwt", "token", "sessionToken", "accessToken", "refreshToken", "body", "request.body", "response.body",
)
MARK = "[Redacted]"


def _kept(value):
    """Scalars, and arrays of what is scalar in them (none: dropped)."""
    if isinstance(value, (str, int, float, bool)) or value is None:
        return value
    if isinstance(value, list):
        return [v for v in value if not isinstance(v, (dict, list))] or ...
    return ...


@F.pandas_udf(StringType())
def sanitised(contexts: pd.Series) -> pd.Series:
    """A JSON object without nested values; null for anything else."""

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        return json.dumps({k: kept for k, v in value.items() if (kept := _kept(v)) is not ...}, ensure_ascii=False, separators=(",", ":"))

    return contexts.map(one)


def redacted(path: Column, value: Column) -> Column:
    """A value, or the mark where its path in the record is one of REDACTED."""
    return F.when(path.isin(*REDACTED), F.lit(MARK)).otherwise(value)


def masked(record: dict) -> dict:
    """The record, changed in place: its values at the REDACTED paths are marks."""
    for path in REDACTED:
        *way, last = path.split(".")
        at = record
        for step in way:
            at = at.get(step) if isinstance(at, dict) else None
        if isinstance(at, dict) and last in at:
            at[last] = MARK
    return record


@F.pandas_udf(StringType())
def redacted_record(records: pd.Series) -> pd.Series:
    """JSON objects with the values at the REDACTED paths replaced by the mark;
    anything else as it is."""

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return text
        if not isinstance(value, dict):
            return text
        return json.dumps(masked(value), ensure_ascii=False, separators=(",", ":"))

    return records.map(one)


def error_record(error: object) -> dict[str, str | None] | None:
    """An error, or whatever was thrown, as a flat record."""
    if error is None:
        return None
    if isinstance(error, BaseException):
        cause = error.__cause__
        return {
            "error_name": type(error).__name__, "error_message": str(error), "error_stack": "".join(traceback.format_exception(error)),
            "error_cause_name": type(cause).__name__ if cause else None, "error_cause_message": str(cause) if cause else None,
        }
    plain = isinstance(error, (str, int, float, bool))
    return {"error_name": type(error).__name__, "error_details": str(error) if plain else "Non-Error value thrown"}


def outcome(status: Column) -> Column:
    return F.when(status >= 400, "failure").otherwise("success")


def route(matched: Column, path: Column) -> Column:
    """The matched route unless it is empty or holds a wildcard, else the path."""
    return F.when((matched != "") & ~F.contains(matched, F.lit("*")), matched).otherwise(path)


def user(existing: Column, session: Column) -> Column:
    return F.coalesce(F.nullif(existing, F.lit("")), F.nullif(session, F.lit("")))


def duration(ms: Column) -> Column:
    return F.round(ms, 2)


def lifecycle(requests: DataFrame) -> DataFrame:
    """Two events a request: started, then completed or failed."""
    end = F.when(F.col("status") >= 400, "failed").otherwise("completed")
    return requests.select("*", F.posexplode(F.array(F.lit("started"), end)).alias("step", "event"))


def envelope(message: Column, code: Column, context: Column) -> Column:
    return F.struct(message.alias("message"), code.alias("code"), context.alias("context"))


@F.pandas_udf(ArrayType(StringType()))
def issue_paths(contexts: pd.Series) -> pd.Series:
    """Paths of the validation issues in a JSON context: those of its
    ``validations`` that are objects without a path or with one of strings and
    numbers; parts joined by dots, ``<root>`` where there are none."""

    def good(issue):
        path = issue.get("path") if isinstance(issue, dict) else ...
        return path is None or isinstance(path, list) and all(isinstance(x, (str, int, float)) and not isinstance(x, bool) for x in path)

    def one(text):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        issues = value.get("validations") if isinstance(value, dict) else None
        return [".".join(map(str, i.get("path") or ())) or "<root>" for i in issues if good(i)] if isinstance(issues, list) else []

    return contexts.map(one)
