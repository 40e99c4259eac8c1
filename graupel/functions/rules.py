"""Rules for nested JSON, compiled to one expression that names all violations.

A document is read as VARIANT, so that a missing field, a null and a value of
another type can be told apart.  A rule gives, for the value at a JSON path,
an array of (path, code): ``missing``, ``null``, ``type``, ``blank``, ``range``
or ``url``; the path is that of the value, its steps joined by dots, array
positions from 0.  An array's elements are tested in the array function that
walks it, so a document costs one row whatever its depth.

A text that is no JSON has the one issue (<root>, json); a null text too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import SPACE, bound, stripped

ISSUES = "array<struct<path: string, code: string>>"
#: Schemes whose URLs have a host.
_HOSTED = "https?|wss?|ftp"
_URL = rf"(?is)^(?:(?:{_HOSTED}):[/\\]*[^\s/\\?#<>^|%@:\[\]]+(?::\d*)?(?:[/\\?#].*)?|(?:{_HOSTED}):[/\\]*[^\s/\\?#]*@[^\s/\\?#<>^|%@]+.*|(?:{_HOSTED}):[/\\]*\[[0-9a-f:.]+\].*|(?!(?:{_HOSTED}):)[a-z][a-z0-9+.-]*:.*)$"

#: What isn't white space.
_SHOWN = SPACE.replace("[", "[^", 1)


def _none() -> Column:
    return F.array().cast(ISSUES)


def _issue(path: Column, code: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code")))


def _step(path: Column | None, step) -> Column:
    own = F.lit(step) if isinstance(step, str) else step.cast("string")
    return own if path is None else F.concat(path, F.lit("."), own)


def _named(path: Column | None) -> Column:
    return F.lit("<root>") if path is None else path


class Rule:
    """``issues`` judges a value (VARIANT; null: it isn't there).  Of a value
    that is there and not null, ``inner`` gives the issues, null where it
    hasn't the right type."""

    def inner(self, value: Column, path: Column | None) -> Column:
        raise NotImplementedError

    def issues(self, value: Column, path: Column | None = None, nullable: bool = False) -> Column:
        null = _none() if nullable else _issue(_named(path), "null")
        absent = "null" if path is None else "missing"
        unfit = F.when(F.is_variant_null(value), null).otherwise(_issue(_named(path), "type"))
        return F.when(value.isNull(), _issue(_named(path), absent)).otherwise(F.coalesce(self.inner(value, path), unfit))


@dataclass(frozen=True)
class Text(Rule):
    """A text that isn't blank; with ``url`` one that is an absolute URL, of
    which scheme and host are looked at."""

    url: bool = False

    def inner(self, value, path):
        bad = lambda said: ~stripped(said).rlike(_URL) if self.url else ~said.rlike(_SHOWN)
        judged = bound(F.try_variant_get(value, "$", "string"), lambda said: F.when(bad(said), _issue(_named(path), "url" if self.url else "blank")).otherwise(_none()))
        return F.when(F.schema_of_variant(value) == "STRING", judged)


@dataclass(frozen=True)
class Whole(Rule):
    """A whole number of at least ``least`` that a double holds exactly."""

    least: int

    def inner(self, value, path):
        def judged(number: Column) -> Column:
            sound = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)) & (F.abs(number) < 2.0**53)
            return F.when(sound, F.when(number < self.least, _issue(_named(path), "range")).otherwise(_none()))

        return bound(F.try_variant_get(value, "$", "double"), judged)


@dataclass(frozen=True)
class Flag(Rule):
    def inner(self, value, path):
        return F.when(F.schema_of_variant(value) == "BOOLEAN", _none())


@dataclass(frozen=True)
class Nullable(Rule):
    rule: Rule

    def issues(self, value, path=None, nullable=True):
        return self.rule.issues(value, path, nullable=True)


@dataclass(frozen=True)
class Each(Rule):
    rule: Rule

    def inner(self, value, path):
        return F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: self.rule.issues(x, _step(path, i))))


class Record(Rule):
    """An object with a rule for each of its fields; other fields are free.
    All fields are taken out at once, as each look-up copies what it finds."""

    def __init__(self, **fields: Rule):
        self.fields = fields

    def inner(self, value, path):
        if not self.fields:
            return F.when(F.try_variant_get(value, "$", "map<string, variant>").isNotNull(), _none())
        taken = F.try_variant_get(value, "$", "struct<" + ", ".join(f"`{name}`: variant" for name in self.fields) + ">")
        return bound(taken, lambda o: F.when(o.isNotNull(), F.concat(*(rule.issues(o[name], _step(path, name)) for name, rule in self.fields.items()))))


def violations(body: Column, rule: Rule) -> Column:
    """All issues of a JSON text, in the order of the rule's fields."""
    return bound(F.try_parse_json(body), lambda root: F.when(root.isNull(), _issue(F.lit("<root>"), "json")).otherwise(rule.issues(root)))  # parsed once


def listed(issues: Column) -> Column:
    """Issues as one text: ``path: code; path: code``."""
    return F.array_join(F.transform(issues, lambda x: F.concat(x["path"], F.lit(": "), x["code"])), "; ")


def checked(body: Column, rule: Rule, schema: str, what: str) -> Column:
    """A JSON text as a struct of ``schema``; an error with all issues where it
    breaks the rule."""
    issues = violations(body, rule)
    value = F.variant_get(F.try_parse_json(body), "$", schema)
    return F.when(F.size(issues) == 0, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), listed(issues))))

