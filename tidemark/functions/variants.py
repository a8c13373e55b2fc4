"""Typed access to JSON fields: a field as it is written in JSON, its kind, number and text.

A document is parsed once; each field is cut out of it as its own JSON text, whose first
character tells the kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def written(document: Column, name: str) -> Column:
    """A top-level field of a VARIANT as JSON text, null if absent."""
    if '"' in name or "\\" in name:
        raise ValueError(f"field name {name!r} cannot be addressed")
    return F.to_json(F.try_variant_get(document, f'$["{name}"]', "variant"))


def fields(document: Column, names: tuple[str, ...]) -> Column:
    """The named top-level fields of a VARIANT in one struct of JSON texts, after `parsed`: whether there is a document.

    The work sits in a lambda, so the document is evaluated once.
    """
    return F.transform(F.array(document), lambda v: F.struct(v.isNotNull().alias("parsed"), *[written(v, n).alias(n) for n in names]))[0]


def kind(j: Column) -> Column:
    """absent, null, number, bool, string, list or object."""
    first = F.substring(j, 1, 1)
    return (
        F.when(j.isNull(), "absent")
        .when(first == '"', "string")
        .when(first == "n", "null")
        .when(first.isin("t", "f"), "bool")
        .when(first == "[", "list")
        .when(first == "{", "object")
        .otherwise("number")
    )


def number(j: Column) -> Column:
    """Numbers as double and booleans as 0 or 1; never the content of a string."""
    return F.when(j == "true", 1.0).when(j == "false", 0.0).otherwise(j.try_cast("double"))


def whole(j: Column) -> Column:
    """A number without its fraction, exact where a long holds it."""
    return F.coalesce(j.try_cast("long"), F.when(F.abs(number(j)) < 9.2e18, number(j).cast("long")))


def text(j: Column) -> Column:
    """The content of a string; most need no unescaping."""
    inner = F.substring(j, 2, F.length(j) - 2)
    return F.when(j.startswith('"'), F.when(F.contains(j, F.lit("\\")), F.try_variant_get(F.try_parse_json(j), "$", "string")).otherwise(inner))


def printed(raw: Column, name: str, j: Column) -> Column:
    """The field as it prints: numbers as they are in `raw`, True and False, strings as they are, None otherwise null."""
    path = f"$.{name}" if name.isidentifier() else f'$["{name}"]'
    of = kind(j)
    return F.when(of == "bool", F.initcap(j)).when(of == "string", text(j)).when(of == "number", F.get_json_object(raw, path))
