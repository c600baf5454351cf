"""Picking typed values out of loosely structured quote documents (VARIANT columns).

A field may sit under several names, and in the document itself or in one of its
nested objects. The search is source-major: all names in the document first, then
all names in the first nested object, and so on; the first usable value wins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nested objects of a chain document, in search order.
NESTED_SOURCES = [
    "latestQuote",
    "latest_quote",
    "quote",
    "latestTrade",
    "latest_trade",
    "trade",
    "snapshot",
    "dailyBar",
    "daily_bar",
    "greeks",
]


def members(value: Column, names: Sequence[str]) -> Column:
    """The named members of an object; NULL for anything but an object, and for absent members.

    A struct with a place for each known name: the document is walked once, and a member is
    then found by its place instead of by its name.
    """
    fields = ", ".join(f"`{name}` variant" for name in dict.fromkeys(names))
    return F.try_variant_get(value, "$", f"struct<{fields}>")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def text_member(source: Column, key: str) -> Column:
    """Member ``key`` if it is a non-empty JSON string; other JSON types do not count."""
    value = source[key]
    text = F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))
    # Nested, so that an absent member costs one lookup.
    return F.when(value.isNotNull(), F.when(F.schema_of_variant(value) == "STRING", text))


def number_member(source: Column, key: str) -> Column:
    """Member ``key`` as a double; text that is no number, and NaN, do not count."""
    number = F.try_variant_get(source[key], "$", "double")
    return F.nanvl(number, F.lit(None).cast("double"))


def names_of(*fields: Mapping[str, Sequence[str]] | Sequence[str]) -> list[str]:
    """All member names of some fields."""
    lists = [keys for f in fields for keys in (f.values() if isinstance(f, Mapping) else [f])]
    return [name for keys in lists for name in keys]


def flat_source(document: Column, names: Sequence[str]) -> Column:
    """The document as the only source, with its members of these names."""
    return F.array_compact(F.array(members(document, names)))


def nested_sources(document: Column, names: Sequence[str]) -> Column:
    """The document and its nested objects as sources, in search order."""

    def with_nested(held: Column) -> Column:
        own, nested = held["own"], held["nested"]
        return F.array_compact(F.array(own, *[members(nested[key], names) for key in NESTED_SOURCES]))

    # A list of one binds the members to a name, so that they are unpacked once.
    both = F.struct(members(document, names).alias("own"), members(document, NESTED_SOURCES).alias("nested"))
    return F.flatten(F.transform(F.array(both), with_nested))


def search(
    sources: Column, numbers: Mapping[str, Sequence[str]], texts: Mapping[str, Sequence[str]]
) -> Column:
    """Look every field up in every source (a struct of members): array of structs, one per source.

    ``numbers`` and ``texts`` name the fields and the keys to try for each. All fields
    are found in one walk over the sources; ``found`` then picks from the result.
    """

    def fields(source: Column) -> Column:
        values = [
            F.coalesce(*[number_member(source, key) for key in keys]).alias(name)
            for name, keys in numbers.items()
        ] + [
            F.coalesce(*[text_member(source, key) for key in keys]).alias(name)
            for name, keys in texts.items()
        ]
        return F.struct(*values)

    return F.transform(sources, fields)


def found(searched: Column, name: str) -> Column:
    """Value of a field in the first source that has one."""
    return F.get(F.array_compact(searched.getField(name)), 0)


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    Plain ``withColumns`` lets the optimizer copy an expression into every later filter
    and projection that uses it, which for these long searches multiplies the work. A
    generator is a boundary to that.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def whole(number: Column) -> Column:
    """Truncate towards zero to BIGINT; NULL when out of range."""
    return number.try_cast("bigint")
