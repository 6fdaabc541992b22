"""Edits of JSON containers: named arrays of items and a metadata map, a row each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def appended(items: Column, more: Column) -> Column:
    return F.concat(items, more)


def replaced(items: Column, at: int, item: Column) -> Column:
    """Null where the index is out of range."""
    return F.when((F.size(items) > at) & (F.lit(at) >= 0), F.transform(items, lambda x, i: F.when(i == at, item).otherwise(x)))


def removed(items: Column, at: int) -> Column:
    """Null where the index is out of range."""
    return F.when((F.size(items) > at) & (F.lit(at) >= 0), F.filter(items, lambda x, i: i != at))


def merged(metadata: Column, more: Column) -> Column:
    """Shallow merge; new keys win."""
    kept = F.map_filter(metadata, lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(kept, more)


def created(kind: Column, number: Column, paths: Column) -> Column:
    """A new container: an id of kind and six hex digits of a hash of a number, and an empty array for each declared path."""
    name = F.concat(kind, F.lit("_"), F.substring(F.md5(number.cast("string")), 1, 6))
    empty = F.map_from_arrays(F.array_distinct(paths), F.transform(F.array_distinct(paths), lambda p: F.array().cast("array<string>")))
    return F.struct(name.alias("id"), empty.alias("arrays"))


def appended_at(arrays: Column, path: Column, more: Column) -> Column:
    """arrays with items put behind those of a path; null where the path isn't declared."""
    return F.when(F.array_contains(F.map_keys(arrays), path), F.transform_values(arrays, lambda k, v: F.when(k == path, F.concat(v, more)).otherwise(v)))


def assembled(metadata: Column, arrays: Column) -> Column:
    """One JSON object of the metadata (name to JSON text) and the arrays (name to items) at the top level; an array wins over a field of its name. Names are sorted."""
    fields = F.map_concat(F.map_filter(metadata, lambda k, v: ~F.array_contains(F.map_keys(arrays), k)), F.transform_values(arrays, lambda k, v: F.to_json(v)))
    entries = F.array_sort(F.map_entries(fields))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
