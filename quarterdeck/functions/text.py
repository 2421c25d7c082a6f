"""Nested values at a text boundary."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarterdeck.functions.scalars import col


def json_map(text, kind: str = "map<string,string>") -> Column:
    """A JSON object as a map; missing or malformed text is an empty map."""
    return F.coalesce(F.from_json(col(text), kind), F.create_map().cast(kind))
