"""Typed document collections on Spark: a small lenient SQL dialect and a fluent builder over one query model."""

from .engine import Collection, Engine
from .plans.builder import field
from .plans.query import Atom, Query
from .schema import CollectionSchema, Field, define

__all__ = ["Atom", "Collection", "CollectionSchema", "Engine", "Field", "Query", "define", "field"]
