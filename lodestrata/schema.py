"""Collection schemas: named typed fields, the primary key first.

Index kinds are hints for the layout on disk (ordered fields sort the files, which makes Parquet's row-group statistics selective);
no query needs them. Names are matched without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass, field as attribute, replace

from pyspark.sql import types as T

from .errors import BindError

PRIMARY, DICTIONARY, ORDERED, NONE = "primary", "dictionary", "ordered", "none"
DEFAULT, COMPRESSED, FLAT = "default", "compressed", "flat"

_SHORT = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "decimal": T.DecimalType(28, 10)}


def as_type(kind: str | T.DataType) -> T.DataType:
    """A Spark type from itself, a short name, or DDL such as ``array<string>``."""
    if isinstance(kind, T.DataType):
        return kind
    return _SHORT.get(kind.lower()) or _parsed(kind.strip())


def _parsed(ddl: str) -> T.DataType:
    """``array<...>``, ``struct<name:type,...>``, ``map<...>`` and ``decimal(p,s)``, without needing a session."""
    low = ddl.lower()
    if low in _SHORT:
        return _SHORT[low]
    if low.startswith("decimal("):
        precision, scale = low[8:-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    if low.startswith("array<"):
        return T.ArrayType(_parsed(ddl[6:-1]))
    if low.startswith("map<"):
        return T.MapType(*map(_parsed, _parts(ddl[4:-1])))
    if low.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), _parsed(t.strip())) for n, t in (p.split(":", 1) for p in _parts(ddl[7:-1]))])
    raise BindError(f"unknown type {ddl}")


def _parts(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    index: str = NONE
    queryable: bool = True

    @property
    def is_collection(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def scalar(self) -> T.DataType:
        """The type that literals are bound to."""
        return self.type.elementType if self.is_collection else self.type


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    fields: tuple[Field, ...]
    full_text: tuple[str, ...] = ()
    layout: str = DEFAULT

    def __post_init__(self):
        if not self.fields:
            raise BindError(f"{self.name}: a primary key is needed")
        seen = set()
        for f in self.fields:
            if f.name.lower() in seen:
                raise BindError(f"{self.name}: two fields are called {f.name}")
            seen.add(f.name.lower())
            if f.is_collection and f.index == ORDERED:
                raise BindError(f"{f.name}: a collection has no order")
            if f.is_collection and self.layout == FLAT:
                raise BindError(f"{f.name}: a flat layout holds no collections")
        if self.layout not in (DEFAULT, COMPRESSED, FLAT):
            raise BindError(f"unknown layout {self.layout}")

    @property
    def key(self) -> str:
        return self.fields[0].name

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    def __getitem__(self, name: str) -> Field:
        found = self.find(name)
        if found is None or not found.queryable:
            raise BindError(f"{name} is not a queryable field of {self.name}")
        return found

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, f.name != self.key) for f in self.fields])

    def to_json(self) -> dict:
        return {"name": self.name, "layout": self.layout, "full_text": list(self.full_text), "fields": [{"name": f.name, "type": f.type.jsonValue(), "index": f.index, "queryable": f.queryable} for f in self.fields]}

    @staticmethod
    def from_json(data: dict) -> CollectionSchema:
        fields = []
        for f in data["fields"]:
            kind = T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": f["type"], "nullable": True, "metadata": {}}]})["x"].dataType
            fields.append(Field(f["name"], kind, f["index"], f["queryable"]))
        return CollectionSchema(data["name"], tuple(fields), tuple(data["full_text"]), data["layout"])

    def describe(self) -> list[tuple[str, str, str]]:
        return [(f.name, f.type.simpleString(), f.index) for f in self.fields]


OK, REINDEX, REPACK = "ok", "needs reindex", "needs repacking"


def compatibility(old: CollectionSchema, new: CollectionSchema) -> str:
    """What re-declaring ``old`` as ``new`` asks for: nothing, other index hints, or rows of another shape."""
    shape = lambda s: [(f.name.lower(), f.type) for f in s.fields]
    if shape(old) != shape(new) or old.layout != new.layout or {x.lower() for x in old.full_text} != {x.lower() for x in new.full_text}:
        return REPACK
    return OK if [f.index for f in old.fields] == [f.index for f in new.fields] else REINDEX


@dataclass(frozen=True)
class _Builder:
    name: str
    fields: tuple[Field, ...] = ()
    text: tuple[str, ...] = ()
    kind: str = DEFAULT
    _: tuple = attribute(default=())

    def primary_key(self, name: str, type: str | T.DataType = "int") -> _Builder:
        return replace(self, fields=(Field(name, as_type(type), PRIMARY), *self.fields))

    def value(self, name: str, type: str | T.DataType = "string", index: str = NONE) -> _Builder:
        return replace(self, fields=(*self.fields, Field(name, as_type(type), index)))

    def collection(self, name: str, element: str | T.DataType = "string", index: str = DICTIONARY) -> _Builder:
        return replace(self, fields=(*self.fields, Field(name, T.ArrayType(as_type(element)), index)))

    def document(self, name: str, type: str | T.DataType) -> _Builder:
        """A part of the document that is stored and searched as text, but not queryable."""
        return replace(self, fields=(*self.fields, Field(name, as_type(type), NONE, False)))

    def full_text(self, *names: str) -> _Builder:
        return replace(self, text=(*self.text, *names))

    def layout(self, kind: str) -> _Builder:
        return replace(self, kind=kind)

    def build(self) -> CollectionSchema:
        if not any(f.index == PRIMARY for f in self.fields):
            raise BindError(f"{self.name}: a primary key is needed")
        built = CollectionSchema(self.name, self.fields, self.text, self.kind)
        for name in self.text:
            if built.find(name) is None:
                raise BindError(f"{name}: no such field to search")
        return built


def define(name: str) -> _Builder:
    """Start a schema: ``define("homes").primary_key("id").value("town").collection("tags").build()``."""
    return _Builder(name)


def of_frame(name: str, struct: T.StructType, key: str, full_text: tuple[str, ...] = (), indexes: dict[str, str] | None = None) -> CollectionSchema:
    """The schema of an existing DataFrame; nested fields are kept but not queryable."""
    indexes = indexes or {}
    fields = []
    for f in struct.fields:
        nested = isinstance(f.dataType, (T.StructType, T.MapType)) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType))
        fields.append(Field(f.name, f.dataType, PRIMARY if f.name.lower() == key.lower() else indexes.get(f.name, NONE), not nested))
    fields.sort(key=lambda f: f.index != PRIMARY)
    if fields[0].index != PRIMARY:
        raise BindError(f"{key} is not a column of {name}")
    return CollectionSchema(name, tuple(fields), full_text)
