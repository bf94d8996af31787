"""The engine: a catalog of collections with queries, writes, transactions, consistent reads and a log of what was asked."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BindError, ConditionFailed, EngineError, IncompleteData, ReadOnly, WriteConflict
from .functions.predicates import literal, matches, where
from .functions.values import bind
from .operators import eviction, fulltext, metadata, pivot
from .plans import compile as C
from .plans import query as Q
from .plans import sql as S
from .plans.builder import Builder, Condition
from .plans.subset import is_subset
from .schema import CollectionSchema, Field, compatibility, OK, REINDEX, of_frame
from .shipping import ship
from .sources import csv, documents
from .sources.store import BUCKETS, Store, scratch

ACTIVITY = "@ACTIVITY"
#: Log entries that the driver holds; older ones are in a table of the shared folder.
LOG_ROWS = 10_000
_ACTIVITY_SCHEMA = CollectionSchema(ACTIVITY, (Field("id", T.StringType(), "primary"), Field("timestamp", T.TimestampType(), "ordered"), Field("type", T.StringType()), Field("collection", T.StringType()), Field("query", T.StringType()), Field("shape", T.StringType()), Field("microseconds", T.LongType(), "ordered"), Field("plan", T.StringType())))


class Engine:
    """Collections below ``root``, or in memory only views of DataFrames when there is none."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS, retries: int = 8, tokens_to_ignore: Iterable[str] = (), most_entries: int = 0, most_ignored: int = fulltext.MOST_IGNORED):
        """``buckets``: of new collections. ``tokens_to_ignore``, ``most_entries``, ``most_ignored``: stop tokens of full text, see
        ``operators.fulltext``. The session's time zone becomes UTC, which literals of dates and times mean."""
        self.tokens_to_ignore = frozenset(tokens_to_ignore)
        self.stop_rule = {"most_entries": most_entries, "most_ignored": most_ignored}
        self.spark, self.buckets, self.retries = spark, buckets, retries
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.store = Store(spark, root) if root else None
        self._views: dict[str, tuple[CollectionSchema, DataFrame]] = {}
        self._log: deque = deque()
        self._old_log: str | None = None
        self._indexes: dict[tuple, fulltext.Index] = {}
        self._pinned = threading.local()
        self._declared: dict[str, CollectionSchema] = {}

    # -- catalog

    def manifest(self) -> dict:
        pinned = getattr(self._pinned, "manifest", None)
        if pinned is not None:
            return pinned
        return self.store.manifest() if self.store else {"version": 0, "collections": {}, "counters": {}, "read_only": False}

    def declare(self, schema: CollectionSchema) -> Collection:
        """Create a collection, or fit the stored one to its new schema."""
        known = self._declared.get(schema.name.lower())
        if known is not None and compatibility(known, schema) != OK:
            raise BindError(f"{schema.name} was declared differently before")
        self._declared[schema.name.lower()] = schema

        def change(manifest: dict) -> dict:
            entry = manifest["collections"].get(schema.name.lower())
            if entry is None:
                entry = {"buckets": {}, "count": self.buckets, "fully_loaded": False, "domain": None}
            else:
                old = CollectionSchema.from_json(entry["schema"])
                what = compatibility(old, schema)
                if what == OK:
                    return manifest
                if what != REINDEX or any(f.index == "ordered" for f in schema.fields):
                    entry = entry | {"buckets": self._repack(old, schema, entry)}
            entry = entry | {"schema": schema.to_json()}
            return manifest | {"collections": manifest["collections"] | {schema.name.lower(): entry}}

        self.commit(change)
        return self.collection(schema.name)

    def _repack(self, old: CollectionSchema, new: CollectionSchema, entry: dict) -> dict:
        rows = self.store.read(old, entry)
        columns = []
        for f in new.fields:
            had = old.find(f.name)
            columns.append((F.col(f"`{had.name}`").try_cast(f.type) if had else F.lit(None).cast(f.type)).alias(f.name))
        return self.store.write(rows.select(*columns), new, entry["count"])

    def attach(self, name: str, df: DataFrame, key: str, full_text: tuple[str, ...] = ()) -> Collection:
        """A DataFrame as a read-only collection; nothing is copied."""
        self._views[name.lower()] = (of_frame(name, df.schema, key, full_text), df)
        return self.collection(name)

    def collection(self, name: str) -> Collection:
        if name.upper() == ACTIVITY:
            return Collection(self, _ACTIVITY_SCHEMA)
        if name.lower() in self._views:
            return Collection(self, self._views[name.lower()][0])
        entry = self.manifest()["collections"].get(name.lower())
        if entry is None:
            raise BindError(f"there is no collection {name}")
        return Collection(self, CollectionSchema.from_json(entry["schema"]))

    def collections(self) -> list[str]:
        stored = [e["schema"]["name"] for e in self.manifest()["collections"].values()]
        return sorted({*stored, *(s.name for s, _ in self._views.values())})

    def rebucket(self, name: str, buckets: int) -> None:
        """Deal a collection's rows to another number of buckets, in one commit; writers that come in between make it start over."""

        def change(manifest: dict) -> dict:
            entry = manifest["collections"].get(name.lower())
            if entry is None:
                raise BindError(f"there is no collection {name}")
            if buckets < 1:
                raise EngineError("a collection needs a bucket")
            if entry["count"] == buckets:
                return manifest
            schema = CollectionSchema.from_json(entry["schema"])
            fresh = self.store.write(self.store.read(schema, entry), schema, buckets)
            return manifest | {"collections": manifest["collections"] | {name.lower(): entry | {"count": buckets, "buckets": fresh}}}

        self.commit(change)

    def drop(self, name: str) -> None:
        self._views.pop(name.lower(), None)
        self._declared.pop(name.lower(), None)
        if self.store:
            self.commit(lambda m: m | {"collections": {k: v for k, v in m["collections"].items() if k != name.lower()}})

    def drop_database(self) -> None:
        self._views.clear()
        self._declared.clear()
        self.commit(lambda m: m | {"collections": {}, "counters": {}})

    def read_only(self, on: bool = True) -> None:
        self.commit(lambda m: m | {"read_only": on}, force=True)

    # -- commits

    def commit(self, change: Callable[[dict], dict], force: bool = False) -> dict:
        """Apply ``change`` to the newest manifest and publish; on a conflict start over from what the other writer left."""
        if self.store is None:
            raise ReadOnly("an engine without a folder has views only")
        for attempt in range(self.retries):
            base = self.store.manifest()
            if base["read_only"] and not force:
                raise ReadOnly("the engine is read-only")
            new = change(base)
            if new is base:
                return base
            try:
                self.store.publish(new, base["version"])
                return new
            except WriteConflict:
                time.sleep(0.01 * 2**attempt)
        raise WriteConflict("other writers were always first")

    def unique_ids(self, name: str, n: int = 1) -> range:
        """``n`` numbers that no other call gets; after failures there may be gaps."""
        got: list[int] = []

        def change(m: dict) -> dict:
            first = m["counters"].get(name, 0) + 1
            got[:] = [first]
            return m | {"counters": m["counters"] | {name: first + n - 1}}

        self.commit(change)
        return range(got[0], got[0] + n)

    @contextmanager
    def consistent_read(self, *names: str) -> Iterator[list[Collection]]:
        """Collections as of one moment: writes that are published meanwhile are not seen inside."""
        before = getattr(self._pinned, "manifest", None)
        self._pinned.manifest = self.store.manifest() if before is None else before
        try:
            yield [self.collection(n) for n in names]
        finally:
            self._pinned.manifest = before

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- statements

    def sql(self, statement: str, full_text: str | None = None) -> DataFrame:
        """Run one statement. ``delete`` returns the number of rows deleted as ``deleted``, ``into`` that of rows written as
        ``written``; ``explain`` the plan as ``plan``."""
        target = self.collection(S.collection_of(statement))
        query = S.parse(statement, target.schema)
        if full_text:
            query = replace(query, full_text=full_text)
        if query.verb == "delete":
            return self.spark.createDataFrame([(target.delete_where(query),)], "deleted long")
        if query.explain:
            return self.spark.createDataFrame([(target.explain(query),)], "plan string")
        out = target.run(query)
        if query.into:
            return self.spark.createDataFrame([(documents.write_array(out, query.into),)], "written long")
        return out

    def sql_json(self, statement: str, full_text: str | None = None) -> Iterator[str]:
        """The result's rows as JSON documents, streamed."""
        for r in documents.as_json(self.sql(statement, full_text)).toLocalIterator():
            yield r[0]

    # -- log

    def log(self, kind: str, collection: str, text: str, shape: str, seconds: float, plan: str = "") -> None:
        if collection.upper() != ACTIVITY:
            self._log.append((uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc), kind, collection, text, shape, int(seconds * 1e6), plan))
            if len(self._log) > LOG_ROWS:
                self._old_log = self._old_log or scratch(self.spark)
                old = [self._log.popleft() for _ in range(LOG_ROWS // 2)]
                self.spark.createDataFrame(old, _ACTIVITY_SCHEMA.struct()).coalesce(1).write.mode("append").parquet(self._old_log)

    @property
    def activity(self) -> DataFrame:
        """All entries: nothing is forgotten while the engine lives."""
        recent = self.spark.createDataFrame(list(self._log), _ACTIVITY_SCHEMA.struct())
        return recent if self._old_log is None else self.spark.read.schema(_ACTIVITY_SCHEMA.struct()).parquet(self._old_log).unionByName(recent)

    def last(self, n: int = 10) -> DataFrame:
        return self.activity.orderBy(F.col("timestamp").desc(), "id").limit(n)

    def longest(self, n: int = 10) -> DataFrame:
        return self.activity.orderBy(F.col("microseconds").desc(), "id").limit(n)

    def logged(self, query_id: str) -> dict | None:
        found = next((dict(zip([f.name for f in _ACTIVITY_SCHEMA.fields], r)) for r in self._log if r[0] == query_id), None)
        if found is None and self._old_log is not None:
            rows = self.activity.filter(F.col("id") == query_id).limit(1).collect()
            found = rows[0].asDict() if rows else None
        return found

    # -- dumps

    def dump(self, path: str) -> None:
        """All stored collections as of now: a Parquet folder each and a catalog."""
        with self.consistent_read():
            m = self.manifest()
            for entry in m["collections"].values():
                schema = CollectionSchema.from_json(entry["schema"])
                self.store.read(schema, entry).write.parquet(f"{path}/{schema.name.lower()}")
            catalog = [(k, __import__("json").dumps(v)) for k, v in m["collections"].items()]
            counters = [("@counters", __import__("json").dumps(m["counters"]))]
            self.spark.createDataFrame(catalog + counters, "name string, entry string").coalesce(1).write.parquet(f"{path}/@catalog")

    def restore(self, path: str, recreate: bool = False) -> None:
        """Collections of a dump replace those of the same name (all others go if ``recreate``), in one commit."""
        import json

        rows = {r["name"]: json.loads(r["entry"]) for r in self.spark.read.parquet(f"{path}/@catalog").collect()}
        counters = rows.pop("@counters", {})
        fresh = {}
        for name, entry in rows.items():
            schema = CollectionSchema.from_json(entry["schema"])
            data = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema.struct()])).parquet(f"{path}/{name}")
            fresh[name] = entry | {"buckets": self.store.write(data, schema, entry["count"])}
        self.commit(lambda m: m | {"collections": ({} if recreate else m["collections"]) | fresh, "counters": counters if recreate else {k: max(v, m["counters"].get(k, 0)) for k, v in {**m["counters"], **counters}.items()}})


class Collection:
    """One collection: queries and writes."""

    def __init__(self, engine: Engine, schema: CollectionSchema):
        self.engine, self.schema, self.name = engine, schema, schema.name

    # -- reading

    @property
    def entry(self) -> dict | None:
        return None if self._is_view else self.engine.manifest()["collections"].get(self.name.lower())

    @property
    def _is_view(self) -> bool:
        return self.name.lower() in self.engine._views or self.name.upper() == ACTIVITY

    def frame(self) -> DataFrame:
        """All rows."""
        if self.name.upper() == ACTIVITY:
            return self.engine.activity
        if self._is_view:
            return self.engine._views[self.name.lower()][1]
        entry = self.entry
        if entry is None:
            raise BindError(f"there is no collection {self.name}")
        return self.engine.store.read(self.schema, entry)

    def __getitem__(self, key) -> dict | None:
        """The row with this key, from its bucket alone."""
        value = bind(key, self.schema.fields[0].type, self.schema.key) if not (isinstance(key, str) and isinstance(self.schema.fields[0].type, T.StringType)) else key
        rows = self._rows_near([value]) if not self._is_view else self.frame()
        found = rows.filter(F.col(f"`{self.schema.key}`") == literal(value, self.schema.fields[0].type)).limit(1).collect()
        return found[0].asDict(True) if found else None

    def _key_frame(self, values: list) -> DataFrame:
        f = self.schema.fields[0]
        return self.engine.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(f.name, f.type)]))

    def _rows_near(self, keys: list) -> DataFrame:
        entry = self.entry
        near = self.engine.store.buckets_of(self._key_frame(keys), self.schema, entry["count"])
        return self.engine.store.read(self.schema, entry, near)

    def query(self) -> Builder:
        return Builder(self.schema, Q.Query(self.name), self.run)

    def where(self, condition: Condition) -> Builder:
        return self.query().where(condition)

    def parse(self, statement: str) -> Q.Query:
        return S.parse(statement, self.schema)

    def run(self, query: Q.Query) -> DataFrame:
        """The query as a DataFrame. Nothing runs until it is read but the proof of completeness, if that is asked for, and the passes
        of a full-text search that find its tokens' weights (in a view, over all lines)."""
        begin = time.perf_counter()
        if query.only_if_complete:
            self.check_complete(query)
        if query.full_text:
            out = self._ranked(query)
        else:
            out = C.run(query, self.frame(), self.schema)
        kind = "count" if query.count else "search" if query.full_text else "select"
        self.engine.log(kind, self.name, query.describe(), query.shape, time.perf_counter() - begin)
        return out

    def rows(self, query: Q.Query) -> list[dict]:
        """Run and fetch; the log gets the time until the last row."""
        begin = time.perf_counter()
        out = [r.asDict(True) for r in self.run(query).collect()]
        if self.engine._log and self.name.upper() != ACTIVITY:
            last = list(self.engine._log.pop())
            last[6] = int((time.perf_counter() - begin) * 1e6)
            self.engine._log.append(tuple(last))
        return out

    def search(self, text: str, take: int = 10) -> DataFrame:
        return self.run(Q.Query(self.name, full_text=text, take=take))

    def index(self) -> fulltext.Index:
        """Postings of the current snapshot, written once and read by later searches."""
        if not self.schema.full_text:
            raise BindError(f"{self.name} has no full-text fields")
        if self._is_view:
            return fulltext.Index.of(self.frame(), self.schema)
        entry = self.entry
        signature = (self.name.lower(), tuple(sorted(entry["buckets"].items())))
        if signature not in self.engine._indexes:
            path = f"{self.engine.store.root}/text/{self.name.lower()}-{uuid.uuid4().hex}"
            fulltext.Index.write(self.frame(), self.schema, path)
            stale = [k for k in self.engine._indexes if k[0] == self.name.lower()]
            for k in stale:
                del self.engine._indexes[k]
            self.engine._indexes[signature] = fulltext.Index.read(self.engine.spark, path, self.schema.fields[0].type)
        return self.engine._indexes[signature]

    def _ranked(self, query: Q.Query) -> DataFrame:
        """Documents by relevance; a structured condition filters them before the bound is applied, an order by is dropped."""
        stop = self.engine.tokens_to_ignore
        if self._is_view:
            if not self.schema.full_text:
                raise BindError(f"{self.name} has no full-text fields")
            found = fulltext.scan(fulltext.lines(self.frame(), self.schema), query.full_text, scratch(self.engine.spark), stop=stop, **self.engine.stop_rule)
        else:
            found = self.index().search(query.full_text, stop=stop, **self.engine.stop_rule)
        ranked = found.withColumnRenamed("key", "__key")
        rows = C.filtered(self.frame(), query, self.schema)
        found = rows.join(ranked, F.col(f"`{self.schema.key}`") == F.col("__key"))
        if query.distinct:
            return C._distinct(found, query, self.schema)
        if query.count:
            return (C.bounded(found, query) if query.take or query.skip else found).agg(F.count("*").alias("count"))
        found = C.bounded(found.orderBy(F.col("score").desc(), "__key"), query)
        return found.select(*C.projected(query)) if query.select else found.select(*[F.col(f"`{f.name}`") for f in self.schema.fields])

    def explain(self, query: Q.Query) -> str:
        return C.run(replace(query, explain=False), self.frame(), self.schema)._jdf.queryExecution().toString()

    def profile(self, query: Q.Query) -> dict:
        """Run the query to its last row and say how long each part took (seconds), with the final plan; also put in the log."""
        began = time.perf_counter()
        out = self._ranked(query) if query.full_text else C.run(query, self.frame(), self.schema)
        built = time.perf_counter()
        execution = out._jdf.queryExecution()
        execution.executedPlan()
        planned = time.perf_counter()
        rows = _drain(out)
        done = time.perf_counter()
        phases = {"building": built - began, "planning": planned - built, "execution": done - planned}
        plan = execution.toString()
        shown = ", ".join(f"{k} {v:.3f} s" for k, v in phases.items()) + f", {rows} rows"
        self.engine.log("profile", self.name, query.describe(), query.shape, done - began, shown)
        return phases | {"rows": rows, "plan": plan}

    def pivot(self, axes: Iterable[str], values: Iterable[str], condition: Condition | None = None, scale: int = 10) -> DataFrame:
        rows = self.frame() if condition is None else C.filtered(self.frame(), self.where(condition).query, self.schema)
        return pivot.pivot(rows, self.schema, axes, values, scale)

    def most_frequent_tokens(self, most: int) -> DataFrame:
        return fulltext.most_frequent(self.frame(), self.schema, most)

    def metadata(self) -> list[dict]:
        return metadata.describe(self.frame(), self.schema)

    # -- completeness

    def declare_fully_loaded(self, yes: bool = True) -> None:
        self._set(fully_loaded=yes, domain=None)

    def declare_domain(self, condition: Condition | None) -> None:
        """Vouch that all rows that satisfy the condition are loaded."""
        self._set(domain=None if condition is None else self.where(condition).query.sql())

    def set_eviction(self, policy: eviction.LeastRecentlyUsed | eviction.TimeToLive | None) -> None:
        kind = None if policy is None else {"lru": [policy.limit, policy.remove]} if isinstance(policy, eviction.LeastRecentlyUsed) else {"ttl": policy.seconds}
        self._set(eviction=kind)

    def _set(self, **kw) -> None:
        def change(m: dict) -> dict:
            entry = m["collections"][self.name.lower()] | kw
            eviction.check_exclusive(entry.get("eviction"), entry.get("domain"), entry.get("fully_loaded", False))
            return m | {"collections": m["collections"] | {self.name.lower(): entry}}

        self.engine.commit(change)

    def check_complete(self, query: Q.Query) -> None:
        entry = self.entry or {}
        if entry.get("fully_loaded"):
            return
        if entry.get("domain") and is_subset(query, self.parse(entry["domain"])):
            return
        raise IncompleteData(f"the data loaded into {self.name} may not answer: {query.describe()}")

    # -- writing

    def to_frame(self, rows: DataFrame | Iterable[dict]) -> DataFrame:
        """Rows in the schema's shape; a null string key gets a new identifier, any other null key is an error."""
        key = self.schema.fields[0]
        if isinstance(rows, DataFrame):
            have = {c.lower(): c for c in rows.columns}
            out = rows.select(*[(F.col(f"`{have[f.name.lower()]}`").cast(f.type) if f.name.lower() in have else F.lit(None).cast(f.type)).alias(f.name) for f in self.schema.fields])
        else:
            struct = T.StructType([T.StructField(f.name, f.type) for f in self.schema.fields])
            shaped = []
            for r in rows:
                low = {k.lower(): v for k, v in r.items()}
                shaped.append(tuple(low.get(f.name.lower()) for f in self.schema.fields))
            out = self.engine.spark.createDataFrame(shaped, struct)
        c = F.col(f"`{key.name}`")
        if isinstance(key.type, T.StringType):
            return out.withColumn(key.name, F.coalesce(c, F.uuid()))
        return out.withColumn(key.name, F.when(c.isNull(), F.raise_error(F.lit(f"{key.name} is null"))).otherwise(c))

    def put(self, row: dict) -> None:
        self.put_many([row])

    def put_many(self, rows: DataFrame | Iterable[dict]) -> None:
        """Insert or replace by key; of rows with one key in a batch the last wins. One commit."""
        t = self.engine.transaction()
        t.put_many(self, rows)
        t.commit()

    @contextmanager
    def feed(self) -> Iterator[list]:
        """Gather rows or DataFrames and commit them together at the end, or nothing if the block fails."""
        parts: list = []
        yield parts
        loose = [p for p in parts if not isinstance(p, DataFrame)]
        frames = [self.to_frame(p) for p in parts if isinstance(p, DataFrame)] + ([self.to_frame(loose)] if loose else [])
        if frames:
            whole = frames[0]
            for f in frames[1:]:
                whole = whole.unionByName(f)
            self.put_many(whole)

    def try_add(self, row: dict) -> bool:
        """Insert unless the key is there; was it inserted?"""
        t = self.engine.transaction()
        t.put_many(self, [row], only_new=True)
        try:
            t.commit()
        except ConditionFailed:
            return False
        return True

    def update_if(self, row: dict, condition: Condition) -> None:
        """Replace the row of this key if the stored one satisfies the condition."""
        t = self.engine.transaction()
        t.update_if(self, row, condition)
        t.commit()

    def update_with_timestamp(self, row: dict, stamp: str = "Timestamp") -> dict:
        """Replace the row if its time stamp is still the one that was read; returns the row with its new stamp."""
        from .plans.builder import field

        new = {**row, stamp: dt.datetime.now(dt.timezone.utc)}
        self.update_if(new, field(stamp) == row[stamp])
        return new

    def delete(self, key) -> bool:
        """Delete by key; was it there?"""
        return self.delete_where(self.where(_equals(self.schema, key)).query) > 0

    def delete_many(self, condition: Condition) -> int:
        return self.delete_where(self.where(condition).query)

    def delete_where(self, query: Q.Query) -> int:
        """Delete the rows that the condition holds for, all rows if there is none; bounds are ignored. Returns how many went."""
        t = self.engine.transaction()
        t.delete_where(self, query)
        return t.commit()

    def truncate(self) -> int:
        return self.delete_where(Q.Query(self.name))

    def evict(self, time_column: str, now: dt.datetime | None = None, excluded: str | None = None) -> int:
        """Apply the collection's policy to its rows by a time column (of last use, or of insertion); returns how many went."""
        policy = (self.entry or {}).get("eviction")
        if not policy:
            return 0
        rows = self.frame()
        if "lru" in policy:
            kept = eviction.LeastRecentlyUsed(*policy["lru"]).survivors(rows, time_column, self.schema.key, excluded)
        else:
            kept = eviction.TimeToLive(policy["ttl"]).survivors(rows, time_column, now or dt.datetime.now(dt.timezone.utc), excluded)
        before, version = rows.count(), self.entry["buckets"]
        buckets = self.engine.store.write(kept, self.schema, self.entry["count"])

        def change(m: dict) -> dict:
            entry = m["collections"][self.name.lower()]
            if entry["buckets"] != version:
                raise WriteConflict(f"{self.name} changed during eviction")
            return m | {"collections": m["collections"] | {self.name.lower(): entry | {"buckets": buckets}}}

        self.engine.commit(change)
        return before - self.frame().count()

    # -- feeds

    def feed_json(self, texts: Iterable[str]) -> None:
        self.put_many(documents.from_strings(self.engine.spark, texts, self.schema))

    def import_json(self, path: str, array: bool = True) -> None:
        self.put_many(documents.read_file(self.engine.spark, path, self.schema, array))

    def feed_csv(self, path: str, schema: csv.CsvSchema) -> None:
        self.put_many(csv.feed_frame(self.engine.spark, path, schema))

    @staticmethod
    def feed_csv_with_automatic_schema(engine: Engine, path: str, name: str) -> Collection:
        found = csv.infer(engine.spark, path)
        target = engine.declare(found.to_collection(name))
        target.feed_csv(path, found)
        return target


def _drain(df: DataFrame) -> int:
    """Compute all rows, keep none; returns their number."""
    ship(df.sparkSession)
    return df.mapInArrow(_lengths, "n long").agg(F.sum("n")).first()[0] or 0


def _lengths(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


def _equals(schema: CollectionSchema, key) -> Condition:
    from .plans.builder import field

    return field(schema.key) == key


class Transaction:
    """Writes to any number of collections, checked together and published by one manifest."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._steps: list[tuple] = []
        self._done = False

    def put(self, target: Collection, row: dict) -> None:
        self.put_many(target, [row])

    def put_many(self, target: Collection, rows: DataFrame | Iterable[dict], only_new: bool = False) -> None:
        self._steps.append(("put", target, rows if isinstance(rows, DataFrame) else list(rows), only_new))

    def update_if(self, target: Collection, row: dict, condition: Condition) -> None:
        self._steps.append(("update", target, row, target.where(condition).query))

    def delete(self, target: Collection, key) -> None:
        self.delete_where(target, target.where(_equals(target.schema, key)).query)

    def delete_many(self, target: Collection, condition: Condition) -> None:
        self.delete_where(target, target.where(condition).query)

    def delete_where(self, target: Collection, query: Q.Query) -> None:
        self._steps.append(("delete", target, query, None))

    def commit(self) -> int:
        """All or nothing; conditions are checked against the very version that is replaced. Returns the rows deleted."""
        if self._done:
            raise EngineError("the transaction is over")
        self._done = True
        for _, target, *_ in self._steps:
            if target._is_view:
                raise ReadOnly(f"{target.name} is a view")
        begin = time.perf_counter()
        self.deleted = 0

        def change(manifest: dict) -> dict:
            self.deleted = 0
            entries = dict(manifest["collections"])
            for kind, target, what, more in self._steps:
                name = target.name.lower()
                if name not in entries:
                    raise BindError(f"there is no collection {target.name}")
                apply = {"put": self._put, "update": self._update, "delete": self._delete}[kind]
                entries[name] = apply(target, entries[name], what, more)
            return manifest | {"collections": entries}

        self.engine.commit(change)
        for kind, target, what, _ in self._steps:
            self.engine.log(kind, target.name, what.describe() if kind == "delete" else kind, what.shape if kind == "delete" else kind, time.perf_counter() - begin)
        return self.deleted

    def _put(self, target: Collection, entry: dict, rows, only_new: bool) -> dict:
        store, schema, key = self.engine.store, target.schema, target.schema.key
        batch = target.to_frame(rows).withColumn("__n", F.monotonically_increasing_id())
        # The last row of a key: a hash aggregate with map-side combine, no window.
        packed = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])
        new = batch.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max_by(packed, F.col("__n")).alias("r")).select("r.*")
        # Generated keys and errors must not be evaluated twice: the batch becomes a table first.
        staged = store.write(new, schema, entry["count"])
        if not staged:
            return entry
        new = store.read(schema, {"buckets": staged})
        shared = [int(b) for b in staged if b in entry["buckets"]]
        if not shared:
            return entry | {"buckets": entry["buckets"] | staged}
        old = store.read(schema, entry, shared)
        if only_new and old.join(new.select(key), key, "left_semi").limit(1).count():
            raise ConditionFailed(f"{target.name}: the key exists")
        kept = old.join(new.select(key), key, "left_anti")
        merged = store.write(kept.unionByName(new.filter(store.bucket(schema, entry["count"]).isin(shared))), schema, entry["count"])
        return entry | {"buckets": entry["buckets"] | staged | merged}

    def _update(self, target: Collection, entry: dict, row: dict, query: Q.Query) -> dict:
        schema = target.schema
        value = {k.lower(): v for k, v in row.items()}[schema.key.lower()]
        near = self.engine.store.buckets_of(target._key_frame([value]), schema, entry["count"])
        rows = self.engine.store.read(schema, entry, near).filter(F.col(f"`{schema.key}`") == literal(value, schema.fields[0].type))
        found = rows.limit(1).collect()
        if not found:
            raise ConditionFailed(f"{target.name}: no row has the key {value!r}")
        condition = where(query, schema)
        if condition is not None and not rows.filter(condition).limit(1).count():
            raise ConditionFailed(f"{target.name}: the stored row fails {query.where_sql()}")
        return self._put(target, entry, [row], False)

    def _delete(self, target: Collection, entry: dict, query: Q.Query, _) -> dict:
        store, schema = self.engine.store, target.schema
        condition = where(query, schema)
        if condition is None:
            self.deleted += store.read(schema, entry).count()
            return entry | {"buckets": {}}
        only = self._keys_asked(query, schema)
        buckets = None if only is None else store.buckets_of(target._key_frame(only), schema, entry["count"])
        rows = store.read(schema, entry, buckets)
        touched = [r[0] for r in rows.filter(condition).select(store.bucket(schema, entry["count"]).alias("b")).distinct().collect()]
        if not touched:
            return entry
        rows = store.read(schema, entry, touched)
        kept = store.write(rows.filter(~F.coalesce(condition, F.lit(False))), schema, entry["count"])
        self.deleted += rows.filter(condition).count()
        rest = {b: p for b, p in entry["buckets"].items() if int(b) not in touched}
        return entry | {"buckets": rest | kept}

    @staticmethod
    def _keys_asked(query: Q.Query, schema: CollectionSchema) -> list | None:
        """The keys that the condition names, if every branch names some."""
        keys: list = []
        for branch in query.branches:
            named = [a for a in branch if a.column == schema.key and a.op in (Q.EQ, Q.IN) and None not in a.values]
            if not named:
                return None
            keys += named[0].values
        return keys


__all__ = ["Collection", "Engine", "Transaction", "matches"]
