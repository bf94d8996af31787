"""A console for an engine: statements of the dialect and a few verbs.

    python -m lodestrata.cli FOLDER [statement ...]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Collection, Engine
from .errors import EngineError, ParseError

HELP = """select ..., count ..., delete ..., explain select ...   statements
search COLLECTION text          the ten best documents
desc [COLLECTION]               collections, or a collection's fields
last [n], longest [n]           from the log
import COLLECTION FILE          a JSON array
csv COLLECTION FILE             a CSV file with an inferred schema
dump FOLDER, restore FOLDER, recreate FOLDER
truncate COLLECTION, drop COLLECTION, drop database
readonly, readwrite, help, exit"""


def execute(engine: Engine, line: str) -> list[str]:
    """Output lines of one command."""
    verb, _, rest = line.strip().partition(" ")
    verb, rest = verb.lower(), rest.strip()
    if verb in ("select", "count", "delete", "explain"):
        return list(engine.sql_json(line))
    if verb == "search":
        name, _, text = rest.partition(" ")
        target = engine.collection(name)
        from .sources.documents import as_json

        return [r[0] for r in as_json(target.search(text, 10)).collect()]
    if verb == "desc":
        if not rest:
            return engine.collections()
        return [" ".join(x) for x in engine.collection(rest).schema.describe()]
    if verb in ("last", "longest"):
        rows = getattr(engine, verb)(int(rest or 10)).collect()
        return [f"{r['id']} {r['timestamp']} {r['type']} {r['collection']} {r['microseconds']} us {r['query']}" for r in rows]
    if verb in ("import", "csv"):
        name, _, path = rest.partition(" ")
        if verb == "import":
            engine.collection(name).import_json(path)
        else:
            Collection.feed_csv_with_automatic_schema(engine, path, name)
        return ["done"]
    if verb == "truncate":
        return [f"{engine.collection(rest).truncate()} rows deleted"]
    if verb == "drop":
        engine.drop_database() if rest.lower() == "database" else engine.drop(rest)
        return ["done"]
    if verb in ("dump", "restore", "recreate"):
        engine.dump(rest) if verb == "dump" else engine.restore(rest, verb == "recreate")
        return ["done"]
    if verb in ("readonly", "readwrite"):
        engine.read_only(verb == "readonly")
        return ["done"]
    if verb == "help":
        return HELP.splitlines()
    raise ParseError(f"unknown command {verb!r}; try help")


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    engine = Engine(spark, args[0])
    lines = iter([" ".join(args[1:])] if args[1:] else sys.stdin)
    for line in lines:
        if line.strip().lower() in ("exit", "quit", "stop"):
            break
        if not line.strip():
            continue
        try:
            print("\n".join(execute(engine, line)), flush=True)
        except EngineError as error:
            print(f"error: {error}", file=sys.stderr, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
