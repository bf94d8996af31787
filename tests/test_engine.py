import datetime as dt
import json
import uuid

import pytest

from lodestrata.cli import execute
from lodestrata.engine import Collection, Engine
from lodestrata.errors import BindError, ConditionFailed, IncompleteData, ParseError, ReadOnly, WriteConflict
from lodestrata.operators import eviction
from lodestrata.plans.builder import field
from lodestrata.schema import define
from lodestrata.sources.documents import stream
from lodestrata.streaming.ingest import upsert_stream

HOMES = define("homes").primary_key("id").value("town", index="dictionary").value("rooms", "int", "ordered").value("price", "decimal(18,2)").value("used", "timestamp").collection("days", "date").value("address").full_text("address", "town").build()
ACCOUNTS = define("accounts").primary_key("id").value("balance", "int").value("Timestamp", "timestamp").build()


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db", buckets=3)


@pytest.fixture
def homes(engine):
    c = engine.declare(HOMES)
    c.put_many([{"id": k, "town": ["Paris", "Nice", None][k % 3], "rooms": k % 5, "address": f"rue {k} du chien", "days": [dt.date(2024, 5, k % 9 + 1)]} for k in range(30)])
    return c


def test_put_get_update(engine, homes):
    assert homes.frame().count() == 30 and homes[4]["town"] == "Nice" and homes[99] is None
    homes.put_many([{"id": 4, "town": "Rome"}, {"id": 4, "town": "Oslo"}, {"ID": 77, "TOWN": "Bern"}])
    assert homes[4]["town"] == "Oslo" and homes[4]["rooms"] is None and homes[77]["town"] == "Bern" and homes.frame().count() == 31
    assert not homes.try_add({"id": 4, "town": "x"}) and homes.try_add({"id": 78}) and homes[4]["town"] == "Oslo"
    with pytest.raises(Exception, match="id is null"):
        homes.put({"town": "x"})
    assert engine.sql("select id, town from HOMES where town = Bern").collect()[0].asDict() == {"id": 77, "town": "Bern"}
    assert json.loads("".join(stream(engine.sql("select id from homes where id in (4, 77) order by id")))) == [{"id": 4}, {"id": 77}]


def test_conditions(homes):
    homes.update_if({**homes[3], "rooms": 9}, field("town") == "Paris")
    with pytest.raises(ConditionFailed):
        homes.update_if({**homes[3], "rooms": 10}, field("rooms") == 1)
    with pytest.raises(ConditionFailed):
        homes.update_if({"id": 1000}, field("rooms") == 1)
    assert homes[3]["rooms"] == 9


def test_timestamp(engine):
    a = engine.declare(ACCOUNTS)
    a.put({"id": 1, "balance": 5, "Timestamp": dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)})
    read = {**a[1], "Timestamp": a[1]["Timestamp"].replace(tzinfo=dt.timezone.utc)}
    a.update_with_timestamp({**read, "balance": 6})
    with pytest.raises(ConditionFailed):
        a.update_with_timestamp({**read, "balance": 7})
    assert a[1]["balance"] == 6


def test_delete(engine, homes):
    assert homes.delete(5) and not homes.delete(5)
    assert homes.delete_many(field("town").is_null() & (field("rooms") < 2)) == len([k for k in range(30) if k % 3 == 2 and k % 5 < 2 and k != 5])
    left = homes.frame().count()
    assert engine.sql("delete from homes where rooms > 3 take 1").first()[0] == len([k for k in range(30) if k % 5 > 3 and not (k % 3 == 2 and k % 5 < 2)])
    assert homes.frame().filter("rooms > 3").count() == 0 and homes.frame().count() < left
    assert homes.truncate() > 0 and homes.frame().count() == 0 and homes.schema == HOMES


def test_transactions_and_consistent_read(engine):
    a, b = engine.declare(ACCOUNTS), engine.declare(define("moves").primary_key("id", "string").value("amount", "int").build())
    a.put_many([{"id": k, "balance": 100} for k in (1, 2)])
    t = engine.transaction()
    t.put(a, {"id": 1, "balance": 90})
    t.put(a, {"id": 2, "balance": 110})
    t.put(b, {"amount": 10})
    with engine.consistent_read("accounts", "moves") as (pinned, moves):
        t.commit()
        assert {r["id"]: r["balance"] for r in pinned.frame().collect()} == {1: 100, 2: 100} and moves.frame().count() == 0
    assert {r["id"]: r["balance"] for r in a.frame().collect()} == {1: 90, 2: 110}
    assert len(b.frame().first()["id"]) == 36
    t = engine.transaction()
    t.put(b, {"id": "x", "amount": 1})
    t.update_if(a, {"id": 1, "balance": 0}, field("balance") > 95)
    version = engine.store.latest()
    with pytest.raises(ConditionFailed):
        t.commit()
    assert engine.store.latest() == version and b.frame().count() == 1
    with pytest.raises(ZeroDivisionError):
        with engine.consistent_read("accounts"):
            1 / 0


def test_conflicting_writers_do_not_lose_updates(engine):
    a = engine.declare(ACCOUNTS)
    a.put({"id": 1, "balance": 1})
    base = engine.store.manifest()
    other = Engine(engine.spark, engine.store.root, buckets=3)
    other.collection("accounts").put({"id": 2, "balance": 2})
    with pytest.raises(WriteConflict):
        engine.store.publish(base, base["version"])
    calls = []

    def change(m):
        if not calls:
            other.collection("accounts").put({"id": 3, "balance": 3})
        calls.append(m["version"])
        return m | {"counters": {"x": 1}}

    engine.commit(change)
    assert len(calls) == 2 and a.frame().count() == 3
    assert list(engine.unique_ids("n", 3)) == [1, 2, 3] and list(other.unique_ids("n")) == [4]


def test_catalog(engine, homes):
    with pytest.raises(BindError):
        engine.declare(define("homes").primary_key("id").value("town").build())
    other = Engine(engine.spark, engine.store.root)
    grown = other.declare(define("homes").primary_key("id").value("town", index="dictionary").value("rooms", "long", "ordered").value("extra").full_text("town").build())
    assert grown.frame().count() == 30 and grown[4]["extra"] is None and grown[4]["rooms"] == 4
    engine.read_only()
    with pytest.raises(ReadOnly):
        homes.put({"id": 1})
    engine.read_only(False)
    assert engine.collections() == ["homes"]
    engine.drop("homes")
    with pytest.raises(BindError):
        engine.collection("homes")


def test_dump_restore(engine, homes, tmp_path):
    path = f"file://{tmp_path}/dump"
    engine.unique_ids("n", 5)
    engine.dump(path)
    homes.put({"id": 500})
    engine.declare(ACCOUNTS)
    engine.restore(path)
    assert homes.frame().count() == 30 and engine.collections() == ["accounts", "homes"]
    engine.restore(path, recreate=True)
    assert engine.collections() == ["homes"] and list(engine.unique_ids("n")) == [6]
    engine.store.vacuum(keep=1)
    assert homes.frame().count() == 30


def test_completeness(engine, homes):
    ask = homes.where((field("town") == "Paris") & (field("rooms") > 2)).only_if_complete()
    with pytest.raises(IncompleteData):
        ask.frame()
    homes.declare_domain(field("town").isin(["Paris", "Nice"]))
    assert ask.frame().count() == len([k for k in range(30) if k % 3 == 0 and k % 5 > 2])
    with pytest.raises(IncompleteData):
        homes.where(field("rooms") > 2).only_if_complete().frame()
    homes.declare_fully_loaded()
    homes.where(field("rooms") > 2).only_if_complete().frame()
    with pytest.raises(Exception, match="eviction"):
        homes.set_eviction(eviction.LeastRecentlyUsed(10, 5))


def test_evicting(engine):
    a = engine.declare(ACCOUNTS)
    a.put_many([{"id": k, "Timestamp": dt.datetime(2020, 1, 1 + k, tzinfo=dt.timezone.utc)} for k in range(10)])
    assert a.evict("Timestamp") == 0
    a.set_eviction(eviction.LeastRecentlyUsed(10, 7))
    assert a.evict("Timestamp") == 7 and sorted(r["id"] for r in a.frame().collect()) == [7, 8, 9]
    a.set_eviction(eviction.TimeToLive(86400 * 2))
    assert a.evict("Timestamp", dt.datetime(2020, 1, 11, tzinfo=dt.timezone.utc)) == 2


def test_search_follows_writes(homes):
    assert [r["id"] for r in homes.search("rue 17 chien").collect()][0] == 17
    homes.put({"id": 17, "address": "somewhere else"})
    assert 17 not in [r["id"] for r in homes.search("rue 17", take=5).collect()] and homes.search("somewhere").first()["id"] == 17
    homes.delete(17)
    assert homes.search("somewhere").count() == 0
    with pytest.raises(BindError):
        homes.engine.declare(ACCOUNTS).search("x")


def test_log(engine, homes):
    homes.rows(homes.parse("select from homes where town = Paris and rooms in (1, 2)"))
    engine.sql("count from homes").collect()
    top = engine.last(2).collect()
    assert top[0]["type"] == "count" and top[1]["shape"].endswith("where town = ? and rooms in (?)") and top[1]["microseconds"] > 0
    assert engine.logged(top[0]["id"])["collection"] == "homes" and engine.longest(1).count() == 1
    assert engine.sql("select type from @ACTIVITY where collection = homes and type = count").count() == 1


def test_profile_and_stop_words(engine, homes):
    found = homes.profile(homes.parse("select id from homes where rooms = 2"))
    assert found["rows"] == 6 and found["execution"] > 0 and "Filter" in found["plan"]
    assert engine.last(1).first()["plan"].endswith("6 rows")
    quiet = Engine(engine.spark, engine.store.root, tokens_to_ignore=["chien"]).collection("homes")
    assert quiet.search("chien").count() == 0 and homes.search("chien").count() == 10
    assert homes.index().search("chien", most_entries=1).count() == 0
    assert Engine(engine.spark, engine.store.root, most_entries=1).collection("homes").search("chien").count() == 0


def test_log_forgets_nothing(spark, monkeypatch):
    from lodestrata import engine as module

    monkeypatch.setattr(module, "LOG_ROWS", 10)
    e = Engine(spark)
    for k in range(37):
        e.log("select", "homes", f"{k} " + "x" * 9000, "shape", k / 1e6)
    rows = e.activity.collect()
    assert sorted(int(r["query"].split()[0]) for r in rows) == list(range(37)) and all(len(r["query"]) > 9000 for r in rows)
    assert e.longest(1).first()["microseconds"] == 36 and all(e.logged(r["id"])["query"] == r["query"] for r in rows[:3])


def test_another_number_of_buckets(engine, homes):
    before = sorted(map(str, homes.frame().collect()))
    engine.rebucket("homes", 3)
    assert homes.entry["count"] == 3 and len(homes.entry["buckets"]) <= 3 and sorted(map(str, homes.frame().collect())) == before
    homes.put({"id": 17, "address": "moved"})
    homes.delete(3)
    assert homes[17]["address"] == "moved" and homes[3] is None and homes.frame().count() == len(before) - 1
    with pytest.raises(BindError):
        engine.rebucket("nothing", 3)


def test_drop_database(engine, homes):
    engine.unique_ids("n", 4)
    engine.drop_database()
    assert engine.collections() == [] and list(engine.unique_ids("n")) == [1]


def test_feeds(engine, homes, spark, tmp_path):
    with homes.feed() as rows:
        rows.append({"id": 100})
        rows.append(spark.createDataFrame([(101, "Rome")], "id int, town string"))
    assert homes[101]["town"] == "Rome" and homes[100] is not None
    with pytest.raises(ZeroDivisionError):
        with homes.feed() as rows:
            rows.append({"id": 102})
            1 / 0
    assert homes[102] is None
    homes.feed_json(['{"id": 103, "town": "Bern", "days": ["2024-01-01"]}', '{"town": "no key"}'])
    assert homes[103]["days"] == [dt.date(2024, 1, 1)] and homes[0]["town"] == "no key"
    (tmp_path / "a.json").write_text('[{"id": 104, "town": "A"}, {"id": 105}]')
    homes.import_json(str(tmp_path / "a.json"))
    assert homes[104]["town"] == "A"
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,y\n")
    deals = Collection.feed_csv_with_automatic_schema(engine, str(tmp_path / "f.csv"), "deals")
    assert engine.sql("select from deals where a = 2").first()["b"] == "y" and deals.frame().count() == 2


def test_stream(engine, homes, spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([('{"id": 200, "town": "S"}',), ('{"id": 4, "town": "T"}',)], "value string").coalesce(1).write.text(str(source))
    q = upsert_stream(homes, spark.readStream.text(str(source)), str(tmp_path / "cp"), "value")
    q.awaitTermination(120)
    assert homes[200]["town"] == "S" and homes[4]["town"] == "T" and homes.frame().count() == 31


def test_console(engine, homes, tmp_path):
    assert execute(engine, "count from homes where town = Paris") == ['{"count":10}']
    assert execute(engine, "desc") == ["homes"] and execute(engine, "desc homes")[0] == "id int primary"
    assert len(execute(engine, "search homes rue 17")) > 0 and len(execute(engine, "last 1")) == 1
    out = tmp_path / "o.json"
    execute(engine, f"select id from homes where id < 2 order by id into {out}")
    assert json.loads(out.read_text()) == [{"id": 0}, {"id": 1}]
    assert "Physical Plan" in execute(engine, "explain select from homes where id = 1")[0]
    with pytest.raises(ParseError):
        execute(engine, "jump")


def test_views_are_read_only(spark):
    c = Engine(spark).attach("v", spark.createDataFrame([(1, "a")], "id int, s string"), "id")
    assert c[1]["s"] == "a" and c.where(field("s") == "a").count() == 1 and c.query().order_by("id").first()["id"] == 1
    with pytest.raises(ReadOnly):
        c.put({"id": 2})
    assert uuid.uuid4()
