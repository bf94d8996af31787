import datetime as dt
import math
import random
from decimal import Decimal

import pytest

from lodestrata.engine import Engine
from lodestrata.errors import BindError, EngineError
from lodestrata.functions import text as X
from lodestrata.operators import eviction, metadata, pivot
from lodestrata.operators import fulltext, packing
from lodestrata.operators.fulltext import Index, bonus, lines, scan
from lodestrata.plans.builder import field
from lodestrata.schema import define, of_frame
from lodestrata.sources import csv


# -- pivot


@pytest.fixture(scope="module")
def orders(spark):
    cats = ["sf", "science", "geek", "geek", "geek"]
    return spark.createDataFrame([(i, cats[i % 5], 1000 + i % 10, 10.15, 2) for i in range(2000)], "id int, category string, product int, amount double, quantity int")


def test_pivot_tree(orders):
    schema = of_frame("orders", orders.schema, "id")
    root = pivot.tree(pivot.pivot(orders, schema, ["category", "product"], ["amount", "quantity"]))
    assert root.count == 2000 and root.sums == {"amount": Decimal("20300"), "quantity": Decimal(4000)}
    assert sorted(root.children) == ["geek", "science", "sf"] and root.children["geek"].count == 1200
    root.check()
    text = str(root).splitlines()
    assert text[0] == "total: count = 2000, amount = 20300, quantity = 4000" and text[1].startswith("    category = geek") and text[2].startswith("        product = ")
    other = pivot.tree(pivot.pivot(orders.filter("id < 100"), schema, ["category", "product"], ["amount", "quantity"]))
    other.merge(pivot.tree(pivot.pivot(orders.filter("id >= 100"), schema, ["category", "product"], ["amount", "quantity"])))
    assert other == root
    root.children["sf"].count += 1
    with pytest.raises(EngineError):
        root.check()


def test_pivot_rules(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "a", 1.0), (3, None, 2.0)], "id int, k string, v double")
    schema = of_frame("t", df.schema, "id")
    rows = {(r["level"], r["k"]): r["sum_v"] for r in pivot.pivot(df, schema, ["k"], ["v"]).collect()}
    assert rows == {(0, None): 8, (1, None): 7, (1, "a"): 1}
    for axes, values in (([], []), (["k"], ["k"]), (["none"], ["v"])):
        with pytest.raises(BindError):
            pivot.pivot(df, schema, axes, values)
    broken = df.union(spark.createDataFrame([(4, "a", None)], df.schema))
    with pytest.raises(Exception, match="v is null"):
        pivot.pivot(broken, schema, ["k"], ["v"]).collect()
    assert pivot.pivot(df.limit(0), schema, [], ["v"]).first()["count"] == 0


# -- full text


@pytest.mark.parametrize("line,tokens", [("some PascalCase and #camelCase", ["some", "pascal", "case", "and", "#", "camel", "case"]), ("ABc", ["abc"]), ("12ab", ["12", "ab"]), ("c++", ["c", "+"]), ("commerce 2000", ["comerce", "20"]), ("Éòñç ÜBER", ["eonc", "uber"])])
def test_tokens(spark, line, tokens):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "t string").select(X.tokens(F.col("t"))).first()[0] == tokens
    assert [X.normalize_text(t) for t in X.split_text(line)] == tokens


def at(line):
    out = {}
    for k, t in enumerate(X.normalize_text(t) for t in X.split_text(line)):
        out.setdefault(t, k)
    return out


def factor(query, line):
    return bonus([X.normalize_text(t) for t in X.split_text(query)], at(line))


def test_bonus_for_order():
    assert factor("a b c", "b c a") > factor("a b c", "c b a") == 1
    assert factor("nice evening", "nice evening") == factor("nice evening", "it was a nice evening") > 1
    assert factor("nice evening", "nice and happy evening") > factor("nice and happy evening", "nice evening") > 1
    assert factor("nice view close beach", "nice view and close to the beach") > 30
    assert factor("c++", "c++") > 1 and factor("c++", "+c") == 1


def brute(docs, query):
    """The recipe, word for word."""
    q = [X.normalize_text(t) for t in X.split_text(query)]
    posts = {(t, k, n) for k, lines in docs.items() for n, line in enumerate(lines) for t in at(line)}
    df = {}
    for t, _, _ in posts:
        df[t] = df.get(t, 0) + 1
    known = [t for t in dict.fromkeys(q) if not X.is_symbol(t) and t in df]
    scores = {}
    for k, lines in docs.items():
        total, found = 0.0, set()
        for line in lines:
            has = [t for t in known if t in at(line)]
            if has:
                s = sum(math.log10(len(posts) / df[t]) for t in has) * (100 * len(has) if len(has) > 1 else 1)
                total += s * bonus(q, at(line))
                found |= set(has)
        if found:
            scores[k] = (total * len(found), len(found))
    best = max((s for s, _ in scores.values()), default=0)
    return {k: v for k, v in scores.items() if v[0] >= best / 20}


@pytest.mark.parametrize("seed", range(3))
def test_search_against_the_recipe(spark, seed, tmp_path):
    r = random.Random(seed)
    words = ["nice", "view", "Metro", "close", "beach", "ps4", "c++", "Évian", "rue"]
    docs = {k: [" ".join(r.choice(words) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 3))] for k in range(40)}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "id int, texts array<string>")
    index = Index.of(df, of_frame("d", df.schema, "id", ("texts",)))
    for query in ("nice view", "close metro", "ps4", "beach, close + view", "evian", "c++ nothing", "nothing"):
        got = {x["key"]: (x["score"], x["tokens"]) for x in index.search(query).collect()}
        expected = brute(docs, query)
        scanned = {x["key"]: (x["score"], x["tokens"]) for x in scan(lines(df, of_frame("d", df.schema, "id", ("texts",))), query, str(tmp_path / str(hash(query)))).collect()}
        assert scanned.keys() == got.keys() and all(math.isclose(scanned[k][0], got[k][0], rel_tol=1e-9) and scanned[k][1] == got[k][1] for k in got)
        assert got.keys() == expected.keys() and all(math.isclose(got[k][0], expected[k][0], rel_tol=1e-9) and got[k][1] == expected[k][1] for k in got), query
    assert index.search("nice", stop=["nice"]).count() == 0
    assert index.stops(0) == ([], index.entries()) == index.stops(index.entries())
    # The stop-token rule: while too many postings are left the token in most lines goes, so many at most.
    counts = sorted(((-x["df"], x["token"]) for x in fulltext.frequencies(index.posted).collect()))
    total = index.entries()
    for most_entries, most_ignored in ((total - 1, 5), (total // 2, 100), (1, 3))[seed : seed + 1]:
        dropped, left = [], total
        for n, token in counts:
            if left <= most_entries or len(dropped) == most_ignored:
                break
            dropped.append(token)
            left += n
        assert index.stops(most_entries, most_ignored) == (dropped, left)
        kept = [w for w in ("nice", "view") if w not in dropped]
        rule = {"most_entries": most_entries, "most_ignored": most_ignored}
        lined = lines(df, of_frame("d", df.schema, "id", ("texts",)))
        ranked = lambda found: sorted((x["key"], round(x["score"], 9), x["tokens"]) for x in found.collect())
        by_rule = ranked(index.search("nice view", **rule))
        assert by_rule == ranked(index.search("nice view", stop=dropped, entries=left)) == ranked(scan(lined, "nice view", str(tmp_path / f"{most_entries}-{most_ignored}"), **rule))
        assert bool(by_rule) == bool(kept)


@pytest.mark.parametrize("squeeze", [True, False])
def test_packed_postings_are_the_same(spark, squeeze):
    r = random.Random(5)
    some = [*"aAbBßẞΣσςΑάЖ İıIiéÉñǅʰª٣37 \t\n\u0085\u3000.,;'·-_\u0301\u0345\u20d0𐐀𐐨😀\x00", *"Σ" * 6, *" " * 6]
    texts = ["".join(r.choices(some, k=r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(map(chr, r.choices([*range(0xD800), *range(0xE000, 0x40000), 0x10FFFF], k=50))) for _ in range(300)] + ["", " ", "the " * 3000]
    lined = spark.createDataFrame([(f"k{k // 2}", k % 2, t) for k, t in enumerate(texts)], "key string, line int, text string").repartition(3)
    expected = sorted(map(tuple, fulltext.postings(lined, squeeze).collect()))
    for sizes in ((packing.PIECE, packing.RUN, packing.LIST, packing.BATCH), (2000, 3000, 5, 500)):
        packed = packing.pack(lined, squeeze, sizes)
        assert sorted(map(tuple, packing.unpack(packed).collect())) == expected
        assert packed.agg({"n": "sum"}).first()[0] == len(expected)
    assert packed.filter("n > 5 or n <> size(key)").count() == 0


def test_a_stored_index_is_of_lists(spark, tmp_path):
    r = random.Random(6)
    df = spark.createDataFrame([(k, " ".join(r.choices(["nice", "view", "metro", "close", "Zug"], k=30))) for k in range(600)], "id int, text string")
    schema = of_frame("d", df.schema, "id", ("text",))
    engine = Engine(spark, str(tmp_path))
    stored = engine.declare(schema)
    stored.put_many(df)
    index, plain = stored.index(), Index.of(df, schema)
    assert index.entries() == plain.entries() and sorted(index.posted.collect()) == sorted(plain.posted.collect())
    for query in ("nice view", "zug", "nothing"):
        assert [(x["key"], x["tokens"]) for x in index.search(query).collect()] == [(x["key"], x["tokens"]) for x in plain.search(query).collect()]
    assert index.stops(1000, 2) == plain.stops(1000, 2)
    # A posting is no row: it is neither shuffled nor sorted as one.
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "text")).count() * 10 < plain.entries()
    assert "Exchange" not in packing.pack(lines(df, schema))._jdf.queryExecution().executedPlan().toString()


def test_texts_inside_documents(spark):
    schema = define("homes").primary_key("id").value("town").document("comments", "array<struct<user:string,text:string,date:string>>").full_text("town", "comments").build()
    df = spark.createDataFrame([(1, "Paris", [("ann", "nice view", "2020-01-02")]), (2, None, None), (3, "Rome", [])], "id int, town string, comments array<struct<user:string,text:string,date:string>>")
    index = Index.of(df, schema)
    assert [r["key"] for r in index.search("view").collect()] == [1]
    assert index.search("2020").count() == 0 and index.search("rome").first()["key"] == 3


# -- eviction, metadata


def test_eviction(spark):
    df = spark.createDataFrame([(k, dt.datetime(2020, 1, 1) + dt.timedelta(hours=k // 2), k == 0) for k in range(20)] + [(20, None, False)], "id int, used timestamp, keep boolean")
    assert eviction.LeastRecentlyUsed(30, 5).survivors(df, "used", "id").count() == 21
    kept = sorted(r["id"] for r in eviction.LeastRecentlyUsed(21, 18).survivors(df, "used", "id").collect())
    assert kept == [17, 18, 19]
    kept = sorted(r["id"] for r in eviction.LeastRecentlyUsed(20, 18).survivors(df, "used", "id", "keep").collect())
    assert kept == [0, 18, 19]
    kept = sorted(r["id"] for r in eviction.TimeToLive(7200).survivors(df, "used", dt.datetime(2020, 1, 1, 9, tzinfo=dt.timezone.utc), "keep").collect())
    assert kept == [0, 16, 17, 18, 19]
    with pytest.raises(EngineError):
        eviction.check_exclusive(object(), None, True)


def test_metadata_and_forms(spark):
    df = spark.createDataFrame([(1, "a", True, ["x"]), (2, None, False, ["y", "x"])], "id int, s string, b boolean, c array<string>")
    schema = of_frame("t", df.schema, "id")
    found = {m["name"]: m for m in metadata.describe(df, schema)}
    assert found["s"]["values"] == [None, "a"] and found["c"]["values"] == ["x", "y"] and found["b"]["type"] == "boolean"
    assert metadata.describe(df, schema, most=1)[0]["values"] == []
    sql = metadata.form_to_sql("t", [{"column": "s", "operator": "starts with", "values": ["a'"]}, {"column": "id", "operator": "in", "values": [1, 2]}, {"column": "b", "operator": "is null"}], "id", True, 5)
    assert sql == "select from t where s like 'a\\'%' and id in (1, 2) and b = null order by id descending take 5"
    Engine(spark).attach("t", df, "id").parse(sql)


# -- csv


def test_csv_lines():
    assert csv.split_line('1,"a,b",,x', ",") == ["1", "a,b", "", "x"]
    assert [csv.detect_separator(h) for h in ("a,b;c", "a;b\tc", "a\tb")] == [",", ";", "\t"]
    assert csv.column_name(" deal id  number ") == "dealIdNumber"
    assert [csv.type_of(x) for x in ("1", "1.5", "x", "", "2020-01-02", "true", "nan")] == ["int", "float", "string", "null", "date", "bool", "string"]
    assert csv.wider("int", "float") == "float" and csv.wider("null", "int") == "int" and csv.wider("int", "date") == "string"
    with pytest.raises(EngineError):
        csv.infer_lines(["a,b", "1,2", "1"])


def test_csv_inference_and_feed(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("deal id,Day,Value,Note\n1,2020-01-02,1.5,\"a, b\"\n2,2020-01-03,2,\n3,,x,c\n4,01/02/2021,3,d\n")
    schema = csv.infer(spark, str(path))
    assert [(c.name, c.type) for c in schema.columns] == [("dealId", "int"), ("Day", "date"), ("Value", "string"), ("Note", "string")]
    schema.columns[2].type = "float"
    rows = csv.read(spark, str(path), schema).collect()
    assert [r["Value"] for r in rows] == [1.5, 2.0, None, 3.0] and rows[3]["Day"] == dt.datetime(2021, 2, 1) and rows[0]["Note"] == "a, b"
    fed = csv.from_lines(spark, ["9,2020-01-02,7"], schema).first()
    assert fed["dealId"] == 9 and fed["Note"] is None
    assert schema.to_collection("deals").key == "@id" and "lines a value" in schema.report()


def test_discriminant_pair(spark):
    lines = ["a,b,c"] + [f"{k % 4},{k // 4},{k % 2}" for k in range(16)]
    assert csv.infer_lines(lines).discriminant == ["a", "b"]
    df = spark.createDataFrame([(k % 4, k // 4, k % 2) for k in range(16)], "a int, b int, c int")
    assert csv.discriminant_in(df, ["a", "b", "c"]).first()["columns"] == "a+b"


def test_condition_on_full_text(spark):
    df = spark.createDataFrame([(1, "nice view", 5), (2, "nice view metro", 50), (3, "nothing", 60)], "id int, t string, p int")
    c = Engine(spark).attach("h", df, "id", ("t",))
    assert [r["id"] for r in c.where(field("p") > 10).full_text("nice view").rows()] == [2]
    assert c.where(field("p") > 10).full_text("nice view").count() == 1


# -- JSON


def test_every_order_becomes_json(spark):
    import duckdb

    from lodestrata.queries import ORACLE, QUERIES

    folder = "/root/testdata/sf0.001"
    got = sorted(r["json"] for r in QUERIES["q32_to_json_all"](spark, folder).collect())
    sql = ORACLE["q32_to_json_all"].replace("FROM orders", f"FROM '{folder}/orders.parquet'")
    assert len(got) == spark.read.parquet(f"{folder}/orders.parquet").count() and got == sorted(r[0] for r in duckdb.sql(sql).fetchall())


def test_csv_folder_of_several_files(spark, tmp_path):
    """Every file has the header; none of them is taken for data."""
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("first long column,second\n" + "".join(f"{k * 10 + j},{j / 4}\n" for j in range(5)))
    schema = csv.infer(spark, str(tmp_path))
    assert [(c.name, c.type) for c in schema.columns] == [("firstLongColumn", "int"), ("second", "float")]
    assert csv.read(spark, str(tmp_path), schema).count() == 15


def test_lru_cut_in_a_range_partitioning(spark):
    r = random.Random(5)
    rows = [(k, r.choice([None, *range(20)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, t int").repartition(5)
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]), reverse=True)
    for limit, remove in ((400, 1), (400, 100), (300, 250), (400, 399), (100, 100)):
        kept = eviction.LeastRecentlyUsed(limit, remove).survivors(df, "t", "k").collect()
        assert sorted(r["k"] for r in kept) == sorted(k for k, _ in order[: max(0, limit - remove)])
