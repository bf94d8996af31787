import datetime as dt

import pytest
from pyspark.sql import types as T

from lodestrata.errors import BindError, ParseError
from lodestrata.functions.values import bind, guess, parse_date
from lodestrata.plans import query as Q
from lodestrata.plans.query import fuse
from lodestrata.plans.sql import parse, tokenize
from lodestrata.schema import REINDEX, REPACK, OK, CollectionSchema, compatibility, define

SCHEMA = define("things").primary_key("id").value("a").value("x", "double", "ordered").value("age", "int", "ordered").value("date", "timestamp").value("flag", "bool").collection("tags").collection("clients", "int").value("big", "long").build()


@pytest.mark.parametrize("text,value", [("123", 123), ("123,1", 123.1), ("123.1", 123.1), ("2012-05-01", dt.datetime(2012, 5, 1)), ("01/05/2012", dt.datetime(2012, 5, 1)), ("45/15/2012", "45/15/2012"), ("true", True), ("false", False), ("null", None), ("abc", "abc"), ("'12'", "12"), ("-5", -5), ("12x", "12x"), ("9999999999", 9999999999)])
def test_guess(text, value):
    assert guess(text) == value


def test_dates():
    assert parse_date("2023-01-02 03:04") == dt.datetime(2023, 1, 2, 3, 4)
    assert parse_date("2023-01-02T03:04:05+02:00") == dt.datetime(2023, 1, 2, 1, 4, 5)
    assert parse_date("3/20/2017", us=True) == dt.datetime(2017, 3, 20)
    assert parse_date("3/20/2017") is None
    assert parse_date("20-03-2017") == dt.datetime(2017, 3, 20)


def test_bind_by_column():
    assert bind("'2023-04-23'", T.TimestampType()) == dt.datetime(2023, 4, 23, tzinfo=dt.timezone.utc)
    assert bind("5000000000", T.LongType()) == 5000000000
    assert bind("1,5", T.DoubleType()) == 1.5
    assert bind("1,5", T.StringType()) == "1,5"
    assert bind("'null'", T.StringType()) == "null" and bind("null", T.StringType()) is None
    with pytest.raises(BindError):
        bind("abc", T.IntegerType())
    with pytest.raises(BindError):
        bind("1,2,3", T.DoubleType())


@pytest.mark.parametrize("text,tokens", [("like '%john%'", ["like", "'%john%'"]), ("a<>'%john%'", ["a", "<>", "'%john%'"]), (" 'john' and jane", ["'john'", "and", "jane"]), (" name = '' ", ["name", "=", "''"])])
def test_tokens(text, tokens):
    assert [str(t) for t in tokenize(text)] == tokens


def atoms(sql):
    return [a for b in parse(sql, SCHEMA).branches for a in b]


@pytest.mark.parametrize(
    "where,expected",
    [
        ("a== b", ("a", Q.EQ, ("b",))),
        ("a = 'select b from c'", ("a", Q.EQ, ("select b from c",))),
        ("a = 'rue d\\'Antin'", ("a", Q.EQ, ("rue d'Antin",))),
        ("a = rue de la paix", ("a", Q.EQ, ("rue de la paix",))),
        ("x >= 0,5", ("x", Q.GE, (0.5,))),
        ("15 > age", ("age", Q.LT, (15,))),
        ("5 <> age", ("age", Q.NE, (5,))),
        ("age in (1, 2, 3)", ("age", Q.IN, (1, 2, 3))),
        ("a in 'geek', 'games'", ("a", Q.IN, ("geek", "games"))),
        ("age not  in (1, 2)", ("age", Q.NOT_IN, (1, 2))),
        ("tags contains geek", ("tags", Q.CONTAINS, ("geek",))),
        ("clients not contains 156", ("clients", Q.NOT_CONTAINS, (156,))),
        ("a like john% ", ("a", Q.STARTS, ("john",))),
        ("a like %john ", ("a", Q.ENDS, ("john",))),
        ("a like '%jo_hn%' ", ("a", Q.HOLDS, ("jo_hn",))),
        ("flag = true", ("flag", Q.EQ, (True,))),
        ("a = null", ("a", Q.EQ, (None,))),
        ("BIG = 5000000000", ("big", Q.EQ, (5000000000,))),
        ("date = '2012-01-31'", ("date", Q.EQ, (dt.datetime(2012, 1, 31, tzinfo=dt.timezone.utc),))),
    ],
)
def test_comparisons(where, expected):
    (a,) = atoms(f"SELECT FROM Things WHERE {where}")
    assert (a.column, a.op, a.values) == expected


def test_and_binds_tighter():
    q = parse("select * from things where a<>'ttt' or x < 1.22 and x >= 0,5 or age > 18 take 1", SCHEMA)
    assert [len(b) for b in q.branches] == [1, 2, 1] and q.take == 1
    assert fuse(q).branches[1] == (Q.Atom("x", Q.GE_LT, (0.5, 1.22)),)


def test_fuse_keeps_every_other_test():
    q = parse("select from things where x > 1 and x < 9 and x <> 5 and x in (2, 3)", SCHEMA)
    assert [a.op for a in fuse(q).branches[0]] == [Q.GT_LT, Q.NE, Q.IN]
    q = parse("select from things where x > 1 and x > 2 and x < 9", SCHEMA)
    assert len(fuse(q).branches[0]) == 3


def test_clauses():
    q = parse("select fx_a, a other from things order by age descending skip 2 take 10 into out.json".replace("fx_a", "x"), SCHEMA)
    assert (q.select, q.order_by, q.descending, q.skip, q.take, q.into) == ((("x", "x"), ("a", "other")), "age", True, 2, 10, "out.json")
    assert parse("select from things take 3 order by age", SCHEMA).order_by == "age"
    assert parse("select distinct a, x from things", SCHEMA).distinct
    assert parse("count from things where age > 3", SCHEMA).count
    assert parse("delete from things where age > 3 take 5", SCHEMA).take == 0
    assert parse("explain select from things", SCHEMA).explain


@pytest.mark.parametrize("sql", ["", "update things", "select from", "select from things where x + 1>= 0,5", "select from things where a like john", "select from things where (age = 1)", "select distinct * from things", "select from things order by", "select from things take many", "select from things where age", "select from things where age = 1 = 2", "select from things where nothing = 1", "select nothing from things", "select from things where a = 'open"])
def test_errors(sql):
    with pytest.raises((ParseError, BindError)):
        parse(sql, SCHEMA)


def test_text_form_reads_back():
    for where in ("a = 'x y' and age >= 3 or tags contains 'q\\'s'", "a like '%b%' and age not in (1, 2)", "x > 1.5 and date < 2020-01-01 10:00:00", "a = null and flag <> true"):
        q = parse(f"select from things where {where} order by age take 5", SCHEMA)
        assert parse(q.sql(), SCHEMA) == q
        assert fuse(q).shape.count("?") >= 2


def test_schema_rules():
    assert CollectionSchema.from_json(SCHEMA.to_json()) == SCHEMA
    assert compatibility(SCHEMA, SCHEMA) == OK
    base = define("t").primary_key("id").value("a")
    assert compatibility(base.build(), define("t").primary_key("id").value("a", index="ordered").build()) == REINDEX
    assert compatibility(base.build(), base.value("b").build()) == REPACK
    for broken in (lambda: define("t").value("a").build(), lambda: define("t").primary_key("id").value("ID").build(), lambda: define("t").primary_key("id").collection("c", index="ordered").build(), lambda: define("t").primary_key("id").collection("c").layout("flat").build()):
        with pytest.raises(BindError):
            broken()
