import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.predicates import holds, matches, where
from lodestrata.plans import query as Q
from lodestrata.plans.builder import Builder, field
from lodestrata.plans.compile import run
from lodestrata.plans.subset import is_subset
from lodestrata.schema import define

SCHEMA = define("t").primary_key("id").value("n", "int").value("s").value("d", "timestamp").value("b", "bool").collection("c").build()
UTC = dt.timezone.utc
DAY = [dt.datetime(2020, 1, k, tzinfo=UTC) for k in (1, 2, 3)]
ROWS = [
    {"id": k, "n": n, "s": s, "d": d, "b": b, "c": c}
    for k, (n, s, d, b, c) in enumerate(
        [(1, "Ab", DAY[0], True, ["x"]), (2, "aB%", DAY[1], False, []), (None, None, None, None, None), (3, "", DAY[2], True, ["x", None, "Y"]), (2, "é_z", None, None, ["y"]), (-5, "null", DAY[0], False, ["x", "y"]), (None, "AB", DAY[1], True, [None])]
    )
]


@pytest.fixture(scope="module")
def df(spark):
    rows = [tuple({**r, "d": r["d"]}[f.name] for f in SCHEMA.fields) for r in ROWS]
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.type) for f in SCHEMA.fields])).cache()


def ids(df, condition):
    return sorted(r[0] for r in (df if condition is None else df.filter(condition)).select("id").collect())


def all_atoms():
    out = []
    for op in (Q.EQ, Q.NE, Q.LT, Q.LE, Q.GT, Q.GE):
        out += [Q.Atom("n", op, (v,)) for v in (2, None, 99)] + [Q.Atom("s", op, (v,)) for v in ("AB", "", None)] + [Q.Atom("d", op, (DAY[1],)), Q.Atom("b", op, (True,))]
    for op in (Q.IN, Q.NOT_IN):
        out += [Q.Atom("n", op, v) for v in ((1, 2), (None,), (3, None), ())] + [Q.Atom("s", op, ("Ab", "null"))]
    for op in Q.RANGES:
        out += [Q.Atom("n", op, (1, 2)), Q.Atom("n", op, (None, 2)), Q.Atom("n", op, (1, None)), Q.Atom("d", op, (DAY[0], DAY[1]))]
    for op in (Q.CONTAINS, Q.NOT_CONTAINS):
        out += [Q.Atom("c", op, (v,)) for v in ("x", "y", None, "q")]
    for op in (Q.STARTS, Q.ENDS, Q.HOLDS, Q.NOT_STARTS, Q.NOT_ENDS, Q.NOT_HOLDS):
        out += [Q.Atom("s", op, (v,)) for v in ("ab", "B", "%", "_", "")]
    return out


def test_truth_table(df):
    """Every operator on every kind of value agrees with plain Python, in one pass over the rows."""
    atoms = all_atoms()
    conditions = [F.coalesce(where(Q.Query("t", ((a,),)), SCHEMA), F.lit(False)).alias(f"c{k}") for k, a in enumerate(atoms)]
    for r in df.select("id", *conditions).collect():
        for k, a in enumerate(atoms):
            assert r[f"c{k}"] == holds(a, ROWS[r["id"]]), (a, ROWS[r["id"]])


def test_negation_is_the_complement():
    for a in all_atoms():
        if a.op in Q.NEGATED:
            for r in ROWS:
                assert holds(a, r) != holds(a.negated(), r), (a, r)


def test_bare_forms_filter_like_wrapped_ones(df):
    for a in all_atoms():
        q = Q.Query("t", ((a,), (Q.Atom("id", Q.EQ, (0,)),)))
        assert ids(df, where(q, SCHEMA)) == sorted(r["id"] for r in ROWS if matches(q, r)), a


SCALARS = st.one_of(
    st.tuples(st.just("n"), st.sampled_from([Q.EQ, Q.NE, Q.LT, Q.LE, Q.GT, Q.GE]), st.sampled_from([None, -5, 1, 2, 3]).map(lambda v: (v,))),
    st.tuples(st.just("n"), st.sampled_from([Q.IN, Q.NOT_IN]), st.lists(st.sampled_from([None, -5, 1, 2]), max_size=3).map(tuple)),
    st.tuples(st.just("n"), st.sampled_from(list(Q.RANGES)), st.tuples(st.integers(-6, 3), st.integers(-6, 3))),
    st.tuples(st.just("s"), st.sampled_from([Q.EQ, Q.NE, Q.LT, Q.GE]), st.sampled_from(["Ab", "AB", None]).map(lambda v: (v,))),
    st.tuples(st.just("s"), st.sampled_from([Q.STARTS, Q.ENDS, Q.HOLDS, Q.NOT_HOLDS]), st.sampled_from(["a", "b", "ab"]).map(lambda v: (v,))),
    st.tuples(st.just("c"), st.sampled_from([Q.CONTAINS, Q.NOT_CONTAINS]), st.sampled_from(["x", "y", None]).map(lambda v: (v,))),
).map(lambda x: Q.Atom(*x))
DNF = st.lists(st.lists(SCALARS, min_size=1, max_size=3).map(tuple), min_size=1, max_size=3).map(tuple)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(DNF)
def test_random_disjunctions(df, branches):
    q = Q.Query("t", branches)
    expected = sorted(r["id"] for r in ROWS if matches(q, r))
    assert ids(df, where(q, SCHEMA)) == expected
    assert ids(df, where(Q.fuse(q), SCHEMA)) == expected


@settings(max_examples=400, deadline=None)
@given(DNF, DNF)
def test_subset_proof_is_sound(a, b):
    asked, domain = Q.Query("t", a), Q.Query("t", b)
    if is_subset(asked, domain):
        grid = [{"id": 0, "n": n, "s": s, "c": c} for n in (None, -6, -5, 0, 1, 2, 3, 4) for s in (None, "", "a", "Ab", "AB", "b", "xab", "zz") for c in (None, ["x"], ["x", "y", None], ["q"])]
        for r in grid:
            assert not matches(asked, r) or matches(domain, r), (asked, domain, r)


def q(condition):
    return Builder(SCHEMA, Q.Query("t")).where(condition).query


def test_subset_cases():
    n, s, d = field("n"), field("s"), field("d")
    yes = [
        (n == 5, n >= 3), ((n == 5) & (s == "E"), n >= 3), (s == "E", (s == "E") | (s == "F")), (s == "E", (s == "E") | ((s == "F") & (n == 1))),
        ((s == "F") & (n == 5), (s == "E") | ((s == "F") & (n > 3))), (s == "E", s.isin(["E", "F"])), ((n > 1) & (n < 3), n >= 1), ((n >= 2) & (n <= 3), (n > 1) & (n < 4)),
        (d == DAY[0], d <= DAY[1]), (s.startswith("abc"), s.startswith("AB")), (s.startswith("xaby"), s.holds("AB")), (n.isin([1, 2]), n != 3), (n > 3, n != 2), (n >= 1, ~n.is_null()),
    ]
    no = [(n >= 3, n == 5), ((s == "E") | (s == "F"), s == "E"), (s == "F", (s == "E") | ((s == "F") & (n == 1))), ((n >= 1) & (n <= 3), (n > 1) & (n < 3)), (n < 3, ~n.is_null()), (s.holds("ab"), s.startswith("ab")), (n != 3, n > 3)]
    for a, b in yes:
        assert is_subset(q(a), q(b)), (q(a).sql(), q(b).sql())
    for a, b in no:
        assert not is_subset(q(a), q(b)), (q(a).sql(), q(b).sql())
    assert is_subset(q(n == 1), Q.Query("t")) and not is_subset(Q.Query("t"), q(n == 1))


def test_builder_nesting():
    n, s = field("n"), field("s")
    nested = (n == 1) & ((s == "Ab") | ~((n > 5) | s.startswith("q")))
    for r in ROWS:
        plain = r["n"] == 1 and (r["s"] == "Ab" or not ((r["n"] is not None and r["n"] > 5) or (r["s"] or "").lower().startswith("q")))
        assert matches(q(nested), r) == plain
    two = Builder(SCHEMA, Q.Query("t")).where((n > 0) | (s == "x")).where(n < 3).query
    assert all(len(b) == 2 for b in two.branches)


def test_order_distinct_take(df):
    rows = run(Q.Query("t", order_by="n"), df, SCHEMA).collect()
    assert [r["n"] for r in rows] == [None, None, -5, 1, 2, 2, 3] and [r["id"] for r in rows][:2] == [2, 6]
    rows = run(Q.Query("t", order_by="n", descending=True, take=3), df, SCHEMA).collect()
    assert [r["id"] for r in rows] == [3, 4, 1]
    assert [r[0] for r in run(Q.Query("t", select=(("n", "k"),), order_by="n", skip=2, take=2), df, SCHEMA).collect()] == [-5, 1]
    assert sorted(map(str, [r[0] for r in run(Q.Query("t", select=(("c", "c"),), distinct=True), df, SCHEMA).collect()])) == ["None", "Y", "x", "y"]
    assert run(Q.Query("t", select=(("n", "n"),), distinct=True), df, SCHEMA).count() == 5
    first = run(Q.Query("t", select=(("b", "b"),), distinct=True, order_by="n"), df, SCHEMA).collect()
    assert {r[0] for r in first[:2]} == {None, True} and first[2][0] is False
    assert run(Q.Query("t", count=True, take=3), df, SCHEMA).first()[0] == 3
    assert run(Q.Query("t", select=(("n", "n"),), distinct=True, count=True), df, SCHEMA).first()[0] == 5


def test_filters_reach_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for condition, pushed in ((field("n") == 1, "EqualNullSafe(n,1)"), (field("n") < 2, "LessThan(n,2)"), (field("n").isin([1, 2]), "In(n, [1,2])"), ((field("n") >= 1) & (field("n") < 3), "GreaterThanOrEqual(n,1)")):
        plan = run(q(condition), stored, SCHEMA)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, plan
