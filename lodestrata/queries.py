"""The registered queries of the collection engine, each with the DuckDB statement that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Collection, Engine
from .functions import text as X
from .operators import correlate, eviction, fulltext, metadata, pivot
from .plans import compile as C
from .plans.builder import field
from .schema import of_frame
from .sources import documents
from .sources.store import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "lineitem": "l_orderkey", "nation": "n_nationkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, df: DataFrame | None = None, full_text: tuple[str, ...] = ()) -> Collection:
    return Engine(spark).attach(name, table(spark, sf_dir, name) if df is None else df, KEYS[name], full_text)


def query(name: str, oracle: str | None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def statement(name: str, target: str, text: str, oracle: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a statement of the dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, target)
        return _run(view(spark, sf_dir, target, df if shape is None else shape(df)), text)

    QUERIES[name], ORACLE[name] = run, oracle


def _run(target: Collection, text: str) -> DataFrame:
    return target.run(target.parse(text))


# -- predicates

_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "
_OS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where "
statement("q01_pk_lookup", "orders", "select from orders where o_orderkey = 42", "SELECT * FROM orders WHERE o_orderkey = 42")
statement("q02_neq", "orders", _OS + "o_orderstatus <> O", _O + "o_orderstatus <> 'O'")
statement("q03_lt", "orders", _OS + "o_totalprice < 1500,5", _O + "o_totalprice < 1500.5")
statement("q04_le", "part", "select p_partkey, p_size from part where p_size <= 3", "SELECT p_partkey, p_size FROM part WHERE p_size <= 3")
statement("q05_gt", "orders", _OS + "o_totalprice > 150000", _O + "o_totalprice > 150000")
statement("q06_ge", "orders", "select o_orderkey, o_orderdate from orders where o_orderdate >= 1998-01-01", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
_L = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
_LS = "select l_orderkey, l_linenumber, l_quantity from lineitem where "
for _n, (_a, _b) in {"q07_range_gele": (">=", "<="), "q08_range_gelt": (">=", "<"), "q09_range_gtlt": (">", "<"), "q10_range_gtle": (">", "<=")}.items():
    statement(_n, "lineitem", _LS + f"l_quantity {_a} 10 and l_quantity {_b} 12", _L + f"l_quantity {_a} 10 AND l_quantity {_b} 12")
statement("q11_in", "orders", _OS + "o_orderpriority in (1-URGENT, '2-HIGH') and o_custkey in 1, 2, 3", _O + "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3)")
statement("q12_not_in", "orders", _OS + "o_orderstatus not in (O, F)", _O + "o_orderstatus NOT IN ('O', 'F')")


def _words(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", F.split("text", " ").alias("words"))


statement("q13_contains", "documents", "select doc_id, source from documents where words contains the", "SELECT doc_id, source FROM documents WHERE list_contains(string_split(text, ' '), 'the')", _words)
statement("q14_not_contains", "documents", "select doc_id, source from documents where words not contains 'the' and words not contains de", "SELECT doc_id, source FROM documents WHERE NOT list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'de')", _words)
_P = "SELECT p_partkey, p_name FROM part WHERE "
statement("q15_starts", "part", "select p_partkey, p_name from part where p_name like 'RED %'", _P + "lower(p_name) LIKE 'red %'")
statement("q16_ends", "part", "select p_partkey, p_name from part where p_name like %Gear", _P + "lower(p_name) LIKE '%gear'")
statement("q17_contains_ci", "part", "select p_partkey, p_name from part where p_name like %E B%", _P + "lower(p_name) LIKE '%e b%'")


def _sparse(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))


_SP = "SELECT o_orderkey, cust, status FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS cust, nullif(o_orderstatus, 'O') AS status FROM orders) WHERE "
statement("q18_null_eq", "orders", "select from orders where status = null and cust <> 5", _SP + "status IS NULL AND cust IS DISTINCT FROM 5", _sparse)
statement("q18_null_order", "orders", "select from orders where cust < 50 or cust >= 900 and status <> null", _SP + "cust IS NULL OR cust < 50 OR (cust >= 900 AND status IS NOT NULL)", _sparse)
statement("q18_null_in", "orders", "select from orders where status not in (F, X) and cust not in (1, 2, null)", _SP + "(status IS NULL OR status NOT IN ('F', 'X')) AND cust IS NOT NULL AND cust NOT IN (1, 2)", _sparse)
statement("q18_null_in_list", "orders", "select from orders where status in (F, null)", _SP + "status = 'F' OR status IS NULL", _sparse)
statement("q19_dnf", "lineitem", _LS + "l_returnflag = R and l_quantity > 45 or l_shipdate < 1992-02-01 and l_linestatus = F", _L + "(l_returnflag = 'R' AND l_quantity > 45) OR (l_shipdate < TIMESTAMP '1992-02-01' AND l_linestatus = 'F')")


@query("q19_builder", _O + "(o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_custkey IN (7, 8))) AND NOT (o_orderpriority = '5-LOW')")
def _builder(spark, sf_dir):
    o = view(spark, sf_dir, "orders")
    condition = (field("o_orderstatus") == "F") & ((field("o_totalprice") > 100000) | field("o_custkey").isin([7, 8])) & ~(field("o_orderpriority") == "5-LOW")
    return o.where(condition).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").frame()


statement("q19_alias", "orders", "select o_orderkey id, o_totalprice Price from orders where 500 > o_custkey and 'F' = o_orderstatus", "SELECT o_orderkey AS id, o_totalprice AS \"Price\" FROM orders WHERE o_custkey < 500 AND o_orderstatus = 'F'")

# -- pivots

_DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_{0}"


def _sums(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("decimal(38,2)").alias(c) if c.startswith("sum_") else F.col(c) for c in df.columns])


def _order_years(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("o_orderdate"))


@query("q20_pivot2", f"SELECT CAST(2 - bit_count(CAST(GROUPING(o_orderstatus, year) AS INTEGER)) AS INTEGER) AS level, o_orderstatus, year, count(*) AS count, {_DEC.format('o_totalprice')} FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) GROUP BY ROLLUP(o_orderstatus, year)")
def _pivot2(spark, sf_dir):
    o = view(spark, sf_dir, "orders", _order_years(table(spark, sf_dir, "orders")))
    return _sums(o.pivot(["o_orderstatus", "year"], ["o_totalprice"], scale=2))


@query("q21_pivot_filtered", f"SELECT CAST(2 - bit_count(CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER)) AS INTEGER) AS level, l_returnflag, l_linestatus, count(*) AS count, {_DEC.format('l_quantity')}, {_DEC.format('l_extendedprice')} FROM lineitem WHERE l_quantity >= 10 GROUP BY ROLLUP(l_returnflag, l_linestatus)")
def _pivot_filtered(spark, sf_dir):
    return _sums(view(spark, sf_dir, "lineitem").pivot(["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], field("l_quantity") >= 10, scale=2))


@query("q22_pivot_total", f"SELECT CAST(0 AS INTEGER) AS level, count(*) AS count, {_DEC.format('l_quantity')} FROM lineitem")
def _pivot_total(spark, sf_dir):
    return _sums(view(spark, sf_dir, "lineitem").pivot([], ["l_quantity"], scale=2))


@query("q22_pivot_null_axis", "SELECT CAST(1 - bit_count(CAST(GROUPING(status) AS INTEGER)) AS INTEGER) AS level, status, count(*) AS count, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price FROM (SELECT nullif(o_orderstatus, 'O') AS status, o_totalprice AS price FROM orders) GROUP BY ROLLUP(status)")
def _pivot_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.col("o_totalprice").alias("price"))
    return _sums(view(spark, sf_dir, "orders", df).pivot(["status"], ["price"], scale=2))


# -- distinct, order, bounds, counts

statement("q23_distinct1", "part", "select distinct p_type from part", "SELECT DISTINCT p_type FROM part")
statement("q24_distinct2", "orders", "select distinct o_orderstatus, o_orderpriority from orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("q25_distinct_where", "orders", "select distinct o_custkey from orders where o_totalprice > 100000 order by o_custkey take 50", "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_custkey LIMIT 50")
statement("q25_distinct_order", "orders", "select distinct o_orderpriority from orders where o_custkey < 100 order by o_totalprice descending take 3", "SELECT o_orderpriority FROM orders WHERE o_custkey < 100 GROUP BY 1 ORDER BY max(o_totalprice) DESC, 1 DESC LIMIT 3")
statement("q26_distinct_collection", "documents", "select distinct words from documents", "SELECT DISTINCT unnest(string_split(text, ' ')) AS words FROM documents", _words)
statement("q27_order_take", "orders", "select o_orderkey, o_totalprice from orders order by o_totalprice take 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
statement("q28_order_desc_take", "orders", "select o_orderkey, o_totalprice from orders where o_orderstatus = F and o_totalprice > 150000 order by o_totalprice descending take 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
statement("q28_order_nulls", "orders", "select from orders order by cust take 40", _SP.replace("WHERE ", "ORDER BY cust NULLS FIRST, o_orderkey LIMIT 40"), _sparse)
statement("q28_order_nulls_desc", "orders", "select from orders where cust < 20 order by cust descending", _SP + "cust IS NULL OR cust < 20", _sparse)
statement("q29_skip", "orders", "select o_orderkey from orders order by o_orderkey skip 100 take 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
statement("q30_count", "orders", "count from orders where o_orderstatus = F", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
statement("q31_count_take", "orders", "count from orders where o_orderstatus = F take 100", "SELECT least(count(*), 100) AS count FROM orders WHERE o_orderstatus = 'F'")


@query("q32_count_distinct", "SELECT count(*) AS count FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def _count_distinct(spark, sf_dir):
    from dataclasses import replace

    o = view(spark, sf_dir, "orders")
    return o.run(replace(o.query().select("o_custkey", "o_orderstatus").distinct().query, count=True))


@query("q32_to_json", "SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}) AS VARCHAR) AS json FROM orders WHERE o_custkey = 11")
def _json(spark, sf_dir):
    return documents.as_json(_run(view(spark, sf_dir, "orders"), "select o_orderkey, o_orderstatus from orders where o_custkey = 11"))


@query("q32_to_json_all", "SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}) AS VARCHAR) AS json FROM orders")
def _json_all(spark, sf_dir):
    return documents.as_json(_run(view(spark, sf_dir, "orders"), "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"))


# -- full text

_TOKENS = r"regexp_extract_all({0}, '\p{{Lu}}+[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]*|[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]+|\p{{Nd}}+|[^\p{{L}}\p{{Nd}}\s\p{{Z}}]+')"
_POST = f"SELECT DISTINCT doc_id, lower(unnest({_TOKENS.format('text')})) AS token FROM documents"


_PLAIN_POST = f"SELECT DISTINCT doc_id, strip_accents(lower(unnest({_TOKENS.format('text')}))) AS token FROM documents"


@query("q33_postings", f"SELECT token, count(*) AS df FROM ({_POST}) GROUP BY token")
def _frequencies(spark, sf_dir):
    lined = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("line"), "text")
    listed = lined.select("key", "line", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0)), lambda t: F.lower(t)))).alias("token"))
    return fulltext.frequencies(listed)


SEARCH = "erst thing Worthless trash"
_WANTED = ("erst", "thing", "worthles", "trash")


def _search_sql() -> str:
    """The ranking recipe for SEARCH over one text a document: tokens with repeated characters once, weights by all postings,
    bonuses for order, and the cut at a twentieth of the best."""
    squeeze = "list_aggregate(list_filter(string_split(low, ''), lambda c, i: i = 1 OR c <> string_split(low, '')[i - 1]), 'string_agg', '')"
    at = [f"min(CASE WHEN token = '{t}' THEN pos END) AS p{k}" for k, t in enumerate(_WANTED)]
    weight = " + ".join(["CAST(0.0 AS DOUBLE)", *[f"CASE WHEN p{k} IS NOT NULL THEN w{k} ELSE CAST(0.0 AS DOUBLE) END" for k in range(4)]])
    n = " + ".join(f"CAST(p{k} IS NOT NULL AS INTEGER)" for k in range(4))
    bonus = []
    for i in range(4):
        for j in range(i + 1, 4):
            next_to = " AND ".join([f"p{i} IS NOT NULL", f"p{j} IS NOT NULL", *[f"p{m} IS NULL" for m in range(i + 1, j)]])
            gap = f"p{j} - p{i} - {j - i}"
            bonus.append(f"CAST(CASE WHEN NOT ({next_to}) THEN 1 WHEN {gap} = 0 THEN 100 WHEN {gap} = 1 THEN 50 WHEN {gap} = 2 THEN 30 WHEN p{j} > p{i} THEN 2 ELSE 1 END AS DOUBLE)")
    return f"""
WITH found AS (SELECT doc_id, {_TOKENS.format('text')} AS list FROM documents),
raw AS (SELECT doc_id, unnest(list) AS tok, unnest(range(1, len(list) + 1)) AS pos FROM found),
low AS (SELECT tok, strip_accents(lower(tok)) AS low FROM (SELECT DISTINCT tok FROM raw)),
norm AS (SELECT tok, {squeeze} AS token FROM low),
post AS (SELECT doc_id, token, min(pos) AS pos FROM raw JOIN norm USING (tok) GROUP BY doc_id, token),
total AS (SELECT count(*) AS n FROM post),
weights AS (SELECT {", ".join(f"log10(max(n) / nullif(CAST(count(*) FILTER (token = '{t}') AS DOUBLE), 0)) AS w{k}" for k, t in enumerate(_WANTED))} FROM post, total),
lines AS (SELECT doc_id, {", ".join(at)} FROM post GROUP BY doc_id),
scored AS (SELECT doc_id, {n} AS n, ({weight}) * CASE WHEN {n} > 1 THEN CAST(100.0 AS DOUBLE) * ({n}) ELSE CAST(1.0 AS DOUBLE) END * ({" * ".join(bonus)}) AS s FROM lines, weights),
hits AS (SELECT doc_id, CAST(s * n AS DOUBLE) AS score, CAST(n AS INTEGER) AS tokens FROM scored WHERE n > 0),
kept AS (SELECT * FROM hits WHERE score >= (SELECT max(score) FROM hits) / 20)
"""


@query("q33_fulltext", _search_sql() + "SELECT doc_id, score, tokens FROM kept")
def _search(spark, sf_dir):
    """All documents that the search finds, with their rank score."""
    d = view(spark, sf_dir, "documents", full_text=("text",))
    found = fulltext.scan(fulltext.lines(d.frame(), d.schema), SEARCH, scratch(spark))
    return found.select(F.col("key").alias("doc_id"), "score", "tokens")


@query("q33_index", _search_sql() + "SELECT doc_id, score, tokens FROM kept")
def _indexed(spark, sf_dir):
    """The same from a stored collection's index."""
    engine = Engine(spark, scratch(spark))
    df = table(spark, sf_dir, "documents")
    d = engine.declare(of_frame("documents", df.schema, "doc_id", ("text",)))
    d.put_many(df)
    return d.index().search(SEARCH).select(F.col("key").alias("doc_id"), "score", "tokens")


@query("q34_mixed", _search_sql() + "SELECT doc_id, lang, n_chars FROM kept JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 500")
def _mixed(spark, sf_dir):
    d = view(spark, sf_dir, "documents", full_text=("text",))
    return d.where((field("lang") == "en") & (field("n_chars") > 500)).full_text(SEARCH).select("doc_id", "lang", "n_chars").frame()


@query("q42_top_tokens", f"SELECT token, count(*) AS df FROM ({_PLAIN_POST}) GROUP BY token ORDER BY df DESC, token LIMIT 20")
def _top(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return fulltext.most_frequent(df, of_frame("documents", df.schema, "doc_id", ("text",)), 20, squeeze=False)


# -- writes


def _stored(spark: SparkSession, sf_dir: str, name: str) -> tuple[Engine, Collection]:
    engine = Engine(spark, scratch(spark))
    df = table(spark, sf_dir, name)
    target = engine.declare(of_frame(name, df.schema, KEYS[name]))
    target.put_many(df)
    return engine, target


@query("q35_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 = 0")
def _upsert(spark, sf_dir):
    _, c = _stored(spark, sf_dir, "customer")
    df = table(spark, sf_dir, "customer")
    changed = df.filter("c_custkey % 7 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!")))
    c.put_many(changed.unionByName(df.filter("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000)))
    return c.frame().select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("q36_delete_many", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
def _delete(spark, sf_dir):
    engine, o = _stored(spark, sf_dir, "orders")
    engine.sql("delete from orders where o_orderstatus = F and o_totalprice > 1000 take 3")
    return o.frame().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("q37_try_add", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 99999999, 'new'")
def _try_add(spark, sf_dir):
    _, s = _stored(spark, sf_dir, "supplier")
    s.try_add({"s_suppkey": 1, "s_name": "not taken"})
    s.try_add({"s_suppkey": 99999999, "s_name": "new"})
    return s.frame().select("s_suppkey", "s_name")


@query("q38_update_if", "SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN 'changed' ELSE s_name END AS s_name FROM supplier")
def _update_if(spark, sf_dir):
    from .errors import ConditionFailed

    _, s = _stored(spark, sf_dir, "supplier")
    s.update_if({**s[2], "s_name": "changed"}, field("s_suppkey") >= 2)
    try:
        s.update_if({**s[3], "s_name": "refused"}, field("s_name") == "someone else")
    except ConditionFailed:
        pass
    return s.frame().select("s_suppkey", "s_name")


@query("q38_transaction", "SELECT 'customer' AS source, c_custkey AS k FROM customer WHERE c_custkey >= 10 UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'supplier', 77777777")
def _transaction(spark, sf_dir):
    engine, c = _stored(spark, sf_dir, "customer")
    df = table(spark, sf_dir, "supplier")
    s = engine.declare(of_frame("supplier", df.schema, "s_suppkey"))
    t = engine.transaction()
    t.put_many(s, df)
    t.put(s, {"s_suppkey": 77777777, "s_name": "x"})
    t.delete_many(c, field("c_custkey") < 10)
    t.commit()
    return c.frame().select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k")).union(s.frame().select(F.lit("supplier"), "s_suppkey"))


# -- the rest


@query("q39_in_correlation", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _in(spark, sf_dir):
    c = _run(view(spark, sf_dir, "customer"), "select c_custkey from customer where c_mktsegment = BUILDING")
    return correlate.is_in(table(spark, sf_dir, "orders"), "o_custkey", c, "c_custkey").select("o_orderkey", "o_custkey")


@query("q39_not_in_correlation", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _not_in(spark, sf_dir):
    return correlate.is_not_in(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").filter("o_totalprice > 250000"), "o_custkey").select("c_custkey", "c_name")


@query("q40_lru", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 400")
def _lru(spark, sf_dir):
    return eviction.LeastRecentlyUsed(500, 100).survivors(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id")


@query("q41_ttl", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def _ttl(spark, sf_dir):
    return eviction.TimeToLive(10 * 86400).survivors(table(spark, sf_dir, "events"), "ts", dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)).select("event_id", "user_id")


@query("q43_json_documents", "SELECT event_id, user_id, event_type FROM events WHERE value > 50")
def _documents(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    schema = of_frame("events", df.schema, "event_id")
    back = documents.from_text(df.select(F.to_json(F.struct("*")).alias("j")), "j", schema)
    return _run(Engine(spark).attach("events", back, "event_id"), "select event_id, user_id, event_type from events where value > 50")


@query("q44_metadata", "SELECT 'p_type' AS \"column\", 'string' AS type, count(DISTINCT p_type) AS \"distinct\", min(p_type) AS low, max(p_type) AS high FROM part UNION ALL SELECT 'p_size', 'integer', count(DISTINCT p_size), CAST(min(p_size) AS VARCHAR), CAST(max(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'p_partkey', 'integer', count(DISTINCT p_partkey), CAST(min(p_partkey) AS VARCHAR), CAST(max(p_partkey) AS VARCHAR) FROM part")
def _metadata(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return metadata.summary(df, of_frame("part", df.schema, "p_partkey"))


@query("q45_csv_feed", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _csv(spark, sf_dir):
    from .sources import csv

    path = scratch(spark) + "/csv"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.csv(path, header=True)
    found = csv.infer(spark, path)
    return csv.feed_frame(spark, path, found).select(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("q46_dump_restore", "SELECT s_suppkey, s_name FROM supplier")
def _dump(spark, sf_dir):
    engine, s = _stored(spark, sf_dir, "supplier")
    path = scratch(spark) + "/dump"
    engine.dump(path)
    s.truncate()
    engine.restore(path)
    return s.frame().select("s_suppkey", "s_name")


@query("q47_subset_domain", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 2000")
def _domain(spark, sf_dir):
    """Answered only because the declared domain provably covers the question."""
    _, o = _stored(spark, sf_dir, "orders")
    o.declare_domain((field("o_custkey") < 1000) & (field("o_totalprice") >= 1000))
    return o.where((field("o_custkey") == 7) & (field("o_totalprice") > 2000)).select("o_orderkey").only_if_complete().frame()


@query("q48_consistent_read", "SELECT s_suppkey, s_name FROM supplier")
def _consistent(spark, sf_dir):
    """A truncate inside the block is not seen by it."""
    engine, s = _stored(spark, sf_dir, "supplier")
    with engine.consistent_read("supplier") as (pinned,):
        seen = pinned.frame()
        s.truncate()
        return seen.select("s_suppkey", "s_name")


# -- more of the surface


@query("q19_boolean_member", _O + "o_orderpriority = '1-URGENT' AND NOT (o_totalprice > 100000)")
def _boolean(spark, sf_dir):
    """A boolean column as a condition, and one negated."""
    df = table(spark, sf_dir, "orders").withColumns({"urgent": F.col("o_orderpriority") == "1-URGENT", "dear": F.col("o_totalprice") > 100000})
    return view(spark, sf_dir, "orders", df).where(field("urgent").is_true() & ~field("dear").is_true()).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").frame()


@query("q29_first", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def _first(spark, sf_dir):
    found = view(spark, sf_dir, "orders").where(field("o_orderstatus") == "F").select("o_orderkey", "o_custkey").order_by_descending("o_totalprice").first()
    return spark.createDataFrame([found], table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").schema)


@query("q20_pivot_tree", "SELECT depth, axis, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(n) AS BIGINT) AS count, CAST(sum(s) AS DECIMAL(38,2)) AS sum_o_totalprice FROM (SELECT 0 AS depth, '' AS axis, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders UNION ALL SELECT 1, 'o_orderstatus', count(*), sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 2, 'o_orderpriority', count(*), sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY depth, axis")
def _tree(spark, sf_dir):
    """The trees of two halves of the orders, merged and checked, summed up by level."""
    df = table(spark, sf_dir, "orders")
    halves = [pivot.tree(view(spark, sf_dir, "orders", df.filter(f"o_custkey % 2 = {k}")).pivot(["o_orderstatus", "o_orderpriority"], ["o_totalprice"], scale=2)) for k in (0, 1)]
    halves[0].merge(halves[1])
    halves[0].check()
    levels, depth = [halves[0]], 0
    rows = []
    while levels:
        rows.append((depth, levels[0].axis or "", len(levels), sum(n.count for n in levels), sum(n.sums["o_totalprice"] for n in levels)))
        levels, depth = [c for n in levels for c in n.children.values()], depth + 1
    return spark.createDataFrame(rows, "depth int, axis string, nodes long, count long, sum_o_totalprice decimal(38,2)")


@query("q35_feed", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 88888888, 'fed'")
def _feed(spark, sf_dir):
    """A feed session of a table and a row, committed together; one that fails leaves nothing."""
    df = table(spark, sf_dir, "supplier")
    engine = Engine(spark, scratch(spark))
    s = engine.declare(of_frame("supplier", df.schema, "s_suppkey"))
    with s.feed() as parts:
        parts.append(df)
        parts.append({"s_suppkey": 88888888, "s_name": "fed"})
    try:
        with s.feed() as parts:
            parts.append({"s_suppkey": 99999999, "s_name": "lost"})
            raise ValueError
    except ValueError:
        pass
    return s.frame().select("s_suppkey", "s_name")


@query("q35_stream", "SELECT s_suppkey, s_name FROM supplier")
def _streamed(spark, sf_dir):
    """A streamed folder of documents, put batch by batch."""
    from .streaming.ingest import upsert_stream

    path, df = scratch(spark), table(spark, sf_dir, "supplier")
    s = Engine(spark, path + "/db").declare(of_frame("supplier", df.schema, "s_suppkey"))
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path + "/in")
    upsert_stream(s, spark.readStream.text(path + "/in"), path + "/cp", "value").awaitTermination()
    return s.frame().select("s_suppkey", "s_name")


@query("q38_timestamp_update", "SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN 'newer' ELSE s_name END AS s_name FROM supplier")
def _stamped(spark, sf_dir):
    """An update that has seen the row's time stamp is taken, one with an old stamp refused."""
    from .errors import ConditionFailed

    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(dt.datetime(2024, 1, 1)).alias("Timestamp"))
    s = Engine(spark, scratch(spark)).declare(of_frame("supplier", df.schema, "s_suppkey"))
    s.put_many(df)
    old = s[2]
    s.update_with_timestamp({**old, "s_name": "newer"})
    try:
        s.update_with_timestamp({**old, "s_name": "refused"})
    except ConditionFailed:
        pass
    return s.frame().select("s_suppkey", "s_name")


@query("q37_unique_ids", "SELECT CAST(range AS BIGINT) AS id, range >= 6 AS second FROM range(1, 9)")
def _unique(spark, sf_dir):
    path = scratch(spark)
    one, two = Engine(spark, path), Engine(spark, path)
    rows = [(i, False) for i in one.unique_ids("n", 5)] + [(i, True) for i in two.unique_ids("n", 3)]
    return spark.createDataFrame(rows, "id long, second boolean")


@query("q36_delete_key", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (1, 3)")
def _delete_key(spark, sf_dir):
    engine, s = _stored(spark, sf_dir, "supplier")
    s.delete(1)
    s.delete(123456789)
    t = engine.transaction()
    t.delete(s, 3)
    t.commit()
    return s.frame().select("s_suppkey", "s_name")


@query("q46_drop", "SELECT 'supplier' AS name, count(*) AS rows FROM supplier")
def _drop(spark, sf_dir):
    engine, s = _stored(spark, sf_dir, "supplier")
    df = table(spark, sf_dir, "customer")
    engine.declare(of_frame("customer", df.schema, "c_custkey")).put_many(df)
    engine.drop("customer")
    return spark.createDataFrame([(n, engine.collection(n).query().count()) for n in engine.collections()], "name string, rows long")


@query("q46_rebucket", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> 5")
def _rebucket(spark, sf_dir):
    engine, s = _stored(spark, sf_dir, "supplier")
    engine.rebucket("supplier", 3)
    s.delete(5)
    return s.frame().select("s_suppkey", "s_name")


@query("q43_json_file", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _json_file(spark, sf_dir):
    """INTO a file of one JSON array in the shared folder, and that file imported again."""
    engine, s = _stored(spark, sf_dir, "supplier")
    path = scratch(spark)
    path = (path if ":/" in path else "file:" + path) + ".json"
    engine.sql(f"select from supplier where s_acctbal > 0 into {path}")
    copy = Engine(spark, scratch(spark)).declare(s.schema)
    copy.import_json(path)
    return copy.frame().select("s_suppkey", "s_name", "s_acctbal")


@query("q43_json_stream", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def _json_stream(spark, sf_dir):
    """Rows streamed out as JSON documents and read again."""
    from pyspark.sql import types as T

    df = table(spark, sf_dir, "nation")
    engine = Engine(spark)
    engine.attach("nation", df, "n_nationkey")
    texts = list(engine.sql_json("select n_nationkey, n_name from nation where n_regionkey <> 1"))
    schema = of_frame("nation", T.StructType([df.schema["n_nationkey"], df.schema["n_name"]]), "n_nationkey")
    return documents.from_strings(spark, texts, schema)


def _discriminant_sql(columns: tuple[str, ...]) -> str:
    from itertools import combinations

    parts = [f"SELECT '{'+'.join(c)}' AS columns, max(n) AS largest, avg(n) AS average FROM (SELECT count(*) AS n FROM orders GROUP BY {', '.join(c)})" for c in [*((x,) for x in columns), *combinations(columns, 2)]]
    return " UNION ALL ".join(parts)


_TELLING = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query("q45_discriminant", _discriminant_sql(_TELLING))
def _telling(spark, sf_dir):
    from .sources import csv

    return csv.discriminant_in(table(spark, sf_dir, "orders"), list(_TELLING))


@query("q45_csv_folder", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _csv_folder(spark, sf_dir):
    """A folder of several files, each with a header: schema found, collection made and fed."""
    path = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").repartition(4, "c_custkey").write.csv(path + "/csv", header=True)
    engine = Engine(spark, path + "/db")
    c = Collection.feed_csv_with_automatic_schema(engine, path + "/csv", "customer")
    return c.frame().select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_name"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("q40_lru_excluded", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'click' ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE event_type = 'click' OR k <= 300")
def _lru_excluded(spark, sf_dir):
    """Excluded rows neither count nor go."""
    df = table(spark, sf_dir, "events").withColumn("kept", F.col("event_type") == "click")
    return eviction.LeastRecentlyUsed(400, 100).survivors(df, "ts", "event_id", "kept").select("event_id", "user_id")


@query("q41_ttl_excluded", "SELECT event_id, user_id FROM events WHERE event_type = 'click' OR ts > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def _ttl_excluded(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("kept", F.col("event_type") == "click")
    return eviction.TimeToLive(10 * 86400).survivors(df, "ts", dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc), "kept").select("event_id", "user_id")


@query("q47_fully_loaded", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def _complete(spark, sf_dir):
    """Refused while nothing vouches for completeness, answered once the collection is declared fully loaded."""
    from .errors import EngineError, IncompleteData

    _, o = _stored(spark, sf_dir, "orders")
    asked = o.where(field("o_totalprice") > 400000).select("o_orderkey").only_if_complete()
    try:
        asked.frame()
    except IncompleteData:
        o.declare_fully_loaded()
        return asked.frame()
    raise EngineError("an unproven answer")


@query("q49_activity", "SELECT * FROM (VALUES ('count', 'nation'), ('select', 'nation')) AS t(type, collection)")
def _activity(spark, sf_dir):
    """The log of what was asked, itself asked as a collection."""
    engine = Engine(spark)
    engine.attach("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    engine.sql("select from nation where n_regionkey = 1")
    engine.sql("count from nation")
    return engine.sql("select type, collection from @ACTIVITY where collection = nation")


@query("q50_form", "SELECT p_partkey, p_size FROM part WHERE lower(p_name) LIKE 'red%' AND p_size BETWEEN 3 AND 40 AND p_size NOT IN (7, 8) ORDER BY p_partkey LIMIT 30")
def _form(spark, sf_dir):
    """A structured form turned into a statement and run."""
    parts = [{"column": "p_name", "operator": "starts with", "values": ["red"]}, {"column": "p_size", "operator": ">=", "values": [3]}, {"column": "p_size", "operator": "<=", "values": [40]}, {"column": "p_size", "operator": "not in", "values": [7, 8]}]
    return _run(view(spark, sf_dir, "part"), metadata.form_to_sql("part", parts, "p_partkey", take=30)).select("p_partkey", "p_size")


def plan_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The physical plan of a registered query."""
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


__all__ = ["C", "ORACLE", "QUERIES", "pivot", "plan_of"]
