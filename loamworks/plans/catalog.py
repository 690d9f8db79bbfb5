"""All queries on the core operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions import columns as C
from loamworks.functions import synonyms
from loamworks.functions import text as X
from loamworks.operators import exact, gates, metrics, models, prepare, profile, quality, ranges
from loamworks.plans import pipeline, policy
from loamworks.session import cut, passing_path, read_table
from loamworks.sources import html, io
from loamworks.streaming import clean as windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _case(mapping: dict, key: str) -> str:
    q = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def _key(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def _num(c: str) -> str:
    s = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, '{C.NUMBER}') THEN TRY_CAST({s} AS DOUBLE) END"


STATUS_SQL = f"coalesce({_case(synonyms.flat('status'), _key('status'))}, {_key('status')})"
PRICE_DIGITS = "regexp_replace(replace(lower(price), 'approx.', ''), '[^0-9.]', '', 'g')"
PRICE_SQL = f"CASE WHEN contains(lower(price), 'free') THEN 0.0 WHEN regexp_matches({PRICE_DIGITS}, '{C.PLAIN_NUMBER}') THEN TRY_CAST({PRICE_DIGITS} AS DOUBLE) END"
RATING_SQL = f"coalesce({_case(C.RATINGS, _key('rating'))}, {_num('rating')})"
AGE_SQL = f"CASE WHEN ({_num('age')}) BETWEEN 0 AND 150 THEN CAST(trunc({_num('age')}) AS INTEGER) END"
EMAIL_SQL = f"CASE WHEN regexp_matches({_key('email')}, '{C.EMAIL}') THEN {_key('email')} END"
PHONE_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
PHONE_SQL = f"CASE WHEN length({PHONE_DIGITS}) = 10 THEN '+1' || {PHONE_DIGITS} WHEN length({PHONE_DIGITS}) BETWEEN 7 AND 15 THEN '+' || {PHONE_DIGITS} END"


def _date_sql(c: str) -> str:
    s = _key(c)
    iso, german, slash = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})([ t].*)?$", r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
    named, day = r"^([a-z]{3})[a-z]*[.]? +([0-9]{1,2}),? +([0-9]{4})$", r"^([0-9]{1,2})[.]? +([a-z]{3})[a-z]*[.]?,? +([0-9]{4})$"
    p = lambda r, k: f"regexp_extract({s}, '{r}', {k})"
    t = lambda y, m, d: f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    month = lambda r, k: _case(C.MONTHS, p(r, k))
    built = f"CASE WHEN regexp_matches({s}, '{iso}') THEN {t(p(iso, 1), p(iso, 2), p(iso, 3))} WHEN regexp_matches({s}, '{german}') THEN {t(p(german, 3), p(german, 2), p(german, 1))} WHEN regexp_matches({s}, '{slash}') THEN CASE WHEN TRY_CAST({p(slash, 1)} AS INTEGER) > 12 THEN {t(p(slash, 3), p(slash, 2), p(slash, 1))} ELSE {t(p(slash, 3), p(slash, 1), p(slash, 2))} END WHEN regexp_matches({s}, '{named}') THEN {t(p(named, 3), month(named, 1), p(named, 2))} WHEN regexp_matches({s}, '{day}') THEN {t(p(day, 3), month(day, 2), p(day, 1))} END"
    return f"strftime(TRY_CAST({built} AS DATE), '%Y-%m-%d')"


DATE_SQL = _date_sql("order_date")
SCORES = """SELECT c_custkey AS row_id, CASE c_custkey % 10 WHEN 0 THEN '85%' WHEN 1 THEN 'A' WHEN 2 THEN '3.2' WHEN 3 THEN '78/100' WHEN 4 THEN 'b+' WHEN 5 THEN '92' WHEN 6 THEN 'F' WHEN 7 THEN '250' WHEN 8 THEN 'junk' ELSE NULL END AS score FROM {customer}"""
MEASURES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag AS flag, CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN l_quantity * 50 ELSE l_quantity END AS qty, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS price, l_discount + 0.0 AS discount FROM {lineitem}"""
M = "WITH m AS (" + MEASURES.format(lineitem="lineitem") + ") "


def orders(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "order_intake")


def visits(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "patient_visit")


def measures(s: SparkSession, d: str) -> DataFrame:
    return s.sql(MEASURES, lineitem=read_table(s, d, "lineitem"))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Labels and scores for the metrics: whether an order line is returned, and a score that goes with it."""
    return read_table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 20).otherwise(0)) / 80).alias("p"), F.col("l_returnflag").alias("actual"), F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).otherwise("N").alias("predicted"))


SCORED = "WITH t AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, (l_quantity + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END) / 80 AS p, l_returnflag AS actual, CASE WHEN l_discount > 0.05 THEN l_returnflag ELSE 'N' END AS predicted FROM lineitem) "


def flagship(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).groupBy(C.status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM order_intake GROUP BY 1")
def status_counts(s, d):
    return flagship(s, d)


# ---- cleaners of columns
for _name, _fn, _sql in [("status", C.status, STATUS_SQL), ("price", C.price, PRICE_SQL), ("rating", C.rating, RATING_SQL), ("age", C.age, AGE_SQL), ("email", C.email, EMAIL_SQL), ("phone", C.phone, PHONE_SQL), ("order_date", C.date, DATE_SQL)]:
    query(f"SELECT order_no, {_sql} AS cleaned FROM order_intake", f"clean_{'date' if _name == 'order_date' else _name}")(lambda s, d, c=_name, f=_fn: orders(s, d).select("order_no", f(F.col(c)).alias("cleaned")))

_S = _key("score")
_SCORE_SQL = f"CASE WHEN contains({_S}, '%') THEN CASE WHEN ({_num(f'replace({_S}, chr(37), chr(32))')}) BETWEEN 0 AND 100 THEN {_num(f'replace({_S}, chr(37), chr(32))')} END WHEN contains({_S}, '/') THEN CASE WHEN ({_num(f'split_part({_S}, chr(47), 2)')}) > 0 THEN ({_num(f'split_part({_S}, chr(47), 1)')}) / ({_num(f'split_part({_S}, chr(47), 2)')}) * 100 END ELSE coalesce({_case(C.GRADES, _S)}, CASE WHEN ({_num(_S)}) BETWEEN 0 AND 100 THEN {_num(_S)} END) END"
_SCORE_SQL = f"WITH v AS ({SCORES.format(customer='customer')}), w AS (SELECT row_id, {_SCORE_SQL} AS x FROM v) SELECT row_id, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM w), 75.0) AS cleaned FROM w"


@query(_SCORE_SQL)
def clean_score(s, d):
    v = s.sql(SCORES, customer=read_table(s, d, "customer")).select("row_id", C.score(F.col("score")).alias("x"))
    middle = exact.summaries(v, {"x": F.col("x")}, [0.5])["x"].quantile(0.5)
    return v.select("row_id", F.coalesce("x", F.lit(75.0 if middle is None else middle)).alias("cleaned"))


@query(f"SELECT visit_no, coalesce({_case(synonyms.flat('gender'), 'lower(trim(gender))')}, lower(trim(gender))) AS gender FROM patient_visit")
def synonym_map_pipe(s, d):
    g = F.lower(F.trim("gender"))
    return visits(s, d).select("visit_no", F.coalesce(synonyms.lookup(g, synonyms.flat("gender")), g).alias("gender"))


@query(f"SELECT visit_no, coalesce({_case(synonyms.flat('gender', 'policy'), 'lower(trim(gender))')}, gender) AS gender FROM patient_visit")
def synonym_map_policy(s, d):
    return visits(s, d).select("visit_no", C.categorical(F.col("gender"), "gender").alias("gender"))


@query(f"SELECT order_no, coalesce({_case(synonyms.flat('status'), 'lower(trim(status))')}, status) AS status FROM order_intake")
def synonym_table_join(s, d):
    table = s.createDataFrame(sorted(synonyms.flat("status").items()), "spelling string, canonical string")
    return synonyms.lookup_table(orders(s, d).select("order_no", "status"), "status", table)


@query("SELECT order_no, lower(trim(category)) AS category FROM order_intake")
def case_standardize(s, d):
    return orders(s, d).select("order_no", C.standard_case(F.col("category")).alias("category"))


@query("SELECT row_id, lower(trim(id)) AS id FROM test_data")
def clean_identifier(s, d):
    return read_table(s, d, "test_data").select("row_id", C.identifier(F.col("id")).alias("id"))


# ---- profiles
OC = ["customer_id", "name", "email", "phone", "age", "status", "order_date", "price", "rating", "category"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM order_intake" for c in OC))
def profile_nulls(s, d):
    return profile.null_counts(orders(s, d), OC)


@query("SELECT " + " + ".join(f"count(*) - count({c})" for c in OC) + " AS missing_cells FROM order_intake")
def profile_total_missing(s, d):
    return profile.total_missing(orders(s, d).select(*OC))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, 'string' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*)::DOUBLE AS null_pct, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) - count(DISTINCT lower({c})) AS case_variants FROM order_intake" for c in OC))
def profile_columns(s, d):
    return profile.column_profile(orders(s, d), OC)


@query("WITH v AS (SELECT DISTINCT status AS v FROM order_intake WHERE status IS NOT NULL), l AS (SELECT lower(v) AS low, count(*) AS d, min(v) AS least FROM v GROUP BY 1), e AS (SELECT least FROM l WHERE d > 1 ORDER BY least LIMIT 10) SELECT sum(d)::BIGINT AS original_unique, count(*) AS lowered_unique, (SELECT string_agg(least, '|' ORDER BY least) FROM e) AS examples FROM l")
def profile_case_variants(s, d):
    return profile.case_variants(orders(s, d), "status").withColumn("examples", F.array_join("examples", "|"))


@query("WITH g AS (SELECT count(*) AS n FROM order_intake GROUP BY customer_id, name, email, phone, age, status, order_date, price, rating, category) SELECT (sum(n) - count(*))::BIGINT AS duplicate_rows FROM g")
def profile_duplicates(s, d):
    return profile.duplicate_rows(orders(s, d).select(*OC))


@query("SELECT category AS value, count(*) AS n FROM order_intake GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 10")
def value_counts_top10(s, d):
    return profile.value_counts(orders(s, d), "category")


@query("SELECT status AS value, count(*) AS n FROM order_intake GROUP BY 1")
def value_counts_with_null(s, d):
    return profile.value_counts(orders(s, d), "status", None)


def _q(c: str) -> str:
    return f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, count({c}) AS n FROM m"


@query(M + " UNION ALL ".join(map(_q, ("qty", "price", "discount"))))
def quantiles_iqr(s, d):
    return profile.quantiles(measures(s, d), ["qty", "price", "discount"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


_PAIRS = [("qty", "qty"), ("qty", "price"), ("qty", "discount"), ("price", "price"), ("price", "discount"), ("discount", "discount")]


@query(M + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM m" for a, b in _PAIRS))
def corr_matrix(s, d):
    return profile.correlations(measures(s, d), ["qty", "price", "discount"]).withColumn("corr", F.round("corr", 6))


@query(M + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(abs(corr({c}, price)), 6) AS abs_corr FROM m" for c in ("qty", "discount")))
def corr_target_top10(s, d):
    return profile.target_correlations(measures(s, d), "price", ["qty", "discount"]).withColumn("abs_corr", F.round("abs_corr", 6))


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)) + 1, 20)::INTEGER AS bin, lo AS l, hi AS h FROM orders, e) SELECT bin, round(l + (bin - 1) * ((h - l) / 20), 4) AS lo, round(l + bin * ((h - l) / 20), 4) AS hi, count(*) AS n FROM b GROUP BY 1, 2, 3")
def histogram(s, d):
    return profile.histogram(read_table(s, d, "orders"), "o_totalprice").withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


_KIND = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"


@query(f"SELECT {_KIND} AS dtype, count(*) AS n FROM (DESCRIBE orders) GROUP BY 1")
def dtype_histogram(s, d):
    return profile.dtype_histogram(read_table(s, d, "orders"))


@query("SELECT order_no, price FROM order_intake WHERE price IS NOT NULL ORDER BY order_no LIMIT 100")
def first_values(s, d):
    return orders(s, d).filter("price IS NOT NULL").orderBy("order_no").limit(100).select("order_no", "price")


@query("SELECT CASE WHEN count(l_quantity) = 0 OR (bool_and(l_quantity = floor(l_quantity)) AND count(DISTINCT l_quantity) / count(l_quantity)::DOUBLE <= 0.05) OR count(DISTINCT l_quantity) <= 10 THEN 'classification' ELSE 'regression' END AS target_type FROM lineitem")
def target_type(s, d):
    return profile.target_kind(read_table(s, d, "lineitem"), "l_quantity")


_DOMAIN_TABLES = ("patient_visit", "order_intake", "test_data", "orders", "customer", "lineitem", "documents", "scraping_result", "structured_card", "events")
_DOMAIN_ROWS = ", ".join(f"('{domain}', {-k}, '{word}')" for k, (domain, words) in enumerate(profile.DOMAIN_WORDS.items()) for word in words)
_DOMAIN_NAMES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, lower(column_name) AS c FROM (DESCRIBE {t})" for t in _DOMAIN_TABLES)


@query(f"WITH n AS ({_DOMAIN_NAMES}), w(domain, rank, word) AS (VALUES {_DOMAIN_ROWS}), h AS (SELECT table_name, domain, rank, count(DISTINCT word) FILTER (WHERE contains(c, word)) AS hits FROM n, w GROUP BY 1, 2, 3) SELECT table_name, CASE WHEN max(hits) = 0 THEN 'general' ELSE arg_max(domain, hits * 10 + rank) END AS domain FROM h GROUP BY 1")
def domain_detect(s, d):
    return s.createDataFrame([(t, profile.domain_of(read_table(s, d, t).columns)) for t in _DOMAIN_TABLES], "table_name string, domain string")


_WARNED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "test_data": ("row_id", "id", "feed", "load_no")}
_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice", "row_id", "load_no")


def _warning_sql(t: str, c: str) -> str:
    named = c in _NUMERIC and any(w in c for w in ("id", "key", "code", "number"))
    rules = [(f"count({c}) = 0 AND count(*) > 0", "all_missing"), (f"count(DISTINCT {c}) = 1", "constant")] + [("count(*) > 0", "numeric_identifier")] * named
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{name}' AS warning FROM {t} HAVING {rule}" for rule, name in rules)


@query(" UNION ALL ".join(_warning_sql(t, c) for t, cs in _WARNED.items() for c in cs))
def schema_warnings(s, d):
    each = [profile.schema_warnings(read_table(s, d, t), list(cs)).select(F.lit(t).alias("table_name"), "column_name", "warning") for t, cs in _WARNED.items()]
    return each[0].unionByName(each[1])


_TYPED = ("customer_id", "name", "email", "phone", "age", "status", "order_date", "price", "rating", "category")


def _type_sql(c: str) -> str:
    """The cascade of column types for a text column, over its values and its first 100 values."""
    has = lambda *ws: "true" if any(w in c for w in ws) else "false"
    share = lambda p: f"(SELECT avg(regexp_matches({c}, '{p}')::INTEGER) FROM (SELECT {c} FROM order_intake WHERE {c} IS NOT NULL ORDER BY order_no LIMIT 100))"
    u = f"count(DISTINCT {c})"
    return (
        f"SELECT '{c}' AS column_name, CASE WHEN {has('id', 'key', 'hash', 'uuid')} AND ({u} = count(*) OR {u} > 0.95 * count(*)) THEN 'id_hash' WHEN {u} <= 2 AND coalesce(bool_and(lower({c}) IN ('true', 'false', '1', '0', 'yes', 'no', 'y', 'n')), true) THEN 'boolean' "
        f"WHEN {has('email')} OR {share('^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$')} > 0.7 THEN 'email' WHEN {has('phone')} OR {share('[+]?[1-9]?[0-9]{7,15}')} > 0.5 THEN 'phone' WHEN {has('url', 'link')} OR {share('^[A-Za-z][A-Za-z0-9+.-]*://[^/?#[:space:]]+')} > 0.5 THEN 'url' "
        f"WHEN {has('date', 'time', 'created', 'updated')} THEN 'date_datetime' WHEN {has('price', 'cost', 'amount', 'value', 'currency')} THEN 'currency_price' WHEN {has('rating', 'score', 'grade', 'rank')} THEN 'rating_score' WHEN {has('code', 'sku', 'product_id')} THEN 'code' "
        f"WHEN {u} < 50 THEN 'categorical_low' WHEN {u} < 0.1 * count(*) THEN 'categorical_high' ELSE 'free_text' END AS column_type FROM order_intake"
    )


@query(" UNION ALL ".join(map(_type_sql, _TYPED)))
def column_types(s, d):
    return profile.column_types(orders(s, d), ["order_no"], list(_TYPED))


# ---- imputation, outliers, encoding, scaling
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
_ids = _ID.split(", ")
for _s, _agg in (("mean", "avg(qty)"), ("median", "quantile_cont(qty, 0.5)"), ("zero", "0.0")):
    query(M.rstrip() + f", fill AS (SELECT {_agg} AS v FROM m LIMIT 1) SELECT {_ID}, round(coalesce(qty, v), 6) AS qty FROM m, fill", f"impute_{_s}")(lambda s, d, k=_s: (lambda m: prepare.NumericImputer(k).fit(m, ["qty"]).transform(m).select(*_ids, F.round("qty", 6).alias("qty")))(measures(s, d)))


@query("SELECT order_no, coalesce(category, (SELECT category FROM order_intake WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1)) AS category FROM order_intake")
def impute_mode(s, d):
    o = orders(s, d).select("order_no", "category")
    return prepare.CategoryImputer("mode").fit(o, ["category"]).transform(o)


@query("SELECT order_no, coalesce(category, 'unknown') AS category FROM order_intake")
def impute_unknown(s, d):
    o = orders(s, d).select("order_no", "category")
    return prepare.CategoryImputer("unknown").fit(o, ["category"]).transform(o)


@query("SELECT order_no, coalesce(status, 'none given') AS status FROM order_intake")
def impute_default(s, d):
    o = orders(s, d).select("order_no", "status")
    return prepare.CategoryImputer("default", "none given").fit(o, ["status"]).transform(o)


_LAST = "coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY order_no ROWS UNBOUNDED PRECEDING), 'none before') AS {c}"


@query(f"SELECT order_no, price, {_LAST.format(c='category')}, {_LAST.format(c='status')} FROM order_intake")
def impute_forward(s, d):
    return prepare.fill_forward(orders(s, d).select("order_no", "price", "category", "status"), ["category", "status"], "order_no", ["order_no"], "none before")


@query(f"WITH v AS (SELECT order_no, {DATE_SQL} AS x FROM order_intake) SELECT order_no, last_value(x IGNORE NULLS) OVER (ORDER BY order_no ROWS UNBOUNDED PRECEDING) AS x FROM v")
def ffill(s, d):
    return ranges.fill(orders(s, d).select("order_no", C.date(F.col("order_date")).alias("x")), "x", ["order_no"])


@query("SELECT order_no, coalesce(last_value(category IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY order_no ROWS UNBOUNDED PRECEDING), first_value(category IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY order_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS category FROM order_intake")
def ffill_bfill(s, d):
    return ranges.fill(orders(s, d).select("order_no", "customer_id", "category"), "category", ["order_no"], ["customer_id"], backward=True).select("order_no", "category")


_IQR = "b AS (SELECT quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM m)"


@query(M.rstrip() + f", {_IQR} SELECT {_ID}, CASE WHEN qty IS NOT NULL THEN least(greatest(qty, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS qty FROM m, b")
def outlier_cap(s, d):
    m = measures(s, d)
    return prepare.IqrOutliers("cap").fit(m, ["qty"]).transform(m).select(*_ids, "qty")


@query(M.rstrip() + f", {_IQR} SELECT {_ID}, CASE WHEN qty BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN qty END AS qty FROM m, b")
def outlier_remove(s, d):
    m = measures(s, d)
    return prepare.IqrOutliers("remove").fit(m, ["qty"]).transform(m).select(*_ids, "qty")


@query(M.rstrip() + ", b AS (SELECT avg(qty) AS m, stddev_pop(qty) AS s FROM m) SELECT count(*) FILTER (WHERE abs((qty - b.m) / (b.s + 1e-8)) > 3) AS outliers, round(100.0 * avg(coalesce(abs((qty - b.m) / (b.s + 1e-8)) > 3, false)::INTEGER), 6) AS pct FROM m, b")
def outlier_zscore_rows(s, d):
    m = measures(s, d)
    flagged = prepare.ZScoreRows().fit(m, ["qty"]).transform(m)
    return flagged.agg(F.count_if("is_outlier").alias("outliers"), F.round(100.0 * F.avg(F.col("is_outlier").cast("int")), 6).alias("pct"))


@query(M.rstrip() + f", b AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM m) SELECT {_ID}, round((price - b.m) / b.s, 6) AS price FROM m, b")
def standard_scale(s, d):
    m = measures(s, d)
    return prepare.StandardScaler().fit(m, ["price"]).transform(m).select(*_ids, F.round("price", 6).alias("price"))


_LABELS = "WITH l AS (SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code, o_orderpriority AS original_value FROM (SELECT DISTINCT o_orderpriority FROM orders)) "


@query(_LABELS + "SELECT * FROM l")
def label_mapping(s, d):
    return prepare.label_mapping(read_table(s, d, "orders"), "o_orderpriority")


@query(_LABELS + "SELECT o_orderkey, code AS priority_code FROM orders JOIN l ON o_orderpriority = original_value")
def label_encode(s, d):
    o = read_table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.label_encode(o, "o_orderpriority", prepare.label_mapping(o, "o_orderpriority"), "priority_code").drop("o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority AS original_value FROM orders")
def label_decode(s, d):
    o = read_table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    m = prepare.label_mapping(o, "o_orderpriority")
    return prepare.label_decode(prepare.label_encode(o, "o_orderpriority", m, "code"), "code", m).select("o_orderkey", "original_value")


# ---- gates: the limits are parameters; these stand for a user's
def _visit_rules() -> list[gates.Rule]:
    return [gates.in_range("age", 0, 150, clip=True), gates.in_set("gender", ["male", "female", "other"], other="other"), gates.not_null("patient_id")]


_BAD_AGE, _BAD_GENDER, _BAD_ID = "coalesce(NOT age BETWEEN 0 AND 150, true)", "coalesce(NOT gender IN ('male', 'female', 'other'), true)", "patient_id IS NULL"
_BAD = f"({_BAD_AGE} OR {_BAD_GENDER} OR {_BAD_ID})"


@query(f"SELECT 'age_range' AS rule, count(*) FILTER (WHERE {_BAD_AGE}) AS violations FROM patient_visit UNION ALL SELECT 'gender_values', count(*) FILTER (WHERE {_BAD_GENDER}) FROM patient_visit UNION ALL SELECT 'patient_id_not_null', count(*) FILTER (WHERE {_BAD_ID}) FROM patient_visit")
def gate_healthcare(s, d):
    return gates.report(visits(s, d), _visit_rules()).select("rule", "violations")


@query("SELECT 'o_totalprice_range' AS rule, count(*) FILTER (WHERE coalesce(NOT o_totalprice BETWEEN 0 AND 300000, true)) AS violations FROM orders")
def gate_finance(s, d):
    return gates.report(read_table(s, d, "orders"), [gates.in_range("o_totalprice", 0, 300_000)]).select("rule", "violations")


@query("SELECT 'category_values' AS rule, count(*) FILTER (WHERE coalesce(NOT category IN ('garden', 'paper', 'tools'), true)) AS violations FROM order_intake")
def gate_retail(s, d):
    return gates.report(orders(s, d), [gates.in_set("category", ["garden", "paper", "tools"])]).select("rule", "violations")


@query("SELECT visit_no, CASE WHEN age IS NOT NULL THEN least(greatest(age::DOUBLE, 0.0), 150.0) END AS age, CASE WHEN gender IN ('male', 'female', 'other') THEN gender ELSE 'other' END AS gender FROM patient_visit")
def gate_autofix(s, d):
    return gates.fixed(visits(s, d), _visit_rules()).select("visit_no", "age", "gender")


@query(f"SELECT count(*) AS rows, (bool_or({_BAD_AGE})::INTEGER + bool_or({_BAD_GENDER})::INTEGER + bool_or({_BAD_ID})::INTEGER) AS rules_violated, greatest(0.0, (30 - (bool_or({_BAD_AGE})::INTEGER + bool_or({_BAD_GENDER})::INTEGER + bool_or({_BAD_ID})::INTEGER)) / 30.0::DOUBLE) AS quality_score FROM patient_visit")
def gate_score(s, d):
    return gates.score(visits(s, d), _visit_rules())


@query("SELECT visit_no, count(*) OVER (PARTITION BY patient_id) > 1 AND patient_id IS NOT NULL AS repeated FROM patient_visit")
def gate_unique(s, d):
    return gates.violations(visits(s, d), [gates.unique("patient_id")]).select("visit_no", (F.size("violated") > 0).alias("repeated"))


@query(f"SELECT 'high' AS severity, count(*) FILTER (WHERE {_BAD_AGE}) AS n FROM patient_visit UNION ALL SELECT 'medium', count(*) FILTER (WHERE {_BAD_GENDER}) FROM patient_visit UNION ALL SELECT 'critical', count(*) FILTER (WHERE {_BAD_ID}) FROM patient_visit")
def gate_severities(s, d):
    return gates.report(visits(s, d), _visit_rules()).groupBy("severity").agg(F.sum("violations").alias("n"))


_SAMPLES = [("age_range", "age", _BAD_AGE), ("gender_values", "gender", _BAD_GENDER)]


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, coalesce(string_agg(v, '|' ORDER BY v), '') AS samples FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM patient_visit WHERE {bad} AND {c} IS NOT NULL ORDER BY v LIMIT 5)" for rule, c, bad in _SAMPLES))
def gate_samples(s, d):
    return gates.report(visits(s, d), _visit_rules()[:2]).select("rule", F.array_join("samples", "|").alias("samples"))


@query(f"SELECT visit_no, {_BAD} AS quarantined FROM patient_visit")
def quarantine_split(s, d):
    clean, bad = gates.split(visits(s, d), _visit_rules())
    return clean.select("visit_no", F.lit(False).alias("quarantined")).unionByName(bad.select("visit_no", F.lit(True).alias("quarantined")))


@query(f"SELECT visit_no, 'row' AS kind FROM patient_visit WHERE {_BAD} UNION ALL SELECT order_no, 'cell' FROM order_intake WHERE email IS NOT NULL AND ({EMAIL_SQL}) IS NULL")
def quarantine_union(s, d):
    _, bad = gates.split(visits(s, d), _visit_rules())
    cells = orders(s, d).filter(F.col("email").isNotNull() & C.email(F.col("email")).isNull()).select(F.col("order_no").alias("visit_no"), F.lit("cell").alias("kind"))
    return bad.select("visit_no", F.lit("row").alias("kind")).unionByName(cells, allowMissingColumns=True)


@query(f"SELECT visit_no FROM patient_visit WHERE NOT {_BAD_AGE}")
def quarantine_by_id(s, d):
    v = visits(s, d)
    bad = gates.violations(v, [gates.in_range("age", 0, 150)]).filter(F.size("violated") > 0)
    return gates.split_by_id(v, bad, "visit_no")[0].select("visit_no")


# ---- whole runs
@query()
def policy_clean(s, d):
    return policy.clean(orders(s, d), "order_no").cleaned


@query(f"SELECT order_no, 'email' AS column_name, email AS original_value, 'invalid email' AS reason FROM order_intake WHERE email IS NOT NULL AND ({EMAIL_SQL}) IS NULL UNION ALL SELECT order_no, 'phone', phone, 'invalid phone' FROM order_intake WHERE phone IS NOT NULL AND ({PHONE_SQL}) IS NULL")
def policy_quarantine(s, d):
    return policy.clean(orders(s, d), "order_no").quarantined.withColumnRenamed("row_id", "order_no")


_TIDY_SQL = f"WITH v AS (SELECT order_no, {PRICE_SQL} AS price, {RATING_SQL} AS rating, coalesce({STATUS_SQL}, 'unknown') AS status, coalesce(lower(trim(category)), 'unknown') AS category FROM order_intake), b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM v), c AS (SELECT order_no, CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS price, status, category FROM v, b) SELECT order_no, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM c)), 6) AS price, status, category FROM c"


@query(_TIDY_SQL)
def dual_output_tidy(s, d):
    done = pipeline.preprocess(orders(s, d).select(F.col("order_no").cast("string").alias("order_no"), "price", "rating", "status", "category"))
    return done.tidy.select(F.col("order_no").cast("long").alias("order_no"), F.round("price", 6).alias("price"), "status", "category")


@query()
def dual_output_ml(s, d):
    return pipeline.preprocess(orders(s, d), pipeline.Settings(encode=["status", "category"])).ml_ready


def _preprocess_sql() -> str:
    low = lambda c: f"coalesce(lower(trim({c})), 'unknown') AS {c}"
    gender = f"coalesce({_case(synonyms.flat('gender'), 'lower(trim(gender))')}, lower(trim(gender)), 'unknown') AS gender"
    v = f"v AS (SELECT visit_no::DOUBLE AS visit_no, age::DOUBLE AS age, score, {low('patient_id')}, {gender}, {low('symptoms')}, {low('diagnosis')}, {low('medication')}, coalesce({_date_sql('visit_date')}, 'unknown') AS visit_date, coalesce({STATUS_SQL}, 'unknown') AS status FROM patient_visit)"
    ends = ", ".join(f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in ("visit_no", "age", "score"))
    cap = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}1 - 1.5 * ({c}3 - {c}1)), {c}3 + 1.5 * ({c}3 - {c}1)) END AS {c}" for c in ("visit_no", "age", "score"))
    fill = ", ".join(f"round(coalesce(c.{c}, m.{c}), 6) AS {c}" for c in ("visit_no", "age", "score"))
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ("visit_no", "age", "score"))
    text = "patient_id, gender, symptoms, diagnosis, medication, visit_date, status"
    return f"WITH {v}, b AS (SELECT {ends} FROM v), c AS (SELECT {text}, {cap} FROM v, b), m AS (SELECT {medians} FROM c) SELECT {text}, {fill} FROM c, m"


@query(_preprocess_sql())
def preprocess(s, d):
    return pipeline.preprocess(visits(s, d)).tidy.withColumns({c: F.round(c, 6) for c in ("visit_no", "age", "score")})


# ---- text and pages
@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+'))), '|') AS emails FROM documents")
def text_emails(s, d):
    return read_table(s, d, "documents").select("doc_id", F.array_join(X.emails(F.col("text")), "|").alias("emails"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[+]?[0-9][0-9\s-]{7,}[0-9]'))), '|') AS phones FROM documents")
def text_phones(s, d):
    return read_table(s, d, "documents").select("doc_id", F.array_join(X.phones(F.col("text")), "|").alias("phones"))


@query()
def text_nfkc(s, d):
    return read_table(s, d, "test_data").select("row_id", X.nfkc_casefold(F.col("name")).alias("name"))


@query(r"WITH w AS (SELECT result_id, summary, list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '') AS w FROM scraping_result) SELECT result_id, CASE WHEN summary IS NULL THEN NULL WHEN len(w) <= 25 THEN summary ELSE array_to_string(w[1:25], ' ') || '...' END AS summary FROM w")
def text_summary(s, d):
    return read_table(s, d, "scraping_result").select("result_id", X.summary(F.col("summary")).alias("summary"))


@query("SELECT result_id, array_to_string(string_split(summary, '. ')[1:2], ' ') AS start FROM scraping_result")
def text_first_sentences(s, d):
    return read_table(s, d, "scraping_result").select("result_id", X.first_two_sentences(F.col("summary")).alias("start"))


@query(r"SELECT result_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+') AS valid, lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)', 2)) AS host FROM scraping_result")
def url_parts(s, d):
    return read_table(s, d, "scraping_result").select("result_id", X.url_valid(F.col("url")).alias("valid"), X.url_part(F.col("url"), "host").alias("host"))


@query("SELECT count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed FROM scraping_result")
def scrape_counts(s, d):
    return read_table(s, d, "scraping_result").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


# Robots texts made of each page's url, so that rules of several forms occur.
_ROBOTS = "CASE result_id % 5 WHEN 0 THEN concat('User-agent: *', chr(10), '  Disallow: /', split_part(url, '/', 4), ' ') WHEN 1 THEN concat('# ', url, chr(10), 'User-agent: *', chr(10), 'Allow: /') WHEN 2 THEN concat('User-agent: ', split_part(url, '/', 3), chr(10), 'Disallow:', chr(10), 'Sitemap: ', url) WHEN 3 THEN concat('USER-AGENT: *', chr(13), chr(10), 'DISALLOW: /', chr(13), chr(10)) END"


@query(f"SELECT result_id, coalesce(NOT list_bool_or(list_transform(string_split({_ROBOTS}, chr(10)), lambda x: starts_with(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), 'disallow: /'))), true) AS allowed FROM scraping_result")
def robots_check(s, d):
    return read_table(s, d, "scraping_result").select("result_id", X.robots_allows(F.expr(_ROBOTS)).alias("allowed"))


@query("SELECT card_id, coalesce(array_to_string(entities['EMAIL'], ', '), '') AS emails FROM structured_card")
def entity_by_label(s, d):
    return read_table(s, d, "structured_card").select("card_id", html.by_label(F.col("entities"), "EMAIL").alias("emails"))


_HTML = "'<html><head><title> Page ' || CAST(result_id AS VARCHAR(20)) || ' </title></head><body><nav>Menu</nav><h2>About us</h2><p>Founded in the year ' || CAST(result_id AS VARCHAR(20)) || '.</p><p>short</p><h2>Contact</h2><p>Write to desk' || CAST(result_id AS VARCHAR(20)) || '@firm.example now.</p><table><tr><td>a</td><td>' || CAST(result_id AS VARCHAR(20)) || '</td></tr></table></body></html>'"


def _pages(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "scraping_result").select("result_id", "url", F.expr(_HTML).alias("html"))


@query("SELECT result_id, 'Page ' || CAST(result_id AS VARCHAR) AS title FROM scraping_result")
def html_title(s, d):
    return _pages(s, d).select("result_id", html.page(F.col("html"))["title"].alias("title"))


@query("SELECT result_id, 'About us Founded in the year ' || result_id::VARCHAR || '. short Contact Write to desk' || result_id::VARCHAR || '@firm.example now. a ' || result_id::VARCHAR AS raw_text FROM scraping_result")
def html_text(s, d):
    return _pages(s, d).select("result_id", html.page(F.col("html"))["raw_text"].alias("raw_text"))


@query("SELECT url, 'about' AS card_type, 'About us' AS title, 'Founded in the year ' || result_id::VARCHAR || '.' AS content, '' AS emails FROM scraping_result UNION ALL SELECT url, k, 'Contact', 'Write to desk' || result_id::VARCHAR || '@firm.example now.', 'desk' || result_id::VARCHAR || '@firm.example' FROM scraping_result, (VALUES ('contact')) t(k)")
def html_cards(s, d):
    cards = html.explode_cards(html.extract(_pages(s, d)))
    return cards.select("url", "card_type", "title", F.element_at("content", 1).alias("content"), html.by_label(F.col("entities"), "EMAIL").alias("emails"))


@query("SELECT url, 'Founded in the year ' || result_id::VARCHAR || '. Write to desk' || result_id::VARCHAR || '@firm.example now.' AS summary FROM scraping_result")
def html_summary(s, d):
    return html.extract(_pages(s, d)).select("url", "summary")


@query("SELECT result_id, 0 AS table_no, 0 AS row_no, 'a|' || result_id::VARCHAR AS cells FROM scraping_result")
def html_tables(s, d):
    s.udtf.register("html_tables_of", html.HtmlTables)
    return s.sql("SELECT result_id, table_no, row_no, array_join(cells, '|') AS cells FROM {p}, LATERAL html_tables_of(html)", p=_pages(s, d))


# ---- metrics and models
@query(SCORED + "SELECT round(avg((y - p) * (y - p)), 8) AS mse, round(sqrt(avg((y - p) * (y - p))), 8) AS rmse, round(avg(abs(y - p)), 8) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS mape, round(avg(y - p), 8) AS residual_mean, round(stddev_pop(y - p), 8) AS residual_std FROM t")
def metrics_regression(s, d):
    m = metrics.regression(scored(s, d), "y", "p")
    return m.select(*[F.round(c, 6 if c in ("r2", "mape") else 8).alias(c) for c in m.columns])


@query(SCORED + ", c AS (SELECT sum((p >= 0.5)::INT * y)::BIGINT AS tp, sum((p >= 0.5)::INT * (1 - y))::BIGINT AS fp, sum((1 - (p >= 0.5)::INT) * y)::BIGINT AS fn, sum((1 - (p >= 0.5)::INT) * (1 - y))::BIGINT AS tn FROM t) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 8) AS accuracy, round(tp / (tp + fp + 1e-8), 8) AS precision, round(tp / (tp + fn + 1e-8), 8) AS recall FROM c".replace(") , c", "), c"))
def metrics_binary(s, d):
    m = metrics.binary(scored(s, d), "y", "p")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall")])


_PER = ", a AS (SELECT actual AS class, count(*) AS support, count(*) FILTER (WHERE actual = predicted) AS tp FROM t GROUP BY 1), f AS (SELECT predicted AS class, count(*) AS found FROM t GROUP BY 1), j AS (SELECT a.class, support, tp, coalesce(found, 0) AS found FROM a LEFT JOIN f ON a.class = f.class), k AS (SELECT class, support, CASE WHEN found > 0 THEN tp / found::DOUBLE ELSE 0 END AS p, tp / support::DOUBLE AS r FROM j)"


@query(SCORED.rstrip() + _PER + " SELECT class, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) AS f1, support FROM k")
def classification_report(s, d):
    m = metrics.per_class(scored(s, d), "actual", "predicted")
    return m.select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(SCORED.rstrip() + _PER + " SELECT round(sum(r * support) / sum(support), 8) AS accuracy, round(sum(p * support) / sum(support), 8) AS precision FROM k")
def metrics_multiclass(s, d):
    return metrics.multiclass(scored(s, d), "actual", "predicted").select(F.round("accuracy", 8).alias("accuracy"), F.round("precision", 8).alias("precision"))


@query(SCORED + "SELECT actual, predicted, count(*) AS n FROM t GROUP BY 1, 2")
def confusion_matrix(s, d):
    return metrics.confusion(scored(s, d), "actual", "predicted")


@query(SCORED.rstrip() + ", c AS (SELECT actual AS class, count(*) AS n FROM t GROUP BY 1) SELECT class, n, max(n) OVER () / min(n) OVER ()::DOUBLE AS imbalance FROM c")
def class_distribution(s, d):
    return metrics.class_distribution(scored(s, d), "actual")


@query(SCORED + "SELECT least(floor(p * 10) + 1, 10)::INTEGER AS bin, round(avg(p), 8) AS mean_score, round(avg(y), 8) AS positive_share, count(*) AS n FROM t WHERE p BETWEEN 0 AND 1 GROUP BY 1")
def calibration_bins(s, d):
    return metrics.calibration(scored(s, d), "y", "p").withColumns({"mean_score": F.round("mean_score", 8), "positive_share": F.round("positive_share", 8)})


_ROC = ", g AS (SELECT p, sum(y)::BIGINT AS pos, count(*) AS n FROM t GROUP BY 1), r AS (SELECT p, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS tt, sum(n - pos) OVER () AS ff FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query(SCORED.rstrip() + _ROC + " SELECT p AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / tt::DOUBLE, 8) AS tpr, round(fp / ff::DOUBLE, 8) AS fpr FROM r")
def roc_points(s, d):
    return metrics.curve_points(scored(s, d), "y", "p").select("score", "tp", "fp", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(SCORED.rstrip() + _ROC + ", z AS (SELECT fp / ff::DOUBLE - coalesce(lag(fp / ff::DOUBLE) OVER (ORDER BY p DESC), 0) AS dx, (tp / tt::DOUBLE + coalesce(lag(tp / tt::DOUBLE) OVER (ORDER BY p DESC), 0)) / 2 AS h FROM r) SELECT round(sum(dx * h), 8) AS roc_auc FROM z")
def roc_auc(s, d):
    return metrics.auc(metrics.curve_points(scored(s, d), "y", "p")).select(F.round("roc_auc", 8).alias("roc_auc"))


@query("SELECT l_returnflag AS flag, round(count(*) * 0.2)::BIGINT AS test_rows, (count(*) - round(count(*) * 0.2))::BIGINT AS train_rows FROM lineitem GROUP BY 1")
def stratified_split(s, d):
    t = read_table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return models.stratified_split(t, "flag", t.columns[1:]).groupBy("flag").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query()
def train_logreg(s, d):
    t = _numbers(s, d)
    return models.train_classifier(t, "label", ["qty", "price", "discount"]).transform(t).select("label", "prediction").groupBy("label", "prediction").count()


@query()
def train_tree(s, d):
    t = _numbers(s, d)
    return models.importance(models.train_classifier(t, "label", ["qty", "price", "discount"], "tree"), ["qty", "price", "discount"], t)


@query()
def train_ridge(s, d):
    t = _numbers(s, d)
    fitted = models.train_regressor(t, "price", ["qty", "discount", "tax"], "ridge").transform(t)
    return metrics.regression(fitted, "price", "prediction")


@query()
def train_search(s, d):
    best = models.search(_numbers(s, d), "price", ["qty", "discount", "tax"], "ridge", {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, folds=2, sampled=3)
    return metrics.regression(best.bestModel.transform(_numbers(s, d)), "price", "prediction")


@query()
def pca2(s, d):
    return models.pca(_numbers(s, d), ["qty", "price", "discount", "tax"]).select("label", "pc1", "pc2")


# ---- sources and sinks
@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def roundtrip_parquet(s, d):
    return cut(read_table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def roundtrip_csv(s, d):
    path = passing_path(s, "orders")
    o = read_table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    written = io.write(o, f"{path}.csv", "csv")["csv"]
    return io.read(s, written, o.schema)


@query("SELECT count(*) AS rows FROM lineitem")
def row_count(s, d):
    return read_table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT order_no, customer_id, status FROM order_intake ORDER BY order_no LIMIT 20")
def preview(s, d):
    return orders(s, d).orderBy("order_no").limit(20).select("order_no", "customer_id", "status")


@query("SELECT row_id AS _k, name AS customer_name FROM test_data")
def normalise_headers(s, d):
    return io.normalise_headers(read_table(s, d, "test_data").select(F.col("row_id").alias(" _K "), F.col("name").alias("Customer Name")))


@query(SCORED.rstrip() + _ROC + ", z AS (SELECT (tp / tt::DOUBLE - coalesce(lag(tp / tt::DOUBLE) OVER (ORDER BY p DESC), 0)) * (tp / (tp + fp)::DOUBLE) AS a FROM r) SELECT round(sum(a), 8) AS pr_auc FROM z")
def pr_auc(s, d):
    return metrics.average_precision(metrics.curve_points(scored(s, d), "y", "p")).select(F.round("pr_auc", 8).alias("pr_auc"))


@query(SCORED + "SELECT least(min(y), min(p)) AS lo, greatest(max(y), max(p)) AS hi FROM t")
def common_range(s, d):
    return metrics.common_range(scored(s, d), "y", "p")


@query(f"WITH v AS (SELECT order_no, {DATE_SQL} AS x FROM order_intake), m AS (SELECT strftime(DATE '1970-01-01' + floor(quantile_cont(datediff('day', DATE '1970-01-01', CAST(x AS DATE)), 0.5))::INTEGER, '%Y-%m-%d') AS m FROM v) SELECT order_no, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY order_no ROWS UNBOUNDED PRECEDING), m) AS x FROM v, m")
def impute_dates(s, d):
    return profile.fill_dates(orders(s, d).select("order_no", C.date(F.col("order_date")).alias("x")), "x", ["order_no"])


@query("SELECT count(DISTINCT customer_id) / count(customer_id)::DOUBLE AS unique_ratio FROM order_intake")
def unique_ratio(s, d):
    return profile.unique_ratio(orders(s, d), "customer_id")


_TARGETS = ("order_intake", "patient_visit", "orders", "lineitem", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, coalesce(max_by(column_name, k) FILTER (WHERE column_type = 'VARCHAR'), max_by(column_name, k)) AS target FROM (SELECT *, row_number() OVER () AS k FROM (DESCRIBE {t}))" for t in _TARGETS))
def default_target(s, d):
    return s.createDataFrame([(t, profile.default_target(read_table(s, d, t))) for t in _TARGETS], "table_name string, target string")


@query("SELECT card_id, value FROM (SELECT card_id, unnest(entities['EMAIL']) AS value FROM structured_card)")
def entity_values(s, d):
    return read_table(s, d, "structured_card").select("card_id", F.explode(F.try_element_at("entities", F.lit("EMAIL"))).alias("value"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 30)) AS lines FROM documents")
def text_long_lines(s, d):
    return read_table(s, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(X.long_lines(F.col("text")))).cast("long").alias("lines"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '), 1, 300) AS start FROM documents")
def text_clean(s, d):
    return read_table(s, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("start"))


@query("SELECT feed, load_no, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE updated_at > loaded_at) AS ahead FROM test_data GROUP BY 1, 2")
def load_counts(s, d):
    t = read_table(s, d, "test_data")
    return t.groupBy("feed", "load_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("updated_at") > F.col("loaded_at")).alias("ahead"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start FROM events GROUP BY 1, 4")
def windowed_events(s, d):
    w = windows.windowed(read_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 day")
    return w.select("event_type", "n", F.round("total", 4).alias("total"), F.col("window_start").cast("timestamp_ntz").alias("window_start"))


# ---- the column-level profile
@query(quality.ISSUES_SQL)
def p3_found(s, d):
    return quality.load_issues(s, f"{d}/test_data.parquet")


@query(quality.PROFILE_SQL)
def p3_profile(s, d):
    return quality.table_profile(s, f"{d}/test_data.parquet", ["row_id", "feed", "load_no", "age", "email", "status"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
