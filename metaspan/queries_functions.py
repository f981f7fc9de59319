"""Queries over the scalar-function families, several functions each, and over the functions of other dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaspan.functions import dialects as D
from metaspan.queries_relational import ORACLES as _REL_ORACLES
from metaspan.queries_relational import QUERIES as _RELATIONAL
from metaspan.queries_relational import Tables
from metaspan.queries_relational import sql as _sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    _sql(name, spark_sql, oracle)
    QUERIES[name], ORACLES[name] = _RELATIONAL.pop(name), _REL_ORACLES.pop(name)


def query(oracle: str):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = oracle
        return f

    return wrap


sql("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, substring(p_name, 2, 3) AS s, trim('  ' || p_brand || ' ') AS t, replace(p_name, 'a', 'A') AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat('ab', p_size % 3) AS rep, reverse(p_brand) AS rev, concat_ws('/', p_brand, p_type) AS c FROM {part}")
sql("fn_string_search", "SELECT p_partkey, instr(p_name, 'e') AS i, contains(p_name, 'a') AS c, startswith(p_name, 'b') AS s, endswith(p_name, 'd') AS e, split_part(p_name, ' ', 1) AS part, left(p_name, 3) AS l, right(p_name, 2) AS r, ascii(p_name) AS a, translate(p_name, 'abc', 'xyz') AS tr FROM {part}", "SELECT p_partkey, instr(p_name, 'e') AS i, contains(p_name, 'a') AS c, starts_with(p_name, 'b') AS s, ends_with(p_name, 'd') AS e, split_part(p_name, ' ', 1) AS part, left(p_name, 3) AS l, right(p_name, 2) AS r, ascii(p_name) AS a, translate(p_name, 'abc', 'xyz') AS tr FROM part")
sql("fn_regexp", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS r, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS e, regexp_count(p_name, '[aeiou]') AS n FROM {part}", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS e, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS n FROM part")
sql("fn_hash", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s, hex(p_brand) AS h, base64(CAST(p_brand AS BINARY)) AS b FROM {part}", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, hex(p_brand) AS h, to_base64(p_brand::blob) AS b FROM part")
sql("fn_math", "SELECT o_orderkey, abs(-o_totalprice) AS a, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, sign(o_totalprice) AS s, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice + 1), 6) AS l, round(exp(o_orderkey % 5), 6) AS e, power(2, o_orderkey % 10) AS p, o_orderkey % 7 AS m, round(sin(o_orderkey), 6) AS si, greatest(o_orderkey, 100) AS g, least(o_orderkey, 100) AS le FROM {orders}", "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(sign(o_totalprice) AS DOUBLE) AS s, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice + 1), 6) AS l, round(exp(o_orderkey % 5), 6) AS e, power(2, o_orderkey % 10) AS p, o_orderkey % 7 AS m, round(sin(o_orderkey), 6) AS si, greatest(o_orderkey, 100) AS g, least(o_orderkey, 100) AS le FROM orders")
sql("fn_bits", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1 AS o, o_orderkey ^ 3 AS x, shiftleft(o_orderkey, 2) AS l, shiftright(o_orderkey, 1) AS r, bit_count(o_orderkey) AS n FROM {orders}", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1 AS o, xor(o_orderkey, 3) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, CAST(bit_count(o_orderkey) AS INTEGER) AS n FROM orders")
sql("fn_null", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS c, ifnull(nullif(value, 0), -1) AS i, nvl2(nullif(event_type, 'view'), 1, 0) AS n2, isnull(nullif(event_type, 'click')) AS isn FROM {events}", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS c, ifnull(nullif(value, 0), -1) AS i, CASE WHEN nullif(event_type, 'view') IS NOT NULL THEN 1 ELSE 0 END AS n2, nullif(event_type, 'click') IS NULL AS isn FROM events")
sql("fn_date_parts", "SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofyear(ts) AS doy, weekofyear(ts) AS w, extract(DAY FROM ts) AS ed FROM {events}", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(weekofyear(ts) AS INTEGER) AS w, CAST(extract(DAY FROM ts) AS INTEGER) AS ed FROM events")
sql("fn_date_arithmetic", "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS a, date_sub(CAST(o_orderdate AS DATE), 3) AS s, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS d, add_months(CAST(o_orderdate AS DATE), 2) AS m, last_day(CAST(o_orderdate AS DATE)) AS l, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS t, date_format(o_orderdate, 'yyyy-MM') AS f FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate AS DATE) - 3 AS s, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS l, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, strftime(o_orderdate, '%Y-%m') AS f FROM orders")
sql("fn_array", "SELECT p_partkey, size(a) AS n, array_contains(a, 'red') AS c, array_position(a, 'blue') AS p, array_distinct(concat(a, a)) AS d, sort_array(a) AS s, array_max(a) AS mx, array_join(reverse(a), '-') AS r, slice(a, 1, 1) AS sl, element_at(a, 1) AS e, flatten(array(a, a)) AS f FROM (SELECT p_partkey, split(p_name, ' ') AS a FROM {part})", "SELECT p_partkey, CAST(len(a) AS INTEGER) AS n, list_contains(a, 'red') AS c, coalesce(CAST(list_position(a, 'blue') AS BIGINT), 0) AS p, list_distinct_ordered AS d, list_sort(a) AS s, list_max(a) AS mx, array_to_string(list_reverse(a), '-') AS r, a[1:1] AS sl, a[1] AS e, flatten([a, a]) AS f FROM (SELECT p_partkey, a, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part))")
sql("fn_array_sets", "SELECT p_partkey, sort_array(array_union(a, b)) AS u, sort_array(array_intersect(a, b)) AS i, sort_array(array_except(a, b)) AS e, arrays_overlap(a, b) AS o FROM (SELECT p_partkey, split(p_name, ' ') AS a, split('red blue green', ' ') AS b FROM {part})", "SELECT p_partkey, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_distinct(list_intersect(a, b))) AS i, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS e, list_has_any(a, b) AS o FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'blue', 'green'] AS b FROM part)")
sql("fn_map", "SELECT p_partkey, m['brand'] AS b, size(m) AS n, sort_array(map_keys(m)) AS k, map_contains_key(m, 'type') AS h FROM (SELECT p_partkey, map('brand', p_brand, 'type', p_type) AS m FROM {part})", "SELECT p_partkey, p_brand AS b, 2 AS n, ['brand', 'type'] AS k, true AS h FROM part")
sql("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, to_json(named_struct('e', event_id)) AS j, json_array_length('[1,2,3]') AS n FROM {events}", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"e\":' || event_id || '}' AS j, 3 AS n FROM events")
sql("fn_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM {events}", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
sql("fn_try", "SELECT p_partkey, try_divide(p_size, p_size % 3) AS d, try_cast(p_brand AS INT) AS c, try_element_at(split(p_name, ' '), 9) AS e, try_add(p_size, 1) AS a FROM {part}", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size / (p_size % 3) END AS d, try_cast(p_brand AS INTEGER) AS c, string_split(p_name, ' ')[9] AS e, p_size + 1 AS a FROM part")
sql("fn_url", "SELECT page_id, parse_url(split(url, '[?#]')[0], 'HOST') AS h, url_encode('a b') AS e FROM {pages}", "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS h, 'a+b' AS e FROM pages")
sql("fn_sequence", "SELECT n_nationkey, size(sequence(0, n_nationkey)) AS n, aggregate(sequence(0, n_nationkey), 0, (a, x) -> a + x) AS s FROM {nation}", "SELECT n_nationkey, n_nationkey + 1 AS n, n_nationkey * (n_nationkey + 1) // 2 AS s FROM nation")
sql("fn_predicates_hof", "SELECT vec_id, exists(embedding, x -> x > 0.3) AS e, forall(embedding, x -> x > -5) AS f, size(zip_with(embedding, embedding, (x, y) -> x * y)) AS z FROM {embeddings}", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS e, len(list_filter(embedding, lambda x: x > -5)) = len(embedding) AS f, CAST(len(embedding) AS INTEGER) AS z FROM embeddings")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS i, coalesce(nullif(p_size, 7), 0) AS z, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size / (p_size % 3) END AS d0, CASE WHEN p_size % 3 <> 0 THEN p_size / (p_size % 3) END AS sd, CASE WHEN p_size % 4 <> 0 THEN (p_size - 25) // (p_size % 4) END IS NULL AS q FROM part")
def dialect_conditionals(t):
    x, y = F.col("p_size"), F.col("p_size") % 3
    return t.part.select("p_partkey", D.iff(x > 20, F.lit("big"), F.lit("small")).alias("i"), D.zeroifnull(F.nullif(x, F.lit(7))).alias("z"), D.div0(x, y).alias("d0"), D.safe_divide(x, y).alias("sd"), D.integer_divide(x - 25, x % 4).isNull().alias("q"))


@query("SELECT p_partkey, strpos(p_name, 'e') AS sp, CASE WHEN p_brand = 'Brand#11' THEN 1 WHEN p_brand = 'Brand#12' THEN 2 ELSE 0 END AS dc, upper(substr(split_part(p_name, ' ', 1), 1, 1)) = substr(upper(p_name), 1, 1) AS ini FROM part")
def dialect_strings(t):
    dc = D.decode(F.col("p_brand"), F.lit("Brand#11"), F.lit(1), F.lit("Brand#12"), F.lit(2), F.lit(0))
    return t.part.select("p_partkey", D.translate("strpos", F.col("p_name"), F.lit("e")).alias("sp"), dc.alias("dc"), (F.substring(D.initials(F.col("p_name")), 1, 1) == F.substring(F.upper("p_name"), 1, 1)).alias("ini"))


@query("SELECT event_id, time_bucket(INTERVAL '900 seconds', ts) AS b, date_diff('month', TIMESTAMP '2020-01-15', ts) AS m, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS h FROM events")
def dialect_times(t):
    since = lambda s: F.lit(s).cast("timestamp_ntz")
    m, h = D.datediff("month", since("2020-01-15 00:00:00"), F.col("ts")), D.datediff("hour", since("2024-01-01 00:30:00"), F.col("ts"))
    return t.events.select("event_id", D.time_bucket(900, F.col("ts")).alias("b"), m.cast("bigint").alias("m"), h.alias("h"))


@query("SELECT n_nationkey, generate_series(n_nationkey, 20, 5) AS g, list_has_all([1, 2, 3, n_nationkey], [2, n_nationkey]) AS h FROM nation")
def dialect_lists(t):
    k = F.col("n_nationkey").cast("bigint")
    return t.nation.select("n_nationkey", D.generate_series(k, F.lit(20).cast("bigint"), F.lit(5).cast("bigint")).alias("g"), D.list_contains_all(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3)], k), F.array(F.lit(2).cast("bigint"), k)).alias("h"))


sql("fn_binary", "SELECT p_partkey, hex(unhex(hex(p_name))) AS h, base64(encode(p_name, 'UTF-8')) AS b, decode(unbase64(base64(CAST(p_type AS BINARY))), 'UTF-8') AS u, octet_length(to_binary(p_brand, 'UTF-8')) AS n FROM {part}", "SELECT p_partkey, hex(p_name) AS h, to_base64(encode(p_name)) AS b, p_type AS u, CAST(strlen(p_brand) AS INTEGER) AS n FROM part")
sql("fn_intervals", "SELECT o_orderkey, o_orderdate + make_interval(0, 1, 0, CAST(o_orderkey % 9 AS INT)) AS a, o_orderdate - make_dt_interval(1, 2, 3, 4) AS d, o_orderdate + make_ym_interval(1, 2) AS y, CAST(extract(DAYS FROM make_dt_interval(3, 30)) AS INT) AS e FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS TIMESTAMP) AS a, CAST(o_orderdate - INTERVAL '1 day 02:03:04' AS TIMESTAMP) AS d, CAST(o_orderdate + INTERVAL 14 MONTH AS TIMESTAMP) AS y, 4 AS e FROM orders")
sql("fn_crypto", "SELECT p_partkey, sha1(p_name) AS s, CAST(aes_decrypt(aes_encrypt(p_name, '0000111122223333'), '0000111122223333') AS STRING) AS a, crc32(p_name) = crc32(concat(p_name, '')) AS c, CAST(try_aes_decrypt(unhex('00'), '0000111122223333') AS STRING) AS t FROM {part}", "SELECT p_partkey, sha1(p_name) AS s, p_name AS a, true AS c, CAST(NULL AS VARCHAR) AS t FROM part")
sql("fn_session", "SELECT current_user() = user() AS u, length(uuid()) AS n, typeof(current_database()) AS d, current_catalog() IS NOT NULL AS c, version() IS NOT NULL AS v, current_timezone() IS NOT NULL AS z", "SELECT true AS u, 36 AS n, 'string' AS d, true AS c, true AS v, true AS z")
sql("fn_bitmap", "SELECT l_returnflag, sum(c) AS n FROM (SELECT l_returnflag, bitmap_bucket_number(l_partkey) AS b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_partkey))) AS c FROM {lineitem} GROUP BY 1, 2) GROUP BY l_returnflag", "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n FROM lineitem GROUP BY 1")
sql("fn_csv_xml", "SELECT p_partkey, from_csv(concat(p_partkey, ',', p_name), 'k INT, n STRING').n AS c, to_csv(named_struct('a', p_partkey, 'b', p_name)) AS t, xpath_string(concat('<p><n>', p_name, '</n></p>'), 'p/n') AS x FROM {part}", "SELECT p_partkey, p_name AS c, p_partkey || ',' || p_name AS t, p_name AS x FROM part")
sql("fn_histogram", "SELECT l_returnflag, CAST(aggregate(h, 0D, (a, x) -> a + x.y) AS BIGINT) AS n, size(h) AS bins FROM (SELECT l_returnflag, histogram_numeric(l_quantity, 5) AS h FROM {lineitem} GROUP BY 1)", "SELECT l_returnflag, count(*) AS n, 5 AS bins FROM lineitem GROUP BY 1")
sql("fn_misc", "SELECT p_partkey, typeof(p_size) AS t, luhn_check(concat('7992739871', p_size % 10)) AS l, equal_null(nullif(p_size, 7), NULL) AS q, elt(1 + p_size % 2, p_name, p_type) AS e, width_bucket(p_size, 0, 50, 5) AS w, nvl(nullif(p_size, 3), -1) AS v FROM {part}", "SELECT p_partkey, 'int' AS t, p_size % 10 = 3 AS l, p_size = 7 AS q, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS e, CASE WHEN p_size >= 50 THEN 6 ELSE p_size // 10 + 1 END AS w, CASE WHEN p_size = 3 THEN -1 ELSE p_size END AS v FROM part")
sql("fn_timestamps", "SELECT event_id, CAST(to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS STRING) AS s, CAST(make_timestamp_ntz(year(ts), month(ts), 1, 0, 0, 0) AS STRING) AS m, unix_timestamp(CAST(ts AS TIMESTAMP)) AS u, CAST(CAST(timestamp_seconds(unix_timestamp(CAST(ts AS TIMESTAMP))) AS TIMESTAMP_NTZ) AS STRING) AS b, CAST(date_part('SECOND', date_trunc('SECOND', ts)) AS INT) AS p FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS m, CAST(floor(epoch(ts)) AS BIGINT) AS u, strftime(ts, '%Y-%m-%d %H:%M:%S') AS b, CAST(second(ts) AS INTEGER) AS p FROM events")
sql("fn_regression", "SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(regr_avgx(l_extendedprice, l_quantity), 6) AS x FROM {lineitem} GROUP BY 1")


@query("SELECT n_nationkey, CAST(d AS VARCHAR) AS dialect, CASE WHEN d IN ('tsql', 'redshift', 'postgres', 'trino', 'sqlite') THEN CAST((n_nationkey * 7) // 4 AS DOUBLE) WHEN d = 'mysql' THEN round(n_nationkey * 7 / 4, 4) WHEN d = 'snowflake' THEN round(n_nationkey * 7 / 4, 6) ELSE n_nationkey * 7 / 4 END AS q, d IN ('databricks', 'tsql', 'bigquery', 'sqlite', 'mysql') AS nulls_first FROM nation, (VALUES ('databricks'), ('tsql'), ('snowflake'), ('bigquery'), ('redshift'), ('postgres'), ('duckdb'), ('trino'), ('sqlite'), ('mysql')) v(d)")
def dialect_behaviour(t):
    rows = None
    for d, b in D.BEHAVIOUR.items():
        one = t.nation.select("n_nationkey", F.lit(d).alias("dialect"), D.divide(d, F.col("n_nationkey") * 7, F.lit(4)).alias("q"), F.lit(b.nulls == "first").alias("nulls_first"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT p_partkey, chr(39) || replace(p_name || CASE WHEN p_size % 2 = 0 THEN chr(39) || 's' ELSE '' END, chr(39), chr(39) || chr(39)) || chr(39) AS q, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS i, printf('%05d|%s', p_partkey, p_name) AS f FROM part")
def dialect_sqlite(t):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "'s").otherwise(""))
    return t.part.select("p_partkey", D.sqlite_quote(name).alias("q"), D.iff(F.col("p_size") > 25, F.lit("big"), F.lit("small")).alias("i"), F.format_string("%05d|%s", "p_partkey", "p_name").alias("f"))
