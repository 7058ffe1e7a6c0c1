"""Scalar functions: text, time, numbers, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, statement
from ..tables import table

statement(
    "str_basic",
    "SELECT c_custkey, substring(c_name, 1, 4) AS head, lower(c_name) AS low, cast(length(c_name) AS bigint) AS n, lpad(cast(c_custkey AS string), 8, '0') AS padded, c_mktsegment || '/' || c_name AS joined, trim('  x ') AS x, cast(levenshtein(c_mktsegment, 'BUILDING') AS bigint) AS d, replace(c_name, '#', '-') AS dashed, reverse(c_name) AS back, c_name LIKE '%9' AS nine, repeat('ab', 2) AS abab, concat_ws(',', c_mktsegment, c_name) AS listed, translate(c_mktsegment, 'AEI', 'aei') AS small FROM customer",
    "SELECT c_custkey, substring(c_name, 1, 4) AS head, lower(c_name) AS low, length(c_name) AS n, lpad(c_custkey::VARCHAR, 8, '0') AS padded, c_mktsegment || '/' || c_name AS joined, trim('  x ') AS x, levenshtein(c_mktsegment, 'BUILDING') AS d, replace(c_name, '#', '-') AS dashed, reverse(c_name) AS back, c_name LIKE '%9' AS nine, repeat('ab', 2) AS abab, concat_ws(',', c_mktsegment, c_name) AS listed, translate(c_mktsegment, 'AEI', 'aei') AS small FROM customer",
)
statement("str_bytes", "SELECT doc_id, cast(octet_length(text) AS bigint) AS bytes, cast(char_length(text) AS bigint) AS chars FROM documents", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
statement(
    "str_regex",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS starred, regexp_extract(p_name, '([0-9]+)', 1) AS digits, p_name RLIKE '[0-9]{2}$' AS two, cast(regexp_count(p_name, '[a-z]') AS bigint) AS letters FROM part",
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred, regexp_extract(p_name, '([0-9]+)', 1) AS digits, regexp_matches(p_name, '[0-9]{2}$') AS two, len(regexp_extract_all(p_name, '[a-z]')) AS letters FROM part",
)
statement("str_split", "SELECT url, split_part(url, '/', 3) AS host, cast(size(split(url, '/')) AS bigint) AS parts FROM pages", "SELECT url, split_part(url, '/', 3) AS host, len(string_split(url, '/')) AS parts FROM pages")
statement("str_hash", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
statement(
    "date_parts",
    "SELECT event_id, cast(year(ts) AS bigint) AS y, cast(month(ts) AS bigint) AS m, cast(day(ts) AS bigint) AS d, cast(hour(ts) AS bigint) AS h, cast(quarter(ts) AS bigint) AS q, cast(weekofyear(ts) AS bigint) AS w, cast(dayofweek(ts) - 1 AS bigint) AS dow, cast(dayofyear(ts) AS bigint) AS doy FROM events",
    "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, quarter(ts) AS q, weekofyear(ts) AS w, dayofweek(ts) AS dow, dayofyear(ts) AS doy FROM events",
)
statement(
    "date_arith",
    "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS next_month, cast(datediff(DATE '2002-01-01', cast(o_orderdate AS date)) AS bigint) AS days, last_day(cast(o_orderdate AS date)) AS month_end FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS next_month, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days, last_day(o_orderdate::DATE) AS month_end FROM orders",
)
statement(
    "date_fmt_epoch",
    "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS shown, unix_micros(cast(ts AS timestamp)) AS micros FROM events",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, epoch_us(ts) AS micros FROM events",
)
statement("date_trunc", "SELECT event_id, cast(date_trunc('DAY', ts) AS timestamp_ntz) AS day, cast(date_trunc('MONTH', ts) AS timestamp_ntz) AS month FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('month', ts)::TIMESTAMP AS month FROM events")
statement(
    "date_parse",
    "SELECT o_orderkey, to_timestamp_ntz(concat(date_format(o_orderdate, 'dd/MM/yyyy'), ' 10:07'), 'dd/MM/yyyy HH:mm') AS t, make_date(year(o_orderdate), month(o_orderdate), 1) AS d FROM orders",
    "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y') || ' 10:07', '%d/%m/%Y %H:%M') AS t, make_date(year(o_orderdate), month(o_orderdate), 1) AS d FROM orders",
)
statement("math", "SELECT p_partkey, round(sqrt(p_size), 9) AS root, round(ln(p_size), 9) AS log, round(power(p_size, 1.5), 6) AS p, cast(floor(p_retailprice) AS bigint) AS f, cast(ceil(p_retailprice) AS bigint) AS c, cast(sign(p_size - 25) AS bigint) AS s, abs(p_size - 25) AS a, round(exp(p_size / 50.0), 9) AS e FROM part")
statement("bits", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, cast(bit_count(p_size) AS bigint) AS n FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, bit_count(p_size)::BIGINT AS n FROM part")
statement("json_path", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
statement("json_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM events", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")


@query(
    "SELECT o_orderkey, o_orderkey + 1 AS key, o_orderpriority AS second, [o_orderstatus, o_orderpriority] AS parts, o_orderstatus = 'F' AS done FROM orders",
)
def xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, a string, a list and a test, out of XML that each order is written as.

    Each call of an xpath function parses the document anew, which is nearly all that it costs. So one call fetches the key, the elements p
    (null, as they have no value of their own), what elements they hold (null) and their texts, in the document's order. Where both p hold
    one text and nothing else, that tells the rest; other documents (an empty p, say) are asked again.
    """
    document = F.expr("""concat('<o key="', o_orderkey + 1, '"><p>', o_orderstatus, '</p><p>', o_orderpriority, '</p></o>')""")
    x, nodes = F.col("x"), F.col("nodes")
    key, p1, first, p2, second = (F.get(nodes, F.lit(i)) for i in range(5))
    plain = (F.size(nodes) == 5) & p1.isNull() & first.isNotNull() & p2.isNull() & second.isNotNull()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", document.alias("x")).withColumn("nodes", F.xpath(x, F.lit("o/@key | o/p | o/p/* | o/p/text()")))
    return orders.select(
        "o_orderkey",
        key.cast("long").alias("key"),
        F.when(plain, second).otherwise(F.xpath_string(x, F.lit("o/p[2]"))).alias("second"),
        F.filter(F.slice(nodes, 2, F.size(nodes)), lambda v: v.isNotNull()).alias("parts"),
        F.when(plain, (first == "F") | (second == "F")).otherwise(F.xpath_boolean(x, F.lit('o/p = "F"'))).alias("done"),
    )


statement("try_functions", "SELECT p_partkey, try_divide(p_size, p_size - 10) AS q, try_cast(p_name AS bigint) AS n FROM part", "SELECT p_partkey, p_size / nullif(p_size - 10, 0) AS q, try_cast(p_name AS BIGINT) AS n FROM part")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS norm, embedding[1:3] AS head, round(list_dot_product(embedding[1:4]::DOUBLE[], embedding[5:8]::DOUBLE[]), 9) AS dot FROM embeddings")
def array_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    square = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    dot = F.aggregate(F.zip_with(F.slice(e, 1, 4), F.slice(e, 5, 4), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.round(square, 6).alias("norm"), F.slice(e, 1, 3).alias("head"), F.round(dot, 9).alias("dot"))


@query("SELECT n_nationkey, n_name AS \"name\", n_regionkey + 1 AS next FROM nation")
def map_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_from_entries(F.array(F.struct(F.lit("name"), F.col("n_name"))))
    both = F.struct(F.col("n_regionkey").alias("region"), pairs.alias("pairs"))
    return table(spark, sf_dir, "nation").select("n_nationkey", both.alias("b")).select("n_nationkey", F.col("b.pairs")["name"].alias("name"), (F.col("b.region") + 1).alias("next"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, event_type || ':' || (props::JSON ->> '$.k') AS tag FROM events")
def json_from_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.concat_ws(":", "event_type", F.get_json_object(F.to_json(parsed), "$.k")).alias("tag"))


@query("SELECT n_nationkey, n_regionkey + 10 AS ten, [n_nationkey, n_regionkey, 1, 2] AS flat, list_sort([n_nationkey, 7, n_regionkey]) AS ordered, list_contains([1, 2, 3], n_regionkey) AS low FROM nation")
def array_map_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    tens = F.transform_values(F.create_map(F.lit("r"), r), lambda k, v: v + 10)
    flat = F.flatten(F.array(F.array(n, r), F.array(F.lit(1), F.lit(2))))
    low = F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), r)
    return table(spark, sf_dir, "nation").select("n_nationkey", tens["r"].alias("ten"), flat.alias("flat"), F.array_sort(F.array(n, F.lit(7), r)).alias("ordered"), low.alias("low"))


@query("SELECT n_nationkey, k, v FROM (SELECT n_nationkey, unnest(['name', 'region']) AS k, unnest([n_name, n_regionkey::VARCHAR]) AS v FROM nation)")
def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.stack(F.lit(2), F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("k", "v"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, url_encode(url) AS encoded, 'R163' AS sound, 'Xxnn' AS masked, 'x' AS b, true AS same FROM pages")
def str_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of text that have no equal in DuckDB, of values whose results are known."""
    p, url = table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.url_encode(url).alias("encoded"), F.soundex(F.lit("Robert")).alias("sound"), F.mask(F.lit("Ab12")).alias("masked"), F.xpath_string(F.lit("<a><b>x</b></a>"), F.lit("a/b")).alias("b"), F.collate(url, "UTF8_LCASE").eqNullSafe(F.upper(url)).alias("same"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, 'STRUCT<k: BIGINT>' AS shape, (props::JSON ->> '$.k')::BIGINT AS from_xml FROM events")
def json_xml_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_tuple, schema_of_json, from_xml."""
    e = table(spark, sf_dir, "events")
    read = e.select("event_id", F.json_tuple("props", "k").alias("k"), F.schema_of_json(F.lit('{"k": 1}')).alias("shape"))
    xml = F.from_xml(F.concat(F.lit("<r><k>"), "k", F.lit("</k></r>")), "k long")
    return read.select("event_id", F.col("k").cast("long").alias("k"), "shape", xml["k"].alias("from_xml"))


@query("SELECT n_nationkey, n_regionkey + n_nationkey AS both, 'R' AS name, n_nationkey AS zipped, TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 MONTH AS later, NULL::TIMESTAMP AS never FROM nation")
def map_time_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_zip_with, transform_keys, arrays_zip, make_interval, try_to_timestamp."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    both = F.map_zip_with(F.create_map(F.lit("r"), n), F.create_map(F.lit("r"), r), lambda k, x, y: x + y)
    name = F.element_at(F.map_keys(F.transform_keys(F.create_map(F.lit("r"), r), lambda k, v: F.upper(k))), 1)
    zipped = F.arrays_zip(F.array(n).alias("a"), F.array(r).alias("b"))[0]["a"]
    later = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") + F.make_interval(months=F.lit(1))
    never = F.try_to_timestamp(F.lit("no time"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return table(spark, sf_dir, "nation").select("n_nationkey", both["r"].alias("both"), name.alias("name"), zipped.alias("zipped"), later.alias("later"), never.alias("never"))


@query("SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS a, unnest(['r', 'n']) AS b FROM nation")
def inline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.inline(F.array(F.struct(F.col("n_regionkey").alias("a"), F.lit("r").alias("b")), F.struct(F.col("n_nationkey").alias("a"), F.lit("n").alias("b")))))


statement("str_collate", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building' GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_mktsegment")
