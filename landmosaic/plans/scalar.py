"""Queries over the scalar functions, one for each family of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions import text
from landmosaic.plans.reference import BOX, PTS, Tables, at_, c, lit, q, r6

_TRIM = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CLEAN = f"CASE WHEN {_TRIM} NOT IN ('', 'NA', 'NULL', 'null') THEN {_TRIM} END"
_AT = "epoch_us(ingested_at) AS at"
_MISSING = ("NA", "NULL", "null")

q("F01", f"SELECT poi_id, {_AT}, {_CLEAN.format('name')} AS name FROM korea_pois_point")(lambda t: t.korea_pois_point.select("poi_id", at_(), text.clean("name", _MISSING).alias("name")))
q("F02", f"SELECT poi_id, {_AT}, coalesce({', '.join(f'nullif({_TRIM.format(x)}, {chr(39) * 2})' for x in ('addr_street', 'phone', 'name'))}) AS first, coalesce(x, -1) AS x FROM korea_pois_point")(
    lambda t: t.korea_pois_point.select("poi_id", at_(), text.first_text("addr_street", "phone", "name").alias("first"), F.coalesce("x", lit(-1.0)).alias("x"))
)
q("F03", f"SELECT poi_id, {_AT}, coalesce(poi_class, 'NA') || '|' || coalesce(name, 'NA') AS key, printf('%06d', CAST(floor(x) % 1000000 AS BIGINT)) AS code FROM korea_pois_point WHERE x IS NOT NULL AND NOT isnan(x)")(
    lambda t: t.korea_pois_point.where(text.finite("x")).select("poi_id", at_(), text.pasted("|", "poi_class", "name").alias("key"), F.format_string("%06d", F.floor("x") % 1000000).alias("code"))
)
q(
    "F04",
    r"SELECT DISTINCT source_shp, regexp_matches(source_shp, '(?i)uq[a-z]') AS layered, CASE WHEN regexp_matches(source_shp, '_(\d{5})') THEN regexp_extract(source_shp, '_(\d{5})', 1) ELSE source_shp END AS region, array_to_string(regexp_extract_all(source_shp, '\d+'), ',') AS numbers, regexp_full_match(source_shp, '[A-Za-z0-9_.]+') AS plain FROM togieeum_polygon_pois WHERE source_shp IS NOT NULL",
)(
    lambda t: t.togieeum_polygon_pois.where("source_shp IS NOT NULL").select("source_shp").distinct().select(
        "source_shp", c("source_shp").rlike("(?i)uq[a-z]").alias("layered"), text.sub_first("source_shp", r"_(\d{5})").alias("region"),
        F.array_join(F.regexp_extract_all("source_shp", lit(r"\d+"), lit(0)), ",").alias("numbers"), c("source_shp").rlike("^[A-Za-z0-9_.]+$").alias("plain"),
    )
)
_PATH = "source_zip || '/' || source_shp"
q(
    "F05",
    rf"SELECT DISTINCT source_zip, source_shp, regexp_replace({_PATH}, '^.*[/\\]', '') AS base, regexp_replace(regexp_replace({_PATH}, '^.*[/\\]', ''), '\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_replace({_PATH}, '^.*[/\\]', ''), '\.([^.]+)$', 1)) AS ext, substr(source_shp, 1, 2) AS head, starts_with(source_zip, 'A') AS a, regexp_replace(regexp_replace(source_zip, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM togieeum_polygon_pois WHERE source_zip IS NOT NULL AND source_shp IS NOT NULL",
)(
    lambda t: t.togieeum_polygon_pois.where("source_zip IS NOT NULL AND source_shp IS NOT NULL").select("source_zip", "source_shp", F.concat_ws("/", "source_zip", "source_shp").alias("path")).distinct().select(
        "source_zip", "source_shp", text.base_name("path").alias("base"), text.stem("path").alias("stem"), text.extension("path").alias("ext"), F.substring("source_shp", 1, 2).alias("head"), c("source_zip").startswith("A").alias("a"), text.safe_name("source_zip").alias("safe")
    )
)
q("F06", "SELECT c_custkey, contains(lower(c_mktsegment), lower('BuilD')) AS hit FROM customer")(lambda t: t.customer.select("c_custkey", F.lower("c_mktsegment").contains("build").alias("hit")))
q("F07", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(trim(p_brand) || ',' || trim(p_type) || ',' || trim(p_name), ' *, *'), lambda x: x <> ''), '|') AS parts FROM part")(lambda t: t.part.select("p_partkey", F.array_join(text.listed(F.concat_ws(" , ", "p_brand", "p_type", lit(" "), "p_name")), "|").alias("parts")))
q("F08", r"SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' *' || c_mktsegment || '!', '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file, substr(hex(c_name), 1, 16) AS head, 'https://example.org/meta?location=' || url_encode(c_name || ' ' || c_custkey) || '&source=outdoor' AS url FROM customer")(
    lambda t: t.customer.select(
        "c_custkey", text.safe_name(F.concat("c_name", lit(" *"), "c_mktsegment", lit("!"))).alias("file"), F.substring(F.hex("c_name"), 1, 16).alias("head"),
        text.url("https://example.org/meta", location=F.concat_ws(" ", "c_name", "c_custkey"), source=lit("outdoor")).alias("url"),
    )
)
_B = "CAST(o_orderkey AS DOUBLE) * o_orderkey"
q(
    "F09",
    f"SELECT o_orderkey, CASE WHEN {_B} >= 1048576 THEN printf('%.1f MB', floor({_B} / 1048576 * 10 + 0.5) / 10) WHEN {_B} >= 1024 THEN printf('%.1f KB', floor({_B} / 1024 * 10 + 0.5) / 10) ELSE printf('%.0f B', {_B}) END AS bytes, CASE WHEN o_orderkey < 60 THEN printf('%.1f s', CAST(o_orderkey AS DOUBLE)) WHEN o_orderkey < 3600 THEN printf('%d min %d s', o_orderkey // 60, o_orderkey % 60) ELSE printf('%d h %d min', o_orderkey // 3600, o_orderkey % 3600 // 60) END AS took, format('{{:,}}', o_orderkey) AS n FROM orders WHERE {_B} < 1073741824",
)(
    lambda t: t.orders.withColumns({"b": c("o_orderkey").cast("double") * c("o_orderkey"), "s": c("o_orderkey").cast("double")}).where("b < 1073741824").select("o_orderkey", text.human_bytes("b").alias("bytes"), text.human_seconds("s").alias("took"), F.format_number("o_orderkey", 0).alias("n"))
)
q("F10", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS DOUBLE) AS year FROM orders")(
    lambda t: t.orders.withColumn("m", F.when(c("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("n/a")).select("o_orderkey", text.year_of("m").cast("double").alias("year"))
)
q("F11", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) - floor(epoch((SELECT min(ts) FROM events))) AS BIGINT) AS elapsed FROM events")(
    lambda t: t.events.join(F.broadcast(t.events.agg(F.min("ts").alias("t0")))).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), (F.unix_timestamp(c("ts").cast("timestamp")) - F.unix_timestamp(c("t0").cast("timestamp"))).alias("elapsed"))
)
q("F12", f"SELECT id, floor(x / 500) * 500 AS low, ceil(x / 500) * 500 AS high, round(ln(1 + y), 6) AS l, round(sqrt(x * x + y * y), 6) AS h, least(4000.0::DOUBLE, greatest(1000.0::DOUBLE, x)) AS held, round(ln(greatest(x - 5000, 1e-9)), 6) AS sl, round(pi() * x, 6) AS p FROM {PTS}")(
    lambda t: t.pts.select("id", (F.floor(c("x") / 500) * 500).cast("double").alias("low"), (F.ceil(c("x") / 500) * 500).cast("double").alias("high"), r6(F.log1p("y"), "l"), r6(F.hypot("x", "y"), "h"), text.clamp(c("x"), 1000.0, 4000.0).alias("held"), r6(text.safe_log(c("x") - 5000), "sl"), r6(F.pi() * c("x"), "p"))
)
q("F13", "SELECT o_orderkey, round_even(o_orderkey / 8, 1) AS even, CASE WHEN o_orderkey = 0 THEN 0 ELSE round(round_even(o_orderkey / pow(10, floor(log10(o_orderkey)) - 2), 0) * pow(10, floor(log10(o_orderkey)) - 2), 6) END AS signif FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.bround(c("o_orderkey") / 8, 1).alias("even"), r6(text.signif("o_orderkey", 3), "signif"))
)
q("F14", "SELECT CAST(split AS DOUBLE) AS split, count(*) FILTER (isfinite(sdf)) AS finite, count(*) AS n FROM sdf_samples GROUP BY 1")(
    lambda t: t.sdf_samples.groupBy(c("split").cast("double").alias("split")).agg(F.count_if(text.finite("sdf")).alias("finite"), F.count(lit(1)).alias("n"))
)
_U64 = "CAST('0x' || concat(" + ", ".join(f"substr(sha256({{0}}), {15 - 2 * i}, 2)" for i in range(8)) + ") AS UBIGINT)"
_UNIT = f"{_U64} / 18446744073709551616.0::DOUBLE"
q("F15", f"SELECT c_custkey, {_UNIT.format(chr(39) + '20260610|' + chr(39) + ' || c_custkey')} AS u FROM customer")(lambda t: t.customer.select("c_custkey", text.unit_hash("20260610", "c_custkey").alias("u")))
q("F16", "SELECT c_custkey, 'bld_' || substr(sha256(coalesce(c_name, 'NA') || '|' || coalesce(c_mktsegment, 'NA')), 1, 16) AS id FROM customer")(lambda t: t.customer.select("c_custkey", text.hashed_id("bld_", "c_name", "c_mktsegment").alias("id")))


def _checksums(t: Tables) -> DataFrame:
    """In order for a table that is small at any size; free of order, one number per task, for one that grows."""
    n = t.nation.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(r["n_nationkey"].cast("string"), lit("|"), r["n_name"], lit("\n"))), ""), 256).alias("checksum"))
    o = t.orders.agg(F.sum(text.row_checksum("o_orderkey", "o_custkey")).cast("string").alias("checksum"))
    return n.select(lit("nation").alias("name"), "checksum").union(o.select(lit("orders"), "checksum"))


q("F17", r"SELECT 'nation' AS name, sha256(string_agg(n_nationkey || '|' || n_name || chr(10), '' ORDER BY n_nationkey)) AS checksum FROM nation UNION ALL SELECT 'orders', CAST(CAST(sum(CAST('0x' || substr(sha256(o_orderkey || '|' || o_custkey), 1, 8) AS UBIGINT)) AS HUGEINT) AS VARCHAR) FROM orders")(_checksums)
q("F18", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS object, CAST(event_id % 90 AS VARCHAR) AS lat FROM events")(
    lambda t: t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), text.sorted_json(user_id=c("user_id"), event_type=c("event_type")).alias("object"),
        F.get_json_object(F.to_json(F.struct(F.struct((c("event_id") % 90).alias("lat")).alias("location"))), "$.location.lat").alias("lat"),
    )
)
_RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
q("F19", "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS DOUBLE) AS rank FROM orders")(lambda t: t.orders.select("o_orderkey", text.mapped("o_orderpriority", _RANKS).cast("double").alias("rank")))
_FLAGS = ["addr_street", "phone", "name"]
q("F20", f"SELECT poi_id, {_AT}, (addr_street IS NOT NULL OR phone IS NOT NULL OR name IS NOT NULL) AS has_any, CAST(CASE WHEN addr_street IS NOT NULL THEN 1 WHEN phone IS NOT NULL THEN 2 WHEN name IS NOT NULL THEN 3 END AS DOUBLE) AS first, coalesce(addr_street, phone, name) AS value FROM korea_pois_point")(
    lambda t: t.korea_pois_point.withColumn("first", text.first_true([c(x).isNotNull() for x in _FLAGS])).select("poi_id", at_(), c("first").isNotNull().alias("has_any"), c("first").cast("double").alias("first"), text.gather(F.array(*_FLAGS), c("first")).alias("value"))
)


def _chunks(t: Tables) -> DataFrame:
    n = t.orders.agg(F.count(lit(1)).alias("n"))
    return n.select("n", F.explode(F.when(c("n") > 0, F.sequence(lit(1), c("n"), lit(5000)))).alias("first")).select(F.ceil(c("first") / 5000).cast("bigint").alias("chunk"), "first", F.least("n", c("first") + 4999).alias("last"))


q("F21", "SELECT CAST(ceil(f / 5000) AS BIGINT) AS chunk, f AS first, least(n, f + 4999) AS last FROM (SELECT count(*) AS n FROM orders), LATERAL (SELECT unnest(generate_series(1, n, 5000)) AS f)")(_chunks)
q("F22", "SELECT vec_id, round(list_aggregate(CAST(embedding[1:8] AS DOUBLE[]), 'sum'), 5) AS total FROM embeddings")(
    lambda t: (lambda w: w.select("vec_id", F.round(F.aggregate(text.wide(w.columns, r"geo2vec_[0-9]{3}"), lit(0.0), lambda s, x: s + x), 5).alias("total")))(t.embeddings.select("vec_id", lit("x").alias("geo2vec_id"), *[c("embedding")[i].cast("double").alias(f"geo2vec_{i:03d}") for i in range(8)]))
)
q("F23", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS s, CAST(l_quantity AS BIGINT) AS n, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", c("l_linenumber").cast("string").alias("s"), c("l_quantity").cast("bigint").alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), c("l_linenumber").cast("double").alias("d"))
)
q("F24", f"SELECT id, CASE WHEN area >= 1000 THEN CASE WHEN kind = 'Brand#11' THEN 'large one' ELSE 'large' END WHEN area >= 100 THEN 'middle' ELSE 'small' END AS class FROM {BOX}")(
    lambda t: t.box.select("id", F.when(c("area") >= 1000, F.when(c("kind") == "Brand#11", "large one").otherwise("large")).when(c("area") >= 100, "middle").otherwise("small").alias("class"))
)
q("F25", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_custkey / c_acctbal, 6) END AS strict, round(c_custkey / greatest(c_acctbal, 1.0), 6) AS raised FROM customer")(
    lambda t: t.customer.select("c_custkey", r6(text.guarded_ratio(c("c_custkey"), c("c_acctbal")), "strict"), r6(text.guarded_ratio(c("c_custkey"), c("c_acctbal"), 1.0), "raised"))
)
