"""A and B: normalisers and payload jobs. Payloads are JSON texts that Spark makes from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.functions.address import with_address
from sightline.functions.columns import local_minute, local_weekday
from sightline.functions.products import classify, comparable_brand
from sightline.plans import views as V
from sightline.plans.register import query
from sightline.sources import payloads as P, store
from sightline.tables import Scratch, table


@query("b1_normal_text", r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm FROM documents")
def b1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normal_text(F.col("text"))).alias("norm"))


_LABEL = "(p_name || '-' || p_brand || '+ AI_95 ёж')"
_LABEL_SQL = rf"trim(regexp_replace(replace(translate(translate(lower({_LABEL}), 'ё', 'е'), 'aieopcxykmtbh', 'аиеорсхукмтвн'), '+', ' плюс '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("b2_product_label", f"SELECT p_partkey, {_LABEL_SQL} AS label FROM part")
def b2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.product_label(F.concat("p_name", F.lit("-"), "p_brand", F.lit("+ AI_95 ёж"))).alias("label"))


PRODUCTS = [
    {"product_key": "AI95_BASE", "variant": "BASE", "aliases": ["АИ-95", "95"]}, {"product_key": "AI95_RING", "variant": "RING", "aliases": ["95 ring", "ai95 red ring"]},
    {"product_key": "AI95_WIDGET", "variant": "WIDGET", "aliases": ["95 small", "95 blue widget"]}, {"product_key": "AI95_PREMIUM_GENERIC", "variant": "PREMIUM", "aliases": ["95 premium"]},
]


def _labels(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 6
    return p.select("p_partkey", F.when(k == 0, F.concat(F.lit("AI 95 "), "p_name")).when(k == 1, F.lit("АИ-95")).when(k == 2, F.concat(F.lit("Ai-95+ "), "p_name")).when(k == 3, F.concat(F.lit("95 "), F.element_at(F.split("p_name", " "), -1))).otherwise(F.concat(F.lit("ДТ "), "p_name")).alias("label"))


@query("b3_classify_labels", """WITH l AS (SELECT p_partkey, p_partkey % 6 AS k, p_name, string_split(p_name, ' ')[-1] AS last FROM part), n AS (SELECT *, CASE k WHEN 0 THEN '95 ' || p_name WHEN 3 THEN '95 ' || last ELSE '' END AS x FROM l)
SELECT p_partkey, CASE WHEN k > 3 THEN NULL WHEN k = 1 THEN 'AI95_BASE' WHEN k = 2 THEN 'AI95_PREMIUM_GENERIC' WHEN contains(x, '95 blue widget') THEN 'AI95_WIDGET' WHEN contains(x, '95 premium') THEN 'AI95_PREMIUM_GENERIC' WHEN contains(x, '95 small') THEN 'AI95_WIDGET' WHEN contains(x, '95 ring') THEN 'AI95_RING' ELSE 'AI95_UNKNOWN' END AS product_key FROM n""")
def b3(spark, sf):
    return classify(_labels(spark, sf), PRODUCTS).select("p_partkey", "product_key")


@query("b4_octane_keys", """WITH k AS (SELECT p_partkey, ['92', '95', '98', '100', '80'][p_size % 5 + 1] AS o, p_partkey % 4 AS c FROM part) SELECT p_partkey, CASE WHEN o = '80' THEN NULL WHEN c = 3 THEN NULL ELSE o END AS octane FROM k""")
def b4(spark, sf):
    o = F.element_at(F.array(*[F.lit(x) for x in ("92", "95", "98", "100", "80")]), (F.col("p_size") % 5 + 1).cast("int"))
    c = F.col("p_partkey") % 4
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.octane(F.when(c == 0, F.concat(F.lit("AI"), o, F.lit("_BASE"))), F.when(c == 1, F.concat(F.lit("AI-"), o)), F.when(c == 2, F.concat(F.lit("АИ "), o, F.lit(" plus"))).when(c == 3, F.concat(F.lit("x"), o)).otherwise(F.lit("diesel"))).alias("octane"))


_STATUS_SAY = ["", "no data", "Not available", "OUT_OF_STOCK", "нет топлива", "low stock", "заканчивается", "In-Stock", "available", "есть", "uncertain", "whatever", "not\u00a0available", "in\u00a0stock", "ｉｎ　ｓｔｏｃｋ"]
_STATUS_IS = ["UNKNOWN", "UNKNOWN", "OUT_OF_STOCK", "OUT_OF_STOCK", "OUT_OF_STOCK", "LIMITED", "LIMITED", "IN_STOCK", "IN_STOCK", "IN_STOCK", "UNCERTAIN", "UNKNOWN", "OUT_OF_STOCK", "IN_STOCK", "IN_STOCK"]
_QUEUE_SAY = ["", "Very long", "no queue", "high", "moderate", "small queue", "небольшая", "большая очередь", "нет", "unknown", "?", "ｖｅｒｙ\u00a0ｌｏｎｇ", "без\u00a0очереди"]
_QUEUE_IS = [None, "VERY_LONG", "NONE", "LONG", "MEDIUM", "SHORT", "SHORT", "LONG", "NONE", None, None, "VERY_LONG", "NONE"]


def _pick(values, column):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query("b5_status_words", f"WITH {V.EVENTS} SELECT event_id, {_sql_list(_STATUS_IS)}[event_id % 15 + 1] AS status FROM e")
def b5(spark, sf):
    return V.events(spark, sf).select("event_id", X.status(F.concat(F.lit(" "), _pick(_STATUS_SAY, F.col("event_id")), F.lit("  "))).alias("status"))


@query("b6_queue_words", f"WITH {V.EVENTS} SELECT event_id, coalesce({_sql_list(_QUEUE_IS)}[event_id % 13 + 1], {_sql_list(_QUEUE_IS)}[k % 13 + 1]) AS ordinal FROM e")
def b6(spark, sf):
    return V.events(spark, sf).select("event_id", X.queue_ordinal(_pick(_QUEUE_SAY, F.col("event_id")), _pick(_QUEUE_SAY, F.col("k"))).alias("ordinal"))


@query("b7_observation_time", f"WITH {V.EVENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'EXACT' WHEN k % 3 = 1 THEN 'BOUNDED_AGE' ELSE 'UNKNOWN' END AS kind, CASE WHEN k % 3 = 0 THEN t END AS at, CASE WHEN k % 3 = 1 THEN k END AS min_minutes FROM e")
def b7(spark, sf):
    e = V.events(spark, sf)
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = X.observation_time(F.when(F.col("k") % 3 == 0, iso).otherwise("soon"), F.when(F.col("k") % 3 == 1, F.col("k")), F.when(F.col("k") % 3 == 1, F.col("k") + 5))
    return e.select("event_id", time.alias("x")).select("event_id", "x.kind", F.unix_seconds("x.observed_at").alias("at"), "x.min_minutes")


@query("b8_epoch_units", f"WITH {V.EVENTS} SELECT event_id, t::DOUBLE AS at FROM e")
def b8(spark, sf):
    return V.events(spark, sf).select("event_id", X.epoch_time(F.when(F.col("event_id") % 2 == 0, F.col("t")).otherwise(F.col("t") * 1000)).alias("at"))


@query("b9_coordinates", "SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1) OR abs(c_acctbal / 40) > 180 THEN NULL ELSE c_acctbal / 40 END AS lon, CASE WHEN c_custkey % 7 IN (0, 1) OR abs(c_acctbal / 40) > 180 THEN NULL ELSE c_nationkey::DOUBLE END AS lat FROM customer")
def b9(spark, sf):
    c = table(spark, sf, "customer")
    lat = F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 7 == 1, "north").otherwise(F.col("c_nationkey").cast("string"))
    lon, latitude = X.coordinate(lat, (F.col("c_acctbal") / 40).cast("string"), "LAT_LON")
    both = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return c.select("c_custkey", lon.alias("lon"), latitude.alias("lat")).select("c_custkey", F.when(both, F.col("lon")).alias("lon"), F.when(both, F.col("lat")).alias("lat"))


@query("b10_brand_labels", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN trim(p_brand) WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN 'brand-id:' || p_size ELSE 'opaque-brand' END AS brand, array_to_string(list_distinct([p_brand, p_type]), '') <> '' AS some FROM part")
def b10(spark, sf):
    k = F.col("p_size") % 4
    none = F.lit(None).cast("string")
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.brand(F.when(k == 0, F.concat(F.lit(" "), "p_brand")).otherwise(" "), F.when(k == 1, F.col("p_name")), none, none, F.when(k == 2, F.col("p_size").cast("string"))).alias("brand"), (X.joined_brands(F.array("p_brand", "p_type")) != "").alias("some"))


@query("b11_comparable_brands", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) END AS comparable FROM part")
def b11(spark, sf):
    p = table(spark, sf, "part").withColumn("brand", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("brand-id:"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")))
    aliases = p.where("p_brand in ('Brand#1', 'Brand#2')").select(X.plain(F.col("p_brand")).alias("alias"), F.lit("first").alias("canonical")).distinct()
    return comparable_brand(p, aliases).select("p_partkey", "comparable")


@query("b12_b13_addresses", """WITH a AS (SELECT c_custkey, c_custkey % 40 AS n, c_nationkey AS s, c_custkey % 4 AS c FROM customer) SELECT c_custkey, CASE c WHEN 0 THEN 'мира ' || n || 'г' WHEN 1 THEN 'мира ' || n || ' корпус ' || s WHEN 2 THEN 'мира ' || n || 'а' ELSE 'мира ' || n || ' строение ' || s END AS norm,
CASE c WHEN 0 THEN n || 'г' WHEN 2 THEN n || 'а' ELSE n::VARCHAR END AS house FROM a""")
def b12(spark, sf):
    c = table(spark, sf, "customer")
    n, s, k = (F.col("c_custkey") % 40).cast("string"), F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    address = F.when(k == 0, F.concat(F.lit("г. Волгоград, ул. Мира, "), n, F.lit(" г"))).when(k == 1, F.concat(F.lit("400005 Россия, улица Мира, "), n, F.lit("/"), s)).when(k == 2, F.concat(F.lit("проспект МИРА "), n, F.lit(" а"))).otherwise(F.concat(F.lit("Мира "), n, F.lit(" стр. "), s))
    return with_address(c.select("c_custkey", address.alias("address"))).select("c_custkey", "norm", "house")


@query("b12_b13_slashes", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ленина ' || n WHEN 1 THEN 'мира ' || n WHEN 2 THEN 'мира ' || n || ' корпус ' || s WHEN 3 THEN 'мира ' || n || ' корпус ' || s || ' 3' ELSE 'мира 10000 ' || n END AS norm, CASE c_custkey % 5 WHEN 3 THEN '3' ELSE n END AS house, CASE WHEN c_custkey % 5 IN (2, 3) THEN s END AS unit
FROM (SELECT c_custkey, (c_custkey % 40 + 1)::VARCHAR AS n, (c_nationkey + 1)::VARCHAR AS s FROM customer)""")
def b12_slashes(spark, sf):
    """A slash after a word, and after a number."""
    c = table(spark, sf, "customer")
    n, s, k = (F.col("c_custkey") % 40 + 1).cast("string"), (F.col("c_nationkey") + 1).cast("string"), F.col("c_custkey") % 5
    address = F.when(k == 0, F.concat(F.lit("пр-кт Ленина / "), n)).when(k == 1, F.concat(F.lit("Мира/"), n)).when(k == 2, F.concat(F.lit("ул. Мира, "), n, F.lit(" / "), s)).when(k == 3, F.concat(F.lit("Мира "), n, F.lit("/"), s, F.lit("/3"))).otherwise(F.concat(F.lit("Мира 10000/"), n))
    return with_address(c.select("c_custkey", address.alias("address"))).select("c_custkey", "norm", "house", F.col("units").getItem("корпус").alias("unit"))


@query("b14_assortment", f"WITH {V.EVENTS} SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' WHEN k % 4 = 2 THEN '92,95' ELSE '95,98,100' END AS grades FROM e")
def b14(spark, sf):
    k = F.col("k") % 4
    lists = F.when(k == 0, F.array(F.lit(" "))).when(k == 1, F.array(F.lit("diesel 1953"))).when(k == 2, F.array(F.lit("АИ-95"), F.lit("92, 95+"))).otherwise(F.array(F.lit("100"), F.lit("98/95")))
    return V.events(spark, sf).select("event_id", F.array_join(X.assortment(lists), ",").alias("grades"))


@query("b15_b17_limits", f"WITH {V.EVENTS} SELECT event_id, CASE WHEN k % 3 < 2 THEN k + 0.5::DOUBLE END AS liters, CASE WHEN k % 3 = 1 THEN 'аи-95' END AS grade FROM e")
def b17(spark, sf):
    k = F.col("k")
    said = F.when(k % 3 == 0, F.concat(F.lit("Лимит "), k.cast("string"), F.lit(",5 л"))).when(k % 3 == 1, F.concat(F.lit("есть · лимит "), k.cast("string"), F.lit(".5 л на аи-95"))).otherwise("без ограничений")
    litres, grade = X.litre_limit(said)
    return V.events(spark, sf).select("event_id", litres.alias("liters"), grade.alias("grade"))


@query("b16_trust", f"WITH {V.EVENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'a' WHEN k % 3 = 1 THEN 'a,b' END AS names, CASE WHEN k % 3 < 2 THEN left(repeat('x', k::INT) || event_type, 40) END AS value FROM e")
def b16(spark, sf):
    k = F.col("k")
    value = F.concat(F.expr("repeat('x', int(k))"), "event_type")
    m = F.create_map(F.lit("a"), F.when(k % 3 < 2, F.concat(F.lit(" "), value)).otherwise(" "), F.lit("b"), F.when(k % 3 == 1, "yes"))
    return V.events(spark, sf).select("event_id", X.trust(m).alias("m")).select("event_id", F.when(F.col("m").isNotNull(), F.array_join(F.array_sort(F.map_keys("m")), ",")).alias("names"), F.try_element_at("m", F.lit("a")).alias("value"))


@query("b19_content_hash", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS hash FROM nation""")
def b19(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.content_hash("n_regionkey", "n_name").alias("hash"))


@query("b20_age_and_clamp", f"WITH {V.EVENTS} SELECT event_id, round(({V.NOW} - t) / 60.0::DOUBLE, 3) AS age, left(trim(regexp_replace(' ' || event_type || '   x', '\\s+', ' ', 'g')), 6) AS text FROM e")
def b20(spark, sf):
    return V.events(spark, sf).select("event_id", F.round((V.NOW - F.col("t")) / 60.0, 3).alias("age"), X.clamp(F.concat(F.lit(" "), "event_type", F.lit("   x")), 6).alias("text"))


@query("b21_local_time", f"WITH {V.EVENTS} SELECT event_id, (t // 60 + 180) % 1440 AS minute, ((t // 60 + 180) // 1440 + 3) % 7 AS weekday FROM e")
def b21(spark, sf):
    m = F.floor(F.col("t") / 60)
    return V.events(spark, sf).select("event_id", local_minute(m, 180).alias("minute"), local_weekday(m, 180).alias("weekday"))


# A: payloads. Each payload is the JSON of one station (user), so that none grows with the table.
def _iso(column):
    return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd HH:mm:ss")


def timeline_payloads(spark, sf):
    e = V.events(spark, sf)
    kind = F.col("event_type")
    comment = F.struct(_iso("t").alias("created_at"), F.when(kind == "error", "no").when(kind == "purchase", "yes").when(kind == "click", "queue").otherwise("note").alias("status"), F.when(F.col("k") % 5 == 4, "нет топлива").otherwise(F.concat(F.lit("АИ-95, 9"), (F.col("k") % 4 + 2).cast("string"), F.lit(" · Очередь 95 машин"))).alias("detail"))
    g = e.groupBy("entity").agg(F.collect_list(comment).alias("comments"), F.max("t").alias("t"), F.max_by("k", F.struct("t", "event_id")).alias("k"), F.max_by("event_type", F.struct("t", "event_id")).alias("last"))
    k = F.col("k")
    row = F.struct(F.col("entity").cast("string").alias("id"), F.when(F.col("entity") % 17 == 0, "").otherwise(F.lit("44.5")).alias("lon"), F.lit("48.7").alias("lat"), F.concat(F.lit("s"), F.col("entity").cast("string")).alias("name"), F.when(k % 3 == 0, "92 · Очередь 100+ машин").when(k % 3 == 1, "АИ-95, 98 · Цена 60").otherwise("Обновлено 95 минут назад").alias("detail"), F.when(F.col("last") == "error", "no").otherwise("yes").alias("status"), _iso("t").alias("last_at"), F.when(k % 4 == 0, "92,95,ДТ").when(k % 4 == 1, "ДТ").when(k % 4 == 2, "").otherwise("95").alias("fuels_now"), "comments")
    return g.select(F.lit("timeline").alias("source"), F.lit(V.NOW).alias("fetched_at"), F.to_json(F.array(row)).alias("payload"))


LASTK = "lk AS (SELECT entity, max(t) AS t, arg_max(k, (t, event_id)) AS k, arg_max(event_type, (t, event_id)) AS last FROM e GROUP BY 1)"


@query("a1_timeline_observations", f"""WITH {V.EVENTS}, {LASTK}, x AS (SELECT *, last = 'error' AS gone, k % 3 = 1 AS a, k % 4 IN (0, 3) AS b, k % 3 < 2 AND k % 4 <> 2 AS bothsay FROM lk WHERE entity % 17 > 0)
SELECT entity::VARCHAR AS station, CASE WHEN gone THEN 'OUT_OF_STOCK' WHEN bothsay AND a <> b THEN 'UNCERTAIN' WHEN a OR b THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS status, gone AS family_all, t AS at FROM x""")
def a1(spark, sf):
    return P.timeline(timeline_payloads(spark, sf))["observations"].select("station", "status", "family_all", "at")


@query("a1_timeline_reports", f"""WITH {V.EVENTS}, c AS (SELECT entity::VARCHAR AS station, t AS at, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 ELSE 0 END AS sign, k, '9' || (k % 4 + 2) AS g2 FROM e WHERE entity % 17 > 0)
SELECT station, at, sign, grade FROM (SELECT *, unnest(CASE WHEN k % 5 = 4 THEN CASE WHEN sign = -1 THEN [NULL] ELSE [] END WHEN g2 IN ('92', '95') THEN list_distinct(['95', g2]) ELSE [] END) AS grade FROM c WHERE sign <> 0)""")
def a1r(spark, sf):
    return P.timeline(timeline_payloads(spark, sf))["reports"].select("station", "at", "sign", "grade")


#: The payload's card by k % 3, its grades, and those of the hidden list by k % 4.
_SIDES = f"""{V.EVENTS}, {LASTK}, sd AS (SELECT *, entity::VARCHAR AS station, last = 'error' AS gone, [['92'], ['95', '98'], []][k % 3 + 1] AS va, [['92', '95'], [], [], ['95']][k % 4 + 1] AS ha, k % 3 < 2 AND k % 4 <> 2 AS bothsay FROM lk WHERE entity % 17 > 0)"""


def wrapped(payloads):
    """The same lists under `stations`, for every second station."""
    return payloads.withColumn("payload", F.when(F.hash("payload") % 2 == 0, F.concat(F.lit('{"stations": '), F.col("payload"), F.lit("}"))).otherwise(F.col("payload")))


@query("a1_timeline_stations", f"WITH {_SIDES} SELECT station, 44.5 AS lon, 48.7 AS lat, 's' || entity AS title FROM sd")
def a1_stations(spark, sf):
    return P.timeline(wrapped(timeline_payloads(spark, sf)))["stations"].select("station", "lon", "lat", "title")


@query("a1_timeline_queues", f"WITH {_SIDES} SELECT station, '100+ машин' AS value, 'VERY_LONG' AS ordinal, t AS at FROM sd WHERE k % 3 = 0")
def a1_queues(spark, sf):
    return P.timeline(wrapped(timeline_payloads(spark, sf)))["queues"].select("station", "value", "ordinal", "at")


@query("a1_timeline_activity", f"""WITH {_SIDES}, gr AS (SELECT *, unnest(list_distinct(list_concat(va, ha))) AS grade FROM sd), c AS (SELECT entity::VARCHAR AS station, t, k, '9' || (k % 4 + 2) AS g2 FROM e WHERE entity % 17 > 0 AND event_type IN ('purchase', 'click') AND k % 5 < 4), d AS (SELECT station, t, unnest(CASE WHEN g2 IN ('92', '95') THEN list_distinct(['95', g2]) ELSE [] END) AS grade FROM c)
SELECT station, grade, 'PETROL_STATUS_SNAPSHOT' AS kind, CASE WHEN gone THEN 'OUT_OF_STOCK' WHEN bothsay AND list_contains(va, grade) <> list_contains(ha, grade) THEN 'UNCERTAIN' ELSE 'IN_STOCK' END AS status, t AS at, NULL AS event_times FROM gr
UNION ALL SELECT station, grade, 'RECENT_SIGNAL', NULL, NULL, array_to_string(list(t ORDER BY t), ',') FROM d GROUP BY station, grade""")
def a1_activity(spark, sf):
    rows = P.timeline(wrapped(timeline_payloads(spark, sf)))["activity"]
    return rows.select("station", "grade", "kind", "status", "at", F.array_join("event_times", ",").alias("event_times"))


def status_payloads(spark, sf):
    e = V.events(spark, sf)
    fuel = F.struct(F.concat(F.lit("АИ-"), _pick(X.OCTANES, F.col("k"))).alias("fuel_type"), F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("available"), _iso("t").alias("last_report_at"), F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).alias("limit_liters"), F.when(F.col("event_type") == "view", "UP_TO_25").alias("queue_level"))
    g = e.groupBy("entity").agg(F.collect_list(fuel).alias("fuel_statuses"))
    station = F.struct(F.col("entity").cast("string").alias("id"), F.lit("44.5").alias("lng"), F.lit("48.7").alias("lat"), F.lit("n").alias("name"), F.lit("a").alias("address"), F.lit("b").alias("brand"))
    row = F.struct(station.alias("station"), "fuel_statuses", F.lit(40.0).alias("limit_liters"), F.array(F.lit("АИ-92"), F.lit("95")).alias("fuel_assortment"))
    return g.select(F.lit("status").alias("source"), F.lit(V.NOW).alias("fetched_at"), F.to_json(F.array(row)).alias("payload"))


@query("a2_status_observations", f"WITH {V.EVENTS} SELECT entity::VARCHAR AS station, 'АИ-' || ['92', '95', '98', '100'][k % 4 + 1] AS grade, CASE event_type WHEN 'purchase' THEN 'IN_STOCK' WHEN 'error' THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS status, t AS at FROM e")
def a2(spark, sf):
    return P.statuses(status_payloads(spark, sf))["observations"].select("station", "grade", "status", "at")


@query("a2_status_stations", f"WITH {V.EVENTS} SELECT entity::VARCHAR AS station, '92,95' AS assortment, count(*) FILTER (k % 2 = 0 AND k > 0) + 1 AS limits, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'LONG' END AS queue, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN max(t) END AS queue_at FROM e GROUP BY entity")
def a2s(spark, sf):
    made = P.statuses(status_payloads(spark, sf))
    q = made["queues"].select("station", F.col("ordinal").alias("queue"), F.col("at").alias("queue_at"))
    return made["stations"].join(q, "station", "left").select("station", F.array_join("assortment", ",").alias("assortment"), F.size("limits").cast("long").alias("limits"), "queue", "queue_at")


def exhaustive_payloads(spark, sf):
    e = V.events(spark, sf)
    g = e.groupBy("entity").agg(F.max("t").alias("t"), F.max_by("k", F.struct("t", "event_id")).alias("k"), F.max_by("event_type", F.struct("t", "event_id")).alias("last"))
    k = F.col("k")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    st = F.struct(F.when(F.col("last") == "error", "no").otherwise("yes").alias("status"), _iso("t").alias("updated_at"), F.when(k % 4 == 0, arr("АИ-95", "АИ-95+")).when(k % 4 == 1, arr("АИ-92")).otherwise(arr()).alias("fuels_now"), F.when(k % 8 == 2, arr("95")).otherwise(arr()).alias("fuels_out"), F.when(k % 5 == 0, F.struct(_iso(F.col("t") + F.when(k % 2 == 0, 60).otherwise(-60)).alias("created_at"), F.lit("x").alias("text"))).alias("conflict"))
    row = F.struct(F.col("entity").cast("string").alias("id"), F.lit("44.5").alias("lon"), F.lit("48.7").alias("lat"), st.alias("st"))
    return g.select(F.lit("exhaustive").alias("source"), F.lit(V.NOW).alias("fetched_at"), F.to_json(F.array(row)).alias("payload"))


@query("a3_exhaustive_observations", f"""WITH {V.EVENTS}, {LASTK}, x AS (SELECT entity::VARCHAR AS station, t, k, last = 'error' AS gone, k % 5 = 0 AND k % 2 = 0 AS active, k % 4 = 0 AS has FROM lk),
y AS (SELECT *, CASE WHEN active THEN 'UNCERTAIN' WHEN gone THEN 'OUT_OF_STOCK' WHEN has THEN 'IN_STOCK' WHEN k % 4 = 1 OR k % 8 = 2 THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS status FROM x)
SELECT station, unnest(CASE WHEN has AND (active OR NOT gone) THEN ['АИ-95', 'АИ-95+'] ELSE [NULL] END) AS grade, status, status = 'OUT_OF_STOCK' AS family_all, CASE WHEN active THEN t + 60 ELSE t END AS at FROM y""")
def a3(spark, sf):
    return P.exhaustive(exhaustive_payloads(spark, sf))["observations"].select("station", "grade", "status", "family_all", "at")


def full_payloads(spark, sf):
    """Full lists with limits, a catalogue, queues as text or object, and recent reports."""
    e = V.events(spark, sf)
    k = F.col("k")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    report = F.struct(_iso("t").alias("created_at"), F.when(F.col("event_type") == "error", "no").when(F.col("event_type") == "purchase", "yes").otherwise("note").alias("status"), F.when(k % 3 == 0, "нет топлива").when(k % 3 == 1, "АИ-92 · 95").otherwise("Цена 98").alias("detail"), F.when(k % 4 == 0, arr("АИ-100")).alias("fuel_grades"))
    g = e.groupBy("entity").agg(F.max("t").alias("t"), F.max_by("k", F.struct("t", "event_id")).alias("k"), F.collect_list(report).alias("recent"))
    queue = F.when(k % 4 == 0, F.lit('"gt50"')).when(k % 4 == 1, F.concat(F.lit('{"size":"20_50","vehicle_count":'), k.cast("string"), F.lit(',"at":"'), _iso("t"), F.lit('"}'))).when(k % 4 == 2, F.lit('{"label":"большая"}')).otherwise("null")
    st = F.struct(F.lit("yes").alias("status"), _iso("t").alias("updated_at"), F.when(k % 2 == 0, arr("АИ-95")).otherwise(arr()).alias("fuels_now"), arr("98").alias("fuels_out"))
    limits = F.array(F.struct(F.lit(" 95 ").alias("grade"), k.cast("double").alias("liters"), _iso(F.col("t") - 60).alias("since")), F.struct(F.lit("92").alias("grade"), F.lit(30.0).alias("liters"), F.lit(None).cast("string").alias("since")))
    row = F.to_json(F.struct(F.col("entity").cast("string").alias("id"), F.lit("44.5").alias("lon"), F.lit("48.7").alias("lat"), F.lit("b").alias("brand"), st.alias("st"), limits.alias("limits"), F.when(k % 3 > 0, arr("АИ-92", "95", "ДТ")).alias("fuels"), "recent"))
    whole = F.replace(row, F.lit('"fuels_out":["98"]'), F.concat(F.lit('"fuels_out":["98"],"queue":'), queue))
    return g.select(F.lit("exhaustive").alias("source"), F.lit(V.NOW).alias("fetched_at"), F.concat(F.lit('{"stations":['), whole, F.lit("]}")).alias("payload"))


@query("a3_full_stations", f"WITH {V.EVENTS}, {LASTK} SELECT entity::VARCHAR AS station, 'b' AS title, CASE WHEN k % 3 > 0 THEN '92,95' END AS assortment, CASE WHEN k > 0 THEN '95:' || k || ':' || (t - 60) || ',' ELSE '' END || '92:30:' AS limits FROM lk")
def a3_stations(spark, sf):
    made = P.exhaustive(full_payloads(spark, sf))["stations"]
    said = F.transform("limits", lambda x: F.concat_ws(":", x["grade"], x["liters"].cast("int").cast("string"), F.coalesce(x["in_force_since"].cast("string"), F.lit(""))))
    return made.select("station", "title", F.array_join("assortment", ",").alias("assortment"), F.array_join(said, ",").alias("limits"))


@query("a3_full_queues", f"WITH {V.EVENTS}, {LASTK} SELECT entity::VARCHAR AS station, ['gt50', '20_50', 'большая'][k % 4 + 1] AS value, ['VERY_LONG', 'LONG', 'LONG'][k % 4 + 1] AS ordinal, CASE WHEN k % 4 = 1 THEN k::DOUBLE END AS vehicles, CASE WHEN k % 4 = 1 THEN t END AS at FROM lk WHERE k % 4 < 3")
def a3_queues(spark, sf):
    return P.exhaustive(full_payloads(spark, sf))["queues"].select("station", "value", "ordinal", "vehicles", "at")


_FULL = f"""{V.EVENTS}, {LASTK}, rp AS (SELECT entity::VARCHAR AS station, t AS at, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END AS sign, CASE WHEN k % 4 = 0 THEN ['100'] WHEN k % 3 = 1 THEN ['92'] ELSE [] END AS g, event_type = 'error' AND k % 4 > 0 AND k % 3 = 0 AS family FROM e)"""


@query("a3_full_reports", f"WITH {_FULL} SELECT station, at, sign, unnest(CASE WHEN len(g) > 0 THEN g WHEN family THEN [NULL] ELSE [] END) AS grade FROM rp WHERE sign <> 0")
def a3_reports(spark, sf):
    return P.exhaustive(full_payloads(spark, sf))["reports"].select("station", "at", "sign", "grade")


@query("a3_full_activity", f"""WITH {_FULL}, told AS (SELECT DISTINCT station, unnest(g) AS grade FROM rp), listed AS (SELECT entity::VARCHAR AS station, unnest(list_concat(['98'], CASE WHEN k % 3 > 0 THEN ['92', '95'] ELSE [] END, CASE WHEN k % 2 = 0 THEN ['95'] ELSE [] END)) AS grade FROM lk), known AS (FROM told UNION FROM listed)
SELECT station, grade, 'PETROL_STATUS_SNAPSHOT' AS kind, CASE WHEN grade = '98' OR k % 2 = 0 AND grade <> '95' THEN 'OUT_OF_STOCK' WHEN k % 2 = 0 THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS status, t AS at, NULL AS event_times FROM known JOIN lk ON entity::VARCHAR = station
UNION ALL SELECT station, grade, 'RECENT_SIGNAL', NULL, NULL, array_to_string(list(at ORDER BY at), ',') FROM (SELECT station, at, unnest(g) AS grade FROM rp WHERE sign = 1) GROUP BY station, grade""")
def a3_activity(spark, sf):
    rows = P.exhaustive(full_payloads(spark, sf))["activity"]
    return rows.select("station", "grade", "kind", "status", "at", F.array_join("event_times", ",").alias("event_times"))


def tree_payloads(spark, sf):
    e = V.events(spark, sf)
    fuel = F.struct(F.concat(F.lit("g"), (F.col("k") % 4).cast("string")).alias("fuel"), F.col("event_type").alias("status"), F.when(F.col("k") % 3 > 0, F.when(F.col("k") % 3 == 1, F.col("t")).otherwise(F.col("t") * 1000)).alias("updatedAt"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("signalsCountPerHour"))
    g = e.groupBy("entity").agg(F.collect_list(fuel).alias("fuels"))
    row = F.struct(F.when(F.col("entity") % 2 == 0, F.col("entity").cast("string")).alias("id"), F.when(F.col("entity") % 2 == 1, F.col("entity").cast("string")).alias("businessId"), F.array(F.lit(44.5), F.when(F.col("entity") % 13 > 0, F.lit(48.7))).alias("coordinates"), "fuels", F.lit(5).alias("updatedAt"))
    return g.select(F.lit("tree").alias("source"), F.lit(V.NOW).alias("fetched_at"), F.to_json(F.struct(F.array(row).alias("items"))).alias("payload"))


@query("a4_state_tree", f"WITH {V.EVENTS} SELECT entity::VARCHAR AS station, 'g' || k % 4 AS fuel, event_type AS status, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS signals, CASE WHEN k % 3 > 0 THEN t::DOUBLE END AS at FROM e WHERE entity % 13 > 0")
def a4(spark, sf):
    made = P.state_tree(tree_payloads(spark, sf), Scratch(spark, "tree"))
    return made["observations"].join(made["stations"].where("lon is not null").select("station"), "station", "left_semi").select("station", "fuel", "status", "signals", "at")


def nested_payloads(spark, sf):
    """Stations at unlike depths, under unlike names, with fuels as a list, a list within, or a map; the number 0 is no id."""
    e = V.events(spark, sf)
    k, n = F.col("k"), F.col("entity")
    name = F.when(k % 5 == 4, "ДТ").otherwise(F.concat(F.lit("АИ-"), _pick(X.OCTANES, k)))
    fuel = F.to_json(F.struct(name.alias("localizedName"), F.col("event_type").alias("availability"), F.when(k % 3 > 0, F.when(k % 3 == 1, F.col("t")).otherwise(F.col("t") * 1000)).alias("lastSignalTimestamp"), F.when(k % 2 == 0, k).alias("signalsCountPerHour")))
    by_name = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('":'), F.when(k % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(fuel))
    g = e.groupBy("entity").agg(F.array_join(F.collect_list(fuel), ",").alias("list"), F.array_join(F.collect_list(by_name), ",").alias("map"), F.max("t").alias("t"))
    text = n.cast("string")
    ident = F.concat(F.when(n % 4 == 0, '"id":').when(n % 4 == 1, '"businessId":"').when(n % 4 == 2, '"oid":"').otherwise('"uri":"'), text, F.when(n % 4 == 0, "").otherwise('"'))
    lat = F.when(n % 13 == 0, F.lit('"north"')).otherwise(F.lit("48.7"))
    spot = F.concat(F.when(n % 3 == 0, '"coordinates":[44.5,').when(n % 3 == 1, '"geometry":{"coordinates":[44.5,').otherwise('"point":["44.5",'), lat, F.when(n % 3 == 1, "]}").otherwise("]"))
    stock = F.when(n % 3 == 0, F.concat(F.lit('"fuels":['), F.col("list"), F.lit("]"))).when(n % 3 == 1, F.concat(F.lit('"fuelAvailability":{"fuel":['), F.col("list"), F.lit('],"queueStatus":"LONG","lastSignalTimestamp":'), F.col("t").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('"fuels":{'), F.col("map"), F.lit('},"updatedAt":5,"properties":{"queue":{"label":"small","vehicleCount":3,"updatedAt":'), F.col("t").cast("string"), F.lit("}}")))
    node = F.concat(F.lit("{"), ident, F.lit(","), spot, F.lit(","), stock, F.lit("}"))
    whole = F.when(n % 5 == 0, node).when(n % 5 == 1, F.concat(F.lit('{"items":['), node, F.lit("]}"))).when(n % 5 == 2, F.concat(F.lit('{"data":{"page":{"results":[{"item":'), node, F.lit("}]}}}"))).when(n % 5 == 3, F.concat(F.lit('[[{"x":1},['), node, F.lit("]]]"))).otherwise(F.concat(F.lit('{"a":{"b":'), node, F.lit('},"c":null}')))
    return g.select(F.lit("nested").alias("source"), F.lit(V.NOW).alias("fetched_at"), whole.alias("payload"))


def _nested(spark, sf):
    return P.state_tree(nested_payloads(spark, sf), Scratch(spark, "nested"))


#: What an object of a nested payload says of its fuels: whether it is bare text, its name, status, signals and time.
_BARE = "entity % 3 = 2 AND k % 2 = 0"
_NESTED = f"""{V.EVENTS}, nf AS (SELECT entity::VARCHAR AS station, CASE WHEN {_BARE} THEN event_id::VARCHAR WHEN k % 5 = 4 THEN 'ДТ' ELSE 'АИ-' || ['92', '95', '98', '100'][k % 4 + 1] END AS fuel, event_type AS status,
CASE WHEN NOT ({_BARE}) AND k % 2 = 0 THEN k::DOUBLE END AS signals, CASE WHEN NOT ({_BARE}) AND k % 3 > 0 THEN t::DOUBLE END AS at FROM e WHERE entity > 0)"""


@query("a4_nested_observations", f"WITH {_NESTED} SELECT * FROM nf")
def a4_observations(spark, sf):
    return _nested(spark, sf)["observations"].select("station", "fuel", "status", "signals", "at")


@query("a4_nested_stations", f"WITH {V.EVENTS} SELECT DISTINCT entity::VARCHAR AS station, CASE WHEN entity % 13 > 0 THEN 44.5 END AS lon, CASE WHEN entity % 13 > 0 THEN 48.7 END AS lat FROM e WHERE entity > 0")
def a4_stations(spark, sf):
    return _nested(spark, sf)["stations"].select("station", "lon", "lat")


@query("a4_nested_queues", f"WITH {V.EVENTS} SELECT entity::VARCHAR AS station, CASE WHEN entity % 3 = 1 THEN 'LONG' ELSE 'small' END AS value, CASE WHEN entity % 3 = 1 THEN 'LONG' ELSE 'SHORT' END AS ordinal, CASE WHEN entity % 3 = 2 THEN 3.0::DOUBLE END AS vehicles, max(t)::DOUBLE AS at FROM e WHERE entity % 3 > 0 GROUP BY entity")
def a4_queues(spark, sf):
    return _nested(spark, sf)["queues"].select("station", "value", "ordinal", "vehicles", "at")


@query("a4_nested_activity", f"""WITH {_NESTED}, gas AS (SELECT * FROM nf WHERE regexp_matches(fuel, '(^|[^0-9])(92|95|98|100)([^0-9]|$)'))
SELECT station, fuel AS grade, 'PETROL_STATUS_SNAPSHOT' AS kind, status, NULL::DOUBLE AS at, NULL::DOUBLE AS count FROM gas UNION ALL SELECT station, fuel, 'ROLLING_SIGNAL_COUNT', NULL, at, signals FROM gas WHERE at IS NOT NULL AND signals IS NOT NULL""")
def a4_activity(spark, sf):
    return _nested(spark, sf)["activity"].select("station", "grade", "kind", "status", "at", "count")


_CARD_SQL = """CASE WHEN regexp_matches(text, '(?i)нет\\s+топлива|заправка\\s+не\\s+работает') THEN 'OUT_OF_STOCK' WHEN regexp_matches(text, '(?i)есть\\s+топливо') AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(аи[-\\s]?)?95\\+?([^\\p{L}\\p{N}]|$)') THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS status"""


@query("a5_html_cards", f"""WITH c AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)(<li(?:[\\s/][^>]*)?>.*?)</li>', 1) AS l FROM pages), u AS (SELECT page_id, i - 1 AS place, l[i] AS card FROM c, unnest(range(1, len(l) + 1)) AS x(i)), t AS (SELECT *, trim(regexp_replace(regexp_replace(card, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, place::INT AS place, text, regexp_extract(card, 'href="([^"]*)"', 1) AS link, {_CARD_SQL} FROM t""")
def a5(spark, sf):
    return P.cards(table(spark, sf, "pages")).select("page_id", "place", "text", "link", "status")


def card_pages(spark, sf):
    """A page of cards for each user: fuel said to be there, said to be gone, or only mentioned."""
    e = V.events(spark, sf)
    said = F.when(F.col("event_type") == "purchase", "есть топливо · АИ-95, ДТ").when(F.col("event_type") == "click", "есть топливо · 92").when(F.col("event_type") == "error", "Нет  топлива").otherwise("Обновлено 95 минут назад")
    queue = F.when(F.col("k") % 4 == 0, F.concat(F.lit(", Очередь "), F.col("k").cast("string"), F.lit(" машин; цена"))).otherwise("")
    card = F.concat(F.lit('<div class="stn" data-osm="'), F.when(F.col("k") % 7 > 0, F.col("event_id").cast("string")).otherwise(""), F.lit('" data-coordinates="'), F.when(F.col("k") % 5 > 0, "44.5,48.7").otherwise("44.5"), F.lit('"><b>S'), F.col("k").cast("string"), F.lit("</b>\n<i>"), said, queue, F.lit("</i></div>"))
    return e.groupBy(F.col("entity").alias("page_id")).agg(F.concat(F.lit("<html>"), F.array_join(F.array_sort(F.collect_list(card)), " "), F.lit("</html>")).alias("html"))


@query("a5_card_stations", f"""WITH {V.EVENTS} SELECT entity AS page_id, CASE WHEN k % 7 > 0 THEN event_id::VARCHAR ELSE 'card' END AS station, CASE WHEN k % 5 > 0 THEN 44.5 END AS lon, CASE WHEN k % 5 > 0 THEN 48.7 END AS lat, 'S' || k AS title,
CASE event_type WHEN 'purchase' THEN 'IN_STOCK' WHEN 'error' THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS status, event_type = 'error' AS family_all, CASE WHEN k % 4 = 0 THEN 'Очередь ' || k || ' машин' END AS queue FROM e""")
def a5_stations(spark, sf):
    found = P.cards(card_pages(spark, sf), r"(?s)(<div class=.stn.*?)</div>")
    return found.select("page_id", F.regexp_replace("station", "^card-.*", "card").alias("station"), "lon", "lat", "title", "status", "family_all", "queue")


@query("a6_merge_batches", f"WITH {V.EVENTS}, b AS (SELECT entity AS id, t // 86400 AS batch, max(k) AS k, min(event_type) AS title FROM e GROUP BY 1, 2) SELECT id, batch, k, title FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC) = 1")
def a6(spark, sf):
    e = V.events(spark, sf)
    s = e.groupBy(F.col("entity").alias("id"), F.floor(F.col("t") / 86400).alias("batch")).agg(F.max("k").alias("k"), F.min("event_type").alias("title"))
    o = e.select(F.floor(F.col("t") / 86400).alias("batch"), F.col("entity").alias("station"), F.col("k").alias("fuel"), F.col("event_type").alias("status"), F.floor(F.col("t") / 86400).alias("at"))
    return P.merge_batches(s, o)[0]


@query("a6_merged_observations", f"WITH {V.EVENTS} SELECT DISTINCT entity AS station, k AS fuel, event_type AS status, t // 86400 AS at FROM e")
def a6o(spark, sf):
    e = V.events(spark, sf)
    o = e.select(F.floor(F.col("t") / 86400).alias("batch"), F.col("entity").alias("station"), F.col("k").alias("fuel"), F.col("event_type").alias("status"), F.floor(F.col("t") / 86400).alias("at"))
    return P.merge_batches(e.select(F.col("entity").alias("id"), F.col("t").alias("batch")), o)[1].select("station", "fuel", "status", "at")


def _batches(spark, sf):
    e = V.events(spark, sf).withColumn("batch", F.floor(F.col("t") / 86400))
    stations = e.select("batch", F.col("entity").alias("id"))
    observations = e.select("batch", F.col("entity").alias("station"), F.col("k").alias("fuel"), F.col("event_type").alias("status"), F.lit(0).alias("at"))
    queues = e.select("batch", F.col("entity").alias("station"), F.col("event_type").alias("value"), (F.col("t") % 3).alias("at"), F.col("t").alias("seen"))
    return P.merge_batches(stations, observations, queues, e.select("batch", "entity", "event_type", (F.col("k") % 5).alias("grade")))


@query("a6_merged_queues", f"WITH {V.EVENTS} SELECT entity AS station, event_type AS value, t % 3 AS at, max(t) AS seen FROM e GROUP BY 1, 2, 3")
def a6q(spark, sf):
    return _batches(spark, sf)[2].select("station", "value", "at", "seen")


@query("a6_merged_activity", f"WITH {V.EVENTS} SELECT DISTINCT entity, event_type, k % 5 AS grade FROM e")
def a6a(spark, sf):
    return _batches(spark, sf)[3].select("entity", "event_type", "grade")


def _results(spark, sf):
    """Four sources: signups enumerate a station, some without a place; other events are rows about stations."""
    e = V.events(spark, sf).withColumns({"source": F.element_at(F.array(*[F.lit(s) for s in V.SOURCES]), (F.col("entity") % 4 + 1).cast("int")), "station": F.when(F.col("k") % 19 > 0, F.col("entity").cast("string")).otherwise("")})
    stations = e.where("event_type = 'signup'").select("source", F.col("entity").cast("string").alias("station"), F.when((F.col("source") != "delta") | (F.col("k") % 2 == 0), 44.5).alias("lon"), F.lit(48.7).alias("lat"))
    rows = {
        "observations": e.where("event_type = 'purchase'").select("source", "station", "event_id", F.when(F.col("k") % 5 > 0, "AI95_BASE").alias("product_key"), F.lit("EXACT_VARIANT").alias("specificity")),
        "queues": e.where("event_type = 'click'").select("source", "station", "event_id"),
        "activity": e.where("event_type = 'error'").select("source", "station", "event_id"),
    }
    facts = spark.createDataFrame([("alpha", False, None, 0.0), ("beta", True, "TRUNCATED", 1.0), ("gamma", False, None, None), ("omega", True, "TIMEOUT", None)], "source string, partial boolean, code string, history_coverage double")
    return stations, rows, facts


_RESULTS = f"""{V.EVENTS}, rs AS (SELECT *, ['alpha', 'beta', 'gamma', 'delta'][entity % 4 + 1] AS source, CASE WHEN k % 19 > 0 THEN entity::VARCHAR ELSE '' END AS station FROM e), en AS (SELECT source, entity::VARCHAR AS station, source <> 'delta' OR k % 2 = 0 AS placed FROM rs WHERE event_type = 'signup'),
mk AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'observations' WHEN 'click' THEN 'queues' WHEN 'error' THEN 'activity' END AS type, CASE WHEN station = '' THEN 'NO_STATION' WHEN station NOT IN (SELECT station FROM en) THEN 'NOT_ENUMERATED' WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'UNCLASSIFIED' END AS reason FROM rs WHERE event_type IN ('purchase', 'click', 'error'))"""


@query("a7_checked_rows", f"""WITH {_RESULTS} SELECT type, event_id, CASE WHEN type = 'observations' THEN c END AS capability, CASE WHEN type = 'observations' THEN CASE c WHEN 'CURRENT_FAMILY' THEN 'FAMILY_ONLY' WHEN 'CATALOG_ONLY' THEN 'CATALOG_ONLY' ELSE 'EXACT_VARIANT' END END AS specificity, CASE WHEN type = 'observations' THEN CASE c WHEN 'CURRENT_FAMILY' THEN 'AI95_FAMILY' ELSE 'AI95_BASE' END END AS product_key
FROM mk, (SELECT unnest(['CURRENT_GRADE', 'CURRENT_FAMILY', 'CATALOG_ONLY']) AS c) WHERE reason IS NULL AND (type = 'observations' OR c = 'CURRENT_GRADE')""")
def a7_rows(spark, sf):
    stations, rows, facts = _results(spark, sf)
    kept, _, _, _ = P.checked(stations, rows, Scratch(spark, "checked"), "CURRENT_GRADE", facts)
    out = kept["queues"].selectExpr("'queues' as type", "event_id", "string(null) as capability", "string(null) as specificity", "string(null) as product_key")
    out = out.unionByName(kept["activity"].selectExpr("'activity' as type", "event_id", "string(null) as capability", "string(null) as specificity", "string(null) as product_key"))
    for capability in ("CURRENT_GRADE", "CURRENT_FAMILY", "CATALOG_ONLY"):
        made = kept["observations"] if capability == "CURRENT_GRADE" else P.lowered(kept["observations"], capability)
        out = out.unionByName(made.select(F.lit("observations").alias("type"), "event_id", F.lit(capability).alias("capability"), "specificity", "product_key"))
    return out


@query("a7_rejects", f"WITH {_RESULTS} SELECT type, source, reason, count(*) AS n FROM mk WHERE reason IS NOT NULL GROUP BY ALL")
def a7_rejects(spark, sf):
    stations, rows, facts = _results(spark, sf)
    return P.checked(stations, rows, Scratch(spark, "checked"), facts=facts)[1].groupBy("type", "source", "reason").agg(F.count("*").alias("n"))


@query("a7_health", f"""WITH {_RESULTS}, n AS (SELECT source, count(*) AS stations, count(*) FILTER (NOT placed) AS unlocated FROM en GROUP BY 1), f AS (FROM (VALUES ('alpha', false, NULL, 0.0), ('beta', true, 'TRUNCATED', 1.0), ('gamma', false, NULL, NULL), ('omega', true, 'TIMEOUT', NULL)) v(source, partial, code, history))
SELECT source, CASE WHEN coalesce(partial, false) OR coalesce(unlocated, 0) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status, coalesce(code, CASE WHEN unlocated > 0 THEN 'COORDINATE_COVERAGE' WHEN history = 0 THEN 'ACTIVITY_HISTORY_UNAVAILABLE' END) AS code, coalesce(stations, 0) AS stations, coalesce(unlocated, 0) AS unlocated FROM n FULL JOIN f USING (source)""")
def a7_health(spark, sf):
    stations, rows, facts = _results(spark, sf)
    return P.checked(stations, rows, Scratch(spark, "checked"), facts=facts)[2]


@query("a7_conform", f"WITH {V.EVENTS} SELECT event_id, 'FAMILY_ONLY' AS specificity, 'AI95_FAMILY' AS product_key FROM e WHERE entity IN (SELECT entity FROM e WHERE event_type = 'signup') AND k % 5 > 0")
def a7(spark, sf):
    e = V.events(spark, sf).withColumns({"source": F.lit("s"), "station": F.col("entity"), "product_key": F.when(F.col("k") % 5 > 0, "AI95_BASE"), "specificity": F.lit("EXACT_VARIANT")})
    return P.conform(e.where("event_type = 'signup'"), e, "CURRENT_FAMILY").select("event_id", "specificity", "product_key")


def _activity(spark, sf):
    e = V.events(spark, sf)
    kind = F.when(F.col("event_type") == "purchase", "SOURCE_REPORTED_TRANSITION").when(F.col("event_type") == "click", "TRANSACTIONS_RESUMED").when(F.col("event_type") == "error", "PETROL_STATUS_SNAPSHOT").otherwise("RECENT_SIGNAL")
    return e.select("event_id", F.lit("a").alias("area"), F.lit("q").alias("query"), F.col("entity").alias("station"), kind.alias("kind"), (F.col("k") % 10).alias("field"), F.col("t").alias("fetched_at"), F.when(F.col("k") % 4 > 0, F.col("t") - 300).alias("observed_at"), F.when(F.col("k") % 4 > 1, F.col("t") - 600).alias("resumed_at"), (F.col("t") - 900).alias("latest_event_at"))


_KIND = "CASE event_type WHEN 'purchase' THEN 'SOURCE_REPORTED_TRANSITION' WHEN 'click' THEN 'TRANSACTIONS_RESUMED' WHEN 'error' THEN 'PETROL_STATUS_SNAPSHOT' ELSE 'RECENT_SIGNAL' END"


@query("a10_event_dedupe", f"WITH {V.EVENTS}, x AS (SELECT event_id, entity AS station, {_KIND} AS kind, k % 10 AS field, t FROM e) SELECT event_id FROM x WHERE kind IN ('PETROL_STATUS_SNAPSHOT', 'RECENT_SIGNAL') UNION ALL (SELECT event_id FROM x WHERE kind NOT IN ('PETROL_STATUS_SNAPSHOT', 'RECENT_SIGNAL') QUALIFY row_number() OVER (PARTITION BY station, kind, field ORDER BY t) = 1)")
def a10(spark, sf):
    return store.once_per_scope(_activity(spark, sf), ["field"]).select("event_id")


_CUT = V.NOW - 5 * 86400


@query("a11_compact_activity", f"WITH {V.EVENTS}, x AS (SELECT event_id, {_KIND} AS kind, CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 4 > 0 THEN t - 300 END ELSE CASE WHEN k % 4 > 1 THEN t - 600 ELSE t - 900 END END AS at FROM e) SELECT event_id FROM x WHERE kind = 'PETROL_STATUS_SNAPSHOT' OR kind <> 'RECENT_SIGNAL' AND at >= {_CUT}")
def a11(spark, sf):
    return store.compact(_activity(spark, sf), _CUT).select("event_id")


@query("a8_a12_day_partitions", f"WITH {V.EVENTS} SELECT event_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day FROM e WHERE t >= {_CUT}")
def a12(spark, sf):
    path = Scratch(spark, "ticks").path()
    store.write_ticks(V.events(spark, sf).withColumn("fetched_at", F.col("t")), path)
    return store.read_ticks(spark, path, _CUT).select("event_id", F.col("day").cast("string").alias("day"))


def _sightings(spark, sf):
    e = V.events(spark, sf)
    return e.select("event_id", F.col("entity").alias("station"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("t"), (F.col("k") % 3).cast("string"))).alias("title"), F.when(F.col("k") % 5 > 3, "b").alias("brand"), F.col("event_type").alias("address"), F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).alias("lon"), F.when(F.col("k") % 2 == 0, 1.0).alias("lat"), F.col("t").alias("fetched_at"), F.col("event_id").alias("order"))


SIGHT = "si AS (SELECT event_id, entity AS station, CASE WHEN k % 3 > 0 THEN 't' || k % 3 END AS title, CASE WHEN k % 5 > 3 THEN 'b' END AS brand, event_type AS address, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS lon, t AS fetched_at FROM e)"
_DIM = """lb AS (SELECT station, list(coalesce(title, '-') || '/' || coalesce(brand, '-') ORDER BY since) AS labels FROM (SELECT station, title, brand, min(fetched_at) AS since FROM si GROUP BY ALL) GROUP BY 1),
dm AS (SELECT station, arg_max(title, fetched_at) FILTER (title IS NOT NULL) AS title, arg_max(brand, fetched_at) FILTER (brand IS NOT NULL) AS brand, arg_max(address, fetched_at) AS address, arg_max(lon, fetched_at) FILTER (lon IS NOT NULL) AS lon, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen FROM si GROUP BY 1)"""


@query("a15_station_dimension", f"WITH {V.EVENTS}, {SIGHT}, {_DIM} SELECT dm.*, array_to_string(labels, ',') AS labels FROM dm JOIN lb USING (station)")
def a15(spark, sf):
    d = store.station_dimension(_sightings(spark, sf))
    said = F.transform("labels", lambda x: F.concat(F.coalesce(x["title"], F.lit("-")), F.lit("/"), F.coalesce(x["brand"], F.lit("-"))))
    return d.select("station", "title", "brand", "address", "lon", "first_seen", "last_seen", F.array_join(said, ",").alias("labels"))


def _said_labels(dimension):
    said = F.transform("labels", lambda x: F.concat(F.coalesce(x["title"], F.lit("-")), F.lit("/"), F.coalesce(x["brand"], F.lit("-"))))
    return dimension.select("station", "title", "brand", "address", "lon", "first_seen", "last_seen", F.array_join(said, ",").alias("labels"))


def _upserted(spark, sf, spans: int = 4):
    """The dimension after sightings were merged in span by span; the folder that holds it."""
    scratch = Scratch(spark, "dimension")
    root, s = scratch.path(), _sightings(spark, sf)
    low, high = s.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    width = max(1, -(-((high or 0) + 1 - (low or 0)) // spans))
    for i in range(spans):
        store.upsert_stations(spark, root, s.where(F.floor((F.col("fetched_at") - (low or 0)) / width) == i))
    return root


@query("a15_upserted_dimension", f"WITH {V.EVENTS}, {SIGHT}, {_DIM} SELECT dm.*, array_to_string(labels, ',') AS labels FROM dm JOIN lb USING (station)")
def a15_upserted(spark, sf):
    return _said_labels(store.told_stations(store.current(spark, _upserted(spark, sf))))


@query("a16_expired_stations", f"WITH {V.EVENTS} SELECT entity AS station, max(t) AS last_seen FROM e GROUP BY 1 HAVING max(t) >= {V.NOW} - 7 * 86400")
def a16_stations(spark, sf):
    return store.expire_stations(spark, _upserted(spark, sf, 2), V.NOW, 7).select("station", "last_seen")


@query("a16_expired_days", f"WITH {V.EVENTS} SELECT event_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day FROM e WHERE (t // 86400 + 1) * 86400 > {V.NOW} - 7 * 86400 - 43200")
def a16_days(spark, sf):
    """What is left on disk: whole days, the partly expired one too."""
    path = Scratch(spark, "expiring").path()
    store.write_ticks(V.events(spark, sf).withColumn("fetched_at", F.col("t")), path)
    store.expire_days(spark, path, V.NOW, 7, 43200)
    return store.read_ticks(spark, path).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("a14_rehydrate", f"WITH {V.EVENTS}, {SIGHT}, {_DIM} SELECT event_id, CASE WHEN labels[event_id % 2 + 1] <> '-/-' THEN split_part(labels[event_id % 2 + 1], '/', 1) END AS title, dm.address, dm.lon FROM si JOIN dm USING (station) JOIN lb USING (station)")
def a14(spark, sf):
    s = _sightings(spark, sf)
    stored = s.select("event_id", "station", (F.col("event_id") % 2).alias("label"))
    out = store.rehydrate(stored, store.station_dimension(s))
    known = F.coalesce("title", F.lit("-"))
    return out.select("event_id", F.when(F.col("title").isNull() & F.col("brand").isNull(), F.lit(None).cast("string")).otherwise(known).alias("title"), "address", "lon")


@query("a16_retention", f"WITH {V.EVENTS} SELECT event_id FROM e WHERE t >= {V.NOW} - 7 * 86400")
def a16(spark, sf):
    return store.retained(V.events(spark, sf).withColumn("fetched_at", F.col("t")), V.NOW, 7).select("event_id")


def _stored_lines(spark, sf):
    """JSON lines of the events, in the shared folder: every seventh is torn, every eleventh has no stations."""
    e = V.events(spark, sf)
    line = F.to_json(F.struct(F.col("t").alias("fetched_at"), F.when(F.col("event_id") % 11 > 0, F.array(F.col("entity").cast("string"))).alias("stations"), "event_id"))
    path = Scratch(spark, "lines").path()
    e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return store.read_lines(spark, path, "fetched_at long, stations array<string>, event_id long")


@query("a13_readable_lines", f"WITH {V.EVENTS} SELECT event_id, t AS fetched_at, entity::VARCHAR AS station FROM e WHERE event_id % 7 > 0 AND event_id % 11 > 0")
def a13(spark, sf):
    return _stored_lines(spark, sf)[0].select("event_id", "fetched_at", F.get("stations", F.lit(0)).alias("station"))


@query("a13_corrupt_lines", f"WITH {V.EVENTS} SELECT count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS corrupt FROM e")
def a13c(spark, sf):
    return _stored_lines(spark, sf)[1]


@query("a18_snapshot_sink", f"""WITH {V.EVENTS}, x AS (SELECT event_id, entity, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day FROM e), l AS (SELECT max(day) AS last FROM x)
SELECT event_id, day, day = last AS replaced FROM x, l WHERE day < last OR entity % 2 = 0""")
def a18(spark, sf):
    path = Scratch(spark, "snapshots").path()
    rows = V.events(spark, sf).select("event_id", "entity", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("day"), F.lit(False).alias("replaced"))
    store.write_snapshot(rows, path)
    last = rows.agg(F.max("day").alias("day"))
    store.write_snapshot(rows.where("entity % 2 = 0").join(last, "day", "left_semi").withColumn("replaced", F.lit(True)).select(*rows.columns), path)
    return spark.read.parquet(path).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "replaced")


@query("a18_versioned_snapshot", f"WITH {V.EVENTS} SELECT event_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day, 2 AS version FROM e WHERE entity % 2 = 0")
def a18_versions(spark, sf):
    """A snapshot of many days replaced by another: no day of the first is left, none of the second is missing."""
    root = Scratch(spark, "versions").path()
    rows = V.events(spark, sf).select("event_id", "entity", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("day"))
    store.publish(rows.withColumn("version", F.lit(1)), root, ["day"])
    store.publish(rows.where("entity % 2 = 0").withColumn("version", F.lit(2)), root, ["day"])
    return store.current(spark, root).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "version")
