"""Payload jobs: stored JSON payloads of four kinds of source into typed rows.

payloads has (source, fetched_at seconds, payload). Each function parses with an explicit schema, or walks a tree of
unknown shape, and returns stations, observations, queues and activity in plain columns, built-in expressions only. A
payload is a list of stations, bare or under `stations`; stations without an id or with unreadable coordinates are left
out. `conform` then holds a result against its contract and tells the source's health.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from sightline.functions import text as X
from sightline.tables import Scratch

TIMELINE = "array<struct<id string, osm_id string, lon string, lat string, name string, brand string, addr string, detail string, status string, last_at string, fuels_now string, catalogue array<string>, comments array<struct<created_at string, status string, detail string>>>>"
STATUSES = "array<struct<station struct<id string, lng string, lat string, name string, address string, brand string>, fuel_statuses array<struct<fuel_type string, available boolean, last_report_at string, limit_liters double, queue_level string>>, limit_liters double, queue_level string, fuel_assortment array<string>>>"
EXHAUSTIVE = "array<struct<id string, lon string, lat string, name string, brand string, address string, st struct<status string, updated_at string, fuels_now array<string>, fuels_out array<string>, conflict struct<created_at string, text string>, queue string>, limits array<struct<grade string, liters double, since string>>, fuels array<string>, recent array<struct<created_at string, status string, detail string, fuel_grades array<string>>>>>"

#: Fixed value: a token that a list of fuels may consist of.
FUEL_TOKEN = r"(?iu)^(?:(?:аи|ai)[-\s]?)?(?:92|95|98|100)\+?$|^(?:аи|ai|дт|дизел\p{L}*|газ|пропан|метан|снг|гбо)$"
NO_FUEL = r"(?iu)нет\s+топлива|заправка\s+не\s+работает"
GRADE = r"(?<![0-9])(92|95|98|100)(?![0-9])"


def grades(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GRADE), F.lit(1)))


def fuel_segments(text: Column) -> Column:
    """The segments of a card (between ·) in which every token is a fuel token, joined by commas."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "·"), lambda s: F.btrim(s))
    tokens = lambda s: F.filter(F.split(s, r"[,;/]|\s+"), lambda t: t != "")
    return F.array_join(F.filter(parts, lambda s: (F.size(tokens(s)) > 0) & F.forall(tokens(s), lambda t: t.rlike(FUEL_TOKEN))), ", ")


def rows_of(payloads: DataFrame, schema: str) -> DataFrame:
    """One row for each station record of a payload, whether the list is bare or under `stations`."""
    listed = F.when(F.ltrim("payload").startswith("{"), F.from_json("payload", f"struct<stations: {schema}>")["stations"]).otherwise(F.from_json("payload", schema))
    return payloads.select("source", "fetched_at", F.explode(listed).alias("r"))


def instant(text: Column) -> Column:
    """Epoch seconds of an ISO text or of `YYYY-MM-DD HH:MM:SS` read as UTC; null if it does not parse."""
    return F.unix_seconds(F.try_to_timestamp(text))


def located(rows: DataFrame, ident: str, lon: str, lat: str) -> DataFrame:
    x, y = X.coordinate(F.col(lon), F.col(lat))
    return rows.withColumns({"station": F.btrim(F.col(ident)), "lon": x, "lat": y}).where("station <> '' and lon is not null and lat is not null")


#: What a source writes for the number of waiting vehicles.
QUEUE_SIZES = [("VERY_LONG", r"100\s*\+"), ("LONG", r"(?:50\s*[–—-]\s*100|20\s*[–—-]\s*50)"), ("MEDIUM", r"5\s*[–—-]\s*20")]
FUEL_NAME = r"(?iu)(?:^|[^\p{L}\p{N}])(?:дт|дизел\p{L}*|92|95|98|100)(?:[^\p{L}\p{N}]|$)"


def said_no(sign: Column, detail: Column, listed: Column | None = None) -> Column:
    """Whether a report says that there is no fuel at all: no, and no fuel named before the first ·."""
    head = F.coalesce(F.get(F.split(F.coalesce(detail, F.lit("")), "·"), F.lit(0)), F.lit(""))
    words = F.coalesce(detail.rlike(r"(?iu)нет\s+(?:топлива|бензина)|заправка\s+не\s+работает"), F.lit(False))
    named = head.rlike(FUEL_NAME)
    if listed is not None:
        named, words = named | F.coalesce(F.size(listed) > 0, F.lit(False)), words | listed.isNotNull()
    return (sign == -1) & ~named & words


def report_rows(said: DataFrame) -> DataFrame:
    """One row for each grade that a report (.., at, sign, g array, family) names; a null grade for the whole family."""
    spread = F.explode(F.when(F.size("g") > 0, F.col("g")).when(F.col("family"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    return said.where("at is not null and sign <> 0").select("source", "station", "at", "sign", spread.alias("grade"))


def recent_signals(reports: DataFrame) -> DataFrame:
    """Activity (source, station, grade, kind, status, at, event_times): when a station's grade was reported there."""
    seen = reports.where("sign = 1 and grade is not null").groupBy("source", "station", "grade").agg(F.array_sort(F.collect_list("at")).alias("event_times"))
    return seen.select("source", "station", "grade", F.lit("RECENT_SIGNAL").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("at"), "event_times")


def snapshots(rows: DataFrame, grade: Column, status: Column, at: Column) -> DataFrame:
    """Activity that says how each grade of a station stands."""
    return rows.select("source", "station", grade.alias("grade"), F.lit("PETROL_STATUS_SNAPSHOT").alias("kind"), status.alias("status"), at.alias("at"), F.lit(None).cast("array<long>").alias("event_times"))


def report_sign(status: Column) -> Column:
    return F.when(F.lower(status) == "no", -1).when(F.lower(status).isin("yes", "queue"), 1).otherwise(0)


def timeline(payloads: DataFrame) -> dict[str, DataFrame]:
    """Stations, observations, reports, queues and activity of a source whose cards carry user comments.

    The card's text and the hidden list name grades independently; where both name something and only one has the
    grade, the status is uncertain and both texts are kept. A queue is what the card says after the word for it.
    """
    named_rows = rows_of(payloads, TIMELINE).withColumn("id", F.coalesce(*[F.when(F.btrim(c) != "", c) for c in (F.col("r.osm_id"), F.col("r.id"))]))
    rows = located(named_rows, "id", "r.lon", "r.lat")
    detail, last = F.coalesce(F.col("r.detail"), F.lit("")), instant(F.col("r.last_at"))
    litres, named = X.litre_limit(detail)
    stations = rows.select("source", "station", "lon", "lat", F.coalesce(F.col("r.name"), F.col("r.brand")).alias("title"), F.col("r.brand").alias("brand"), F.col("r.addr").alias("address"), X.assortment(F.col("r.catalogue")).alias("assortment"), litres.alias("limit_liters"), named.alias("limit_grade"))
    seen = rows.withColumns({"visible": fuel_segments(F.col("r.detail")), "hidden": F.coalesce(F.col("r.fuels_now"), F.lit(""))}).withColumns({"va": grades(F.col("visible")), "ha": grades(F.col("hidden"))})
    both = (F.btrim("visible") != "") & (F.btrim("hidden") != "")
    disputed = lambda grade: both & (F.array_contains("va", grade) != F.array_contains("ha", grade))
    gone = (F.lower(F.coalesce(F.col("r.status"), F.lit(""))) == "no") | F.coalesce(F.col("r.detail").rlike(NO_FUEL), F.lit(False))
    known = F.array_contains("va", "95") | F.array_contains("ha", "95")
    status = F.when(gone, "OUT_OF_STOCK").when(disputed(F.lit("95")), "UNCERTAIN").when(known, "IN_STOCK").otherwise("UNKNOWN")
    observations = seen.select("source", "station", status.alias("status"), gone.alias("family_all"), last.alias("at"), F.when(disputed(F.lit("95")) & ~gone, F.concat_ws(" | ", "visible", "hidden")).alias("conflict"))
    comments = rows.select("source", "station", F.explode("r.comments").alias("c"))
    sign = report_sign(F.col("c.status"))
    said = comments.select("source", "station", instant(F.col("c.created_at")).alias("at"), sign.alias("sign"), grades(fuel_segments(F.col("c.detail"))).alias("g"), said_no(sign, F.col("c.detail")).alias("family"))
    reports = report_rows(said)
    each = seen.withColumn("gone", gone).withColumn("both", both).select("source", "station", "gone", "both", "va", "ha", last.alias("last"), F.explode(F.array_union("ha", "va")).alias("grade"))
    one_sided = F.col("both") & (F.array_contains("va", F.col("grade")) != F.array_contains("ha", F.col("grade")))
    standing = snapshots(each, F.col("grade"), F.when(F.col("gone"), "OUT_OF_STOCK").when(one_sided, "UNCERTAIN").otherwise("IN_STOCK"), F.col("last"))
    value = F.btrim(F.regexp_extract(detail, r"(?iu)очередь\s*([^·,;]*)", 1))
    queues = rows.select("source", "station", value.alias("value"), F.coalesce(X.ordinal(value), X.first_match(value, QUEUE_SIZES)).alias("ordinal"), F.lit(None).cast("double").alias("vehicles"), last.alias("at")).where("value <> ''")
    return {"stations": stations, "observations": observations, "reports": reports, "queues": queues, "activity": standing.unionByName(recent_signals(reports))}


def statuses(payloads: DataFrame) -> dict[str, DataFrame]:
    """Stations (with limits), one observation per grade, and queues of a source with a status per grade."""
    rows = located(rows_of(payloads, STATUSES), "r.station.id", "r.station.lng", "r.station.lat")
    caps = F.filter(F.concat(F.transform("r.fuel_statuses", lambda f: F.struct(f["fuel_type"].alias("grade"), f["limit_liters"].alias("liters"))), F.array(F.struct(F.lit(None).cast("string").alias("grade"), F.col("r.limit_liters").alias("liters")))), lambda x: x["liters"] > 0)
    stations = rows.select("source", "station", "lon", "lat", F.col("r.station.name").alias("title"), F.col("r.station.address").alias("address"), X.assortment(F.col("r.fuel_assortment")).alias("assortment"), caps.alias("limits"))
    each = rows.select("source", "station", F.explode("r.fuel_statuses").alias("f"))
    observations = each.select("source", "station", F.col("f.fuel_type").alias("grade"), F.when(F.col("f.available"), "IN_STOCK").when(~F.col("f.available"), "OUT_OF_STOCK").otherwise("UNKNOWN").alias("status"), instant(F.col("f.last_report_at")).alias("at"))
    level = F.coalesce(F.col("r.queue_level"), F.get(F.filter(F.transform("r.fuel_statuses", lambda f: f["queue_level"]), lambda q: q.isNotNull() & (q != "NONE")), F.lit(0)))
    newest = F.array_max(F.transform("r.fuel_statuses", lambda f: instant(f["last_report_at"])))
    word = F.when(level == "OVER_50", "VERY_LONG").when(level.isin("FROM_25_TO_50", "UP_TO_25"), "LONG")
    queues = rows.select("source", "station", level.alias("value"), F.coalesce(X.ordinal(level), word).alias("ordinal"), newest.alias("at")).where("value <> 'NONE'")
    return {"stations": stations, "observations": observations, "queues": queues}


def exhaustive(payloads: DataFrame) -> dict[str, DataFrame]:
    """Stations, observations, reports, queues and activity of a source with full lists.

    Observations are (source, station, grade or null for the family, status, family_all, at). A conflict that is not
    strictly older than the status makes it uncertain; a list of what there is says that what it leaves out is gone. A
    limit carries the time since when it is in force, never the time of an observation.
    """
    rows = located(rows_of(payloads, EXHAUSTIVE), "r.id", "r.lon", "r.lat")
    st = F.col("r.st")
    now, out = F.coalesce(st["fuels_now"], F.array().cast("array<string>")), F.coalesce(st["fuels_out"], F.array().cast("array<string>"))
    caps = F.filter(F.transform(F.coalesce(F.col("r.limits"), F.array().cast("array<struct<grade string, liters double, since string>>")), lambda x: F.struct(F.btrim(x["grade"]).alias("grade"), x["liters"].alias("liters"), instant(x["since"]).alias("in_force_since"))), lambda x: x["liters"] > 0)
    stations = rows.select("source", "station", "lon", "lat", F.coalesce(F.col("r.name"), F.col("r.brand")).alias("title"), F.col("r.brand").alias("brand"), F.col("r.address").alias("address"), X.assortment(F.col("r.fuels")).alias("assortment"), F.when(F.size(caps) > 0, caps).alias("limits"))
    mine = F.filter(now, lambda f: F.array_contains(grades(f), "95"))
    at, clash = instant(st["updated_at"]), instant(st["conflict"]["created_at"])
    active = st["conflict"].isNotNull() & ~F.coalesce(clash < at, F.lit(False))
    gone = F.lower(F.coalesce(st["status"], F.lit(""))) == "no"
    listed_out = F.exists(out, lambda f: F.array_contains(grades(f), "95"))
    family = F.array(F.lit(None).cast("string"))
    some = F.size(mine) > 0
    status = F.when(active, "UNCERTAIN").when(gone, "OUT_OF_STOCK").when(some, "IN_STOCK").when((F.size(now) > 0) | listed_out, "OUT_OF_STOCK").otherwise("UNKNOWN")
    labels = F.when(active & some, mine).when(~active & ~gone & some, mine).otherwise(family)
    cut = rows.select("source", "station", status.alias("status"), F.when(active, clash).otherwise(at).alias("at"), F.explode(labels).alias("grade"))
    observations = cut.select("source", "station", "grade", "status", (F.col("status") == "OUT_OF_STOCK").alias("family_all"), "at")

    recent = rows.select("source", "station", F.explode("r.recent").alias("c"))
    sign, listed = report_sign(F.col("c.status")), F.col("c.fuel_grades")
    head = F.coalesce(F.get(F.split(F.coalesce(F.col("c.detail"), F.lit("")), "·"), F.lit(0)), F.lit(""))
    from_text = F.when(head.rlike(r"(?iu)очеред|лимит|цена"), F.array().cast("array<string>")).otherwise(grades(head))
    said = recent.select("source", "station", instant(F.col("c.created_at")).alias("at"), sign.alias("sign"), F.when(listed.isNotNull(), grades(F.array_join(listed, ","))).otherwise(from_text).alias("g"), said_no(sign, F.col("c.detail"), listed).alias("family"))
    reports = report_rows(said)

    named = lambda x: grades(F.array_join(x, ","))
    told = F.flatten(F.transform(F.coalesce(F.col("r.recent"), F.array().cast("array<struct<created_at string, status string, detail string, fuel_grades array<string>>>")), lambda c: F.when(c["fuel_grades"].isNotNull(), named(c["fuel_grades"])).otherwise(F.when(F.coalesce(F.get(F.split(c["detail"], "·"), F.lit(0)), F.lit("")).rlike(r"(?iu)очеред|лимит|цена"), F.array().cast("array<string>")).otherwise(grades(F.get(F.split(F.coalesce(c["detail"], F.lit("")), "·"), F.lit(0)))))))
    known = F.array_distinct(F.concat(named(F.coalesce(F.col("r.fuels"), F.array().cast("array<string>"))), named(now), named(out), told))
    each = rows.select("source", "station", at.alias("last"), active.alias("active"), gone.alias("gone"), named(now).alias("there"), named(out).alias("out"), (F.size(now) > 0).alias("lists"), F.explode(known).alias("grade"))
    grade = F.col("grade")
    stands = F.when(F.col("active"), "UNCERTAIN").when(F.col("gone") | F.array_contains("out", grade) | (F.col("lists") & ~F.array_contains("there", grade)), "OUT_OF_STOCK").when(F.array_contains("there", grade), "IN_STOCK").otherwise("UNKNOWN")
    standing = snapshots(each, grade, stands, F.col("last"))

    raw = st["queue"]
    inside = raw.startswith("{")
    field = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names])
    value = F.when(inside, field("size", "label", "level", "status", "value")).otherwise(raw)
    token = F.when(value.rlike("(?i)^20[_-]50$"), "LONG").when(value.rlike(r"(?i)^(?:gt50|50\+|over_50)$"), "VERY_LONG")
    queues = rows.where(F.coalesce(raw, F.lit("")) != "").select("source", "station", value.alias("value"), F.coalesce(X.ordinal(value), token).alias("ordinal"), F.when(inside, field("vehicle_count", "vehicleCount", "count").try_cast("double")).alias("vehicles"), F.when(inside, instant(field("at"))).alias("at"))
    return {"stations": stations, "observations": observations, "reports": reports, "queues": queues, "activity": standing.unionByName(recent_signals(reports))}


def scalar(node: Column, *paths: str) -> Column:
    """The first of the paths that says something, as text: no empty text, zero or false (the text "0" does)."""

    def said(path: str) -> Column:
        text = F.try_variant_get(node, path, "string")
        hollow = text.isin("0", "false") & (F.schema_of_variant(F.try_variant_get(node, path, "variant")) != "STRING")
        return F.when((text != "") & ~hollow, text)

    return F.coalesce(*map(said, paths))


def stamp(node: Column, *paths: str) -> Column:
    """Epoch seconds of the first path that holds a time: a number of seconds or milliseconds, or an ISO text."""
    text = scalar(node, *paths)
    return F.coalesce(X.epoch_time(text.try_cast("double")), instant(text).cast("double"))


def parts(node: Column) -> Column:
    """(key, value) of what an object or array directly holds; the key of an array's element is null."""
    kind = "array<struct<key string, value variant>>"
    pairs = F.transform(F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    return F.coalesce(pairs, listed, F.array().cast(kind))


def nests(node: Column) -> Column:
    return F.schema_of_variant(node).rlike("^(OBJECT|ARRAY)<.+>$")


def walk(payloads: DataFrame, scratch: Scratch, depth: int = 10) -> DataFrame:
    """All objects of JSON payloads at any place: rows (source, fetched_at, payload_id, path, node).

    The trees are descended level by level, each level a written table, until nothing nests any more or `depth` levels
    are seen. `path` has the place of each step; keys of an object are taken in their order as text.
    """
    level = payloads.select("source", "fetched_at", F.xxhash64("source", "fetched_at", "payload").alias("payload_id"), F.array().cast("array<int>").alias("path"), F.try_parse_json("payload").alias("node")).where(F.col("node").isNotNull() & nests(F.col("node")))
    out = None
    for _ in range(depth + 1):
        level = scratch.keep(level)
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        below = level.select("source", "fetched_at", "payload_id", "path", F.posexplode(F.transform(parts(F.col("node")), lambda p: p["value"])).alias("place", "node"))
        level = below.select("source", "fetched_at", "payload_id", F.concat("path", F.array("place")).alias("path"), "node").where(F.col("node").isNotNull() & nests(F.col("node")))
    out = level if out is None else out
    return out.where(F.schema_of_variant("node").startswith("OBJECT"))


GASOLINE = r"(?iu)(?:^|[^\p{L}\p{N}])(?:аи|ai)?[-\s]?(?:92|95|98|100)\+?(?:[^\p{L}\p{N}]|$)"


def state_tree(payloads: DataFrame, scratch: Scratch, depth: int = 10) -> dict[str, DataFrame]:
    """Stations, observations, queues and activity from trees of unknown shape.

    An object with an id and a place (under any of the names that sources use) is a station, the last one of an id in a
    payload counts. An object with an id and fuels, as a list, a list within, or a map by fuel, gives an observation for
    each fuel, and activity for gasoline: its status, and its signals an hour where it has a time of its own. A time that
    stands on the station or on its fuels as a whole is never lent to a grade. Queues stand beside the fuels or on the
    object itself. Payloads that do not parse give no rows; coordinates that do not read are null.
    """
    node = F.col("node")
    known = walk(payloads, scratch, depth).withColumn("station", F.btrim(scalar(node, "$.id", "$.businessId", "$.oid", "$.uri"))).where("station <> ''")
    place = F.coalesce(*[F.try_variant_get(node, p, "array<variant>") for p in ("$.coordinates", "$.geometry.coordinates", "$.point", "$.geocode")])
    number = lambda i: F.try_variant_get(F.get(F.col("place"), F.lit(i)), "$", "string")
    lon, lat = X.coordinate(number(0), number(1))
    placed = known.withColumn("place", place).where(F.size("place") >= 2)
    fields = F.struct("path", lon.alias("lon"), lat.alias("lat"), scalar(node, "$.title", "$.name").alias("title"), scalar(node, "$.brand").alias("brand"), scalar(node, "$.address", "$.subtitle", "$.properties.CompanyMetaData.address").alias("address"))
    stations = placed.groupBy("source", "fetched_at", "payload_id", "station").agg(F.max(fields).alias("s")).select("source", "fetched_at", "station", "s.lon", "s.lat", "s.title", "s.brand", "s.address")

    fuels = F.coalesce(*[F.when(nests(v), v) for v in (F.try_variant_get(node, p, "variant") for p in ("$.fuelAvailability", "$.fuels", "$.fuel", "$.properties.fuelAvailability"))])
    sold = known.withColumn("fuels", fuels)
    inner = F.try_variant_get("fuels", "$.fuel", "array<variant>")
    entries = F.when(inner.isNotNull(), F.transform(inner, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))).otherwise(F.filter(parts(F.col("fuels")), lambda p: p["key"].isNull() | p["value"].isNull() | ~F.schema_of_variant(p["value"]).startswith("ARRAY")))
    each = sold.where("fuels is not null").select("source", "fetched_at", "station", F.explode(entries).alias("e"))
    v, plain = F.col("e.value"), F.when(~nests(F.col("e.value")), F.try_variant_get(F.col("e.value"), "$", "string"))
    rows = each.select(
        "source",
        "fetched_at",
        "station",
        F.coalesce(scalar(v, "$.localizedName", "$.fuelType", "$.fuel", "$.name", "$.title", "$.grade"), F.col("e.key")).alias("fuel"),
        F.coalesce(scalar(v, "$.status", "$.availability", "$.value"), plain).alias("status"),
        F.try_variant_get(v, "$.signalsCountPerHour", "double").alias("signals"),
        stamp(v, "$.lastSignalTimestamp", "$.updatedAt", "$.timestamp").alias("at"),
    )
    gasoline = rows.where(F.col("fuel").rlike(GASOLINE))
    none = F.lit(None).cast("double")
    snapshot = gasoline.select("source", "fetched_at", "station", F.col("fuel").alias("grade"), F.lit("PETROL_STATUS_SNAPSHOT").alias("kind"), "status", none.alias("at"), none.alias("count"), none.alias("window_minutes"))
    rolling = gasoline.where("at is not null and signals is not null").select("source", "fetched_at", "station", F.col("fuel").alias("grade"), F.lit("ROLLING_SIGNAL_COUNT").alias("kind"), F.lit(None).cast("string").alias("status"), "at", F.col("signals").alias("count"), F.lit(60.0).alias("window_minutes"))

    said = scalar(F.col("fuels"), "$.queueStatus")
    size = scalar(F.col("fuels"), "$.localizedQueueSize")
    beside = sold.where(F.coalesce(F.upper(said) != "UNKNOWN", F.lit(False)) | size.isNotNull()).select("source", "fetched_at", "station", F.coalesce(size, said).alias("value"), F.coalesce(X.ordinal(size), X.ordinal(said)).alias("ordinal"), none.alias("vehicles"), stamp(F.col("fuels"), "$.lastSignalTimestamp").alias("at"))
    queue = F.coalesce(*[F.when(~F.coalesce(F.try_variant_get(q, "$", "string"), F.lit("")).isin("", "0", "false"), q) for q in (F.try_variant_get(node, p, "variant") for p in ("$.queue", "$.queueStatus", "$.properties.queue"))])
    own = known.withColumn("queue", queue).where("queue is not null")
    value = F.when(nests(F.col("queue")), scalar(F.col("queue"), "$.label", "$.status", "$.value")).otherwise(F.try_variant_get("queue", "$", "string"))
    standing = own.select("source", "fetched_at", "station", value.alias("value"), X.ordinal(value).alias("ordinal"), F.try_variant_get("queue", "$.vehicleCount", "double").alias("vehicles"), stamp(F.col("queue"), "$.updatedAt").alias("at"))
    return {"stations": stations, "observations": rows, "queues": beside.unionByName(standing), "activity": snapshot.unionByName(rolling)}


#: The words by which a card says that there is fuel or none.
CARD_NO, CARD_YES, CARD_95 = r"(?iu)нет\s+топлива|заправка\s+не\s+работает", r"(?iu)есть\s+топливо", r"(?iu)(?:^|[^\p{L}\p{N}])(?:аи[-\s]?)?95\+?(?:[^\p{L}\p{N}]|$)"


def cards(pages: DataFrame, card: str = r"(?s)(<li\b[^>]*>.*?)</li>", ids: str = "data-osm|data-station-id|data-business-id|data-id|id") -> DataFrame:
    """Fallback for HTML: a row for each card of a page, found by a pattern whose first group holds it with its tag.

    Columns: page_id, place, station, lon, lat, title, link, text, status, family_all, queue. The id and the coordinates
    stand in the card's attributes; without an id the place names the card, without readable coordinates both are null.
    Explicit words decide the status; without them it is unknown. The title is what is set in strong or bold type, else
    the text up to its first gap. A queue is what follows the word for it, up to a comma.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(card), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("place", "card"))
    tag = F.regexp_extract("card", r"^<[^>]*>", 0)
    text = F.btrim(F.regexp_replace(F.regexp_replace("card", "<[^>]*>", " "), r"\s+", " "))
    attribute = lambda of, name: F.regexp_extract(of, rf"""\s(?:{name})\s*=\s*["']([^"']*)["']""", 1)
    ident = attribute(tag, ids)
    spot = F.split(attribute(tag, "data-coordinates"), ",")
    lon, lat = X.coordinate(F.get(spot, F.lit(0)), F.get(spot, F.lit(1)))
    bold = F.btrim(F.regexp_replace(F.regexp_extract("card", r"(?is)<(?:strong|b|h[23])\b[^>]*>(.*?)</(?:strong|b|h[23])>", 1), "<[^>]*>|\\s+", " "))
    no, yes = text.rlike(CARD_NO), text.rlike(CARD_YES) & text.rlike(CARD_95)
    queue = F.regexp_extract(text, r"(?iu)очередь[^,;]*", 0)
    return each.select(
        "page_id",
        "place",
        F.when(ident != "", ident).otherwise(F.concat(F.lit("card-"), F.col("place").cast("string"))).alias("station"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.when(bold != "", bold).otherwise(text).alias("title"),
        F.regexp_extract("card", 'href="([^"]*)"', 1).alias("link"),
        text.alias("text"),
        F.when(no, "OUT_OF_STOCK").when(yes, "IN_STOCK").otherwise("UNKNOWN").alias("status"),
        no.alias("family_all"),
        F.when(queue != "", F.btrim(queue)).alias("queue"),
    )


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each of the keys; in one batch the greatest row."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return latest.select(*[F.col(k) if k in keys else F.col(f"r.{k}").alias(k) for k in rows.columns])


def merge_batches(stations: DataFrame, observations: DataFrame, queues: DataFrame | None = None, activity: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Scroll batches as one: the last record of each station, each observation, queue and activity once.

    stations (batch, id, ..), observations (batch, station, fuel, status, at, ..), queues (batch, station, value, at, ..),
    activity (batch, ..). Equal keys count once, the last batch's row; activity is equal in all but its batch.
    """
    out = [last_of(stations, ["id"]), last_of(observations, ["station", "fuel", "status", "at"])]
    if queues is not None:
        out.append(last_of(queues, ["station", "value", "at"]))
    if activity is not None:
        out.append(activity.drop("batch").distinct())
    return tuple(out)


def lowered(rows: DataFrame, capability: str) -> DataFrame:
    """Specificity lowered to what the source can say; rows without a product stay as they are."""
    known = F.col("product_key").isNotNull()
    if capability == "CURRENT_FAMILY":
        return rows.withColumns({"specificity": F.when(known, "FAMILY_ONLY").otherwise(F.col("specificity")), "product_key": F.when(known, "AI95_FAMILY")})
    return rows.withColumn("specificity", F.when(known, "CATALOG_ONLY").otherwise(F.col("specificity"))) if capability == "CATALOG_ONLY" else rows


def conform(stations: DataFrame, observations: DataFrame, capability: str = "CURRENT_GRADE") -> DataFrame:
    """Observations of enumerated stations with a classified product; specificity lowered to what the source can say."""
    kept = observations.join(stations.select("source", "station").distinct(), ["source", "station"], "left_semi").where("product_key is not null")
    return lowered(kept, capability)


def checked(stations: DataFrame, rows: dict[str, DataFrame], scratch: Scratch, capability: str = "CURRENT_GRADE", facts: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, dict[str, dict[str, int]]]:
    """A source result against its contract: (rows kept, rejects, health, counts).

    stations (source, station, lon, lat, ..), null coordinates for those that could not be located. rows: observations
    (source, station, product_key, specificity, ..), queues and activity (source, station, ..), any of them. Each type is
    written once with the reason for which a row is rejected, and counted in that pass: NO_STATION, NOT_ENUMERATED, or
    UNCLASSIFIED for an observation without a product. rejects (type, source, station, reason) reads what was written.
    health (source, status, code, stations, unlocated): PARTIAL where a station has no place or the source said so, the
    code being the source's own, COORDINATE_COVERAGE or ACTIVITY_HISTORY_UNAVAILABLE. facts (source, partial, code,
    history_coverage) is what collecting found out; a source without stations is in health through its facts.
    """
    known = stations.select("source", "station").distinct().withColumn("__known", F.lit(True))
    kept, turned, counts = {}, [], {}
    for name, frame in rows.items():
        reason = F.when(F.coalesce(F.col("station"), F.lit("")) == "", "NO_STATION").when(F.col("__known").isNull(), "NOT_ENUMERATED")
        if name == "observations":
            reason = reason.when(F.col("product_key").isNull(), "UNCLASSIFIED")
        marked = frame.join(known, ["source", "station"], "left").withColumn("__reason", reason).drop("__known")
        seen = Observation(f"{name}-contract")
        sums = [F.count_if(F.col("__reason") == r).alias(r) for r in ("NO_STATION", "NOT_ENUMERATED", "UNCLASSIFIED")]
        written = scratch.keep(marked.observe(seen, F.count(F.lit(1)).alias("rows"), *sums))
        counts[name] = seen.get
        good = written.where("__reason is null").drop("__reason")
        kept[name] = lowered(good, capability) if name == "observations" else good
        turned.append(written.where("__reason is not null").select(F.lit(name).alias("type"), "source", "station", F.col("__reason").alias("reason")))
    rejects = turned[0]
    for more in turned[1:]:
        rejects = rejects.unionByName(more)
    found = stations.groupBy("source").agg(F.count("*").alias("stations"), F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("unlocated"))
    if facts is None:
        facts = found.select("source").selectExpr("source", "false as partial", "string(null) as code", "double(null) as history_coverage")
    health = found.join(facts, "source", "full").select("source", F.coalesce("stations", F.lit(0)).alias("stations"), F.coalesce("unlocated", F.lit(0)).alias("unlocated"), "partial", "code", "history_coverage")
    apart = F.col("unlocated") > 0
    status = F.when(F.coalesce("partial", F.lit(False)) | apart, "PARTIAL").otherwise("OK")
    code = F.coalesce("code", F.when(apart, "COORDINATE_COVERAGE").when(F.col("history_coverage") == 0, "ACTIVITY_HISTORY_UNAVAILABLE"))
    return kept, rejects, health.select("source", status.alias("status"), code.alias("code"), "stations", "unlocated"), counts


def coverage(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Per source: stations, shares with coordinates, repeated, with observations, and of observations with a time."""
    s = stations.groupBy("source").agg(F.count("*").alias("station_count"), F.avg((F.col("lon").isNotNull() & F.col("lat").isNotNull()).cast("int")).alias("coordinate_coverage"), F.count_distinct("station").alias("u"))
    o = observations.groupBy("source").agg(F.count_distinct("station").alias("fueled"), F.avg(F.col("at").isNotNull().cast("int")).alias("timestamp_coverage"))
    j = s.join(o, "source", "left")
    return j.select("source", "station_count", "coordinate_coverage", (1 - F.col("u") / F.col("station_count")).alias("duplicate_ratio"), (F.coalesce("fueled", F.lit(0)) / F.col("u")).alias("fuel_block_coverage"), F.coalesce("timestamp_coverage", F.lit(0.0)).alias("timestamp_coverage"))
