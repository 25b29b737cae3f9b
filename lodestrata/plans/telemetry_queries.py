"""Queries of telemetry, jobs and plans over the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import audit, folds, jobs, telemetry
from lodestrata.plans import levels
from lodestrata.plans.views import ERRORS, EVENTS, errors, events, load
from lodestrata.sources.tables import tasks_for

SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
Q: dict = {}
O: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _seconds(ts: str = "ts"):
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    prop = F.create_map(*[F.lit(x) for k, v in telemetry.EVENTS.items() if v for x in (k, v)])[F.col("name")]
    text = F.concat(F.lit('"'), "raw_value", F.lit('"'))
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"'), prop, F.lit('":'), text, F.lit("}"))).when(F.col("event_id") % 3 == 1, text).otherwise(F.when(F.col("event_id") % 5 == 0, F.col("k").cast("string")).otherwise(text))
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.col("name")).alias("e"), p.alias("p"))


CLEAN = f"""
SELECT event_id, user_id, ts, name, CASE
    WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN NULL
    WHEN name = 'page_view' AND NOT regexp_full_match(raw_value, '[a-z]{{2}}') THEN NULL
    WHEN name IN ('file_selected', 'convert_start', 'convert_done') AND raw_value NOT IN ('lt100m', '100m-1g', '1g-4g', '4g-16g', '16g-64g', 'gt64g') THEN NULL
    ELSE raw_value END AS value
FROM ({EVENTS}) WHERE event_id % 50 <> 0"""


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.clean_events(_raw(spark, d))[0]


@query
def clean_events(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("event_id", "user_id", "ts", "name", "value")


O["clean_events"] = CLEAN

COUNTED = f"""
WITH c AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM ({CLEAN})),
v AS (SELECT day, name, value, count(*) AS n, min((ts, event_id)) AS f FROM c WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day, name ORDER BY f) AS r FROM v)
SELECT day, name, NULL AS value, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT day, name, CASE WHEN r <= 5 THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL"""


@query
def count_events_cap(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.count_events(_cleaned(spark, d), most=5)


O["count_events_cap"] = COUNTED


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.count_events(_cleaned(spark, d), most=5)


@query
def stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.stats(_totals(spark, d), 7, "2024-01-20")


_COLUMNS = ", ".join(f"CAST(coalesce(sum(n) FILTER (name = '{e}'), 0) AS BIGINT) AS {e}" for e in telemetry.EVENT_ORDER)
O["stats_pivot"] = f"SELECT coalesce(day, 'total') AS day, {_COLUMNS} FROM ({COUNTED}) WHERE value IS NULL AND day BETWEEN '2024-01-14' AND '2024-01-20' GROUP BY ROLLUP (day)"


@query
def conversion_rates(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.conversion_rates(_totals(spark, d))


_OF = "coalesce(sum(n) FILTER (name = 'convert_{}' AND value IS NULL), 0)"
O["conversion_rates"] = f"""SELECT CAST({_OF.format("start")} AS BIGINT) AS starts, {", ".join(f"round({_OF.format(k)} * 100 / {_OF.format('start')}, 1) AS {k}_percent" for k in ("done", "error", "cancel"))} FROM ({COUNTED})"""


@query
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.top_values(_totals(spark, d))


O["top_values"] = f"""SELECT name, value, n, rank FROM (SELECT name, value, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY name ORDER BY sum(n) DESC, value) AS rank
FROM ({COUNTED}) WHERE value IS NOT NULL GROUP BY name, value) WHERE rank <= 8"""

_KEY = "substr(sha256(release || chr(10) || stage || chr(10) || trim(regexp_replace(regexp_replace(message, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))), 1, 24)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    e = errors(spark, d)
    return e.withColumn("key", S.error_key(F.col("release"), F.col("stage"), F.col("message"))).withColumn("at", F.col("ts")).withColumn("sec", _seconds())


@query
def error_key(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("id", "key")


O["error_key"] = f"SELECT id, {_KEY} AS key FROM ({ERRORS})"


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    return folds.dedup_window(_keyed(spark, d).select("id", "key", "ts", "sec"), ["key"], 86_400, "sec", "id")


FIRSTS = f"""
WITH RECURSIVE r AS (SELECT id, {_KEY} AS key, ts, {SECONDS} AS sec FROM ({ERRORS})),
f AS (SELECT key, min((sec, id)) AS first FROM r GROUP BY key
      UNION ALL SELECT x.key, x.first FROM (SELECT f.key, min((r.sec, r.id)) AS first FROM f JOIN r ON r.key = f.key AND r.sec >= f.first[1] + 86400 GROUP BY f.key) AS x),
d AS (SELECT r.id, r.key, r.ts, r.sec, max(f.first) AS w FROM r JOIN f ON r.key = f.key AND (f.first[1], f.first[2]) <= (r.sec, r.id) GROUP BY ALL)
SELECT id, key, ts, sec, CASE WHEN w[2] = id THEN NULL ELSE w[2] END AS repeat_of FROM d"""


@query
def dedup_errors_24h(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d).select("id", "key", "repeat_of")


O["dedup_errors_24h"] = f"SELECT id, key, repeat_of FROM ({FIRSTS})"


@query
def error_digest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.error_digest(_deduped(spark, d).withColumn("at", F.col("ts")), 3).select("day", "repeat_of", "n", "rank")


O["error_digest"] = f"""
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, repeat_of, count(*) AS n FROM ({FIRSTS}) WHERE repeat_of IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, repeat_of) AS rank FROM c)
SELECT day, repeat_of, n, rank FROM r WHERE rank <= 3 UNION ALL SELECT day, NULL, count(*), 4 FROM r WHERE rank > 3 GROUP BY day"""


@query
def report_ids(spark: SparkSession, d: str) -> DataFrame:
    old = _keyed(spark, d).where("id % 1000 = 7").select(F.concat(F.lit("R-"), F.date_format("ts", "yyyyMMdd"), F.lit("-00"), F.lpad((F.col("id") % 89 + 10).cast("string"), 2, "0")).alias("report_id"))
    return telemetry.assign_report_id(_keyed(spark, d), old).select("id", "report_id")


O["report_ids"] = f"""
WITH e AS (SELECT *, strftime(ts, '%Y%m%d') AS day FROM ({ERRORS})), o AS (SELECT day, max(id % 89 + 10) AS last FROM e WHERE id % 1000 = 7 GROUP BY day)
SELECT id, 'R-' || day || '-' || lpad(CAST(row_number() OVER (PARTITION BY day ORDER BY ts, id) + coalesce(last, 0) AS VARCHAR), 4, '0') AS report_id FROM e LEFT JOIN o USING (day)"""


@query
def inbox_open(spark: SparkSession, d: str) -> DataFrame:
    reports = _deduped(spark, d).join(_keyed(spark, d).select("id", "message"), "id").select("id", F.when(F.col("id") % 9 == 0, "bug").otherwise("error").alias("kind"), "message", (F.col("id") % 13 == 0).alias("suspect"), "repeat_of")
    status = _keyed(spark, d).where("id % 4 = 0").select("id", F.when(F.col("id") % 3 == 0, "open").otherwise("closed").alias("status"), F.lit(1).alias("seq"))
    status = status.unionByName(_keyed(spark, d).where("id % 8 = 0").select("id", F.lit("closed").alias("status"), F.lit(2).alias("seq")))
    return telemetry.inbox(reports, status)


O["inbox_open"] = f"""
WITH s AS (SELECT id, CASE WHEN id % 8 = 0 THEN 'closed' WHEN id % 3 = 0 THEN 'open' ELSE 'closed' END AS status FROM ({ERRORS}) WHERE id % 4 = 0),
r AS (SELECT d.id, CASE WHEN d.id % 9 = 0 THEN 'bug' ELSE 'error' END AS kind, e.message, d.repeat_of FROM ({FIRSTS}) d JOIN ({ERRORS}) e USING (id) WHERE d.id % 13 <> 0),
x AS (SELECT r.*, coalesce(o.status, i.status, 'open') AS state FROM r LEFT JOIN s o ON o.id = r.id LEFT JOIN s i ON i.id = r.repeat_of),
g AS (SELECT repeat_of, count(*) AS folded FROM x WHERE repeat_of IS NOT NULL GROUP BY 1)
SELECT id, kind, state, coalesce(folded, 0) AS folded, substr(message, 1, 80) AS headline FROM x LEFT JOIN g ON g.repeat_of = x.id WHERE x.repeat_of IS NULL AND state = 'open'"""


@query
def store_policy(spark: SparkSession, d: str) -> DataFrame:
    r = _keyed(spark, d).select("id", "at", (F.col("id") % 13 == 0).alias("suspect"), F.when(F.col("id") % 3 > 0, F.length("message").cast("long")).alias("bytes"))
    return telemetry.store_policy(r, 2_000).select("id", "diag_state")


O["store_policy"] = f"""
WITH r AS (SELECT id, ts, id % 13 = 0 AS suspect, CASE WHEN id % 3 > 0 THEN length(message) END AS bytes FROM ({ERRORS})),
t AS (SELECT *, sum(CASE WHEN NOT suspect AND bytes IS NOT NULL THEN bytes ELSE 0 END) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, id) AS run FROM r)
SELECT id, CASE WHEN suspect OR bytes IS NULL THEN 'absent' WHEN run > 2000 THEN 'skipped' ELSE 'kept' END AS diag_state FROM t"""


@query
def retention(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", S.utc_day(F.col("ts")).alias("day"))
    return telemetry.retention_prune(e, "day", "2024-01-31", 10)


O["retention"] = f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM ({EVENTS}) WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-21'"


@query
def consent_gate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("decision", F.when(F.col("name") == "convert_start", "granted").when(F.col("name") == "convert_done", "denied"))
    return telemetry.consent_gate(e, "user_id", "ts", "event_id", "decision").select("event_id", "user_id", "name")


O["consent_gate"] = f"""
SELECT event_id, user_id, name FROM (SELECT *, last_value(CASE name WHEN 'convert_start' THEN 'granted' WHEN 'convert_done' THEN 'denied' END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM ({EVENTS}))
WHERE latest = 'granted' AND name NOT IN ('convert_start', 'convert_done')"""


@query
def route_events(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.route_events(_cleaned(spark, d), F.lit("EN-gb-x"))
    flat = F.array_join(F.sort_array(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("event_id", "to_analytics", flat.alias("params"))


_PARAM = "CASE name WHEN 'convert_error' THEN 'stage' WHEN 'page_view' THEN NULL ELSE 'size_bucket' END"
O["route_events"] = f"""SELECT event_id, name <> 'page_view' AS to_analytics, array_to_string(list_sort(list_filter(['site_lang=en-gb', {_PARAM} || '=' || value], lambda x: x IS NOT NULL)), ';') AS params FROM ({CLEAN})"""


@query
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    hits = events(spark, d).select("event_id", "user_id", _seconds().alias("at"))
    return folds.rate_limit(hits, ["user_id"], 5, 21_600, "at", ("event_id",)).select("event_id", "allowed")


O["rate_limit"] = f"""
WITH RECURSIVE h AS (SELECT event_id, user_id, {SECONDS} AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({EVENTS})),
f AS (SELECT event_id, user_id, i, sec, sec AS b, 1 AS c, 0 AS p, true AS allowed FROM h WHERE i = 1
  UNION ALL SELECT x.event_id, x.user_id, x.i, x.sec, x.b2, CASE WHEN x.ok THEN x.c2 + 1 ELSE x.c2 END, x.p2, x.ok FROM (
    SELECT y.*, NOT (y.p2 * greatest(0, 1 - (y.sec - y.b2) / 21600::DOUBLE) + y.c2 + 1 > 5) AS ok FROM (
      SELECT h.event_id, h.user_id, h.i, h.sec, f.b + ((h.sec - f.b) // 21600) * 21600 AS b2, CASE WHEN (h.sec - f.b) // 21600 >= 1 THEN 0 ELSE f.c END AS c2,
             CASE WHEN (h.sec - f.b) // 21600 = 0 THEN f.p WHEN (h.sec - f.b) // 21600 = 1 THEN f.c ELSE 0 END AS p2
      FROM f JOIN h ON h.user_id = f.user_id AND h.i = f.i + 1) AS y) AS x)
SELECT event_id, allowed FROM f"""


@query
def parse_reports(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    raw = docs.select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "spam").when(F.col("doc_id") % 3 == 0, "bug").when(F.col("doc_id") % 3 == 1, "idea").otherwise("error").alias("kind"), F.col("text").alias("message"),
        F.col("source").alias("contact"), "lang", F.lit("index").alias("page"), F.lit("1.0").alias("release"), F.concat(F.lit("S"), "lang").alias("stage"), (F.col("n_chars") * 2.0).alias("t"),
        F.when(F.col("doc_id") % 50 == 0, "http://x").alias("website"), (F.col("doc_id") % 2 == 0).alias("consent"), F.lit('{"gpu":1}').alias("diagnostics"), F.col("n_chars").alias("body_bytes"),
    )
    ok, bad = telemetry.parse_reports(raw)
    cols = ["doc_id", "kind", "suspect", "contact", "stage", "diagnostics"]
    return ok.select(*cols, F.lit(0).alias("code")).unionByName(bad.select("doc_id", "kind", F.lit(None).cast("boolean").alias("suspect"), F.lit(None).cast("string").alias("contact"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("diagnostics"), "code"))


O["parse_reports"] = """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'spam' WHEN doc_id % 3 = 0 THEN 'bug' WHEN doc_id % 3 = 1 THEN 'idea' ELSE 'error' END AS kind, source, n_chars FROM documents),
c AS (SELECT *, CASE WHEN kind = 'spam' THEN 400 WHEN n_chars > 8192 THEN 413 ELSE 0 END AS code FROM r)
SELECT doc_id, kind, CASE WHEN code = 0 THEN doc_id % 50 = 0 OR (kind <> 'error' AND n_chars * 2.0 < 3000) END AS suspect,
       CASE WHEN code = 0 THEN CASE WHEN kind = 'error' THEN '' ELSE source END END AS contact, CASE WHEN code = 0 THEN '' END AS stage,
       CASE WHEN code = 0 AND doc_id % 2 = 0 AND kind <> 'idea' THEN '{"gpu":1}' END AS diagnostics, code FROM c"""


@query
def parse_leads(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    email = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("@x.org"))
    role = F.lower(F.when(F.col("c_mktsegment") == "BUILDING", "studio").otherwise(F.col("c_mktsegment")))
    raw = c.select("c_custkey", role.alias("role"), email.alias("email"), F.col("c_name").alias("name"), F.lit("hi").alias("message"), (F.col("c_custkey") % 4 > 0).alias("consent"), F.lit("en").alias("lang"), F.lit("index").alias("page"), F.col("c_acctbal").alias("t"), F.lit(None).cast("string").alias("website"))
    return telemetry.parse_leads(raw)[0].select("c_custkey", "role", "email", "suspect")


O["parse_leads"] = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'studio' ELSE 'other' END AS role, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@x.org' AS email,
c_acctbal < 3000 AS suspect FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 4 > 0"""


@query
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", S.plain_text(F.concat(F.lit("  ‮\u0007"), "text"), 120).alias("plain"), S.plain_text(F.col("text"), 200, lines=True).alias("lines"))


O["plain_text"] = r"""SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(substr('  ' || chr(8238) || chr(7) || text, 1, 240), '[\p{Cc}\p{Cf}]', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 120), '^\s+|\s+$', '', 'g') AS plain,
regexp_replace(substr(regexp_replace(substr(text, 1, 400), '^\s+|\s+$', '', 'g'), 1, 200), '^\s+|\s+$', '', 'g') AS lines FROM documents"""


@query
def url_scrub(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.lit("see "), "url", F.lit(" now"))
    return load(spark, d, "pages").select("page_id", S.strip_query(u).alias("stripped"), S.scrub_exception(F.lit("Error"), F.concat(F.lit('bad "quoted" at  '), "url")).alias("scrubbed"), S.contact_method(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("MAILTO:"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://t.me/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))).alias("contact"))


_SCRUBBED = r"""regexp_replace(regexp_replace(regexp_replace('Error: bad "quoted" at  ' || url, '(blob:)?https?://\S+', '<url>', 'g'), '["''`«“].*?["''`»”]', '…', 'g'), '\s+', ' ', 'g')"""
O["url_scrub"] = rf"""SELECT page_id, regexp_replace('see ' || url || ' now', '(https?://[^\s?#''")]+)[?#][^\s''")]*', '\1', 'g') AS stripped,
substr(trim({_SCRUBBED}), 1, 100) AS scrubbed, CASE page_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' END AS contact FROM pages"""


@query
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", S.size_bucket(F.col("value") * float(1 << 28)).alias("size"), S.duration_bucket(F.col("value") * 30).alias("duration"), S.retry_memory(F.col("value") * float(1 << 26)).alias("retry_bytes"))


O["size_buckets"] = """SELECT event_id, CASE WHEN value * 268435456 < 104857600 THEN 'lt100m' WHEN value < 4 THEN '100m-1g' WHEN value < 16 THEN '1g-4g' WHEN value < 64 THEN '4g-16g' WHEN value < 256 THEN '16g-64g' ELSE 'gt64g' END AS size,
CASE WHEN value * 30 < 60 THEN 'lt1m' WHEN value * 30 < 300 THEN '1m-5m' WHEN value * 30 < 1800 THEN '5m-30m' WHEN value * 30 < 7200 THEN '30m-2h' ELSE 'gt2h' END AS duration,
CAST(greatest(2, floor(value * 67108864 / 1073741824 * 0.6)) * 1073741824 AS BIGINT) AS retry_bytes FROM events"""


@query
def hint_classes(spark: SparkSession, d: str) -> DataFrame:
    e = errors(spark, d).withColumn("m", F.when(F.col("id") % 3 == 0, F.col("message")).when(F.col("id") % 3 == 1, "WebGPU device lost").otherwise("bad input"))
    return e.select("id", S.hint_class(F.col("m"), F.when(F.col("id") % 2 == 0, "header").otherwise("read")).alias("hint"), S.retry_class(F.col("m"), F.col("stage"), F.col("id") % 5 > 0, F.lit(8 << 30), F.col("id") % 4).alias("retry"))


O["hint_classes"] = f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'memory' WHEN id % 3 = 1 THEN 'gpu' WHEN id % 2 = 0 THEN 'input' ELSE '' END AS hint,
CASE WHEN id % 4 >= 2 THEN NULL WHEN id % 3 = 1 AND id % 5 > 0 THEN 'gpu' WHEN id % 3 = 0 THEN 'memory' END AS retry FROM ({ERRORS})"""
O["hint_classes"] = O["hint_classes"].replace("WHEN id % 3 = 0 THEN 'memory' WHEN id % 3 = 1", "WHEN id % 3 = 0 AND message LIKE '%RangeError%' AND regexp_matches(message, '(?i)memory|allocation failed|RangeError: Array buffer') THEN 'memory' WHEN id % 3 = 1", 1).replace("WHEN id % 2 = 0 THEN 'input'", "WHEN id % 2 = 0 THEN 'input'")


@query
def output_names(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    items = part.select(F.col("p_partkey").alias("id"), F.concat(F.substring_index("p_name", " ", 1), F.lit(".ply")).alias("name"), F.col("p_brand").alias("folder"))
    taken = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("folder"), F.concat(S.stem(F.substring_index("p_name", " ", 1)), F.lit("-SSOG"), F.when(F.col("p_size") % 5 > 1, F.concat(F.lit("-"), (F.col("p_size") % 5).cast("string"))).otherwise(""), F.lit(".zip")).alias("output"))
    return jobs.output_names(items, taken)


O["output_names"] = """
WITH i AS (SELECT p_partkey AS id, p_brand AS folder, regexp_replace(split_part(p_name, ' ', 1), '[^\\p{L}\\p{N}._-]+', '_', 'g') AS stem FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY id) AS nth FROM i),
t AS (SELECT DISTINCT p_brand AS folder, regexp_replace(split_part(p_name, ' ', 1), '[^\\p{L}\\p{N}._-]+', '_', 'g') AS stem, CASE WHEN p_size % 5 > 1 THEN p_size % 5 ELSE 1 END AS no FROM part WHERE p_partkey % 3 = 0),
free AS (SELECT folder, stem, no, row_number() OVER (PARTITION BY folder, stem ORDER BY no) AS nth FROM (
  SELECT k.folder, k.stem, g.no FROM (SELECT folder, stem, count(*) AS c FROM i GROUP BY ALL) k, LATERAL (SELECT unnest(range(1, k.c + 6)) AS no) g
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.folder = k.folder AND t.stem = k.stem AND t.no = g.no)))
SELECT id, folder, stem || '-SSOG' || CASE WHEN no > 1 THEN '-' || no ELSE '' END || '.zip' AS output FROM r JOIN free USING (folder, stem, nth)"""


@query
def queue_summary(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    items = o.select(F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("waiting").alias("status"), (F.col("o_orderkey") % 100).alias("seconds"), (F.col("o_orderkey") * 10).alias("bytes"))
    return jobs.queue_summary(items)


O["queue_summary"] = """WITH i AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'waiting' END AS status, o_orderkey FROM orders)
SELECT count(*) AS n, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, CAST(sum(o_orderkey % 100) FILTER (status = 'waiting') AS BIGINT) AS seconds_left,
CAST(sum(o_orderkey * 10) FILTER (status = 'waiting') AS BIGINT) AS bytes_left FROM i"""


@query
def queue_state(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "running").when(F.col("o_orderkey") % 4 == 1, "editing").when(F.col("o_orderkey") % 4 == 2, "waiting").otherwise("done").alias("status"), F.lit("waiting").alias("previous"), (F.col("o_custkey") % 3 > 0).alias("has_file"), F.col("o_orderkey").alias("seq"))
    return jobs.queue_state(o)


O["queue_state"] = """WITH l AS (SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT id, CASE WHEN k % 4 = 3 THEN 'done' WHEN id % 3 = 0 THEN 'missing' ELSE 'waiting' END AS status FROM l"""


@query
def reattach(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 2 == 0, "missing").otherwise("waiting").alias("status"))
    files = p.where("p_partkey % 37 = 0").select(F.col("p_brand").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("file"))
    return jobs.reattach(items, files).select("id", "file")


O["reattach"] = "SELECT i.p_partkey AS id, f.p_partkey AS file FROM part i JOIN part f ON i.p_brand = f.p_brand AND i.p_size = f.p_size WHERE i.p_partkey % 2 = 0 AND f.p_partkey % 37 = 0"


@query
def orphan_runs(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("ts"), "o_orderstatus")
    return jobs.orphan_runs(o, o.where("o_orderstatus = 'P'"), o)


O["orphan_runs"] = "SELECT o_custkey AS run, arg_max(o_orderpriority, o_orderkey) AS stage FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') = 0"


@query
def progress_report(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("done"), F.lit(300000.0).alias("total"), (F.col("o_orderkey") % 1000).alias("elapsed"))
    return jobs.progress_report(o).select("job", "id", F.round("progress", 6).alias("progress"), F.round("eta", 3).alias("eta"))


O["progress_report"] = """
WITH p AS (SELECT o_custkey AS job, o_orderkey AS id, o_totalprice AS done, o_orderkey % 1000 AS elapsed,
  max(least(0.995::DOUBLE, 0.005::DOUBLE + 0.99::DOUBLE * least(o_totalprice, 300000) / 300000)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM orders)
SELECT job, id, round(p, 6) AS progress, round(CASE WHEN p > 0.03 THEN 0.5::DOUBLE * greatest(0, 300000 - done) + 0.5::DOUBLE * (elapsed * (1 - p) / p) ELSE greatest(0, 300000 - done) END, 3) AS eta FROM p"""


@query
def diff_snapshots(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    kind, key = F.when(F.col("p_partkey") % 2 == 0, "container").otherwise("body").alias("kind"), F.col("p_partkey").cast("string").alias("key")
    before = p.where("p_partkey % 10 <> 3").select(kind, key, F.col("p_size").cast("string").alias("value"))
    after = p.where("p_partkey % 10 <> 7").select(kind, key, F.when(F.col("p_partkey") % 11 == 0, "-1").otherwise(F.col("p_size").cast("string")).alias("value"))
    stable = before.where(F.col("key").cast("long") % 3 > 0)
    return audit.diff_snapshots(before, after, ["7", "33"], [stable])


O["diff_snapshots"] = """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'container' ELSE 'body' END AS kind, CAST(p_partkey AS VARCHAR) AS key,
CASE WHEN p_partkey % 10 = 7 THEN 'gone' WHEN p_partkey % 10 = 3 THEN 'added' ELSE 'changed' END AS change FROM part
WHERE p_partkey NOT IN (7, 33) AND (p_partkey % 10 IN (3, 7) OR (p_partkey % 11 = 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 > 0)))"""


@query
def log_window_count(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("ts", F.concat(F.when(F.col("k") == 7, "[emerg] ").when(F.col("k") == 8, "GET /emergency ").otherwise("ok "), F.lit("from 10.1.2."), (F.col("user_id") % 250).cast("string"), F.lit(" id "), F.col("event_id").cast("string")).alias("line"))
    return audit.log_window_count(e, "2024-01-05 00:00:00", "2024-01-15 00:00:00").withColumn("samples", F.array_join("samples", "|"))


O["log_window_count"] = f"""
WITH e AS (SELECT ts, event_id, k FROM ({EVENTS}) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'),
s AS (SELECT '[emerg] from x.x.x.x id ' || event_id AS line FROM e WHERE k = 7 ORDER BY ts, event_id LIMIT 3)
SELECT count(*) AS lines, count(*) FILTER (k = 7) AS strict, count(*) FILTER (k IN (7, 8)) AS loose, (SELECT string_agg(line, '|' ORDER BY line) FROM s) AS samples FROM e"""


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) * 50_000).alias("n")).select(F.col("l_suppkey").alias("scene_id"), "n")


_SCENES = "SELECT l_suppkey AS scene_id, count(*) * 50000 AS n FROM lineitem GROUP BY 1"
PLANNED = f"""
WITH RECURSIVE s AS ({_SCENES}), l AS (SELECT scene_id, 0 AS lod, CAST(n AS BIGINT) AS planned_n FROM s
  UNION ALL SELECT scene_id, lod + 1, greatest(1, CAST(floor(planned_n * 0.5 + 0.5) AS BIGINT)) FROM l WHERE planned_n > 100000 AND lod < 23)
SELECT scene_id, lod, planned_n FROM l"""


@query
def plan_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.plan_levels(_scenes(spark, d))


O["plan_levels"] = PLANNED


@query
def viewer_floor(spark: SparkSession, d: str) -> DataFrame:
    return levels.viewer_floor(levels.plan_levels(_scenes(spark, d)))


O["viewer_floor"] = f"SELECT scene_id, min(planned_n) AS floor_rows, CAST(floor(min(planned_n) / 500000 * 100 + 0.5) AS BIGINT) AS floor_percent, min(planned_n) > 125000 AS warn FROM ({PLANNED}) GROUP BY 1"


@query
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d).withColumns({"kept_floats": F.lit(14), "sh_bands": (F.col("scene_id") % 4).cast("int"), "stride": F.lit(68)})
    return levels.cost_model(s)


O["cost_model"] = f"""
WITH s AS (SELECT scene_id, n, 14 AS k, scene_id % 4 AS b FROM ({_SCENES})), p AS (SELECT scene_id, sum(planned_n) AS e, min(planned_n) AS c, count(*) AS levels FROM ({PLANNED}) GROUP BY 1),
t AS (SELECT *, greatest(1000000, least(40000000, floor(0.4 * 8589934592::DOUBLE / (k * 8 + 190)))) AS tile FROM s JOIN p USING (scene_id)),
u AS (SELECT *, greatest(1, ceil(n / tile)) AS tiles, greatest(1, ceil(n * k * 4 / greatest(0.35 * 8589934592::DOUBLE, tile * k * 4 * 1.3::DOUBLE))) AS passes FROM t)
SELECT scene_id, levels, CAST(tile AS BIGINT) AS tile_rows, CAST(tiles AS BIGINT) AS tiles, CAST(passes AS BIGINT) AS passes,
round(passes * n * 68 / 300e6 + (e - c) * 7.5e-6 * 2.4 + e * 6.7e-6, 6) AS seconds, CAST(floor(e * (12.2::DOUBLE + CASE WHEN b > 0 THEN 4 ELSE 0 END) + 0.5) AS BIGINT) AS output_bytes FROM u"""


@query
def match_preset(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(
        "p_partkey", F.lit(0.5).alias("lod_ratio"), F.when(F.col("p_partkey") % 5 == 0, 1_000_000).otherwise(100_000).cast("long").alias("min_coarsest"), F.lit(0).alias("max_levels"),
        F.when(F.col("p_partkey") % 5 == 0, "uniform").otherwise("adaptive").alias("decimator"), F.when(F.col("p_size") % 2 == 0, -1).otherwise(0).alias("sh_bands"),
        F.when(F.col("p_partkey") % 5 == 0, 512).otherwise(256).alias("chunk_count"), F.when(F.col("p_size") % 2 == 0, 16).otherwise(32).alias("chunk_extent"),
        F.when(F.col("p_partkey") % 5 == 0, 8).when(F.col("p_size") % 2 == 0, 16).otherwise(32).alias("chunk_min"),
    )
    return levels.match_preset(p).select("p_partkey", "preset")


O["match_preset"] = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'standard' ELSE 'custom' END WHEN p_size % 2 = 0 THEN 'all' ELSE 'aerial' END AS preset FROM part"


@query
def scrub_json(spark: SparkSession, d: str) -> DataFrame:
    diag = F.to_json(F.struct(F.col("name").alias("stage"), F.col("k").alias("secret"), F.struct(F.col("user_id").alias("file_name"), F.col("amount").alias("rows")).alias("input")))
    return events(spark, d).select("event_id", S.scrub_json(diag).alias("diagnostics"))


O["scrub_json"] = f"""SELECT event_id, '{{"stage":"' || name || '","input":{{"rows":' || CAST(amount AS VARCHAR) || '}}}}' AS diagnostics FROM ({EVENTS})"""


@query
def client_key(spark: SparkSession, d: str) -> DataFrame:
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit("."), (F.col("k") % 250).cast("string"))
    six = F.concat(F.lit("2001:db8:"), F.hex("user_id"), F.lit("::"), F.hex("k"))
    return events(spark, d).select("event_id", S.client_key(F.when(F.col("event_id") % 3 == 0, ip).otherwise("bad"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("1.1.1.1, "), six)), F.lit("::ffff:192.0.2.7")).alias("client"))


O["client_key"] = f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.' || (user_id % 250) || '.' || (k % 250)
WHEN event_id % 3 = 1 AND user_id < 65536 THEN '2001:db8' || CASE WHEN user_id = 0 THEN '' ELSE ':' || format('{{:x}}', user_id) END || '::/64' ELSE '192.0.2.7' END AS client FROM ({EVENTS})"""


@query
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """A limit for each client and one for all together, the client's first."""
    hits = events(spark, d).select("event_id", "user_id", _seconds().alias("at"))
    return folds.rate_limits(hits, "user_id", 2, 60, 21_600, "at", ("event_id",)).select("event_id", "allowed")


def _limit_sql(source: str, key: str, limit: int) -> str:
    """Rows of ``source`` (event_id, k, sec) with allowed, by key ``k``: a step of the limiter per row."""
    return f"""{key}h AS (SELECT event_id, k, sec, row_number() OVER (PARTITION BY k ORDER BY sec, event_id) AS i FROM ({source})),
{key}f AS (SELECT event_id, k, i, sec, sec AS b, 1 AS c, 0 AS p, true AS allowed FROM {key}h WHERE i = 1
  UNION ALL SELECT x.event_id, x.k, x.i, x.sec, x.b2, CASE WHEN x.ok THEN x.c2 + 1 ELSE x.c2 END, x.p2, x.ok FROM (
    SELECT y.*, NOT (y.p2 * greatest(0, 1 - (y.sec - y.b2) / 21600::DOUBLE) + y.c2 + 1 > {limit}) AS ok FROM (
      SELECT h.event_id, h.k, h.i, h.sec, f.b + ((h.sec - f.b) // 21600) * 21600 AS b2, CASE WHEN (h.sec - f.b) // 21600 >= 1 THEN 0 ELSE f.c END AS c2,
             CASE WHEN (h.sec - f.b) // 21600 = 0 THEN f.p WHEN (h.sec - f.b) // 21600 = 1 THEN f.c ELSE 0 END AS p2
      FROM {key}f f JOIN {key}h h ON h.k = f.k AND h.i = f.i + 1) AS y) AS x)"""


O["rate_limits"] = f"""
WITH RECURSIVE {_limit_sql(f"SELECT event_id, user_id AS k, {SECONDS} AS sec FROM ({EVENTS})", "own", 2)},
{_limit_sql("SELECT event_id, 0 AS k, sec FROM ownf WHERE allowed", "all", 60)}
SELECT o.event_id, coalesce(a.allowed, false) AS allowed FROM ownf o LEFT JOIN allf a ON o.event_id = a.event_id"""


@query
def plan_warnings(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d).withColumns({"n": F.col("n") * 30, "kept_floats": F.lit(14), "sh_bands": F.lit(0), "stride": F.lit(68)})
    return levels.plan_warnings(levels.cost_model(s, stop=150_000), levels.viewer_floor(levels.plan_levels(s, stop=150_000)))


O["plan_warnings"] = """
WITH RECURSIVE s AS (SELECT l_suppkey AS scene_id, count(*) * 50000 * 30 AS n FROM lineitem GROUP BY 1), l AS (SELECT scene_id, 0 AS lod, CAST(n AS BIGINT) AS planned_n FROM s
  UNION ALL SELECT scene_id, lod + 1, greatest(1, CAST(floor(planned_n * 0.5 + 0.5) AS BIGINT)) FROM l WHERE planned_n > 150000 AND lod < 23),
p AS (SELECT scene_id, sum(planned_n) AS e, min(planned_n) AS c FROM l GROUP BY 1)
SELECT scene_id, 'over10' AS warning FROM p WHERE floor(e * 12.2::DOUBLE + 0.5) > 10737418240 UNION ALL SELECT scene_id, 'floor' FROM p WHERE c > 125000"""


@query
def show_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "[ \n]+").alias("w"))
    diag = F.to_json(F.struct(F.col("w").alias("log"), F.array_join("w", "\n").alias("stack"), F.lit("gpu").alias("stage")))
    return telemetry.show(docs.select("id", diag.alias("diagnostics")))


O["show_diagnostics"] = r"""
WITH d AS (SELECT doc_id AS id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents),
s AS (SELECT id, 'log' AS section, list_transform(w[greatest(1, len(w) - 29):], lambda x: substr(x, 1, 300)) AS lines FROM d
  UNION ALL SELECT id, 'stack', list_transform(w[1:20], lambda x: substr(x, 1, 200)) FROM d UNION ALL SELECT id, 'stage', ['gpu'] FROM d)
SELECT id, section, CAST(unnest(range(len(lines))) AS INT) AS no, unnest(lines) AS line FROM s""".replace("\\n", "\n")


@query
def first_per_view(spark: SparkSession, d: str) -> DataFrame:
    """At most five errors of a user and day."""
    e = errors(spark, d).withColumn("day", S.utc_day(F.col("ts")))
    return telemetry.first_per(e, ["user_id", "day"], ["ts", "id"], 5).select("id", "user_id", "day")


O["first_per_view"] = f"SELECT id, user_id, day FROM (SELECT id, user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, id) AS r FROM ({ERRORS})) WHERE r <= 5"


@query
def read_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals written as files of maps, a file per day, and read back."""
    from lodestrata.sources import logs
    from lodestrata.sources.tables import shared_path

    path, totals = shared_path(spark, "daily"), _totals(spark, d)
    counts = totals.where("value IS NULL").groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))
    props = totals.where("value IS NOT NULL").groupBy("day", "name").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("of"))
    props = props.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("name", "of"))).alias("props"))
    counts.join(props, "day", "left").write.json(path)
    return logs.read_daily_totals(spark, path)


O["read_daily_totals"] = COUNTED


@query
def diff_restarts(spark: SparkSession, d: str) -> DataFrame:
    """Start times and restart counts of services, and open sockets, before and after."""
    p = load(spark, d, "part")
    key = F.col("p_partkey").cast("string").alias("key")
    of = lambda rows, at, n: rows.select(F.lit("started").alias("kind"), key, F.concat_ws("|", at, n).alias("value"))
    sockets = lambda rows: rows.select(F.lit("socket").alias("kind"), F.concat(F.lit(":"), key).alias("key"), F.lit("").alias("value"))
    before = of(p.where("p_partkey % 10 <> 3"), F.lit("t0"), F.lit("0")).unionByName(sockets(p.where("p_partkey % 5 > 0")))
    after = of(p, F.when(F.col("p_partkey") % 7 == 0, "t1").otherwise("t0"), (F.col("p_partkey") % 4 == 0).cast("int").cast("string")).unionByName(sockets(p.where("p_partkey % 6 > 0")))
    return audit.diff_snapshots(before, after, ["14", ":6"])


O["diff_restarts"] = """
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS key FROM part)
SELECT 'started' AS kind, key, 'restarted' AS change FROM p WHERE k % 10 <> 3 AND k % 7 = 0 AND k <> 14
UNION ALL SELECT 'started', key, 'restart count' FROM p WHERE k % 10 <> 3 AND k % 4 = 0 AND k <> 14
UNION ALL SELECT 'socket', ':' || key, CASE WHEN k % 5 > 0 THEN 'gone' ELSE 'added' END FROM p WHERE (k % 5 > 0) <> (k % 6 > 0)"""


@query
def event_value_types(spark: SparkSession, d: str) -> DataFrame:
    """Values count only as strings of the event's own property: not nested ones, not numbers, not text that looks like one."""
    given = ['"en"', '{"lang":"en"}', '{"a":{"lang":"en"},"lang":7}', '{"x":"\\"lang\\":\\"en\\""}', '{"lang":"EN"}', "{broken", '["en"]']
    kind = (F.col("event_id") % (len(given) + 1)).cast("int")
    raw = load(spark, d, "events").select("event_id", F.lit("page_view").alias("e"), F.get(F.array(*map(F.lit, given)), kind).alias("p"))
    return telemetry.clean_events(raw)[0].select("event_id", "name", "value")


O["event_value_types"] = "SELECT event_id, 'page_view' AS name, CASE WHEN event_id % 8 <= 1 THEN 'en' END AS value FROM events"


#: Texts of a task, of some 12 kB each.
ODD_ROWS = 5_000


@query
def scrub_odd_json(spark: SparkSession, d: str) -> DataFrame:
    """Half surrogates, numbers that JSON does not have, and brackets without end among whole reports."""
    kind, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    raw = F.when(kind == 0, F.concat(F.lit('{"stage":"\\ud800'), key, F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"stage":NaN,"input":[1e999,'), key, F.lit("]}")))
    raw = raw.when(kind == 2, F.concat(F.lit('{"stage":'), F.repeat(F.lit("["), 20_000), key)).when(kind == 3, F.concat(F.lit('{"stage":'), F.repeat(F.lit("["), 20_000), key, F.repeat(F.lit("]"), 20_000), F.lit("}")))
    parts = load(spark, d, "part").select("p_partkey")
    parts = parts.repartition(tasks_for(parts, ODD_ROWS))  # keys are few bytes, so a scan would make all their long texts in one task
    return parts.select(F.col("p_partkey").alias("id"), S.scrub_json(raw.otherwise(F.concat(F.lit('{"stage":"'), key, F.lit('"}')))).alias("diagnostics"))


O["scrub_odd_json"] = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"stage":"' || chr(65533) || p_partkey || '"}' WHEN 1 THEN '{"stage":null,"input":[null,' || p_partkey || ']}' WHEN 4 THEN '{"stage":"' || p_partkey || '"}' END AS diagnostics FROM part"""


@query
def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Report lines of the orders, some broken and some without a valid id."""
    from lodestrata.sources import logs
    from lodestrata.sources.tables import shared_path

    path, key = shared_path(spark, "lines"), F.col("o_orderkey")
    line = F.to_json(F.struct(F.when(key % 5 == 0, F.concat(F.lit("X-"), key)).otherwise(F.concat(F.lit("R-20240101-"), F.lpad(key.cast("string"), 9, "0"))).alias("id"), F.lit("bug").alias("kind"), F.col("o_orderpriority").alias("message")))
    load(spark, d, "orders").select(F.when(key % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return logs.read_jsonl(spark, path).select("id", "kind", F.length("message").alias("size"))


O["read_jsonl"] = "SELECT 'R-20240101-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, 'bug' AS kind, length(o_orderpriority) AS size FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"


@query
def stored_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals in three parts, one of them written twice, merged into one and read back from a day on."""
    from lodestrata.sources import logs
    from lodestrata.sources.tables import shared_path

    path, rows = shared_path(spark, "totals"), events(spark, d)
    for part in (0, 1, 2, 1):
        some = telemetry.count_events(rows.where(F.col("event_id") % 3 == part).withColumn("value", F.lit(None).cast("string")))
        logs.write_daily_totals(some, path, str(part))
    logs.merge_daily_totals(spark, path)
    return logs.daily_totals(spark, path, "2024-01-03").select("day", "name", "n")


O["stored_daily_totals"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, name, count(*) AS n FROM ({EVENTS}) WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-03' GROUP BY ALL"
