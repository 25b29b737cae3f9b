"""Telemetry: cleansing, daily totals, statistics, inbox views, retention, consent, routing. Stateless parts and
windows work on batch and streaming input alike; ordered folds are in ``folds``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S

# Events with their one property (None: a bare count), and what a property's value may be.
EVENTS = {
    "page_view": "lang", "file_selected": "size", "convert_start": "size", "convert_done": "size", "convert_error": "stage", "convert_cancel": "stage",
    "save_fallback": "method", "feedback_open": None, "lead_submit": None, "lang_switch": "lang", "gpu_unavailable": "reason", "preset": "preset",
    "queue_add": "count", "queue_start": "count", "queue_done": "count",
}
PROPERTIES = {
    "lang": "[a-z]{2}", "size": "lt100m|100m-1g|1g-4g|4g-16g|16g-64g|gt64g", "stage": "[a-z0-9][a-z0-9_-]{0,23}", "method": "[a-z0-9][a-z0-9_-]{0,23}",
    "reason": "[a-z0-9][a-z0-9_-]{0,23}", "preset": "all|standard|aerial|street|interior|object|light|custom", "count": "[0-9]{1,3}",
}
EVENT_ORDER = ["page_view", "file_selected", "convert_start", "convert_done", "convert_error", "convert_cancel", "gpu_unavailable", "save_fallback", "feedback_open", "lead_submit", "lang_switch"]
ROUTES = {
    "lang_switch": "lang_to", "file_selected": "size_bucket", "convert_start": "size_bucket", "convert_done": "size_bucket", "convert_error": "stage", "convert_cancel": "stage",
    "gpu_unavailable": "reason", "preset": "preset", "save_fallback": "method", "queue_add": "count", "queue_start": "count", "queue_done": "count",
}
COUNTER_ONLY = ["page_view", "lead_submit"]
ROLES = ["scanner", "studio", "developer", "platform", "investor", "other"]
#: Distinct values of an event and day that are counted by name; bytes of a report without diagnostics; days kept.
MAX_VALUES, MAX_BODY, KEEP_DIAGNOSTICS, KEEP_TOTALS = 32, 8192, 180, 400


def event_rules(df: DataFrame) -> DataFrame:
    """One row per known event: name, prop, rule."""
    rows = [(e, p, PROPERTIES[p] if p else None) for e, p in EVENTS.items()]
    return df.sparkSession.createDataFrame(rows, "name string, prop string, rule string")


def clean_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (e, p as JSON text, ...) -> accepted (name, value, ...) and rejected rows of unknown names.

    p is a string or an object that holds the event's property; any other value is dropped, the event counts.
    """
    joined = raw.join(F.broadcast(event_rules(raw)), raw["e"] == F.col("name"), "left")
    parsed = joined.withColumn("p", F.try_parse_json("p"))
    kind = lambda v: F.schema_of_variant(v)
    own = F.lit(None).cast("variant")
    for prop in PROPERTIES:
        own = F.when(F.col("prop") == prop, F.try_variant_get("p", f"$.{prop}", "variant")).otherwise(own)
    held = F.when(kind(F.col("p")).startswith("OBJECT"), own).otherwise(F.col("p"))
    value = F.when(F.col("prop").isNotNull() & (kind(held) == "STRING"), F.try_variant_get(held, "$", "string"))
    joined = parsed
    accepted = joined.where("name IS NOT NULL").withColumn("value", value)
    fits = F.regexp_like(F.col("value"), F.concat(F.lit("\\A(?:"), F.col("rule"), F.lit(")\\z")))
    accepted = accepted.withColumn("value", F.when(fits, F.col("value"))).drop("e", "p", "prop", "rule")
    return accepted, joined.where("name IS NULL").drop("name", "prop", "rule")


def partial_counts(events: DataFrame) -> DataFrame:
    """events (name, value, ts, event_id) -> day, name, value, n, first: counts that can be added up, null values included."""
    return events.groupBy(S.utc_day(F.col("ts")).alias("day"), "name", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))


def folded_counts(partial: DataFrame, most: int = MAX_VALUES) -> DataFrame:
    """Partial counts added up: day, name, value, n: totals (value null) and counts by value.

    Of the values of an event and day the ``most`` first seen keep their name, the rest count as 'other'.
    """
    seen = partial.groupBy("day", "name", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ranked = seen.where("value IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("day", "name").orderBy("first")))
    values = ranked.groupBy("day", "name", F.when(F.col("r") <= most, F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))
    totals = seen.groupBy("day", "name").agg(F.sum("n").alias("n")).select("day", "name", F.lit(None).cast("string").alias("value"), "n")
    return totals.unionByName(values)


def count_events(events: DataFrame, most: int = MAX_VALUES) -> DataFrame:
    """events (name, value, ts, event_id) -> day, name, value, n: see ``folded_counts``."""
    return folded_counts(partial_counts(events), most)


def stats(totals: DataFrame, days: int, last_day: str) -> DataFrame:
    """A row per day with data, one column per event, and a row 'total'."""
    recent = totals.where("value IS NULL").where(F.col("day").between(F.date_format(F.date_sub(F.lit(last_day), days - 1), "yyyy-MM-dd"), F.lit(last_day)))
    sums = [F.coalesce(F.sum(F.when(F.col("name") == e, F.col("n"))), F.lit(0)).alias(e) for e in EVENT_ORDER]
    return recent.rollup("day").agg(*sums).withColumn("day", F.coalesce("day", F.lit("total")))


def conversion_rates(totals: DataFrame) -> DataFrame:
    """done, error and cancel per start in percent; no row without starts."""
    of = lambda e: F.sum(F.when((F.col("name") == e) & F.col("value").isNull(), F.col("n")))
    one = totals.agg(of("convert_start").alias("starts"), *(F.coalesce(of(f"convert_{k}"), F.lit(0)).alias(k) for k in ("done", "error", "cancel"))).where("starts > 0")
    return one.select("starts", *(F.round(F.col(k) * 100 / F.col("starts"), 1).alias(f"{k}_percent") for k in ("done", "error", "cancel")))


def top_values(totals: DataFrame, k: int = 8) -> DataFrame:
    """The most frequent values of each event."""
    sums = totals.where("value IS NOT NULL").groupBy("name", "value").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= k)


def digest(repeats: DataFrame, k: int = 15) -> DataFrame:
    """repeats (day, repeat_of, n; parts add up) -> day, repeat_of, n, rank: the errors repeated most, and a row for how many more there are."""
    again = repeats.groupBy("day", "repeat_of").agg(F.sum("n").alias("n"))
    ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "repeat_of")))
    rest = ranked.where(F.col("rank") > k).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.select("day", F.lit(None).cast("long").alias("repeat_of"), "n", F.lit(k + 1).alias("rank"))
    return ranked.where(F.col("rank") <= k).unionByName(rest.select(*ranked.columns))


def error_digest(reports: DataFrame, k: int = 15) -> DataFrame:
    """The digest of reports (at, repeat_of)."""
    return digest(reports.where("repeat_of IS NOT NULL").groupBy(S.utc_day(F.col("at")).alias("day"), "repeat_of").agg(F.count(F.lit(1)).alias("n")), k)


def assign_report_id(reports: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """report_id R-YYYYMMDD-NNNN by UTC day in order of arrival; goes on after the greatest of ``existing`` (report_id)."""
    rows = reports.withColumn("__day", F.date_format("at", "yyyyMMdd")).withColumn("__hour", F.date_trunc("hour", "at"))
    hours = rows.groupBy("__day", "__hour").agg(F.count(F.lit(1)).alias("__c"))  # numbers run by hour first, then within an hour
    hours = hours.withColumn("__before", F.sum("__c").over(Window.partitionBy("__day").orderBy("__hour")) - F.col("__c")).drop("__c")
    if existing is not None:
        parts = existing.where(F.col("report_id").rlike("^R-[0-9]{8}-[0-9]{4,}$"))
        last = parts.groupBy(F.substring("report_id", 3, 8).alias("__day")).agg(F.max(F.substring_index("report_id", "-", -1).cast("long")).alias("__last"))
        hours = hours.join(last, "__day", "left").withColumn("__before", F.col("__before") + F.coalesce("__last", F.lit(0))).drop("__last")
    inside = F.row_number().over(Window.partitionBy("__day", "__hour").orderBy("at", "id"))
    out = rows.withColumn("__n", inside).join(hours, ["__day", "__hour"]).withColumn("__n", F.col("__n") + F.col("__before"))
    text = F.col("__n").cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return out.withColumn("report_id", F.concat(F.lit("R-"), "__day", F.lit("-"), padded)).select(*reports.columns, "report_id")


def inbox(reports: DataFrame, statuses: DataFrame, kind: str | None = None, everything: bool = False, repeats: bool = False, suspect: bool = False) -> DataFrame:
    """reports (id, kind, message, suspect, repeat_of), statuses (id, status, seq) -> id, kind, state, folded, headline.

    A repeat has its own state or else its first report's; both default to 'open'. Repeats fold into their first.
    """
    latest = statuses.groupBy("id").agg(F.max_by("status", "seq").alias("own"))
    rows = reports if kind is None else reports.where(F.col("kind") == kind)
    rows = rows if suspect else rows.where(~F.coalesce("suspect", F.lit(False)))
    first = latest.select(F.col("id").alias("__first"), F.col("own").alias("inherited"))
    rows = rows.join(latest, "id", "left").join(first, F.col("repeat_of") == F.col("__first"), "left")
    rows = rows.withColumn("state", F.coalesce("own", "inherited", F.lit("open")))
    folded = rows.where("repeat_of IS NOT NULL").groupBy(F.col("repeat_of").alias("__of")).agg(F.count(F.lit(1)).alias("folded"))
    rows = rows if repeats else rows.where("repeat_of IS NULL")
    rows = rows if everything else rows.where("state = 'open'")
    rows = rows.join(folded, F.col("id") == F.col("__of"), "left")
    return rows.select("id", "kind", "state", F.coalesce("folded", F.lit(0)).cast("long").alias("folded"), F.substring(F.substring_index(F.coalesce("message", F.lit("")), "\n", 1), 1, 80).alias("headline"))


def show(reports: DataFrame, report_id: str | None = None) -> DataFrame:
    """reports (id, diagnostics as JSON) -> id, section, no, line: what a reader sees of the diagnostics of one report (or of all).

    Of ``errors`` and ``log`` the last 30 entries (300 characters each), of ``stack`` the first 20 lines (200 each), of other
    keys their value (300). ``no`` counts from 0 within what is shown.
    """
    rows = reports if report_id is None else reports.where(F.col("id") == report_id)
    held = rows.select("id", F.from_json("diagnostics", "map<string,string>").alias("d"))
    last = lambda a: F.transform(F.slice(a, F.greatest(F.lit(1), F.size(a) - 29), F.lit(30)), lambda x: F.substring(x, 1, 300))
    entries = lambda k: last(F.from_json(F.get(F.map_values(F.map_filter("d", lambda n, _: n == k)), F.lit(0)), "array<string>"))
    stack = F.transform(F.slice(F.split(F.get(F.map_values(F.map_filter("d", lambda n, _: n == "stack")), F.lit(0)), "\\r?\\n"), 1, 20), lambda x: F.substring(x, 1, 200))
    rest = F.transform(F.map_entries(F.map_filter("d", lambda n, _: ~n.isin("errors", "log", "stack"))), lambda e: F.struct(e["key"].alias("section"), F.array(F.substring(e["value"], 1, 300)).alias("lines")))
    named = F.array(*(F.struct(F.lit(k).alias("section"), lines.alias("lines")) for k, lines in (("errors", entries("errors")), ("log", entries("log")), ("stack", stack))))
    parts = held.select("id", F.explode(F.concat(named, rest)).alias("x"))
    return parts.select("id", "x.section", F.posexplode("x.lines").alias("no", "line"))


def store_policy(reports: DataFrame, cap: int, stored: DataFrame | None = None) -> DataFrame:
    """reports (id, at, suspect, bytes or null) -> diag_state: kept, skipped (the day's bytes would pass the cap) or absent.

    ``stored`` (day as yyyy-MM-dd, bytes) is what earlier batches hold of a day. Sums run by hour first and then within an
    hour, so no task orders a whole day.
    """
    due = F.when(~F.col("suspect") & F.col("bytes").isNotNull(), F.col("bytes")).otherwise(F.lit(0))
    rows = reports.withColumn("__due", due).withColumn("__day", S.utc_day(F.col("at"))).withColumn("__hour", F.date_trunc("hour", "at"))
    hours = rows.groupBy("__day", "__hour").agg(F.sum("__due").alias("__sum"))
    hours = hours.withColumn("__before", F.sum("__sum").over(Window.partitionBy("__day").orderBy("__hour")) - F.col("__sum")).drop("__sum")
    if stored is not None:
        old = stored.groupBy(F.col("day").alias("__day")).agg(F.sum("bytes").alias("__old"))
        hours = hours.join(old, "__day", "left").withColumn("__before", F.col("__before") + F.coalesce("__old", F.lit(0))).drop("__old")
    inside = F.sum("__due").over(Window.partitionBy("__day", "__hour").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__inside", inside).join(hours, ["__day", "__hour"])
    state = F.when(F.col("suspect") | F.col("bytes").isNull(), "absent").when(F.col("__before") + F.col("__inside") > cap, "skipped").otherwise("kept")
    return rows.withColumn("diag_state", state).select(*reports.columns, "diag_state")


def retention_prune(rows: DataFrame, day: str, today: str, days: int) -> DataFrame:
    """Rows whose day is at most ``days`` before ``today``."""
    return rows.where(F.col(day) >= F.date_format(F.date_sub(F.lit(today), days), "yyyy-MM-dd"))


def consent_gate(events: DataFrame, visitor: str, ts: str, order: str, decision: str) -> DataFrame:
    """Rows without a decision of their own whose visitor's latest decision at that time is 'granted'."""
    before = Window.partitionBy(visitor).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(decision, ignorenulls=True).over(before)
    return events.withColumn("__latest", latest).where((F.col("__latest") == "granted") & F.col(decision).isNull()).drop("__latest")


def route_events(events: DataFrame, lang: Column) -> DataFrame:
    """events (name, value) -> where each goes (counter, analytics) and the analytics parameters as a sorted map."""
    routes = events.sparkSession.createDataFrame(list(ROUTES.items()), "name string, param string")
    out = events.join(F.broadcast(routes), "name", "left")
    value = F.when(F.col("param") == "count", F.col("value").cast("long").cast("string")).otherwise(F.col("value"))
    params = F.map_from_entries(F.filter(F.array(F.struct(F.lit("site_lang").alias("k"), F.lower(F.substring(lang, 1, 5)).alias("v")), F.struct(F.col("param").alias("k"), value.alias("v"))), lambda x: x["k"].isNotNull() & x["v"].isNotNull() & (x["v"] != "")))
    return out.withColumn("to_counter", F.lit(True)).withColumn("to_analytics", ~F.col("name").isin(COUNTER_ONLY)).withColumn("params", params).drop("param")


def parse_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (kind, message, contact, lang, page, release, stage, t, website, consent, diagnostics, body_bytes, ...) -> accepted, rejected.

    Rejected rows have a code: 400 for a bad kind or no message, 413 for a body over the limit.
    """
    out = raw.withColumn("message", S.plain_text(F.col("message"), 2000, lines=True))
    code = F.when(~F.coalesce(F.col("kind").isin("bug", "idea", "error"), F.lit(False)) | (F.col("message") == ""), 400).when(F.col("body_bytes") > MAX_BODY, 413)
    out = out.withColumn("code", code)
    hasty = (F.col("kind") != "error") & (F.coalesce("t", F.lit(0.0)) < 3000)
    accepted = out.where("code IS NULL").drop("code", "body_bytes").withColumns({
        "suspect": (F.coalesce("website", F.lit("")) != "") | hasty,
        "page": S.full_match(F.col("page"), S.SLUG), "stage": S.full_match(F.col("stage"), S.SLUG),
        "lang": S.full_match(F.col("lang"), S.LANG), "release": S.full_match(F.col("release"), S.RELEASE),
        "contact": F.when(F.col("kind") == "error", "").otherwise(S.plain_text(F.col("contact"), 200)),
        "diagnostics": F.when(F.coalesce("consent", F.lit(False)) & F.col("kind").isin("bug", "error"), F.col("diagnostics")),
    })
    return accepted.drop("consent", "t", "website"), out.where("code IS NOT NULL")


def parse_leads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (role, email, name, message, consent, lang, page, t, website, ...) -> accepted, rejected (bad e-mail or no consent)."""
    out = raw.withColumn("email", S.plain_text(F.col("email"), 254))
    fine = F.col("email").rlike(f"^{S.EMAIL}$") & F.coalesce("consent", F.lit(False))
    accepted = out.where(fine).withColumns({
        "role": F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("other"), "name": S.plain_text(F.col("name"), 100),
        "message": S.plain_text(F.col("message"), 1000, lines=True), "lang": S.full_match(F.col("lang"), S.LANG), "page": S.full_match(F.col("page"), S.SLUG),
        "suspect": (F.coalesce("website", F.lit("")) != "") | (F.coalesce("t", F.lit(0.0)) < 3000),
    })
    return accepted.drop("consent", "t", "website"), out.where(~fine)


def first_per(rows: DataFrame, keys: list[str], order: list[str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key: sections seen once per page view, at most five exceptions per view."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__r") <= most).drop("__r")
