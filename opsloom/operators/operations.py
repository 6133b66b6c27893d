"""Network health, service levels, tickets and configuration checks as rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opsloom.functions import configs as G
from opsloom.functions import services as S
from opsloom.functions.text import lines


# --- dimensions: fixed, a few dozen rows at most ----------------------------
def topology(ranges: DataFrame) -> DataFrame:
    """One row per node (region, element_id, core_router, edge_routers) from one row per region.

    ``ranges``: region, first, last (node numbers), core_router, edge_routers.
    """
    nodes = F.explode(F.sequence("first", "last"))
    return ranges.select("region", nodes.alias("n"), "core_router", "edge_routers").select(
        "region", F.concat(F.lit("node-"), F.col("n")).alias("element_id"), "core_router", "edge_routers"
    )


_METRICS = {"availability": "target_availability", "latency": "target_latency_ms", "error_rate": "target_error_rate"}


def sla_thresholds(spark: SparkSession) -> DataFrame:
    """One row per tier with its three targets and their measurement windows; the row of a null tier is the default."""
    found = [*S.SLA_THRESHOLDS, *((None, *rest) for rest in S.DEFAULT_SLA_THRESHOLDS)]
    tiers: dict[str | None, dict[str, tuple]] = {}
    for tier, metric, target, _, window in found:
        tiers.setdefault(tier, {})[metric] = (target, window)
    rows = [(tier, *[m[n][0] for n in _METRICS], *[m[n][1] for n in _METRICS]) for tier, m in tiers.items()]
    targets = ", ".join(f"{t} double" for t in _METRICS.values())
    windows = ", ".join(f"window_{m} string" for m in _METRICS)
    return spark.createDataFrame(rows, f"tier string, {targets}, {windows}")


def with_thresholds(services: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add each service's targets and windows; a tier that is null or unknown gets the default ones."""
    names = [c for c in thresholds.columns if c != "tier"]
    own = thresholds.where(F.col("tier").isNotNull()).select("tier", F.struct(*names).alias("__own"))
    default = thresholds.where(F.col("tier").isNull()).select(F.struct(*names)).scalar()
    chosen = F.coalesce("__own", default)
    return services.join(F.broadcast(own), "tier", "left").select(*services.columns, *[chosen[n].alias(n) for n in names])


def validation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(G.VALIDATION_RULES, "rule_id string, name string, severity string, description string")


# --- network health ---------------------------------------------------------
def degraded_elements(elements: DataFrame) -> DataFrame:
    """Elements whose status is not ``operational``, one row each."""
    return elements.where(F.col("status") != "operational").select("region", "element_id", "status")


def network_health(elements: DataFrame) -> DataFrame:
    """Per region: element count, mean availability and number of degraded elements.

    ``elements``: region, element_id, status, availability.  The degraded ids
    themselves are rows (:func:`degraded_elements`), because a region may have
    any number of them.
    """
    region = S.normalize_region(F.col("region"))
    rolled = elements.groupBy(region.alias("region")).agg(
        F.count("*").alias("total_elements"),
        F.bround(F.avg("availability"), 2).alias("overall_availability"),
        F.count_if(F.col("status") != "operational").alias("degraded"),
    )
    return rolled.withColumn("summary", health_summary())


def health_summary() -> Column:
    """The sentence on a region's rollup; without elements there is no availability."""
    known = F.col("overall_availability").isNotNull()
    shown = F.when(known, F.format_string("%.2f%%", "overall_availability")).otherwise("n/a")
    return F.format_string("Region %s: %d elements, availability: %s, degraded: %d", "region", "total_elements", shown, "degraded")


def known_region(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """Normalise requested regions; unknown ones carry an error text.

    ``regions`` is the list of configured regions, a fixed dimension.
    """
    names = F.broadcast(regions.select(F.col("region").alias("__known")).distinct())
    out = requests.withColumn("region", S.normalize_region(F.coalesce("region", F.lit("region_a"))))
    joined = out.join(names, F.col("region") == F.col("__known"), "left")
    error = F.when(F.col("__known").isNull(), F.concat(F.lit("Unknown region: "), F.col("region")))
    return joined.withColumn("error", error).drop("__known")


# --- service levels ---------------------------------------------------------
def sla_measurements(samples: DataFrame, thresholds: DataFrame, as_of: Column) -> DataFrame:
    """Per service: availability, latency, error rate, breaches of 30 days and the last breach.

    ``samples``: region, service_id, service_name, tier, ts, latency_ms,
    is_error, is_available.  Each metric is measured over the window its
    threshold names, back from ``as_of``: an hour, a day or 30 days; without a
    sample there it is null.  A clock hour of the last 30 days whose mean
    latency exceeds the target is one breach.  A service appears with its first
    sample up to ``as_of``, however old.  Both steps pre-aggregate, so a busy
    service is no hot spot.
    """
    ids = ["region", "service_id", "service_name", "tier"]
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))

    def within(seconds: Column | int) -> Column:
        return F.col("__age") < F.lit(1_000_000).cast("long") * seconds

    def seconds(metric: str) -> Column:
        window = F.col(f"window_{metric}")
        pairs = [(window == name, F.lit(value)) for name, value in S.WINDOW_SECONDS.items()]
        return F.coalesce(*[F.when(c, v) for c, v in pairs])

    recent = with_thresholds(samples.withColumn("__age", age).where(F.col("__age") >= 0), thresholds)

    def counted(metric: str, value: Column) -> tuple[Column, Column]:
        inside = within(seconds(metric))
        return F.sum(F.when(inside, value)).alias(f"__{metric}"), F.count_if(inside).alias(f"__{metric}_n")

    in_breach_time = within(S.BREACH_DAYS * 86_400)
    hourly = recent.groupBy(*ids, "target_latency_ms", F.date_trunc("hour", "ts").alias("hour")).agg(
        *counted("availability", F.col("is_available").cast("int")),
        *counted("latency", F.col("latency_ms")),
        *counted("error_rate", F.col("is_error").cast("int")),
        F.avg(F.when(in_breach_time, F.col("latency_ms"))).alias("__hour_latency"),
    )
    breach = F.col("__hour_latency") > F.col("target_latency_ms")

    def ratio(metric: str, factor: float) -> Column:
        return F.sum(f"__{metric}") * factor / F.nullif(F.sum(f"__{metric}_n"), F.lit(0))

    return hourly.groupBy(*ids).agg(
        F.round(ratio("availability", 100.0), 3).alias("current_availability"),
        F.round(ratio("latency", 1.0), 1).alias("current_latency_ms"),
        F.round(ratio("error_rate", 100.0), 2).alias("current_error_rate"),
        F.count_if(breach).alias("breach_count_30d"),
        F.max(F.when(breach, F.col("hour"))).alias("last_breach"),
    )


def sla_compliance(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add targets, a verdict per metric, the overall verdict and breach details.

    A metric without samples in its window breaks no target.
    """
    targets = thresholds.select("tier", *_METRICS.values())
    avail, latency, errors = F.col("current_availability"), F.col("current_latency_ms"), F.col("current_error_rate")
    t_avail, t_latency, t_errors = F.col("target_availability"), F.col("target_latency_ms"), F.col("target_error_rate")
    details = F.array_compact(
        F.array(
            F.when(
                ~F.col("availability_compliant"),
                F.format_string("Availability %s%% below target %s%%", avail.cast("string"), t_avail.cast("string")),
            ),
            F.when(
                ~F.col("latency_compliant"),
                F.format_string("Latency %sms exceeds target %sms", latency.cast("string"), t_latency.cast("string")),
            ),
            F.when(
                ~F.col("error_rate_compliant"),
                F.format_string("Error rate %s%% exceeds target %s%%", errors.cast("string"), t_errors.cast("string")),
            ),
        )
    )

    def verdict(ok: Column) -> Column:
        return F.coalesce(ok, F.lit(True))

    return (
        with_thresholds(measured, targets)
        .withColumns(
            {
                "availability_compliant": verdict(S.availability_ok(avail, t_avail)),
                "latency_compliant": verdict(S.latency_ok(latency, t_latency)),
                "error_rate_compliant": verdict(S.error_rate_ok(errors, t_errors)),
            }
        )
        .withColumn(
            "is_compliant",
            F.col("availability_compliant") & F.col("latency_compliant") & F.col("error_rate_compliant"),
        )
        .withColumn("breach_details", details)
    )


def sla_status(compliance: DataFrame) -> DataFrame:
    """Per region: services, compliant, non-compliant, and non-compliant ones close to target."""
    bad = ~F.col("is_compliant")
    close = F.col("current_availability") < F.col("target_availability") + 0.1
    rolled = compliance.groupBy("region").agg(
        F.count("*").alias("total_services"),
        F.count_if("is_compliant").alias("compliant"),
        F.count_if(bad).alias("non_compliant"),
        F.count_if(bad & close).alias("at_risk"),
    )
    text = F.format_string(
        "Region %s: %d/%d services compliant, %d at risk", "region", "compliant", "total_services", "at_risk"
    )
    return rolled.withColumn("summary", text)


def sla_at_risk(compliance: DataFrame) -> DataFrame:
    """Services near a threshold with both margins and a risk level."""
    a = F.col("current_availability") - F.col("target_availability")
    m = F.col("target_latency_ms") - F.col("current_latency_ms")
    return compliance.withColumn("risk_level", S.risk_level(a, m)).where(F.col("risk_level").isNotNull()).select(
        "region",
        "service_id",
        F.round(a, 3).alias("availability_margin"),
        F.round(m, 1).alias("latency_margin_ms"),
        "risk_level",
    )


def sla_breaches(compliance: DataFrame) -> DataFrame:
    """Services with at least one breach, and whether they are breaching now."""
    return compliance.where(F.col("breach_count_30d") > 0).select(
        "region",
        "service_id",
        "service_name",
        F.col("breach_count_30d").alias("breach_count"),
        "last_breach",
        F.when(F.col("is_compliant"), "compliant").otherwise("breaching").alias("current_status"),
    )


def breach_totals(breaches: DataFrame) -> DataFrame:
    """Per region: services with breaches and their total."""
    return breaches.groupBy("region").agg(
        F.count("*").alias("services_with_breaches"), F.sum("breach_count").alias("total_breaches_30d")
    )


# --- tickets ----------------------------------------------------------------
def create_tickets(
    requests: DataFrame, identity: list[str], domain: str = S.MAIL_DOMAIN, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Tickets from requests: title, description, priority, category, region, affected_elements, ts.

    Missing fields get their defaults; ``identity`` columns make the id, and
    ``keep`` columns pass through.
    """
    none = F.array().cast("array<string>")
    filled = requests.withColumns(
        {
            "title": F.coalesce("title", F.lit("Untitled Ticket")),
            "description": F.coalesce("description", F.lit("")),
            "priority": F.coalesce("priority", F.lit("medium")),
            "category": F.coalesce("category", F.lit("incident")),
            "affected_elements": F.coalesce("affected_elements", none),
        }
    )
    category, priority, region = F.col("category"), F.col("priority"), F.col("region")
    return filled.select(
        S.ticket_id(category, *[F.col(c) for c in identity]).alias("ticket_id"),
        F.substring("title", 1, S.TITLE_LIMIT).alias("title"),
        F.substring("description", 1, S.DESCRIPTION_LIMIT).alias("description"),
        "priority",
        F.lit("new").alias("status"),
        "category",
        S.ticket_assignee(priority, category, region, domain).alias("assignee"),
        "region",
        "affected_elements",
        F.col("ts").alias("created_at"),
        *keep,
    )


def search_tickets(
    tickets: DataFrame, ticket_id: str | None = None, status: str | None = None, element_id: str | None = None
) -> DataFrame:
    """By id alone, or by status and affected element."""
    if ticket_id:
        return tickets.where(F.col("ticket_id") == ticket_id)
    if status:
        tickets = tickets.where(F.col("status") == status)
    if element_id:
        tickets = tickets.where(F.array_contains("affected_elements", element_id))
    return tickets


# --- configurations ---------------------------------------------------------
def validate_configs(configs: DataFrame, config: str = "config", strict: bool = False) -> DataFrame:
    """Add the verdict on each configuration: issues by severity, score, validity.

    ``configs``: config, change_type.  An empty configuration gets an error
    and no verdict.  In strict mode warnings count as errors, but only after
    score and policy verdict are fixed.
    """
    change = F.coalesce(F.col("change_type"), F.lit("general"))
    present = F.col(config).isNotNull() & (F.length(config) > 0)
    issues = F.when(F.col("__lower").isNotNull(), G.find_issues(F.col("__lower"), change))
    out = (
        configs.withColumn("__lower", F.when(present, F.lower(F.col(config))))
        .withColumn("__issues", issues)
        .withColumns({f"__{s}": G.with_severity(F.col("__issues"), s) for s in ("error", "warning", "info")})
        .withColumns(
            {
                "best_practices_score": G.best_practice_score(F.col("__error"), F.col("__warning")),
                "policy_compliant": ~F.exists("__error", lambda e: e["rule_id"].startswith("SEC")),
            }
        )
    )
    errors, warnings = F.col("__error"), F.col("__warning")
    if strict:
        errors, warnings = F.concat(errors, warnings), F.slice(warnings, 1, 0)
    n_errors, n_warnings = F.size("errors"), F.size("warnings")
    percent = F.format_string("%.0f%%", F.col("best_practices_score") * 100)
    summary = (
        F.when(~present, "Validation failed: no configuration to validate")
        .when(
            ~F.col("is_valid"),
            F.format_string("Configuration invalid: %d error(s), %d warning(s)", n_errors, n_warnings),
        )
        .when(
            n_warnings > 0,
            F.concat(
                F.format_string("Configuration valid with %d warning(s). Best practices score: ", n_warnings), percent
            ),
        )
        .otherwise(F.concat(F.lit("Configuration valid. Best practices score: "), percent))
    )
    return (
        out.withColumns({"errors": errors, "warnings": warnings, "info": F.col("__info")})
        .withColumns(
            {
                "error_count": n_errors,
                "warning_count": n_warnings,
                "info_count": F.size("info"),
                "is_valid": n_errors == 0,
                "error": F.when(~present, "No configuration provided"),
            }
        )
        .withColumn("summary", summary)
        .drop("__lower", "__issues", "__error", "__warning", "__info")
    )


def diff_configs(pairs: DataFrame, current: str = "current_config", proposed: str = "proposed_config") -> DataFrame:
    """Add added and removed lines and their counts; repeated lines are all counted."""
    now, then = F.col("__current"), F.col("__proposed")
    added, removed = F.size("added"), F.size("removed")
    return (
        pairs.withColumns(
            {
                "__current": lines(F.coalesce(F.col(current), F.lit(""))),
                "__proposed": lines(F.coalesce(F.col(proposed), F.lit(""))),
            }
        )
        .withColumns({"__new": F.array_except(then, now), "__gone": F.array_except(now, then)})
        .withColumns(
            {
                "added": G.keep_lines(then, F.col("__new")),
                "removed": G.keep_lines(now, F.col("__gone")),
            }
        )
        .withColumns(
            {
                "added_count": added,
                "removed_count": removed,
                "unchanged_count": F.size(now) - removed,
                "change_count": added + removed,
                "summary": F.format_string("Config diff: +%d added, -%d removed", added, removed),
            }
        )
        .drop("__current", "__proposed", "__new", "__gone")
    )


# --- service levels at many moments -----------------------------------------
def sla_timeline(samples: DataFrame, thresholds: DataFrame, since: str, until: str, step: str = "1 day") -> DataFrame:
    """The levels of every service at every moment from ``since`` to ``until``, from one pass over the samples.

    ``samples`` as in :func:`sla_measurements`; moments lie on full hours and
    windows (30 days, one day, one hour, by default thresholds) reach back from
    a moment, which they do not include.  Samples become hourly sums once;
    running totals per service turn any window into the difference of two of
    them, found by an as-of merge of hours and moments.  A service appears from
    its first sample on; a metric without samples in its window is null and
    breaks no target.
    """
    ids = ["region", "service_id", "service_name", "tier"]
    hourly = (
        with_thresholds(samples, thresholds)
        .groupBy(*ids, "target_latency_ms", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))
        .agg(
            F.count("*").alias("n"),
            F.count_if("is_available").alias("up"),
            F.count_if("is_error").alias("bad"),
            # whole nanoseconds: differences of running totals stay exact
            F.sum(F.round(F.col("latency_ms") * 1_000_000).cast("long")).alias("ns"),
            F.avg("latency_ms").alias("__mean"),
        )
        .withColumn("breach", (F.col("__mean") > F.col("target_latency_ms")).cast("long"))
    )
    totals = ["n", "up", "bad", "ns", "breach"]
    # rows of one service: its hours, whatever the number of its samples
    own = Window.partitionBy(*ids).orderBy("at")
    running = hourly.select(*ids, "at", F.lit(1).alias("kind"), F.struct(*[F.sum(c).over(own).alias(c) for c in totals]).alias("upto"))

    windows = {"now": 0, **{m: S.WINDOW_SECONDS[w] for m, w in (("month", "monthly"), ("day", "daily"), ("hour", "hourly"))}}
    moments = F.sequence(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))
    reach = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(s).alias("seconds")) for n, s in windows.items()])
    services = hourly.groupBy(*ids).agg(F.min("at").alias("first"))
    points = services.select(*ids, "first", F.explode(moments).alias("as_of")).where(F.col("as_of") > F.col("first"))
    points = points.select(*ids, "as_of", F.explode(reach).alias("w")).select(
        *ids, "as_of", "w.window", (F.col("as_of") - F.make_dt_interval(secs=F.col("w.seconds"))).alias("at"), F.lit(0).alias("kind")
    )
    # a moment sees the hours before its own
    seen = Window.partitionBy(*ids).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = running.unionByName(points, allowMissingColumns=True).withColumn("found", F.last("upto", ignorenulls=True).over(seen))
    at = merged.where(F.col("kind") == 0).groupBy(*ids, "as_of").agg(
        *[F.max(F.when(F.col("window") == w, F.col("found"))).alias(w) for w in windows]
    )

    def inside(window: str, total: str) -> Column:
        return F.coalesce(F.col("now")[total], F.lit(0)) - F.coalesce(F.col(window)[total], F.lit(0))

    def ratio(window: str, total: str, factor: float) -> Column:
        return inside(window, total) * factor / F.nullif(inside(window, "n"), F.lit(0))

    measured = at.select(
        *ids,
        "as_of",
        F.round(ratio("month", "up", 100.0), 3).alias("current_availability"),
        F.round(ratio("hour", "ns", 1e-6), 4).alias("current_latency_ms"),
        F.round(ratio("day", "bad", 100.0), 2).alias("current_error_rate"),
        inside("month", "breach").alias("breach_count_30d"),
    )
    return sla_compliance(measured, thresholds)
