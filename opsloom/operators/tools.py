"""Named tools: requests in, one result row per request out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.text import flag
from opsloom.operators import operations as O
from opsloom.session import scratch_dir

logger = logging.getLogger(__name__)

#: result columns a tool returns besides request_id
RESULT_COLUMNS = ["data", "summary", "error"]
_NO_TOOL = "__none"
#: what a ticket's status can be; other values are looked up like any key
TICKET_STATUS = ["new", "in_progress", "resolved", "closed"]


@dataclass(frozen=True)
class Tool:
    """``run`` maps requests (request_id, params map) to request_id, data (JSON), summary, error."""

    name: str
    description: str
    run: Callable[[DataFrame], DataFrame]
    parameters: dict = field(default_factory=dict)

    def schema(self) -> dict:
        """Function-calling description of the tool."""
        body = {"type": "object", "properties": self.parameters}
        return {
            "type": "function",
            "function": {"name": self.name, "description": self.description, "parameters": body},
        }


class ToolRegistry:
    """Tools by name; registering a name again replaces the tool."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            logger.warning("replacing tool %s", tool.name)
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def list_tools(self) -> list[dict]:
        return [tool.schema() for tool in self._tools.values()]

    def execute(self, requests: DataFrame) -> DataFrame:
        """Run every request (request_id, tool_name, params) with its tool: one row for each.

        Returns request_id, tool_name, status, data, summary, error.  Requests
        for unknown tools, or for none, become error rows.  A tool that cannot
        even be planned turns its requests into error rows too.

        The requests are written once to the shared folder, a part for each
        tool name, so every tool reads its own and their source is read once.
        """
        path = scratch_dir(requests.sparkSession, "requests")
        known = F.when(F.col("tool_name").isin(list(self._tools)), F.col("tool_name"))
        routed = requests.select("request_id", "tool_name", "params").withColumn("tool", F.coalesce(known, F.lit(_NO_TOOL)))
        routed.write.partitionBy("tool").parquet(path)
        stored = requests.sparkSession.read.schema(routed.schema).parquet(path)
        parts = []
        for name, tool in self._tools.items():
            own = stored.where(F.col("tool") == name).select("request_id", "params")
            try:
                out = tool.run(own).select("request_id", *RESULT_COLUMNS)
            except Exception as error:  # noqa: BLE001 - the contract is an error row
                logger.error("tool %s failed: %s", name, error)
                out = own.select(
                    "request_id",
                    F.lit("{}").alias("data"),
                    F.lit(f"Tool '{name}' failed: {error}").alias("summary"),
                    F.lit(str(error)).alias("error"),
                )
            status = F.when(F.col("error").isNull(), "success").otherwise("error")
            parts.append(out.withColumns({"tool_name": F.lit(name), "status": status}))
        asked = F.coalesce("tool_name", F.lit("null"))
        unknown = stored.where(F.col("tool") == _NO_TOOL).select(
            "request_id",
            F.lit("{}").alias("data"),
            F.format_string("Tool '%s' not found", asked).alias("summary"),
            F.concat(F.lit("Unknown tool: "), asked).alias("error"),
            "tool_name",
            F.lit("error").alias("status"),
        )
        columns = ["request_id", "tool_name", "status", *RESULT_COLUMNS]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in [*parts, unknown]])


def _param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def _result(df: DataFrame, fields: list[str], summary: Column) -> DataFrame:
    return df.select(
        "request_id", F.to_json(F.struct(*fields)).alias("data"), summary.alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )


def _data_error(df: DataFrame, message: Column, summary: Column) -> DataFrame:
    """A refused request: the reason is in the data, the call itself succeeded."""
    return df.select(
        "request_id", F.to_json(F.struct(message.alias("error"))).alias("data"), summary.alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )


def network_health_tool(elements: DataFrame, regions: DataFrame) -> Tool:
    """Region rollup, or one element's row when ``element_id`` is given.

    A region without elements has a rollup of zero elements.  The rollup has a
    row for each configured region, a fixed dimension.
    """

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select("request_id", _param("region").alias("region"), _param("element_id").alias("element_id"))
        known = O.known_region(asked, regions)
        good = known.where(F.col("error").isNull())
        named = F.broadcast(regions.select("region").distinct())
        normal = elements.withColumn("region", O.S.normalize_region(F.col("region")))
        rolled = named.join(O.network_health(normal.join(named, "region", "left_semi")).drop("summary"), "region", "left")
        rolled = F.broadcast(rolled.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("total_elements", "degraded")}))
        whole = good.where(F.col("element_id").isNull()).join(rolled, "region").withColumn("summary", O.health_summary())
        one = good.where(F.col("element_id").isNotNull()).join(elements, ["region", "element_id"], "left")
        shown = F.concat_ws("", "element_id", F.lit(": "), "status", F.lit(", availability: "), F.col("availability").cast("string"), F.lit("%"))
        bad = known.where(F.col("error").isNotNull())
        missing = F.concat(F.lit("Region '"), F.col("region"), F.lit("' not found in network topology"))
        return (
            _result(whole, ["region", "total_elements", "overall_availability", "degraded"], F.col("summary"))
            .unionByName(_result(one, ["region", "element_id", "status", "availability"], shown))
            .unionByName(_data_error(bad, F.col("error"), missing))
        )

    return Tool(
        "network_health_check",
        "Current health of the elements of a region: status, availability and degraded count.",
        run,
        {"region": {"type": "string"}, "element_id": {"type": "string", "required": False}},
    )


def ticket_creator_tool(now: Column | None = None) -> Tool:
    def run(requests: DataFrame) -> DataFrame:
        fields = ["title", "description", "priority", "category", "region"]
        asked = requests.select(
            "request_id",
            *[_param(f).alias(f) for f in fields],
            F.filter(F.split(F.coalesce(_param("affected_elements"), F.lit("")), ","), lambda e: F.length(e) > 0).alias("affected_elements"),
            (F.current_timestamp() if now is None else now).alias("ts"),
        )
        tickets = O.create_tickets(asked, ["request_id"], keep=("request_id",))
        said = F.format_string(
            "Created %s ticket %s (priority: %s, assigned to: %s)", "category", "ticket_id", "priority", "assignee"
        )
        return _result(tickets, ["ticket_id", "title", "priority", "status", "category", "assignee", "created_at"], said)

    return Tool(
        "ticket_creator",
        "Create an incident, change, problem or request ticket.",
        run,
        {
            "title": {"type": "string"},
            "description": {"type": "string"},
            "priority": {"type": "string", "enum": ["critical", "high", "medium", "low"]},
            "category": {"type": "string", "enum": ["incident", "change", "problem", "request"]},
            "region": {"type": "string", "required": False},
            "affected_elements": {"type": "array", "items": {"type": "string"}, "required": False},
        },
    )


def ticket_query_tool(tickets: DataFrame) -> Tool:
    """One ticket by id, or the number of tickets by status and affected element.

    The matching tickets themselves are a table: see
    :func:`opsloom.operators.operations.search_tickets`.
    """

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select(
            "request_id",
            _param("ticket_id").alias("ticket_id"),
            _param("status").alias("__status"),
            _param("element_id").alias("__element"),
        )
        shown = ["ticket_id", "title", "priority", "status", "category", "assignee", "region", "affected_elements"]
        by_id = asked.where(F.col("ticket_id").isNotNull()).join(tickets.select(*shown), "ticket_id", "left")
        found = by_id.where(F.col("status").isNotNull())
        absent = by_id.where(F.col("status").isNull())
        missing = F.format_string("Ticket %s not found", "ticket_id")

        # each ticket counts under its status and any, and under each of its elements and any
        def or_any(values: Column) -> Column:
            return F.explode(F.concat(F.array(F.lit(None).cast("string")), values))

        counts = (
            tickets.select("status", or_any(F.array_distinct(F.coalesce("affected_elements", F.array()))).alias("e"))
            .select("e", or_any(F.array("status")).alias("s"))
            .groupBy("s", "e")
            .agg(F.count("*").alias("count"))
        )
        # requests that name no element share a few keys: their answers are one row per known status
        plain = F.col("__element").isNull() & (F.col("__status").isNull() | F.col("__status").isin(TICKET_STATUS))
        few = counts.where(F.col("e").isNull() & (F.col("s").isNull() | F.col("s").isin(TICKET_STATUS)))
        searched = asked.where(F.col("ticket_id").isNull())
        same = F.col("__status").eqNullSafe(F.col("s")) & F.col("__element").eqNullSafe(F.col("e"))
        searched = (
            searched.where(plain).join(F.broadcast(few), same, "left")
            .unionByName(searched.where(~plain).join(counts.where(F.col("e").isNotNull() | ~F.col("s").isin(TICKET_STATUS)), same, "left"))
            .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
        )
        return (
            _result(found, shown, F.format_string("Found ticket %s: %s", "ticket_id", "status"))
            .unionByName(_data_error(absent, missing, missing))
            .unionByName(_result(searched, ["count"], F.format_string("Found %d tickets matching criteria", "count")))
        )

    return Tool(
        "ticket_query",
        "Find tickets by id, status or affected element.",
        run,
        {
            "ticket_id": {"type": "string", "required": False},
            "status": {"type": "string", "enum": TICKET_STATUS, "required": False},
            "element_id": {"type": "string", "required": False},
        },
    )


def sla_monitor_tool(compliance: DataFrame, regions: DataFrame) -> Tool:
    """Status, at-risk or breach rollup of a region, or of one of its services.

    The at-risk and breaching services themselves are tables: see
    :func:`opsloom.operators.operations.sla_at_risk` and ``sla_breaches``.
    """

    names = ["total_services", "compliant", "non_compliant", "at_risk", "near", "breached", "breaches"]
    bad = ~F.col("is_compliant")
    close = F.col("current_availability") < F.col("target_availability") + 0.1
    level = O.S.risk_level(
        F.col("current_availability") - F.col("target_availability"), F.col("target_latency_ms") - F.col("current_latency_ms")
    )
    conditions = [F.lit(True), ~bad, bad, bad & close, level.isNotNull(), F.col("breach_count_30d") > 0]
    values = [flag(c).cast("bigint") for c in conditions] + [F.col("breach_count_30d")]
    per_service = compliance.select("region", "service_id", *[v.alias(n) for v, n in zip(values, names)])

    def answers(rows: DataFrame) -> DataFrame:
        """Three answers per row, one for each kind of check."""

        def answer(check: str, fields: dict[str, str], summary: Column) -> Column:
            data = F.to_json(F.struct("region", *[F.col(c).alias(n) for n, c in fields.items()]))
            return F.struct(F.lit(check).alias("c"), data.alias("data"), summary.alias("summary"))

        status = F.format_string(
            "Region %s: %d/%d services compliant, %d at risk", "region", "compliant", "total_services", "at_risk"
        )
        near = F.format_string("Found %d services at risk of SLA breach in %s", "near", "region")
        breached = F.format_string("%d services had %d total breaches in last 30 days", "breached", "breaches")
        three = F.array(
            answer("status", {n: n for n in names[:4]}, status),
            answer("at_risk", {"count": "near"}, near),
            answer("breaches", {"services_with_breaches": "breached", "total_breaches_30d": "breaches"}, breached),
        )
        return rows.select(F.col("region").alias("r"), F.col("service_id").alias("s"), F.inline(three))

    per_region = per_service.groupBy("region").agg(
        F.lit(None).cast("string").alias("service_id"), *[F.sum(n).alias(n) for n in names]
    )
    # three answers for each configured region, a fixed dimension; a region without services has zeros
    counted = regions.select("region").distinct().join(per_region, "region", "left")
    of_region = F.broadcast(answers(counted.fillna(0, names)).drop("s"))

    def run(requests: DataFrame) -> DataFrame:
        check = F.coalesce(_param("check_type"), F.lit("status"))
        asked = requests.select(
            "request_id",
            _param("region").alias("region"),
            _param("service_id").alias("service_id"),
            F.when(check.isin("status", "at_risk", "breaches"), check).otherwise("status").alias("check_type"),
        )
        known = O.known_region(asked, regions)
        good = known.where(F.col("error").isNull()).drop("error")
        same = (F.col("region") == F.col("r")) & (F.col("check_type") == F.col("c"))
        whole = good.where(F.col("service_id").isNull()).join(of_region, same, "left")
        one = good.where(F.col("service_id").isNotNull()).join(answers(per_service), same & (F.col("service_id") == F.col("s")), "left")
        good = whole.unionByName(one.drop("s"))
        no_service = good.where(F.col("data").isNull())
        bad = known.where(F.col("error").isNotNull())
        answered = good.where(F.col("data").isNotNull()).select(
            "request_id", "data", "summary", F.lit(None).cast("string").alias("error")
        )
        return answered.unionByName(
            _data_error(no_service, F.format_string("Service %s not found in %s", "service_id", "region"), F.lit("Service not found"))
        ).unionByName(_data_error(bad, F.col("error"), F.format_string("Region '%s' not found", "region")))

    return Tool(
        "sla_monitor",
        "Service-level status, services at risk and breaches of a region.",
        run,
        {
            "region": {"type": "string"},
            "service_id": {"type": "string", "required": False},
            "check_type": {"type": "string", "enum": ["status", "at_risk", "breaches"], "required": False},
        },
    )


def config_validator_tool() -> Tool:
    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select(
            "request_id",
            _param("config").alias("config"),
            F.coalesce(_param("element_id"), F.lit("unknown")).alias("element_id"),
            F.coalesce(_param("change_type"), F.lit("general")).alias("change_type"),
            (F.lower(F.coalesce(_param("strict_mode"), F.lit("false"))) == "true").alias("__strict"),
        )
        fields = [
            "element_id", "change_type", "is_valid", "policy_compliant", "best_practices_score",
            "error_count", "warning_count", "info_count", "errors", "warnings", "info",
        ]
        parts = []
        for strict in (False, True):
            checked = O.validate_configs(asked.where(F.col("__strict") == strict), strict=strict)
            good, empty = checked.where(F.col("error").isNull()), checked.where(F.col("error").isNotNull())
            parts += [_result(good, fields, F.col("summary")), _data_error(empty, F.col("error"), F.col("summary"))]
        return reduce(DataFrame.unionByName, parts)

    return Tool(
        "config_validator",
        "Check a configuration against security policy and good practice.",
        run,
        {
            "config": {"type": "string"},
            "element_id": {"type": "string"},
            "change_type": {"type": "string", "enum": ["interface", "routing", "qos", "security", "general"], "required": False},
            "strict_mode": {"type": "boolean", "required": False},
        },
    )


def config_diff_tool() -> Tool:
    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select(
            "request_id", _param("current_config").alias("current_config"), _param("proposed_config").alias("proposed_config")
        )
        out = O.diff_configs(asked)
        return _result(out, ["added", "removed", "unchanged_count", "change_count"], F.col("summary"))

    return Tool(
        "config_diff",
        "Lines added and removed between two configurations.",
        run,
        {"current_config": {"type": "string"}, "proposed_config": {"type": "string"}},
    )


def default_registry(elements: DataFrame, tickets: DataFrame, compliance: DataFrame, regions: DataFrame) -> ToolRegistry:
    """All tools over the given tables."""
    registry = ToolRegistry()
    for tool in (
        network_health_tool(elements, regions),
        ticket_creator_tool(),
        ticket_query_tool(tickets),
        sla_monitor_tool(compliance, regions),
        config_validator_tool(),
        config_diff_tool(),
    ):
        registry.register(tool)
    return registry
