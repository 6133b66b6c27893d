"""Device configuration checks and line comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
#: rule id, name, severity, description; HA-001 is declared but has no check
VALIDATION_RULES = [
    ("SEC-001", "No plaintext passwords", "error", "Configuration must not contain plaintext passwords"),
    ("SEC-002", "SSH required for management", "error", "Telnet must be disabled, SSH required for remote management"),
    ("NET-001", "MTU consistency", "warning", "MTU values should be consistent across tunnel endpoints"),
    ("NET-002", "Loopback required", "error", "Router must have a loopback interface configured"),
    ("QOS-001", "QoS policy applied", "warning", "Standard QoS policy should be applied to all interfaces"),
    ("HA-001", "Redundancy configured", "warning", "Critical links should have redundancy configured"),
    ("LOG-001", "Logging enabled", "info", "Syslog should be configured for centralized logging"),
    ("NTP-001", "NTP configured", "warning", "NTP servers should be configured for time synchronization"),
]
#: rule id to message, suggestion and location of its issue
ISSUE_TEXTS = {
    "SEC-001": ("Plaintext password detected", "Use encrypted passwords (type 5 or 7)", None),
    "SEC-002": ("Telnet enabled on VTY lines", "Use 'transport input ssh' instead", "line vty"),
    "NET-001": ("Inconsistent MTU values: ", "Ensure MTU is consistent across related interfaces", None),
    "NET-002": ("No loopback interface defined", "Configure a loopback interface for router-id", None),
    "QOS-001": ("No QoS policy applied to interface", "Apply standard service-policy for traffic management", None),
    "LOG-001": ("No logging configuration found", "Consider configuring syslog for monitoring", None),
    "NTP-001": ("No NTP configuration found", "Configure NTP for time synchronization", None),
}
ERROR_WEIGHT = 3
WARNING_WEIGHT = 1
FULL_SCORE = len(VALIDATION_RULES) * ERROR_WEIGHT
# --- end of fixed values ----------------------------------------------------

ISSUE_TYPE = "struct<rule_id:string,severity:string,message:string,location:string,suggestion:string>"
_SEVERITY = {rule_id: severity for rule_id, _, severity, _ in VALIDATION_RULES}


def mtu_values(config: Column) -> Column:
    """Distinct MTU values of a lower-case configuration, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(config, F.lit(r"(?U)mtu\s+(\d+)"), F.lit(1)))


def find_issues(config: Column, change_type: Column) -> Column:
    """All issues of a lower-case configuration as one array of structs, in rule order."""
    text = config
    mtus = mtu_values(config)

    def issue(rule_id: str, details: Column | None = None) -> Column:
        message, suggestion, location = ISSUE_TEXTS[rule_id]
        shown = F.lit(message) if details is None else F.concat(F.lit(message), details)
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(_SEVERITY[rule_id]).alias("severity"),
            shown.alias("message"),
            F.lit(location).cast("string").alias("location"),
            F.lit(suggestion).alias("suggestion"),
        ).cast(ISSUE_TYPE)

    typed_secret = text.rlike(r"(?U)(?:password|secret)\s+\d")
    plain_secret = text.contains("password 0") | text.contains("secret 0")
    checks = [
        F.when(typed_secret & plain_secret, issue("SEC-001")),
        F.when(text.contains("transport input telnet"), issue("SEC-002")),
        F.when(F.size(mtus) > 1, issue("NET-001", F.array_join(mtus, ", "))),
        F.when((change_type == "routing") & ~text.contains("interface loopback"), issue("NET-002")),
        F.when((change_type == "interface") & ~text.contains("service-policy"), issue("QOS-001")),
        F.when(~text.contains("logging"), issue("LOG-001")),
        F.when(~text.contains("ntp server") & ~text.contains("ntp peer"), issue("NTP-001")),
    ]
    return F.array_compact(F.array(*checks))


def with_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda i: i["severity"] == severity)


def best_practice_score(errors: Column, warnings: Column) -> Column:
    """1 minus the weighted share of issues, at least 0, two decimals (half to even)."""
    lost = F.size(errors) * ERROR_WEIGHT + F.size(warnings) * WARNING_WEIGHT
    return F.bround(F.greatest(F.lit(0.0), (F.lit(FULL_SCORE) - lost) / F.lit(float(FULL_SCORE))), 2)


def keep_lines(lines: Column, wanted: Column) -> Column:
    """Lines that occur in ``wanted``; repeated lines are all kept."""
    return F.filter(lines, lambda line: F.array_contains(wanted, line))
