"""Error classification and severity as ``CASE WHEN`` chains over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Each entry is (error type, alternatives); an alternative is a tuple of
# fragments which must all occur in the lower-cased text. The first entry that matches wins.
# Six fragments carry capitals, so they cannot occur in lower-cased text: "faithful" keeps
# them as they are, "intended" compares them in lower case.
ERROR_TYPES = [
    ("Boot Instance Failed: Instance Status is ERROR", [("status is error: fault is None",)]),
    ("Instance could not be found (HTTP 404) - FUNC: server_delete",
     [("Instance could not be found (HTTP 404) FUNC: server_delete",)]),
    ("(HTTP 429) Rate Limited", [("http 429",), ("rate-limited",), ("rate limit",)]),
    ("(HTTP 404) Resource Not Found", [("http 404", "not found")]),
    ("Address Quota Exceeded", [("AddressLimitExceeded: Address quota exceeded",)]),
    ("Instance Quota Exceeded", [("Quota exceeded for instances",)]),
    ("(HTTP 400) Invalid key_name provided", [("Invalid key_name provided",)]),
    ("(HTTP 400) No nw_info cache associated with instance",
     [("http 400", "nw_info cache associated with instance")]),
    ("(HTTP 400) Unable to associate floating ip",
     [("http 400", "unable to associate floating ip")]),
    ("SSH Failed: Permission denied (publickey)", [("permission denied (publickey)", "ssh")]),
    ("SSH Timeout", [("ssh timeout",)]),
    ("Wait for Active Status Timeout", [("timed out", "wait_for_active_status ")]),
    ("Ping Timeout", [("ping timeout",)]),
    ("Delete Server Timeout", [("delete server timeout",)]),
    ("Floating IP Attach Failed", [("floating ip attach failed",)]),
    ("(HTTP 500)", [("http 500",)]),
    ("(HTTP 400) Bad Request", [("bad request",), ("400",)]),
    ("Max retries exceeded with url", [("Max retries exceeded with url",)]),
]

# Fixed values. (fragment of the lower-cased error type, severity); first match wins and
# every other non-empty type is hard.
SEVERITIES = [
    ("http 429", "soft"),
    ("rate-limited", "soft"),
    ("rate limit", "soft"),
    ("http 413", "soft"),
    ("quota exceeded", "soft"),
    ("ssh timeout", "hard"),
    ("floating ip attach failed", "hard"),
    ("http 500", "hard"),
    ("http 404", "hard"),
    ("http 400", "hard"),
    ("ping timeout", "hard"),
    ("delete server timeout", "soft"),
    ("address quota exceeded", "soft"),
]

# Error types the reports leave out as noise.
NOT_FOUND = "(HTTP 404) Resource Not Found"
RATE_LIMITED = "(HTTP 429) Rate Limited"
OPERAND_NOISE = "unsupported operand type(s) for"


def classify_error(text: Column, mode: str = "faithful", lowered: Column | None = None) -> Column:
    """Error type of a raw error text; text that matches nothing is its own type."""
    if mode not in ("faithful", "intended"):
        raise ValueError(f"unknown mode {mode!r}")
    lowered = F.lower(text) if lowered is None else lowered

    def matches(alternatives) -> Column:
        groups = []
        for fragments in alternatives:
            if mode == "intended":
                fragments = [f.lower() for f in fragments]
            groups.append(reduce(lambda a, b: a & b, [lowered.contains(f) for f in fragments]))
        return reduce(lambda a, b: a | b, groups)

    chain = F.when(text == "", F.lit(""))
    for error_type, alternatives in ERROR_TYPES:
        chain = chain.when(matches(alternatives), F.lit(error_type))
    return chain.otherwise(text)


def error_type_of(text: str) -> str:
    """The faithful rules for one Python string, for constants and tests."""
    lowered = text.lower()
    for error_type, alternatives in ERROR_TYPES if text else []:
        if any(all(f in lowered for f in fragments) for fragments in alternatives):
            return error_type
    return text


def with_error_type(df: DataFrame, text: str = "error_text", mode: str = "faithful") -> DataFrame:
    """Add ``error_type``, as done once when actions are stored; reports read the stored type.

    The lower-cased text is a projection of its own, so it is computed once per row.
    """
    lowered = df.withColumn("_lowered", F.lower(text))
    return lowered.withColumn(
        "error_type", classify_error(F.col(text), mode, F.col("_lowered"))).drop("_lowered")


def error_severity(error_type: Column, lowered: Column | None = None) -> Column:
    """``none`` for all spellings of "no error", else ``soft`` or ``hard``."""
    lowered = F.lower(error_type) if lowered is None else lowered
    chain = F.when(is_success(error_type), F.lit("none"))
    for fragment, severity in SEVERITIES:
        chain = chain.when(lowered.contains(fragment), F.lit(severity))
    return chain.otherwise(F.lit("hard"))


def with_severity(df: DataFrame) -> DataFrame:
    """Add ``severity``; the lower-cased type and the cascade are computed once per row."""
    lowered = df.withColumn("_lowered", F.lower("error_type"))
    return lowered.withColumn(
        "severity", error_severity(F.col("error_type"), F.col("_lowered"))).drop("_lowered")


def normalize_no_error(error_type: Column) -> Column:
    """Map the three spellings of "no error" (``''``, ``'None'``, NULL) to NULL."""
    return F.nullif(F.nullif(error_type, F.lit("")), F.lit("None"))


def is_success(error_type: Column) -> Column:
    return normalize_no_error(error_type).isNull()


def is_error(error_type: Column) -> Column:
    """``error_type <> ''``, which also drops NULL."""
    return error_type != ""


def is_legacy_error(error_type: Column, mode: str = "faithful") -> Column:
    """Rows of the older layout, where "no error" was written as ``'None'``: "faithful" leaves
    out that spelling and NULL, "intended" the empty type as well."""
    if mode == "intended":
        return ~is_success(error_type)
    return error_type != "None"


def is_reportable(error_type: Column, excluded=(NOT_FOUND, RATE_LIMITED)) -> Column:
    """Errors kept by the report families: not empty, not excluded, not operand noise."""
    return ~error_type.isin("", *excluded) & ~error_type.contains(OPERAND_NOISE)
