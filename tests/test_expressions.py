"""Expressions against hand-made rows, one per branch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import errors, numbers, text, times
from faultline.sources.derived import BRANCH_TEXTS


def values(spark, rows, column):
    """Evaluate an expression of column ``v`` over Python values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)],
                               f"i int, v {'string' if isinstance(rows[0], str) else 'double'}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


INTENDED = {
    "server s1 status is error: fault is None": "Boot Instance Failed: Instance Status is ERROR",
    "EXCEPTION: Instance could not be found (HTTP 404) FUNC: server_delete":
        "Instance could not be found (HTTP 404) - FUNC: server_delete",
    "call failed (HTTP 429)": "(HTTP 429) Rate Limited",
    "This request was rate-limited.": "(HTTP 429) Rate Limited",
    "over the Rate Limit": "(HTTP 429) Rate Limited",
    "Image not found (HTTP 404)": "(HTTP 404) Resource Not Found",
    "AddressLimitExceeded: Address quota exceeded": "Address Quota Exceeded",
    "Quota exceeded for instances": "Instance Quota Exceeded",
    "Invalid key_name provided": "(HTTP 400) Invalid key_name provided",
    "(HTTP 400) no nw_info cache associated with instance":
        "(HTTP 400) No nw_info cache associated with instance",
    "(HTTP 400) unable to associate floating ip": "(HTTP 400) Unable to associate floating ip",
    "Permission denied (publickey). During SSH from a to b":
        "SSH Failed: Permission denied (publickey)",
    "SSH Timeout Error": "SSH Timeout",
    "timed out in wait_for_active_status after 240": "Wait for Active Status Timeout",
    "PING TIMEOUT for IP 15.0.1.1 after trying for 180 seconds": "Ping Timeout",
    "Delete Server Timeout Exception": "Delete Server Timeout",
    "Floating IP attach failed": "Floating IP Attach Failed",
    "server erred (HTTP 500)": "(HTTP 500)",
    "Bad Request": "(HTTP 400) Bad Request",
    "waited 2400 seconds": "(HTTP 400) Bad Request",
    "Max retries exceeded with url": "Max retries exceeded with url",
    "Some Other Text": "Some Other Text",
    "": "",
}
# The literals that carry capitals never match, so these texts stay as they are.
UNREACHABLE = {
    "server s1 status is error: fault is None", "AddressLimitExceeded: Address quota exceeded",
    "EXCEPTION: Instance could not be found (HTTP 404) FUNC: server_delete",
    "Quota exceeded for instances", "Invalid key_name provided", "Max retries exceeded with url",
}


@pytest.mark.parametrize("mode", ["faithful", "intended"])
def test_classify_every_branch(spark, mode):
    texts = list(INTENDED)
    got = values(spark, texts, errors.classify_error(F.col("v"), mode))
    want = [t if mode == "faithful" and t in UNREACHABLE else INTENDED[t] for t in texts]
    assert got == want


def test_constant_rules_equal_the_column(spark):
    got = values(spark, BRANCH_TEXTS, errors.classify_error(F.col("v")))
    assert got == [errors.error_type_of(t) for t in BRANCH_TEXTS]


def test_not_found_text_with_could_not_be_found_is_its_own_type(spark):
    text_ = "The resource could not be found. (HTTP 404)"
    assert values(spark, [text_], errors.classify_error(F.col("v"))) == [text_]


def test_severity(spark):
    cases = {
        "(HTTP 429) Rate Limited": "soft", "rate-limited": "soft", "a rate limit": "soft",
        "Quota (HTTP 413)": "soft", "Address Quota Exceeded": "soft", "SSH Timeout": "hard",
        "Floating IP Attach Failed": "hard", "(HTTP 500)": "hard",
        "(HTTP 404) Resource Not Found": "hard", "(HTTP 400) Bad Request": "hard",
        "Ping Timeout": "hard", "Delete Server Timeout": "soft", "anything else": "hard",
        "": "none",
    }
    assert values(spark, list(cases), errors.error_severity(F.col("v"))) == list(cases.values())
    assert spark.range(1).select(
        errors.error_severity(F.lit(None).cast("string"))).first()[0] == "none"


def test_no_error_spellings(spark):
    df = spark.createDataFrame([("",), ("None",), (None,), ("real",)], "e string")
    assert df.filter(errors.is_error(F.col("e"))).count() == 2
    for mode, kept in [("faithful", ["", "real"]), ("intended", ["real"])]:
        assert [r.e for r in df.filter(errors.is_legacy_error(F.col("e"), mode)).collect()] == kept
    kept = df.select(errors.normalize_no_error(F.col("e"))).collect()
    assert [r[0] for r in kept] == [None, None, None, "real"]


def test_reportable_drops_noise_and_null(spark):
    rows = ["", errors.NOT_FOUND, errors.RATE_LIMITED, "x unsupported operand type(s) for y",
            "(HTTP 500)"]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "e string")
    assert [r.e for r in df.filter(errors.is_reportable(F.col("e"))).collect()] == ["(HTTP 500)"]
    only_404 = df.filter(errors.is_reportable(F.col("e"), (errors.NOT_FOUND,))).collect()
    assert {r.e for r in only_404} == {errors.RATE_LIMITED, "(HTTP 500)"}


def test_bad_ip(spark):
    rows = ["PING TIMEOUT for IP 15.0.1.2 after trying for 180 seconds", "no marker",
            "after trying for x for IP 15.0.0.1"]
    assert values(spark, rows, text.extract_bad_ip(F.col("v"))) == ["15.0.1.2 ", "", ""]
    assert values(spark, rows, text.extract_bad_ip(F.col("v"), "intended")) == [
        "15.0.1.2", None, None]


def test_int_percent_keeps_29(spark):
    rows = [0.29, 0.28999, 0.2899, 0.57, 1.0, 0.0]
    assert values(spark, rows, numbers.int_percent(F.col("v"))) == [29, 29, 28, 57, 100, 0]


def test_same_text_ignores_case_and_trailing_blanks(spark):
    assert values(spark, ["Ping Timeout", "PING TIMEOUT  ", "Ping"],
                  text.same_text(F.col("v"), "ping timeout")) == [True, True, False]


def _label(value, precision, si):
    """Plain Python rendering, the definition of the labels."""
    units = ([(10**15, "P"), (10**12, "T"), (10**9, "G"), (10**6, "M"), (10**3, "k"), (1, " ")]
             if si else [(2**50, "Pi"), (2**40, "Ti"), (2**30, "Gi"), (2**20, "Mi"),
                         (2**10, "Ki"), (1, "  ")])
    factor, suffix = next((u for u in units if value >= u[0]), units[-1])
    if precision == 0:
        return f"{value // factor:3d} {suffix}"
    return f"{value / factor:{4 + precision}.{precision}f} {suffix}"


@pytest.mark.parametrize("precision,si", [(0, False), (0, True), (1, False)])
def test_humanize(spark, precision, si):
    rng = random.Random(3)
    sizes = [0, 1, 512, 1023, 1024, 1536, 2**20, 2**30 + 1, 2**41, 2**52,
             *[rng.randrange(2**rng.randrange(1, 52)) for _ in range(200)]]
    df = spark.createDataFrame([(s,) for s in sizes], "v long")
    got = df.select("v", numbers.humanize_units(F.col("v"), precision, si).alias("l")).collect()
    assert [r.l for r in got] == [_label(r.v, precision, si) for r in got]


def test_twelve_hour_bucket_folds_midnight_and_noon(spark):
    rows = [dt.datetime(2001, 6, 1, 0, 5), dt.datetime(2001, 6, 1, 12, 5)]
    df = spark.createDataFrame([(r,) for r in rows], "t timestamp_ntz")
    labels = {r[0] for r in df.select(times.HOUR12_US.label(F.col("t"))).collect()}
    assert labels == {"06-01-2001-12"}


def test_lookback_is_strict_and_ends_at_the_reference_time(spark):
    rows = [dt.datetime(2001, 6, 24), dt.datetime(2001, 6, 24, 0, 0, 1), dt.datetime(2030, 1, 1)]
    df = spark.createDataFrame([(r,) for r in rows], "t timestamp_ntz")
    kept = df.filter(times.since(F.col("t"), "2001-07-01 00:00:00", 7)).count()
    assert kept == 1


def test_time_parts_ignore_the_session_zone(spark):
    """Around a change to daylight saving time an hour is neither lost nor moved."""
    rows = [(dt.datetime(2001, 4, 1, 1, 30), dt.datetime(2001, 4, 1, 3, 30)),
            (dt.datetime(2001, 4, 1, 2, 30), dt.datetime(2001, 4, 1, 2, 30, 0, 250000))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(times.elapsed_seconds(F.col("a"), F.col("b")),
                        times.HOUR_ISO.start(F.col("a")), times.HOUR12_US.label(F.col("a"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in got] == [
        (7200.0, dt.datetime(2001, 4, 1, 1), "04-01-2001-01"),
        (0.25, dt.datetime(2001, 4, 1, 2), "04-01-2001-02")]


def test_elapsed_keeps_fractions(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 1, 0, 0, 1, 250000))],
        "a timestamp_ntz, b timestamp_ntz")
    assert df.select(times.elapsed_seconds(F.col("a"), F.col("b"))).first()[0] == 1.25


def test_server_status(spark):
    rows = [("Building", "scheduling", "scheduling"), ("building", None, "BUILD"),
            ("building", "Networking", "networking"), ("x", "spawning", "spawning"),
            ("ACTIVE", None, "active"), ("error", "deleting", "error"), ("x", "y", "unknown")]
    df = spark.createDataFrame(rows, "vm string, task string, want string")
    got = df.select(text.server_status(F.col("vm"), F.col("task"), F.lit("BUILD")), "want")
    assert all(a == b for a, b in got.collect())
