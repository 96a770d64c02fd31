"""Explicit schemas of the tables; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType(),
)


def _table(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


TEST_PASSES = _table(
    ("test_pass_id", _L, False),
    ("test_pass_name", _S, False),
    ("environ_name", _S, False),
    ("zone", _S, False),
    ("region", _S, False),
    ("execution_hostname", _S, False),
    ("cloud_account_username", _S, False),
    ("time_started", _TS, False),
    ("time_end", _TS, True),
    ("time_total", _D, True),
)

TEST_RESULTS = _table(
    ("test_id", _L, False),
    ("test_pass_id", _L, True),
    ("test_name", _S, False),
    ("concurrency_count", _I, True),
    ("time_started", _TS, False),
    ("time_end", _TS, False),
    ("time_total", _D, False),
    ("time_to_active", _D, False),
    ("time_to_ping", _D, False),
    ("time_to_ssh", _D, False),
    ("is_active", _I, False),
    ("is_pingable", _I, False),
    ("is_sshable", _I, False),
    ("is_successful", _I, False),
    ("rps", _D, True),
    ("hard_errors_exist", _I, False),
    ("hard_error_count", _I, True),
    ("soft_error_count", _I, True),
)

TEST_ACTIONS = _table(
    ("test_id", _L, True),
    ("function_name", _S, False),
    ("time_started", _TS, False),
    ("time_end", _TS, False),
    ("time_total", _D, False),
    ("error_type", _S, True),
    ("error_text", _S, True),
)

BUILD_DETAILS = _table(
    ("id", _S, False),
    ("duration", _L, True),
    ("end_date", _TS, True),
    ("full_name", _S, False),
    ("name", _S, False),
    ("result", _S, True),
    ("start_date", _TS, False),
    ("user_id", _S, True),
    ("user_name", _S, True),
    ("node_url", _S, True),
)

BUILD_NODE = _table(
    ("url", _S, False),
    ("description", _S, True),
    ("display_name", _S, False),
    ("label", _S, True),
    ("master_address", _S, False),
    ("master_host_name", _S, False),
    ("name", _S, False),
)

BUILD_PARAMS = _table(
    ("id", _S, False),
    ("name", _S, False),
    ("value", _S, True),
    ("build_details_id", _S, False),
)

ACCOUNT_EXTERNAL_IDS = _table(
    ("account_id", _L, False), ("external_id", _S, False), ("email_address", _S, True),
)

ACCOUNTS = _table(
    ("account_id", _L, False), ("full_name", _S, True), ("inactive", _S, False),
)

TABLES = {
    "test_passes": TEST_PASSES,
    "test_results": TEST_RESULTS,
    "test_actions": TEST_ACTIONS,
    "build_details": BUILD_DETAILS,
    "build_node": BUILD_NODE,
    "build_params": BUILD_PARAMS,
    "account_external_ids": ACCOUNT_EXTERNAL_IDS,
    "accounts": ACCOUNTS,
}

# Foreign keys: child table, child key, parent table, parent key.
FOREIGN_KEYS = [
    ("test_results", "test_pass_id", "test_passes", "test_pass_id"),
    ("test_actions", "test_id", "test_results", "test_id"),
    ("build_details", "node_url", "build_node", "url"),
    ("build_params", "build_details_id", "build_details", "id"),
]
