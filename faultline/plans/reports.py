"""Parameters of the standing reports.

Environments and zones are those of the benchmark tables; a site replaces them by its own.
"""

from __future__ import annotations

from faultline.functions.errors import NOT_FOUND, RATE_LIMITED
from faultline.functions.times import DAY_ISO, DAY_US, HOUR12_US, HOUR_ISO, HOUR_US

ENVIRONMENTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
ZONES = {
    "AMERICA": ["NATION_1", "NATION_6", "NATION_11"],
    "ASIA": ["NATION_2", "NATION_7", "NATION_12"],
    "EUROPE": ["NATION_3", "NATION_8", "NATION_13", "NATION_18"],
    "MIDDLE EAST": ["NATION_4", "NATION_9", "NATION_14"],
}

_ENV_ZONE = ("environ_name", "zone")


def _rate(bucket, days, keys=_ENV_ZONE, environ=None, loose=(), ascending=False) -> dict:
    return {"bucket": bucket, "lookback": (days, "day"), "keys": keys, "environ": environ,
            "loose": loose, "ascending": ascending}


_LOOSE_ENV = {"keys": ("zone",), "loose": ("environ_name",)}

# Failure-rate reports: bucket format, days back, grouping, environment, order.
FAILURE_RATES = {
    "a1a_day_zone_5d_env": _rate(DAY_US, 5, environ="AMERICA"),
    "a1b_hour_zone_7d_env": _rate(HOUR_ISO, 7, environ="ASIA"),
    "a1c_day_zone_90d": _rate(DAY_ISO, 90),
    "a1d_hour_zone_30d": _rate(HOUR_ISO, 30),
    "a1e_day_zone_5d_env": _rate(DAY_US, 5, environ="EUROPE"),
    "a1f_hour_zone_30d": _rate(HOUR_US, 30),
    "a1g_day_zone_90d": _rate(DAY_ISO, 90, environ="AFRICA"),
    "a1h_day_env_90d": _rate(DAY_US, 90, keys=("environ_name",)),
    "a1i_hour_zone_7d_env": _rate(HOUR_ISO, 7, environ="EUROPE"),
    "a1j_day_zone_90d": _rate(DAY_ISO, 90, environ="ASIA"),
    "a1k_hour_zone_30d": _rate(HOUR_ISO, 30, environ="ASIA"),
    "a1l_hour_zone_7d_env": _rate(HOUR_ISO, 7, environ="MIDDLE EAST"),
    "a1m_day_zone_90d": _rate(DAY_ISO, 90, environ="MIDDLE EAST"),
    "a1n_hour_zone_30d": _rate(HOUR_ISO, 30, environ="MIDDLE EAST"),
    "a1o_day_zone_60d_asc": _rate(DAY_US, 60, ascending=True),
    "a1p_day_zone_60d_env_loose": _rate(DAY_US, 60, environ="ASIA", ascending=True, **_LOOSE_ENV),
    "a1q_hour_zone_3d_loose": _rate(HOUR_US, 3, **_LOOSE_ENV),
    "a1q_hour_zone_14d_loose_asc": _rate(HOUR_US, 14, ascending=True, **_LOOSE_ENV),
    "a1r_hour_zone_14d_loose_asc": _rate(HOUR_US, 14, environ="AMERICA", ascending=True,
                                         **_LOOSE_ENV),
    "a1s_day_env_90d": _rate(DAY_ISO, 90, keys=("environ_name",)),
    "a1s_day_env_360d": _rate(DAY_ISO, 360, keys=("environ_name",)),
    "a1t_hour12_zone_7d": _rate(HOUR12_US, 7),
}

# Zone and concurrency latency reports: one environment each, 90 days.
LATENCY_ENVIRONMENTS = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Error-type counts per environment: environment, days back, types left out.
ERROR_TYPE_COUNTS = {
    "a4a_error_types_america_7d": ("AMERICA", 7, (NOT_FOUND,)),
    "a4a_error_types_asia_90d": ("ASIA", 90, (NOT_FOUND, RATE_LIMITED)),
    "a4a_error_types_america_90d": ("AMERICA", 90, (NOT_FOUND, RATE_LIMITED)),
    "a4a_error_types_europe_90d": ("EUROPE", 90, (NOT_FOUND, RATE_LIMITED)),
    "a4a_error_types_middle_east_90d": ("MIDDLE EAST", 90, (NOT_FOUND, RATE_LIMITED)),
    "a4a_error_types_asia_7d": ("ASIA", 7, (NOT_FOUND,)),
}

# Errors by hour: environment, days back, smallest concurrency, per zone.
ERRORS_BY_HOUR = {
    "a6a_errors_by_hour_asia_7d": ("ASIA", 7, 2, False),
    "a6a_errors_by_hour_america_14d": ("AMERICA", 14, 2, False),
    "a6a_errors_by_hour_middle_east_7d": ("MIDDLE EAST", 7, 1, False),
    "a6b_errors_by_hour_zone_europe_7d": ("EUROPE", 7, 1, True),
}
