"""Text extraction and cascades over probe and server snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers around the address in a ping failure, address patterns (the first
# dot is unescaped on purpose), identity URL prefixes and the identity line.
IP_MARKER = "for IP "
AFTER_MARKER = "after trying for"
LOCAL_IP_PATTERN = r"10.\d{1,3}\.\d{1,3}\.\d{1,3}"
PUBLIC_IP_PATTERN = r"15.\d{1,3}\.\d{1,3}\.\d{1,3}"
LOGIN_PREFIX = "https://login.launchpad.net/"
PROFILE_PREFIX = "https://launchpad.net/"
TRUSTED_LINE = r"trustedOpenID = ^https://(login\\.)?launchpad\\.net/(%s|\\%s|%s)$"


def extract_bad_ip(text: Column, mode: str = "faithful") -> Column:
    """Address between the two markers.

    "faithful" keeps the blank before the second marker and yields ``''`` when the length
    would be negative; "intended" returns the bare address or NULL.
    """
    if mode == "intended":
        return F.nullif(F.regexp_extract(text, r"for IP (\S+) after trying for", 1), F.lit(""))
    start = F.instr(text, IP_MARKER) + len(IP_MARKER)
    length = F.instr(text, AFTER_MARKER) - start
    return F.substring(text, start, F.greatest(length, F.lit(0)))


def first_ip(addresses: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(addresses, pattern, 0), F.lit(""))


def local_ip(addresses: Column) -> Column:
    return first_ip(addresses, LOCAL_IP_PATTERN)


def public_ip(addresses: Column) -> Column:
    """Used for both the public and the floating address."""
    return first_ip(addresses, PUBLIC_IP_PATTERN)


def server_status(vm_state: Column, task_state: Column, previous: Column) -> Column:
    """Status from the (vm_state, task_state) pair; missing states read as ``none``."""
    vm = F.lower(F.coalesce(vm_state, F.lit("none")))
    task = F.lower(F.coalesce(task_state, F.lit("none")))
    return (
        F.when(task == "scheduling", F.lit("scheduling"))
        .when((vm == "building") & (task == "none"), previous)
        .when(task.isin("networking", "block_device_mapping", "spawning"), task)
        .when((vm == "active") & (task == "none"), F.lit("active"))
        .when(vm == "error", F.lit("error"))
        .otherwise(F.lit("unknown"))
    )


def legacy_server_status(status: Column, previous: Column) -> Column:
    """Status from the older single status string; other strings leave it unchanged."""
    named = ["BUILD(scheduling)", "BUILD(networking)", "BUILD(block_device_mapping)",
             "BUILD(spawning)", "ACTIVE"]
    return (
        F.when(status.isin(*named), status)
        .when(status.startswith("BUILD"), F.lit("BUILD"))
        .when(status == "ACTIVE(rebooting_hard)", F.lit("REBOOT_HARD"))
        .when(status.isin("ERROR", "ERROR(networking)"), F.lit("ERROR(networking)"))
        .otherwise(previous)
    )


def command_outcome(return_code: Column, output: Column, expected: Column) -> Column:
    """Outcome of a ping, ssh or remote command."""
    return (
        F.when((return_code == 0) & F.contains(output, expected), F.lit("success"))
        .when(return_code == 1, F.lit("host not found"))
        .when(return_code == 2, F.lit("timed out"))
        .when(return_code == 255, F.lit("auth or ssh error"))
        .otherwise(F.lit("other"))
    )


def is_publickey_failure(return_code: Column, errors: Column) -> Column:
    return (return_code == 255) & errors.contains("Permission denied (publickey)")


def trusted_line(login_id: Column, profile_id: Column, email: Column) -> Column:
    """Trust line of one identity; missing parts read ``None``."""
    none = F.lit("None")
    user = F.replace(F.coalesce(login_id, none), F.lit(LOGIN_PREFIX), F.lit(""))
    code = F.replace(F.coalesce(profile_id, none), F.lit(PROFILE_PREFIX), F.lit(""))
    return F.format_string(TRUSTED_LINE, code, user, F.coalesce(email, none))


def name_has_prefix(name: Column, pattern: str) -> Column:
    """Start-anchored match, whatever the pattern holds."""
    return name.rlike(f"^(?:{pattern})")


def same_text(value: Column, other: str) -> Column:
    """Equality that ignores case and trailing blanks, as the original columns compared."""
    return F.collate(value, "UTF8_LCASE_RTRIM") == F.lit(other)
