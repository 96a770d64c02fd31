"""The library's tables derived from the benchmark tables (see FIXTURES.md).

Everything is a lazy view: parquet scans plus expressions. A site with its own test-run log
reads that log instead (``readers.py``); the operators only see DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.errors import error_type_of

# Fixed values of the derivation, repeated in the SQL twins.
AS_OF = "2001-07-03 08:01:50"
SNAPSHOT_SPLIT = "2024-01-16 00:00:00"


class Tables:
    """Lazy tables over one directory of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- test runs ---------------------------------------------------------------------

    def _orders(self) -> DataFrame:
        """Orders with their pass id; the pass is one week of one nation."""
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        joined = self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.withColumn("wk", week_start(F.col("o_orderdate"))).withColumn(
            "test_pass_id", pass_id(F.col("wk"), F.col("c_nationkey"))
        )

    def test_passes(self) -> DataFrame:
        per_pass = (
            self._orders()
            .groupBy("test_pass_id", "wk", "c_nationkey")
            .agg(F.min(order_start()).alias("first_test"),
                 F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"))
        )
        named = per_pass.join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return named.select(
            "test_pass_id",
            F.lit("boot-scaling").alias("test_pass_name"),
            F.col("r_name").alias("environ_name"),
            F.col("n_name").alias("zone"),
            F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("region"),
            F.concat(F.lit("host-"), (F.col("n_nationkey") % 4).cast("string"))
            .alias("execution_hostname"),
            F.concat(F.lit("acct-"), (F.col("n_nationkey") % 7).cast("string"))
            .alias("cloud_account_username"),
            F.col("first_test").alias("time_started"),
            (F.col("last_order") + F.expr("interval '1' day")).alias("time_end"),
            (F.col("n") * 60).cast("double").alias("time_total"),
        )

    def test_results(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        started = order_start()
        total = F.floor(F.col("o_totalprice") / 1000)
        level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        base = self._orders().select(
            key.alias("test_id"),
            # Some tests are stored before their pass is known.
            F.when(key % 97 != 13, F.col("test_pass_id")).alias("test_pass_id"),
            F.lit("test_boot").alias("test_name"),
            F.pow(F.lit(2), level).cast("int").alias("concurrency_count"),
            started.alias("time_started"),
            F.timestamp_add("SECOND", total.cast("int"), started).alias("time_end"),
            total.cast("double").alias("time_total"),
            zero_when(key % 10 == 0, key % 97).alias("time_to_active"),
            zero_when(key % 7 == 0, key % 113).alias("time_to_ping"),
            zero_when(status == "F", key % 211).alias("time_to_ssh"),
            (key % 50).cast("double").alias("rps"),
            (status == "F").cast("int").alias("hard_errors_exist"),
            F.when(status == "F", 1 + key % 3).otherwise(0).cast("int").alias("hard_error_count"),
            F.when(status == "P", 1 + key % 2).otherwise(0).cast("int").alias("soft_error_count"),
        )
        return base.withColumns({
            "is_active": (F.col("time_to_active") > 0).cast("int"),
            "is_pingable": (F.col("time_to_ping") > 0).cast("int"),
            "is_sshable": (F.col("time_to_ssh") > 0).cast("int"),
            "is_successful": F.lit(0),
        })

    def test_actions(self) -> DataFrame:
        return action_log(self.raw("lineitem"))

    def spelled_actions(self) -> DataFrame:
        """The log with all three spellings of "no error"."""
        test = F.col("test_id") % 3
        spelled = F.when(test == 0, F.lit("")).when(test == 1, F.lit("None"))
        return self.test_actions().withColumn("error_type", F.when(
            F.col("error_type") == "", spelled).otherwise(F.col("error_type")))

    def error_texts(self) -> DataFrame:
        """One text per action covering every classification branch."""
        variant = (F.col("l_orderkey") + F.col("l_linenumber")) % len(BRANCH_TEXTS)
        texts = F.array(*[F.lit(t) for t in BRANCH_TEXTS])
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("test_id"),
            F.col("l_linenumber").alias("step"),
            F.get(texts, variant.cast("int")).alias("error_text"),
        )

    def scrub_texts(self) -> DataFrame:
        """One text per action; each scrub rule meets some of them."""
        variant = (F.col("l_orderkey") + F.col("l_linenumber")) % len(SCRUB_TEXTS)
        texts = F.array(*[F.lit(t) for t in SCRUB_TEXTS])
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("test_id"),
            F.col("l_linenumber").alias("step"),
            F.get(texts, variant.cast("int")).alias("error_text"),
            F.lit("").alias("error_type"),
        )

    def milestones_log(self) -> DataFrame:
        """Pass updates: one closing record per pass, for the upsert."""
        passes = self.test_passes()
        return passes.filter(F.col("test_pass_id") % 3 == 0).select(
            "test_pass_id",
            (F.col("time_started") + F.expr("interval '7' day")).alias("time_end"),
            F.lit(604800.0).alias("time_total"),
            F.lit(1).alias("version"),
        )

    # -- builds ------------------------------------------------------------------------

    def build_details(self) -> DataFrame:
        user = F.col("user_id")
        job = F.concat(F.lit("job-"), (user % 20).cast("string"))
        result = (
            F.when(F.col("event_type") == "error", "FAILURE")
            .when(F.col("event_type") == "view", "UNSTABLE")
            .otherwise("SUCCESS")
        )
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("id"),
            F.floor(F.col("value") * 1000).cast("bigint").alias("duration"),
            F.col("ts").alias("end_date"),
            F.concat(F.lit("folder/"), job).alias("full_name"),
            job.alias("name"),
            result.alias("result"),
            F.col("ts").alias("start_date"),
            user.cast("string").alias("user_id"),
            F.concat(F.lit("user-"), user.cast("string")).alias("user_name"),
            F.concat(F.lit("node-"), (user % 5).cast("string")).alias("node_url"),
        )

    def spelled_builds(self) -> DataFrame:
        """Builds of which some write their failure the other way."""
        other = (F.col("result") == "FAILURE") & (F.col("id").cast("bigint") % 2 == 0)
        return self.build_details().withColumn(
            "result", F.when(other, "FAILED").otherwise(F.col("result")))

    def build_node(self) -> DataFrame:
        url = F.col("node_url")
        return self.build_details().select("node_url").distinct().select(
            url.alias("url"),
            F.lit("build node").alias("description"),
            F.upper(url).alias("display_name"),
            F.lit("linux").alias("label"),
            F.lit("15.0.0.1").alias("master_address"),
            F.lit("master").alias("master_host_name"),
            url.alias("name"),
        )

    def build_params(self) -> DataFrame:
        return self.raw("events").select(
            F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("id"),
            F.lit("k").alias("name"),
            F.get_json_object("props", "$.k").alias("value"),
            F.col("event_id").cast("string").alias("build_details_id"),
        )

    # -- identities --------------------------------------------------------------------

    def account_external_ids(self) -> DataFrame:
        """Up to three identities per customer, one scan."""
        key, name = F.col("c_custkey"), F.col("c_name")
        ids = F.array_compact(F.array(
            F.concat(F.lit("https://login.launchpad.net/+id/"), key.cast("string")),
            F.when(key % 3 != 0, F.concat(F.lit("https://launchpad.net/~"), name)),
            F.when(key % 5 != 0, F.concat(F.lit("username:"), name)),
        ))
        return self.raw("customer").select(
            key.alias("account_id"),
            F.explode(ids).alias("external_id"),
            F.concat(name, F.lit("@example.org")).alias("email_address"),
        )

    def repeated_external_ids(self) -> DataFrame:
        """Identities of which every fourth account's are stored twice."""
        ids = self.account_external_ids()
        return ids.unionAll(ids.filter(F.col("account_id") % 4 == 0))

    def accounts(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("full_name"),
            F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("inactive"),
        )

    # -- snapshots ---------------------------------------------------------------------

    def floating_ips(self) -> DataFrame:
        """Last known attachment of each address in each of two snapshots."""
        latest = (
            self._snapshots()
            .groupBy("snapshot", "user_id")
            .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
        )
        user = F.col("user_id")
        return latest.select(
            "snapshot",
            user.alias("id"),
            F.concat(F.lit("15.0.0."), user.cast("string")).alias("ip"),
            F.when(~F.col("event_type").isin("view", "click"), user).alias("instance_id"),
        )

    def usage(self) -> DataFrame:
        """A counter per user and snapshot, for the before/after comparison."""
        return self._snapshots().groupBy(
            "snapshot", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name")
        ).agg(F.count("*").alias("value"))

    def _snapshots(self) -> DataFrame:
        first = F.col("ts") < F.lit(SNAPSHOT_SPLIT).cast("timestamp_ntz")
        return self.raw("events").withColumn("snapshot", F.when(first, 1).otherwise(2))

    def servers(self) -> DataFrame:
        key = F.col("c_custkey")
        vm = F.get(F.array(*map(F.lit, ["Building", "active", "error", "active"])),
                   (key % 4).cast("int"))
        task = F.get(
            F.array(F.lit("scheduling"), F.lit(None), F.lit("networking"), F.lit("spawning"),
                    F.lit("block_device_mapping"), F.lit("deleting"), F.lit("None")),
            (key % 7).cast("int"))
        legacy = F.get(F.array(*map(F.lit, LEGACY_STATES)), (key % len(LEGACY_STATES)).cast("int"))
        text = key.cast("string")
        address = F.concat(
            F.lit("net=10.0."), (key % 200).cast("string"), F.lit("."),
            (key % 250).cast("string"), F.lit(", 15.0."), (key % 30).cast("string"), F.lit("."),
            (key % 240).cast("string"))
        return self.raw("customer").select(
            F.concat(F.lit("srv-"), text).alias("id"),
            F.col("c_name").alias("name"),
            F.when(key % 11 != 0, address).alias("addresses"),
            vm.alias("vm_state"),
            task.alias("task_state"),
            legacy.alias("legacy_status"),
        )

    def address_events(self) -> DataFrame:
        return attachment_events(self.raw("events"))

    # -- disk samples, probes, definitions --------------------------------------------

    def io_samples(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_returnflag").alias("device"),
            F.expr("512L * shiftleft(1L, l_linenumber - 1)").alias("blocksize"),
            F.col("l_suppkey").alias("thread"),
            F.col("l_quantity").alias("iops"),
        )

    def probe_log(self) -> DataFrame:
        code = F.get(F.array(*map(F.lit, [0, 1, 2, 255, 13])),
                     (F.col("l_linenumber") % 5).cast("int"))
        host = F.concat(F.lit("node-"), F.col("l_suppkey").cast("string"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("test_id"),
            F.col("l_linenumber").alias("step"),
            code.alias("return_code"),
            F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(
                F.concat(F.lit("login on "), host)).alias("output"),
            host.alias("expected"),
            F.when(F.col("l_partkey") % 2 == 0, F.lit("Permission denied (publickey)."))
            .otherwise(F.lit("connection reset")).alias("errors"),
        )

    def definition_lines(self) -> DataFrame:
        """Whitespace-separated benchmark definitions, one line per part."""
        key, size = F.col("p_partkey"), F.col("p_size").cast("string")
        hosts = F.concat(F.lit("db"), (key % 9).cast("string"), F.lit("@db"),
                         (key % 9 + 1).cast("string"))
        name = F.concat(F.lit("run"), key.cast("string"))
        value = (
            F.when(key % 6 == 0, F.concat(F.lit("# "), F.col("p_name")))
            .when(key % 6 == 1, F.lit(""))
            .when(key % 6 == 2, F.concat_ws(" ", F.lit("sysbench rw"), size, F.lit("4"),
                                            F.lit("1@8"), F.lit("60"), hosts, name))
            .when(key % 6 == 3, F.concat_ws("  ", F.lit("sysbench in-memory"), size,
                                            F.lit("3600"), F.lit("db1"), name))
            .when(key % 6 == 4, F.concat_ws(" ", F.lit("tpcc-mysql"), size, F.lit("2@16"),
                                            F.lit("120"), hosts, name))
            .otherwise(F.concat_ws(" ", F.lit("unknown"), size))
        )
        return self.raw("part").select(value.alias("value"))


# Error texts of the action log by the last digit of the supplier.
LOG_TEXTS = [
    "Rate limit: request was rate-limited (HTTP 429)",
    "PING TIMEOUT for IP %s after trying for 180 seconds",
    "SSH Timeout Error: FAILED ssh to IP %s after trying for 240 seconds.",
    "The resource could not be found. (HTTP 404)",
    "Not Found (HTTP 404)",
    "The server has either erred (HTTP 500)",
    "Quota exceeded for instances (HTTP 413)",
    "ssh: Permission denied (publickey)",
    "unsupported operand type(s) for -",
    "Delete Server Timeout Exception",
]

LEGACY_STATES = [
    "BUILD(scheduling)", "BUILD(networking)", "BUILD(block_device_mapping)", "BUILD(spawning)",
    "BUILD(other)", "ACTIVE(rebooting_hard)", "ACTIVE", "ERROR", "ERROR(networking)", "DELETED",
]

# One text per classification branch and spelling.
BRANCH_TEXTS = [
    "",
    "server s1 status is error: fault is None",
    "EXCEPTION: Instance could not be found (HTTP 404) FUNC: server_delete",
    "call failed (HTTP 429)",
    "This request was rate-limited.",
    "over the Rate Limit",
    "Image not found (HTTP 404)",
    "AddressLimitExceeded: Address quota exceeded",
    "Quota exceeded for instances",
    "Invalid key_name provided",
    "(HTTP 400) no nw_info cache associated with instance",
    "(HTTP 400) unable to associate floating ip",
    "Permission denied (publickey). During SSH from a to b",
    "SSH Timeout Error",
    "timed out in wait_for_active_status after 240",
    "PING TIMEOUT for IP 15.0.1.1 after trying for 180 seconds",
    "Delete Server Timeout Exception",
    "Floating IP attach failed",
    "server erred (HTTP 500)",
    "Bad Request",
    "waited 2400 seconds",
    "Max retries exceeded with url",
    "unsupported operand type(s) for -",
    "Some Other Text",
]


# One text per scrub rule and fragment, one that two rules meet and two that none does.
SCRUB_TEXTS = [
    "",
    "The server has either erred or is incapable of performing the requested operation. (HTTP 500)",
    "ssh: Permission denied (publickey)",
    "Instance quota exceeded for tenant 7",
    "The resource could not be found. (HTTP 404)",
    "Instance could not be found (HTTP 404)",
    "Test timed out: Permission denied (publickey)",
    "Some Other Text",
]


def week_start(ts: Column) -> Column:
    day = ts.cast("date")
    return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")


def order_start() -> Column:
    """A test starts on the day of its order; its pass starts with its first test."""
    return F.col("o_orderdate") + F.expr("(o_orderkey % 24) * interval '1' hour")


def pass_id(week: Column, nation: Column) -> Column:
    stamp = F.year(week).cast("bigint") * 10000 + F.month(week) * 100 + F.day(week)
    return stamp * 25 + nation


def zero_when(condition: Column, value: Column) -> Column:
    return F.when(condition, F.lit(0)).otherwise(value).cast("double")


def action_log(lineitem: DataFrame) -> DataFrame:
    """Action rows from order lines; works on a batch and on a stream."""
    step, supplier, part = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    names = ["boot", "wait_for_active_status", "floating_ip_create",
             "server_attach_floating_ip", "ping_device", "ssh"]
    function = F.coalesce(F.get(F.array(*map(F.lit, names)), step - 1), F.lit("server_delete"))
    started = F.col("l_shipdate") + F.expr("((l_partkey * 37) % 86400) * interval '1' second")
    ip = F.concat(F.lit("15.0."), (part % 4).cast("string"), F.lit("."),
                  (supplier % 50).cast("string"))
    text = error_type = F.when(F.col("l_returnflag") == "N", F.lit(""))
    for digit, template in enumerate(LOG_TEXTS):
        hit = supplier % 10 == digit
        text = text.when(hit, F.format_string(template, ip) if "%s" in template
                         else F.lit(template))
        # The address cannot change the type, so the type is one constant per text.
        error_type = error_type.when(hit, F.lit(error_type_of(template)))
    return lineitem.select(
        F.col("l_orderkey").alias("test_id"),
        function.alias("function_name"),
        started.alias("time_started"),
        F.timestamp_add("SECOND", F.col("l_quantity").cast("int"), started).alias("time_end"),
        F.col("l_quantity").alias("time_total"),
        text.alias("error_text"),
        error_type.alias("error_type"),
    )


def attachment_events(events: DataFrame) -> DataFrame:
    """Attach and detach events of addresses; works on a batch and on a stream."""
    return events.select(
        F.concat(F.lit("15.0.0."), F.col("user_id").cast("string")).alias("ip"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type").isin("view", "click"), "detach").otherwise("attach")
        .alias("kind"),
    )
