"""SQL twins of the registered queries, written by hand against the benchmark tables."""

from __future__ import annotations

from faultline.plans import reports

_AS_OF = "timestamp '2001-07-03 08:01:50'"

# Derived tables as common table expressions; each may use the ones above it.
_TABLES = {
    "keyed_orders": """
        select o.*, c_nationkey, wk,
          (cast(year(wk) as bigint) * 10000 + month(wk) * 100 + day(wk)) * 25 + c_nationkey
            as test_pass_id
        from (select *, cast(date_trunc('week', o_orderdate) as timestamp) as wk from orders) o
        join customer on c_custkey = o_custkey""",
    "test_passes": """
        select test_pass_id, 'boot-scaling' as test_pass_name, r_name as environ_name,
          n_name as zone, 'region-' || r_regionkey as region,
          'host-' || (n_nationkey % 4) as execution_hostname,
          'acct-' || (n_nationkey % 7) as cloud_account_username,
          min(o_orderdate + (o_orderkey % 24) * interval 1 hour) as time_started,
          max(o_orderdate) + interval 1 day as time_end,
          cast(count(*) * 60 as double) as time_total
        from keyed_orders join nation on n_nationkey = c_nationkey
        join region on r_regionkey = n_regionkey
        group by test_pass_id, r_name, n_name, r_regionkey, n_nationkey""",
    "test_results": """
        select *, cast(time_to_active > 0 as integer) as is_active,
          cast(time_to_ping > 0 as integer) as is_pingable,
          cast(time_to_ssh > 0 as integer) as is_sshable, 0 as is_successful
        from (
          select o_orderkey as test_id,
            case when o_orderkey % 97 <> 13 then test_pass_id end as test_pass_id,
            'test_boot' as test_name,
            cast(power(2, cast(substring(o_orderpriority, 1, 1) as integer) - 1) as integer)
              as concurrency_count,
            o_orderdate + (o_orderkey % 24) * interval 1 hour as time_started,
            o_orderdate + (o_orderkey % 24) * interval 1 hour
              + cast(floor(o_totalprice / 1000) as bigint) * interval 1 second as time_end,
            cast(floor(o_totalprice / 1000) as double) as time_total,
            cast(case when o_orderkey % 10 = 0 then 0 else o_orderkey % 97 end as double)
              as time_to_active,
            cast(case when o_orderkey % 7 = 0 then 0 else o_orderkey % 113 end as double)
              as time_to_ping,
            cast(case when o_orderstatus = 'F' then 0 else o_orderkey % 211 end as double)
              as time_to_ssh,
            cast(o_orderkey % 50 as double) as rps,
            case when o_orderstatus = 'F' then 1 else 0 end as hard_errors_exist,
            cast(case when o_orderstatus = 'F' then 1 + o_orderkey % 3 else 0 end as integer)
              as hard_error_count,
            cast(case when o_orderstatus = 'P' then 1 + o_orderkey % 2 else 0 end as integer)
              as soft_error_count
          from keyed_orders)""",
    "raw_actions": """
        select l_orderkey as test_id,
          case l_linenumber when 1 then 'boot' when 2 then 'wait_for_active_status'
            when 3 then 'floating_ip_create' when 4 then 'server_attach_floating_ip'
            when 5 then 'ping_device' when 6 then 'ssh' else 'server_delete' end as function_name,
          l_shipdate + ((l_partkey * 37) % 86400) * interval 1 second as time_started,
          l_shipdate + ((l_partkey * 37) % 86400) * interval 1 second
            + cast(l_quantity as bigint) * interval 1 second as time_end,
          l_quantity as time_total,
          case when l_returnflag = 'N' then '' else case l_suppkey % 10
            when 0 then 'Rate limit: request was rate-limited (HTTP 429)'
            when 1 then 'PING TIMEOUT for IP 15.0.' || (l_partkey % 4) || '.' || (l_suppkey % 50)
              || ' after trying for 180 seconds'
            when 2 then 'SSH Timeout Error: FAILED ssh to IP 15.0.' || (l_partkey % 4) || '.'
              || (l_suppkey % 50) || ' after trying for 240 seconds.'
            when 3 then 'The resource could not be found. (HTTP 404)'
            when 4 then 'Not Found (HTTP 404)'
            when 5 then 'The server has either erred (HTTP 500)'
            when 6 then 'Quota exceeded for instances (HTTP 413)'
            when 7 then 'ssh: Permission denied (publickey)'
            when 8 then 'unsupported operand type(s) for -'
            else 'Delete Server Timeout Exception' end end as error_text
        from lineitem""",
    "test_actions": "select *, {classify} as error_type from raw_actions",
    "spelled_actions": """select * replace (case when error_type <> '' then error_type
          else case test_id % 3 when 0 then '' when 1 then 'None' end end as error_type)
        from test_actions""",
    "error_texts": """
        select l_orderkey as test_id, l_linenumber as step,
          case (l_orderkey + l_linenumber) % 24
            when 0 then '' when 1 then 'server s1 status is error: fault is None'
            when 2 then 'EXCEPTION: Instance could not be found (HTTP 404) FUNC: server_delete'
            when 3 then 'call failed (HTTP 429)' when 4 then 'This request was rate-limited.'
            when 5 then 'over the Rate Limit' when 6 then 'Image not found (HTTP 404)'
            when 7 then 'AddressLimitExceeded: Address quota exceeded'
            when 8 then 'Quota exceeded for instances' when 9 then 'Invalid key_name provided'
            when 10 then '(HTTP 400) no nw_info cache associated with instance'
            when 11 then '(HTTP 400) unable to associate floating ip'
            when 12 then 'Permission denied (publickey). During SSH from a to b'
            when 13 then 'SSH Timeout Error'
            when 14 then 'timed out in wait_for_active_status after 240'
            when 15 then 'PING TIMEOUT for IP 15.0.1.1 after trying for 180 seconds'
            when 16 then 'Delete Server Timeout Exception'
            when 17 then 'Floating IP attach failed' when 18 then 'server erred (HTTP 500)'
            when 19 then 'Bad Request' when 20 then 'waited 2400 seconds'
            when 21 then 'Max retries exceeded with url'
            when 22 then 'unsupported operand type(s) for -' else 'Some Other Text'
          end as error_text
        from lineitem""",
    "build_details": """
        select cast(event_id as varchar) as id, cast(floor(value * 1000) as bigint) as duration,
          ts as end_date, 'folder/job-' || (user_id % 20) as full_name,
          'job-' || (user_id % 20) as name,
          case event_type when 'error' then 'FAILURE' when 'view' then 'UNSTABLE'
            else 'SUCCESS' end as result,
          ts as start_date, cast(user_id as varchar) as user_id, 'user-' || user_id as user_name,
          'node-' || (user_id % 5) as node_url
        from events""",
    "spelled_builds": """
        select * replace (case when result = 'FAILURE' and cast(id as bigint) % 2 = 0
            then 'FAILED' else result end as result)
        from build_details""",
    "scrub_texts": """
        select l_orderkey as test_id, l_linenumber as step, '' as error_type,
          case (l_orderkey + l_linenumber) % 8 when 0 then ''
            when 1 then 'The server has either erred or is incapable of performing the requested operation. (HTTP 500)'
            when 2 then 'ssh: Permission denied (publickey)'
            when 3 then 'Instance quota exceeded for tenant 7'
            when 4 then 'The resource could not be found. (HTTP 404)'
            when 5 then 'Instance could not be found (HTTP 404)'
            when 6 then 'Test timed out: Permission denied (publickey)'
            else 'Some Other Text' end as error_text
        from lineitem""",
    "build_node": """
        select distinct node_url as url, 'build node' as description,
          upper(node_url) as display_name, 'linux' as label, '15.0.0.1' as master_address,
          'master' as master_host_name, node_url as name
        from build_details""",
    "build_params": """
        select 'p-' || event_id as id, 'k' as name, json_extract_string(props, '$.k') as value,
          cast(event_id as varchar) as build_details_id
        from events""",
    "account_external_ids": """
        select c_custkey as account_id, 'https://login.launchpad.net/+id/' || c_custkey
          as external_id, c_name || '@example.org' as email_address from customer
        union all
        select c_custkey, 'https://launchpad.net/~' || c_name, c_name || '@example.org'
        from customer where c_custkey % 3 <> 0
        union all
        select c_custkey, 'username:' || c_name, c_name || '@example.org'
        from customer where c_custkey % 5 <> 0""",
    "repeated_external_ids": """
        select * from account_external_ids
        union all select * from account_external_ids where account_id % 4 = 0""",
    "accounts": """
        select c_custkey as account_id, c_name as full_name,
          case when c_acctbal < 0 then 'Y' else 'N' end as inactive from customer""",
    "snapped_events": """
        select *, case when ts < timestamp '2024-01-16 00:00:00' then 1 else 2 end as snapshot
        from events""",
    "floating_ips": """
        select snapshot, user_id as id, '15.0.0.' || user_id as ip,
          case when event_type in ('view', 'click') then null else user_id end as instance_id
        from (select *, row_number() over (partition by snapshot, user_id
                order by ts desc, event_id desc) as rn from snapped_events) where rn = 1""",
    "usage": """
        select snapshot, 'user-' || user_id as name, count(*) as value
        from snapped_events group by snapshot, user_id""",
    "servers": """
        select 'srv-' || c_custkey as id, c_name as name,
          case when c_custkey % 11 <> 0 then 'net=10.0.' || (c_custkey % 200) || '.'
            || (c_custkey % 250) || ', 15.0.' || (c_custkey % 30) || '.' || (c_custkey % 240)
          end as addresses,
          case c_custkey % 4 when 0 then 'Building' when 2 then 'error' else 'active' end
            as vm_state,
          case c_custkey % 7 when 0 then 'scheduling' when 1 then null when 2 then 'networking'
            when 3 then 'spawning' when 4 then 'block_device_mapping' when 5 then 'deleting'
            else 'None' end as task_state,
          case c_custkey % 10 when 0 then 'BUILD(scheduling)' when 1 then 'BUILD(networking)'
            when 2 then 'BUILD(block_device_mapping)' when 3 then 'BUILD(spawning)'
            when 4 then 'BUILD(other)' when 5 then 'ACTIVE(rebooting_hard)' when 6 then 'ACTIVE'
            when 7 then 'ERROR' when 8 then 'ERROR(networking)' else 'DELETED' end
            as legacy_status
        from customer""",
    "probe_log": """
        select l_orderkey as test_id, l_linenumber as step,
          case l_linenumber % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 255
            else 13 end as return_code,
          case when l_partkey % 3 = 0 then '' else 'login on node-' || l_suppkey end as output,
          'node-' || l_suppkey as expected,
          case when l_partkey % 2 = 0 then 'Permission denied (publickey).'
            else 'connection reset' end as errors
        from lineitem""",
    "definition_lines": """
        select p_partkey as line_no, case p_partkey % 6 when 0 then '# ' || p_name when 1 then ''
          when 2 then 'sysbench rw ' || p_size || ' 4 1@8 60 db' || (p_partkey % 9) || '@db'
            || (p_partkey % 9 + 1) || ' run' || p_partkey
          when 3 then 'sysbench in-memory  ' || p_size || '  3600  db1  run' || p_partkey
          when 4 then 'tpcc-mysql ' || p_size || ' 2@16 120 db' || (p_partkey % 9) || '@db'
            || (p_partkey % 9 + 1) || ' run' || p_partkey
          else 'unknown ' || p_size end as value
        from part""",
    "definitions": """
        select w[1] as benchmark_type,
          case w[1] when 'sysbench' then w[2] end as ro_rw,
          case w[1] when 'sysbench' then w[3] when 'tpcc-mysql' then '0' end as table_size,
          case w[1] when 'sysbench' then w[4] when 'tpcc-mysql' then '0' end as tables_count,
          case w[1] when 'sysbench' then '0' when 'tpcc-mysql' then w[2] end as warehouses,
          case w[1] when 'sysbench' then w[5] when 'tpcc-mysql' then w[3] end as threads,
          case w[1] when 'sysbench' then w[6] when 'tpcc-mysql' then w[4] end as run_seconds,
          case w[1] when 'sysbench' then w[7] when 'tpcc-mysql' then w[5] end as hosts,
          case w[1] when 'sysbench' then w[8] when 'tpcc-mysql' then w[6] end as name_prefix
        from (select regexp_split_to_array(trim(value), '\\s+') as w from definition_lines
              where not regexp_matches(value, '^#|^$'))""",
    "address_events": """
        select '15.0.0.' || user_id as ip, ts as event_time,
          case when event_type in ('view', 'click') then 'detach' else 'attach' end as kind
        from events""",
}


def _classify(text: str, intended: bool = False) -> str:
    """Classification cascade; six literals carry capitals and match only when lowered."""
    def lit(fragment: str) -> str:
        return f"contains(lower({text}), '{fragment.lower() if intended else fragment}')"
    return f"""case when {text} = '' then ''
      when {lit('status is error: fault is None')}
        then 'Boot Instance Failed: Instance Status is ERROR'
      when {lit('Instance could not be found (HTTP 404) FUNC: server_delete')}
        then 'Instance could not be found (HTTP 404) - FUNC: server_delete'
      when {lit('http 429')} or {lit('rate-limited')} or {lit('rate limit')}
        then '(HTTP 429) Rate Limited'
      when {lit('http 404')} and {lit('not found')} then '(HTTP 404) Resource Not Found'
      when {lit('AddressLimitExceeded: Address quota exceeded')} then 'Address Quota Exceeded'
      when {lit('Quota exceeded for instances')} then 'Instance Quota Exceeded'
      when {lit('Invalid key_name provided')} then '(HTTP 400) Invalid key_name provided'
      when {lit('http 400')} and {lit('nw_info cache associated with instance')}
        then '(HTTP 400) No nw_info cache associated with instance'
      when {lit('http 400')} and {lit('unable to associate floating ip')}
        then '(HTTP 400) Unable to associate floating ip'
      when {lit('permission denied (publickey)')} and {lit('ssh')}
        then 'SSH Failed: Permission denied (publickey)'
      when {lit('ssh timeout')} then 'SSH Timeout'
      when {lit('timed out')} and {lit('wait_for_active_status ')}
        then 'Wait for Active Status Timeout'
      when {lit('ping timeout')} then 'Ping Timeout'
      when {lit('delete server timeout')} then 'Delete Server Timeout'
      when {lit('floating ip attach failed')} then 'Floating IP Attach Failed'
      when {lit('http 500')} then '(HTTP 500)'
      when {lit('bad request')} or {lit('400')} then '(HTTP 400) Bad Request'
      when {lit('Max retries exceeded with url')} then 'Max retries exceeded with url'
      else {text} end"""


_SEVERITY = """case when coalesce(error_type, '') in ('', 'None') then 'none'
  when contains(lower(error_type), 'http 429') or contains(lower(error_type), 'rate-limited')
    or contains(lower(error_type), 'rate limit') then 'soft'
  when contains(lower(error_type), 'http 413') or contains(lower(error_type), 'quota exceeded')
    then 'soft'
  when contains(lower(error_type), 'ssh timeout')
    or contains(lower(error_type), 'floating ip attach failed')
    or contains(lower(error_type), 'http 500') or contains(lower(error_type), 'http 404')
    or contains(lower(error_type), 'http 400') or contains(lower(error_type), 'ping timeout')
    then 'hard'
  when contains(lower(error_type), 'delete server timeout') then 'soft'
  else 'hard' end"""


def _with_tables(body: str) -> str:
    """Prefix a statement with the derived tables it uses, directly or through others."""
    needed, pending = set(), [body]
    while pending:
        piece = pending.pop()
        for name, definition in _TABLES.items():
            if name not in needed and name in piece:
                needed.add(name)
                pending.append(definition)
    parts = [f"{name} as ({definition.replace('{classify}', _classify('error_text'))})"
             for name, definition in _TABLES.items() if name in needed]
    return f"with {', '.join(parts)} {body}" if parts else body


_RESULT_COLUMNS = """test_id, test_pass_id, test_name, concurrency_count, time_started, time_end,
  time_total, time_to_active, time_to_ping, time_to_ssh, is_active, is_pingable, is_sshable,
  is_successful, rps, hard_errors_exist, hard_error_count, soft_error_count"""

# Joins of the log as the reports state them.
_LOG_JOIN = """test_results tr left join test_actions trg on tr.test_id = trg.test_id
  left join test_passes tp on tr.test_pass_id = tp.test_pass_id"""


def _since(column: str, count: int, unit: str) -> str:
    return f"{column} > {_AS_OF} - interval {count} {unit} and {column} <= {_AS_OF}"


_TESTS_UNTIL = f"and t.time_started <= {_AS_OF}"
_LOG_UNTIL = f"and tr.time_started <= {_AS_OF} and trg.time_started <= {_AS_OF}"


def _not_in(types) -> str:
    return " ".join(f"and trg.error_type <> '{t}'" for t in types)


_STRFTIME = {"MM-dd-yyyy": "%m-%d-%Y", "MM-dd-yy": "%m-%d-%y", "yyyy-MM-dd": "%Y-%m-%d",
             "yyyy-MM-dd-HH": "%Y-%m-%d-%H", "MM-dd-yyyy-HH": "%m-%d-%Y-%H",
             "MM-dd-yyyy-hh": "%m-%d-%Y-%I"}

_NOISE = "and trg.error_type not like '%unsupported operand type(s) for%'"


def _failure_rate(params: dict) -> str:
    count, unit = params["lookback"]
    keys = ", ".join(f"tp.{k}" for k in params["keys"])
    loose = "".join(f", min(tp.{c}) as {c}" for c in params["loose"])
    environ = f"where tp.environ_name = '{params['environ']}'" if params["environ"] else ""
    return f"""
        select strftime(t.time_started, '{_STRFTIME[params['bucket'].pattern]}') as my_date,
          {keys}{loose}, count(*) as total_tests,
          cast(sum(hard_errors_exist) as bigint) as total_failures,
          avg(t.hard_errors_exist) as failure_rate
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
          and {_since('tp.time_started', count, unit)} {_TESTS_UNTIL}
        {environ} group by my_date, {keys}"""


def _latency(keys, days, loose, environ=None, counts=False) -> str:
    grouped = ", ".join(f"tp.{k}" for k in keys)
    shown = "".join(f", min(tp.{c}) as {c}" for c in loose)
    errors = (", cast(sum(t.hard_error_count) as bigint) as hard_error_count, "
              "cast(sum(t.soft_error_count) as bigint) as soft_error_count") if counts else ""
    where = f"and tp.environ_name = '{environ}'" if environ else ""
    return f"""
        select count(*) as total_booted, {grouped}{shown}, t.concurrency_count,
          avg(nullif(t.time_total, 0)) as avg_time_total,
          avg(nullif(t.time_to_active, 0)) as avg_time_to_active,
          avg(nullif(t.time_to_ping, 0)) as avg_time_to_ping,
          avg(nullif(t.time_to_ssh, 0)) as avg_time_to_ssh,
          avg(t.hard_errors_exist) as pct_error{errors}
        from test_results t left join test_passes tp on tp.test_pass_id = t.test_pass_id
        where {_since('tp.time_started', days, 'day')} {_TESTS_UNTIL} {where}
        group by {grouped}, t.concurrency_count"""


def _error_types(environ: str, days: int, excluded) -> str:
    return f"""
        select count(*) as func_error_count, tp.environ_name, trg.error_type from {_LOG_JOIN}
        where error_type <> '' and tp.environ_name = '{environ}'
          and {_since('tp.time_started', days, 'day')} {_LOG_UNTIL} {_not_in(excluded)} {_NOISE}
        group by tp.environ_name, trg.error_type"""


def _errors_by_function(count: int, unit: str) -> str:
    return f"""
        select count(*) as func_error_count, min(tp.environ_name) as environ_name,
          trg.function_name, trg.error_type, min(trg.error_text) as error_text
        from {_LOG_JOIN} where error_type <> '' and {_since('tp.time_started', count, unit)} {_LOG_UNTIL}
        group by trg.function_name, trg.error_type"""


def _recent_errors(count: int, unit: str) -> str:
    return f"""
        select tp.environ_name, trg.function_name, trg.error_type, trg.error_text
        from {_LOG_JOIN} where error_type <> '' and {_since('tp.time_started', count, unit)} {_LOG_UNTIL}"""


def _errors_by_call(environ: str) -> str:
    return f"""
        select count(*) as error_count, trg.function_name, tr.concurrency_count, trg.error_type
        from {_LOG_JOIN} where tr.concurrency_count > 1 and tp.environ_name = '{environ}'
          and trg.error_type <> '' and {_since('tp.time_started', 90, 'day')} {_LOG_UNTIL}
          {_not_in([reports.NOT_FOUND, reports.RATE_LIMITED])} {_NOISE}
        group by tr.concurrency_count, trg.function_name, trg.error_type"""


def _errors_by_hour(environ: str, days: int, least: int, zone: bool) -> str:
    zones = "tp.zone, " if zone else ""
    return f"""
        select strftime(tr.time_started, '%Y-%m-%d-%H') as my_date, count(*) as error_count,
          {zones}min(trg.function_name) as function_name, tr.concurrency_count, trg.error_type
        from {_LOG_JOIN} where tr.concurrency_count >= {least} and tp.environ_name = '{environ}'
          and trg.error_type <> '' and {_since('tp.time_started', days, 'day')} {_LOG_UNTIL}
          {_not_in([reports.NOT_FOUND, reports.RATE_LIMITED])} {_NOISE}
        group by my_date, {zones}trg.error_type, tr.concurrency_count"""


_BAD_IP = """substring({t}, instr({t}, 'for IP ') + 7,
  greatest(instr({t}, 'after trying for') - instr({t}, 'for IP ') - 7, 0))"""


def _unpingable(environ: str, days: int) -> str:
    return f"""
        select strftime(tr.time_started, '%Y-%m-%d') as my_date,
          {_BAD_IP.format(t='trg.error_text')} as bad_ip, count(*) as ip_used_x_times,
          min(tp.environ_name) as environ_name, min(tp.zone) as zone,
          min(trg.error_type) as error_type
        from {_LOG_JOIN} where trg.error_type = 'Ping Timeout'
          and tp.environ_name = '{environ}' and {_since('tp.time_started', days, 'day')} {_LOG_UNTIL}
        group by my_date, bad_ip"""


def _percentiles(source: str, keys: str) -> str:
    return f"""
        select {keys}, divisor, row_offset, time_total from (
          select *, row_number() over (partition by {keys}, divisor order by time_total desc) - 1
              as pos,
            cast(round(count(*) over (partition by {keys}, divisor) / divisor) as bigint)
              as row_offset
          from {source} cross join (select unnest([2, 4, 20, 100]) as divisor))
        where pos = row_offset"""


def _moving_avg(period: int, days: int, environ: str | None) -> str:
    where = f"and tp.environ_name = '{environ}'" if environ else ""
    return f"""
        select tp.environ_name, days_ago, count(*) as total_tests,
          avg(t.hard_errors_exist) as failure_rate
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
        join (select cast(unnest(range({days})) as integer) as days_ago) d
          on tp.time_started > {_AS_OF} - (days_ago + {period}) * interval 1 day
          and tp.time_started < {_AS_OF} - days_ago * interval 1 day
        where true {_TESTS_UNTIL} {where} group by tp.environ_name, days_ago"""


def _pct(column: str) -> str:
    return f"cast(trunc(cast({column} as decimal(14, 4)) * 100) as integer)"


def _wide(source: str, key: str, labels: list[str], condition: str) -> str:
    columns = ", ".join(f"""max(case when {key} = '{z}' then {_pct('failure_rate')} end)
          as "{z}" """ for z in labels)
    names = ", ".join(f"'{z}'" for z in labels)
    return f"""select cast(strptime(my_date, '%Y-%m-%d') as timestamp) as point, {columns}
        from ({source}) where {key} in ({names}) {condition} group by point"""


_DAILY = _failure_rate(reports.FAILURE_RATES["a1c_day_zone_90d"])
_HOURLY = _failure_rate(reports.FAILURE_RATES["a1d_hour_zone_30d"])
_ENV_DAILY = _failure_rate(reports.FAILURE_RATES["a1s_day_env_360d"])
_ENV_ROWS = f"""select environ_name as series,
    cast(strptime(my_date, '%Y-%m-%d') as timestamp) as point, {_pct('failure_rate')} as pct
  from ({_ENV_DAILY})"""

_TESTS_ENV = """(select r.test_id, tp.environ_name from test_results r
  join test_passes tp on r.test_pass_id = tp.test_pass_id)"""


def _request_count(environ: str, minutes: int) -> str:
    return f"""select count(*) as requests from {_LOG_JOIN}
        where {_since('trg.time_started', minutes, 'minute')} and tp.environ_name = '{environ}'"""


_GREEK_INT = """case when size >= 1125899906842624 then printf('%3d Pi', size // 1125899906842624)
  when size >= 1099511627776 then printf('%3d Ti', size // 1099511627776)
  when size >= 1073741824 then printf('%3d Gi', size // 1073741824)
  when size >= 1048576 then printf('%3d Mi', size // 1048576)
  when size >= 1024 then printf('%3d Ki', size // 1024)
  else printf('%3d   ', size) end"""

_UPDATED_PASSES = """(select test_pass_id, time_started + interval 7 day as time_end,
  604800.0 as time_total from test_passes where test_pass_id % 3 = 0)"""

_MILESTONE = """coalesce(epoch(max(case when a.function_name = '{call}' and coalesce(a.error_type, '') in ('', 'None')
  then a.time_end end) - r.time_started), 0.0)"""


def _milestone(name: str, call: str) -> str:
    return f"cast({_MILESTONE.format(call=call)} as double) as time_to_{name}"


def _flag(name: str, call: str) -> str:
    return (f"cast(count(case when a.function_name = '{call}' "
            f"and coalesce(a.error_type, '') in ('', 'None') then 1 end)"
            f" > 0 as integer) as is_{name}")


def _last_builds(job: str, n: int, failed: str) -> str:
    return f"""select count(*) as failures from (select * from build_details
        where name = '{job}' order by end_date desc, id desc limit {n}) where result = '{failed}'"""


_SEQUENTIAL = """select name, count(case when result = 'FAILURE' then 1 end) as failures
  from (select *, row_number() over (partition by name order by end_date desc, id desc) as rn
        from build_details) where rn <= 3 group by name"""


def _statements() -> dict[str, str]:
    q: dict[str, str] = {}
    for name in ["test_passes", "build_details", "build_node", "build_params",
                 "account_external_ids", "accounts", "test_actions"]:
        q[f"scan_{name}"] = f"select * from {name}"
    q["scan_test_results"] = f"select {_RESULT_COLUMNS} from test_results"

    q["f1_results_of_pass"] = f"""select {_RESULT_COLUMNS} from test_results
        where test_pass_id = 499260360"""
    q["f1_results_of_concurrency"] = f"""select {_RESULT_COLUMNS} from test_results
        where concurrency_count = 16"""
    q["f1_actions_of_test"] = "select * from test_actions where test_id = 742"
    q["f1_clustered_actions_of_test"] = q["f1_actions_of_test"]
    q["f7_clustered_actions_of_two_days"] = f"""select * from test_actions
        where time_started between timestamp '2001-07-01 08:00:00' and {_AS_OF}"""
    q["f1_actions_of_function"] = """select * from test_actions
        where function_name = 'wait_for_active_status'"""
    q["f2_error_actions"] = "select * from test_actions where error_type <> ''"
    q["f3_legacy_errors"] = """select * from spelled_actions
        where error_type <> 'None'"""
    q["f4_text_contains_publickey"] = """select * from test_actions
        where error_text like '%Permission denied (publickey)%'"""
    q["f4_text_contains_timeout"] = """select * from test_actions
        where error_text like '%Timeout%'"""
    q["f5_f6_reportable_errors"] = """select * from test_actions where error_type <> ''
        and error_type <> '(HTTP 404) Resource Not Found'
        and error_type <> '(HTTP 429) Rate Limited'
        and error_type not like '%unsupported operand type(s) for%'"""
    for days in [1, 5, 7, 10, 14, 20, 30, 60, 90, 360]:
        q[f"f7_passes_last_{days}_days"] = f"""select * from test_passes
            where {_since('time_started', days, 'day')}"""
    for count, unit in [(3, "hour"), (48, "hour"), (60, "minute"), (60, "second")]:
        q[f"f7_actions_last_{count}_{unit}s"] = f"""select * from test_actions
            where {_since('time_started', count, unit)}"""
    q["f8_concurrent_results"] = """select test_id, concurrency_count from test_results
        where concurrency_count > 1"""
    q["f9_successful_ssh"] = """select * from spelled_actions
        where function_name = 'ssh' and coalesce(error_type, '') in ('', 'None')"""
    q["f10_active_results"] = "select test_id, time_to_active from test_results where is_active = 1"
    q["f11_servers_with_pattern"] = """select id, name from servers
        where regexp_matches(name, '^(?:Customer#0000000[0-4])')
          and name not in ('Customer#000000007', 'Customer#000000011')"""
    q["f12_unattached_ips"] = "select * from floating_ips where instance_id is null"
    q["f13_ip_lookup"] = "select * from floating_ips where ip = '15.0.0.7'"
    q["f13_servers_with_account"] = """select id, name from servers
        where name in (select full_name from accounts where inactive = 'N')"""
    q["f14_recent_actions"] = f"""select r.test_id, r.test_name, rg.function_name, rg.time_started
        from test_results r left join test_actions rg on r.test_id = rg.test_id
        where {_since('rg.time_started', 60, 'minute')}"""
    q["s1_passes_by_id_desc"] = "select * from test_passes"
    q["s2_actions_by_test_and_start"] = """select test_id, time_started, function_name
        from test_actions"""
    q["s4_last_builds_of_job"] = """select id, end_date, result from build_details
        where name = 'job-3' order by end_date desc, id desc limit 3"""
    q["s5_row_at_offset"] = """select time_total from test_actions
        where function_name = 'wait_for_active_status' order by time_total desc
        limit 1 offset 53"""
    q["errors_ignoring_case"] = """select test_id, function_name, error_type, error_text
        from test_actions where lower(rtrim(error_type)) = 'ping timeout'"""

    q["j1_tests_with_pass"] = f"""select t.test_id, t.test_pass_id, t.time_started,
          t.hard_errors_exist, tp.environ_name, tp.zone, tp.time_started as pass_started
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
          and {_since('tp.time_started', 90, 'day')} {_TESTS_UNTIL}"""
    q["j4_tests_and_actions"] = """select r.test_id, r.test_pass_id, r.test_name,
          rg.function_name, rg.time_started as action_started, rg.error_type
        from test_results r left join test_actions rg on r.test_id = rg.test_id"""
    identities = """
        select id1.account_id, id1.email_address, id1.external_id as login_id,
          id2.external_id as profile_id, acc.full_name, count(*) as copies
        from (select * from account_external_ids
              where external_id like '%login.launchpad.net%') id1
        left join (select account_id, external_id from account_external_ids
                   where external_id like '%/launchpad.net%') id2
          on id1.account_id = id2.account_id
        left join (select account_id from account_external_ids
                   where external_id like '%username:%') id3 on id1.account_id = id3.account_id
        left join accounts acc on id1.account_id = acc.account_id
        where acc.inactive = 'N' group by all"""
    q["j7_identities"] = identities
    q["j7_identity_rows"] = identities.replace(
        "account_external_ids", "repeated_external_ids").replace(
        ", count(*) as copies", "").replace("group by all", "")
    q["x7_trusted_lines"] = f"""select full_name,
          'trustedOpenID = ^https://(login\\\\.)?launchpad\\\\.net/('
          || replace(coalesce(profile_id, 'None'), 'https://launchpad.net/', '') || '|\\\\'
          || replace(login_id, 'https://login.launchpad.net/', '') || '|' || email_address
          || ')$' as trust, copies from ({identities})"""
    q["j8_first_match"] = """select needle, name, id from (
          select needle, name, id,
            row_number() over (partition by needle order by name, id) as rn
          from servers join (select unnest(['srv-12', '0001', 'Customer#00000010', 'absent'])
            as needle) on contains(name, needle) or contains(id, needle)) where rn = 1"""
    q["j8_first_match_of_table"] = """select needle, name, id from (
          select needle, name, id,
            row_number() over (partition by needle order by name, id) as rn
          from servers join (select distinct substring('#00' || p_partkey,
              1 + p_partkey::int % 4, 1 + p_partkey::int % 5) as needle from part) n
            on contains(name, needle) or contains(id, needle)) where rn = 1"""
    q["j9_add_if_absent"] = """select c_name as name, 'known' as origin from customer
        where c_custkey % 3 <> 0
        union all
        select distinct c_name, 'new' from customer where c_mktsegment = 'BUILDING'
          and c_name not in (select c_name from customer where c_custkey % 3 <> 0)"""

    for key, params in reports.FAILURE_RATES.items():
        q[f"failure_rate_{key}"] = _failure_rate(params)
    q["a2_failure_rate_by_env"] = f"""select window_days, tp.environ_name,
          count(*) as total_booted, avg(t.hard_errors_exist) as pct_error
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
        join (select cast(unnest([1, 7, 14, 30, 90, 360]) as integer) as window_days) w
          on tp.time_started > {_AS_OF} - window_days * interval 1 day
          and tp.time_started <= {_AS_OF} {_TESTS_UNTIL}
        group by window_days, tp.environ_name"""
    q["wp5_failure_rate_moving_avg"] = _moving_avg(30, 10, None)
    q["wp5_failure_rate_moving_avg_360d"] = _moving_avg(90, 360, None)
    q["wp5_failure_rate_moving_avg_env"] = _moving_avg(10, 7, "ASIA")

    for environ in reports.LATENCY_ENVIRONMENTS:
        slug = environ.lower().replace(" ", "_")
        q[f"a3a_latency_zone_{slug}"] = _latency(
            ["environ_name", "zone"], 90, ["cloud_account_username"], environ)
        q[f"a5_errors_by_call_{slug}"] = _errors_by_call(environ)
    loose = ["environ_name", "cloud_account_username"]
    q["a3b_latency_region_zone"] = _latency(["region", "zone"], 20, loose, counts=True)
    for days in [10, 20]:
        q[f"a3c_latency_region_{days}d"] = _latency(["region"], days, loose, counts=True)
    q["a3d_latency_by_concurrency"] = """select count(*) as total_nodes, concurrency_count,
          avg(time_total) as avg_time_total, avg(time_to_active) as avg_time_to_active,
          avg(time_to_ping) as avg_time_to_ping, avg(time_to_ssh) as avg_time_to_ssh,
          avg(hard_errors_exist) as avg_error
        from test_results group by concurrency_count"""

    for key, (environ, days, excluded) in reports.ERROR_TYPE_COUNTS.items():
        q[key] = _error_types(environ, days, excluded)
    q["a4b_error_types_by_zone"] = f"""select count(*) as func_error_count,
          min(tp.environ_name) as environ_name, tp.region, tp.zone, trg.error_type,
          min(trg.error_text) as error_text
        from {_LOG_JOIN} where error_type <> '' and tp.environ_name = 'ASIA'
          and {_since('tp.time_started', 20, 'day')} {_LOG_UNTIL}
        group by tp.region, tp.zone, trg.error_type"""
    q["a4c_error_types_all"] = f"""select count(*) as func_error_count, tp.environ_name,
          trg.error_type, min(trg.error_text) as error_text
        from {_LOG_JOIN} where error_type <> '' group by tp.environ_name, trg.error_type"""
    q["a4d_errors_by_function_7d"] = _errors_by_function(7, "day")
    q["a4d_errors_by_function_48h"] = _errors_by_function(48, "hour")
    q["a4e_recent_error_detail"] = _recent_errors(3, "hour")
    q["a4e_recent_error_detail_48h"] = _recent_errors(48, "hour")
    q["a4f_function_error_counts"] = """select trg.function_name, trg.error_type,
          count(*) as errors
        from test_actions trg left join test_results tr on trg.test_id = tr.test_id
        where error_type <> '' group by trg.function_name, trg.error_type"""
    q["a4g_error_type_histogram"] = """select count(*) as errors, trg.error_type
        from test_actions trg left join test_results tr on trg.test_id = tr.test_id
        group by trg.error_type"""
    # Every pass meets every matching row, so the product of the two counts.
    q["a4h_error_counts_cross"] = """select
          count(*) * (select count(*) from test_passes) as func_error_count,
          (select min(environ_name) from test_passes) as environ_name,
          min(trg.function_name) as function_name, trg.error_type
        from test_results tr left join test_actions trg on tr.test_id = trg.test_id
        where error_type <> '' group by trg.error_type"""
    q["a4i_error_counts_not_none"] = """select count(*) as errors, rg.error_type
        from test_results r left join test_actions rg on r.test_id = rg.test_id
        where rg.error_type <> 'None' group by rg.error_type"""
    for key, params in reports.ERRORS_BY_HOUR.items():
        q[key] = _errors_by_hour(*params)
    for environ, days in [("EUROPE", 7), ("MIDDLE EAST", 7), ("EUROPE", 90)]:
        slug = environ.lower().replace(" ", "_")
        q[f"a7_unpingable_ips_{slug}_{days}d"] = _unpingable(environ, days)

    q["a8a_tests_per_day"] = """select strftime(time_started, '%m-%d-%y') as my_date,
          count(*) as total_tests from test_results group by my_date"""
    q["a8b_tests_per_day_env"] = """select strftime(t.time_started, '%m-%d-%y') as my_date,
          tp.environ_name, count(*) as total_tests
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
        group by tp.environ_name, my_date"""
    q["a8c_tests_per_env_name"] = f"""select tp.environ_name, t.test_name,
          count(*) as total_tests
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
        where {_since('t.time_started', 30, 'day')} group by tp.environ_name, t.test_name"""
    q["a9_ssh_duration_stats"] = """select count(*) as total_ssh_calls,
          avg(time_total) as time_avg, max(time_total) as time_max, min(time_total) as time_min
        from spelled_actions
        where function_name = 'ssh' and coalesce(error_type, '') in ('', 'None')"""
    q["a10_avg_time_to_active"] = """select count(*) as calls, avg(time_total) as avg_time_total
        from test_actions where function_name = 'wait_for_active_status'"""
    q["a11_request_count"] = _request_count("ASIA", 60)
    q["a12_requests_per_env"] = f"""select tp.environ_name, count(*) as requests
        from {_LOG_JOIN} where {_since('trg.time_started', 60, 'second')}
        group by tp.environ_name"""
    q["a13_request_rate"] = f"""select 'ASIA' as environ_name,
          cast(round(requests / 3600.0, 2) as double) as rps from ({_request_count('ASIA', 60)})"""
    q["a14_distinct_errors"] = "select distinct error_type from test_actions"

    q["wp1_percentile_rows"] = _percentiles("test_actions", "function_name")
    q["wp1_percentile_rows_env"] = _percentiles(
        f"(select a.*, e.environ_name from test_actions a join {_TESTS_ENV} e "
        "on a.test_id = e.test_id)", "environ_name, function_name")
    q["wp2_percentile_offsets"] = """select count(*) as calls,
          cast(round(count(*) / 2) as bigint) as offset_2,
          cast(round(count(*) / 4) as bigint) as offset_4,
          cast(round(count(*) / 20) as bigint) as offset_20,
          cast(round(count(*) / 100) as bigint) as offset_100
        from test_actions where function_name = 'wait_for_active_status'"""
    q["wp1_sketched_percentiles"] = """select function_name, unnest([2, 4, 20, 100]) as divisor,
          count(*) as n, 1 as within_bound from test_actions group by function_name"""
    q["wp3_failures_in_last_builds"] = _SEQUENTIAL
    q["wp3_sequential_failures"] = f"select * from ({_SEQUENTIAL}) where failures >= 2"
    q["wp3_job_failures"] = _last_builds("job-3", 3, "FAILURE")
    q["wp4_head_failures"] = _last_builds("job-7", 3, "FAILED")
    q["wp4_failures_other_spelling"] = """select name,
          count(case when result = 'FAILED' then 1 end) as failures
        from (select *, row_number() over (partition by name order by end_date desc, id desc) as rn
              from spelled_builds) where rn <= 20 group by name"""

    q["r1_rollup_test_results"] = f"""select *,
          round(action_count / nullif(time_total, 0), 3) as rps from (
          select test_id, count(*) as action_count,
            count(case when severity = 'hard' then 1 end) as hard_error_count,
            count(case when severity = 'soft' then 1 end) as soft_error_count,
            min(time_started) as time_started, max(time_end) as time_end,
            cast(count(case when severity = 'hard' then 1 end) > 0 as integer)
              as hard_errors_exist,
            cast(epoch(max(time_end) - min(time_started)) as double) as time_total
          from (select *, {_SEVERITY} as severity from spelled_actions) group by test_id)"""
    calls = {"active": "wait_for_active_status", "ping": "ping_device", "ssh": "ssh",
             "deleted": "server_delete"}
    q["r2_milestone_times"] = f"""select r.test_id,
          {', '.join(_milestone(n, c) for n, c in calls.items())},
          {_flag('active', calls['active'])}, {_flag('pingable', calls['ping'])},
          {_flag('sshable', calls['ssh'])}
        from test_results r left join spelled_actions a on r.test_id = a.test_id
        group by r.test_id, r.time_started"""
    q["r3_close_passes"] = """select tp.test_pass_id, max(r.time_end) as time_end,
          cast(epoch(max(r.time_end) - tp.time_started) as double) as time_total
        from test_passes tp join test_results r on r.test_pass_id = tp.test_pass_id
        group by tp.test_pass_id, tp.time_started"""
    q["r4_retry_attempts"] = """select test_id, function_name, time_started, attempt,
          cast(epoch(time_started - previous) as double) as gap_seconds,
          case when attempt > 1 then cast(5 * power(2, attempt - 2) as double) end
            as expected_gap
        from (select *, row_number() over w as attempt, lag(time_end) over w as previous
              from test_actions window w as (partition by test_id, function_name
                order by time_started, time_end))"""
    # Islands end with a success; NULL types sort first on both sides.
    order = "order by time_started, time_end, error_type nulls first"
    calls = """select test_id % 100 as test_id, 'call' as function_name, time_started, time_end,
        error_type, case when coalesce(error_type, '') in ('', 'None') then 1 else 0 end as ok
      from test_actions"""
    islands = f"""select *, coalesce(sum(ok) over (partition by test_id {order}
        rows between unbounded preceding and 1 preceding), 0) as island from ({calls})"""
    q["r4_retry_episodes"] = f"""select test_id, function_name, time_started, time_end,
          error_type, attempt,
          case when attempt > 1 then cast(epoch(time_started - previous) as double) end
            as gap_seconds,
          case when attempt > 1 then cast(5 * power(2, attempt - 2) as double) end
            as expected_gap
        from (select *, (row_number() over w - 1) % 5 + 1 as attempt,
                lag(time_end) over w as previous
              from ({islands}) window w as (partition by test_id, island {order}))"""
    q["r5_effective_zone"] = """select test_pass_id,
          coalesce(case when test_pass_id % 4 = 0 then zone || '-v1' end, zone) as zone
        from test_passes"""
    q["r6_io_throughput"] = """
        with sizes as (
          select l_returnflag as device,
            cast(512 * power(2, l_linenumber - 1) as bigint) as blocksize,
            sum(l_quantity) as iops
          from lineitem group by device, blocksize),
        kept as (select device, blocksize, iops, cast(floor(blocksize * iops) as bigint)
            as bandwidth
          from (select *, min(case when iops > 32 then 1 else 0 end) over (partition by device
                  order by blocksize rows between unbounded preceding and 1 preceding) as going
                from sizes) where coalesce(going, 1) = 1)
        select device, blocksize, iops, bandwidth, bandwidth * 8 as bits,
          case when blocksize >= 1024 then printf('%3d Ki', blocksize // 1024)
            else printf('%3d   ', blocksize) end as block_label,
          case when bandwidth >= 1099511627776
              then printf('%5.1f Ti', bandwidth / 1099511627776)
            when bandwidth >= 1073741824 then printf('%5.1f Gi', bandwidth / 1073741824)
            when bandwidth >= 1048576 then printf('%5.1f Mi', bandwidth / 1048576)
            when bandwidth >= 1024 then printf('%5.1f Ki', bandwidth / 1024)
            else printf('%5.1f   ', cast(bandwidth as double)) end as bandwidth_label,
          case when bandwidth * 8 >= 1000000000000
              then printf('%5.1f T', bandwidth * 8 / 1000000000000)
            when bandwidth * 8 >= 1000000000 then printf('%5.1f G', bandwidth * 8 / 1000000000)
            when bandwidth * 8 >= 1000000 then printf('%5.1f M', bandwidth * 8 / 1000000)
            when bandwidth * 8 >= 1000 then printf('%5.1f k', bandwidth * 8 / 1000)
            else printf('%5.1f  ', cast(bandwidth * 8 as double)) end as bits_label
        from kept"""
    q["w7_sample_actions"] = """select test_id, step, function_name, time_started,
          time_started + ((test_id * 31 + step * 17) % 10 + 1) * interval 1 second as time_end,
          3.0::double as time_total
        from (select test_id, time_started, cast(generate_subscripts(calls, 1) - 1 as integer)
            as step, unnest(calls) as function_name
          from (select *, ['boot', 'wait_for_active_status', 'floating_ip_create',
            'server_attach_floating_ip', 'ping_device', 'ssh', 'server_delete'] as calls
            from test_results))"""

    for mode in ["faithful", "intended"]:
        q[f"x1_classify_error_{mode}"] = f"""select test_id, step, error_text,
            {_classify('error_text', mode == 'intended')} as error_type from error_texts"""
    q["x1_classify_error_log"] = f"""select test_id, function_name, error_text,
          {_classify('error_text')} as error_type from raw_actions"""
    q["x2_error_severity"] = f"""select test_id, step, error_type, {_SEVERITY} as severity
        from (select *, {_classify('error_text', True)} as error_type from error_texts)"""
    q["x3_bad_ip_faithful"] = f"""select test_id, error_text, {_BAD_IP.format(t='error_text')}
        as bad_ip from test_actions"""
    q["x3_bad_ip_intended"] = """select test_id, error_text, nullif(regexp_extract(error_text,
        'for IP (\\S+) after trying for', 1), '') as bad_ip from test_actions"""
    q["x4_server_addresses"] = """select id,
          nullif(regexp_extract(addresses, '10.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', 0), '')
            as ip_local,
          nullif(regexp_extract(addresses, '15.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', 0), '')
            as ip_public,
          nullif(regexp_extract(addresses, '15.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', 0), '')
            as ip_floating
        from servers"""
    q["x5_server_states"] = """select id,
          case when task = 'scheduling' then 'scheduling'
            when vm = 'building' and task = 'none' then 'BUILD'
            when task = 'networking' then 'networking'
            when task = 'block_device_mapping' then 'block_device_mapping'
            when task = 'spawning' then 'spawning'
            when vm = 'active' and task = 'none' then 'active'
            when vm = 'error' then 'error' else 'unknown' end as status,
          case when legacy_status in ('BUILD(scheduling)', 'BUILD(networking)',
              'BUILD(block_device_mapping)', 'BUILD(spawning)') then legacy_status
            when legacy_status like 'BUILD%' then 'BUILD'
            when legacy_status = 'ACTIVE(rebooting_hard)' then 'REBOOT_HARD'
            when legacy_status = 'ACTIVE' then 'ACTIVE'
            when legacy_status in ('ERROR', 'ERROR(networking)') then 'ERROR(networking)'
            else 'BUILD' end as legacy_status
        from (select *, lower(coalesce(vm_state, 'none')) as vm,
                lower(coalesce(task_state, 'none')) as task from servers)"""
    q["x6_command_outcome"] = """select test_id, step, return_code,
          case when return_code = 0 and contains(output, expected) then 'success'
            when return_code = 1 then 'host not found' when return_code = 2 then 'timed out'
            when return_code = 255 then 'auth or ssh error' else 'other' end as outcome,
          cast(return_code = 255 and contains(errors, 'Permission denied (publickey)')
            as integer) as publickey
        from probe_log"""
    q["x8_x9_time_labels"] = """select test_id, strftime(time_started, '%m-%d-%Y') as day_us,
          strftime(time_started, '%m-%d-%y') as day_us_short,
          strftime(time_started, '%Y-%m-%d') as day_iso,
          strftime(time_started, '%Y-%m-%d-%H') as hour_iso,
          strftime(time_started, '%m-%d-%Y-%H') as hour_us,
          strftime(time_started, '%m-%d-%Y-%I') as hour12_us,
          cast(strptime(strftime(time_started, '%m-%d-%Y-%H'), '%m-%d-%Y-%H') as timestamp)
            as hour_start
        from test_results"""
    q["x11_elapsed_seconds"] = """select test_id,
          cast(epoch(time_end - time_started) as double) as seconds from test_results"""
    q["x14_humanize_units"] = f"""select l_orderkey, l_linenumber, size, {_GREEK_INT} as label
        from (select l_orderkey, l_linenumber, l_partkey * 1024 * l_linenumber * l_suppkey as size
              from lineitem)"""
    q["x16_normalize_no_error"] = """select spelled,
          nullif(nullif(spelled, ''), 'None') as error_type, count(*) as n
        from (select case when test_id % 3 = 0 then 'None' else error_type end as spelled
              from test_actions) group by spelled"""

    for environ, zones in reports.ZONES.items():
        q[f"p1_series_by_zone_{environ.lower().replace(' ', '_')}"] = _wide(
            _DAILY, "zone", zones, f"and environ_name = '{environ}'")
    asia = ", ".join(f"'{z}'" for z in reports.ZONES["ASIA"])
    q["p1_series_by_zone_hourly"] = f"""select zone as series,
          cast(strptime(my_date, '%Y-%m-%d-%H') as timestamp) as point,
          {_pct('failure_rate')} as pct
        from ({_HOURLY}) where environ_name = 'ASIA' and zone in ({asia})"""
    q["p2_series_by_env"] = _wide(_ENV_DAILY, "environ_name", reports.ENVIRONMENTS, "")
    q["p3_zero_filled_series"] = f"""select s.series, s.day, coalesce(r.pct, 0) as pct
        from (select series, cast(unnest(generate_series(timestamp '2000-07-08',
                timestamp '2001-07-06', interval 1 day)) as date) as day
              from (select distinct series from ({_ENV_ROWS}))) s
        left join ({_ENV_ROWS}) r on r.series = s.series and cast(r.point as date) = s.day"""
    q["u4_series_labels"] = f"select distinct zone as label from ({_DAILY})"
    q["io6_series_output"] = f"select point, pct, series from ({_ENV_ROWS})"

    q["u1_orphaned_ips"] = """select id, ip, instance_id from floating_ips
        where snapshot = 2 and instance_id is null
          and ip in (select ip from floating_ips where snapshot = 1 and instance_id is null)
          and ip not in (select ip from floating_ips where id % 10 = 0)"""
    q["u2_except_ignore_list"] = """select * from floating_ips
        where ip not in (select ip from floating_ips where id % 7 = 0)"""
    q["u3_snapshot_delta"] = """select name, b.value as before_value, a.value as after_value,
          a.value - b.value as delta,
          coalesce(cast(a.value - b.value = 1 as integer), 0) as as_expected
        from (select * from usage where snapshot = 1) b
        full join (select * from usage where snapshot = 2) a using (name)"""

    q["io7_definitions"] = "select * from definitions"
    q["io8_benchmark_runs"] = """select benchmark_type, db_host, thread, run_seconds,
          case benchmark_type when 'sysbench' then coalesce(name_prefix, '') || '_sysbench_'
              || db_host || '_' || coalesce(ro_rw, '') || '_th' || thread || '_ts'
              || coalesce(table_size, '') || '_tc' || coalesce(tables_count, '') || '_time'
              || coalesce(run_seconds, '')
            else coalesce(name_prefix, '') || '_tpcc_' || db_host || '_w'
              || coalesce(warehouses, '') || '_th' || thread || '_time'
              || coalesce(run_seconds, '') end as benchmark_name
        from (select *, unnest(string_split(hosts, '@')) as db_host
              from (select *, unnest(string_split(threads, '@')) as thread from definitions
                    where benchmark_type in ('sysbench', 'tpcc-mysql')))"""

    q["w1_append_results"] = f"select {_RESULT_COLUMNS} from test_results"
    q["w2_append_open_passes"] = """select * replace (
          cast(null as timestamp) as time_end, cast(null as double) as time_total)
        from test_passes"""
    q["w3_upsert_pass_end"] = f"""select p.* replace (
          coalesce(u.time_end, p.time_end) as time_end,
          coalesce(u.time_total, p.time_total) as time_total)
        from test_passes p left join {_UPDATED_PASSES} u on u.test_pass_id = p.test_pass_id"""
    q["w4_scrub_errors"] = """select test_id, function_name, time_started, error_text,
          case when error_text like '%Test timed out%' then 'Test timed out'
            when error_text like '%The resource could not be found. (HTTP 404)%'
              or error_text like '%Instance could not be found (HTTP 404)%'
              then '(HTTP 404) Resource Not Found'
            when error_text like '%Instance quota exceeded%'
              then '(HTTP 413) Instance quota exceeded'
            when error_text like '%Permission denied (publickey)%'
              then 'SSH Failed: Permission denied (publickey)'
            when error_text like '%The server has either erred or is incapable of performing the requested operation. (HTTP 500)%'
              then 'The server has either erred or is incapable of performing the requested operation. (HTTP 500)'
            else error_type end as error_type
        from test_actions"""
    q["w4_scrub_every_rule"] = q["w4_scrub_errors"].replace(
        "test_id, function_name, time_started,", "test_id, step,").replace(
        "from test_actions", "from scrub_texts")
    q["w4_scrub_environments"] = """select test_pass_id, region,
          case region when 'region-1' then 'AMERICA-2' when 'region-4' then 'ASIA'
            else environ_name end as environ_name
        from test_passes"""
    q["w4_scrub_hard_flag"] = """select test_id, hard_error_count,
          case when hard_error_count = 0 then 0 else 1 end as hard_errors_exist
        from test_results"""
    q["w5_assign_ids"] = """select (select max(test_id) from test_results)
          + row_number() over (order by time_started, test_id) as result_id, time_started, test_id from test_results"""
    q["w5_ledger_ids"] = """select row_number() over (
          order by test_id % 2 desc, time_started, test_id) as result_id, time_started, test_id
        from test_results"""
    q["w3_stored_upsert"] = q["w3_upsert_pass_end"]
    q["w4_stored_scrub"] = q["w4_scrub_errors"]
    q["w6_orphan_check"] = """
        select 'results-passes' as relation, count(*) as orphans from test_results
          where test_pass_id not in (select test_pass_id from test_passes
            where test_pass_id % 3 <> 0)
        union all select 'actions-results', count(*) from test_actions
          where test_id not in (select test_id from test_results where test_id % 5 <> 0)
        union all select 'details-node', count(*) from build_details
          where node_url not in (select url from build_node where url <> 'node-4')
        union all select 'params-details', count(*) from build_params
          where build_details_id not in (select id from build_details where result <> 'FAILURE')"""
    gone = "(select test_pass_id from test_passes where zone in ('NATION_2', 'NATION_3'))"
    q["w6_cascade_delete_passes"] = f"""select * from test_passes
        where test_pass_id not in {gone}"""
    q["w6_cascade_delete_results"] = f"""select {_RESULT_COLUMNS} from test_results
        where test_pass_id is null or test_pass_id not in {gone}"""
    q["w6_cascade_delete_actions"] = f"""select * from test_actions where test_id not in
        (select test_id from test_results where test_pass_id in {gone})"""
    q["w6_orphan_check_bitmaps"] = """
        select 'results-passes' as relation, count(*) as orphans from test_results
          where test_pass_id not in (select test_pass_id from test_passes
            where test_pass_id % 3 <> 0)
        union all select 'actions-results', count(*) from test_actions
          where test_id not in (select test_id from test_results where test_id % 5 <> 0)"""
    q["w6_stored_cascade"] = q["w6_cascade_delete_actions"]

    q["t1_stream_request_rate"] = f"""select w as window_start, environ_name,
          count(*) as requests, count(*) / 3600.0::double as rps
        from (select environ_name, unnest([
                time_bucket(interval 30 minute, a.time_started),
                time_bucket(interval 30 minute, a.time_started) - interval 30 minute]) as w
              from test_actions a join {_TESTS_ENV} e on a.test_id = e.test_id)
        group by w, environ_name"""
    q["t2_stream_failure_rate"] = """select
          cast(date_trunc('hour', t.time_started) as timestamp) as window_start,
          tp.environ_name, tp.zone, count(*) as total_tests,
          cast(sum(hard_errors_exist) as bigint) as total_failures,
          avg(hard_errors_exist) as failure_rate
        from test_results t join test_passes tp on tp.test_pass_id = t.test_pass_id
        group by all"""
    q["t1_late_tests"] = q["t1_stream_request_rate"]
    q["t1_watermarked_request_rate"] = f"""select w as window_start, environ_name,
          count(*) filter (where not late) as requests, count(*) filter (where late) as late_requests,
          count(*) filter (where not late) / 3600.0::double as rps
        from (select environ_name, w, test_id % 11 = 0 and w + interval 1 hour <= m1 as late
              from (select environ_name, a.test_id, unnest([
                      time_bucket(interval 30 minute, a.time_started),
                      time_bucket(interval 30 minute, a.time_started) - interval 30 minute]) as w
                    from test_actions a join {_TESTS_ENV} e on a.test_id = e.test_id) p,
                (select max(time_started) filter (where test_id % 11 <> 0) - interval 1 day as m1,
                   max(time_started) - interval 1 day as m2 from test_actions) m
              where w + interval 1 hour <= m2) j
        group by w, environ_name"""
    q["t2_late_passes"] = q["t2_stream_failure_rate"]
    q["t3_stream_sequential_failures"] = _SEQUENTIAL
    q["t3_keyed_sequential_failures"] = _SEQUENTIAL
    orphaned = """select ip, event_time as detached_at from address_events d
        where kind = 'detach' and not exists (select 1 from address_events a
          where a.kind = 'attach' and a.ip = d.ip and a.event_time > d.event_time
            and a.event_time <= d.event_time + interval {} second)"""
    q["t4_orphaned_ips_batch"] = orphaned.format(7200)
    q["t4_stream_orphaned_ips"] = orphaned.format(120)
    # What is due when the watermark, ten minutes behind the newest event, has passed its wait.
    q["t4_timed_orphaned_ips"] = orphaned.format(120) + """ and event_time + interval 120 second
          < (select max(event_time) from address_events) - interval 10 minute"""
    return q


def oracle_sql() -> dict[str, str]:
    return {name: _with_tables(body) for name, body in _statements().items()}
