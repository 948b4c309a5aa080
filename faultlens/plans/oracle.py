"""The registered queries as SQL for a second engine, written against the same data tables."""

from __future__ import annotations

from faultlens import fixed_values as V
from faultlens import schemas
from faultlens.operators.prompts import DEFAULT_PROMPT
from faultlens.sources import samples

SQL: dict[str, str] = {}


# Fragments -------------------------------------------------------------------------------------


def lit(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f"e'{escaped}'"


def cut(value: str, limit: int) -> str:
    value = f"coalesce({value}, '')"
    return f"(case when length({value}) <= {limit} then {value} else left({value}, {limit}) || {lit(V.TRUNCATION_MARKER)} end)"


def refs(value: str) -> str:
    found = f"regexp_extract_all(coalesce({value}, ''), '{V.TABLE_REF_PATTERN}')"
    return f"list_sort(list_distinct(list_transform({found}, lambda m: replace(m, '`', ''))))"


def dropped(struct: str) -> str:
    """JSON of a struct without its null fields."""
    return f"json_merge_patch('{{}}', to_json({struct}))"


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when strftime({ts}, '%f') = '000000' then '' "
        f"else '.' || strftime({ts}, '%f') end || '+00:00')"
    )


def failing(task: str) -> str:
    return (
        f"(coalesce({task}.state.result_state = 'FAILED', false) "
        f"or coalesce({task}.status.termination_details.\"type\" = 'CLIENT_ERROR', false) "
        f"or coalesce({task}.status.termination_details.code = 'RUN_EXECUTION_ERROR', false))"
    )


def path_of(task: str) -> str:
    def block(name: str, key: str) -> str:
        return f"when cardinality({task}.{name}) > 0 then coalesce({task}.{name}['{key}'], '')"

    return (
        f"(case {block('notebook_task', 'notebook_path')} {block('spark_python_task', 'python_file')} "
        f"{block('python_wheel_task', 'package_name')} else '' end)"
    )


def leaves(document: str) -> str:
    """Decoded strings of a JSON text without its keys, one per line."""
    quoted = f"""regexp_extract_all({document}, '"(?:[^"\\\\]|\\\\.)*"\\s*:?')"""
    values = f"list_filter({quoted}, lambda q: not ends_with(q, ':'))"
    return f"array_to_string(list_transform({values}, lambda q: cast(q as json) ->> '$'), e'\\n')"


CTES: dict[str, str] = {}


def with_tables(*names: str) -> str:
    """WITH clause of the named common tables, in the order given."""
    return "with " + ",\n".join(f"{name} as ({CTES[name]})" for name in names) + "\n"


# Orders and lineitem ---------------------------------------------------------------------------

ORDER = "{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_shipdate, 'e': l_extendedprice, 'f': l_quantity}"

CTES["line_tasks"] = """
  select *, 'task_' || l_linenumber as task_key, l_orderkey * 100 + l_linenumber as task_run_id,
    case l_returnflag when 'R' then 'FAILED' when 'A' then 'SUCCESS' end as result_state,
    l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F')
      or (l_returnflag = 'A' and l_linenumber = 7) as failed
  from lineitem"""

CTES["order_blamed"] = f"""
  select l_orderkey, bool_or(failed) as any_failed,
    coalesce(min_by(s, ord) filter (where failed), min_by(s, ord)) as task
  from (select l_orderkey, failed, {ORDER} as ord,
          {{'task_key': task_key, 'run_id': task_run_id, 'result_state': result_state, 'part': l_partkey}} as s
        from line_tasks)
  group by l_orderkey"""

CTES["order_heads"] = """
  select o_orderkey as run_id, o_custkey as job_id, coalesce(task.task_key, 'unknown_task') as failed_task_key,
    o_custkey || ':' || o_orderkey || ':' || coalesce(task.task_key, 'unknown_task') || ':'
      || cast(epoch(o_orderdate) as bigint) as event_id,
    not coalesce(any_failed, false) as is_fallback, task
  from orders left join order_blamed on l_orderkey = o_orderkey"""

SQL["qualifying_runs"] = with_tables("line_tasks") + """
select o_orderkey as run_id, o_custkey as job_id, 'job_' || o_custkey as run_name, count(*) as failed_tasks
from orders join line_tasks on o_orderkey = l_orderkey where failed group by all"""

SQL["first_failed_task"] = with_tables("line_tasks", "order_blamed", "order_heads") + """
select run_id, job_id, event_id, failed_task_key, is_fallback,
  coalesce(cast(task.run_id as varchar), '') as failed_task_run_id, task.result_state as result_state
from order_heads"""

_ENTRY = "{{'max_retries': c_custkey % 4, 'notebook_task': {}, 'python_wheel_task': {}, 'spark_python_task': {}, 'task_key': {}}}"
_NO_MAP = "cast(null as map(varchar, varchar))"

CTES["settings"] = f"""
  select c_custkey as job_id, c_name as name, c_mktsegment as creator,
    {{'note': 'after lake.ref.calendar_' || (c_custkey % 7)}} as schedule,
    case when c_custkey % 10 <> 9 then [
      {_ENTRY.format("map {'notebook_path': '/jobs/page_' || (c_custkey % 400)}", _NO_MAP, _NO_MAP, "'task_' || (c_custkey % 3)")},
      {_ENTRY.format(_NO_MAP, _NO_MAP, "map {'python_file': '/src/etl_' || c_custkey || '.py'}", "'task_' || (c_custkey % 5)")},
      {_ENTRY.format(_NO_MAP, "map {'package_name': 'pkg_' || (c_custkey % 10)}", _NO_MAP, "'task_7'")},
      {_ENTRY.format("map {'notebook_path': ''}", _NO_MAP, _NO_MAP, "'task_1'")}
    ] end as tasks
  from customer"""

SQL["task_settings_lookup"] = with_tables("line_tasks", "order_blamed", "order_heads", "settings") + f"""
select event_id, cast(run_id as varchar) as source_run_id, cast(h.job_id as varchar) as source_job_id,
  'job_' || h.job_id as source_job_name, failed_task_key,
  coalesce(nullif({path_of('t')}, ''), '/lines/' || task.part, '') as failure_code_path,
  t is not null as has_task_settings
from (select h.*, list_filter(s.tasks, lambda x: x.task_key = h.failed_task_key)[1] as t
      from order_heads h left join settings s on s.job_id = h.job_id) h"""

# Run documents from events ---------------------------------------------------------------------

CTES["runs"] = """
  select event_id * 10 as run_id, user_id * 11 as job_id,
    case when event_id % 4 <> 0 then 'run of job ' || user_id end as run_name, ts as event_ts,
    list_transform(range(0, event_id % 3 + 1), lambda i: {
      'depends_on': case when i > 0 then [{'task_key': 'task_' || (i - 1)}] end,
      'notebook_task': case when (event_id + i) % 3 = 0 then map {'notebook_path': '/jobs/page_' || (event_id % 300)} end,
      'python_wheel_task': case when (event_id + i) % 3 = 2 then map {'package_name': 'pkg_' || user_id} end,
      'run_id': case when (event_id + i) % 13 <> 0 then event_id * 10 + i + 1 end,
      'spark_python_task': case when (event_id + i) % 3 = 1 then map {'python_file': '/src/etl_' || user_id || '.py'} end,
      'sql_task': case when i = 1 then
        {'query': 'select "id"' || chr(10) || 'from `lake`.raw.orders_' || (event_id % 50) || ' -- ' || chr(92)} end,
      'state': {
        'result_state': case when event_type = 'error' and i = event_id % 3 then 'FAILED'
                             when event_id % 5 <> 0 then 'SUCCESS' end,
        'state_message': case when event_type = 'error' and i = event_id % 3
                              then 'failed reading `lake`.sales.t' || user_id end},
      'status': {'termination_details': {
        'code': case when event_type = 'error' and i = event_id % 3 and event_id % 5 <> 0 then 'RUN_EXECUTION_ERROR' end,
        'message': case when event_type = 'error' and i = event_id % 3
                        then 'run ' || event_id || ' ended with ' || props end,
        'type': case when event_type = 'error' and event_id % 7 = 1 then 'CLIENT_ERROR' end}},
      'task_key': 'task_' || ((event_id + i * i) % 4)}) as tasks
  from events"""

CTES["heads"] = f"""
  select *, coalesce(task.task_key, 'unknown_task') as failed_task_key,
    job_id || ':' || run_id || ':' || coalesce(task.task_key, 'unknown_task') || ':'
      || cast(floor(epoch(event_ts)) as bigint) as event_id
  from (select *, coalesce(list_filter(tasks, lambda t: {failing('t')})[1], tasks[1]) as task,
          len(list_filter(tasks, lambda t: {failing('t')})) > 0 as qualifies
        from runs)
  where qualifies"""

CTES["cases"] = f"""
  select event_id, cast(h.job_id as varchar) as source_job_id, cast(run_id as varchar) as source_run_id,
    coalesce(nullif(run_name, ''), nullif(h.name, ''), '') as source_job_name, failed_task_key,
    task.run_id as task_run_id,
    coalesce(nullif({path_of('task_settings')}, ''), nullif({path_of('task')}, ''), '') as failure_code_path,
    schedule, creator, tasks, run_name, task.state as state, task.status.termination_details as term, event_ts,
    has_settings, name, setting_tasks, task_settings
  from (select h.*, s.job_id is not null as has_settings, s.name, s.tasks as setting_tasks, s.schedule, s.creator,
          list_filter(s.tasks, lambda x: x.task_key = h.failed_task_key)[1] as task_settings
        from heads h left join settings s on s.job_id = h.job_id) h"""

_TEXTS = "[" + ", ".join(lit(t) for t in samples.ERROR_TEXTS) + "]"

CTES["outputs"] = f"""
  select id as run_id, case when id % 10 <> 0 then {_TEXTS}[event_id % 8 + 1] end as error,
    'INFO start' || e'\\n' || 'read from `raw`.orders.day_' || (user_id % 20) || e'\\n' || 'done' as logs,
    case when event_id % 2 = 0 then 'cell ' || event_id end as notebook_output,
    '{{"attempt": ' || (event_id % 3) || '}}' as output_json
  from (select *, unnest([case when event_id % 6 <> 0 then event_id * 10 end, event_id * 10 + event_id % 3 + 1]) as id
        from events)
  where id is not null"""

CTES["asked"] = """
  select event_id, state, term, 4 as ord, cast(source_run_id as bigint) as id from cases
  union all
  select event_id, state, term, 5 as ord, task_run_id as id from cases"""

CTES["output_docs"] = f"""
  select *, cast({dropped("{'error': error, 'logs': logs, 'notebook_output': notebook_output, 'output_json': output_json, 'warning': warning}")} as varchar) as doc
  from (select a.*, case when o.run_id is null and a.id is not null
            then 'LookupError: no output recorded for run ' || a.id
            when o.error is not null then {cut('o.error', V.RUN_OUTPUT_LIMIT)} end as error,
          case when o.logs is not null then {cut('o.logs', V.RUN_OUTPUT_LIMIT)} end as logs,
          case when o.notebook_output is not null then {cut('o.notebook_output', V.RUN_OUTPUT_LIMIT)} end as notebook_output,
          o.output_json, case when a.id is null then {lit(V.NO_TASK_RUN_ID)} end as warning
        from asked a left join outputs o on o.run_id = a.id)"""

CTES["summaries"] = f"""
  select event_id,
    case when contains(doc, 'UNRESOLVED_COLUMN') then 'UNRESOLVED_COLUMN'
         when contains(doc, 'PERMISSION_DENIED') or contains(doc, 'PermissionDenied') then 'PERMISSION_DENIED'
         when contains(doc, 'TABLE_OR_VIEW_NOT_FOUND') or contains(lower(doc), 'not found') then 'NOT_FOUND'
         else coalesce(nullif(term.code, ''), nullif(state.result_state, ''), 'UNKNOWN') end as error_type,
    {cut("coalesce(nullif(error, ''), nullif(notebook_output, ''), nullif(term.message, ''), nullif(state.state_message, ''), doc)", V.ERROR_DESCRIPTION_LIMIT)} as error_description
  from output_docs where ord = 5"""

CASES = ["runs", "heads", "settings", "cases"]
OUTPUTS = [*CASES, "outputs", "asked", "output_docs", "summaries"]

SQL["classify_errors"] = with_tables(*OUTPUTS) + """
select event_id, source_run_id, error_type from summaries join cases using (event_id)"""

SQL["error_descriptions"] = with_tables(*OUTPUTS) + "select event_id, error_description from summaries"

SQL["archived_outputs"] = with_tables(*OUTPUTS) + """
select event_id, source_run_id, error_type, error_description from summaries join cases using (event_id)"""

SQL["event_rows"] = with_tables(*CASES) + f"""
select event_id, source_job_id, source_run_id, source_job_name, failed_task_key,
  '{V.TRIGGER_SOURCE}' as trigger_source,
  cast(to_json({{'failed_task_key': failed_task_key, 'failed_task_run_id': coalesce(cast(task_run_id as varchar), ''),
    'failure_code_path': failure_code_path, 'slack_channel': '{V.DEFAULT_CHANNEL}', 'source_job_id': source_job_id,
    'source_job_name': source_job_name, 'source_run_id': source_run_id, 'trigger_source': '{V.TRIGGER_SOURCE}'}}) as varchar) as payload_json,
  {iso('event_ts')} as created_at
from cases"""

SQL["stream_failed_runs"] = with_tables("runs", "heads") + """
select event_id, run_id, job_id, failed_task_key, false as is_fallback from heads"""

# Text ------------------------------------------------------------------------------------------

SQL["truncate_text"] = f"""
select doc_id, {cut('text', V.ERROR_DESCRIPTION_LIMIT)} as description, {cut('text', V.RUN_OUTPUT_LIMIT)} as output
from documents"""

SQL["discover_table_refs"] = f"select page_id, array_to_string({refs('html')}, ',') as refs from pages"

SQL["table_refs_in_documents"] = f"""
select ref, count(*) as documents from (select unnest({refs('text')}) as ref from documents) group by ref"""

SQL["text_scalars"] = f"""
select conv_id, turn, trim(text, e' \\n\\t\\r') as stripped, lower(role) as role_lower,
  regexp_extract('a {{' || text || '}} b', '(?s)\\{{.*\\}}') as braces,
  left(text, {V.FALLBACK_SUMMARY_LIMIT}) as prefix,
  {iso("make_timestamp(1700000000000000 + turn * 250000)")} as iso,
  cast(cast(date '2024-01-01' + cast(turn as integer) - 1 as date) as varchar) as day_before,
  case when turn = 0 then '[]' else '["' || role || '"]' end as paths,
  case when role = 'user' then 'nobody' else role end as speaker
from conversations"""

# Table snapshots -------------------------------------------------------------------------------

CTES["page_refs"] = f"select page_id, unnest({refs('html')}) as table_name from pages"

CTES["table_columns"] = """
  select table_name, ordinal, 'c' || ordinal as col_name,
    case when ordinal % 2 = 0 then 'double' else 'string' end as data_type,
    case when ordinal = 1 then 'key' end as comment
  from (select table_name, unnest(range(1, first_page % 3 + 2)) as ordinal
        from (select table_name, min(page_id) as first_page from page_refs where left(md5(table_name), 1) < 'c' group by table_name)
        union all
        select 'lake.sales.t' || c_custkey, unnest(range(1, c_custkey % 4 + 2)) from customer)"""

CTES["table_history"] = """
  select table_name, page_id as version, make_timestamp(page_id * 60 * 1000000) as ts, 'WRITE' as operation,
    'writer_' || (page_id % 3) as user_name from page_refs
  union all
  select 'lake.sales.t' || o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority from orders"""

CTES["table_docs"] = f"""
  select table_name, cast({dropped("{'detail': coalesce(details, []), 'missing_parts': case when len(missing) > 0 then missing end, 'recent_history': coalesce(entries, []), 'schema': coalesce(columns, []), 'table': table_name}")} as varchar) as table_json
  from (select table_name, columns, entries, details,
          list_filter([case when details is null then 'detail' end, case when entries is null then 'recent_history' end,
                       case when columns is null then 'schema' end], lambda x: x is not null) as missing
        from (select table_name, list({dropped("{'col_name': col_name, 'comment': comment, 'data_type': data_type}")} order by ordinal) as columns
              from table_columns group by table_name)
        full join (select table_name, list({dropped("{'operation': operation, 'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'user_name': user_name, 'version': version}")} order by rank) as entries
              from (select *, row_number() over (partition by table_name order by version desc, ts desc, operation desc) as rank from table_history)
              where rank <= {V.MAX_HISTORY_PER_TABLE} group by table_name) using (table_name)
        full join (select 'lake.sales.t' || c_custkey as table_name,
                     [to_json({{'format': 'parquet', 'location': '/lake/sales/t' || c_custkey, 'num_files': c_nationkey, 'partition_columns': ['day']}})] as details from customer) using (table_name))"""

TABLES = ["page_refs", "table_columns", "table_history", "table_docs"]

SQL["recent_history_top5"] = """
select table_name, cast(rank as integer) as rank, version, operation, day
from (select *, row_number() over (partition by table_name order by version desc, ts desc, operation desc) as rank
      from (select 'lake.parts.p' || l_partkey as table_name, l_orderkey * 10 + l_linenumber as version,
              l_shipdate as ts, l_returnflag as operation, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem))
where rank <= 5"""

SQL["ref_schema_join"] = with_tables(*TABLES) + """
select page_id, table_name, table_json from page_refs left join table_docs using (table_name)"""

# Evidence --------------------------------------------------------------------------------------

CTES["source_code"] = """
  select '/jobs/page_' || page_id as path, html as source from pages
  union all
  select '/src/etl_' || doc_id || '.py', text from documents"""

CTES["codes"] = f"""
  select event_id, path, source, cast({dropped("{'error': error, 'path': path, 'source': source, 'warning': warning}")} as varchar) as doc
  from (select event_id, nullif(failure_code_path, '') as path, {cut('s.source', V.SOURCE_CODE_LIMIT)} as source_text,
          case when s.path is not null then {cut('s.source', V.SOURCE_CODE_LIMIT)} end as source,
          case when failure_code_path <> '' and s.path is null
               then 'LookupError: no source recorded for ' || failure_code_path end as error,
          case when failure_code_path = '' then {lit(V.NO_CODE_PATH)} end as warning
        from cases left join source_code s on s.path = nullif(failure_code_path, ''))"""

_STRAY = lit("\ufffd")
_BROKEN = f"{_STRAY} || left(s.source, length(s.source) // 2) || {_STRAY} || s.source[length(s.source) // 2 + 1:] || {_STRAY}"

SQL["source_bytes"] = with_tables(*CASES, "source_code") + f"""
select event_id, cast({dropped("{'error': error, 'path': path, 'source': source, 'warning': warning}")} as varchar) as evidence_json
from (select event_id, nullif(failure_code_path, '') as path, case when s.path is not null then {cut(_BROKEN, V.SOURCE_CODE_LIMIT)} end as source,
        case when failure_code_path <> '' and s.path is null
             then 'LookupError: no source recorded for ' || failure_code_path end as error,
        case when failure_code_path = '' then {lit(V.NO_CODE_PATH)} end as warning
      from cases left join source_code s on s.path = nullif(failure_code_path, ''))"""

_TASK_JSON = dropped("t")
_JOB_JSON = dropped(
    "{'creator': creator, 'settings': {'name': name, 'schedule': schedule, "
    f"'tasks': list_transform(setting_tasks, lambda t: {_TASK_JSON})}}}}"
)
_RUN_JSON = dropped(
    "{'job_id': cast(source_job_id as bigint), 'run_id': cast(source_run_id as bigint), 'run_name': run_name, "
    f"'run_page_url': 'https://runs.example/' || source_run_id, 'tasks': list_transform(tasks, lambda t: {_TASK_JSON})}}"
)
_ALL_RUNS = "(select *, cast(job_id as varchar) as source_job_id, cast(run_id as varchar) as source_run_id from runs)"

SQL["run_documents"] = with_tables("runs") + f"""
select run_id, job_id, run_name, cast(len(tasks) as integer) as n_tasks, document,
  array_to_string({refs(leaves('document'))}, ',') as refs
from (select *, cast({_RUN_JSON} as varchar) as document from {_ALL_RUNS})"""

SQL["settings_documents"] = with_tables("settings") + f"""
select job_id, document, array_to_string(list_transform(setting_tasks, lambda t: t.task_key), ',') as task_keys,
  array_to_string(list_transform(setting_tasks, lambda t: cast({_TASK_JSON} as varchar)), e'\\n') as task_documents,
  array_to_string({refs(leaves('document'))}, ',') as refs
from (select *, cast({_JOB_JSON} as varchar) as document from (select *, tasks as setting_tasks from settings))"""

SQL["repeated_deliveries"] = with_tables("runs", "heads") + f"""
select source_job_id, source_run_id, event_id, 'delivered again: ' || surplus as reason, md5(delivered) as digest
from (select *, unnest([{{'delivered': document, 'surplus': least(copies, 2) - case when copies = 2 then 1 else 0 end}},
                        {{'delivered': '{{"added":1,' || document[2:], 'surplus': copies - 3}}], recursive := true)
      from (select source_job_id, source_run_id, event_id, copies, cast({_RUN_JSON} as varchar) as document
            from (select *, cast(job_id as varchar) as source_job_id, cast(run_id as varchar) as source_run_id,
                    2 + run_id // 30 % 3 as copies
                  from heads where run_id // 10 % 3 = 0)))
where surplus > 0"""


def damaged(text: str, number: str) -> str:
    return f"""(case ({number}) % 7 when 1 then left({text}, length({text}) // 2) when 2 then '[' || {text} || ']'
      when 3 then {text} || ' and more' when 4 then null else {text} end)"""


def fault(text: str) -> str:
    """Why a text isn't one JSON object."""
    kind = f"json_type(case when json_valid({text}) then {text} end)"
    return f"""(case when {text} is null then 'no document' when not json_valid({text}) then 'not JSON'
      when {kind} <> 'OBJECT' then 'not an object but ' || lower({kind}) end)"""


_OUTPUT_JSON = dropped(
    "{'error': case when event_id % 3 <> 0 then " + _TEXTS + "[event_id % 8 + 1] end, "
    "'logs': 'read \"raw\".orders.day_' || (user_id % 20) || chr(10) || 'done', "
    "'attempt': case when event_id % 4 = 1 then event_id % 3 end, "
    "'notebook_output': case when event_id % 2 = 0 then {'result': 'cell ' || event_id, 'truncated': false} end}"
)
CTES["damaged_texts"] = f"""
  select *, {fault("details")} as fault, case when {fault("details")} is null then details end as object from (
    select 'run' as kind, null as outer_job, null as outer_run, {damaged("details", "run_id // 10")} as details
    from (select run_id, cast({_RUN_JSON} as varchar) as details from {_ALL_RUNS})
    union all
    select 'settings', cast(job_id as varchar), null, {damaged("details", "job_id")}
    from (select job_id, cast({_JOB_JSON} as varchar) as details from (select *, tasks as setting_tasks from settings))
    union all
    select 'output', null, cast(event_id * 10 as varchar), {damaged("details", "event_id")}
    from (select event_id, cast({_OUTPUT_JSON} as varchar) as details from events))"""

_TOLD = " || '|' || ".join(f"coalesce(object ->> '$.{name}', '-')" for name in ("error", "logs", "notebook_output"))

SQL["unreadable_documents"] = with_tables("runs", "settings", "damaged_texts") + f"""
select kind, coalesce(outer_job, object ->> '$.job_id') as source_job_id,
  coalesce(outer_run, object ->> '$.run_id') as source_run_id,
  case kind when 'run' then cast(json_array_length(object, '$.tasks') as varchar) when 'settings' then object ->> '$.settings.name'
    else {_TOLD} || '|' || coalesce('{{"attempt":' || (object ->> '$.attempt') || '}}', '-') end as said,
  null as reason, null as digest
from damaged_texts where fault is null
union all
select 'reject', outer_job, outer_run, null, 'unreadable ' || kind || ': ' || fault, md5(details)
from damaged_texts where fault is not null"""

CTES["documents_of"] = f"""
  select event_id, cast({_RUN_JSON} as varchar) as run_json,
    case when has_settings then cast({_JOB_JSON} as varchar) else '{{}}' end as job_json
  from cases"""

CTES["event_refs"] = f"""
  select event_id, list_sort(list_distinct(flatten([
      {refs(leaves('run_json'))},
      {refs(leaves('job_json'))},
      {refs("concat_ws(e'\\n', o.error, o.logs, o.notebook_output, o.output_json)")},
      {refs("concat_ws(e'\\n', codes.path, codes.source)")}
    ]))) as refs
  from cases join documents_of using (event_id) join (select * from output_docs where ord = 5) o using (event_id)
    join codes using (event_id)"""

CTES["evidence"] = f"""
  select event_id, 1 as ord, '' as detail, 'job_run' as collector_name, run_json as evidence_json from documents_of
  union all
  select event_id, 2, '', 'job_settings', job_json from documents_of
  union all
  select event_id, 3, '', 'failed_task_settings',
    case when task_settings is null then '{{}}' else cast({dropped('task_settings')} as varchar) end from cases
  union all
  select event_id, ord, '', case ord when 4 then 'root_run_output' else 'failed_task_output' end, doc from output_docs
  union all
  select event_id, 6, '', 'failure_code', doc from codes
  union all
  select event_id, 7, ref, 'discovered_table_schema',
    coalesce(table_json, cast(to_json({{'error': 'LookupError: no snapshot of table ' || ref, 'table': ref}}) as varchar))
  from (select event_id, unnest(refs[1:{V.MAX_TABLES_PER_EVENT}]) as ref from event_refs) left join table_docs on table_name = ref
  union all
  select event_id, 8, '', 'error_summary',
    cast(to_json({{'error_description': error_description, 'error_type': error_type}}) as varchar) from summaries"""

REFS = [*OUTPUTS, "source_code", "codes", "documents_of", "event_refs"]
EVIDENCE = [*REFS, *TABLES, "evidence"]

SQL["refs_per_event_top10"] = with_tables(*REFS) + f"""
select event_id, cast(len(refs) as integer) as n_refs, array_to_string(refs[1:{V.MAX_TABLES_PER_EVENT}], ',') as top_refs from event_refs"""

SQL["evidence_rows"] = with_tables(*EVIDENCE) + "select event_id, collector_name, detail, evidence_json from evidence"

CTES["bundles"] = f"""
  select event_id, string_agg(collector_name, ',' order by ord, detail) as collectors,
    cast(to_json(list({{'collector_name': collector_name, 'evidence_json_excerpt': {cut('evidence_json', V.PROMPT_EXCERPT_LIMIT)}}}
      order by ord, detail)) as varchar) as evidence_bundle_json
  from evidence group by event_id"""

SQL["evidence_bundle_order"] = with_tables(*EVIDENCE, "bundles") + """
select event_id, collectors, cast(length(evidence_bundle_json) as integer) as bundle_chars from bundles"""

# Prompts ---------------------------------------------------------------------------------------

CTES["part_prompts"] = """
  select p_type as prompt_name, p_brand as prompt_alias, cast(p_size as varchar) as prompt_version,
    case p_partkey % 3 when 0 then 'true' when 1 then 'TRUE' else 'false' end as is_active,
    case p_partkey % 5 when 0 then '' when 1 then '0.25' when 2 then '1e-1' when 3 then 'warm' end as temperature,
    case p_partkey % 4 when 0 then '' when 1 then '800' when 2 then ' 900 ' else 'many' end as max_tokens,
    '2026-01-' || lpad(cast(1 + p_partkey % 28 as varchar), 2, '0') as updated_at,
    'part ' || p_partkey as notes, p_partkey as part_key
  from part"""


def _active(order: str) -> str:
    return with_tables("part_prompts") + f"""
select prompt_name, prompt_alias, prompt_version, updated_at, notes
from (select *, row_number() over (partition by prompt_name, prompt_alias order by {order}) as rn
      from part_prompts where lower(is_active) = 'true')
where rn = 1"""


SQL["active_prompt"] = _active("updated_at desc, prompt_version desc, part_key desc")
SQL["active_prompt_numeric"] = _active("cast(prompt_version as integer) desc, updated_at desc, part_key desc")

SQL["prompt_seed_missing"] = with_tables("part_prompts") + """
select distinct prompt_name, prompt_alias, '2' as prompt_version from part_prompts p
where not exists (select 1 from part_prompts q where q.prompt_name = p.prompt_name and q.prompt_alias = p.prompt_alias
  and lower(q.is_active) = 'true' and try_cast(q.prompt_version as integer) >= 48)"""

SQL["prompt_numeric_defaults"] = with_tables("part_prompts") + """
select part_key, t as temperature, m as max_tokens,
  case when t is null then 'malformed temperature' when m is null then 'malformed max_tokens' end as settings_error
from (select part_key, try_cast(coalesce(nullif(temperature, ''), '0.1') as double) as t,
        try_cast(coalesce(nullif(max_tokens, ''), '1600') as bigint) as m from part_prompts)"""

SQL["required_key_split"] = """
select order_key, source_job_id, source_run_id,
  'required: ' || nullif(concat_ws(', ', case when source_job_id is null then 'source_job_id' end,
                                   case when source_run_id is null then 'source_run_id' end), '') as reason
from (select o_orderkey as order_key, nullif(o_orderpriority, '5-LOW') as source_job_id,
        nullif(o_orderstatus, 'P') as source_run_id from orders)"""


def _filled_template() -> str:
    """The default template as a SQL concatenation."""
    text = lit(V.DEFAULT_USER_TEMPLATE)
    values = {name: name for name in V.PROMPT_PLACEHOLDERS}
    values["failed_task_run_id"] = "coalesce(cast(task_run_id as varchar), '')"
    values["discovered_code_paths"] = "case when failure_code_path = '' then '[]' else cast(to_json([failure_code_path]) as varchar) end"
    values["discovered_tables"] = "cast(to_json(refs) as varchar)"
    for name, value in values.items():
        text = text.replace("{" + name + "}", f"' || {value} || e'")
    return text


SQL["render_prompt"] = with_tables(*EVIDENCE, "bundles") + f"""
select event_id, '{V.DEFAULT_PROMPT_NAME}' as prompt_name, '{V.DEFAULT_PROMPT_ALIAS}' as prompt_alias,
  '{V.DEFAULT_PROMPT_VERSION}' as prompt_version, '{V.DEFAULT_MODEL_ENDPOINT}' as model_endpoint,
  cast(0.1 as double) as temperature, cast(1600 as bigint) as max_tokens, {lit(V.DEFAULT_SYSTEM_PROMPT)} as system_prompt,
  {_filled_template()} as user_prompt
from cases join bundles using (event_id) join event_refs using (event_id)"""

SQL["stream_analysis"] = f"""
select e.*, n_evidence, evidence_chars, md5(user_prompt) as prompt_md5
from ({SQL['event_rows']}) e
left join ({with_tables(*EVIDENCE)} select event_id, count(*) as n_evidence, cast(sum(length(evidence_json)) as bigint) as evidence_chars
           from evidence group by event_id) using (event_id)
left join ({SQL['render_prompt']}) using (event_id)"""

# Reports ---------------------------------------------------------------------------------------


def answer(form: str, said: str) -> str:
    body = (
        "('{\"title\": \"T\", \"error_type\": \"DATA\", \"error_description\": ' || cast(to_json(" + said + ") as varchar) || "
        "', \"possible_fixes\": [\"check input\", \"rerun\", null, \"page owner\"], \"confidence\": \"high\","
        " \"likely_root_cause\": \"late feed\", \"evidence\": [{\"line\": 1}],"
        " \"databricks_links\": \"[\\\"a\\\", \\\"b\\\", \\\"c\\\"]\"}')"
    )
    return f"""(case {form}
      when 0 then {body}
      when 1 then '```json' || e'\\n' || {body} || e'\\n```'
      when 2 then 'Here it is: ' || {body} || ' - as asked.'
      when 3 then '[' || {body} || ']'
      when 4 then '{{''title'': ''single quotes''}}'
      when 5 then {said}
      when 6 then e'\\n ' || '{{"error_type": "", "possible_fixes": "restart", "recommended_fix": "restart twice", "owner_next_steps": ["ask"], "confidence": null, "missing_context": [{{"log": 1, "log": 2}}]}}' || e'\\t'
      else '{{"primary_error": "boom", "possible_fixes": [], "owner_next_steps": ["ask owner"], "evidence": 0}}' end)"""


def fixed_report(values: dict, **per_event: str) -> str:
    fields = dict(per_event)
    for name, value in values.items():
        fields[name] = "[" + ", ".join(lit(v) for v in value) + "]" if isinstance(value, list) else lit(value)
    listed = ", ".join(f"'{name}': {fields[name]}" for name in sorted(fields))
    return f"cast(to_json({{{listed}}}) as varchar)"


def parsed(source: str, columns: str) -> str:
    """Rows of ``source`` with report_source and report_json read from its column ``content``."""
    fixed = fixed_report(
        V.NON_JSON_REPORT,
        summary=f"left(stripped, {V.FALLBACK_SUMMARY_LIMIT})",
        failed_job="source_job_name",
        failed_task="failed_task_key",
    )
    return f"""
  select {columns}, kind as report_source,
    case kind when 'whole' then cast(json(stripped) as varchar) when 'inner' then cast(json(inside) as varchar) else {fixed} end as report_json
  from (select *, case when json_valid(stripped) then (case when json_type(stripped) = 'OBJECT' then 'whole' else 'fixed' end)
                       when json_valid(inside) then 'inner' else 'fixed' end as kind
        from (select *, regexp_extract(stripped, '(?s)\\{{.*\\}}') as inside
              from (select *, trim(content, e' \\n\\t\\r') as stripped from {source})))"""


def j(field: str) -> str:
    return f"json_extract(report_json, '$.{field}')"


def truthy(field: str) -> str:
    return f"(case when cast({j(field)} as varchar) not in ('null', '\"\"', '[]', '{{}}', 'false', '0') then {j(field)} end)"


def truthy_text(field: str) -> str:
    return f"({truthy(field)} ->> '$')"


def text_lines(text: str) -> str:
    return (
        f"(case when json_valid({text}) and case when json_valid({text}) then json_type({text}) end = 'ARRAY' "
        f"then list_transform(json_extract({text}, '$[*]'), lambda x: coalesce(x ->> '$', 'None')) "
        f"when coalesce({text}, '') <> '' then [{text}] else [] end)"
    )


def value_lines(value: str) -> str:
    return (
        f"(case json_type({value}) when 'ARRAY' then list_transform(json_extract({value}, '$[*]'), lambda x: coalesce(x ->> '$', 'None')) "
        f"when 'VARCHAR' then {text_lines('(' + value + " ->> '$')")} "
        f"when 'NULL' then [] else case when {value} is null then [] else [cast({value} as varchar)] end end)"
    )


def fields_of(source: str) -> str:
    texts = ["error_type", "error_description", "primary_error", "likely_root_cause", "recommended_fix", "confidence"]
    shown = ", ".join(
        f"case when {j(n)} is null then null else coalesce({j(n)} ->> '$', 'None') end as {n}_shown"
        for n in ("error_type", "confidence")
    )
    return f"""
  select *, {', '.join(f'{truthy_text(n)} as model_{n}' for n in texts)}, {shown},
    cast(coalesce({truthy('possible_fixes')}, {truthy('owner_next_steps')}, '[]') as varchar) as possible_fixes,
    cast(coalesce({truthy('evidence')}, '[]') as varchar) as evidence_list,
    cast(coalesce({truthy('missing_context')}, '[]') as varchar) as missing_context,
    {value_lines(f"coalesce({truthy('possible_fixes')}, {j('recommended_fix')})")} as fix_lines,
    {value_lines(j('databricks_links'))} as link_lines
  from {source}"""


CTES["answers"] = f"""
  select *, {answer('(conv_id + turn) % 8', 'text')} as content, conv_id || ':' || turn as event_id,
    cast(conv_id as varchar) as source_job_id, cast(turn as varchar) as source_run_id,
    case when turn % 2 = 0 then 'talk ' || conv_id else '' end as source_job_name, 'task_' || turn as failed_task_key
  from conversations where role = 'assistant'"""

SQL["strict_json_kinds"] = with_tables("answers") + """
select conv_id, turn, case when json_valid(content) then
  case json_type(content) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
    when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end end as kind
from answers"""

CTES["talks"] = parsed(
    "answers", "event_id, conv_id, turn, source_job_id, source_run_id, source_job_name, failed_task_key"
)
CTES["talk_fields"] = fields_of("talks")
TALKS = ["answers", "talks", "talk_fields"]

SQL["parse_report"] = with_tables("answers", "talks") + "select event_id, report_source, report_json from talks"

_BULLETS = (
    f"case when len({{0}}) > 0 then array_to_string(list_transform({{0}}[1:{V.MAX_FIXES}], lambda x: '- ' || x), e'\\n') "
    f"else {lit(V.NO_FIXES_LINE)} end"
)
_LINKS = (
    f"case when len({{0}}) > 0 then array_to_string({{0}}[1:{V.MAX_LINKS}], e'\\n') else {lit(V.NO_LINKS_LINE)} end"
)

SQL["as_lines"] = f"""
select conv_id, turn, cast(len(items) as integer) as n_lines, {_BULLETS.format('items')} as fixes, {_LINKS.format('items')} as links
from (select *, {text_lines('lines')} as items
      from (select conv_id, turn, case turn % 3 when 0 then cast(to_json(['first', text, 'third', 'fourth']) as varchar)
                when 1 then text else '' end as lines from conversations))"""


def _message() -> str:
    parts = [
        lit(V.MESSAGE_HEADER + "\nJob: "), "coalesce(nullif(source_job_name, ''), source_job_id)",
        lit("\nRun: "), "source_run_id", lit("\nFailed task: "), "failed_task_key",
        lit("\nError type: "), "coalesce(error_type_shown, 'UNKNOWN')",
        lit("\nConfidence: "), "coalesce(confidence_shown, 'unknown')",
        lit("\n\nError:\n"), cut("coalesce(model_error_description, model_primary_error)", V.MESSAGE_ERROR_LIMIT),
        lit("\n\nLikely root cause:\n"), cut("model_likely_root_cause", V.MESSAGE_CAUSE_LIMIT),
        lit("\n\nPossible fixes:\n"), _BULLETS.format("fix_lines"), lit("\n\nLinks:\n"), _LINKS.format("link_lines"),
        lit("\n"),
    ]
    return " || ".join(f"({part})" for part in parts)


SQL["notification_text"] = with_tables(*TALKS) + f"""
select event_id, '{V.DEFAULT_CHANNEL}' as channel, {_message()} as text from talk_fields"""


def _block(kind: str, text: str) -> str:
    return f"to_json({{'text': {{'text': {text}, 'type': 'mrkdwn'}}, 'type': '{kind}'}})"


_FACTS = (
    "concat('*Job:* `', coalesce(nullif(source_job_name, ''), source_job_id), e'`\\n*Run:* `', source_run_id, "
    "e'`\\n*Failed task:* `', failed_task_key, e'`\\n*Error type:* `', coalesce(error_type_shown, 'UNKNOWN'), "
    "e'`\\n*Confidence:* `', coalesce(confidence_shown, 'unknown'), '`')"
)



def _blocks() -> str:
    return f"""cast(to_json([
  to_json({{'text': {{'text': {lit(V.MESSAGE_HEADER)}, 'type': 'plain_text'}}, 'type': 'header'}}),
  {_block('section', _FACTS)},
  {_block('section', lit('*Likely root cause:*' + chr(10)) + ' || ' + cut('model_likely_root_cause', V.BLOCK_CAUSE_LIMIT))},
  {_block('section', lit('*Possible fixes:*' + chr(10)) + ' || ' + _BULLETS.format('fix_lines'))},
  to_json({{'elements': [{{'text': '*Links:* ' || {_LINKS.format('link_lines')}, 'type': 'mrkdwn'}}], 'type': 'context'}})
]) as varchar)"""


SQL["notification_blocks"] = with_tables(*TALKS) + f"select event_id, {_blocks()} as blocks_json from talk_fields"

# Delivery: the outcome is worked out from the attempts of each form.


def _last_attempts() -> str:
    forms = []
    for i, rows in enumerate(samples.ATTEMPT_FORMS):
        if rows:
            forms.append(f"select {i} as form, * from (values {rows}) a(kind, attempt, ok, http_status, body, error)")
    last = ", ".join(
        f"arg_max({{'ok': ok, 'http': cast(http_status as integer), 'body': replace(body, '\\n', chr(10)), 'error': cast(error as varchar)}}, "
        f"attempt) filter (kind = '{kind}') as {kind}"
        for kind in ("helper", "api", "webhook")
    )
    every = " union all ".join(forms)
    return f"select f.form, a.* exclude (form) from range({len(samples.ATTEMPT_FORMS)}) f(form) left join (select form, {last} from ({every}) group by form) a on a.form = f.form"


def _http_failed(name: str) -> str:
    return f"coalesce({name}.http, 200) not between 200 and 299"


_API_OK = f"(api.error is null and not {_http_failed('api')} and coalesce(api.ok, (api.body ->> '$.ok') = 'true', false))"
_HOOK_OK = f"(webhook.error is null and not {_http_failed('webhook')} and lower(trim(coalesce(webhook.body, ''), e' \\n\\t\\r')) = 'ok')"
_API_ERROR = f"""case when api.error is not null then api.error
    when {_http_failed('api')} then 'HTTPError ' || api.http || ': ' || {cut('api.body', V.RESPONSE_BODY_LIMIT)}
    else coalesce(nullif(api.body ->> '$.error', ''), api.body, '') end"""
_HOOK_ERROR = f"""case when webhook.error is not null then 'Webhook ' || webhook.error
    when {_http_failed('webhook')} then 'Webhook HTTPError ' || webhook.http || ': ' || {cut('webhook.body', V.RESPONSE_BODY_LIMIT)}
    else 'Unexpected webhook response: ' || {cut('webhook.body', V.RESPONSE_BODY_LIMIT)} end"""

_OUTCOMES = f"""
  select form, status as slack_notification_status,
    coalesce(case when status = '{V.STATUS_SENT}' then nullif(api.body ->> '$.channel', '') end, '{V.DEFAULT_CHANNEL}') as slack_channel_id,
    coalesce(case when status = '{V.STATUS_SENT}' then nullif(api.body ->> '$.ts', '') end, '') as slack_message_ts,
    case when status in ('{V.STATUS_HELPER}', '{V.STATUS_SENT}', '{V.STATUS_WEBHOOK}') then ''
      when status in ('{V.STATUS_NOT_IN_CHANNEL}', '{V.STATUS_CHANNEL_NOT_FOUND}') then said
      when status = '{V.STATUS_FAILED}' then said || '; fallback ' || case when api is not null then {_API_ERROR} else {_HOOK_ERROR} end
      else said || '; no token; no webhook' end as slack_error
  from (select *,
          case when coalesce(helper.ok, false) then '{V.STATUS_HELPER}'
            when contains(said, 'not_in_channel') then '{V.STATUS_NOT_IN_CHANNEL}'
            when contains(said, 'channel_not_found') then '{V.STATUS_CHANNEL_NOT_FOUND}'
            when api is not null then case when {_API_OK} then '{V.STATUS_SENT}' else '{V.STATUS_FAILED}' end
            when webhook is not null then case when {_HOOK_OK} then '{V.STATUS_WEBHOOK}' else '{V.STATUS_FAILED}' end
            else '{V.STATUS_SKIPPED}' end as status
        from (select *, 'helper failed: ' || coalesce(helper.error, 'no attempt recorded') as said from ({_last_attempts()})))"""


def delivery(number: str) -> str:
    """The four delivery columns for the form ``number`` % 8."""
    names = ["slack_notification_status", "slack_channel_id", "slack_message_ts", "slack_error"]
    return ", ".join(
        f"(select list({name} order by form) from ({_OUTCOMES}))[({number}) % {len(samples.ATTEMPT_FORMS)} + 1] as {name}" for name in names
    )


SQL["delivery_status"] = f"select cast(event_id as varchar) as event_id, {delivery('event_id')} from events"


def report_columns(created: str) -> str:
    metadata = "to_json({'model_endpoint': model_endpoint, 'prompt_alias': prompt_alias, 'prompt_name': prompt_name, 'prompt_version': prompt_version})"
    result = "to_json({'channel_id': slack_channel_id, 'error': slack_error, 'message_ts': slack_message_ts, 'status': slack_notification_status})"
    return f"""event_id, source_job_id, source_run_id, source_job_name, failed_task_key, failed_task_run_id,
  coalesce(model_error_type, rule_type) as error_type,
  coalesce(model_error_description, model_primary_error, rule_description) as error_description,
  coalesce(model_likely_root_cause, '') as likely_root_cause, possible_fixes,
  coalesce(model_recommended_fix, '') as recommended_fix, coalesce(model_confidence, '') as confidence,
  evidence_list as evidence_json, missing_context,
  left(report_json, length(report_json) - 1) || ',"prompt_metadata":' || cast({metadata} as varchar)
    || ',"slack_notification":' || cast({result} as varchar) || '}}' as report_json,
  {created} as created_at, slack_channel_id, slack_notification_status, slack_message_ts, slack_error"""


SQL["report_rows"] = with_tables(*TALKS) + f"""
select {report_columns(iso("make_timestamp((1700000000 + turn) * 1000000)"))}
from (select *, {delivery('conv_id + turn')}, '' as failed_task_run_id, 'RULE' as rule_type, 'by rule' as rule_description,
        'prompt_name' as prompt_name, 'prompt_alias' as prompt_alias, 'prompt_version' as prompt_version,
        'model_endpoint' as model_endpoint from talk_fields)"""

CTES["responses"] = f"""
  select event_id, n, {answer('n % 8', "said")} as content,
    case when n % 10 = 0 then 'TimeoutError: no answer for run ' || n end as error
  from (select *, 'run ' || n || ' of "' || source_job_name || '"' as said
        from (select *, cast(source_run_id as bigint) // 10 as n from cases))
  where source_job_name <> ''"""

SQL["response_content"] = with_tables(*CASES, "responses") + "select event_id, content from responses"

CTES["answered"] = """
  select c.event_id, c.source_job_id, c.source_run_id, c.source_job_name, c.failed_task_key,
    coalesce(cast(c.task_run_id as varchar), '') as failed_task_run_id, c.event_ts, coalesce(r.content, '') as content,
    case when r.event_id is null then 'LookupError: no model response recorded' else r.error end as call_error
  from cases c left join responses r using (event_id)"""

CTES["parsed_answers"] = parsed(
    "answered",
    "event_id, source_job_id, source_run_id, source_job_name, failed_task_key, failed_task_run_id, event_ts, call_error",
)

_CALL_FAILED = fixed_report(
    V.CALL_FAILED_REPORT,
    failed_job="source_job_name",
    failed_task="failed_task_key",
    primary_error="call_error",
    error_description="call_error",
)
CTES["model_reports"] = f"""
  select * replace (case when call_error is not null then {_CALL_FAILED} else report_json end as report_json)
  from parsed_answers"""
CTES["report_fields"] = fields_of("model_reports")

SQL["analysis_reports"] = (
    with_tables(*OUTPUTS, "responses", "answered", "parsed_answers", "model_reports", "report_fields")
    + f"""
select {report_columns(iso('event_ts'))}
from (select *, {delivery('cast(source_run_id as bigint) // 10')}, s.error_type as rule_type, s.error_description as rule_description,
        '{V.DEFAULT_PROMPT_NAME}' as prompt_name, '{V.DEFAULT_PROMPT_ALIAS}' as prompt_alias,
        '{V.DEFAULT_PROMPT_VERSION}' as prompt_version, '{V.DEFAULT_MODEL_ENDPOINT}' as model_endpoint
      from report_fields join summaries s using (event_id))"""
)

SQL["stream_reports"] = SQL["analysis_reports"]

ANALYSED = [*EVIDENCE, "responses", "answered", "parsed_answers", "model_reports", "report_fields"]


def content(name: str, columns: list[str], source: str) -> str:
    """Number of rows and sum over the digests of all columns of a source."""
    whole = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in columns)
    number = f"cast('0x' || left(md5(concat_ws('|', {whole})), 8) as bigint)"
    return f"select '{name}' as table_name, count(*) as n_rows, cast(coalesce(sum({number}), 0) as bigint) as content from ({source})"


def _columns(schema) -> list[str]:
    return [name for name in schema.fieldNames() if name != "case_id"]


def _sink_round_trip() -> str:
    result = "cast(to_json({'channel_id': slack_channel_id, 'error': slack_error, 'message_ts': slack_message_ts, 'status': slack_notification_status}) as varchar)"
    told = f"(select event_id, {delivery('cast(source_run_id as bigint) // 10')} from cases)"
    evidence = with_tables(*EVIDENCE) + f"""
  select event_id, source_job_id, source_run_id, collector_name, evidence_json, {iso('event_ts')} as created_at
  from (select event_id, collector_name, evidence_json from evidence
        union all select event_id, 'slack_notification', {result} from {told}) join cases using (event_id)"""
    notes = with_tables(*ANALYSED) + f"""
  select event_id, '{V.DEFAULT_CHANNEL}' as channel, {_message()} as text, {_blocks()} as blocks_json from report_fields"""
    second = lit(samples.SECOND_ANSWER)
    rejects = with_tables(*CASES, "responses") + f"""
  select source_job_id, source_run_id, event_id, 'answered again: 1' as reason,
    md5(case when n % 5 = 0 then {second} else coalesce(error, content) end) as digest
  from responses join cases using (event_id) where n % 5 = 0 or n % 7 = 0"""
    prompts = with_tables("part_prompts") + f"""
  select prompt_name, prompt_alias, prompt_version, is_active, model_endpoint, temperature, max_tokens,
    'Explain the failure.' as system_prompt, {lit(samples.PART_TEMPLATE)} as user_prompt_template, notes
  from part_prompts join (select p_partkey as part_key, p_name as model_endpoint from part) using (part_key)
  union all
  select {', '.join(map(lit, DEFAULT_PROMPT.values()))}"""
    sources = [
        ("events", _columns(schemas.EVENTS), SQL["event_rows"]),
        ("evidence", _columns(schemas.EVIDENCE), evidence),
        ("reports", _columns(schemas.REPORTS), SQL["analysis_reports"]),
        ("prompt_requests", _columns(schemas.PROMPT_REQUESTS), SQL["render_prompt"]),
        ("notifications", _columns(schemas.NOTIFICATIONS), notes),
        ("rejects", _columns(schemas.REJECTS), rejects),
        ("prompts", list(DEFAULT_PROMPT), prompts),
        ("snapshot", ["region"], "select r_name as region from region where r_name <> 'ASIA'"),
        ("dropped", ["x"], "select 1 as x where false"),
        ("events before the commit", ["x"], "select 1 as x where false"),
    ]
    return "\nunion all\n".join(content(*source) for source in sources)


_VIEW = """select o_custkey || ':' || o_orderkey as event_id, cast(o_custkey as varchar) as source_job_id,
    cast(o_orderkey as varchar) as source_run_id, {created} as created_at, o_orderpriority as error_type,
    'order ' || o_orderkey as error_description, 'status ' || o_orderstatus as likely_root_cause,
    '["retry ' || o_orderkey || '"]' as possible_fixes, 'retry' as recommended_fix, 'low' as confidence,
    'C1' as slack_channel_id, 'sent' as slack_notification_status, cast(o_orderkey as varchar) as slack_message_ts,
    '' as slack_error from orders""".format(created=iso("(o_orderdate + to_microseconds(o_orderkey))"))

SQL["latest_report"] = f"""
select * exclude (source_job_id) from ({_VIEW}) order by created_at desc limit 1"""

SQL["latest_report_per_job"] = f"""
select * exclude (rn) from (select *, row_number() over (partition by source_job_id order by created_at desc) as rn from ({_VIEW}))
where rn = 1"""

# Health ----------------------------------------------------------------------------------------

AS_OF = "date '2001-08-01'"

SQL["feed_freshness"] = f"""
select n_nationkey as vendor_id, cast(count_if(d = {AS_OF}) as bigint) as rows_on_day, cast(max(d) as varchar) as newest_day,
  cast(date_diff('day', max(d), {AS_OF}) as integer) as lag_days,
  case when count_if(d = {AS_OF}) = 0 then 'feed ' || n_nationkey || ' is empty on 2001-08-01'
    || coalesce('; its last rows are of ' || max(d), '; it never had rows') end as failure
from nation left join (select c_nationkey, cast(o_orderdate as date) as d from orders join customer on c_custkey = o_custkey)
  on c_nationkey = n_nationkey
group by n_nationkey"""

SQL["rows_on_day"] = f"select count(*) as cnt from orders where cast(o_orderdate as date) = {AS_OF}"

SQL["recency_filter"] = f"""
select o_custkey as merchant_id, cast(cast(o_orderdate as date) as varchar) as order_date, o_totalprice as gross_sales
from orders where cast(o_orderdate as date) >= {AS_OF} - 1"""

SQL["amount_cents"] = """
select o_orderkey as transaction_id, o_totalprice * 100 as amount_cents,
  cast(cast(o_orderdate as date) as varchar) as transaction_date from orders"""

SQL["schema_drift"] = with_tables("page_refs", "table_columns") + """
select * from (
  select table_name, col_name, e.data_type as expected_type, a.data_type as actual_type,
    case when a.data_type is null then 'missing' when e.data_type is null then 'added'
         when e.data_type <> a.data_type then 'retyped' end as drift
  from (select 'lake.sales.t' || c_custkey as table_name, unnest(['c1', 'c2', 'amount']) as col_name, 'string' as data_type
        from customer) e
  full join (select table_name, col_name, data_type from table_columns
             where table_name in (select 'lake.sales.t' || c_custkey from customer)) a using (table_name, col_name))
where drift is not null"""

SQL["table_files"] = " union all ".join(
    f"select 'lake.data.{name}' as table_name, 'parquet' as format, count(*) as num_rows, true as has_files, true as has_time from {name}"
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split()
)

SQL["missing_tables"] = with_tables("page_refs", "table_columns") + """
select table_name, count(*) as mentions from page_refs
where table_name not in (select table_name from table_columns) group by table_name"""


def family(text: str) -> str:
    tests = " ".join(f"when regexp_matches({text}, {lit('(?i)' + p)}) then '{f}'" for f, p in V.FAILURE_PATTERNS)
    return f"(case {tests} else '{V.OTHER_FAMILY}' end)"


SQL["failure_pattern_tags"] = with_tables("outputs") + f"""
, rules as (
  select 10 * i as priority, family, pattern
  from (values {", ".join(f"({i}, {lit(f)}, {lit(p)})" for i, (f, p) in enumerate(V.FAILURE_PATTERNS, start=1))}) r(i, family, pattern)
  union all
  select 5 + r_regionkey, case when r_regionkey = 0 then 'vendor' else 'data_quality' end,
    case when r_regionkey = 0 then 'vendor_lib|/mnt/vendor' else r_name || ' feed' end
  from region),
first as (select family, min(priority) as place from rules group by family)
select run_id, coalesce(min_by(family, (place, family)), '{V.OTHER_FAMILY}') as family,
  coalesce(string_agg(family, ',' order by place, family), '') as families
from (select distinct o.run_id, f.family, f.place
      from outputs o left join rules r on regexp_matches(o.error, '(?i)' || r.pattern) left join first f on f.family = r.family
      where o.error is not null)
group by run_id"""

SQL["access_check"] = with_tables("outputs") + f"""
select table_name, 'probe of ' || table_name || ' failed: ' || error as message,
  case when contains(error, 'UNRESOLVED_COLUMN') then 'UNRESOLVED_COLUMN'
       when contains(error, 'PERMISSION_DENIED') or contains(error, 'PermissionDenied') then 'PERMISSION_DENIED'
       when contains(error, 'TABLE_OR_VIEW_NOT_FOUND') or contains(lower(error), 'not found') then 'NOT_FOUND'
       else 'UNKNOWN' end as error_type,
  {family('error')} as family
from (select 'lake.sales.t' || run_id as table_name, error from outputs where error <> '')"""

SQL["sink_round_trip"] = _sink_round_trip()
