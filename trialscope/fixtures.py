"""Telemetry views over the driver tables.

One SQL text per view serves both Spark and the ANSI-SQL check: base tables and
other views are written ``@name@`` and replaced by whatever the engine calls them.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["log_lines"] = """
select event_id as line_number, concat('s', cast(user_id as string)) as file, ts,
  concat(substring(cast(ts as string),1,19), ' ',
    case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end,
    ' pid: ', cast(user_id as string), ' ',
    case event_type
      when 'click' then concat('took ', cast(value as string), case event_id % 3 when 0 then ' ms' when 1 then ' s' else ' minutes' end)
      when 'view' then concat('memory: ', cast(value as string), case event_id % 3 when 0 then ' kb' when 1 then ' gb' else ' mb' end, ' cpu: ', cast(event_id % 100 as string), '%')
      when 'signup' then concat(case event_id % 3 when 0 then 'openai gpt-4' when 1 then 'anthropic claude-3-opus' else 'ollama llama3' end, ' tokens: ', cast(event_id % 4000 as string), ' cost $', cast(value as string))
      when 'purchase' then concat('coverage: ', cast(event_id % 101 as string), '% lines: ', cast(event_id % 95 as string), '% branches: ', cast(event_id % 90 as string), '%')
      else case event_id % 5
        when 0 then 'crash SIGSEGV heap buffer overflow at 0x00000000'
        when 1 then 'signal 6 abort double free 0xdeadbeef'
        when 2 then 'error: undefined symbol foo'
        when 3 then 'crash use after free CVE-2021-3156 asan report'
        else '#3 0x41 in strcpy lib.c' end
    end) as raw_line
from @events@
"""

# Output of eight kinds of tool, one kind per user, so that every line parser meets
# the lines it is made for.
VIEWS["tool_lines"] = """
select event_id as line_number, concat('t', cast(user_id as string)) as file, ts,
  case user_id % 8 when 0 then 'afl' when 1 then 'libfuzzer' when 2 then 'honggfuzz' when 3 then 'cifuzz'
    when 4 then 'llm' when 5 then 'compilation' when 6 then 'coverage' else 'crash' end as tool,
  case user_id % 8
    when 0 then case event_type
      when 'click' then concat('execs_done : ', cast(event_id as string))
      when 'view' then concat('stability : ', cast(value as string))
      when 'signup' then 'american fuzzy lop 2.57b'
      when 'purchase' then concat('Target Mode : m', cast(event_id % 3 as string))
      else case event_id % 2 when 0 then 'saved crash id 7' else 'saved hang id 9' end end
    when 1 then case event_type
      when 'click' then concat('#', cast(event_id as string), ' INITED cov: 10 exec/s: ', cast(event_id % 900 as string))
      when 'view' then concat('#', cast(event_id as string), ' NEW cov: 11')
      when 'signup' then 'asan: leak of 8 bytes, crash follows'
      when 'purchase' then 'memory leak detected'
      else 'crash-da39a3ee written' end
    when 2 then case event_type
      when 'click' then concat('Iterations: ', cast(event_id as string), ' [1] Speed: ', cast(event_id % 700 as string), '/sec')
      when 'view' then 'Iterations: none yet'
      when 'signup' then 'unique: 3'
      when 'purchase' then 'Crash: saved as SIGABRT'
      else 'idle' end
    when 3 then case event_type
      when 'click' then 'Running fuzz test parser'
      when 'view' then 'Building target and compiling sources'
      when 'signup' then 'generating driver with llm'
      when 'purchase' then 'new finding: vulnerability in parser'
      else 'stopped' end
    when 4 then case event_type
      when 'click' then concat('POST api.openai completions tokens: ', cast(event_id % 4000 as string))
      when 'view' then concat('anthropic messages cost $', cast(value as string))
      when 'signup' then concat('POST openai completions token ', cast(event_id % 300 as string), ' price $', cast(value as string))
      else 'waiting' end
    when 5 then case event_type
      when 'click' then 'a.c:3: error: expected semicolon'
      when 'view' then 'a.c:9: warning: unused variable'
      when 'signup' then 'Build successful'
      when 'purchase' then 'warning: treated as error: stop'
      else 'linking' end
    when 6 then case event_type
      when 'click' then concat('coverage: ', cast(event_id % 101 as string), '%')
      when 'view' then concat('lines: ', cast(value as string), '% branch: ', cast(event_id % 90 as string), '%')
      when 'signup' then concat('branches ', cast(event_id % 77 as string), '%')
      else 'no data' end
    else case event_type
      when 'click' then concat('#', cast(event_id % 7 as string), ' 0x41 in ', case event_id % 5 when 0 then 'strcpy' when 1 then 'free' else 'parse_next' end, ' lib.c')
      when 'view' then case event_id % 4 when 0 then '' else concat('frame 0x', cast(event_id % 10 as string)) end
      when 'signup' then 'msan report'
      when 'purchase' then case event_id % 3 when 0 then '' else '# asan summary' end
      else case event_id % 4 when 0 then 'Segmentation fault' when 1 then 'crash with SIGABRT' when 2 then 'crash: heap buffer overflow, heap overflow' else 'crash signal 11' end end
  end as raw_line
from @events@
"""

VIEWS["interactions"] = """
select concat('c', cast(conv_id as string), '-', cast(turn as string)) as interaction_id,
  concat('s', cast(conv_id % 150 as string)) as session_id, e.ts as ts,
  case conv_id % 4 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'ollama' else 'huggingface' end as llm_provider,
  case conv_id % 8 when 0 then 'gpt-4' when 4 then 'gpt-3.5-turbo' when 1 then 'claude-3-opus' when 5 then 'other' when 2 then 'llama3:latest' when 6 then 'yi:34b' else 'hf-model' end as llm_model,
  prompt_text, response_text,
  cast(floor(length(prompt_text) / 4) as bigint) as prompt_tokens,
  cast(floor(length(response_text) / 4) as bigint) as response_tokens,
  cast(length(response_text) % 5000 as double) as response_time_ms,
  conv_id % 11 <> 0 as success
from @turn_pairs@ t
join @events@ e on e.event_id = t.conv_id
"""

VIEWS["turn_pairs"] = """
select conv_id, turn, prompt_text, response_text from (
  select conv_id, turn, role, text as prompt_text,
    lead(text) over (partition by conv_id order by turn) as response_text,
    lead(role) over (partition by conv_id order by turn) as next_role
  from @conversations@) t
where role = 'user' and next_role = 'assistant'
"""

# Replies that hold code, keyed like the interactions: the conversation tables hold
# prose only, so the code checks of a reply need a reply with code in it.
VIEWS["code_replies"] = """
select concat('d', cast(doc_id as string)) as interaction_id, concat('s', cast(doc_id % 150 as string)) as session_id,
  concat('write code about ', text) as prompt_text,
  concat(
    case doc_id % 10
      when 0 then concat('import json', chr(10), 'import torch', chr(10), 'def run(a):', chr(10), '    return total + len(a)', chr(10))
      when 1 then concat('#include <stdio.h>', chr(10), '#include <fake.h>', chr(10), 'int main(void) { char* p = malloc(9); x = y / 0; }', chr(10))
      when 2 then concat('#include <iostream>', chr(10), 'std::string s; int main() { std::cout << s; }', chr(10))
      when 3 then concat('public class A { public static void main(String[] a) { System.out.println(1); } }', chr(10), 'import fake_lib;', chr(10))
      when 4 then concat('function go() { console.log((1); var a = [1; let b = 2; const c = 3;', chr(10))
      when 5 then concat('use std::io;', chr(10), 'fn main() { let mut x = 5; }', chr(10))
      when 6 then concat('package app', chr(10), 'func main() { fmt.Print(1) }', chr(10))
      when 7 then concat('void f() { malloc(-5); array[-1] = 0; undefined_function(); for (;true;) { x++; } }', chr(10))
      when 8 then concat('def broken(:', chr(10), '    nonexistent_module print (x)', chr(10))
      else '' end,
    case doc_id % 10 when 0 then '# ' when 8 then '# ' else '// ' end, replace(text, chr(10), ' '), chr(10)) as response_text
from @documents@
"""

VIEWS["source_files"] = """
select doc_id, concat('s', cast(doc_id % 150 as string)) as session_id,
  concat('p', cast(doc_id % 20 as string), '/f', cast(doc_id as string),
    case doc_id % 5 when 0 then '.c' when 1 then '.py' when 2 then '.js' when 3 then '.java' else '.cpp' end) as file_path,
  case doc_id % 5 when 0 then 'c' when 1 then 'python' when 2 then 'javascript' when 3 then 'java' else 'cpp' end as language,
  concat(
    case doc_id % 5
      when 0 then concat('#include <stdio.h>', chr(10), '#include <fake.h>', chr(10), 'int main(int argc, char** argv) {', chr(10), '  char* p = malloc(16); if (argc > 1 && p) { strcpy(p, argv[1]); }', chr(10))
      when 1 then concat('import os', chr(10), 'from fakelib import x', chr(10), 'def run(a, b, c, d, e, f):', chr(10), '    return eval(a)  # TODO check', chr(10))
      when 2 then concat('function go(x) {', chr(10), '  var a = x ? 1 : 2; let b = 1234; const f = (y) => y;', chr(10))
      when 3 then concat('import java.util.List;', chr(10), 'public class A { public static void main(String[] a) {', chr(10), '  st.executeQuery("q" + a[0]);', chr(10))
      else concat('#include <iostream>', chr(10), 'template <class T> class K { };', chr(10), 'int LLVMFuzzerTestOneInput(const char* d) {', chr(10), '  for (int i = 0; i < 9; i++) { sprintf(b, d); }', chr(10)) end,
    case doc_id % 5 when 1 then '# ' else '// ' end, replace(text, chr(10), ' '), chr(10),
    case doc_id % 5 when 1 then '' else '}' end) as content
from @documents@
"""

# The same documents with their own line breaks, as plain text files.
VIEWS["text_files"] = """
select doc_id, concat('p', cast(doc_id % 20 as string), '/t', cast(doc_id as string),
    case doc_id % 3 when 0 then '.h' when 1 then '.go' else '.txt' end) as file_path, text as content
from @documents@
"""

VIEWS["findings"] = """
select concat('f', cast(event_id as string)) as finding_id, concat('s', cast(user_id as string)) as session_id, ts,
  case event_id % 6 when 0 then 'buffer_overflow' when 1 then 'use_after_free' when 2 then 'null_pointer_dereference' when 3 then 'sql_injection' when 4 then 'command_injection' else 'memory_leak' end as vulnerability_type,
  case cast(floor(value) as bigint) % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end as severity,
  case event_id % 4 when 0 then 'pattern_matching' when 1 then 'crash_signature_analysis' when 2 then 'stack_trace_analysis' else 'memory_analysis' end as detection_method,
  cast(event_id % 10 as double) / 10 as confidence_score,
  case event_id % 3 when 0 then '' else 'strcpy(' end as code_snippet
from @events@ where event_type = 'error'
"""

VIEWS["crashes"] = """
select event_id as crash_id, concat('s', cast(user_id as string)) as session_id,
  case event_id % 4 when 0 then 'heap overflow then heap overflow' when 1 then 'SIGSEGV null pointer' when 2 then 'double free' else 'timeout' end as signature,
  case event_id % 3 when 0 then concat('#0 0x41 in strcpy lib.c', chr(10), '#1 0x0 in free a.c') when 1 then 'at main (x.c:1)' else '' end as stack_trace,
  event_id % 5 = 0 as heap_corruption, event_id % 7 = 0 as stack_overflow
from @events@ where event_type = 'error'
"""

VIEWS["metrics"] = """
select concat('s', cast(user_id as string)) as session_id, ts, 'system_resources' as metric_category,
  cast(event_id % 100 as double) as cpu_percent, value as memory_mb, event_id
from @events@ where event_type in ('view', 'click')
"""

VIEWS["sessions"] = """
select concat('s', cast(user_id as string)) as session_id, cast(user_id + 1 as int) as pid, min(ts) as start_time, max(ts) as end_time,
  case user_id % 4 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'ollama' else 'unknown' end as llm_provider,
  case user_id % 3 when 0 then 'c' when 1 then 'cpp' else 'python' end as primary_language,
  case user_id % 5 when 0 then 'failed' when 1 then 'running' else 'completed' end as status,
  count(case when event_type = 'click' then 1 end) as fuzz_drivers_generated,
  count(case when event_type = 'signup' then 1 end) as total_llm_interactions,
  sum(case when event_type = 'signup' then event_id % 4000 else 0 end) as total_tokens_consumed,
  count(case when event_type = 'error' then 1 end) as security_vulnerabilities_found,
  count(case when event_type = 'error' and event_id % 5 = 0 then 1 end) as unique_crashes_found,
  cast(user_id % 50 as double) / 10 as estimated_cost_usd,
  cast(user_id % 90 as double) as average_cpu_usage, max(value) as peak_memory_usage_mb, user_id * 1000 as network_bytes_sent
from @events@ group by user_id
"""

VIEWS["provider_health"] = """
select case user_id % 5 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'ollama' when 3 then 'huggingface' else 'localai' end as provider,
  ts, event_id, case event_type when 'error' then 'unhealthy' else 'healthy' end as status
from @events@
"""

VIEWS["experiments"] = """
select concat('x', cast(o_orderkey as string)) as experiment_id, concat('repo', cast(o_custkey % 25 as string)) as repo_name,
  substring(o_orderpriority, 1, 1) as category, concat('m', cast(o_orderkey % 14 as string)) as model,
  case o_orderstatus when 'O' then 'completed' when 'F' then 'failed' else 'timeout' end as status,
  case when o_orderstatus = 'P' then null else o_totalprice / 1000 end as duration_seconds,
  cast(o_orderkey % 4 as int) as generated_files
from @orders@
"""

# Every document is a file of a project; where its place is that of a manifest, the manifest is a file besides.
VIEWS["project_files"] = """
select concat('p', cast(cast(floor(doc_id / 16) as bigint) as string)) as project,
  case doc_id % 16 when 0 then 'README.md' when 1 then 'CMakeLists.txt' when 2 then 'requirements.txt' when 3 then 'package.json'
    when 4 then 'src/main.c' when 5 then 'tests/test_a.py' when 6 then '.github/workflows/ci.yml' when 7 then 'Cargo.toml'
    when 8 then 'go.mod' when 9 then 'setup.py' when 10 then 'pyproject.toml' when 11 then 'pom.xml' when 12 then '.env'
    when 13 then 'Dockerfile' when 14 then 'src/util.js' else 'lib/b.cpp' end as path,
  case doc_id % 16
    when 2 then concat('# c', chr(10), 'numpy>=1.', cast(doc_id % 9 as string), chr(10), 'pkg', cast(doc_id % 30 as string), '==2', chr(10), '-r x')
    when 3 then concat('{"dependencies":{"lib', cast(doc_id % 7 as string), '":"1"},"devDependencies":{"jest":"2"}}')
    when 5 then 'import pytest'
    when 7 then concat('[package]', chr(10), 'name = "a"', chr(10), '[dependencies]', chr(10), 'serde = "1"', chr(10), '[dev-dependencies]', chr(10), 'rand = "0"')
    when 8 then concat('module a', chr(10), 'require (', chr(10), '  github.com/x/y', cast(doc_id % 5 as string), ' v1', chr(10), ')')
    when 9 then 'setup(install_requires=["requests>=2", "six"])'
    when 10 then concat('[project]', chr(10), 'dependencies = ["attrs>=1"]', chr(10), '[project.optional-dependencies]', chr(10), 'dev = ["black"]', chr(10))
    when 11 then '<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>'
    when 12 then concat('provider=openai', chr(10), 'model=gpt-4')
    else text end as content
from @documents@
union all
select concat('p', cast(cast(floor(doc_id / 16) as bigint) as string)), concat('docs/note', cast(doc_id % 16 as string), '.txt'), text
from @documents@ where doc_id % 16 in (2, 3, 5, 7, 8, 9, 10, 11, 12)
"""

VIEWS["proc_snapshot"] = """
select c_custkey as pid, case c_custkey % 6 when 0 then 'cifuzz' when 1 then 'python' else 'bash' end as name,
  case c_custkey % 4 when 0 then 'cifuzz spark --llm-model=gpt-4 --project-dir /w/p1' when 1 then 'fuzz run with ai --provider ollama' when 2 then 'make all' else 'python llm_fuzz.py -d /w/p2' end as cmdline,
  case when c_custkey % 13 = 0 then 'zombie' else 'running' end as status,
  case c_custkey % 3 when 0 then 'GITHUB_RUN_ID' when 1 then 'CI_PIPELINE_ID' else 'HOME' end as env_key, cast(c_custkey as string) as env_value
from @customer@
"""

VIEWS["file_snapshots"] = """
select 'prev' as snap, concat('f', cast(p_partkey as string)) as path, p_size as mtime from @part@ where p_partkey % 10 <> 0
union all
select 'cur' as snap, concat('f', cast(p_partkey as string)) as path, p_size + case when p_partkey % 3 = 0 then 1 else 0 end as mtime from @part@ where p_partkey % 7 <> 0
"""

# Log files of several formats: JSON lines, CSV with a header, a fuzzer's log, plain text.
VIEWS["mixed_lines"] = """
select concat(case event_id % 4 when 0 then 'json' when 1 then 'table' when 2 then 'fuzz' else 'text' end, '-', cast(cast(floor(event_id / 1000) as bigint) as string)) as file,
  cast(floor((event_id % 1000) / 4) as bigint) + case event_id % 4 when 1 then 2 else 1 end as line_number, event_id,
  case event_id % 4
    when 0 then case when event_id % 20 = 0 and event_id % 1000 > 40 then '{broken'
      when event_type = 'error' then concat('{"time":"', substring(cast(ts as string),1,19), '","severity":"ERROR","msg":"crash ', cast(event_id as string), '","signal":"11"}')
      when event_type = 'signup' then concat('{"timestamp":"', substring(cast(ts as string),1,19), '","level":"INFO","message":"reply","model":"gpt-4","tokens":', cast(event_id as string), '}')
      when event_type = 'click' then concat('{"timestamp":"', substring(cast(ts as string),1,19), '","level":"INFO","message":"ran","model":"m","exec":1}')
      else concat('{"time":"', substring(cast(ts as string),1,19), '","level":"INFO","msg":"idle"}') end
    when 1 then concat(substring(cast(ts as string),1,19), ',', event_type, ',', cast(user_id as string), ',"a, ""quoted"" note"')
    when 2 then case event_type when 'error' then 'libfuzzer crash' when 'click' then concat('#', cast(event_id as string), ' INITED libfuzzer exec/s: 7') else 'libfuzzer leak' end
    else concat(substring(cast(ts as string),1,19), ' INFO took ', cast(value as string), ' ms') end as raw_line
from @events@
union all
select distinct concat('table-', cast(cast(floor(event_id / 1000) as bigint) as string)) as file, cast(1 as bigint) as line_number, cast(null as bigint) as event_id, 'time,type,code,note' as raw_line
from @events@
"""

VIEWS["xml_reports"] = """
select o_orderkey, concat('x', cast(o_orderkey as string), '.xml') as file,
  case o_orderkey % 4
    when 0 then concat('<testsuites><testsuite name="s', cast(o_custkey % 5 as string), '"><testcase name="a', cast(o_orderkey as string), '" classname="k" time="', cast(o_orderkey % 100 as string), '.5"/>',
      '<testcase name="b', cast(o_orderkey as string), '" classname="k" time="1.0"><failure message="', o_orderstatus, '">boom</failure></testcase></testsuite></testsuites>')
    when 1 then concat('<testsuite name="r', cast(o_custkey % 5 as string), '"><testcase name="c', cast(o_orderkey as string), '" classname="k"><error message="', o_orderstatus, '">bad</error></testcase></testsuite>')
    when 2 then concat('<coverage><packages><package name="p', cast(o_custkey % 7 as string), '"><classes><class name="C', cast(o_orderkey as string), '" filename="f.c" line-rate="0.5" branch-rate="0.25"><lines>',
      '<line number="1" hits="', cast(o_orderkey % 9 as string), '" branch="true"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    else concat('<other id="', cast(o_orderkey as string), '"><item>', o_orderstatus, '</item></other>') end as content
from @orders@
"""

_NAME = re.compile(r"@(\w+)@")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, streams: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named view (or base table) as a lazy DataFrame.

    ``streams`` replaces base tables, so that the same text also defines a streaming view.
    """
    if streams and name in streams:
        return streams[name]
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    if name == "turn_pairs":
        from .operators.interactions import pair_turns

        return pair_turns(table(spark, sf_dir, "conversations"))
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:8] + ("_live" if streams else "")

    def bind(match: re.Match) -> str:
        temp = f"ts_{match[1]}_{tag}"
        view(spark, sf_dir, match[1], streams).createOrReplaceTempView(temp)
        return temp

    return spark.sql(_NAME.sub(bind, VIEWS[name]))


def oracle(names: str, body: str) -> str:
    """ANSI SQL: the needed views as CTEs in front of ``body`` (a SELECT, or WITH ... SELECT)."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in BASE_TABLES or name in ordered:
            return
        for inner in _NAME.findall(VIEWS[name]):
            need(inner)
        ordered.append(name)

    for name in names.split():
        need(name)
    ctes = [f"{name} as ({_NAME.sub(lambda m: m[1], VIEWS[name])})" for name in ordered]
    body = body.strip()
    if body[:5].lower() == "with ":
        rest = body[5:]
    else:
        rest = body
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + ("," if body is not rest else "") + "\n" + rest
