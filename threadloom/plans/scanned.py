"""Queries that hold paths against patterns: commands that read files, and the policy of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import globs
from .registry import _page_path, _table, registered

#: Ignore files by their folder; a rule's place in the list is its order.
IGNORED = {
    "": ("# hosts", "*.example.net", "!blog.*", "/www.*/en/", "fr/1*.html", "**/3*.html", "m.*/**/7?.html", "", "!m.therou.example.com/en/474.html"),
    "blog.ththan.example.net": ("/en/", "!en/[3-5]*", "es/*"),
}
_SCANNED = r"""
    with p as (select page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') as path, html from pages),
    docs as (select page_id, regexp_replace(path, '(\.html|/)?$', '.md') as path from p),
    cmd as (
      select user_id as run, event_id as step, case when event_id % 17 = 0 then 1 else 0 end as exit_code, case event_id % 6 when 0 then 'cat ' || path || ' | head' when 1 then 'cat ./' || path || '; ls docs' when 2 then 'type C:\repo\' || replace(path, '/', '\')
        when 3 then 'cat ' || string_split(path, '/')[1] || '/*/' || left(string_split(path, '/')[3], 1) || '?.md && pytest' when 4 then 'grep -n x f; rg foo; cat $FILE' else 'rg --files; cat *' || right(path, 6) end as command
      from events join docs on page_id = event_id % 50
    ), ok as (select run, step, replace(command, '\', '/') as command from cmd where exit_code = 0),
    seg as (select run, step, generate_subscripts(s, 1) as nth, unnest(s) as segment from (select run, step, regexp_extract_all(command, '(?i)(?:Get-Content|\bcat\b|\btype\b)\s+([^;|\n]+)', 1) as s from ok)),
    tok as (select run, step, nth, unnest(regexp_extract_all(segment, '[\w./*?\-]+\.(?:py|tsx|ts|json|js|toml|yaml|yml|md)')) as pattern from seg),
    met as (
      select pattern, path from (select distinct pattern, ltrim(pattern, './') as lit from tok) cross join (select distinct path from docs)
      where regexp_full_match(path, replace(replace(replace(lit, '.', '\.'), '*', '.*'), '?', '.')) or ends_with(pattern, '/' || path)
    ), reads as (select distinct run, step, nth, path from tok join met using (pattern))
    """


def _commands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.regexp_replace(_page_path(F.col("url")), r"(\.html|/)$", ""), F.lit(".md"))
    docs = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    events, parts = _table(spark, sf_dir, "events").withColumn("page_id", F.col("event_id") % 50), F.split("path", "/")
    which = F.col("event_id") % 6
    command = (
        F.when(which == 0, F.concat(F.lit("cat "), "path", F.lit(" | head")))
        .when(which == 1, F.concat(F.lit("cat ./"), "path", F.lit("; ls docs")))
        .when(which == 2, F.concat(F.lit("type C:\\repo\\"), F.translate("path", "/", "\\")))
        .when(which == 3, F.concat(F.lit("cat "), parts[0], F.lit("/*/"), F.left(parts[2], F.lit(1)), F.lit("?.md && pytest")))
        .when(which == 4, F.lit("grep -n x f; rg foo; cat $FILE"))
        .otherwise(F.concat(F.lit("rg --files; cat *"), F.right("path", F.lit(6))))
    )
    code = F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    return events.join(docs, "page_id").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), command.alias("command"), code.alias("exit_code")), docs.select("path")


@registered(_SCANNED + "select run, step, path from reads")
def exploration_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return globs.exploration(*_commands(spark, sf_dir))[0]


@registered(
    _SCANNED
    + r""", c as (
      select run, sum(case when exit_code = 0 then len(regexp_extract_all(replace(command, '--files', '~'), '\brg foo\b')) else 0 end) as searches, sum(case when exit_code = 0 then len(regexp_extract_all(command, '\bgrep\b')) else 0 end) as greps,
        sum(case when exit_code = 0 then len(regexp_extract_all(command, '\bls\b|\bdir\b|\brg\s+--files')) else 0 end) as listings, count(*) filter (where exit_code <> 0 and contains(command, 'pytest')) as failed_tests from cmd group by run
    ), r as (select run, count(*) as reads, count(distinct path) as files from reads group by run),
    u as (select run, count(*) as unresolved from seg where (run, step, nth) not in (select (run, step, nth) from reads) group by run)
    select run, cast(searches as bigint) as searches, cast(greps as bigint) as greps, cast(listings as bigint) as listings, failed_tests, coalesce(reads, 0) as reads, coalesce(files, 0) as files, coalesce(unresolved, 0) as unresolved from c left join r using (run) left join u using (run)"""
)
def exploration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return globs.exploration(*_commands(spark, sf_dir))[1]


#: The rules of IGNORED written as patterns, for a folder or a file alike: (base, order, leaves out, pattern).
_RULES = r"""(values ('', 1, true, '^(.*/)?[^/]*\.example\.net(/.*)?$'), ('', 2, false, '^(.*/)?blog\.[^/]*(/.*)?$'), ('', 3, true, '^www\.[^/]*/en/.*$'), ('', 4, true, '^fr/1[^/]*\.html(/.*)?$'), ('', 5, true, '^(.*/)?3[^/]*\.html(/.*)?$'),
      ('', 6, true, '^m\.[^/]*/(.*/)?7[^/]\.html(/.*)?$'), ('', 8, false, '^m\.therou\.example\.com/en/474\.html(/.*)?$'), ('blog.ththan.example.net', 10, true, '^en/.*$'), ('blog.ththan.example.net', 11, false, '^en/[3-5][^/]*(/.*)?$'), ('blog.ththan.example.net', 12, true, '^es/[^/]*(/.*)?$'))"""


@registered(
    _SCANNED
    + rf""", f as (select path, arg_min(html, page_id) as html, string_split(path, '/') as parts from p group by path),
    e as (select path, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/') || case when i < len(parts) then '/' else '' end)) as entity from f),
    m as (select path, entity, arg_max(leaves_out, nth) as leaves_out from e join {_RULES} as r(base, nth, leaves_out, pattern) on (base = '' or starts_with(entity, base || '/') and length(entity) > length(base) + 1) and regexp_matches(case when base = '' then entity else substr(entity, length(base) + 2) end, pattern) group by 1, 2),
    i as (select distinct path from m where leaves_out)
    select path, case when not regexp_matches(lower(path), '\.(py|ts|tsx|js|jsx|md|rst|txt|json|yaml|yml|toml|sql|css|html|sh|ps1)$') then 'extension' when path in (select path from i) then 'ignored' when octet_length(encode(html)) > 1000000 then 'too_large'
      when contains(html, chr(0)) then 'binary' when contains(html, '-----BEGIN ') and contains(html, 'PRIVATE KEY-----') then 'private_key' when regexp_matches(left(html, 500), '(?i)@generated|DO NOT EDIT|auto-generated') then 'generated' end as reason from f"""
)
def scan_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(base, i, line) for base, lines in IGNORED.items() for i, line in enumerate(lines)], "base string, nth int, line string")
    pages = _table(spark, sf_dir, "pages").select("page_id", _page_path(F.col("url")).alias("path"), "html")
    files = pages.groupBy("path").agg(F.min_by("html", "page_id").alias("content"))
    return globs.scan_policy(files, globs.ignore_rules(lines))
