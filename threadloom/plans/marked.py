"""Pages as files of a repository: what they declare, as units, and what their links bind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from ..sources import markup
from .registry import _TOKENS, _page_path, _table, registered

_KINDS = "|".join(markup.DECLARING)
_MARKED = rf"""
    with p as (select page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') as path, replace(html, '<p>', chr(10) || '<p>') as content from pages),
    fl as (select path, arg_min(content, page_id) as content, min(page_id) as page_id from p group by path),
    mk as (select path, generate_subscripts(ms, 1) as pos, unnest(ms) as mark from (select path, regexp_extract_all(content, '(?i)\n|<(?:{_KINDS})\b[^>]*>|</(?:{_KINDS})\s*>') as ms from fl)),
    ln as (select *, 1 + sum(case when mark = chr(10) then 1 else 0 end) over (partition by path order by pos) as line from mk),
    la as (select *, max(line) over (partition by path) as last, lower(regexp_extract(mark, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) as kind, case when starts_with(mark, '</') then -1 else 1 end as step from ln),
    tg as (select * from la where mark <> chr(10)),
    op as (select *, step = 1 as opens from tg),
    mt as (
      select a.path, a.pos, a.kind, a.mark, a.line as low, a.last,
        (select min(b.pos) from op b where b.path = a.path and b.kind = a.kind and b.pos > a.pos and not b.opens
          and (select coalesce(sum(c.step), 0) from op c where c.path = a.path and c.kind = a.kind and c.pos > a.pos and c.pos < b.pos) = 0) as end_at
      from op a where a.opens
    ), dc as (
      select mt.path, pos, coalesce(end_at, 2147483647) as end_at, kind, mark, low, coalesce((select line from ln where ln.path = mt.path and ln.pos = end_at), last) as high, row_number() over (partition by mt.path order by pos) as nth from mt
    ), nm as (
      select path, pos, end_at, kind, low, high, nth, lower(coalesce(nullif(regexp_extract(mark, '(?i)\sid\s*=\s*["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(mark, '(?i)\sclass\s*=\s*["'']([^"'']+)["'']', 1), ''),
        case when kind = 'h1' then nullif(trim((select regexp_extract(content, '<h1>([^<\n]*)</h1>', 1) from fl where fl.path = dc.path)), '') end, kind)) as name from dc
    ), decl as (
      select path, nth, kind, name, cast(low as bigint) as low, cast(high as bigint) as high, (select count(*) from nm o where o.path = nm.path and o.pos < nm.pos and o.end_at > nm.pos) as level,
        (select max(o.nth) from nm o where o.path = nm.path and o.pos < nm.pos and o.end_at > nm.pos) as parent from nm
    )
    """


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", _page_path(F.col("url")).alias("path"), F.replace("html", F.lit("<p>"), F.lit("\n<p>")).alias("content"))
    first = stored(pages.groupBy("path").agg(F.min("page_id").alias("page_id")), "first-pages")
    return stored(pages.join(first, ["page_id", "path"]), "marked-files")


@registered(_MARKED + "select * from decl")
def markup_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.declarations(_files(spark, sf_dir))


@registered(
    _MARKED
    + rf""", ls as (select path, regexp_extract_all(content, '[^\n]*\n|[^\n]+') as ls from fl),
    u as (
      select path as unit_id, 'repository_file' as source_type, null as parent_id, content, 1 as low, len(ls) as high from fl join ls using (path)
      union all select d.path || '::' || d.name || ':' || d.nth, 'code_symbol', coalesce(d.path || '::' || o.name || ':' || o.nth, d.path), array_to_string(ls[d.low : d.high], ''), d.low, d.high from decl d join ls using (path) left join decl o on o.path = d.path and o.nth = d.parent
    ) select unit_id, source_type, parent_id, sha256(content) as content_hash, cast({_TOKENS.format("content")} as bigint) as token_count, low, high from u"""
)
def repository_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    units = markup.repository_units(files, stored(markup.declarations(files), "declared"))
    return units.select("unit_id", "source_type", "parent_id", "content_hash", "token_count", "low", "high")


@registered(
    _MARKED
    + """, b as (
      select x.path as file, y.path as target, case x.page_id % 4 when 0 then 'nav' when 1 then 'ad' when 2 then 'ul' else 'none' end as name from fl x left join fl y on y.page_id = (x.page_id * 7) % 250
    ), one as (select path as target, name, min(nth) as nth from decl group by 1, 2 having count(*) = 1),
    a as (select distinct file, target, name from b where target is not null and target <> file)
    select 'references_symbol' as kind, file as src, target || '::' || name || ':' || nth as dst from a join one using (target, name)
    union all select distinct 'references', file, target from a where (target, name) not in (select (target, name) from one)"""
)
def symbol_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    page = F.col("page_id")
    name = F.element_at(F.array(F.lit("nav"), F.lit("ad"), F.lit("ul"), F.lit("none")), (page % 4 + 1).cast("int"))
    own = files.select(F.col("path").alias("file"), (page * 7 % 250).alias("key"), name.alias("name"))
    bindings = own.join(files.select(page.alias("key"), F.col("path").alias("target")), "key", "left")
    return markup.bound_symbols(bindings, markup.declarations(files))
