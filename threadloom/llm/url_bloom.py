"""URL filter: rules by host and path, and a list of canonical URLs.

The list is held as a blocked Bloom filter: one block of eight 64-bit words for each
group of keys, and one bit of each word for a key. URLs that miss are not listed; URLs
that hit go to an exact hash join with the list, so no false positive is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, size_checked, stored

WORDS = 8
#: Bits of filter for each listed URL.
BITS_PER_KEY = 16


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Parts of host names that put a page's canonical URL on the list.
LISTED_NAMES = ("ads-track", "adult", "casino", "pills", "free-bets", "spam")
#: A title with such a run of symbols puts its page's canonical URL on the list.
NOISY_TITLE = "<title>[^<]*[#*$%]{3}"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, in lower case; "" without ://."""
    found = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; "" without ://."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or blog. and path without its last slash or .html; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits; of two as long, the one given first. Null if none does."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, chosen) if found is None else found.when(fits, chosen)
    return found if found is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit that a key has in a word: six bits of a second hash."""
    place = F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block and w0 to w7, for the blocks that have a key."""
    marked = keys.select(_block(F.col(key), blocks).alias("block"), *[_bit(F.col(key), i).alias(f"w{i}") for i in range(WORDS)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, *, url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` with a struct ``judged``: host, path, rule, possible, listed and verdict.

    ``listed`` has one column of canonical URLs; nulls and repeats in it do not count. A
    rule decides first; elsewhere a listed URL is blocked and any other allowed.
    ``possible`` says that the filter let a URL pass to the exact join. The filter and the list are broadcast only if measured to be small; else pages are
    exchanged by block, and possible hits by canonical URL.

    A null URL, or one without ://, has an empty host and path, fits no rule, and is
    allowed. Empty tables give no rows or list nothing; repeated pages are each judged. A
    URL may have any length. Other columns pass through; one named ``judged`` is replaced.
    """
    name = listed.columns[0]
    keys = stored(listed.select(F.col(name).alias("listed_url")).filter("listed_url is not null").distinct(), "listed")
    count = keys.count()
    blocks = max(1, -(-count * BITS_PER_KEY // (64 * WORDS)))
    table = stored(bloom_blocks(keys, "listed_url", blocks), "bloom")

    row = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    row = row.withColumn("canon", canonical(F.col("host"), F.col("path"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    row = row.withColumn("block", _block(F.col("canon"), blocks))
    held = [_bit(F.col("canon"), i).bitwiseAND(F.col(f"w{i}")) != 0 for i in range(WORDS)]
    probed = row.join(size_checked(table, 8 * (WORDS + 1)), "block", "left")
    probed = probed.withColumn("possible", F.coalesce(reduce(Column.__and__, held), F.lit(False)))
    # A page that misses the filter gets a key of its own that no list has, so misses are spread evenly.
    miss = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    probed = probed.withColumn("probe", F.when(F.col("possible"), F.col("canon")).otherwise(miss))
    exact = probed.join(size_checked(keys, 16, ["listed_url"]), F.col("probe") == F.col("listed_url"), "left")
    is_listed = F.col("listed_url").isNotNull()
    verdict = F.coalesce(F.col("rule.verdict"), F.when(is_listed, "block").otherwise("allow"))
    judged = F.struct("host", "path", F.col("rule.name").alias("rule"), "possible", is_listed.alias("listed"), verdict.alias("verdict"))
    return exact.select(*beside(pages, "judged"), judged.alias("judged"))


def listed_pages(pages: DataFrame, *, url: str = "url", html: str = "html", names: Sequence[str] = LISTED_NAMES, noisy: str = NOISY_TITLE) -> DataFrame:
    """Canonical URLs of the pages whose title is noise, or whose host has one of ``names`` in it.

    A page is listed for what stands on it, so other addresses of the same page (another
    scheme, host prefix, query or ending) are met by the list although they look clean.
    """
    host = host_of(F.col(url))
    found = F.coalesce(F.col(html).rlike(noisy), F.lit(False))
    for name in names:
        found = found | host.contains(name)
    return pages.filter(found).select(canonical(host, path_of(F.col(url))).alias("listed_url"))


def urls_digest(pages: DataFrame) -> DataFrame:
    """The verdict on each page, by the standing rules and the list of such pages."""
    found = judge_urls(pages.select("page_id", "url"), listed_pages(pages.select("url", "html")))
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.listed", "judged.verdict")


DIGEST_SQL = r"""
with cut as (
  select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), canon as (
  select *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(/|\.html)$', '') as canon,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts
), listed as (
  select distinct canon from canon
  where regexp_matches(html, '<title>[^<]*[#*$%]{3}') or host like '%ads-track%' or host like '%adult%' or host like '%casino%' or host like '%pills%' or host like '%free-bets%' or host like '%spam%'
)
select page_id, host, path, rule, l.canon is not null as listed,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule in ('example.net/en/', 'org/fr/') then 'allow'
       when l.canon is not null then 'block' else 'allow' end as verdict
from canon c left join listed l on c.canon = l.canon
"""
