"""Secrets, told from examples by who has them.

Candidates of fixed shape are found in every text, and beside them long tokens of mixed
characters. A candidate's hash is counted over the corpus by distinct repositories and
owners: what many owners or many repositories of several owners have is a copied example;
what one owner has and looks random is likely live, in one repository or reused in several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, beside, let, scan, size_checked, stored
from .spans import PLACES, as_text, count_where, match_spans, with_kind

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
}
#: The method's own candidates: a long run of letters and digits of both cases.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+"


@dataclass(frozen=True)
class Ownership:
    """From how many owners or repositories on a candidate is an example, and what looks live."""

    example_owners: int = 3
    #: So many repositories make an example of what at least two owners have.
    example_repos: int = 8
    shortest: int = 12
    distinct_characters: int = 8
    #: Words that mark a placeholder, in any case.
    placeholders: tuple[str, ...] = ("example", "sample", "changeme", "placeholder", "dummy", "your", "xxxx", "test")


def base_places(text: Column) -> dict[str, Column]:
    """Places of each kind, with the secret as value; matches that fail are dropped."""
    assign = match_spans(text, F.lit(PATTERNS["assign"]), 2)
    return {
        "assign": F.filter(assign, lambda p: F.length(p["value"]) >= 12),
        "access": F.when(F.contains(text, F.lit("AKIA")), match_spans(text, F.lit(PATTERNS["access"]))).otherwise(F.array().cast(PLACES)),
        "hex": match_spans(text, F.lit(PATTERNS["hex"])),
    }


def mixed_tokens(text: Column) -> Column:
    mixed = lambda p: p["value"].rlike("[0-9]") & p["value"].rlike("[a-z]") & p["value"].rlike("[A-Z]")
    return F.filter(match_spans(text, F.lit(TOKEN)), mixed)


def looks_live(value: Column, rules: Ownership) -> Column:
    """Long, of many different characters, with a digit, and no placeholder's word."""
    found = (F.length(value) >= rules.shortest) & value.rlike("[0-9]")
    found &= F.size(F.array_distinct(F.split(value, ""))) >= rules.distinct_characters
    for word in rules.placeholders:
        found &= ~F.lower(value).contains(word)
    return found


def candidate_owners(candidates: DataFrame, rules: Ownership) -> DataFrame:
    """hash, n_owners, n_repos for each candidate; ``candidates`` has hash, owner, repo.

    Three steps of partial sums: a hash that everyone has is never gathered in one place.
    """
    repos = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def _uncovered(spans: Column) -> Column:
    """Spans by start without the tokens that meet another span.

    A token meets one that starts no later if that ends behind the token's start, and one
    that starts later if that starts before the token's end: a scan from either side.
    """

    def kept(xs: Column) -> Column:
        ends = scan(xs, F.lit(0), lambda at, s: F.when(s["kind"] == "token", at).otherwise(F.greatest(at, s["end"])))
        starts = scan(F.reverse(xs), F.lit(2**31 - 1), lambda at, s: F.when(s["kind"] == "token", at).otherwise(F.least(at, s["start"])))

        def alone(s: Column, i: Column, before: Column, after: Column) -> Column:
            return (s["kind"] != "token") | ((s["start"] >= F.get(before, i)) & (s["end"] <= F.get(after, F.size(xs) - 1 - i)))

        return let(ends, lambda before: let(starts, lambda after: F.filter(xs, lambda s, i: alone(s, i, before, after))))

    return let(spans, kept)


def candidate_spans(text: Column) -> Column:
    """All candidates by start, then kind: base spans, and tokens that no base span meets."""
    base = F.concat(*[F.transform(with_kind(v, k, i), _by_start) for i, (k, v) in enumerate(base_places(text).items())])
    tokens = F.transform(with_kind(mixed_tokens(text), "token", len(KINDS)), _by_start)
    return let(base, lambda b: let(tokens, lambda t: F.when(F.size(t) > 0, _uncovered(F.array_sort(F.concat(b, t)))).otherwise(F.array_sort(b))))


def find_secrets(
    docs: DataFrame,
    *,
    text: str = "text",
    owner: str = "source",
    repo: tuple[str, ...] = ("source", "lang"),
    rules: Ownership = Ownership(),  # noqa: B008
) -> DataFrame:
    """``docs`` with a struct ``secrets``: base and tokens (spans with a verdict each).

    A span has start, rank, end, kind, value, class, n_owners and n_repos. Its class is
    ``example`` if at least ``rules.example_owners`` owners have the value, or two owners in
    at least ``rules.example_repos`` repositories; ``live`` if one owner has it and it looks
    random; else ``unclear``. A live one with several repositories is reused by its owner.
    ``base`` goes by start, then kind; ``tokens`` has only live ones, which the base
    patterns do not cover. A repository is told by the columns ``repo``; the default,
    source and language, stands in for tables that have no better one.

    Texts are searched once; what is found is counted, and comes back to the rows by the
    text's hash. A null text counts as empty. Null owners are one owner, and null
    repositories one repository of theirs. Repeated rows get equal results and count once.
    A text may have any length and any number of candidates: the work grows in proportion.
    An empty table gives no rows. Other columns pass through; one named ``secrets`` is
    replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Hashed before the candidates are spread, or each of them would hash the whole text again.
    named = docs.select(
        F.md5(whole.cast("binary")).alias("text_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo]).alias("repo"),
        whole.alias("text"),
    )
    # The outer form, as the optimiser would search texts again to leave out those without candidates.
    found = named.select("text_key", "owner", "repo", F.posexplode_outer(candidate_spans(F.col("text"))).alias("no", "s")).filter("s is not null")
    held = stored(found.select("*", F.md5("s.value").alias("hash")), "secret-candidates")
    counts = candidate_owners(held, rules)
    values = held.groupBy("hash").agg(F.max(looks_live(F.col("s.value"), rules).cast("int")).alias("live"))
    copied = (F.col("n_owners") >= rules.example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= rules.example_repos))
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & (F.col("live") == 1), "live").otherwise("unclear")
    classed = stored(counts.join(values, "hash").select("hash", verdict.alias("class"), "n_owners", "n_repos"), "secret-classes")

    texts = stored(held.groupBy("text_key", "no").agg(F.first("s").alias("s"), F.first("hash").alias("hash")), "secret-texts")
    judged = texts.join(size_checked(classed, 80), "hash").filter((F.col("s.kind") != "token") | (F.col("class") == "live"))
    one = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("start", "rank", "end", "kind", "value")], "class", "n_owners", "n_repos")
    known = judged.groupBy("text_key").agg(F.array_sort(F.collect_list(one)).alias("spans"), F.sum(F.octet_length("s.value") + 48).alias("bytes"))
    known = stored(known, "secrets-of-texts")

    small = payload_of(known)
    named = docs.select(F.struct("*").alias("row"), F.md5(whole.cast("binary")).alias("text_key"))
    joined = named.join(small, "text_key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType)))
    base, tokens = F.filter("spans", lambda s: s["kind"] != "token"), F.filter("spans", lambda s: s["kind"] == "token")
    return joined.select(*beside(docs, "secrets"), F.struct(base.alias("base"), tokens.alias("tokens")).alias("secrets"))


def payload_of(known: DataFrame) -> DataFrame:
    """``known`` for a join, broadcast if the bytes that it has counted are few."""
    total = known.agg(F.coalesce(F.sum(F.col("bytes") + 64), F.lit(0))).first()[0]
    table = known.drop("bytes")
    return F.broadcast(table) if total <= BROADCAST_BYTES else table.hint("merge")


def _by_start(s: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts, places and classes of secrets in each document, and the owners and repositories that have each."""
    found = find_secrets(docs.select("doc_id", "text", "source", "lang"))
    base, tokens = F.col("secrets.base"), F.col("secrets.tokens")
    counts = [count_where(base, "kind", k).alias(f"n_{k}") for k in KINDS]
    classes = [count_where(base, "class", c).alias(f"n_{c}") for c in ("live", "example", "unclear")]
    every = F.array_sort(F.concat(base, tokens))
    reused = F.size(F.filter(every, lambda s: (s["class"] == "live") & (s["n_repos"] > 1))).cast("long")
    reach = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["n_owners"].cast("string"), s["n_repos"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(every).alias("spans"), *classes, reused.alias("n_reused"), reach.alias("owners_repos"))
