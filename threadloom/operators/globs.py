"""Paths against patterns: reads of files by commands with wildcards, and scan policies with ordered ignore rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import size_checked, stored

#: How commands read, search and list, and which paths in them are told.
READS = r"(?i)(?:Get-Content|\bcat\b|\btype\b)\s+([^;|\n]+)"
PATHS = r"[\w./*?\-]+\.(?:py|tsx|ts|json|js|toml|yaml|yml|md)"
SEARCHES, GREPS = r"(?i)\brg\b(?!\s+--files)|\bSelect-String\b", r"\bgrep\b"
LISTINGS, TESTS = r"(?i)Get-ChildItem|\bls\b|\bdir\b|\brg\s+--files", r"(?i)\b(?:pytest|unittest)\b|npm\s+test"
#: What a scan takes and leaves out.
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".md", ".rst", ".txt", ".json", ".yaml", ".yml", ".toml", ".sql", ".css", ".html", ".sh", ".ps1")
EXCLUDED = (".git", "node_modules", ".next", "dist", "build", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".idea", ".ssh")
NOISE = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml")
GENERATED = r"(?i)@generated|DO NOT EDIT|auto-generated"
MOST_BYTES, GENERATED_WITHIN = 1_000_000, 500


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"[.+^$(){}|\[\]\\]", r"\\$0")


def wildcard_regex(pattern: Column) -> Column:
    """A pattern whose ``*`` stands for any characters, and ``?`` for one, as a regular expression for whole paths."""
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(_quoted(pattern), r"\*", ".*"), r"\?", "."), F.lit("$"))


def matching_paths(patterns: DataFrame, paths: DataFrame, least: int = 3) -> DataFrame:
    """(pattern, path): paths that a pattern matches, or that stand at its end after a slash.

    Patterns without a wildcard, and the ends of all, meet paths by equality. A pattern
    with one meets the paths that begin as it does, if that is at least ``least``
    characters, else those that end as it does, and is tried on these alone.
    """
    asked = stored(patterns.select("pattern").distinct().withColumn("p", F.regexp_replace("pattern", r"^[./]+", "")), "path-patterns")
    known = paths.select("path").distinct()
    parts = F.split("pattern", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>"))
    exact = asked.select("pattern", F.explode(F.array_distinct(F.concat(F.array("p"), ends))).alias("path")).filter("path <> ''")
    found = known.join(size_checked(stored(exact, "exact-paths"), 48, ["pattern", "path"]), "path").select("pattern", "path")

    wild = asked.filter(F.col("p").rlike(r"[*?]")).select("pattern", "p", F.regexp_extract("p", r"^[^*?]*", 0).alias("head"), F.regexp_extract("p", r"[^*?]*$", 0).alias("tail"))
    wild = stored(wild.withColumn("by_head", F.length("head") >= least), "wild-patterns")
    for by_head, name in ((True, "head"), (False, "tail")):
        own = wild.filter(F.col("by_head") == by_head)
        sizes = sorted(r.n for r in own.select(F.length(name).alias("n")).distinct().collect())  # no more than a path is long
        if not sizes:
            continue
        cut = [F.when(F.length("path") >= n, F.left("path", F.lit(n)) if by_head else F.right("path", F.lit(n))) for n in sizes]
        keyed = known.select("path", F.explode(F.array_distinct(F.array_compact(F.array(*cut)))).alias(name))
        tried = keyed.join(size_checked(own, 64, ["pattern", "p", name]), name).filter(F.regexp_like("path", wildcard_regex(F.col("p"))))
        found = found.unionByName(tried.select("pattern", "path"))
    return found.distinct()


def exploration(commands: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, counts): files that commands of a log read as far as that can be told, and what else each run did.

    ``commands`` has run, step, command and exit_code. ``reads`` has run, step and path of
    successful reads; ``counts`` of each run its reads, files, searches, greps, listings,
    reads of which no path is known, and failed tests. Both are lower bounds.
    """
    said = commands.withColumn("command", F.translate("command", "\\", "/"))
    done = said.filter("exit_code = 0")
    segments = done.select("run", "step", F.posexplode(F.regexp_extract_all("command", F.lit(READS), F.lit(1))).alias("nth", "segment"))
    tokens = stored(segments.select("run", "step", "nth", F.explode_outer(F.regexp_extract_all("segment", F.lit(PATHS), F.lit(0))).alias("pattern")), "read-tokens")
    met = matching_paths(tokens.filter("pattern is not null"), paths)
    # Paths that the same patterns match are told as one, by the first of them, with how many they are.
    held = stored(met.groupBy("path").agg(F.array_sort(F.collect_set("pattern")).alias("patterns")), "matched-paths")
    alike = stored(held.groupBy("patterns").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")), "alike-paths")
    by_pattern = stored(alike.select("first", "n", F.explode("patterns").alias("pattern")), "paths-by-pattern")
    members = stored(held.join(alike, "patterns").select("first", "path"), "path-members")
    # One row for each read command and group of paths, however many of its patterns match.
    groups = tokens.join(size_checked(by_pattern, 40, ["first", "pattern"]), "pattern").select("run", "step", "nth", "first", "n").distinct()
    groups = stored(groups, "reads")
    reads = groups.join(size_checked(members, 32, ["first", "path"]), "first")
    unknown = tokens.select("run", "step", "nth").distinct().join(groups.select("run", "step", "nth").distinct(), ["run", "step", "nth"], "left_anti").groupBy("run").agg(F.count(F.lit(1)).alias("unresolved"))
    seen = groups.groupBy("run", "first").agg((F.count(F.lit(1)) * F.first("n")).alias("reads"), F.first("n").alias("files"))
    seen = seen.groupBy("run").agg(F.sum("reads").alias("reads"), F.sum("files").alias("files"))
    times = lambda pattern: F.sum(F.when(F.col("exit_code") == 0, F.regexp_count("command", F.lit(pattern))).otherwise(0))
    failed = F.count_if((F.col("exit_code") != 0) & F.col("command").rlike(TESTS))
    counted = said.groupBy("run").agg(times(SEARCHES).alias("searches"), times(GREPS).alias("greps"), times(LISTINGS).alias("listings"), failed.alias("failed_tests"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("reads", "files", "unresolved", "searches", "greps", "listings", "failed_tests")}
    return reads.select("run", "step", "path"), counted.join(seen, "run", "left").join(unknown, "run", "left").withColumns(zero)


def ignore_rules(lines: DataFrame) -> DataFrame:
    """(base, nth, include, regex) of the lines of ignore files; ``lines`` has base (a folder, "" at the top), nth and line.

    A rule with a slash before its end holds from its folder on, any other at each depth;
    one that ends in a slash is for folders; "!" takes a match back. Comments are dropped.
    """
    bare = F.regexp_replace("line", r"(?<!\\)\s+$", "")
    named = lines.select("base", "nth", bare.alias("p")).filter((F.col("p") != "") & ~F.col("p").startswith("#"))
    named = named.withColumn("include", ~F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", r"^!", ""))
    named = named.withColumn("folder", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", r"/$", ""))
    named = named.withColumn("rooted", F.contains("p", F.lit("/"))).withColumn("p", F.regexp_replace("p", r"^/", "")).filter("p <> ''")
    body = F.regexp_replace(F.regexp_replace("p", r"[.+^$(){}|]", r"\\$0"), r"\[!", "[^")
    for mark, text in ((r"^\*\*/", "\x01"), (r"/\*\*/", "/\x01"), (r"/\*\*$", "\x02"), (r"\*\*", "\x03"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", ".*")):
        body = F.regexp_replace(body, mark, text)
    regex = F.concat(F.lit("(?s)^"), F.when(F.col("rooted"), "").otherwise("(?:.*/)?"), body, F.when(F.col("folder"), "/.*$").otherwise("(?:/.*)?$"))
    return named.select("base", "nth", "include", regex.alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths that ignore rules leave out: the last rule that matches decides, deeper folders after those above.

    What is in an ignored folder stays ignored whatever rules say. A folder is judged once,
    not for each file in it; a path meets only the rules of folders above it, by equality.
    """
    parts = F.split("path", "/")
    known = paths.select("path").distinct()
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    folders = F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))
    within = stored(known.select("path", F.explode(F.concat(folders, F.array("path"))).alias("entity")), "entities")
    entities = within.select("entity").distinct()
    bits = F.split(F.regexp_replace("entity", "/$", ""), "/")
    above = F.concat(F.array(F.lit("")), F.when(F.size(bits) > 1, F.transform(F.sequence(F.lit(1), F.size(bits) - 1), lambda i: F.array_join(F.slice(bits, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    bases = entities.select("entity", F.posexplode(above).alias("depth", "base"))
    own = stored(rules, "ignore-rules")
    met = bases.join(size_checked(own, 32, ["base", "regex"]), "base")
    relative = F.when(F.col("base") == "", F.col("entity")).otherwise(F.substring("entity", F.length("base") + 2, F.length("entity")))
    met = met.filter(F.regexp_like(relative, F.col("regex")))
    last = met.groupBy("entity").agg(F.max_by("include", F.struct("depth", "nth")).alias("out")).filter("out").select("entity")
    return within.join(size_checked(stored(last, "ignored-entities"), 24, ["entity"]), "entity", "left_semi").select("path").distinct()


def scan_policy(files: DataFrame, rules: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(path, reason): why a scan leaves a file out, the first rule that applies; null where it is taken. ``files`` has path and content."""
    name = F.lower(F.substring_index("path", "/", -1))
    folders = F.split("path", "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    out = ignored(files.select("path"), rules).withColumn("out", F.lit(True))
    any_of = lambda test, values: F.greatest(*[test(v) for v in values], F.lit(False))
    text = F.col("content")
    reason = (
        F.when(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED])) | F.exists(folders, lambda d: d.startswith(".env")), "excluded_folder")
        .when(~any_of(name.endswith, extensions), "extension")
        .when(name.isin(*NOISE), "noise")
        .when(any_of(name.startswith, (".env", "secret", "credential")), "secret_name")
        .when(any_of(name.endswith, (".min.js", ".min.css", ".d.ts")), "minified")
        .when(F.coalesce("out", F.lit(False)), "ignored")
        .when(F.octet_length(text) > MOST_BYTES, "too_large")
        .when(F.contains(text, F.lit("\x00")), "binary")
        .when(F.contains(text, F.lit("-----BEGIN ")) & F.contains(text, F.lit("PRIVATE KEY-----")), "private_key")
        .when(F.left(text, F.lit(GENERATED_WITHIN)).rlike(GENERATED), "generated")
    )
    return files.join(out, "path", "left").select("path", reason.alias("reason"))
