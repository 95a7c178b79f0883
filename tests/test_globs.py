"""Patterns on paths against plain matching, ignore rules by hand, and a log by hand."""

import fnmatch
import random

from threadloom.operators import globs


def test_patterns_equal_plain_matching(spark):
    pick = random.Random(6)
    names = ["a", "ab", "abc", "b.py", "c.ts", "[x]", "d+e"]
    paths = sorted({"/".join(pick.choice(names) for _ in range(pick.randint(1, 4))) + pick.choice([".py", ".md"]) for _ in range(150)})
    patterns = {p.replace(pick.choice("abc/."), pick.choice(["*", "?", "*"]), 1) for p in pick.sample(paths, 60)} | set(pick.sample(paths, 10)) | {"./" + p for p in paths[:5]} | {"/root/" + p for p in paths[:5]} | {"*.py", "?.md", "a*", "*", "nothing.py"}
    found = globs.matching_paths(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    plain = lambda path, p: fnmatch.fnmatchcase(path, p.lstrip("./").replace("[", "[[]")) or p.endswith("/" + path)
    assert {(r.pattern, r.path) for r in found.collect()} == {(p, x) for p in patterns for x in paths if plain(x, p)}


def test_ignore_rules_by_hand(spark):
    lines = {
        "": ["# comment", "*.log", "!keep.log", "/top.txt", "build/", "docs/**/draft?.md", "a b.txt   ", "", "!", "deep/**", "[!x]y.py"],
        "pkg": ["*.md", "!/README.md", "*.log"],
    }
    table = spark.createDataFrame([(b, i, x) for b, own in lines.items() for i, x in enumerate(own)], "base string, nth int, line string")
    out = {
        "x.log", "src/x.log", "top.txt", "build/a/keep.log", "src/build/x.py", "docs/draft1.md", "docs/a/b/draft2.md", "a b.txt", "deep/x.py", "zy.py", "pkg/notes.md", "pkg/sub/README.md", "pkg/keep.log",
    }
    kept = {"keep.log", "src/keep.log", "src/top.txt", "build", "docs/draft12.md", "xy.py", "pkg/README.md", "README.md", "src/logs.py", "deep"}
    paths = spark.createDataFrame([(p,) for p in out | kept], "path string")
    assert {r.path for r in globs.ignored(paths, globs.ignore_rules(table)).collect()} == out
    assert globs.ignored(paths, globs.ignore_rules(table).limit(0)).collect() == []


def test_scan_policy_by_hand(spark):
    rows = {
        "src/a.py": ("x", None), "src/a.exe": ("x", "extension"), "node_modules/a.py": ("x", "excluded_folder"), "x/.env.d/a.py": ("x", "excluded_folder"), "yarn.lock": ("x", "extension"), "package-lock.json": ("x", "noise"),
        "src/Secrets.py": ("x", "secret_name"), "a.min.js": ("x", "minified"), "a.d.ts": ("x", "minified"), "b.log.txt": ("x", "ignored"), "big.md": ("y" * 1_000_001, "too_large"), "nul.md": ("a\x00b", "binary"),
        "key.md": ("-----BEGIN RSA PRIVATE KEY-----", "private_key"), "gen.ts": ("// @Generated by x", "generated"), "late.ts": (" " * 500 + "@generated", None), "null.md": (None, None),
    }
    files = spark.createDataFrame([(p, c) for p, (c, _) in rows.items()], "path string, content string")
    rules = globs.ignore_rules(spark.createDataFrame([("", 0, "*.log.*")], "base string, nth int, line string"))
    assert {r.path: r.reason for r in globs.scan_policy(files, rules).collect()} == {p: reason for p, (_, reason) in rows.items()}


def test_a_log_by_hand(spark):
    commands = [
        (1, 1, "cat src/a.py src/?.py; cat src/a.py", 0), (1, 2, "Get-Content C:\\repo\\src\\b.py", 0), (1, 3, "cat $FILE | head", 0), (1, 4, "cat src/a.py", 1), (1, 5, "pytest -q; cat src/a.py", 2),
        (1, 6, "rg --files; RG foo; ls; grep x; select-string y", 0), (2, 1, "echo", 0),
    ]
    paths = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("src/bb.py",)], "path string")
    reads, counts = globs.exploration(spark.createDataFrame(commands, "run long, step long, command string, exit_code int"), paths)
    assert sorted((r.run, r.step, r.path) for r in reads.collect()) == [(1, 1, "src/a.py"), (1, 1, "src/a.py"), (1, 1, "src/b.py"), (1, 2, "src/b.py")]
    got = {r.run: (r.reads, r.files, r.searches, r.greps, r.listings, r.unresolved, r.failed_tests) for r in counts.collect()}
    assert got == {1: (4, 2, 2, 1, 2, 1, 1), 2: (0, 0, 0, 0, 0, 0, 0)}
