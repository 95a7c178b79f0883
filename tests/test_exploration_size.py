"""What an exploration writes grows with commands, not with the files that a pattern matches."""

from __future__ import annotations

from threadloom.operators import globs


def test_files_of_one_pattern_are_written_as_one(spark, monkeypatch):
    written = {}
    kept = globs.stored

    def spy(df, name, **more):
        written[name] = kept(df, name, **more)
        return written[name]

    monkeypatch.setattr(globs, "stored", spy)
    paths = spark.createDataFrame([(f"docs/f{i}.md",) for i in range(30)] + [("docs/g.md",)], "path string")
    commands = [(run, step, "cat docs/*.md docs/g.md; cat docs/f1*.md", 0) for run in (1, 2) for step in (1, 2)] + [(2, 3, "cat nothing.md", 0)]
    reads, counts = globs.exploration(spark.createDataFrame(commands, "run long, step long, command string, exit_code int"), paths)
    assert reads.count() == 4 * (31 + 11)
    assert {(r.run, r.reads, r.files, r.unresolved) for r in counts.collect()} == {(1, 2 * 42, 31, 0), (2, 2 * 42, 31, 1)}
    assert written["reads"].count() == 4 * (3 + 1)
