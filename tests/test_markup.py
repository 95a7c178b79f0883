"""Declarations against a stack, units and bindings by hand."""

import random
import re

from threadloom.sources import markup


def by_stack(content):
    """(nth, kind, low, high, level, parent) by one stack for each kind, then by containment."""
    line, at, open_, found = 1, 0, {}, []
    for m in re.finditer(r"\n|<(/?)(div|section|ul|h1)\b[^>]*>", content):
        at += 1
        if m[0] == "\n":
            line += 1
        elif not m[1]:
            found.append([at, 10**9, m[2], line, None])
            open_.setdefault(m[2], []).append(found[-1])
        elif open_.get(m[2]):
            mine = open_[m[2]].pop()
            mine[1], mine[4] = at, line
    out = []
    for i, (a, b, kind, low, high) in enumerate(found):
        outer = [j + 1 for j, (c, d, *_) in enumerate(found) if c < a and d > a]
        out.append((i + 1, kind, low, high or line, len(outer), max(outer, default=None)))
    return out


def test_nested_elements_equal_a_stack(spark):
    pick = random.Random(12)
    texts = []
    for _ in range(30):
        stack, parts = [], []
        for _ in range(60):
            if stack and pick.random() < 0.45:
                parts.append(f"</{stack.pop()}>")
            elif pick.random() < 0.7:
                stack.append(pick.choice(["div", "section", "ul"]))
                parts.append(f"<{stack[-1]} class='x'>")
            else:
                parts.append(pick.choice(["\n", "text", "<p>", "<b>", "</b>", "<br>"]))
        texts.append("".join(parts + [f"</{k}>" for k in reversed(stack)][: pick.choice([0, 99])]))
    texts += ["", "no mark", "</div></div><div>\n<div></div>\n</div></div>", "<DIV>\n</DiV><divider>"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")
    found = {}
    for r in markup.declarations(files).collect():
        found.setdefault(r.path, []).append((r.nth, r.kind, r.low, r.high, r.level, r.parent))
    for i, t in enumerate(texts):
        assert sorted(found.get(f"f{i}", [])) == by_stack(t.replace("DIV", "div").replace("DiV", "div")), i


def test_names_and_units(spark):
    content = '<article id="Main">\n<h1>A  Title</h1>\n<div class="box">\ntext\n</div>\n</article>\nend'
    files = spark.createDataFrame([("a.html", content), ("b.html", "<div>x</div>"), ("null.html", None)], "path string, content string")
    declared = markup.declarations(files)
    assert sorted((r.path, r.nth, r.name, r.low, r.high, r.level, r.parent) for r in declared.collect()) == [
        ("a.html", 1, "main", 1, 6, 0, None), ("a.html", 2, "a  title", 2, 2, 1, 1), ("a.html", 3, "box", 3, 5, 1, 1), ("b.html", 1, "div", 1, 1, 0, None),
    ]
    units = {r.unit_id: r for r in markup.repository_units(files, declared).collect()}
    assert units["a.html::box:3"].parent_id == "a.html::main:1" and units["a.html::box:3"].content == '<div class="box">\ntext\n</div>\n'
    assert units["a.html::main:1"].parent_id == "a.html" and units["a.html"].parent_id is None and units["b.html::div:1"].content == "<div>x</div>"


def test_bindings_by_hand(spark):
    declared = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("a", 3, "two"), ("b", 1, "one")], "path string, nth long, name string")
    bindings = spark.createDataFrame([("x", "a", "one"), ("x", "a", "two"), ("x", "a", "none"), ("x", None, "one"), ("a", "a", "one"), ("y", "b", "one"), ("y", "b", "one")], "file string, target string, name string")
    found = sorted(tuple(r) for r in markup.bound_symbols(bindings, declared).collect())
    assert found == [("references", "x", "a"), ("references_symbol", "x", "a::one:1"), ("references_symbol", "y", "b::one:1")]
