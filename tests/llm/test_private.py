"""Personal data and secrets against plain code."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import disclosure, ownership

from . import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def luhn(value):
    d = [int(c) for c in re.sub("[^0-9]", "", value)][::-1]
    return 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def personal(text):
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if luhn(m[0])]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end(), m[0]) for k, m in found]


def secret(text):
    found = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return [(k, a, b, v) for a, _, k, b, v in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def noise(seed, letters, count=400, longest=60):
    pick = random.Random(seed)
    parts = letters.split("|")
    return [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, longest))), "en", "a", 1) for i in range(count)]


PARTS = "a|b.|c@|@|.|d-e|x_|1|22|255|256|4111 1111|-|4111111111111111|+|+49 |(0)| |\n|é|漢|😀|10.0.0.1|a@b.c|,"
SECRETS = "token|Password|=|:| |'|\"|AKIA|ABCDEF0123456789|0123456789abcdef|deadbeef|api_key|APIKEY=|secret= |x|-|z.z|\n|é|abcdefABCDEF0123456789xyz|k|ſ|İ|api_Key"


@pytest.mark.parametrize("table", ["noise", "awkward", "real"])
def test_personal_data_against_plain_code(spark, small, table):
    if table == "real":
        docs = spark.read.parquet(f"{small}/documents.parquet")
    else:
        docs = cases.docs(spark, noise(1, PARTS) if table == "noise" else cases.ROWS)
    plain = docs.select("doc_id", "text").collect()
    rows = disclosure.personal_digest(docs).collect()
    expected = []
    for r in plain:
        spans = personal(r.text or "")
        n = Counter(s[0] for s in spans)
        expected.append((str(r.doc_id), *[n[k] for k in disclosure.KINDS], hashlib.sha256(joined(spans).encode()).hexdigest()))
        match = [x.spans for x in rows if x.doc_id == r.doc_id]
        assert any(s.startswith(joined(spans)) for s in match)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == sorted(expected)


def test_long_runs_do_not_stall(spark):
    long = ["a" * 200_000, "1" * 200_000, "a@b" + ".c" * 100_000, "1 " * 100_000, "+1" + "(" * 100_000, "a." * 100_000, "0123456789abcdef" * 10_000, "token" * 40_000]
    docs = cases.docs(spark, [(i, x, "en", "a", 1) for i, x in enumerate(long)])
    rows = {r.doc_id: r for r in disclosure.personal_digest(docs).collect()}
    assert rows[2].n_email == 1 and sum(r.n_email for r in rows.values()) == 1
    assert {r.doc_id: r.n_hex for r in ownership.secrets_digest(docs).collect()}[6] == 1


CUT = re.compile(r"[\x20\x09-\x0D.,;:!?\"'()\[\]]+")
TERM = re.compile(r"[^\x20\x09-\x0D.,;:!?\"'()\[\]]+")


def tokens_of(text, rules):
    """Mentions and the terms that meet none, in order: (start, end, entity or None, term or None)."""
    spans = [(a, b, f"{k}:{v.lower() if k == 'email' else re.sub('[^0-9]', '', v)}") for k, a, b, v in personal(text)]
    out = [(a, 0, b, e, None) for a, b, e in spans]
    for m in TERM.finditer(text):
        if len(m[0]) >= rules.shortest and not any(a < m.end() and m.start() < b for a, b, _ in spans):
            out.append((m.start(), 1, m.end(), None, m[0].lower()))
    return [(a, b, e, t) for a, _, b, e, t in sorted(out, key=lambda x: x[:2])]


def revealing(docs, rules=disclosure.Disclosure()):  # noqa: B008
    """{(doc, start, end): share}, by brute force over the tokens of each text."""
    n_e, n_t, both = Counter(), Counter(), Counter()
    where, mentioned = defaultdict(set), defaultdict(set)
    total = 0
    for doc, text in docs:
        said = [t for t in CUT.split(text.lower()) if len(t) >= rules.shortest]
        total += len(said)
        n_t.update(said)
        tokens = tokens_of(text, rules)
        for i, (_, _, e, _) in enumerate(tokens):
            if e:
                around = [t for *_, t in tokens[max(0, i - rules.reach) : i + rules.reach + 1] if t]
                n_e[e] += 1
                mentioned[doc].add(e)
                context = tuple(dict.fromkeys(around))
                where[e].add(context)
                for t in set(around):
                    both[e, t] += 1
                    where[e, t].add(context)
    shares = {}
    for (e, t), n in both.items():
        bits = -math.log2(min(1, n_e[e] * 2 * rules.reach / total))
        if len(where[e]) >= rules.contexts and len(where[e, t]) >= rules.contexts and bits >= rules.least_bits:
            shares[e, t] = 1 + math.log2(min(1, n / n_t[t])) / bits
    out = {}
    for doc, text in docs:
        for a, b, _, t in tokens_of(text, rules):
            share = max((shares.get((e, t), 0) for e in mentioned[doc]), default=0)
            if t and share >= rules.generalise:
                out[doc, a, b] = share
    return out


def test_terms_that_reveal_an_entity(spark):
    pick = random.Random(8)
    word = lambda: f"w{pick.randrange(60)}"
    docs = [(i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(12))) for i in range(150)]
    for i in range(5):  # one field a line: what reveals the address stands on other lines
        docs.append((200 + i, f"first {word()} line\n{word()} zorkville\nwrite to Kim.Lee@corp.example.com\nask {word()} for quux {word()}\n" + " ".join(word() for _ in range(20)) + "\nback in Zorkville"))
    docs += [(300 + i, f"{word()} quux {word()}") for i in range(9)]
    docs += [(400 + i, docs[152][1]) for i in range(4)]
    expected = revealing(docs)
    text_of = dict(docs)
    assert {text_of[d][a:b] for d, a, b in expected} >= {"zorkville", "Zorkville", "quux"}
    table = cases.docs(spark, [(i, t, "en", "a", 1) for i, t in docs])
    rows = disclosure.sanitise(table).collect()
    assert table.columns + ["personal"] == list(rows[0].asDict())
    for r in rows:
        got = {(s.start, s.end, s.value, s.kind) for s in r.personal.terms}
        want = {(a, b, text_of[doc][a:b], "removed_term" if share >= 0.9 else "general_term") for (doc, a, b), share in expected.items() if doc == r.doc_id}
        assert got == want
        for s in r.personal.terms:
            assert text_of[r.doc_id][s.start : s.end] == s.value
            assert s.kind == "general_term" or s.value not in r.personal.text
        if r.doc_id >= 200 and "@" in text_of[r.doc_id]:
            assert "[EMAIL]" in r.personal.text and "@" not in r.personal.text
        else:
            assert r.personal.text == text_of[r.doc_id]


def test_many_matches_in_one_text_take_seconds(spark):
    n = 50_000
    many = "".join(f"to user{i}@mail.example.com now\n" for i in range(n))
    keys = "".join(f"token: {i:x}Zk3vQ9xLm2Rt8WbN, Ab1Cd2Ef3Gh4Ij5Kl{i:06d}\n" for i in range(n))
    docs = cases.docs(spark, [(1, many, "en", "a", 1), (2, keys, "en", "a", 1)], partitions=2)
    begin = time.perf_counter()
    row = disclosure.sanitise(docs).filter("doc_id = 1").first()
    assert len(row.personal.base) == n and row.personal.text == "to [EMAIL] now\n" * n
    row = ownership.find_secrets(docs).filter("doc_id = 2").first()
    assert len(row.secrets.base) == n and len(row.secrets.tokens) == n
    assert time.perf_counter() - begin < 120


def test_result_columns_replace_those_of_their_name(spark):
    docs = cases.docs(spark).withColumnsRenamed({"kept": "personal", "hash": "secrets", "key": "row", "spans": "text_key"})
    for found, name in ((disclosure.sanitise(docs), "personal"), (ownership.find_secrets(docs), "secrets")):
        assert found.columns == [c for c in docs.columns if c != name] + [name]
        assert len(found.select("*").collect()) == docs.count()


@pytest.mark.parametrize("table", ["noise", "awkward", "real"])
def test_secrets_against_plain_code(spark, small, table):
    if table == "real":
        docs = spark.read.parquet(f"{small}/documents.parquet")
    else:
        docs = cases.docs(spark, noise(2, SECRETS) if table == "noise" else cases.ROWS)
    plain = docs.select("doc_id", "text", "source").collect()
    owners = defaultdict(set)
    for r in plain:
        for _, _, _, v in secret(r.text or ""):
            owners[v].add(r.source or "")
    expected = []
    for r in plain:
        spans = secret(r.text or "")
        n = Counter(s[0] for s in spans)
        expected.append((str(r.doc_id), *[n[k] for k in ownership.KINDS], hashlib.sha256(joined(spans).encode()).hexdigest(), sum(len(owners[s[3]]) >= 3 for s in spans)))
    rows = ownership.secrets_digest(docs).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.n_example) for r in rows) == sorted(expected)
    for r in rows:
        assert r.n_live + r.n_example + r.n_unclear == r.n_assign + r.n_access + r.n_hex


def test_examples_and_live_secrets(spark):
    rows = [(i, "use password=abcdef0123456789zz here", "en", f"s{i}", 1) for i in range(3)]
    rows += [(10, "token: Zk3vQ9xLm2Rt8WbN", "en", "s1", 1), (11, "token: Zk3vQ9xLm2Rt8WbN", "de", "s1", 1)]
    rows += [(12, "secret=aaaaaaaaaaaaaaaa1", "en", "s1", 1), (13, "see Ab1Cd2Ef3Gh4Ij5Kl6Mn7 there", "en", "s9", 1)]
    found = {r.doc_id: r.secrets for r in ownership.find_secrets(cases.docs(spark, rows)).collect()}
    assert {found[i].base[0]["class"] for i in range(3)} == {"example"}
    assert found[10].base[0]["class"] == "live" and found[11].base[0]["class"] == "live"
    assert found[12].base[0]["class"] == "unclear"
    assert [(s.kind, s.start, s.end) for s in found[13].tokens] == [("token", 4, 25)] and not found[13].base


def test_repositories_tell_reused_and_copied_values(spark):
    """One owner in one or two repositories; two owners in few, and in eight."""
    rows = [(1, "token: Zk3vQ9xLm2Rt8WbN", "en", "a", 1), (2, "token: Qk3vQ9xLm2Rt8WbM", "en", "a", 1), (3, "token: Qk3vQ9xLm2Rt8WbM", "de", "a", 1)]
    rows += [(4, "token: Tk3vQ9xLm2Rt8WbT", "en", "a", 1), (5, "token: Tk3vQ9xLm2Rt8WbT", "en", "b", 1)]
    rows += [(10 + i, "token: Vk3vQ9xLm2Rt8WbV", f"l{i % 4}", "ab"[i // 4], 1) for i in range(8)]
    docs = cases.docs(spark, rows + rows)
    found = {r.doc_id: r.secrets.base[0] for r in ownership.find_secrets(docs).collect()}
    assert {i: (found[i]["class"], found[i].n_owners, found[i].n_repos) for i in (1, 2, 3, 4, 5, 10)} == {
        1: ("live", 1, 1), 2: ("live", 1, 2), 3: ("live", 1, 2), 4: ("unclear", 2, 2), 5: ("unclear", 2, 2), 10: ("example", 2, 8),
    }
    told = {r.doc_id: (r.n_reused, r.owners_repos) for r in ownership.secrets_digest(docs).collect()}
    assert told[1] == (0, "1:1") and told[3] == (1, "1:2") and told[17] == (0, "2:8")


def test_empty_tables(spark):
    assert disclosure.personal_digest(cases.empty(spark)).collect() == []
    assert ownership.secrets_digest(cases.empty(spark)).collect() == []
    kept = disclosure.sanitise(cases.docs(spark)).filter(F.col("text").isNull()).first()
    assert kept.personal.text is None and kept.personal.base == []
