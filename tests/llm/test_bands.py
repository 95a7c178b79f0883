"""What the bands reject and keep, beyond the base rules."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import fertility, tokens

from . import cases


def test_share_of_bad_rejected_and_of_good_kept(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = fertility.fertility_rules(docs.join(labels, "doc_id")).filter("not base_failed").select("lang", "quality", "kept").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    english = [r for r in bad if r.lang == "en"]
    assert len(bad) >= 15 and len(english) >= 8 and len(good) > 200
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)
    assert sum(not r.kept for r in english) >= 0.9 * len(english)
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def noise(kind):
    pick = random.Random(3)
    word = {
        "symbols": lambda: "".join(pick.choice("#*$%&|<>~^=+-_@!") for _ in range(pick.randint(1, 8))),
        "emoji": lambda: pick.choice("\U0001f600\U0001f602\U0001f389\U0001f525\u2728"),
        "rules": lambda: pick.choice(("----", "====")),
        "mash": lambda: "".join(pick.choice("asdfghjklqwertyuiop") for _ in range(pick.randint(3, 9))),
    }[kind]
    return " ".join(word() for _ in range(300))


@pytest.mark.parametrize(("kind", "lang"), [("symbols", None), ("emoji", None), ("rules", "xx"), ("mash", "en")])
def test_noise_is_rejected_by_its_band(spark, kind, lang):
    docs = spark.createDataFrame([(1, noise(kind), lang)], "doc_id long, text string, lang string")
    (row,) = fertility.fertility_rules(docs).collect()
    assert not row.kept and (row.base_failed or row.script == ("Latin" if kind == "mash" else ""))


def test_scripts():
    assert fertility.script_of("\u0939\u093f\u0928\u094d\u0926\u0940 \u092e\u0947\u0902 \u0932\u0947\u0916 GPU") == "Other"
    assert fertility.script_of("\u05d0\u05d1\u05d2 ab") == "Other"
    assert fertility.script_of("\u05d0\u05d1 ab") == "Latin"
    assert fertility.script_of("\u0436\u0437 x \u2728") == "Cyrillic"
    assert fertility.script_of("\u2728 12") == fertility.script_of("12 #") == ""


MIXED = [
    "plain words and more",
    "caf\u00e9 na\u00efve stra\u00dfe \u0142\u00f3d\u017a",
    "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440",
    "\u6f22\u5b57 \u304b\u306a \ud55c\uad6d\uc5b4",
    "\u0627\u0644\u0644\u063a\u0629 \u05e2\u05d1\u05e8\u05d9\u05ea \u0939\u093f\u0928\u094d\u0926\u0940",
    "\U0001f600 \u2728 \u222b\u2211 \u16a0\u16a2",
    "x\ny\tz",
]


@pytest.mark.parametrize("text", MIXED)
def test_fallback_share_is_that_of_the_vocabulary(text):
    """Byte pieces of a real encoding, but for those of line feeds and tabs."""
    import sentencepiece

    path = tokens.vocabulary_path(tokens.PIECE_VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = sum(model.is_byte(i) and int(model.id_to_piece(i)[1:-1], 16) not in (9, 10) for i in model.encode(text))
    assert fertility.token_figures(text, tokens.vocabulary_path(tokens.VOCABULARY), path)[2] == pytest.approx(spelt / len(text.encode()))


def brute(text, lang):
    """Every figure and the verdict in plain code: regex words, the tokenizers library, sentencepiece."""
    import math
    import re
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        again += bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen
        seen.add(line)
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered))
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    if not text:
        return (*counts, 0, None, None, None, failed, False)
    ids = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY)).encode(text, add_special_tokens=False).ids
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(tokens.PIECE_VOCABULARY))
    spelt = sum(model.is_byte(i) and int(model.id_to_piece(i)[1:-1], 16) not in (9, 10, 11, 12, 13) for i in model.encode(text))
    shares = [n / len(ids) for n in Counter(ids).values()]
    bits = -sum(s * math.log2(s) for s in shares) + 0.0
    chars, fallback = len(text) / len(ids), spelt / len(text.encode())
    band = fertility.BANDS.get(lang) or fertility.BANDS["Latin"]
    kept = not failed and band.least_chars <= chars <= band.most_chars and fallback <= band.most_fallback and band.least_bits <= bits <= band.most_bits
    return (*counts, len(ids), chars, fallback, bits, failed, kept)


def test_all_figures_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = {r.doc_id: brute(r.text, r.lang) for r in docs.collect()}
    for r in fertility.quality_digest(docs).collect():
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, r.chars_per_token, r.fallback_share, r.entropy_bits, r.base_failed, r.kept)
        assert found == pytest.approx(plain[r.doc_id], nan_ok=True), r.doc_id


def test_clashing_and_missing_columns(spark):
    docs = cases.docs(spark).withColumnRenamed("hash", "_row").withColumnRenamed("key", "n_words")
    assert fertility.keep_good(docs).columns == docs.columns and fertility.keep_good(docs.drop("lang")).count() == fertility.keep_good(docs.withColumn("lang", F.lit(None).cast("string"))).count()
    found = fertility.fertility_rules(docs)
    assert found.columns.count("n_words") == found.columns.count("kept") == 1 and "_row" in found.columns and len(found.collect()) == len(cases.ROWS)
