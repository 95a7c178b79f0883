"""Alignment against the rule written plainly, token by token."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from threadloom.llm import alignment
from threadloom.llm.tokens import PIECE_VOCABULARY, VOCABULARY, vocabulary_path

from .cases import ROWS, docs, empty

EXTRA = [(90, "a▁b c", "en", "a", 5), (91, "<s> </s> <unk> <0x41> <|endoftext|>", "en", "a", 9), (92, " ", "en", "a", 1), (93, "\n\n\t  x", "en", "a", 6), (94, "naïve 漢字 🙂🙂 ﬁ Å", "en", "a", 16)]


def plainly(rows):
    """The contract's row of each (doc_id, text), by lists and loops."""
    a_model = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECE_VOCABULARY))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    spans, out = [], []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_model.encode(text) if text else []:
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        placed = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                own.append((i, at, at + len(x)))
                at += len(x)
            placed.append(own)
        spans.append(placed)
    links = []
    for a, b in spans:
        own, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    own.append((i, b[j][0]))
                j += 1
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (doc, _), (a, b), own in zip(rows, spans, links, strict=True):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in tokens if begin < e <= cut) for tokens in (a, b)) if len(a) < 500 else None)
            begin = cut
        text = ";".join(groups) if None not in groups else None
        digest = "" if not a else text and hashlib.sha256(text.encode()).hexdigest()
        out.append((doc, len(a), len(b), len(cuts), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), digest))
    return out


def check(found, rows):
    """Digests of long texts are left to the small tables, as the plain way is quadratic."""
    ours = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()), key=str)
    wanted = sorted(plainly(rows), key=str)
    assert len(ours) == len(wanted)
    for x, y in zip(ours, wanted, strict=True):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7]), (x, y)


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_awkward_rows(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    rows = ROWS + EXTRA
    found = alignment.aligned(docs(spark, rows).withColumnRenamed("key", "n_a"))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check(found, [(r[0], r[1]) for r in rows])
    assert {r.groups_sha256 for r in found.filter("doc_id in (1, 2, 90)").collect()} == {""}


def test_given_documents(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    check(alignment.alignment_digest(table), [(r.doc_id, r.text) for r in table.collect()])


def test_empty_table_and_texts_without_tokens(spark):
    assert alignment.aligned(empty(spark)).collect() == []
    found = alignment.aligned(docs(spark, ROWS[:2])).collect()
    assert [r[1:] for r in found] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_partial_counts_are_handed_on(spark, small, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500)
    table = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    check(alignment.alignment_digest(table), [(r.doc_id, r.text) for r in table.collect()])


def test_wide_ids_are_kept(spark):
    import numpy as np

    codes = np.array([(70_000 << 32) | 3, (1 << 32) | 90_000], dtype=np.uint64)
    assert [alignment._unpacked(x).tolist() for x in alignment._packed(codes, np.array([0, 1, 2]))] == [[int(codes[0])], [int(codes[1])]]
    assert alignment._unpacked(alignment._packed(codes[:0], np.array([0, 0]))[0]).tolist() == []
