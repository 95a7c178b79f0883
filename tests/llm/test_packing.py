"""Exact round trips of both packings, against the tokenizer library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadloom.llm import best_fit, hilbert_pack, tokens

from . import cases


@pytest.fixture(scope="module")
def exact():
    found = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_those_of_the_library(exact):
    ours = tokens.byte_bpe(tokens.vocabulary_path(tokens.VOCABULARY))
    pick = random.Random(5)
    letters = "ab Zé\n\t'sll  \u0085ß漢😀٣½#*<|endoftext|>’—Ж\x1c "
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, *[r[1] or "" for r in cases.ROWS]]:
        assert ours.ids(text).tolist() == exact(text)[:-1], repr(text)


def test_best_fit_takes_the_fullest_row():
    pick = np.random.default_rng(3)
    for _ in range(60):
        sizes = pick.integers(1, 65, pick.integers(0, 80))
        rooms: list[int] = []
        for size in sorted(sizes.tolist(), reverse=True):
            if fits := [r for r in rooms if r >= size]:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(64 - size)
        rows = best_fit.best_fit(sizes, 64)
        assert sorted(x for row in rows for x in row) == list(range(len(sizes)))
        assert sorted(64 - sum(int(sizes[x]) for x in row) for row in rows) == sorted(rooms)


def check_rows(rows, docs, exact, length):
    whole = defaultdict(list)
    for row in rows:
        ids, positions = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.positions, "<u4")
        assert len(ids) == len(positions) == length and row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens
        for i, (a, b) in enumerate(zip(row.cu_seqlens, row.cu_seqlens[1:], strict=False)):
            assert positions[a:b].tolist() == list(range(b - a)) and b > a
            whole[row.doc_ids[i]].append((row.starts[i], ids[a:b].tolist()))
    expected = defaultdict(list)
    for doc_id, text in docs:
        ids = exact(text)
        expected[doc_id] += [(at, ids[at : at + length]) for at in range(0, len(ids), length)]
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in expected.items()}
    assert len({r.row_id for r in rows}) == len(rows)


def test_pack_best_fit_round_trip(spark, small, exact):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = best_fit.pack_best_fit(docs, length=512, window_tokens=20_000).collect()
    check_rows(rows, docs.select("doc_id", "text").collect(), exact, 512)
    assert sum(r.n_tokens for r in rows) / (512 * len(rows)) > 0.97


def test_pack_best_fit_awkward_rows(spark, exact):
    check_rows(best_fit.pack_best_fit(cases.docs(spark)).collect(), [r[:2] for r in cases.ROWS], exact, 2048)
    assert best_fit.pack_best_fit(cases.empty(spark)).collect() == []


def test_write_matrices_refuses_to_overwrite(spark, tmp_path):
    packed = best_fit.pack_best_fit(cases.docs(spark))
    best_fit.write_matrices(packed, f"file://{tmp_path}/m")
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == packed.count()
    with pytest.raises(Exception, match="already exists"):
        best_fit.write_matrices(packed, f"file://{tmp_path}/m")


def check_pieces(rows, docs, exact):
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id].append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(exact(text))
    assert set(whole) == set(texts)
    for doc_id, own in texts.items():
        assert sum(len(p[2]) for p in whole[doc_id]) == sum(map(len, own))
        if len(own) == 1:
            assert [x for p in sorted(whole[doc_id]) for x in p[2]] == own[0]
            assert all(p[1] == len(own[0]) for p in whole[doc_id])
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == len(sequences) - 1 and at <= 2048


def test_curve_round_trip(spark, small, exact):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = hilbert_pack.pack_along_curve(docs).collect()
    check_pieces(rows, docs.select("doc_id", "text").collect(), exact)


def test_curve_with_many_ranges(spark, small, exact, monkeypatch):
    monkeypatch.setattr(hilbert_pack, "RANGE_TOKENS", 3000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_pieces(hilbert_pack.pack_along_curve(docs).collect(), docs.select("doc_id", "text").collect(), exact)


def test_curve_awkward_rows(spark, exact):
    check_pieces(hilbert_pack.pack_along_curve(cases.docs(spark)).collect(), [r[:2] for r in cases.ROWS], exact)
    assert hilbert_pack.pack_along_curve(cases.empty(spark)).collect() == []


def test_hilbert_curve_visits_neighbours():
    side = 1 << 3
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = hilbert_pack.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_lie_close_on_the_curve():
    pick = np.random.default_rng(1)
    base = pick.integers(0, 50_000, 400)
    near = base.copy()
    near[:10] = pick.integers(0, 50_000, 10)
    far = pick.integers(0, 50_000, 400)
    a, b, c = (hilbert_pack.curve_place(x, 50_257) for x in (base, near, far))
    assert np.abs(a - b).sum() < np.abs(a - c).sum()
