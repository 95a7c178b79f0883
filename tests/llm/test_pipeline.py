"""Each stage on what the one before it kept, against brute force."""

import corpus_pipeline
from threadloom.llm import fertility

from . import cases
from .plain_lines import plain_passages
from .test_bands import brute
from .test_latent import words
from .test_packing import check_pieces
from .test_packing import exact  # noqa: F401
from .test_near_copies import plain_kept as near_kept


def test_stages_against_brute_force(spark, small, exact):  # noqa: F811
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    docs = stages["quality_rules"](spark, docs, small)
    kept = {i: r.text for i, r in plain.items() if brute(r.text, r.lang)[-1]}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and docs.columns == columns

    docs = stages["line_dedup"](spark, docs, small)
    kept = {key[0]: row[0] for key, row in plain_passages(list(kept.items())).items()}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and docs.columns == columns

    docs = stages["near_dedup"](spark, docs, small)
    expected = near_kept(list(kept.items()))
    found = {r.doc_id: r.text for r in docs.collect()}
    # No document goes without a near copy that stays; at least nine tenths of the copies go.
    assert expected <= set(found) and docs.columns == columns and len(set(found) - expected) <= 0.1 * (len(kept) - len(expected))
    kept = {i: kept[i] for i in found}
    assert found == kept

    docs = stages["decontamination"](spark, docs, small)
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in " " + " ".join(words(t)) + " " for x in items)}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and docs.columns == columns

    from threadloom.llm import hilbert_pack

    assert stages["packing"](spark, docs, small).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(hilbert_pack.pack_along_curve(docs).collect(), list(kept.items()), exact)


def test_stages_take_awkward_rows(spark, small):
    for docs in (cases.docs(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, small)
            assert name == "packing" or docs.columns == columns
            docs.collect()


def test_base_counts():
    assert fertility.base_counts("a b c\n\na b c\n \n#x a b c") == (10, 11, 1, 1, 9)
    assert fertility.base_counts("") == (0, 0, 0, 0, 0)
    assert fertility.base_counts("é\x1cé\x0bb\x85 c")[:2] == (3, 6)
