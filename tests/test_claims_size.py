"""Claims cost a text once."""

from __future__ import annotations

import time

from threadloom.operators import projection


def test_claims_cost_a_text_once(spark):
    texts = spark.createDataFrame(
        [(1, "not a foe"), (2, "no\na foe"), (3, f"no {'x' * 45} foe no foefoe"), (4, f"no {'x' * 44} foe"), (5, "foe no"), (6, "none"), (7, None), (8, "foe é no foe\nfoe friend no friend")],
        "doc_id long, text string",
    )
    found = {r.doc_id: (r.stated, r.negated) for r in projection.claims(texts, "doc_id", "foe|friend", r"\bno\b").collect()}
    assert found == {1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (0, 1), 5: (1, 0), 8: (3, 2)}
    plain = spark.createDataFrame([(9, "word " * 2_000_000), (10, "foe " * 300_000)], "doc_id long, text string")
    begin = time.perf_counter()
    assert [tuple(r) for r in projection.claims(plain, "doc_id", "foe|friend|rival|enemy", "no").collect()] == [(10, 300_000, 0)]
    assert time.perf_counter() - begin < 6
