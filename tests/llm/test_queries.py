"""The registered queries: names, contracts' columns, SQL twins."""

import pytest

from threadloom.llm import queries

from ..compare import rows_of, twin_rows

FOLDER = "/root/testdata/sf0.01"
COLUMNS = {
    1: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    3: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    5: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    6: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    7: ["doc_id", "fingerprint", "component_id"],
    8: ["page_id", "host", "path", "rule", "verdict"],
    9: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    11: ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    12: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    13: ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_queries_with_the_contracts_columns(spark, small):
    found = {int(name.split("_")[0][2:]): q for name, q in queries.queries().items()}
    assert sorted(found) == list(range(1, 14))
    for n, columns in COLUMNS.items():
        assert set(columns) <= set(found[n](spark, small).columns), n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    found = queries.queries()[name](spark, FOLDER)
    columns, expected = twin_rows(queries.oracle_sql()[name], FOLDER)
    assert sorted(found.columns) == columns
    assert rows_of(found.columns, found.collect()) == expected
