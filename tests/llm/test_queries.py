"""The registered queries over a small table: columns, rows, and the SQL form where there is one."""

import duckdb
import pytest

from loomtrace.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op5": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op6": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7": {"doc_id", "fingerprint", "component_id"},
    "op8": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op12": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13": {"doc_id", "n_features", "weight", "score", "rank"},
}


def test_queries_cover_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        if name == "op11_filter_audit":  # rows of parts, see below
            continue
        out = query(spark, SF)
        assert COLUMNS.get(name.split("_")[0], set()) <= set(out.columns), name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(set(ids)) == n and (name.startswith("op5") or len(ids) == n), name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con, more = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{more}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, more)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)
