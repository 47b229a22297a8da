"""Every registered query of this subpackage, as the driver runs it, against its SQL form or a plain count."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests_common import TABLES, canonical

COLUMNS = {
    "op1_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op5_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op6_top_products": ["query_id", "rank", "vec_id", "score"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted", "threshold", "toxic"],
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*COLUMNS, "url_rules"])
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
        if name not in ("op6_top_products", "op7_packing"):
            kind = {"op2": "pages", "op5": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
            assert len(rows) == duck.execute(f"select count(*) from {kind}").fetchone()[0]
    if sql := entry.oracle_sql().get(name):
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(r.fetchall(), columns)


def test_all_eleven_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())
