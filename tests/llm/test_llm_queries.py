"""The registered queries: columns, types, rows, and the SQL twins."""

import pytest

from compare import compare
from siltstone.llm import queries
from siltstone.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMAS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_sharding": "doc_id bigint, slot int, shard string",
    "op5_pii_pseudonyms": "doc_id bigint, text string, n_values int, kinds string",
    "op6_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint, near_sha256 string",
    "op9_line_dedup": "doc_id bigint, text string, n_removed int",
    "op12_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,label:int>>",
    "op13_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op10_license_scan": "doc_id bigint, licenses string, n_paragraphs int, n_predicted int, n_confirmed int",
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_query(spark, name):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    out = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{a} {b}" for a, b in out.dtypes) == SCHEMAS[name]
    key = out.columns[0]
    table = {"vec_id": "embeddings", "page_id": "pages", "doc_id": "documents"}[key]
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in read(spark, SF, table).select(key).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) == ""
