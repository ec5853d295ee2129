"""The registered queries: SQL parity at sf0.001, contract columns, and the pipeline against its operators."""

import math

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.cases import no_docs, odd_docs, odd_rows
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as components
from turnforge.llm import rule_ensemble, secrets
from turnforge.llm.common import read
from turnforge.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_html_text": "page_id url text n_chars",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_near_duplicates": "doc_id n_shingles component_id kept",
    "op6_warc_index": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_quality_classifier": "doc_id held_out score predicted",
    "op10_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_phrases": "lang rank phrase a l r n score",
    "op12_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_one_query_for_each_operator():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(SQL[key])
    columns = [c[0] for c in cur.description]
    got = QUERIES[key](spark, SF_SMALL)
    assert set(got.columns) == set(columns) == set(COLUMNS[key].split())
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("key", sorted(set(COLUMNS) - set(SQL)))
def test_query_has_the_contract_columns_and_all_rows(spark, key):
    got = QUERIES[key](spark, SF_SMALL)
    assert set(COLUMNS[key].split()) <= set(got.columns)
    table, name = ("pages", "page_id") if key == "op3_html_text" else ("documents", "doc_id")
    rows = got.collect()
    assert {r[name] for r in rows} == {r[0] for r in read(spark, SF_SMALL, table).select(name).collect()}
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's rows on what its predecessor kept."""
    docs = read(spark, SF_SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dup", "decontaminate", "secrets", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    tables = {}
    now = docs
    for n in names:
        now = stage[n](spark, now, SF_SMALL)
        tables[n] = now = spark.createDataFrame(now.collect(), now.schema)
        assert n == "pack" or now.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in rule_ensemble.scored(docs, read(spark, SF_SMALL, "labels")).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {d for d in rows if scores[d]}
    assert {r.doc_id for r in tables["quality"].collect()} == kept
    label = components([(d, rows[d].text) for d in kept], 5, 80)
    kept = {d for d in kept if label[d][1] == d}
    assert {r.doc_id for r in tables["near_dup"].collect()} == kept
    items = [tuple(r) for r in read(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()]
    kept -= {r[0] for r in contaminated([(d, rows[d].text) for d in kept], items) if r[2]}
    assert {r.doc_id for r in tables["decontaminate"].collect()} == kept
    for r in tables["secrets"].collect():
        assert not [s for s in secrets.scan(r.text) if s[0] != "guess"] and r.n_chars == len(r.text)
        assert secrets.scan(rows[r.doc_id].text) or r.text == rows[r.doc_id].text
    assert {r.doc_id for r in tables["pack"].collect()} == kept


def test_stages_take_odd_and_empty_tables(spark):
    for table in (odd_docs(spark), no_docs(spark)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF_SMALL)
        assert now.count() >= (1 if table.count() else 0)
    assert len(odd_rows()) > 20
