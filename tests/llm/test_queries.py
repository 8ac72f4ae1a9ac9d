"""Every opN_ query on the smallest tables: names and types of its contract, and its SQL where it has one."""

import os

import pytest

registry = pytest.importorskip("tessera.llm.registry")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")

#: Columns that the contracts ask for; more may follow.
CONTRACTS = {
    "op1": "doc_id bigint",
    "op2": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3": "query_id bigint, rank int, vec_id bigint, score double",
    "op4": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5": "doc_id bigint",
    "op6": "page_id bigint, url string, text string, n_chars bigint",
    "op7": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8": "doc_id bigint, fingerprint string, component_id bigint",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_one_query_for_each_operator():
    assert sorted(name.split("_")[0] for name in registry.queries()) == sorted(CONTRACTS)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    kinds = dict(found.dtypes)
    for field in CONTRACTS[name.split("_")[0]].split(", "):
        column, kind = field.split(" ")
        assert kinds.get(column) == kind
    rows = found.collect()
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(found.columns)
        assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in rows) == sorted(repr(tuple(map(plain, r))) for r in result.fetchall())
