"""The registered queries over their whole tables, against brute force or SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from cardloom.llm import mixing
from tests.llm import test_classlm, test_decontaminate, test_pii, test_prefixtrie, test_quality, test_sharding
from tests.llm import test_simhash, test_substrings

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def rows_of(table, columns="doc_id, text"):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet'").fetchall()


def found(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and len(corpus_pipeline.STAGES) == 5


def test_op1(spark):
    rows = {r.doc_id: r for r in found(spark, "op1_skip_chain_pii")}
    for doc, text in rows_of("documents"):
        base = test_pii.brute(text)
        assert [rows[doc][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[1] == i for s in base) for i in range(4)]


def test_op2(spark):
    got = {r.doc_id: r for r in found(spark, "op2_class_ngrams")}
    assert all(got[d].held_out == test_classlm.held(d) for d, _ in rows_of("documents"))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op3(spark):
    rows = rows_of("documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found(spark, "op3_golay_simhash")}
    prints = {d: test_simhash.brute_fingerprint(t) for d, t in rows}
    find, least = test_simhash.brute_groups(set(prints.values())), test_simhash.least_ids(rows)
    assert got == {d: (f"{p:016x}", least[find(p)]) for d, p in prints.items()}


def test_op4(spark):
    wanted = test_substrings.expected(rows_of("documents"))
    assert {tuple(r) for r in found(spark, "op4_suffix_levels")} == {(d, *v) for (d, _), v in wanted.items()}


def test_op6(spark):
    wanted = sorted((d, *test_quality.expected(t)) for d, t in rows_of("documents"))
    assert sorted(tuple(r)[:7] for r in found(spark, "op6_repetition_quality")) == wanted


def test_op9(spark):
    texts = dict(rows_of("documents"))
    got = found(spark, "op9_chained_passages")
    met = {r.doc_id for r in got}
    for r in got:
        assert min(len(texts[d].split()) for d in (r.doc_id, r.other_id)) >= 40 and r.other_id <= r.doc_id
    first = {}
    for doc, text in sorted(texts.items()):
        if len(text.split()) > 60 and first.setdefault(text, doc) != doc:
            assert doc in met


def test_op10(spark):
    wanted = test_decontaminate.expected(rows_of("documents"), rows_of("benchmark", "item_id, text"))
    assert sorted(map(str, map(tuple, found(spark, "op10_winnowing")))) == wanted


def test_op11(spark):
    got = sorted(str(tuple(r)) for r in found(spark, "op11_z_fast_trie"))
    assert got == test_prefixtrie.brute(rows_of("conversations", "conv_id, turn, role, text"))


def test_op12(spark):
    got = {r.doc_id: r for r in found(spark, "op12_cross_parsing")}
    right = [got[d].lang_pred == lang for d, lang in rows_of("documents", "doc_id, lang") if got[d].held_out]
    assert len(got) == len(rows_of("documents")) and sum(right) / len(right) > 0.95


@pytest.mark.parametrize("name", ["op5_golden_mix", "op7_url_vocabulary", "op13_chunk_divergence"])
def test_sql(spark, name):
    oracle = duckdb.connect()
    for table in ("documents", "pages"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    table = QUERIES[name](spark, FOLDER)
    wanted = oracle.execute(f"SELECT {', '.join(table.columns)} FROM ({entry_points.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, table.collect()))) == sorted(map(str, wanted))


def test_op8(spark):
    assert len(found(spark, "op8_bounded_ring")) == len(rows_of("documents"))
    test_sharding.check(spark, rows_of("documents"))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    rows = rows_of("documents", "doc_id, text, source")
    kept = []
    for doc, text, source in rows:
        from cardloom.llm import quality

        if quality.measure(text.encode(), quality.RepetitionLimits()).kept:
            assert not test_quality.expected(text)[-1]
            kept.append((doc, text, source))
    pairs = [(d, t) for d, t, _ in kept]
    first = set(test_simhash.least_ids(pairs).values())
    kept = [row for row in kept if row[0] in first]
    bad = {eval(x)[0] for x in test_decontaminate.expected([(d, t) for d, t, _ in kept], rows_of("benchmark", "item_id, text")) if x.endswith("True)")}
    kept = [row for row in kept if row[0] not in bad]
    oracle = duckdb.connect()
    oracle.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    oracle.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    mixed = [(d, n) for d, size, _, _, taken in oracle.execute(mixing.MIX_SQL).fetchall() for n in [int(taken / size + 0.5)]]
    wanted = sorted(d for d, n in mixed for _ in range(n))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == wanted and len(wanted) > 50
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.simpleString() == docs.schema.simpleString()
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0
