from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from morphlake.llm import pieces, quality
from morphlake.llm.common import table
from tests.llm.fixtures import awkward, clashing, empty, prose
from tests.llm.test_minhash import brute
from tests.llm.test_secrets import FOUND


def passed_by_sql(path: str) -> set[int]:
    """Ids that the current policy keeps, by the ledger in SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.LEDGER_SQL}) WHERE keep_{quality.CURRENT}").fetchall()}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage is held against SQL, all pairs, planted secrets, counts and the encoder's own library."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    # secrets in places that are known, in documents that pass the rules before
    host = docs.filter("length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(len(FOUND)).collect()
    planted = {r.doc_id: (kind, secret) for r, (kind, secret) in zip(host, FOUND.items())}
    with_secrets = spark.createDataFrame([(i, " " + s) for i, (_, s) in planted.items()], "p_id long, secret string")
    docs = docs.join(F.broadcast(with_secrets), F.col("doc_id") == F.col("p_id"), "left").withColumn("text", F.concat("text", F.coalesce("secret", F.lit("")))).select(*columns)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    texts = {r.doc_id: r for r in docs.collect()}
    kept = passed_by_sql(f"{tmp_path}/documents/*.parquet")
    gone = brute({i: texts[i].text for i in kept})
    run = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, run = {r.doc_id: r for r in run.collect()}, stage(spark, run, sf_dir)
        assert run.columns == columns, name
        now = {r.doc_id: r for r in run.collect()}
        assert set(now) <= set(before)
        if name == "quality rules":
            assert set(now) == kept and all(now[i] == texts[i] for i in now)
        if name == "MinHash near-dedup":
            lost = kept - set(now)
            assert lost <= set(gone) and len(lost) >= 0.95 * len(gone)
        if name == "secret scans":
            assert set(now) == set(before)
            seen = set(planted) & set(now)
            assert len(seen) >= len(planted) - 2
            for i in seen:
                kind, secret = planted[i]
                value = secret.split(" ")[-1] if kind in ("hex_secret", "base64_secret") else secret
                assert f"[SECRET:{kind}]" in now[i].text and value not in now[i].text and now[i].n_chars == len(now[i].text)
            assert all(now[i].text == texts[i].text for i in now if "[SECRET:" not in now[i].text)
        if name.startswith("mixing"):
            assert now == before  # all are drawn; what the stage does is their order
            left = now
    assert Counter(r.source for r in left.values()) == Counter(r.source for i, r in texts.items() if i in left)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    end = corpus_pipeline.STAGES[4][1](spark, run, sf_dir).collect()
    assert {r.doc_id for r in end} == set(left)
    for r in end:
        assert r.ids == sp.encode(r.text) and r.exact and r.text == left[r.doc_id].text


def test_run_writes_and_rereads_the_stages(spark, sf_dir):
    end = corpus_pipeline.run(spark, sf_dir)
    assert end.columns == [*table(spark, sf_dir, "documents").columns, "ids", "n_ids", "exact"]
    assert end.filter("NOT exact OR n_ids <> size(ids)").count() == 0 and end.count() > 100


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    """What each stage leaves of nulls, empty and very long texts, repeated rows and repeated ids."""
    docs = awkward(spark)
    every = {"1", "2", "3", "4", "5", "6", "7", "None"}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        got = docs.collect()
        assert {str(r.doc_id) for r in got} == (every - {"6"} if i else every) and len(got) == (7 if i else 10), name
    assert all(r.exact for r in got) and [(r.ids, r.n_ids) for r in got if r.doc_id == 2] == [(None, None)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table_and_clashing_columns(spark, sf_dir, stage):
    assert stage[1](spark, empty(spark), sf_dir).count() == 0
    names = ["k", "size", "keys", "shard", "place", "kind", "__clean", "__t", "label", "node", "c0", "rank"]
    data = spark.createDataFrame([(i, prose(i, 120), "en", "web", None) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage[1](spark, clashing(data, *names), sf_dir)
    assert [c for c in got.columns if c not in ("ids", "n_ids", "exact")] == [*data.columns, *names]
    rows = got.collect()
    assert len(rows) == 6 and all(r[n] == "x" for r in rows for n in names)


def test_mixing_changes_what_is_encoded(spark, sf_dir):
    """Sources of 64 and 4 documents: the small one gets its weight by repetition, and the last stage encodes it so."""
    rows = [(i, prose(i, 30), "en", "web" if i < 64 else "books", 0) for i in range(68)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.source_mixing(spark, docs, sf_dir)
    encoded = corpus_pipeline.sentencepiece_encoding(spark, mixed, sf_dir).collect()
    times = Counter(r.doc_id for r in encoded)
    assert Counter(r.source for r in encoded) == {"web": 64, "books": 9}  # 64 * (4 / 64) ** 0.7 = 9.19
    assert all(times[i] == 1 for i in range(64)) and sorted(times[i] for i in range(64, 68)) == [2, 2, 2, 3]
