import shutil

from morphlake.llm import common, quality
from tests.llm.fixtures import awkward, clashing, empty, prose, rows, DOCS


def test_bits_and_policies(spark):
    good = prose(1, 60)
    docs = spark.createDataFrame(rows(good, "# " * 60, "WORD " * 60, "same\n" * 60, "lorem ipsum " + good, "", None), DOCS)
    led = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert led[0].fail_bits == 0 and led[0].keep_v1
    bits = quality.BIT
    assert led[1].fail_bits & bits["symbol_ratio"] and led[2].fail_bits & bits["shouting"] and led[3].fail_bits & bits["repeated_lines"]
    assert led[4].fail_bits & bits["filler"] and not led[4].keep_v2
    assert led[5].fail_bits == led[6].fail_bits == bits["no_words"] | bits["few_words"]


def test_apply_policy_agrees_with_the_ledger(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.apply_policy(docs).collect()}
    assert kept == {r.doc_id for r in quality.ledger(docs).filter(f"keep_{quality.CURRENT}").collect()}


def test_labelled_good_documents_stay(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    led = quality.ledger(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.quality, r.keep_v2): r["count"] for r in led.groupBy("quality", "keep_v2").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "n_words", "w", "fail_bits", "__t")
    led = quality.ledger(docs)
    assert led.count() == docs.count()
    kept = quality.apply_policy(docs)
    assert {x for r in kept.collect() for x in r[-4:]} == {"x"}
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert sorted(str(r.doc_id) for r in kept.filter("n_chars > 400").collect()).count("1") == 2


def test_empty_table(spark):
    assert quality.ledger(empty(spark)).count() == 0
    assert quality.ablations(quality.ledger(empty(spark))).filter("n_fail <> 0 OR n_kept <> 0").count() == 0


def test_policies_and_ablations_read_the_stored_ledger(spark, sf_dir, tmp_path):
    """Once the query has measured the texts, they may go: verdicts, another policy and ablations come from the bits."""
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, ablated = (sorted(map(str, df.collect())) for df in (quality.ledger(docs), quality.ablations(quality.ledger(docs))))
    led = quality.op7_quality_rules(spark, str(tmp_path))
    assert led.inputFiles() and all(common.shared_root(spark).removeprefix("file://") in f for f in led.inputFiles())
    (tmp_path / "documents.parquet").unlink()
    assert sorted(map(str, led.collect())) == want and sorted(map(str, quality.ablations(led).collect())) == ablated
    other = {"few": quality.BIT["few_words"]}
    short = {r.doc_id for r in quality.judged(led, other).filter("NOT keep_few").collect()}
    assert short == {r.doc_id for r in docs.collect() if len(r.text.split()) < 20}
