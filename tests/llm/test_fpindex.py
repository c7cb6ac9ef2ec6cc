import random

from morphlake.llm import fpindex
from tests.llm.fixtures import DOCS, awkward, clashing, empty, prose, rows


def brute(texts: dict[int, str], least: int) -> dict[int, set[int]]:
    """Word positions of each document that lie in a window of ``least`` words seen before (in id order)."""
    seen: set[tuple] = set()
    out: dict[int, set[int]] = {}
    for d in sorted(texts):
        w = (texts[d] or "").split()
        windows = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        out[d] = {j for i, x in enumerate(windows) if x in seen for j in range(i, i + least)}
        seen |= set(windows)
    return {d: x for d, x in out.items() if x}


def covered(spans, texts) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for r in spans:
        a, b = texts[r.doc_id][r.begin : r.end], texts[r.source_id][r.source_begin : r.source_end]
        assert a.split() == b.split() and len(a.split()) == r.n_words
        first = len(texts[r.doc_id][: r.begin].split())
        out.setdefault(r.doc_id, set()).update(range(first, first + r.n_words))
    return out


def test_covers_what_brute_force_covers(spark):
    p, q = prose(1, 70), prose(2, 55)
    texts = dict(enumerate([f"{prose(3, 20)} {p} {prose(4, 20)}", f"{q} {prose(5, 30)}", f"é {p}\n\n{q}", prose(6, 100), f"{p} {prose(7, 9)} {q}", p[: len(p) // 2], f"{prose(8, 12)} {p}"]))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    for batches in (1, 4, 7):
        assert covered(fpindex.repeated_spans(docs, batches=batches).collect(), texts) == brute(texts, fpindex.MIN_WORDS)


def test_the_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got, want = covered(fpindex.repeated_spans(docs).collect(), texts), brute(texts, fpindex.MIN_WORDS)
    assert set(got) >= set(want)
    for d, x in want.items():
        # within a document, a repeat of itself may be reported from the middle of a periodic passage on
        assert len(got[d] & x) >= 0.9 * len(x), d


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "h", "pos", "self", "old")
    assert {(r.doc_id, r.source_id, r.n_words) for r in fpindex.repeated_spans(docs).collect()} == {(6, 1, 80)}


def test_empty_table(spark):
    assert fpindex.repeated_spans(empty(spark)).count() == 0


def test_compaction_keeps_every_hash(spark):
    docs = spark.createDataFrame(rows(*[prose(i, 80) for i in range(30)]), DOCS).select("doc_id", "text")
    runs = fpindex.Runs(spark, 2, fan=2)
    for i in range(5):
        fpindex.ingest(runs, docs.filter(f"doc_id % 5 = {i}"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    n = sum(runs.table(r).count() for r in runs.history())
    again = fpindex.ingest(runs, docs.selectExpr("doc_id + 100 AS doc_id", "text"))
    assert again.count() == n
    runs.forget()


def test_first_occurrence_in_other_surroundings(spark):
    """Half windows whose first occurrence is in a short excerpt or in a copy edited nearby."""
    p = prose(40, 60)
    texts = [f"{' '.join(p.split()[:45])} {prose(41, 60)}", f"{prose(42, 30)} {p} {prose(43, 30)}", f"{prose(44, 10)} {p} {prose(45, 10)}"]
    base = prose(46, 400).split()
    for copy in range(8):
        r = random.Random(copy)
        texts.append(" ".join(f"edit{copy}x{i}" if r.random() < 1 / 30 else x for i, x in enumerate(base)))
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    for batches in (1, 3, 7):
        assert covered(fpindex.repeated_spans(docs, batches=batches).collect(), texts) == brute(texts, fpindex.MIN_WORDS)


def test_a_second_session_goes_on(spark, tmp_path):
    """The index of one load is opened by name in the next; what a load that broke off has left isn't seen."""
    p, q = prose(50, 80), prose(51, 70)
    texts = dict(enumerate([f"{p} {prose(52, 30)}", f"{prose(53, 40)} {q}", " ".join(p.split()[:45]) + " x", f"{prose(54, 9)} {p}", f"{q} {prose(55, 9)} {p}", prose(56, 90), f"{prose(57, 20)} {' '.join(p.split()[20:])}"]))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    want = brute(texts, fpindex.MIN_WORDS)
    index = f"file://{tmp_path}/index"
    first = fpindex.repeated_spans(docs.filter("doc_id < 3"), batches=2, index=index).collect()
    broken = fpindex.Runs.open(spark, index, 4)
    fpindex.ingest(broken, docs.filter("doc_id >= 3"))  # never saved
    broken.forget()
    later = spark.newSession()
    new, old = (later.createDataFrame(docs.filter(c).collect(), DOCS) for c in ("doc_id >= 3", "doc_id < 3"))
    second = fpindex.repeated_spans(new, batches=2, index=index, history=old).collect()
    assert covered([*first, *second], texts) == want and {r.doc_id for r in second} == {3, 4, 6}


def test_periodic_hot_and_text_ids(spark):
    """One text of one line over and over, a passage that a third of all documents share, ids that are text."""
    p = prose(60, 55)
    texts = dict(enumerate(["a b c " * 60] + [f"{prose(100 + i, 20)} {p if i % 3 == 0 else prose(300 + i, 55)} {prose(200 + i, 10)}" for i in range(60)] + ["x " + "a b c " * 40]))
    docs = spark.createDataFrame([(str(i), t) for i, t in texts.items()] + [("none", p)], "doc_id string, text string")
    got, want = covered(fpindex.repeated_spans(docs).collect(), texts), brute(texts, fpindex.MIN_WORDS)
    # the periodic document repeats itself, too, from where its own source ends on
    assert {d: x for d, x in got.items() if d} == want and len(got[0]) >= 90
