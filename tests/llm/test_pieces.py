import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from morphlake.llm import pieces
from tests.llm.fixtures import awkward, clashing, empty

SP = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve café ß", "日本語 text", "a\nb\n\n c", "tabs\tand  runs    of spaces", "emoji 🎉🎉", "x" * 500, "▁ mark", "don't--stop...", "1234567890", " leading"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    ids = pieces.model().encode(text)
    assert ids == SP.encode(text)
    if "▁" not in text:
        assert pieces.model().decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeghilnorstuw  \n.,éßAZ09日▁"), max_size=60))
def test_random_texts(text):
    assert pieces.model().encode(text) == SP.encode(text)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pieces.encode(docs)
    for r in got.collect():
        assert r.ids == SP.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.exact
    assert {r.doc_id: r.text for r in pieces.decode(got).collect()} == texts


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "ids", "exact", "__text")
    got = pieces.encode(docs).collect()
    assert len(got) == docs.count() and all(r.exact for r in got)
    assert [(r.ids, r.n_ids) for r in got if r.doc_id in (2, 3)] == [(None, None), ([], 0)]
    wide = pieces.with_pieces(docs.drop("__text"))
    assert wide.columns == [c for c in docs.columns if c not in ("ids", "exact", "__text")] + ["ids", "n_ids", "exact"]
    assert wide.count() == docs.count()
    assert pieces.encode(empty(spark)).count() == 0 and pieces.with_pieces(empty(spark)).count() == 0
