import random

from morphlake.llm import licenses
from tests.llm.fixtures import DOCS, awkward, clashing, empty, prose, rows


def least_errors(notice: str, text: str) -> int:
    """Smallest edit distance of the notice to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def damaged(s: str, k: int, r: random.Random) -> str:
    out = list(s)
    for _ in range(k):
        i = r.randrange(len(out))
        o = r.randrange(3)
        if o == 0:
            out[i] = r.choice("xyz")
        elif o == 1:
            out.insert(i, r.choice("xyz"))
        else:
            del out[i]
    return "".join(out)


def test_matches_brute_force():
    r = random.Random(3)
    search = licenses.Search()
    for n in range(120):
        name, notice, limit = r.choice(search.notices)
        text = f"{prose(n, 6)} {damaged(notice, r.randint(0, limit + 3), r)} {prose(n + 500, 6)}"
        found = search.find(text)
        low = licenses.fold(text)
        best = {k: least_errors(x, low) for k, (_, x, _) in enumerate(search.notices)}
        possible = [k for k, e in best.items() if e <= search.notices[k][2]]
        assert bool(found) == bool(possible)
        if found:
            assert min(e for *_, e, _ in found) == min(best[k] for k in possible)
        for licence, a, b, e, matched in found:
            assert text[a:b] == matched
            assert e == min(least_errors(x, low[a:b]) for nm, x, _ in search.notices if nm == licence)


def test_spans_and_nearest_notice():
    find = licenses.Search().find
    assert find("Licensed under CC BY-NC 4.0.")[0][:4] == ("CC-BY-NC-4.0", 0, 28, 0)
    assert find("é RELEASED under the MIT Licence.")[0][:4] == ("MIT", 2, 33, 1)
    assert find("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0"
    assert find("a licensed driver was released under the bridge") == []
    assert find(None) == find("") == []


def test_scan_finds_what_the_text_holds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    exact = [(n, licenses.fold(x)) for n, xs in licenses.NOTICES.items() for x in xs]
    want = {(r.doc_id, n) for r in docs.collect() for n, x in exact if x in licenses.fold(r.text or "")}
    assert want and want <= got


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "license", "begin", "errors")
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty(spark)).count() == 0
    end = spark.createDataFrame(rows(prose(1, 100_000) + " Released under the MIT License."), DOCS)
    assert [r.license for r in licenses.scan(end).collect()] == ["MIT"]
