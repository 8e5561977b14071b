import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import decontamination as dc
from provenant.llm import queries
from provenant.llm.columnar import hash_words, words_of
from tests.llm.helpers import awkward, words

VOCABULARY = [f"w{i}" for i in range(40)] + ["the", "of"] * 5


def scores(index, terms):
    out = {}
    for t in terms:
        for item, value in zip(index.lists[t][0], index.lists[t][1], strict=True):
            out[item] = out.get(item, 0.0) + value
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.05, 0.95))
def test_search_finds_all_items_above_the_threshold(seed, threshold):
    rng = random.Random(seed)
    index = dc.BlockMaxIndex([(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(3, 25)))) for i in range(60)])
    passage = index.term_numbers(hash_words(rng.choices(VOCABULARY, k=30)))
    terms = sorted({int(t) for t in passage if t < len(index.terms)})
    want = {i: s for i, s in scores(index, terms).items() if s >= threshold}
    got = dict(index.search(terms, threshold))
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bounds_never_miss_a_passage():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=15))) for i in range(30)]
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(0, 200))) + " " + items[i % 30][1] for i in range(40)]
    index = dc.BlockMaxIndex(items)
    passages = dc.Passages(pa.array(texts), index.longest)
    cells, terms = passages.terms(index)
    some = {int(cells[a]) for a in dc.possible(index, cells, terms, 0.6, pairs_at_once=50)}
    for cell in sorted(set(cells.tolist())):
        own = terms[cells == cell].tolist()
        if max(scores(index, own).values(), default=0) >= 0.6:
            assert cell in some


def test_question_and_answer():
    assert dc.split_item("What is it? It is a fox.") == (["what", "is", "it"], ["it", "is", "a", "fox"])
    assert dc.split_item("only one") == (["only", "one"], [])
    assert dc.split_item("") == ([], [])


def test_words_match_the_pattern():
    for text in ("Don't STOP: now_1 – é;ß", "a,b c.d", "", "%%% x"):
        assert words_of(text) == words(text)


def test_query_against_brute_force(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, sf_dir).filter("leaked").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    five = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    held = {i["item_id"]: five(words(i["text"])) for i in items}
    want = {(d["doc_id"], i) for d in docs for i, s in held.items() if s and len(s & five(words(d["text"]))) >= 0.8 * len(s)}
    assert got == want


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over"), (1, "quick brown fox jumps over"), (2, ""), (3, None), (None, "word word"), (4, "dog")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in dc.find_leaks(awkward(spark), bench).filter("leaked").collect()]
    assert got.count((1, 1)) == 4 and (2, 1) in got and (2, 4) in got and (5, None) in got
    kept = dc.drop_leaking(awkward(spark), bench)
    assert kept.columns == awkward(spark).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0), (True, 0)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.find_leaks(awkward(spark).limit(0), bench).count() == 0
    assert dc.find_leaks(awkward(spark), bench.limit(0)).count() == 0
    assert dc.drop_leaking(awkward(spark), bench.limit(0)).count() == 11


def test_many_indexes(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_ITEMS", 2)
    monkeypatch.setattr(dc, "PASS_BYTES", 40)
    bench = spark.createDataFrame([(i, f"item number {i} says alpha beta gamma{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before that item number {i} says alpha beta gamma{i} after it") for i in range(9)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).filter("leaked").collect()) == [(i, i) for i in range(9)]


def test_scores_do_not_depend_on_the_cut(spark, monkeypatch):
    rng = random.Random(5)
    bench = spark.createDataFrame([(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(6, 40)))) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 300)))) for i in range(25)], "doc_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"]): (round(r["score"], 9), r["first_word"], r["leaked"]) for r in dc.find_leaks(docs, bench).collect()}

    want = found()
    assert len(want) > 20
    for items in (2, 10_000):
        monkeypatch.setattr(dc, "INDEX_ITEMS", items)
        assert found() == want
    monkeypatch.setattr(dc, "PASS_BYTES", 500)
    assert found() == want


def test_a_long_item_leaves_the_passages_of_the_others(spark):
    rng = random.Random(6)
    short = [(i, " ".join(rng.choices(VOCABULARY, k=20))) for i in range(10)]
    long = (99, " ".join(f"z{rng.randint(0, 9999)}" for _ in range(20_000)))
    indexes = list(dc.item_indexes(spark.createDataFrame([*short, long], "item_id long, text string"), "item_id", "text"))[0]
    assert sorted(i.longest for i in indexes) == [64, 65_536]
    docs = spark.createDataFrame([(1, f"before {short[3][1]} after"), (2, f"zz {long[1]} zz"), (3, " ".join(long[1].split()[:9000]))], "doc_id long, text string")
    leaks = dc.find_leaks(docs, spark.createDataFrame([*short, long], "item_id long, text string")).filter("leaked").collect()
    assert {(r["doc_id"], r["item_id"]) for r in leaks} == {(1, 3), (2, 99)}
