import numpy as np
import pyarrow as pa
import pytest

from provenant.llm import lm, queries
from tests.llm.helpers import awkward, words


@pytest.fixture(scope="module")
def tree():
    counts = np.sort(np.random.default_rng(4).poisson(2.0, lm.TOKENS) + (10**6 / (1 + np.arange(lm.TOKENS)) ** 1.2).astype(np.int64))[::-1]
    return lm.Tree.of(counts)


def test_paths_of_the_tree(tree):
    nodes, right, first, lengths = tree.decisions(np.arange(lm.TOKENS))
    assert (nodes[first + lengths - 1] == lm.TOKENS - 2).all()  # all paths end in the root
    assert abs(np.sum(0.5 ** lengths.astype(np.float64)) - 1) < 1e-9
    paths = {tuple(zip(nodes[a : a + n].tolist(), right[a : a + n].tolist(), strict=True)) for a, n in zip(first.tolist(), lengths.tolist(), strict=True)}
    assert len(paths) == lm.TOKENS
    assert lengths[0] <= lengths[-1]


def test_a_huffman_tree_by_hand():
    tree = lm.Tree.of(np.array([8, 3, 2, 1]))
    assert tree.lengths.tolist() == [1, 2, 3, 3]


def test_probabilities_of_all_tokens_sum_to_one(tree):
    network = lm.WindowNetwork.start(tree, seed=3)
    network.out += np.random.default_rng(5).normal(0, 0.5, network.out.shape).astype(np.float32)
    context = np.tile(np.array([[1, 2, 3, lm.PAD]]), (lm.TOKENS, 1))
    p = np.exp(network.log_probability(tree, context, np.arange(lm.TOKENS)).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-3


def test_a_fresh_network_gives_the_shares_of_the_counts():
    counts = np.sort(np.random.default_rng(6).integers(1, 10**5, lm.TOKENS))[::-1]
    tree = lm.Tree.of(counts)
    got = lm.WindowNetwork.start(tree).log_probability(tree, np.zeros((50, 4), np.int64), np.arange(50))
    assert np.allclose(got, np.log((counts[:50] + 0.5) / (counts + 0.5).sum()), atol=1e-3)


def test_learning_lowers_the_loss(tree):
    rng = np.random.default_rng(0)
    network = lm.WindowNetwork.start(tree)
    context = rng.integers(0, 50, (4000, 2 * lm.REACH))
    target = (context[:, 1] + context[:, 2]) % 7
    state = network.squares()
    before = network.log_probability(tree, context, target).mean()
    for _ in range(60):
        network.learn(tree, context, target, state)
    assert network.log_probability(tree, context, target).mean() > before + 0.5


def test_gradient_equals_finite_differences(tree):
    rng = np.random.default_rng(1)
    network = lm.WindowNetwork.start(tree)
    network.out += rng.normal(0, 0.5, network.out.shape).astype(np.float32)
    context, target = rng.integers(0, lm.TOKENS, (5, 2 * lm.REACH)), rng.integers(0, 200, 5)
    state = [np.zeros(w.shape, dtype=np.float32) for w in network.weights()]
    lm.WindowNetwork.from_flat(network.flat()).learn(tree, context, target, state)
    node = int(tree.decisions(target[:1])[0][0])
    for weight, where in ((0, (0, int(context[0, 0]), 3)), (1, (2,)), (2, (node, 5)), (3, (node,))):
        losses = []
        for sign in (1, -1):
            moved = lm.WindowNetwork.from_flat(network.flat())
            moved.weights()[weight][where] += sign * 1e-2
            losses.append(-moved.log_probability(tree, context, target).mean())
        assert abs(abs((losses[0] - losses[1]) / 2e-2) - np.sqrt(state[weight][where])) < 1e-3


def test_a_step_is_that_of_every_decision_alone(tree, monkeypatch):
    rng = np.random.default_rng(8)
    start = lm.WindowNetwork.start(tree)
    start.out += rng.normal(0, 0.5, start.out.shape).astype(np.float32)
    context, target = rng.integers(0, 300, (64, 2 * lm.REACH)), rng.integers(0, 4000, 64)
    nodes, right, first, lengths = tree.decisions(target)
    each = start.hidden(start.places(context)).astype(np.float64)
    grown = [np.zeros(w.shape) for w in start.weights()]
    for i, (a, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
        inner = np.zeros(lm.HIDDEN)
        for node, turn in zip(nodes[a : a + n].tolist(), right[a : a + n].tolist(), strict=True):
            wrong = (1 / (1 + np.exp(-(each[i] @ start.out[node] + start.out_bias[node]))) - turn) / len(target)
            inner += wrong * start.out[node]
            grown[2][node] += wrong * each[i]
            grown[3][node] += wrong
        inner *= 1 - each[i] ** 2
        grown[1] += inner
        for k in range(2 * lm.REACH):
            grown[0][k, context[i, k]] += inner
    assert lm.Tree.of(np.array([8, 3, 2, 1])).head.below.tolist() == [0, 0, 0, 0]  # a small tree is all head
    for head in (1, 64):
        monkeypatch.setattr(lm, "HEAD", head)
        again = lm.Tree(tree.nodes, tree.right, tree.starts, tree.lengths, tree.sides)
        moved, state = lm.WindowNetwork.from_flat(start.flat()), start.squares()
        moved.learn(again, context, target, state)
        for now, before, g in zip(moved.weights(), start.weights(), grown, strict=True):
            assert np.allclose(now, before - g / (np.sqrt(1e-4 + g * g) + 1e-6), atol=2e-4)


def test_batches_that_are_planned_at_once_hold_all_decisions_and_sums(tree):
    rng = np.random.default_rng(9)
    n, count = 64, 5
    target = (rng.pareto(0.6, n * count) * 3).astype(np.int64) % lm.TOKENS
    context = (rng.pareto(0.8, (n * count, 2 * lm.REACH)) * 2).astype(np.int64) % lm.TOKENS
    context[: 2 * n, 0] = lm.PAD  # runs longer than short
    planned = list(lm.plan(tree, context, target, n))
    assert len(planned) == count
    for b, batch in enumerate(planned):
        own = slice(b * n, (b + 1) * n)
        nodes, right, _, lengths = tree.decisions(target[own])
        assert sorted(zip(batch.nodes.tolist(), batch.turns.tolist(), strict=True)) == sorted(zip(nodes.tolist(), (2 * right - 1).tolist(), strict=True))
        values = rng.normal(0, 1, (n + len(batch.owner), lm.HIDDEN)).astype(np.float32)
        got, want = np.zeros((len(batch.used), lm.HIDDEN), np.float32), np.zeros((2 * (lm.PLACES + lm.TOKENS), lm.HIDDEN))
        batch.sums(values, got)
        for line in batch.places:
            np.add.at(want, line, values[:n])
        np.add.at(want, batch.node_rows, values[n:])
        many = len(batch.first)
        assert len(set(batch.used.tolist())) == len(batch.used) and np.allclose(got[:many], want[batch.used[:many]], atol=1e-4)
        assert abs(want).sum() == pytest.approx(abs(want[batch.used[:many]]).sum())  # no row is left out
        assert sorted(batch.places.T.tolist()) == sorted((2 * lm.WindowNetwork.places(context[own])).T.tolist())


def test_steps_planned_at_once_are_those_planned_one_by_one(tree):
    rng = np.random.default_rng(10)
    start = lm.WindowNetwork.start(tree)
    context, target = rng.integers(0, 300, (96, 2 * lm.REACH)), rng.integers(0, 4000, 96)
    one, state, many = lm.WindowNetwork.from_flat(start.flat()), start.squares(), lm.Learner.of(start, start.squares())
    for at in range(0, 96, 32):
        one.learn(tree, context[at : at + 32], target[at : at + 32], state)
    for batch in lm.plan(tree, context, target, 32):
        many.step(batch)
    assert np.allclose(one.flat(), many.network().flat(), atol=1e-5)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(state, many.squares(), strict=True))


@pytest.mark.parametrize("busy", [1, 40, 10**6])
def test_nodes_worked_out_for_all_positions_at_once_give_the_sums_of_their_decisions(tree, monkeypatch, busy):
    rng = np.random.default_rng(11)
    network = lm.WindowNetwork.start(tree)
    network.out += rng.normal(0, 1, network.out.shape).astype(np.float32)
    context, target = rng.integers(0, lm.TOKENS, (500, 2 * lm.REACH)), (rng.pareto(0.5, 500) * 3).astype(np.int64) % lm.TOKENS
    network.out_bias[tree.decisions(target[:1])[0]] *= 5000  # a product beyond all numbers for some
    nodes, right, first, lengths = tree.decisions(target)
    h = np.tanh(network.embed.reshape(-1, lm.HIDDEN)[network.places(context)].astype(np.float64).sum(axis=0) + network.bias)
    z = (np.repeat(h, lengths, axis=0) * network.out[nodes]).sum(axis=1) + network.out_bias[nodes]
    want = -np.add.reduceat(np.logaddexp(z * (1 - 2 * right), 0), first)
    assert want.min() < -710
    monkeypatch.setattr(lm, "BUSY", busy)
    monkeypatch.setattr(lm, "PIECE", 70)
    assert np.allclose(network.log_probability(tree, context, target), want, rtol=1e-4, atol=1e-3)


def test_pieces_hold_every_text_once():
    offsets = np.array([0, 0, 3, 3, 20, 21, 22, 22])
    pieces = list(lm._pieces(offsets, 4))
    assert [a for a, _ in pieces] == [0] + [b for _, b in pieces[:-1]] and pieces[-1][1] == 7
    assert all(b > a and (offsets[b] - offsets[a] <= 4 or b == a + 1) for a, b in pieces)


def test_tokens_are_found_where_the_low_bits_clash():
    low = np.array([5, 5 + lm.LOOKUP, 5 - lm.LOOKUP, 9, 5 + 2 * lm.LOOKUP, 10], dtype=np.int64)
    vocabulary = lm.Vocabulary.of(low[:4], np.array([40, 30, 20, 10]), np.zeros(lm.ENDINGS, np.int64))
    assert len(vocabulary.slots[1]) == 2
    tokens, known = vocabulary.tokens(low)
    assert known.tolist() == [True] * 4 + [False] * 2 and tokens[:4].tolist() == [0, 1, 2, 3]


def test_windows_see_both_sides_of_the_own_text_only():
    got = lm.windows(np.arange(6), np.array([0, 4, 4, 6]), np.array([0, 1, 3, 4]))
    p = lm.PAD
    assert got.tolist() == [[p, p, 1, 2], [p, 0, 2, 3], [1, 2, p, p], [p, p, 5, p]]


def test_every_position_is_masked_once_wherever_the_batch_is_cut():
    numbers, offsets = lm.word_numbers(pa.array(["one two three four five six", "", "one two three"]))
    rounds = [lm.masked(numbers, offsets, t, 3).tolist() for t in range(3)]
    assert sorted(sum(rounds, [])) == list(range(9))
    second = [lm.masked(numbers[6:], offsets[2:] - offsets[2], t, 3).tolist() for t in range(3)]
    assert [[i - 6 for i in r if i >= 6] for r in rounds] == second
    assert sum(len(lm.masked(numbers, offsets, t, 3, 0.5)) for t in range(3)) < 9


def test_vocabulary_and_its_rule_for_other_words():
    numbers = lm.word_numbers(pa.array(["alpha beta gamma delta"]))[0]
    endings = np.zeros(lm.ENDINGS, dtype=np.int64)
    np.add.at(endings, lm.endings_of(numbers[2:]), [5, 7])
    vocabulary = lm.Vocabulary.of(numbers[:2], np.array([100, 50]), endings)
    tokens, known = vocabulary.tokens(numbers)
    assert known.tolist() == [True, True, False, False]
    assert tokens[:2].tolist() == [0, 1] and vocabulary.counts[tokens[:2]].tolist() == [100, 50]
    assert vocabulary.counts[tokens[3]] in (7, 12)
    assert (np.diff(vocabulary.counts) <= 0).all()


def test_scores_equal_a_word_by_word_sum(tree):
    network = lm.WindowNetwork.start(tree, seed=3)
    texts = ["one two three", "", "four four"]
    numbers, offsets = lm.word_numbers(pa.array(texts))
    endings = np.zeros(lm.ENDINGS, dtype=np.int64)
    rare = np.unique(numbers[1:])
    np.add.at(endings, lm.endings_of(rare), [3] * len(rare))
    vocabulary = lm.Vocabulary.of(numbers[:1], np.array([9]), endings)
    sums, others, at = lm.LanguageScorer(vocabulary, tree, network).score(numbers, offsets, block=2)
    packed = [others[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    scored = pa.table({"doc_id": [1, 2, 3], "n_words": np.diff(offsets), "of_tokens": sums, "rare": pa.array(packed, pa.binary())})
    got = lm.with_totals(scored, pa.table({"word": rare, "total": np.full(len(rare), 3)}))["log_prob"].to_numpy()
    want = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        total = 0.0
        own, known = vocabulary.tokens(numbers[a:b])
        for i, c in enumerate(own.tolist()):
            context = [own[i + s] if 0 <= i + s < len(own) else lm.PAD for s in (-2, -1, 1, 2)]
            total += float(network.log_probability(tree, np.array([context]), np.array([c]))[0])
            total += 0 if known[i] else float(np.log(3 / vocabulary.counts[c]))
        want.append(total)
    assert np.allclose(got, want, atol=1e-4)


def test_trained_network_beats_unigrams_and_order_matters(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, folder).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    texts = [words(r["text"]) for r in rows]
    assert all(got[r["doc_id"]]["n_words"] == len(t) for r, t in zip(rows, texts, strict=True))
    counts = {}
    for t in texts:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    base = sum(c * np.log(c / n) for c in counts.values()) / n  # the best that any model without context can give
    mine = sum(r["log_prob"] for r in got.values()) / n
    assert mine > base
    more = lm.score_documents(docs, learned_share=1.0).agg({"log_prob": "sum"}).first()[0] / n
    assert more > base + 0.1 and more > mine
    rng = np.random.default_rng(0)
    mixed = [(r["doc_id"], " ".join(rng.permutation(t))) for r, t in zip(rows, texts, strict=True) if len(t) > 50][:50]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in mixed], "doc_id long, text string"))
    again = {r["doc_id"]: r["mean_log_prob"] for r in lm.score_documents(both).collect()}
    assert sum(again[i] > again[10**6 + i] for i, _ in mixed) >= 0.8 * len(mixed)


def test_awkward_rows(spark):
    got = lm.score_documents(awkward(spark)).collect()
    assert len(got) == 11
    for r in got:
        assert (r["n_words"] == 0) == (r["mean_log_prob"] is None)
        assert r["log_prob"] == 0 if r["n_words"] == 0 else r["log_prob"] < 0
    assert sorted(r["n_words"] for r in got if r["doc_id"] == 1) == [9, 9]
    assert lm.score_documents(awkward(spark).limit(0)).count() == 0


def test_words_beyond_the_vocabulary_keep_their_own_counts(spark):
    many = " ".join(f"w{i} w{i} w{i}" for i in range(lm.TOKENS))
    df = spark.createDataFrame([(0, many), (1, "lemon"), (2, "lemon"), (3, "wagon")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["log_prob"] for r in lm.score_documents(df).collect()}
    assert got[1] == got[2] and abs((got[1] - got[3]) - np.log(2)) < 1e-4


def test_totals_are_of_the_whole_corpus_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 16)
    df = spark.createDataFrame([(i, f"same word{i % 7} {'same ' * (i % 3)}") for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string").repartition(3)
    counted = lm.block_words(lm.tokenised(df, "doc_id", "text")).cache()
    want = {}
    for r in df.collect():
        for w in words(r["text"]):
            want[w] = want.get(w, 0) + 1
    number = {int(lm.word_numbers(pa.array([w]))[0][0]): n for w, n in want.items()}
    vocabulary = lm.vocabulary_of(counted)
    assert {int(w): int(vocabulary.counts[t]) for w, t in zip(vocabulary.words, vocabulary.word_tokens, strict=True)} == number
    nothing = lm.Vocabulary.of(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(lm.ENDINGS, np.int64))
    totals = lm.rare_totals(counted, nothing).collect()
    assert {r["word"] for r in totals} == set(number)
    assert all(r["total"] == number[r["word"]] for r in totals)


def test_copies_are_averaged_in_a_tree(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words {i % 5} here and there {i % 3}") for i in range(80)], "doc_id long, text string").repartition(9)
    want = {r["doc_id"]: r["log_prob"] for r in lm.score_documents(df, rounds=1).collect()}
    monkeypatch.setattr(lm, "MERGE_COPIES", 2)
    monkeypatch.setattr(lm, "MERGE_WEIGHTS", 50_000)
    got = {r["doc_id"]: r["log_prob"] for r in lm.score_documents(df, rounds=1).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_the_query_learns_every_position(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "train", lambda tokens, vocabulary, tree, network, rounds, learned_share: seen.append((rounds, learned_share)) or network)
    lm.score_documents(spark.createDataFrame([(0, "a b c")], "doc_id long, text string")).count()
    [(rounds, share)] = seen
    numbers, offsets = lm.word_numbers(pa.array([" ".join(f"w{i % 90}" for i in range(1000)), "one"]))
    parts = [lm.masked(numbers, offsets, turn, rounds, share) for turn in range(rounds)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(numbers)))
