"""Document scoring by masked pseudo-likelihood.

Every word is counted for itself over the whole corpus.  The most frequent
words are tokens of a bidirectional window network, written in numpy, that
predicts every token from the words on both sides.  Its softmax is hierarchical:
the tokens are the leaves of a Huffman tree of their counts, and a token's
probability is the product of the decisions on its path, so those of all tokens
add up to one and frequent tokens cost few decisions.

Out-of-vocabulary rule: any other word is the token of its ending (a hash of
the last two letters), times its share in that ending's words, by counts of
whole words.  These counts grow with the corpus; they come back to the words by
a join, a block of texts at a time, to which only those words go.  A document's
score is the sum over all its words of the log probability of the word given its
neighbours.

Counting, training and scoring all read every document.  Training is data
parallel: in every round each task updates its copy of the network, and the
copies are averaged, in a tree.  A position is masked in one round at most; how
many are is the parameter ``learned_share`` (1: every position is predicted in
training).  Scoring predicts every token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columnar import bounded_batches, hash_words, mix, offsets_of, slices, text_array, text_words
from .storage import durable

ENDINGS = 64
#: Leaves of the tree; all but ``ENDINGS`` are words.
TOKENS = 16_384
PAD = TOKENS
REACH = 2
HIDDEN = 16
ROUNDS = 2
#: Share of all positions that the network learns from: every one, once in all rounds.
LEARNED_SHARE = 1.0
BATCH = 512
#: Values of the low bits of a word's number, by which a token is looked up.
LOOKUP = 1 << 18
#: Nodes near the root whose decisions are worked out for all positions of a batch at once.
HEAD = 64
#: Gradients of a row up to which those of all rows of a batch are summed at once.
SHORT_RUN = 8
#: Batches that are planned at once.
PLANNED = 32
#: Words that are prepared or scored at once, how many of them pass a node that is worked out for itself, and rows of a piece of the rest.
SCORED, BUSY, PIECE = 1 << 16, 256, 1 << 12
#: Copies that are averaged in one task, and weights of a piece that is averaged for itself.
MERGE_COPIES, MERGE_WEIGHTS = 64, 1 << 16
#: Text of a block, whose words are joined to their totals at once.
BLOCK_BYTES = 16 << 20
#: Bits of a word's number that hold its hash; the ending stands above them.
HASH_BITS = 58


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts to numbers of whole words: the ending (a hash of the last two letters), then 58 bits of the word's hash."""
    words, codes, offsets = text_words(texts)
    last = [w[-2:] for w in words]
    each = list(set(last))
    number = dict(zip(each, (hash_words(each) % np.uint64(ENDINGS)).tolist(), strict=True))
    ending = np.fromiter(map(number.__getitem__, last), np.uint64, len(last))
    numbers = (ending << np.uint64(HASH_BITS)) | (mix(hash_words(words)) & np.uint64((1 << HASH_BITS) - 1))
    return numbers[codes].view(np.int64), offsets


def endings_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers.view(np.uint64) >> np.uint64(HASH_BITS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Tokens by rank: ``words`` (sorted numbers) and their tokens, the tokens of the endings, and how often each token occurs."""

    words: np.ndarray
    word_tokens: np.ndarray
    ending_tokens: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: np.ndarray, totals: np.ndarray, endings: np.ndarray) -> Vocabulary:
        """From the frequent words, their totals, and the totals of all other words by ending."""
        every = np.concatenate([endings, totals])
        rank = np.empty(len(every), dtype=np.int64)
        rank[np.argsort(-every, kind="stable")] = np.arange(len(every))
        counts = np.zeros(TOKENS, dtype=np.int64)
        counts[rank] = every
        order = np.argsort(words)
        return Vocabulary(words[order], rank[ENDINGS:][order], rank[:ENDINGS], counts)

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """A word for each value of the low bits of its number, and the words that found theirs taken; made where it is used first."""
        low = self.words & (LOOKUP - 1)
        table = np.zeros(LOOKUP, dtype=np.int32)
        table[low] = np.arange(len(self.words))
        return table, np.flatnonzero(table[low] != np.arange(len(self.words)))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token of every word, and whether it is that of the word itself."""
        out = self.ending_tokens.take(endings_of(numbers))
        if not len(self.words):
            return out, np.zeros(len(numbers), dtype=bool)
        table, others = self.slots
        at = table.take(numbers & (LOOKUP - 1))
        known = self.words.take(at) == numbers
        if len(others):
            rest = np.flatnonzero(~known)
            found = others.take(np.minimum(np.searchsorted(self.words[others], numbers.take(rest)), len(others) - 1))
            at[rest] = found
            known[rest] = self.words.take(found) == numbers.take(rest)
        return np.where(known, self.word_tokens.take(at), out), known


@dataclass
class Tree:
    """A Huffman tree: the decisions (node, 1: right) on the path to each token, one path after the other."""

    nodes: np.ndarray
    right: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    #: Counts of the tokens on the left and on the right of each node.
    sides: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        """The tree of tokens that are ranked by falling counts; unseen tokens weigh a half."""
        n = len(counts)
        weight = np.concatenate([counts + 0.5, np.full(n - 1, np.inf)])
        parent, right, sides = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.zeros((n - 1, 2))
        leaf, inner = n - 1, n  # the lightest leaf and the lightest inner node that have no parent
        for made in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if leaf >= 0 and (inner >= made or weight[leaf] <= weight[inner]):
                    pair.append(leaf)
                    leaf -= 1
                else:
                    pair.append(inner)
                    inner += 1
            parent[pair], right[pair[1]] = made, 1
            sides[made - n] = weight[pair]
            weight[made] = weight[pair].sum()
        paths, bits, at, turn = [], [], np.arange(n), np.arange(n)
        token = []
        while len(at):  # all tokens climb at once
            token.append(turn)
            paths.append(parent[at] - n)
            bits.append(right[at])
            at = parent[at]
            below = at < 2 * n - 2
            at, turn = at[below], turn[below]
        owner = np.concatenate(token)
        order = np.argsort(owner, kind="stable")
        lengths = np.bincount(owner, minlength=n)
        return Tree(np.concatenate(paths)[order].astype(np.uint16), np.concatenate(bits)[order].astype(np.float32), offsets_of(lengths)[:-1], lengths, sides)

    def decisions(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides of the paths of some tokens, where each path starts, and their lengths."""
        lengths = self.lengths[tokens]
        first = offsets_of(lengths)[:-1]
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts[tokens] - first, lengths)
        return self.nodes.take(at), self.right.take(at), first, lengths

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The place of each token among the leaves from left to right; where the leaves below each node begin, where its right side does, and where they end."""
        n = len(self.lengths)
        size = np.bincount(self.nodes, minlength=n - 1)
        left = size - np.bincount(self.nodes, self.right, n - 1).astype(np.int64)
        leaf = np.add.reduceat(left.take(self.nodes) * (self.right > 0), self.starts)
        begin = np.full(n - 1, n)
        np.minimum.at(begin, self.nodes, np.repeat(leaf, self.lengths))
        return leaf.astype(np.uint16), begin, begin + left, begin + size

    @cached_property
    def head(self) -> Head:
        """The nodes that most tokens pass; made where it is used first, so that it is not sent along."""
        return Head.of(self)


@dataclass
class Head:
    """The heaviest nodes of a tree, from one number on: nodes are made by rising weights, and so stand at the ends of all paths."""

    start: int
    #: The decisions of all paths in order: twice the node, and one more if the path turns right.
    decisions: np.ndarray
    #: How many decisions each token has before the head.
    below: np.ndarray

    @staticmethod
    def of(tree: Tree) -> Head:
        n = len(tree.lengths)
        start = max(0, n - 1 - HEAD)
        owner = np.repeat(np.arange(n), tree.lengths)
        return Head(start, 2 * tree.nodes + tree.right.astype(np.uint16), np.bincount(owner[tree.nodes < start], minlength=n))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on."""
    ends = offsets_of(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)


def _adagrad(weight: np.ndarray, gradient: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """A step scaled by the root of the summed squares; the gradient's array is used up."""
    root = gradient * gradient
    squares += root
    np.sqrt(squares, out=root)
    root += np.float32(1e-6)
    if rate != 1:
        gradient *= np.float32(rate)
    gradient /= root
    weight -= gradient


def _put(rows: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
    """Replace some rows of a table that lies in one piece, each as a single value."""
    kind = f"V{rows.itemsize * rows.shape[1]}"
    rows.view(kind).reshape(-1).put(at, new.view(kind).reshape(-1))


@dataclass
class WindowNetwork:
    """The decisions on the path to a position's token from its neighbours on both sides."""

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(2 * REACH, TOKENS + 1, HIDDEN), (HIDDEN,), (TOKENS - 1, HIDDEN), (TOKENS - 1,)]

    @staticmethod
    def start(tree: Tree, seed: int = 7) -> WindowNetwork:
        """Small random embeddings; the decisions begin with the shares of the counts."""
        embed = np.random.default_rng(seed).normal(0, 0.3, WindowNetwork.shapes()[0]).astype(np.float32)
        return WindowNetwork(embed, np.zeros(HIDDEN, np.float32), np.zeros((TOKENS - 1, HIDDEN), np.float32), np.log(tree.sides[:, 1] / tree.sides[:, 0]).astype(np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    @staticmethod
    def from_flat(values: np.ndarray) -> WindowNetwork:
        sizes = [int(np.prod(s)) for s in WindowNetwork.shapes()]
        parts = np.split(np.asarray(values, dtype=np.float32), np.cumsum(sizes)[:-1])
        return WindowNetwork(*(p.reshape(s).copy() for p, s in zip(parts, WindowNetwork.shapes(), strict=True)))

    def squares(self) -> list[np.ndarray]:
        """A fresh state of :meth:`learn`."""
        return [np.full(w.shape, 1e-4, dtype=np.float32) for w in self.weights()]

    @staticmethod
    def places(context: np.ndarray) -> np.ndarray:
        """The rows of all embeddings, laid end to end, that neighbours have: a line for each of their places."""
        return context.T + np.arange(2 * REACH)[:, None] * (TOKENS + 1)

    def hidden(self, places: np.ndarray) -> np.ndarray:
        return _hidden(self.embed.reshape(-1, HIDDEN).take(places, axis=0), self.bias)

    def log_probability(self, tree: Tree, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of the target tokens.

        The positions are put in the order of the leaves, so that those that pass a node
        stand in one piece: a node that many pass is worked out for all of them at once.
        """
        n = len(target)
        if not n:
            return np.zeros(0)
        leaf, begin, middle, end = tree.spans
        order = np.argsort(leaf.take(target), kind="stable")
        target = target.take(order)
        places, h = self.places(context.take(order, axis=0)), np.empty((n, HIDDEN), np.float32)
        for at in range(0, n, PIECE):
            h[at : at + PIECE] = self.hidden(places[:, at : at + PIECE])
        passed = offsets_of(np.bincount(leaf.take(target), minlength=len(leaf)))
        low, turn, high = passed.take(begin), passed.take(middle), passed.take(end)
        busy = high - low >= BUSY  # and so are all nodes above one
        product = np.ones(n)  # of the inverse probabilities of the decisions
        with np.errstate(over="ignore"):
            for node, a, b, c in zip(np.flatnonzero(busy).tolist(), low[busy].tolist(), turn[busy].tolist(), high[busy].tolist(), strict=True):
                z = h[a:c] @ self.out[node]
                z += self.out_bias[node]
                np.negative(z[b - a :], out=z[b - a :])
                np.exp(z, out=z)
                z += 1
                product[a:c] *= z
            quiet = np.add.reduceat(~busy[tree.nodes], tree.starts, dtype=np.int64)
            for at in range(0, n, PIECE):
                own = quiet.take(target[at : at + PIECE])
                has = np.flatnonzero(own)
                if not len(has):
                    continue
                paths, owner = _ranges(tree.starts.take(target[at : at + PIECE]), own), np.repeat(np.arange(at, at + len(own)), own)
                z = self._decisions(h, owner, tree.nodes.take(paths))
                z *= 1 - 2 * tree.right.take(paths)
                np.exp(z, out=z)
                z += 1
                product[at + has] *= np.multiply.reduceat(z, offsets_of(own).take(has), dtype=np.float64)
        out = np.empty(n)
        out[order] = -np.log(product)
        far = np.flatnonzero(~np.isfinite(product))  # a product too large for a number
        if len(far):
            nodes, right, first, lengths = tree.decisions(target.take(far))
            z = self._decisions(h, np.repeat(far, lengths), nodes)
            z *= 1 - 2 * right
            out[order.take(far)] = -np.add.reduceat(np.logaddexp(z, 0, dtype=np.float64), first)
        return out

    def _decisions(self, h: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The logits of some decisions, each with the hidden units of its position."""
        each = h.take(owner, axis=0)
        each *= self.out.take(nodes, axis=0)
        z = each @ np.ones(HIDDEN, np.float32)
        z += self.out_bias.take(nodes)
        return z

    def learn(self, tree: Tree, context: np.ndarray, target: np.ndarray, state: list[np.ndarray], rate: float = 1.0) -> None:
        """One step of a :class:`Learner`, from and back to this network and its state."""
        learner = Learner.of(self, state)
        for batch in plan(tree, context, target, len(target)):
            learner.step(batch, rate)
        for own, new in zip([*self.weights(), *state], [*learner.network().weights(), *learner.squares()], strict=True):
            own[...] = new


#: Rows of all embeddings, laid end to end.
PLACES = 2 * REACH * (TOKENS + 1)


@dataclass
class Learner:
    """A network that learns: the rows of the embeddings, then those of the decisions, each before its summed squares."""

    rows: np.ndarray
    #: Those of the hidden units, then those of the decisions, and their summed squares.
    biases: np.ndarray
    bias_squares: np.ndarray

    @staticmethod
    def of(network: WindowNetwork, state: list[np.ndarray]) -> Learner:
        rows = np.empty((PLACES + TOKENS - 1, 2, HIDDEN), np.float32)
        for side, (embed, _, out, _) in enumerate((network.weights(), state)):
            rows[:PLACES, side] = embed.reshape(-1, HIDDEN)
            rows[PLACES:, side] = out
        return Learner(rows.reshape(-1, HIDDEN), np.concatenate([network.bias, network.out_bias]), np.concatenate([state[1], state[3]]))

    def _tables(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.rows[side::2].copy()
        return own[:PLACES].reshape(WindowNetwork.shapes()[0]), own[PLACES:]

    def network(self) -> WindowNetwork:
        embed, out = self._tables(0)
        return WindowNetwork(embed, self.biases[:HIDDEN], out, self.biases[HIDDEN:])

    def squares(self) -> list[np.ndarray]:
        embed, out = self._tables(1)
        return [embed, self.bias_squares[:HIDDEN], out, self.bias_squares[HIDDEN:]]

    def step(self, batch: Batch, rate: float = 1.0) -> None:
        """One step of stochastic gradient descent with per-weight scaling (Adagrad); only rows in use are touched.

        The decisions of the head are worked out by products of whole matrices, those
        below it one by one.
        """
        n, m, many = batch.n, len(batch.owner), len(batch.first)
        weights = self.rows.take(batch.used, axis=0)
        top = weights[many:]
        h = _hidden(self.rows.take(batch.places, axis=0), self.biases[:HIDDEN])
        moves = np.empty((n + m, HIDDEN), np.float32)
        inner, spread = moves[:n], h.take(batch.owner, axis=0, out=moves[n:], mode="clip")
        each = self.rows.take(batch.node_rows, axis=0)
        wrong = np.empty(len(batch.nodes), np.float32)
        np.matmul(each * spread, np.ones(HIDDEN, np.float32), out=wrong[:m])
        (h @ top.T).take(batch.cells, out=wrong[m:], mode="clip")
        wrong += self.biases[HIDDEN:].take(batch.nodes)
        _wrong(wrong, batch.turns, n)
        table = np.zeros((n, len(top)), np.float32)
        table.put(batch.cells, wrong[m:])
        np.matmul(table, top, out=inner)
        gradient = np.empty_like(weights)
        np.matmul(table.T, h, out=gradient[many:])
        widened = np.repeat(wrong[:m], HIDDEN).reshape(m, HIDDEN)
        each *= widened
        spread *= widened
        at = 0
        for k in batch.levels:
            inner[:k] += each[at : at + k]
            at += k
        h *= h
        inner *= np.subtract(1, h, out=h)
        batch.sums(moves, gradient)
        sums = np.zeros_like(self.biases)
        ones = np.ones(n, np.float32)
        np.matmul(ones, inner, out=sums[:HIDDEN])
        np.matmul(ones, table, out=sums[-len(top) :])
        np.add.at(sums[HIDDEN:], batch.nodes[:m], wrong[:m])
        _adagrad(self.biases, sums, self.bias_squares, rate)
        squares = self.rows.take(batch.used + 1, axis=0)
        _adagrad(weights, gradient, squares, rate)
        _put(self.rows, batch.used, weights)
        _put(self.rows, batch.used + 1, squares)


@dataclass
class Batch:
    """What a step needs to know of its positions; nothing of it depends on the weights.

    The positions with the longest paths below the head come first and the decisions
    there stand level by level, so that those of a level meet the first positions in order.
    """

    n: int
    #: Decisions of each level below the head, their positions and rows.
    levels: list[int]
    owner: np.ndarray
    node_rows: np.ndarray
    #: All decisions, those of the head last, and the cells that these have in a table by position and node.
    nodes: np.ndarray
    turns: np.ndarray
    cells: np.ndarray
    #: The rows of the neighbours, a line for each of their places.
    places: np.ndarray
    #: The rows in use, each once, and then those of the head.
    used: np.ndarray
    #: Of each row in use but those of the head: its first gradient; of those in long runs, which come first: all of them and where each run begins; of the others: the second ones, the third ones, and so on.
    first: np.ndarray
    long_rows: np.ndarray
    long_starts: np.ndarray
    short_rows: np.ndarray
    short: list[int]

    def sums(self, values: np.ndarray, out: np.ndarray) -> None:
        """The gradients of each row in use but those of the head, summed up."""
        values.take(self.first, axis=0, out=out[: len(self.first)], mode="clip")
        long = len(self.long_starts)
        if long:
            pairs = values.take(self.long_rows, axis=0).view(np.complex64)  # two numbers are added at once
            out[:long] = np.add.reduceat(pairs, self.long_starts).view(np.float32)
        others, at = values.take(self.short_rows, axis=0), 0
        for k in self.short:
            out[long : long + k] += others[at : at + k]
            at += k


def _unpacked(decisions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some decisions, and -1 where they turn left, 1 where right."""
    turns = (decisions & 1).astype(np.float32)
    turns *= 2
    turns -= 1
    return (decisions >> 1).astype(np.int64), turns


def plan(tree: Tree, context: np.ndarray, target: np.ndarray, n: int) -> Iterator[Batch]:
    """Some positions in batches of ``n``, all of them planned at once."""
    head, count, places = tree.head, len(target) // n, 2 * REACH
    below = head.below.take(target)
    deep, which = int(below.max()) + 1, np.repeat(np.arange(count), n)
    turn = np.argsort((which * deep + (deep - 1 - below)).astype(np.uint16), kind="stable")
    below, target, context = below.take(turn), target.take(turn), context.T.take(turn, axis=1)
    starts, inside = tree.starts.take(target), tree.lengths.take(target) - below
    # decisions by batch, level and position
    held = np.bincount(which * deep + below, minlength=count * deep).reshape(count, deep)
    levels = held[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    lengths, of = levels.ravel(), offsets_of(levels.sum(axis=1))
    owner = _ranges(np.zeros(len(lengths), np.int64), lengths)
    position = owner + np.repeat(np.repeat(np.arange(count) * n, deep - 1), lengths)
    at = starts.take(position) + np.repeat(np.tile(np.arange(deep - 1), count), lengths)
    nodes, turns = _unpacked(head.decisions.take(at))
    top_of = offsets_of(inside)[::n]
    top_nodes, top_turns = _unpacked(head.decisions.take(_ranges(starts + below, inside)))
    cells = np.repeat(np.tile(np.arange(n) * (TOKENS - 1 - head.start) - head.start, count), inside) + top_nodes
    # rows in use by batch, those with most gradients first
    rows, node_rows = (context + np.arange(places)[:, None] * (TOKENS + 1)) * 2, (nodes + PLACES) * 2
    sorted_by = nodes.astype(np.uint16)
    order = np.argsort(context.astype(np.uint16).reshape(places, count, n), axis=2, kind="stable")
    ordered = rows.take(order + (np.arange(places)[:, None, None] * count + np.arange(count)[:, None]) * n)
    cuts = of + np.arange(count + 1) * (places * n)
    keys, needs = np.empty(cuts[-1], np.int64), np.empty(cuts[-1], np.int64)
    for b in range(count):
        own, middle = slice(of[b], of[b + 1]), cuts[b] + places * n
        node_order = np.argsort(sorted_by[own], kind="stable")
        keys[cuts[b] : middle], needs[cuts[b] : middle] = ordered[:, b].ravel(), order[:, b].ravel()
        keys[middle : cuts[b + 1]] = node_rows[own].take(node_order)
        needs[middle : cuts[b + 1]] = node_order + n
    new = np.empty(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[cuts[:-1]] = True
    first = np.flatnonzero(new)
    run = np.concatenate([first[1:], [len(keys)]]) - first
    used_of = np.searchsorted(first, cuts)
    kinds = SHORT_RUN + 1  # 0: longer than short
    kind = np.repeat(np.arange(count) * kinds, np.diff(used_of)) + np.maximum(kinds - run, 0)
    sizes = np.bincount(kind, minlength=count * kinds).reshape(count, kinds)
    fall = np.argsort(kind.astype(np.uint16), kind="stable")
    first, run = first.take(fall), run.take(fall)
    long = np.concatenate([np.arange(a, a + k) for a, k in zip(used_of[:-1], sizes[:, 0], strict=True)])
    long_run = run.take(long)
    long_rows, long_of, long_rows_of = needs.take(_ranges(first.take(long), long_run)), offsets_of(sizes[:, 0]), offsets_of(long_run)
    more = sizes[:, 1:].cumsum(axis=1)[:, -2::-1]  # short runs with a second gradient, a third one, ...
    short_of = offsets_of(more.ravel())
    at = _ranges(np.repeat(used_of[:-1] + sizes[:, 0], SHORT_RUN - 1), more.ravel())
    short_rows = needs.take(first.take(at) + np.repeat(np.tile(np.arange(1, SHORT_RUN), count), more.ravel()))
    used, first = keys.take(first), needs.take(first)
    tops = (np.arange(head.start, TOKENS - 1) + PLACES) * 2
    for b in range(count):
        own, above, mine = slice(of[b], of[b + 1]), slice(top_of[b], top_of[b + 1]), slice(used_of[b], used_of[b + 1])
        begins = long_rows_of[long_of[b] : long_of[b + 1] + 1]
        yield Batch(
            n,
            levels[b].tolist(),
            owner[own],
            node_rows[own],
            np.concatenate([nodes[own], top_nodes[above]]),
            np.concatenate([turns[own], top_turns[above]]),
            cells[above],
            rows[:, b * n : (b + 1) * n],
            np.concatenate([used[mine], tops]),
            first[mine],
            long_rows[begins[0] : begins[-1]],
            begins[:-1] - begins[0],
            short_rows[short_of[b * (SHORT_RUN - 1)] : short_of[(b + 1) * (SHORT_RUN - 1)]],
            more[b].tolist(),
        )


def _hidden(found: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The hidden units from the embeddings of the neighbours, a line for each of their places."""
    total = bias + found[0]
    for row in found[1:]:
        total += row
    total *= 2  # by the exponential, as it takes half the time of the tangent
    with np.errstate(over="ignore"):
        np.exp(total, out=total)
    total += 1
    np.divide(np.float32(-2), total, out=total)
    total += 1
    return total


def _wrong(z: np.ndarray, turns: np.ndarray, n: int) -> np.ndarray:
    """By how much the probabilities of turning right miss the decisions (-1: left, 1: right), as shares of a batch; in place."""
    np.multiply(z, turns, out=z)
    with np.errstate(over="ignore"):  # a share of 1
        np.exp(z, out=z)
    z += 1
    np.divide(np.float32(1 / n), z, out=z)
    z *= turns
    return np.negative(z, out=z)


def _padded(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with :data:`PAD` before, between and behind the texts, and where each of them stands then."""
    at = np.arange(len(tokens)) + np.repeat(REACH * np.arange(1, len(offsets)), np.diff(offsets))
    out = np.full(len(tokens) + REACH * len(offsets), PAD, dtype=np.int64)
    out.put(at, tokens)
    return out, at


def _around(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The neighbours of some places, a line for each place."""
    return np.stack([padded.take(at + shift) for shift in (*range(-REACH, 0), *range(1, REACH + 1))]).T


def windows(tokens: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Neighbours of the chosen positions; beyond a text's ends stands :data:`PAD`."""
    padded, at = _padded(tokens, offsets)
    return _around(padded, at.take(chosen))


def masked(numbers: np.ndarray, offsets: np.ndarray, turn: int, rounds: int, share: float = 1.0) -> np.ndarray:
    """The positions that a round predicts, by word and place in the text: a share of all over all rounds, each in one."""
    place = np.arange(len(numbers), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    draw = (mix(place * np.uint64(2654435761) + numbers.view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.flatnonzero((draw >= share * turn / rounds) & (draw < share * (turn + 1) / rounds))


def _pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many words, whose arrays stay in the caches."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def _decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat word numbers and offsets of a column of packed int64 arrays."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype=np.int64), offsets_of(np.array([len(c) // 8 for c in cells], dtype=np.int64))


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block, doc_id, tokens``: the packed word numbers of every text; a block is about ``BLOCK_BYTES`` of a task's texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, 1):
                texts = text_array(part.column(1))
                flat, offsets = word_numbers(texts)
                packed = pa.array([flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), part.column(0), packed], names=["block", "doc_id", "tokens"])
                held += pc.sum(pc.binary_length(texts)).as_py()
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0

    return rows.mapInArrow(run, f"block long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens binary")


def block_words(tokens: DataFrame) -> DataFrame:
    """``block, word, n``: how often each word stands in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []

        def counted() -> Iterator[pa.RecordBatch]:
            if waiting:
                words, n = np.unique(np.concatenate(waiting), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), at)), pa.array(words), pa.array(n)], names=["block", "word", "n"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for start, stop in zip(ends[:-1], ends[1:], strict=True):
                if start == stop:
                    continue
                if blocks[start] != at:
                    yield from counted()
                    at, waiting = blocks[start], []
                waiting.append(_decode(batch.column(1).slice(start, stop - start))[0])
        yield from counted()

    return tokens.select("block", "tokens").mapInArrow(run, "block long, word long, n long")


def vocabulary_of(counted: DataFrame) -> Vocabulary:
    """The most frequent words of the corpus, ties by number, and the totals of the other ones by ending."""
    totals = durable(counted.groupBy("word").agg(F.sum("n").alias("n")))
    by_size = totals.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("words")).collect()  # 64 rows at most
    least, held = 0, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        least, held = r["size"], held + r["words"]
        if held >= TOKENS - ENDINGS:
            break
    frequent = totals.filter(F.col("n") >= F.lit(2.0) ** least)  # the tokens, and what shares the size of the last one
    top = frequent.orderBy(F.desc("n"), "word").limit(TOKENS - ENDINGS).toArrow()
    words, n = (top[c].to_numpy().astype(np.int64) for c in ("word", "n"))
    endings = np.zeros(ENDINGS, dtype=np.int64)
    for r in counted.groupBy(F.shiftrightunsigned("word", HASH_BITS).alias("ending")).agg(F.sum("n").alias("n")).collect():  # ENDINGS rows
        endings[r["ending"]] = r["n"]
    np.subtract.at(endings, endings_of(words), n)
    return Vocabulary.of(words, n, endings)


def rare_totals(counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``block, word, total``: how often each word of a block that is no token occurs in the whole corpus."""
    spark = counted.sparkSession
    known = spark.createDataFrame(pa.table({"word": pa.array(vocabulary.words)})) if len(vocabulary.words) else spark.createDataFrame([], "word long")
    rare = counted.join(F.broadcast(known), "word", "left_anti")  # TOKENS rows at most
    return rare.select("block", "word", F.sum("n").over(Window.partitionBy("word")).alias("total"))


def _averaged(table: pa.Table) -> pa.Table:
    """One piece of weights of some copies, averaged by the positions they learned from."""
    learned = table["learned"].to_numpy().astype(np.float64)
    total = np.zeros(len(table["weights"][0].as_py()) // 4)
    for n, cell in zip(learned, table["weights"], strict=True):
        total += n * np.frombuffer(cell.as_py(), dtype=np.float32)
    mean = (total / learned.sum()).astype(np.float32).tobytes()
    return pa.table({"piece": table["piece"][:1], "slot": table["slot"][:1], "learned": pa.array([int(learned.sum())], pa.int64()), "weights": pa.array([mean], pa.binary())})


def train(tokens: DataFrame, vocabulary: Vocabulary, tree: Tree, network: WindowNetwork, rounds: int = ROUNDS, learned_share: float = LEARNED_SHARE, batch_size: int = BATCH) -> WindowNetwork:
    """Data-parallel rounds; the copies of all tasks are averaged by the positions they learned from, so many at a time."""
    shape = "piece int, slot long, learned long, weights binary"
    parts = (tokens.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    for turn in range(rounds):
        start = network.flat()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, turn: int = turn) -> Iterator[pa.RecordBatch]:
            network = WindowNetwork.from_flat(start)
            copy = Learner.of(network, network.squares())
            learned, waiting, many = 0, [], 0
            for batch in batches:
                numbers, offsets = _decode(batch.column(0))
                for a, b in _pieces(offsets, SCORED):
                    own, within = numbers[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    flat, chosen = vocabulary.tokens(own)[0], masked(own, within, turn, rounds, learned_share)
                    padded, places = _padded(flat, within)
                    for at in range(0, len(chosen), PLANNED * batch_size):
                        part = chosen[at : at + PLANNED * batch_size]
                        waiting.append((_around(padded, places.take(part)), flat.take(part)))
                        many += len(part)
                        if many < batch_size:
                            continue
                        context, target = (np.concatenate(x) for x in zip(*waiting, strict=True))
                        whole = many - many % batch_size
                        for planned in plan(tree, context[:whole], target[:whole], batch_size):
                            copy.step(planned)
                        learned += whole
                        waiting, many = [(context[whole:], target[whole:])], many - whole
            if many:
                context, target = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for planned in plan(tree, context, target, many):
                    copy.step(planned)
                learned += many
            if learned:
                slot, flat = TaskContext.get().partitionId(), copy.network().flat()
                for piece, at in enumerate(range(0, len(flat), MERGE_WEIGHTS)):
                    cell = flat[at : at + MERGE_WEIGHTS].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([slot], pa.int64()), pa.array([learned], pa.int64()), pa.array([cell], pa.binary())], names=["piece", "slot", "learned", "weights"])

        copies, left = tokens.select("tokens").mapInArrow(run, shape), parts
        while True:
            copies = copies.withColumn("slot", F.expr(f"slot div {MERGE_COPIES}")).groupBy("piece", "slot").applyInArrow(_averaged, shape)
            left = -(-left // MERGE_COPIES)
            if left <= 1:
                break
        merged = copies.collect()  # one copy of the network
        if not merged:
            break
        network = WindowNetwork.from_flat(np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(merged, key=lambda r: r["piece"])]))
    return network


@dataclass
class LanguageScorer:
    vocabulary: Vocabulary
    tree: Tree
    network: WindowNetwork

    def score(self, numbers: np.ndarray, offsets: np.ndarray, block: int = SCORED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log probability of the tokens of each text given their neighbours, and the words that are no tokens with their offsets.

        The share of such a word among those of its ending is still to be added.
        """
        tokens, known = self.vocabulary.tokens(numbers)
        each = np.empty(len(tokens))
        padded, places = _padded(tokens, offsets)
        for at in range(0, len(tokens), block):
            each[at : at + block] = self.network.log_probability(self.tree, _around(padded, places[at : at + block]), tokens[at : at + block])
        each[~known] -= np.log(self.vocabulary.counts[tokens[~known]])
        running, others = np.concatenate([[0.0], np.cumsum(each)]), offsets_of(~known)
        return running[offsets[1:]] - running[offsets[:-1]], numbers[~known], others[offsets]


def with_totals(scored: pa.Table, totals: pa.Table) -> pa.Table:
    """The scores of a block's texts with the corpus totals of their words that are no tokens."""
    numbers, offsets = _decode(scored["rare"])
    order = totals.sort_by("word")
    each = np.log(order["total"].to_numpy())[np.searchsorted(order["word"].to_numpy(), numbers)] if len(numbers) else np.zeros(0)
    running = np.concatenate([[0.0], np.cumsum(each)])
    lengths = scored["n_words"].to_numpy()
    total = scored["of_tokens"].to_numpy() + running[offsets[1:]] - running[offsets[:-1]]
    mean = pa.array(total / np.maximum(lengths, 1), mask=lengths == 0)
    return pa.table([scored["doc_id"], pa.array(lengths), pa.array(total), mean], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, learned_share: float = LEARNED_SHARE) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every row, by a network trained on the table itself.

    A text without words (also null or empty) has no words, a sum of 0 and a null
    mean.  Texts of any length are read whole.  Repeated rows score alike and count
    as often as they stand; words with equal counts are ranked by their hash; null
    ids stay null; other columns are ignored, whatever their names; an empty table
    gives no rows.  The masks depend on the texts alone; the averages, as in any
    data-parallel training, on how the rows are dealt to tasks.
    """
    bounded_batches(docs.sparkSession)
    tokens = durable(tokenised(docs, id_col, text_col))
    counted = durable(block_words(tokens))
    vocabulary = vocabulary_of(counted)
    tree = Tree.of(vocabulary.counts)
    scorer = LanguageScorer(vocabulary, tree, train(tokens, vocabulary, tree, WindowNetwork.start(tree), rounds, learned_share))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, offsets = _decode(batch.column(2))
            sums, rare, at = scorer.score(numbers, offsets)
            packed = pa.array([rare[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(sums), packed], names=["block", "doc_id", "n_words", "of_tokens", "rare"])

    scored = tokens.mapInArrow(run, f"block long, doc_id {kind}, n_words long, of_tokens double, rare binary")
    pairs = scored.groupBy("block").cogroup(rare_totals(counted, vocabulary).groupBy("block"))
    return pairs.applyInArrow(with_totals, f"doc_id {kind}, n_words long, log_prob double, mean_log_prob double")
