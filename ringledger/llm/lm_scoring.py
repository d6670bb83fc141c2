"""Language-model scores of documents: a small causal self-attention model over subword ids, trained in numpy.

Words (A-Z lower-cased, split at white space) are cut into subword ids by a public vocabulary. A document is its words'
ids and an end id. Windows of ``WINDOW`` positions overlap by ``OVERLAP``; each token is scored once, in the window
that gives it the longer context, by masked attention over a batch of windows. The model gives the probability of the next id's
class (each of the commonest ids is a class of its own, the others share classes with ids of like contexts), times the id's share of its class in all
training text, so the probabilities of all ids add up to one.

What comes from the corpus: counts of all words, of all subword ids and of ids beside each other, and the attention weights, all over every
training document. The documents' ids are written once; each id is predicted once in ``ROUNDS`` rounds, in which the tasks learn from equal weights
and the mean of theirs goes on. Tasks grow in number with the corpus, weights do not. Scale: word counts are summed by hash before and after one
shuffle. The commonest words (at most ``COMMON_WORDS``) are broadcast; what a document has of all other words is joined to their
counts by hash, so neither the driver nor any task holds the vocabulary, and no join key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import common

WINDOW, OVERLAP = 16, 4
WIDTH, HIDDEN, CLASSES = 16, 16, 192
#: Commonest ids whose places beside an id describe its context.
CONTEXTS = 128
#: Rounds of the training pass, and windows of all rounds that a task is dealt: what a task returns a round is small beside its ids.
ROUNDS, TASK_WINDOWS = 4, 400_000
#: Windows that are shuffled at a time in a task, and embedding rows of a slice of weights.
SHUFFLED, SLICE = 16_384, 4096
COMMON_WORDS = 300_000
BATCH_WINDOWS = 256
#: Rows of class logits that are worked on at a time, so that they stay in the cache of a core.
CACHED = 512
BLOCK_ROWS = 100
#: Words are cut here first, so that a very long one costs no more a byte than others.
PIECES = r" ?\p{L}{1,32}| ?\p{N}{1,8}| ?[^\s\p{L}\p{N}]{1,16}|\s+"


class Places(dict):
    """A number for each word, in the order of first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Subwords:
    """Ids of words by a public vocabulary of ranks; remembers words until ``full``."""

    def __init__(self, tokenizer_path: str, limit: int = 1_000_000) -> None:
        import base64

        import tiktoken

        with open(tokenizer_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tool = tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size, self.limit = self.end + 1, limit
        self.clear()

    def clear(self) -> None:
        self.known = Places()
        self.hash = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros((1 << 16) + 1, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)

    @property
    def full(self) -> bool:
        return len(self.known) > self.limit

    def _learn(self, words: list[bytes]) -> None:
        import xxhash

        encoded = [self.tool.encode_ordinary(" " + w.decode()) for w in words]
        end = len(self.known)
        first = end - len(words)
        if end > len(self.hash):
            self.hash, self.start = np.resize(self.hash, 2 * end), np.resize(self.start, 2 * end + 1)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        at = self.start[first]
        self.start[first + 1 : end + 1] = at + np.cumsum(sizes)
        to = self.start[end]
        if to > len(self.flat):
            self.flat = np.resize(self.flat, 2 * to)
        self.flat[at:to] = np.fromiter((i for ids in encoded for i in ids), np.int32, int(to - at))
        self.hash[first:end] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def places(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """The words' places in the memory, for each document."""
        known = self.known
        found = [np.fromiter(map(known.__getitem__, d), np.int64, len(d)) for d in docs]
        if known.new:
            self._learn(known.new)
            known.new = []
        return found

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The subword ids of the words, with the end id behind them."""
        first, size = self.start[places], self.start[places + 1] - self.start[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(first - (ends - size), size)
        return np.append(self.flat[at], np.int32(self.end))


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - top), its sums of rows and ``top``: 0, or the rows' largest where exp(z) would be too large or too small."""
    ones, top = np.ones(z.shape[1], np.float32), np.float32(0)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ ones
    if not (np.isfinite(total) & (total > 1e-30)).all():
        top = z.max(-1)
        e = np.exp(z - top[:, None])
        total = e @ ones
    return e, total, top


@dataclass
class Attention:
    """One head with a residual, a hidden layer with a residual, and class logits; ``group`` is each id's class and ``share`` its log10 share of it."""

    p: dict[str, np.ndarray]
    group: np.ndarray
    share: np.ndarray
    row: np.ndarray

    def tables(self) -> None:
        """Projections of every id and position, so that scoring only looks them up."""
        p = self.p
        ask = np.concatenate([p["Q"] * np.float32(WIDTH**-0.5), np.eye(WIDTH, dtype=np.float32)], axis=1)
        offer = np.concatenate([p["K"], p["V"] @ p["O"]], axis=1)
        self._t = [((p["E"] @ x).astype(np.float32), (p["P"] @ x).astype(np.float32)) for x in (ask, offer)]

    def class_log_probs(self, inputs: np.ndarray, wanted: np.ndarray, from_: int = 0) -> np.ndarray:
        """Natural log probability of the ``wanted`` class after each position from ``from_`` on; inputs are rows of the embedding table."""
        p, n = self.p, inputs.shape[1]
        (ask, ask_at), (offer, offer_at) = self._t
        qe = ask[inputs[:, from_:]] + ask_at[from_:n]
        kv = offer[inputs] + offer_at[:n]
        a = qe[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
        np.exp(np.clip(a, -60, 60, out=a), out=a)  # exp() must neither overflow nor vanish
        a *= np.tri(n, dtype=np.float32)[from_:]
        a /= (a.reshape(-1, n) @ np.ones(n, np.float32)).reshape(*a.shape[:2], 1)
        h = (qe[..., WIDTH:] + a @ kv[..., WIDTH:]).reshape(-1, WIDTH)
        hidden = h @ p["A"]
        hidden += p["a"]
        np.maximum(hidden, 0, out=hidden)
        h += hidden @ p["B"]
        h, wanted_, out = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1), wanted.reshape(-1), np.empty(len(h), np.float32)
        both = np.concatenate([p["U"], p["u"][None]])
        for at in range(0, len(h), CACHED):
            z = h[at : at + CACHED] @ both
            _, total, top = exponentials(z)
            out[at : at + CACHED] = z[np.arange(len(z)), wanted_[at : at + CACHED]] - top - np.log(total)
        return out.reshape(wanted.shape)

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each of the sequences that lie one behind the other in ``ids``; none is empty. Every id is scored once."""
        if not len(sizes):
            return np.zeros(0)
        first = np.cumsum(sizes) - sizes
        rows = np.concatenate([[0], self.row[ids[:-1]]])
        rows[first] = 0  # the beginning
        groups = self.group[ids]
        total = np.add.reduceat(self.share[ids].astype(np.float64), first)
        step = WINDOW - OVERLAP
        more = np.maximum(0, -(-(sizes - WINDOW) // step))
        owner = np.repeat(np.arange(len(sizes)), more)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        for own, start, from_ in ((np.arange(len(sizes)), first, 0), (owner, first[owner] + number * step, OVERLAP)):
            end, got = (first + sizes)[own], np.zeros(len(own))
            for a in range(0, len(own), BATCH_WINDOWS):
                at = start[a : a + BATCH_WINDOWS, None] + np.arange(WINDOW)
                ok = at < end[a : a + BATCH_WINDOWS, None]
                at = np.minimum(at, len(ids) - 1)
                found = self.class_log_probs(rows[at], groups[at[:, from_:]], from_)
                got[a : a + BATCH_WINDOWS] = np.where(ok[:, from_:], found, 0).sum(1, dtype=np.float64)
            total += np.bincount(own, got, len(sizes)) / np.log(10)
        return total


def context_places(counts: np.ndarray) -> np.ndarray:
    """Place of each of the commonest ids among the contexts, -1 for the others."""
    place = np.full(len(counts), -1)
    contexts = np.lexsort((np.arange(len(counts)), -counts))[:CONTEXTS]
    place[contexts] = np.arange(len(contexts))
    return place


def neighbours(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, times) of the contexts beside each id; a cell is 2 CONTEXTS times the id, and the context's place behind it or CONTEXTS more before it."""
    ok = (left >= 0) & (right >= 0)
    left, right = left[ok].astype(np.int64), right[ok].astype(np.int64)
    cells = [a[place[b] >= 0] * 2 * CONTEXTS + place[b][place[b] >= 0] + shift for a, b, shift in ((left, right, 0), (right, left, CONTEXTS))]
    return np.unique(np.concatenate(cells), return_counts=True)


def classes_of(counts: np.ndarray, cells: np.ndarray, times: np.ndarray, classes: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class and log10 share of its class; counts are smoothed by one.

    A quarter of the classes are the commonest ids alone. The other ids are clustered (k-means over the square roots of the shares of
    their neighbours), so that ids of a class stand in like contexts. Ids without such a neighbour share the last class.
    """
    smooth = counts + 1.0
    order = np.lexsort((np.arange(len(counts)), -counts))
    alone = min(classes // 4, len(counts))
    group = np.full(len(counts), classes - 1, np.int64)
    group[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    line = np.full(len(counts), -1)  # rows of the ids that have a neighbour among the contexts
    beside = np.zeros(len(counts), bool)
    beside[cells // (2 * CONTEXTS)] = True
    rest = rest[beside[rest]]
    line[rest] = np.arange(len(rest))
    x = np.zeros((len(rest), 2 * CONTEXTS), np.float32)
    own = line[cells // (2 * CONTEXTS)]
    x[own[own >= 0], cells[own >= 0] % (2 * CONTEXTS)] = times[own >= 0]
    k = min(classes - alone - 1, len(rest))
    if k > 1:
        np.sqrt(x, out=x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        weight = smooth[rest].astype(np.float32)
        centres = x[:k].copy()  # the commonest
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            for c in range(k):
                if (own == c).any():
                    centres[c] = weight[own == c] @ x[own == c]
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        group[rest] = alone + own
    total = np.bincount(group, smooth, classes)
    return group, np.log10(smooth / total[group]).astype(np.float32)


def fresh(counts: np.ndarray, cells: np.ndarray, times: np.ndarray, classes: int, seed: int) -> Attention:
    """The model before training."""
    group, share = classes_of(counts, cells, times, classes)
    row = np.arange(len(counts)) + 1  # row 0: the beginning
    r = np.random.default_rng(seed)
    shapes = {"E": (len(counts) + 1, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "A": (WIDTH, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, WIDTH), "U": (WIDTH, classes), "u": (classes,)}
    p = {k: (r.normal(0, 0.25, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    p["u"] = np.log(np.bincount(group, counts + 1.0, classes) / (counts + 1.0).sum() + 1e-9).astype(np.float32)
    return Attention(p, group, share, row)


class Learner:
    """Adam on the class log loss, in place; of the embedding a step touches only the rows that its windows have.

    All weights but the embedding lie in one vector, of which ``p`` holds views, so a step updates them at once.
    """

    TRI = np.tri(WINDOW, dtype=np.float32)

    def __init__(self, model: Attention) -> None:
        p = model.p
        dense = [k for k in p if k != "E"]
        ends = np.cumsum([p[k].size for k in dense])
        self.flat = np.concatenate([p[k].reshape(-1) for k in dense])
        self.slope = np.zeros_like(self.flat)
        views = [{k: x[end - p[k].size : end].reshape(p[k].shape) for k, end in zip(dense, ends, strict=True)} for x in (self.flat, self.slope)]
        self.model, self.p, self.g, self.step, self.windows = model, views[0] | {"E": p["E"]}, views[1], 0, 0
        model.p = self.p
        self.moments = np.zeros((2, len(self.flat)), np.float32)
        self.rows = np.zeros((2, *p["E"].shape), np.float32)  # the embedding's moments
        self.seen = np.zeros(len(p["E"]), np.float32)  # how often a row was met
        self.place = np.zeros(len(p["E"]), np.int64)

    def learn(self, data: np.ndarray, later: np.ndarray, rate: float) -> None:
        """One step. ``data`` are rows of WINDOW + 1 ids, -1 for the beginning and -2 for no id; of ``later`` windows the overlap is context only."""
        p, g, scale, windows = self.p, self.g, np.float32(WIDTH**-0.5), len(data)
        x = np.where(data[:, :-1] >= 0, self.model.row[np.maximum(data[:, :-1], 0)], 0).reshape(-1)
        y = np.where(data[:, 1:] >= 0, self.model.group[np.maximum(data[:, 1:], 0)], -1)
        y[later, :OVERLAP] = -1
        y = y.reshape(-1)
        cube, flat = lambda t: t.reshape(windows, WINDOW, -1), lambda t: t.reshape(len(x), -1)  # products of small matrices are slow one by one
        row_sums = lambda t: cube(flat(t) @ np.ones(t.shape[-1], np.float32))
        h0 = flat(cube(p["E"][x]) + p["P"])
        q, k, w = cube(h0 @ (p["Q"] * scale)), cube(h0 @ p["K"]), cube(h0 @ p["V"])
        a = q @ k.transpose(0, 2, 1)
        np.exp(np.clip(a, -60, 60, out=a), out=a)  # exp() must neither overflow nor vanish
        a *= self.TRI
        a /= row_sums(a)
        c = flat(a @ w)
        h1 = h0 + c @ p["O"]
        pre = h1 @ p["A"]
        pre += p["a"]
        act = np.maximum(pre, 0)
        h2 = h1 + act @ p["B"]
        d2 = self.class_slopes(h2, y)
        g["B"][:] = act.T @ d2
        dp = d2 @ p["B"].T
        dp *= pre > 0
        g["A"][:], g["a"][:] = h1.T @ dp, dp.sum(0)
        d1 = d2 + dp @ p["A"].T
        g["O"][:] = c.T @ d1
        dc = cube(d1 @ p["O"].T)
        ds = dc @ w.transpose(0, 2, 1)
        ds *= a
        ds -= a * row_sums(ds)
        dq, dk, dw = flat(ds @ k), flat(ds.transpose(0, 2, 1) @ q), flat(a.transpose(0, 2, 1) @ dc)
        dq *= scale
        g["Q"][:], g["K"][:], g["V"][:] = h0.T @ dq, h0.T @ dk, h0.T @ dw
        d0 = d1 + dq @ p["Q"].T
        d0 += dk @ p["K"].T
        d0 += dw @ p["V"].T
        g["P"][:] = cube(d0).sum(0)
        number = np.arange(len(x))
        self.place[x] = number
        rows = x[self.place[x] == number]
        self.place[rows] = number[: len(rows)]
        at = self.place[x]
        of_rows = np.bincount((at[:, None] * WIDTH + np.arange(WIDTH)).reshape(-1), d0.reshape(-1), len(rows) * WIDTH)
        self.seen[rows] += np.bincount(at, minlength=len(rows))
        self.step += 1
        self.windows += windows
        now = rate * min(1.0, self.step / 20)
        self.flat -= self.change(self.slope, self.moments, now)
        moments = self.rows[:, rows]
        p["E"][rows] -= self.change(of_rows.astype(np.float32).reshape(-1, WIDTH), moments, now)
        self.rows[:, rows] = moments

    def class_slopes(self, h2: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slopes of the mean log loss along ``h2``; those of the classes' weights are put into ``g``. Only where an id is wanted."""
        ok = np.flatnonzero(y >= 0)
        both = np.concatenate([self.p["U"], self.p["u"][None]])
        slopes, sums = np.zeros_like(h2), np.zeros_like(both)
        for some in (ok[at : at + CACHED] for at in range(0, len(ok), CACHED)):
            h = np.concatenate([h2[some], np.ones((len(some), 1), np.float32)], axis=1)
            z, total, _ = exponentials(h @ both)
            z[np.arange(len(some)), y[some]] -= total
            share = (1 / (total * np.float32(len(ok))))[:, None]
            sums += (h * share).T @ z
            slopes[some] = (z @ self.p["U"].T) * share
        self.g["U"][:], self.g["u"][:] = sums[:-1], sums[-1]
        return slopes

    def change(self, slope: np.ndarray, moments: np.ndarray, rate: float) -> np.ndarray:
        m, v = moments
        m += np.float32(0.1) * (slope - m)
        v += np.float32(0.01) * (slope * slope - v)
        return np.float32(rate / (1 - 0.9**self.step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**self.step))) + np.float32(1e-8))


def train(windows: list[np.ndarray], counts: np.ndarray, classes: int = CLASSES, epochs: int = 3, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Attention:
    """A model of the given ``windows``, rows of WINDOW + 1 ids; -1 stands for the beginning and -2 for no id."""
    data = np.stack(windows).astype(np.int64) if windows else np.zeros((0, WINDOW + 1), np.int64)
    model = fresh(counts, *neighbours(data[:, :-1].reshape(-1), data[:, 1:].reshape(-1), context_places(counts)), classes, seed)
    learner, r = Learner(model), np.random.default_rng(seed)
    steps = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for at in range(0, len(data), batch):
            some = data[order[at : at + batch]]
            learner.learn(some, np.zeros(len(some), bool), rate * (1 - learner.step / (steps + 1)))
    model.tables()
    return model


def windows_of(ids: np.ndarray, sizes: np.ndarray, chosen=None) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the sequences that lie one behind the other in ``ids``, as scoring cuts them: every id is wanted in one of them.

    Rows of WINDOW + 1 ids, and whether the window is not the first of its sequence; ``chosen`` takes the windows' number and says which.
    """
    step = WINDOW - OVERLAP
    more = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // step)), 0)
    owner = np.repeat(np.arange(len(sizes)), more)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
    if chosen is not None:
        some = chosen(len(owner))
        owner, number = owner[some], number[some]
    first = (np.cumsum(sizes) - sizes)[owner]
    at = (first + number * step)[:, None] + np.arange(-1, WINDOW)
    data = ids[np.clip(at, 0, max(0, len(ids) - 1))].astype(np.int64) if len(ids) else np.zeros((0, WINDOW + 1), np.int64)
    data[at < first[:, None]] = -1
    data[at >= (first + sizes[owner])[:, None]] = -2
    return data, number > 0


def encode(tool: Subwords, texts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Subword ids of the texts one behind the other, each with its end id; their sizes; and the places of the words of each."""
    each = tool.places([common.space_words(t if isinstance(t, str) else None) for t in texts])
    places, owner = np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(each)), [len(p) for p in each])
    sizes = np.bincount(owner, (tool.start[places + 1] - tool.start[places]), len(each)).astype(np.int64) + 1
    ids = tool.ids(places)[:-1]
    return (np.insert(ids, np.cumsum(sizes - 1), tool.end) if len(each) else ids), sizes, each


def id_blocks(docs: DataFrame, path: str) -> DataFrame:
    """(number, ids, sizes): the ids of every document, written once, some documents a row."""

    def run(batches):
        from pyspark import TaskContext

        tool, number = subwords(path), TaskContext.get().partitionId() << 32
        kind = np.uint16 if tool.size <= 1 << 16 else np.int32
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                if tool.full:
                    tool.clear()
                ids, sizes, _ = encode(tool, batch["text"][at : at + BLOCK_ROWS])
                number += 1
                yield pd.DataFrame({"number": [number], "width": [np.dtype(kind).itemsize], "ids": [ids.astype(kind).tobytes()], "sizes": [sizes.tobytes()]})

    return cut(common.small_batches(docs.select("text")).mapInPandas(run, "number long, width int, ids binary, sizes binary"))


def _unpacked(batches):
    for batch in batches:
        for number, width, ids, sizes in zip(batch["number"], batch["width"], batch["ids"], batch["sizes"], strict=True):
            yield number, np.frombuffer(ids, np.uint16 if width == 2 else np.int32).astype(np.int64), np.frombuffer(sizes, np.int64)


def count_neighbours(blocks: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, times) of ``neighbours`` over all documents; at most 2 CONTEXTS cells an id of the vocabulary reach the driver."""
    place = context_places(counts)

    def run(batches):
        total = np.zeros(len(place) * 2 * CONTEXTS, np.int32)
        for _, ids, sizes in _unpacked(batches):
            left, right = ids[:-1].copy(), ids[1:]
            left[np.cumsum(sizes)[:-1] - 1] = -1  # an end stands beside nothing
            cells, times = neighbours(left, right, place)
            total[cells] += times.astype(np.int32)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            yield pd.DataFrame({"hash": some[at : at + 100_000], "n": total[some[at : at + 100_000]].astype(np.int64)})

    return packed_counts(blocks.mapInPandas(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))


def train_on(blocks: DataFrame, counts: np.ndarray, sample: int | None = None, classes: int = CLASSES, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Attention:
    """A model that has learnt to predict every id of the documents in ``blocks`` once (of about ``sample`` windows, where a caller sets a bound)."""
    spark = blocks.sparkSession
    model = fresh(counts, *count_neighbours(blocks, counts), classes, seed)
    windows = counts.sum() / (WINDOW - OVERLAP)
    share = 1.0 if sample is None else min(1.0, sample / max(1.0, windows))
    dealt = cut(blocks.repartition(max(1, int(np.ceil(windows * share / TASK_WINDOWS)))))
    dense = [k for k in model.p if k != "E"]

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw, np.float32).astype(np.float64) for raw in parts["sums"])
        return pd.DataFrame({"slice": parts["slice"][:1], "deal": 0, "sums": [total.astype(np.float32).tobytes()]})

    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        now = rate * (1 - number / ROUNDS)

        def learn(batches, sent=sent, number=number, now=now):
            from pyspark import TaskContext

            base = sent.value
            learner = Learner(Attention({k: x.copy() for k, x in base.p.items()}, base.group, base.share, base.row))
            r = np.random.default_rng((seed, number))

            def use(held):
                data, later = (np.concatenate(x) for x in zip(*held, strict=True))
                order = r.permutation(len(data))
                for at in range(0, len(data), batch):
                    learner.learn(data[order[at : at + batch]], later[order[at : at + batch]], now)

            held, size = [], 0
            for block, ids, sizes in _unpacked(batches):
                def chosen(n, block=block):
                    drawn = np.random.default_rng((seed, block)).random(n)  # the same in every round: each window is in one of them
                    return np.floor(drawn * ROUNDS / share) == number if share else np.zeros(n, bool)

                held.append(windows_of(ids, sizes, chosen))
                size += len(held[-1][0])
                if size >= SHUFFLED:
                    use(held)
                    held, size = [], 0
            if size:
                use(held)
            if not learner.windows:
                return
            p, deal = learner.p, TaskContext.get().partitionId() % 16
            flat = np.concatenate([p[k].reshape(-1) for k in dense] + [[1.0]]) * learner.windows
            yield pd.DataFrame({"slice": [-1], "deal": [deal], "sums": [flat.astype(np.float32).tobytes()]})
            for at in range(0, len(p["E"]), SLICE):  # a row's mean is over the tasks that met it
                seen = learner.seen[at : at + SLICE, None]
                if seen.any():
                    yield pd.DataFrame({"slice": [at], "deal": [deal], "sums": [np.concatenate([p["E"][at : at + SLICE] * seen, seen], axis=1).tobytes()]})

        schema = "slice int, deal int, sums binary"
        found = dealt.mapInPandas(learn, schema).groupBy("slice", "deal").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
        for r in found.collect():  # as many bytes as the weights have, whatever the input
            sums = np.frombuffer(r["sums"], np.float32)
            if r["slice"] >= 0:
                sums = sums.reshape(-1, WIDTH + 1)
                met = sums[:, -1] > 0
                model.p["E"][r["slice"] : r["slice"] + len(sums)][met] = sums[met, :-1] / sums[met, -1:]
            else:
                at = 0
                for k in dense:
                    x = model.p[k]
                    model.p[k] = (sums[at : at + x.size] / sums[-1]).reshape(x.shape).astype(np.float32)
                    at += x.size
        sent.unpersist()
    model.tables()
    return model


@dataclass
class Counts:
    words: DataFrame  # hash, n
    tokens: int  # N
    distinct: int  # V
    ends: int
    pieces: np.ndarray


def count_corpus(docs: DataFrame, path: str) -> Counts:
    """Counts of words (by 64-bit hash), subword ids and ends over all documents."""

    def run(batches):
        tool, ends = subwords(path), 0
        pieces, here = np.zeros(tool.size, np.int64), np.zeros(0, np.int64)

        def flush():
            used = np.flatnonzero(here)
            n, size = here[used], tool.start[used + 1] - tool.start[used]
            pieces[:] += np.bincount(tool.ids(used)[:-1], np.repeat(n, size), tool.size).astype(np.int64)
            return pd.DataFrame({"kind": 0, "key": tool.hash[used].view(np.int64), "n": n})

        for batch in batches:
            if tool.full:
                yield flush()
                tool.clear()
                here = np.zeros(0, np.int64)
            places = np.concatenate([np.zeros(0, np.int64), *tool.places([common.space_words(t if isinstance(t, str) else None) for t in batch["text"]])])
            now = np.bincount(places, minlength=len(tool.known))
            now[: len(here)] += here
            here = now
            ends += len(batch)
        yield flush()
        pieces[tool.end] += ends
        some = np.flatnonzero(pieces)
        yield pd.DataFrame({"kind": 1, "key": some, "n": pieces[some]})
        yield pd.DataFrame({"kind": 2, "key": [0], "n": [ends]})

    found = cut(common.small_batches(docs).select("text").mapInPandas(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = found.where("kind = 0").select(F.col("key").alias("hash"), "n")
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    pieces, ends = np.zeros(subwords(path).size, np.int64), 0
    for r in found.where("kind > 0").collect():  # one row an id of the vocabulary at most
        if r["kind"] == 1:
            pieces[r["key"]] = r["n"]
        else:
            ends = r["n"]
    return Counts(words, (n or 0) + ends, v + (ends > 0), ends, pieces)


def common_from(words: DataFrame, most: int) -> int:
    """The count from which words are common: at most ``most`` words have it."""
    sizes = words.groupBy(F.floor(8 * F.log2("n")).alias("band")).agg(F.count("*").alias("words"), F.min("n").alias("low")).collect()  # some hundred bands
    total, low = 0, 1 << 62
    for band in sorted(sizes, key=lambda r: -r["band"]):
        total += band["words"]
        if total > most:
            break
        low = band["low"]
    return low


def packed_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their counts; they reach the driver as one block of 16 bytes a word from each task, not as rows."""

    def pack(batches):
        held = [b.to_numpy(np.int64) for b in batches]
        if held:
            yield pd.DataFrame({"block": [np.concatenate(held).tobytes()]})

    blocks = [np.frombuffer(r["block"], np.int64) for r in words.select("hash", "n").mapInPandas(pack, "block binary").collect()]
    both = np.concatenate(blocks).reshape(-1, 2) if blocks else np.zeros((0, 2), np.int64)
    both = both[np.argsort(both[:, 0], kind="stable")]
    return both[:, 0].copy(), both[:, 1].copy()


def score_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", is_held_out=held_out, sample: int | None = None, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the documents that are not held out. Null and empty texts are one end token. Whole texts are scored, whatever their
    length. ``base_score`` is the smoothed unigram log10 probability of words and end, ``score`` the attention model's. Without
    training documents all counts are zero. All windows are learnt from, or about ``sample`` of them where a caller sets it. Repeated rows count and are returned as often as they came. Other columns are not read; an
    empty table gives an empty result.
    """
    common.small_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(is_held_out(F.col("id")), F.lit(False)))
    learn = rows.where("not held_out").select("id", "text")
    counts = count_corpus(learn, tokenizer_path)
    model = train_on(id_blocks(learn, tokenizer_path), counts.pieces, sample)
    divisor, low = float(counts.tokens + counts.distinct + 1), common_from(counts.words, common_words)
    sent = docs.sparkSession.sparkContext.broadcast((model, *packed_counts(counts.words.where(F.col("n") >= low))))
    end_known, end_log = int(counts.ends > 0), float(np.log10((counts.ends + 1) / divisor))

    def run(batches):
        tool, (model, keys, numbers) = subwords(tokenizer_path), sent.value
        for batch in batches:
            if tool.full:
                tool.clear()
            ids, sizes, each = encode(tool, batch["text"])
            n = np.array([len(p) for p in each])
            places, owner = np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(each)), n)
            used = np.flatnonzero(np.bincount(places, minlength=1))
            line = np.zeros(len(tool.known) + 1, np.int64)
            line[used] = np.arange(len(used))
            c = lookup(keys, numbers, tool.hash[used].view(np.int64))[line[places]] if len(places) else places
            is_common = c > 0
            other, times = np.unique(owner[~is_common] * len(line) + places[~is_common], return_counts=True)
            stops = np.searchsorted(other, np.arange(1, len(each)) * len(line))
            yield pd.DataFrame({
                "id": batch["id"], "held_out": batch["held_out"], "n_tokens": n + 1, "score": model.scores(ids, sizes),
                "n_known": np.bincount(owner, is_common, len(each)).astype(np.int64) + end_known,
                "base_score": np.bincount(owner, np.where(is_common, np.log10((c + 1.0) / divisor), 0), len(each)) + end_log,
                "words": np.split(tool.hash[other % len(line)].view(np.int64), stops), "times": np.split(times, stops),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInPandas(run, f"id {kind}, held_out boolean, n_tokens long, score double, n_known long, base_score double, words array<long>, times array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    other = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("hash"), F.col("w.times").alias("times"))
    met = other.join(counts.words.where(F.col("n") < low), "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1.0) / divisor)).alias("rest"))
    whole = scored.drop("words", "times").join(met, "row", "left")
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def lookup(keys: np.ndarray, numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, numbers[at], 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES: dict[str, str] = {}
