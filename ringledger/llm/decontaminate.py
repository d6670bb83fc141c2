"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of consecutive words of the benchmark items. Documents stream through it word by
word: at each word it knows the longest run ending there that occurs in some item. Where that length reaches a
window (10 words, or a whole shorter item) the words of the run are hit. ``remove_spans`` then cuts the hit spans, and
drops documents of which too much was hit.

Scale: the benchmark is cut into blocks of at most ``max_block_words`` words by a hash of the item; one automaton per
block is built inside the tasks from the block's words, which are the only thing broadcast, so its size is bounded.
Documents are read once per block and never shuffled when there is one block; with more, rows get a number and are written, one block after the
other is scanned and its matches written, and only the matches are grouped and joined back to the rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import common

WINDOW = 10
MAX_BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
MATCHES = "array<struct<start:int,end:int>>"


def words(text: str | None) -> list[str]:
    """A-Z lower-cased; runs of digits, a-z and everything above ASCII. Null has none."""
    return WORD.findall(text.translate(LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton of several word sequences, in flat arrays.

    Words are numbers. A state's first move stands in two arrays, as most states have one; only states with more have a dict. An item's windows are named where they are met first on the way up
    the suffix links (``top``): a window's state has the items of all prefixes that end in it.
    """

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int = WINDOW) -> None:
        self.window, self.number = window, {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str] = []
        ends, owners, sizes, number = array("i"), array("i"), array("i"), self.number
        for k, (name, seq) in enumerate(x for x in items if x[1]):
            self.names.append(name)
            sizes.append(len(seq))
            last = 0
            for w in seq:
                last = self._extend(last, number.setdefault(w, len(number)))
                ends.append(last)
                owners.append(k)
        self._collect(ends, owners, sizes)

    def _move(self, s: int, w: int) -> int:
        """The state behind ``w``, or -1."""
        if self.word[s] == w:
            return self.to[s]
        more = self.more.get(s)
        return more.get(w, -1) if more else -1

    def _set(self, s: int, w: int, to: int) -> None:
        if self.word[s] in (w, -1):
            self.word[s], self.to[s] = w, to
        else:
            self.more.setdefault(s, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self._move(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self._move(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (q := self._move(p, w)) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _collect(self, ends: array, owners: array, sizes: array) -> None:
        """``top``: the window's state of each state that is as long, else -1. ``only``, ``several``: its items. ``whole``: short items that a state is, and ``near`` the next such state on the way up."""
        n, window, link, length = len(self.link), self.window, self.link, self.length
        self.top, self.near, self.only = array("i", [-1]) * n, array("i", [-1]) * n, array("i", [-1]) * n
        self.several: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        start = 0
        for k, size in enumerate(sizes):
            start += size
            if size < window:
                self.whole.setdefault(ends[start - 1], []).append((size, k))
        for s in map(int, np.argsort(np.frombuffer(length, np.int32), kind="stable").astype(np.int32)):
            up = link[s]
            if length[s] >= window:
                self.top[s] = self.top[up] if length[up] >= window else s
            self.near[s] = s if s in self.whole else self.near[up] if up >= 0 else -1
        for s, k in zip(ends, owners, strict=True):
            t = self.top[s]
            if t < 0 or self.only[t] == k:
                continue
            if self.only[t] < 0:
                self.only[t] = k
            else:
                self.several.setdefault(t, {self.only[t]}).add(k)

    def match(self, seq: list[str]) -> tuple[list[list[int]], list[int], int]:
        """Merged hit spans over the words, the items with occurring windows, and the longest run met."""
        first, to, more, link, length, window, near = self.word, self.to, self.more, self.link, self.length, self.window, self.near
        spans: list[list[int]] = []
        met: set[int] = set()
        seen: set[int] = set()
        state = run = longest = 0
        number, root, first_word, first_to = self.number, self.more.get(0, {}), self.word[0], self.to[0]
        for at, text in enumerate(seq):
            w = number.get(text)
            if w is None:
                state = run = 0
                continue
            if state and first[state] == w:
                state, run = to[state], run + 1
            else:
                while state:
                    nxt = to[state] if first[state] == w else more[state].get(w, -1) if state in more else -1
                    if nxt >= 0:
                        break
                    state = link[state]
                    run = length[state]
                if state:
                    state, run = nxt, run + 1
                else:  # every word of an item is a move of the root
                    state, run = (first_to if first_word == w else root[w]), 1
            if run > longest:
                longest = run
            short = near[state]
            if run >= window or short >= 0:
                size = run if run >= window else 0
                if run >= window and (top := self.top[state]) not in seen:
                    seen.add(top)
                    met |= self.several[top] if top in self.several else {self.only[top]}
                while short >= 0:
                    for n, k in self.whole[short]:
                        if n <= run:
                            met.add(k)
                            size = max(size, n)
                    short = near[link[short]]
                if size:
                    start = at + 1 - size
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([start, at + 1])
        return spans, [int(k) for k in met], longest


def packed(items: list[tuple[str, list[str]]]) -> tuple[list[str], str]:
    """The items of a block with words, as one text: words are without spaces."""
    return [name for name, seq in items if seq], "\n".join(" ".join(seq) for _, seq in items if seq)


def unpacked(names: list[str], text: str) -> Iterator[tuple[str, list[str]]]:
    """Item by item, so no more than one item's words are held beside the automaton."""
    return ((name, line.split(" ")) for name, line in zip(names, text.split("\n") if names else [], strict=True))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_block_words: int) -> tuple[int, Iterator[list[tuple[str, list[str]]]]]:
    """Number of blocks, which follows the benchmark's size, and the blocks of (item, words), each of about ``max_block_words``."""
    counted = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = counted.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    n = int(total // max_block_words) + 1

    def block(k: int) -> list[tuple[str, list[str]]]:
        rows = counted.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()
        return [(r["item"] or "", words(r["text"])) for r in rows]

    return n, map(block, range(n))


_built: dict[int, Automaton] = {}


def _automaton(handle) -> Automaton:
    """Built once per Python worker and block."""
    if handle.id not in _built:
        _built.clear()
        names, text, window = handle.value
        _built[handle.id] = Automaton(unpacked(names, text), window)
    return _built[handle.id]


class _Handle:
    def __init__(self, broadcast, number: int) -> None:
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


_numbers = iter(range(1, 1 << 60))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_words, spans, items, longest`` (and the text with ``keep_text``).

    ``spans`` are merged hit spans in words, ``items`` the ids (as sorted strings) of the benchmark items of which a window
    occurs, ``longest`` the longest matching run. Null and empty texts have no words and no hits; items without words
    match nothing; items with the same text are all named. Rows that repeat are returned as often; ids may repeat or
    be null. Other columns are not read. Empty tables give empty or unhit results.
    """
    columns = [id_col, *["text"] * keep_text, "n_words", "spans", "items", "longest"]
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    n, blocks = _blocks(benchmark, item_col, item_text_col, max_block_words)
    if n == 1:
        return _scan(rows, next(blocks), window, [id_col, *["text"] * keep_text])
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    return rows.join(_matches(rows, blocks, window), "_row").select(*columns)


def _scan(rows: DataFrame, items: list[tuple[str, list[str]]], window: int, carried: list[str], used: list | None = None) -> DataFrame:
    """``carried`` columns of ``rows`` with n_words, spans, items and longest of their text, by one block."""
    handle = _Handle(rows.sparkSession.sparkContext.broadcast((*packed(items), window)), next(_numbers))
    if used is not None:
        used.append(handle.broadcast)
    columns = [*carried, "n_words", "spans", "items", "longest"]
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried) + f"n_words long, spans {MATCHES}, items array<string>, longest int"

    def scan(batches):
        auto = _automaton(handle)
        names = auto.names
        for batch in batches:
            n_words, spans, met, longest = [], [], [], []
            for text in batch["text"]:
                seq = words(text)
                a, b, c = auto.match(seq)
                n_words.append(len(seq))
                spans.append([{"start": x, "end": y} for x, y in a])
                met.append(sorted({names[k] for k in b}))
                longest.append(c)
            out = {"n_words": n_words, "spans": spans, "items": met, "longest": longest}
            yield pd.DataFrame({c: batch[c] for c in carried} | out)[columns]

    return common.small_batches(rows).mapInPandas(scan, schema)


def _matches(rows: DataFrame, blocks: Iterator[list[tuple[str, list[str]]]], window: int) -> DataFrame:
    """(_row, n_words, spans, items, longest) of written ``rows`` over several blocks; one block is held at a time."""
    parts = None
    for items in blocks:
        used: list = []
        part = cut(_scan(rows.select("_row", "text"), items, window, ["_row"], used))
        used[0].unpersist()
        parts = part if parts is None else parts.unionByName(part)
    joined = parts.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    step = f"""aggregate(spans, cast(array() as {MATCHES}), (done, s) -> case
        when size(done) > 0 and element_at(done, -1).end >= s.start
        then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
        else concat(done, array(s)) end)"""
    return joined.withColumn("spans", F.expr(step))


def hit_words(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans of their texts, and without documents of which more than ``max_coverage`` of the words are hit.

    A removed span leaves one line break. Columns stay as they are, but for ``n_chars`` (where present), which follows the text.
    Null texts stay null. A document is returned as often as it came.
    """
    n, blocks = _blocks(benchmark, "item_id", "text", max_block_words)
    has_count = "n_chars" in docs.columns

    if n == 1:
        handle = _Handle(docs.sparkSession.sparkContext.broadcast((*packed(next(blocks)), window)), next(_numbers))
        rows = docs
    else:
        handle = None
        rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        rows = rows.join(_matches(rows.select("_row", F.col(text_col).alias("text")), blocks, window).select("_row", F.to_json("spans").alias("_spans")), "_row")

    def clean(batches):
        for batch in batches:
            texts, keep = [], []
            auto = _automaton(handle) if handle else None
            found = [None] * len(batch) if auto else batch["_spans"]
            for text, spans in zip(batch[text_col], found, strict=True):
                seq = words(text)
                hit = np.zeros(len(seq), bool)
                for a, b in auto.match(seq)[0] if auto else [(s["start"], s["end"]) for s in json.loads(spans)]:
                    hit[a:b] = True
                keep.append(not len(seq) or hit.mean() <= max_coverage)
                texts.append(cut_words(text, hit) if keep[-1] and hit.any() else text)
            batch = batch.assign(**{text_col: texts})
            if has_count:
                batch["n_chars"] = [len(t) if isinstance(t, str) else n for t, n in zip(texts, batch["n_chars"], strict=True)]
            yield batch.loc[np.array(keep, bool), docs_columns]

    docs_columns = docs.columns
    return common.small_batches(rows).mapInPandas(clean, docs.schema)


def cut_words(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them."""
    kept, at, inside = [], 0, False
    for k, m in enumerate(WORD.finditer(text.translate(LOWER))):
        if hit[k] and not inside:
            kept.append(text[at : m.start()].rstrip())
            inside = True
        elif not hit[k] and inside:
            at, inside = m.start(), False
    if not inside:
        kept.append(text[at:])
    return "\n".join(k for k in kept if k)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark).withColumn("n_hit", hit_words())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
with d as (select doc_id, {_WORDS} w from documents), b as (select item_id::varchar item, {_WORDS} w from benchmark),
sized as (select item, w, least(10, len(w)) n from b where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') g from (select item, w, n, unnest(range(1, len(w) - n + 2)) i from sized)),
sizes as (select distinct n from windows),
grams as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, item, n, i from grams join windows using (n, g)),
hit_words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, n, i from hits)) group by 1),
hit_items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": ORACLE}
