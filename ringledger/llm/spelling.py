"""Spelling variant grouping by pivotal grams.

Bigrams are ordered from rare to frequent. Of each word the three rarest are its prefix, and dynamic programming picks the two disjoint ones among them that
fewest words hold: its pivots. One edit spoils at most one of two disjoint bigrams, so of two words at distance one, the word whose
prefix ends earlier in the order has a pivot that stands, unspoilt, in the prefix of the other. Pivots are therefore looked up in an index of all prefix grams.

Position limits: an edit lies wholly before or wholly behind a gram that it leaves alone, so on one side of the gram both words are equal, and the key of the
index is that side together with the gram, which fixes the position from one end. Where that side is short (``SHORT``), its bucket would hold many words; then the
other side must agree as well, either in its first three characters or in all behind them. What meets by a key is verified by edit distance.

Every step is a Spark shuffle with keys of this kind; a word that makes up a third of all tokens is summed before the shuffle, and large buckets are ordinary equi-joins
that adaptive execution may split. Only the bigrams' frequencies reach the driver: the letters are 90 different ones, so there are 8,100 at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import small_batches

#: Runs in lower-cased text.
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, RATIO, SPOILT = 5, 3, 2, 97
EDITS, GRAM = 1, 2
PREFIX, PIVOTS = GRAM * EDITS + 1, EDITS + 1
#: An untouched side of so many code points or fewer, gram included, does not make a key alone.
SHORT, HEAD = 5, 3
#: Different words that a task counts before it hands them on; code points of a text that are read at a time.
MAX_COUNTED, SLICE = 200_000, 1 << 20


def runs(text: str) -> Iterator[str]:
    """The runs of a text, read in slices that end where a run does."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and (text[end].isascii() and text[end].isalpha() or "À" <= text[end] <= "ÿ"):
            end += 1
        yield from RUN.findall(text[start:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        start = end


def spoilt(doc_id, run: str) -> str:
    """The run, less one character where its hash with the document's id says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SPOILT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` code points that occur ``min_count`` times or more. A null id counts as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                doc_id = "" if doc_id is None else doc_id
                for run, n in Counter(runs(text)).items():
                    word = spoilt(doc_id, run)
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) >= MAX_COUNTED:
                    yield out()
        if seen:
            yield out()

    counted = small_batches(docs.select(id_col, text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """gram -> (place from rare to frequent, number of words that hold it)."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda k: F.substring(F.col("word"), k, F.lit(GRAM))))
    held = words.where(F.length("word") >= GRAM).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {g: (k, n) for k, (g, n) in enumerate(sorted(((r["gram"], r["n"]) for r in held), key=lambda x: (x[1], x[0])))}


def gram_prefix(word: str, ranks: dict[str, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(position, place, words that hold it) of the rarest grams: the first ``PREFIX``, and what equals the last of them."""
    grams = sorted((*ranks[word[k : k + GRAM]], k) for k in range(len(word) - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return sorted((k, place, n) for place, n, k in grams if place <= last)


def pivots(prefix: list[tuple[int, int, int]], count: int = PIVOTS) -> list[int]:
    """Positions of ``count`` disjoint grams with the smallest sum of holders; ``best[j][k]`` is the cheapest choice of j of the first k grams."""
    nothing = (float("inf"), ())
    best = [[(0, ())] * (len(prefix) + 1)] + [[nothing] * (len(prefix) + 1) for _ in range(count)]
    for j in range(1, count + 1):
        for k, (position, _, n) in enumerate(prefix, 1):
            before = sum(p + GRAM <= position for p, *_ in prefix[: k - 1])
            cost, chosen = best[j - 1][before]
            best[j][k] = min(best[j][k - 1], (cost + n, (*chosen, position)))
    return list(best[count][-1][1])


def keys(word: str, position: int) -> Iterator[str]:
    """What two words share if one edit parts them and leaves the gram at ``position`` alone: its left side with it, or its right side."""
    for side, known, rest in (("<", word[: position + GRAM], word[position + GRAM :]), (">", word[position:], word[:position][::-1])):
        if len(known) > SHORT:
            yield f"{side}{known}"
        else:  # the edit lies behind the next three characters, or what follows it is equal, counted from the far end
            yield f"{side}{known}|{rest[:HEAD]}"
            yield f"{side}{known}/{rest[HEAD:]}"
            yield f"{side}{known}/{rest[HEAD + 1 :]}"


def entries(words: DataFrame, ranks: dict[str, tuple[int, int]], of_pivots: bool) -> DataFrame:
    """(key, word, n, last) of the words' pivots, or of all grams of their prefixes; ``last`` is the place of the prefix's last gram."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = gram_prefix(word, ranks)
                last = max(place for _, place, _ in prefix)
                at = pivots(prefix) if of_pivots else [k for k, *_ in prefix]
                out += [(key, word, n, last) for key in {x for k in at for x in keys(word, k)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int32())], ["key", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(make, "key string, word string, n long, last int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words of ``words`` (at least 4 code points long) at an edit distance of one."""
    ranks = gram_ranks(words)
    asked, held = entries(words, ranks, True).alias("a"), entries(words, ranks, False).alias("h")
    meets = (F.col("a.key") == F.col("h.key")) & (F.col("a.last") <= F.col("h.last")) & (F.col("a.word") != F.col("h.word")) & (F.abs(F.length("a.word") - F.length("h.word")) <= EDITS)
    found = asked.join(held, meets).where(F.levenshtein("a.word", "h.word", EDITS) == EDITS)
    pair = F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ah", "ha")])
    return found.select(F.explode(pair).alias("p")).select("p.*").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the form of the form and so on. Pointers double in length a round, and a form occurs at least twice as often as its
    word, so there are at most six rounds for counts below 2^64. Each round is written."""
    up = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not up.where("moved").isEmpty():
        there = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = cut(up.join(there, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return up.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """One row a word: ``word, form, root, n, n_near, form_n``.

    Words have at least 5 code points and ``min_count`` occurrences. A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least
    ``ratio`` times its own n, else null; ``root`` follows the forms to the last. ``ratio`` must be above one, else forms may run in circles. Null and empty texts have no words, null ids count as empty ones,
    rows that repeat count again, other columns are not read, and an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above one")
    words = cut(word_counts(docs, id_col, text_col, MIN_CHARS, min_count))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = F.col("best.near_n") >= ratio * F.col("n")
    formed = cut(words.join(near, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near_n")).alias("form_n")))
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_groups": op11_spelling_groups}
#: SQL has no crc32; the tests compare with a loop over all pairs.
ORACLES: dict[str, str] = {}
