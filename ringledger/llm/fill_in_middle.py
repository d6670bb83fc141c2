"""Fill-in-middle transformation by secondary sort.

A text is cut at two points that its id's hash names, and its parts are written in another order behind marks. Every row becomes a header and
pieces of at most ``UNITS`` code points, keyed by (document, output position). ``repartition`` and ``sortWithinPartitions`` (the two halves of
``repartitionAndSortWithinPartitions`` for tables, which sort with spilling) deal them by document and sort them by position, so a task streams piece after piece into an
incremental digest and never builds an output. The stream is then read as a reader would read it, by marks and form alone: each stretch gets the position it had in the
text. The stretches are sorted anew by that position, which needs no second shuffle, since they have not left their partitions, and stream into the digest of the
restored text.

A document is known by a hash of its id and text and by the input partition it came from. Rows that repeat within a partition give the same pieces, which then
stand side by side: each is used once, and the document is returned as often as its header came. So a hot id, or a text that a third of all rows share,
is spread over as many keys as there are input partitions, and a task that runs again gives the same keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Marks in the order of the output, and the place of what follows each in the text.
ORDERS = {"plain": ((), (0,)), "psm": ((PREFIX, SUFFIX, MIDDLE), (0, 2, 1)), "spm": ((SUFFIX, PREFIX, MIDDLE), (2, 0, 1))}
UNITS = 4096


@dataclass(frozen=True)
class Choice:
    """Forms in per cent: ``changed`` of the texts are transformed, ``spm`` of those suffix first. ``seed`` starts the hashes."""

    seed: int = 1
    changed: int = 90
    spm: int = 20


def numbers(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cuts(doc_id, text: str, choice: Choice = Choice()) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) in code points."""
    one, two, change, order = numbers(choice.seed, doc_id)
    low, high = sorted((one % (len(text) + 1), two % (len(text) + 1)))
    if not text or any(m in text for m in MARKS) or change % 100 >= choice.changed:
        return "plain", low, high
    return "spm" if order % 100 < choice.spm else "psm", low, high


def pieces(text: str, form: str, low: int, high: int, units: int = UNITS) -> Iterator[str]:
    """The output, piece by piece: marks, and chunks of the parts."""
    if form == "plain":
        spans = [(None, 0, len(text))]
    else:
        part = {PREFIX: (0, low), SUFFIX: (high, len(text)), MIDDLE: (low, high)}
        spans = [(m, *part[m]) for m in ORDERS[form][0]]
    for mark, start, end in spans:
        if mark:
            yield mark
        for k in range(start, end, units):
            yield text[k : min(k + units, end)]


class Reader:
    """Gives every stretch of an output its position in the text; marks may lie across pieces. No transformed text contains a mark."""

    def __init__(self, form: str) -> None:
        self.marks, self.places = ORDERS[form]
        self.at, self.number, self.left = (-1 if self.marks else 0), 0, ""

    def place(self, stretch: str) -> Iterator[tuple[tuple[int, int], str]]:
        if stretch:
            if self.at < 0:
                raise ValueError("the output does not begin with the first mark of its form")
            self.number += 1
            yield (self.places[self.at], self.number), stretch

    def feed(self, piece: str) -> Iterator[tuple[tuple[int, int], str]]:
        text = self.left + piece
        while self.at + 1 < len(self.marks):
            found = text.find(self.marks[self.at + 1])
            if found < 0:
                keep = min(len(text), len(PREFIX) - 1)
                self.left = text[len(text) - keep :]
                yield from self.place(text[: len(text) - keep])
                return
            yield from self.place(text[:found])
            text, self.at = text[found + len(PREFIX) :], self.at + 1
        self.left = ""
        yield from self.place(text)

    def close(self) -> Iterator[tuple[tuple[int, int], str]]:
        if self.at + 1 < len(self.marks):
            raise ValueError("the output lacks a mark of its form")
        yield from self.place(self.left)


#: A row of the sort: a header (place -1) or a piece. Headers carry the document, and behind the first pass the output's digest and the number of copies.
ENTRY = "key string, place int, number long, piece string, n long, form string, low long, high long, output_sha256 string, copies long"
WIDTH = len(ENTRY.split(", "))


def row_key(part: int, *values) -> str:
    return f"{hashlib.sha256(repr(values).encode('utf-8', 'surrogatepass')).hexdigest()[:32]}-{part}"


def header(key: str, n: int | None, form: str, low: int | None, high: int | None, doc_id, sha: str | None = None, copies: int | None = None) -> tuple:
    return key, -1, 0, None, n, form, low, high, sha, copies, doc_id


def piece(key: str, place: int, number: int, text: str) -> tuple:
    return (key, place, number, text, *[None] * (WIDTH - 3))


def mapped(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``df`` through a function of row tuples, in batches of bounded size both ways."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

        held, size = [], 0
        for row in make(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= 2000 or size >= 1 << 22:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return small_batches(df).mapInArrow(run, schema)


def entry_schema(df: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ENTRY).fields, T.StructField("id", df.schema[id_col].dataType)])


def cut_documents(docs: DataFrame, id_col: str, text_col: str, choice: Choice, units: int) -> DataFrame:
    """The headers of all documents and the pieces of all outputs."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, part in rows:
            text = text or ""
            form, low, high = cuts(doc_id, text, choice)
            key = row_key(part, doc_id, text)
            yield header(key, len(text), form, low, high, doc_id)
            for k, chunk in enumerate(pieces(text, form, low, high, units)):
                yield piece(key, 0, k, chunk)

    return mapped(docs.select(id_col, text_col, F.spark_partition_id()), cut, entry_schema(docs, id_col))


def by_document(entries: DataFrame, parts: int | None) -> DataFrame:
    return entries.repartition(parts or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def in_order(entries: DataFrame) -> DataFrame:
    """Behind ``by_document``, and behind what keeps its rows in their partitions, this moves nothing."""
    return entries.sortWithinPartitions("key", "place", "number")


def streams(rows: Iterator[tuple], begin: Callable, add: Callable, end: Callable) -> Iterator:
    """Over sorted entries: ``begin(header)`` gives a document's state, ``add(state, text)`` and ``end(state, copies)`` what it yields; repeated entries count once."""
    key, at, copies, state = None, None, 0, None
    for row in rows:
        if row[0] != key:
            if key is not None:
                yield from end(state, copies)
            key, at, copies, state = row[0], row[1:3], 1, begin(row)
        elif row[1] < 0:
            copies += 1
        elif row[1:3] != at:
            at = row[1:3]
            yield from add(state, row[3])
    if key is not None:
        yield from end(state, copies)


def _result(head: tuple, *more: str) -> tuple:
    n, form, low, high = head[4:8]
    return head[-1], n, form, *((None, None) if form == "plain" else (low, high - low)), *more


def _schema(docs: DataFrame, id_col: str, *more: str) -> T.StructType:
    plain = T.StructType.fromDDL(", ".join(["n long, form string, prefix_chars long, middle_chars long", *[f"{c} string" for c in more]]))
    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *plain.fields])


def keep(state: tuple, text: str) -> tuple:
    state[1].append(text)
    return ()


def transform_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", choice: Choice = Choice(), parts: int | None = None, units: int = UNITS) -> DataFrame:
    """One row a document: id, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output`` text.

    Null texts count as empty, and empty ones and those that contain a mark stay plain. Null ids are hashed as an empty string. Rows that repeat are returned as often as they
    came, an empty table gives an empty result, and other columns, whatever their names, are not read.
    """
    end = lambda state, copies: [_result(state[0], "".join(state[1]))] * copies
    sorted_ = in_order(by_document(cut_documents(docs, id_col, text_col, choice, units), parts))
    return mapped(sorted_, lambda rows: streams(rows, lambda head: (head, []), keep, end), _schema(docs, id_col, "output"))


def restore_documents(outputs: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output", parts: int | None = None, units: int = UNITS) -> DataFrame:
    """(id, ``text``) from outputs and their forms alone. Null outputs give empty texts if plain; a form that is not known, or an output without its marks, is an error."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, form, output, part in rows:
            reader, key = Reader(form), row_key(part, doc_id, form, output)
            yield header(key, None, form, None, None, doc_id)
            for k in range(0, len(output or ""), units):
                for (place, number), stretch in reader.feed(output[k : k + units]):
                    yield piece(key, place, number, stretch)
            for (place, number), stretch in reader.close():
                yield piece(key, place, number, stretch)

    entries = mapped(outputs.select(id_col, form_col, output_col, F.spark_partition_id()), cut, entry_schema(outputs, id_col))
    end = lambda state, copies: [(state[0][-1], "".join(state[1]))] * copies
    schema = T.StructType([T.StructField(id_col, outputs.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return mapped(in_order(by_document(entries, parts)), lambda rows: streams(rows, lambda head: (head, []), keep, end), schema)


class Output:
    """A document whose output is being read: its digest so far, and the places its stretches go to."""

    def __init__(self, head: tuple) -> None:
        self.head, self.sha, self.reader = head, hashlib.sha256(), Reader(head[5])

    def add(self, text: str) -> Iterator[tuple]:
        self.sha.update(text.encode())
        for (place, number), stretch in self.reader.feed(text):
            yield piece(self.head[0], place, number, stretch)

    def end(self, copies: int) -> Iterator[tuple]:
        for (place, number), stretch in self.reader.close():
            yield piece(self.head[0], place, number, stretch)
        yield header(self.head[0], *self.head[4:8], self.head[-1], self.sha.hexdigest(), copies)


class Restored:
    def __init__(self, head: tuple) -> None:
        self.head, self.sha = head, hashlib.sha256()

    def add(self, text: str) -> tuple:
        self.sha.update(text.encode())
        return ()

    def end(self, _: int) -> list[tuple]:
        return [_result(self.head, self.head[8], self.sha.hexdigest())] * self.head[9]


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", choice: Choice = Choice(), parts: int | None = None, units: int = UNITS) -> DataFrame:
    """As ``transform_documents``, with ``output_sha256`` and ``restored_sha256`` (the text rebuilt from output and form) for the output; no text is held whole behind the shuffle."""
    entries = in_order(by_document(cut_documents(docs, id_col, text_col, choice, units), parts))
    stretches = mapped(entries, lambda rows: streams(rows, Output, Output.add, Output.end), entry_schema(docs, id_col))
    return mapped(in_order(stretches), lambda rows: streams(rows, Restored, Restored.add, Restored.end), _schema(docs, id_col, "output_sha256", "restored_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
with cut as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
hashed as (select *, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from cut),
placed as (select *, least(h1 % (n + 1), h2 % (n + 1)) low, greatest(h1 % (n + 1), h2 % (n + 1)) high,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from hashed),
parts as (select *, substring(t, 1, low) p, substring(t, low + 1, high - low) m, substring(t, high + 1) s from placed)
select doc_id, n, form, case when form <> 'plain' then low end prefix_chars, case when form <> 'plain' then high - low end middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
    sha256(t) restored_sha256 from parts"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": ORACLE}
