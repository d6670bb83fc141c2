"""Token counts of the fields or sections of documents, by offset-mapped attribution.

A document is encoded once and as a whole; the tokens' byte lengths give their byte spans, and those their
character spans. The spans are joined with the sections' intervals, and a token that crosses a boundary is
allocated by an explicit rule, so the counts of the sections and of what lies outside them add up to the document's.

Scale: documents stream in small batches without a shuffle; the ranks are read in each Python worker from a
path that every executor has.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = ("most", "start")


class Encoder:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def character_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the characters [start, end) of each: those of which it holds the first byte."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        firsts = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        return ids, firsts[ends - self.sizes[ids]], firsts[ends]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks_path, pattern)
    return _encoders[key]


def lines(text: str) -> np.ndarray:
    """[start, end) of every line, its line break included; none in an empty text."""
    cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    cuts = np.concatenate([[0], cuts[cuts < len(text)], [len(text)]]) if text else np.zeros(1, np.int64)
    return np.stack([cuts[:-1], cuts[1:]], axis=1)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens of none, and tokens that cross a boundary of sections.

    ``sections`` are sorted and do not overlap; empty ones get nothing. Rule ``most``: a token goes to the section that has most of
    its characters, the earlier of equals; ``start``: to the one that has its first character. A token without characters
    (inner bytes of a character cut into several tokens) goes with its character's section. Characters outside all sections count
    as one more candidate, which loses ties.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    counts = np.zeros(len(sections), np.int64)
    if not len(starts) or not len(sections):
        return counts, len(starts), 0
    low, high = sections[:, 0], sections[:, 1]
    at = np.where(ends > starts, starts, np.maximum(starts - 1, 0))
    first = np.searchsorted(low, at, "right") - 1
    inside = (first >= 0) & (at < high[np.maximum(first, 0)])
    last = np.searchsorted(low, np.maximum(ends - 1, at), "right") - 1
    owner = np.where(inside, first, -1)
    crossing = (first != last) | (ends > high[np.maximum(first, 0)]) & inside
    if rule == "most":
        for k in np.flatnonzero(crossing):  # few: the interval join proper, over the sections the token meets
            met = np.arange(max(first[k], 0), last[k] + 1)
            part = np.minimum(high[met], ends[k]) - np.maximum(low[met], starts[k])
            part = np.maximum(part, 0)
            outside = ends[k] - starts[k] - part.sum()
            best = int(np.argmax(part)) if len(met) else 0
            owner[k] = met[best] if len(met) and part[best] >= max(outside, 1) else -1
    np.add.at(counts, owner[owner >= 0], 1)
    return counts, int((owner < 0).sum()), int(crossing.sum())


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_tokens, section_tokens, outside_tokens, crossing_tokens``.

    ``sections_col`` holds an array of structs (start, end) of characters, sorted and not overlapping; without it the sections are the
    lines. Spans are cut to the text. Null texts are empty: no tokens, no lines, zero for every given section; a null array has no sections. Whole texts
    are encoded. Repeated rows are returned as often as they came; other columns are not read.
    """
    picked = docs.select(id_col, F.col(text_col).alias("text"), *([F.transform(F.col(sections_col), lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("sections")] if sections_col else []))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, section_tokens array<long>, outside_tokens long, crossing_tokens long"

    def run(batches):
        tool = encoder(ranks_path, pattern)
        for batch in batches:
            out = []
            for k, text in enumerate(batch["text"]):
                text = text if isinstance(text, str) else ""
                ids, starts, ends = tool.character_spans(text)
                if sections_col:
                    given = batch["sections"].iat[k]
                    sections = np.array([list(s) for s in given], np.int64).reshape(-1, 2).clip(0, len(text)) if given is not None else np.zeros((0, 2), np.int64)
                else:
                    sections = lines(text)
                counts, outside, crossing = attribute(starts, ends, sections, rule)
                out.append((len(ids), counts, outside, crossing))
            frame = pd.DataFrame(out, columns=["n_tokens", "section_tokens", "outside_tokens", "crossing_tokens"])
            frame.insert(0, id_col, batch[id_col].to_numpy())
            yield frame

    return common.small_batches(picked).mapInPandas(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.withColumn("n_sections", F.size("section_tokens").cast("long"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
