"""N-gram Jaccard join over word shingles: size-banded tiles with hashed bitmap signatures, then exact intersections.

1. Every text becomes the sorted array of its shingles' 64-bit hashes. Equal arrays are one class, so copies cost nothing
   further.
2. Shingles are ranked by how common they are, from counts of all documents in 2^22 hash buckets (a fixed size). Two
   sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, rarest first. The classes of
   a rare shingle (at most ``PAIRS_UP_TO``) are paired where sizes, places and bit counts allow the similarity; those of a
   commoner one in an ordinary bucket (a passage that many texts quote) meet in one task with short signatures, and only a forest of what these allow is handed on; those in a
   heavy bucket are only pointed at one of them. So the pairs of a common shingle are never listed. Connected classes are one cluster.
3. Inside a cluster classes are sorted by size and cut into tiles. A tile meets only tiles whose sizes are within the
   similarity. In a pair of tiles the bit counts of signatures (1,024 to 65,536 bits, by size) bound every overlap from above:
   overlap <= (|x| + |y| - bits(x xor y)) / 2. Only pairs that this bound lets pass are intersected exactly.
4. A pair of tiles returns link counts and a forest of its links; components of all forests give the classes.

Any order of the shingles gives the same links, the counts only make it cheap. Clusters above a tile's size are spread
over many tasks by pairs of tiles, so no task holds more than two tiles. Sets are told apart by 128 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import common
from .components import Forest, components

BUCKETS = 1 << 22
SLICE = 1 << 17
#: Width of the signatures, by the size of the set.
BITS, MOST_BITS = 1024, 65536
TILE = 1000
#: Classes of a shingle that are paired at most; beyond it they are pointed at one of them.
PAIRS_UP_TO = 64
#: Up to so many rows of 40 bytes are broadcast to pick out the texts of clustered documents.
MAX_BROADCAST_ROWS = 500_000
PERCENT = 80


def shingle_sets(texts, hashes: common.WordHashes, words: int):
    for text in texts:
        yield common.shingles(common.hashed(common.space_words(text if isinstance(text, str) else None), hashes), words)


def set_ids(items: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two numbers."""
    both = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64)
    return int(both[0]), int(both[1])


WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def narrow(counts: np.ndarray) -> np.ndarray:
    most = counts.max(initial=0)
    return counts.astype(next(t for w, t in WIDTHS.items() if most < 1 << 8 * w or w == 8))


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Documents' shingles by hash bucket, over all documents, as ranks: 0 for ordinary buckets, more for heavier ones."""

    def count(batches):
        hashes, total = common.WordHashes(), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for s in shingle_sets(batch["text"], hashes, words):
                total[(s >> np.uint64(42)).astype(np.int64)] += 1
        parts = narrow(total).reshape(-1, SLICE)
        yield pd.DataFrame({"slice": range(len(parts)), "width": parts.itemsize, "deal": TaskContext.get().partitionId() % 16, "counts": [p.tobytes() for p in parts]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for width, raw in zip(parts["width"], parts["counts"], strict=True):
            total += np.frombuffer(raw, WIDTHS[width])
        total = narrow(total)
        return pd.DataFrame({"slice": parts["slice"][:1], "width": total.itemsize, "deal": 0, "counts": [total.tobytes()]})

    schema = "slice int, width int, deal int, counts binary"
    parts = docs.mapInPandas(count, schema).groupBy("slice", "deal").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    total = np.zeros((BUCKETS // SLICE, SLICE), np.int64)

    for row in parts.collect():  # 4 million counts, whatever the input
        total[row["slice"]] = np.frombuffer(row["counts"], WIDTHS[row["width"]])
    total = total.reshape(-1)
    mean = total.mean()
    usual = mean + 4 * mean**0.5 + 16
    return np.where(total <= usual, 0, 1 + np.log2(np.maximum(total, 1) / usual).clip(0, 60)).astype(np.uint8)


def first_shingles(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles, rarest first; as (rank, 56 bits of the hash)."""
    n = len(s)
    if not n:
        return s.view(np.int64)
    k = n - -(-percent * n // 100) + 1
    order = rank[(s >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
    return np.sort(np.partition(order, k - 1)[:k] if k < n else order).view(np.int64)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, key, n, cls, own, other, first, bits) for every document; cls is null without words, and first empty there and where the task has met the class.

    ``own`` and ``other`` are 128 bits of the set's hash. A class is known by ``own``; where sets agree in it but not in ``other``, by a hash of both.
    """
    rank = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, words))

    def run(batches):
        hashes, seen, none = common.WordHashes(), set(), np.zeros(0, np.int64)
        for batch in batches:
            sets = list(shingle_sets(batch["text"], hashes, words))
            ids = [set_ids(s) if len(s) else (None, None) for s in sets]
            first = []
            for s, k in zip(sets, ids, strict=True):  # once a class and task: copies would only repeat it
                first.append(none if k in seen else first_shingles(s, rank.value, percent))
                seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            bits = [bitmap(s, width(len(s))).tobytes() for s in sets]
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n": [len(s) for s in sets], "own": pd.array([k[0] for k in ids], "Int64"), "other": pd.array([k[1] for k in ids], "Int64"), "first": first, "bits": bits})

    signed = cut(docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, n int, own long, other long, first array<long>, bits binary"))
    return told_apart(signed)


def told_apart(signed: DataFrame) -> DataFrame:
    """With ``cls``: ``own``, or a hash of both numbers where different sets have one ``own``."""
    mixed = signed.where("own is not null").groupBy("own").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high").select("own", F.lit(True).alias("mixed"))
    if mixed.isEmpty():
        return signed.withColumn("cls", F.col("own"))
    return signed.join(mixed, "own", "left").withColumn("cls", F.when(F.col("mixed"), F.xxhash64("own", "other")).otherwise(F.col("own"))).drop("mixed")


def _allowed(n: np.ndarray, m: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def light_edges(tiles: DataFrame, percent: int) -> DataFrame:
    """(cls, lead, place) from the tiles of ordinary buckets' shingles: the pairs that sizes and places allow, or for a shingle of more than ``PAIRS_UP_TO`` classes its classes with their places, ``lead`` being the shingle."""

    def pair(token, place, n, cls):
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])  # tasks that met copies all hand on the class
        token, place, n, cls = token[fresh], place[fresh], n[fresh], cls[fresh]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([start, [len(token)]]))
        within, run = np.repeat(size, size), np.repeat(start, size)
        out = []
        big = within > PAIRS_UP_TO
        out.append(pd.DataFrame({"cls": cls[big], "lead": token[big], "place": pd.array(place[big], "Int32")}))
        few = np.flatnonzero((within > 1) & (within <= PAIRS_UP_TO))
        run, place, n, cls = run[few], place[few], n[few], cls[few]
        for step in range(1, int(within[few].max(initial=1))):
            a = np.flatnonzero(run[step:] == run[:-step])
            b = a + step
            left = np.minimum(n[a] - place[a], n[b] - place[b])  # at most so many can be shared if this is the first shared one
            a, b = (x[_allowed(n[a], n[b], left, percent) & (cls[a] != cls[b])] for x in (a, b))
            out.append(pd.DataFrame({"cls": cls[a], "lead": cls[b], "place": pd.array([None] * len(a), "Int32")}))
        return pd.concat(out, ignore_index=True).drop_duplicates()

    def run(batches):
        names, held, size = ("token", "place", "n", "cls"), [], 0
        for batch in batches:
            held.append([batch[c].to_numpy() for c in names])
            size += len(batch)
            if size >= 100_000:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shingle may go on in the next batch
                if end:
                    yield pair(*(c[:end] for c in columns))
                held = [[c[end:] for c in columns]]
                size -= end
        if size:
            yield pair(*(np.concatenate(c) for c in zip(*held, strict=True)))

    parts = max(8, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = tiles.repartition(parts, "token").sortWithinPartitions("token", "cls")
    return tiles.select("token", "place", "n", "cls").mapInPandas(run, "cls long, lead long, place int")


def common_edges(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(cls, lead): a forest of the pairs that sizes, places and signatures allow among the classes of each shingle (``token``); ``members`` has (cls, token, place), ``bits`` (cls, n, bits).

    A shingle's classes meet in one task: they are fewer than an ordinary bucket's count.
    """

    def shorten(batches):
        for batch in batches:
            short = [folded(np.frombuffer(b, np.uint64).reshape(1, -1), width(n) // 128).tobytes() for n, b in zip(batch["n"], batch["bits"], strict=True)]
            yield batch[["cls", "n"]].assign(bits=short)

    def forest(cls, n, place, maps):
        order = np.argsort(n, kind="stable")
        cls, n, place, wide = cls[order], n[order], place[order], np.array([len(maps[k]) // 8 for k in order])
        sets = {w: np.zeros((len(n), w), np.uint64) for w in np.unique(wide).tolist()}  # at each width those that have at least that many bits
        for w, m in sets.items():
            for v in sets:
                if v >= w:
                    at = np.flatnonzero(wide == v)
                    m[at] = folded(np.frombuffer(b"".join(maps[order[k]] for k in at), np.uint64).reshape(len(at), -1), w)
        ends, label, left = np.searchsorted(n, 100 * n // percent, "right"), np.arange(len(n)), n - place
        for i in range(len(n)):
            j = np.arange(i + 1, ends[i])
            j = j[label[j] != label[i]]
            j = j[_allowed(n[i], n[j], np.minimum(left[i], left[j]), percent)]
            if not len(j):
                continue
            m = sets[int(wide[i])]
            most = (n[i] + n[j] - np.bitwise_count(m[i] ^ m[j]).sum(1, dtype=np.int64)) // 2
            for k in j[_allowed(n[i], n[j], most, percent)].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    yield cls[i], cls[k]

    def run(batches):
        token, group, out = None, [], []
        for batch in batches:
            for row in zip(*(batch[c] for c in ("token", "cls", "n", "place", "bits")), strict=True):
                if row[0] != token:
                    out += forest(*(np.array(c, np.int64) for c in list(zip(*group, strict=True))[:3]), [g[3] for g in group]) if group else []
                    token, group = row[0], []
                group.append(row[1:])
            yield pd.DataFrame(out, columns=["cls", "lead"]).drop_duplicates()
            out = []
        if group:
            out = forest(*(np.array(c, np.int64) for c in list(zip(*group, strict=True))[:3]), [g[3] for g in group])
            yield pd.DataFrame(out, columns=["cls", "lead"])

    parts = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = bits.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "bits").mapInPandas(shorten, "cls long, n int, bits binary")
    met = members.join(asked, "cls").repartition(parts, "token").sortWithinPartitions("token")
    return met.select("token", "cls", "n", "place", "bits").mapInPandas(run, "cls long, lead long")


def heavy_edges(tiles: DataFrame) -> DataFrame:
    """(cls, lead) that connect the classes of each common shingle; a shingle's classes are dealt over several tasks first."""
    salted = tiles.select("cls", "token").withColumn("salt", F.pmod("cls", F.pow(F.lit(2), F.least(_rank(), F.lit(12))).cast("long")).cast("int"))
    lead = F.first("cls").over(Window.partitionBy("token", "salt").orderBy("cls").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = cut(salted.withColumn("lead", lead))
    own = led.where("lead = cls").distinct()
    top = own.groupBy("token").agg(F.min("cls").alias("top"))
    over = own.join(top, "token").where("cls != top").select("cls", F.col("top").alias("lead"))
    return led.where("lead != cls").select("cls", "lead").unionByName(over).distinct()


def _rank():
    return F.shiftrightunsigned("token", 56)


def clusters(signed: DataFrame, percent: int) -> DataFrame:
    """(cls, cluster) such that any two classes that can be linked have one cluster."""
    tiles = signed.select("cls", "n", F.posexplode("first").alias("place", "token"))
    light = cut(light_edges(tiles.where(_rank() == 0), percent).distinct())
    bits = signed.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    other = bits.select(F.col("cls").alias("lead"), F.col("n").alias("m"), F.col("bits").alias("bits2"))
    pairs = light.where("place is null").select(F.greatest("cls", "lead").alias("cls"), F.least("cls", "lead").alias("lead")).distinct()

    def bounded(batches):
        for batch in batches:
            for _, same in batch.groupby([batch["bits"].str.len(), batch["bits2"].str.len()]):
                x, y = (np.frombuffer(b"".join(same[c]), np.uint64).reshape(len(same), -1) for c in ("bits", "bits2"))
                words = min(x.shape[1], y.shape[1])
                n, m = same["n"].to_numpy(np.int64), same["m"].to_numpy(np.int64)
                most = (n + m - np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(1, dtype=np.int64)) // 2
                yield same.loc[_allowed(n, m, most, percent), ["cls", "lead"]]

    close = pairs.join(bits, "cls").join(other, "lead").select("cls", "lead", "n", "m", "bits", "bits2").mapInPandas(bounded, "cls long, lead long")
    common_ = common_edges(light.where("place is not null").select("cls", F.col("lead").alias("token"), "place"), bits, percent)
    edges = close.unionByName(common_).unionByName(heavy_edges(tiles.where(_rank() > 0))).distinct()
    return components(edges, "cls", "lead").select(F.col("node").alias("cls"), F.col("component").alias("cluster"))


def width(n: float) -> int:
    """Bits for sets of about n: a power of two, at least twice n within bounds."""
    return min(MOST_BITS, max(BITS, 1 << int(np.ceil(np.log2(max(2 * n, 1))))))


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """Bit h mod ``bits`` for each hash h, as 64-bit words; the halves of a bitmap joined by or are that of half the width."""
    out = np.zeros(bits, np.uint8)
    out[(items & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int):
    """(i, [j...]) of the linked pairs, i in ``left`` and j in ``right`` (or later in ``left``)."""
    same = right is None
    right = left if same else right
    n_left, n_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    bits = width(float(np.median(n_left)))
    bits_left = np.stack([bitmap(x, bits) for x in left])
    bits_right = bits_left if same else np.stack([bitmap(x, bits) for x in right])
    for i, s in enumerate(left):
        n = n_left[i]
        fit = (100 * np.minimum(n, n_right) >= percent * np.maximum(n, n_right)).nonzero()[0]
        if same:
            fit = fit[fit > i]
        if not len(fit):
            continue
        differ = np.bitwise_count(bits_left[i] ^ bits_right[fit]).sum(1, dtype=np.int64)
        most = (n + n_right[fit] - differ) // 2
        fit = fit[100 * most >= percent * (n + n_right[fit] - most)]
        if not len(fit):
            continue
        joined = np.concatenate([right[j] for j in fit])
        at = np.searchsorted(s, joined)
        at[at == n] = 0
        shared = np.add.reduceat((s[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(n_right[fit])[:-1]]))
        linked = fit[100 * shared >= percent * (n + n_right[fit] - shared)]
        if len(linked):
            yield i, linked


def links(docs: DataFrame, clustered: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """(cls, root, n_links): links met in each pair of tiles, and a forest of them.

    ``clustered`` has (key, cls, own, other, n, copies, cluster): one document of each class. Rows that repeat share a key; a task hands on each key once, so a text that a third of all
    rows repeat, ids included, is as many rows as there are tasks.
    """
    sized = clustered.groupBy("cluster").agg(F.count("*").alias("members"))
    placed = clustered.join(sized, "cluster")
    # Tiles are runs of the sizes' order; a class's place comes from counts by size, so no cluster is sorted in one task.
    big = placed.where(F.col("members") > tile)
    counts = big.groupBy("cluster", "n").agg(F.count("*").alias("here"))
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spot = (F.col("before") + F.pmod(F.xxhash64("cls"), F.col("here"))) / tile
    tiled = cut(big.join(counts, ["cluster", "n"]).withColumn("tile", F.floor(spot).cast("int")).drop("here", "before"))
    edges = tiled.groupBy("cluster", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = edges.select("cluster", F.col("tile").alias("with"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = edges.join(other, "cluster").where(f"with >= tile and 100 * high >= {percent} * low2").select("cluster", "tile", "with")
    both = meet.unionByName(meet.where("with != tile").select("cluster", F.col("with").alias("tile"), F.col("tile").alias("with")).withColumn("swap", F.lit(1)), allowMissingColumns=True)
    dealt = tiled.join(both, ["cluster", "tile"]).select("key", "cls", "own", "other", "copies", "cluster", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "tile")
    small = placed.where(F.col("members") <= tile).select("key", "cls", "own", "other", "copies", "cluster", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("tile"))
    work = cut(small.unionByName(dealt))
    if work.count() <= MAX_BROADCAST_ROWS:  # else both sides are shuffled by key
        work = F.broadcast(work)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["cluster", "a", "b", "tile", "cls", "own", "other", "copies"]
    met = once(docs.join(work, "key").select("key", *names, "text"), "key", "a", "b")
    texts = met.repartition(parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "tile")

    def solve(group: list[tuple]):
        ids, copies, tiles, sets = zip(*group, strict=True)
        order = np.lexsort(([len(s) for s in sets], tiles))
        ids, copies, tiles, sets = ([x[k] for k in order] for x in (ids, copies, tiles, sets))
        n_first = tiles.count(tiles[0])
        forest, found = Forest(len(ids)), np.zeros(len(ids), np.int64)
        copies_ = np.array(copies, np.int64)
        split = n_first < len(ids)
        base = n_first if split else 0
        for i, linked in tile_links(sets[:n_first], sets[n_first:] if split else None, percent):
            linked = linked + base
            found[i] += copies_[linked].sum()
            found[linked] += copies_[i]
            for j in linked:
                forest.join(i, int(j))
        return [(ids[k], ids[forest.find(k)], int(found[k])) for k in range(len(ids)) if found[k]]

    def run(batches):
        hashes, key, group, out = common.WordHashes(), None, {}, []
        for batch in batches:
            for cluster, a, b, tile_, cls, own, other, copies, s in zip(*(batch[c] for c in names), shingle_sets(batch["text"], hashes, words), strict=True):
                if key != (cluster, a, b):
                    if len(group) > 1:
                        out += solve(list(group.values()))
                    key, group = (cluster, a, b), {}
                if set_ids(s) == (own, other):  # keys may agree by chance
                    group[cls] = (cls, copies, tile_, s)
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=["cls", "root", "n_links"])
                    out = []
        if len(group) > 1:
            out += solve(list(group.values()))
        yield pd.DataFrame(out, columns=["cls", "root", "n_links"])

    return texts.select(*names, "text").mapInPandas(run, "cls long, root long, n_links long")


def once(rows: DataFrame, *keys: str, most: int = 500_000) -> DataFrame:
    """``rows`` without those whose keys the task has handed on already; it remembers up to ``most`` of them at a time. Rows of equal keys must be equal."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
                if row not in seen:
                    seen.add(row)
                    fresh.append(k)
            if len(seen) > most:
                seen.clear()
            yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def _parts(id_col: str, text_col: str) -> list:
    """What the hash of a row is taken of: nulls are not empty values."""
    return [F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, n_links``.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their shingles (runs of ``words`` words; the whole
    text where it has fewer). ``component_id`` is the smallest id reachable by links, the document's own included; ``n_links`` the number of
    other documents linked directly. Texts that are null, empty or without words have no shingles and link with nothing. Repeated rows
    count as copies. Null ids count as rows, but are never smallest; ``component_id`` is null where all ids are. Other columns are not read; an empty table gives an empty result.
    """
    docs = common.small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(*_parts(id_col, text_col)).alias("key")))
    signed = signatures(docs, words, percent)
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.first("own").alias("own"), F.first("other").alias("other"), F.first("n").alias("n"), F.count("*").alias("copies"))
    clustered = cut(classes.join(clusters(signed, percent), "cls"))
    met = cut(links(docs, clustered, words, percent, tile))
    joined = components(met, "cls", "root").select(F.col("node").alias("cls"), "component")
    counted = met.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    per_class = classes.select("cls", "id", "copies").join(joined, "cls", "left").join(counted, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = per_class.groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = per_class.join(smallest, "component").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return signed.join(per_class, "cls", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id, null last, by a hash of id and text among equal ids.

    Ids may be null or repeat: rows are told apart by 128 bits of hash of id and text. Rows without words link with nothing, so all of them stay.
    """
    keyed = docs.withColumn("_key", F.concat(*[F.hex(F.xxhash64(F.lit(k), *_parts(id_col, text_col))) for k in (1, 2)]))
    found = jaccard_join(keyed, "_key", text_col).select("_key", F.col("component_id").alias("_component"), (F.col("n_shingles") == 0).alias("_bare")).distinct()
    ids = keyed.groupBy("_key").agg(F.first(F.col(id_col).isNull()).alias("_last"), F.first(id_col).alias("_id"), (F.count("*") > 1).alias("_again"))
    first = found.join(ids, "_key").groupBy("_component").agg(F.min(F.struct("_last", "_id", "_key", "_again")).alias("_s"), F.first("_bare").alias("_bare"))
    kept = keyed.join(cut(first.select("_s._key", (F.col("_s._again") & ~F.col("_bare")).alias("_again"))), "_key")
    return kept.where("not _again").unionByName(kept.where("_again").dropDuplicates(["_key"])).select(*docs.columns)  # only rows that repeat are shuffled whole


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (with recursive r(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from r join e on r.y = e.a) select x, min(y) c from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, coalesce(k, 0)::bigint n_links
from documents left join n using (doc_id) left join r on doc_id = x left join (select a, count(*) k from e group by 1) on doc_id = a"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {"op6_jaccard_join": ORACLE}
