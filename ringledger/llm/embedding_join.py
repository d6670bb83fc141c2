"""Near duplicates of embeddings by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of one another. Vectors are projected on the leading principal
axes of the whole table and sorted, within a label, by their grid cells of width eps. The sorted sequence is cut into blocks of
bounded size, numbered along it. Intervals of blocks are joined recursively: an interval has the box, in the leading dimensions,
of its ``1 << FAN_BITS`` parts, and only parts of two intervals whose boxes are within eps are looked into, down to single blocks.
Inside blocks the halving goes on, so that only close leaves are compared, by cosines in double precision.

Scale: equal vectors of a label are one class, so copies cost nothing. Blocks come from a range partitioning of the sorted order,
so a large label is spread over many tasks. Each level of the recursion is an equi-join of close pairs of intervals with their parts, the
levels grow with the logarithm of the largest label's blocks, and distant intervals are dropped before any of their blocks meet.
A task gets two tiles of ``1 << TILE_BITS`` consecutive blocks, of them the blocks that are close to one of the other tile, each once. It
returns counts of links and a forest of them, never the pairs. The driver gets one second-moment matrix for each of the commonest
vector lengths; the bound is on all of them together. Rows without a usable vector are kept apart from all joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import common
from .components import Forest, components

MIN_COSINE = 0.93
#: Leading axes of the grid.
AXES = 8
BLOCK = 512
LEAF = 64
#: A block has at most this many bytes of vectors too.
BLOCK_BYTES = 8 << 20
#: Parts of an interval of blocks, and blocks of a tile, as powers of two.
FAN_BITS, TILE_BITS = 4, 2
#: Lengths of vectors that get principal axes of their own, the commonest first, while all their matrices have at most MAX_MOMENTS numbers together; others take their first components, with which the join is as exact.
MAX_LENGTHS, MAX_MOMENTS = 64, 2048 * 2048



def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(classes: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """Leading eigenvectors of the second moments of the unit vectors, for each of the commonest lengths of vectors."""
    commonest = classes.groupBy("size").agg(F.count("*").alias("n")).where(F.col("size") <= int(MAX_MOMENTS**0.5)).orderBy(F.desc("n"), "size").limit(MAX_LENGTHS).collect()
    lengths, held = [], 0
    for r in commonest:
        if held + r["size"] ** 2 <= MAX_MOMENTS:
            lengths.append(r["size"])
            held += r["size"] ** 2
    classes = classes.where(F.col("size").isin(lengths))

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, same in batch["embedding"].groupby(batch["size"]):
                x = np.stack(same.to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total[size] = total.get(size, 0) + x.T @ x
        rows = [(size, i, row) for size, m in total.items() for i, row in enumerate(m)]
        yield pd.DataFrame(rows, columns=["size", "i", "row"])

    parts = classes.select("embedding", "size").mapInPandas(moments, "size int, i int, row array<double>")
    summed = parts.select("size", "i", F.posexplode("row").alias("j", "x")).groupBy("size", "i", "j").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in summed.toLocalIterator():
        found.setdefault(r["size"], np.zeros((r["size"], r["size"])))[r["i"], r["j"]] = r["x"]
    return {size: np.linalg.eigh(m)[1][:, ::-1][:, :axes] for size, m in found.items()}


def blocks(classes: DataFrame, axes: dict[int, np.ndarray], k: int, eps: float, block: int) -> DataFrame:
    """Runs of the grid order: label, size, part and pos (the run's task and its place there, which tell it from all others), low and high on each of ``k`` axes, and the packed members."""

    def project(batches):
        for batch in batches:
            spots = np.zeros((len(batch), k))
            for size, at in batch.groupby("size").indices.items():
                x = np.stack(batch["embedding"].to_numpy()[at]).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = x @ axes[size] if size in axes else x[:, :k]
                spots[at, : p.shape[1]] = p
            cells = np.floor(spots / eps).astype(np.int32)
            yield batch.assign(spot=list(spots), **{f"c{i}": cells[:, i] for i in range(k)})

    cells = [f"c{i}" for i in range(k)]
    spotted = classes.mapInPandas(project, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", spot array<double>, " + ", ".join(f"{c} int" for c in cells))
    parts = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(spotted).repartitionByRange(parts, "label", "size", *cells, "cls").sortWithinPartitions("label", "size", *cells, "cls").withColumn("part", F.spark_partition_id())

    def pack(rows: pd.DataFrame, pos: int):
        x, spots = np.stack(rows["embedding"].to_numpy()), np.stack(rows["spot"].to_numpy())
        return {"label": rows["label"].iloc[0], "size": rows["size"].iloc[0], "part": rows["part"].iloc[0], "pos": pos, "low": spots.min(0), "high": spots.max(0), "ids": rows["cls"].to_numpy(np.int64).tobytes(), "copies": rows["copies"].to_numpy(np.int64).tobytes(), "spots": spots.tobytes(), "vectors": x.astype(np.float64).tobytes()}

    def gather(batches):
        rest, pos = None, 0
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            done = []
            for (_, size), same in rest.groupby(["label", "size"], sort=False):
                rows = max(1, min(block, BLOCK_BYTES // (8 * size)))
                whole = len(same) // rows * rows if same.index[-1] == len(rest) - 1 else len(same)
                done += [pack(same.iloc[a : min(a + rows, whole)], pos + i) for i, a in enumerate(range(0, whole, rows))]
                pos += -(-whole // rows)
                left = same.iloc[whole:]
            rest = left.reset_index(drop=True)
            if done:
                yield pd.DataFrame(done)
        if rest is not None and len(rest):
            yield pd.DataFrame([pack(rest, pos)])

    label = classes.schema["label"].dataType.simpleString()
    return cut(ordered.drop(*cells).mapInPandas(gather, f"label {label}, size int, part int, pos long, low array<double>, high array<double>, ids binary, copies binary, spots binary, vectors binary"))


def numbered(packed: DataFrame) -> DataFrame:
    """label, size, seq, part, pos, low, high: the blocks' boxes, numbered from 0 along the grid order of each label and size. Blocks are counted by part first, so no label is one task."""
    boxes = packed.select("label", "size", "part", "pos", "low", "high")
    runs = boxes.groupBy("label", "size", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = F.sum("n").over(Window.partitionBy("label", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    starts = runs.select("label", "size", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    return cut(boxes.join(starts, ["label", "size", "part"]).select("label", "size", (F.col("start") + F.col("pos")).alias("seq"), "part", "pos", "low", "high"))


def intervals(boxes: DataFrame, level: int, k: int) -> DataFrame:
    """label, size, node, parent, low, high of the intervals of ``1 << FAN_BITS * level`` blocks."""
    side = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(k)]).alias(c)
    rows = boxes.withColumn("node", F.shiftright("seq", FAN_BITS * level)).groupBy("label", "size", "node").agg(side(F.min, "low"), side(F.max, "high"))
    return rows.withColumn("parent", F.shiftright("node", FAN_BITS))


def close_blocks(boxes: DataFrame, k: int, eps: float) -> DataFrame:
    """(label, size, a, b), a <= b: numbers of blocks of one label and size whose boxes are within eps, by joining intervals of the sequence recursively."""
    last = boxes.agg(F.max("seq")).first()[0] or 0
    depth = -(-last.bit_length() // FAN_BITS)  # at this level every label is one interval
    top = F.lit(0).cast("long")
    pairs = boxes.where("seq = 0").select("label", "size", top.alias("a"), top.alias("b"))
    gaps = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    for level in reversed(range(depth)):
        parts = intervals(boxes, level, k)
        one = parts.select("label", "size", F.col("parent").alias("a"), F.col("node").alias("x"), "low", "high")
        two = parts.select("label", "size", F.col("parent").alias("b"), F.col("node").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        met = pairs.join(one, ["label", "size", "a"]).join(two, ["label", "size", "b"]).where("x <= y").where(near)
        pairs = cut(met.select("label", "size", F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


def grid_join(spots_a, spots_b, compare, eps: float, same: bool, leaf: int = LEAF) -> None:
    """Calls ``compare(a0, a1, b0, b1)`` for all close leaves of two intervals of the grid order; of an interval with itself once a pair."""

    def visit(a0: int, a1: int, b0: int, b1: int) -> None:
        a, b = spots_a[a0:a1], spots_b[b0:b1]
        gap = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
        if gap @ gap > eps * eps:
            return
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            compare(a0, a1, b0, b1)
            return
        if a1 - a0 >= b1 - b0:
            middle = (a0 + a1) // 2
            if same and (a0, a1) == (b0, b1):
                visit(a0, middle, a0, middle)
                visit(a0, middle, middle, a1)
                visit(middle, a1, middle, a1)
            else:
                visit(a0, middle, b0, b1)
                visit(middle, a1, b0, b1)
        else:
            middle = (b0 + b1) // 2
            visit(a0, a1, b0, middle)
            visit(a0, a1, middle, b1)

    visit(0, len(spots_a), 0, len(spots_b))


def block_links(packed: DataFrame, boxes: DataFrame, pairs: DataFrame, eps: float, min_cosine: float) -> DataFrame:
    """(cls, root, n_links) of every pair of tiles that hold close blocks."""
    tile = lambda c: F.shiftright(c, TILE_BITS)
    tiles = pairs.groupBy("label", "size", tile("a").alias("ta"), tile("b").alias("tb")).agg(F.collect_set("a").alias("a"), F.collect_set("b").alias("b"))  # at most a tile each
    wanted = tiles.select("label", "size", "ta", "tb", F.explode(F.array_union("a", "b")).alias("seq"))
    wanted = wanted.join(boxes.select("label", "size", "seq", "part", "pos"), ["label", "size", "seq"])
    shipped = wanted.join(packed.select("part", "pos", "ids", "copies", "spots", "vectors"), ["part", "pos"])

    def unpack(rows: pd.DataFrame):
        size = int(rows["size"].iloc[0])
        ids, copies = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "copies"))
        x = np.frombuffer(b"".join(rows["vectors"]), np.float64).reshape(len(ids), size)
        return ids, copies, np.frombuffer(b"".join(rows["spots"]), np.float64).reshape(len(ids), -1), x, np.sqrt((x * x).sum(1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        one, two = rows["ta"].iloc[0], rows["tb"].iloc[0]
        same, in_one = one == two, rows["seq"].to_numpy() >> TILE_BITS == one
        ids, copies, spots, x, norm = unpack(rows[in_one])
        ids2, copies2, spots2, y, norm2 = (ids, copies, spots, x, norm) if same else unpack(rows[~in_one])
        both = ids if same else np.concatenate([ids, ids2])
        weight = copies if same else np.concatenate([copies, copies2])
        found, forest, shift = np.zeros(len(both), np.int64), Forest(len(both)), 0 if same else len(ids)

        def compare(a0, a1, b0, b1):
            cosine = (x[a0:a1] @ y[b0:b1].T) / (norm[a0:a1, None] * norm2[None, b0:b1])
            i, j = np.nonzero(cosine >= min_cosine)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            j = j + shift
            np.add.at(found, i, weight[j])
            np.add.at(found, j, weight[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(p, q)

        grid_join(spots, spots2, compare, eps, same)
        linked = np.flatnonzero(found)
        return pd.DataFrame({"cls": both[linked], "root": both[[forest.find(int(k)) for k in linked]] if len(linked) else both[:0], "n_links": found[linked]})

    return cut(shipped.groupBy("label", "size", "ta", "tb").applyInPandas(run, "cls long, root long, n_links long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in double precision, is at
    least ``min_cosine``. Vectors that are null, empty or zero or hold null or non-finite components, and those with a null label, link with nothing
    and are their own component. ``n_links`` counts the other vectors linked directly, copies included; ``component_id`` is
    the smallest id reachable, ``kept`` whether it is the vector's own. Ids must be integers, not null. Repeated rows count as
    copies. Other columns are not read; an empty table gives an empty result.
    """
    eps = float(np.sqrt(2 - 2 * min_cosine)) * (1 + 1e-9)
    spark = vectors.sparkSession
    common.small_batches(vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit("second"), "embedding", "label"))})
    classes = cut(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("size", F.size("embedding")))
    directions = principal_axes(classes, axes)
    packed = blocks(classes.drop("h1", "h2"), directions, axes, eps, block)
    boxes = numbered(packed)
    met = block_links(packed, boxes, close_blocks(boxes, axes, eps), eps, min_cosine)
    joined = components(met, "cls", "root").select(F.col("node").alias("cls"), "component")
    counted = met.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    per_class = classes.select("h1", "h2", "cls", "copies").join(joined, "cls", "left").join(counted, "cls", "left")
    per_class = per_class.select("h1", "h2", F.coalesce("component", "cls").alias("component"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    # A class with very many copies is one skewed key of this join; its other side is one row, so its rows can be split over tasks.
    found = rows.where("ok").select("id", "h1", "h2").join(per_class, ["h1", "h2"]).select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r as (with recursive r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.b from r join l on r.y = l.a) select x, min(y) c from r group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, c component_id, c = vec_id kept
from embeddings left join r on vec_id = x left join (select a, count(*) n from l group by 1) on vec_id = a"""

QUERIES = {"op1_embedding_neardup": op1_embedding_neardup}
ORACLES = {"op1_embedding_neardup": ORACLE}
