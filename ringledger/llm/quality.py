"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score f(x) = w.x is shared by all grades; ordered thresholds turn it into P(grade <= k) = sigmoid(theta_k - f(x)). The
expected grade and the tail probability P(grade >= k) follow, and selection uses the tail. x holds hashed text: which
words and word starts occur (lower-cased, bare of punctuation), and the square roots of the shares that token
shapes (``Aa``, ``A!``, ``a$``, ``|``, ...) and immediate repetitions have among the tokens.

The model is fitted in numpy on at most ``MAX_PER_GRADE`` rated rows a grade, chosen by a hash of the id; all documents are
scored. Scale: the sampled ids (bounded) and the weights (fixed size) are broadcast; documents stream, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 20
#: Bound of the fitting sample.
MAX_PER_GRADE = 4000
#: A document is selected when the probability of the highest grade is at least this.
MIN_TAIL = 0.7
GRADES = 3
MIN_ROWS_PER_FEATURE = 20
#: Weight of the absolute weights in the loss.
LASSO = 2e-3
RIDGE = 1e-5

_LETTERS = re.compile(r"[^\W\d_]+")
_SQUEEZE = re.compile(r"(.)\1+")
REPEATED = DIMENSIONS - 1
PREFIX = 4


def _slot(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + text) % (DIMENSIONS - 1)


def shape(token: str) -> str:
    """Letters as A or a, digits as 0, runs squeezed; of the whole token."""
    return _SQUEEZE.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token))


class TokenSlots(dict):
    """Slots of a token's word, word start and shape, in one integer; memory is bounded."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if token.isalpha():
            bare, form = token.lower(), "a" if token.islower() else "Aa" if token.istitle() and len(token) > 1 else shape(token)
        else:
            bare, form = "".join(_LETTERS.findall(token)).lower(), shape(token)
        word, start = (_slot("w", bare), _slot("p", bare[:PREFIX])) if bare else (DIMENSIONS, self.shape_slot(form))
        self[token] = value = word << 40 | start << 20 | self.shape_slot(form)
        return value

    def shape_slot(self, form: str) -> int:
        if len(self.shapes) > 100_000:
            self.shapes.clear()
        if form not in self.shapes:
            self.shapes[form] = _slot("s", form)
        return self.shapes[form]


def features(text: str | None, slots: TokenSlots) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and their values; none for texts without tokens."""
    tokens = text.split() if isinstance(text, str) else []
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens))
    words = np.unique(np.concatenate([both >> 40, both >> 20 & (DIMENSIONS - 1)]))
    words = words[words < DIMENSIONS]
    shapes, counts = np.unique(both & (DIMENSIONS - 1), return_counts=True)
    shares = np.sqrt(counts / len(tokens))
    again = (both[1:] == both[:-1]).sum() / len(tokens)
    return np.concatenate([words, shapes, [REPEATED]]).astype(np.int32), np.concatenate([np.ones(len(words)), 4 * shares, [4 * again**0.5]]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[slots] @ values)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score."""
        return _sigmoid(np.asarray(scores, np.float64)[:, None] - self.thresholds)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weights: np.ndarray, steps: int = 400, rate: float = 0.4, lasso: float = LASSO) -> Model:
    """Adam with soft thresholds on the weighted negative log likelihood: words that do not tell get weight 0, so a very long text
    does not gather noise. Gaps between the ordered thresholds stay positive by exp()."""
    if not len(rows):
        return Model(np.zeros(DIMENSIONS, np.float32), np.linspace(-1, 1, GRADES - 1))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    seen = np.bincount(slot, minlength=DIMENSIONS) >= max(1, min(MIN_ROWS_PER_FEATURE, len(rows) // 20))
    keep = seen[slot]
    owner, slot, value = owner[keep], slot[keep], value[keep]
    used = np.flatnonzero(seen & (np.bincount(slot, minlength=DIMENSIONS) > 0))
    slot = np.searchsorted(used, slot)
    share = np.array([weights[grades >= k].sum() for k in range(1, GRADES)]) / weights.sum()
    start = -np.log((share.clip(1e-3, 1 - 1e-3)) / (1 - share.clip(1e-3, 1 - 1e-3)))
    n = len(used)
    p = np.concatenate([np.zeros(n), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weights = weights / weights.sum()
    index, free = np.arange(len(rows)), None
    for step in range(1, steps + 1):
        if step == steps // 2 + 1:  # the second half fits the chosen slots without the penalty, which would keep them small
            free = p[:n] != 0
            kept = free[slot]
            owner, slot, value = owner[kept], slot[kept], value[kept]
        f = np.bincount(owner, p[slot] * value, len(rows))
        theta = np.cumsum(np.concatenate([p[n : n + 1], np.exp(p[n + 1 :])]))
        tail = np.concatenate([np.ones((len(rows), 1)), _sigmoid(f[:, None] - theta), np.zeros((len(rows), 1))], axis=1)
        prob = (tail[index, grades] - tail[index, grades + 1]).clip(1e-9)
        slope = tail * (1 - tail)
        up, down = slope[index, grades] / prob * weights, slope[index, grades + 1] / prob * weights
        g = np.zeros_like(p)
        g[:n] = -np.bincount(slot, (up - down)[owner] * value, n) + RIDGE * p[:n]
        by_theta = np.array([(up[grades == k].sum() - down[grades == k - 1].sum()) for k in range(1, GRADES)])
        g[n] = by_theta.sum()
        for k in range(1, GRADES - 1):
            g[n + k] = by_theta[k:].sum() * np.exp(p[n + k])
        m, v = 0.9 * m + 0.1 * g, np.maximum(0.99 * v, g * g)
        size = rate / (np.sqrt(v) + 1e-6) / (1 + 5 * step / steps)
        p = p - size * m / (1 - 0.9**step)
        if step <= steps // 2:
            p[:n] = np.sign(p[:n]) * np.maximum(np.abs(p[:n]) - (size * lasso)[:n], 0)
        else:
            p[:n] *= free
    full = np.zeros(DIMENSIONS, np.float32)
    full[used] = p[:n]
    return Model(full, np.cumsum(np.concatenate([p[n : n + 1], np.exp(p[n + 1 :])])))


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: low quality, 1: toxic, 2: good.

    The order is that of use for training: junk teaches nothing, toxic texts are at least texts, good ones are both. Toxic texts that are also junk are junk.
    """
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_per_grade: int = MAX_PER_GRADE) -> Model:
    """``rated`` has (id, grade); rows with a null id, without grade or with one that is none of 0, 1, ``GRADES - 1`` are not used. Of several grades of an id the lowest counts."""
    rated = rated.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, GRADES - 1)).groupBy("id").agg(F.min("grade").alias("grade"))
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for g, n in counts.items():
        wanted = wanted | ((F.col("grade") == g) & (draw < int(1_000_000 * min(1.0, max_per_grade / n))))
    chosen = F.broadcast(rated.where(wanted))  # about max_per_grade ids a grade, whatever the number of ratings
    sample = common.small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).join(chosen, "id")

    def run(batches):
        slots = TokenSlots()
        for batch in batches:
            found = [features(t, slots) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "grade": batch["grade"], "slots": [f[0].tobytes() for f in found], "values": [f[1].tobytes() for f in found]})

    rows = sample.mapInPandas(run, "id string, grade int, slots binary, values binary").toPandas().sort_values(["id", "slots"])
    grades = rows["grade"].to_numpy(np.int64)
    drawn = np.bincount(grades, minlength=GRADES)
    weights = np.array([counts[g] / drawn[g] for g in grades], np.float64)
    return fit([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(rows["slots"], rows["values"], strict=True)], grades, weights)


NAMES = ("expected_grade", "p_top", "selected")


def rate_documents(docs: DataFrame, model: Model, text_col: str = "text", min_tail: float = MIN_TAIL, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the expected grade, the probability of the highest grade and whether it is at least ``min_tail``, under ``names``; columns of these names are replaced.

    Null, empty and blank texts have no features and are rated by the thresholds alone; whole texts count, whatever their length.
    Equal texts get equal ratings. An empty table gives an empty result.
    """
    handle = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    docs = common.small_batches(docs.drop(*names))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {t}" for n, t in zip(names, ("double", "double", "boolean"), strict=True)])

    def run(batches):
        slots, model = TokenSlots(), Model(*handle.value)
        for batch in batches:
            scores = np.array([model.score(*features(t, slots)) for t in batch[text_col]], np.float64)
            tails = model.tails(scores)
            yield batch.assign(**dict(zip(names, (tails.sum(1), tails[:, -1], tails[:, -1] >= min_tail), strict=True)))

    return docs.mapInPandas(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.withColumn("grade", grade()))
    return rate_documents(docs.select("doc_id", "text"), model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_top", 6).alias("p_top"), "selected")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
