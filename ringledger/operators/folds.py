"""Order-dependent rating folds over a contest log.

Each contest reads and writes the states of two contestants, so neither windows nor single-key state express the fold. Everything that a contest
alone decides (K factors, target offsets) is computed before, in columns. The rest runs in waves: a contest's level is one more than the last levels of
its two contestants, so the contests of a level touch different contestants, and a level is one update of numpy arrays of states.

Contestants who never meet, not even through others, do not matter to one another: the log is labelled with the connected components of who met whom and dealt by (system,
component). Where a component has more contests than one task may have, the log is cut into slices of its order, each short enough that
no component *inside* it is larger, and the slices follow one another; states pass on as a table by contestant.

What does not need the states is not done by the one task that must go through a component in order. Other tasks sort the contests by ranges of the order, find the waves of up to ``CHUNK`` contests and hand these on as one value, a pack
in Arrow's format, with the columns that a system reads. The task holds the states of its contestants and a pack, and gives packs that other tasks open in turn.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import cut, ensure_checkpoint_dir, stored
from . import analytics
from .graph import components

# Fixed values of the systems.
GLICKO = {"scale": 173.7178, "rating": 1500.0, "rd": 350.0, "volatility": 0.06, "tau": 0.5, "epsilon": 1e-6, "period": 30.0, "growth": 0.06}
FACTOR = {"variance": (1.0, 1.2, 1.2, 1.0), "noise": (0.0007, 0.0010, 0.0010, 0.0008), "floor": 0.02, "margin": 0.65, "promotion": 0.20, "damage": 0.35, "latent": 0.30, "finish": 0.05, "rating": 1500.0, "scale": 400.0}
STRIKING = ("kickboxing", "boxing", "muay", "lethwei", "boxing_cage")
GRAPPLING = ("grappling", "wrestling", "judo", "sambo", "combat_jj")
FACTOR_WEIGHTS = {"mma": (1.0, 0.35, 0.35, 0.20), "striking": (0.0, 1.0, 0.0, 0.20), "grappling": (0.0, 0.0, 1.0, 0.20), "other": (0.25, 0.50, 0.25, 0.20)}
UNIFIED = {
    "rating": 1500.0, "scale": 400.0, "rd": 300.0, "volatility": 0.06, "growth": 0.05, "rd_bounds": (30.0, 350.0), "k0": 28.0, "tier": {"A": 1.0, "B": 0.85, "C": 0.70}, "title": 1.10, "finish": 1.08, "margin": (0.45, 0.40),
    "experience": ((5, 1.20), (12, 1.0), 0.90), "active": 1.05, "layoff": 0.88, "layoff_days": 540, "promotion": (0.85, 0.30, 0.75, 1.12), "upset": (0.30, 0.40), "quality": 0.15, "consistency": 0.10,
    "variance": (1.0, 1.2, 1.2, 1.0, 1.1), "noise": (0.0007, 0.0010, 0.0010, 0.0008, 0.0009), "composite": (0.55, 0.45), "floor": 0.35, "decay": 0.02, "blend": (0.45, 0.40, 0.15), "form": (0.04, 0.12),
    "weights": {"mma": (1.0, 0.30, 0.30, 0.20, 0.20), "striking": (0.0, 1.0, 0.0, 0.20, 0.15), "grappling": (0.0, 0.0, 1.0, 0.15, 0.20), "other": (0.25, 0.45, 0.20, 0.20, 0.15)},
}

OUTCOMES = {"L": -1, "D": 0, "W": 1}
FAMILIES = tuple(FACTOR_WEIGHTS)
TIERS = tuple(UNIFIED["tier"])
#: Contests that a task holds at once; contests that a task may have in all before the log is cut into slices.
CHUNK, MAX_TASK_CONTESTS = 1 << 16, 4_000_000
#: Bytes of contests in a pack before its columns are chosen, beyond which the next begins; rows of a pack that a fold gives.
BYTES, PACK = 1 << 26, 1 << 13
#: Packs of a file, so that files are small beside what a task reads.
PACKS_A_FILE = 64
#: Contests of a task that opens packs, and of a bin of small components.
OPENED, BIN = 1 << 18, 1 << 21
FIRST_DAY = "1900-01-01"

COLUMNS = ["contest_id", "day", "a", "b", "outcome", "sport", "method", "rounds", "title", "finish_round", "finish_seconds", "promotion", "tier", "margin"]
DELTA = "system string, contest_id long, contestant long, opponent long, day date, seq long, pre_rating double, post_rating double, expected double, target double, k double, rd double, fights long, expected_after double, latent double, streak int, peak double, finish_rate double"
STATE = "system string, contestant long, state array<double>"
NAMES = [c.split()[0] for c in DELTA.split(", ")]


def clip(v: np.ndarray, low, high) -> np.ndarray:
    """The lower bound wins where the bounds cross."""
    return np.where(v < low, low, np.where(v > high, high, v))


def sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, small) / (1 + small)


def anchored(won: np.ndarray, base: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The target of a decided contest: ``base`` (outcome, margin, finish; a column) moved beyond the expectation on the winner's side."""
    near = kernels.TARGET["epsilon"]
    return np.where(won, clip(base, np.maximum(0.5, expected + near), 1.0), clip(base, 0.0, np.minimum(0.5, expected - near)))


def idle_days(states: dict, at: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Days since the last contest, 0 for newcomers."""
    return np.fmax(0, day - states["last"][at])


def career(states: dict, at: np.ndarray, day: np.ndarray, rules: dict) -> np.ndarray:
    """The factor of K for experience and for a long absence."""
    (few, early), (some, middle), late = rules["experience"]
    fights, away = states["fights"][at], day - states["last"][at] > rules["layoff_days"]  # false for newcomers
    return np.where(fights < few, early, np.where(fights < some, middle, late)) * np.where(away, rules["layoff"], rules["active"])


def played(states: dict, at: np.ndarray, day: np.ndarray) -> None:
    states["fights"][at] += 1
    states["last"][at] = day


def elo_expected(s: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sigmoid((s["rating"][i] - s["rating"][j]) / 400)


def elo_wave(s: dict, i: np.ndarray, j: np.ndarray, c: SimpleNamespace, compat: bool) -> tuple:
    """(ratings before, expected, target, K of both) of contests of which no two share a contestant; moves the states. So do the other waves."""
    pre = s["rating"][i], s["rating"][j]
    e = elo_expected(s, i, j)
    live = c.mma & c.decided
    t = np.where(live, anchored(c.won, c.base, e), np.where(c.draw, 0.5, e))
    ks = tuple(np.where(live, c.k * career(s, at, c.day, kernels.ELO), 0.0) for at in (i, j))
    s["rating"][i] = pre[0] + ks[0] * (t - e)
    s["rating"][j] = pre[1] + ks[1] * (e - t)
    for at in (i, j):
        played(s, at[live], c.day[live])
    return pre, e, t, ks


def volatility(phi, sigma, gain, variance, tau: float = GLICKO["tau"]) -> np.ndarray:
    """The volatility at which the published condition on x = ln(sigma^2) holds, to machine precision, for arrays.

    ``gain`` is the improvement that the result suggests and ``variance`` that of the performance. The condition falls in x around its root,
    and Newton's rule finds it in a few steps from the old value. After extreme surprises brackets are widened by steps of tau below the old value and closed by Ridders' rule,
    until its points stand still: one end of a bracket may stay where it is.
    """
    phi, sigma, gain, variance = np.broadcast_arrays(*(np.asarray(v, float) for v in (phi, sigma, gain, variance)))
    start, fixed = 2 * np.log(sigma), phi * phi + variance
    apart = gain * gain - fixed
    x, steep = start, 1 / (tau * tau)
    plain = apart < 80 * fixed  # there the condition falls everywhere and has one root
    for _ in range(8):
        ex = np.exp(x)
        both = fixed + ex
        square = 2 * both * both
        slope = ex * (fixed * (apart - 2 * ex) - apart * ex) / (square * both) - steep
        step = np.where(plain, (ex * (apart - ex) / square - (x - start) * steep) / slope, 0.0)
        x = x - step
        if (np.abs(step) < 1e-9).all():  # the next step would be of the order of its square
            break
    hard = ~(plain & (np.abs(step) < 1e-9))
    if hard.any():
        x = np.where(hard, 0.0, x)
        x[hard] = bracketed(start[hard], fixed[hard], apart[hard], tau)
    return np.exp(x / 2)[()]


def bracketed(start: np.ndarray, fixed: np.ndarray, apart: np.ndarray, tau: float) -> np.ndarray:
    """The x of ``volatility`` by brackets and Ridders' rule."""

    def slack(x: np.ndarray) -> np.ndarray:
        ex = np.exp(x)
        return ex * (apart - ex) / (2 * (fixed + ex) ** 2) - (x - start) / (tau * tau)

    far = np.where(apart > 0, np.log(np.maximum(apart, 1e-300)), start)
    low, high = np.minimum(start, far), np.maximum(start, far)
    at_low = slack(low)
    while (open_ := at_low < 0).any():
        low = np.where(open_, low - tau, low)
        at_low = slack(low)
    at_high, last = slack(high), np.inf
    for _ in range(60):
        middle = (low + high) / 2
        at_middle = slack(middle)
        root = np.sqrt(np.maximum(at_middle * at_middle - at_low * at_high, 1e-300))
        x = np.minimum(np.maximum(middle + (middle - low) * at_middle / root, low), high)
        at_x = slack(x)
        near, near_value, past, past_value = *(np.where(middle < x, u, v) for u, v in ((middle, x), (at_middle, at_x))), *(np.where(middle < x, v, u) for u, v in ((middle, x), (at_middle, at_x)))
        low, at_low = np.where(past_value >= 0, past, np.where(near_value >= 0, near, low)), np.where(past_value >= 0, past_value, np.where(near_value >= 0, near_value, at_low))
        high, at_high = np.where(near_value <= 0, near, np.where(past_value <= 0, past, high)), np.where(near_value <= 0, near_value, np.where(past_value <= 0, past_value, at_high))
        if (np.minimum(high - low, np.abs(x - last)) < 2e-14).all():
            break
        last = x
    return x


def dampening(phi: np.ndarray) -> np.ndarray:
    """How much a result says against an opponent of that deviation."""
    return 1 / np.sqrt(1 + 3 * (phi / math.pi) ** 2)


def after_contest(gap, phi, sigma, other_phi, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviation, volatility, surprise) after one contest; ``gap`` is the rating less the opponent's, all in units of the scale."""
    g = dampening(other_phi)
    e = sigmoid(g * gap)
    information, surprise = np.maximum(1e-9, g * g * e * (1 - e)), g * (score - e)
    new_sigma = volatility(phi, sigma, surprise / information, 1 / information)
    return (1 / (phi * phi + new_sigma * new_sigma) + information) ** -0.5, new_sigma, surprise


def grown(rd: np.ndarray, days: np.ndarray, growth: float) -> np.ndarray:
    scale = GLICKO["scale"]
    return np.where(days > 0, scale * np.sqrt((rd / scale) ** 2 + days / GLICKO["period"] * growth**2), rd)


def glicko_expected(s: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The opponent's deviation alone counts, so the two sides' expectations do not add up to one."""
    return sigmoid(dampening(s["rd"][j] / GLICKO["scale"]) * (s["rating"][i] - s["rating"][j]) / GLICKO["scale"])


def glicko_wave(s: dict, i: np.ndarray, j: np.ndarray, c: SimpleNamespace, compat: bool) -> tuple:
    for at in (i, j):
        s["rd"][at] = grown(s["rd"][at], idle_days(s, at, c.day), GLICKO["growth"])
    scale, e, pre = GLICKO["scale"], glicko_expected(s, i, j), (s["rating"][i], s["rating"][j])
    for at in (i, j):
        played(s, at, c.day)
    live = c.mma & c.decided
    t = np.where(live, anchored(c.won, c.base, e), np.where(c.draw, 0.5, e))
    n, me, other = int(live.sum()), np.concatenate([i[live], j[live]]), np.concatenate([j[live], i[live]])
    score = np.concatenate([t[live], 1 - t[live]])
    if n:
        phi, sigma, surprise = after_contest((s["rating"][me] - s["rating"][other]) / scale, s["rd"][me] / scale, s["volatility"][me], s["rd"][other] / scale, score)
        s["rating"][me] += scale * phi * phi * surprise
        s["rd"][me], s["volatility"][me] = scale * phi, sigma
    return pre, e, t, (np.zeros(len(i)),) * 2


def settled(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What the columns of contests come to without states: by how much margin, promotion and finish shift a latent gap (a zero promotion counts as unknown) and stretch it, and the unified system's fixed part of K."""
    made = {}
    if "margin" in f:
        margin, finish = np.nan_to_num(f["margin"]), f["finish"] * FACTOR["finish"]
        promotion = np.where(np.isnan(f["promotion"]) | (f["promotion"] == 0), 0.5, f["promotion"]) - 0.5
        made |= {"shift": FACTOR["margin"] * margin + FACTOR["promotion"] * promotion + finish * FACTOR["damage"] * np.abs(margin), "stretch": 1 + finish * FACTOR["latent"]}
    if "tier" in f:
        u, (slope, most), (low, rise, least, top) = UNIFIED, UNIFIED["margin"], UNIFIED["promotion"]
        k = u["k0"] * np.array([u["tier"][t] for t in TIERS])[f["tier"]] * np.where(f["major"], u["title"], 1.0) * np.where(f["finish"], u["finish"], 1.0)
        k = k * (1 + np.minimum(slope * np.abs(np.nan_to_num(f["margin"])), most))
        made["fixed"] = k * np.where(np.isnan(f["promotion"]), 1.0, clip(low + rise * clip(f["promotion"], 0.0, 1.0), least, top))
    return made


def shifted_gap(w: np.ndarray, x: np.ndarray, y: np.ndarray, c: SimpleNamespace) -> np.ndarray:
    """Latent gap and what margin, promotion and finish add."""
    return (w * (x - y)).sum(1) * c.stretch + c.shift


def kalman(s: dict, i: np.ndarray, j: np.ndarray, w: np.ndarray, e: np.ndarray, t: np.ndarray) -> None:
    """Joint update of two independent states by one observation; what they come to share is dropped again. Covariances stay symmetric."""
    slope, n, both = e * (1 - e), len(i), np.concatenate([i, j])
    h = slope[:, None] * w
    cov = s["cov"][both]
    p = np.einsum("nij,nj->ni", cov, np.concatenate([h, -h]))
    d = (h * (p[:n] - p[n:])).sum(1) + np.maximum(FACTOR["floor"], slope)
    d, gap = np.concatenate([d, d]), np.concatenate([t - e, t - e])
    s["cov"][both] = cov - p[:, :, None] * p[:, None, :] / d[:, None, None]
    s["mean"][both] += p * (gap / d)[:, None]


FACTOR_MATRIX = np.array([FACTOR_WEIGHTS[f] for f in FAMILIES])
UNIFIED_MATRIX = np.array([UNIFIED["weights"][f] for f in FAMILIES])


def noisier(s: dict, at: np.ndarray, days: np.ndarray, noise: tuple) -> None:
    m = len(noise)
    s["cov"].reshape(len(s["cov"]), m * m)[at[:, None], np.arange(m) * (m + 1)] += days[:, None] * np.array(noise)


def factor_rating(s: dict, at: np.ndarray) -> np.ndarray:
    return FACTOR["rating"] + FACTOR["scale"] * s["mean"][at, 0]


def factor_wave(s: dict, i: np.ndarray, j: np.ndarray, c: SimpleNamespace, compat: bool) -> tuple:
    for at in (i, j):
        noisier(s, at, idle_days(s, at, c.day), FACTOR["noise"])
    w = FACTOR_MATRIX[c.family]
    e = sigmoid(shifted_gap(w, s["mean"][i], s["mean"][j], c))
    pre = factor_rating(s, i), factor_rating(s, j)
    t = np.where(c.decided, np.where(c.mma, anchored(c.won, c.base, e), c.won), np.where(c.draw, 0.5, e))
    kalman(s, i[c.decided], j[c.decided], w[c.decided], e[c.decided], t[c.decided])
    for at in (i, j):
        s["fights"][at] += c.mma
        s["last"][at] = c.day
    return pre, e, t, (np.zeros(len(i)),) * 2


def blend(s: dict, at: np.ndarray) -> np.ndarray:
    own, skill = UNIFIED["composite"]
    return own * s["base"][at] + skill * (UNIFIED["rating"] + UNIFIED["scale"] * s["mean"][at, 0])


def unified_rating(s: dict, at: np.ndarray) -> np.ndarray:
    """The composite, held up by the remembered peak."""
    start, peak, now = UNIFIED["rating"], s["peak"][at], blend(s, at)
    return np.where(peak > start, np.maximum(now, start + UNIFIED["floor"] * (peak - start)), now)


def unified_k(s: dict, me: np.ndarray, other: np.ndarray, day: np.ndarray, fixed: np.ndarray, e: np.ndarray, won: np.ndarray) -> np.ndarray:
    """K of the contestants ``me``; ``fixed`` is what the contest alone says, ``e`` their expectation and ``won`` the outcome by which an upset is judged."""
    u = UNIFIED
    k = fixed * career(s, me, day, u)
    k = k * (1 + clip(2 * u["upset"][0] * np.where(won, 0.5 - e, e - 0.5), 0.0, u["upset"][1]))
    k = k * (1 + clip(u["quality"] * (s["base"][other] - u["rating"]) / u["scale"], -0.15, 0.25))
    past = s["past"][me]
    known = ~np.isnan(past)
    n = known.sum(1)
    if n.max(initial=0) >= 3:
        count = np.maximum(n, 1)
        mean = np.where(known, past, 0.0).sum(1) / count
        apart = np.where(known, past - mean[:, None], 0.0)
        k = k * np.where(n >= 3, 1 + u["consistency"] * np.maximum(0.0, 1 - 5 * np.sqrt((apart * apart).sum(1) / count)), 1.0)
    return k * clip(s["rd"][me] / u["rd"], 0.5, 2.0)


def unified_wave(s: dict, i: np.ndarray, j: np.ndarray, c: SimpleNamespace, compat: bool) -> tuple:
    """Other sports move the skills only.

    With ``compat`` what counts as won follows a's outcome and the side's own target, so a's loss counts as a win for a's streak, finishes and remembered
    scores; without it each side's own outcome and score count.
    """
    u, scale, size, twice = UNIFIED, GLICKO["scale"], len(i), lambda v: np.concatenate([v, v])
    both, against, day = np.concatenate([i, j]), np.concatenate([j, i]), twice(c.day)
    days, rd = idle_days(s, both, day), s["rd"][both]
    s["rd"][both] = np.where(days > 0, clip(grown(rd, days, u["growth"]), *u["rd_bounds"]), rd)
    noisier(s, both, days, u["noise"])
    w, (by_rating, by_skill, by_form), (each, most) = UNIFIED_MATRIX[c.family], u["blend"], u["form"]
    form = clip(0.5 + clip(each * (s["streak"][i] - s["streak"][j]), -most, most), 0.0, 1.0)
    e = by_rating * sigmoid((s["base"][i] - s["base"][j]) / u["scale"]) + by_skill * sigmoid(shifted_gap(w, s["mean"][i], s["mean"][j], c)) + by_form * form
    e = clip(e / (by_rating + by_skill + by_form), 1e-6, 1 - 1e-6)
    pre = unified_rating(s, both).reshape(2, size)
    live, skills = c.mma & c.decided, c.decided | (c.draw & ~c.mma)
    t = np.where(live, anchored(c.won, c.base, e), np.where(c.draw, 0.5, np.where(c.decided, c.won, e)))
    lost_it = c.decided & ~c.won
    upset = twice(c.won) if compat else np.concatenate([c.won, lost_it])  # with compat by a's outcome for both
    on = twice(live)
    ks = np.where(on, unified_k(s, both, against, day, twice(c.fixed), np.concatenate([e, 1 - e]), upset), 0.0)
    me, other = both[on], against[on]
    if len(me):
        score, gap = np.concatenate([t, 1 - t])[on], s["base"][me] - s["base"][other]
        phi, sigma, _ = after_contest(gap / scale, s["rd"][me] / scale, s["volatility"][me], s["rd"][other] / scale, score)
        base = s["base"][me] + ks[on] * (score - sigmoid(gap / u["scale"]))
    kalman(s, i[skills], j[skills], w[skills], e[skills], t[skills])
    if len(me):
        s["base"][me], s["rd"][me], s["volatility"][me] = base, clip(scale * phi, *u["rd_bounds"]), sigma
        first = np.arange(len(me)) < len(me) // 2
        won_it, lost_it = twice(c.won)[on], twice(lost_it)[on]
        ahead = score > 0.5
        won = np.where(ahead, won_it, lost_it) & (score != 0.5) if compat else np.where(first, won_it, lost_it)
        lost = ~won & (score != 0.5) if compat else np.where(first, lost_it, won_it)
        streak = s["streak"][me]
        s["streak"][me] = np.where(won, np.maximum(1, streak + 1), np.where(lost, np.minimum(-1, streak - 1), 0))
        s["finishes"][me] += won & twice(c.finish)[on]
        margin = twice(c.margin)[on]
        known, shown = ~np.isnan(margin), (1 + margin) / 2
        past = s["past"][me]
        newest = np.where(ahead if compat else first, shown, 1 - shown)
        s["past"][me] = np.where(known[:, None], np.concatenate([past[:, 1:], newest[:, None]], 1), past)
        peak = s["peak"][me]
        s["peak"][me] = np.maximum(np.where(lost, peak - u["decay"] * (peak - u["rating"]), peak), blend(s, me))
        played(s, me, day[on])
    return pre, e, t, ks.reshape(2, size)


@dataclass(frozen=True)
class System:
    """``start``: a newcomer's state by field. ``reads``: what a wave needs of contests (``FIELDS``). ``rating`` reads the state, ``after`` is the expectation of updated states, ``facts`` further columns of one side."""

    start: dict
    wave: Callable
    reads: tuple[str, ...]
    rating: Callable = lambda s, at: s["rating"][at]
    after: Callable | None = None
    rd: Callable = lambda s, at: s["rd"][at]
    facts: Callable = lambda s, at: {}


NEW = {"fights": 0.0, "last": math.nan}
SYSTEMS: dict[str, System] = {
    "elo": System(NEW | {"rating": 1500.0}, elo_wave, ("outcome", "mma", "base", "k"), after=elo_expected, rd=lambda s, at: np.full(len(at), np.nan)),
    "glicko": System(NEW | {k: GLICKO[k] for k in ("rating", "rd", "volatility")}, glicko_wave, ("outcome", "mma", "base"), after=glicko_expected),
    "factor": System(
        NEW | {"mean": np.zeros(4), "cov": np.diag(FACTOR["variance"])}, factor_wave, ("outcome", "mma", "family", "finish", "margin", "promotion", "base"), factor_rating, rd=lambda s, at: FACTOR["scale"] * np.sqrt(np.maximum(0.0, s["cov"][at, 0, 0])),
        facts=lambda s, at: {"latent": s["mean"][at] @ np.array(FACTOR_WEIGHTS["mma"])}),
    "unified": System(
        NEW | {"base": UNIFIED["rating"], "rd": UNIFIED["rd"], "volatility": UNIFIED["volatility"], "mean": np.zeros(5), "cov": np.diag(UNIFIED["variance"]), "streak": 0.0, "finishes": 0.0, "past": np.full(10, np.nan), "peak": UNIFIED["rating"]},
        unified_wave, ("outcome", "mma", "family", "finish", "major", "tier", "margin", "promotion", "base"), unified_rating, facts=lambda s, at: {"streak": s["streak"][at], "peak": s["peak"][at], "finish_rate": s["finishes"][at] / np.maximum(s["fights"][at], 1)}),
}


class States:
    """The states of a task's contestants, a row each in the arrays of all fields."""

    def __init__(self, start: dict) -> None:
        self.start = {k: np.asarray(v, float) for k, v in start.items()}
        self.row: dict[int, int] = {}
        self.data = {k: np.empty((0, *v.shape)) for k, v in self.start.items()}

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of the contestants; newcomers get one."""
        row = self.row
        found = np.array([row.setdefault(n, len(row)) for n in ids.tolist()], int)
        have = len(self.data["fights"])
        if len(row) > have:
            more = max(len(row), 2 * have) - have
            self.data = {k: np.concatenate([v, np.repeat(self.start[k][None], more, 0)]) for k, v in self.data.items()}
        return found

    def put(self, ids: np.ndarray, packed: np.ndarray) -> None:
        at, start = self.rows(ids), 0
        for k, v in self.start.items():
            self.data[k][at] = packed[:, start : start + v.size].reshape(len(at), *v.shape)
            start += v.size

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.row)
        return np.fromiter(self.row, np.int64, n), np.concatenate([self.data[k][:n].reshape(n, -1) for k in self.start], 1)


def levels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """One more than the last levels of both contestants, numbers below ``n``, for contests in order."""
    last, out = [0] * n, []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        level = (last[i] if last[i] > last[j] else last[j]) + 1
        last[i] = last[j] = level
        out.append(level)
    return np.array(out, int)


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different contestants, and the places of both sides among them."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return names, at[: len(a)], at[len(a) :]


def waves(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The contests' places, level by level."""
    if not len(a):
        return []
    names, x, y = numbered(a, b)
    level = levels(x, y, len(names))
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1)


#: What waves read of contests, and the type in which packs have it.
FIELDS = {"outcome": np.int8, "mma": np.int8, "family": np.int8, "finish": np.int8, "major": np.int8, "tier": np.int8, "margin": np.float64, "promotion": np.float64, "base": np.float64, "k": np.float64}
KEPT = ["contest_id", "a", "b", "day", "seq"]
#: Columns of ``DELTA`` that both sides have of their own.
OWN = ["pre_rating", "post_rating", "k", "rd", "fights", "latent", "streak", "peak", "finish_rate"]


def in_waves(table: pa.Table) -> pa.Table:
    """Contests in order, put by waves: also ``level``, and the places ``x`` and ``y`` of both sides among the contestants, whose ids are the schema's metadata."""
    names, x, y = numbered(*(table.column(c).to_numpy() for c in "ab"))
    level = levels(x, y, len(names))
    order = np.argsort(level, kind="stable")
    made = {c: pa.array(table.column(c).to_numpy()[order].astype(t)) for c, t in FIELDS.items()}
    made |= {c: pa.array(v[order].astype(np.int32)) for c, v in (("x", x), ("y", y), ("level", level))}
    kept = table.select(KEPT).take(pa.array(order)).combine_chunks()
    return pa.table({c: kept.column(c) for c in KEPT} | made).replace_schema_metadata({"ids": names.astype(np.int64).tobytes()})


def run_chunk(name: str, states: States, i: np.ndarray, j: np.ndarray, level: np.ndarray, columns: dict[str, np.ndarray], compat: bool) -> dict[str, np.ndarray]:
    """Folds contests of the contestants in rows ``i`` and ``j``, which stand by waves: a's expectation and target, and the columns ``OWN``, a's and then b's."""
    system, n, s = SYSTEMS[name], len(i), states.data
    one = {k: np.full(n, np.nan) for k in ("expected", "target", "expected_after")}
    out: dict[str, np.ndarray] = {}
    ends = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), n] if n else [0]
    for start, end in zip(ends, ends[1:], strict=False):
        at = slice(start, end)
        x, y = i[at], j[at]
        c = SimpleNamespace(**{k: v[at] for k, v in columns.items()})
        pre, one["expected"][at], one["target"][at], ks = system.wave(s, x, y, c, compat)
        if system.after:
            one["expected_after"][at] = system.after(s, x, y)
        both = np.concatenate([x, y])
        here = {"post_rating": system.rating(s, both), "rd": system.rd(s, both), "fights": s["fights"][both], **system.facts(s, both)}
        for k, v in here.items():
            if k not in out:
                out[k] = np.full((2, n), np.nan)
            out[k][:, at] = v.reshape(2, -1)
        for k, v in (("pre_rating", pre), ("k", ks)):
            if k not in out:
                out[k] = np.full((2, n), np.nan)
            out[k][0, at], out[k][1, at] = v
    return one | out


TYPES = {"system": pa.string(), "contest_id": pa.int64(), "contestant": pa.int64(), "opponent": pa.int64(), "day": pa.date32(), "seq": pa.int64(), "fights": pa.int64(), "streak": pa.int32()}
SCHEMA = pa.schema([(n, TYPES.get(n, pa.float64())) for n in NAMES] + [("state", pa.list_(pa.float64()))])


def _array(name: str, values: np.ndarray) -> pa.Array:
    kind = TYPES.get(name, pa.float64())
    if kind in (pa.int64(), pa.int32()) and values.dtype.kind == "f":
        return pa.array(np.where(np.isnan(values), 0, values).astype(np.int64), mask=np.isnan(values)).cast(kind)
    return pa.array(values, from_pandas=True).cast(kind)


Rows = Callable[[str, States, pa.Table], pa.RecordBatch]


def delta_rows(compat: bool) -> Rows:
    """Of a pack put by waves: what ``run_chunk`` makes, a row a contest."""

    def rows(name: str, states: States, table: pa.Table) -> pa.RecordBatch:
        at = states.rows(np.frombuffer(table.schema.metadata[b"ids"], np.int64))
        f = {c: table.column(c).to_numpy() for c in ("x", "y", "level", "day", *SYSTEMS[name].reads)}
        x, y, level, outcome = f.pop("x"), f.pop("y"), f.pop("level"), f.pop("outcome")
        f = {c: v.view(bool) if c in ("mma", "finish", "major") else v.astype(float) if c == "day" else v for c, v in f.items()}
        f |= {"won": outcome == 1, "draw": outcome == 0, "decided": np.abs(outcome) == 1} | settled(f)
        made = run_chunk(name, states, at[x], at[y], level, f, compat)
        flat = {k: v for k, v in made.items() if v.ndim == 1} | {f"{k}_{side}": v[side] for k, v in made.items() if v.ndim == 2 for side in (0, 1)}
        return pa.RecordBatch.from_pydict({c: table.column(c).combine_chunks() for c in KEPT} | {k: pa.array(v) for k, v in flat.items()})

    return rows


def delta_batch(name: str, made: pa.RecordBatch) -> pa.RecordBatch:
    """``DELTA`` and an empty state of the rows of ``delta_rows``: first all of a's, then all of b's."""
    n, given = made.num_rows, {c: made.column(c).to_numpy(zero_copy_only=False) for c in made.schema.names}
    twice = lambda c: np.concatenate([given[c], given[c]])
    out = {"contest_id": twice("contest_id"), "contestant": np.concatenate([given["a"], given["b"]]), "opponent": np.concatenate([given["b"], given["a"]]), "day": twice("day").astype(np.int32), "seq": twice("seq"), "expected_after": twice("expected_after")}
    out |= {c: np.concatenate([given[c], 1 - given[c]]) for c in ("expected", "target")}
    out |= {c: np.concatenate([given[f"{c}_0"], given[f"{c}_1"]]) if f"{c}_0" in given else np.full(2 * n, np.nan) for c in OWN}
    return pa.RecordBatch.from_arrays([pa.array([name] * (2 * n), pa.string()), *[_array(c, out[c]) for c in NAMES[1:]], pa.nulls(2 * n, pa.list_(pa.float64()))], schema=SCHEMA)


def written(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def runs(*columns: list) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of runs of equal values."""
    start, rows = 0, list(zip(*columns, strict=True))
    for n in range(1, len(rows) + 1):
        if n == len(rows) or rows[n] != rows[start]:
            yield start, n
            start = n


BUNDLE = "system string, bin int, task int, number long, rows binary"
PACKS = "task int, number long, system string, kept boolean, rows binary"


def bundled(prepare: Callable[[pa.Table], pa.Table], reads: dict[str, list[str] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contests by bin and order as ``BUNDLE``: up to some ``CHUNK`` of a bin, or ``BYTES``, after ``prepare``, with the columns that a system reads (None: all)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, []

        def packs(at: int) -> Iterator[pa.RecordBatch]:
            table = prepare(pa.Table.from_batches(held).drop_columns(["bin"]))
            for system, names in reads.items():
                rows = written((table.select(names) if names else table).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([system]), pa.array([at], pa.int32()), pa.array([task], pa.int32()), pa.array([number], pa.int64()), pa.array([rows], pa.binary())], ["system", "bin", "task", "number", "rows"])

        now = None
        for batch in batches:
            bins = batch.column("bin").to_pylist()
            for start, end in runs(bins):
                if held and (bins[start] != now or sum(len(h) for h in held) >= CHUNK or sum(h.nbytes for h in held) >= BYTES):
                    yield from packs(now)
                    number, held = number + 1, []
                now = bins[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from packs(now)

    return go


def runner(rows: Rows, starts: dict[str, dict], schema: pa.Schema, with_states: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, pa.RecordBatch]]]:
    """Over ``BUNDLE`` with a and state, sorted by system and bin, states before packs, packs in order: what ``rows`` makes of each pack, and after each
    system's bin, if asked for, the states as rows of ``schema`` (which ends with the state) that have no contest."""

    def state_rows(name: str, states: States) -> Iterator[tuple[str, pa.RecordBatch]]:
        ids, packed = states.packed()
        for k in range(0, len(ids), CHUNK):
            part = packed[k : k + CHUNK]
            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.reshape(-1))
            fixed = {"system": pa.array([name] * len(part)), "contestant": pa.array(ids[k : k + CHUNK]), "state": lists}
            yield name, pa.RecordBatch.from_arrays([fixed[f.name] if f.name in fixed else pa.nulls(len(part), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        now, states = None, None
        for batch in batches:
            systems, bins = (batch.column(c).to_pylist() for c in ("system", "bin"))
            for start, end in runs(systems, bins):
                name = systems[start]
                if (name, bins[start]) != now:
                    if now and with_states:
                        yield from state_rows(now[0], states)
                    now, states = (name, bins[start]), States(starts[name])
                part = batch.slice(start, end - start)
                given = part.filter(part.column("state").is_valid())
                if len(given):
                    states.put(given.column("a").to_numpy(), given.column("state").flatten().to_numpy().reshape(len(given), -1))
                for pack in part.column("rows").drop_null():
                    yield name, rows(name, states, pa.ipc.open_stream(pack.as_buffer()).read_all())
        if now and with_states:
            yield from state_rows(now[0], states)

    return run


def family(sport: Column) -> Column:
    """The place of the sport's family in ``FAMILIES``."""
    named = F.when(sport == "mma", "mma").when(sport.isin(*STRIKING), "striking").when(sport.isin(*GRAPPLING), "grappling").otherwise("other")
    return F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), named) - 1


def prepared(log: DataFrame) -> DataFrame:
    """The log with what a contest alone decides: its order, the target before anchoring and the static part of K. A null day counts as the first of 1900."""
    k = kernels
    sign = F.when(F.col("outcome") == "W", 1.0).when(F.col("outcome") == "L", -1.0).otherwise(0.0)
    elapsed = (F.col("finish_round") - 1) * 300 + F.col("finish_seconds")
    early = F.when((F.col("finish_round") > 0) & F.col("finish_seconds").isNotNull(), k.TARGET["time"] * (1 - k.clip(elapsed / (F.greatest("rounds", "finish_round") * 300), 0, 1))).otherwise(0.0)
    bonus = F.when(k.is_finish(F.col("method")), k.TARGET["finish"]).otherwise(0.0)
    base = k.clip(0.5 + sign * k.TARGET["gap"] + k.TARGET["margin"] * F.coalesce("margin", F.lit(0.0)) + sign * (bonus + early), 0, 1)
    fixed = k.k_static(F.col("tier"), F.col("rounds"), F.col("title"), F.col("method"), F.col("margin"), F.col("promotion")).alias("k")
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    return log.withColumn("day", F.coalesce("day", F.lit(FIRST_DAY).cast("date"))).select(*COLUMNS, seq.cast("long").alias("seq"), base.alias("base"), fixed)


def numbers(ready: DataFrame) -> DataFrame:
    """A prepared log as ids and numbers (``FIELDS``) for the waves; other outcomes than W, L and D are none (2)."""
    code = F.coalesce(F.create_map(*[F.lit(x) for item in OUTCOMES.items() for x in item])[F.col("outcome")], F.lit(2))
    tier = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.lit(0)), F.lit(len(TIERS))) - 1
    no = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return ready.select(
        "contest_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.unix_date("day").alias("day"), "seq", code.alias("outcome"), no(F.col("sport") == "mma").alias("mma"), family(F.col("sport")).cast("int").alias("family"),
        no(kernels.is_finish(F.col("method"))).alias("finish"), no((F.col("rounds") >= 5) | F.coalesce("title", F.lit(False))).alias("major"), tier.cast("int").alias("tier"), F.col("margin").cast("double").alias("margin"),
        F.col("promotion").cast("double").alias("promotion"), F.col("base").cast("double").alias("base"), F.col("k").cast("double").alias("k"))


def _dealt(rows: DataFrame, systems: tuple[str, ...], states: DataFrame | None, size: Row, prepare: Callable, reads: dict[str, list[str] | None]) -> DataFrame:
    """Contests (with ``component``) in packs for each system, and the given states of their contestants, dealt by system and bin of components, in order. ``size`` has the numbers of contests and components."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = size["total"] or 0
    bins = max(1, min(max(most, -(-total // BIN)), size["components"] or 0))
    rows = rows.withColumn("bin", F.pmod(F.hash("component"), F.lit(bins)))
    ranges = max(1, min(most, -(-total // CHUNK)), -(-total // (4 * CHUNK)))
    order = ("bin", "day", "seq", "contest_id")
    each = rows.drop("component").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(bundled(prepare, reads), BUNDLE).withColumn("state", F.lit(None).cast("array<double>"))
    if states is not None:
        who = rows.select(F.explode(F.array("a", "b")).alias("contestant"), "bin").distinct()
        given = states.where(F.col("system").isin(*systems)).join(who, "contestant").select(F.col("contestant").alias("a"), "bin", "system", "state")
        each = each.unionByName(given, allowMissingColumns=True)
    else:
        each = each.withColumn("a", F.lit(None).cast("long"))
    place = (F.array_position(F.array(*[F.lit(x) for x in systems]), F.col("system")).cast("int") - 1) * bins + F.col("bin")
    return each.repartitionById(len(systems) * bins, place).sortWithinPartitions("system", "bin", F.col("state").isNull(), "task", "number")


def sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """Contests, components, and contests of the largest component."""
    return rows.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("components"))


def largest_component(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs: each contestant beside the smallest that it is tied to in the task, itself left out; far fewer rows than pairs, with the same components."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if x is not None and y is not None:
                p, q = up.setdefault(x, x), up.setdefault(y, y)
                if p != q:
                    p, q = top(x), top(y)
                    up[x] = up[y] = up[max(p, q)] = min(p, q)
    found = [(x, top(x)) for x in up if up[x] != x]
    for at in range(0, len(found), CHUNK):
        u, v = zip(*found[at : at + CHUNK], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def labelled(rows: DataFrame) -> DataFrame:
    label = components(row_batches(rows.select("a", "b")).mapInArrow(met, "u long, v long"))
    return rows.join(label.select(F.col("node").alias("a"), "component"), "a")


def packed(run: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``run`` gives, as ``PACKS`` of up to ``PACK`` rows in Arrow's stream format; ``kept`` are those of states."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for system, batch in run(batches):
            kept = "state" in batch.schema.names and batch.column("state").null_count < batch.num_rows
            for start in range(0, batch.num_rows, PACK):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number], pa.int64()), pa.array([system]), pa.array([kept]), pa.array([written(batch.slice(start, PACK))], pa.binary())], ["task", "number", "system", "kept", "rows"])
                number += 1

    return go


def unpacked(finish: Callable[[str, pa.RecordBatch], pa.RecordBatch] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of packs; ``finish`` makes them of what is not states."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for system, pack in zip(batch.column("system").to_pylist(), batch.column("rows"), strict=True):
                for made in pa.ipc.open_stream(pack.as_buffer()):
                    yield finish(system, made) if finish and "state" not in made.schema.names else made

    return go


def row_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches bounded by rows alone in this session: with a bound of bytes Spark adds up the sizes of all columns at every row, which takes longer than the fold. Contests are short, and
    a partition of packs is bounded by ``_dealt`` and ``folded``."""
    conf = df.sparkSession.conf
    rows = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if rows.isdigit() and 0 < int(rows) <= 10_000:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", (1 << 31) - 1)
    return df


def folded(dealt: DataFrame, run: Callable, shape: str, contests: int, finish: Callable | None = None) -> DataFrame:
    """The rows of ``run`` over dealt contests, opened by as many tasks as a shuffle has, by more where these would get over ``OPENED`` of the ``contests`` (times systems)."""
    dealt = row_batches(dealt)
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contests // OPENED))
    return dealt.mapInArrow(packed(run), PACKS).repartition(parts, "task", "number").mapInArrow(unpacked(finish), shape)


def sliced(rows: DataFrame, bound: int, start: int = 0) -> DataFrame:
    """``rows`` with ``component`` and ``slice``, a number from ``start`` that grows with the order inside a component, of which a slice has at most ``bound`` contests.

    Components do not matter to one another, so each is cut on its own, and there are no more slices than the largest needs.
    """
    whole = rows if "component" in rows.columns else labelled(rows)
    placed = analytics.running_total(whole.withColumn("_one", F.lit(1)), ["component"], ["day", "seq", "contest_id"], "_one", "_upto")
    return stored(placed.withColumn("slice", F.floor((F.col("_upto") - 1) / bound).cast("long") + start).drop("_one", "_upto"), "slice")


def fold(log: DataFrame, systems: tuple[str, ...] = tuple(SYSTEMS), compat: bool = True, bound: int = MAX_TASK_CONTESTS) -> DataFrame:
    """Two rows a contest and system (``DELTA``), contests in the order of (day, ``seq`` where the log has it, contest_id). ``a`` and ``b`` differ and are not null.

    ``expected`` is the expectation before the contest, ``expected_after`` (Elo and Glicko) that of the updated states, for a in both rows. No task gets a component of more than
    ``bound`` contests. Without ``compat`` the unified system takes each side's own outcome. An empty log gives an empty result.
    """
    return fold_on(log, systems, None, compat, bound, keep=False)[0]


def fold_on(log: DataFrame, systems: tuple[str, ...] = tuple(SYSTEMS), states: DataFrame | None = None, compat: bool = True, bound: int = MAX_TASK_CONTESTS, keep: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """As ``fold``, going on from ``states`` (``STATE``); also the states of all contestants afterwards, unless ``keep`` is false."""
    run = lambda with_states: runner(delta_rows(compat), {s: SYSTEMS[s].start for s in systems}, SCHEMA, with_states)
    reads = {s: [*KEPT, "x", "y", "level", *SYSTEMS[s].reads] for s in systems}
    return fold_rows(cut(numbers(prepared(log))), systems, run, DELTA, states, bound, keep, in_waves, reads, delta_batch)


def fold_rows(
    rows: DataFrame, systems: tuple[str, ...], run: Callable[[bool], Callable], delta: str, states: DataFrame | None, bound: int, keep: bool,
    prepare: Callable[[pa.Table], pa.Table] = lambda table: table, reads: dict[str, list[str]] | None = None, finish: Callable | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Written ``rows`` (contest_id, day as a number, a, b, and what ``run`` reads) through the runners of the systems; slices where a component is larger than ``bound``.

    ``prepare`` is done to packs before the runners, which read the columns ``reads`` of it (default: all), and ``finish`` to what they give, by other tasks."""
    spark, shape, names = rows.sparkSession, f"{delta}, state array<double>", [c.split()[0] for c in delta.split(", ")]
    rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0).cast("long"))
    reads = reads or dict.fromkeys(systems)
    whole = labelled(rows)
    found = sizes(whole).first()
    if not found or (found["n"] or 0) <= bound:
        size = found or Row(total=0, components=0)
        made = folded(_dealt(whole, systems, states, size, prepare, reads), run(keep), shape, len(systems) * (size["total"] or 0), finish)
        if not keep:
            return made.drop("state"), None
        made = cut(made)
        return made.where("state is null").drop("state"), _replaced(states, made)
    parts = sliced(whole, bound)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/fold-{uuid.uuid4().hex}"
    opened = lambda path, kept: spark.read.parquet(path).where(F.col("kept") == kept).select("system", "rows").mapInArrow(unpacked(finish), shape)
    for number, size in enumerate(sizes(parts, "slice").orderBy("slice").collect()):
        dealt = row_batches(_dealt(parts.where(F.col("slice") == size["slice"]).drop("slice"), systems, states, size, prepare, reads))
        # The packs stay closed here: who reads the result opens those of all slices at once, while a slice waits for its largest component.
        dealt.mapInArrow(packed(run(True)), PACKS).write.option("maxRecordsPerFile", PACKS_A_FILE).parquet(f"{folder}/slice={number}")
        states = cut(_replaced(states, opened(f"{folder}/slice={number}", True)))
    return opened(folder, False).select(*names), states


def _replaced(states: DataFrame | None, made: DataFrame) -> DataFrame:
    new = made.where("state is not null").select("system", "contestant", "state")
    return new if states is None else states.join(new, ["system", "contestant"], "left_anti").unionByName(new)


def order_of(rows: DataFrame) -> Column:
    """What contests are ordered by: day, ``seq`` where ``rows`` have it, contest_id."""
    return F.struct(*[c for c in ("day", "seq", "contest_id") if c in rows.columns])


def latest(deltas: DataFrame) -> DataFrame:
    """The last state of each contestant and system, in one partial aggregation."""
    last = F.max_by(F.struct("day", F.col("post_rating").alias("rating"), "rd", "fights", "latent", "streak", "peak", "finish_rate"), order_of(deltas))
    return deltas.groupBy("system", "contestant").agg(last.alias("s")).select("system", "contestant", "s.*")
