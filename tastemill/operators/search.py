"""Population search over flattened centroids: one Spark job scores a whole generation.

Steppers are small numpy functions on the driver over a population of at most a
few hundred points; the data never leaves the executors. Generations are
synchronous, so a generation is a single batch of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash

Objective = Callable[[np.ndarray], np.ndarray]
#: Numbers of dense rows that a worker holds at a time.
BLOCK_NUMBERS = 2_000_000


@dataclass
class Result:
    best: np.ndarray
    fitness: float
    history: list[float] = field(default_factory=list)
    population: np.ndarray | None = None


def blocks(pdf: pd.DataFrame, d: int) -> Iterator[np.ndarray]:
    """Rows as dense blocks of bounded size, from ``v`` or from places and values (``ids``, ``vals``)."""
    step = max(1, BLOCK_NUMBERS // max(1, d))
    for lo in range(0, len(pdf), step):
        part = pdf.iloc[lo : lo + step]
        if "ids" not in part:
            yield np.array(part.v.tolist(), float)
            continue
        out = np.zeros((len(part), d))
        lengths = [len(x) for x in part.ids]
        out[np.repeat(np.arange(len(part)), lengths), np.concatenate([*part.ids, []]).astype(int)] = np.concatenate([*part.vals, []])
        yield out


def clustering_objective(df: DataFrame, k: int, d: int, penalty: float = 1000.0) -> Objective:
    """Scores of candidates (P x k d): sum of squared distances to the nearest centroid, and ``penalty`` for each empty one.

    The candidates are broadcast (P k d numbers); each task returns P sums and
    P k counts, which are added up: what moves does not grow with the data.
    """
    session = df.sparkSession

    def score(population: np.ndarray) -> np.ndarray:
        sent = session.sparkContext.broadcast(population.reshape(len(population), k, d))

        def run(batches):
            total, used = np.zeros(len(sent.value)), np.zeros((len(sent.value), k), bool)
            for pdf in batches:
                if pdf.empty:
                    continue
                for x in blocks(pdf, d):
                    q = (x * x).sum(1)
                    for c, centre in enumerate(sent.value):
                        d2 = np.maximum(q[:, None] - 2 * x @ centre.T + (centre * centre).sum(1), 0)
                        total[c] += d2.min(1).sum()
                        used[c] |= np.bincount(d2.argmin(1), minlength=k) > 0
            yield pd.DataFrame({"c": range(len(total)), "s": total, "used": [u.astype("int32").tolist() for u in used]})

        parts = df.drop("vec_id", "cluster_id").mapInPandas(run, "c int, s double, used array<int>")
        rows = parts.groupBy("c").agg(F.sum("s").alias("s"), F.array(*[F.max(F.col("used")[i]) for i in range(k)]).alias("used")).collect()
        out = np.zeros(len(population))
        for r in rows:
            out[r["c"]] = r["s"] + penalty * (k - sum(r["used"]))
        return out

    return score


class Composite:
    """0.50 wcss / w0 + 0.25 (1 - silhouette) / s0 + 0.25 (1 / CH) / c0, relative to the first candidate that is scored.

    A generation is one job over all vectors, which gives the sums of squares. Silhouette (cosine) and
    Calinski-Harabasz are of a fixed sample of at most ``sample`` vectors, smallest hashes first, and need no job;
    candidates that leave the sample in one cluster, or every vector alone, have -1 and 1.
    """

    def __init__(self, df: DataFrame, k: int, d: int, sample: int = 300, seed: str = "sil"):
        self.k, self.d, self.base = k, d, None
        self.squares = clustering_objective(df, k, d, 0.0)
        rows = df.orderBy(order_hash("vec_id", seed=seed), "vec_id").limit(sample).drop("vec_id").toPandas()
        self.x = np.concatenate([np.zeros((0, d)), *blocks(rows, d)])
        norm = np.sqrt((self.x * self.x).sum(1))
        unit = self.x / np.where(norm > 0, norm, 1.0)[:, None]
        self.far = np.clip(1 - unit @ unit.T, 0, 2)
        np.fill_diagonal(self.far, 0.0)

    def quality(self, centres: np.ndarray) -> tuple[float, float]:
        """(silhouette, CH) of the sample by its nearest centres."""
        x, n = self.x, len(self.x)
        own = (-2 * x @ centres.T + (centres * centres).sum(1)).argmin(1) if n else np.zeros(0, int)
        names, own = np.unique(own, return_inverse=True)
        if not 2 <= len(names) < n:
            return -1.0, 1.0
        one = np.eye(len(names))[own]
        size = one.sum(0)
        total = self.far @ one
        rows = np.arange(n)
        inner = total[rows, own] / np.maximum(size[own] - 1, 1)
        other = total / size
        other[rows, own] = np.inf
        outer = other.min(1)
        top = np.maximum(inner, outer)
        sil = np.where((size[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1.0), 0.0)
        mean = (one.T @ x) / size[:, None]
        within = ((x - mean[own]) ** 2).sum()
        between = (size[:, None] * (mean - x.mean(0)) ** 2).sum()
        ch = 1.0 if within == 0 else between * (n - len(names)) / (within * (len(names) - 1))
        return float(sil.mean()), float(ch)

    def parts(self, population: np.ndarray) -> np.ndarray:
        """(wcss, silhouette, CH) of each candidate."""
        quality = [self.quality(c) for c in population.reshape(len(population), self.k, self.d)]
        return np.column_stack([self.squares(population), np.array(quality)])

    def __call__(self, population: np.ndarray) -> np.ndarray:
        wcss, sil, ch = self.parts(np.atleast_2d(population)).T
        costs = np.column_stack([np.maximum(wcss, 0), 1 - sil, 1 / np.maximum(ch, 1e-12)])
        if self.base is None:
            self.base = np.maximum(costs[0], 1e-12)
        return (costs / self.base) @ np.array([0.50, 0.25, 0.25])


class Search:
    """State that all steppers share: bounds, population, fitness, best so far (strict improvement only)."""

    def __init__(self, objective: Objective, low: np.ndarray, high: np.ndarray, size: int, seed: int, start: np.ndarray | None = None):
        self.f, self.low, self.high, self.draw = objective, low, high, np.random.RandomState(seed)
        x = self.draw.uniform(low, high, (size, len(low)))
        if start is not None:
            x[: min(size, len(start))] = start[:size]
        self.x = np.clip(x, low, high)
        self.y = objective(self.x)
        b = int(self.y.argmin())
        self.best, self.fitness, self.history = self.x[b].copy(), float(self.y[b]), [float(self.y[b])]

    def note(self, x: np.ndarray, y: np.ndarray) -> None:
        b = int(y.argmin())
        if y[b] < self.fitness:
            self.best, self.fitness = x[b].copy(), float(y[b])

    def greedy(self, new: np.ndarray) -> None:
        new = np.clip(new, self.low, self.high)
        y = self.f(new)
        self.note(new, y)
        better = y < self.y
        self.x[better], self.y[better] = new[better], y[better]

    def result(self) -> Result:
        return Result(self.best, self.fitness, self.history, self.x)


def pso(objective, low, high, size=30, epochs=100, seed=42, start=None, w=0.7, c1=1.5, c2=1.5) -> Result:
    """Particles always move; personal and global bests change on strict improvement."""
    s = Search(objective, low, high, size, seed, start)
    v, mine, best = np.zeros_like(s.x), s.x.copy(), s.y.copy()
    for _ in range(epochs):
        r1, r2 = s.draw.rand(*s.x.shape), s.draw.rand(*s.x.shape)
        v = w * v + c1 * r1 * (mine - s.x) + c2 * r2 * (s.best - s.x)
        s.x = np.clip(s.x + v, low, high)
        s.y = objective(s.x)
        s.note(s.x, s.y)
        better = s.y < best
        mine[better], best[better] = s.x[better], s.y[better]
        s.history.append(s.fitness)
    return s.result()


def gwo(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Grey wolves: everyone moves to the mean of steps towards the three best (Mirjalili et al., 2014)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        a = 2 - 2 * t / max(1, epochs)
        lead = s.x[np.argsort(s.y, kind="stable")[:3]]
        steps = []
        for wolf in lead:
            r1, r2 = s.draw.rand(*s.x.shape), s.draw.rand(*s.x.shape)
            steps.append(wolf - (2 * a * r1 - a) * np.abs(2 * r2 * wolf - s.x))
        s.greedy(np.mean(steps, 0))
        s.history.append(s.fitness)
    return s.result()


def doa(objective, low, high, size=30, epochs=100, seed=42, start=None, c1=1.0, middle=25.0, steep=0.5, c3=3.0, surroundings=1.0) -> Result:
    """Dholes: a pack of one size each generation; half of the dholes search (small pack) or encircle (large one), the others attack.

    The prey is the middle of the best now and the best ever. Positions change on strict improvement.
    """
    s = Search(objective, low, high, size, seed, start)
    n, d = s.x.shape
    for t in range(1, epochs + 1):
        pack = round(15 * s.draw.rand() + 5)
        strength = (c1 / (1 + np.exp(steep * (pack - middle)))) ** 2 * surroundings
        local, best = s.x[int(s.y.argmin())].copy(), s.best.copy()
        prey = (local + best) / 2
        f_prey = s.fitness if abs(s.fitness) > 1e-10 else 1e-10
        calls = s.draw.rand(n, 1) < 0.5
        if pack < 10:
            calm = s.x + (1 - t / epochs) * s.draw.rand(n, d) * (prey - s.x)
        else:
            other = (np.arange(n) + s.draw.randint(1, max(n, 2), n)) % n  # any dhole but oneself
            calm = s.x - s.x[other] + prey
        size_ratio = c3 * s.draw.rand(n, 1) * s.y[:, None] / f_prey
        weak = np.exp(-1 / np.where(size_ratio > 0, size_ratio, 1.0)) * local
        turn = np.cos(2 * np.pi * s.draw.rand(n, d)) - np.sin(2 * np.pi * s.draw.rand(n, d))
        large = s.x + weak * strength * turn * weak * strength
        small = (s.x - best) * strength + strength * s.draw.rand(n, d) * s.x
        s.greedy(np.where(calls, calm, np.where(size_ratio > (c3 + 1) / 2, large, small)))
        s.history.append(s.fitness)
    return s.result()


def de(objective, low, high, size=30, epochs=100, seed=42, start=None, scale=0.8, rate=0.9) -> Result:
    """Differential evolution, rand/1/bin, greedy."""
    s = Search(objective, low, high, size, seed, start)
    for _ in range(epochs):
        s.greedy(mutate(s, s.x, scale, rate))
        s.history.append(s.fitness)
    return s.result()


def donors(s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point three others, all different and none the point itself (drawn with repeats only from fewer than four points)."""
    n = len(s.x)
    if n < 4:
        return tuple(s.x[s.draw.randint(n, size=n)] for _ in range(3))
    order = np.argsort(s.draw.rand(n, n - 1), axis=1)[:, :3]
    order += order >= np.arange(n)[:, None]  # skips the point
    return s.x[order[:, 0]], s.x[order[:, 1]], s.x[order[:, 2]]


def mutate(s: Search, x: np.ndarray, scale: float, rate: float) -> np.ndarray:
    a, b, c = donors(s)
    return np.where(s.draw.rand(*x.shape) < rate, np.clip(a + scale * (b - c), s.low, s.high), x)


def hho_step(s: Search, t: int, epochs: int) -> np.ndarray:
    """Harris hawks: perching while the prey has energy, besieging when it tires (Heidari et al., 2019)."""
    energy = 2 * (2 * s.draw.rand(len(s.x), 1) - 1) * (1 - t / max(1, epochs))
    far = s.x[s.draw.randint(len(s.x), size=len(s.x))]
    perch = far - s.draw.rand(*s.x.shape) * np.abs(far - 2 * s.draw.rand(*s.x.shape) * s.x)
    jump = 2 * (1 - s.draw.rand(len(s.x), 1))
    soft = (s.best - s.x) - energy * np.abs(jump * s.best - s.x)
    hard = s.best - energy * np.abs(s.best - s.x)
    return np.where(np.abs(energy) >= 1, perch, np.where(np.abs(energy) >= 0.5, soft, hard))


def hho(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        s.greedy(hho_step(s, t, epochs))
        s.history.append(s.fitness)
    return s.result()


def de_hho(objective, low, high, size=30, epochs=100, seed=42, start=None, scale=0.5, rate=0.9) -> Result:
    """Each generation a hawk step, which is scored and kept where better, then rand/1/bin on what it left; greedy."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        s.greedy(hho_step(s, t, epochs))
        s.greedy(mutate(s, s.x, scale, rate))
        s.history.append(s.fitness)
    return s.result()


def mfo(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Moths fly in spirals around flames, the best places so far, of which fewer and fewer are left (Mirjalili, 2015)."""
    s = Search(objective, low, high, size, seed, start)
    flames, light = s.x[np.argsort(s.y, kind="stable")], np.sort(s.y, kind="stable")
    for t in range(epochs):
        left = round(size - (t + 1) * (size - 1) / max(1, epochs))
        way = (-2 - t / max(1, epochs)) * s.draw.rand(*s.x.shape) + 1
        flame = flames[np.minimum(np.arange(size), left - 1)]
        s.x = np.clip(np.abs(flame - s.x) * np.exp(way) * np.cos(2 * np.pi * way) + flame, low, high)
        s.y = objective(s.x)
        s.note(s.x, s.y)
        every, lights = np.vstack([flames, s.x]), np.append(light, s.y)
        order = np.argsort(lights, kind="stable")[:size]
        flames, light = every[order], lights[order]
        s.history.append(s.fitness)
    return s.result()


def woa(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Whales encircle the best, swim to any other one, or blow bubbles in a spiral (Mirjalili and Lewis, 2016)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        a = 2 - 2 * t / max(1, epochs)
        big = 2 * a * s.draw.rand(size, 1) - a
        goal = np.where(np.abs(big) < 1, s.best, s.x[s.draw.randint(size, size=size)])
        ring = goal - big * np.abs(2 * s.draw.rand(size, 1) * goal - s.x)
        way = s.draw.uniform(-1, 1, (size, 1))
        spiral = np.abs(s.best - s.x) * np.exp(way) * np.cos(2 * np.pi * way) + s.best
        s.greedy(np.where(s.draw.rand(size, 1) < 0.5, ring, spiral))
        s.history.append(s.fitness)
    return s.result()


def goa(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Grasshoppers keep a comfortable distance from each other and drift to the best (Saremi et al., 2017)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        c = 1 - t * (1 - 4e-5) / max(1, epochs)
        gap = s.x[None, :, :] - s.x[:, None, :]
        far = np.sqrt((gap * gap).sum(2, keepdims=True)) + 1e-12
        near = 1 + 3 * far / max(far.max(), 1e-12)  # distances are mapped to [1, 4]
        force = (0.5 * np.exp(-near / 1.5) - np.exp(-near)) * gap / far
        s.x = np.clip(c * (c * (np.asarray(high) - np.asarray(low)) / 2 * force.sum(1)) + s.best, low, high)
        s.y = objective(s.x)
        s.note(s.x, s.y)
        s.history.append(s.fitness)
    return s.result()


def ssa(objective, low, high, size=30, epochs=100, seed=42, start=None, safe=0.8, lead=0.2, scouts=0.1) -> Result:
    """Sparrows: producers search, scroungers follow, scouts flee (Xue and Shen, 2020)."""
    s = Search(objective, low, high, size, seed, start)
    for _ in range(epochs):
        order = np.argsort(s.y, kind="stable")
        x, new = s.x[order], s.x[order].copy()
        n1 = max(1, int(lead * size))
        calm = s.draw.rand() < safe
        new[:n1] = x[:n1] * np.exp(-np.arange(1, n1 + 1)[:, None] / (s.draw.rand(n1, 1) * epochs + 1e-12)) if calm else x[:n1] + s.draw.normal(0, 1, (n1, 1))
        rest = np.arange(n1, size)
        hungry = s.draw.normal(0, 1, (len(rest), 1)) * np.exp((x[-1] - x[rest]) / (rest[:, None] + 1.0) ** 2)
        follow = new[0] + np.abs(x[rest] - new[0]) * np.sign(s.draw.uniform(-1, 1, (len(rest), 1))) / x.shape[1]
        new[rest] = np.where(rest[:, None] > size / 2, hungry, follow)
        who = s.draw.permutation(size)[: max(1, int(scouts * size))]
        new[who] = s.best + s.draw.normal(0, 1, (len(who), 1)) * np.abs(x[who] - s.best)
        back = np.empty_like(new)
        back[order] = new
        s.greedy(back)
        s.history.append(s.fitness)
    return s.result()


def ga(objective, low, high, size=30, epochs=100, seed=42, start=None, cross=0.9, change=0.05, elite=0.1) -> Result:
    """Genetic: tournaments of two, arithmetic crossover, uniform mutation; the best tenth stays."""
    s = Search(objective, low, high, size, seed, start)
    for _ in range(epochs):
        first, second = (s.draw.randint(size, size=(2, size)) for _ in range(2))
        pick = lambda pair: s.x[np.where(s.y[pair[0]] <= s.y[pair[1]], pair[0], pair[1])]  # noqa: B023, E731
        a, b, w = pick(first), pick(second), s.draw.rand(size, 1)
        child = np.where(s.draw.rand(size, 1) < cross, w * a + (1 - w) * b, a)
        child = np.where(s.draw.rand(*child.shape) < change, s.draw.uniform(low, high, child.shape), child)
        keep = np.argsort(s.y, kind="stable")[: max(1, int(elite * size))]
        child[: len(keep)] = s.x[keep]
        s.x = np.clip(child, low, high)
        s.y = objective(s.x)
        s.note(s.x, s.y)
        s.history.append(s.fitness)
    return s.result()


SINGLE: dict[str, Callable[..., Result]] = {"PSO": pso, "GWO": gwo, "DOA": doa, "DE": de, "HHO": hho, "DE-HHO": de_hho, "MFO": mfo, "WOA": woa, "GOA": goa, "SSA": ssa, "GA": ga}


#: Where searches come from, by name: ours, and what a caller adds.
SOURCES: dict[str, dict[str, Callable[..., Result]]] = {}


def get_optimizer(name: str, source: str = "own") -> Callable[..., Result]:
    """A single algorithm, ``A+B`` (A, then B around its best), ``A+GAop`` (A with crossover and mutation between) or ``A||B`` (the better of two); ``source`` names another table of single ones."""
    if source != "own":
        if source not in SOURCES:
            raise ValueError(f"unknown source of optimizers: {source}")
        if name not in SOURCES[source]:
            raise ValueError(f"unknown optimizer: {name}")
        return SOURCES[source][name]
    if "||" in name:
        first, second = (get_optimizer(x.strip()) for x in name.split("||"))
        return lambda *a, **b: min((first(*a, **b), second(*a, **b)), key=lambda r: r.fitness)  # ties: the first
    if "+" in name:
        one, other = (x.strip() for x in name.split("+"))
        if other.upper() == "GAOP":
            return partial(memetic, get_optimizer(one))
        first, second = get_optimizer(one), get_optimizer(other)
        return lambda *a, **b: sequential(first, second, *a, **b)
    try:
        return SINGLE[name.upper()]
    except KeyError:
        raise ValueError(f"unknown optimizer: {name}") from None


def sequential(first, second, objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Half the budget global, then local from the best and copies of it with noise of 2 % of the range."""
    a = first(objective, low, high, size, max(1, epochs // 2), seed, start)
    noise = np.random.RandomState(seed + 1).normal(0, 0.02, (size, len(low))) * (high - low)
    noise[0] = 0
    b = second(objective, low, high, size, max(1, epochs - epochs // 2), seed + 1, np.clip(a.best + noise, low, high))
    return Result(b.best, b.fitness, a.history + b.history) if b.fitness < a.fitness else Result(a.best, a.fitness, a.history + b.history)


def memetic(step, objective, low, high, size=30, epochs=100, seed=42, start=None, every=10, crossed=0.3, mutated=0.1) -> Result:
    """Every ``every`` epochs some pairs cross (the child replaces the worse parent if better than it) and some points move by 5 % of the range, if better."""
    draw = np.random.RandomState(seed)
    x, best, history, done = start, None, [], 0
    while done < epochs:
        n = min(every, epochs - done)
        r = step(objective, low, high, size, n, seed + done, x)
        history += r.history[1 if history else 0 :]
        best = r if best is None or r.fitness < best.fitness else best
        done += n
        x = np.vstack([r.best, np.clip(r.best + draw.normal(0, 0.02, (size - 1, len(low))) * (high - low), low, high)]) if r.population is None else r.population.copy()
        if done >= epochs:
            break
        y = objective(x)
        who = draw.permutation(size)[: 2 * min(size // 2, max(1, int(size * crossed)))]
        one, two = who[0::2], who[1::2]
        alpha = draw.uniform(0.3, 0.7, (len(one), 1))
        child = np.clip(alpha * x[one] + (1 - alpha) * x[two], low, high)
        worse, fresh = np.where(y[one] > y[two], one, two), objective(child)
        better = fresh < y[worse]
        x[worse[better]], y[worse[better]] = child[better], fresh[better]
        who = draw.permutation(size)[: max(1, int(size * mutated))]
        child = np.clip(x[who] + draw.normal(0, 0.05, (len(who), len(low))) * (high - low), low, high)
        fresh = objective(child)
        better = fresh < y[who]
        x[who[better]], y[who[better]] = child[better], fresh[better]
        if y.min() < best.fitness:
            best = Result(x[int(y.argmin())].copy(), float(y.min()))
    return Result(best.best, best.fitness, history, x)


def gwo_pso(objective, low, high, size=30, epochs=100, seed=42, start=None, pull=1e-9) -> Result:
    """Half the budget each; in the second half candidates pay ``pull`` times their distance from the first best."""
    a = gwo(objective, low, high, size, max(1, epochs // 2), seed, start)
    near = lambda p: objective(p) + pull * np.sqrt(((p - a.best) ** 2).sum(1))
    b = pso(near, low, high, size, max(1, epochs - epochs // 2), seed + 1, a.best[None])
    return b if b.fitness <= a.fitness else a


SINGLE["GWO-PSO"] = gwo_pso


def multi_start(objective: Objective, make: Callable[[list[int]], np.ndarray], restarts: int, size: int, seed: int = 42) -> np.ndarray:
    """Of 3 x restarts candidates, which ``make`` gives for as many seeds at once, the best size + 10, scored in one batch."""
    x = np.asarray(make([seed + 17 * i for i in range(3 * restarts)]))
    return x[np.argsort(objective(x), kind="stable")[: size + 10]]


def screen(names: list[str], objective, low, high, runs: int = 3, size: int = 10, epochs: int = 8, seed: int = 10_000) -> list[dict]:
    """A row for each algorithm and run; a failure is a row with its error."""
    rows = []
    for run in range(runs):
        for name in names:
            try:
                r = get_optimizer(name)(objective, low, high, size, epochs, seed + run)
                rows.append({"algorithm": name, "run_num": run, "success": True, "wcss": r.fitness, "history": r.history, "error": None})
            except Exception as error:  # a failed run is data here
                rows.append({"algorithm": name, "run_num": run, "success": False, "wcss": None, "history": [], "error": str(error)})
    return rows


def choose_hybrid(behaviour: list[dict]) -> tuple[str, str]:
    """(global, local) from rows with algorithm, final_wcss, category, exploration_ratio, time: never the same algorithm."""
    pool = [b for b in behaviour if b["category"] == "GLOBAL"]
    first = min(pool, key=lambda b: b["final_wcss"]) if pool else max(behaviour, key=lambda b: b["exploration_ratio"])
    rest = [b for b in behaviour if b["algorithm"] != first["algorithm"]]
    pool = [b for b in rest if b["category"] == "LOCAL"]
    second = min(pool, key=lambda b: b["final_wcss"]) if pool else min(rest, key=lambda b: b["time"])
    return first["algorithm"], second["algorithm"]
