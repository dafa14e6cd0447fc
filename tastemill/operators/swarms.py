"""More population searches by their published equations, in generations that are scored at once.

Where a publication moves one point after the other, a point here sees the generation before
(``search`` says why). All positions are clipped to the bounds; the best so far changes on strict
improvement only.
"""

from __future__ import annotations

from math import gamma as gamma_of

import numpy as np

from tastemill.operators.search import SINGLE, Result, Search, hho_step

EPS = 1e-12


def order_of(s: Search) -> np.ndarray:
    return np.argsort(s.y, kind="stable")


def others(s: Search, n: int) -> np.ndarray:
    """For each point n drawn partners (places)."""
    return s.draw.randint(len(s.x), size=(n, len(s.x)))


def hgs(objective, low, high, size=30, epochs=100, seed=42, start=None, alone=0.08, least_hunger=10_000.0) -> Result:
    """Hunger games: hunger grows with the distance from the best fitness, is carried on, and weighs the pull of the best (Yang et al., 2021)."""
    s = Search(objective, low, high, size, seed, start)
    hunger = np.zeros(size)
    for t in range(epochs):
        best, worst, total = s.y.min(), s.y.max(), hunger.sum()
        r, wide = s.draw.rand(7, size), float(np.mean(high - low))
        grown = (s.y - best) / (worst - best + EPS) * r[0] * 2 * wide
        hunger = np.where(s.y == best, 0.0, hunger + np.where(grown < least_hunger, least_hunger * (1 + r[1]), grown))
        total = hunger.sum()
        w1 = np.where(r[2] < alone, hunger * size / (total + EPS) * r[3], 1.0)[:, None]
        w2 = ((1 - np.exp(-np.abs(hunger - total))) * r[4] * 2)[:, None]
        shrink = 2 * (1 - (t + 1) / max(1, epochs))
        reach = 2 * shrink * s.draw.rand(*s.x.shape) - shrink
        doubt = 1 / np.cosh(np.clip(np.abs(s.y - s.fitness), 0, 700))
        pull = reach * w2 * np.abs(s.best - s.x)
        led = np.where((r[5] > doubt)[:, None], w1 * s.best + pull, w1 * s.best - pull)
        s.greedy(np.where((r[6] < alone)[:, None], s.x * (1 + s.draw.normal(0, 1, (size, 1))), led))
        s.history.append(s.fitness)
    return s.result()


def queues(y: np.ndarray, size: int) -> np.ndarray:
    """Which of three staff serves each customer (in the order of fitness): the faster, the longer the queue."""
    times = y[:3]
    share = (1 / times) / (1 / times).sum() if (times > 1e-6).all() else np.full(len(times), 1 / len(times))
    return np.minimum(np.searchsorted(np.cumsum(np.round(share * size)), np.arange(size), side="right"), len(times) - 1)


def qsa(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Queueing search: customers move around the staff of their queue, between each other, and component by component (Zhang et al., 2018)."""
    s = Search(objective, low, high, size, seed, start)
    near_staff = np.ones(size, bool)  # how a customer is served next; it changes after each failure
    for t in range(1, epochs + 1):
        spread = t ** ((t / epochs) ** 0.5)

        def sorted_state() -> np.ndarray:
            order = order_of(s)
            s.x, s.y = s.x[order], s.y[order]
            return s.x[:3][queues(s.y, size)]

        order = order_of(s)
        near_staff = near_staff[order]
        staff = sorted_state()
        e = s.draw.exponential(0.5, s.x.shape)
        drift = s.draw.uniform(-1, 1, (size, 1)) / spread * e * np.abs(staff - s.x)
        pull = s.draw.exponential(0.5, (size, 1)) * (staff - s.x)
        before = s.y.copy()
        s.greedy(np.where(near_staff[:, None], staff + drift + pull, s.x + drift))
        near_staff = np.where(s.y < before, near_staff, ~near_staff)
        order = order_of(s)
        near_staff = near_staff[order]
        staff = sorted_state()
        patient = s.draw.rand(size) < np.arange(1, size + 1) / size
        a, b = others(s, 2)
        e = s.draw.exponential(0.5, (size, 1))
        confused = s.y[0] / (s.y[min(1, size - 1)] + s.y[min(2, size - 1)] + EPS)
        way = np.where(s.draw.rand(size, 1) < confused, s.x[a] - s.x[b], staff - s.x[a])
        s.greedy(np.where(patient[:, None], s.x + e * way, s.x))
        order = order_of(s)
        near_staff = near_staff[order]
        sorted_state()
        rank = np.arange(1, size + 1)[:, None] / size
        a, b = others(s, 2)
        s.greedy(np.where(s.draw.rand(*s.x.shape) < rank, s.x[a] + s.draw.exponential(0.5, s.x.shape) * (s.x[b] - s.x), s.x))
        s.history.append(s.fitness)
    return s.result()


#: Speeds of the three particles: smallest and largest value under the logarithm, and the weight of each.
PARTICLES = ((16_000.0, 0.25), (270_000.0, 0.5), (300_000.0, 1.0))


def cdo(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """Chernobyl disaster: everyone moves to the mean of the gradients of three kinds of particles, led by the three best (Shehadeh, 2023)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        lead = s.x[order_of(s)[:3]]
        walking = 3 - 3 * t / max(1, epochs)
        steps = []
        for k, (speed, weight) in enumerate(PARTICLES):
            log = np.log10((speed - 1) * s.draw.rand() + speed)
            r1, r2, r3 = (s.draw.rand(*s.x.shape) for _ in range(3))
            p = np.pi * r1 * r1 / (weight * log) - walking * r2
            place = lead[min(k, len(lead) - 1)]
            steps.append(weight * (place - p * np.abs(np.pi * r3 * r3 * place - s.x)))
        s.greedy(np.mean(steps, 0))
        s.history.append(s.fitness)
    return s.result()


def abc(objective, low, high, size=30, epochs=100, seed=42, start=None, limit=25) -> Result:
    """Bee colony: employed and onlooker bees try one step between two sources; a source that was tried in vain ``limit`` times is left to a scout (Karaboga, 2005)."""
    s = Search(objective, low, high, size, seed, start)
    trials = np.zeros(size, int)

    def step(who: np.ndarray) -> None:
        """One trial at each of the sources ``who``; of several at one source the best counts."""
        other = (who + s.draw.randint(1, max(2, size), len(who))) % size
        place = s.draw.randint(s.x.shape[1], size=len(who))
        new = s.x[who].copy()
        rows = np.arange(len(who))
        new[rows, place] += s.draw.uniform(-1, 1, len(who)) * (new[rows, place] - s.x[other, place])
        new = np.clip(new, low, high)
        y, before = s.f(new), s.y[who]
        s.note(new, y)
        for n in np.argsort(-y, kind="stable"):
            if y[n] < s.y[who[n]]:
                s.x[who[n]], s.y[who[n]], trials[who[n]] = new[n], y[n], 0
        trials[np.setdiff1d(who, who[y < before])] += 1

    for _ in range(epochs):
        step(np.arange(size))
        worth = np.where(s.y >= 0, 1 / (1 + np.maximum(s.y, 0)), 1 + np.abs(np.minimum(s.y, 0)))
        step(s.draw.choice(size, size, p=worth / worth.sum()))
        tired = np.flatnonzero(trials > limit)
        if len(tired):
            s.x[tired] = s.draw.uniform(low, high, (len(tired), len(low)))
            s.y[tired], trials[tired] = s.f(s.x[tired]), 0
            s.note(s.x[tired], s.y[tired])
        s.history.append(s.fitness)
    return s.result()


def bees(objective, low, high, size=30, epochs=100, seed=42, start=None, sites=0.5, elite=0.4, recruits=(2, 4), radius=0.1, shrink=0.9, patience=10) -> Result:
    """Bees: recruits look around the best sites, more of them around elite ones; a patch shrinks when nothing better is found and is abandoned in the end; all others scout (Pham et al., 2005)."""
    s = Search(objective, low, high, size, seed, start)
    patch, vain = np.full(size, radius), np.zeros(size, int)
    n_sites = max(1, round(sites * size))
    n_elite = max(1, round(elite * n_sites))
    for _ in range(epochs):
        order = order_of(s)
        s.x, s.y, patch, vain = s.x[order], s.y[order], patch[order], vain[order]
        who = np.repeat(np.arange(n_sites), np.where(np.arange(n_sites) < n_elite, recruits[1], recruits[0]))
        new = np.clip(s.x[who] + s.draw.uniform(-1, 1, (len(who), len(low))) * patch[who, None] * (high - low), low, high)
        scouts = s.draw.uniform(low, high, (size - n_sites, len(low)))
        y = s.f(np.vstack([new, scouts]))
        s.note(np.vstack([new, scouts]), y)
        near, far = y[: len(who)], y[len(who) :]
        for k in range(n_sites):
            own = np.flatnonzero(who == k)
            b = own[near[own].argmin()]
            if near[b] < s.y[k]:
                s.x[k], s.y[k], vain[k] = new[b], near[b], 0
            else:
                patch[k], vain[k] = patch[k] * shrink, vain[k] + 1
        s.x[n_sites:], s.y[n_sites:], patch[n_sites:], vain[n_sites:] = scouts, far, radius, 0
        gone = np.flatnonzero(vain[:n_sites] > patience)
        if len(gone):
            s.x[gone] = s.draw.uniform(low, high, (len(gone), len(low)))
            s.y[gone], patch[gone], vain[gone] = s.f(s.x[gone]), radius, 0
            s.note(s.x[gone], s.y[gone])
        s.history.append(s.fitness)
    return s.result()


def cross_points(draw: np.random.RandomState, one: np.ndarray, two: np.ndarray, rate: float, points: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Two children of each pair that swap every other piece between ``points`` drawn places."""
    n, d = one.shape
    cuts = np.sort(draw.randint(0, d + 1, (n, points)), axis=1)
    swap = ((np.arange(d)[None, :, None] >= cuts[:, None, :]).sum(2) % 2 == 1) & (draw.rand(n, 1) < rate)
    return np.where(swap, two, one), np.where(swap, one, two)


def multi_ga(objective, low, high, size=30, epochs=100, seed=42, start=None, rate=0.95, change=0.025, keep=1, groups=None) -> Result:
    """Genetic with crossover and mutation at many points; ``groups``: shares of the best, whose tournament gives one parent, and of the worst, which give the other."""
    s = Search(objective, low, high, size, seed, start)
    for _ in range(epochs):
        order = order_of(s)
        s.x, s.y = s.x[order], s.y[order]
        best = np.arange(size) if groups is None else np.arange(max(1, int(groups[0] * size)))
        worst = np.arange(size) if groups is None else np.arange(size - max(1, int(groups[1] * size)), size)
        half = (size + 1) // 2
        pick = lambda pool, half=half: pool[s.draw.randint(len(pool), size=(2, half))].min(0)  # noqa: E731  (places are in the order of fitness)
        a, b = cross_points(s.draw, s.x[pick(best)], s.x[pick(worst)], rate)
        child = np.vstack([a, b])[:size]
        child = np.where(s.draw.rand(*child.shape) < change, s.draw.uniform(low, high, child.shape), child)
        y = s.f(child := np.clip(child, low, high))
        s.note(child, y)
        keepers = max(keep, len(best)) if groups is not None else keep
        every, light = np.vstack([s.x[:keepers], child]), np.append(s.y[:keepers], y)
        order = np.argsort(light, kind="stable")[:size]
        s.x, s.y = every[order], light[order]
        s.history.append(s.fitness)
    return s.result()


def elite_multi_ga(objective, low, high, size=30, epochs=100, seed=42, start=None) -> Result:
    """The best tenth stays and gives one parent, the worst three tenths the other."""
    return multi_ga(objective, low, high, size, epochs, seed, start, groups=(0.1, 0.3))


def ga_hho(objective, low, high, size=30, epochs=100, seed=42, start=None, rate=0.8, change=0.05) -> Result:
    """Hawks with crossover and mutation inside each generation: a hawk step, then children of neighbours in the order of fitness; both kept where better."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        s.greedy(hho_step(s, t, epochs))
        order = order_of(s)
        s.x, s.y = s.x[order], s.y[order]
        child, _ = cross_points(s.draw, s.x, np.roll(s.x, 1, axis=0), rate)
        s.greedy(np.where(s.draw.rand(*child.shape) < change, s.draw.uniform(low, high, child.shape), child))
        s.history.append(s.fitness)
    return s.result()


def ssa_dev(objective, low, high, size=30, epochs=100, seed=42, start=None, safe=0.8, lead=0.2, scouts=0.1) -> Result:
    """Sparrows in the developer's variant: producers grow by an exponential that is cut at 5, scroungers go to the best by normal steps, scouts flee from the worst."""
    s = Search(objective, low, high, size, seed, start)
    for _ in range(epochs):
        order = order_of(s)
        s.x, s.y = s.x[order], s.y[order]
        n1, new = max(1, int(lead * size)), s.x.copy()
        place = np.arange(1, size + 1)[:, None]
        if s.draw.rand() < safe:
            grow = np.exp(np.minimum(place[:n1] / ((s.draw.rand(n1, 1) + EPS) * epochs), 700))
            new[:n1] = s.x[:n1] * np.where(grow > 5, s.draw.normal(0, 1, (n1, 1)), grow)
        else:
            new[:n1] = s.x[:n1] + s.draw.normal(0, 1, (n1, s.x.shape[1]))
        hungry = s.draw.normal(0, 1, (size, 1)) * np.exp(np.clip((s.x[-1] - s.x) / place**2, -700, 700))
        follow = s.best + np.abs(s.x - s.best) * s.draw.normal(0, 1, (size, 1))
        rest = np.arange(n1, size)
        new[rest] = np.where(place[rest] > size / 2, hungry[rest], follow[rest])
        who = s.draw.permutation(size)[: max(1, int(scouts * size))]
        flee = s.x[who] + s.draw.uniform(-1, 1, (len(who), 1)) * np.abs(s.x[who] - s.x[-1]) / (s.y[who] - s.y[-1] + (s.y[who] == s.y[-1]) * EPS + EPS)[:, None]
        new[who] = np.where((s.y[who] > s.fitness)[:, None], s.best + s.draw.normal(0, 1, (len(who), 1)) * np.abs(s.x[who] - s.best), flee)
        s.greedy(new)
        s.history.append(s.fitness)
    return s.result()


def bat(objective, low, high, size=30, epochs=100, seed=42, start=None, loudness=0.8, pulse=0.95, span=(0.0, 2.0), cool=0.97, learn=0.05, step=0.1) -> Result:
    """Bats: velocities towards the best by drawn frequencies, walks around it; loudness falls and pulses grow with success (Yang, 2010)."""
    s = Search(objective, low, high, size, seed, start)
    v, loud, rate = np.zeros_like(s.x), np.full(size, loudness), np.zeros(size)
    for t in range(epochs):
        v = v + (s.best - s.x) * s.draw.uniform(*span, (size, 1))
        walk = s.best + step * s.draw.uniform(-1, 1, s.x.shape) * (high - low) * loud.mean()
        new = np.clip(np.where((s.draw.rand(size) > rate)[:, None], walk, s.x + v), low, high)
        y = s.f(new)
        s.note(new, y)
        taken = (y < s.y) & (s.draw.rand(size) < loud)
        s.x[taken], s.y[taken] = new[taken], y[taken]
        loud[taken], rate[taken] = loud[taken] * cool, pulse * (1 - np.exp(-learn * (t + 1)))
        s.history.append(s.fitness)
    return s.result()


def slime(objective, low, high, size=30, epochs=100, seed=42, start=None, lost=0.03) -> Result:
    """Slime mould: weights by smell, contraction towards the best, and a small share that starts anew (Li et al., 2020)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        order = order_of(s)
        s.x, s.y = s.x[order], s.y[order]
        smell = s.draw.rand(*s.x.shape) * np.log10((s.y - s.y[0]) / (s.y[-1] - s.y[0] + EPS) + 1)[:, None]
        weight = np.where(np.arange(size)[:, None] <= size / 2, 1 + smell, 1 - smell)
        done = (t + 1) / max(1, epochs)
        a = np.arctanh(np.clip(1 - done + EPS, -1 + 1e-9, 1 - 1e-9))
        p = np.tanh(np.abs(s.y - s.fitness))[:, None]
        one, two = others(s, 2)
        near = s.best + s.draw.uniform(-a, a, s.x.shape) * (weight * s.x[one] - s.x[two])
        new = np.where(s.draw.rand(*s.x.shape) < p, near, s.draw.uniform(-1, 1, s.x.shape) * (1 - done) * s.x)
        s.greedy(np.where(s.draw.rand(size, 1) < lost, s.draw.uniform(low, high, s.x.shape), new))
        s.history.append(s.fitness)
    return s.result()


def tuna(objective, low, high, size=30, epochs=100, seed=42, start=None, follow=0.7, lost=0.05) -> Result:
    """Tuna: a spiral after the best or a drawn place, or a parabola around the best (Xie et al., 2021)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(1, epochs + 1):
        done = t / epochs
        a1, a2, bend = follow + (1 - follow) * done, (1 - follow) * (1 - done), (1 - done) ** done
        b = s.draw.rand(size, 1)
        beta = np.exp(b * np.exp(3 * np.cos(((epochs + 1 / t) - 1) * np.pi))) * np.cos(2 * np.pi * b)
        goal = np.where(s.draw.rand(size, 1) < done, s.best, s.draw.uniform(low, high, s.x.shape))
        spiral = a1 * (goal + beta * np.abs(goal - s.x)) + a2 * np.vstack([s.x[:1], s.x[:-1]])
        sign = np.where(s.draw.rand(size, 1) < 0.5, 1.0, -1.0)
        arc = np.where(s.draw.rand(size, 1) < 0.5, s.best + s.draw.rand(size, 1) * (s.best - s.x) + sign * bend**2 * (s.best - s.x), sign * bend**2 * s.x)
        new = np.where(s.draw.rand(size, 1) < 0.5, spiral, arc)
        s.greedy(np.where(s.draw.rand(size, 1) < lost, s.draw.uniform(low, high, s.x.shape), new))
        s.history.append(s.fitness)
    return s.result()


def circle(objective, low, high, size=30, epochs=100, seed=42, start=None, change=0.8) -> Result:
    """Circle search: the tangent of an angle that closes carries a point around the best (Qais et al., 2022)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        done = (t + 1) / max(1, epochs)
        a = np.pi - np.pi * done**2
        w = a * s.draw.rand(size, 1) - a
        angle = w * (s.draw.rand(size, 1) if done > change else 1 - 0.9 * done**0.5)
        s.greedy(s.best + (s.best - s.x) * np.tan(angle))
        s.history.append(s.fitness)
    return s.result()


def eagle(objective, low, high, size=30, epochs=100, seed=42, start=None, wide=10.0, turns=1.5, near=2.0, c1=2.0, c2=2.0) -> Result:
    """Bald eagles: choose a place, search it in a spiral, swoop down (Alsattar et al., 2020)."""
    s = Search(objective, low, high, size, seed, start)

    def spiral(sine, cosine, growing: float) -> tuple[np.ndarray, np.ndarray]:
        angle = wide * np.pi * s.draw.rand(size)
        far = angle + growing * s.draw.rand(size)
        x, y = far * sine(angle), far * cosine(angle)
        return (x / (np.abs(x).max() + EPS))[:, None], (y / (np.abs(y).max() + EPS))[:, None]

    for _ in range(epochs):
        s.greedy(s.best + near * s.draw.rand(size, 1) * (s.x.mean(0) - s.x))
        x, y = spiral(np.sin, np.cos, turns)
        s.greedy(s.x + y * (s.x - np.roll(s.x, -1, axis=0)) + x * (s.x - s.x.mean(0)))
        x, y = spiral(np.sinh, np.cosh, 0.0)
        s.greedy(s.draw.rand(size, 1) * s.best + x * (s.x - c1 * s.x.mean(0)) + y * (s.x - c2 * s.best))
        s.history.append(s.fitness)
    return s.result()


def gorilla(objective, low, high, size=30, epochs=100, seed=42, start=None, lost=0.03, calm=0.8, beta=3.0) -> Result:
    """Gorilla troops: wander, move to another gorilla or to a known place; then follow the silverback, or compete for females (Abdollahzadeh et al., 2021)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        c = (np.cos(2 * s.draw.rand()) + 1) * (1 - (t + 1) / max(1, epochs))
        reach = c * s.draw.uniform(-1, 1, (size, 1))
        one, two = others(s, 2)
        migrate = (s.draw.rand(size, 1) - c) * s.x[one] + reach * s.draw.uniform(-c, c, s.x.shape) * s.x
        away = s.x - s.x[two]
        known = s.x - reach * (reach * away + s.draw.rand(size, 1) * away)
        new = np.where(s.draw.rand(size, 1) >= 0.5, migrate, known)
        s.greedy(np.where(s.draw.rand(size, 1) < lost, s.draw.uniform(low, high, s.x.shape), new))
        if c >= calm:
            # the publication's (|mean| ** g) ** (1 / g) is |mean| for every g
            s.greedy(reach * np.abs(s.x.mean(0)) * (s.x - s.best) + s.x)
        else:
            violence = np.where(s.draw.rand(size, 1) >= 0.5, s.draw.normal(0, 1, s.x.shape), s.draw.normal(0, 1, (size, 1)))
            s.greedy(s.best - (2 * s.draw.rand(size, 1) - 1) * (s.best - s.x) * beta * violence)
        s.history.append(s.fitness)
    return s.result()


def vulture(objective, low, high, size=30, epochs=100, seed=42, start=None, p1=0.6, p2=0.4, p3=0.6, alpha=0.8, gamma=2.5) -> Result:
    """African vultures: the hungrier, the nearer to one of the two best; sated ones explore, others circle, besiege or fly by Levy steps (Abdollahzadeh et al., 2021)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(epochs):
        done = (t + 1) / max(1, epochs)
        shake = s.draw.uniform(-2, 2, (size, 1)) * (np.sin(np.pi / 2 * done) ** gamma + np.cos(np.pi / 2 * done) - 1)
        f = (2 * s.draw.rand(size, 1) + 1) * s.draw.uniform(-1, 1, (size, 1)) * (1 - done) + shake
        first, second = s.x[order_of(s)[[0, min(1, size - 1)]]]
        lead = np.where(s.draw.rand(size, 1) < alpha, first, second)
        d = np.abs(2 * s.draw.rand(size, 1) * lead - s.x)
        far = np.where(s.draw.rand(size, 1) < p1, lead - d * f, lead - f + s.draw.rand(size, 1) * ((high - low) * s.draw.rand(size, 1) + low))
        circles = lead - lead * s.x / (2 * np.pi) * (s.draw.rand(size, 1) * np.cos(s.x) + s.draw.rand(size, 1) * np.sin(s.x))
        near = np.where(s.draw.rand(size, 1) < p2, d * (f + s.draw.rand(size, 1)) - (lead - s.x), circles)
        siege = np.mean([v - v * s.x / nonzero(v - s.x**2) * f for v in (first, second)], 0)
        close = np.where(s.draw.rand(size, 1) < p3, siege, lead - np.abs(lead - s.x) * f * levy(s.draw, s.x.shape))
        s.greedy(np.where(np.abs(f) >= 1, far, np.where(np.abs(f) >= 0.5, near, close)))
        s.history.append(s.fitness)
    return s.result()


def levy(draw: np.random.RandomState, shape: tuple[int, ...], b: float = 1.5) -> np.ndarray:
    """Steps of a Levy flight by Mantegna's quotient of normals."""
    sigma = (gamma_of(1 + b) * np.sin(np.pi * b / 2) / (gamma_of((1 + b) / 2) * b * 2 ** ((b - 1) / 2))) ** (1 / b)
    u, v = draw.normal(0, sigma, shape), draw.normal(0, 1, shape)
    return 0.01 * u / (np.abs(v) + EPS) ** (1 / b)


def nonzero(x: np.ndarray) -> np.ndarray:
    """``x`` with zeros moved away from zero, to divide by."""
    return np.where(np.abs(x) < EPS, EPS, x)


def tug_of_war(objective, low, high, size=30, epochs=100, seed=42, start=None, still=1.0, moving=1.0, dt=1.0, alpha=0.99, beta=0.1) -> Result:
    """Tug of war: every heavier team pulls a lighter one by what its force exceeds friction; noise shrinks, and half of the components out of bounds go near the best (Kaveh and Zolghadr, 2016)."""
    s = Search(objective, low, high, size, seed, start)
    for t in range(1, epochs + 1):
        weight = (s.y - s.y.max()) / nonzero(s.y.min() - s.y.max()) + 1
        move = np.zeros_like(s.x)
        for j in range(size):
            pulled = weight < weight[j]
            force = np.maximum(weight, weight[j]) * still - weight * moving
            step = 0.5 * (force / (weight * moving))[:, None] * (s.x[j] - s.x) * dt**2
            noise = alpha**t * beta * (high - low) * s.draw.normal(0, 1, s.x.shape)
            move += np.where(pulled[:, None], step + noise, 0.0)
        new = s.x + move
        beyond = ((new < low) | (new > high)) & (s.draw.rand(*s.x.shape) < 0.5)
        s.greedy(np.where(beyond, s.best + s.draw.normal(0, 1, s.x.shape) / t * (s.best - new), new))
        s.history.append(s.fitness)
    return s.result()


SINGLE |= {
    "HGS": hgs, "QSA": qsa, "CDO": cdo, "ABC": abc, "BEESA": bees, "MULTIGA": multi_ga, "ELITEMULTIGA": elite_multi_ga, "GAHHO": ga_hho, "SSA-DEV": ssa_dev,
    "BA": bat, "SMA": slime, "TSO": tuna, "CIRCLESA": circle, "BES": eagle,
    "AGTO": gorilla, "AVOA": vulture, "TWO": tug_of_war,
}
