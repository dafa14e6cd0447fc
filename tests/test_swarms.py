"""Searches: bounds, improvement, first generations by hand, and labels that run what they name."""

import numpy as np
import pytest

from tastemill.operators import search, swarms
from tastemill.plans import assignments

LOW, HIGH = np.full(4, -3.0), np.full(4, 5.0)
NAMES = ["HGS", "QSA", "CDO", "ABC", "BEESA", "MULTIGA", "ELITEMULTIGA", "GAHHO", "SSA-DEV", "BA", "SMA", "TSO", "CIRCLESA", "BES", "AGTO", "AVOA", "TWO"]


def bowl(p):
    assert ((p >= LOW - 1e-12) & (p <= HIGH + 1e-12)).all()
    return ((p - 1.5) ** 2).sum(1)


@pytest.mark.parametrize("name", NAMES)
def test_bounds_and_improvement(name):
    r = search.get_optimizer(name)(bowl, LOW, HIGH, 12, 40, 3)
    assert len(r.history) == 41 and (np.diff(r.history) <= 0).all() and r.fitness == r.history[-1] < 0.5 * r.history[0]
    assert abs(bowl(r.best[None])[0] - r.fitness) < 1e-12
    again = search.get_optimizer(name)(bowl, LOW, HIGH, 12, 40, 3)
    assert (again.best == r.best).all()
    flat = search.get_optimizer(name)(lambda p: np.full(len(p), 2.0), LOW, HIGH, 5, 3, 1)
    assert flat.fitness == 2.0
    one = search.get_optimizer(name)(bowl, LOW, HIGH, 4, 2, 1, np.full((9, 4), 1.5))
    assert one.fitness == 0


def start_of(seed, size):
    draw = np.random.RandomState(seed)
    return draw, draw.uniform(LOW, HIGH, (size, 4))


def test_hunger_by_hand():
    size, draw_x = 5, start_of(7, 5)
    draw, x = draw_x
    y = bowl(x)
    r = draw.rand(7, size)
    hunger = [0.0 if y[i] == y.min() else max(0.0, 0.0) + ((y[i] - y.min()) / (y.max() - y.min() + 1e-12) * r[0, i] * 16 if (y[i] - y.min()) / (y.max() - y.min() + 1e-12) * r[0, i] * 16 >= 2.0 else 2.0 * (1 + r[1, i])) for i in range(size)]
    reach = draw.rand(size, 4)
    noise = draw.normal(0, 1, (size, 1))
    shrink = 2 * (1 - 1 / 3)
    new = []
    for i in range(size):
        w1 = hunger[i] * size / (sum(hunger) + 1e-12) * r[3, i] if r[2, i] < 0.5 else 1.0
        w2 = (1 - np.exp(-abs(hunger[i] - sum(hunger)))) * r[4, i] * 2
        pull = (2 * shrink * reach[i] - shrink) * w2 * np.abs(x[y.argmin()] - x[i])
        led = w1 * x[y.argmin()] + (pull if r[5, i] > 1 / np.cosh(abs(y[i] - y.min())) else -pull)
        one = np.clip(x[i] * (1 + noise[i]) if r[6, i] < 0.5 else led, LOW, HIGH)
        new.append(one if bowl(one[None])[0] < y[i] else x[i])
    got = swarms.hgs(bowl, LOW, HIGH, size, 3, 7, alone=0.5, least_hunger=2.0)
    first = []
    swarms.hgs(lambda p: first.append(p.copy()) or bowl(p), LOW, HIGH, size, 3, 7, alone=0.5, least_hunger=2.0)
    tried = first[1]
    kept = np.where((bowl(tried) < y)[:, None], tried, x)
    assert np.allclose(kept, new) and got.history[1] == pytest.approx(min(bowl(np.array(new)).min(), y.min()))


def test_disaster_by_hand():
    size = 4
    draw, x = start_of(2, size)
    y = bowl(x)
    lead = x[np.argsort(y)[:3]]
    steps = []
    for k, (speed, weight) in enumerate(swarms.PARTICLES):
        log = np.log10((speed - 1) * draw.rand() + speed)
        r1, r2, r3 = draw.rand(size, 4), draw.rand(size, 4), draw.rand(size, 4)
        steps.append([[weight * (lead[k][j] - (np.pi * r1[i, j] ** 2 / (weight * log) - 3 * r2[i, j]) * abs(np.pi * r3[i, j] ** 2 * lead[k][j] - x[i, j])) for j in range(4)] for i in range(size)])
    seen = []
    swarms.cdo(lambda p: seen.append(p.copy()) or bowl(p), LOW, HIGH, size, 1, 2)
    assert np.allclose(seen[1], np.clip(np.mean(steps, 0), LOW, HIGH))


def test_bee_colony_by_hand_and_scouts():
    size = 4
    draw, x = start_of(9, size)
    y = bowl(x)
    other = (np.arange(size) + draw.randint(1, size, size)) % size
    place = draw.randint(4, size=size)
    phi = draw.uniform(-1, 1, size)
    new = x.copy()
    for i in range(size):
        new[i, place[i]] += phi[i] * (x[i, place[i]] - x[other[i], place[i]])
    seen = []
    swarms.abc(lambda p: seen.append(p.copy()) or bowl(p), LOW, HIGH, size, 1, 9)
    assert np.allclose(seen[1], np.clip(new, LOW, HIGH)) and (other != np.arange(size)).all()
    calls = []
    swarms.abc(lambda p: calls.append(len(p)) or np.full(len(p), 1.0), LOW, HIGH, size, 6, 9, limit=2)
    assert len(calls) > 1 + 2 * 6  # nothing gets better, so sources are left to scouts
    assert y.min() <= bowl(np.array([[9.0] * 4]).clip(LOW, HIGH)).max()


def generation(search_, size, seed, epochs=1, which=1, **more):
    """The start and a generation as it was scored."""
    seen = []
    search_(lambda p: seen.append(p.copy()) or bowl(p), LOW, HIGH, size, epochs, seed, **more)
    return seen[0], seen[which]


def test_gorillas_by_hand():
    size, seed, epochs = 5, 4, 3
    draw, x = start_of(seed, size)
    c = (np.cos(2 * draw.rand()) + 1) * (1 - 1 / epochs)
    reach, mates = c * draw.uniform(-1, 1, (size, 1)), draw.randint(size, size=(2, size))
    r2, z, r3, turn = draw.rand(size, 1), draw.uniform(-c, c, (size, 4)), draw.rand(size, 1), draw.rand(size, 1)
    new = []
    for i in range(size):
        if turn[i] >= 0.5:
            one = (r2[i] - c) * x[mates[0, i]] + reach[i] * z[i] * x[i]
        else:
            away = x[i] - x[mates[1, i]]
            one = x[i] - reach[i] * (reach[i] * away + r3[i] * away)
        new.append(np.clip(one, LOW, HIGH))
    begun, tried = generation(swarms.gorilla, size, seed, epochs, lost=0.0)
    assert np.allclose(begun, x) and np.allclose(tried, new)
    # then, as ``calm`` is below the troop's energy, all follow the silverback
    kept = np.where((bowl(tried) < bowl(x))[:, None], tried, x)
    best = kept[bowl(kept).argmin()]
    _, after = generation(swarms.gorilla, size, seed, epochs, which=2, lost=0.0, calm=-1.0)
    expected = reach * np.abs(kept.mean(0)) * (kept - best) + kept
    assert np.allclose(after, np.clip(expected, LOW, HIGH))


def test_vultures_by_hand():
    size, seed, epochs = 6, 8, 4
    draw, x = start_of(seed, size)
    y, done = bowl(x), 1 / epochs
    shake = draw.uniform(-2, 2, (size, 1)) * (np.sin(np.pi / 2 * done) ** 2.5 + np.cos(np.pi / 2 * done) - 1)
    r, z = draw.rand(size, 1), draw.uniform(-1, 1, (size, 1))
    f = (2 * r + 1) * z * (1 - done) + shake
    first, second = x[np.argsort(y)[:2]]
    lead = np.where(draw.rand(size, 1) < 0.8, first, second)
    sway, p1, r2, r3 = draw.rand(size, 1), draw.rand(size, 1), draw.rand(size, 1), draw.rand(size, 1)
    r5, r6, p2, r4 = draw.rand(size, 1), draw.rand(size, 1), draw.rand(size, 1), draw.rand(size, 1)
    p3 = draw.rand(size, 1)
    flight = swarms.levy(draw, (size, 4))
    new = []
    for i in range(size):
        d, gap = np.abs(2 * sway[i] * lead[i] - x[i]), lead[i] - x[i]
        if abs(f[i, 0]) >= 1:
            one = lead[i] - d * f[i] if p1[i] < 0.6 else lead[i] - f[i] + r2[i] * ((HIGH - LOW) * r3[i] + LOW)
        elif abs(f[i, 0]) >= 0.5:
            s1, s2 = lead[i] * (r5[i] * x[i] / (2 * np.pi)) * np.cos(x[i]), lead[i] * (r6[i] * x[i] / (2 * np.pi)) * np.sin(x[i])
            one = d * (f[i] + r4[i]) - gap if p2[i] < 0.4 else lead[i] - (s1 + s2)
        elif p3[i] < 0.6:
            one = (first - first * x[i] / (first - x[i] ** 2) * f[i] + second - second * x[i] / (second - x[i] ** 2) * f[i]) / 2
        else:
            one = lead[i] - np.abs(gap) * f[i] * flight[i]
        new.append(np.clip(one, LOW, HIGH))
    assert len({abs(v) >= 1 for v in f[:, 0]} | {abs(v) >= 0.5 for v in f[:, 0]}) == 2
    begun, tried = generation(swarms.vulture, size, seed, epochs)
    assert np.allclose(begun, x) and np.allclose(tried, new)


def test_tug_of_war_by_hand():
    size, seed = 4, 6
    draw, x = start_of(seed, size)
    y = bowl(x)
    weight = (y - y.max()) / (y.min() - y.max()) + 1
    assert weight.min() == 1 and weight.max() == 2
    new = x.copy()
    for j in range(size):
        noise = draw.normal(0, 1, (size, 4))
        for i in range(size):
            if weight[i] < weight[j]:
                force = max(weight[i], weight[j]) - weight[i]
                new[i] += 0.5 * force / weight[i] * (x[j] - x[i]) + 0.99 * 0.1 * 8 * noise[i]
    beyond = ((new < LOW) | (new > HIGH)) & (draw.rand(size, 4) < 0.5)
    near = x[y.argmin()] + draw.normal(0, 1, (size, 4)) * (x[y.argmin()] - new)
    begun, tried = generation(swarms.tug_of_war, size, seed)
    assert np.allclose(begun, x) and np.allclose(tried, np.clip(np.where(beyond, near, new), LOW, HIGH))
    assert (tried[y.argmin()] == x[y.argmin()]).all()  # the heaviest team is pulled by none


def test_queues_and_crossover():
    assert swarms.queues(np.array([1.0, 1.0, 2.0, 9.0]), 10).tolist() == [0] * 4 + [1] * 4 + [2] * 2
    assert swarms.queues(np.array([0.0, 1.0, 2.0]), 9).tolist() == [0] * 3 + [1] * 3 + [2] * 3
    a, b = np.zeros((50, 9)), np.ones((50, 9))
    one, two = swarms.cross_points(np.random.RandomState(1), a, b, 1.0)
    assert (one + two == 1).all() and 0 < one.mean() < 1 and (np.abs(np.diff(one, axis=1)).sum(1) <= 3).all()
    assert (swarms.cross_points(np.random.RandomState(1), a, b, 0.0)[0] == 0).all()


def test_labels_run_what_they_name():
    assert len(assignments.ALGORITHMS) == 15 and len(assignments.SCREENED) == 19
    for name in [*assignments.ALGORITHMS.values(), *assignments.SCREENED]:
        if name != "KMEANS":
            r = search.get_optimizer(name)(bowl, LOW, HIGH, 6, 4, 5)
            assert r.fitness <= r.history[0]
    assert assignments.ALGORITHMS["LIT_SSA"] == "SSA-DEV" and assignments.ALGORITHMS["H5_EliteGA+HHO"].startswith("ELITE")
    assert assignments.choose(["hgs", "H9_QSA+CDO", "gahho"]) == ["B2_HGS", "H9_QSA+CDO", "H5_GAHHO"]
