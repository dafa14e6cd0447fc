"""Pairs of users by blocks of their vectors, where most pairs share an item.

A join on items makes a row for each common item of each pair and shuffles partial
sums of all pairs. If pairs share an item or more on average, that is more than the
pairs themselves. Here the vectors travel instead: products of two blocks of users
give all six co-rating sums of their pairs inside a task, and what is asked of them
(k neighbours of a target) is kept there too, so no pair is shuffled. A task holds
a block of users and streams the others past it, in pieces that are bounded in users
times items. Ids are whole numbers; vectors have finite values (``kernels`` looks first).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Users of a block, of a piece of the left side, and the cells of a dense piece.
USERS, PIECE, CELLS = 4_096, 128, 4_000_000
#: Users of the right side whose sums with a piece stay in a core's cache, and those that pass by first, so that later ones have k best to beat.
TILE, FIRST = 512, 512
#: Targets (user, item) whose neighbours a task keeps at most (one user's all go together), and the tasks there should be at least.
TARGETS, TASKS = 200_000, 64
MOST_TASKS = 20_000


def vectors(cells: DataFrame) -> DataFrame:
    """_g, user_id, items, vals of cells (_g, user_id, item_id, x)."""
    got = cells.where("_g IS NOT NULL AND user_id IS NOT NULL AND item_id IS NOT NULL").groupBy("_g", "user_id").agg(F.collect_list(F.struct(F.col("item_id").cast("long").alias("i"), F.col("x").cast("double").alias("x"))).alias("_c"))
    return got.select("_g", "user_id", F.col("_c.i").alias("items"), F.col("_c.x").alias("vals"))


class Side:
    """Users of one side, rising ids: ids, first place of each vector, items, values."""

    def __init__(self, ids, lens, items, vals):
        import numpy as np

        self.ids, self.items, self.vals = ids, items, vals
        self.start = np.concatenate([[0], np.cumsum(lens)])
        self.rows = np.repeat(np.arange(len(ids)), lens)

    def part(self, lo: int, hi: int) -> Side:
        import numpy as np

        a, b = self.start[lo], self.start[min(hi, len(self.ids))]
        return Side(self.ids[lo:hi], np.diff(self.start[lo : hi + 1]), self.items[a:b], self.vals[a:b])

    def mean(self):
        import numpy as np

        n = len(self.ids)
        return np.bincount(self.rows, self.vals, n) / np.maximum(np.bincount(self.rows, minlength=n), 1)

    def squares(self):
        import numpy as np

        return np.bincount(self.rows, self.vals * self.vals, len(self.ids))

    def less(self, own) -> Side:
        """The same with ``own`` of each user taken off."""
        import numpy as np

        return Side(self.ids, np.diff(self.start), self.items, self.vals - own[self.rows])

    def dense(self, known):
        """Counts, sums and sums of squares of users x ``known`` items (sorted)."""
        import numpy as np

        n, w = len(self.ids), len(known)
        if not w or not len(self.items):
            return np.zeros((n, w)), np.zeros((n, w)), np.zeros((n, w))
        at = np.minimum(np.searchsorted(known, self.items), w - 1)
        hit = known[at] == self.items
        place, x = self.rows[hit] * w + at[hit], self.vals[hit]
        return tuple(np.bincount(place, y, n * w).reshape(n, w).astype(float) for y in (None, x, x * x))


def side_of(batches: list) -> Side:
    """Arrow rows (user_id, items, vals) as a side."""
    import numpy as np
    import pyarrow as pa

    t = pa.Table.from_batches(batches)
    lists = t.column("items").combine_chunks(), t.column("vals").combine_chunks()
    lens = np.asarray(lists[0].value_lengths().fill_null(0)).astype(np.int64)
    return Side(t.column("user_id").to_numpy(), lens, np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten(), float))


def six(left: tuple, right: tuple):
    """n, sx, sy, sxy, sxx, syy of all pairs of two dense pieces."""
    (m, x, q), (o, y, r) = left, right
    return m @ o.T, x @ o.T, m @ y.T, x @ y.T, q @ o.T, m @ r.T


def runs(batches: Iterator, keys: list[str]) -> Iterator[tuple[tuple, object]]:
    """(key, slice of a batch) for each run of rows with the same keys."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield tuple(c[lo] for c in cols), b.slice(lo, hi - lo)


def tasks(n: int) -> int:
    return int(min(MOST_TASKS, max(1, n)))


SUMS = "u long, v long, n long, sx double, sy double, sxy double, sxx double, syy double, qx double, qy double"


def block_sums(cells: DataFrame, sizes: DataFrame, n_groups: int, n_users: int) -> DataFrame:
    """u < v with n, sx, sy, sxy, sxx, syy, and each side's own sum of squares (qx, qy), of pairs of a group that share an item.

    ``sizes`` has _g and _users. A user's vector goes to as many tasks as its group has blocks; pairs leave a task once, as results.
    """
    parts = F.ceil(F.col("_users") / F.least(F.lit(USERS), F.greatest(F.lit(256), F.ceil(F.col("_users") / 8)))).cast("int")
    own = vectors(cells).join(sizes.select("_g", parts.alias("_parts")), "_g")
    own = own.withColumn("_b", F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    met = own.select("_g", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).cast("int").alias("_side"), "user_id", "items", "vals")
    blocks = n_users // USERS + 1
    n = tasks(max(8 * n_groups, blocks * (blocks + 1) // 2))

    def products(left: Side, right: Side | None):
        import numpy as np
        import pyarrow as pa

        same = right is None
        right = left if same else right
        known = np.intersect1d(left.items, right.items)
        wide = max(1, CELLS // max(1, len(right.ids)))
        slabs = [known[lo : lo + wide] for lo in range(0, len(known), wide)]
        kept = [right.dense(slabs[0])] if len(slabs) == 1 else None
        ql, qr = left.squares(), right.squares()
        for lo in range(0, len(left.ids), PIECE):
            piece = left.part(lo, lo + PIECE)
            total = None
            for s, slab in enumerate(slabs):
                one = six(piece.dense(slab), kept[s] if kept else right.dense(slab))
                total = one if total is None else tuple(a + b for a, b in zip(total, one, strict=True))
            if total is None:
                continue
            hit = total[0] > 0
            if same:  # ids rise, so a pair is seen once
                hit &= np.arange(len(right.ids))[None, :] > lo + np.arange(len(piece.ids))[:, None]
            a, b = np.nonzero(hit)
            cnt, sx, sy, sxy, sxx, syy = (t[a, b] for t in total)
            u, v, qx, qy = piece.ids[a], right.ids[b], ql[lo + a], qr[b]
            turn = u > v
            pick = lambda p, q: (np.where(turn, q, p), np.where(turn, p, q))  # noqa: E731, B023
            (u, v), (sx, sy), (sxx, syy), (qx, qy) = pick(u, v), pick(sx, sy), pick(sxx, syy), pick(qx, qy)
            cols = {"u": u.astype(np.int64), "v": v.astype(np.int64), "n": np.rint(cnt).astype(np.int64), "sx": sx, "sy": sy, "sxy": sxy, "sxx": sxx, "syy": syy, "qx": qx, "qy": qy}
            yield pa.RecordBatch.from_pydict({k: pa.array(c) for k, c in cols.items()})

    def work(batches):
        now, held = None, ([], [])

        def done():
            if held[0] and (held[1] or now[1] == now[2]):
                yield from products(side_of(held[0]), side_of(held[1]) if held[1] else None)

        for (*key, side), rows in runs(batches, ["_g", "_i", "_j", "_side"]):
            if now is not None and key != now:
                yield from done()
                held = ([], [])
            now = key
            held[int(side)].append(rows)
        if now is not None:
            yield from done()

    return met.repartition(n, "_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", "_side", "user_id").mapInArrow(work, SUMS)


def small_whole(side: Side, counts) -> bool:
    """Whole values, so few and small that numbers of 32 bits hold what Pearson's terms are made of exactly; no item twice (``counts``: dense)."""
    import numpy as np

    if not len(side.vals):
        return True
    most = int(np.diff(side.start).max()) * float(np.abs(side.vals).max())
    return most * most < 1 << 24 and bool((side.vals == np.rint(side.vals)).all()) and (not counts.size or counts.max() <= 1)


def may_beat(left: tuple, right: tuple, low):
    """(rows, columns, six sums) of the pairs of two dense pieces whose |Pearson's r| in millionths may reach ``low`` of their row; those without variance too.

    Squares are compared, with more slack than rounding needs, so most pairs cost neither root, quotient nor key; the caller looks at the rest exactly.
    """
    import numpy as np

    kind = left[0].dtype
    least = (np.maximum(low - 2, 0) * 1e-6) ** 2 * (1 - (1e-5 if kind == np.float32 else 1e-9))
    least = least.astype(kind)[:, None]
    found = []
    for at in range(0, len(right[0]), TILE):
        sums = six(left, tuple(x[at : at + TILE] for x in right))
        n, sx, sy, sxy, sxx, syy = sums
        up = n * sxy
        up -= sx * sy
        up *= up
        down = n * sxx
        down -= sx * sx
        other = n * syy
        other -= sy * sy
        down *= other
        down *= least
        r, c = np.nonzero(up >= down)
        found.append((r, c + at, *(x[r, c] for x in sums)))
    rows, cols, *sums = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, cols, tuple(x.astype(float) for x in sums)


def similarity(kernel: str, s: tuple):
    """The similarities of ``kernels`` and ``neighbours`` from the six sums."""
    import numpy as np

    n, sx, sy, sxy, sxx, syy = s
    if kernel in ("pearson", "pearson_zero"):
        low = -1.0 if kernel == "pearson" else 0.0
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        ok = (n >= 2) & (spread > 0)
        r = (n * sxy - sx * sy) / np.sqrt(np.where(ok, spread, 1.0))
        return np.where(ok, r if kernel == "pearson" else np.clip(r, -1.0, 1.0), low)
    if kernel in ("global_mean", "cosine"):
        norm = np.sqrt(np.maximum(sxx, 0.0)) * np.sqrt(np.maximum(syy, 0.0))
        ok = (n >= 3) & (norm > 1e-8)
        return np.where(ok, np.clip(sxy / np.where(ok, norm, 1.0), -1.0 if kernel == "global_mean" else 0.0, 1.0), 0.0)
    raise ValueError(f"unknown kernel: {kernel}")


class Kept:
    """The k best of each target so far, by key: |similarity| at six digits, then the earlier rater (raters come by rising id)."""

    def __init__(self, n: int, k: int, kind: type = float):
        import numpy as np

        self.k, self.key, self.sim, self.dev = k, np.full((n, k), -1, np.int64), np.zeros((n, k)), np.zeros((n, k), kind)

    def add(self, at, key, sim, dev) -> None:
        """k candidates for each target of ``at``, a slice or places."""
        import numpy as np

        both = np.concatenate([self.key[at], key], 1)
        best = np.argpartition(-both, self.k - 1, axis=1)[:, : self.k]
        for name, new in (("sim", sim), ("dev", dev)):
            old = getattr(self, name)
            old[at] = np.take_along_axis(np.concatenate([old[at], new], 1), best, 1)
        self.key[at] = np.take_along_axis(both, best, 1)

    def in_order(self):
        import numpy as np

        order = np.argsort(-self.key, axis=1, kind="stable")
        return tuple(np.take_along_axis(x, order, 1) for x in (self.key, self.sim, self.dev))


def best_of_row(can, keys, sims, has, dev, cols, k: int, least):
    """(places, keys, similarities, deviations) of the items at ``cols`` that gain a neighbour: the at most k raters ``can`` of largest key, above ``least`` of the item, who rated it."""
    import numpy as np

    order = np.argsort(-keys)
    can, keys, sims = can[order], keys[order], sims[order]
    m = 8 * k
    while True:  # the first few hold k raters of most items
        rated = has[np.ix_(can[:m], cols)]
        if m >= len(can) or rated.sum(0).min() >= k:
            break
        m *= 4
    rated &= keys[: len(rated), None] > least
    some = np.flatnonzero(rated.any(0))
    seen = (rated := rated[:, some]).cumsum(0)
    wide = min(k, int(seen[-1].max(initial=0)))
    r, j = np.nonzero(rated & (seen <= k))
    place = seen[r, j] - 1
    out = np.full((len(some), wide), -1, np.int64), np.zeros((len(some), wide)), np.zeros((len(some), wide))
    for x, y in zip(out, (keys[r], sims[r], dev[can[r], cols[some[j]]]), strict=True):
        x[j, place] = y
    return some, *out


def meet(raters: DataFrame, asking: DataFrame, n_blocks: int, kernel: str, k: int, positive: bool, nonzero: bool, itself: bool = False) -> DataFrame:
    """user_id, item_id, up, down of each target with a neighbour: the k raters of its item of largest |similarity| (ties: smaller id).

    ``raters``: _g, _t, user_id, items, vals, in every block _t that may need them; ``asking``: the same for the users of
    the targets, each in one block, with ``asked``, its items. up is the sum of similarity times deviation from the
    rater's mean, down that of absolute similarities; ``positive``: of similarities above 0, times ratings. ``nonzero``:
    raters of similarity 0 don't count. Without ``asked`` (null) the k most similar users that share an item: user_id, item_id (the other one), up (similarity);
    ``itself``: a user is a rater of its own, too.
    """
    none = F.lit(None).cast("array<long>")
    rows = asking.select("_g", "_t", F.lit(0).alias("_side"), "user_id", "items", "vals", "asked").unionByName(raters.select("_g", "_t", F.lit(1).alias("_side"), "user_id", "items", "vals", none.alias("asked")))

    class Block:
        def __init__(self, batches):
            import numpy as np
            import pyarrow as pa

            t = pa.Table.from_batches(batches)
            side = side_of(batches)
            asked = t.column("asked").combine_chunks()
            lens = np.asarray(asked.value_lengths().fill_null(0)).astype(np.int64)
            self.free = asked.null_count == len(asked)
            self.first = np.arange(len(lens) + 1) if self.free else np.concatenate([[0], np.cumsum(lens)])
            self.item = np.asarray(asked.flatten()) if not self.free else np.zeros(0, np.int64)
            self.known = np.unique(np.concatenate([side.items, self.item]))
            self.col = np.searchsorted(self.known, self.item)
            self.ids = side.ids
            self.side = side.less(side.mean()) if kernel == "global_mean" else side
            self.kept, self.seq = Kept(int(self.first[-1]), k, int if self.free else float), 0
            self.most = int(max(32, min(USERS, CELLS // max(1, len(self.known)))))
            self.quick = kernel in ("pearson", "pearson_zero")
            self.pieces = None
            if len(self.ids) * len(self.known) <= CELLS:
                self.pieces = {lo: self.dense(lo) for lo in range(0, len(self.ids), PIECE)}

        def dense(self, lo: int) -> tuple:
            """A piece of the block, in 32 bits where that is exact."""
            import numpy as np

            piece = self.side.part(lo, lo + PIECE)
            cells = piece.dense(self.known)
            return tuple(x.astype(np.float32) for x in cells) if self.quick and small_whole(piece, cells[0]) else cells

        def parts(self, far: Side) -> Iterator[Side]:
            lo = 0
            while lo < len(far.ids):
                wide = self.most if self.seq else min(self.most, FIRST)
                yield far.part(lo, lo + wide)
                lo += wide

        def pass_by(self, far: Side) -> None:
            import numpy as np

            mean = far.mean()
            raw = far
            far = far.less(mean) if kernel == "global_mean" else far
            right = far.dense(self.known)
            has = right[0] > 0
            if positive:
                dev = raw.dense(self.known)[1]
            else:
                dev = right[1] if kernel == "global_mean" else (right[1] - right[0] * mean[:, None])
            order = (1 << 31) - 1 - (self.seq + np.arange(len(far.ids)))
            self.seq += len(far.ids)
            right = {right[0].dtype: right}
            if self.quick and small_whole(far, right[np.dtype(float)][0]):
                right[np.dtype("f4")] = tuple(x.astype("f4") for x in right[np.dtype(float)])
            for lo in range(0, len(self.ids), PIECE):
                ids = self.ids[lo : lo + PIECE]
                first = self.first[lo : lo + len(ids) + 1]
                left = self.pieces[lo] if self.pieces else self.dense(lo)
                if left[0].dtype not in right:
                    left = tuple(x.astype(float) for x in left)
                other = right[left[0].dtype]
                least = self.kept.key[first[0] : first[-1]].min(1)
                asks = np.flatnonzero(np.diff(first))
                low = np.full(len(ids), np.iinfo(np.int64).max)
                low[asks] = np.minimum.reduceat(least, first[asks] - first[0]) if len(asks) else 0
                if self.quick and (low >= 0).mean() > 0.5:
                    rows, cols, sums = may_beat(left, other, low >> 31)
                else:
                    sums = tuple(x.astype(float, copy=False) for x in six(left, other))
                    rows, cols = np.arange(len(ids))[:, None], np.arange(len(far.ids))[None, :]
                sim = similarity(kernel, sums)
                key = (np.abs(np.floor(sim * 1e6 + 0.5)).astype(np.int64) << 31) | order[cols]
                hit = (key > low[rows]) & (itself | (ids[rows] != far.ids[cols]))
                if nonzero:
                    hit &= sim != 0
                if self.free:
                    hit &= sums[0] > 0
                rows, cols, key, sim = (np.broadcast_to(x, hit.shape)[hit] for x in (rows, cols, key, sim))
                if not len(rows):
                    continue
                by = np.lexsort((-key, rows)) if self.free else np.argsort(rows, kind="stable")
                rows, cols, key, sim = rows[by], cols[by], key[by], sim[by]
                who, start = np.unique(rows, return_index=True)
                if self.free:
                    place = np.arange(len(rows)) - np.repeat(start, np.diff([*start, len(rows)]))
                    some = place < k
                    at = np.searchsorted(who, rows[some]), place[some]
                    new = np.full((len(who), k), -1, np.int64), np.zeros((len(who), k)), np.zeros((len(who), k), int)
                    for x, y in zip(new, (key, sim, far.ids[cols]), strict=True):
                        x[at] = y[some]
                    self.kept.add(lo + who, *new)
                    continue
                for i, a, b in zip(who.tolist(), start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
                    own = slice(first[i], first[i + 1])
                    some, *new = best_of_row(cols[a:b], key[a:b], sim[a:b], has, dev, self.col[own], k, least[first[i] - first[0] : first[i + 1] - first[0]])
                    if len(some):
                        self.kept.add(first[i] + some, *new)

        def result(self):
            import numpy as np
            import pyarrow as pa

            key, sim, dev = self.kept.in_order()
            live = key >= 0
            sim, dev = np.where(live, sim, 0.0), np.where(live, dev, 0)
            if self.free:
                r, c = np.nonzero(live)
                cols = self.ids[r].astype(np.int64), dev[r, c].astype(np.int64), sim[r, c], np.abs(sim[r, c])
            else:
                w = np.maximum(sim, 0.0) if positive else sim
                some = live.any(1)
                who = np.repeat(self.ids, np.diff(self.first))
                cols = who[some].astype(np.int64), self.item[some].astype(np.int64), (w * dev).sum(1)[some], np.abs(w).sum(1)[some]
            return pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(("user_id", "item_id", "up", "down"), cols, strict=True)})

    def work(batches):
        now, own, block, far, held = None, [], None, [], 0

        def flush():
            nonlocal block, far, held
            if own:
                block = block or Block(own)
                if far:
                    for part in block.parts(side_of(far)):
                        block.pass_by(part)
            far, held = [], 0

        for (*key, side), rows_ in runs(batches, ["_g", "_t", "_side"]):
            if now is not None and key != now:
                flush()
                if block:
                    yield block.result()
                own, block = [], None
            now = key
            if side == 0:
                own.append(rows_)
            else:
                far.append(rows_)
                held += rows_.num_rows
                if held >= USERS:
                    flush()
        flush()
        if block:
            yield block.result()

    ready = rows.repartition(tasks(n_blocks), "_g", "_t").sortWithinPartitions("_g", "_t", "_side", "user_id")
    return ready.mapInArrow(work, "user_id long, item_id long, up double, down double")


def blocks_of(stats: DataFrame, cells: int) -> DataFrame:
    """_g and its _parts of target users, from _g, _askers and _cells."""
    cap = float(min(TARGETS, max(2_000, cells // TASKS)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_askers") / USERS), F.ceil(F.col("_cells") / cap)).cast("int")
    return stats.select("_g", parts.alias("_parts"))
