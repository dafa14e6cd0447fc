"""Stochastic gradient descent over strata of blocks: biased and probabilistic factor models of any size, one or many at once.

Ratings have a group (a cluster, all gray users, or everything), and each group is a model
of its own. Users and items of a group are dealt out in ``n`` blocks each, so its ratings
lie in n x n blocks. A sub-epoch takes one diagonal, blocks (b, b + s mod n): no two of
them share a user or an item, so all of all groups are walked at once, each in a task, and
the factors of users and items travel to the block that needs them. After n sub-epochs every
rating was walked once. The strata of Gemulla et al., "Large-scale matrix factorization with
distributed stochastic gradient descent".

Inside a block the order of ratings is a hash's. Ratings are laid out in waves: a rating's
wave is one behind the last that has its user or its item, so ratings of a wave share
neither, and walking wave by wave with arrays gives exactly what walking the order one by
one would.

What a task holds is bounded: a chunk of ratings and one block of users and of items. The
number of blocks follows the group's ratings, users and items; a user or item with more
ratings than a block should have makes more chunks of that block, one behind the other.
No group has to fit a task. Groups of a single block (most clusters) are walked through
all epochs in one job.

Defined results
* no ratings: no factors, and no predictions; groups with fewer than ``least`` rows have none;
* repeated (user, item): each row is a step of its own, in the order of its rating;
* rows with a null id, group or rating are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import clip, dot, order_hash
from tastemill.operators.iterate import cut

#: Ratings that a block should have, ratings of a chunk, and numbers in the factors of a block.
BLOCK_ROWS, CHUNK_ROWS, BLOCK_NUMBERS = 1_000_000, 100_000, 4_000_000
STATE = "grp long, side int, block int, blocks int, ids array<long>, bias array<double>, vec array<double>"
PACKED = "grp long, ub int, ib int, blocks int, chunk int, users array<long>, items array<long>, ratings array<double>, ends array<int>"


@dataclass(frozen=True)
class Rule:
    """Step sizes: e is the error times ``precision``; factors move by lr (e other - reg own)."""

    rank: int = 20
    epochs: int = 30
    lr: float = 0.01
    reg_user: float = 0.02
    reg_item: float = 0.02
    precision: float = 1.0
    biased: bool = True
    start: float = 0.1
    shuffled: bool = False
    seed: str = "sgd"

    @classmethod
    def biased_model(cls, rank: int = 20, epochs: int = 30, lr: float = 0.01, reg: float = 0.02, seed: str = "sgd") -> Rule:
        return cls(rank, epochs, lr, reg, reg, seed=seed)

    @classmethod
    def probabilistic_model(cls, rank: int = 20, epochs: int = 30, lr: float = 0.005, sigma_sq: float = 1.0, sigma_u_sq: float = 1.0, sigma_v_sq: float = 1.0, seed: str = "pmf") -> Rule:
        """Ridges are the precisions of the factors, errors count by that of the ratings; waves are walked in another order each epoch."""
        start = (min(sigma_u_sq, sigma_v_sq) / max(rank, 1)) ** 0.5
        return cls(rank, epochs, lr, 1 / max(sigma_u_sq, 1e-6), 1 / max(sigma_v_sq, 1e-6), 1 / max(sigma_sq, 1e-6), False, start, True, seed)


@dataclass
class Model:
    """mean (grp, mu), users (grp, user_id, b_u, p), items (grp, item_id, b_i, q)."""

    mean: DataFrame
    users: DataFrame
    items: DataFrame

    def predict(self, targets: DataFrame, grp: str | None = None, clipped: bool = True) -> DataFrame:
        """``targets`` with pred. An unknown item adds nothing; an unknown user has the mean bias and factor of the group; targets of an unknown group go."""
        k = F.lit(0).cast("long") if grp is None else F.col(grp).cast("long")
        rank = self.users.select("p").limit(1).first()
        width = len(rank["p"]) if rank else 0
        # one row for each group
        centre = self.users.groupBy("grp").agg(F.avg("b_u").alias("_b"), F.array(*[F.avg(F.col("p")[i]) for i in range(width)]).alias("_c")).join(self.mean, "grp")
        met = targets.withColumn("grp", k).join(centre, "grp").join(self.users, ["grp", "user_id"], "left").join(self.items, ["grp", "item_id"], "left")
        near = F.coalesce(dot(F.coalesce("p", "_c"), F.col("q")), F.lit(0.0))
        x = F.col("mu") + F.coalesce("b_u", "_b") + F.coalesce("b_i", F.lit(0.0)) + near
        return met.select(*targets.columns, (clip(x) if clipped else x).alias("pred"))


def block_of(name: str, blocks: Column, seed: str) -> Column:
    """The block of a user or item: a hash that every engine computes alike."""
    return (F.conv(F.substring(order_hash(name, seed=seed), 1, 8), 16, 10).cast("long") % blocks).cast("int")


def normal(name: str, k: int, seed: str) -> Column:
    """A standard normal variate of an id, from two hashes."""
    u = [(F.conv(F.substring(order_hash("grp", name, seed=f"{seed}{k}{t}"), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for t in "ab"]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def waves(users: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): positions wave by wave, and where each wave ends."""
    last_user, last_item = [0] * (int(users.max()) + 1), [0] * (int(items.max()) + 1)
    level = []
    for a, b in zip(users.tolist(), items.tolist(), strict=True):
        n = max(last_user[a], last_item[b]) + 1
        last_user[a] = last_item[b] = n
        level.append(n)
    level = np.array(level)
    return np.argsort(level, kind="stable"), np.cumsum(np.bincount(level)[1:])


def walk(u: np.ndarray, i: np.ndarray, r: np.ndarray, ends: list[tuple[int, int]], mu: float, users: list[np.ndarray], items: list[np.ndarray], rule: Rule) -> None:
    """One pass over a chunk; biases and factors change in place."""
    (bu, p), (bi, q) = users, items
    for lo, hi in ends:
        a, b = u[lo:hi], i[lo:hi]
        own, far = p[a], q[b]
        e = r[lo:hi] - mu - (own * far).sum(1)
        if rule.biased:
            x, y = bu[a], bi[b]
            e = (e - x - y) * rule.precision
            bu[a] = x + rule.lr * (e - rule.reg_user * x)
            bi[b] = y + rule.lr * (e - rule.reg_item * y)
        else:
            e = e * rule.precision
        e = e[:, None]
        p[a] = own + rule.lr * (e * far - rule.reg_user * own)
        q[b] = far + rule.lr * (e * own - rule.reg_item * far)


class Strata:
    """Ratings laid out in blocks, ready for epochs."""

    def __init__(self, ratings: DataFrame, rule: Rule, grp: str | None = None, least: int = 1, blocks: int | None = None):
        k = F.lit(0).cast("long") if grp is None else F.col(grp).cast("long")
        rows = ratings.select(k.alias("grp"), F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id"), F.col("rating").cast("double").alias("rating")).na.drop()
        sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("rating").alias("mu"), F.approx_count_distinct("user_id").alias("nu"), F.approx_count_distinct("item_id").alias("ni")).where(F.col("n") >= least)
        wanted = F.greatest(F.ceil(F.sqrt(F.col("n") / BLOCK_ROWS)), F.ceil(F.col("nu") * rule.rank / BLOCK_NUMBERS), F.ceil(F.col("ni") * rule.rank / BLOCK_NUMBERS), F.lit(1))
        self.rule, self.mean = rule, cut(sizes.select("grp", "mu", (wanted if blocks is None else F.lit(blocks)).cast("int").alias("blocks")))
        self.blocks = self.mean.agg(F.max("blocks")).first()[0] or 0
        dealt = rows.join(self.mean.select("grp", "blocks"), "grp").withColumns({"ub": block_of("user_id", F.col("blocks"), "ub"), "ib": block_of("item_id", F.col("blocks"), "ib")})
        self.packed = cut(self.pack(dealt))
        self.state = cut(self.start(dealt, "user_id", "ub", 0).unionAll(self.start(dealt, "item_id", "ib", 1)))

    def pack(self, dealt: DataFrame) -> DataFrame:
        """A row for each chunk of a block, its ratings in waves."""
        held = dealt.groupBy("grp", "ub", "ib").agg(F.count("*").alias("_n"))
        many = F.greatest(F.lit(1), F.ceil(F.col("_n") / CHUNK_ROWS)).cast("int")
        rows = dealt.join(held, ["grp", "ub", "ib"]).withColumn("_h", order_hash("user_id", "item_id", seed=self.rule.seed))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("user_id", "item_id"), many).cast("int"))

        def lay(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in ("_h", "user_id", "item_id", "rating")])
            users, items = table.column("user_id").to_numpy(), table.column("item_id").to_numpy()
            order, ends = waves(np.unique(users, return_inverse=True)[1], np.unique(items, return_inverse=True)[1])
            one = {c: table.column(c)[:1].combine_chunks() for c in ("grp", "ub", "ib", "blocks", "chunk")}
            lists = {"users": (users[order], pa.int64()), "items": (items[order], pa.int64()), "ratings": (table.column("rating").to_numpy()[order], pa.float64()), "ends": (ends, pa.int32())}
            one |= {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for c, (v, kind) in lists.items()}
            return pa.table(one)

        return rows.groupBy("grp", "ub", "ib", "chunk").applyInArrow(lay, PACKED)

    def start(self, dealt: DataFrame, key: str, block: str, side: int) -> DataFrame:
        """The factors of each block: no bias, and a normal variate of the id for each component."""
        ids = dealt.select("grp", F.lit(side).alias("side"), F.col(block).alias("block"), "blocks", key).distinct()
        vec = F.array(*[self.rule.start * normal(key, k, f"{self.rule.seed}{side}.") for k in range(self.rule.rank)])

        def lay(table: pa.Table) -> pa.Table:
            table = table.sort_by(key)
            n = table.num_rows
            one = {c: table.column(c)[:1].combine_chunks() for c in ("grp", "side", "block", "blocks")}
            flat = table.column("vec").combine_chunks().flatten()
            lists = {"ids": table.column(key).combine_chunks(), "bias": pa.array(np.zeros(n)), "vec": flat}
            return pa.table(one | {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in lists.items()})

        return ids.withColumn("vec", vec).groupBy("grp", "side", "block").applyInArrow(lay, STATE)

    def sub_epoch(self, s: int, epoch: int, passes: int = 1) -> DataFrame:
        """The state after walking the blocks (b, b + s) of all groups that have so many blocks; the others stay."""
        rule, rank = self.rule, self.rule.rank
        active = self.state.where(F.col("blocks") > s)
        key = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - s, F.col("blocks")))
        none = F.lit(None)
        factors = active.select("grp", key.alias("k"), F.col("side").alias("ord"), F.lit(0).alias("chunk"), "block", "blocks", "ids", none.cast("array<long>").alias("items"), "bias", "vec", none.cast("array<int>").alias("ends"), none.cast("double").alias("mu"))
        walked = self.packed.where((F.col("blocks") > s) & (F.col("ib") == F.pmod(F.col("ub") + s, F.col("blocks")))).join(self.mean.select("grp", "mu"), "grp")
        ratings = walked.select("grp", F.col("ub").alias("k"), F.lit(2).alias("ord"), "chunk", F.col("ub").alias("block"), "blocks", F.col("users").alias("ids"), "items", F.col("ratings").alias("bias"), none.cast("array<double>").alias("vec"), "ends", "mu")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, sides, chunks = None, {}, []

            def spans(ends: list[int], turn: int, number: int) -> list[tuple[int, int]]:
                found = list(zip([0, *ends[:-1]], ends, strict=True))
                if rule.shuffled:
                    np.random.RandomState([turn, s, number]).shuffle(found)
                return found

            def finish() -> Iterator[pa.RecordBatch]:
                if not sides:
                    return
                for turn in range(passes if len(sides) == 2 else 0):
                    for u, i, r, ends, mu, number in chunks:
                        walk(u, i, r, spans(ends, epoch + turn, number), mu, sides[0][1:3], sides[1][1:3], rule)
                for side, (ids, bias, vec, block, blocks) in sides.items():
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (ids, bias, vec.ravel())]
                    yield pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int64()), *[pa.array([x], pa.int32()) for x in (side, block, blocks)], *lists], names=["grp", "side", "block", "blocks", "ids", "bias", "vec"])

            for batch in batches:
                for n in range(batch.num_rows):
                    row = batch.slice(n, 1)
                    flat = lambda c, row=row: row.column(c).flatten().to_numpy(zero_copy_only=False).copy()
                    here = (row.column("grp")[0].as_py(), row.column("k")[0].as_py())
                    if here != place:
                        yield from finish()
                        place, sides, chunks = here, {}, []
                    if (kind := row.column("ord")[0].as_py()) < 2:
                        sides[kind] = [flat("ids"), flat("bias"), flat("vec").reshape(-1, rank), row.column("block")[0].as_py(), row.column("blocks")[0].as_py()]
                        continue
                    u, i = np.searchsorted(sides[0][0], flat("ids")), np.searchsorted(sides[1][0], flat("items"))
                    one = (u, i, flat("bias"), flat("ends").tolist(), row.column("mu")[0].as_py(), row.column("chunk")[0].as_py())
                    if passes == 1:  # chunks go by one at a time
                        walk(*one[:3], spans(one[3], epoch, one[5]), one[4], sides[0][1:3], sides[1][1:3], rule)
                    else:
                        chunks.append(one)
            yield from finish()

        moved = factors.unionAll(ratings).repartition("grp", "k").sortWithinPartitions("grp", "k", "ord", "chunk").mapInArrow(run, STATE)
        return moved.unionAll(self.state.where(F.col("blocks") <= s))

    def fit(self) -> Model:
        if self.blocks == 1:
            self.state = cut(self.sub_epoch(0, 0, self.rule.epochs))
        else:
            for epoch in range(self.rule.epochs if self.blocks else 0):
                for s in range(self.blocks):
                    self.state = cut(self.sub_epoch(s, epoch))
        return self.model()

    def model(self) -> Model:
        rank = self.rule.rank

        def side(n: int, key: str, bias: str, vec: str) -> DataFrame:
            rows = self.state.where(F.col("side") == n).select("grp", F.posexplode("ids").alias("_at", key), "bias", "vec")
            return rows.select("grp", key, F.get("bias", F.col("_at")).alias(bias), F.slice("vec", F.col("_at") * rank + 1, F.lit(rank)).alias(vec))

        return Model(self.mean.select("grp", "mu"), side(0, "user_id", "b_u", "p"), side(1, "item_id", "b_i", "q"))


def fit(ratings: DataFrame, rule: Rule, grp: str | None = None, least: int = 1, blocks: int | None = None) -> Model:
    """A model for each group of ``ratings``, or one for all; ``blocks`` overrides how many each group is cut in."""
    return Strata(ratings, rule, grp, least, blocks).fit()
