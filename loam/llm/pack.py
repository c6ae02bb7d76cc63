"""Filling containers of fixed capacity with items, whole unless an item alone exceeds the capacity.

Method: Martello-Toth dominance reduction, then best fit. The number of items of each size is all the packing
depends on, and sizes run from 1 to the capacity: the plan is made on that histogram (at most ``capacity`` rows,
whatever the corpus holds), and items take their places in it by their rank within their size.

Reduction, sizes from large to small: a container is fixed for good when its set of items dominates every other set
that could hold its largest item - the item alone if nothing fits beside it; the item and the one that fills the
container exactly; the item and the largest that fits, if at most one fits or no two small ones are larger; three
items under Martello and Toth's condition for two companions. The rest is placed by best fit, largest first.

Defined results
- null and empty texts have size 0: one row, no container;
- an item over the capacity is cut into full containers and one remainder, numbered by ``piece_no``; the remainder
  is packed with the other items;
- repeated ids are items of their own; ties in size are broken by a hash of id and piece, so runs agree.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.tokens import VOCABULARY, token_counts
from loam.session import bounded_rows

CAPACITY = 2048
ROWS_PER_BUCKET = 50_000
RUNS_PER_SIZE = 64


@dataclass
class Plan:
    """Runs ``(size, first_rank, last_rank, first_container, per_container)``, ranks from 0, the last one exclusive."""

    capacity: int
    counts: dict[int, int]
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    fixed: int = 0

    def __post_init__(self) -> None:
        self.left = {s: c for s, c in self.counts.items() if c > 0}
        self.taken = dict.fromkeys(self.left, 0)

    def take(self, size: int, count: int, container: int, per: int = 1) -> None:
        """The next ``count`` items of a size, ``per`` to a container, from ``container`` on."""
        if count:
            at = self.taken[size]
            self.runs.append((size, at, at + count, container, per))
            self.taken[size] = at + count
            self.left[size] -= count
            if not self.left[size]:
                del self.left[size]

    def fix(self, sizes: tuple[int, ...], times: int) -> None:
        """``times`` containers that hold exactly these sizes."""
        for size in sorted(set(sizes)):
            same = sizes.count(size)
            self.take(size, same * times, self.containers, same)
        self.containers += times
        self.fixed += times


def _dominant(plan: Plan, size: int, order: list[int]) -> tuple[int, ...] | None:
    """The set that dominates all sets holding the item ``size``; ``order`` has the sizes left, ascending."""
    room = plan.capacity - size

    count = {s: plan.left[s] - (s == size) for s in order}
    others = [s for s in order if count[s] > 0]
    small: list[int] = []  # the three smallest others
    for s in others:
        small += [s] * min(3 - len(small), count[s])
        if len(small) == 3:
            break
    if not small or small[0] > room:
        return (size,)
    fits = bisect_left(others, room + 1) - 1
    best = others[fits]
    if best == room or len(small) == 1 or small[0] + small[1] > room:
        return (size, best)
    if len(small) == 3 and sum(small) <= room:
        return None
    # exactly two companions fit at most: the best pair by two pointers
    i, j, pair = 0, fits, (0, 0)
    while i < j or (i == j and count[others[i]] > 1):
        total = others[i] + others[j]
        if total > room:
            j -= 1
            continue
        if total > sum(pair):
            pair = (others[j], others[i])
        i += 1
    if best >= sum(pair):
        return (size, best)
    if best == pair[0]:
        between = [s for s in others if pair[1] < s < pair[0] for _ in range(min(2, count[s]))]
        if len(between) <= 1 or between[0] + between[1] > room:
            return (size, *pair)
    return None


def reduce(plan: Plan) -> None:
    """Fix dominating containers, sizes from large to small, until no size allows one."""
    order = sorted(plan.left)
    at = len(order) - 1
    while at >= 0:
        size = order[at]
        found = _dominant(plan, size, order) if size in plan.left else None
        if found is None:
            at -= 1
            continue
        # as often as the items last; with companions that may run out, the set is looked up again after one
        times = min(plan.left[s] // found.count(s) for s in set(found))
        plan.fix(found, times if len(found) < 3 else 1)
        order = sorted(plan.left)
        at = bisect_left(order, size)
        at = at if at < len(order) and order[at] == size else at - 1


def best_fit(plan: Plan) -> None:
    """Largest first, each into the open container with the least room that still holds it."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def offer(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, count))

    for size in sorted(plan.left, reverse=True):
        while (left := plan.left.get(size, 0)) > 0:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
                # of a container with room for several of this size, as many as fit go in: it stays the best fit
                per = min(room // size, left)
                used = min(count, left // per)
                plan.take(size, used * per, first, per)
                offer(room - per * size, first, used)
                offer(room, first + used, count - used)
            else:
                per = min(plan.capacity // size, left)
                used = left // per
                first, plan.containers = plan.containers, plan.containers + used
                plan.take(size, used * per, first, per)
                offer(plan.capacity - per * size, first, used)


def packing_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for a histogram of sizes between 1 and the capacity."""
    plan = Plan(capacity, {s: c for s, c in counts.items() if 0 < s <= capacity})
    reduce(plan)
    best_fit(plan)
    return plan


def items_of(sizes: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """``(id, piece_no, tokens)``: items, cut only where one exceeds the capacity. Expressions over the map side."""
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1).cast("int")
    rows = sizes.select(F.col(id_col), F.col("tokens").alias("__t"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return rows.select(id_col, "piece_no", F.least(F.lit(capacity), F.col("__t") - F.col("piece_no") * capacity).alias("tokens"))


def packed(spark: SparkSession, items: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece_no, tokens, container_id)`` of items of ``items_of``.

    Ranks within a size come from buckets: a size held by a third of all items is many buckets, never one task.
    """
    sized = items.where(F.col("tokens") > 0)
    histogram = bounded_rows(sized.groupBy("tokens").agg(F.count(F.lit(1)).alias("items")), capacity, "sizes")
    counts = {int(r["tokens"]): int(r["items"]) for r in histogram}
    plan = packing_plan(counts, capacity)
    buckets = max(1, -(-max(counts.values(), default=1) // ROWS_PER_BUCKET))
    bucketed = sized.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(buckets)))
    per_bucket = bucketed.groupBy("tokens", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = per_bucket.select("tokens", "__b", (F.sum("__n").over(Window.partitionBy("tokens").orderBy("__b")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("tokens", "__b").orderBy(F.xxhash64(id_col, "piece_no"), id_col, "piece_no")) - 1
    ranked = bucketed.withColumn("__in", inside).join(before, ["tokens", "__b"]).withColumn("__rank", F.col("__before") + F.col("__in"))
    # the plan has a few runs per size, whatever the corpus holds
    if len(plan.runs) > RUNS_PER_SIZE * capacity:
        raise ValueError(f"a plan of {len(plan.runs)} runs is too large to send to every executor")
    runs = spark.createDataFrame(plan.runs or [(0, 0, 0, 0, 1)], "tokens long, __first long, __last long, __container long, __per long")
    placed = ranked.join(F.broadcast(runs), "tokens").where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last")))
    container = F.col("__container") + F.expr("(__rank - __first) div __per")
    none = items.where(F.col("tokens") <= 0).select(id_col, "piece_no", "tokens", F.lit(None).cast("long").alias("container_id"))
    return placed.select(id_col, "piece_no", "tokens", container.alias("container_id")).unionByName(none)


def packed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts measured in tokens of a public vocabulary and packed; each text is measured once."""
    from loam.session import staged

    sizes = staged(token_counts(df, id_col, text_col, vocabulary), "sizes")
    return packed(df.sparkSession, items_of(sizes, id_col, capacity), id_col, capacity)
