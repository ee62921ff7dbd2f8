"""Filling fixed-capacity containers by bin completion."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Documents of one task's packing; a block leaves at most one poorly filled container.
BLOCK = 8192
#: Work of one block's search, in steps of the enumeration, after which the best packing so far stands without a proof.
NODES = 200_000


@dataclass
class Packing:
    """Container of each size; containers used, those of best fit alone, the lower bound, the steps of the search, and whether no better packing exists."""

    place: list[int]
    containers: int
    best_fit: int
    bound: int
    steps: int
    proven: bool


def lower_bound(sizes: np.ndarray, capacity: int, count: np.ndarray | None = None) -> int:
    """Containers that any packing needs: for each k, items over capacity - k stand alone, those over half the capacity
    take one each, and what of the items of at least k doesn't fit beside the latter needs containers of its own.

    With ``count``, sizes are the different sizes, rising, and count says how many items of each there are.
    """
    v, n = np.unique(sizes, return_counts=True) if count is None else (sizes, count)
    if not len(v):
        return 0
    items, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(v * n)])
    half = int(np.searchsorted(v, capacity // 2, side="right"))  # the first size over half the capacity
    k = np.concatenate([[0], v[:half]])
    alone = np.searchsorted(v, capacity - k, side="right")
    least = np.maximum(np.arange(-1, half), 0)  # the first size of at least k
    beside = (items[alone] - items[half]) * capacity - (total[alone] - total[half])
    need = np.maximum(0, -((beside - (total[half] - total[least])) // capacity))
    return int((items[-1] - items[half] + need).max())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of best fit with falling sizes: each goes where the least room stays."""
    room: list[tuple[int, int]] = []  # (room, container), sorted
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(room, (s, -1))
        if i < len(room):
            free, c = room.pop(i)
            out[c].append(s)
        else:
            free, c = capacity, len(out)
            out.append([s])
        if free > s:
            bisect.insort(room, (free - s, c))
    return out


def _smeared(bits: int, width: int) -> int:
    """bits | bits << 1 | ... | bits << width."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def dominated(chosen: list[int], left: int, others: int) -> bool:
    """Whether a filling with ``left`` unused can be bettered by an item that it leaves out (a bit set of sizes).

    It can if such an item fits beside it, or can take the place of some of its items that are not larger together, within
    the capacity: the items it frees pack wherever the item would have gone.  An item in place of a single one of its own size changes
    nothing and doesn't count.
    """
    if others & ((2 << left) - 2):
        return True
    one = many = 0  # sums of one item, and of two or more
    for s in chosen:
        many |= many << s | one << s
        one |= 1 << s
    larger = _smeared(one << 1, left - 1) if left else 0
    return bool(others & (_smeared(many, left) | larger))


class _Search:
    """Sizes of a block in falling order with how many are left, and the search for a packing into fewer containers."""

    def __init__(self, sizes: list[int], capacity: int, steps: int):
        n = Counter(sizes)
        self.sizes = sorted(n, reverse=True)
        self.count = [n[s] for s in self.sizes]
        self.negative = [-s for s in self.sizes]
        self.rising = np.array(self.sizes[::-1], np.int64)
        self.capacity, self.steps, self.total = capacity, steps, sum(sizes)

    def _left(self) -> int:
        return sum(1 << s for s, n in zip(self.sizes, self.count) if n)

    def _between(self, room: int, low: int, high: int) -> Iterator[list[int]]:
        """Undominated fillings of the room (as places in the list of sizes) that leave low to high of it unused.

        Sizes never grow along a filling, larger ones come first; a branch ends where all smaller items together would still leave more than
        ``high`` unused.
        """
        sizes, count, n = self.sizes, self.count, len(self.sizes)
        tail = [*reversed(list(accumulate(map(mul, reversed(sizes), reversed(count))))), 0]
        every = self._left()
        used = [0] * n
        chosen: list[int] = []
        left = room
        j = bisect.bisect_left(self.negative, -left)
        self.steps -= 1 + n // 16
        while True:
            while j < n and used[j] >= count[j]:
                j += 1
            self.steps -= 1
            if self.steps <= 0:
                return
            if j < n and tail[j] - used[j] * sizes[j] >= left - high:
                used[j] += 1
                chosen.append(j)
                left -= sizes[j]
                j = max(j, bisect.bisect_left(self.negative, -left))
                continue
            if j >= n and low <= left <= high:
                others = every
                for i in set(chosen):
                    if used[i] == count[i]:
                        others ^= 1 << sizes[i]
                if not dominated([sizes[i] for i in chosen], left, others):
                    yield list(chosen)
            if not chosen:
                return
            j = chosen.pop()
            used[j] -= 1
            left += sizes[j]
            j += 1

    def _fillings(self, room: int, waste: int) -> Iterator[list[int]]:
        """All undominated fillings that leave at most ``waste`` of the room unused, the fuller ones before."""
        low = width = 0
        while low <= min(waste, room):
            yield from self._between(room, low, min(low + width, waste, room))
            low, width = low + width + 1, width * 2 + 1

    def into(self, containers: int) -> list[list[int]] | None:
        """A packing into so many containers, or None if the search finds none.

        Each level takes the largest item left and tries its fillings; a branch ends where the unused space so far is more
        than the packing can afford, or where the items left need more containers than are left.
        """
        spare = containers * self.capacity - self.total
        levels: list[tuple[int, Iterator[list[int]], list[int] | None]] = []
        wasted = 0
        open_one = True
        while True:
            if open_one:
                top = next((i for i, n in enumerate(self.count) if n), None)
                if top is None:
                    return [[self.sizes[i], *(self.sizes[j] for j in f)] for i, _, f in levels]
                fits = len(levels) + lower_bound(self.rising, self.capacity, np.array(self.count[::-1])) <= containers
                self.count[top] -= 1
                levels.append((top, self._fillings(self.capacity - self.sizes[top], spare - wasted) if fits else iter(()), None))
            top, fillings, filling = levels[-1]
            if filling is not None:
                wasted -= self._change(top, filling, 1)
            filling = next(fillings, None) if self.steps > 0 else None
            levels[-1] = top, fillings, filling
            if filling is not None:
                wasted += self._change(top, filling, -1)
                open_one = True
                continue
            self.count[top] += 1
            levels.pop()
            open_one = False
            if not levels:
                return None

    def _change(self, top: int, filling: list[int], by: int) -> int:
        for i in filling:
            self.count[i] += by
        return self.capacity - self.sizes[top] - sum(self.sizes[i] for i in filling)


def pack_block(sizes: list[int], capacity: int, nodes: int = NODES) -> Packing:
    """Packs sizes from 1 to the capacity by bin completion.

    Best fit with falling sizes is the first incumbent.  While it has more containers than the lower bound, the search looks for a packing
    into one container less: around the largest item left each time, over undominated fillings, with bounds on the unused
    space.  It ends with a proof (the bound is met, or no better packing exists), or after ``nodes`` steps with the incumbent.
    """
    best = best_fit(sizes, capacity)
    first, bound = len(best), lower_bound(np.array(sizes, np.int64), capacity)
    steps = nodes
    while len(best) > bound and steps > 0:
        search = _Search(sizes, capacity, steps)
        found = search.into(len(best) - 1)
        steps = max(0, search.steps)
        if found is None:
            break
        best = found
    at: dict[int, list[int]] = {}
    for c, items in enumerate(best):
        for s in items:
            at.setdefault(s, []).append(c)
    used = dict.fromkeys(at, 0)
    place = []
    for s in sizes:
        place.append(at[s][used[s]])
        used[s] += 1
    return Packing(place, len(best), first, bound, nodes - steps, len(best) == bound or steps > 0)


def packed(sizes: DataFrame, profiles: DataFrame, key: str = "doc_id", size: str = "tokens", block: int = BLOCK) -> DataFrame:
    """(profile, container, key, piece, start_token, tokens): where each piece of each document goes.

    A document over the capacity is cut into pieces that fill a container each, and one for the rest; others are one
    piece.  A document of size 0 takes no space and is put, as a piece of 0, into a container of its own block.  Documents
    are dealt to blocks of about ``block`` by a hash of their key, so packing runs in as many tasks as data asks for and
    no group grows with the data.  Profiles are a short table of settings (at most 1000).  Null sizes count as 0; null keys and profiles without a positive capacity are ignored.
    """

    def run(gkey: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        profile, b, cap = (g.as_py() for g in gkey)
        t = table.sort_by("k")
        keys, n = t.column("k").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        whole = n // cap
        rest = n - whole * cap
        full_doc = np.repeat(np.arange(len(n)), whole)
        full_piece = np.arange(len(full_doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        part, empty = np.flatnonzero(rest > 0), np.flatnonzero(n <= 0)
        place = np.array(pack_block(rest[part].tolist(), cap).place, np.int64)
        part, place = np.concatenate([part, empty]), np.concatenate([place, np.zeros(len(empty), np.int64)])
        made = int(place.max()) + 1 if len(place) else 0
        doc = np.concatenate([full_doc, part])
        piece = np.concatenate([full_piece, whole[part]])
        box = np.concatenate([made + np.arange(len(full_doc)), place])
        length = np.concatenate([np.full(len(full_doc), cap), rest[part]])
        return pa.table(
            {
                "profile": pa.array([profile] * len(doc)), "container": pa.array([f"{b}-{x}" for x in box.tolist()]), key: keys[doc],
                "piece": piece.astype(np.int32), "start_token": (piece * cap).astype(np.int32), "tokens": length.astype(np.int32),
            }
        )

    return _blocks(sizes, profiles, key, size, block).applyInArrow(run, f"profile string, container string, `{key}` bigint, piece int, start_token int, tokens int")


def _blocks(sizes: DataFrame, profiles: DataFrame, key: str, size: str, block: int):
    """Documents grouped by profile and block, with the capacity."""
    ship(sizes.sparkSession)
    clean = sizes.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("n")).where("k is not null")
    blocks = max(1, -(-clean.count() // block))
    caps = profiles.select("profile", F.col("capacity_tokens").cast("int").alias("cap")).where("profile is not null and cap > 0").dropDuplicates(["profile"]).orderBy("profile").limit(1000).collect()
    each = F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["cap"]).alias("cap")) for r in caps]) if caps else F.expr("cast(array() as array<struct<profile:string,cap:int>>)")
    tasks = clean.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).select("*", F.explode(each).alias("_p")).select("k", "n", "block", "_p.*")
    return tasks.groupBy("profile", "block", "cap")


def search_report(sizes: DataFrame, profiles: DataFrame, key: str = "doc_id", size: str = "tokens", block: int = BLOCK) -> DataFrame:
    """How the packing went, a row a profile: blocks, those proven to have no better packing, items packed (pieces that fill a container aside),
    containers, those of best fit alone, the sum of the blocks' lower bounds, and steps of the search."""

    def run(gkey: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        profile, _, cap = (g.as_py() for g in gkey)
        n = np.sort(table.column("n").to_numpy().astype(np.int64))
        rest = n[n > 0] % cap
        p = pack_block(rest[rest > 0].tolist(), cap)
        return pa.table({"profile": [profile], "proven": [int(p.proven)], "items": [len(p.place)], "containers": [p.containers], "best_fit": [p.best_fit], "least": [p.bound], "steps": [p.steps]})

    names = ["proven", "items", "containers", "best_fit", "least", "steps"]
    each = _blocks(sizes, profiles, key, size, block).applyInArrow(run, "profile string, " + ", ".join(f"{c} bigint" for c in names))
    return each.groupBy("profile").agg(F.count(F.lit(1)).alias("blocks"), *[F.sum(c).alias(c) for c in names])


def fill_report(packing: DataFrame, profiles: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each profile, and the least number of containers its tokens need."""
    box = packing.groupBy("profile", "container").agg(F.sum("tokens").alias("t"))
    total = box.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    joined = total.join(F.broadcast(profiles.select("profile", "capacity_tokens")), "profile")
    return joined.select("profile", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))
