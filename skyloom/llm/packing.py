"""Filling containers of several permitted capacities with items, best fit first.

What is packed is the histogram of sizes: its number of entries is bounded by the largest
capacity, whatever the number of items. Sizes go in descending order; equal items
fill equal containers many at a time, which leaves the result that of one-by-one best
fit decreasing. The plan (runs of ranks per size -> runs of containers) is as small as
the histogram; items find their place in it by their rank among those of their size.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.session import checkpointed

CAPACITIES = (512, 1024, 2048, 4096)


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of ``counts`` items of each size (1 to the largest capacity).

    Returns runs and containers. runs: rows (size, first rank, number of items, first
    container, items to a container, offset in the container); the i-th item of a run goes to container
    first + i // per, at offset + (i % per) * size. containers: rows (first container, number,
    filled, capacity), by container. A new container's capacity is the one of least expected cost,
    (unused + ``overhead``) per token held, when filled up with the largest sizes left;
    in the end each container gets the smallest capacity that holds its contents.
    """
    caps = sorted(capacities)
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    left = {s: n for s, n in counts.items() if n > 0}
    if left and (min(left) < 1 or max(left) > caps[-1]):
        raise ValueError("sizes must lie between 1 and the largest capacity")
    sizes = sorted(left)
    runs: list[tuple] = []
    # room -> groups of equal containers (first, number, opened with); rooms kept in order
    open_: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, int, int]] = []
    opened = 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room == 0:
            done.append((group[0], group[1], group[2]))
        elif room in open_:
            open_[room].append(group)
        else:
            open_[room] = [group]
            bisect.insort(rooms, room)

    def cost(cap: int, size: int, n: int, smaller: int) -> float:
        held = min(n, cap // size) * size
        room, i = cap - held, smaller
        while room and i > 0:  # the largest that fit, as best fit would bring them
            i = bisect.bisect_right(sizes, room, 0, i) - 1
            if i < 0:
                break
            take = min(left[sizes[i]], room // sizes[i])
            held, room = held + take * sizes[i], room - take * sizes[i]
        return (room + overhead) / held

    for at in range(len(sizes) - 1, -1, -1):
        size = sizes[at]
        n, rank = left[size], 0
        while n:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, number, cap = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                cap = room = min((c for c in caps if c >= size), key=lambda c: (cost(c, size, n, at), c))
                number = -(-n // (cap // size))
                first, opened = opened, opened + number
            per = room // size
            full = min(number, n // per)
            if full:
                runs.append((size, rank, full * per, first, per, cap - room))
                put(room - per * size, (first, full, cap))
                rank, n, first, number = rank + full * per, n - full * per, first + full, number - full
            if n and number:  # fewer than a container takes
                runs.append((size, rank, n, first, n, cap - room))
                put(room - n * size, (first, 1, cap))
                rank, n, first, number = rank + n, 0, first + 1, number - 1
            if number:
                put(room, (first, number, cap))
    groups = [(first, number, cap) for first, number, cap in done] + [(first, number, cap - room) for room, gs in open_.items() for first, number, cap in gs]
    fit = [(first, number, filled, caps[bisect.bisect_left(caps, filled)]) for first, number, filled in sorted(groups)]
    return np.array(sorted(runs), np.int64).reshape(-1, 6), np.array(fit, np.int64).reshape(-1, 4)


def pack(items: DataFrame, key: str, size: str, *, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 4.0, per_part: int = 200_000) -> DataFrame:
    """key, piece int, n_tokens int, container_id long, capacity int, start int.

    One row per item, or per piece of an item larger than the largest capacity, which is
    cut into full containers and a rest (pieces count from 0; no other item is ever
    split). start is the place of the piece in its container. Items of size 0, null or
    negative take no room: container_id, capacity and start are null. Rows with equal or null keys are
    items of their own. An empty input gives an empty result.

    Ranks among equal sizes come from counts per (size, part), parts being
    hash classes of about ``per_part`` rows by a number that each row gets when it is first
    written, so a size, or a key, that a third of all items have is ranked in as
    many tasks as it needs.
    """
    most = max(capacities)
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    pieces = checkpointed(
        items.select(F.col(key), n.alias("_n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / most) - 1, F.lit(0)).cast("int"))))
        .select(key, "piece", F.least(F.col("_n") - F.col("piece") * F.lit(most).cast("long"), F.lit(most)).cast("int").alias("n_tokens"), F.monotonically_increasing_id().alias("_id"))
    )
    hist = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``most`` rows
    runs, fit = plan(hist, capacities, overhead)
    parts = max(1, -(-sum(hist.values()) // per_part))
    some = pieces.where("n_tokens > 0").withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    counts = some.groupBy("n_tokens", "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("n_tokens", "_part", (F.sum("_c").over(Window.partitionBy("n_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_from"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "_part").orderBy("_id")) - 1
    ranked = some.withColumn("_r", within).join(starts, ["n_tokens", "_part"]).select(key, "piece", "n_tokens", (F.col("_from") + F.col("_r")).alias("_rank"))
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else np.zeros(0, int)
    runs = runs[order]

    def place(batches):
        import pyarrow as pa

        # (size, rank) as one number: ranks stay below the number of items.
        span = int(runs[:, 1].max() + runs[:, 2].max() + 1) if len(runs) else 1
        firsts = runs[:, 0] * span + runs[:, 1]
        for b in batches:
            s, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            k = runs[np.searchsorted(firsts, s * span + rank, "right") - 1]
            i = rank - k[:, 1]
            box = k[:, 3] + i // k[:, 4]
            start = k[:, 5] + i % k[:, 4] * s
            cap = fit[np.searchsorted(fit[:, 0], box, "right") - 1, 3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(box), pa.array(cap.astype(np.int32)), pa.array(start.astype(np.int32))], names=names)

    names = [key, "piece", "n_tokens", "container_id", "capacity", "start"]
    kind = items.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"`{key}` {kind}, piece int, n_tokens int, container_id bigint, capacity int, start int")
    nothing = pieces.where("n_tokens = 0").select(key, "piece", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("container_id", "bigint"), ("capacity", "int"), ("start", "int"))])
    return placed.unionByName(nothing)


def containers(packed: DataFrame) -> DataFrame:
    """container_id, capacity, n_items, filled, unused of each container."""
    return packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.first("capacity").alias("capacity"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("filled")).withColumn("unused", F.col("capacity") - F.col("filled"))
