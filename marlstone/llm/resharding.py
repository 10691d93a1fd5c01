"""Minimum-cost-flow resharding.

Old shard sizes and new capacities form a transport problem: a byte that stays
costs nothing, one that moves costs its price. The flow says how many bytes go
from each old to each new shard. Rows of an old shard are laid out in blocks,
large rows first, and cut by their running byte position, so what stays are
the large rows and cuts fall between small ones. Only shard-level sizes reach
the driver; positions and slots come from block-level sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, local_table, maybe_broadcast, written

#: Rows for which one block of an old shard and size class is made.
ROWS_PER_BLOCK = 20_000
#: Shards on either side where prices differ (two tables of so many numbers squared in the driver); with the plain price there is no bound.
MAX_SHARDS = 2048


def cheapest_moves(supply: list[int], capacity: list[int], home: list[int | None]) -> dict[tuple[int, int], int]:
    """The flow where staying costs nothing and every move the same: what fits stays, the rest fills the free room in order."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than the sizes")
    flow, left, room = {}, list(supply), list(capacity)
    for i, j in enumerate(home):
        if j is not None and (x := min(left[i], room[j])):
            flow[i, j] = x
            left[i] -= x
            room[j] -= x
    j = 0
    for i, x in enumerate(left):
        while x:
            while not room[j]:
                j += 1
            y = min(x, room[j])
            flow[i, j] = flow.get((i, j), 0) + y
            room[j] -= y
            x -= y
    return flow


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supply into capacity; ``cost(i, j)`` is a whole number >= 0 for each byte.

    Primal-dual: the distances over the residual graph raise the potentials, then
    all paths of reduced cost 0 are filled, so there is one round for each
    distinct path cost. Returns the positive flows {(i, j): bytes}. Capacity must
    suffice.
    """
    n, m = len(supply), len(capacity)
    if max(n, m) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than the sizes")
    far = np.iinfo(np.int64).max // 4
    reduced = np.array([[cost(i, j) for j in range(m)] for i in range(n)], np.int64).reshape(n, m)
    left, room, flow = np.array(supply, np.int64), np.array(capacity, np.int64), np.zeros((n, m), np.int64)
    while left.any():
        du = np.where(left > 0, 0, far)
        while True:
            dv = (du[:, None] + reduced).min(0)
            nearer = np.minimum(du, np.where(flow > 0, dv, far).min(1))  # arcs with flow have reduced cost 0
            if (nearer == du).all():
                break
            du = nearer
        reach = dv[room > 0].min()
        reduced += np.minimum(du, reach)[:, None] - np.minimum(dv, reach)
        open_arcs = [np.flatnonzero(row == 0) for row in reduced]
        for i in np.flatnonzero(left):
            for j in open_arcs[i]:
                if x := min(left[i], room[j]):
                    flow[i, j] += x
                    left[i] -= x
                    room[j] -= x
        while path := _free_path(left, room, flow, open_arcs):
            x = min(left[path[0][0]], room[path[-1][1]], *(flow[i, j] for i, j, s in path if s < 0))
            for i, j, s in path:
                flow[i, j] += s * x
            left[path[0][0]] -= x
            room[path[-1][1]] -= x
    return {(int(i), int(j)): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def _free_path(left: np.ndarray, room: np.ndarray, flow: np.ndarray, open_arcs: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """A path of open arcs (+1) and given-back flow (-1) from a shard with rows left to one with room; empty if there is none."""
    came_u, came_v = dict.fromkeys(np.flatnonzero(left).tolist()), {}
    queue = list(came_u)
    for i in queue:
        for j in open_arcs[i].tolist():
            if j in came_v:
                continue
            came_v[j] = i
            if room[j]:
                path = []
                while True:
                    path.append((came_v[j], j, 1))
                    if (back := came_u[came_v[j]]) is None:
                        return path[::-1]
                    path.append((came_v[j], back, -1))
                    j = back
            for k in np.flatnonzero(flow[:, j]).tolist():
                if k not in came_u:
                    came_u[k] = j
                    queue.append(k)
    return []


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, capacities: int | list[int], cost=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a new shard.

    ``old_shard`` gives a row's present shard (0 up; null: 0), ``capacities``
    the new shards' byte capacities or their number for even ones. Returns
    doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, old_shard, shard
    and slot (gapless from 0 in each shard). New sizes differ from the flow's
    by less than one row at each cut.

    Defined results: a null text has size 1 and a null checksum; null ids are
    rows like others; repeated rows are placed each; rows of one size class go by
    their place in the table; an empty table gives an empty result; other columns
    are not read.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"))
    level = -F.floor(F.log2("size")).cast("int")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("level", level), "rows")
    classes = rows.groupBy("old_shard", "level").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sizes: dict[int, int] = {}
    for r in classes:
        sizes[r["old_shard"]] = sizes.get(r["old_shard"], 0) + r["bytes"]
    new = even_capacities(sum(sizes.values()), capacities) if isinstance(capacities, int) else list(capacities)
    old = sorted(sizes)
    price = cost or (lambda i, j: 0 if i == j else 1)
    if cost is None:
        flow = cheapest_moves([sizes[k] for k in old], new, [k if 0 <= k < len(new) else None for k in old])
    else:
        flow = minimum_cost_flow([sizes[k] for k in old], new, lambda a, j: cost(old[a], j))
    parts: dict[int, list[tuple[int, int]]] = {}
    for (a, j), x in flow.items():
        parts.setdefault(a, []).append((j, x))
    cuts = []
    for a, k in enumerate(old):
        at = 0
        for j, x in sorted(parts.get(a, []), key=lambda p: (price(k, p[0]), p[0])):
            cuts.append((k, at, at + x, j))
            at += x
    block = ["old_shard", "level", "bucket"]
    spark = docs.sparkSession
    dealt = local_table(spark, [(r["old_shard"], r["level"], -(-r["n"] // ROWS_PER_BLOCK)) for r in classes], "old_shard int, level int, buckets int")
    n_blocks = sum(-(-r["n"] // ROWS_PER_BLOCK) for r in classes)
    rows = rows.join(maybe_broadcast(dealt, len(classes)), ["old_shard", "level"]).withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")).cast("int"))
    earlier = Window.partitionBy("old_shard").orderBy("level", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.sum("size").alias("bytes")).select(*block, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*block).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    ranges = local_table(spark, cuts, "cut_shard int, low long, high long, shard int")
    placed = rows.join(maybe_broadcast(blocks, n_blocks), block).withColumn("middle", middle)
    fits = (F.col("old_shard") == F.col("cut_shard")) & (F.col("middle") > F.col("low")) & (F.col("middle") <= F.col("high"))
    placed = written(placed.join(maybe_broadcast(ranges, len(cuts)), fits).select("doc_id", "size", "text_crc32", "row", "shard", *block), "placed")
    group = ["shard", *block]
    ahead = Window.partitionBy("shard").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy(*group).orderBy("row")) - 1
    return placed.join(maybe_broadcast(firsts, n_blocks + len(cuts)), group).select("doc_id", "size", "text_crc32", "old_shard", "shard", slot.cast("long").alias("slot"))


def rewrite_affected(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rewrite in ``path`` the folder of every shard that gains or loses rows (``shard=0``, ``shard=1``, ...); others are not touched.

    The new rows are first written to the shared folder, so ``docs`` may be read
    from ``path`` itself and a lost executor or driver leaves the rows in one of
    the two places. A shard that lost all its rows is left with no rows. Columns
    ``shard`` and ``slot`` of ``docs`` give way to the new ones. Returns the
    affected shards with the bytes that move in.

    Every row of an affected folder must be in the assignment, as a rewritten
    folder holds nothing else: where rows of ``docs`` are missing from it, or it
    has rows that ``docs`` has not, nothing is written and a ``ValueError`` says
    how many.

    Defined results: rows without id and rows with one id and equal texts are
    told apart by their order (as many as the assignment has go to each shard);
    an empty assignment of empty documents rewrites nothing; other columns are
    kept.
    """
    change = assignment.where("old_shard != shard")
    ends = change.select(F.col("old_shard").alias("s")).union(change.select("shard"))
    affected = [r["s"] for r in ends.distinct().orderBy("s").collect()]  # no more than there are shards
    docs = docs.drop("shard", "slot")
    own_id, own_crc, own_rank = (fresh(docs, x) for x in ("id", "crc", "rank"))
    alike = [own_id, own_crc]
    ranked = lambda df, order: df.withColumn(own_rank, F.row_number().over(Window.partitionBy(*alike).orderBy(order)))
    left = docs.withColumn(own_id, F.col(f"`{id_col}`")).withColumn(own_crc, F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("binary")), F.lit(-1)))
    right = assignment.select(F.col("doc_id").alias(own_id), F.coalesce("text_crc32", F.lit(-1)).alias(own_crc), "shard", "slot", "old_shard")
    left, right = ranked(left, F.monotonically_increasing_id()), ranked(right, F.struct("old_shard", "shard", "slot")).drop("old_shard")
    names = [f"`{c}`" for c in docs.columns]
    same = left[own_id].eqNullSafe(right[own_id]) & (left[own_crc] == right[own_crc]) & (left[own_rank] == right[own_rank])
    own_has, new_has = fresh(docs, "has"), fresh(docs, "assigned")
    both = left.withColumn(own_has, F.lit(1)).join(right.withColumn(new_has, F.lit(1)), same, "full").select(*names, "shard", "slot", own_has, new_has)
    lone = F.col(own_has).isNull() | F.col(new_has).isNull()
    rows = written(both.where(lone | F.col("shard").isin(affected)), "rewritten")
    odd = rows.agg(F.count_if(F.col(new_has).isNull()), F.count_if(F.col(own_has).isNull())).first()
    if any(odd):
        raise ValueError(f"{odd[0]} rows are not in the assignment, {odd[1]} of the assignment are not among the rows")
    rows = rows.drop(own_has, new_has)
    dealt = rows.repartition("shard", F.floor(F.col("slot") / ROWS_PER_BLOCK))
    if affected:
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {r["shard"] for r in rows.select("shard").distinct().collect()}
    for k in affected:
        if k not in filled:
            rows.drop("shard").limit(0).write.mode("overwrite").parquet(f"{path}/shard={k}")
    moved_in = change.groupBy("shard").agg(F.sum("size").alias("bytes_in"))
    table = local_table(docs.sparkSession, [(k,) for k in affected], "shard int")
    return table.join(moved_in, "shard", "left").select("shard", F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"))
