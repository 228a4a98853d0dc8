"""Resharding by minimum-cost flow.

Rows lie in old shards; the new shards get capacities.  Rows are hashed into blocks of their old
shard, whose sizes are one aggregate.  Old shard ``i`` becomes new shard ``i`` where both exist,
so bytes that stay cost nothing and every byte sent elsewhere costs one: the cheapest flow from
old sizes to new capacities keeps as much as fits in each shard and sends only the excess of
shards that are too large to those with room.  ``cheapest_flow`` solves that transport problem by
successive shortest paths, and ``assign_blocks`` gives whole blocks to the flows, the tightest
fit last, so that sizes end within about one block of their capacities.

The driver holds one row a block.  Their number is set by parameters (old shards x blocks, plus
the parts of heavy blocks), not by the number of rows.  A heavy block is cut by the digest of the text, so
equal texts of one old shard stay together; only a text that alone takes more than ``1 / SPLIT`` of a
shard is cut by the row, and there are fewer than ``SPLIT`` x shards of these.

A row's shard follows from its old shard, its text and, for those few texts, its key, so the
affected shards are rewritten without any shuffle of texts: each task writes its rows into the folders of their
shards.  Slots are gapless without a global sort: the rank inside a block's part plus the rows of the
parts before it in the shard.

Defined results: a null text has no bytes (size 1); repeated rows take a slot each and are written as
often as they occur; an empty table gives an empty result; other columns, of any name, are ignored by
``reshard`` and kept by ``rewrite``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide.llm.storage import written

#: blocks of one old shard, and parts of one shard's size that a block may reach before it is cut
BLOCKS, FINE = 512, 512
#: share of a shard from which the copies of one text are cut by the row
SPLIT = 20


@dataclass(frozen=True)
class Block:
    old: int
    block: int
    part: int
    size: int
    rows: int


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def cheapest_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard so that capacities hold and the fewest bytes move.

    Successive shortest paths on the transport network: a unit from old i to new j costs 0 if
    i = j and 1 otherwise.  Each round finds the cheapest path in the residual network."""
    assert sum(sizes) <= sum(capacities)
    n, m = len(sizes), len(capacities)
    flow: dict[tuple[int, int], int] = {}
    supply, room = list(sizes), list(capacities)
    while any(supply):
        # nodes 0..n-1 old, n..n+m-1 new; distances from all old shards with supply
        far = [float("inf")] * (n + m)
        back: list[int | None] = [None] * (n + m)
        for i in range(n):
            if supply[i]:
                far[i] = 0
        for _ in range(n + m):  # costs on reverse edges are negative, so relax in rounds
            changed = False
            for i in range(n):
                for j in range(m):
                    cost = int(i != j)
                    if far[i] + cost < far[n + j]:
                        far[n + j], back[n + j], changed = far[i] + cost, i, True
                    if flow.get((i, j)) and far[n + j] - cost < far[i]:
                        far[i], back[i], changed = far[n + j] - cost, n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j], j))
        path, node = [n + end], back[n + end]
        while node is not None:
            path.append(node)
            node = back[node]
        path.reverse()
        amount = min(supply[path[0]], room[end])
        for a, b in zip(path, path[1:]):
            if a >= n:  # against the direction of a flow
                amount = min(amount, flow[(b, a - n)])
        for a, b in zip(path, path[1:]):
            edge, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        supply[path[0]] -= amount
        room[end] -= amount
    return {edge: amount for edge, amount in flow.items() if amount}


def assign_blocks(blocks: list[Block], flow: dict[tuple[int, int], int], capacities: list[int]) -> dict[tuple, int]:
    """New shard of every block.

    Blocks leave an old shard for its flows, largest first, each where it misses most; small ones
    come last and even out what the larger ones left."""
    need = dict(flow)
    out: dict[tuple, int] = {}
    targets: dict[int, list[int]] = {}
    for i, j in flow:
        targets.setdefault(i, []).append(j)
    for b in sorted(blocks, key=lambda b: (-b.size, b.old, b.block, b.part)):
        j = max(targets.get(b.old, [b.old % len(capacities)]), key=lambda j: (need.get((b.old, j), 0), j == b.old, -j))
        need[(b.old, j)] = need.get((b.old, j), 0) - b.size
        out[(b.old, b.block, b.part)] = j
    # the errors of several flows into one shard may add up: move the smallest blocks that help
    have = [0] * len(capacities)
    members: list[list] = [[] for _ in capacities]
    for b in blocks:
        j = out[(b.old, b.block, b.part)]
        have[j] += b.size
        heapq.heappush(members[j], (b.size, b.old, b.block, b.part))
    for _ in range(len(blocks)):
        high = max(range(len(have)), key=lambda j: have[j] - capacities[j])
        low = min(range(len(have)), key=lambda j: have[j] - capacities[j])
        gap = (have[high] - capacities[high]) - (have[low] - capacities[low])
        if not members[high] or not 0 < members[high][0][0] < gap:
            break
        size, *name = heapq.heappop(members[high])
        out[tuple(name)] = low
        have[high] -= size
        have[low] += size
        heapq.heappush(members[low], (size, *name))
    return out


@dataclass
class Moves:
    """Where every row goes: blocks with their shards, how blocks are cut, and the shards that change."""

    cuts: list[tuple]  # old, block, parts: cut by the digest of the text
    texts: list[tuple]  # old, block, digest, first part, parts: cut by the row
    places: list[tuple]  # old, block, part, shard, rows of the shard before it
    affected: set[int]


def _located(old: Column, key: Column, text: Column) -> dict[str, Column]:
    """What decides where a row goes."""
    body = F.coalesce(text, F.lit(""))
    return {
        "_old": old.cast("int"),
        "_block": F.pmod(F.xxhash64(body), F.lit(BLOCKS)).cast("int"),
        "_digest": F.xxhash64(body, F.lit(1)),
        "_spread": F.pmod(F.xxhash64(key, body, F.lit(2)), F.lit(1 << 20)).cast("int"),
    }


def _narrow(docs: DataFrame, old: Column, key: str, text: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[key].alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *[c.alias(n) for n, c in _located(old, docs[key], docs[text]).items()],
    )


def _with_part(rows: DataFrame, cuts: list[tuple], texts: list[tuple]) -> DataFrame:
    """Rows with the part of their block; the tables are bounded by parameters."""
    spark = rows.sparkSession
    cut = spark.createDataFrame(cuts, "_old int, _block int, _parts long")
    own = spark.createDataFrame(texts, "_old int, _block int, _digest long, _from long, _pieces long")
    rows = rows.join(F.broadcast(cut), ["_old", "_block"], "left").join(F.broadcast(own), ["_old", "_block", "_digest"], "left")
    by_text = F.coalesce(F.pmod(F.col("_digest"), F.col("_parts")), F.lit(0))
    by_row = F.col("_from") + F.pmod(F.col("_spread"), F.col("_pieces"))
    return rows.withColumn("_part", F.coalesce(by_row, by_text).cast("int")).drop("_parts", "_from", "_pieces")


def plan_moves(rows: DataFrame, n_old: int, n_new: int, capacities: list[int] | None = None) -> Moves:
    """The moves for narrow rows (``_old, _block, _digest, _spread, size``), which are read several times."""
    sizes = rows.groupBy("_old", "_block").agg(F.sum("size").alias("_size")).collect()
    total = sum(r["_size"] for r in sizes)
    limit, split = max(1, total // (n_new * FINE)), max(1, total // (n_new * SPLIT))
    cuts = {(r["_old"], r["_block"]): -(-r["_size"] // limit) for r in sizes if r["_size"] > 2 * limit}
    # texts that are too large to stay whole: fewer than SPLIT x shards
    heavy = rows.groupBy("_old", "_block", "_digest").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n"))
    heavy = heavy.where((F.col("_size") > split) & (F.col("_n") > 1)).orderBy("_old", "_block", "_digest").collect()
    texts, used = [], {}
    for r in heavy:
        name = (r["_old"], r["_block"])
        first = used.get(name, cuts.get(name, 1))
        pieces = min(r["_n"], -(-r["_size"] // limit))
        texts.append((*name, r["_digest"], first, pieces))
        used[name] = first + pieces
    cuts = [(*name, n) for name, n in sorted(cuts.items())]
    name = ["_old", "_block", "_part"]
    found = _with_part(rows, cuts, texts).groupBy(*name).agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n")).collect()
    blocks = [Block(r["_old"], r["_block"], r["_part"], r["_size"], r["_n"]) for r in found]
    before = [0] * n_old
    for b in blocks:
        before[b.old] += b.size
    capacities = capacities or even(total, n_new)
    target = assign_blocks(blocks, cheapest_flow(before, capacities), capacities)
    places, taken, affected = [], [0] * n_new, set()
    for b in sorted(blocks, key=lambda b: (b.old, b.block, b.part)):
        shard = target[(b.old, b.block, b.part)]
        places.append((b.old, b.block, b.part, shard, taken[shard]))
        taken[shard] += b.rows
        if shard != b.old:
            affected |= {shard, b.old}
    return Moves(cuts, texts, places, affected & set(range(n_new)))


def _placed(rows: DataFrame, moves: Moves) -> DataFrame:
    """Rows with ``_part``, ``_shard`` and ``_first``, without a shuffle."""
    table = rows.sparkSession.createDataFrame(moves.places, "_old int, _block int, _part int, _shard int, _first long")
    return _with_part(rows, moves.cuts, moves.texts).join(F.broadcast(table), ["_old", "_block", "_part"])


def _slotted(rows: DataFrame, moves: Moves, key: str) -> DataFrame:
    """Narrow rows -> key, size, text_crc32, old_shard, shard, slot."""
    order = Window.partitionBy("_old", "_block", "_part").orderBy("_spread", "_key", "size", "text_crc32")
    return (
        _placed(rows, moves)
        .withColumn("_rank", F.row_number().over(order) - 1)
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            F.col("_old").alias("old_shard"),
            F.col("_shard").alias("shard"),
            (F.col("_first") + F.col("_rank")).cast("long").alias("slot"),
        )
    )


def reshard(
    docs: DataFrame,
    old: Column,
    n_old: int,
    n_new: int,
    key: str = "doc_id",
    text: str = "text",
    capacities: list[int] | None = None,
) -> DataFrame:
    """One row per document: key, size, text_crc32, old shard, new shard and slot.

    ``capacities`` are the target bytes of the new shards, by default equal ones."""
    rows = written(_narrow(docs, old, key, text), "reshard")
    return _slotted(rows, plan_moves(rows, n_old, n_new, capacities), key)


def rewrite(docs: DataFrame, moves: Moves, old: Column, folder: str, key: str = "doc_id", text: str = "text") -> str:
    """Write the new contents of the shards that change, one folder a shard; the others keep their files.

    A shard changes if a row enters or leaves it.  Returns the name of the folders' column: ``_shard``,
    with underscores behind it if the rows have such a column."""
    name = "_shard"
    while name in docs.columns:
        name += "_"
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in _located(old, docs[key], docs[text]).items()])
    rows = _placed(rows, moves).where(F.col("_shard").isin(sorted(moves.affected)))
    rows.select("_row.*", F.col("_shard").alias(name)).write.mode("overwrite").partitionBy(name).parquet(folder)
    return name


def rewritten(
    docs: DataFrame,
    old: Column,
    n_old: int,
    n_new: int,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    capacities: list[int] | None = None,
) -> DataFrame:
    """As ``reshard``, with the affected shards rewritten below ``folder`` and the rows of these taken from
    what was written there.  ``old`` may use the key and the text."""
    spark = docs.sparkSession
    rows = written(_narrow(docs, old, key, text), "reshard")
    moves = plan_moves(rows, n_old, n_new, capacities)
    if not moves.places:
        return _slotted(rows, moves, key)
    stay = _placed(rows, moves).where(~F.col("_shard").isin(sorted(moves.affected))).select(*rows.columns)
    if moves.affected:
        body = docs.select(docs[key].alias(key), docs[text].alias(text))
        rewrite(body, moves, old, folder, key, text)
        again = spark.read.schema(body.schema).parquet(folder)
        stay = stay.unionByName(_narrow(again, old, key, text))
    return _slotted(stay, moves, key)
