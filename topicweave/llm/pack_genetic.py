"""Packing by a grouping genetic algorithm, distributed as islands.

Pieces as long as a sequence are sequences of their own. The others are dealt at
random to shards of bounded size, and each shard is packed on some islands. An island
has a population of packings. A child takes whole well-filled sequences of one parent,
loses the sequences of the other parent that hold the same pieces, and gets their
remaining pieces back by best fit, longest first or nearly so. After each epoch the best packing of
an island migrates to the next island of its shard. The best packing has the fewest sequences, and of such the most uneven
ones. What it leaves in poorly filled sequences is dealt to shards once more, together with what other shards left, and
evolves there in the same way, for as long as that takes fewer sequences than before.

* Repeated rows and ties are packed one by one like other pieces.
* An empty table gives an empty packing. Columns besides ``length`` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.pieces import CAPACITY, pieces
from topicweave.plans.tables import materialise

#: Pieces of a shard; bounds the memory of a task.
SHARD = 8192
ISLANDS = 4
EPOCHS = 3
POPULATION = 4
#: Children that an island makes in an epoch, unless no packing can be better.
CHILDREN = 8
#: How much the order of lengths is disturbed in every other child.
DISTURBED = 0.1
#: A shard of leftovers is this many times larger.
TOGETHER = 8
#: More than the sequences of any shard.
SEQUENCES = 1 << 32
#: Share of a sequence's tokens from which it is well filled.
WELL_FILLED = 0.999


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, owner: np.ndarray, fill: list[int]) -> None:
    """Put the pieces of ``order`` where they leave the least room; opens sequences as needed.

    ``owner`` gets the sequence of each piece, ``fill`` has the tokens in each
    sequence. ``open_rooms`` has a bit for every room that some sequence has left.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for sequence in range(len(fill) - 1, -1, -1):
        room = capacity - fill[sequence]
        if 0 < room < capacity:
            rooms[room].append(sequence)
            open_rooms |= 1 << room
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        able = open_rooms >> length
        if able:
            room = length + (able & -able).bit_length() - 1
            sequence = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room = capacity
            sequence = len(fill)
            fill.append(0)
        owner[item] = sequence
        fill[sequence] += length
        room -= length
        if room:
            rooms[room].append(sequence)
            open_rooms |= 1 << room


def fitness(lengths: np.ndarray, owner: np.ndarray, capacity: int) -> float:
    """Mean square of how full the sequences are: higher with fewer and more uneven ones."""
    fill = np.bincount(owner, weights=lengths)
    return float(((fill / capacity) ** 2).sum() / (fill > 0).sum())


def _compact(owner: np.ndarray) -> np.ndarray:
    return np.unique(owner, return_inverse=True)[1].astype(np.int32)


def founder(lengths: np.ndarray, capacity: int, rng: np.random.Generator, spread: float) -> np.ndarray:
    """Best fit of the pieces from long to short, the order disturbed by ``spread``."""
    order = np.argsort(-lengths * (1 + spread * rng.standard_normal(len(lengths))), kind="stable")
    owner = np.zeros(len(lengths), dtype=np.int32)
    best_fit(lengths, order, capacity, owner, [])
    return owner


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int,
              rng: np.random.Generator) -> np.ndarray:
    """A child with well-filled sequences of the mother among those of the father."""
    full = np.bincount(mother, weights=lengths)
    well = np.flatnonzero(full >= WELL_FILLED * capacity)
    if not len(well):
        well = np.array([int(full.argmax())])
    chosen = np.zeros(len(full), dtype=bool)
    chosen[rng.permutation(well)[: max(1, len(well) // 2)]] = True
    injected = chosen[mother]
    broken = np.zeros(int(father.max()) + 1, dtype=bool)
    broken[father[injected]] = True
    fathers_fill = np.bincount(father, weights=lengths)
    broken |= (fathers_fill < WELL_FILLED * capacity) & (rng.random(len(broken)) < 0.5)
    displaced = broken[father] & ~injected
    child = np.where(injected, mother + len(broken), father)
    child[displaced] = -1
    kept = ~displaced
    child[kept] = _compact(child[kept])
    fill = np.bincount(child[kept], weights=lengths[kept]).astype(int).tolist() if kept.any() else []
    order = np.flatnonzero(displaced)
    spread = DISTURBED * rng.integers(2)
    best_fit(lengths, order[np.argsort(-lengths[order] * (1 + spread * rng.standard_normal(len(order))), kind="stable")], capacity, child, fill)
    return child.astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Make children of chosen parents; those of the fewest sequences and the highest fitness stay, best first."""
    def ranked_as(number: int, packing: np.ndarray) -> tuple[int, float, int, np.ndarray]:
        return int(packing.max()) + 1, -fitness(lengths, packing, capacity), number, packing

    ranked = sorted((ranked_as(i, p) for i, p in enumerate(population)), key=lambda x: x[:3])
    least = -(-int(lengths.sum()) // capacity)
    for n in range(CHILDREN):
        if ranked[0][0] <= least:
            break
        first, second = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        child = crossover(lengths, ranked[min(first, second)][3], ranked[max(first, second)][3], capacity, rng)
        ranked = sorted([*ranked, ranked_as(len(population) + n, child)], key=lambda x: x[:3])[:POPULATION]
    return [p for *_, p in ranked]


def _sorted(items: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a shard in an order that does not depend on how they arrived."""
    return items.sort_values("item", kind="stable", ignore_index=True)


def _settled(items: DataFrame, capacity: int) -> DataFrame:
    """Best packing of each shard: ``shard`` and ``elite``, the sequence of each piece."""

    def settle(items: pd.DataFrame) -> pd.DataFrame:
        lengths = _sorted(items)["length"].to_numpy(dtype=np.int64)
        shard = int(items["shard"].iloc[0])
        islands = []
        for island in range(ISLANDS):
            rng = np.random.default_rng([shard, island])
            founders = [founder(lengths, capacity, rng, 0.1 * (i + island)) for i in range(POPULATION)]
            islands.append((shard, island, lengths.astype("<i4").tobytes(), [p.astype("<i4").tobytes() for p in founders]))
        return pd.DataFrame(islands, columns=["shard", "island", "lengths", "population"])

    def epoch(number: int):
        def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lived = []
                for row in batch.itertuples():
                    lengths = np.frombuffer(row.lengths, dtype="<i4").astype(np.int64)
                    people = [np.frombuffer(p, dtype="<i4") for p in row.population]
                    if number and row.migrant is not None:
                        people.append(np.frombuffer(row.migrant, dtype="<i4"))
                    people = evolve(lengths, people, capacity, np.random.default_rng([row.shard, row.island, number]))
                    lived.append((row.shard, row.island, row.lengths, [p.tobytes() for p in people], people[0].tobytes(),
                                  int(people[0].max()) + 1, fitness(lengths, people[0], capacity)))
                yield pd.DataFrame(lived, columns=["shard", "island", "lengths", "population", "elite", "sequences", "fitness"])
        return live

    state = "shard long, island int, lengths binary, population array<binary>"
    islands = items.select("shard", "item", "length").groupBy("shard").applyInPandas(settle, state)
    for number in range(EPOCHS):
        if number:
            migrants = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                      F.col("elite").alias("migrant"))
            islands = islands.drop("elite", "sequences", "fitness").join(migrants, ["shard", "island"], "left")
        islands = materialise(islands.mapInPandas(epoch(number), f"{state}, elite binary, sequences int, fitness double"), "islands")
    return islands.groupBy("shard").agg(
        F.max_by("elite", F.struct(-F.col("sequences"), "fitness", -F.col("island"))).alias("elite"))


def _placed(items: DataFrame, elites: DataFrame, capacity: int) -> DataFrame:
    """Sequence and place in it of each piece, and whether the sequence is ``poor``, that is not well filled."""

    def place(key: tuple, items: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        items = _sorted(items)
        names = ["item", "length", "sequence_id", "offset", "poor"]
        if not len(items):
            return pd.DataFrame({name: [] for name in names})
        owner = np.frombuffer(elite["elite"].iloc[0], dtype="<i4")
        lengths = items["length"].to_numpy(dtype=np.int64)
        poor = np.bincount(owner, weights=lengths)[owner] < WELL_FILLED * capacity
        return pd.DataFrame(dict(zip(names, (items["item"], lengths, int(key[0]) * SEQUENCES + owner.astype(np.int64),
                                             _offsets(owner, lengths), poor), strict=True)))

    return (items.select("shard", "item", "length").groupBy("shard").cogroup(elites.groupBy("shard"))
            .applyInPandas(place, "item long, length long, sequence_id long, offset long, poor boolean"))


def _offsets(owner: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.unique(owner[order], return_index=True)[1]
    offsets = np.empty(len(owner), dtype=np.int64)
    offsets[order] = starts - np.repeat(starts[first], np.diff([*first, len(owner)]))
    return offsets


def _evolved(items: DataFrame, capacity: int, first_shard: int, shards: int, name: str) -> DataFrame:
    """Deal the pieces to shards, numbered from ``first_shard`` on, and place them as the best packing of each does."""
    dealt = F.pmod(F.xxhash64("item", F.lit(first_shard)), F.lit(shards)) + first_shard
    items = materialise(items.select("item", "length", dealt.alias("shard")), "items")
    return materialise(_placed(items, materialise(_settled(items, capacity), "elites"), capacity), name)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack the rows of ``table``, which have a ``length`` from 1 to ``capacity``.

    Adds ``sequence_id`` and ``offset``. Lengths are packed whole. Rows are numbered where they are written: numbers given in a
    scan would follow its splits, which another scan may cut differently.
    """
    numbered = materialise(table.withColumn("item", F.monotonically_increasing_id()), "pieces")
    part = numbered.where(F.col("length") < capacity).select("item", "length")
    shards = max(1, -(-part.count() // SHARD))
    placed = _evolved(part, capacity, 0, shards, "placed")
    first = shards
    while True:
        poor = placed.where("poor")
        left, before = poor.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        shards = -(-left // (TOGETHER * SHARD))
        again = _evolved(poor, capacity, first, max(1, shards), "placed_again")
        if again.select("sequence_id").distinct().count() >= before:
            break
        placed = materialise(placed.where("NOT poor").unionByName(again), "placed")
        if shards <= 1:
            break
        first += shards
    found = materialise(placed.select("item", "sequence_id", "offset"), "packed")
    whole = numbered.where(F.col("length") >= capacity)
    return (numbered.where(F.col("length") < capacity).join(found, "item")
            .unionByName(whole.withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long")))
            .drop("item"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents: one row for each piece with its sequence and its place there."""
    return pack(pieces(docs, capacity), capacity)
