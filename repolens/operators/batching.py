"""Token-bounded batching of texts, and merging of partial results.

Next-fit batching is a chain: where a batch ends tells where the next begins. The rows of all groups stand in one order and are cut into blocks of as many rows. A block works out, for each row that could be the first to begin a batch in it, at which row the block's last batch would begin. This leaves a chain over blocks, whose members are found by pointer doubling: each round doubles how far a row's pointer reaches. Then every block knows the batch that is open where it begins, and deals out its own rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..scratch import Scratch, numbered
from ..session import ship

#: Rows of a block: at least so many, and enough for so many batches on average; more where there would be more than MOST_BLOCKS blocks, as the driver holds a few numbers for each.
BLOCK_ROWS, BLOCK_BATCHES, MOST_BLOCKS = 65_536, 16, 100_000


class Summary(NamedTuple):
    """Of each block: characters before it, and the first and last group that begins in it (their first row, and the characters before that; -1 if none does)."""

    before: np.ndarray
    first: np.ndarray
    first_at: np.ndarray


def most_chars(limit: float, chars_per_token: float) -> int:
    """The largest number of characters whose tokens don't exceed a limit."""
    most = int(limit * chars_per_token)
    while (most + 1) / chars_per_token <= limit:
        most += 1
    while most / chars_per_token > limit:
        most -= 1
    return most


def _rows(table: pa.Table, block: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, characters, and whether a group begins, of the rows of a block in order. The row before the block is there, too, to tell whether its group goes on."""
    idx = table.column("idx").to_numpy()
    order = np.argsort(idx, kind="stable")
    idx, n = idx[order], table.column("n").to_numpy()[order]
    names = np.stack([table.column(c).to_numpy()[order] for c in ("g1", "g2")])
    begins = np.r_[True, (names[:, 1:] != names[:, :-1]).any(axis=0)]
    own = idx >= block * size
    return idx[own], n[own], begins[own]


def _successors(n: np.ndarray, begins: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters before each row (and after the last), and for each row the row at which the batch after one that begins there begins; len(n) if that is in a later block."""
    at = np.r_[0, np.cumsum(n)]
    fit = np.searchsorted(at[1:], at[:-1] + most, side="right")
    groups = np.flatnonzero(begins)
    following = np.r_[groups, len(n)][np.searchsorted(groups, np.arange(len(n)), side="right")]
    return at, np.minimum(fit, following)


def _ends(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the last batch start of its chain within the block, and the number of steps to it."""
    rows = len(following)
    jump = np.where(following < rows, following, np.arange(rows))
    steps = (following < rows).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, steps
        steps, jump = steps + steps[jump], further


NODES = "block bigint, idx bigint, at bigint, last bigint, last_at bigint, steps bigint, group_steps bigint, next bigint, next_at bigint, next_block bigint"


def _nodes(key: tuple, table: pa.Table, size: int, most: int, all_blocks: Summary) -> pa.Table:
    """Rows that may be the first to begin a batch in a block: those within the first batch's length, up to the first that begins a group. Each with the last start that follows from it, the steps to it and to the last group's first row (-1 if none begins), and where the next start is: next is its row if it begins a group, else it is the row that holds next_at."""
    block = key[0].as_py()
    idx, n, begins = _rows(table, block, size)
    at, following = _successors(n, begins, most)
    last, steps = _ends(following)
    groups = np.flatnonzero(begins)
    may = np.arange(len(n))[: groups[0] + 1 if len(groups) else None]
    may = may[at[may] <= most]
    if block == 0:
        may = may[:1]
    offset = all_blocks.before[block]
    group_steps = steps[may] - steps[groups[-1]] if len(groups) else np.full(len(may), -1)
    end_at = offset + at[last[may]]
    later = np.flatnonzero(all_blocks.first[block + 1 :] >= 0)
    group, group_at = (all_blocks.first[block + 1 + later[0]], all_blocks.first_at[block + 1 + later[0]]) if len(later) else (-1, np.iinfo(np.int64).max)
    fits = end_at + most < group_at
    target = np.where(fits, end_at + most, group_at)
    where = np.where(fits, np.searchsorted(all_blocks.before[:-1], target, side="right") - 1, group // size)
    none = target >= all_blocks.before[-1] if group < 0 else np.zeros(len(may), bool)
    columns = [np.full(len(may), block), idx[may], offset + at[may], idx[last[may]], end_at, steps[may], group_steps, np.where(fits, -1, group), target, np.where(none, -1, where)]
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[c.split()[0] for c in NODES.split(", ")])


def _linked(nodes: DataFrame) -> DataFrame:
    """idx, next row (null at the end) and steps to it. A place among characters belongs to the last row that begins at or before it; nodes and places of a block are sorted together for this."""
    probe = nodes.where("next < 0 and next_block >= 0").select(F.col("next_block").alias("block"), F.col("next_at").alias("at"), F.lit(1).alias("kind"), F.col("idx"), F.col("steps"))
    both = nodes.select("block", "at", F.lit(0).alias("kind"), "idx", "steps").unionByName(probe)
    holder = F.last(F.when(F.col("kind") == 0, F.col("idx")), ignorenulls=True).over(Window.partitionBy("block").orderBy("at", "kind", "idx"))
    found = both.withColumn("next", holder).where("kind = 1").select("idx", "next", (F.col("steps") + 1).alias("steps"))
    direct = nodes.where("next >= 0").select("idx", "next", (F.col("steps") + 1).alias("steps"))
    return found.unionByName(direct)


def _chain(nodes: DataFrame, tmp: Scratch) -> DataFrame:
    """idx and number (0, 1, ...) of the first batch start of each block, from row 0 on, by pointer doubling."""
    links = tmp.save(_linked(nodes), "links0")
    found = nodes.where("idx = 0").select("idx", F.lit(0).cast("long").alias("number"))
    k = 0
    while not links.isEmpty():
        step = found.join(links, "idx").select(F.col("next").alias("idx"), (F.col("number") + F.col("steps")).alias("number"))
        found = tmp.save(found.unionByName(step), f"found{k}")
        beyond = links.select(F.col("idx").alias("next"), F.col("next").alias("_further"), F.col("steps").alias("_more"))
        k += 1
        links = tmp.save(links.join(beyond, "next").select("idx", F.col("_further").alias("next"), (F.col("steps") + F.col("_more")).alias("steps")), f"links{k}")
    return found


def _summaries(key: tuple, table: pa.Table, size: int) -> pa.Table:
    idx, n, begins = _rows(table, key[0].as_py(), size)
    groups = np.flatnonzero(begins)
    first = (idx[groups[0]], n[: groups[0]].sum()) if len(groups) else (-1, 0)
    return pa.table({"block": [key[0].as_py()], "chars": [int(n.sum())], "first": [int(first[0])], "first_at": [int(first[1])]})


def _dealt(key: tuple, table: pa.Table, size: int, most: int, opened: list[np.ndarray], before: np.ndarray) -> pa.Table:
    """batch and item of each row of a block. opened: of each block, of the batch that is open before it, its first row, characters before that, its number, and the number of the first batch of its group."""
    block = key[0].as_py()
    idx, n, begins = _rows(table, block, size)
    at, following = _successors(n, begins, most)
    start, start_at, number, group_number = (int(o[block]) for o in opened)
    groups = np.flatnonzero(begins)
    limit = start_at + most - before[block]  # characters of this block that fit the open batch
    first = int(np.searchsorted(at[1:], limit, side="right")) if block else 0
    first = min(first, groups[0] if len(groups) else len(n))
    starts = np.zeros(len(n) + 1, bool)
    row = first
    while row < len(n):
        starts[row] = True
        row = following[row]
    order = np.cumsum(starts[:-1])  # batches that began in this block up to a row
    heads = np.r_[start, idx[starts[:-1]]]
    numbers = number + np.arange(len(heads))
    first_of_group = np.r_[group_number, numbers[order[groups]]] if len(groups) else np.array([group_number])
    batch = numbers[order] - first_of_group[np.cumsum(begins)]
    return pa.table({"idx": idx, "batch": batch.astype(np.int32), "item": (idx - heads[order]).astype(np.int32)})


def token_batches(items: DataFrame, group: str, order: list[str], text: str, max_tokens: int, ratio: float = V.BATCH_RATIO, chars_per_token: float = V.CHARS_PER_TOKEN, block_rows: int | None = None) -> DataFrame:
    """Next-fit batches of a group's texts in order: group, batch, item (0, 1, ...), text.

    A batch takes texts while their tokens fit into max_tokens * ratio; a longer text is cut to fit a batch of its own. Lengths are compared in characters, as whole numbers. Null texts are left out, empty ones stand in the batch that is open. Texts that share group and place are ordered by themselves. Groups may be of any size: no task holds more than a block of rows, without their texts, and the time is linear in the number of rows.
    """
    ship(items.sparkSession)
    limit = max_tokens * ratio
    most = most_chars(limit, chars_per_token)
    long = F.char_length(text) > most
    rows = items.where(F.col(text).isNotNull()).select(F.col(group).alias("_g"), F.struct(*order).alias("_o"), F.when(long, F.substring(text, 1, int(limit * chars_per_token))).otherwise(F.col(text)).alias("_t"), F.when(long, most).otherwise(F.char_length(text)).cast("long").alias("n"))
    with Scratch(items.sparkSession, "batches") as tmp:
        placed = numbered(rows, tmp, [F.col("_g"), F.col("_o"), F.col("_t")], "placed")
        total, chars = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS), min(1 << 22, BLOCK_BATCHES * most * total // max(1, chars)))
        block = F.expr(f"idx div {size}")
        blocks = F.when((F.col("idx") + 1) % size == 0, F.array(block, block + 1)).otherwise(F.array(block))
        keyed = placed.select("idx", "n", F.xxhash64("_g").alias("g1"), F.xxhash64("_g", F.lit("second")).alias("g2"), F.explode(blocks).alias("block")).where(F.col("block") * size < total)
        count = -(-total // size)
        places = _deal(keyed, tmp, size, most, count)
    return placed.join(places, "idx").select(F.col("_g").alias(group), "batch", "item", F.col("_t").alias("text"))


def _deal(keyed: DataFrame, tmp: Scratch, size: int, most: int, count: int) -> DataFrame:
    """idx, batch and item of all rows."""
    opened = [np.zeros(max(1, count), np.int64) for _ in range(4)]
    opened[2][0] = -1  # the first batch of all is yet to begin
    before = np.zeros(max(1, count) + 1, np.int64)
    if count > 1:
        all_blocks = Summary(before, np.full(count, -1), np.zeros(count, np.int64))
        chars = np.zeros(count, np.int64)
        for r in keyed.groupBy("block").applyInArrow(lambda k, t: _summaries(k, t, size), "block bigint, chars bigint, first bigint, first_at bigint").collect():  # at most MOST_BLOCKS rows
            chars[r["block"]], all_blocks.first[r["block"]], all_blocks.first_at[r["block"]] = r["chars"], r["first"], r["first_at"]
        before[1:] = np.cumsum(chars)
        all_blocks.first_at[:] += before[:-1]
        nodes = tmp.save(keyed.groupBy("block").applyInArrow(lambda k, t: _nodes(k, t, size, most, all_blocks), NODES), "nodes")
        reached = nodes.join(_chain(nodes, tmp), "idx").select("block", "last", "last_at", "steps", "group_steps", "number").orderBy("block").collect()  # at most one row of each block
        now, group_number, at = (0, 0, -1), 0, 0
        for r in reached:
            for b in range(at, r["block"] + 1):
                opened[0][b], opened[1][b], opened[2][b], opened[3][b] = *now, group_number
            at = r["block"] + 1
            now = r["last"], r["last_at"], r["number"] + r["steps"]
            group_number = r["number"] + r["group_steps"] if r["group_steps"] >= 0 else group_number
        for b in range(at, count):
            opened[0][b], opened[1][b], opened[2][b], opened[3][b] = *now, group_number
    return tmp.save(keyed.groupBy("block").applyInArrow(lambda k, t: _dealt(k, t, size, most, opened, before), "idx bigint, batch int, item int"), "places", keep=True)


def strategies(batches: DataFrame, group: str) -> DataFrame:
    """A single pass for groups of one batch, map and reduce for others."""
    n = batches.groupBy(group).agg((F.max("batch") + 1).cast("long").alias("batches"))
    return n.withColumn("strategy", F.when(F.col("batches") == 1, "single-pass").otherwise("map-reduce"))


#: Most groups whose starts go to every task; those of more groups are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def _positioned(elements: DataFrame, group: str, order: list[str]) -> DataFrame:
    """group, position (0, 1, ... within a group) and element. A position is a place in the order of all rows less the group's first, so a group of any size is spread over tasks."""
    with Scratch(elements.sparkSession, "combined") as tmp:
        placed = numbered(elements, tmp, [F.col(group), *(F.col(o) for o in order), F.col("element")], "elements")
        starts = tmp.save(placed.groupBy(F.col(group).alias("_g")).agg(F.min("idx").alias("_start")), "starts", keep=True)
        few = starts.count() <= BROADCAST_GROUPS
    out = placed.join(F.broadcast(starts) if few else starts, F.col(group).eqNullSafe(F.col("_g")))
    return out.select(group, (F.col("idx") - F.col("_start")).alias("position"), "element")


def combined_elements(partials: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Elements of partial results' lists, one list after the other, repeats kept: group, position, element. Null lists count as empty."""
    return _positioned(partials.select(group, F.col(order).alias("_o"), F.posexplode(column).alias("_i", "element")), group, ["_o", "_i"])


def combined_fields(partials: DataFrame, group: str, order: str, column: str) -> dict[str, DataFrame]:
    """combined_elements of each array field of partial results that are structs, by the field's name; other fields drop out."""
    fields = [f.name for f in partials.schema[column].dataType.fields if f.dataType.typeName() == "array"]
    return {f: combined_elements(partials.select(group, order, F.col(f"{column}.{f}").alias("_list")), group, order, "_list") for f in fields}


def combined_texts(partials: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Texts of partial results that aren't empty: group, position, element."""
    return _positioned(partials.where(F.col(column) != "").select(group, F.col(order).alias("_o"), F.col(column).alias("element")), group, ["_o"])


def nested(elements: DataFrame, group: str, column: str) -> DataFrame:
    """One row per group with its elements as a list: for a sink whose groups are small, such as a prompt or a report."""
    return elements.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("position", "element"))).alias("r")).select(group, F.transform("r", lambda x: x["element"]).alias(column))


def combine_arrays(partials: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """combined_elements, nested; groups without any element have an empty list."""
    some = nested(combined_elements(partials, group, order, column), group, column)
    return _with_empty(partials.where(F.col(column).isNotNull()), some, group, column, partials.schema[column].dataType)


def combine_objects(partials: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """combined_fields, nested into one struct per group."""
    kinds = {f.name: f.dataType for f in partials.schema[column].dataType.fields}
    out = partials.select(group).distinct()
    for name, elements in combined_fields(partials, group, order, column).items():
        out = _with_empty(out, nested(elements, group, f"_{name}"), group, f"_{name}", kinds[name])
    fields = [c for c in out.columns if c != group]
    return out.select(group, F.struct(*(F.col(c).alias(c[1:]) for c in fields)).alias(column))


def _with_empty(rows: DataFrame, lists: DataFrame, group: str, column: str, kind) -> DataFrame:
    """rows, one per group, with the groups' lists; an empty one where there is none."""
    kept = [c for c in rows.columns if c == group or c.startswith("_")]
    groups = rows.select(*kept).distinct()
    right = lists.select(F.col(group).alias("_g"), column)
    return groups.join(right, F.col(group).eqNullSafe(F.col("_g")), "left").select(*kept, F.coalesce(column, F.array().cast(kind)).alias(column))


def combine_texts(partials: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """combined_texts, nested."""
    return nested(combined_texts(partials, group, order, column), group, column)
