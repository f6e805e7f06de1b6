"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are dealt into groups of about ``group_items`` by a hash; each group is packed on its own. Pieces go from
long to short into the open bin with the least room that fits. When none fits, a bin is opened at the permitted
length of least cost; at the end each bin shrinks to the least length that holds its contents. Which lengths
to open is decided jointly: the group is packed under each policy (lengths up to each permitted one, and the
least expected cost for the tokens still unplaced) and the cheapest result stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep, n_words, with_null_ids, without_null_ids

CAPACITIES = (256, 512, 1024, 2048, 4096)
_COPIES = 4096  # copies of one row that a task numbers


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int, largest: int | None) -> tuple[list[int], list[int], int]:
    """Bin of each piece, contents of each bin and cost after shrinking; ``lengths`` run from long to short.

    ``largest`` is the length opened where a piece fits into it; None takes the least expected cost per token.
    """
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    where, filled, space = [], [], []
    left = sum(lengths)
    for length in lengths:
        at = bisect_left(rooms, length)
        if at < len(rooms):
            free = rooms[at]
            bin_ = room[free].pop()
            if not room[free]:
                del rooms[at]
        else:
            fit = [c for c in capacities if c >= length]
            if largest is not None:
                free = largest if largest >= length else fit[0]
            else:
                free = min(fit, key=lambda c: ((c + overhead) / min(c, left), c))
            bin_ = len(filled)
            filled.append(0)
            space.append(free)
        where.append(bin_)
        filled[bin_] += length
        left -= length
        free -= length
        if free:
            held = room.setdefault(free, [])
            if not held:
                insort(rooms, free)
            held.append(bin_)
    sizes = np.array(capacities)
    cost = int((sizes[np.searchsorted(sizes, filled)] + overhead).sum()) if filled else 0
    return where, filled, cost


def pack_group(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> pd.DataFrame:
    """bin, capacity and offset of each length, in the given order."""
    order = np.argsort(-lengths, kind="stable")
    longest = lengths[order].tolist()
    where, filled, _ = min((best_fit(longest, capacities, overhead, c) for c in (*capacities[::-1], None)), key=lambda r: r[2])
    bins, sizes = np.array(where, np.int64), np.array(capacities)
    out = pd.DataFrame({"bin": np.empty(len(lengths), np.int64)})
    out.loc[order, "bin"] = bins
    out["capacity"] = sizes[np.searchsorted(sizes, np.array(filled)[out["bin"]])]
    out["length"] = lengths
    out["bin_offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
    return out.drop(columns="length")


def pack(
    docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16, group_items: int = 16_384,
) -> DataFrame:
    """(doc_id, piece, length, bin_id, capacity, bin_offset, text_hash, copy): where every token of every row goes.

    ``length`` is a row's token count (default: its words and one end mark); a null or empty text has only the
    end mark, and a length below 1 counts as 1. A row longer than the largest capacity is cut into full pieces and
    a rest; pieces 0, 1, ... cover it without a gap. A null doc_id stays null.
    ``text_hash`` is xxhash64 of the text. Rows equal in id, text and token count are counted first and then numbered
    as ``copy`` 0, 1, ..., so each is packed, its pieces can be told apart, and any number of them spreads over all groups.
    ``overhead`` is the fixed cost of a sequence in tokens. Other columns are not read; an empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    tokens = length if length is not None else n_words(F.col(text_col).cast("string")) + 1
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long").alias("tokens"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )
    equal = keep(rows.groupBy("doc_id", "text_hash", "tokens").agg(F.count("*").alias("rows")), "rows-to-pack")
    pieces = F.ceil(F.col("tokens") / top)
    total = equal.agg(F.sum(F.col("rows") * pieces)).first()[0] or 0
    groups = max(1, -(-total // group_items))
    zero, step = F.lit(0).cast("long"), F.lit(_COPIES).cast("long")
    runs = equal.withColumn("first", F.explode(F.sequence(zero, F.col("rows") - 1, step))).repartition("doc_id", "text_hash", "first")
    rows = runs.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("rows"), F.col("first") + step) - 1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(zero, pieces - 1)))
    rows = rows.withColumn("length", F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("piece") * top))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "text_hash", "copy"), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["no_id", "doc_id", "piece", "text_hash", "copy"], kind="stable").reset_index(drop=True)
        found = pack_group(part["length"].to_numpy(), capacities, overhead)
        out = pd.concat([part[["doc_id", "no_id", "piece", "length", "text_hash", "copy"]], found], axis=1)
        out["bin_id"] = part["group"] * (1 << 24) + out["bin"]
        return out[["doc_id", "no_id", "piece", "length", "bin_id", "capacity", "bin_offset", "text_hash", "copy"]]

    kinds = "doc_id long, no_id boolean, piece long, length long, bin_id long, capacity int, bin_offset long, text_hash long, copy long"
    rows = without_null_ids(rows.select("doc_id", "piece", "length", "text_hash", "copy", "group"))
    return with_null_ids(rows.groupBy("group").applyInPandas(run, kinds))
