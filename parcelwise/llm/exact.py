"""Exact dedup: a minimal perfect hash over the digests of a history, looked up with a byte check.

The index holds the distinct digests of the history: groups known from before, or one half of the rows. They are
spread over shards by their leading bits; each shard is one row with a minimal perfect hash (level bitmaps: a key
that is alone in its slot of a level stays there, the others move to the next level) and, by slot, the full digest,
the winner's id and the group's size. A row's digest is hashed to its slot and compared with the whole digest there.
A member repeats the slot's text, so members are grouped by slot; nonmembers are grouped by digest among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep, with_null_ids, without_null_ids

_GAMMA = 2.0  # slots per key that is still to be placed
_INDEX = "shard int, bits binary, sizes array<long>, digests binary, winners array<long>, counts array<long>"


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _keys(digests: list[bytes]) -> np.ndarray:
    """The 8 bytes of each digest after those that name its shard."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8").astype(np.uint64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Occupied slots of all levels as one boolean array, and the levels' sizes. Keys must differ."""
    bits, sizes, left = [], [], keys
    while len(left):
        size = max(8, int(_GAMMA * len(left)))
        slot = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[slot]]
        if len(sizes) > 200:
            raise ValueError("keys are not distinct")
    return np.concatenate(bits) if bits else np.zeros(0, bool), sizes


def slots(keys: np.ndarray, bits: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Number from 0 to the count of keys - 1 for each key; -1, or some key's number, for a key not indexed."""
    rank = np.concatenate(([0], np.cumsum(bits)))
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest): a number for each row, SHA-256 of the unchanged text in UTF-8; null counts as empty.

    The numbers hold only once they are written: a task that runs again may give others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")
    )


def _shard(digest, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """Index rows of the distinct ``groups`` (digest, winner, n), one for each of ``shards`` shards in use."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(part["digest"].tolist())
        # two digests may agree in the hashed 8 bytes: the hash needs distinct keys, so later ones stay out
        _, first = np.unique(keys, return_index=True)
        part, keys = part.iloc[first], keys[first]
        bits, sizes = perfect_hash(keys)
        order = np.argsort(slots(keys, bits, sizes))
        part = part.iloc[order]
        return pd.DataFrame([{
            "shard": int(part["shard"].iat[0]), "bits": np.packbits(bits).tobytes(), "sizes": sizes,
            "digests": b"".join(part["digest"]), "winners": part["winner"].tolist(), "counts": part["n"].tolist(),
        }])

    rows = groups.filter(F.col("winner").isNotNull()).withColumn("shard", _shard(F.col("digest"), shards))
    return rows.groupBy("shard").applyInPandas(build, _INDEX)


def look_up(rows: DataFrame, index: DataFrame, shards: int, parts: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, digest) with shard and part, and slot, winner and n from the index; null for a digest that it lacks.

    ``parts`` (shard, parts) says into how many tasks the rows of a shard are dealt, by their number.
    """
    rows = rows.withColumn("shard", _shard(F.col("digest"), shards)).join(parts, "shard")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def find(part: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = part[["row", "doc_id", "no_id", "digest", "shard", "part"]].copy()
        slot, winner, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        member = np.zeros(len(part), bool)
        if len(shard) and len(part):
            entry, asked = shard.iloc[0], part["digest"].tolist()
            sizes = [int(x) for x in entry["sizes"]]
            bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
            slot = slots(_keys(asked), bits, sizes)
            stored = entry["digests"]
            member = np.array([s >= 0 and stored[32 * s : 32 * s + 32] == d for s, d in zip(slot.tolist(), asked, strict=True)], bool)
            winner[member] = np.asarray(entry["winners"])[slot[member]]
            n[member] = np.asarray(entry["counts"])[slot[member]]
        for name, values in (("slot", slot), ("winner", winner), ("n", n)):
            out[name] = pd.array(values, "Int64").copy()
            out.loc[~member, name] = pd.NA
        return out

    pairs = without_null_ids(rows).groupBy("shard", "part").cogroup(copies.drop("parts").groupBy("shard", "part"))
    return with_null_ids(pairs.applyInPandas(find, "row long, doc_id long, no_id boolean, digest binary, shard int, part int, slot long, winner long, n long"))


def _of_their_groups(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """Looked-up ``rows`` with the winner and size of their group, those of a shard with equal ``key``.

    Groups are combined before the shuffle; those of two rows or more go to every task that holds rows of their shard.
    """
    groups = rows.groupBy("shard", key).agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))
    groups = keep(groups.filter("n > 1"), f"groups-by-{key}")
    copies = groups.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    joined = rows.drop("winner", "n").join(copies, ["shard", "part", key], "left")
    winner = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    return joined.select("doc_id", "digest", winner.alias("winner"), F.coalesce("n", F.lit(1)).alias("n"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None,
    shard_digests: int = 16_384, task_rows: int = 16_384,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays: keep_id.
    ``history`` (digest, winner, n) are groups known from before: a row whose text is known takes the known winner
    and size. Without it, one half of the rows, by a hash of the row's number, is the history; rows of both halves
    are looked up and members of a slot form a group. A shard's index covers about ``shard_digests`` digests; its rows
    are dealt to tasks of about ``task_rows`` by row number, so neither a text that a third of all rows share nor
    rows without an id are a hot task. A null doc_id wins only if no row of its group has one. Rows that share text
    and winning doc_id are all marked kept (ids are expected to be unique). Other columns are not read; an empty table
    gives no rows.
    """
    rows = keep(digests(docs, id_col, text_col), "digests")
    known = history
    if history is None:
        past = rows.filter(F.pmod(F.xxhash64("row"), F.lit(2)) == 0)
        known = keep(past.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), "history")
    shards = max(1, -(-known.count() // shard_digests))
    index = keep(build_index(known, shards), "perfect-hash")
    parts = rows.groupBy(_shard(F.col("digest"), shards).alias("shard")).count()
    parts = keep(parts.select("shard", F.ceil(F.col("count") / task_rows).cast("int").alias("parts")), "shard-tasks")
    found = keep(look_up(rows, index, shards, parts), "looked-up")
    members, others = found.filter("slot is not null"), found.filter("slot is null")
    if history is None:
        members = _of_their_groups(members, "slot", parts)
    out = members.select("doc_id", "digest", "winner", "n").unionByName(_of_their_groups(others, "digest", parts))
    return out.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
select doc_id, max(doc_id) over (partition by sha256(coalesce(text, ''))) as keep_id,
       count(*) over (partition by sha256(coalesce(text, ''))) as group_size,
       doc_id = max(doc_id) over (partition by sha256(coalesce(text, ''))) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
