"""Collapse records that differ only in how they are written."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import join_on_unique
from graphloom.runtime import Scratch

HASHES, BITS_PER_ROW = 3, 10
BLOCK_BITS = 1 << 16
#: Blocks of a filter: 32 MB, for 27 million rows. More rows are taken in passes, each with a filter of its own.
MAX_BLOCKS = 1 << 12
CHUNK_ROWS = 1 << 20


def plain_text(col: Column) -> Column:
    """Letters and digits only, without letter case; ß equals SS, and forms of one letter that have the same capital are
    one."""
    low = F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))
    return F.replace(F.translate(low, "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def canonical_title(col: Column) -> Column:
    """``plain_text`` of a title whose last bracketed list of name-value fields is put in order.

    The list is the last pair of brackets of the title, with nothing but characters that are neither letter nor digit
    after it, and every field of it has a name and a value joined by = or :. Other brackets are ordinary text.
    """
    ending = r"[(\[{<]([^()\[\]{}<>]*)[)\]}>][^\p{L}\p{N}]*$"
    inner = F.regexp_extract(col, ending, 1)
    fields = F.filter(F.split(inner, "[,;]"), lambda x: plain_text(x) != "")
    is_list = (F.size(fields) > 0) & F.forall(fields, lambda x: x.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}=:]*[=:]"))
    head = plain_text(F.regexp_replace(col, ending, ""))
    ordered = F.array_join(F.array_sort(F.transform(fields, plain_text)), "")
    return F.when(is_list, F.concat(head, ordered)).otherwise(plain_text(col))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions (keys x HASHES) by double hashing of a 64-bit hash."""
    u = h.astype(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


FILTER_SCHEMA = "block int, once binary, twice binary"


def _partition_filters(bits: int, block_bits: int, chunk_rows: int):
    """Of one partition: the bits set in each block of its once filter, and of its twice filter (set by two different
    rows), as lists of places, which take six bytes a row however large the filter is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel().astype(np.uint64))
            rows += batch.num_rows
            if rows >= chunk_rows:
                yield _blocks(np.concatenate(held), block_bits)
                held, rows = [], 0
        if rows:
            yield _blocks(np.concatenate(held), block_bits)

    return run


def _blocks(positions: np.ndarray, block_bits: int) -> pa.RecordBatch:
    once, n = np.unique(positions, return_counts=True)  # the HASHES positions of one row differ, as the step is odd
    block, place = once // block_bits, (once % block_bits).astype(np.uint16)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    parts = list(zip(np.split(place, starts[1:]), np.split(n > 1, starts[1:]), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array(block[starts].astype(np.int32)),
            "once": pa.array([p.tobytes() for p, _ in parts], pa.binary()),
            "twice": pa.array([p[t].tobytes() for p, t in parts], pa.binary()),
        }
    )


def _merge(block_bits: int):
    """Rows of the same block merged to the packed bits of its twice filter; a bit set in two of them is set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, *both in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(x, np.uint16) for x in both)
                once, twice = merged.setdefault(block, (np.zeros(block_bits, bool), np.zeros(block_bits, bool)))
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
        for block, (_, twice) in sorted(merged.items()):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "twice": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    return run


def repeat_filter(hashes: DataFrame, rows: int) -> np.ndarray:
    """Bytes of the bits that at least two rows of ``hashes`` (one column, 64-bit) have set, merged over partitions.

    The size follows the number of rows of the pass, up to MAX_BLOCKS.
    """
    blocks = 1
    while blocks * BLOCK_BITS < rows * BITS_PER_ROW and blocks < MAX_BLOCKS:
        blocks *= 2
    bits = blocks * BLOCK_BITS
    parts = hashes.mapInArrow(_partition_filters(bits, BLOCK_BITS, CHUNK_ROWS), FILTER_SCHEMA)
    merged = parts.repartition(min(blocks, 64), "block").mapInArrow(_merge(BLOCK_BITS), "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most MAX_BLOCKS rows of 8 KB
        out[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def _tested(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (copy_id, key, h) with ``again``: false where no other row can have the same key."""
    shared = rows.sparkSession.sparkContext.broadcast(repeat_filter(rows.select("h"), n))

    @F.pandas_udf("boolean")
    def may_repeat(h):
        at = _positions(h.to_numpy(), len(shared.value) * 8)
        hit = (shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return rows.select("copy_id", "key", may_repeat("h").alias("again"))


def split(hashed: DataFrame, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(single, maybe): rows (copy_id, key) that have their key alone, and those that may share it.

    Rows are taken in as many passes as filters of MAX_BLOCKS are needed, by another hash of the key, so that the share
    of false repeats stays the same at every size. Each pass reads its own folder, so every row is read twice in all.
    """
    passes = max(1, -(-rows * BITS_PER_ROW // (MAX_BLOCKS * BLOCK_BITS)))
    at = scratch.write(hashed.withColumn("pass", F.pmod(F.hash("key"), F.lit(passes))), ["pass"])
    kind = hashed.select("copy_id", "key").schema
    empty = hashed.select("copy_id", "key").limit(0)
    parts = {"false": [empty], "true": [empty]}
    for i in range(passes):
        if not scratch.exists(f"{at}/pass={i}"):
            continue
        part = scratch.read(f"{at}/pass={i}", hashed.schema)
        out = scratch.write(_tested(part, -(-rows // passes)), ["again"])
        scratch.drop(part)
        for again in parts:
            if scratch.exists(f"{out}/again={again}"):
                parts[again].append(scratch.read(f"{out}/again={again}", kind))
    single, maybe = (reduce(DataFrame.unionByName, p[1:] or p) for p in parts.values())
    return single, maybe


def collapse(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """Rows (kept_id, copy_id, copies): each record with the smallest id of its group and the size of the group.

    ``keys`` are canonical forms; null equals only null. Records whose hash cannot occur twice by the merged filters are
    emitted as singletons without a shuffle; the others are grouped by a 128-bit hash of their canonical values. The
    smallest id and the count of a group come from a map-side combined aggregate and are joined back with hot groups
    kept apart, so a group may hold any share of the rows. Ids are unique; a null id is left out. No records give no
    rows.
    """
    scratch = Scratch(records.sparkSession, "collapse")
    tagged = F.to_json(F.struct(*(c.alias(n) for n, c in keys.items())), {"ignoreNullFields": "false"})
    named = records.where(F.col(id_col).isNotNull())
    hashed = named.select(F.col(id_col).alias("copy_id"), F.unhex(F.md5(tagged)).alias("key")).withColumn("h", F.xxhash64("key"))
    single, maybe = split(hashed, named.count(), scratch)
    alone = single.select(F.col("copy_id").alias("kept_id"), "copy_id", F.lit(1).cast("long").alias("copies"))
    groups = maybe.groupBy("key").agg(F.min("copy_id").alias("kept_id"), F.count("*").alias("copies"))
    return alone.unionByName(join_on_unique(maybe, groups, "key", "inner", scratch).select("kept_id", "copy_id", "copies"))
