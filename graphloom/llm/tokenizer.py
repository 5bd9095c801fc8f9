"""Corpus encoding with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Scratch, spread

VOCABULARY = os.environ.get("GRAPHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CHUNK = 2048
OVERLAP = 256
#: Longer texts have their chunks spread over all tasks; those of shorter ones are encoded where the text is read.
SPREAD_OVER = 8192

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Places where a pre-token ends whatever stands before: a blank after a letter, digit or sign; a letter or digit before
#: a visible character of another class. The pattern has no pre-token across any of them, and none of its look-aheads
#: reaches over them.
RESYNC = regex.compile(
    r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n\t])|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])"
)


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The vocabulary as an encoder; loaded once in each Python worker."""
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes joined, then decoded."""
    return encoder(path).decode_bytes(ids).decode("utf-8", errors="replace")


def resync(text: str, lo: int, hi: int) -> int | None:
    """The first place p, lo <= p <= hi, where pre-tokens end whatever stands before."""
    m = RESYNC.search(text, lo, min(hi + 1, len(text))) if lo <= hi else None
    return m.start() if m and m.start() <= hi else None


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str, bool]]:
    """(k, part, last) of overlapping chunks: the character before the chunk, the chunk, and the overlap with the next."""
    n = -(-len(text) // size)
    for k in range(n):
        yield k, text[max(0, k * size - 1) : (k + 1) * size + overlap + 1], k == n - 1


def piece(k: int, part: str, last: bool, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[str, bool]:
    """What chunk k encodes, and whether both of its ends are places of resynchronisation.

    It begins at the first such place among its first ``overlap`` characters and ends at the first one in the overlap
    with the next chunk; both chunks see the same characters there and so find the same place. Where there is none (one
    pre-token longer than the overlap) the piece goes to the nominal end of the chunk, and is not sound: it has to be
    joined with its neighbours before it is encoded.
    """
    first = 1 if k else 0
    begin = resync(part, first, first + overlap) if k else 0
    end = len(part) if last else resync(part, first + size, first + size + overlap)
    sound = begin is not None and end is not None
    return part[first if begin is None else begin : first + size if end is None else end], sound


def join_pieces(parts: list[tuple[list[int] | None, str | None]], path: str = VOCABULARY) -> list[int]:
    """Ids of a text out of its pieces in order: (ids, None) of sound ones, (None, text) of the others."""
    out, raw = [], ""
    for ids, text in [*parts, ([], None)]:
        if text is not None:
            raw += text
            continue
        if raw:
            out += encoder(path).encode_ordinary(raw)
            raw = ""
        out += ids
    return out


def encoded(text: str, path: str = VOCABULARY) -> list[int]:
    """Ids of one text by its chunks, within a task."""
    pieces = [piece(*c) for c in chunks(text)]
    return join_pieces([(encoder(path).encode_ordinary(t), None) if sound else (None, t) for t, sound in pieces], path)


_IDS = pa.list_(pa.int32())


def _encode(path: str, count_only: bool):
    """Rows (keep, text) to (keep, ids or their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoded(t, path) if t else [] for t in batch.column(1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, _IDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["keep", "out"])

    return run


def _cut():
    """Rows (rid, keep, text) to chunk rows (rid, k, part, last, keep); ``keep`` goes with the first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (rid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows = list(chunks(text))
                first = pa.array([i] + [None] * (len(rows) - 1), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rid] * len(rows), pa.int64()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.bool_()),
                        batch.column(1).take(first),
                    ],
                    ["rid", "k", "part", "last", "keep"],
                )

    return run


def _encode_pieces(path: str):
    """Chunk rows to pieces (rid, k, ids, raw): ids of sound pieces, the text of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, raw = [], []
            for k, part, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                text, sound = piece(k, part, last)
                ids.append(enc.encode_ordinary(text) if sound else None)
                raw.append(None if sound else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, _IDS), pa.array(raw, pa.string()), batch.column(4)],
                ["rid", "k", "ids", "raw", "keep"],
            )

    return run


def _join(path: str, count_only: bool):
    """Rows (keep, pieces) to (keep, ids or their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [join_pieces([(p["ids"], p["raw"]) for p in row], path) for row in batch.column(1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, _IDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["keep", "out"])

    return run


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """Columns ``keep`` and ids (ARRAY<INT>), or n_tokens with ``count_only``, of every row.

    Ids are those of ordinary text: strings of special tokens are not special. Null and empty texts give an empty list
    (0 tokens). Texts are cut into overlapping chunks, pre-tokenised, stitched at places of resynchronisation, encoded in
    pieces, and put together: where they are read up to SPREAD_OVER characters, and beyond, so that one very long text
    doesn't hold up its task, by all tasks. The chunks of these are written first, which fixes the numbers that tell
    their texts apart, whatever task has to run again. Repeated rows each give a row; a table without rows gives none;
    other columns play no part.
    """
    name, kind = ("n_tokens", "bigint") if count_only else ("ids", "array<int>")
    kept = F.struct(*keep)
    rows = docs.select(kept.alias("keep"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > SPREAD_OVER, F.lit(False))
    keep_type = rows.schema["keep"].dataType.simpleString()
    short = spread(rows.where(~long)).mapInArrow(_encode(path, count_only), f"keep {keep_type}, out {kind}")
    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("rid"), "keep", "text")
    cut = numbered.mapInArrow(_cut(), f"rid bigint, k int, part string, last boolean, keep {keep_type}")
    joined = (
        Scratch(docs.sparkSession, "chunks").put(cut)
        .repartition("rid", "k")
        .mapInArrow(_encode_pieces(path), f"rid bigint, k int, ids array<int>, raw string, keep {keep_type}")
        .groupBy("rid")
        .agg(F.first("keep", ignorenulls=True).alias("keep"), F.sort_array(F.collect_list(F.struct("k", "ids", "raw"))).alias("pieces"))  # of one text
        .select("keep", "pieces")
        .mapInArrow(_join(path, count_only), f"keep {keep_type}, out {kind}")
    )
    return short.unionByName(joined).select("keep.*", F.col("out").alias(name))
