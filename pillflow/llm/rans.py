"""Token ids as a compressed binary file: static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, is shared by all blocks. A block holds whole documents in order and
is coded on its own: its tokens are dealt in turn to ``LANES`` coders of 32 bits that write 16-bit words to one
stream. Every ``STRIDE`` tokens the block has a checkpoint, the place in the stream and the states of all lanes
there, so that its parts can be decoded in parallel, and each part has a crc32 of its tokens.

The container is a Parquet folder of blocks, which Spark commits as a whole, and a folder with the table.
Documents without tokens take no room but keep their place; the container holds ``doc_id`` as a text, null ones, which
come first, and repeated ones included. Empty tables give an empty container.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pillflow.llm.common import stored, texts_of, with_text_id
from pillflow.llm.tokens import byte_encoder

BITS = 16
LANES = 2048
STRIDE = 1 << 17
#: Tokens after which a block is closed. A longer document has a block of its own, with more checkpoints.
BLOCK = 1 << 19
_LOW = 1 << 16

BLOCKS = ("slice int, block int, docs array<string>, lengths array<long>, n_tokens long, words binary, "
          "states binary, places array<long>, checks array<long>")


class Table:
    """Frequencies scaled to 2**BITS, each token that occurs at least 1."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        """``tokens`` ascending, ``counts`` positive; ids must be below 2**BITS."""
        size = 1 << BITS
        if len(tokens) and int(tokens[-1]) >= size:
            raise ValueError("token ids must be below 65536")
        share = counts.astype(np.float64) / max(1, counts.sum())
        scaled = np.maximum(1, np.floor(share * size)).astype(np.int64)
        over = int(scaled.sum()) - size
        if len(tokens) and over < 0:
            scaled[np.argmax(scaled)] -= over
        while over > 0:  # taken from the largest, in proportion
            room = scaled - 1
            cut = np.minimum(room, np.ceil(room * (over / room.sum())).astype(np.int64))
            left = np.cumsum(cut)
            cut = np.where(left <= over, cut, np.maximum(0, cut - (left - over)))
            scaled -= cut
            over -= int(cut.sum())
        self.freq = np.zeros(size, np.uint32)
        self.freq[tokens] = scaled
        self.base = np.zeros(size, np.uint32)
        self.base[tokens] = np.cumsum(scaled) - scaled
        self.symbol = np.repeat(np.asarray(tokens, np.uint32), scaled)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(words, states at each checkpoint, place of each checkpoint in the words)."""
        n = len(ids)
        parts = -(-n // STRIDE)
        steps = -(-n // LANES)
        freq, base = self.freq[ids], self.base[ids]
        state = np.full(LANES, _LOW, np.uint32)
        out: list[np.ndarray] = []
        states = np.empty((parts, LANES), np.uint32)
        behind = [0] * parts  # words from each checkpoint to the end
        written, per_part = 0, STRIDE // LANES
        for step in range(steps - 1, -1, -1):
            a, b = step * LANES, min(n, (step + 1) * LANES)
            f, x = freq[a:b], state[:b - a]
            full = (x >> np.uint32(16)) >= f
            if full.any():
                words = x[full].astype(np.uint16)
                out.append(words)
                written += len(words)
                x = np.where(full, x >> np.uint32(16), x)
            q = (x / f).astype(np.uint32)  # exact: a double holds all 32 bits and more
            state[:b - a] = (q << np.uint32(16)) + (x - q * f) + base[a:b]
            if step % per_part == 0:
                states[step // per_part] = state
                behind[step // per_part] = written
        words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint16)
        return words, states, [written - w for w in behind]

    def decode_part(self, words: np.ndarray, state: np.ndarray, place: int, n: int) -> np.ndarray:
        """``n`` tokens from a checkpoint on."""
        ids = np.empty(n, np.uint32)
        state = state.copy()
        mask, low, shift = np.uint32(0xFFFF), np.uint32(_LOW), np.uint32(16)
        for a in range(0, n, LANES):
            b = min(n, a + LANES)
            x = state[:b - a]
            slot = x & mask
            token = self.symbol[slot]
            ids[a:b] = token
            x = self.freq[token] * (x >> shift) + slot - self.base[token]
            short = x < low
            k = int(np.count_nonzero(short))
            if k:
                x[short] = (x[short] << shift) | words[place:place + k]
                place += k
            state[:b - a] = x
        return ids


def _counted(ids: list[bytes]) -> bytes:
    """The distinct ids of some documents, and how often each occurs, as pairs of unsigned 64-bit numbers."""
    total = np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << BITS)
    seen = np.flatnonzero(total)
    return np.stack([seen, total[seen]], axis=1).astype("<u8").tobytes()


def count_tokens(tokens: DataFrame) -> DataFrame:
    """``token``, ``n`` over all rows, from the ``counts`` that ``tokenize`` writes beside the ids."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for raw in batch["counts"]:
                token, n = np.frombuffer(raw, "<u8").reshape(-1, 2).T.astype(np.int64)
                total[token] += n  # each token once in a row
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"token": seen, "n": total[seen]})

    counted = tokens.where("counts is not null").select("counts")
    return counted.mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def shared_table(counts: DataFrame) -> Table:
    """The table on the driver: at most 65,536 rows, however large the data."""
    rows = counts.orderBy("token").toPandas()
    return Table(rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write_container(spark: SparkSession, tokens: DataFrame, counts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Write the shared table and the blocks; returns both as read from storage.

    ``tokens``: ``slice``, ``place``, ``doc_id``, ``ids`` (unsigned 16-bit); the rows of a slice come in the order
    of ``place`` and together.
    """
    table_rows = stored(counts, f"{name}-table")
    shared = spark.sparkContext.broadcast(shared_table(table_rows))  # 65,536 entries at most

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        held: list[tuple] = []
        size = 0

        def block(rows: list[tuple]) -> dict:
            ids = np.frombuffer(b"".join([r[2] for r in rows]), "<u2")
            words, states, places = table.encode(ids)
            checks = [zlib.crc32(ids[a:a + STRIDE].astype("<u4").tobytes()) for a in range(0, len(ids), STRIDE)]
            return {
                "slice": rows[0][0], "block": rows[0][3], "docs": [r[1] for r in rows], "lengths": [len(r[2]) // 2 for r in rows],
                "n_tokens": len(ids), "words": words.astype("<u2").tobytes(), "states": states.astype("<u4").tobytes(),
                "places": places, "checks": checks,
            }

        for batch in batches:
            made = []
            for row in zip(batch["slice"], batch["doc_id"], batch["ids"], batch["place"]):
                follows = held and held[-1][0] == row[0] and held[-1][3] + 1 == row[3]
                if held and (size >= 2 * BLOCK or not follows):
                    made.append(block(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
            if made:
                yield pd.DataFrame(made)
        if held:
            yield pd.DataFrame([block(held)])

    ordered = tokens.select("slice", "place", "doc_id", "ids")
    return table_rows, stored(ordered.mapInPandas(encode, BLOCKS), f"{name}-blocks", compression="none")


def read_container(spark: SparkSession, table_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``slice``, ``block``, ``doc_id``, ``start_in_block``, ``n_tokens``, ``ids_crc32`` of each document.

    A part whose crc32 does not fit raises an error.
    """
    shared = spark.sparkContext.broadcast(shared_table(table_rows))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = decode_block(table, row).astype("<u4").tobytes()
                lengths = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pd.DataFrame({
                    "slice": row.slice, "block": row.block, "doc_id": row.docs, "start_in_block": starts, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                })

    return blocks.mapInPandas(
        decode, "slice int, block int, doc_id string, start_in_block long, n_tokens long, ids_crc32 long")


def decode_block(table: Table, row) -> np.ndarray:
    """All tokens of a block, part by part."""
    words = np.frombuffer(row.words, "<u2")
    states = np.frombuffer(row.states, "<u4").reshape(-1, LANES)
    parts = []
    for k, (place, check) in enumerate(zip(row.places, row.checks)):
        ids = table.decode_part(words, states[k], place, min(STRIDE, row.n_tokens - k * STRIDE))
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"block {row.slice}/{row.block}, part {k}: crc32 does not fit")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def starts_of(documents: DataFrame, blocks: DataFrame, id_type: str = "long") -> DataFrame:
    """Adds ``start``: the number of tokens in all documents before; ``doc_id`` is brought back to its type."""
    # A slice is a partition of the sorted documents, so its blocks are few; the sums over slices are one row each.
    sizes = blocks.select("slice", "block", "n_tokens")
    before = Window.partitionBy("slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_slice = sizes.withColumn("_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    slices = sizes.groupBy("slice").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    offsets = in_slice.join(slices, "slice").select(
        "slice", "block", (F.col("_before") + F.col("_start")).alias("_offset"))
    return documents.join(offsets, ["slice", "block"]).select(
        F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("_offset") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """``slice``, ``place``, ``doc_id``, ``ids`` (unsigned 16-bit) in ascending order of ``doc_id``; slices rise. The
    first row of a batch holds in ``counts`` how often each token occurs in the batch, so that the ids aren't read for it.

    The sorted rows are written, so that a lost executor cannot move the cuts between slices.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, place = byte_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in texts_of(batches):
            ids = [np.frombuffer(raw, "<u4").astype("<u2").tobytes() + end for raw in encoder.all_ids(list(batch["text"]))]
            counts = [_counted(ids), *[None] * (len(ids) - 1)] if ids else []
            yield pd.DataFrame({"slice": part, "place": np.arange(place, place + len(ids)), "doc_id": batch["doc_id"], "ids": ids, "counts": counts})
            place += len(ids)

    rows = documents.select("doc_id", "text")
    parts = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stored(with_text_id(ordered, "text").mapInPandas(encode, "slice int, place int, doc_id string, ids binary, counts binary"), "tokens", compression="zstd")
