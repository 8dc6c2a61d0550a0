"""Best-fit packing with bound-certified repacking.

Texts become token ids and one end id; only what is longer than a sequence is cut. Full pieces are
sequences of their own. The others are dealt over partitions of bounded size, each packed by
best-fit decreasing. A partition whose bin count equals a lower bound from dual feasible functions
is certified optimal and final. The rest keep their full bins; what lies in bins with room is
exchanged between partitions (dealt anew, over fewer at first, so that sizes mix) and packed again, until
all are certified, one partition is left, or a pass over all saves hardly a bin (LEAST_SAVED). Each piece tells how many bins the
partition took that closed its bin, and the bound: equal numbers are a certificate.

Edge cases: a null or empty text is the end id alone; documents of equal id are packed each by
itself, in any order (ids are whole numbers; others are cast, or null); ties of length go by id, piece and checksum; an empty table gives an empty
result; extra columns are not read; the length of a text is not bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import parts_for, small_batches, text_groups, written
from frameloom.llm.subwords import word_bpe

CAPACITY, END_ID = 2048, 0
#: Pieces in one packing partition at the start; later ones hold up to GROWTH times as many.
PIECES_EACH, GROWTH = 40_000, 4
#: The exchange ends when a pass over all saves no more than this share of the bins with room.
LEAST_SAVED = 0.001
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit;
    null unless with_ids)."""
    end = np.array([END_ID], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_bpe(tokenizer)
        for part, texts in text_groups(batches):
            out: list[tuple] = []
            for doc, raw in zip(part.column(0).to_pylist(), of.ids(texts), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return small_batches(docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(rows, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of the lengths needs: the best of three families of dual feasible functions."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    # Sizes over capacity - e count as whole bins, those under e as nothing, the others as they are.
    over, mass = np.cumsum(n[::-1])[::-1], np.concatenate([[0], np.cumsum(n * x)])
    e = np.arange(1, capacity // 2 + 1)
    whole = over[capacity - e + 1]
    best = max(best, int((whole - (-(mass[capacity - e + 1] - mass[e]) // capacity)).max(initial=0)))
    for k in range(1, 25):
        # Fekete and Schepers' rounding to k-ths, multiples of capacity / (k + 1) staying as they are.
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * scaled).sum()) // (k * capacity)))
    for e in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        # Sizes up to a half count one part in m, larger ones what they leave less than the whole.
        m = capacity // e
        values = np.where(2 * x > capacity, m - (capacity - x) // e, np.where(x >= e, 1, 0))
        best = max(best, -(-int((n * values).sum()) // m))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (given in falling order) and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has r tokens of room
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own, count = capacity, count, count + 1
        bins[i], offsets[i] = own, capacity - room
        if left := room - length:
            with_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, count


def _packer(capacity: int, round_no: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        if round_no > 1:  # the exchanged bins came whole: they stay as they were if packing again needs more
            old = rows.groupby(["from_part", "bin"], sort=False).ngroup().to_numpy(np.int64)
            if old.max() + 1 <= count:
                bins, offsets, count = old, rows["offset"].to_numpy(np.int64), int(old.max()) + 1
        full = np.bincount(bins, lengths, count) == capacity
        bound = lower_bound(lengths, capacity)
        # A full bin is certified by itself, and so closed before the rest of its partition.
        alone = full & (count > bound)
        return rows.assign(bin=bins, offset=offsets, round=round_no, final=full[bins] | (count == bound), bins=np.where(alone, 1, count)[bins], bound=np.where(alone, 1, bound)[bins]).drop(columns="from_part")

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_each: int = PIECES_EACH, rounds: int | None = None) -> DataFrame:
    """The pieces' columns with sequence_id, offset (places in a sequence are gapless from 0), and bins and bound of
    the partition that closed the sequence. rounds: an end before the last exchange, for comparison."""
    columns = pieces.columns
    pieces = written(pieces, "pieces")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    whole = pieces.filter(F.col("length") == capacity)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # A full piece's sequence is told by its document and place; repeated rows differ by the row's number.
    done = [whole.select(*columns, F.monotonically_increasing_id().alias("bin"), zero.alias("offset"), F.lit(0).alias("round"), zero.alias("part"), one.alias("bins"), one.alias("bound"))]
    todo = pieces.filter(F.col("length") < capacity).withColumns({x: zero for x in ("from_part", "bin", "offset")})
    left, open_bins, round_no = todo.count(), None, 0
    while left:
        round_no += 1
        parts = parts_for(left, pieces_each * min(2 ** (round_no - 1), GROWTH))
        by = ["doc_id", "piece"] if round_no == 1 else ["from_part", "bin"]
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(*by, F.lit(round_no)), F.lit(parts)))
        packed = written(dealt.groupBy("part").applyInPandas(_packer(capacity, round_no), f"{schema}, part long, bin long, offset long, round int, final boolean, bins long, bound long"), "packed")
        rest = packed.filter("not final").agg(F.count("*"), F.count_distinct("part", "bin")).first()
        idle = open_bins is not None and open_bins - rest[1] <= LEAST_SAVED * open_bins
        last = parts == 1 or not rest[0] or round_no == rounds or idle
        done.append((packed if last else packed.filter("final")).select(*columns, "bin", "offset", "round", "part", "bins", "bound"))
        if last:
            break
        todo, (left, open_bins) = packed.filter("not final").select(*columns, F.col("part").alias("from_part"), "bin", "offset"), rest
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    number = F.when(F.col("round") == 0, F.col("bin") * 2 + 1).otherwise(((F.col("part") * 1024 + F.col("round")) * (1 << 24) + F.col("bin")) * 2)
    return union.select(*columns, number.alias("sequence_id"), "offset", "bins", "bound")
