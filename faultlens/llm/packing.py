"""Documents packed into token sequences by the sum-of-squares rule.

A piece goes into the open sequence that leaves the sum of squares, over every residual gap, of the
number of open sequences with that gap smallest. Pieces come longest first and a new sequence is opened
only where none fits; on long-tailed lengths this needs about as few as the total length allows.

The rule is sequential, so pieces are dealt into groups of bounded size that are packed apart. A group
loses less than a sequence or two to not knowing the others. Only lengths and numbers are shuffled,
never texts or ids. Pieces are numbered in turn by the task that made them, and that number deals
them, so neither one long document nor thousands of equal rows can fill a group.

Defined cases: a null or empty text is its end id alone; rows with one id are packed apart, each with
its own pieces; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.tokens import encoder
from faultlens.session import stage

PIECES_PER_GROUP = 50_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint"
# Sequences of one group are numbered below this; the group's number stands above.
_GROUP_STRIDE = 1 << 32


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, *,
    id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: all full but the first of a longer document."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode_all = encoder(tokenizer_path).encode_all
        end = np.array([end_id], "<u4").tobytes()
        # Tasks start at different groups; 7919 is any odd step that spreads them.
        slot = TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, code in zip(batch.column(0).to_pylist(), encode_all(texts), strict=True):
                code += end
                total = len(code) // 4
                first = (total - 1) % capacity + 1
                start, piece, stop = 0, 0, first
                while start < total:
                    own = code[4 * start : 4 * stop]
                    ids = np.frombuffer(own, "<u4").astype("i4") if with_ids else None
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), slot, ids))
                    start, stop, piece, slot = stop, stop + capacity, piece + 1, slot + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids"][: 6 + with_ids]
            arrays = [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)][: 6 + with_ids]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = _PIECES + ", ids array<int>" * with_ids
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(cut, schema)


def sum_of_squares(lengths, capacity: int):
    """Sequence number and offset of every length; ``lengths`` are 1 to ``capacity``."""
    import numpy as np

    never = np.iinfo(np.int64).max // 4
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Change of the sum when a gap loses one of its sequences, and when it gains one.
    lose = np.full(capacity + 1, never, np.int64)
    gain = np.ones(capacity + 1, np.int64)
    gain[0] = 0  # a full sequence is no longer open
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    opened = 0

    def resize(gap: int) -> None:
        n = len(open_bins[gap])
        lose[gap] = 1 - 2 * n if n else never
        if gap:
            gain[gap] = 1 + 2 * n

    for i in np.argsort(-np.asarray(lengths), kind="stable"):
        length = int(lengths[i])
        cost = lose[length:capacity] + gain[: capacity - length]
        best = int(cost.argmin()) if length < capacity else -1  # of equal ones the smallest gap
        if best >= 0 and cost[best] < never // 2:
            gap = length + best
            bins[i] = open_bins[gap].pop()
            resize(gap)
        else:
            gap, bins[i] = capacity, opened
            opened += 1
        offsets[i] = capacity - gap
        if gap > length:
            open_bins[gap - length].append(int(bins[i]))
            resize(gap - length)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, *, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces; ``slot`` deals them into groups."""
    groups = max(1, -(-pieces.count() // per_group))
    columns = [c for c in pieces.columns if c != "slot"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "slot")

    def place(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("slot", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        numbered = bins + np.int64(key[0].as_py()) * _GROUP_STRIDE
        out = table.select(columns)
        return out.append_column("sequence_id", pa.array(numbered)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("_group", F.pmod("slot", F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, **options) -> DataFrame:
    """Cut and pack; pieces are staged, so every text is encoded once."""
    return pack(stage(pieces(docs, tokenizer_path, capacity, end_id, **options), "pieces"), capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces that carry their ids; each holds at most ``capacity``."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed_with_ids.groupBy("sequence_id").agg(placed.alias("placed"))
    return rows.select("sequence_id", F.flatten("placed.ids").alias("ids"))
