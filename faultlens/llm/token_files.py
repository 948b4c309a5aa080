"""Token ids of a corpus as flat files that readers map into memory.

A folder holds, for each part ``p`` in ascending document order:

* ``tokens-p``: the ids of the part's documents, one after another, as little-endian unsigned
  integers (16 bits when every id fits, else 32)
* ``offsets-p``: 64-bit positions in the whole corpus, one per document and one for the end
* ``ids-p``: the 64-bit document ids, in the same order

Documents are dealt into parts by ranges of their id. Each part is written on its own, without knowing
how many ids come before it; the bases of the parts are the prefix sums of the parts' totals (one
number per file), and a second, small pass turns local offsets into global ones. A part is written
under a name of its attempt and then renamed, so a task that runs again replaces its own files.

Defined cases: a null or empty text has only the end id; a null id comes first; rows with one id stay
apart, ordered by text; an empty table gives no parts. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.tokens import encoder
from faultlens.session import fresh_folder

MANIFEST = "part int, n_docs bigint, n_null_ids bigint, n_tokens bigint"
DOCS_PER_BATCH = 4096


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: its parts in order, with the number of ids before each of them."""

    folder: str
    width: int
    parts: list[tuple[int, int, int, int, int]]  # part, n_docs, n_null_ids, n_tokens, base

    @property
    def n_tokens(self) -> int:
        return sum(part[3] for part in self.parts)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, chunks) -> None:
    """Write a file whole, then give it its name: readers never see half of one."""
    files, base = _files(folder)
    draft = f"{base}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(draft, f"{base}/{name}")


def _load(folder: str, name: str, dtype: str):
    """An array over the file, mapped into memory where the shared folder is mounted."""
    import numpy as np
    from pyarrow import fs

    files, base = _files(folder)
    if isinstance(files, fs.LocalFileSystem):
        size = files.get_file_info(f"{base}/{name}").size
        return np.memmap(f"{base}/{name}", dtype, "r") if size else np.empty(0, dtype)
    with files.open_input_file(f"{base}/{name}") as source:
        return np.frombuffer(source.read(), dtype)


def write(
    docs: DataFrame, tokenizer_path: str, end_id: int, *,
    folder: str | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the files below a shared folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "token-files")
    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    files, base = _files(folder)
    files.create_dir(base, recursive=True)

    def write_part(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode_all = encoder(tokenizer_path).encode_all
        lengths, ids, nulls = [], [], 0
        end = np.array([end_id], f"<u{width}").tobytes()

        def tokens() -> Iterator[bytes]:
            nonlocal nulls
            for batch in batches:
                texts = [text or "" for text in batch.column(1).to_pylist()]
                for doc_id, code in zip(batch.column(0).to_pylist(), map(np.frombuffer, encode_all(texts), repeat("<u4")), strict=True):
                    nulls += doc_id is None
                    ids.append(doc_id or 0)
                    lengths.append(len(code) + 1)
                    yield code.astype(f"<u{width}").tobytes()
                    yield end

        first = next(batches, None)
        if first is None:
            return
        waiting, batches = batches, _chain(first, batches)
        part = TaskContext.get().partitionId()
        _save(folder, f"tokens-{part:06d}", tokens())
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, "<i8"))]).astype("<i8")
        _save(folder, f"local-{part:06d}", [offsets.tobytes()])
        _save(folder, f"ids-{part:06d}", [np.array(ids, "<i8").tobytes()])
        row = [[part], [len(ids)], [nulls], [int(offsets[-1])]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "n_docs", "n_null_ids", "n_tokens"]
        )

    doc_id, text = F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")
    ordered = docs.select(doc_id, text).repartitionByRange("id").sortWithinPartitions("id", "text")
    # One row for each file that was written.
    rows = sorted(tuple(row) for row in ordered.mapInArrow(write_part, MANIFEST).collect() if row["n_docs"])
    bases = accumulate((row[3] for row in rows), initial=0)
    written = TokenFiles(folder, width, [(*row, base) for row, base in zip(rows, bases, strict=False)])
    _write_offsets(spark, written)
    return written


def _chain(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def _part_table(spark: SparkSession, written: TokenFiles) -> DataFrame:
    table = spark.createDataFrame(written.parts, f"{MANIFEST}, base bigint")
    return table.repartition(max(1, len(written.parts)))


def _write_offsets(spark: SparkSession, written: TokenFiles) -> None:
    """Second pass: local offsets plus the base of their part."""
    folder = written.folder

    def shift(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                local = _load(folder, f"local-{row['part']:06d}", "<i8")
                _save(folder, f"offsets-{row['part']:06d}", [(local + row["base"]).astype("<i8").tobytes()])
            yield batch.select(["part"])

    if written.parts:
        _part_table(spark, written).mapInArrow(shift, "part int").write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, written: TokenFiles, *, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: id, first position, number of ids and their checksum.

    ``with_ids`` adds the ids themselves.
    """
    folder, width = written.folder, written.width
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                part, base, nulls = row["part"], row["base"], row["n_null_ids"]
                tokens = _load(folder, f"tokens-{part:06d}", f"<u{width}")
                offsets = _load(folder, f"offsets-{part:06d}", "<i8")
                ids = _load(folder, f"ids-{part:06d}", "<i8")
                for low in range(0, len(ids), DOCS_PER_BATCH):
                    at = offsets[low : low + DOCS_PER_BATCH + 1]
                    texts = [tokens[a:b] for a, b in zip(at[:-1] - base, at[1:] - base, strict=True)]
                    sums = [zlib.crc32(text.astype("<u4").tobytes()) for text in texts]
                    n = len(texts)
                    columns = [
                        pa.array(np.asarray(ids[low : low + n]), mask=np.arange(low, low + n) < nulls),
                        pa.array(np.asarray(at[:-1])),
                        pa.array(np.diff(at)),
                        pa.array(sums, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([text.astype("i4") for text in texts], pa.list_(pa.int32())))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return _part_table(spark, written).mapInArrow(scan, schema)
