"""Spelling variants of a corpus' words, found with tries of letter-group counts.

Words and how often they occur are counted in every task first. The letters are put into groups of
about equal use; a word's vector has its number of letters of each group. One inserted, deleted or replaced letter
changes a vector by a surplus of one at most and a deficit of one at most.

The trie arranges words by their counts, group after group. Its upper levels, where groups are joined into few
coarse ones, are the shards: a word is filed under its coarse vector and visits the shards that a budget
of one surplus and one deficit can reach, each pair of shards from one side only. In a shard a
depth-first search walks the trie with all words still in reach of a node: a child whose count is one
above or below a word's spends that word's surplus or deficit, and words without budget stay behind. At the
leaves words are compared code point by code point.

Size: the number of coarse groups is the smallest that leaves no shard above ``shard_words``; a shard that is
larger even with all groups apart is cut into blocks, and every word visits all blocks. No candidates
are dropped, and no shard is held whole beyond that size.

Roots: a word's form occurs at least ten times as often as the word, so following forms ends after few
steps; steps are doubled by joining the table of forms with itself until nothing changes.

Defined cases: null and empty texts have no words; a null id counts as an empty id text in the checksum that plants
the slips; rows that repeat count each time; ties of the largest near word go to the smallest in code-point
order; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

# Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
SLIP = 31
SHORTEST = 7
LEAST_COUNT = 2
TIMES = 10

# Fine groups of the trie, and how many coarse ones the shards may be made of.
GROUPS = 16
COARSE = (4, 6, 8, 12, 16)
SHARD_WORDS = 20_000
LEAF_WORDS = 24
# Distinct words a task holds before it hands them on.
HELD_WORDS = 200_000

# Runs in lower-cased UTF-8 of texts whose only lead byte is C3: there every byte pair is a letter.
_BYTE_RUNS = re.compile(rb"[a-z\xc3\x80-\xbf]+")
_BEYOND = bytes([0xC2, *range(0xC4, 0xF5)])
_RUNS = re.compile(RUN)


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as UTF-8."""
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if len(lowered.translate(None, _BEYOND)) == len(lowered):
        return _BYTE_RUNS.findall(lowered)
    return [run.encode() for run in _RUNS.findall(lowered.decode("utf-8", "surrogatepass"))]


def slipped(run: bytes, start: int, slip: int) -> bytes:
    """``run`` after the slip of the pen that its checksum plants; ``start`` is the checksum of what precedes it."""
    code = zlib.crc32(run, start)
    if code % slip:
        return run
    letters = run.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, *, shortest: int, least_count: int, slip: int) -> DataFrame:
    """(word, n) over the texts of (doc_id, text)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()

        def handed():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                start = zlib.crc32(b":", start)
                # A slip only shortens a run.
                for run, n in Counter(r for r in runs_of(text.as_py() or "") if len(r) >= shortest).items():
                    held[slipped(run, start, slip)] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        if held:
            yield handed()

    counted = docs.mapInArrow(scan, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= shortest))


def letter_groups(words: DataFrame, groups: int) -> list[int]:
    """Group of each code point below 256, so that the groups are used about equally."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(_codes(batch.column(0).to_pylist())[0], minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["letter", "n"])

    counted = words.select("word").mapInArrow(scan, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    # At most one row for each letter.
    use = {row["letter"]: row["n"] for row in counted.collect()}
    filled, group = [0] * groups, [0] * 256
    for letter in sorted(use, key=lambda c: (-use[c], c)):
        least = filled.index(min(filled))
        group[letter] = least
        filled[least] += use[letter]
    return group


def _codes(words: list[str]):
    """The code points of all words in a row, and the length of each word."""
    import numpy as np

    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def vectors(words: list[str], group: list[int], groups: int):
    """Number of letters of each group, one row a word."""
    import numpy as np

    codes, lengths = _codes(words)
    at = np.repeat(np.arange(len(words)), lengths) * groups + np.array(group)[codes]
    return np.bincount(at, minlength=len(words) * groups).reshape(-1, groups).astype(np.int32)


def coarse(fine, n: int):
    """Neighbouring groups joined into ``n``."""
    import numpy as np

    groups = fine.shape[1]
    return np.add.reduceat(fine, [-(-i * groups // n) for i in range(n)], axis=1)


FILED = "shard binary, word string, n bigint"


def filed(words: DataFrame, group: list[int], n: int) -> DataFrame:
    """Each word under its coarse vector."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = coarse(vectors(batch.column(0).to_pylist(), group, GROUPS), n).astype("<i4")
            shards = pa.array([key.tobytes() for key in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([shards, *batch.columns], ["shard", "word", "n"])

    return words.select("word", "n").mapInArrow(scan, FILED)


def visits(words: DataFrame, group: list[int], n: int) -> DataFrame:
    """Each word under the other coarse vectors it has to visit, with the surplus it may spend there.

    A letter less: the word visits the shorter ones. A letter replaced: of two shards the one with more
    letters of the earlier group visits the other.
    """
    moves = [(i, None) for i in range(n)] + [(i, j) for i in range(n) for j in range(i + 1, n)]

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = coarse(vectors(batch.column(0).to_pylist(), group, GROUPS), n).astype("<i4")
            for less, more in moves:
                at = np.flatnonzero(own[:, less])
                keys = own[at]
                keys[:, less] -= 1
                if more is not None:
                    keys[:, more] += 1
                columns = [column.take(pa.array(at)) for column in batch.columns]
                shards = pa.array([key.tobytes() for key in keys], pa.binary())
                surplus = pa.array(np.full(len(at), more is not None, np.int32))
                yield pa.RecordBatch.from_arrays([shards, *columns, surplus], ["shard", "word", "n", "surplus"])

    return words.select("word", "n").mapInArrow(scan, f"{FILED}, surplus int")


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def search(own, visitor, surplus, leaf_words: int = LEAF_WORDS) -> Iterator[tuple]:
    """Depth-first search of the trie over the vectors ``own``, for all ``visitor`` vectors at once.

    Each visitor may meet counts one above its own once if ``surplus`` says so, and counts one below once.
    Yields (rows of ``own``, rows of ``visitor``) for every leaf that is reached.
    """
    import numpy as np

    order = np.lexsort(own.T[::-1])
    columns, seekers = own[order].T.copy(), visitor.T.copy()
    every = np.arange(len(visitor))
    stack = [(0, len(order), 0, every, surplus.astype(bool), np.ones(len(visitor), bool))]
    while stack:
        low, high, level, who, may_gain, may_lose = stack.pop()
        if high - low <= leaf_words or level == len(columns):
            yield order[low:high], who
            continue
        counts = columns[level, low:high]
        wanted = seekers[level, who]
        edges = np.flatnonzero(np.diff(counts)) + 1
        for start, stop in zip([0, *edges], [*edges, len(counts)], strict=True):
            step = counts[start] - wanted
            stay = (step == 0) | ((step == 1) & may_gain) | ((step == -1) & may_lose)
            if stay.any():
                step = step[stay]
                stack.append((low + int(start), low + int(stop), level + 1, who[stay],
                              may_gain[stay] & (step != 1), may_lose[stay] & (step != -1)))


def _parities(words: list[str]):
    """A bit for each letter modulo 64: whether its number is odd. One edit changes two bits at most."""
    import numpy as np

    codes, lengths = _codes(words)
    bits = np.left_shift(np.uint64(1), (codes % 64).astype(np.uint64))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.bitwise_xor.reduceat(bits, starts) if len(words) else np.empty(0, np.uint64)


# Pairs a leaf compares at a time, and the longest words that are compared as rows of a table.
PAIRS_AT_ONCE = 4_000_000
TABLE_WIDTH = 64


class _Table:
    """Words as rows of code points, from the front and from the back, with zeros behind them."""

    def __init__(self, words: list[str], width: int):
        import numpy as np

        codes, self.lengths = _codes(words)
        row = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        fits = self.lengths[row] < width
        row, at, codes = row[fits], at[fits], codes[fits].astype(np.uint8)
        self.front, self.back = np.zeros((2, len(words), width), np.uint8)
        self.front[row, at] = codes
        self.back[row, self.lengths[row] - 1 - at] = codes


def _near_rows(words: _Table, seekers: _Table, a, b):
    """Which pairs of rows are near: the words have the length of the seekers, or one letter less."""
    differ = words.front[a] != seekers.front[b]
    replaced = differ.sum(axis=1) == 1
    longer = words.lengths[a] < seekers.lengths[b]
    some = longer.nonzero()[0]
    # What the words have in common from the front and from the back has to cover the shorter one.
    front = differ[some].argmax(axis=1)
    back = (words.back[a[some]] != seekers.back[b[some]]).argmax(axis=1)
    replaced[some] = front + back >= words.lengths[a[some]]
    return replaced


def near_pairs(words: list[str], seekers: list[str], surplus, group: list[int], first: int) -> Iterator[tuple]:
    """(rows of ``words``, rows of ``seekers``) of near words; the seekers from row ``first`` on are the words themselves."""
    import numpy as np

    own_parity, parity = _parities(words), _parities(seekers)
    width = min(TABLE_WIDTH, 1 + max(map(len, seekers), default=0))
    own_table, table = _Table(words, width), _Table(seekers, width)
    found = search(vectors(words, group, GROUPS), vectors(seekers, group, GROUPS), surplus)
    for rows, who in found:
        step = max(1, PAIRS_AT_ONCE // len(rows))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            close = np.bitwise_count(parity[some][:, None] ^ own_parity[rows][None, :]) <= 2
            i, j = np.nonzero(close)
            left, right = rows[j], some[i]
            # A word meets each other word of its own block once, from the later row.
            once = (right < first) | (right - first > left)
            left, right = left[once], right[once]
            short = table.lengths[right] < width
            yes = np.zeros(len(left), bool)
            yes[short] = _near_rows(own_table, table, left[short], right[short])
            for k in np.flatnonzero(~short):
                yes[k] = near(words[left[k]], seekers[right[k]])
            yield left[yes], right[yes]


LINKS = "word string, near string, near_n bigint"


def links(words: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n), both ways, of all near words of (word, n)."""
    group = letter_groups(words, GROUPS)
    for n in COARSE:
        own = stage(filed(words, group, n), "spelling-filed")
        sizes = own.groupBy("shard").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("blocks"))
        sizes = stage(sizes, "spelling-shards")
        if n == COARSE[-1] or sizes.where("blocks > 1").isEmpty():
            break
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    filed_here = own.join(sizes, "shard").select("shard", block.alias("block"), "word", "n", F.lit(-1).alias("surplus"))
    seekers = visits(words, group, n).join(sizes, "shard").select("shard", everywhere, "word", "n", "surplus")
    # Words of a shard of several blocks also visit its later blocks.
    later = own.join(sizes.where("blocks > 1"), "shard").withColumn("own", block).select(
        "shard", everywhere, "word", "n", F.lit(1).alias("surplus"), "own"
    ).where("block > own").drop("own")

    def match(table):
        import numpy as np
        import pyarrow as pa

        surplus = table.column("surplus").to_numpy()
        here = np.flatnonzero(surplus < 0)
        if not len(here):
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        order = np.concatenate([np.flatnonzero(surplus >= 0), here])
        n_visitors = len(order) - len(here)
        every = table.column("word").take(pa.array(order)).to_pylist()
        counts = table.column("n").to_numpy()[order]
        budget = np.abs(surplus[order])
        none = np.empty(0, np.int64)
        pairs = [(none, none), *near_pairs(every[n_visitors:], every, budget, group, n_visitors)]
        a, b = (np.concatenate([pair[side] for pair in pairs]) for side in (0, 1))
        a += n_visitors
        names = pa.array(every, pa.string())
        return pa.table({
            "word": pa.concat_arrays([names.take(pa.array(a)), names.take(pa.array(b))]),
            "near": pa.concat_arrays([names.take(pa.array(b)), names.take(pa.array(a))]),
            "near_n": pa.array(np.concatenate([counts[b], counts[a]])),
        })

    together = filed_here.unionByName(seekers).unionByName(later)
    return together.groupBy("shard", "block").applyInArrow(match, LINKS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms."""
    reached = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = reached.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        step = stage(step, "spelling-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(
    docs: DataFrame, *, shortest: int = SHORTEST, least_count: int = LEAST_COUNT, times: int = TIMES, slip: int = SLIP,
    shard_words: int = SHARD_WORDS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word."""
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    words = stage(word_counts(chosen, shortest=shortest, least_count=least_count, slip=slip), "spelling-words")
    # The largest count first, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    found = links(words, shard_words=shard_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.n") >= times * F.col("n")
    joined = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    known = stage(joined, "spelling-forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
