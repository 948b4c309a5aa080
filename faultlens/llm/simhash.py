"""SimHash near-duplicates by a generalised pigeonhole with unequal thresholds.

Fingerprints link at ``tau`` or fewer differing bits. The bits are cut into groups; when the groups'
thresholds sum to ``tau - groups + 1``, every pair that links is within the threshold of at least one
group. Correlated bits go into one group, because a group of independent bits splits the fingerprints
best and two copies of one bit split nothing. Thresholds come from a dynamic program over counts,
estimated from the fingerprints themselves, of the candidates each group would have to compare.

A fingerprint is filed under its own value of each group and probes the values within the group's
threshold. Only distinct fingerprints take part; every exact copy follows its fingerprint. Files and
probes are dealt by value, and a value that holds many fingerprints is cut into blocks, whose pairs are
compared one by one, so that no task holds more than two blocks. Each comparison returns links that keep
its linked fingerprints connected (a spanning forest), not all pairs, and components are found by
passing the smallest member along, with every round written to the shared folder.

Defined cases: a text without words, null or empty, has fingerprint zero and links like any other; null
ids take part but are never the smallest; rows with one id count as one; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

BITS = 64
# Fingerprints from which bit statistics are estimated; thresholds only decide the cost, never the result.
SAMPLE = 4_096
# Fingerprints of one value compared in one block; a task holds two blocks at a time.
BLOCK = 2_048
# Cost of emitting a probe, in comparisons.
PROBE_COST = 40.0


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Bits set in over half the hashes of the word shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # On bytes, lower() and split() know exactly A-Z and [\\x20\\x09-\\x0D].
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        ends = (starts[width:] - 1).tolist()
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)]
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[low : low + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view(">u8")[0])


def fingerprints(docs: DataFrame, width: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint as a signed 64-bit number."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(scan, "doc_id bigint, fp bigint")


# --- groups and thresholds ------------------------------------------------------------------------


def group_bits(sample, groups: int) -> list[list[int]]:
    """Cut the bits into equal groups, most correlated bits together, greedily from the sample."""
    import numpy as np

    bits = np.unpackbits(np.asarray(sample, ">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    alike = np.abs(centred.T @ centred) / max(1, len(bits))
    left, out = list(range(BITS)), []
    for k in range(groups):
        size = len(left) // (groups - k)
        # Start from the bit with the strongest tie to another one that is left.
        tied = alike[np.ix_(left, left)] - np.eye(len(left))
        chosen = [left.pop(int(tied.max(axis=1).argmax()))]
        while len(chosen) < size:
            ties = alike[np.ix_(left, chosen)].mean(axis=1)
            chosen.append(left.pop(int(ties.argmax())))
        out.append(sorted(chosen))
    return out


def _keys(values, bits: list[int]):
    """The values' bits of one group, packed into one number. Bit 0 is the highest."""
    import numpy as np

    key = np.zeros(len(values), np.uint64)
    for bit in bits:
        key = (key << np.uint64(1)) | ((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1))
    return key


def candidate_costs(sample, bits: list[int], rows: int, tau: int) -> list[float]:
    """Estimated comparisons and probes of one group for each threshold from 0 to ``tau``."""
    import numpy as np

    keys = _keys(np.asarray(sample, np.uint64), bits)
    n = len(keys)
    # Distances of sampled pairs at fixed shifts; a flat floor stands for what the sample can't show.
    near = np.zeros(tau + 1)
    shifts = range(1, min(n, 200))
    for shift in shifts:
        apart = np.bitwise_count(keys ^ np.roll(keys, shift))
        near += np.bincount(np.minimum(apart, tau + 1), minlength=tau + 2)[: tau + 1]
    pairs = max(1, n * len(shifts))
    costs, probes, share = [], 0, 0.0
    for t in range(tau + 1):
        probes += math.comb(len(bits), t)
        share += max(near[t] / pairs, math.comb(len(bits), t) / 2.0 ** len(bits))
        costs.append(share * rows * rows / 2 + PROBE_COST * rows * probes)
    return costs


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (a group left out) with sum ``total`` and the smallest summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(own)):
                offer = (cost + (own[t] if t >= 0 else 0.0), [*chosen, t])
                if spent + t not in step or offer < step[spent + t]:
                    step[spent + t] = offer
        best = step
    return best[total]


def choose(sample, rows: int, tau: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, of the number of groups that costs least."""
    options = []
    for groups in range(1, tau + 2):
        bits = group_bits(sample, groups)
        costs = [candidate_costs(sample, own, rows, tau) for own in bits]
        cost, thresholds = allocate(costs, tau - groups + 1)
        options.append((cost, groups, [(b, t) for b, t in zip(bits, thresholds, strict=True) if t >= 0]))
    return min(options)[2]


# --- links ----------------------------------------------------------------------------------------


def _flips(bits: list[int], threshold: int):
    """Patterns over the whole fingerprint that change up to ``threshold`` bits of a group."""
    import numpy as np

    patterns = [
        sum(1 << (BITS - 1 - bit) for bit in chosen)
        for t in range(1, threshold + 1)
        for chosen in combinations(bits, t)
    ]
    return np.array(patterns, np.uint64)


def _filed(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (part, value, fp, probe): each fingerprint under its own value and under those it probes."""
    masks = [sum(1 << (BITS - 1 - bit) for bit in bits) for bits, _ in plan]

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(whole), 4096):
                values = whole[low : low + 4096]
                for part, (mask, (bits, threshold)) in enumerate(zip(masks, plan, strict=True)):
                    own = values & np.uint64(mask)
                    flips = _flips(bits, threshold)
                    probed = (own[:, None] ^ flips[None, :]).ravel()
                    keys = np.concatenate([own, probed])
                    fps = np.concatenate([values, np.repeat(values, len(flips))])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), part, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(fps.view(np.int64)),
                            pa.array(np.arange(len(keys)) >= len(values)),
                        ],
                        ["part", "value", "fp", "probe"],
                    )

    return distinct.select("fp").mapInArrow(scan, "part int, value bigint, fp bigint, probe boolean")


def forest(values, is_probe, tau: int) -> list[tuple[int, int]]:
    """Links that connect the filed fingerprints with all filed or probing ones within ``tau``.

    Breadth-first: each fingerprint is compared with those not reached yet, so a dense cluster costs
    one link per member. Two probes are not compared; their own values have them compared.
    """
    import numpy as np

    links = []
    left = np.arange(len(values))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= tau
            if is_probe[at]:
                near &= ~is_probe[left]
            if near.any():
                reached = left[near]
                links += [(int(values[at]), int(v)) for v in values[reached]]
                queue += reached.tolist()
                left = left[~near]
    return links


def _link_batches(tau: int):
    """Compare rows that come sorted by group; only the groups that span batches are held over."""

    def links_of(starts, values, probes) -> list[tuple[int, int]]:
        import numpy as np

        found: list[tuple[int, int]] = []
        sizes = np.diff(np.append(starts, len(values)))
        large = sizes > 16
        for at, size in zip(starts[large], sizes[large], strict=True):
            found += forest(values[at : at + size], probes[at : at + size], tau)
        # Small groups all at once: each row with the one k places on, if it is in the same group.
        stop = np.repeat(np.where(large, 0, starts + sizes), sizes)
        row = np.arange(len(values))
        for k in range(1, 16):
            row = row[row + k < stop[row]]
            if not len(row):
                break
            a, b = values[row], values[row + k]
            near = (np.bitwise_count(a ^ b) <= tau) & ~(probes[row] & probes[row + k])
            found += list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        return found

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept = None
        names = ["part", "value", "block", "fp", "probe"]

        def out(columns, cut: int):
            values, probes = columns[3][:cut].view(np.uint64), columns[4][:cut]
            change = np.zeros(cut, bool)
            change[:1] = True
            for column in columns[:3]:
                change[1:] |= column[1:cut] != column[: cut - 1]
            pairs = sorted({(min(p), max(p)) for p in links_of(np.flatnonzero(change), values, probes)})
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if kept is not None:
                columns = [np.concatenate(both) for both in zip(kept, columns, strict=True)]
            n = len(columns[0])
            last = [column[-1] for column in columns[:3]] if n else None
            same = np.ones(n, bool)
            for column, value in zip(columns[:3], last or [], strict=False):
                same &= column == value
            cut = n - int(same.sum())
            kept = [column[cut:] for column in columns]
            if cut:
                yield out(columns, cut)
        if kept is not None and len(kept[0]):
            yield out(kept, len(kept[0]))

    return scan


def links(distinct: DataFrame, tau: int, *, block: int = BLOCK, sample_rows: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints exactly as all pairs within ``tau`` would."""
    import numpy as np

    rows = distinct.count()
    # A bounded sample in hash order; it sets the thresholds, and any thresholds give the same links.
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()]
    plan = choose(np.array(sample or [0], np.int64).view(np.uint64), rows, tau)
    filed = _filed(distinct, plan)
    # Values with more rows than a block, from counts combined before the shuffle.
    sizes = filed.groupBy("part", "value").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    hot = stage(sizes.where(F.col("n") > block).select("part", "value", blocks), "hot-values")
    return _compare(filed, hot, tau)


def _compare(filed: DataFrame, hot: DataFrame, tau: int) -> DataFrame:
    spread = filed.join(hot, ["part", "value"], "left")
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    # Pair (i, j) of blocks, i <= j: a row of block x joins (min(x, y), max(x, y)) for every y.
    paired = spread.withColumn("_own", own).withColumn("_other", other)
    pair = F.least("_own", "_other") * F.lit(1 << 20) + F.greatest("_own", "_other")
    keyed = paired.select("part", "value", pair.cast("bigint").alias("block"), "fp", "probe")
    sorted_rows = keyed.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "fp")
    return sorted_rows.mapInArrow(_link_batches(tau), "a bigint, b bigint").distinct()


# --- components -----------------------------------------------------------------------------------


def _digest(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(code), F.sum(code % (1 << 31))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (a member that names its component) for every node with a link.

    Alternates two steps until nothing changes: larger neighbours of a node, then all its smaller
    ones, are tied to its smallest neighbour. Each round is written and read back.
    """
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are staged so that adaptive execution can split the links of a node with many.
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = stage(large.where("u <> v").distinct(), "large-star")
        smallest = stage(down.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        tied = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stage(tied.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, *, width: int, tau: int, **columns) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest document id that links reach, the document itself included.
    """
    marked = stage(fingerprints(docs, width, **columns), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    found = stage(components(links(distinct, tau)), "components")
    members = found.join(distinct, found["node"] == distinct["fp"])
    least = members.groupBy("root").agg(F.min("least_id").alias("linked_id"))
    of_fp = found.join(least, "root").select(F.col("node").alias("fp"), "linked_id")
    # Every distinct fingerprint with its answer; copies of a hot one are split by adaptive execution.
    answers = stage(
        distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("linked_id", "least_id").alias("component_id")),
        "answers",
    )
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(answers, "fp").select("doc_id", "fp", hexed, "component_id")
