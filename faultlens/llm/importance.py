"""Quality by importance resampling over hashed n-grams.

Two generative models share one feature space: words and pairs of neighbouring words, hashed into a fixed
number of buckets. One model counts the target (documents labelled as good), the other all documents.
A document's log weight is the sum over its features of the log ratio of the two models. Documents are
drawn without replacement in proportion to their weights by adding Gumbel noise to each log weight and
keeping the largest: the noise comes from a hash of the id and text, so a draw is repeatable.

Counts are combined in every task before they are shuffled, over all documents and whole texts. The k-th
largest key is found exactly by counting keys in a fixed number of ranges, three times over, so no rows
are sorted or gathered.

Defined cases: a null or empty text has log weight 0; without a target every log weight is 0; equal keys
go to the smaller id, then the smaller text digest, null ids last; rows that repeat in id and text are one draw, so
they stay or go together and count as one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

BUCKETS = 10_000
SMOOTHING = 1.0
KEEP_SHARE = 0.5


def features(text: str | None, buckets: int):
    """Bucket counts of a text's words and neighbouring pairs."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(buckets, np.int64)
    distinct = {word: i for i, word in enumerate(dict.fromkeys(words))}
    hashes = np.array([xxh3_64_intdigest(word) for word in distinct], np.uint64)
    own = hashes[np.array([distinct[word] for word in words])]
    with np.errstate(over="ignore"):
        # A pair's hash depends on the order of its words.
        pairs = (own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    every = np.concatenate([own, pairs]) % np.uint64(buckets)
    return np.bincount(every.astype(np.int64), minlength=buckets)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all texts of a one-column table, summed within each task first."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += features(text.as_py(), buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.mapInArrow(scan, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int):
    """The counts as a vector of fixed length."""
    import numpy as np

    out = np.zeros(buckets)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def log_ratio(target: DataFrame, raw: DataFrame, buckets: int):
    """Log of target over raw probability of each bucket; zeros without a target."""
    import numpy as np

    good, every = _vector(bucket_counts(target, buckets), buckets), _vector(bucket_counts(raw, buckets), buckets)
    if not good.sum():
        return np.zeros(buckets)
    good, every = good + SMOOTHING, every + SMOOTHING
    return np.log(good / good.sum()) - np.log(every / every.sum())


def weigh(docs: DataFrame, ratio, seed: int) -> DataFrame:
    """(doc_id, digest, log_weight, gumbel_key, rank_key); ``rank_key`` orders like ``gumbel_key``, as an integer."""
    buckets = len(ratio)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            weights, digests, noise = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                weights.append(float(features(text, buckets) @ ratio))
                digest = xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                digests.append(digest)
                code = xxh3_64_intdigest(digest + str(doc_id.as_py()).encode(), seed)
                noise.append((code + 0.5) / 2.0**64)
            u = np.clip(np.array(noise), 1e-300, 1 - 2.0**-53)
            weight = np.array(weights)
            key = weight - np.log(-np.log(u)) + 0.0
            # Doubles order like integers once the negative ones are flipped; then shifted to be positive.
            bits = key.view(np.int64)
            ordered = np.where(bits >= 0, bits, ~bits ^ np.int64(-(2**63)))
            rank = (ordered >> 1) + np.int64(2**62)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(weight), pa.array(key), pa.array(rank)],
                ["doc_id", "digest", "log_weight", "gumbel_key", "rank_key"],
            )

    schema = "doc_id bigint, digest binary, log_weight double, gumbel_key double, rank_key bigint"
    return docs.mapInArrow(scan, schema)


def kth_largest(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """(value, how many of that value belong to the k largest) of a column ``rank_key`` of 63-bit integers.

    Each pass counts the keys that share the digits found so far by their next digits, summing within
    ranges before single digits are looked at; at most two thousand counts reach the driver at a time.
    """
    prefix, left, shift = 0, k, 63
    for bits in (11, 10, 11, 10, 11, 10):
        shift -= bits
        inside = keys.where(F.shiftright("rank_key", shift + bits) == prefix)
        digit = F.shiftright("rank_key", shift).bitwiseAND(F.lit((1 << bits) - 1))
        counts = dict(inside.groupBy(digit.alias("digit")).count().collect())
        for value in sorted(counts, reverse=True):
            if left <= counts[value]:
                prefix = prefix << bits | value
                break
            left -= counts[value]
        else:
            return None
    return prefix, left


def resample(
    docs: DataFrame, target_ids: DataFrame, *, keep_share: float = KEEP_SHARE, buckets: int = BUCKETS, seed: int = 17,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``log_weight``, ``gumbel_key`` and ``selected`` of every row.

    ``target_ids`` (doc_id) names the documents of the target. The share of the distinct rows that is
    drawn is rounded up.
    """
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    wanted = target_ids.select(F.col(id_column).cast("bigint").alias("doc_id")).distinct()
    # The ids grow with the corpus: never broadcast, one plan at every size.
    target = chosen.join(wanted.hint("merge"), "doc_id", "left_semi").select("text")
    ratio = log_ratio(target, chosen.select("text"), buckets)
    weighed = stage(weigh(chosen, ratio, seed), "weights")
    keys = ["doc_id", "digest"]
    single = weighed.groupBy(*keys).agg(F.max("rank_key").alias("rank_key"))
    single = stage(single, "draws")
    total = single.count()
    cut = kth_largest(single, -int(-total * keep_share // 1)) if total else None
    if cut is None:
        return weighed.select("doc_id", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    value, room = cut
    # Equal keys at the cut go by id and digest; there are as many as hash collisions allow.
    tied = single.where(F.col("rank_key") == value).orderBy(F.col("doc_id").isNull(), "doc_id", "digest").limit(room)
    tied = tied.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
                       F.col("digest").alias("_digest"), F.lit(True).alias("_tied"))
    match = ((F.coalesce("doc_id", F.lit(0)) == F.col("_id")) & (F.col("doc_id").isNull() == F.col("_none"))
             & (F.col("digest") == F.col("_digest")))
    marked = weighed.join(tied, match, "left")
    selected = (F.col("rank_key") > value) | F.coalesce("_tied", F.lit(False))
    return marked.select("doc_id", "log_weight", "gumbel_key", selected.alias("selected"))
