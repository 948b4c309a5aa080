"""Toxicity by compression distance: does a text compress better after toxic text or after ordinary text?

Two zstandard dictionaries are trained on labelled text, one on what toxic documents say and ordinary
ones don't, one the other way round; both follow the same background, trained on all of it, so that
what the classes share costs the same in both. A document is cut into windows of a few words, each
window is compressed with either dictionary, and the difference in length is its margin. A document's
largest margins, with its number of windows, go through a logistic calibration fitted on labelled
documents by dictionaries that have not seen them; a fixed threshold on that score decides.

What a class says is counted by distinct contexts (a word with the word before it), so that copies of a
document teach no more than one. Labelled rows are read up to a bound for each part (parameters of
``train``), taken in hash order; every text is read whole and every document is scored.

Defined cases: null and empty texts score like one window that fits neither class; without labels of both
classes every score is 0; labels that repeat an id count once, as toxic if any says so; rows with one id
are scored apart; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import nlargest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

WORDS_PER_WINDOW = 8
TOP_MARGINS = 3
THRESHOLD = 0.7
# Labelled documents of each class in each half of the sample.
DOCUMENTS = 2_000
# Contexts a word needs to count at all, and words that are kept.
LEAST_CONTEXTS = 6
MOST_WORDS = 30_000
# A word belongs to a class when it is this many times as frequent there (log), with at least this
# share of the evidence of the class's strongest word.
LOG_RATIO = 2.0
EVIDENCE_SHARE = 0.08
BACKGROUND_BYTES = 32_768
CLASS_BYTES = 2_048
# Ends of words that are not part of them.
_EDGES = b"\t\n\x0b\x0c\r .,;:!?\"'()[]{}|*#%$&<>-"


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [word for word in (w.strip(_EDGES) for w in words) if word]


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries and the weights of the calibration; about 80 KB."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


# --- scoring --------------------------------------------------------------------------------------


def _compressor(content: bytes):
    import zstandard as zstd

    parameters = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=6, target_length=32,
        strategy=zstd.STRATEGY_LAZY2, write_content_size=False,
    )
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self._ordinary, self._toxic = _compressor(ordinary), _compressor(toxic)

    def features(self, text: str | None) -> list[float]:
        """The largest margins, largest first, and the logarithm of the number of windows."""
        words = words_of(text)
        starts = range(0, len(words) or 1, WORDS_PER_WINDOW)
        windows = [b" %b " % b" ".join(words[i : i + WORDS_PER_WINDOW]) for i in starts]
        ordinary, toxic = self._ordinary, self._toxic
        margins = nlargest(TOP_MARGINS, [len(ordinary(w)) - len(toxic(w)) for w in windows])
        return [*map(float, margins), *[0.0] * (TOP_MARGINS - len(margins)), math.log(len(windows))]


def _probability(features, weights):
    import numpy as np

    x = np.column_stack([np.asarray(features, float).reshape(-1, TOP_MARGINS + 1), np.ones(len(features))])
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights), -500, 500)))


def _features(texts: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(doc_id, label, features) of (doc_id, label, text)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(ordinary, toxic)
        for batch in batches:
            rows = [scorer.features(text.as_py()) for text in batch.column(2)]
            features = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], ["doc_id", "label", "features"])

    return texts.mapInArrow(scan, "doc_id bigint, label int, features array<double>")


def score(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    if model is None:
        return chosen.select("doc_id", F.lit(0.0).alias("score"))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            rows = [scorer.features(text.as_py()) for text in batch.column(1)]
            scores = pa.array(_probability(rows, model.weights)) if rows else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return chosen.mapInArrow(scan, "doc_id bigint, score double")


# --- training -------------------------------------------------------------------------------------


def _contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic_0, ordinary_0, toxic_1, ordinary_1): distinct contexts of a word by class and half."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for label, text, half in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                pairs = set(zip([b"", *words], words, strict=False))
                word, before = zip(*pairs, strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([half.as_py()] * len(word), pa.int32()), pa.array([label.as_py()] * len(word), pa.int32()),
                     pa.array(word, pa.binary()), pa.array(before, pa.binary())],
                    ["half", "label", "word", "before"],
                )

    pairs = sample.mapInArrow(scan, "half int, label int, word binary, before binary").distinct()
    return pairs.groupBy("word").agg(*[
        F.count_if((F.col("half") == half) & (F.col("label") == label)).alias(f"{name}_{half}")
        for half in (0, 1)
        for label, name in ((1, "toxic"), (0, "ordinary"))
    ])


def _dictionary(counts: dict[bytes, int], size: int) -> bytes:
    """A dictionary trained on the words, each as often as it has contexts, in a fixed shuffled order."""
    import random

    import zstandard as zstd

    words = [word for word in sorted(counts) for _ in range(min(counts[word], 200))]
    random.Random(8).shuffle(words)
    samples = [b" %b " % b" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    try:
        return zstd.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstd.ZstdError:
        # Too little text to choose from: all of it.
        return (b" %b " % b" ".join(sorted(counts)))[-size:]


def class_words(counts: list[tuple[bytes, int, int]]) -> tuple[dict, dict, dict]:
    """(background, toxic, ordinary) words with their numbers of contexts."""
    import numpy as np

    words = [row[0] for row in counts]
    a = np.array([row[1] for row in counts], float)
    b = np.array([row[2] for row in counts], float)
    total_a, total_b = max(a.sum(), 1), max(b.sum(), 1)
    ratio = np.log((a + 0.5) / total_a) - np.log((b + 0.5) / total_b)
    # Likelihood ratio of the word's counts against one common rate.
    share = total_a / (total_a + total_b)

    def term(own, expected):
        return np.where(own > 0, own * np.log(np.maximum(own, 1) / np.maximum(expected, 1e-9)), 0)

    evidence = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))

    def of_class(mask) -> dict:
        least = EVIDENCE_SHARE * evidence[mask].max() if mask.any() else 0
        return {words[i]: int(a[i] + b[i]) for i in np.flatnonzero(mask & (evidence >= least))}

    shared = {words[i]: int(a[i] + b[i]) for i in np.flatnonzero(np.abs(ratio) < LOG_RATIO)}
    return shared, of_class(ratio >= LOG_RATIO), of_class(ratio <= -LOG_RATIO)


def fit_logistic(features, labels, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic model, by Newton's method with a small ridge."""
    import numpy as np

    x = np.column_stack([np.asarray(features, float), np.ones(len(features))])
    y = np.asarray(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _contents(counts: list[tuple[bytes, int, int]]) -> tuple[bytes, bytes] | None:
    """Contents of the ordinary and the toxic dictionary, none when nothing sets the toxic class apart."""
    shared, toxic, ordinary = class_words([row for row in counts if row[1] + row[2] >= LEAST_CONTEXTS])
    if not toxic:
        return None
    background = _dictionary(shared, BACKGROUND_BYTES) if shared else b" "
    specific = [_dictionary(own, CLASS_BYTES) if own else b"" for own in (ordinary, toxic)]
    return background + specific[0], background + specific[1]


def train(
    docs: DataFrame, labels: DataFrame, *, documents: int = DOCUMENTS, id_column: str = "doc_id",
    text_column: str = "text", label_column: str = "toxic",
) -> Model | None:
    """Dictionaries and calibration from bounded samples of the labelled rows that aren't held out.

    The sample has two halves. Each half is scored by dictionaries trained on the other one, which gives
    the calibration; the dictionaries that go into the model are trained on both.
    """
    doc_id = F.col(id_column).cast("bigint")
    known = labels.select(doc_id.alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    own_half = F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string")).cast("binary")) % 2
    halves = known.withColumn("half", own_half.cast("int"))
    chosen = [
        halves.where((F.col("half") == half) & (F.col("label") == label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
        for half in (0, 1)
        for label in (0, 1)
    ]
    sample = reduce(lambda a, b: a.unionByName(b), chosen)
    texts = docs.select(doc_id.alias("doc_id"), F.col(text_column).alias("text"))
    # At most four times the bound, so the ids may be broadcast.
    taught = stage(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", "half"), "labelled")
    parts = ["toxic_0", "ordinary_0", "toxic_1", "ordinary_1"]
    total = reduce(lambda a, b: a + b, map(F.col, parts))
    counts = _contexts(taught).where(total >= LEAST_CONTEXTS).orderBy(total.desc(), "word").limit(MOST_WORDS).collect()
    rows = [(bytes(r["word"]), *(r[name] for name in parts)) for r in counts]
    final = _contents([(w, t0 + t1, o0 + o1) for w, t0, o0, t1, o1 in rows])
    by_half = [_contents([(r[0], r[1 + 2 * half], r[2 + 2 * half]) for r in rows]) for half in (0, 1)]
    if final is None or None in by_half:
        return None
    scored = [
        _features(taught.where(F.col("half") == 1 - half).select("doc_id", "label", "text"), *by_half[half]) for half in (0, 1)
    ]
    seen = scored[0].unionByName(scored[1]).select("label", "features").collect()
    prior = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = Counter(r["label"] for r in seen)
    if len(prior) < 2 or len(drawn) < 2:
        return None
    weights = fit_logistic([r["features"] for r in seen], [r["label"] for r in seen])
    # The bounds change the classes' proportions; the intercept takes them back to those of the labels.
    shift = math.log(prior[1] / prior[0]) - math.log(drawn[1] / drawn[0])
    return Model(*final, (*weights[:-1], weights[-1] + shift))


def classify(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_column: str = "doc_id",
    text_column: str = "text", **options,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    columns = {"id_column": id_column, "text_column": text_column}
    scored = score(docs, train(docs, labels, **columns, **options), **columns)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
