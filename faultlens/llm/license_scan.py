"""Licence texts and notices in documents, by Dice coefficient over word bigrams; DataFrame functions only.

Texts are normalised to lower-case words of ASCII letters and digits. A document is looked at whole, line
by line, and in every run of consecutive words, so that a notice wrapped over lines of a longer document
and a sentence inside a longer line are found. For bags of bigrams a and b, Dice is 2 |a & b| / (|a| + |b|),
so a template of n bigrams can reach a threshold t only in a text of n t / (2 - t) to n (2 - t) / t bigrams,
n t / (2 - t) of them shared: other units, and documents that share fewer, are passed over. Bigrams find
their templates in a table of the templates' bigrams, which is broadcast: its size is that of the template
list given, not of the data. Only bigrams of templates go on from there, dealt by document and row, so a
hot source costs what its documents cost.

The best run of words begins and ends with a shared bigram. A start is left out where the run that begins
one or two places before it always scores as high, or where too few shared bigrams follow. Of runs of
one template that share a third of their words the best score stays, then, over templates, the one that shares
most bigrams. A run inside a line or document that matches the same template is not told twice.
Runs are compared within stretches that overlapping runs connect, so many notices in one document take time in
proportion.

Defined cases: null and empty texts match nothing; a text of one word has no bigrams; of equal scores the
whole document comes before its lines, then the first line (of a run: where it begins), then the first
template id; rows that repeat are answered alike; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Numbers in place of a line: the document itself, so that documents without a match stay, and its runs of words.
_ITSELF, _RUNS = -1, -2

# Wordings of public licences, as their publishers give them. Ids follow SPDX.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU Affero General Public License for more details.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "BSD-2-Clause-line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-line": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def all_templates() -> dict[str, str]:
    """The wordings above, and the full licences and further notices of ``licenses``, by file name."""
    texts = {file.stem: file.read_text(encoding="utf-8") for file in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return TEMPLATES | texts


def template_bigrams(text: str) -> Counter:
    """The bag of a template's bigrams."""
    import re

    words = re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams of a text that can reach the threshold against ``n``."""
    low = next(m for m in range(n + 1) if m == n or 2 * m / (n + m) >= threshold)
    high = n
    while 2 * n / (n + high + 1) >= threshold:
        high += 1
    return low, high


# Words that nearly every text has: they tell no licence from prose, so others are asked for first.
COMMON_WORDS = frozenset(
    "a an and any are as at be been but by can do for from has have if in into is it its may must no not of on only or "
    "other our out so such than that the their them there these they this to under was we were what when where which "
    "who will with without you your each all one above below".split()
)


def anchor_words(bags: dict[str, Counter], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold against any template has at least one.

    Such a text shares ``low`` of a template's n bigrams at least. Words whose bigrams are more than n - low of them
    can't all be absent. Few words that serve many templates are chosen, one by one.
    """
    open_bags = {name: Counter(bag) for name, bag in bags.items()}
    needs = {name: bag.total() - bounds(bag.total(), threshold)[0] + 1 for name, bag in bags.items()}
    chosen: list[str] = []
    while needs:
        gains: Counter = Counter()
        for name, need in needs.items():
            held: Counter = Counter()
            for bigram, n in open_bags[name].items():
                for word in set(bigram.split(" ")):
                    held[word] += n
            for word, n in held.items():
                gains[word] += min(n, need) / need
        best = min(gains, key=lambda word: (word in COMMON_WORDS, -gains[word], word))
        chosen.append(best)
        for name in list(needs):
            bag = open_bags[name]
            for bigram in [b for b in bag if best in b.split(" ")]:
                needs[name] -= bag.pop(bigram)
            if needs[name] <= 0:
                del needs[name]
    return chosen


def _any_word(words: list[str]) -> str:
    """Pattern of any of the words as a word, in either case; words of one first letter are tried together."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(words):
        by_letter.setdefault(word[0], []).append(word[1:])
    tried = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return rf"(?i)(?<![A-Za-z0-9])(?=[{''.join(by_letter)}])(?:{tried})(?![A-Za-z0-9])"


def _template_table(docs: DataFrame, bags: dict[str, Counter], threshold: float) -> DataFrame:
    rows = [
        {"license_id": name, "template_size": bag.total(), "low": low, "high": high, "bag": bag}
        for name, bag in bags.items()
        for low, high in [bounds(bag.total(), threshold)]
    ]
    # The empty bigram stands for the document itself, so that documents without a match stay.
    rows.append({"license_id": None, "template_size": 0, "low": 0, "high": 0, "bag": {"": 0}})
    sizes = ["license_id", "template_size", "low", "high"]
    schema = "array<struct<license_id:string,template_size:int,low:int,high:int,bag:map<string,int>>>"
    templates = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    return templates.select(*sizes, F.explode("bag").alias("bigram", "in_template"))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document.

    ``matches`` are the units that reach the threshold with their best template (line 0: the whole
    document) and the runs of words that reach it elsewhere (line where they begin); ``license_id``,
    ``score`` and ``line`` are the best of them, null where there is none.
    """
    bags = {name: bag for name, text in sorted((templates or all_templates()).items()) if (bag := template_bigrams(text))}
    table = _template_table(docs, bags, threshold)
    sizes = sorted(bounds(bag.total(), threshold) for bag in bags.values())
    text = F.coalesce(F.col(text_column), F.lit(""))
    hopeful = text.rlike(_any_word(anchor_words(bags, threshold))) if bags else F.lit(False)
    plain = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\n]+", " "))
    # Rows are told apart by their place as well, in case they repeat whole.
    # A text without any anchor word matches nothing and is not normalised.
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("_text"), F.monotonically_increasing_id().alias("_row"),
        F.when(hopeful, plain).alias("plain"),
    )

    def unit(line: Column, words: Column, counts: Column | None = None) -> Column:
        n = F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))
        counts = F.lit(None).cast("array<int>") if counts is None else counts
        return F.struct(line.cast("int").alias("line"), n.alias("n"), words.alias("words"), counts.alias("counts"))

    joined = F.btrim(F.regexp_replace("plain", "[ \n]+", " "))
    cut = F.split("plain", "\n", -1)
    lines = F.transform(cut, lambda x, i: unit(i + 1, F.btrim(x)))
    fits = lambda u: reduce(lambda a, b: a | b, [u["n"].between(*span) for span in _spans(sizes)], F.lit(False))
    counts = F.transform(cut, lambda x: F.when(F.btrim(x) == "", 0).otherwise(F.size(F.split(F.btrim(x), " "))))
    itself = F.array(unit(F.lit(_ITSELF), F.lit(""), counts))
    runs = F.filter(F.array(unit(F.lit(_RUNS), joined)), lambda u: u["n"] >= min((low for low, _ in sizes), default=0))
    key = ["doc_id", "_text", "_row"]
    found_units = F.filter(F.concat(F.array(unit(F.lit(0), joined)), lines), fits)
    alone = F.array(unit(F.lit(_ITSELF), F.lit("")))
    looked_at = F.when(F.col("plain").isNotNull(), F.concat(itself, runs, found_units)).otherwise(alone)
    units = rows.select(*key, F.explode(looked_at).alias("u"))
    words = units.select(*key, "u.line", "u.n", "u.counts", F.split("u.words", " ").alias("words"))
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    own = F.when(F.col("line") == _ITSELF, F.array(F.lit(""))).otherwise(pairs)
    found = words.select(*key, "line", "n", "counts", F.posexplode(own).alias("place", "bigram")).join(F.broadcast(table), "bigram")
    is_run = F.col("line") == _RUNS
    in_bounds = F.when(is_run, F.col("n") >= F.col("low")).otherwise(F.col("n").between(F.col("low"), F.col("high")))
    found = found.where(in_bounds).repartition(*key)
    # All groups below keep a document in its partition.
    unit_key = [*key, "line", "n", "counts", "license_id", "template_size", "low", "high"]
    places = F.collect_list(F.when(is_run, F.col("place")))
    shared = found.groupBy(*unit_key, "bigram", "in_template").agg(F.count("*").alias("here"), places.alias("places"))
    common = F.sum(F.least("here", "in_template"))
    groups = F.collect_list(F.when(is_run, F.struct(F.array_sort("places").alias("places"), "in_template")))
    totals = shared.groupBy(*unit_key).agg(common.alias("common"), groups.alias("groups"))
    score = F.lit(2.0) * F.col("common").cast("double") / F.nullif(F.col("n") + F.col("template_size"), F.lit(0))
    enough = is_run & (F.col("common") >= F.col("low"))
    scored = totals.select(
        *key, "line", "counts", "license_id", F.when(~is_run, score).alias("score"),
        F.when(enough, _runs(threshold)).alias("runs"),
    )
    best = scored.groupBy(*key, "line", "counts").agg(
        F.max("score").alias("score"), F.collect_list(F.struct("score", "license_id")).alias("all"),
        F.flatten(F.collect_list("runs")).alias("runs"),
    )
    first = F.array_min(F.transform(F.filter("all", lambda s: s["score"] == F.col("score")), lambda s: s["license_id"]))
    unit_match = F.when(F.col("score") >= threshold, F.struct("line", "score", first.alias("license_id")))
    documents = best.groupBy(*key).agg(
        F.collect_list(unit_match).alias("units"), F.flatten(F.collect_list("runs")).alias("runs"),
        F.first("counts", ignorenulls=True).alias("counts"),
    )
    documents = documents.select("doc_id", F.array_sort(F.concat("units", _untold(F.col("runs")))).alias("matches"))
    documents = documents.withColumn("top", F.array_max(F.transform("matches", lambda m: m["score"])))
    top = F.filter("matches", lambda m: m["score"] == F.col("top"))
    top = F.when(F.size(top) > 0, top[0])
    return documents.select(
        "doc_id", top["license_id"].alias("license_id"), top["score"].alias("score"), top["line"].alias("line"),
        F.size("matches").cast("bigint").alias("n_matches"), "matches",
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _runs(threshold: float) -> Column:
    """Runs of words that reach the threshold against one template.

    A hit at place p counts in a run from s on when fewer than ``in_template`` equal ones lie between:
    when the one that many before it, q, is before s. r is the one that many after it.
    """
    n, low, high = F.col("template_size"), F.col("low"), F.col("high")

    def hit(group: Column) -> Column:
        times, own = group["in_template"], group["places"]
        return F.transform(own, lambda p, i: F.struct(
            p.alias("p"), F.coalesce(F.when(i >= times, F.get(own, i - times)), F.lit(-1)).alias("q"),
            F.coalesce(F.get(own, i + times), F.lit(2**31 - 1)).alias("r"),
        ))

    def starts(hits: Column) -> Column:
        def open_at(i: Column) -> Column:
            here, before = F.get(hits, i)["p"], F.get(hits, i - 1)
            behind = (i > 0) & (here - before["p"] <= 2) & (before["r"].cast("bigint") > before["p"] + high + 1)
            enough = F.coalesce(F.get(hits, i + low - 1)["p"] < here + high, F.lit(False))
            return enough & ~F.coalesce(behind, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(hits) - 1), open_at)

    def best_from(hits: Column, i: Column) -> Column:
        def step(so_far: Column, h: Column) -> Column:
            common = so_far["now"] + F.when(h["q"] < so_far["start"], 1).otherwise(0)
            length = h["p"] - so_far["start"] + 1
            score = F.lit(2.0) * common / (n + length)
            better = (length <= high) & (score > so_far["score"])
            pick = lambda new, old: F.when(better, new).otherwise(so_far[old]).alias(old)
            return F.struct(
                so_far["start"].alias("start"), common.cast("int").alias("now"), pick(score, "score"),
                pick(common.cast("int"), "common"), pick(h["p"], "stop"),
            )

        zero = F.struct(
            F.get(hits, i)["p"].alias("start"), F.lit(0).alias("now"), F.lit(0.0).alias("score"), F.lit(0).alias("common"),
            F.lit(-1).alias("stop"),
        )
        return F.aggregate(F.slice(hits, i + 1, high), zero, step)

    def all_runs(hits: Column) -> Column:
        ends = F.filter(F.transform(starts(hits), lambda i: best_from(hits, i)), lambda w: w["score"] >= threshold)
        named = F.transform(ends, lambda w: F.struct(
            (-w["score"]).alias("_1"), (-w["common"]).alias("_2"), w["start"].alias("start"), w["stop"].alias("stop"),
            F.col("license_id").alias("license_id"),
        ))
        return _apart(named)

    return _let(F.array_sort(F.flatten(F.transform("groups", hit))), all_runs)


def _apart(runs: Column) -> Column:
    """Runs in their order, without those that share a third of a run before them.

    Runs that nothing connects by place can't share words, so each connected stretch is looked at by itself.
    """
    by_place = F.array_sort(F.transform(runs, lambda w: F.struct(w["start"].alias("at"), w["stop"].alias("stop"), w.alias("run"))))

    def stretches(placed: Column) -> Column:
        furthest = F.aggregate(
            placed, F.array().cast("array<int>"),
            lambda so_far, w: F.concat(so_far, F.array(F.greatest(w["stop"], F.coalesce(F.get(so_far, F.size(so_far) - 1), w["stop"])))),
        )

        def cut(reach: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(placed) - 1)
            begins = F.filter(places, lambda i: (i == 0) | (F.get(placed, i)["at"] > F.get(reach, i - 1)))
            return _let(begins, lambda at: F.transform(at, lambda b, k: F.slice(
                placed, b + 1, F.coalesce(F.get(at, k + 1), F.size(placed)) - b
            )))

        return _let(furthest, cut)

    kept = _let(by_place, lambda placed: F.transform(
        stretches(placed), lambda part: _apart_within(F.transform(part, lambda w: w["run"]))
    ))
    return F.when(F.size(runs) < 2, runs).otherwise(F.flatten(kept))


def _apart_within(runs: Column) -> Column:

    def near(a: Column, b: Column) -> Column:
        both = F.least(a["stop"], b["stop"]) - F.greatest(a["start"], b["start"]) + 1
        return both * 3 > F.least(a["stop"] - a["start"], b["stop"] - b["start"]) + 1

    nothing = F.filter(runs, lambda w: F.lit(False))
    keep = lambda kept, w: F.when(F.exists(kept, lambda k: near(k, w)), kept).otherwise(F.concat(kept, F.array(w)))
    return F.aggregate(F.array_sort(runs), nothing, keep)


def _untold(runs: Column) -> Column:
    """Of all templates' runs those that stand for themselves, as matches; ``units`` and ``counts`` are the document's."""
    by_common = F.transform(runs, lambda w: F.struct(
        w["_2"].alias("_1"), w["_1"].alias("_2"), w["start"].alias("start"), w["stop"].alias("stop"), w["license_id"].alias("license_id"),
    ))

    def line_of(word: Column) -> Column:
        def step(so_far: Column, count: Column) -> Column:
            inside = so_far["before"] + count > word
            return F.when(so_far["done"] | inside, F.struct(so_far["before"], so_far["line"], F.lit(True).alias("done"))).otherwise(
                F.struct((so_far["before"] + count).alias("before"), (so_far["line"] + 1).alias("line"), F.lit(False).alias("done"))
            )

        zero = F.struct(F.lit(0).alias("before"), F.lit(1).alias("line"), F.lit(False).alias("done"))
        return F.aggregate("counts", zero, step, lambda so_far: so_far["line"])

    placed = F.transform(_apart(by_common), lambda w: F.struct(
        line_of(w["start"]).alias("line"), (-w["_2"]).alias("score"), w["license_id"].alias("license_id"),
        line_of(w["stop"] + 1).alias("last"),
    ))
    told = lambda w: F.exists("units", lambda m: (m["license_id"] == w["license_id"]) & (
        (m["line"] == 0) | ((m["line"] == w["line"]) & (w["line"] == w["last"]))
    ))
    return F.transform(F.filter(placed, lambda w: ~told(w)), lambda w: F.struct(w["line"], w["score"], w["license_id"]))


def _spans(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined."""
    out: list[tuple[int, int]] = []
    for low, high in sizes:
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
