"""Quality rules, Merkle manifest and spelling variants against plain Python, on difficult rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultlens import session
from faultlens.llm import merkle, quality_rules, spelling

SPACE = " \t\n\x0b\x0c\r"
LONG = "the long line of an old text\n" * 400 + "tail " * 3000
TEXTS = [
    None, "", " \n\t ", "one", "A b\nc d", "é è  ü x × ÷ straße Ångström", "日本 語 🙂", LONG, "x" * 50_000, "ab " * 30,
    "one two three four five six seven eight nine ten " * 2, "a|b # $ * & < > %" * 9, "a line\na line\n\n\na line \nb",
]
ROWS = [(i * 3, t, "en", "src0", 5) for i, t in enumerate(TEXTS)]
ODD = [
    *ROWS, ROWS[4], ROWS[4], (None, "no id here", None, None, None), (None, "no id here", None, None, None),
    (None, None, None, "s", 1), (4, "Ärger Im Haus", "", "src:1", -2), (4, "other text of that id", "", "src:1", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    names = "place tree at size digest run slot path row word n form root shard block signal bucket upto total kept leaf".split()
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in names})


def random_rows(seed, n, langs=("en", "de", None), words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words)))
        rows.append((rng.randint(0, n * 3), text, rng.choice(langs), rng.choice(["a", "b", None]), rng.randint(0, 99)))
    return rows


# --- quality rules --------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def plain_verdicts(rows, least_rows, reach):
    """base_failed and kept of each row, with quantiles taken from sorted buckets."""
    counts = [plain_counts(r[1]) for r in rows]
    base = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]

    def values(i):
        n, chars, symbols, dup, _ = counts[i]
        return 100 * chars // n, 1000 * symbols // n, 1000 * dup // n

    def bucket(v):
        unit = 1 << max(0, len(bin(v)) - 2 - 7)
        return v // unit * unit

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if not base[i]:
            for key in ((r[2], r[3]), (r[2],), ()):
                groups[key].append(values(i))

    def quartile(key, s, k):
        own = sorted(bucket(v[s]) for v in groups[key])
        return own[-(-len(own) * k // 4) - 1]

    kept = []
    for i, r in enumerate(rows):
        fine = not base[i]
        if fine:
            language = (r[2],) if len(groups[(r[2],)]) >= least_rows else ()
            own = (r[2], r[3]) if len(groups[(r[2], r[3])]) >= least_rows else language
            for s, (slack, low) in enumerate([(100, True), (100, False), (50, False)]):
                q1, q3 = quartile(own, s, 1), quartile(own, s, 3)
                spread = max(q3 - q1, quartile(language, s, 3) - quartile(language, s, 1))
                v = values(i)[s]
                fine = fine and v <= q3 + reach * spread + slack and (not low or v >= q1 - reach * spread - slack)
        kept.append(fine)
    return base, kept


@pytest.mark.parametrize("least_rows", [1, 25, 1000])
def test_quality_rules_equal_plain_ones(spark, least_rows):
    rng = random.Random(least_rows)
    rows = [*ODD, *random_rows(3, 150, words=90)]
    rows += [(9000 + i, "|".join(["abcdefghijklmnopqrstuvw " * 1] * rng.randint(20, 40)), "en", "a", 1) for i in range(4)]
    rows += [(9100, "### $$$ " * 5 + " ".join(f"w{i}" for i in range(60)), "de", "b", 1)]
    found = quality_rules.judge(frame(spark, rows), least_rows=least_rows).collect()
    base, kept = plain_verdicts(rows, least_rows, quality_rules.REACH)
    want = sorted((str(r[0]), *plain_counts(r[1]), b, k) for r, b, k in zip(rows, base, kept, strict=True))
    assert sorted((str(r.doc_id), *[r[c] for c in quality_rules.COUNTS], r.base_failed, r.kept) for r in found) == want
    assert any(b is False and k is False for b, k in zip(base, kept, strict=True))


def test_repeated_words():
    rng = random.Random(4)
    for window in (2, 3, 5, 8):
        for _ in range(60):
            words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
            seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
            hit = {i + k for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for k in range(window)}
            assert quality_rules.repeated_words(words, window) == len(hit)


def test_thresholds_follow_their_language_and_source(spark):
    """A word length that is usual in one source is an outlier in another."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        length = 5 if i % 2 else 12
        words = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(length - 1, length + 1))) for _ in range(50))
        rows.append((i, words, "xx" if i % 2 else "yy", "long" if i % 2 == 0 else "short", 0))
    stray = "".join(rng.choice("abcdefgh") for _ in range(12))
    rows.append((1000, " ".join(stray[:11] + chr(97 + i % 26) + chr(97 + i // 26) for i in range(50)), "xx", "short", 0))
    rows.append((1001, rows[0][1], "yy", "long", 0))
    got = {r.doc_id: (r.kept, r.broken) for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert got[1000] == (False, ["word_length"]) and got[1001] == (True, [])
    assert all(got[i][0] for i in range(600))


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("lang"), (F.col("id") % 5).cast("string").alias("source"),
        F.lit("s").alias("signal"), quality_rules.bucket(F.col("id") * F.col("id")).alias("bucket"),
    )
    n = F.count("*").alias("n")
    whole = rows.groupBy("signal", "bucket").agg(n)
    parts = quality_rules.merged(quality_rules.merged(rows.groupBy("lang", "source", "signal", "bucket").agg(n), "lang"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    kept = spark.range(5000).select(F.col("id"), quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id <= r.b * (1 + 1 / 64) for r in kept)


# --- merkle ---------------------------------------------------------------------------------------


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves, arity):
    """Root and, for each leaf, the siblings before and after on every level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // arity * arity
            path.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + arity])))
            at[i] //= arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(rows, arity):
    langs = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = plain_leaf(doc_id, source, lang, n_chars, text), plain_leaf(doc_id, source, lang, n_chars, changed)
        langs[lang].append((doc_id, *own))
    names = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in names:
        members = sorted(langs[lang], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees.append((members, *plain_tree([m[1] for m in members], arity)))
    root, above = plain_tree([t[1] for t in trees], arity) if trees else (None, [])
    out = []
    for (members, subroot, paths), top in zip(trees, above, strict=True):
        for (doc_id, leaf, changed), path in zip(members, paths, strict=True):
            proof, value = "", changed
            for before, after in path + top:
                proof, value = proof + before + after, h(before, value, after)
            out.append((str(doc_id), leaf, subroot, root, h(proof), value, value == root))
    return sorted(out)


COLUMNS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity, rows", [
    (8, ODD), (8, random_rows(1, 300)), (2, random_rows(2, 37)), (3, random_rows(5, 90, langs=[str(i) for i in range(11)])),
    (8, ROWS[:1]), (8, [(i, f"T{i}", "en", "s", 1) for i in range(9)]), (8, [(i, f"T{i}", "en", "s", 1) for i in range(65)]),
])
def test_manifest_equals_a_plain_one(spark, arity, rows):
    found = merkle.manifest(frame(spark, rows), arity=arity).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in found) == plain_manifest(rows, arity)


def test_every_change_of_a_column_shows(spark):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(20)]
    root = merkle.manifest(frame(spark, rows)).first().root
    for changed in [(3, "Text 3", "en", "s", 4), (3, "Text 3", "en", None, 3), (3, "text 3", "en", "s", 3), (3, "Text 3", "e", "ns", 3)]:
        assert merkle.manifest(frame(spark, [*rows[:3], changed, *rows[4:]])).first().root != root


def test_siblings_are_joined_without_another_shuffle(spark):
    level = spark.range(1000).select(
        (F.col("id") % 1).alias("tree"), F.col("id").alias("at"), F.lit(1000).cast("bigint").alias("size"),
        F.col("id").cast("string").alias("digest"),
    )
    level = session.stage(level, "level")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        with merkle._joins_within_runs(spark):
            plan = merkle._siblings(level, 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Join") >= 7
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


# --- spelling -------------------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 31 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    forms, near = {}, {}
    for w in words:
        close = [o for o in words if plain_near(w, o)]
        near[w] = len(close)
        best = min(close, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], near[w], words.get(forms[w])))
    return sorted(out, key=str)


def misspelt(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcdeéß")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word])


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeéß" if seed else "ab") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    rows = [*ODD]
    for i in range(200):
        word = bases[min(int(rng.expovariate(0.2)), 39)]
        spelt = [misspelt(rng, misspelt(rng, word)).capitalize() for _ in range(rng.randint(1, 3))]
        rows.append((i, f"{word} {word}, {word}. " * rng.randint(1, 9) + " ".join(spelt), "en", "s", 1))
    # From shards of every size up to blocks of a single one.
    monkeypatch.setattr(spelling, "COARSE", [(4, 16), (16,), (1,), (4,)][seed])
    found = spelling.variants(frame(spark, rows), shard_words=[20, 20_000, 30, 7][seed])
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    want = plain_variants(rows)
    assert sorted(got, key=str) == want
    assert any(r[1] for r in want)


def test_runs_of_letters():
    rng = random.Random(6)
    letters = "abzAZ09 -_.,\n×÷ßàÿÀĀēЯ日🙂¿ÂÃ\u0080¿"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
        assert [r.decode() for r in spelling.runs_of(text)] == want


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    words = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abcdlkji", "abcmlkji"]
    forms = spark.createDataFrame(list(zip(words[1:], words, strict=False)), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {w: words[0] for w in words[1:]}


def test_search_reaches_all_that_budgets_allow():
    import numpy as np

    rng = np.random.default_rng(2)
    own, seekers = rng.integers(0, 3, (200, 5)), rng.integers(0, 3, (60, 5))
    surplus = rng.integers(0, 2, 60)
    got = {(int(w), int(s)) for rows, who in spelling.search(own, seekers, surplus, leaf_words=1) for w in rows for s in who}
    # A leaf may hold a single word before all its groups were looked at; what is found must hold all that is near.
    diff = own[:, None] - seekers[None]
    near = ((diff.clip(0).sum(2) <= surplus) & ((-diff).clip(0).sum(2) <= 1))
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)} <= got
    assert len(got) < near.size / 2


# --- all three ------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, [])
    assert quality_rules.judge(none).count() == merkle.manifest(none).count() == spelling.variants(none).count() == 0


def test_rows_without_any_word(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "  ", "en", "s", 2)]
    assert [r.kept for r in quality_rules.judge(frame(spark, rows)).collect()] == [False] * 3
    assert spelling.variants(frame(spark, rows)).count() == 0
    assert all(r.verified for r in merkle.manifest(frame(spark, rows)).collect())
