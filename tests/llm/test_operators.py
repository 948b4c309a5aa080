"""The operators on small tables of difficult rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultlens.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    importance,
    license_scan,
    line_dedup,
    packing,
    simhash,
    token_files,
    tokens,
    toxicity,
)
from faultlens.llm.queries import tokenizer_path
from faultlens.llm.tokens import CachedEncoder, encoder

SPACE = " \t\n\x0b\x0c\r"
LONG = "the long line of an old text\n" * 400 + "tail " * 3000
TEXTS = [
    None, "", " \n\t ", "one", "A b\nc d", "a B \n C D", "ab cd", "A b\nc d", "line that is repeated often\nown line one",
    "  LINE that is repeated often \nown line two", "line that is repeated often\n\nown line three", LONG, LONG + "x",
    "é è  ü x", "Released under the MIT License.\nmore text here", "one  two   three\n four", "日本 語 🙂",
]
ROWS = [(i * 3, t, "en", "src0") for i, t in enumerate(TEXTS)]
ODD = [*ROWS, ROWS[4], ROWS[4], (None, "no id here", None, None), (None, "no id here", None, None), (None, None, None, None)]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "fp name pos h block keys batch k1 score n_lines _row _id digest slot part value n_original n_docs".split()
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in names})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert license_scan.scan(none).count() == 0
    assert line_dedup.deduplicate(none).count() == 0
    assert token_files.read(spark, token_files.write(none, tokenizer_path(), 2)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert toxicity.classify(none, labels).count() == 0
    assert importance.resample(none, labels.select("doc_id")).count() == 0
    assert packing.packed(none, tokenizer_path(), 2048, 0).count() == 0
    assert simhash.near_duplicates(none, width=4, tau=4).count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert exact_dedup.classes(none).count() == 0


# --- licences -------------------------------------------------------------------------------------


def test_license_scan(spark, odd):
    found = license_scan.scan(odd).collect()
    assert len(found) == len(ODD)
    assert [(r.doc_id, r.line, r.score) for r in found if r.license_id] == [(42, 1, 1.0)]
    notice = license_scan.TEMPLATES["GPL-3.0-notice"]
    rows = [(1, notice, "", ""), (2, "\n".join(notice.split(". ")), "", ""), (3, "intro\n" + notice.lower() + "\nend", "", ""),
            (4, notice[:100], "", ""), (5, "This work is licensed under the GNU General Public License, version 2", "", "")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [got[i].license_id for i in range(1, 6)] == ["GPL-3.0-notice"] * 3 + [None, "GPL-2.0-line"]
    assert got[1].line == 0 and got[2].score == 1.0 and got[3].n_matches == 2
    twice = license_scan.scan(frame(spark, [rows[0], rows[0]])).collect()
    assert [r.score for r in twice] == [1.0, 1.0]


def wrapped(text, width=70, mark=" * "):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


CODE = "\n".join(f"int value_{i} = compute_{i}(left_{i}, right_{i});" for i in range(400))


def test_license_in_the_middle_of_a_document(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-notice"]
    line = license_scan.TEMPLATES["MIT-line"]
    rows = [
        (1, f"/*\n{wrapped(mit)}\n */\n{CODE}", "MIT", 2), (2, f"{CODE}\n{wrapped(gpl, 60, '# ')}\n{CODE}", "GPL-3.0-notice", 401),
        (3, f"One thing to know about this work is its terms. {line} Ask the team for anything else you need.", "MIT-line", 1),
        (4, f"{CODE}\nx {line} {wrapped(mit)}\n{wrapped(mit)}\n{CODE}", "MIT", 401), (5, CODE + mit[:300] + CODE, None, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, [(i, t, "", "") for i, t, *_ in rows])).collect()}
    assert [(i, got[i].license_id, got[i].line) for i, *_ in rows] == [(i, name, line) for i, _, name, line in rows]
    assert {got[i].score for i in range(1, 5)} == {1.0}
    assert sorted(m.license_id for m in got[4].matches) == ["MIT", "MIT", "MIT-line"]


def test_full_licences_are_found(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib",
             "CC0-1.0", "GPL-2.0-notice", "LGPL-2.1-notice", "LGPL-3.0-notice"]
    texts = license_scan.all_templates()
    rows = [(i, f"Copyright (c) 2020 Some One\n\n{texts[name]}", "", "") for i, name in enumerate(names)]
    rows += [(100 + i, f"{CODE}\n{wrapped(texts[name])}\n{CODE}", "", "") for i, name in enumerate(names)]
    found = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [found[i].license_id for i in range(len(names))] == names
    assert [(found[100 + i].license_id, found[100 + i].line) for i in range(len(names))] == [(name, 401) for name in names]


def test_best_run_of_words_equals_all_runs(spark):
    rng = random.Random(8)
    template = "a b c a b d e f a b g"
    bag = license_scan.template_bigrams(template)
    rows = []
    for i in range(60):
        words = [w for w in template.split() * rng.choice([1, 1, 2, 3]) if rng.random() > 0.1 or rng.random() > 0.5]
        for _ in range(rng.randint(0, 5)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "a", "b"]))
        words = rng.choices("abxyz", k=rng.randint(20, 40)) + words + rng.choices("abxyz", k=rng.randint(20, 40))
        rows.append((i, " ".join(words), "", ""))
    found = {r.doc_id: r.score for r in license_scan.scan(frame(spark, rows), {"T": template}).collect()}
    for i, text, *_ in rows:
        words = text.split()
        best = max(
            2 * (license_scan.template_bigrams(" ".join(words[a:b])) & bag).total() / (b - a - 1 + bag.total())
            for a in range(len(words)) for b in range(a + 2, len(words) + 1)
        )
        assert found[i] == (pytest.approx(best) if best >= 0.8 else None), text


def test_no_text_can_match_without_an_anchor_word():
    bags = {name: license_scan.template_bigrams(text) for name, text in license_scan.all_templates().items()}
    anchors = set(license_scan.anchor_words(bags, 0.8))
    for bag in bags.values():
        without = sum(n for bigram, n in bag.items() if not anchors & set(bigram.split(" ")))
        assert without < license_scan.bounds(bag.total(), 0.8)[0]
    pattern = re.compile(license_scan._any_word(sorted(anchors)))
    for word in anchors:
        assert pattern.search(f"({word.upper()})") and not pattern.search(f"x{word}") and not pattern.search(f"{word}9")


def test_many_notices_in_one_document(spark):
    """Each is told, in time that grows with their number."""
    line = license_scan.TEMPLATES["MIT-line"]
    text = " ".join(f"{line} word{i} other{i}" for i in range(1500))
    found = license_scan.scan(frame(spark, [(1, text, "", "")])).first()
    assert found.n_matches == 1500 and found.score == 1.0


@pytest.mark.parametrize("n", [1, 4, 9, 40])
def test_license_bounds_are_tight(n):
    low, high = license_scan.bounds(n, 0.8)
    assert {m for m in range(1, 200) if 2 * min(m, n) / (m + n) >= 0.8} == set(range(max(1, low), high + 1))


# --- lines ----------------------------------------------------------------------------------------


def brute_lines(rows, shortest=20, least=3):
    def key(line):
        return line.strip(SPACE).encode().lower().decode()

    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= shortest:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < least or max(holders[key(x)]) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batch_bytes", "fanout"), [(1 << 20, 4), (9000, 2)])
def test_line_dedup(spark, odd, batch_bytes, fanout):
    before = {t.name for t in spark.catalog.listTables()}
    found = line_dedup.deduplicate(odd, batch_bytes=batch_bytes, fanout=fanout)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_lines(ODD)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_the_anti_join_alone_decides_what_is_new(spark, monkeypatch):
    """Every key is in one run, of whatever level; what a run holds is counted beside it."""
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    batches = [[(1, 7, 7), (2, 7, 7), (2, 8, 8)], [(3, 7, 7), (9, 9, 9)], [(4, 8, 8), (5, 10, 10)], [(6, 9, 9)]]
    held = set()
    for rows in batches:
        batch = spark.createDataFrame(rows, "doc_id bigint, k1 bigint, k2 bigint")
        own = {k for _, k, _ in rows}
        counts = batch.groupBy("k1", "k2").count()
        assert {r.k1 for r in runs.known_keys(counts).collect()} == own & held
        runs.add(batch)
        held |= own
        in_runs = [r.k1 for run in runs._tables(0) for r in run.collect()]
        assert sorted(in_runs) == sorted(held)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    # Were nothing known, keys would be in several runs.
    monkeypatch.setattr(line_dedup.LineRuns, "known_keys", lambda self, counts: counts.limit(0))
    wrong = line_dedup.LineRuns(spark, fanout=9, buckets=3)
    for rows in batches:
        wrong.add(spark.createDataFrame(rows, "doc_id bigint, k1 bigint, k2 bigint"))
    assert len([r.k1 for run in wrong._tables(0) for r in run.collect()]) == 7


def test_batches_follow_the_texts(spark):
    rows = frame(spark, [(i, "é" * 10, "", "") for i in range(50)] + [(None, None, "", "")])
    assert line_dedup._batches(rows, 300) == 4 and line_dedup._batches(rows, 10**9) == 1


def test_runs_count_each_batch_once(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    seen = defaultdict(set)
    for batch in range(5):
        rows = [(batch * 100 + d, k, k * 7) for d in range(6) for k in range(d, d + 4)]
        for doc_id, k, _ in rows:
            seen[k].add(doc_id)
        runs.add(spark.createDataFrame(rows, "doc_id bigint, k1 bigint, k2 bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {r.k1: (r.n_docs, r.last_id) for r in runs.counts().collect()}
    assert got == {k: (len(d), max(d)) for k, d in seen.items()}


# --- tokens ---------------------------------------------------------------------------------------


def test_cached_encoder_equals_the_library():
    encode, plain = CachedEncoder(tokenizer_path()).encode, tokenizer()
    texts = [*filter(None, TEXTS), "<|endoftext|> a.b c, d! don't '' x' 1a ªb ² ǅ. ʰ", "\n lead", "end ", "a b c"]
    for text in texts:
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", " lead  <|endoftext|>end \n", "<|endoftext| >", LONG + "<|endoftext|> z"]


def test_added_tokens_have_their_own_ids(spark):
    plain = Tokenizer.from_file(tokenizer_path())
    ids = [plain.encode(text, add_special_tokens=False).ids for text in ADDED]
    assert ids[0] == [64, 220, 50256, 275]
    assert [encoder(tokenizer_path()).encode(text) for text in ADDED] == [np.array(i, "<u4").tobytes() for i in ids]
    rows = frame(spark, [(i, text, "", "") for i, text in enumerate(ADDED)])
    found = token_files.read(spark, token_files.write(rows, tokenizer_path(), 2), with_ids=True).orderBy("start").collect()
    assert [r.ids for r in found] == [[*i, 2] for i in ids]
    packed = packing.packed(rows, tokenizer_path(), 10**6, 0, with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in packed] == [[*i, 0] for i in ids]


def test_token_files_round_trip(spark, odd):
    written = token_files.write(odd, tokenizer_path(), 2)
    found = token_files.read(spark, written, with_ids=True).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for doc_id, text, *_ in order:
        ids = [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert written.width == 2 and written.n_tokens == start


def naive_packing(lengths, capacity):
    """The rule word by word: of all gaps a piece fits into, the one after which the squared counts are smallest."""
    bins = []
    for length in sorted(lengths, reverse=True):
        best = None
        for gap in sorted({capacity - sum(b) for b in bins}):
            if gap >= length:
                left = Counter(g for b in bins if (g := capacity - sum(b)))
                left[gap] -= 1
                left[gap - length] += gap > length
                cost = sum(n * n for n in left.values())
                best = min(best or (cost, gap), (cost, gap))
        if best is None:
            bins.append([length])
        else:
            # Of sequences with equal gaps the one that came to it last.
            next(b for b in reversed(bins) if capacity - sum(b) == best[1]).append(length)
            at = next(i for i in reversed(range(len(bins))) if bins[i][-1] == length and capacity - sum(bins[i]) == best[1] - length)
            bins.append(bins.pop(at))
    return sorted(tuple(b) for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_sum_of_squares_follows_its_rule(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 12, 30])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 4)]) for _ in range(rng.randint(1, 70))]
    bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
    got = defaultdict(list)
    for sequence, offset, length in sorted(zip(bins.tolist(), offsets.tolist(), lengths, strict=True)):
        assert offset == sum(got[sequence])
        got[sequence].append(length)
    assert sorted(map(tuple, got.values())) == naive_packing(lengths, capacity)


def test_packing(odd):
    capacity = 64
    found = packing.packed(odd, tokenizer_path(), capacity, 0, with_ids=True)
    rows = found.collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
        assert sum(n for _, n in parts) <= capacity
    lower = math.ceil(sum(r.length for r in rows) / capacity)
    assert lower <= len(by_sequence) <= lower + 2
    for doc_id, text, *_ in ROWS[11:13]:
        ids = [*tokenizer().encode(text, add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids and all(r.length == capacity for r in own[1:])
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    assert packing.sequences(found).count() == len(by_sequence)


def test_sum_of_squares_prefers_fewer_equal_gaps():
    bins, offsets = packing.sum_of_squares([6, 6, 4, 3, 1, 10, 2], 10)
    assert len(set(bins.tolist())) == 4 and offsets[5] == 0
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 512)
    bins, _ = packing.sum_of_squares(lengths, 512)
    assert len(set(bins.tolist())) <= math.ceil(lengths.sum() / 512) + 1


# --- pages ----------------------------------------------------------------------------------------

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph of\n the   article, with <a href=x>a link</a> in it.<p>Second one<br>here"
PAGES = [
    (f"<html><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>(c)</footer></body></html>", 3),
    (f"<body><div class='cookie-notice'>We use cookies</div><main><header>{ARTICLE}</header><form>Name <input></form></main>", 3),
    (f"<body><div id=sidebar><p>Side text of some length here</div><div class=post>{ARTICLE}<ul><li>x<li>y</ul></div>"
     "<section id=comments><p>Great read, thanks a lot for it!</section></body>", 5),
    (f"<article>{ARTICLE}<aside>See also</aside><script>if (a<b) '</p>'</script><!-- gone --></article><p hidden>no</p>", 3),
]


@pytest.mark.parametrize(("page", "blocks"), PAGES)
def test_main_text(page, blocks):
    text = html_text.main_text(page).split("\n")
    assert text[:3] == ["Title & more", "First paragraph of the article, with a link in it.", "Second one here"]
    assert len(text) == blocks


WRAPPED = [
    "<body><div class='layout with-sidebar'><nav><a href=/>Home</a></nav><article>{}</article></div></body>",
    "<body class=x><div class='has-cookie-banner nav-open'><div id=top><main>{}</main></div><div class=sidebar>Side</div></div>",
    "<body><form id='aspnetForm'><div class=post>{}</div><div class=footer>Imprint</div></form></body>",
    "<body><div class='layout with-sidebar'><div class=post>{}</div></div></body>",
    "<body><article><div class='elementor-widget'>{}</div><div class=share-buttons>Share</div></article></body>",
    "<body><article>{}</article><div class=related><article><h3>Other</h3>A teaser</article></div></body>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_keep_their_article(page):
    expected = ["Title & more", "First paragraph of the article, with a link in it.", "Second one here"]
    assert html_text.main_text(page.format(ARTICLE)).split("\n") == expected


def test_headings_with_ids_of_their_words():
    parts = [("related-work", "Related work"), ("social-impact", "Social impact"), ("cookies", "Cookies")]
    page = ARTICLE + "".join(f"<h2 id='{i}'>{t}</h2><p>Text about {t}.</p>" for i, t in parts)
    page += "<section id='sharing-data'><h2>Sharing data</h2><p>Text on that.</p></section>"
    page += "<div class='related'><h3>See also</h3><a href=a>Another article</a> <a href=b>One more of them</a></div>"
    text = [x for _, t in parts for x in (t, f"Text about {t}.")] + ["Sharing data", "Text on that."]
    for whole in (f"<body><article>{page}</article>", f"<body><div class=post>{page}</div>"):
        assert html_text.main_text(whole).split("\n")[3:] == text


def test_main_text_of_odd_pages(spark):
    odd = {None: "", "": "", "plain & simple": "plain & simple", "<p>cut of<b": "cut of", "<style>p{}": "", "a<!-- b": "a",
           "<p>1 < 2 &amp": "1 < 2 &", "</div></p>x": "x"}
    rows = [(i, "u", page) for i, page in enumerate(odd)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = html_text.extract(table).orderBy("page_id").collect()
    assert [r.text for r in found] == list(odd.values())
    assert html_text.extract(table).columns == ["page_id", "url", "text"]


def test_pages_of_the_test_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plain = {r.page_id: r.html for r in table.collect()}
    for row in html_text.extract(table).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", plain[row.page_id], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", article))
        import html

        texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert row.text == "\n".join(t for t in texts if t)


# --- classifiers ----------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hits = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if r.toxic == 0) / sum(1 - r.toxic for r in rows)
    assert hits > 0.4 and false < 0.02


def test_toxicity_without_use_of_held_out_labels(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=60)) + (" vilest" * 3 if i % 5 == 0 else ""), "", "")
            for i in range(600)]
    labels = [(i, 1, int(i % 5 == 0)) for i, *_ in rows]
    changed = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    kinds = "doc_id bigint, quality int, toxic int"
    first, second = (
        {r.doc_id: r.score for r in toxicity.classify(frame(spark, rows), spark.createDataFrame(x, kinds)).collect()}
        for x in (labels, changed)
    )
    assert first == second


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.0}


def test_importance_draws_the_largest_keys(spark, odd):
    target = spark.createDataFrame([(9,), (12,), (12,), (None,)], "doc_id bigint")
    rows = importance.resample(odd, target, keep_share=0.5).collect()
    assert len(rows) == len(ODD)
    distinct = {(r.doc_id, r.gumbel_key): r for r in rows}
    assert sum(r.selected for r in distinct.values()) == math.ceil(len(set(ODD)) / 2)
    kept = [r.gumbel_key for r in distinct.values() if r.selected]
    assert min(kept) > max(r.gumbel_key for r in distinct.values() if not r.selected)
    assert {r.log_weight for r in rows if r.doc_id in (0, 3, 6)} == {0.0}
    again = importance.resample(odd.repartition(5), target, keep_share=0.5).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def plain_features(text, buckets):
    """Bucket counts of words and neighbouring pairs, with whole numbers of Python."""
    from xxhash import xxh3_64_intdigest

    words = [xxh3_64_intdigest(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    counts = Counter(h % buckets for h in words)
    for a, b in zip(words, words[1:], strict=False):
        h = ((a * 0x9E3779B97F4A7C15) ^ b) * 0xC2B2AE3D27D4EB4F % 2**64
        counts[(h ^ h >> 29) % buckets] += 1
    # The product of the first factor wraps as well, but only its low bits reach the result.
    return counts


def test_importance_equals_plain_python(spark):
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    rows = [*ROWS, (None, "no id here", None, None), (100, TEXTS[4], None, None)]
    good, buckets, seed = {12, 21, 33}, 50, 5
    target, raw = Counter(), Counter()
    for doc_id, text, *_ in rows:
        raw += plain_features(text, buckets)
        if doc_id in good:
            target += plain_features(text, buckets)
    n_target, n_raw = sum(target.values()) + buckets, sum(raw.values()) + buckets
    ratio = [math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(buckets)]
    expected = {}
    for doc_id, text, *_ in rows:
        weight = sum(n * ratio[b] for b, n in plain_features(text, buckets).items())
        digest = xxh3_128_digest((text or "").encode())
        u = (xxh3_64_intdigest(digest + str(doc_id).encode(), seed) + 0.5) / 2**64
        expected[doc_id, text] = (weight, weight - math.log(-math.log(u)))
    ids = spark.createDataFrame([(i,) for i in good], "doc_id bigint")
    found = importance.resample(frame(spark, rows), ids, keep_share=0.3, buckets=buckets, seed=seed).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.log_weight, r.gumbel_key) for r in found)
    want = sorted(((i is None, i or 0), *v) for (i, _), v in expected.items())
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)
    top = sorted(expected.values(), key=lambda v: -v[1])[: math.ceil(len(rows) * 0.3)]
    assert sorted(r.gumbel_key for r in found if r.selected) == pytest.approx(sorted(v[1] for v in top))


def test_importance_weights_by_hand(spark):
    rows = [(1, "good good words", "", ""), (2, "bad words", "", ""), (3, "good words", "", "")]
    found = {r.doc_id: r.log_weight for r in importance.resample(frame(spark, rows), spark.createDataFrame([(1,)], "doc_id bigint"), buckets=64).collect()}
    good = importance.features(rows[0][1], 64) + 1.0
    every = sum(importance.features(t, 64) for _, t, *_ in rows) + 1.0
    ratio = np.log(good / good.sum()) - np.log(every / every.sum())
    assert found == pytest.approx({i: float(importance.features(t, 64) @ ratio) for i, t, *_ in rows})
    assert found[3] > found[2]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_kth_largest(spark, k):
    keys = [5, 2**62, 2**62, 2**63 - 1, 0]
    value, room = importance.kth_largest(spark.createDataFrame([(x,) for x in keys], "rank_key bigint"), k)
    top = sorted(keys, reverse=True)
    assert value == top[k - 1] and room == top[:k].count(value)


# --- near copies ----------------------------------------------------------------------------------


def brute_components(fps, tau):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted_fingerprints(n=300):
    rng = random.Random(5)
    out = [0, 2**64 - 1, 15, 31]
    while len(out) < n:
        base = rng.choice(out) if rng.random() < 0.6 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            base ^= 1 << bit
        out.append(base)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("tau", [0, 2, 4])
def test_links_connect_what_all_pairs_connect(spark, block, tau):
    fps = planted_fingerprints()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = simhash.links(table, tau, block=block)
    pairs = links.collect()
    assert all(((p.a ^ p.b) & (2**64 - 1)).bit_count() <= tau for p in pairs)
    parts = {r.node: r.root for r in simhash.components(links).collect()}
    expected = brute_components(fps, tau)
    got = [parts.get(f, f) for f in signed]
    assert len({*zip(expected, got, strict=True)}) == len(set(expected)) == len(set(got))


def test_every_allocation_sums_to_the_general_pigeonhole():
    fps = np.array(planted_fingerprints(), np.uint64)
    for groups in range(1, 6):
        bits = simhash.group_bits(fps, groups)
        assert sorted(b for own in bits for b in own) == list(range(64))
        costs = [simhash.candidate_costs(fps, own, 10**6, 4) for own in bits]
        _, chosen = simhash.allocate(costs, 4 - groups + 1)
        assert sum(chosen) == 4 - groups + 1 and min(chosen) >= -1


def brute_fingerprint(text, width=4):
    from xxhash import xxh64_intdigest

    words = re.findall(rf"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_duplicates(spark, odd):
    found = simhash.near_duplicates(odd, width=4, tau=4).collect()
    assert len(found) == len(ODD)
    fps = [brute_fingerprint(t) for _, t, *_ in ODD]
    parts = brute_components(fps, 4)
    ids = defaultdict(list)
    for part, (doc_id, *_) in zip(parts, ODD, strict=True):
        ids[part].append(doc_id)
    expected = [(d, f"{f:016x}", min((x for x in ids[p] if x is not None), default=None)) for (d, *_), f, p in zip(ODD, fps, parts, strict=True)]
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=repr) == sorted(expected, key=repr)


def test_a_large_group_of_near_copies_stays_together(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(400)]
    rows = []
    for i in range(250):
        words = list(base)
        words[rng.randrange(400)] = f"edit{i % 40}"
        rows.append((i, " ".join(words), "", ""))
    found = simhash.near_duplicates(frame(spark, rows), width=4, tau=4).collect()
    parts = brute_components([brute_fingerprint(t) for _, t, *_ in rows], 4)
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(parts))


# --- benchmark and exact copies -------------------------------------------------------------------


@pytest.mark.parametrize("shard", [30, 2_000_000])
def test_contamination(spark, odd, shard):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ab1", "çé", "x", "long", "line", "old", "text", "an"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 15])))) for i in range(12)]
    items += [(12, None), (13, "!!"), (None, "the of"), (3, items[3][1]), (20, "the long line of an old text the long line of an")]
    rows = [*ODD, *[(1000 + i, "pre, " + " ".join(rng.choices(vocabulary, k=40)).upper() + "-" + (items[i % 12][1]), "", "") for i in range(20)]]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(frame(spark, rows), table, shard_characters=shard)
    named = [(str(i), t) for i, t in items if i is not None]
    expected = [(d, *decontaminate.brute_force(t, named)) for d, t, *_ in rows]
    got = [
        (r.doc_id, r.n_words, r.n_hit, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()) for r in found.collect()
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(f"[{SPACE}]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        taken = False
        for m in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            out.append((m[2], best[2], len(members), not taken, hashlib.sha256(norm.encode()).hexdigest()))
            taken = True
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "shared"), [(512, False), (3, False), (7, True)])
def test_exact_classes(odd, size, shared):
    from pyspark.sql import functions as F

    digest = (lambda block: F.length(block).cast("bigint") % 3) if shared else F.xxhash64
    found = exact_dedup.classes(odd, size=size, digest=digest).drop("n_original").collect()
    assert sorted(map(tuple, found), key=repr) == brute_exact(ODD)


def test_exact_dedup_keeps_columns(odd):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    expected = [r[0] for r in brute_exact(ODD) if r[3]]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(expected, key=repr)


def test_exact_dedup_plan_is_native(odd):
    plan = exact_dedup.classes(odd)._jdf.queryExecution().executedPlan().toString()
    scan = license_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan and unwanted not in scan


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.classify(table, labels).where("predicted = 1").collect()}
    left = [tuple(r) for r in table.collect() if r.doc_id not in toxic]
    kept = {r[0] for r in brute_exact(left) if r[3]}
    left = sorted(r for r in left if r[0] in kept)
    parts = brute_components([brute_fingerprint(r[1]) for r in left], 4)
    left = [r for i, r in enumerate(left) if parts[i] == i]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tables = decontaminate.matchers(items, 10)
    left = [r for r in left if not decontaminate.search(decontaminate.words_of(r[1]), tables)[1]]
    rows = corpus_pipeline.run(spark, folder).collect()
    expected = {r[0]: len(tokenizer().encode(r[1], add_special_tokens=False).ids) + 1 for r in left}
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == expected
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(expected.values()) / 2048) + 2


@pytest.mark.parametrize("position", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, none, position):
    name, stage = corpus_pipeline.STAGES[position]
    folder = "/root/testdata/sf0.001"
    some, nothing = stage(spark, odd, folder), stage(spark, none, folder)
    assert nothing.count() == 0 and some.count() > 0, name
    if position < 4:
        assert some.columns == odd.columns


def test_each_row_has_its_own_decision(spark, monkeypatch):
    """Rows with null or shared ids are judged one by one: one that goes takes no other with it, none stays unjudged."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: None)
    by_word = F.when(F.col("text").startswith("bad"), 1.0).otherwise(0.0).alias("score")
    monkeypatch.setattr(toxicity, "score", lambda docs, model: docs.select("doc_id", by_word))
    some = [(None, "bad 1"), (None, "good 1"), (3, "bad 2"), (3, "good 2"), (4, "bad 3"), (5, "good 3"), (5, "good 3"), (-2, "bad 4")]
    left = corpus_pipeline.drop_toxic(spark, frame(spark, [(i, t, "en", "s") for i, t in some]), folder).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in left) == [(0, "good 1"), (3, "good 2"), (5, "good 3"), (5, "good 3")]
    few = [(None, f"{item} tail"), (None, "quite another text"), (5, f"{item} tail"), (5, "a third text"), (6, "a fourth text")]
    small = frame(spark, [(i, t, "en", "s") for i, t in few])
    kept = corpus_pipeline.drop_contaminated(spark, small, folder).collect()
    assert sorted(r.text for r in kept) == ["a fourth text", "a third text", "quite another text"]
    long = " ".join(f"word{i}" for i in range(300))
    copies = [(None, long), (9, long + " end"), (9, "something else"), (None, "something else"), (8, "unlike all")]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, [(i, t, "en", "s") for i, t in copies]), folder).collect()
    assert len(kept) == 3 and {r.text.startswith("word0") for r in kept} == {True, False}
