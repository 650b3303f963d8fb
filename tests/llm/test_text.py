import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest

from lodestone.llm import html_extract, quality_rules, toxicity
from tests.llm.cases import documents, edge_texts, words


def brute_measure(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines))


def test_measure():
    rng = random.Random(1)
    texts = [t or "" for _, t in edge_texts()] + ["a b c d e f g h " * 2, "#* é|\n\n \nx\nx\n x\nx", "\x1c\x85\xa0 a\x0bb\x0cc"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(("", "\n")) * 3 for _ in range(200)]
    for t in texts:
        assert quality_rules.measure(t) == brute_measure(t)


def test_windows_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(quality_rules, "window_hashes", lambda h, n: h[: len(h) - n + 1] * 0)
    for t in ("a b c d e f g h i " * 3, words(random.Random(2), 60), "a " * 30):
        assert quality_rules.measure(t) == brute_measure(t)


def test_ledger_and_policies(spark):
    rows = edge_texts() + [(20, "## $$ " * 40), (21, ("one line of words here\n" * 9) + words(random.Random(3), 60)), (22, words(random.Random(4), 50))]
    entries = quality_rules.ledger(documents(spark, rows, True)).cache()
    got = quality_rules.apply_policy(entries).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[22].kept and by[4].kept and by[9].kept and not by[22].base_failed
    assert by[1].base_failed and by[2].base_failed and by[11].base_failed and not by[20].kept and not by[21].kept
    for r in got:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines)
        names = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), m))
        assert r.fail_bits == sum(1 << i for i, rule in enumerate(quality_rules.RULES.values()) if eval(rule, {}, names))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    ablated = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    mask = quality_rules.DEFAULT.mask
    for i, rule in enumerate(quality_rules.RULES):
        assert ablated[rule].n_failed == sum(r.fail_bits >> i & 1 for r in got)
        assert ablated[rule].n_failed_alone == sum(r.fail_bits & mask == 1 << i for r in got)
        assert ablated[rule].n_kept == sum(r.fail_bits & mask == 0 for r in got)
    only_base = quality_rules.apply_policy(entries, quality_rules.BASE).filter("kept").count()
    assert only_base >= sum(r.kept for r in got)
    assert quality_rules.ledger(documents(spark, [], True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>no";</script></head><body>
<nav><ul><li><a href="/x">No</a></li></ul></nav><header>no</header><div class="ad">no</div><!-- no -->
<article><h1>Head &amp; line</h1><p><b>First <i>bold</i>&nbsp;words<br>next<p>Second   one
two</p><div class="share-links">no</div><form><p>no</p></form>
<p>{0}</p><section class="comments"><article><p>no</p></article></section></article><aside><p>no</p></aside><footer>no</footer></body>"""


def test_main_text(spark):
    plain = "<body><div>Site name</div><p>{0}</p><p>Same &copy; 2020</p></body>"
    rows = [(1, "http://a.org/x/1", PAGE.format("own")), (2, "http://a.org/x/2", PAGE.format("own")), (3, "https://B.org:80/p/1?q=1", plain.format("alpha beta")), (4, "http://b.org/p/2#f", plain.format("gamma")), (5, "http://b.org/p/2", plain.format("gamma")),
            (6, None, None), (7, "", ""), (None, "http://c.org/", "<p>only</p>"), (8, "nonsense", "a < b &lt; c <b"), (9, "http://d.org/1", "<p>" + "word " * 50_000 + "</p>"), (9, "http://d.org/1", "<p>" + "word " * 50_000 + "</p>")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit("y"), "text": F.lit("z")})
    got = html_extract.extract(pages).collect()
    assert html_extract.extract(pages).count() == len(rows)
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == "Head & line\n\nFirst bold words next\n\nSecond one two\n\nown"
    assert texts[3] == "alpha beta" and texts[4] == "gamma"
    assert texts[6] == texts[7] == "" and texts[None] == "only" and texts[8].startswith("a < b < c")
    assert texts[9] == ("word " * 50_000).strip()
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_copies_keep_their_text():
    assert html_extract.main_text(["a", "b"], [1, 2], [1, 2]) == "a\n\nb"


def test_articles_are_differenced(spark):
    """pages with an article's element never met their nearest page."""
    rows = [
        (1, "http://a.org/1", "<article><p>One</p><p>Shared</p></article><p>More stories</p>"),
        (2, "http://a.org/2", "<article><p>Two</p><p>Shared</p><p>More stories</p></article>"),
        (3, "http://b.org/2", "<article><p>Three</p><p>More stories</p></article>"),
        (4, "http://c.org/1", "<p>All</p><article><p>Four</p></article>"),
        (5, "http://c.org/2", "<article><p>All</p></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    expected = {1: "One\n\nShared", 2: "Two\n\nShared", 3: "Three\n\nMore stories", 4: "Four", 5: "All"}
    assert got == {k: (v, len(v)) for k, v in expected.items()}


def brute_extract(rows):
    """The page before on the host by path and id, or else the one after; lines that stand in both, in the order of both."""
    pages = sorted((urlsplit(u).hostname, urlsplit(u).path, i, html) for i, u, html in rows)
    out = {}
    for k, (host, _, i, html) in enumerate(pages):
        lines = re.findall(r"<p>(.*?)</p>", html)
        if "<article>" in html:
            out[i] = "\n\n".join(re.findall(r"<p>(.*?)</p>", html.split("<article>")[1]))
            continue
        near = pages[k - 1] if k and pages[k - 1][0] == host else pages[k + 1] if k + 1 < len(pages) and pages[k + 1][0] == host else None
        other = set(re.findall(r"<p>(.*?)</p>", near[3])) if near else set()
        out[i] = "\n\n".join([x for x in lines if x not in other] or lines)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_extract_matches_brute_force(spark, partitions):
    """Lines of a page are distinct and shared ones in one order, so that their longest common subsequence is all of them."""
    rng, rows = random.Random(8), []
    for i in range(120):
        lines = [f"menu {k}" for k in range(6) if rng.random() < 0.8] + [f"own {i} {k}" for k in range(rng.randint(0, 3))] + [f"foot {k}" for k in range(3) if rng.random() < 0.8]
        html = "".join(f"<p>{x}</p>" for x in lines)
        rows.append((i, f"http://h{rng.choice((0, 0, 0, 1, 2, i))}.org/p{rng.randint(0, 60):02}", html if rng.random() < 0.6 else html + f"<article><p>text {i}</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == brute_extract(rows)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_extract.shared(a, b)
        kept = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in kept for i in sorted(found))


def labelled(spark, n: int):
    rng = random.Random(6)
    bad = ("grubby", "scoundrel", "nitwit", "vileness")
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(rng, rng.randint(15, 120)).split(), rng.random() < 0.3
        for _ in range(max(1, len(w) // 15) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(("", "s", "ly")))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark, 700)
    docs = documents(spark, rows, True)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_documents(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_learned(spark):
    from pyspark.sql import functions as F

    rows, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = documents(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark):
    rows, labels = labelled(spark, 200)
    model = toxicity.train(documents(spark, rows), labels)
    got = toxicity.score(documents(spark, edge_texts(), True), model).collect()
    assert len(got) == len(edge_texts()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.score(documents(spark, [], True), model).count() == 0
    none = spark.createDataFrame([(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(documents(spark, rows[:5], True), none).count() == 5
    assert toxicity.score_documents(documents(spark, [], True), labels.limit(0)).count() == 0


def test_probabilities_add_up():
    grams, counts = toxicity.count_grams(["aa ab abc ba", "ab abd"], [0, 1], 3)
    model = toxicity.kneser_ney(grams, np.column_stack([counts, counts.sum(axis=1)]), 3)
    assert (model.grams[1:] > model.grams[:-1]).all() and len(model.ratio) == len(model.grams)
    assert model.of_words([b"abd"])[0] > model.of_words([b"abc"])[0]


def brute_kneser_ney(texts, order):
    """Plain dictionaries: the logarithm of toxic over ordinary probability of each gram, with a shared model below both."""
    raw = [Counter(), Counter(), Counter()]
    for label, text in texts:
        for w in text.encode().split():
            w = b" " + w + b" "
            for i in range(1, len(w)):
                for c in {label, 2} if label is not None else {2}:
                    raw[c][w[max(0, i - order + 1) : i + 1]] += 1
    raw[2] = Counter({g: n for g, n in raw[2].items() if g in raw[0] or g in raw[1]})
    levels = {}
    for n in range(order, 0, -1):
        levels[n] = [Counter({g: k for g, k in raw[c].items() if len(g) == n}) for c in range(3)]
        for c in range(3):
            for g, k in levels.get(n + 1, [{}] * 3)[c].items():
                levels[n][c][g[1:]] += k > 0

    def p(c, g):
        if not g:
            return 1 / 257
        own = {x: k for x, k in levels[len(g)][c].items() if x[:-1] == g[:-1] and k > 0}
        total = sum(own.values())
        if not total:  # a context that the class doesn't know
            return p(c, g[1:])
        return max(own.get(g, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(own) / total * p(2, g[1:])

    return {g: math.log(p(1, g) / p(0, g)) for n in levels for g in set(levels[n][0]) | set(levels[n][1])}


def test_kneser_ney_matches_plain_counts(spark):
    rng = random.Random(9)
    texts = [(rng.choice((0, 0, 1)), " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8)))) for _ in range(30)]
    more = [(None, "abc cab abc"), (None, "zz ab"), (None, "")]
    keys, own = toxicity.count_grams([t for _, t in texts], [label for label, _ in texts], 4)
    everywhere = toxicity.corpus_counts(documents(spark, [(i, t) for i, (_, t) in enumerate(texts + more)]), keys, 4)
    model = toxicity.kneser_ney(keys, np.column_stack([own, everywhere]), 4)
    name = lambda key: (int(key) & (1 << 40) - 1).to_bytes(8, "big")[-(int(key) >> 40) :]
    got = dict(zip(map(name, model.grams), model.ratio))
    want = brute_kneser_ney(texts + more, 4)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_without_usable_labels_nothing_is_rejected(spark):
    rows, labels = labelled(spark, 40)
    docs = documents(spark, rows + edge_texts(), True)
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.score_documents(docs, few).collect()} == {(0.0, 0)}
        assert toxicity.reject_toxic(docs, few).count() == len(rows) + len(edge_texts())
