"""Main text, language, tokens and quality on small fixtures."""

import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from relscope.llm import html_extract as H
from relscope.llm import language_id as L
from relscope.llm import quality as Q
from relscope.llm import token_count as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string, text string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("<p>", ""),
    (f"<body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>Short.<p><b>{LONG}\n  <i>tail</i></b><br></article><footer>&copy; x</footer>", f"Title & more\nShort.\n{LONG} tail"),
    ("<article><p>Text<script>var a='</p>';</script> goes on</p><!-- <p>no</p> --><div class='comments'><p>Great!</p></div><form><label>Name</label></form></article>", "Text goes on"),
    ("<main><p>a&nbsp;b &#x41; &lt;c&gt; &unknown; &am</p></main>", "a b A <c> &unknown; &am"),
    ("<article><p>Kept<div hidden>hid</div><div style='display: none'>hid</div><aside>side</aside></article><p>Outside of it</p>", "Kept"),
    (f"<div id=top-nav>Menu</div><div class=content><h2>Head</h2><p>{LONG}</p><p>{LONG} <a href=x>link</a></p></div><div id=sidebar><p>{LONG}</p></div>", f"Head\n{LONG}\n{LONG} link"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article>a < b and c > d</article>", "a < b and c > d"), ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
])
def test_main_text(page, want):
    assert H.main_text(page) == want


def test_tree_learns_its_table():
    rows, labels = H.labelled()
    assert np.mean([H.says(H.tree(), tuple(r)) == y for r, y in zip(rows, labels, strict=True)]) >= 0.95
    assert {"words", "links", "next_words", "hint"} <= H.used(H.tree()) and H.used(H.tree()) & {"prev_words", "prev_links"}


@pytest.mark.parametrize("wrapper", [
    '<div class="has-sidebar"><article>{}</article></div>', '<div class="layout no-sidebar"><article>{}</article></div>', '<div class="page-header-share"><article>{}</article></div>',
    '<article><div class="social-science">{}</div></article>', '<form id="aspnetForm"><article>{}</article></form>', '<form id="aspnetForm"><div>{}</div></form>',
    '<div class="sidebar"><nav><a href=/>Home</a></nav><main>{}</main></div>', '<body class="menu-open"><div id="content">{}</div></body>',
])
def test_wrappers_keep_their_article(wrapper):
    article = f"<h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG} <a href=x>link</a></p>"
    assert H.main_text(wrapper.format(article)) == f"Title here\n{LONG}\nShort.\n{LONG} link"


def test_links_stay_in_the_article_and_asides_go():
    page = (
        f"<article><p>{LONG}</p><p><a href=x>Read the long report on it</a></p><ul><li><a href=1>First linked source text</a><li><a href=2>Second linked source text</a></ul><p>{LONG}</p>"
        f"<div class=share-buttons><a href=f>Facebook</a></div><section class=comments><article class=comment><p>Great read {LONG}</p></article></section></article><aside class=related><article><p>Teaser {LONG}</p></article></aside>"
    )
    assert H.main_text(page) == f"{LONG}\nRead the long report on it\nFirst linked source text\nSecond linked source text\n{LONG}"


class SlowReader(HTMLParser):
    """Blocks of the article of a page as the parser of the standard library sees it."""

    def __init__(self):
        super().__init__()
        self.inside = self.silent = 0
        self.parts, self.out = [], []

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text and self.inside else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article", "div", "li", "ul", "nav", "footer"):
            self.end_block()
        self.inside += tag == "article"
        self.silent += tag in ("script", "style", "title")
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "div", "li", "ul", "nav", "footer"):
            self.end_block()
        self.inside -= tag == "article"
        self.silent -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def test_pages_match_a_slow_reader(spark):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.op1_main_text(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        reader = SlowReader()
        reader.feed(r["html"] or "")
        text = "\n".join(reader.out)
        assert got[r["page_id"]] == (text, len(text))


def test_long_and_broken_pages():
    assert H.main_text("<article>" + "<b><p>w " * 5000).count("w") == 5000
    assert H.main_text("<article><p>" + "long " * 200_000).startswith("long long")
    assert H.main_text("</p>" * 10_000 + "<article>x</article>") == "x"


def test_extracted(spark):
    df = spark.createDataFrame([(1, "u", "<article>a  b</article>", "clash"), (1, "u", "<article>a  b</article>", "clash"), (2, None, None, None), (None, "v", "", "")], PAGES)
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in H.extracted(df).collect())
    assert got == [("1", "a b", 3), ("1", "a b", 3), ("2", "", 0), ("None", "", 0)]
    assert H.extracted(spark.createDataFrame([], PAGES)).count() == 0


def speech(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    parts = {"aa": ["the", "ing", "tion", "of", "er"], "bb": ["sch", "ung", "über", "der", "ein"], "cc": ["eau", "é", "que", "les", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_windows_cover_the_text():
    for n in (1, 255, 256, 257, 508, 509, 510, 5000):
        data = bytes(1 + i % 250 for i in range(n))
        rows = L.windows_of(data)
        seen = np.zeros(n + L.WINDOW, bool)
        for i, row in enumerate(rows):
            part = data[i * L.STRIDE : i * L.STRIDE + L.WINDOW]
            assert bytes(row[: len(part)]) == part
            seen[i * L.STRIDE : i * L.STRIDE + L.WINDOW] = True
        assert seen[:n].all() and len(rows) == max(1, -(-(n - L.WINDOW + L.STRIDE) // L.STRIDE))


def test_tables_equal_the_convolution():
    model = L.train([speech(x, 0, 60) for x in ("aa", "bb")], ["aa", "bb"], epochs=1)
    x = L.windows_of(speech("bb", 1, 200).encode())
    want = []
    for w, f, b in zip(L.WIDTHS, model.filters, model.bias, strict=True):
        z = sum(model.embed[x][:, k : k + L.WINDOW - w + 1] @ f[k] for k in range(w)) + b
        want.append(np.maximum(z.max(axis=1), 0))
    assert np.allclose(L.pooled(x, model.tables()), np.concatenate(want, axis=1), atol=1e-4)


def test_languages(spark):
    rows = [(i, speech(lang, i, 5 + i % 90), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    odd = [(1000, None, "aa", "s", 1), (1001, "", "aa", None, 1), (1002, "123 !? 4", "bb", "s", 1), (1003, speech("cc", 5, 60), None, "s", 1), (None, speech("bb", 7, 60), "aa", "s", 1), (3, speech("aa", 3, 8), "aa", "s", 1), (1004, speech("bb", 9, 60_000), None, "s", 1)]
    got = L.languages(spark.createDataFrame(rows + odd, DOCS)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003]["lang_pred"] == "cc" and by_id[None]["lang_pred"] == "bb" and not by_id[None]["held_out"] and by_id[1004]["lang_pred"] == "bb"
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert len(held) > 20 and np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.95


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 1), (2, None, None, None, None)], DOCS)
    assert {r["lang_pred"] for r in L.languages(df).collect()} == {"und"}
    assert [r["doc_id"] for r in L.known_language(df).collect()] == [1] and L.known_language(df).columns == df.columns
    assert L.languages(spark.createDataFrame([], DOCS)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.quality(df, labels).collect()} == {0.5}


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(speech("aa", rng.random(), 9).capitalize() + "." for _ in range(rng.randrange(2, 30)))
    bad = lambda: rng.choice([" | ".join(speech("aa", rng.random(), 60).split()), speech("aa", rng.random(), 40).upper().replace(" ", "!! "), "word " * 200])
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1) for i in range(400)]
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(400)] + [(9999, 1, 0), (5, None, 0), (7, 3, 0), (None, 1, 0)]
    odd = [(500, None, None, None, None), (501, "", "en", "s", 0), (None, good(), "en", "s", 1), (502, " ".join(good() for _ in range(3000)), "en", "s", 1)]
    got = Q.quality(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(got) == 404 and np.mean([r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_features_cover_the_text():
    text = "Ab c! " * 1000
    f = Q.features(text)
    assert len(f) == 10 and np.allclose(f[:, : Q.N_KINDS].sum(axis=1), 1, atol=1e-5)
    assert Q.features(None).shape == (1, Q.N_FEATURES)
    assert np.allclose((f[:, Q.N_PLAIN :] ** 2).sum(axis=1), 1, atol=1e-5)


def test_features_match_a_slow_version(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["word", "Word", "é", "x" * 90, "a.b", "12"]) for _ in range(900))
    data = text.encode()
    want = []
    for at in range(0, len(data), Q.PASSAGE):
        part = data[at : at + Q.PASSAGE]
        words = [m.group().lower() for m in re.finditer(rb"[^ ]+", data) if at <= m.start() < at + Q.PASSAGE]
        pairs = list(zip(words, words[1:], strict=False))
        want.append((sum(b == 32 for b in part) / len(part), 10 * len(words) / len(part), len(set(words)) / len(words), sum(a == b for a, b in pairs) / len(words), min(60, max(map(len, words))) / 20, len(part) / Q.PASSAGE))
    columns = [3, *range(Q.N_KINDS, Q.N_PLAIN)]
    assert np.allclose(Q.features(text)[:, columns], want, atol=1e-5)
    whole = Q.features(text)
    monkeypatch.setattr(Q, "AT_ONCE", 2)
    assert np.allclose(Q.features(text)[:, : Q.N_KINDS], whole[:, : Q.N_KINDS])


def test_scores_match_a_slow_network():
    """Attention and score of every bag against plain loops."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "bad", "fine", "!!"]) for _ in range(rng.randrange(1, 700))) for _ in range(40)] + [""]
    bags = [Q.features(t) for t in texts]
    model = Q.train(bags, [i % 2 for i in range(41)], epochs=2)
    p = model.p
    for bag, got in zip(bags, model.score(bags), strict=True):
        weights, codes = [], []
        for row in bag:
            h = np.tanh(((row - model.mean) / model.scale).clip(-8, 8) @ p["w"] + p["b"])
            weights.append(np.exp((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]))
            codes.append(h)
        z = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        assert abs(got - 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))) < 1e-5


def test_words_reach_the_quality_encoder(spark):
    """Labels that only the words tell, not the kinds of characters."""
    rng = random.Random(6)
    good, bad = [f"ab{i:03d}" for i in range(0, 400, 2)], [f"ab{i:03d}" for i in range(1, 400, 2)]
    rows = [(i, " ".join(rng.choice((good if i % 2 else bad)[:12]) for _ in range(60)), "en", "s", 1) for i in range(500)]
    got = Q.quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id long, quality int, toxic int")).where("held_out").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.95


def test_texts_without_letters_are_und():
    model = L.train([speech(x, i, 60) for i in range(8) for x in ("aa", "bb")], ["aa", "bb"] * 8, epochs=1)
    assert [x for x, _ in L.predict(model, ["½ ² 3", "Ⅷ", "①②", "_ - 12", "\u0301", None, ""])] == ["und"] * 7
    assert all(x != "und" for x, _ in L.predict(model, ["a", "ª", "ß", "語", "½ x"]))


def test_known_language_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, speech(x, i, 30), x, "s", 1, "c", 2) for i, x in enumerate(["aa", "bb"] * 30)] + [(None, speech("aa", 1, 30), None, None, None, None, None), (1, "123", "aa", "s", 1, "c", 2)], DOCS + ", language string, __0 long")
    kept = L.known_language(df)
    assert kept.columns == df.columns and kept.count() >= 55 and kept.where("text = '123'").count() == 0
    assert L.known_language(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def counter():
    return K.Counter(K.default_path(), chunk=200, overlap=16)


def test_token_counts_equal_the_library(counter):
    rng = random.Random(1)
    bits = ["a", "b ", " ", "\n", "  ", "the", " the", "é", "<|endoftext|>", "!", "\t", "日本", "don't ", "12", "　", "\x1c", " x", "\r\n", "word ", "naïve ", " "]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 400)))
        want = len(counter.tok.encode(t, add_special_tokens=False).ids)
        assert counter.short(t) == want and (not t or counter.huge(t) == want)
    assert counter.splices > 100 and counter.widened > 10


def test_texts_without_a_boundary(counter):
    for t in ("x" * 3000, "日" * 2000, " " * 1500, "ab\n" * 900, "a " * 1000 + "b" * 2000 + " c" * 300):
        assert counter.huge(t) == len(counter.tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("alphabet", ["日本語の文章を書く", "日本語。文章、", "abcXYZ0189+/", "ab\n"])
def test_long_texts_without_spaces_take_time_in_proportion(alphabet):
    c, rng, seen = K.Counter(K.default_path(), chunk=1000, overlap=64), random.Random(3), []
    text = "".join(rng.choice(alphabet) for _ in range(150_000))
    want, plain = len(c.tok.encode(text, add_special_tokens=False).ids), c._offsets
    c._offsets = lambda part: (seen.append(len(part)), plain(part))[1]
    assert c.count(text) == want and sum(seen) <= 5 * len(text)


def test_the_tables_have_texts_long_enough_for_splicing(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and len(r["text"]) > K.CHUNK]
    c = K.Counter(K.default_path())
    assert texts and all(c.count(t) == len(c.tok.encode(t, add_special_tokens=False).ids) for t in texts) and c.splices >= len(texts)


def test_token_table(spark, counter):
    rows = [(1, "Hello world, hello!", "x", "s", 1), (1, "Hello world, hello!", "x", "s", 1), (2, None, None, None, None), (3, "", "x", "s", 0), (None, "é " * 400, "x", "s", 1)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.token_counts(spark.createDataFrame(rows, DOCS)).collect())
    n = lambda t: len(counter.tok.encode(t, add_special_tokens=False).ids)
    assert got == [("1", 19, n(rows[0][1]), False)] * 2 + [("2", 0, 0, False), ("3", 0, 0, False), ("None", 1200, n("é " * 400), n("é " * 400) > 512)]
    assert K.token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_teach_where_there_are_no_others(spark):
    """Languages and labels of which only texts above the preferred length are known."""
    from pyspark.sql import functions as F

    from relscope.llm import language_id, quality

    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwischen", "würde", "größe", "über"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[lang], k=7000)), lang) for i in range(24) for lang in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert df.where(F.octet_length("text") <= language_id.MOST_BYTES).count() == 0
    got = language_id.languages(df).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == [r[2] for r in rows]
    labels = spark.createDataFrame([(r[0], int(r[2] == "aa"), 0) for r in rows], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r for r in quality.quality(df, labels).collect()}
    assert all(scores[r[0]]["predicted"] == int(r[2] == "aa") for r in rows)


def test_held_out_languages_have_no_part(spark):
    import zlib

    from relscope.llm import language_id

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "eins zwei drei vier", "xx" if i in out else ("de", "fr")[i % 2]) for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["de", "fr"]
    only = language_id.languages(spark.createDataFrame([r for r in rows if r[0] in out], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in only.collect()} == {"und"}
