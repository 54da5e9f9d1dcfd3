import html as htmllib

import numpy as np

from brindle.llm import extract, lstm
from brindle.llm.blocks import leaves, vectors

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";x<1;</script></head><body>'
    '<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it now.</div>'
    "<article><h1>Of tea &amp; milk</h1><p><b>First  line\n here.<br><p>Second &lt;line&gt; &eacute;.</p><p>Third</article>"
    '<div class="comments"><p><b>Bo</b> nice</p></div><form><label>Mail</label></form><footer>&copy; x &middot; y.</footer>'
)


def test_blocks_are_read_from_broken_markup():
    texts = [x.text for x in leaves(PAGE)]
    assert texts == ["a", "b", "Buy it now.", "Of tea & milk", "First line here.", "Second <line> é.", "Third", "Bo nice", "Mail", "© x · y."]
    assert leaves(None) == leaves("") == leaves("<p> </p>") == leaves("<script>x") == []
    assert [x.text for x in leaves("a</div><p>b<x</p>")][0] == "a"
    assert len(leaves("<p>x" * 50_000)) == 50_000


def test_main_text_of_a_page():
    assert extract.main_texts(lstm.labeller(), [PAGE, None, ""]) == ["Of tea & milk\nFirst line here.\nSecond <line> é.\nThird", "", ""]


def test_held_out_accuracy():
    seqs, marks = lstm.examples(200, seed=77)
    said = lstm.label(lstm.labeller(), seqs)
    assert np.mean(np.concatenate([a == (b > 0) for a, b in zip(said, marks)])) > 0.99


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    seqs = [rng.normal(size=(k, 5)).astype(np.float32) for k in (4, 2)]
    x, on, y = lstm.padded(seqs, [np.array([1, 0, 1, 1.0]), np.array([0, 1.0])])
    m = {k: v.astype(np.float64) for k, v in lstm.start(1, 5, 3).items()}
    _, grad = lstm.gradient(m, x, on, y)
    for name in m:
        flat = m[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[k]
            flat[k] = old + 1e-3
            up, _ = lstm.gradient(m, x, on, y)
            flat[k] = old - 1e-3
            down, _ = lstm.gradient(m, x, on, y)
            flat[k] = old
            assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[k]) < 2e-3


def test_query_matches_the_article_of_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        article = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        for tag in ("h1", "p", "b", "br"):
            for end in ("", "/"):
                article = article.replace(f"<{end}{tag}>", "\0" if tag != "b" else "")
        want = "\n".join(x for x in (" ".join(htmllib.unescape(y).split()) for y in article.split("\0")) if x)
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right / len(rows) > 0.99


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (2, "", None)], "page_id long, html string, text string")
    assert [r.text for r in extract.main_text(pages).collect()] == ["", "", ""]
    assert extract.main_text(pages.limit(0)).count() == 0


def test_optional_tags_and_unclosed_elements_lose_no_text():
    said = lambda page: [x.text for x in leaves(page)]
    assert said("<head><title>T</title><meta charset=x><p>One<p>Two") == ["One", "Two"]
    for tag in ("svg", "object", "select", "noscript", "template"):
        assert said(f"<p>One</p><{tag}><p>Two</p>") == ["One", "Two"]
        assert said(f"<p>One</p><{tag}>x</{tag}><p>Two</p>") == ["One", "Two"]
    assert said("<p>Let <math><mi>x</mi></math> be</p><math><p>Two</p>") == ["Let x be", "Two"]
    assert said("<p>One</p><script>x<p>Two</p>") == ["One"]


def test_markers_above_many_classes_are_seen():
    deep = "".join(f'<div class="row col-md-{k} px-{k} inner">' for k in range(6))
    shut = "</div>" * 6
    story = "".join(f"<p>Ander fogu hiis joka the lemmi of nopa and quire suti verwo the xeyl {k}.</p>" for k in range(6))
    reply = "<p><b>Bo</b> The za and der noka of lemmi sure quipa and xeyl.</p>" * 3
    page = f"<html><body><article><h1>Of tea</h1>{deep}{story}{shut}</article><section id=comments>{deep}{reply}{shut}</section><footer>{deep}<p>Ander fogu.</p>{shut}</footer>"
    found = leaves(page)
    a, b = (vectors([x])[0] for x in (found[1], found[-1]))
    assert len(found[1].path) > 24 and (a[:64] != b[:64]).any()
    text = extract.main_texts(lstm.labeller(), [page])[0]
    assert "joka" in text and "noka" not in text and not text.endswith("Ander fogu.")


def test_long_and_unclosed_pages():
    """Time grows with the page: tags without an end, open quotes and declarations are read once, deep nesting costs no more than flat."""
    import time

    pages = {
        "<div class='x' " * 350_000: 1, "<x " * 500_000 + '"': 1, "<!" * 1_000_000: 1, "</" * 500_000: 1, "<x '" * 500_000 + ">": 0, "<!-- " * 1_000_000: 0, "<div>x" * 100_000: 100_000, "<b 'y' \"" * 100_000 + ">": 1,
    }
    for page, n in pages.items():
        began = time.perf_counter()
        found = leaves(page)
        assert time.perf_counter() - began < 10, page[:20]
        assert (len(found) == n) if n != 1 else len(found) <= 1, page[:20]
    assert [x.text for x in leaves("a <b c='> <i>d</i>")] == ["a <b c='> d"]


def test_many_blocks_in_bounded_memory():
    """A page of 40,000 blocks among small ones, with no more for the small ones than they need, and the same labels as alone."""
    import tracemalloc

    model = lstm.labeller()
    small = [PAGE, "<p>Ander fogu.</p>"] * 40
    want = extract.main_texts(model, small)
    long = "<article>" + "<p>Ander fogu hiis joka the lemmi of nopa and quire suti verwo the xeyl." * 40_000
    tracemalloc.start()
    got = extract.main_texts(model, [*small[:40], long, *small[40:]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:40] + got[41:] == want and got[40].count("\n") > 38_000
    assert peak < 1 << 28  # so 200,000 blocks stay far below a GB
