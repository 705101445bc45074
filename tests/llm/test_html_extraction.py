"""Wrappers and main texts: articles put into many templates come back word for word; alignment against brute force; defined cases."""

import random
from html import escape

import pytest

from tallyhouse.llm import html_extraction as he
from tallyhouse.llm.html_extraction import Wrapper, aligned, blocks, chosen, folded, main_texts, page_stats

SCHEMA = "page_id long, url string, html string, text int, host string, tokens string"
WORDS = "river stone & night <b> house \"quiet\" green hill é über naïve 日本 walk 3.5% (note) it's end.".split()


def prose(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(n // 2, n)))


def inner(rng, text):
    """A block's text as markup: escaped, with inline elements, line breaks and white space."""
    out = []
    for w in text.split():
        w = escape(w, quote=rng.random() < 0.5)
        x = rng.random()
        out.append(f"<b>{w}</b>" if x < 0.1 else f'<a href="/{x}">{w}</a>' if x < 0.13 else f"<span class='k'>{w[:2]}<i>{w[2:]}</i></span>" if x < 0.2 and "&" not in w else w)
    return "".join(w + rng.choice([" ", " ", "\n  ", "&#32;", "<br>"]) for w in out)


def links(rng, n):
    return "".join(f"<li><a href='/x{i}'>{escape(prose(rng, 4))}</a></li>" for i in range(n))


def page(kind, rng, article):
    h, *rest = article
    body = "".join(f"<p>{inner(rng, p)}" + rng.choice(["</p>", ""]) for p in rest)
    menu, ad, comment = links(rng, rng.randint(3, 9)), escape(prose(rng, 20)), escape(prose(rng, 30))
    if kind == "article":
        return f"<html><head><title>{escape(h)}</title><style>p{{}}</style></head><body><header><a href=/>Site</a> <p>Slogan</p></header><nav><ul>{menu}</ul></nav><article><h1>{inner(rng, h)}</h1>{body}<div class='ad'>{ad}</div></article><aside><p>{ad}</p></aside><footer>{ad}</footer></body></html>"
    if kind == "divs":
        return f"<BODY><div id=masthead><h2>Site</h2></div><div class='top-nav'><ul>{menu}</ul></div><div class='post-content'><h1>{inner(rng, h)}</h1>{body}</div><div id='comments'><ol><li><p>{comment}</p><li><p>{comment} again</p></ol><form><label>Your name</label><textarea>Say</textarea></form></div><div class='siteFooter'>{ad}</div>"
    if kind == "bare":  # nothing marks the article: the host's other pages tell
        return f"<html><body><div><p>We keep small files on your machine, as all do.</p></div><table><tr><td>{menu}</td></tr></table><div><section><h1>{inner(rng, h)}</h1>{body}</section></div><div><i>All rights are with us</i></div><script>if (a < b) document.write('<p>no</p>')</script></body></html>"
    if kind == "main":
        return f"<body class='has-sidebar'><form id=all><div role=banner>Site {ad}</div><main><div class='cookie-notice'>{ad}</div><h1>{inner(rng, h)}</h1>{body}<section class='related-posts'><h3>More</h3><ul>{menu}</ul></section></main><div role=contentinfo>{ad}</div></form>"
    return f"<!-- <article>no</article> --><div hidden>{ad}</div><div style='display: none'>{ad}</div><section class=story><h1>{inner(rng, h)}</h1>{body}<div class=newsletter-signup>{ad}</div></section><!-- open {ad}"


@pytest.mark.parametrize("small", [he.SMALL, 0])
def test_articles_come_back(spark, small, monkeypatch):
    monkeypatch.setattr(he, "SMALL", small)
    monkeypatch.setattr(he, "HEAVY_SHARE", 0.3)
    rng, rows, want = random.Random(3), [], {}
    for i in range(240):
        kind = ("article", "article", "article", "divs", "bare", "main", "rest")[i % 7]
        article = [prose(rng, 8), *(prose(rng, 60) for _ in range(rng.randint(1, 7)))]
        want[i] = " ".join(article)
        rows.append((i, f"https://{kind}.example.org:80/{i}?x#y", page(kind, rng, article), i, "h", "t"))
    # a hot group of copies, and pages of hosts of their own
    rows += [(1000 + i, "http://article.example.org/copy", rows[0][2], 0, "h", "t") for i in range(60)]
    want |= {1000 + i: want[0] for i in range(60)}
    for i, kind in enumerate(["article", "divs", "main", "rest"]):
        article = [prose(rng, 8), prose(rng, 60)]
        rows.append((2000 + i, f"http://alone{i}.example.org", page(kind, rng, article), 0, "h", "t"))
        want[2000 + i] = " ".join(article)
    got = main_texts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    wrong = [(r.page_id, r.url, r.text[:150], want[r.page_id][:150]) for r in got if r.text != want[r.page_id]]
    assert not wrong, (len(wrong), wrong[:3])
    assert all(r.n_chars == len(r.text) for r in got)


def test_defined_cases(spark):
    long = "word " * 200_000
    rows = [
        (1, "http://a.org", None, ""), (2, None, "", ""), (3, "no url", "plain &lt;text&gt; &am &amp &nosuch;", "plain <text> &am & &nosuch;"), (None, "http://a.org", "<p>x", "x"),
        (4, "http://b.org", "<p>one<script>never closed <p>two", "one"), (5, "http://c.org", "<p>one<!-- never closed <p>two", "one"), (6, "http://d.org", "< 5 <p title='a>b'>x</p>", "< 5 x"),
        (7, "http://e.org", f"<article><p>{long}</article>", long.strip()), (8, "http://f.org", "<nav>only a menu</nav>", ""), (9, "http://g.org", "<p>a &nbsp; b\x0b\x0cc</p>&#x1F600;&#xD800;", "a b c \U0001f600�"),
        (8, "http://f.org", "<nav>only a menu</nav>", ""),
    ]
    got = main_texts(spark.createDataFrame([(*r[:3], 0, "h", "t") for r in rows], SCHEMA)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted((str(r[0]), r[3], len(r[3])) for r in rows)
    assert main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks():
    assert blocks("<ul><li>a<li>b<ul><li>c</ul></ul>d") == [("ul>li", "a", 0), ("ul>li", "b", 0), ("ul>li>ul>li", "c", 0), ("", "d", 0)]
    assert blocks("<table><tr><td>a<td>b<tr><td><a>c d</a> e</table>") == [("table>tr>td", "a", 0), ("table>tr>td", "b", 0), ("table>tr>td", "c d e", 3)]
    assert blocks("<div><p>a</div></p>b") == [("div>p", "a", 0), ("", "b", 0)]
    assert blocks("x<br>y<b>z</b>w") == [("", "x yzw", 0)]
    assert blocks('<div class="Ad-12 x" id=k9>t</div>') == [("div.Ad-0.x.k0", "t", 0)]


def test_folding():
    assert folded(list("abbbc")) == (list("abc"), [0, 1, 1, 1, 2])
    assert folded(list("hphpphppp")) == (list("hp"), [0, 1, 0, 1, 1, 0, 1, 1, 1])
    assert folded([]) == ([], [])
    rng = random.Random(1)
    for _ in range(300):
        paths = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        tokens, slot = folded(paths)
        assert [tokens[s] for s in slot] == paths and sorted(set(slot)) == list(range(len(tokens)))
        assert all(a != b for a, b in zip(tokens, tokens[1:]))


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(2)
    for k in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and v < w for (x, v), (y, w) in zip(got, got[1:]))
        assert len(got) == lcs(a, b)
    monkeypatch.setattr(he, "TABLE", 0)  # the way of very long streams still aligns
    assert aligned(list("xabcdy"), list("zabcdw")) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_wrapper_holds_every_page_as_a_subsequence():
    rng = random.Random(5)
    for _ in range(60):
        pages = [folded([rng.choice("abcdef") for _ in range(rng.randint(1, 12))])[0] for _ in range(6)]
        stat = [1, 1, 3, 0, 7, 7]
        whole = Wrapper(pages[0], [stat] * len(pages[0]), 1)
        for p in pages[1:]:
            whole.merge(p, [stat] * len(p), 1)
        for p in pages:
            assert len(aligned(whole.tokens, p)) == len(p)
        assert sum(s[0] for s in whole.stats) == sum(map(len, pages)) and whole.pages == 6


def test_expression():
    one = blocks("<nav><a>x</a></nav><article><h1>t</h1><p>a<p>b</article>")
    two = blocks("<nav><a>x</a></nav><article><h1>u</h1><p>a</article><footer>f</footer>")
    made = [(t, page_stats(p, s, len(t))) for p in (one, two) for t, s in [folded([b[0] for b in p])]]
    w = Wrapper(*made[0], 1)
    w.merge(*made[1], 1)
    assert w.expression() == "(nav #text) (article>h1 #text) (article>p #text)+ (footer #text)?"
    assert chosen(w.tokens, w.stats) == [False, True, True, False]
