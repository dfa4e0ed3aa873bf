"""Operator 12: texts of known pages, and classes and templates against a plain computation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barcraft.llm import main_text as m
from barcraft.llm.html_tokens import read_page
from barcraft.llm.scratch import Scratch
from tests.llm.conftest import CLASHES


def pages(spark, rows, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return df.withColumns({c: F.lit("x") for c in [*CLASHES, "host", "text", "template", "link_slots", "tokens", "slot"]})


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def one(html):
    return "\n".join(m.extract(read_page(html), set(), set()))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\nb"), ("<p>x<b>y</b>z<br>w</p>", "xyz w"),
        ("<article><h1>T &amp; t</h1><p>&lt;p&gt; &#233;&nbsp;&eacute;&copy 1 &am</p></article>", "T & t\n<p> é é© 1 &am"),
        ("<nav>menu</nav><header>top</header><article><header><h1>Head</h1></header><p>one</p><div class='ad box'>buy</div><p>two</p></article><aside>s</aside><footer>f</footer>", "Head\none\ntwo"),
        ("<main><h1>t</h1><p>p</p><form><label>mail</label></form><section id='comments'><article class='comment'>me too</article></section></main><p>out</p>", "t\np"),
        ("<div role='navigation'>n</div><div class='cookie-notice'>c</div><div class='siteHeader'>h</div><p>kept</p><div id=sidebar>s</div><div style='display: none'>no</div>", "kept"),
        ("<head><title>T</title><style>p{}</style></head><body><script>'</p>'</script><!-- <p>no</p> --><p>yes</p><noscript>no</noscript><textarea>no</textarea><svg><text>no</text></svg>", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v</dl>", "a\nb\nc\nd\n1\n2\n3\nk\nv"),
        ('<p title="a > b" data-x=\'<p>\'>q</p><p it\'s>r</p><!-->s<!--->t<!-- u --!>v<?x y?><!DOCTYPE z>w', "q\nr\nstvw"),
        ("<article><p>unclosed <b>bold<p>next</article>", "unclosed bold\nnext"), ("<article>a</article><div>b</div><article>c</article>", "a\nc"), ("<script>all of it", ""), ("x<b", "x"), ("a < b <3", "a < b <3"),
        ("<b><p>in</b>side</p>after", "inside\nafter"), ("</div></p><p>ok</p></section>", "ok"), ("<ADDRESS CLASS=NAV>n</ADDRESS><P>Ä 漢字 🙂", "Ä 漢字 🙂"),
    ],
)
def test_known_pages(html, text):
    assert one(html) == text


def test_hostile_pages_take_linear_time():
    n = 60_000
    for html in ("<a" * n, "<!--" * n, '<p x="' * n, "<div>" * n + "</div>" * n, "<b>" * n + "<div>" * n + "</b>" * n, "<script>" * n, "&" * n, "<p><i>" * n, "<li>" * n, "<" * n):
        one(html)
    assert one("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep\nafter"


def site(seed, n=12):
    """Pages of one host that name no article: a title, prose and a list of links in a fixed frame."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    out = []
    for i in range(n):
        prose = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 5))]
        title = f"{word()} {i} {word()}"
        links = "".join(f'<div><a href="/{word()}">{word()} {word()}</a></div>' for _ in range(rng.randrange(1, 6)))
        body = f'<div class="top"><div>Daily Planet</div></div><div class="c"><h2>{title}</h2><div class="t">' + "".join(f"<p>{p}</p>" for p in prose) + f'</div></div><div class="more"><div>Read on:</div>{links}</div><div class="end"><div>All rights reserved</div></div>'
        out.append((f"<html><head><title>x</title></head><body>{body}</body></html>", "\n".join([title, *prose])))
    return out


def test_template_leaves_prose(spark):
    """The frame's texts and the link lists go, though nothing names them."""
    rows, want = [], {}
    for h, host in enumerate(["a.example", "b.example:80"]):
        for i, (html, text) in enumerate(site(h)):
            rows.append((100 * h + i, f"http://u@{host.upper()}/x/{i}?q=1", html))
            want[100 * h + i] = text
    assert texts(m.main_text(pages(spark, rows))) == want


def test_small_sites_are_judged_on_their_own(spark):
    rows = [(i, f"https://s{i}.example/", html) for i, (html, _) in enumerate(site(3, 2))]
    got = texts(m.main_text(pages(spark, rows)))
    assert all("Daily Planet" in t and "All rights reserved" in t for t in got.values())


def test_awkward_rows(spark):
    """Nulls, empty pages, repeated rows, one long page, a page that repeats all over its host."""
    same = "<html><body><div>x</div><article><h1>Same</h1><p>again</p></article></body></html>"
    long = "<article>" + "".join(f"<p>w{i} &amp;</p>" for i in range(60_000)) + "</article>"
    rows = [(1, None, None), (2, "http://h.example/", None), (3, "relative/path", "<p>r</p>"), (None, "http://h.example/n", "<p>n</p>"), (4, "http://h.example/l", long)]
    rows += [(5, "http://h.example/s", same)] * 4 + [(5, "http://other.example/s", same), (6, "", ""), (7, "http://h.example/e", " ")]
    df = m.main_text(pages(spark, rows))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in df.collect())
    want = Counter()
    for i, url, html in rows:
        text = {3: "r", None: "n", 4: "\n".join(f"w{k} &" for k in range(60_000)), 5: "Same\nagain"}.get(i, "")
        want[i, url, text, len(text)] += 1
    assert got == want
    assert m.main_text(pages(spark, [], 1)).count() == 0


def plain_classes(rows, tokens=3, pages=3, share=0.5):
    """{host: classes} from whole occurrence vectors."""
    by_host = defaultdict(list)
    for _, url, html in rows:
        found = re.match(r"\w+://([^/]+)", url or "")
        if found:
            by_host[found[1]].append(Counter(m._signed(t) for t in read_page(html).tokens))
    out = {}
    for host, counts in by_host.items():
        groups = defaultdict(list)
        for t in set().union(*counts):
            vector = tuple(c[t] for c in counts)
            have = sum(map(bool, vector))
            if have >= pages and have >= share * len(counts):
                groups[vector].append(t)
        found = sorted(sorted(g) for g in groups.values() if len(g) >= tokens)
        if found:
            out[host] = found
    return out


def plain_templates(rows, classes):
    """{host: template tokens}: each page's classes judged pair by pair, then over all pages."""
    seen = defaultdict(lambda: defaultdict(set))
    for _, url, html in rows:
        found = re.match(r"\w+://([^/]+)", url or "")
        if not found or found[1] not in classes:
            continue
        tokens, mine = [m._signed(t) for t in read_page(html).tokens], classes[found[1]]
        for k, c in enumerate(mine):
            order = [t for t in tokens if t in c]
            if not order:
                continue
            verdict = len(order) % len(c) == 0 and all(order[i] == order[i % len(c)] for i in range(len(order)))
            at = [i for i, t in enumerate(tokens) if t in c]
            spans = [(at[i], at[i + len(c) - 1]) for i in range(0, len(at), len(c))] if verdict else []
            around = []
            for j, o in enumerate(mine):
                where = [i for i, t in enumerate(tokens) if t in o]
                if j == k or not where or len(where) % len(o) or not verdict:
                    continue
                gaps = [(sum(w < a for w in where), sum(w < b for w in where)) for a, b in spans]
                weaker = (len(o), -j) < (len(c), -k)
                if all(a == b for a, b in gaps):
                    kinds = {a % len(o) for a, _ in gaps}
                    if len(kinds) > 1:
                        verdict = verdict and weaker
                    elif kinds != {0}:
                        around.append((where[gaps[0][0] - 1], o[0], kinds.pop()))
                elif any(a % len(o) or b % len(o) for a, b in gaps):
                    verdict = verdict and weaker
            seen[found[1]][k].add((verdict, tuple(order[: len(c)]), max(around)[1:] if around else ()))
    return {h: sorted(t for k, v in ks.items() if len(v) == 1 and next(iter(v))[0] for t in classes[h][k]) for h, ks in seen.items()}


def random_site(seed, n):
    """Pages with frames that repeat, nest, overlap and change places."""
    rng = random.Random(seed)
    pieces = ['<div class="a"><p>one</p></div>', '<div class="b"><ul><li>x</li></ul></div>', "<section><h2>t</h2></section>", "<table><tr><td>%d</td></tr></table>", "<p>%d</p>", '<div class="c">', "</div>", '<div class="d"><dl><dt>k</dt></dl></div>']
    fixed = [rng.choice(pieces) for _ in range(6)]
    out = []
    for i in range(n):
        body = [p.replace("%d", str(rng.randrange(5))) for p in fixed]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body)), rng.choice(pieces).replace("%d", str(i)))
        if rng.random() < 0.15:
            a, b = rng.randrange(6), rng.randrange(6)
            body[a], body[b] = body[b], body[a]
        body = body * (1 + (rng.random() < 0.1))
        out.append((seed * 1000 + i, f"http://h{seed}.example/{i}", "<body>" + "".join(body) + "</body>"))
    return out


def test_classes_and_templates_equal_plain_ones(spark):
    rows = [r for seed in range(14) for r in random_site(seed, 3 + seed)] + [(9, "http://h3.example/1", "<p>x")] * 2
    df = pages(spark, rows)
    tokens = Scratch(spark, "t").write("tokens", df.select(m.host_of(df.url).alias("host"), "page_id", "url", "html").mapInArrow(m._token_rows, m._TOKENS))
    classes = m.classes_of(tokens)
    want = plain_classes(rows)
    assert {r.host: [list(c) for c in r.classes] for r in classes.collect()} == want
    got = {r.host: sorted(r.template) for r in m.templates_of(tokens, classes).collect()}
    assert got == {h: t for h, t in plain_templates(rows, want).items() if t}
    assert 0 < len(got) < len(want) or any(len(got[h]) < sum(map(len, want[h])) for h in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<td>", "<table>", "</table>", "<article>", "</article>", "a", " ", "&amp;", "<br>", "<!--", "-->", "<script>", "</script>", "<nav>", "</nav>", '<i class="ad">', "</i>", "<", ">", '"', "="]), max_size=40))
def test_any_html_is_read(parts):
    """Every position is a token or in a block; texts are trimmed and single-spaced."""
    page = read_page("".join(parts))
    for b in page.blocks:
        assert b.text == " ".join(b.text.split()) and 0 <= b.at < len(page.tokens) and b.linked <= b.size
    assert [b.at for b in page.blocks] == sorted({b.at for b in page.blocks})
