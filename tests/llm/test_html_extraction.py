import html
import random

import pytest

from panelforge.llm import html_extraction
from panelforge.llm.html_extraction import Matching, extract_group, main_texts, parse, slots

SCHEMA = "page_id long, url string, html string, text string, host string, part int, groups int"


def page(i, body):
    return f"<html><head><title>T{i}</title><script>var a='</p>';</script></head><body><nav><a href='/x'>Home</a></nav>{body}<footer>f {i}</footer></body></html>"


def test_marked_parts_go_and_blocks_are_joined():
    body = (
        "<div class='site-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>One\n  <b>two</b>&nbsp;three<br>four"
        "<p>five<!-- no --><aside>side</aside><form>f</form> six<ul><li>a<li>b</ul><section id='comments-7'><p>reader</p></section></article>"
        "<div class=\"ad\">buy</div>"
    )
    assert extract_group([page(1, body)]) == ["Title & more\nOne two three four\nfive\nsix\na\nb"]


def test_unclosed_and_broken_markup_parses():
    assert extract_group(["<article><p><b>x.<br><p>y</article>z", "<p", "a < b > c", "<div>" * 900 + "deep", "</p></div>t", None, ""]) == [
        "x.\ny", "<p", "a < b > c", "deep", "t", "", "",
    ]


def test_constant_slots_are_template_and_copies_do_not_vote():
    rng = random.Random(1)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(12))
    bodies = [(text(), text()) for _ in range(9)]
    made = [f"<div class='top'>Welcome here</div><div class='x'><h2>{a}</h2><p>{b}</p></div><div class='end'>All rights</div>" for a, b in bodies]
    assert extract_group(made) == [f"{a}\n{b}" for a, b in bodies]
    # copies only: nothing can be told apart, everything stays
    assert extract_group(made[:1] * 9) == [f"Welcome here\n{bodies[0][0]}\n{bodies[0][1]}\nAll rights"] * 9
    # a shared passage in some pages is no template
    shared = [(a, "common passage" if k % 3 == 0 else b) for k, (a, b) in enumerate(bodies)]
    got = extract_group([f"<div><h2>{a}</h2><p>{b}</p></div>" for a, b in shared])
    assert got == [f"{a}\n{b}" for a, b in shared]


def test_all_pages_come_back_whatever_their_columns(spark):
    rng = random.Random(2)
    rows = [(i, f"https://h{i % 3}.example.com/{i}", page(i, f"<article><p>{rng.random()} &lt;{i}</p></article>"), "t", "h", 1, 2) for i in range(100)]
    rows += [(None, None, None, "t", "h", 1, 2), (5, "no url", "", "t", "h", 1, 2), rows[0], (7, None, "<p>" + "long " * 50_000, None, None, None, None)]
    got = main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got if r.url and "example" in r.url}
    for i, _, source, *_ in rows[:100]:
        assert by_id[i] == html.unescape(source.split("<p>")[1].split("</p>")[0])
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_without_content_element_use_the_whole_page():
    assert slots(parse("<div>a</div><p>b")) == ["a", "b"]
    assert slots(parse("<div>a</div><main><p>b</main>")) == ["b"]


def test_layout_classes_and_other_attributes_drop_nothing():
    for wrapper in ("class='has-sidebar'", "class='post comments-open'", "class='no-ads'", "id=page-with-header", "class=sidebar-left", "class='search'"):
        assert extract_group([page(1, f"<div {wrapper}><article><p>text</p></article></div>")]) == ["text"], wrapper
    for wrapper in ("class='has-sidebar'", "class='post comments-open'", "class='no-ads'", "class='page-with-header'"):
        assert extract_group([page(1, f"<div {wrapper}><p>text</p></div>")]) == ["text"], wrapper
    body = "<h2 title='the hidden cost'>a</h2><p data-id=\"menu\">b</p><p><a href='?id=search'>c</a> d</p><p data-hidden='no' title=\"class='ad'\">e</p>"
    assert extract_group([page(1, body)]) == ["a\nb\nc d\ne"]
    assert extract_group([page(1, "<p class='lead ad'>a</p><p HIDDEN>b</p><p style='display: none'>c</p><p class=cookie-banner>d</p><p>e</p>")]) == ["e"]


def test_marked_elements_keep_the_content_they_hold():
    assert extract_group(["<form id=all><div class=overlay><p>menu</p><main><p>text</p></main></div></form>"]) == ["text"]
    assert extract_group(["<nav><p>menu<main><p>text</p></main>"]) == ["text"]
    # where the content is elsewhere, articles of marked elements are teasers; marked articles are readers' comments
    assert extract_group(["<article>text</article><div class=related-posts><article>teaser</article></div>"]) == ["text"]
    assert extract_group(["<div><p>text</p></div><ol class=comment-list><li class=comment><article class=comment-body>reader</article></ol>"]) == ["text"]
    assert extract_group(["<p>text</p><div hidden><article>no</article></div>"]) == ["text"]


def test_boilerplate_goes_on_hosts_of_any_size(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    tail = "All rights reserved " * 20
    want, rows = {}, []
    for size in (2, 3, 4, 17, 18, 40):
        for k in range(size):
            # boilerplate outweighs the text; the first page lacks a part of it where the host is large
            extra = "" if size > 10 and k == 0 else "<p>Follow our channel</p>"
            own = text(5)
            want[len(rows)] = own
            source = f"<article><p>Welcome to our pages</p>{extra}<p>{own}</p><div class='end'>{tail}</div></article>"
            rows.append((len(rows), f"https://n{size}.example.com/{k}", source, "t", "h", 1, 2))
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    whole = [r[2] for r in rows if "//n40." in r[1]]
    assert extract_group(whole) == [want[r[0]] for r in rows if "//n40." in r[1]]


def test_copies_of_a_host_have_one_vote(spark):
    words = [f"text of page {k}" for k in range(20)]
    # many copies of one page, some without the boilerplate, must not turn its text into template
    made = [f"<article><p>{words[0]}</p>{'<p>Welcome</p>' if k % 10 else ''}</article>" for k in range(60)]
    made += [f"<article><p>{w}</p><p>Welcome</p></article>" for w in words[1:]]
    rows = [(k, f"https://c.example.com/{k}", m, "t", "h", 1, 2) for k, m in enumerate(made)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(len(made))] == [words[0]] * 60 + words[1:] == extract_group(made)
    # a page and a part of it: nothing varies in the part, so it is no second voter
    assert extract_group(["<p>a</p><p>b</p>", "<p>a</p>"]) == ["a\nb", "a"]


@pytest.mark.parametrize(
    "page, size",
    [
        ("<div>" * 100_000 + "deep", 4),
        ("<div>t" * 100_000, 199_999),
        ("<a " * 350_000, 350_000 * 3 - 1),
        ("<a<a" * 250_000, 1_000_000),
        ("<a \"" * 250_000, 1_000_000),
        ("<script>" + "</script " * 110_000, 0),
        ("<b><div></div>" * 66_000 + "x", 1),
        ("<li>" + "<div>" * 50_000 + "</p></i>" * 60_000 + "x", 1),
        ("<!--" * 250_000, 0),
    ],
)
def test_long_and_deep_markup_ends(page, size):
    assert [len(text) for text in extract_group([page])] == [size]


def test_blocks_below_the_depth_stay_in_order():
    deep = "<div>" * 400
    assert extract_group([f"{deep}a<p>b</p><aside>side<p>no</p></aside>c<form>d</form>e<b>f</b></div>g"]) == ["a\nb\nc\nef\ng"]


def test_wide_pages_are_aligned():
    row = "<p>x</p>"
    pages = [row * 20_000, row * 20_000 + "<p>one</p>", "<p>two</p>" + row * 20_000]
    assert [text.replace("\n", "") for text in extract_group(pages)] == ["", "one", "two"]


def test_long_stretches_cut_at_equal_children_match_like_whole_ones(monkeypatch):
    rng = random.Random(4)
    for _ in range(30):
        frame = [f"<p>menu {k}</p>" for k in range(6)]
        pages = []
        for _ in range(6):
            parts = list(frame)
            for _ in range(5):
                parts.insert(rng.randrange(len(parts) + 1), f"<p>{rng.random()}</p>")
            pages.append("<div>" + "".join(parts) + "</div>")
        whole = extract_group(pages)
        monkeypatch.setattr(html_extraction, "CELLS", 12)
        assert extract_group(pages) == whole
        monkeypatch.undo()


def test_the_heaviest_matching_at_any_size(monkeypatch):
    # an equal child far off its place weighs less than the two that it would part
    one, two = (f"<ul>{''.join(f'<li>{k}{n}</li>' for n in range(9))}%s</ul>" for k in "ab")
    first = parse(one % "<li>x</li>" + two % "<li>x</li>" + "<p>same</p>")
    second = parse("<p>same</p>" + one % "<li>y</li>" + two % "<li>y</li>")

    def matched():
        return sorted(a.children[i] for a, i, b, j in Matching(first, second).pairs() if a.children[i] == b.children[j])

    whole = matched()
    assert whole == sorted(f"{k}{n}" for k in "ab" for n in range(9))
    monkeypatch.setattr(html_extraction, "CELLS", 2)
    assert matched() == whole


def test_deep_pages_in_a_job(spark):
    rows = [(i, f"http://h/{i}", "<div>" * 5_000 + f"<p>page {i}</p>", "x", "x", 0, 0) for i in range(3)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"page {i}" for i in range(3)}
