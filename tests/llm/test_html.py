import html
import random
import re
import time

import pytest

from strandmill.llm import html_wrapper as w
from strandmill.session import table

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page"><article class="post"><header><h1>Title&nbsp;{k}</h1></header><p>First &amp; {k}  para<b>graph</b>.
<p>Second &lt;para&gt;<br>goes on<div class="ad-box">Buy!</div>{more}<form><input name=q>Search</form><blockquote>Quoted <i>words</i></blockquote>
<table><tr><td>a<td>b</table></article><aside>Other news</aside><section id="comments"><p>Nice post {k}!</p></section></div>
<!-- <p>hidden</p> --><footer>&copy; {k}</footer></body></html>"""


def page(k, more=""):
    return PAGE.format(k=k, more=more)


def want(k, more=""):
    return "\n".join([f"Title {k}", f"First & {k} paragraph.", "Second <para> goes on", *([more] if more else []), "Quoted words", "a", "b"])


def read(pages, source):
    return w.extract(source, w.plan_of(w.infer(pages)))


def test_article_alone():
    plan = w.plan_of(w.infer([page(1), page(2, "<p>more</p>"), page(3)]))
    assert [t[0] for t in plan["tokens"] if t[2] == 1] == ["article class=post"] and [t[0] for t in plan["tokens"] if t[2] == "x"] == ["div class=ad-box"]
    for k in (1, 5):
        assert w.extract(page(k), plan) == want(k)
        assert w.extract(page(k, "<p>more"), plan) == want(k, "more")


def test_pages_that_the_wrapper_does_not_fit():
    plan = w.plan_of(w.infer([page(1), page(2)]))
    assert w.extract("<main><p>One</p><p>Two</main>", plan) == "One\nTwo"
    assert w.extract("just text", plan) == "just text"
    assert w.extract("", plan) == ""


def unnamed(k, rng):
    """A page without telling names: a constant notice longer than the story, an optional box, a story in a box of its own."""
    box = "<div><p>A box that only some pages have, always with the same words in it.</p></div>" if rng.random() < 0.5 else ""
    story = "".join(f"<p>Story {k} part {j} {rng.random()}</p>" for j in range(rng.randrange(1, 5)))
    quote = f"<blockquote>Quote {k}</blockquote>" if rng.random() < 0.3 else ""
    links = "".join(f"<a href=/{j}>Entry {j * k}</a>" for j in range(3))
    notice = "Words of our own that never change at all and go on for long. " * 8
    source = f"<body><div><div>The Site</div><div>{links}</div></div>{box}<div><div><h1>Head {k}</h1><div>{story}{quote}</div></div></div><div><div>{notice}</div></div>"
    text = "\n".join([f"Head {k}", *re.findall(r"<p>(Story.*?)</p>", story), *([f"Quote {k}"] if quote else [])])
    return source, text


@pytest.mark.parametrize("seed", range(3))
def test_hosts_without_article_or_names_go_by_their_wrapper(seed):
    rng = random.Random(seed)
    made = [unnamed(k, rng) for k in range(12)]
    plan = w.plan_of(w.infer([s for s, _ in made]))
    fresh = [unnamed(k, rng) for k in range(50, 60)]
    assert [w.extract(s, plan) for s, _ in made + fresh] == [t for _, t in made + fresh]
    assert all(w.extract(s) != t for s, t in made)  # without a wrapper


def test_two_templates_of_a_host():
    one = lambda k: f"<body><div id=a><p>First kind {k}</p><p>goes on {k * k}</p></div><div id=low>Same words below</div>"
    two = lambda k: f"<body><div id=b><h2>Second kind {k}</h2>{k} text<ul><li>x{k}</ul></div><div id=low>Same words below</div>"
    plan = w.plan_of(w.infer([one(1), two(2), one(3), two(4), one(5)]))
    assert w.extract(one(9), plan) == "First kind 9\ngoes on 81" and w.extract(two(8), plan) == "Second kind 8\n8 text\nx8"


@pytest.mark.parametrize("wrap", ["<form id=page>{}</form>", "<div class='with-sidebar'>{}</div>", "<div class=share-bar><section class=widget>{}</section></div>"])
def test_what_wraps_the_article_is_no_furniture(wrap):
    source = "<body>" + wrap.format("<div class=menu>Menu</div><article><p>Text</p></article><div class=sidebar>More</div>")
    assert read([source], source) == "Text" == w.extract(source)


def test_alignment_makes_union_free_expressions():
    line = lambda *pages: w.expression(w.infer(list(pages)))
    assert line("<div><h1>A</h1><p>x</p><p>y</p><i>z</i></div>", "<div><h1>B</h1><h2>s</h2><p>x</p></div>") == "<#page><div><h1>_</h1><h2>'</h2>?<p>_</p>+<i>'</i>?</div></#page>"
    assert line("<ul></ul>", "<ul><li>a<li>b</ul>") == "<#page><ul><li>'</li>*</ul></#page>"
    assert line("<p>same</p>", "<p>same</p>") == "<#page><p>'</p></#page>"
    assert line("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<#page><dl><dt>'</dt>+<dd>'</dd>+</dl></#page>"
    assert line("<div class='a b'>x</div>", "<div class='a c'>x</div>") == "<#page><div *>'</div></#page>"
    assert line("<p id=post-1>x", "<p id=post-22>x") == "<#page><p id=post-0>'</p></#page>"
    same = "word " * 40
    assert line(f"<p>{same}a</p>", f"<p>{same}b</p>") == "<#page><p>_</p></#page>"


def test_alignment_accepts_both_pages():
    """Every page's own stream is a word of the expression of both."""
    rng = random.Random(4)

    def pattern(stream):
        out, open_, i = [], [], 0
        while i < len(stream) or open_:
            if open_ and open_[-1][0] <= i:
                _, token = open_.pop()
                out.append(f"</{token[0]}>){token[2].replace('1', '')}")
                continue
            token = stream[i]
            if token[0] == w.TEXT:
                out.append(f"(#){token[2].replace('1', '')}")
            else:
                out.append(f"(<{token[0]}>")
                open_.append((i + token[1], token))
            i += 1
        return "".join(out)

    for _ in range(300):
        make = lambda depth: "".join(f"<{t}>{make(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["b", "i", "u", "em"], k=rng.randrange(0, 4)))
        a, b = (w.fold(w.parse(make(2))) for _ in range(2))
        both = re.compile(pattern(w.merge(a, b)))
        for one in (a, b):
            word, open_ = [], []
            for i, token in enumerate(one):
                while open_ and open_[-1][0] <= i:
                    word.append(f"</{open_.pop()[1]}>")
                word.append("#" if token[0] == w.TEXT else f"<{token[0]}>")
                if token[0] != w.TEXT:
                    open_.append((i + token[1], token[0]))
            word += [f"</{name}>" for _, name in reversed(open_)]
            assert both.fullmatch("".join(word))


@pytest.mark.parametrize("source, text", [("<article><p>a</p>b<p>c", "a\nb\nc"), ("<article>a&#8364;&eacute;&notit;<br/>b</article>", "a€é¬it; b"), ("<article><ul><li>a<li>b</ul>c", "a\nb\nc"), ("<article><p>a<!-- x --> b</b> c</p", "a b c</p"), ("<ARTICLE><P>A</ARTICLE>z", "A"), ("<article><pre>a\n  b</pre></article>", "a b"), ("<article><table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"), ("<article></article><p>x", "")])
def test_markup(source, text):
    assert read([source], source) == text == read([source] * 3, source)


def test_pages_table_against_a_plain_reading(spark, sf_dir):
    got = {r["page_id"]: r for r in w.extract_pages(table(spark, sf_dir, "pages")).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        text = "\n".join(x for x in blocks if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_query_over_hosts_with_and_without_names(spark):
    """The distributed form, however pages are dealt, against the known texts."""
    rng = random.Random(7)
    rows = [(k, f"http://plain.example/{k}", *unnamed(k, rng)) for k in range(40)]
    rows += [(100 + k, f"http://named.example/{k}", page(k), want(k)) for k in range(20)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r["page_id"]: r["text"] for r in w.extract_pages(df.repartition(parts)).collect()}
        assert got == {k: text for k, _, _, text in rows}


def test_a_page_repeated_and_null_ids(spark):
    rng = random.Random(1)
    source, text = unnamed(1, rng)
    rows = [(None, None, source)] * 3000 + [(None, None, unnamed(k, rng)[0]) for k in range(2, 6)]
    got = [r["text"] for r in w.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()]
    assert got.count(text) == 3000 and len(got) == 3004


def test_partial_wrappers_hand_on_and_forget_rare_parts(spark, monkeypatch):
    monkeypatch.setattr(w, "HELD", 200)
    rng = random.Random(3)
    rows = [(k, f"http://plain.example/{k}", *unnamed(k, rng)) for k in range(60)]
    got = {r["page_id"]: r["text"] for r in w.extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, _, _, text in rows}
    monkeypatch.setattr(w, "LARGEST", 30)
    monkeypatch.setattr(w, "RARE", 10)
    pages = [f"<body><div id=text><h1>{k}</h1><p>Story {k}</p></div>" + "".join(f"<div id={chr(97 + k)}{chr(97 + j)}>odd</div>" for j in range(3)) for k in range(26)]
    wrapper = w.infer(pages)
    assert len(wrapper.stream) < 60 and [w.extract(p, w.plan_of(wrapper)) for p in pages] == [f"{k}\nStory {k}" for k in range(26)]


def test_wrappers_of_a_table_forget_nothing(monkeypatch):
    """A template on two of many pages gives its container whether a host's wrapper is small or large."""
    low = "<div id=low>{}</div>".format("Same words below. " * 3)
    pages = [f"<body><div id=a><p>Story {k}</p><p>goes on {k * k}</p></div>{low}" for k in range(120)]
    for k in (30, 40):
        pages[k] = f"<body><section id=b><p>Another kind of story, told on {k}</p></section>{low}"

    def read():
        wrapper = w.Wrapper.of_page(pages[0])
        for source in pages[1:]:
            wrapper = wrapper.join(w.Wrapper.of_page(source))
        return [w.extract(source, w.plan_of(wrapper)) for source in pages]

    small = read()
    monkeypatch.setattr(w, "LARGEST", 3)
    assert read() == small and small[30] == "Another kind of story, told on 30" and small[7] == "Story 7\ngoes on 49"


def test_nesting_of_any_depth(spark):
    rows = [(1, "http://a.b/1", "<div>" * 100_000 + "<p>deep"), (2, "http://a.b/2", "<span>" * 100_000 + "x" + "</p>" * 1000), (3, "http://a.b/3", "<article>" + "<i><b>" * 60_000 + "y")]
    got = {r["page_id"]: r["text"] for r in w.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {1: "deep", 2: "x", 3: "y"}


def test_what_stands_before_the_article_does_not_use_up_the_page():
    menu = "".join(f"<div class=row><a href=/{k}>Entry {k}</a></div>" for k in range(5000))
    make = lambda k: f"<body><nav>{menu}</nav><div id=index>{menu}</div><div id=text class=story><p>Story {k}</p></div>"
    assert read([make(1), make(2)], make(3)) == "Story 3"


def test_long_sequences_of_few_kinds_stay_small():
    make = lambda k: "<body><dl>" + "".join(f"<dt>t{j}<dd>d{j + k}" for j in range(9000 + k)) + f"</dl><article><p>Story {k}</article>"
    wrapper = w.infer([make(1), make(2)])
    assert len(wrapper.stream) < 20
    assert w.extract(make(3), w.plan_of(wrapper)) == "Story 3"


def test_names_lose_no_text_of_the_article():
    source = """<article><h1 class="post-header">Title</h1><h2 id="related-work">Related work</h2><p class="related-work">We</p><section class="social-policy"><p>Policy.</p></section><label>Label</label>
    <section id="navigation-systems"><h3 id="social-impact">Navigation &amp; systems</h3><p class=notice>Maps.</p></section><div class=widget>Gear</div><section class="comments"><p>Nice!</p></section></article>"""
    assert w.extract(source) == "Title\nRelated work\nWe\nPolicy.\nLabel\nNavigation & systems\nMaps.\nGear"


def test_what_is_alike_on_all_pages_of_a_host_goes_from_the_article():
    make = lambda k: f"<article><h1>T{k}</h1><p>Shared first sentence.</p><p>Story {k}</p><div class=x7>Follow us</div><p>More {k}</p></article>"
    plan = w.plan_of(w.infer([make(k) for k in range(3)]))
    assert w.extract(make(9), plan) == "T9\nShared first sentence.\nStory 9\nMore 9"
    assert "Follow us" in read([make(1), make(2)], make(1))  # two pages are no evidence


def test_a_constant_menu_does_not_vary():
    menu = "".join(f"<p><a href=/{k}>Entry {k}</a></p><h3>Part {k}</h3>" for k in range(6))
    make = lambda k: f"<body><div id=one>{menu}</div><div id=two><p>Story {k}</p></div>"
    assert read([make(k) for k in range(5)], make(9)) == "Story 9"
    flat = lambda k: make(k).replace("<h3>", "<p>").replace("</h3>", "</p>")
    assert read([flat(k) for k in range(5)], flat(9)) == "Story 9"


@pytest.mark.parametrize("unit", ["<a ", "<", "<!", "<a x='", '<a x=">" ', "</script ", "<script></script ", "<a\"'", "<div>", "<p class=x>", "&", "<!--", "<b <i"])
@pytest.mark.parametrize("tail", ["", ">", "\">", "'>", "<p>end"])
def test_broken_markup_takes_time_by_its_length(unit, tail):
    """A megabyte of tags that never end, of quotes that never close, of scripts without an end."""
    begun = time.process_time()
    w.parse(unit * (1_000_000 // len(unit)) + tail)
    assert time.process_time() - begun < 6


def test_a_megabyte_of_unclosed_tags_is_text():
    begun = time.process_time()
    assert w.extract("<p>text</p>" + "<a " * 333_000).startswith("text\n<a <a")
    assert time.process_time() - begun < 2


@pytest.mark.parametrize("source, names", [
    ("a < b <c d='>'>x</c> <3", ["c"]), ("<p title=it's>x<i>y", ["p", "i"]), ("<!-- <b> --><i>", ["i"]), ("<!doctype html><?xml ?><u>", ["u"]), ("<a\nhref='x'\n>t</a", ["a"]),
    ("<script>if (a<b) '</p>'</script><s>", ["script", "s"]), ("<b", []), ("<b><!-- x", ["b"]), ("<i x=\"1>2\" y='>\"'><u>", ["i", "u"]),
])
def test_tags(source, names):
    assert [w.tag_of(n) for n in w.parse(source).names[1:] if n != w.TEXT] == names


@pytest.mark.parametrize("box", ["article class=post", "div class=body"])
def test_blocks_of_an_article_that_all_pages_share_stay(box):
    """Heads of tables, labels, steps and quotes are text of the article; a constant box with a name is not, nor a list of links alone."""
    parts = "<table><tr class='head'><th>Name</th><th>Value</th></tr><tr><td>size</td><td>{k}</td></tr></table><dl><dt class='k'>Price</dt><dd>{k}0</dd></dl><ul><li class='step'>Preheat the oven</li><li>Bake {k}</li></ul><blockquote class='q'>To be or not</blockquote>"
    extra = "<div class='ad'>Buy now</div><ul class='share'><li><a href=/f>Share</a></li><li><a href=/t>Send</a></li></ul>"
    make = lambda k: f"<body><div class=top>Site</div><{box}><h1>Head {k}</h1><p>Story {k} goes on and on, in words of its own {k * k}.</p>{parts.format(k=k)}{extra}<p>End {k}</p></{box.split()[0]}><div class=foot>All rights reserved</div>"
    pages = [make(k) for k in range(2, 9)]
    plan = w.plan_of(w.infer(pages))
    for k, source in enumerate(pages, 2):
        assert w.extract(source, plan).split("\n") == [f"Head {k}", f"Story {k} goes on and on, in words of its own {k * k}.", "Name", "Value", "size", f"{k}", "Price", f"{k}0", "Preheat the oven", f"Bake {k}", "To be or not", f"End {k}"]


def test_plans_that_are_told_and_plans_that_are_joined_agree(spark, sf_dir, monkeypatch):
    rng = random.Random(5)
    made = [(k, f"https://h{k % 7}.example/{k}", unnamed(k, rng)[0]) for k in range(60)] + [(100, None, "<p>x"), (101, "https://h1.example/", None)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").coalesce(3)
    told = sorted(map(str, w.extract_pages(pages).collect()))
    monkeypatch.setattr(w.common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, w.extract_pages(pages).collect())) == told
