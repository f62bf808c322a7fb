import itertools
import random

from quillon.llm import html_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site <a href=x>home</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies. Accept all of them now please, thanks.</div><!-- ad -->
<div class="ad">Buy this now. It is a very good thing and you will like it a lot, all of you.</div>
<div class=sidebar><p>Some long sidebar text about things that go on and on for a long while. It is here.</p></div>
<article><h1>Big &amp; bold</h1><p><b>First&nbsp;para &lt;x&gt; one<br>two.<br><p>Second.<ul><li>item one<li>item two</ul>
<form><label>Name</label><input></form><p hidden>secret</p><p>Ok.</p>
<section class="comments"><h3>Comments</h3><p>Great article, thanks a lot for writing it. I did enjoy it.</p></section></article>
<aside>Aside text.</aside><footer>&copy; me &middot; 2020</footer></body></html>"""


def test_page():
    assert html_cut.main_text(PAGE).split("\n\n") == ["Big & bold", "First para <x> one two.", "Second.", "item one", "item two", "Ok."]


def test_page_without_article():
    text = html_cut.main_text("<div><div class=nav><a>a</a><a>b</a></div><div><p>" + "word " * 40 + ".</p><p>Short.</p><p>" + "another " * 30 + ".</p></div><div class=footer>c 2020</div></div>")
    assert [b.split()[0] for b in text.split("\n\n")] == ["word", "Short.", "another"]


def test_names_of_the_layout():
    assert html_cut.main_text('<body class="has-comments"><div class="page-with-sidebar"><article><p>Words that stay.</p></article></div></body>') == "Words that stay."


def test_edges(spark):
    for page in (None, "", "   ", "<", "<p>", "</p></div>", "<!-- x", "<script>x", "<article></article>"):
        assert html_cut.main_text(page) == ""
    long = "<article>" + "<p>Some words.</p>" * 20_000
    assert html_cut.main_text(long).count("Some words.") == 20_000
    assert html_cut.main_text("<article>" + "<div>" * 3000 + "<p>Deep words.") == "Deep words."
    rows = [(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (2, None, None, None)]
    got = html_cut.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 69), (1, 69), (2, 0)]
    assert html_cut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def cost(side, sources, sinks, edges):
    return sum(b if s else a for s, a, b in zip(side, sources, sinks, strict=True)) + sum(c for u, v, c in edges if side[u] != side[v])


def test_cut_is_minimal():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(1, 8)
        sources, sinks = [rnd.randint(0, 9) for _ in range(n)], [rnd.randint(0, 9) for _ in range(n)]
        edges = [(u, v, rnd.randint(1, 6)) for u, v in itertools.combinations(range(n), 2) if rnd.random() < 0.5]
        best = min(cost(side, sources, sinks, edges) for side in itertools.product((False, True), repeat=n))
        assert cost(html_cut.minimum_cut(sources, sinks, edges), sources, sinks, edges) == best


def test_neighbours_decide_weak_blocks():
    # a lone short line is dropped; between long paragraphs of the same parent it stays
    assert html_cut.main_text("<div><p>Short</p></div>") == ""
    assert "Short" in html_cut.main_text("<div>" + "<p>" + "word " * 50 + ".</p><p>Short</p><p>" + "word " * 50 + ".</p></div>")


def test_wrapped_by_a_form():
    story = "<p>" + "word " * 40 + "end.</p><p>Short one.</p>"
    inner = f"<article><h1>Title</h1>{story}<form><p>Leave a reply. Your address will not be shown to anyone here.</p></form></article><form><p>Search this site now.</p></form>"
    want = ["Title", "word " * 40 + "end.", "Short one."]
    assert html_cut.main_text(f"<form action=x>{inner}</form>").split("\n\n") == want
    assert html_cut.main_text(inner).split("\n\n") == want
    # without an article, a form of most words wraps the page, a smaller one does not
    assert html_cut.main_text(f"<form>{story}</form>").split("\n\n") == want[1:]
    assert html_cut.main_text(f"{story}<form><p>Tell us here what you think of it.</p></form>").split("\n\n") == want[1:]


def test_names_of_content_beside_weak_ones():
    story = "<p>" + "word " * 40 + "end.</p>"
    assert html_cut.main_text(f'<div class="content widget">{story}</div>') == "word " * 40 + "end."
    assert html_cut.main_text(f'<div class="search"><article>{story}</article></div>') == "word " * 40 + "end."
    for names in ("content-sidebar", "entry-footer", "content ads", "story comments", "widget"):
        assert html_cut.main_text(f'<div class="{names}">{story}</div>') == ""


def test_story_beside_a_short_article():
    story = "<div>" + "".join("<p>" + f"word{i} " * 50 + "end.</p>" for i in range(6)) + "</div>"
    text = html_cut.main_text(f"<article><h2>Teaser</h2><p>Read this.</p></article>{story}<footer>me</footer>")
    assert [b.split()[0] for b in text.split("\n\n")] == ["Teaser", "Read", *[f"word{i}" for i in range(6)]]
    # beside the article that most words are in, other text is none of the story
    assert "teaser" not in html_cut.main_text(f"<article>{story}</article><div><p>A teaser for another story, which is long enough to be read.</p></div>")


def corpus(n=60):
    """Pages without articles, with their main texts: stories with short paragraphs among long ones, and lists of links."""
    rnd = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ber", "din", "fol", "gar")]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(n):
        story = [say(rnd.randint(25, 60))] + [say(rnd.choice((1, 2, 30, 50))) for _ in range(rnd.randint(2, 6))] + [say(rnd.randint(25, 60))]
        links = "".join(f"<li><a href=x>{rnd.choice(words)} {rnd.choice(words)}</a></li>" for _ in range(rnd.randint(3, 8)))
        notes = "".join(f"<p>{say(2)}</p>" for _ in range(rnd.randint(1, 3)))
        yield f"<body><div><ul>{links}</ul></div><section><div>{''.join(f'<p>{b}</p>' for b in story)}</div></section><div><span>{notes}</span></div></body>", "\n\n".join(story)


def test_cut_mends_what_costs_alone_get_wrong():
    by_cut = by_cost = 0
    for html, story in corpus():
        page = html_cut.Page(html)
        alone = [k > d for k, d in (html_cut.costs(b, page.share) for b in page.blocks)]
        by_cost += "\n\n".join(b.text for b, keep in zip(page.blocks, alone, strict=True) if keep) == story
        by_cut += html_cut.main_text(html) == story
    assert by_cut >= 54 > 30 > by_cost


def test_classifier_is_learned_from_marked_pages(spark):
    rows = []
    for i, (html, story) in enumerate(corpus(80)):
        body = "".join(f"<p>{b}</p>" for b in story.split("\n\n"))
        notes = html.split("<span>")[1].split("</span>")[0]
        rows.append((i, f"<nav><ul><li><a href=x>{i} more</a><li><a href=y>all of it</a></ul></nav><article>{body}</article><div class=ad>{3 * notes}</div><footer><p>Mine {i}</p></footer>"))
    frame = spark.createDataFrame(rows, "page_id long, html string")
    weights = html_cut.fit(frame)
    assert weights != html_cut.DEFAULT and len(weights) == len(html_cut.DEFAULT)
    assert weights[0] > 0 > weights[2]  # words speak for content, links against it
    assert html_cut.fit(frame.unionByName(frame)) == weights  # repeated pages do not move it
    # pages that show one kind only, or none, teach nothing
    assert html_cut.fit(frame.limit(0)) == html_cut.fit(spark.createDataFrame([(1, None), (2, "<article><p>x")], "page_id long, html string")) == html_cut.DEFAULT
    # on pages without marks it tells the story from the rest
    assert sum(html_cut.main_text(html, weights) == story for html, story in corpus()) >= 40
