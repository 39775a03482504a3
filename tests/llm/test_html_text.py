import html
import re

from permlens.llm import html_text as ht
from tests.llm.conftest import key, passage, rows_of

P1, P2, P3 = passage(1), passage(2, 40), "Short one."


def page(body, head="<title>t</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var a='<p>no</p>'</script></head><body>{body}</body></html>"


def test_the_article_without_what_surrounds_it():
    around = "<nav><ul><li><a href=/>Home</a></li></ul></nav><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><aside>Read more</aside>"
    after = "<div class=comments><p>" + "I disagree. " * 60 + "</p></div><form><label>Name<input></label></form><div id=ad-1>Buy</div><footer>&copy; us</footer>"
    article = f"<h2>T &amp; T</h2><p>{P1}</p><!-- no --><ul><li>one <a href=x>link</a> in a long enough line</li><li>two</li></ul><p>{P3}<p>{P2}"
    want = f"T & T\n{P1}\none link in a long enough line\ntwo\n{P3}\n{P2}"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div><div id=content>{}</div></div>"):
        assert ht.extract(page(around + wrap.format(article) + after)) == want, wrap


def test_slugs_and_lists_of_links_of_an_article_stay():
    links = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    parts = [f"<section id='related-work'><h2 id='related-work-1'>Related</h2><p>{P1}</p></section>", f"<h2 id=how-to-share-files>How to share</h2><p id='login'>{P2}</p>", f"<div id=search-algorithms><p>{P3}</p></div>",
             "<h3 id='comments'>Heading</h3><h3><span id='Related'>Wrapped</span></h3><dl><dt id=search>term<dd>definition</dl>", f"<h2>Sources</h2>{links}"]
    cut = "<div id=comments>I disagree</div><div id='ad-1'>Buy</div><div class='share-buttons'>Share</div><div role=search>Find</div>"
    want = f"Related\n{P1}\nHow to share\n{P2}\n{P3}\nHeading\nWrapped\nterm\ndefinition\nSources\nFirst source\nSecond source"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<main><article id='related-work'>{}</article></main>"):
        assert ht.extract(page(f"<ul><li><a href=/>Home</a><li><a href=/x>News</a></ul>{wrap.format(''.join(parts) + cut)}<div id=related-posts>More</div>{links}")) == want, wrap
    plain = "".join(parts[:1]) + f"<h2 id=how-to-share-files>How to share</h2><p>{P2}</p>"
    assert ht.extract(page(f"<div class=post>{plain}</div><div id=related-posts>More</div>{links}")) == f"Related\n{P1}\nHow to share\n{P2}"


def test_classes_that_are_words_of_the_text_stay():
    kept = [
        ("<h2 class='section-header'>Results here</h2>", "Results here"), ("<h3 class='subsection header'>Next</h3>", "Next"), ("<p class='notice-text'>Take care.</p>", "Take care."),
        (f"<div class='search-results-discussion'><p>{P2}</p></div>", P2), ("<p class='social-science'>Science.</p>", "Science."), ("<div class='section-header'><h4>Wrapped</h4></div>", "Wrapped"),
        (f"<section class='related-work-of-others'><h2>Work</h2><p>{P3}</p></section>", f"Work\n{P3}"), ("<ul><li class='login-shell'>Shell</li></ul>", "Shell"), (f"<blockquote class='comment-of-the-day'>{P2}</blockquote>", P2),
        (f"<div class='header'><h3>Part</h3><p>{P3}</p></div>", f"Part\n{P3}"),
    ]
    gone = ["<div class='advert'>Buy</div>", "<p class='advert'>Buy now</p>", "<div class='ad ad-2'>Buy</div>", "<div class='share-buttons'>Share</div>", f"<section class='comments'><h3>Comments</h3><p>{P1}</p></section>",
            f"<div class='reader-comments'><p>{P1}</p></div>", "<div class='cookie-notice'>We use cookies</div>", "<div class='newsletter-signup'><h3>Subscribe</h3><p>Get it.</p></div>", "<ul class='related-posts'><li><a href=/>More</a></ul>",
            "<div class='search-hints'><a href=/>More</a></div>", "<div class='mt-4 social-share'><a href=/>x</a></div>", "<div role=navigation>Next</div>"]
    body = f"<h1>Title</h1><p>{P1}</p>" + "".join(k + g for (k, _), g in zip(kept, gone + [""] * 9)) + "".join(gone[len(kept) :]) + f"<p>{P1}</p>"
    want = "\n".join(["Title", P1, *(t for _, t in kept), P1])
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<main><article class='post has-comments'>{}</article></main>"):
        assert ht.extract(page("<nav><a href=/>Home</a></nav>" + wrap.format(body) + "<article class='related'>More</article><footer>us</footer>")) == want, wrap
    assert ht.extract(page(f"<div class=post><h2 class='subsection header'>Head</h2><p class='notice-text'>{P1}</p><p>{P2}</p></div><div class='site-footer-inner'>us</div>")) == f"Head\n{P1}\n{P2}"


def test_white_space_references_and_broken_markup():
    assert ht.extract("<p> a \n\t b&nbsp;c &#233;&lt;i&gt; <b>d<br>e</p><p>f") == "a b c é<i> d e\nf"
    assert ht.extract("plain text") == "plain text"
    assert [ht.extract(x) for x in (None, "", "<script>x", "<div class='", "<!-- x", "<!-- <p>x", "a < b <p")] == [""] * 6 + ["a < b"]


def test_depth_and_length_are_no_limit():
    assert ht.extract("<div>" * 20_000 + "<p>" + P1) == P1
    long = "\n".join(passage(i, 50) for i in range(2000))
    assert ht.extract(page("<article>" + "".join(f"<p>{x}</p>" for x in long.split("\n")) + "</article>")) == long
    assert ht.extract('<p a="' * 20_000) != None  # noqa: E711


def test_pages_of_the_given_table(spark, given):
    pages = spark.read.parquet(f"{given}/pages.parquet")
    for r in ht.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        parts = re.split("<(?:p|/p|h1|/h1)>", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, ""), (3, "v", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    want = [(i, u, ht.extract(h), len(ht.extract(h))) for i, u, h in rows]
    assert rows_of(ht.main_text(df), "page_id", "url", "text", "n_chars") == sorted(want, key=key)
    assert ht.main_text(df.limit(0)).count() == 0
