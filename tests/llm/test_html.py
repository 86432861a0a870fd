"""Pages whose markup leaves out end tags, or whose attributes only look like marks."""

from __future__ import annotations

import pytest

from linkwatch.llm.html_text import article_text

LONG = "Some long text of an article, with many words in it, which goes on for a while."
PARTS = f"<p>First. {LONG}</p><p>Second. {LONG}</p><p>Third. {LONG}</p>"
WANT = [f"{x}. {LONG}" for x in ("First", "Second", "Third")]


@pytest.mark.parametrize("before", ['<p class="share">Share this', '<ul><li class="related">x<li>y</ul>', "<div><div class=ad>Buy now</div></div>", "<div><nav>Menu</div>", "<div><aside>Aside</div>", "<nav>Menu", "<aside>Aside", "<div class=ad>Buy"])
def test_open_parts_end_where_others_do(before):
    got = article_text(f"<body><div>{before}{PARTS}</div></body>").split("\n")
    assert [x for x in got if x in WANT] == WANT
    assert "Share this" not in got and "x" not in got


@pytest.mark.parametrize("attribute", ['href="/the-hidden-life"', 'title="A hidden gem"', 'alt="hidden"', 'data-hidden="false"', 'href="/p?id=comments"'])
def test_values_of_other_attributes(attribute):
    assert article_text(f"<body><div>{PARTS}<p {attribute}>More {LONG}</p></div></body>").split("\n") == [*WANT, f"More {LONG}"]


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-sidebar content", "elementor-widget", "social-issues", "widget", "sidebar-box"])
def test_containers_of_the_text(mark):
    assert article_text(f'<body><div class="{mark}">{PARTS}</div><div class="sidebar">Other</div></body>').split("\n") == WANT


@pytest.mark.parametrize("mark", ["ad-box", "related-posts", "comments", "comment-12", "shareButtons", "sidebar left", "social_share"])
def test_parts_left_out(mark):
    assert article_text(f'<body><div>{PARTS}<div class="{mark}">Something else, not of it.</div></div></body>').split("\n") == WANT
    assert article_text(f"<body><div>{PARTS}<div hidden>Something else</div></div></body>").split("\n") == WANT


def test_link_blocks_stay_in_the_article():
    page = f"<body><article>{PARTS}<p><a href=a>A paragraph that is a link</a></p><ul><li><a href=b>One</a><li><a href=c>Two</a></ul></article></body>"
    assert article_text(page).split("\n") == [*WANT, "A paragraph that is a link", "One", "Two"]


def test_quotes_in_attributes():
    assert article_text("<body><p title=it's>First one here, with words.</p><p>Don't stop</p><p>LAST</p></body>").split("\n") == ["First one here, with words.", "Don't stop", "LAST"]
    assert article_text(f"""<body><div data-x='a > b' title = "c > d" y=e"f>{PARTS}</div></body>""").split("\n") == WANT


@pytest.mark.parametrize(
    "mark",
    "article-comments user-comments reader-comments comment-thread c-comments user-reviews responses discussion google-ads sponsored-content related-content promo-card privacy-notice cookie-policy breaking-alert".split(),
)
def test_parts_left_out_of_the_article(mark):
    other = f'<div class="{mark}"><p>Something else, not of it.</p></div>'
    assert article_text(f"<body><article>{PARTS}{other}</article></body>").split("\n") == WANT


def test_comments_by_their_property():
    assert article_text(f"<body><article>{PARTS}<div itemprop=comment>Something else</div></article></body>").split("\n") == WANT


def test_end_tags_without_a_start_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        assert article_text("<body>" + "<span>" * n + "</b>" * n + "<p>text</p></body>") == "text"
        return time.process_time() - began

    seconds(1000)
    assert seconds(16_000) < 16 * seconds(2000) + 0.5
