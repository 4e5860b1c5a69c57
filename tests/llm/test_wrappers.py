"""Class names and forms that wrap the text of a page, or stand beside it."""

import pytest

from strandlake.llm import html_text

TEXT = "The first paragraph says a good deal about rivers, stones and lamps."
MORE = "The second paragraph says some more about clouds, streets and harbours."
BODY = f"<p>{TEXT}</p><p>{MORE}</p>"
WANT = f"{TEXT}\n{MORE}"
LONG = "<p>I disagree with all of this, and I will say so at length.</p>" * 9


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<div class="layout with-sidebar"><article>{BODY}</article></div>', WANT),
        (f'<div id="page" class="site no-sidebar">{BODY}</div>', WANT),
        (f'<div class="overlay"><article>{BODY}</article></div>', WANT),
        (f'<div class="page-widget">{BODY}</div>', WANT),
        (f'<article><h2 class="section-header">Part</h2>{BODY}</article>', f"Part\n{WANT}"),
        (f'<article><div class="post-header"><h2>Part</h2></div>{BODY}</article>', f"Part\n{WANT}"),
        (f'<form id="aspnetForm"><input name="q"><div>{BODY}</div></form>', WANT),
        (f'<div>{BODY}</div><form>Your name<input></form>', WANT),
        (f'<article>{BODY}</article><div class="comments">{LONG}</div>', WANT),
        (f'<article>{BODY}</article><div class="comments"><article class="comment">{LONG}</article></div>', WANT),
        (f'<article>{BODY}<div class="share">Share this</div></article>', WANT),
        # compounds name topics, unless all their words are roles and layout
        *((f"<article>{BODY}<{tag}>{TEXT}</{tag.split()[0]}></article>", f"{WANT}\n{TEXT}") for tag in (
            'h2 class="search-engines"', 'section class="menu-planning"', 'div id="social-history"', 'div class="notice-board"', 'p class="toc"', 'div class="related"', 'h3 class="menu"')),
        *((f'<article>{BODY}<div class="{name}">Gone</div></article>', WANT) for name in ("site-footer", "comment-list", "cookie_banner", "ad", "left-ad-slot", "toc", "nav-links", "related")),
        # a main element around junk does not make it text
        (f'<main><div>{BODY * 3}</div><div><a href="/">All</a> <a href="/">more</a></div></main>', "\n".join([WANT] * 3)),
    ],
)
def test_wrappers(page, text):
    assert html_text.main_text(f"<body>{page}</body>") == text
