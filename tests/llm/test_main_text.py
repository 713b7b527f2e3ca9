"""Main text of pages that the shared tables do not have."""

import pytest

from vitrine.llm.main_text import main_text

MENU = "<ul>" + "<li><a href=x>Link text of a menu</a></li>" * 9 + "</ul>"


@pytest.mark.parametrize(("page", "text"), [
    (f"{MENU}<p>Closed on Monday, the shop opens again on Tuesday at nine.</p>{MENU}", "Closed on Monday, the shop opens again on Tuesday at nine."),
    ("<p>Rose,</p><p>oh pure</p><p>contradiction</p>", "Rose,\n\noh pure\n\ncontradiction"),
    (f"{MENU}<ul><li>Milk</li><li>Bread</li></ul>", "Milk\n\nBread"),
    (f"<p>{'long text ' * 30}</p>{MENU}<p>Imprint</p>", ("long text " * 30).strip()),
    (MENU, ""),
])
def test_strongest_block_of_short_pages_is_kept(page, text):
    assert main_text(page) == text


STORY = [f"Paragraph {i} of the story, which stands in plain blocks and goes on for a while, as stories do." for i in range(6)]
PLAIN = "<div>" + "".join(f"<p>{p}</p>" for p in STORY) + "</div>"
TEASERS = "".join(f"<article><h3><a href=x>Other story {i}</a></h3><p>In short.</p></article>" for i in range(3))


@pytest.mark.parametrize("page", [TEASERS + PLAIN, PLAIN + TEASERS, TEASERS + PLAIN + TEASERS, f"<main>{PLAIN}{TEASERS}</main>", f"<main>{TEASERS}</main>{PLAIN}"])
def test_story_beside_article_teasers(page):
    assert main_text(page) == "\n\n".join(STORY)


def test_windows_decide_inside_and_outside_of_an_article():
    links = "".join(f"<p><a href=x>More of this {i}</a></p>" for i in range(5))
    page = f"<p>Skip to the text</p><article><p>{STORY[0]}</p><p>Short.</p>{links}</article><p>Share</p>"
    assert main_text(page) == f"{STORY[0]}\n\nShort."
    assert main_text(f"<article><p>{STORY[0]}</p></article>{links}<div>{STORY[1]}</div>") == f"{STORY[0]}\n\n{STORY[1]}"


def test_short_first_lines_of_an_article_are_kept():
    assert main_text(f"<article><h1>Rech.</h1>{'<p>Les Rech.</p>' * 9}<p>{STORY[0]}</p></article>") == "\n\n".join(["Rech.", *["Les Rech."] * 9, STORY[0]])


@pytest.mark.parametrize("opening", [
    '<div style="overflow:hidden">', '<div title="the hidden truth">', '<div data-id="ad" data-class="menu">', "<div title='class=\"ad\"'>", "<div data-x=/a/hidden/id=ad>",
    '<div class="content has-sidebar">', '<div class="post no-comments with-nav">', '<div class="elementor-widget">', '<div class="widget"><section>', '<div id="left-sidebar-wrap">',
])
def test_containers_that_only_look_like_parts_are_kept(opening):
    story = "".join(f"<p>{p}</p>" for p in STORY)
    assert main_text(f"{opening}{story}</div>") == "\n\n".join(STORY)


def test_blocks_of_one_doubted_name_are_kept_and_real_parts_are_not():
    widgets = "".join(f'<div class="elementor-widget"><p>{p}</p><div class="share">Share this text with friends</div></div>' for p in STORY)
    assert main_text(widgets) == "\n\n".join(STORY)
    parts = ['<div class="left-sidebar">', '<div id=comments>', "<div class='box ad'>", "<div hidden>", '<p aria-hidden="true">', "<div role=banner>", '<div title="a > b" class="cookie-box">', '<span class="related_posts">']
    for part in parts:
        end = "</" + part[1:].split()[0].strip(">") + ">"
        assert main_text(f"{PLAIN}{part}{STORY[0]}{end}<p>End.</p>") == "\n\n".join([*STORY, "End."]), part
        assert main_text(f"{part}{STORY[0]}{end}{PLAIN}") == "\n\n".join(STORY), part
    assert main_text('<div class="ad">Buy this, it is longer.</div><article><p>Tiny.</p></article>') == "Tiny."
    assert main_text('<div class="alert">Closed today.</div>') == "Closed today."


@pytest.mark.parametrize(("between", "text"), [
    ('<svg class="i"/>', "A\n\nrest"), ("<svg-icon></svg-icon>", "A\n\nrest"), ("<title-bar>Bar</title-bar>", "A\n\nBar\n\nrest"), ("<object-view/>", "A\n\nrest"),
    ('<canvas id="c">', "A\n\nrest"), ("<object data=x>", "A\n\nrest"), ("<svg><path d='M0'/><svg><text>no</text></svg>no</svg>", "A\n\nrest"),
    ("<svg><p>B</p><svg>no</svg>", "A\n\nB\n\nrest"), ('<svg data-x="a/>b"><text>no</text></SVG >', "A\n\nrest"), ("<script>var a='<svg>';</script>", "A\n\nrest"),
    ("<object data=a><p>no</p><object data=b>no</object></object>", "A\n\nrest"), ("</svg>", "A\n\nrest"), ("<script>no", "A"),
])
def test_embedded_elements_end_where_they_end(between, text):
    assert main_text(f"<p>A</p>{between}<p>rest</p>") == text
    assert main_text("<p>A <svg><text>no</text></svg>B</p>") == "A B"
