"""Articles keep their short blocks, and names weigh but do not decide."""

import pytest

from seqloom.llm import html

TEXT = "".join(f"<p>Paragraph number {i} has a good deal of text in it, with commas, and more. It goes on for a while, so that it is long.</p>" for i in range(5))
PLAIN = " ".join(f"Paragraph number {i} has a good deal of text in it, with commas, and more. It goes on for a while, so that it is long." for i in range(5))
FRAMES = (
    ("<body><nav><a>Home</a></nav><article>", "</article><div class=comments><p>Nice one, really. I liked it, a lot!</p></div></body>"),
    ("<body><div class='nav'>Home</div><div id='x'>", "</div><footer>Legal.</footer></body>"),
    ("<header>Site</header><main><div>", "</div><aside>More, from us.</aside></main><div class='cookie notice'>We use cookies, as you know. Yes?</div>"),
)
SHORT = {
    "<ul><li>one egg</li><li>two</li></ul>": "one egg two",
    "<table><tr><td>cell a</td><td>cell b</td></tr></table>": "cell a cell b",
    "<pre>x = 1</pre>": "x = 1",
    "<blockquote>two words</blockquote>": "two words",
    "<figure><img src=a><figcaption>A caption</figcaption></figure>": "A caption",
    "<dl><dt>term</dt><dd>meaning</dd></dl>": "term meaning",
    "<section><h2>Head</h2><p>Short.</p></section>": "Head Short.",
    "<div>short</div>": "short",
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("part", SHORT)
def test_short_blocks_stay(frame, part):
    assert html.main_text((frame[0] + TEXT + part + frame[1]).encode()) == f"{PLAIN} {SHORT[part]}"


@pytest.mark.parametrize("name", ["post-content related-story", "promo story", "recommended reading"])
@pytest.mark.parametrize("frame", FRAMES[:1])
def test_long_text_outweighs_a_doubtful_name(frame, name):
    assert html.main_text((frame[0] + f"<div class='{name}'>{TEXT}</div>" + frame[1]).encode()) == PLAIN


def test_a_named_article_is_the_article():
    assert html.main_text(f"<body><article class='banner-news'>{TEXT}</article><div class=ad>Buy now, today!</div></body>".encode()) == PLAIN


@pytest.mark.parametrize("name", ["comments", "related", "sponsored", "share", "sidebar", "newsletter"])
def test_named_parts_inside_go(name):
    assert html.main_text(f"<article>{TEXT}<div class='{name}'><p>One more thing, for you. Look here, please!</p></div></article>".encode()) == PLAIN


def test_headings_around_the_content_come_along():
    assert html.main_text(f"<body><h1>Title</h1><div class=menu><h2>No</h2>a b</div><div>{TEXT}</div></body>".encode()) == f"Title {PLAIN}"


def test_lists_of_links_go_and_lists_with_links_stay():
    menu = "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(8))
    assert html.main_text(f"<main>{TEXT}<ul>{menu}</ul></main>".encode()) == PLAIN
    assert html.main_text(f"<main>{TEXT}<ul><li>see <a href=x>this</a> and that</li></ul></main>".encode()) == PLAIN + " see this and that"
