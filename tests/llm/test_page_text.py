"""Main text of pages: the path threshold decides, elements and names only where they say so, in linear time."""

import math
import time

import numpy as np
import pytest

from stagewise.llm import htmltext

STORY = [f"The council met again on day {i}, and after long debate, the members agreed: the bridge will be rebuilt, slowly." for i in range(6)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in STORY)
WHOLE = "\n\n".join(STORY)


def test_story_in_plain_elements_beside_an_article_card():
    page = f"<body><div class=page><div class=story>{PARAGRAPHS}</div><article class=card><p>Read this too</p></article></div></body>"
    assert htmltext.main_text(page) == WHOLE
    divs = "".join(f"<div>{t}</div>" for t in STORY)
    assert htmltext.main_text(f"<body><div class=story>{divs}</div><article class=card><h3>Teaser</h3><p>Read this too</p></article></body>") == WHOLE


def test_unnamed_link_lists_inside_an_article_are_left_out():
    links = "<ul><li><a href=a>Ten cheap phones</a></li><li><a href=b>Win a holiday now</a></li></ul><div><a href=c><b>Buy one, get one free!</b></a></div>"
    assert htmltext.main_text(f"<body><article><h1>Bridge</h1>{PARAGRAPHS}{links}</article></body>") == "Bridge\n\n" + WHOLE
    own = "<ul><li>Costs: two million</li><li>Start: May</li></ul>"
    assert htmltext.main_text(f"<body><article>{PARAGRAPHS}{own}</article></body>") == WHOLE + "\n\nCosts: two million\n\nStart: May"


def test_names_are_judged_whole():
    page = f"<body><div id=main><div class='entry-header'><h1>Bridge</h1></div><section class='legal-analysis'>{PARAGRAPHS}</section></div></body>"
    assert htmltext.main_text(page) == "Bridge\n\n" + WHOLE
    for name in ("site-header", "footer", "main-nav", "post-comments", "comment-42", "cookieBanner", "social share", "newsletter-signup"):
        junk = f"<div class='{name}'><p>{STORY[0].replace('council', 'club')}</p></div>"
        assert htmltext.main_text(f"<body>{junk}<div class=story>{PARAGRAPHS}</div></body>") == WHOLE, name


def test_path_ratios_against_a_plain_reckoning():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40):
        at = np.unique(rng.integers(0, 5, n), return_inverse=True)[1]
        length, marks, weight = rng.integers(1, 300, n).astype(float), rng.integers(0, 9, n).astype(float), rng.choice([1.0, 2.0], n)
        groups = {p: [i for i in range(n) if at[i] == p] for p in set(at.tolist())}

        def smooth(values):
            line = [sum(values[j] for j in groups[at[i]]) / len(groups[at[i]]) for i in range(n)]
            out = []
            for i in range(n):
                near = {j: math.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 1} if n > 2 else {i: 1.0}
                out.append(sum(w * line[j] for j, w in near.items()) / sum(near.values()))
            return out

        a, b = smooth(length), smooth(marks)
        wanted = [sum(weight[i] * math.sqrt(a[i] * (1 + b[i])) for i in groups[p]) / len(groups[p]) for p in sorted(groups)]
        assert np.allclose(htmltext.path_ratios(at, length, marks, weight=weight), wanted)


@pytest.mark.parametrize("unit", [
    "<div>x", "<a '", "<a \">\" ", "<b>x", "<i><b></i>", "<div><dt>x</dt>", "<svg>", "<li>x<div>", "</div>x", "<p>x<b>", "<ul><li>x", "<a class=", "<", "<!--", "&amp", "<td><p>", "<a>x<div>",
])
def test_a_megabyte_of_odd_markup_is_read_in_linear_time(unit):
    def seconds(size):
        page, start = unit * (size // len(unit)), time.process_time()
        htmltext.main_text(page)
        return time.process_time() - start

    seconds(10_000)
    small, large = seconds(125_000), seconds(1_000_000)
    assert large < 24 * small + 0.5, (small, large)
