"""What an article keeps although a word of its attributes marks other things elsewhere (op5)."""

import pytest

from gridtally.llm import htmltext


@pytest.mark.parametrize("inner, text", [
    ('<h2 class="section-header">Head</h2><p>x</p>', "Head x"),
    ('<h2 id="comments">Head</h2><p>x</p>', "Head x"),
    ('<section id="search-index">index</section>', "index"),
    ('<div id="related-work"><p>earlier work</p></div>', "earlier work"),
    ("a <math class='widget'><mi>y</mi><mo>=</mo></math> b", "a y = b"),
    ("a <object><p>other form</p></object> b <svg><text>label</text></svg>", "a other form b label"),
    ('a <div class="ad wide">buy</div><div id="newsletter">mail</div> b', "a b"),
    ('a <nav>menu</nav><section class="comments"><p>c</p></section> b', "a b"),
])
def test_inside_an_article(inner, text):
    assert htmltext.main_text(f"<body><div class='top-ad'>no</div><svg><title>no</title></svg><article>{inner}</article></body>", frozenset()) == text


def test_outside_an_article():
    assert htmltext.main_text("<svg><title>no</title></svg><object>no</object><div class='top-ad'>no</div><p>yes</p><math><mi>x</mi></math>", frozenset()) == "yes x"
