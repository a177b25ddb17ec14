"""Work per token of the main-text operator: what repeats is parsed and hashed once, odd attributes are not remembered."""

from gridtally.llm import htmltext as H

PAGE = "<html><body>" + "<div class='row item'><p id=x>some text</p></div>" * 500 + "</body></html>"


def test_repeated_tags_are_hashed_once(monkeypatch):
    calls = []
    digest = H.xxhash.xxh64_intdigest

    class Counted:
        @staticmethod
        def xxh64_intdigest(data):
            calls.append(data)
            return digest(data)

    want = [H.signature(*t) for t in H.paired(PAGE)]
    monkeypatch.setattr(H, "xxhash", Counted)
    assert [H.signature(*t) for t in H.paired(PAGE)] == want
    assert len(calls) == 500 and len(want) == 2504  # the texts alone


def test_long_attributes_are_not_remembered():
    before = H._known_marks.cache_info().currsize, H._known_hash.cache_info().currsize
    long = "k" * 1000
    got = list(H.tokens(f"<div class='{long}'>a</div><section id='one two'>"))
    assert got[0] == ("open", "div", frozenset([long, "." + long])) and got[2] == ("close", "div", frozenset())
    assert got[3] == ("open", "section", frozenset(["one", "two", ".one", ".two"]))
    sigs = [H.signature(*t) for t in got]
    assert len(set(sigs)) == 4
    after = H._known_marks.cache_info().currsize, H._known_hash.cache_info().currsize
    assert after[0] - before[0] <= 1 and after[1] - before[1] <= 2


def test_blocks_are_kept_apart():
    page = "<article><p>a<b>b</b>c</p><p>d</p>e<br>f<i> g</i></article><div>h</div>"
    assert H.main_text(page, frozenset()) == "abc d e f g"
    assert H.main_text("x<p>y</p>z", frozenset()) == "x y z"
