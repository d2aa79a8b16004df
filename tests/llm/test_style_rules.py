"""Rules of style sheets: of other media, later and stronger ones."""

import pytest

from leadtide.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>@media print{.nav{display:none}}</style><p class=nav>menu", "menu"),
        ("<style>@media (max-width:600px){aside,.side{display:none}}</style><aside>one</aside><p class=side>two", "one\n\ntwo"),
        ("<style>@media screen and (max-width:600px){.a{display:none}} .b{display:none}</style><p class=a>a<p class=b>b", "a"),
        ("<style>@media screen{.a{display:none}} @media print,all{.b{display:none}}</style><p class=a>a<p class=b>b<p>c", "c"),
        ("<style>@media print{@media all{.a{display:none}}} @layer x{.b{display:none}}</style><p class=a>a<p class=b>b", "a"),
        ("<style>@import 'x{';@font-face{font-family:x}.a{content:'}';display:none}</style><p class=a>a<p>b", "b"),
        ("<style media=print>.a{display:none}</style><p class=a>a", "a"),
        ("<style>.a{display:none}.a{display:block}</style><p class=a>a", "a"),
        ("<style>.a{display:none;display:block}.b{display:block;display:none}</style><p class=a>a<p class=b>b", "a"),
        ("<style>.b{display:block}.a{display:none}</style><p class='a b'>a<p class='b a'>b<p>c", "c"),
        ("<style>.a{display:none}</style><p class=a style='display:block'>a", "a"),
        ("<style>.a{display:none!important}</style><p class=a style='display:block'>a<p>b", "b"),
        ("<style>p{display:none}.a{display:inline-block}</style><p class=a>a<p>b", "a"),
        ("<style>.a{display:none;display:bogus}</style><p class=a>a<p>b", "b"),
    ],
)
def test_style_rules_of_other_media_and_later_ones(page, text):
    assert html_text.page_text(page) == text
