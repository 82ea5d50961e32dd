"""Markup to structured text: nothing that elements part is fused, lists nest and count, entities are read."""

import pytest

from lodestack.functions.html import structured_text, to_text

CASES = [
    ("<strong>You will:</strong><strong>Growth Systems &amp; Product Ownership</strong><ul><li>Own it</li></ul>", "You will:\nGrowth Systems & Product Ownership\n\n- Own it"),
    ("<span><span>You will:</span><span>Growth</span></span>", "You will:\nGrowth"), ("<p>Bay Area or<b>New York City</b></p>", "Bay Area or New York City"),
    ("<p>This is <strong>bold</strong>face text.</p>", "This is boldface text."), ("<p>See <a href='http://x'>our site</a> for more.</p>", "See our site for more."),
    ("<p>Health Coverage: Full medical. Note: details vary by state.</p>", "Health Coverage: Full medical. Note: details vary by state."),
    ("<ol><li>a<ul><li>b</li><li>c<br>d</li></ul></li><li>e</li></ol><p>x&#8217;y &ndash; z&rsquo;</p>", "1. a\n  - b\n  - c\n    d\n2. e\n\nx’y – z’"),
    ("<ul><li><p>From scratch.</p><p>Role Details:</p><p>Employment Type: Full Time, Exempt</p></li><li>next</li></ul>", "- From scratch.\n\nRole Details:\n\nEmployment Type: Full Time, Exempt\n- next"),
    ("a<br><br>b<br/>c", "a\n\nb\nc"), ("<ul><li>a<li>b</ul>t", "- a\n- b\n\nt"), ("<script>var t='</p>'</script><style>x</style><!-- c --><noscript>n</noscript><p>k", "k"),
    ("<ul> stray <li>a</li></ul>", "- a"), ("<b></b>Text. <i>Next</i>", "Text. Next"), ("", ""), (None, ""), ("</ul></li></p>", ""), ("<p>a\n  b</p>", "a\nb"),
]


@pytest.mark.parametrize(("markup", "text"), CASES)
def test_vectors(markup, text):
    assert to_text(markup) == text


def test_column(spark):
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CASES)], "i int, html string")
    assert [r[1] for r in rows.select("i", structured_text("html")).orderBy("i").collect()] == [t for _, t in CASES]


def test_deep_markup_ends():
    assert to_text("<div>" * 5000 + "x" + "<ul><li>" * 300 + "y").count("y") == 1
