"""Pages without the optional end of the head."""

import pytest

from tallyspark.llm import html_extract


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<noscript><link rel=x></noscript><body class=b><p>", "<noscript><body><p>", "<img src=x>", ""])
def test_page_without_the_end_of_its_head(start):
    html = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>not this</title><style>p {{}}</style>\n{start}The text of the page.<p>And more of it."
    assert [b.text for b in html_extract.blocks(html)] == ["The text of the page.", "And more of it."]


def test_a_closed_head_stays_out():
    html = "<html><head>\n<title>no</title><noscript>no</noscript><script>no</script>\n</head><body><p>yes</body></html>"
    assert [b.text for b in html_extract.blocks(html)] == ["yes"]
