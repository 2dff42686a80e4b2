"""Copies beside copies, and class names that only look like page furniture."""

import pytest

from wardline.llm import pages


@pytest.mark.parametrize("others", [3, 40])
def test_runs_of_copies_lose_the_menu(spark, others):
    t = "<main><p>Menu home<p>Menu shop<p>{}<p>Made by us</main>"
    article = [f"sentence {k} of the article" for k in range(12)]
    rows = [(i, f"http://h/a/{i:03}", t.format("<p>".join([*article, f"edit {i}"]))) for i in range(30)]
    rows += [(100 + i, f"http://h/b/{i:03}", t.format("<p>".join(f"own {i} {k}" for k in range(8)))) for i in range(others)]
    rows += [(300 + i, f"http://only/{i:03}", t.format("<p>".join([*article, f"edit {i}"]))) for i in range(12)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == "\n".join([*article, f"edit {i}"]) for i in range(30))
    assert all(got[100 + i] == "\n".join(f"own {i} {k}" for k in range(8)) for i in range(others))
    assert all(got[300 + i].startswith("Menu home") and article[0] in got[300 + i] for i in range(12))  # a host of copies only: nothing to differ from


@pytest.mark.parametrize(
    ("name", "stays"),
    [("notice-period", True), ("ad", False), ("big ad", False), ("ad-slot", False), ("cookie-banner", False), ("share-buttons", False), ("comments-2", False), ("social-history", True), ("commentary", True), ("related_links", False), ("sidebar-left", False), ("alert-system", True), ("footer", False), ("story-promotion", True)],
)
def test_class_names(name, stays):
    page = f"<article><p>first<div class='{name}'><p>second</div><p>third</article>"
    assert pages.text_lines(page)[0] == (["first", "second", "third"] if stays else ["first", "third"])
