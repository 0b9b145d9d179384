"""Old report sheets in their five layouts, with odd rows, and what fails."""

import pytest

from ratingloom.operators import sheets as S

HEADS = [("platform first", ["Бренд", "Площадка", "Ссылка", "Продукт"]), ("link first", ["Бренд", " ссылка", "Продукт", ""]), ("one brand, link first", ["Ссылка", "Площадка", "Продукт", ""]), ("one brand, platform first", ["Площадка", "Ссылка", "Продукт", ""]), ("plain", ["Страница", "Продукт", "Тип"])]


def sheet(name, layout, head, title):
    """A title or none, the header, a row under it, a section, a product, a row without an address."""
    known = {"platform first": ["Зор", "x", "https://x.example/p/1", "Зор гель"], "link first": ["Зор", "https://x.example/p/1", "Зор гель", ""], "one brand, link first": ["https://x.example/p/1", "x", "Зор гель", ""], "one brand, platform first": ["x", "https://x.example/p/1", "Зор гель", ""], "plain": ["HTTPS://x.example/p/1", "Зор гель", ""]}[layout]
    rows = ([[title]] if title else []) + [head + ["Июнь 2025", "", "июль", "", "Итого"], [""] * len(head) + ["Отзывы", "Рейтинг"], ["Аптеки"], known + ["1 024", "4,5", "нет", "5"], ["Зор", "без ссылки"]]
    return [(name, r, c, text) for r, row in enumerate(rows) for c, text in enumerate(row) if text]


def test_layouts(spark):
    cells = [cell for layout, head in HEADS for title in ("", "Рейтинги", "ACME RATINGS", "Рейтинги за год") for cell in sheet(f"{layout}/{title}", layout, head, title)]
    frame = spark.createDataFrame(cells, "sheet string, row int, col int, text string")
    brands = spark.createDataFrame([(f"{layout}/{title}", b) for layout, _ in HEADS for title in ("", "Рейтинги", "ACME RATINGS", "Рейтинги за год") for b in (["Зор"] if "one" in layout else ["Зор", "Зор гель", "Икс"])], "sheet string, brand string")
    got = S.read_sheets(frame, 2026, brands).collect()
    assert len(got) == 40
    for r in got:
        assert r.sheet.split("/")[0] == r.layout and r.section == "Аптеки" and r.domain == "x.example" and r["product"] == "Зор гель"
        assert r.brand == ("Зор гель" if r.layout == "plain" else "Зор")
        assert (r.month, r.reviews, r.rating) in {("2025-06", 1024, 4.5), ("2026-07", None, 5.0)}
    assert {(r.first_month, r.last_month, len(r.months)) for r in S.products_of(S.read_sheets(frame, 2026, brands)).collect()} == {("2025-06", "2026-07", 2)}


def test_no_sheet(spark):
    frame = spark.createDataFrame([("a", 0, 0, "слова"), ("b", 5, 5, "x")], "sheet string, row int, col int, text string")
    assert S.read_sheets(frame, 2026).collect() == [] and {r.layout for r in S.layouts(frame).collect()} == {"plain"}
    assert S.read_sheets(frame.limit(0), 2026).collect() == []


def test_what_fails(spark, monkeypatch):
    twice = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 0, "y")], "sheet string, row int, col int, text string")
    with pytest.raises(Exception, match="(?i)duplicate"):
        S.read_sheets(twice, 2026).collect()
    monkeypatch.setattr(S, "MOST_CELLS", 1)
    with pytest.raises(Exception, match="over 1 cells"):
        S.read_sheets(spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y")], "sheet string, row int, col int, text string"), 2026).collect()
