"""Documents whose shape makes retrieval or reading go wrong, as cells and texts with questions, the answer that is right and
the one that is taken for it. Made of numbers alone, so they are the same everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELLS = "grid_id string, row int, col int, header boolean, text string, color string"
QUESTIONS = "query_id int, question string, expect string, reject string"


def _value(row: int, col: int) -> str:
    return f"{(row * 37 + col * 11) % 89 + 10}.{(row * 7 + col * 3) % 10}"


def dense_two_headers(spark: SparkSession, rows: int = 6, groups: int = 3, each: int = 2) -> tuple[DataFrame, DataFrame]:
    """(cells, questions): a grid below two header rows, the first over `each` columns, whose cells look alike."""
    width = groups * each
    cells = [("dense", 0, 1 + g * each, True, f"Zone {g + 1}", None) for g in range(groups)] + [("dense", 1, 1 + c, True, f"Tier {c % each + 1}", None) for c in range(width)]
    cells += [("dense", 2 + r, 0, False, f"Item {r + 1}", None) for r in range(rows)] + [("dense", 2 + r, 1 + c, False, _value(r, c), None) for r in range(rows) for c in range(width)]
    asked = [(r, f"What does item {r + 1} cost in zone {r % groups + 1}, tier {r % each + 1}?", _value(r, r % groups * each + r % each), _value(r, (r % groups * each + r % each + 1) % width)) for r in range(rows)]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(asked, QUESTIONS)


def multilevel_table(spark: SparkSession, years: int = 2, parts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cells, questions): years over quarters over measures, three header rows deep."""
    width = years * parts * 2
    cells = [("levels", 0, 1 + y * parts * 2, True, str(2020 + y), None) for y in range(years)] + [("levels", 1, 1 + q * 2, True, f"Q{q % parts + 1}", None) for q in range(years * parts)]
    cells += [("levels", 2, 1 + c, True, ("Plan", "Actual")[c % 2], None) for c in range(width)] + [("levels", 3, 0, False, "Total", None)] + [("levels", 3, 1 + c, False, _value(3, c), None) for c in range(width)]
    asked = [(c, f"What was the {('planned', 'actual')[c % 2]} total of Q{c // 2 % parts + 1} {2020 + c // 2 // parts}?", _value(3, c), _value(3, c ^ 1)) for c in range(width)]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(asked, QUESTIONS)


def band_table(spark: SparkSession, bands: int = 8, window: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, text), questions): a table of distance bands cut into windows that overlap, so that a band stands in
    several texts, the bands first and their prices after."""
    line = [(f"{b * 5} to {b * 5 + 5} km", _value(b, 1)) for b in range(bands)]
    texts = [(w, "\n".join(f"{band}: {price}" for band, price in line[w : w + window])) for w in range(bands - window + 1)]
    asked = [(b, f"What is the price of {b * 5 + 2} km?", line[b][1], line[(b + 1) % bands][1]) for b in range(bands)]
    return spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(asked, QUESTIONS)


def scan_page(spark: SparkSession, lines: int = 40, degenerate: bool = False) -> DataFrame:
    """Blocks (doc_id, page, ord, text) of a scan, as a model reads it; a degenerate reading says the same over and over."""
    return spark.createDataFrame([(1, 1, k, "the same line" if degenerate and k % 5 else f"Paragraph {k + 1} says {_value(k, 0)}.") for k in range(lines)], "doc_id int, page int, ord int, text string")


def two_hops(spark: SparkSession, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, questions): the answer needs a text that only another text names."""
    texts = [(2 * i, f"The permit of depot {i + 1} is kept under code K{i * 7 % n}.") for i in range(n)] + [(2 * i + 1, f"Code K{i} runs out in {2030 + i}.") for i in range(n)]
    asked = [(i, f"When does the permit of depot {i + 1} run out?", str(2030 + i * 7 % n), str(2030 + (i * 7 + 1) % n)) for i in range(n)]
    return spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(asked, QUESTIONS)
