"""Reading order, paragraphs, headings, furniture and books on small laid-out pages."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quirework.operators import assemble, cover, epub_validate, furniture, headings, paragraphs, reading_order
from quirework.plans import convert
from quirework.sources import epub, epub_write


def _block(k: int, x0: float, y0: float, x1: float, y1: float) -> dict:
    return {"block_order": k, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def _order(*blocks: dict) -> list[int]:
    return [b["block_order"] for b in reading_order.page_order(list(blocks))]


def test_two_columns_are_read_one_after_the_other():
    left = [_block(k, 72, 100 + 50 * k, 280, 140 + 50 * k) for k in range(3)]
    right = [_block(10 + k, 320, 100 + 50 * k, 530, 140 + 50 * k) for k in range(3)]
    title = _block(20, 72, 40, 530, 80)
    assert _order(*right, *left, title) == [20, 0, 1, 2, 10, 11, 12]


def test_full_width_block_cuts_columns_into_bands():
    left = [_block(k, 72, 100 + 100 * k, 280, 140 + 100 * k) for k in range(2)]
    right = [_block(10 + k, 320, 100 + 100 * k, 530, 140 + 100 * k) for k in range(2)]
    assert _order(*left, *right, _block(30, 72, 150, 530, 190)) == [0, 10, 30, 1, 11]


def test_one_column_goes_by_rows():
    assert _order(_block(0, 210, 104, 300, 124), _block(1, 72, 100, 215, 120), _block(2, 72, 130, 300, 150)) == [1, 0, 2]
    assert reading_order.page_order([]) == []


LINES = "doc_id string, page_number bigint, block_order int, line_order int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_name string, font_size double, font_flags int"


def _line(page: int, k: int, text: str, y: float, size: float = 12.0, name: str = "Times", flags: int = 0, x: float = 72.0) -> tuple:
    return ("d", page, k, 0, text, x, float(y), x + 5 * len(text), float(y + size), 595.0, 842.0, name, float(size), flags)


def _book() -> list[tuple]:
    rows = []
    for page in range(1, 6):
        rows += [
            _line(page, 0, "A Running Title", 20), _line(page, 1, "Opening", 140, 24, "Times-Bold", 16),
            _line(page, 2, f"The first line of the page number {page}, which goes on for a whi-", 180), _line(page, 3, "le and ends here, after a good many words.", 194),
            _line(page, 4, "Another paragraph stands alone below, and it is long enough to be one.", 260), _line(page, 5, f"{page}", 815),
        ]
    return rows


def test_paragraphs_headings_and_furniture(spark):
    lines = spark.createDataFrame(_book(), LINES)
    rows = convert.reconstruct(lines).orderBy("page_number", "para_idx").collect()
    texts = [r.text for r in rows if r.page_number == 2]
    assert texts == ["Opening", "The first line of the page number 2, which goes on for a while and ends here, after a good many words.", "Another paragraph stands alone below, and it is long enough to be one."]
    assert [r.is_heading for r in rows if r.page_number == 2] == [True, False, False]


def test_doubled_lines_go_once(spark):
    rows = [_line(1, 0, "same", 100), _line(1, 1, "same", 101), _line(1, 2, "same", 130), _line(1, 3, "other", 131)]
    kept = reading_order.doubled_lines(spark.createDataFrame(rows, LINES))
    assert sorted(r.block_order for r in kept.collect()) == [0, 2, 3]


def test_furniture_needs_three_pages(spark):
    rows = [("d", p, 0, "Title", "title", 1, 72.0, 20.0, 200.0, 32.0, 595.0, 842.0) for p in (1, 2)]
    schema = "doc_id string, page_number bigint, para_idx int, text string, norm_text string, line_count int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
    assert furniture.detect(spark.createDataFrame(rows, schema)).count() == 0
    rows += [("d", 3, 0, "Title", "title", 1, 72.0, 20.0, 200.0, 32.0, None, 842.0)]
    assert furniture.detect(spark.createDataFrame(rows, schema)).count() == 0
    rows += [("d", 4, 0, "Title", "title", 1, 72.0, 20.0, 200.0, 32.0, 595.0, 842.0)]
    found = furniture.detect(spark.createDataFrame(rows, schema)).collect()
    assert [(r.region, r.n_pages, r.confidence) for r in found] == [("header", 3, 0.72)]


def test_books_are_valid_and_the_same_bytes(spark):
    lines = spark.createDataFrame(_book(), LINES)
    books = convert.books(convert.reconstruct(lines))
    data = [bytes(r.epub) for r in books.collect()]
    assert len(data) == 1 and data == [bytes(r.epub) for r in books.collect()]
    facts = epub.facts(books, F.col("doc_id"), F.col("epub")).cache()
    assert epub_validate.issues(facts).collect() == []


def test_books_are_packed_without_holding_their_text():
    import tracemalloc

    lines = lambda: (f"<p>{k % 97} some words of a line</p>" for k in range(600_000))
    args = ("T", "en", "i")
    one = lambda body: [{"name": "chapter-01.xhtml", "title": "T", "body": body}]
    tracemalloc.start()
    data = epub_write.archive(*args, one(lines()), [], "p {}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 < len("".join(lines()))
    whole = epub_write.archive(*args, one("\n".join(lines())), [], "p {}")
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(io.BytesIO(whole)) as b:
        assert a.namelist() == b.namelist() and all(a.read(n) == b.read(n) for n in a.namelist())


def _archive(change) -> bytes:
    chapters = [{"name": "chapter-01.xhtml", "title": "One", "body": '<p>x</p><div class="page-break"></div><img src="images/a.png" alt=""/>'}]
    images = [{"name": "a.png", "media_type": "image/png", "data": b"\x89PNG\r\n\x1a\n"}]
    args = {"title": "T", "language": "en", "identifier": "i", "chapters": chapters, "images": images, "css": epub_write.stylesheet()}
    change(args)
    return epub_write.archive(**args)


def test_validator_finds_each_damage(spark):
    def body(text: str):
        return lambda a: a["chapters"][0].update(body=text)

    damage = {
        "none": (lambda a: None, set()),
        "title": (lambda a: a.update(title=""), {"missing_metadata"}),
        "image": (body('<img src="images/b.png" alt=""/>'), {"broken_resource_reference"}),
        "no source": (body('<img alt=""/>'), {"invalid_xhtml"}),
        "break": (body('<p class="page-break">x</p>'), {"invalid_xhtml"}),
        "link": (body('<p><a href="nowhere.xhtml">x</a></p>'), {"broken_resource_reference"}),
        "external": (body('<p><a href="https://example.com/">x</a></p>'), set()),
        "style reference": (lambda a: a.update(css="p { background: url(lost.png) } .page-break {}"), {"broken_resource_reference"}),
        "style": (lambda a: a.update(css="p {}"), {"undefined_page_break_style"}),
    }
    rows = spark.createDataFrame([(k, _archive(f)) for k, (f, _) in damage.items()] + [("unclosed", _archive(body("<p>unclosed"))), ("type", _archive(lambda a: a["images"][0].update(media_type="text/plain")))], "doc_id string, epub binary")
    facts = epub.facts(rows, F.col("doc_id"), F.col("epub")).cache()
    found: dict[str, set[str]] = {}
    for r in epub_validate.issues(facts).collect():
        found.setdefault(r.artifact, set()).add(r.code)
    assert {k: found.get(k, set()) for k in damage} == {k: want for k, (_, want) in damage.items()}
    assert "invalid_xhtml" in found["unclosed"] and "invalid_image" in found["type"]


def test_unreadable_archives_are_rows(spark):
    rows = spark.createDataFrame([("a", b""), ("b", b"PK\x03\x04"), ("c", None)], "doc_id string, epub binary")
    found = epub_validate.issues(epub.facts(rows, F.col("doc_id"), F.col("epub"))).collect()
    assert sorted((r.artifact, r.code) for r in found) == [(x, "invalid_archive") for x in "abc"]


def test_cover_needs_a_clear_lead(spark):
    schema = "doc_id string, page_number int, text string, image_count int, image_area_ratio double, page_width double, page_height double"
    rows = [("a", 1, "A Title", 1, 1.0, 595.0, 842.0), ("a", 2, "long " * 100, 0, 0.0, 595.0, 842.0), ("b", 1, "One", 1, 0.9, 595.0, 842.0), ("b", 2, "Two", 1, 1.0, 595.0, 842.0), ("c", 1, "Contents", 1, 1.0, 595.0, 842.0)]
    rows += [(d, p, "long " * 100, 0, 0.0, 595.0, 842.0) for d in "bc" for p in (3, 4, 5)]
    found = cover.signals(spark.createDataFrame(rows, schema))
    got = {r.doc_id: (r.cover_page, r.decision) for r in cover.decide(cover.score(found, cover.page_medians(found))).collect()}
    assert got == {"a": (1, "selected"), "b": (1, "selected"), "c": (None, "none_eligible")}


def test_ocr_paragraphs_split_at_blank_lines(spark):
    rows = spark.createDataFrame([(1, "one\ntwo\n\n \nthree-\nfour\n"), (2, None), (3, "\n\n")], "k int, t string")
    got = paragraphs.ocr_paragraphs(rows, F.col("t"), ["k"]).collect()
    assert [(r.k, r.para_idx, r.text) for r in got] == [(1, 0, "one two"), (1, 1, "threefour")]


def test_elements_put_text_before_images_at_one_height(spark):
    text = spark.createDataFrame([("d", 1, 0, "t", 50.0, False), ("d", 1, 1, "ocr", None, False), ("d", 2, 0, " ", 10.0, False)], "doc_id string, page_number bigint, para_idx int, text string, y0 double, is_heading boolean")
    image = spark.createDataFrame([("d", 1, 0, 50.0, "x")], "doc_id string, page_number bigint, placement_order int, y0 double, sha256 string")
    rows = assemble.blocks(assemble.elements(text, image), text.select("doc_id", "page_number").distinct()).orderBy("block_index").collect()
    assert [(r.kind, r.text) for r in rows] == [("paragraph", "t"), ("image", None), ("paragraph", "ocr"), ("page_break", None)]


def test_heading_threshold_counts_signals(spark):
    spans = [{"font_name": "Times-Bold", "font_size": 24.0, "font_flags": 16, "height": 24.0}]
    plain = [{"font_name": "Times", "font_size": 12.0, "font_flags": 0, "height": 12.0}]
    rows = [("d", 1, 0, "Big", 1, 72.0, 100.0, 100.0, 124.0, spans), ("d", 1, 1, "x" * 200, 3, 72.0, 200.0, 500.0, 240.0, plain), ("d", 1, 2, "y" * 200, 3, 72.0, 245.0, 500.0, 290.0, plain)]
    schema = "doc_id string, page_number bigint, para_idx int, text string, line_count int, x0 double, y0 double, x1 double, y1 double, spans array<struct<font_name: string, font_size: double, font_flags: int, height: double>>"
    df = spark.createDataFrame(rows, schema).withColumn("page_width", F.lit(595.0)).withColumn("page_height", F.lit(842.0))
    got = {r.para_idx: (r.is_heading, r.reasons) for r in headings.classify(df).collect()}
    assert got[0][0] and "font_size_strongly_above_body_baseline" in got[0][1]
    assert not got[1][0] and got[1][1] == ["large_spacing_before", "long_paragraph"]
    assert got[2] == (False, ["long_paragraph"])


def test_cover_queries_judge_whole_texts_of_all_documents(spark, tmp_path):
    from quirework.plans.queries import QUERIES

    body = "word " * 200  # image areas: 0.7, 0.3, 1.0, 0.6, 0.2, 0.9, 0.5, 0.1, 0.8, 0.4
    texts = [body, body, "A Title", body, "x"] + [body] * 20
    rows = [(k + 1, "s", t) for k, t in enumerate(texts)] + [(3 + 11 * k, "t", t) for k, t in enumerate(["n" * 150, "n" * 30, "n" * 30] + ["n" * 40] * 9)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.page_number): r.rejected for r in QUERIES["cover_scores"](spark, str(tmp_path)).collect()}
    assert len(got) == 10 and got["s", 1] == "body_text" and got["s", 3] is None and got["t", 1] == "too_much_text" and got["t", 2] == "not_sparse_for_the_book"
