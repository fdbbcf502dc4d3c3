"""Adapters to libraries that aren't installed, over stand-ins for them."""

from __future__ import annotations

import sys
import types

import pytest

from quirework.sources import native


def test_dpi_is_checked():
    assert native.check_dpi(72) == 72 and native.check_dpi(600) == 600
    for wrong in (71, 601, True, 300.0):
        with pytest.raises(ValueError):
            native.check_dpi(wrong)


def test_an_unreadable_file_is_a_row(spark, monkeypatch):
    def library():
        lib = types.ModuleType("pymupdf")

        class Page:
            number, rect = 0, types.SimpleNamespace(width=595.0, height=842.0)

            def get_text(self, kind):
                span = {"text": "Hello", "font": "Times", "size": 12.0, "flags": 16}
                return {"blocks": [{"type": 0, "lines": [{"spans": [span, {**span, "text": " you"}], "bbox": (72.0, 100.0, 140.0, 112.0)}]}, {"type": 1}]}

        class Document(list):
            def __enter__(self):
                return self

            def __exit__(self, *a):
                return None

        def open(stream, filetype):
            if not stream.startswith(b"%PDF"):
                raise RuntimeError("broken")
            return Document([Page()])

        lib.open = open
        return lib

    files = spark.createDataFrame([("good", bytearray(b"%PDF-1")), ("bad", bytearray(b"x"))], "path string, content binary")
    monkeypatch.setattr(native, "_pdf_library", library)
    got = {r.doc_id: r for r in native.pdf_lines(files).collect()}
    assert got["good"].text == "Hello you" and got["good"].font_flags == 16 and got["good"].error_code is None
    assert got["bad"].error_code == "pdf_read_error: RuntimeError" and got["bad"].text is None
    assert "pymupdf" not in sys.modules


def test_recognition_calls_the_engine(spark):
    pages = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "page int, image binary")
    got = {r.page: r.ocr_text for r in native.recognised(pages, lambda: lambda image: f"{len(image)} bytes").collect()}
    assert got == {1: "3 bytes", 2: None}


def test_missing_program_is_said(spark):
    with pytest.raises(native.MissingLibrary):
        native.tesseract(program="no-such-program")
    books = spark.createDataFrame([("a", bytearray(b"PK"))], "doc_id string, epub binary")
    assert [tuple(r) for r in native.azw3(books, program="no-such-program").collect()] == [("a", None, "converter_not_found")]
