"""What needs libraries or programs from outside: PDF parsing and rendering, recognition, AZW3.

Each is imported or looked up when it is first used in a task, once for each worker, and says what is
missing if it isn't there. Failures of a document become rows with an ``error_code``.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "doc_id string, page_number bigint, block_order int, line_order int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_name string, font_size double, font_flags int, error_code string"


class MissingLibrary(RuntimeError):
    """A native library or program that isn't installed."""


def check_dpi(dpi: int) -> int:
    if isinstance(dpi, bool) or not isinstance(dpi, int) or not 72 <= dpi <= 600:
        raise ValueError(f"dpi must be an integer from 72 to 600, not {dpi!r}")
    return dpi


def _pdf_library():
    try:
        import pymupdf
    except ImportError as e:
        raise MissingLibrary("reading PDF files needs pymupdf") from e
    return pymupdf


def pdf_lines(files: DataFrame) -> DataFrame:
    """The line table of PDF files (path, content as ``binaryFile`` gives them); an unreadable one is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib, names = _pdf_library(), [c.split()[0] for c in LINES.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with lib.open(stream=bytes(content), filetype="pdf") as doc:
                        for page in doc:
                            found = [b for b in page.get_text("dict")["blocks"] if b.get("type") == 0]
                            for b, block in enumerate(found):
                                for n, line in enumerate(block["lines"]):
                                    first = line["spans"][0] if line["spans"] else {}
                                    rows.append((path, page.number + 1, b, n, "".join(s["text"] for s in line["spans"]), *line["bbox"], page.rect.width, page.rect.height, first.get("font"), first.get("size"), max(0, first.get("flags") or 0), None))
                except Exception as e:  # one bad file is a row, not a failed job
                    rows = [(path, *[None] * (len(names) - 2), f"pdf_read_error: {type(e).__name__}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, LINES)


def recognised(pages: DataFrame, engine: Callable[[], Callable[[bytes], str]], image: str = "image") -> DataFrame:
    """``pages`` with ``ocr_text``; ``engine()`` is called once for each worker and gives the function that reads an image."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = engine()
        for images in batches:
            yield images.map(lambda x: None if x is None else one(bytes(x)))

    return pages.withColumn("ocr_text", read(image))


def tesseract(language: str = "eng", program: str = "tesseract") -> Callable[[bytes], str]:
    """A recogniser that runs the program for each image."""
    if not shutil.which(program):
        raise MissingLibrary(f"recognition needs the program {program}")
    return lambda image: subprocess.run([program, "-", "-", "-l", language, "--psm", "3"], input=image, capture_output=True, check=True).stdout.decode()


def azw3(books: DataFrame, program: str = "ebook-convert") -> DataFrame:
    """(doc_id, azw3, error_code) of packaged books, by an external program without a shell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, epub in zip(frame["doc_id"], frame["epub"], strict=True):
                if not shutil.which(program):
                    rows.append((doc, None, "converter_not_found"))
                    continue
                with tempfile.TemporaryDirectory() as folder:  # lives as long as the call
                    source, target = Path(folder, "book.epub"), Path(folder, "book.azw3")
                    source.write_bytes(bytes(epub))
                    done = subprocess.run([program, str(source), str(target)], capture_output=True)
                    data = target.read_bytes() if target.exists() else b""
                code = "conversion_failed" if done.returncode else None if data else "output_missing"
                rows.append((doc, None if code else data, code))
            yield pd.DataFrame(rows, columns=["doc_id", "azw3", "error_code"])

    return books.select("doc_id", "epub").mapInPandas(run, f"doc_id {books.schema['doc_id'].dataType.simpleString()}, azw3 binary, error_code string")
