"""Media types, resource names and references inside packaged books."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and leading bytes of image types.
MIME_BY_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}
MAGIC = (("FFD8FF", "image/jpeg", "jpg"), ("89504E470D0A1A0A", "image/png", "png"), ("474946383761", "image/gif", "gif"), ("474946383961", "image/gif", "gif"), ("424D", "image/bmp", "bmp"))
DEFAULT_MIME = "application/octet-stream"


def sniffed(data: Column) -> Column:
    """The image type that a file's first bytes tell, or null."""
    head = F.hex(F.substring(data, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, mime, _ in MAGIC:
        out = out.when(head.startswith(magic), mime)
    return out


def mime(extension: Column, data: Column) -> Column:
    """By extension, else by the first bytes, else unknown."""
    known = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_replace(extension, r"^\.", ""))), sniffed(data), F.lit(DEFAULT_MIME))


def extension_of(media_type: Column) -> Column:
    known = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tif", "image/svg+xml": "svg"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), media_type), F.lit("bin"))


def chapter_name(index: Column) -> Column:
    return F.format_string("chapter-%02d.xhtml", index)


def image_name(asset_number: Column, chapter: Column, block: Column, media_type: Column) -> Column:
    """By the asset's number where it has one, else by where the image stands."""
    by_place = F.format_string("image-%d-%d.", chapter, block)
    return F.concat(F.coalesce(F.format_string("image-%03d.", asset_number), by_place), extension_of(media_type))


def resolve(base_dir: str, reference: str) -> str | None:
    """The packaged path that a reference means, or None: external, absolute, or above the root."""
    path = re.split(r"[#?]", reference, maxsplit=1)[0]
    if not path or path.startswith("/") or "\\" in path or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return None
    out = posixpath.normpath(posixpath.join(base_dir, path))
    return None if out == ".." or out.startswith("../") or out == "." else out


def candidates(path: str) -> list[str]:
    """A path as written, then percent-decoded."""
    decoded = unquote(path)
    return [path] if decoded == path else [path, decoded]


CSS_URL = r"""(?i)url\(\s*(?:"([^"]*)"|'([^']*)'|([^)'"\s]*))\s*\)|@import\s+(?:"([^"]*)"|'([^']*)')"""


def css_references(css: Column) -> Column:
    """Targets of url() and @import in order, each once, inline data left out."""
    groups = [F.regexp_extract_all(css, F.lit(CSS_URL), F.lit(k)) for k in range(1, 6)]
    merged = F.transform(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)]), lambda s: F.concat(*[F.coalesce(s[f"g{k}"], F.lit("")) for k in range(5)]))
    return F.array_distinct(F.filter(merged, lambda x: (x != "") & ~F.lower(x).startswith("data:")))


def invalid_entry_name(name: Column) -> Column:
    """Empty, absolute, with a drive or backslash or control, or stepping above the root."""
    return (name == "") | name.rlike(r"^/|^[A-Za-z]:|\\|[\x00-\x1f\x7f]|(^|/)\.\.(/|$)|//")
