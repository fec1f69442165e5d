"""Guards of zip packages: required parts, encryption and decompression limits."""

from __future__ import annotations

import io
import zipfile

# -- fixed values -------------------------------------------------------------------------
ENTRY_LIMIT, TOTAL_LIMIT, RATIO_LIMIT = 64 << 20, 256 << 20, 1000
XLSX_PARTS = ("[Content_Types].xml", "xl/workbook.xml")
DOCX_PARTS = ("[Content_Types].xml", "word/document.xml")


class InvalidPackage(ValueError):
    """A file that is no safe package of its kind."""


def opened(data: bytes, required: tuple[str, ...], encrypted_ok: bool = False) -> zipfile.ZipFile:
    """The package, if it has the required parts and inflates within the limits."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise InvalidPackage("not a zip package") from e
    entries = package.infolist()
    if missing := set(required) - {e.filename for e in entries}:
        raise InvalidPackage(f"parts missing: {sorted(missing)}")
    if not encrypted_ok and any(e.flag_bits & 1 for e in entries):
        raise InvalidPackage("encrypted entries")
    if any(e.file_size > ENTRY_LIMIT for e in entries) or sum(e.file_size for e in entries) > TOTAL_LIMIT:
        raise InvalidPackage("too large when inflated")
    if any(e.file_size > RATIO_LIMIT * max(1, e.compress_size) for e in entries):
        raise InvalidPackage("suspicious compression ratio")
    return package
