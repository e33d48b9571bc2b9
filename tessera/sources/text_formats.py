"""Texts of single files, from their bytes; run inside Python workers."""

from __future__ import annotations

import csv
import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

DROPPED_TAGS = frozenset(("script", "style", "nav", "footer", "header"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class MissingPackage(RuntimeError):
    """A format whose parser is not installed here."""


def plain_text(content: bytes) -> str:
    """UTF-8, otherwise Latin-1, which never fails."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


class _Visible(HTMLParser):
    """Collects visible text; rows of tables are one line each, their cells set off by bars."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.parts: list[str] = []
        self.main: list[tuple[int, int]] = []  # stretches of parts inside main or article
        self.open_main: list[int] = []
        self.row: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS and tag not in _VOID:
            self.hidden.append(tag)
        elif tag in ("main", "article"):
            self.open_main.append(len(self.parts))
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([])

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        elif tag in ("main", "article") and self.open_main:
            self.main.append((self.open_main.pop(), len(self.parts)))
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        if self.row:
            self.row[-1].append(data.strip())
        else:
            self.parts.append(data)

    def _end_row(self):
        if self.row and any(self.row):
            self.parts.append(" | ".join(" ".join(cell) for cell in self.row))
        self.row = None

    def text(self) -> str:
        self._end_row()
        start, end = max(self.main, key=lambda m: sum(map(len, self.parts[m[0] : m[1]])), default=(0, 0))
        return "\n".join(self.parts[start:end]) or "\n".join(self.parts)


def html_text(content: bytes) -> str:
    """The main content of a page: its longest main or article element, otherwise all visible text; one piece a line.

    Script, style, navigation, header and footer are left out, comments too; tables are kept.
    """
    parser = _Visible()
    parser.feed(plain_text(content))
    parser.close()
    return parser.text()


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, a blank line between them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{w}body")
    paragraphs = []
    for p in body.findall(f"{w}p") if body is not None else ():
        text = "".join("\t" if n.tag == f"{w}tab" else "\n" if n.tag in (f"{w}br", f"{w}cr") else n.text or "" for n in p.iter() if n.tag in (f"{w}t", f"{w}tab", f"{w}br", f"{w}cr"))
        if text.strip():
            paragraphs.append(text)
    return "\n\n".join(paragraphs)


def pdf_text(content: bytes) -> str:
    """Pages, a blank line between them; needs one of two optional packages."""
    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return "\n\n".join(page.get_text() for page in doc)
    except ImportError:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise MissingPackage("reading PDF needs the package pymupdf or pypdf") from e
        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


# Cells that count as missing.
MISSING = frozenset(("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))


def csv_cells(content: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of a CSV file, missing cells as None; short rows are filled up, a row longer than the header is an error."""
    csv.field_size_limit(2**31 - 1)
    lines = [row for row in csv.reader(io.StringIO(plain_text(content).removeprefix("\ufeff"), newline="")) if row]
    if not lines:
        return [], []
    header, rows = lines[0], lines[1:]
    for n, row in enumerate(rows, 2):
        if len(row) > len(header):
            raise ValueError(f"line {n} has {len(row)} cells under {len(header)} columns")
    return header, [[None if c in MISSING else c for c in row] + [None] * (len(header) - len(row)) for row in rows]


READERS = {".html": html_text, ".htm": html_text, ".docx": docx_text, ".pdf": pdf_text, ".txt": plain_text, ".md": plain_text}
EXTENSIONS = (*READERS, ".csv")


def extension(name: str) -> str:
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
