"""Text of office files from their bytes, with the standard library only; what cannot be read is empty."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def docx_text(data: bytes) -> str:
    """Body paragraphs, one a line; tables are not read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join((e.text or "") if e.tag == f"{_W}t" else _BREAKS.get(e.tag, "") for e in p.iter()) for p in body.findall(f"{_W}p"))


def _number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(title, rows of cells) of each sheet in order; rows are as wide as the sheet, empty cells empty.

    Cells are what is stored: text, numbers as written, True and False; dates stay numbers.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).find(f"{_S}sheets"):
            target = targets[sheet.get(f"{_R}id")]
            root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            grid: dict[tuple[int, int], str] = {}
            for i, row in enumerate(root.iter(f"{_S}row"), 1):
                r = int(row.get("r", i))
                for j, c in enumerate(row.findall(f"{_S}c"), 1):
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "b":
                        value = str(v.text == "1")
                    else:
                        value = v.text
                    grid[r, _number(c.get("r", "")) or j] = value
            height, width = max((r for r, _ in grid), default=0), max((c for _, c in grid), default=0)
            out.append((sheet.get("name"), [[grid.get((r, c), "") for c in range(1, width + 1)] for r in range(1, height + 1)]))
        return out


def xlsx_text(data: bytes) -> str:
    """All rows of all sheets, cells between tabs."""
    return "\n".join("\t".join(row) for _, rows in xlsx_sheets(data) for row in rows)


def pdf_text(data: bytes) -> str:
    """Pages, one after the other; needs the library pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def pdf_words(data: bytes) -> list[dict]:
    """Word boxes of all pages; needs the library pdfplumber."""
    import pdfplumber

    out = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for page, p in enumerate(pdf.pages):
            for i, w in enumerate(p.extract_words(x_tolerance=3, y_tolerance=3, keep_blank_chars=False)):
                out.append({"page": page, "word_idx": i, "text": w["text"], "page_height": float(p.height)} | {k: float(w[k]) for k in ("x0", "x1", "top", "bottom")})
    return out


def pdf_streams(data: bytes) -> list[tuple[int, int, bytes]]:
    """(page, stream, content) of all content streams; needs the library pikepdf."""
    import pikepdf

    out = []
    with pikepdf.Pdf.open(io.BytesIO(data)) as pdf:
        for page, p in enumerate(pdf.pages):
            contents = p.get("/Contents")
            if contents is not None:
                for i, s in enumerate(list(contents) if isinstance(contents, pikepdf.Array) else [contents]):
                    out.append((page, i, bytes(s.read_bytes())))
    return out


def safely(reader, data: bytes, otherwise):
    """What a reader gives, or `otherwise` for files that it cannot read."""
    try:
        return reader(data)
    except Exception:  # noqa: BLE001  damaged files and missing libraries are empty
        return otherwise


# Writers

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _escaped(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), _TYPES + text)
    return out.getvalue()


def docx_bytes(text: str) -> bytes:
    """A new document with one paragraph for each line and no properties."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escaped(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    pkg, off = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{off}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>',
    })


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of text cells without properties."""
    pkg, off = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{off}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{off}"><sheets>' + "".join(f'<sheet name="{_escaped(t)}" sheetId="{i}" r:id="rId{i}"/>' for i, (t, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{off}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, (_, rows) in enumerate(sheets, 1):
        cell = lambda r, c, v: f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_escaped(v)}</t></is></c>'
        data = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{data}</sheetData></worksheet>'
    return _zip(files)


def rejoined(sheets: list[tuple[str, list[list[str]]]], text: str) -> list[tuple[str, list[list[str]]]]:
    """The sheets with the text's lines as rows and tab pieces as cells, by position; what is missing is empty."""
    rows, out, at = text.split("\n"), [], 0
    for title, grid in sheets:
        new = []
        for row in grid:
            parts = rows[at].split("\t") if at < len(rows) else []
            new.append([parts[j] if j < len(parts) else "" for j in range(len(row))])
            at += 1
        out.append((title, new))
    return out
