"""Text PDFs without a library: page texts and sizes out of files, and files of page texts.

Reading: objects and object streams, Flate streams, the page tree, and the text operators of content streams; strings are
decoded by a font's ToUnicode map or as Windows-1252. Each page has two candidates: the words by their places (lines by the
vertical place, blanks by the gap between words) and the words in the order of the stream. Scans have no text here; an
extractor with optical recognition can be given to read_documents instead.

Writing: Helvetica at 11 points inside fixed margins, lines broken by width, pages at their own sizes. A text with
characters outside of Windows-1252 is put on the page once more, invisibly, in a font with a ToUnicode map, so that it
is read again as it was.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

WIDTH, HEIGHT = 612.0, 792.0
#: Margins (left and right, top and bottom) and size of the letters.
SIDE, EDGE, SIZE = 54.0, 58.0, 11.0
#: Mean width of Helvetica's letters and the distance of lines, in sizes.
LETTER, LEADING = 0.52, 1.25

_object = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ref = re.compile(rb"(\d+)\s+\d+\s+R\b")
_token = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF file")
        self.objects: dict[int, bytes] = {}
        found = [*_object.finditer(data)]
        for m, after in zip(found, [*found[1:], None]):
            self.objects[int(m[1])] = data[m.end() : after.start() if after else len(data)]
        for body in [*self.objects.values()]:
            if b"/ObjStm" in body[:400]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        content = self.stream(body)
        first, n = (self.number(body, k) for k in (b"/First", b"/N"))
        head = [int(x) for x in content[:first].split()[: 2 * n]]
        starts = [first + x for x in head[1::2]]
        for number, a, b in zip(head[::2], starts, [*starts[1:], len(content)]):
            self.objects.setdefault(number, content[a:b])

    def number(self, body: bytes, key: bytes) -> int:
        m = re.search(re.escape(key) + rb"\s+(\d+)(?:\s+\d+\s+(R))?", body)
        if not m:
            return 0
        return int(self.objects.get(int(m[1]), b"0").split()[0]) if m[2] else int(m[1])

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"\bstream\r?\n", body)
        if not m:
            return b""
        size = self.number(body[: m.start()], b"/Length")
        raw = body[m.end() : m.end() + size] if size else body[m.end() : body.rfind(b"endstream")]
        if b"FlateDecode" in body[: m.start()]:
            return zlib.decompressobj().decompress(raw)
        return raw

    def value(self, body: bytes, key: bytes) -> bytes | None:
        """The object a key of a dictionary refers to, or what stands behind the key."""
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*", body)
        if not m:
            return None
        if r := _ref.match(body, m.end()):
            return self.objects.get(int(r[1]))
        return body[m.end() :]

    def pages(self) -> Iterator[bytes]:
        root = next((o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", o)), b"")
        tree = self.value(root, b"/Pages")

        def walk(node: bytes, size: bytes, depth: int = 0) -> Iterator[bytes]:
            own = re.search(rb"/MediaBox\s*\[[^\]]*\]", node)
            size = own[0] if own else size
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", node)
            if kids and depth < 50:
                for r in _ref.findall(kids[1]):
                    yield from walk(self.objects.get(int(r), b""), size, depth + 1)
            elif not kids:
                yield node if own else node + size

        if tree:
            yield from walk(tree, b"")

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str] | None]:
        """Names of fonts with their maps from codes to text, None without one."""
        resources = self.value(page, b"/Resources") or b""
        inside = self.value(resources, b"/Font") or b""
        out = {}
        for name, r in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inside.split(b">>")[0]):
            body = self.objects.get(int(r), b"")
            cmap = self.value(body, b"/ToUnicode")
            out[name] = code_map(self.stream(cmap)) if cmap else None
        return out


def code_map(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            for i in range(int(b, 16) - int(a, 16) + 1):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = first[:-1] + chr(ord(first[-1]) + i)
    return out


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return _escapes.get(c, b"" if c[:1] in b"\r\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _decoded(raw: bytes, font: dict[bytes, str] | None) -> str:
    if not font:
        return raw.decode("cp1252", "replace")
    width = max(map(len, font))
    return "".join(font.get(raw[i : i + width], "") for i in range(0, len(raw), width))


#: A shift to the left of so many thousandths of a size is a blank.
GAP = 200


def words(content: bytes, fonts: dict[bytes, dict[bytes, str] | None]) -> list[tuple[float, float, float, str]]:
    """(y, x, size, text) of the shown strings of a content stream, in its order."""
    out: list[tuple[float, float, float, str]] = []
    stack: list[bytes] = []
    x = y = x0 = y0 = 0.0
    size, lead, font = SIZE, 0.0, None

    def show(text: str) -> None:
        nonlocal x
        if text:
            out.append((y, x, size, text))
            x += len(text) * size * LETTER

    def line(dx: float, dy: float) -> None:
        nonlocal x, y, x0, y0
        x0, y0 = x0 + dx, y0 + dy
        x, y = x0, y0

    num = lambda i: float(stack[i]) if len(stack) >= -i else 0.0
    for m in _token.finditer(content):
        t = m[0]
        if t[:1] in b"(</[]0123456789+-." or t in (b"<<", b">>"):
            stack.append(t)
            continue
        if t == b"BT":
            x = y = x0 = y0 = 0.0
        elif t == b"Tf" and len(stack) > 1:
            font, size = fonts.get(stack[-2][1:]), abs(num(-1)) or SIZE
        elif t in (b"Td", b"TD"):
            lead = -num(-1) if t == b"TD" else lead
            line(num(-2), num(-1))
        elif t == b"TL":
            lead = num(-1)
        elif t == b"Tm":
            x0, y0 = num(-2), num(-1)
            x, y = x0, y0
        elif t == b"T*":
            line(0, -lead)
        elif t in (b"Tj", b"'", b'"') and stack:
            if t != b"Tj":
                line(0, -lead)
            show(_decoded(_bytes_of(stack[-1]), font) if stack[-1][:1] in b"(<" else "")
        elif t == b"TJ":
            parts = []
            for s in stack[len(stack) - stack[::-1].index(b"[") :] if b"[" in stack else []:
                if s[:1] in b"(<":
                    parts.append(_decoded(_bytes_of(s), font))
                elif s[:1] not in b"[]/" and abs(float(s)) > GAP:
                    parts.append(" ")
            show("".join(parts))
        stack.clear()
    return out


def by_place(found: list[tuple[float, float, float, str]]) -> str:
    """Words in lines by their vertical places, with a blank where there is a gap."""
    lines: list[list[tuple[float, float, float, str]]] = []
    for w in sorted(found, key=lambda w: -w[0]):
        if lines and abs(lines[-1][0][0] - w[0]) < 0.4 * w[2]:
            lines[-1].append(w)
        else:
            lines.append([w])
    out = []
    for line in lines:
        text, end = "", None
        for _, x, size, t in sorted(line, key=lambda w: w[1]):
            # widths are estimates, so words that begin apart are apart
            text += (" " if end is not None and text[-1:] != " " and t[:1] != " " and x - end > -0.25 * size * len(t) else "") + t
            end = x + len(t) * size * LETTER
        out.append(text)
    return "\n".join(out)


def page_candidates(data: bytes) -> list[tuple[list[str], float, float]]:
    """(texts, width, height) of every page; a page that can't be read has empty texts."""
    pdf, out = Pdf(data), []
    for page in pdf.pages():
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", page)
        try:
            a, b, c, d = map(float, box[1].split())
            width, height = c - a, d - b
        except (TypeError, ValueError):
            width, height = WIDTH, HEIGHT
        try:
            many = re.search(rb"/Contents\s*\[([^\]]*)\]", page)
            bodies = [pdf.objects.get(int(r), b"") for r in _ref.findall(many[1])] if many else [pdf.value(page, b"/Contents") or b""]
            found = words(b"\n".join(pdf.stream(b) for b in bodies), pdf.fonts(page))
            texts = [by_place(found), "\n".join(t for *_, t in found)]
        except Exception:  # one page never fails its file
            texts = ["", ""]
        out.append((texts, width, height))
    return out


_PAGES = "id string, page_no int, texts array<string>, width double, height double"


def _extracted(batches):
    for b in batches:
        rows = []
        for key, content in zip(b["id"], b["content"]):
            try:
                pages = page_candidates(bytes(content))
            except Exception:  # no PDF, or a broken one: the file has no pages
                continue
            rows += [(key, i, texts, w, h) for i, (texts, w, h) in enumerate(pages, 1)]
        yield pd.DataFrame(rows, columns=["id", "page_no", "texts", "width", "height"])


def extract_pages(files: DataFrame) -> DataFrame:
    """(id, page_no, texts, width, height) of (id, content): what pages_from_candidates reads."""
    return files.select("id", "content").mapInPandas(_extracted, _PAGES)


def _quoted(text: str) -> bytes:
    return b"(" + re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace")) + b")"


def _broken(text: str, width: float) -> list[str]:
    """Lines that fit a width, words kept whole where they can be."""
    most = max(1, int(width / (SIZE * LETTER)))
    out = []
    for line in text.split("\n"):
        while len(line) > most:
            cut = line.rfind(" ", 1, most + 1)
            cut = cut if cut > 0 else most
            out.append(line[:cut])
            line = line[cut:].lstrip(" ")
        out.append(line)
    return out


def write_pdf(pages: list[str], sizes: list[tuple[float, float]] = ()) -> bytes:
    """A PDF file of page texts; a text that needs more room goes on over pages of the same size."""
    sheets: list[tuple[list[str], float, float]] = []
    for i, text in enumerate(pages or [""]):
        w, h = sizes[min(i, len(sizes) - 1)] if sizes else (WIDTH, HEIGHT)
        w, h = (w, h) if w and h and w > 0 and h > 0 else (WIDTH, HEIGHT)
        lines = _broken(text or "", w - 2 * SIDE)
        most = max(1, int((h - 2 * EDGE) / (SIZE * LEADING)))
        sheets += [(lines[k : k + most], w, h) for k in range(0, len(lines), most)]
    odd = sorted({c for lines, *_ in sheets for line in lines for c in line if c.encode("cp1252", "ignore") == b""})
    every = sorted({c for lines, *_ in sheets for line in lines for c in line}) if odd else []
    code = {c: i + 1 for i, c in enumerate(every)}
    kids = " ".join(f"{6 + 2 * k} 0 R" for k in range(len(sheets)))
    cmap = "\n".join(f"<{i:04x}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items())
    chars = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(code)} beginbfchar\n{cmap}\nendbfchar".encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(sheets)} >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /ToUnicode 5 0 R >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(chars), chars),
    ]
    for k, (lines, w, h) in enumerate(sheets):
        shown = []
        for n, line in enumerate(lines):
            y = h - EDGE - SIZE - n * SIZE * LEADING
            if all(c not in odd for c in line):
                shown.append(b"/F1 %.1f Tf 1 0 0 1 %.2f %.2f Tm %s Tj" % (SIZE, SIDE, y, _quoted(line)))
            else:
                shown.append(b"3 Tr /F2 %.1f Tf 1 0 0 1 %.2f %.2f Tm <%s> Tj 0 Tr" % (SIZE, SIDE, y, "".join(f"{code[c]:04x}" for c in line).encode()))
        content = zlib.compress(b"BT\n" + b"\n".join(shown) + b"\nET")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:g} {h:g}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {7 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
    out, places = b"%PDF-1.5\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, table, len(places) + 1, len(out))


@F.pandas_udf(BinaryType())
def _files_of(pages: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else write_pdf([*p], [*zip(w, h)] if w is not None and h is not None else ()) for p, w, h in zip(pages, widths, heights)], dtype=object)


def pdf_file(pages: Column, widths: Column, heights: Column) -> Column:
    """The bytes of a PDF of an array of page texts; null for null."""
    return _files_of(pages, widths, heights)
