"""File contents to text: markdown, plain text, CSV, HTML, DOCX, PPTX, XLSX and PDF, with the standard library only.

Headings become markdown headings, rows of tables one line each, pages and
slides are separated. PDF text is taken from content streams, plain or
deflated, with the fonts' own character maps; scans and encrypted files have no
text to take. Images aren't read.

Defined results: bytes that aren't UTF-8 are dropped from text; a file of
another format, or one that can't be parsed, raises ``ValueError``.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Bytes that an archive's member or a stream may have when it is unpacked.
MOST_UNPACKED = 256 << 20


def decode(content: bytes) -> str:
    return content.decode("utf-8", "ignore").removeprefix("﻿")


# HTML


class _Page(HTMLParser):
    HIDDEN = frozenset(("script", "style", "template", "noscript"))
    BLOCKS = frozenset("address article aside blockquote dd div dl dt footer form header hr li main nav ol p pre section table title tr ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCKS:
            self.out.append("\n\n" if tag in ("p", "table") else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n" if tag[0] == "h" else "\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html(content: bytes) -> str:
    page = _Page()
    page.feed(decode(content))
    page.close()
    lines = (re.sub(" +", " ", line).strip().removeprefix("| ") for line in "".join(page.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


# Office formats


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"no readable archive: {e}") from e


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        if archive.getinfo(name).file_size > MOST_UNPACKED:
            raise ValueError(f"{name} is too large")
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error) as e:
        raise ValueError(f"{name} can't be read: {e}") from e


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _value(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _texts(e: ElementTree.Element) -> str:
    parts = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n"}
    return "".join(parts[_tag(x)](x) for x in e.iter() if _tag(x) in parts)


def docx(content: bytes) -> str:
    def blocks(e: ElementTree.Element) -> Iterator[str]:
        for x in e:
            if _tag(x) == "p":
                style = next((_value(s, "val") or "" for s in x.iter() if _tag(s) == "pStyle"), "")
                level = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
                yield f"{'#' * int(level[1])} {_texts(x)}" if level else _texts(x)
            elif _tag(x) == "tbl":
                yield "\n".join(" | ".join(_texts(c).strip() for c in row if _tag(c) == "tc") for row in x.iter() if _tag(row) == "tr")
            elif _tag(x) in ("body", "sdt", "sdtContent"):
                yield from blocks(x)

    return "\n\n".join(b for b in blocks(_xml(_archive(content), "word/document.xml")) if b.strip())


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx(content: bytes) -> str:
    archive = _archive(content)
    slides = []
    for i, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml")):
        lines = [t for p in _xml(archive, name).iter() if _tag(p) == "p" and (t := _texts(p).strip())]
        slides.append("\n".join([f"## Slide {i + 1}", *lines]))
    return "\n\n".join(slides)


def xlsx(content: bytes) -> str:
    archive = _archive(content)
    shared = [_texts(e) for e in _xml(archive, "xl/sharedStrings.xml") if _tag(e) == "si"] if "xl/sharedStrings.xml" in archive.namelist() else []

    def cell(c: ElementTree.Element) -> str:
        if _value(c, "t") == "inlineStr":
            return _texts(c)
        value = next((v.text or "" for v in c if _tag(v) == "v"), "")
        return shared[int(value)] if _value(c, "t") == "s" and value.isdigit() and int(value) < len(shared) else value

    sheets = []
    for i, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
        rows = [" | ".join(map(cell, (c for c in r if _tag(c) == "c"))) for r in _xml(archive, name).iter() if _tag(r) == "row"]
        sheets.append("\n".join([f"## Sheet {i + 1}", *rows]))
    return "\n\n".join(sheets)


def rows(content: bytes) -> str:
    """CSV: one line for each row."""
    return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(decode(content).replace("\0", ""))))


# PDF

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<other><<|>>|[\[\]{}])|(?P<name>/[^\s<>\[\](){}/%]*)|(?P<open>\()|(?P<word>[^\s<>\[\](){}/%]+)")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Pdf:
    def __init__(self, content: bytes):
        if b"/Encrypt" in content:
            raise ValueError("an encrypted PDF")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """The objects in an object stream."""
        data = self.stream(body)
        n, first = (int(m[1]) if (m := re.search(rb"/%s\s+(\d+)" % k, body)) else 0 for k in (b"N", b"First"))
        heads = [int(x) for x in data[:first].split()[: 2 * n]]
        edges = [first + at for at in heads[1::2]] + [len(data)]
        for number, begin, end in zip(heads[::2], edges[:-1], edges[1:], strict=False):
            self.objects.setdefault(number, data[begin:end])

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"\bstream\r?\n", body)
        if not m:
            return b""
        data = body[m.end() : body.rfind(b"endstream")]
        head = body[: m.start()]
        if b"FlateDecode" not in head:
            return b"" if b"/Filter" in head else data
        unpacker = zlib.decompressobj()
        try:
            return unpacker.decompress(data, MOST_UNPACKED)
        except zlib.error:
            return b""

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key names, one or an array of them."""
        m = re.search(rb"/%s\s*(?:\[([^\]]*)\]|%s)" % (key, _REF), body)
        if not m:
            return []
        return [int(x) for x in re.findall(_REF, m[1])] if m[1] is not None else [int(m[2])]

    def value(self, body: bytes, key: bytes) -> bytes:
        """A dictionary that a key holds or names."""
        if m := re.search(rb"/%s\s*%s" % (key, _REF), body):
            return self.objects.get(int(m[1]), b"")
        if not (m := re.search(rb"/%s\s*<<" % key, body)):
            return b""
        depth, at = 0, m.end() - 2
        for x in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if x[0] == b"<<" else -1
            if not depth:
                return body[at : at + x.end()]
        return body[at:]

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Pages in their order, with their resources."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        seen: set[int] = set()

        def walk(number: int, resources: bytes) -> Iterator[tuple[bytes, bytes]]:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            resources = self.value(body, b"Resources") or resources
            if re.search(rb"/Type\s*/Pages\b", body):
                for kid in self.refs(body, b"Kids"):
                    yield from walk(kid, resources)
            elif body:
                yield body, resources

        for root in roots[-1:]:
            for number in self.refs(root, b"Pages"):
                yield from walk(number, b"")

    def fonts(self, resources: bytes) -> dict[bytes, Callable[[bytes], str]]:
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+" + _REF, self.value(resources, b"Font")):
            font = self.objects.get(int(number), b"")
            maps = self.refs(font, b"ToUnicode")
            found[name] = _mapped(self.stream(self.objects.get(maps[0], b""))) if maps else _latin
        return found


def _latin(data: bytes) -> str:
    return data.decode("cp1252", "replace").replace("�", "")


def _utf16(data: bytes) -> str:
    return bytes.fromhex(data.decode()).decode("utf-16-be", "ignore")


def _mapped(cmap: bytes) -> Callable[[bytes], str]:
    """Reads codes by a font's character map."""
    table: dict[int, str] = {}
    hexes = rb"<\s*([0-9A-Fa-f]+)\s*>"
    width = max((len(c) // 2 for space in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S) for c in re.findall(hexes, space)), default=1)
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        table |= {int(a, 16): _utf16(b) for a, b in re.findall(hexes + rb"\s*" + hexes, part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to, each in re.findall(hexes + rb"\s*" + hexes + rb"\s*(?:" + hexes + rb"|\[([^\]]*)\])", part):
            first, last = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            if each:
                table |= {first + i: _utf16(x) for i, x in enumerate(re.findall(hexes, each))}
            elif start := _utf16(to):
                table |= {c: start[:-1] + chr(min(ord(start[-1]) + c - first, 0x10FFFF)) for c in range(first, last + 1)}
    return lambda data: "".join(table.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width))


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                out += _ESCAPED.get(data[at : at + 1], data[at : at + 1] if data[at : at + 1] not in (b"\n", b"\r") else b"")
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _shown(data: bytes, fonts: dict[bytes, Callable[[bytes], str]]) -> str:
    """The text that a content stream shows; a new line where it moves down, a space at wide gaps."""
    out: list[str] = []
    stack: list = []
    read, at, y = _latin, 0, None
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m["open"]:
            text, at = _string(data, at)
            stack.append(text)
        elif m["hex"]:
            digits = re.sub(rb"\s", b"", m["hex"][1:-1])
            stack.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif m["name"]:
            stack.append(m["name"].decode("latin-1"))
        elif m["word"]:
            word = m["word"]
            if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", word):
                stack.append(float(word))
                continue
            numbers = [x for x in stack if isinstance(x, float)]
            if word == b"Tf":
                read = next((fonts.get(x[1:].encode("latin-1"), _latin) for x in stack if isinstance(x, str)), read)
            elif word in (b"Tj", b"TJ", b"'", b'"'):
                if word in (b"'", b'"'):
                    out.append("\n")
                for x in stack:
                    if isinstance(x, bytes):
                        out.append(read(x))
                    elif isinstance(x, float) and word == b"TJ" and x < -200:
                        out.append(" ")
            elif word == b"T*" or (word in (b"Td", b"TD") and len(numbers) == 2 and numbers[1]):
                out.append("\n")
            elif word in (b"Td", b"TD"):
                out.append(" ")
            elif word == b"Tm" and len(numbers) == 6:
                out.append("\n" if y is not None and numbers[5] != y else " ")
                y = numbers[5]
            elif word == b"ET":
                out.append("\n")
            stack = []
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def pdf(content: bytes) -> str:
    """The text of all pages, with a rule between pages."""
    file = _Pdf(content)
    found = [_shown(b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.refs(body, b"Contents")), file.fonts(resources)) for body, resources in file.pages()]
    if not any(found):
        raise ValueError("a PDF without text that can be read")
    return "\n\n-----\n\n".join(found)


PARSERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf, "html": html, "docx": docx, "powerpoint": pptx, "excel": xlsx, "csv": rows, "markdown": decode, "text": decode}
_OFFICE = (("word/document.xml", "docx"), ("ppt/presentation.xml", "powerpoint"), ("xl/workbook.xml", "excel"))


def detect(content: bytes, by_name: str) -> str:
    """Format by what the content begins with or holds, else ``by_name``; text of an unknown name is text."""
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:4] == b"PK\x03\x04":
        names = set(_archive(content).namelist())
        return next((f for n, f in _OFFICE if n in names), "unknown")
    if re.match(rb"\s*<(!doctype html|html)\b", content[:200], re.I):
        return "html"
    if content[:8] == b"\x89PNG\r\n\x1a\n" or content[:3] == b"\xff\xd8\xff":
        return "image"
    if by_name in ("pdf", "docx", "powerpoint", "excel"):
        return "unknown"  # the name says what the content isn't
    if by_name != "unknown":
        return by_name
    try:
        return "unknown" if b"\0" in content or not content.decode("utf-8").strip() else "text"
    except UnicodeDecodeError:
        return "unknown"


def parse(content: bytes, by_name: str) -> tuple[str, str]:
    """Format and text of a file."""
    kind = detect(content, by_name)
    if kind not in PARSERS:
        raise ValueError(f"no parser for this {kind} file")
    try:
        return kind, PARSERS[kind](content)
    except (ValueError, csv.Error, RecursionError, IndexError, KeyError, OverflowError) as e:
        raise ValueError(f"a {kind} file that can't be parsed: {e}") from e
