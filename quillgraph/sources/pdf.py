"""Text of PDFs, page by page, as runs with size and place; no library beyond zlib.

It reads what papers mostly are: plain and Flate streams, object streams, simple fonts and fonts with a ToUnicode map.
Encrypted files, scans and other filters give no text, which the quality rules then call no-text.

Defined results: a file that is no PDF, or is damaged beyond its objects, has no pages; a page without text is an empty
page; nothing is raised for a file's content.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|<<|>>|[\[\]]|/[^\s()<>\[\]/%]*|[-+.\d][-+.\d]*|[A-Za-z'\"*]+\d?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift back of so many thousandths of the size inside a line is a space.
GAP = 200
MOST_BYTES = 200_000_000


class Run(NamedTuple):
    text: str
    size: float
    top: float
    left: float


def _inflated(body: bytes) -> bytes:
    """The data of an object's stream; nothing for filters other than Flate."""
    m = _STREAM.search(body)
    if not m:
        return b""
    head, data = body[: m.start()], m[1]
    if b"/Filter" not in head:
        return data
    if b"/FlateDecode" not in head or re.search(rb"/(?:DCT|LZW|ASCII85|CCITT|JPX|JBIG2)", head):
        return b""
    try:
        return zlib.decompressobj().decompress(data, MOST_BYTES)
    except zlib.error:
        return b""


def _objects(raw: bytes) -> dict[int, bytes]:
    """The bodies of all objects by number, those of object streams too; the last one of a number counts."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(found.values()):
        if b"/ObjStm" not in body or not (first := re.search(rb"/First\s+(\d+)", body)):
            continue
        data, at = _inflated(body), int(first[1])
        numbers = [int(x) for x in re.findall(rb"\d+", data[:at])]
        pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
        for (n, start), (_, end) in zip(pairs, [*pairs[1:], (0, len(data) - at)], strict=True):
            found.setdefault(n, data[at + start : at + end])
    return found


def _value(body: bytes, key: bytes, objects: dict[int, bytes]) -> bytes:
    """What stands at a key of a dictionary: a reference is followed; a dictionary or list is given whole."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
    if not m:
        return b""
    rest = body[m.end() :]
    if ref := _REF.match(rest):
        return objects.get(int(ref[1]), b"")
    for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
        if rest.startswith(opening):
            depth = 0
            for t in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                depth += 1 if t[0] == opening else -1
                if not depth:
                    return rest[: t.end()]
    return rest.split(b"/", 1)[0] if not rest.startswith(b"/") else rest


def _pages(objects: dict[int, bytes]) -> list[tuple[bytes, bytes]]:
    """(page, its resources) in reading order: down the page tree, or by number where there is none."""
    out: list[tuple[bytes, bytes]] = []
    seen: set[int] = set()

    def walk(n: int, above: bytes) -> None:
        body = objects.get(n, b"")
        if n in seen or not body:
            return
        seen.add(n)
        resources = _value(body, b"Resources", objects) or above
        if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body):
            out.append((body, resources))
        for kid in _REF.findall(_value(body, b"Kids", objects)):
            walk(int(kid), resources)

    for body in list(objects.values()):
        if re.search(rb"/Type\s*/Catalog", body) and (root := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)):
            walk(int(root[1]), b"")
    if not out:
        for n in sorted(objects):
            if re.search(rb"/Type\s*/Page(?![a-zA-Z])", objects[n]):
                walk(n, b"")
    return out


def _map_of(font: bytes, objects: dict[int, bytes]) -> tuple[int, dict[int, str]] | None:
    """(bytes a code, code -> text) of a font's ToUnicode map."""
    m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
    if not m:
        return None
    data, codes, width = _inflated(objects.get(int(m[1]), b"")), {}, 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, codes[int(a, 16)] = max(width, len(a) // 2), text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, first = max(width, len(a) // 2), text(b)
            for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                codes[int(a, 16) + k] = first[:-1] + chr(ord(first[-1]) + k) if first else ""
    return width, codes


def _bytes_of(token: bytes) -> bytes:
    """A string token's bytes."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _spelt(raw: bytes, known: tuple[int, dict[int, str]] | None) -> str:
    if known is None:
        return raw.decode("cp1252", "replace")
    width, codes = known
    return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _runs(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]] | None]) -> Iterator[Run]:
    """What a content stream shows, in its order."""
    stack: list[bytes] = []
    font, size, leading, scale, x, y = None, 1.0, 0.0, 1.0, 0.0, 0.0

    def number(k: int) -> float:
        try:
            return float(stack[k])
        except (ValueError, IndexError):
            return 0.0

    def shown(tokens: list[bytes]) -> str:
        out = []
        for t in tokens:
            if t[:1] in b"(<" and t not in (b"<<",):
                out.append(_spelt(_bytes_of(t), font))
            elif t not in (b"[", b"]"):
                try:
                    out.append(" " if float(t) < -GAP else "")
                except ValueError:
                    pass
        return "".join(out)

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(</[]" or t[:1] in b"+-.0123456789":
            stack.append(t)
            continue
        if t == b"BT":
            scale, x, y = 1.0, 0.0, 0.0
        elif t == b"Tf" and len(stack) > 1:
            font, size = fonts.get(stack[-2][1:]), number(-1)
        elif t == b"TL":
            leading = number(-1)
        elif t == b"Tm" and len(stack) > 5:
            scale, x, y = abs(number(-3)) or 1.0, number(-2), number(-1)
        elif t in (b"Td", b"TD"):
            x, y = x + number(-2) * scale, y + number(-1) * scale
            leading = -number(-1) if t == b"TD" else leading
        elif t in (b"T*", b"'", b'"'):
            y -= leading * scale
        if t in (b"Tj", b"TJ", b"'", b'"') and (text := shown(stack if t == b"TJ" else stack[-1:])):
            yield Run(text, abs(size) * scale, y, x)
        stack = []


def pages_of(raw: bytes) -> list[list[Run]]:
    """The runs of each page."""
    if b"%PDF-" not in raw[:1024] or b"/Encrypt" in raw[-2048:]:
        return []
    objects = _objects(raw)
    out = []
    for page, resources in _pages(objects):
        listed = _value(resources, b"Font", objects)
        fonts = {name: _map_of(objects.get(int(n), b""), objects) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed)}
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(_inflated(objects.get(int(n), b"")) for n in _REF.findall(m[1])) if m else b""
        out.append(list(_runs(content, fonts)))
    return out


def text_of(runs: list[Run]) -> str:
    """Runs as lines: a new line where the place moves up or down by half a size, a space where it moves on."""
    out, last = "", None
    for r in runs:
        if last is not None:
            if abs(last.top - r.top) > max(last.size, r.size) / 2:
                out += "\n"
            elif r.left != last.left and not out.endswith(" ") and not r.text.startswith(" "):
                out += " "
        out, last = out + r.text, r
    return out


def read_pdfs(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, page, text, runs) of the PDFs below a folder, pages from 1; a file is read by one task, and its bytes stay there."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, raw in zip(f["path"], f["content"], strict=True):
                pages = pages_of(bytes(raw))
                if not pages:
                    continue
                yield pd.DataFrame({"path": [where] * len(pages), "page": range(1, len(pages) + 1), "text": [text_of(p) for p in pages], "runs": [[r._asdict() for r in p] for p in pages]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(make, "path string, page int, text string, runs array<struct<text:string,size:double,top:double,left:double>>")


def front_runs(pages: DataFrame) -> DataFrame:
    """(work_id, text, size, top, left) of the first pages, as `operators.text.front_titles` takes them; the path stands for the work."""
    return pages.filter("page = 1").select(F.col("path").alias("work_id"), F.explode("runs").alias("r")).select("work_id", "r.*")
