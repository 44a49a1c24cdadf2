"""Text of PDF files, page by page in the order of the page tree.

Objects are found by the cross-reference tables or streams, or, where those are broken, by a scan; object streams are read. Content
streams are run by a small interpreter with an operand stack. What streams may inflate to is bounded for each file, and malformed bytes give what could
be read, never an exception.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

#: Bytes that the streams of one file may inflate to, nesting of containers and forms, and entries of a character map.
MOST_INFLATED, MOST_DEPTH, MOST_CODES = 64 << 20, 40, 1 << 17

#: What malformed bytes raise.
BROKEN = (ValueError, TypeError, IndexError, KeyError, AttributeError, StopIteration, RecursionError, OverflowError)

_SPACE = rb"\x00\t\n\f\r "
_PLAIN = rb"[^\x00\t\n\f\r ()<>\[\]{}/%]"
_LEX = re.compile(rb"(?s)(?:[" + _SPACE + rb"]+|%[^\r\n]*)*+(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?!" + _PLAIN + rb"))|/(?P<name>" + _PLAIN + rb"*)|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f" + _SPACE + rb"]*)>|(?P<text>\()|(?P<word>" + _PLAIN + rb"+)|.)")
_PART = re.compile(rb"(?s)\\[0-7]{1,3}|\\\r\n|\\.|[()]|[^\\()]+|\\")
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
#: Heads of objects, and what may stand around their values; a run of digits is tried once.
_OBJECTS = re.compile(rb"(?<!\d)(\d++)[" + _SPACE + rb"]++\d++[" + _SPACE + rb"]++obj\b")
_HEAD = re.compile(rb"[" + _SPACE + rb"]*\d+[" + _SPACE + rb"]+\d+[" + _SPACE + rb"]+obj")
_STREAM, _END_STREAM = re.compile(rb"[" + _SPACE + rb"]*stream(\r\n|\n|\r)?"), re.compile(rb"[" + _SPACE + rb"]*endstream")
_ASCII, _SURROGATE = bytes(range(0x80)), re.compile("[\ud800-\udfff]")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    head: dict
    data: bytes


class Page(NamedTuple):
    #: None where the page has no content.
    text: str | None
    #: Whether many of its characters come from fonts whose codes can't be told.
    unmapped: bool


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string from behind its opening parenthesis; parentheses may nest."""
    depth, out = 1, []
    while depth and (p := _PART.match(data, at)):
        at, part = p.end(), p[0]
        if part in (b"(", b")"):
            depth += 1 if part == b"(" else -1
            if not depth:
                break
        elif part[:1] == b"\\":
            part = bytes([int(part[1:], 8) & 255]) if part[1:2] and part[1:2] in b"01234567" else _NAMED.get(part[1:], part[1:])
        out.append(part)
    return b"".join(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values and keywords of data with the places where they end: numbers, names, strings (bytes), arrays, dictionaries, references."""
    stack: list[list] = []
    while at < len(data) and (m := _LEX.match(data, at)):
        at, kind = m.end(), m.lastgroup
        if kind is None:
            continue
        if kind == "open":
            if len(stack) >= MOST_DEPTH:
                return
            stack.append([m["open"]])
            continue
        if kind == "close":
            if not stack:
                continue
            mark, *items = stack.pop()
            value = items if mark == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        elif kind == "number":
            number = m["number"]
            value = float(number) if b"." in number else int(number[:19])
        elif kind == "name":
            name = m["name"]
            value = Name((_ESCAPED.sub(lambda h: bytes([int(h[1], 16)]), name) if b"#" in name else name).decode("latin-1"))
        elif kind == "hex":
            digits = m["hex"].translate(None, b"\x00\t\n\f\r ")
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "text":
            value, at = _literal(data, at)
        else:
            value = Word(m["word"].decode("latin-1"))
        if stack:
            if value == "R" and isinstance(value, Word) and len(stack[-1]) > 2 and isinstance(stack[-1][-2], int):
                del stack[-1][-1]
                value = Ref(stack[-1].pop())
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    """Objects by number, loaded when asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.left, self.cache = raw, MOST_INFLATED, {}
        self.trailer, self.places = {}, {}
        try:
            self._read_table()
            sound = self.places and all(self._starts(n, p) for n, p in self.places.items() if isinstance(p, int))
        except BROKEN:
            sound = False
        if not sound or not isinstance(self.get(self.trailer.get("Root")), dict):
            self._scan()

    def _starts(self, number: int, at: int) -> re.Match | None:
        return re.compile(rb"[" + _SPACE + rb"]*0*" + str(number).encode() + rb"[" + _SPACE + rb"]+\d+[" + _SPACE + rb"]+obj").match(self.raw, at)

    def _read_table(self) -> None:
        """Cross-reference sections from the newest to the oldest: what is known already is newer."""
        found = re.findall(rb"startxref\s+(\d+)", self.raw[-2048:])
        todo, seen = [int(found[-1])] if found else [], set()
        while todo and len(seen) < 1000:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.raw):
                continue
            seen.add(at)
            if m := re.compile(rb"\s*xref\b").match(self.raw, at):
                end = self.raw.find(b"trailer", m.end())
                rows = self.raw[m.end() : end].split()
                while len(rows) >= 2:
                    first, n = int(rows[0]), int(rows[1])
                    for k in range(min(n, (len(rows) - 2) // 3)):
                        place, _, state = rows[2 + 3 * k : 5 + 3 * k]
                        self.places.setdefault(first + k, int(place) if state == b"n" else None)
                    rows = rows[2 + 3 * n :]
                head = next(v for v, _ in values(self.raw, end + 7) if isinstance(v, dict))
            else:
                stream = self._object_at(at)
                head, data = stream.head, self.inflated(stream) or b""
                w = head["W"]
                span = head.get("Index") or [0, head["Size"]]
                numbers = (first + k for first, n in zip(span[::2], span[1::2]) for k in range(n))
                for number, row in zip(numbers, range(0, len(data) - sum(w) + 1, sum(w))):
                    a, b, c = row + w[0], row + w[0] + w[1], row + sum(w)
                    kind = int.from_bytes(data[row:a], "big") if w[0] else 1
                    place = int.from_bytes(data[a:b], "big")
                    self.places.setdefault(number, place if kind == 1 else (place, int.from_bytes(data[b:c], "big")) if kind == 2 else None)
            self.trailer = head | self.trailer
            todo += [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]

    def _scan(self) -> None:
        """Every object in the file, the last of a number counts; then those in object streams."""
        self.places, self.cache, self.trailer = {int(m[1][-12:]): m.start() for m in _OBJECTS.finditer(self.raw)}, {}, {}
        for number in sorted(self.places):
            value = self.get(Ref(number))
            head = value.head if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            if head.get("Type") == "ObjStm":
                for k, inner in enumerate(self._members(number)):
                    self.places.setdefault(inner, (number, k))
        for number in sorted(self.places):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)

    def _object_at(self, at: int) -> object:
        m = _HEAD.match(self.raw, at)
        value, end = next(self._first(m.end() if m else at), (None, at))
        begin = _STREAM.match(self.raw, end) if isinstance(value, dict) else None
        if not begin:
            return value
        size, start = self.get(value.get("Length")), begin.end()
        if not (isinstance(size, int) and 0 <= size <= len(self.raw) - start and _END_STREAM.match(self.raw, start + size)):
            stop = self.raw.find(b"endstream", start)
            size = (stop if stop >= 0 else len(self.raw)) - start
        return Stream(value, self.raw[start : start + size])

    def _first(self, at: int) -> Iterator[tuple[object, int]]:
        """The first value; a reference, which only containers know, as such."""
        got = []
        for value, end in values(self.raw, at):
            got.append(value)
            if not isinstance(value, int) or len(got) > 2:
                break
        if got:
            yield (Ref(got[0]) if len(got) > 2 and got[2] == "R" else got[0]), end

    def _members(self, number: int) -> list[int]:
        stream = self.get(Ref(number))
        head = [v for v, _ in values(self.inflated(stream) or b"")][: 2 * int(self.get(stream.head.get("N")) or 0)] if isinstance(stream, Stream) else []
        return [v for v in head[::2] if isinstance(v, int)]

    def _inner(self, number: int, index: int) -> object:
        """An object of an object stream."""
        stream = self.get(Ref(number))
        data = self.inflated(stream) if isinstance(stream, Stream) else None
        first = self.get(stream.head.get("First")) if data else None
        if not isinstance(first, int):
            return None
        heads = re.findall(rb"\d+", data[:first])
        return next((v for v, _ in values(data, first + int(heads[2 * index + 1]))), None) if len(heads) > 2 * index + 1 else None

    def get(self, value: object, depth: int = 0) -> object:
        """The value, or what it refers to; None where that is missing."""
        if not isinstance(value, Ref):
            return value
        if value.number not in self.cache:
            self.cache[value.number] = None  # a cycle ends here
            place = self.places.get(value.number)
            try:
                found = self._object_at(place) if isinstance(place, int) else self._inner(*place) if place else None
                self.cache[value.number] = self.get(found, depth + 1) if depth < MOST_DEPTH else None
            except BROKEN:
                pass
        return self.cache[value.number]

    def inflated(self, stream: Stream) -> bytes | None:
        """The data of a stream; None where it can't be told, or where the file has inflated to its bound."""
        filters, options = self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        options = options if isinstance(options, list) else [options]
        data = stream.data
        for k, name in enumerate(map(self.get, filters)):
            if name in ("FlateDecode", "Fl"):
                inflater = zlib.decompressobj()
                try:
                    data = inflater.decompress(data, self.left + 1)
                except zlib.error:
                    return None
                self.left -= len(data)
                if self.left < 0:
                    self.left = 0
                    return None
                data = _unpredicted(data, self.get(options[k]) if k < len(options) else None)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return None
        return data

    def pages(self) -> list[tuple[dict, dict]]:
        """(page, resources) in the order of the tree; where there is none, all pages by number."""
        root = self.get(self.trailer.get("Root"))
        out, seen, stack = [], set(), [(root.get("Pages"), {})] if isinstance(root, dict) else []
        if not stack or not isinstance(self.get(stack[0][0]), dict):
            stack = [(Ref(n), {}) for n in sorted(self.places, reverse=True) if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Pages" and "Parent" not in v]
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            own = self.get(node.get("Resources"))
            own = own if isinstance(own, dict) else above
            kids = self.get(node.get("Kids"))
            if node.get("Type") == "Page" or (not isinstance(kids, list) and "Contents" in node):
                out.append((node, own))
            elif isinstance(kids, list):
                stack += [(k, own) for k in reversed(kids)]
        if out:
            return out
        loose = [v for n in sorted(self.places) if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Page"]
        return [(v, r if isinstance(r := self.get(v.get("Resources")), dict) else {}) for v in loose]

    def text_of(self, page: dict, resources: dict) -> Page:
        contents = page.get("Contents")
        found = self.get(contents)
        streams = [self.get(x) for x in found] if isinstance(found, list) else [found]
        streams = [s for s in streams if isinstance(s, Stream)]
        if not streams:
            return Page(None, False)
        parts = [self.inflated(s) for s in streams]
        if any(p is None for p in parts):
            return Page("", False)
        shown = _Shown()
        self._run(b"\n".join(parts), resources, shown, 0)
        return Page("\n".join(p for p in shown.pieces if p.strip()), shown.unmapped)

    def _run(self, data: bytes, resources: dict, shown: _Shown, depth: int) -> None:
        """Run a content stream: each text-showing operator gives one piece."""
        fonts, forms = self.get(resources.get("Font")), self.get(resources.get("XObject"))
        operands, codes, at = [], None, 0
        while at < len(data):
            for value, end in values(data, at):
                at = end
                if not isinstance(value, Word):
                    operands = [*operands[-31:], value]
                    continue
                if value == "ID":  # an image among the operators
                    stop = re.compile(rb"[" + _SPACE + rb"]EI(?=[" + _SPACE + rb"]|$)").search(data, end)
                    at = stop.end() if stop else len(data)
                elif value == "Tf" and len(operands) > 1 and isinstance(fonts, dict):
                    codes = self._codes(fonts.get(operands[-2]))
                elif value in ("Tj", "'", '"') and operands and isinstance(operands[-1], bytes):
                    shown.add([operands[-1]], codes)
                elif value == "TJ" and operands and isinstance(operands[-1], list):
                    shown.add([x for x in operands[-1] if isinstance(x, bytes)], codes)
                elif value == "Do" and operands and isinstance(forms, dict) and depth < 8:
                    form = self.get(forms.get(operands[-1]))
                    if isinstance(form, Stream) and form.head.get("Subtype") == "Form" and (inner := self.inflated(form)):
                        own = self.get(form.head.get("Resources"))
                        self._run(inner, own if isinstance(own, dict) else resources, shown, depth + 1)
                operands = []
                if value == "ID":
                    break
            else:
                return

    def _codes(self, ref: object) -> Codes | None:
        font = self.get(ref)
        table = self.get(font.get("ToUnicode")) if isinstance(font, dict) else None
        if not isinstance(table, Stream):
            return None
        key = ("codes", id(table))
        if key not in self.cache:
            self.cache[key] = Codes(self.inflated(table) or b"")
        return self.cache[key]


class Codes:
    """A font's map from codes to text."""

    def __init__(self, data: bytes):
        self.width, self.ranges, held = 1, [], []
        self.single = _Single(self.ranges)
        for value, _ in values(data):
            if not isinstance(value, Word):
                held.append(value)
                continue
            if value == "endcodespacerange" and held and isinstance(held[-1], bytes):
                self.width = max(1, len(held[-1]))
            elif value == "endbfchar":
                for a, b in zip(held[::2], held[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes) and len(self.single) < MOST_CODES:
                        self.single[int.from_bytes(a, "big")] = b.decode("utf-16-be", "replace")
            elif value == "endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    if isinstance(to, list):
                        self.single.update({low + k: x.decode("utf-16-be", "replace") for k, x in enumerate(to[: high - low + 1]) if isinstance(x, bytes)})
                    elif isinstance(to, bytes) and len(self.ranges) < MOST_CODES:
                        self.ranges.append((low, high, to))
            held = []

    def text(self, data: bytes) -> str:
        if self.width == 2 and len(data) % 2 == 0:
            codes = struct.unpack(f">{len(data) // 2}H", data)
        else:
            codes = [int.from_bytes(data[k : k + self.width], "big") for k in range(0, len(data), self.width)]
        out = "".join(map(self.single.__getitem__, codes))
        # a character outside the first plane is a pair of codes; half of one can't be told
        return out.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace") if _SURROGATE.search(out) else out


class _Single(dict):
    """Texts of codes; those of ranges are made when they are asked for."""

    def __init__(self, ranges: list[tuple[int, int, bytes]]):
        self.ranges = ranges

    def __missing__(self, code: int) -> str:
        self[code] = "�"
        for low, high, to in self.ranges:
            if low <= code <= high:
                last = int.from_bytes(to[-2:], "big") + code - low
                found = to[:-2] + (last & 0xFFFF).to_bytes(2, "big")
                self[code] = found.decode("utf-16-be", "surrogatepass" if len(found) == 2 else "replace")
                break
        return self[code]


class _Shown:
    def __init__(self):
        self.pieces: list[str] = []
        self.unmapped = False

    def add(self, strings: list[bytes], codes: Codes | None) -> None:
        out = []
        for s in strings:
            if codes:
                out.append(codes.text(s))
            elif s[:2] == b"\xfe\xff":
                out.append(s[2:].decode("utf-16-be", "replace"))
            else:
                self.unmapped |= len(s.translate(None, _ASCII)) > max(2, len(s) // 4)
                out.append(s.decode("latin-1"))
        self.pieces.append("".join(out))


def _unpredicted(data: bytes, options: object) -> bytes:
    """Rows of which each byte was written as a difference (PNG filters none, sub and up, which streams of numbers use)."""
    if not isinstance(options, dict) or not isinstance(options.get("Predictor"), int) or options["Predictor"] < 10:
        return data
    width = int(options.get("Columns") or 1) * int(options.get("Colors") or 1) * int(options.get("BitsPerComponent") or 8) // 8
    above, out = bytearray(width), []
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        if kind == 1:
            for i in range(1, len(row)):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind == 2:
            for i in range(len(row)):
                row[i] = (row[i] + above[i]) & 255
        out.append(bytes(row))
        above = row + bytearray(width - len(row))
    return b"".join(out)


def pages_of(raw: bytes) -> list[Page]:
    """The pages of a file; none where no page can be found. A page that can't be read is empty."""
    try:
        document = Document(raw)
        found = document.pages()
    except BROKEN:
        return []
    out = []
    for page, resources in found:
        try:
            out.append(document.text_of(page, resources))
        except BROKEN:
            out.append(Page("", False))
    return out
