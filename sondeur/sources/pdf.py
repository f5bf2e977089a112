"""The text of PDF files: content streams in the order of pages, with fonts' own maps to Unicode where they have them.

It reads plain and deflated streams, object streams, literal and hexadecimal strings, and the operators that show text.
Encrypted files and fonts without a map or a Latin encoding give no useful text; a file that can't be read gives none.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]?|%[^\r\n]*", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(head: bytes, data: bytes) -> bytes:
    if b"/FlateDecode" not in head and b"/Fl " not in head:
        return data
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


class _File:
    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[bytes, bytes]] = {}  # dictionary, stream
        for m in _OBJECT.finditer(data):
            s = _STREAM.match(m[2])
            self.objects[int(m[1])] = (s[1], _inflated(s[1], s[2])) if s else (m[2], b"")
        for head, body in list(self.objects.values()):
            if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
                at = int(first[1])
                numbers = [int(x) for x in body[:at].split()]
                places = numbers[1::2]
                for number, a, b in zip(numbers[::2], places, [*places[1:], len(body) - at], strict=True):
                    self.objects.setdefault(number, (body[at + a : at + b], b""))

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """The objects that an entry refers to: one, or an array of them."""
        m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def inner(self, head: bytes, key: bytes) -> bytes:
        """An entry's dictionary, which stands in place or is referred to."""
        m = re.search(key + rb"\s*(<<|\d+\s+\d+\s+R)", head)
        if not m:
            return b""
        if m[1] != b"<<":
            return self.objects.get(int(m[1].split()[0]), (b"", b""))[0]
        depth, at = 0, m.start(1)
        for t in re.finditer(rb"<<|>>", head[at:]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return head[at : at + t.end()]
        return head[at:]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(resources, content) of each page, in order."""
        tree = {n: h for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages?\b", h)}
        inner = {k for h in tree.values() for k in self.refs(h, rb"/Kids")}
        out: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()

        def go(n: int, resources: bytes) -> None:
            if n in seen or n not in tree:
                return
            seen.add(n)
            own = self.inner(tree[n], rb"/Resources") or resources
            for k in self.refs(tree[n], rb"/Kids"):
                go(k, own)
            if not re.search(rb"/Type\s*/Pages\b", tree[n]):
                out.append((own, b"\n".join(self.objects.get(c, (b"", b""))[1] for c in self.refs(tree[n], rb"/Contents"))))

        for n in sorted(tree, key=lambda n: (n in inner, n)):
            go(n, b"")
        return out

    def fonts(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """Each font's map from codes to text; empty for fonts without one."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.inner(resources, rb"/Font")):
            head = self.objects.get(int(number), (b"", b""))[0]
            maps = self.refs(head, rb"/ToUnicode")
            out[name] = _unicode_map(self.objects.get(maps[0], (b"", b""))[1]) if maps else {}
        return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(a.decode())] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", part):
            first, last, width = int(a, 16), int(b, 16), len(a) // 2
            each = re.findall(rb"<([0-9A-Fa-f]+)>", to)
            for k in range(min(last - first + 1, 65_536)):
                if to.startswith(b"["):
                    made = text(each[k]) if k < len(each) else ""
                else:
                    start = text(each[0])
                    made = start[:-1] + chr(ord(start[-1]) + k) if start else ""
                out[(first + k).to_bytes(width, "big")] = made
    return out


def _bytes(token: bytes) -> bytes:
    """The bytes of a string of either kind."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match[bytes]) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.DOTALL)


def _decoded(data: bytes, font: dict[bytes, str]) -> str:
    if not font:
        return data.decode("cp1252", "replace")
    width = len(next(iter(font)))
    return "".join(font.get(data[i : i + width], "") for i in range(0, len(data), width))


def _shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    font: dict[bytes, str] = {}
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789" and t not in (b"<<", b">>"):
            stack.append(t)
            continue
        if t == b"Tf":
            font = next((fonts.get(x[1:], {}) for x in reversed(stack) if x.startswith(b"/")), {})
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_decoded(_bytes(x), font))
                elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:  # a gap as wide as a blank
                    out.append(" ")
        elif t in (b"T*", b"ET", b"Tm") or (t in (b"Td", b"TD") and stack and float(stack[-1] if stack[-1][:1] in b"+-.0123456789" else b"0")):
            out.append("\n")
        elif t in (b"Td", b"TD"):
            out.append(" ")
        stack.clear()
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def pdf_text(data: bytes) -> str:
    """The text of a file's pages, a line end between them; empty for what can't be read."""
    if b"/Encrypt" in data:
        return ""
    try:
        file = _File(data)
        return "\n".join(x for r, c in file.pages() if (x := _shown(c, file.fonts(r))))
    except (ValueError, IndexError, RecursionError):
        return ""
