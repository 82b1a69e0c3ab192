"""A small reader of the text layer of simple PDF files: plain or deflated content streams with Tj, TJ, ' and "."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"(<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>)\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_OPERATION = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+|/\S+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _stream_text(data: bytes) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    row: float | None = None
    for m in _OPERATION.finditer(data):
        t = m[0]
        if t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for s in stack:
                if s[:1] in b"(<":
                    out.append(_string(s))
                elif t == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", s) and float(s) < -200:
                    out.append(" ")
            stack = []
        elif t in (b"Td", b"TD", b"Tm", b"T*"):
            if t == b"T*":
                out.append("\n")
            else:
                numbers = [float(s) for s in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", s)]
                y = numbers[-1] if numbers else 0.0
                moved = y != 0 if t != b"Tm" else row is not None and y != row
                row = y if t == b"Tm" else row
                if moved and out and out[-1] != "\n":
                    out.append("\n")
            stack = []
        elif t == b"ET":
            if out and out[-1] != "\n":
                out.append("\n")
            stack = []
        elif t[:1].isalpha():
            stack = []
        else:
            stack.append(t)
    return "".join(out)


def embedded_text(content: bytes) -> str:
    """The text layer of a PDF file; raises ValueError if it isn't one or is encrypted."""
    if not content[:1024].lstrip().startswith(b"%PDF"):
        raise ValueError("Invalid PDF structure")
    if re.search(rb"/Encrypt\s+\d+", content):
        raise ValueError("Password required")
    parts = []
    for m in _STREAM.finditer(content):
        data = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", data):
            parts.append(_stream_text(data).strip("\n"))
    return "\n\n".join(parts)


def text_pdf(text: str, encrypted: bool = False) -> bytes:
    """A PDF file whose text layer is ``text``, without line feeds at its ends as embedded_text() reads it."""
    shown = "\nT*\n".join(f"<{(chr(0xFEFF) + line).encode('utf-16-be', 'replace').hex()}> Tj" for line in text.split("\n"))
    stream = zlib.compress(f"BT\n{shown}\nET".encode())
    secret = b"trailer << /Encrypt 2 0 R >>\n" if encrypted else b""
    return b"%%PDF-1.4\n%s1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (secret, len(stream), stream)
