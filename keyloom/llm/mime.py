"""Raw mail messages to their parts, tolerant of cut-off ends, both line endings, and broken encodings."""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple


class Part(NamedTuple):
    """A leaf of a message: its type (``text/plain``), whether it is an attachment, and its decoded text."""

    kind: str
    attached: bool
    text: str


_HEAD_END = re.compile(r"\r?\n\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_FIELD = re.compile(r"(?im)^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*([^\r\n]*)")
_PARAMETER = re.compile(r"""(?i);\s*(boundary|charset|filename|name)\s*=\s*(?:"([^"]*)"|([^\s;]+))""")
_SOFT = re.compile(r"=[ \t]*\r?\n|=[ \t]*\Z")
_ESCAPED = re.compile(rb"=([0-9A-Fa-f]{2})")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def _fields(head: str) -> tuple[str, str, str, dict[str, str]]:
    """(type, encoding, disposition, parameters) of a header block; the first field of a name counts."""
    found: dict[str, str] = {}
    for m in _FIELD.finditer(_FOLD.sub(" ", head)):
        found.setdefault(m[1].lower(), m[2])
    kind = found.get("content-type", "")
    disposition = found.get("content-disposition", "")
    parameters: dict[str, str] = {}
    for m in (*_PARAMETER.finditer(kind), *_PARAMETER.finditer(disposition)):
        parameters.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3])
    return kind.split(";")[0].strip().lower(), found.get("content-transfer-encoding", "").strip().lower(), disposition.split(";")[0].strip().lower(), parameters


def _decoded(data: bytes, charset: str) -> str:
    for name in (charset or "utf-8", "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("cp1252", "replace")


def _whole_characters(data: bytes, charset: str) -> bytes:
    """UTF-8 without the rest of a character that was cut off at the end."""
    if charset.lower() in ("", "utf-8", "utf8"):
        for k in range(1, min(4, len(data) + 1)):
            if data[-k] >= 0xC0:
                need = 2 if data[-k] < 0xE0 else 3 if data[-k] < 0xF0 else 4
                return data[:-k] if k < need else data
            if data[-k] < 0x80:
                break
    return data


def decode_body(body: str, encoding: str, charset: str) -> str:
    """A part's text with its transfer encoding and charset undone; text that isn't encoded is text already."""
    if encoding == "base64":
        kept = _NOT_BASE64.sub("", body)
        kept = kept[: len(kept) - (len(kept) % 4 == 1)]
        try:
            data = binascii.a2b_base64(kept + "=" * (-len(kept) % 4))
        except binascii.Error:
            return ""
        return _decoded(_whole_characters(data, charset), charset)
    if encoding == "quoted-printable":
        joined = _SOFT.sub("", body)
        if "=" not in joined:
            return joined
        data = _ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), joined.encode("utf-8", "surrogatepass"))
        return _decoded(_whole_characters(data, charset), charset)
    return body


def parts(message: str) -> list[Part]:
    """The text parts of a message in their order, however deep they are nested. No header of a type makes all after the
    headers plain text. An empty message has no parts.
    """
    out: list[Part] = []
    waiting = [(message, True)]
    while waiting:
        whole, top = waiting.pop()
        end = _HEAD_END.search(whole)
        if whole[:1] in "\r\n":
            head, body = "", whole.lstrip("\r\n") if top else whole[1:].removeprefix("\n")
        elif end:
            head, body = whole[: end.start()], whole[end.end() :]
        else:
            head, body = whole, ""
        kind, encoding, disposition, parameters = _fields(head)
        attached = disposition == "attachment" or (disposition != "inline" and "filename" in parameters)
        if kind.startswith("multipart/") and parameters.get("boundary"):
            mark = "--" + parameters["boundary"]
            inner: list[tuple[str, bool]] = []
            lines = re.split(rf"(?m)^{re.escape(mark)}(--)?[ \t]*\r?$\n?", body)
            for k in range(2, len(lines), 2):
                if lines[k - 1]:  # what follows the closing mark
                    break
                piece = lines[k]
                if k + 1 < len(lines):  # the line end before a mark belongs to the mark
                    piece = piece[:-2] if piece.endswith("\r\n") else piece[:-1] if piece.endswith("\n") else piece
                inner.append((piece, False))
            waiting.extend(reversed(inner))
        elif kind.startswith("text/") or not kind:
            if body:
                out.append(Part(kind or "text/plain", attached, decode_body(body, encoding, parameters.get("charset", ""))))
        elif kind == "message/rfc822" and body:
            waiting.append((decode_body(body, encoding, ""), True))
    return out


_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"(?s)<(/?)([A-Za-z][A-Za-z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)|<[!?][^>]*(?:>|\Z)")
# Elements that stand within a line and don't part words.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())


def html_text(source: str) -> str:
    """The visible text of HTML: markup out, entities undone, lines parted where elements end a line."""
    shown = _HIDDEN.sub(" ", source)
    shown = _TAG.sub(lambda m: "" if (m[2] or "").lower() in _INLINE else "\n", shown)
    return html.unescape(shown)


def readable(message: str) -> list[str]:
    """The texts a reader sees: text parts and attached text files, HTML as text."""
    return [html_text(p.text) if p.kind == "text/html" else p.text for p in parts(message)]


def plain_body(message: str) -> str | None:
    """The first text/plain part that isn't an attachment; null where there is none."""
    return next((p.text for p in parts(message) if p.kind == "text/plain" and not p.attached), None)
