"""The readable text of an e-mail in raw form: subject and every text part, decoded once, quoted text included."""

from __future__ import annotations

import binascii
import html
import quopri
import re
from itertools import takewhile

_HEAD = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_FOLD = re.compile(r"\n[ \t]+")
_FIELD = re.compile(r"^(subject|content-type|content-transfer-encoding)[ \t]*:[ \t]*(.*)$", re.I | re.M)
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(\?=)\s+(=\?)")
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\n]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([A-Za-z0-9_.:-]+)", re.I)
_SKIPPED = re.compile(r"<(style|script)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", re.I | re.S)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|a|wbr|sub|sup|small|big|tt|code|mark)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[!/a-zA-Z][^<>]*>?")
_NOT64 = re.compile(r"[^A-Za-z0-9+/]")
_DAMAGED = re.compile(r"[Â-Å][\u0080-¿Œ-Ÿ–-™ƒˆ˜]")


def _charset(data: bytes, name: str | None) -> str:
    for c in (name, "utf-8"):
        try:
            return data.decode(c or "utf-8")
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return data.decode("utf-8" if name is None or "utf" in name.lower() else "latin-1", "replace")


def _base64(s: str) -> bytes:
    """Whatever of it can be decoded: a cut-off end is left out."""
    s = _NOT64.sub("", s)
    s = s[: len(s) - (len(s) % 4 == 1)]
    try:
        return binascii.a2b_base64(s + "=" * (-len(s) % 4))
    except binascii.Error:
        return b""


def _encoded_word(m: re.Match) -> str:
    data = _base64(m[3]) if m[2] in "bB" else quopri.decodestring(m[3].replace("_", " ").encode("utf-8", "replace"))
    return _charset(data, m[1].split("*")[0])


def decode_words(s: str) -> str:
    return _WORD.sub(_encoded_word, _BETWEEN.sub(r"\1\2", s)) if "=?" in s else s


def repaired(s: str) -> str:
    """UTF-8 that was read as a one-byte charset, read again."""
    return _DAMAGED.sub(lambda m: _reread(m[0]), s) if _DAMAGED.search(s) else s


def _reread(s: str) -> str:
    for c in ("cp1252", "latin-1"):
        try:
            return s.encode(c).decode("utf-8")
        except UnicodeError:
            pass
    return s


def html_text(s: str) -> str:
    return html.unescape(_TAG.sub("\n", _INLINE.sub("", _SKIPPED.sub(" ", s))))


def _entity(raw: str, out: list[str]) -> list[str]:
    """Appends subject and text of an entity to ``out``; returns the entities within it, each shorter than it."""
    head, _, body = raw.partition("\n\n")
    if raw.startswith("\n"):
        head, body = "", raw[1:]
    elif not _HEAD.match(head):
        head, body = "", raw
    fields = {k.lower(): v for k, v in _FIELD.findall(_FOLD.sub(" ", head))[::-1]}  # the first of repeated fields holds
    if "subject" in fields:
        out.append(decode_words(fields["subject"]))
    kind = fields.get("content-type", "text/plain")
    low = kind.lower().strip()
    if low.startswith("multipart"):
        b = _BOUNDARY.search(kind)
        mark = "--" + (b[1] or b[2]) if b and (b[1] or b[2]) else None
        if mark and mark in body:
            preamble, *parts = ("\n" + body).split("\n" + mark)
            return [part.partition("\n")[2] for part in takewhile(lambda part: not part.startswith("--"), parts)]
        low = "text/plain"
    if low.startswith("message/rfc822"):
        return [body]
    if not low.startswith("text") and "/" in low:
        return []
    coding = fields.get("content-transfer-encoding", "").strip().lower()
    name = m[1] if (m := _CHARSET.search(kind)) else None
    if coding == "base64":
        body = _charset(_base64(body), name)
    elif coding == "quoted-printable":
        body = _charset(quopri.decodestring(body.encode("utf-8", "replace")), name)
    if low.startswith("text/html"):
        body = html_text(body)
    out.append(body)
    return []


def readable(raw: str | None) -> str:
    """Subject and text parts, one after the other; empty for null."""
    if not raw:
        return ""
    out: list[str] = []
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("From "):  # the separator line of a mailbox file
        text = text.partition("\n")[2]
    rest = [text]
    while rest:
        rest += reversed(_entity(rest.pop(), out))
    return repaired("\n\n".join(out))
