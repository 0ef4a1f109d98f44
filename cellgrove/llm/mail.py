"""Reading raw mails: MIME parts, transfer encodings, HTML as a person reads it, quote marks, signatures.

Small helpers on one text each; Spark partitions the texts and calls them from mapInPandas.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

_HEADER = re.compile(r"([!-9;-~]+):[ \t]*(.*(?:\n[ \t].*)*)\n?")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_NOT64 = re.compile(r"[^A-Za-z0-9+/]")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_BREAK = re.compile(r"<\s*br\b[^>]*>|</?\s*(?:tr|li|ul|ol|table|h[1-6]|hr|blockquote|pre|html|body)\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?\s*(?:p|div)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
WORD = re.compile(r"[^\W_]+")


#: Characters of text that a task works on at once.
CHUNK = 2_000_000


def chunks(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = CHUNK) -> Iterator[pd.DataFrame]:
    """The rows of the batches in slices of about `chars` characters of text, so that memory does not follow the batch."""
    for pdf in batches:
        size = pdf[column].map(lambda t: len(t) if t else 0).to_numpy()
        part = (size.cumsum() - size) // chars
        for _, rows in pdf.groupby(part, sort=True):
            yield rows


@dataclass
class Part:
    kind: str  # plain or html
    attached: bool
    text: str  # decoded; of HTML what a person reads; quote marks still there


def _headers(raw: str) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the body starts."""
    found, at = {}, 0
    while m := _HEADER.match(raw, at):
        found.setdefault(m[1].lower(), m[2].strip())
        at = m.end()
    return found, at + 1 if raw[at : at + 1] == "\n" else at


def _bytes_to_text(data: bytes, charset: str) -> str:
    """The bytes in the named charset; under an unknown name in UTF-8, and where that does not fit in Latin-1."""
    try:
        charset = codecs.lookup(charset).name
    except LookupError:
        charset = "utf-8"
    try:
        return data.decode(charset)
    except (UnicodeDecodeError, LookupError):  # LookupError: a codec that is none of characters
        return data.decode("iso-8859-1")


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        clean = _NOT64.sub("", body)
        clean = clean[:-1] if len(clean) % 4 == 1 else clean
        return _bytes_to_text(binascii.a2b_base64(clean + "=" * (-len(clean) % 4)), charset)
    if encoding == "quoted-printable":
        plain = body.isascii()
        data = binascii.a2b_qp(body.encode("ascii" if plain else "utf-8"))
        return _bytes_to_text(data, charset if plain else "utf-8")
    return body


def html_text(source: str) -> str:
    """What a person reads: hidden parts and tags gone, entities resolved; lines end at <br>, paragraphs at <p>, <div>."""
    source = _HIDDEN.sub("", source)
    source = _BREAK.sub("\n", source.replace("\n", " "))
    source = _TAG.sub("", _BLOCK.sub("\n\n", source))
    return html.unescape(source).replace("\xa0", " ").replace("\xad", "")


def parts(raw: str | None) -> list[Part]:
    """The text parts of a mail, attachments of type text included. A null or empty text has none.

    A missing closing boundary ends at the end; an unreadable transfer encoding leaves the part as it stands.
    """
    out: list[Part] = []
    stack = [raw.replace("\r\n", "\n")] if raw else []
    while stack:
        head, start = _headers(here := stack.pop())
        kind = head.get("content-type", "text/plain")
        body, low = here[start:], kind.lower()
        if low.startswith("multipart/") and (b := _BOUNDARY.search(kind)):
            mark = "\n--" + (b[1] if b[1] is not None else b[2])
            pieces = ("\n" + body).split(mark)
            inner = []
            for p in pieces[1:]:
                if p.startswith("--"):
                    break
                inner.append(p[1:] if p.startswith("\n") else p.partition("\n")[2])
            stack.extend(reversed(inner))
        elif low.startswith("text/"):
            charset = m[1].lower() if (m := _CHARSET.search(kind)) else "utf-8"
            try:
                text = _decoded(body, head.get("content-transfer-encoding", "").strip().lower(), charset)
            except (binascii.Error, ValueError):
                text = body
            is_html = low.startswith("text/html")
            out.append(Part("html" if is_html else "plain", head.get("content-disposition", "").lower().startswith("attachment"), html_text(text) if is_html else text))
    return out


def unquoted(text: str) -> str:
    """The text without the quote marks that its lines begin with."""
    return _QUOTE.sub("", text)


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def _without_signature(text: str, paragraphs_are_lines: bool) -> str:
    """Drops signatures (from a line -- on, at most six lines that are short and end no sentence, or hold many digits), attribution lines, and the
    header lines of a forwarded message. In HTML each line of a signature is a paragraph, in plain text a blank ends it."""
    keep: list[str] = []
    left, headers = 0, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare == "--":
            left = 6
            continue
        if left:
            if not bare:
                if not paragraphs_are_lines:
                    left = 0
                keep.append("")
                continue
            digits = sum(map(str.isdigit, bare))
            if not bare.startswith("__") and (bare[-1] not in ".,;:!?" and bare.count(" ") < 6 or digits >= 4 and 4 * digits >= len(bare) - bare.count(" ")):
                left -= 1
                continue
            left = 0
        if bare.startswith("-----") and bare.endswith("-----"):
            headers = True
            keep.append("")
            continue
        if headers and bare and re.match(r"[A-Za-z-]+:", bare):
            continue
        headers = headers and not bare
        if bare.endswith(":") and re.search(r"\d\d|\?,", bare) and bare.count(" ") < 16:
            keep.append("")
            continue
        keep.append(bare)
    return "\n".join(keep)


def body(raw: str | None) -> str:
    """The body as written: no headers, attachments and signatures, quoted text and notices included without marks.

    An HTML part that mostly repeats the words of the plain parts is the same body once more and left out.
    """
    own = [p for p in parts(raw) if not p.attached]
    plain = [_without_signature(unquoted(p.text), False) for p in own if p.kind == "plain"]
    rich = [_without_signature(unquoted(p.text), True) for p in own if p.kind == "html"]
    if plain and rich:
        known = set(words("\n".join(plain)))
        rich = [t for t in rich if (w := set(words(t))) and len(w & known) < 0.6 * len(w)]
    return "\n\n".join(plain + rich)


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_LETTERS = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """Each sentence as its words (runs of letters, lower case); blank lines end sentences too, empty ones are left out."""
    return [w for s in _SENTENCE.split(text.lower()) if (w := _LETTERS.findall(s))]
