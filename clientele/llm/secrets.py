"""Secret scans: patterns first, then candidates confirmed by their structure.

A long base64 or hex string alone proves little. It is decoded, and reported as a key only
if the bytes parse: DER with nested lengths that fill each other exactly, a key in SSH wire
format, an armoured key (base64 of its text is taken too), or a signed token whose header and claims
are JSON objects and name an algorithm. Base64 may be wrapped over lines of equal width. Of an armoured key encrypted
by headers nothing can be parsed but the headers: cipher, initial value and whole blocks confirm it. Not looked for: tokens whose
header starts with white space, hex with separators, encrypted tokens.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import column

# The base kinds. Letters in either case are ASCII ones only.
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Candidates of the structural kinds; each starts where its run of characters starts.
# Lines may end in an escaped line feed, as in JSON strings.
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}KEY-----((?:(?:\s|\\[rn])*+[A-Za-z][A-Za-z-]*+: [^\r\n\\]*+)*+)((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END [A-Z0-9 ]{0,40}KEY-----")
_CIPHER = re.compile(r"Proc-Type: 4,ENCRYPTED\b.*DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\b", re.S)
# JSON objects start with a brace and a quote, blank or line feed.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})(?=[ \t]*(?:\r?\n|$|[\"']))")
_LINE_END = re.compile(r"\\[rn]|\s")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")

KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex")
# Object numbers of password-based encryption (PKCS 5 and PKCS 12).
_ENCRYPTIONS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_SSH_NAMES = (b"ssh-", b"ecdsa-", b"sk-")
_MAX_DEPTH = 16


def _der_parts(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and bodies that fill ``data`` exactly, constructed ones checked in turn; else None."""
    parts, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        body = data[at:at + size]
        if len(body) != size or (tag & 0x20 and (depth >= _MAX_DEPTH or _der_parts(body, depth + 1) is None)):
            return None
        parts.append((tag, body))
        at += size
    return parts


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that starts with a version number or an algorithm, as key encodings do."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = _der_parts(data)
    if outer is None or len(outer) != 1:
        return False
    inner = _der_parts(outer[0][1]) or []
    if len(inner) < 2:
        return False
    (first, body), kinds = inner[0], [t for t, _ in inner]
    if first == 0x02:  # version, then algorithm and octets, or numbers, or octets
        return (len(body) == 1 and (kinds[1:3] == [0x30, 0x04] or kinds[1] == 0x04 or len(kinds) >= 6 and set(kinds) <= {0x02, 0x30})
                ) or kinds == [0x02, 0x02]
    if first != 0x30 or body[:1] != b"\x06":
        return False
    # A public key, or an encrypted private one; octets after other algorithms are digests.
    return kinds == [0x30, 0x03] or kinds == [0x30, 0x04] and body[2:].startswith(_ENCRYPTIONS)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the bytes, the first one a key type; or the private container."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0].startswith(_SSH_NAMES)


def is_key(data: bytes | None) -> bool:
    """Key bytes, or the text of an armoured key."""
    if data is None:
        return False
    return is_der_key(data) or is_ssh_key(data) or any(is_armoured_key(m) for m in _PEM.finditer(data.decode("latin-1")))


def is_armoured_key(match: re.Match) -> bool:
    """The body parses, or its headers name a cipher and the body is whole blocks of it."""
    data = _from_base64(_LINE_END.sub("", match[2]))
    cipher = _CIPHER.search(match[1])
    if data is None or cipher is None:
        return data is not None and (is_der_key(data) or is_ssh_key(data))
    return len(data) >= 16 and len(data) % (len(cipher[1]) // 2) == 0


def _from_base64(text: str) -> bytes | None:
    """Decoded, both alphabets, padding optional; None if it isn't base64."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _starts_as_key(data: bytes) -> bool:
    return data[:1] == b"\x30" or data.startswith((b"openssh-key-v1\0", b"-----BEGIN "))


def _coded_size(head: bytes) -> int:
    """Base64 characters, without padding, of DER whose first bytes are ``head``; 0 if it is none."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + more + (int.from_bytes(head[2:2 + more], "big") if more else head[1])
    return -(-size * 4 // 3) if more <= 4 else 0


def key64_spans(text: str) -> Iterator[tuple[int, int]]:
    """Base64 of a key, in one run of characters or in lines as wide as the first, the last one at most as wide.

    Only a first line that begins as a key does is followed, by as many lines as are that wide. DER says how many it
    takes; otherwise the last may belong to what follows, so the lines are tried with and without it.
    """
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done:
            continue
        if is_key(_from_base64(m[0])):
            done = m.end()
            yield m.start(), m.end()
            continue
        head = _from_base64(m[0][:40]) or b""
        if m[0].endswith("=") or not _starts_as_key(head):
            continue
        width, lines, ends = len(m[0]), [m[0]], [m.end()]
        most = -(-_coded_size(head) // width) or math.inf
        while len(lines) < most and (line := _NEXT_LINE.match(text, ends[-1])) and len(line[1]) <= width:
            lines.append(line[1])
            ends.append(line.end())
            if len(line[1]) < width or line[1].endswith("="):
                break
        for n in (len(lines), len(lines) - 1):
            if n > 1 and is_key(_from_base64("".join(lines[:n]))):
                done = ends[n - 1]
                yield m.start(), done
                break


def is_signed_token(header: str, claims: str) -> bool:
    try:
        parsed = [json.loads(_from_base64(part) or b"") for part in (header, claims)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parsed) and isinstance(parsed[0].get("alg"), str)


def _matching(pattern: re.Pattern, good: Callable[[re.Match], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if good(m))


# Kind, its spans in a text, and a cheaper pattern that every text with a match has.
_SCANS: tuple[tuple[str, Callable[[str], Iterator[tuple[int, int]]], str], ...] = (
    ("assign", _matching(_ASSIGN, lambda m: len(m[2]) >= 8), r"(?i)password|passwd|secret|token|api_?key"),
    ("access", _matching(_ACCESS, lambda m: len(m[0]) >= 16), r"AKIA[A-Z0-9]{12}"),
    ("hex", _matching(_HEX, lambda m: True), r"[0-9a-f]{32}"),
    ("pem", _matching(_PEM, is_armoured_key), r"-----BEGIN "),
    ("jwt", _matching(_JWT, lambda m: is_signed_token(m[1], m[2])), r"e[wy][A-Za-z0-9_-]{12,}\."),
    ("key64", key64_spans, r"[A-Za-z0-9+/]{40}"),
    ("keyhex", _matching(_ANY_HEX, lambda m: len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))), r"[0-9A-Fa-f]{64}"),
)


def spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed; an armoured key's body is no second finding."""
    found = {kind: list(scan(text)) for kind, scan, _ in _SCANS if kind in kinds}
    if found.get("pem") and found.get("key64"):
        starts = [a for a, _ in found["pem"]]
        inside = lambda a, b: (i := bisect_right(starts, a)) and b <= found["pem"][i - 1][1]
        found["key64"] = [s for s in found["key64"] if not inside(*s)]
    return sorted(((a, b, kind) for kind, each in found.items() for a, b in each), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``found``, an array of (kind, start, end) in code points, end exclusive.

    NULL and empty texts have none; a repeated row is scanned as often as it occurs; other
    columns are ignored; an empty table gives an empty result. Each text is scanned whole.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind_of_id = dict(docs.select(column(docs, id_col).alias("id")).dtypes)["id"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(batch.column("text")).cast(pa.large_string())
            likely = [(kind, pc.fill_null(pc.match_substring_regex(texts, quick), False)) for kind, _, quick in _SCANS]
            rows = []
            for i, text in enumerate(texts):
                kinds = tuple(kind for kind, mask in likely if mask[i].as_py())
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans(text.as_py(), kinds)] if kinds else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(span))], ["doc_id", "found"])
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(scanned, f"doc_id {kind_of_id}, found array<struct<kind: string, start: bigint, end: bigint>>")


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
