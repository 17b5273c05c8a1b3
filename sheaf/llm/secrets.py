"""Secret scan with structural confirmation.

Candidates are PEM blocks, three-part tokens, long base64 or hexadecimal runs (also wrapped over lines) and values given to a name
like token or api key; each is decoded and its structure parsed to the end, and only what parses is reported:

* ``signed_token``: a header that is a JSON object with an ``alg``, a JSON payload and a base64url signature;
* ``der_key``: an ASN.1 SEQUENCE whose nested lengths fill it exactly and whose fields are those of a PKCS#1, DSA, SEC1 or PKCS#8
  private key, the key inside PKCS#8 included; ``encrypted_key``: PKCS#8 encrypted, or PEM with the headers of an encryption;
* ``openssh_key``: the openssh-key-v1 magic with its length-prefixed fields; ``ssh_public_key``: length-prefixed fields that name a key type (reported, not secret);
* ``checked_token``: a prefixed token whose last six characters are the check sum of the thirty before;
* ``assigned_key``: a value given to such a name that decodes from hexadecimal, base64 or a UUID to 15 bytes or more of high variety.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import map_batches, table
from sheaf.llm.words import slices

_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_HEADER = re.compile(r"\s*[A-Za-z][A-Za-z0-9\-]*:[^\n]*")
_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{20,}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_\-])(eyJ[A-Za-z0-9_\-]{8,})\.([A-Za-z0-9_\-]{2,})\.([A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_\-])")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{32,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:M[C-I]|b3BlbnNza|AAAA)[A-Za-z0-9+/]{38,74}(?:\r?\n[ \t]*[A-Za-z0-9+/]{40,76})*\r?\n[ \t]*[A-Za-z0-9+/]{1,76}={0,2}(?![A-Za-z0-9+/])")
_CHECKED = re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_ASSIGNED = re.compile(
    r"(?i:token|secret|passwd|password|api[_\-]?key|access[_\-]?key(?:[_\-]?id)?|auth[_\-]?key|private[_\-]?key|encryption[_\-]?key|signing[_\-]?key|credentials?)"
    r"[\"'`]?\s*(?::=|=>|=|:)\s*[\"'`]?([A-Za-z0-9+/_\-]{20,}={0,2})(?![A-Za-z0-9+/_\-.])"
)
_HEX = re.compile(r"(?:[0-9a-f]{2})+\Z|(?:[0-9A-F]{2})+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Least bytes of an assigned key.
KEY_BYTES = 15
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_RSA, _EC, _DSA = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401"))
_EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}


def _decode(s: str) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str) -> dict | None:
    raw = _decode(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER elements that fill ``raw`` exactly; None where lengths don't add up."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw):
                return None
            n = int.from_bytes(raw[at : at + k], "big")
            at += k
            if n < 128 or n >> (8 * (k - 1)) == 0:
                return None
        if at + n > len(raw):
            return None
        out.append((tag, raw[at : at + n]))
        at += n
    return out


def nested(raw: bytes, depth: int = 0) -> bool:
    """Whether DER lengths add up in ``raw`` and in all it holds."""
    items = der_items(raw)
    return items is not None and depth < 32 and all(not tag & 0x20 or nested(body, depth + 1) for tag, body in items)


def _integers(fields: list[tuple[int, bytes]], n: int) -> bool:
    return len(fields) >= n and all(tag == 2 and body and (len(body) == 1 or body[0] or body[1] & 0x80) for tag, body in fields[:n])


def _pkcs1(raw: bytes) -> bool:
    fields = _sequence(raw)
    return bool(fields) and _integers(fields, 9) and fields[0][1] in (b"\0", b"\1") and len(fields) - 9 == fields[0][1][0]


def _sec1(raw: bytes) -> bool:
    fields = _sequence(raw)
    return bool(fields) and [t for t, _ in fields[:2]] == [2, 4] and fields[0][1] == b"\1" and 20 <= len(fields[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t, _ in fields[2:])


def _sequence(raw: bytes) -> list[tuple[int, bytes]] | None:
    outer = der_items(raw)
    return der_items(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None


def der_kind(raw: bytes) -> str | None:
    """What private key a DER SEQUENCE is, if any."""
    fields = _sequence(raw)
    if not fields or not nested(raw):
        return None
    tags = [t for t, _ in fields]
    if _pkcs1(raw) or _sec1(raw) or (len(fields) == 6 and _integers(fields, 6) and fields[0][1] == b"\0"):
        return "der_key"
    algorithm = der_items(fields[0 if tags[0] == 0x30 else 1][1]) if len(fields) > 1 and 0x30 in tags[:2] else None
    if not algorithm or algorithm[0][0] != 6:
        return None
    if tags == [0x30, 4]:
        return "encrypted_key" if len(algorithm) == 2 and len(fields[1][1]) >= 8 and len(fields[1][1]) % 8 == 0 else None
    if tags[:3] != [2, 0x30, 4] or fields[0][1] not in (b"\0", b"\1"):
        return None
    name, key = algorithm[0][1], fields[2][1]
    inner = der_items(key)
    if name == _RSA:
        fine = _pkcs1(key)
    elif name == _EC:
        fine = _sec1(key)
    elif name in _EDWARDS:
        fine = bool(inner) and len(inner) == 1 and inner[0][0] == 4 and len(inner[0][1]) == _EDWARDS[name]
    elif name == _DSA:
        fine = bool(inner) and len(inner) == 1 and _integers(inner, 1)
    else:
        fine = bool(inner) and nested(key)
    return "der_key" if fine else None


def _prefixed(raw: bytes) -> list[bytes] | None:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def binary_kind(raw: bytes) -> str | None:
    """What key encoding these bytes hold, if any."""
    if raw[:1] == b"\x30":
        return der_kind(raw)
    magic = b"openssh-key-v1\0"
    if raw.startswith(magic):
        at, fields = len(magic), []
        for _ in range(3):  # cipher, kdf, kdf options
            n = int.from_bytes(raw[at : at + 4], "big")
            fields.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        rest = _prefixed(raw[at + 4 :]) if at + 4 <= len(raw) else None
        return "openssh_key" if rest and len(rest) >= 2 and fields[0].isascii() and fields[0] else None
    if raw[:3] == b"\0\0\0":
        fields = _prefixed(raw)
        if fields and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-)[a-z0-9@.\-]+", fields[0]):
            return "ssh_public_key"
    return None


def _pem(body: str) -> str | None:
    """What the text between the lines of a PEM block holds."""
    lines, headers = body.replace("\\r", "").replace("\\n", "\n").split("\n"), ""
    while lines and (not lines[0].strip() or _PEM_HEADER.fullmatch(lines[0])):
        headers += lines.pop(0)
    raw = _decode("".join("".join(lines).split()))
    if not raw:
        return None
    if "ENCRYPTED" in headers:
        return "encrypted_key" if "DEK-Info" in headers and len(raw) % 8 == 0 and len(raw) >= 32 else None
    return binary_kind(raw)


def _base62(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _varied(value: str) -> bool:
    """Whether an assigned value looks drawn at random: it decodes, and its bytes and characters vary as random ones do."""
    if _UUID.match(value):
        raw = bytes.fromhex(value.replace("-", ""))
    elif _HEX.match(value):
        raw = bytes.fromhex(value)
    else:
        raw = _decode(value)
        signs = sum(not c.isalnum() for c in value.rstrip("="))
        if raw is None or signs > 0.15 * len(value) or not (any(map(str.isdigit, value)) and any(map(str.islower, value)) and any(map(str.isupper, value))):
            return False
    return len(raw) >= KEY_BYTES and len(set(raw)) >= 0.6 * min(len(raw), 100)


def confirm(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed secrets of a text, in order, none overlapping."""
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str | None) -> None:
        if kind and not any(x < b and a < y for x, y, _ in out):
            out.append((a, b, kind))

    if "PRIVATE KEY-----" in text:
        at: dict[str, int] = {}
        for m in _BEGIN.finditer(text):
            close = f"-----END {m[1]}-----"
            if at.get(m[1], 0) >= 0 and at.get(m[1], 0) < m.end():
                at[m[1]] = text.find(close, m.end())
            if (end := at[m[1]]) >= 0:
                add(m.start(), end + len(close), _pem(text[m.end() : end]))
    runs = list(_RUN.finditer(text))
    if not runs:
        return out
    for m in _WRAPPED.finditer(text):
        for end in (m.end(), m.start() + m[0].rindex("\n")):  # the last line may be none of it
            raw = _decode("".join(text[m.start() : end].split()))
            if raw and (kind := binary_kind(raw)):
                add(m.start(), end, kind)
                break
    for run in runs:
        lo, piece = run.start(), run[0]
        if len(piece) < 32:
            continue
        for m in _TOKEN.finditer(piece):
            head = _json(m[1])
            if head and isinstance(head.get("alg"), str) and _json(m[2]) is not None and _decode(m[3]):
                add(lo + m.start(), lo + m.end(), "signed_token")
        for m in _CHECKED.finditer(piece):
            add(lo + m.start(), lo + m.end(), "checked_token" if _base62(binascii.crc32(m[1].encode())) == m[2] else None)
        for m in _BLOB.finditer(piece):
            value = m[0]
            raw = bytes.fromhex(value) if _HEX.match(value) else _decode(value)
            add(lo + m.start(), lo + m.end(), binary_kind(raw) if raw else None)
    for m in _ASSIGNED.finditer(text):
        add(*m.span(1), "assigned_key" if _varied(m[1]) else None)
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, length, digest): each confirmed secret, by character position, with a hash in place of its value.

    Null and empty texts hold none; very long texts are searched whole; repeated rows are reported each; of overlapping findings the one
    named first above counts; a null doc_id stays null; other columns don't matter; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            ids, column = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            rows = [(i, kind, a, b - a, text[a:b]) for i, text in zip(ids, column, strict=True) if text for a, b, kind in confirm(text)]
            if rows:
                yield dict(zip(("doc_id", "kind", "start", "length", "value"), map(list, zip(*rows, strict=True)), strict=True))

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, work, "doc_id bigint, kind string, start int, length int, value string").select("doc_id", "kind", "start", "length", F.sha2("value", 256).alias("digest"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each confirmed secret (public keys aside) replaced by ``[SECRET:kind]`` and n_chars, where there is such a column, set anew for changed texts.

    No row goes; null and empty texts, null ids and other columns stay as they are; repeated rows change alike; very long texts are
    searched whole; an empty table gives none.
    """
    fields = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column, sizes, changed = part.column("text").to_pylist(), part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None, False
                for i, text in enumerate(column):
                    found = [x for x in confirm(text) if x[2] != "ssh_public_key"] if text else []
                    if found:
                        changed = True
                        for a, b, kind in reversed(found):
                            text = f"{text[:a]}[SECRET:{kind}]{text[b:]}"
                        column[i] = text
                        if sizes:
                            sizes[i] = len(text)
                if changed:
                    new = {"text": column} | ({"n_chars": sizes} if sizes else {})
                    part = pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name) for f in fields], schema=fields)
                yield part

    return docs.mapInArrow(run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
