r"""Secrets by pattern, and by structural confirmation.

Base kinds (assign, access, hex) are leftmost matches without overlap over whole texts; matches that
fail their length go. Structural kinds are reported only after decoding and parsing, and only where they hold
private material (certificates and public keys are none):

- jwt: a signed token; its header decodes to a JSON object that names an algorithm, its claims to an object;
- pem: a block between BEGIN and END marks whose body is base64 of a private key, or is marked as encrypted and decodes;
- der: a base64 run, on one line or wrapped over several, and hexder: a hex run, whose bytes are a private key in DER;
- ssh: a base64 run (as before) whose bytes are OpenSSH's private format.

A private key in DER is one SEQUENCE, all nested lengths exact, laid out as PKCS#1 (RSA), SEC1 (EC), DSA's six
numbers, PKCS#8 or encrypted PKCS#8. OpenSSH's format is parsed field by field to the end.

Each span has a form, which tells what its value decodes to: key, jwt, text (printable base64), digest (hex of a
hash's length), hex, or plain. A base span of form key or jwt is confirmed by structure.

Spans are in code points, the end exclusive.

Edge cases: null and empty texts have no spans; repeated rows each give a row; spans of different kinds
may overlap; an empty table gives an empty result; extra columns are not read; text length is not bounded.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import small_batches, text_groups

KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "hexder", "ssh"]
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    # Runs shorter than the least length fail in any case, so that they need not be matched.
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
#: Without one of these in the lower-cased text, no assign match can be.
HEXED = re.compile("[0-9A-Fa-f]+")
NAMES = ("passw", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
#: Base64 of a DER SEQUENCE or of OpenSSH's mark, in one run or wrapped. The shortest EC key has 27 bytes, in 36 characters.
LEAST = 36
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNza)[A-Za-z0-9+/_-]+={0,2}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/_-]))*")
HEX = re.compile("(?<![0-9A-Fa-f])30[0-9A-Fa-f]{52,}")
BEGIN = re.compile("-----BEGIN ([A-Z0-9 ]+)-----")
#: Mark of OpenSSH's private format, and lengths of hashes in hex.
OPENSSH = b"openssh-key-v1\0"
DIGESTS = (32, 40, 56, 64, 96, 128)
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padding optional."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag of the element at a place, and where its content starts and ends."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        return None  # tags of several bytes are in no key format
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        length = int.from_bytes(data[at : at + size], "big")
        if length < 0x80 or length >> 8 * (size - 1) == 0:
            return None  # DER takes the shortest form
        at += size
    return (tag, at, at + length) if at + length <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tags and contents' places of the elements that fill the bytes exactly, or None."""
    out = []
    while at < end:
        found = _header(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def exact(data: bytes, start: int, end: int) -> bool:
    """Whether all nested lengths of the elements there are exact."""
    todo = [(start, end)]
    while todo:
        inner = elements(data, *todo.pop())
        if inner is None:
            return False
        todo.extend((a, b) for tag, a, b in inner if tag & 0x20)
    return True


def private_key(data: bytes | None) -> bool:
    """Whether the bytes are a private key in DER."""
    if not data or data[0] != SEQUENCE:
        return False
    top = _header(data, 0, len(data))
    if top is None or top[2] != len(data) or (inner := elements(data, top[1], top[2])) is None or not inner or not exact(data, top[1], top[2]):
        return False
    tags = [tag for tag, _, _ in inner]
    version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big") if tags[0] == INTEGER and inner[0][2] - inner[0][1] == 1 else None
    if version is not None and version < 2:
        if len(tags) >= 9 and set(tags[:9]) == {INTEGER} or len(tags) == 6 and set(tags) == {INTEGER}:
            return True  # PKCS#1, DSA
        if version == 1 and tags[1:2] == [OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return inner[1][2] - inner[1][1] >= 16  # SEC1
        return tags[1:3] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0xA1, 0x80, 0x81) for t in tags[3:]) and _names(data, inner[1])  # PKCS#8
    return tags == [SEQUENCE, OCTETS] and _names(data, inner[0])  # encrypted PKCS#8


def _names(data: bytes, place: tuple[int, int, int]) -> bool:
    """Whether an element's first one is an object identifier."""
    inner = elements(data, place[1], place[2])
    return bool(inner) and inner[0][0] == OID and inner[0][2] > inner[0][1]


def openssh_size(data: bytes) -> int:
    """Bytes of OpenSSH's private format at the start: its mark, cipher, key derivation and options, public keys, private part; 0 for others."""
    if not data.startswith(OPENSSH):
        return 0
    at, fields, wanted = len(OPENSSH), 0, 3
    while fields < wanted:
        if at + 4 > len(data):
            return 0
        at += 4 + struct.unpack_from(">I", data, at)[0]
        fields += 1
        if fields == 3 == wanted:
            if at + 4 > len(data):
                return 0
            keys = struct.unpack_from(">I", data, at)[0]
            at += 4
            wanted = 3 + max(1, keys) + 1
    return at if at <= len(data) else 0


def key_in(run: str) -> tuple[str, int] | None:
    """Kind and end of the private key that a base64 run, of one line or several, begins with."""
    pieces = [(m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", run.partition("=")[0])]
    body = "".join(x for _, x in pieces)
    data = decoded(body[: len(body) - (len(body) % 4 == 1)]) or b""
    top = _header(data, 0, len(data)) if data[:1] == b"\x30" else None
    kind, size = ("der", top[2]) if top else ("ssh", openssh_size(data))
    if not size or kind == "der" and not private_key(data[:size]):
        return None
    left = -(-size * 4 // 3)
    for end, piece in pieces:
        left -= len(piece)
        if left <= 0:
            break
    if left:
        return None  # the key ends inside a line
    return kind, end + len(run[end : end + 2]) - len(run[end : end + 2].lstrip("="))


def signed_token(token: str) -> bool:
    parts = []
    for part in token.split(".")[:2]:
        try:
            parts.append(json.loads((decoded(part) or b"").decode()))
        except (ValueError, RecursionError):
            return False
    head, claims = parts
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def key_block(body: str) -> bool:
    lines = [x.strip() for x in body.strip().replace("\\n", "\n").splitlines()]
    marked = [x for x in lines if ":" in x]
    data = decoded("".join(x for x in lines if x and ":" not in x))
    if not data:
        return False
    return private_key(data) or openssh_size(data) == len(data) or any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in marked)


def form(value: str) -> str:
    """What a value decodes to."""
    if value.count(".") == 2 and signed_token(value):
        return "jwt"
    if HEXED.fullmatch(value):
        if len(value) % 2 == 0 and private_key(bytes.fromhex(value)):
            return "key"
        if len(value) >= 24:
            return "digest" if len(value) in DIGESTS else "hex"
    data = decoded(value)
    if data and (private_key(data) or openssh_size(data) == len(data)):
        return "key"
    if data and len(data) >= 6 and data.isascii() and data.decode().isprintable():
        return "text"
    return "plain"


def spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, form) of every secret, in order."""
    if not text:
        return []
    out = set()
    low = text.lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and not any(x in low for x in NAMES):
            continue
        out.update((m.start(), KINDS.index(kind), m.end(), form(m[group])) for m in pattern.finditer(text) if len(m[group]) >= least)
    if "ey" in text and "." in text:
        out.update((m.start(), KINDS.index("jwt"), m.end(), "jwt") for m in TOKEN.finditer(text) if m[0].startswith("ey") and signed_token(m[0]))
    if "-----BEGIN " in text:
        for m in BEGIN.finditer(text):
            mark = f"-----END {m[1]}-----"
            end = text.find(mark, m.end())
            if end >= 0 and key_block(text[m.end() : end]):
                out.add((m.start(), KINDS.index("pem"), end + len(mark), "key"))
    for m in RUN.finditer(text):
        if len(m[0]) >= LEAST and (found := key_in(m[0])):
            out.add((m.start(), KINDS.index(found[0]), m.start() + found[1], "key"))
    for m in HEX.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0])):
            out.add((m.start(), KINDS.index("hexder"), m.end(), "key"))
    return sorted(out)


def listed(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: an array of (start, end, kind, form) in order, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            found = [[{"start": a, "end": b, "kind": KINDS[k], "form": f} for a, k, b, f in spans(t)] for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("form", pa.string())]))
            yield pa.record_batch([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(rows, f"doc_id {own.schema[0].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string,form:string>>")
