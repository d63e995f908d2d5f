"""Secret scan: pattern candidates plus structural confirmation.

Base patterns are reported as they match. Base64 and hexadecimal runs are reported
only when their decoded bytes have the structure of a key: DER whose nested lengths
add up, the length-prefixed fields of an SSH key, or a signed token whose header and
payload are JSON objects. Keys may be glued to other characters of the alphabet or go on over several lines.
Rows are independent; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, types as T

from wirepulse.llm.rows import text_map

# The base patterns and the shortest length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "pem", "jwt", "key", "hexkey")
ORDER = {kind: k for k, kind in enumerate(KINDS)}

ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[^-]|-(?!----))*)-----END \1-----")
#: A header begins with a brace: an e and one of sixteen letters. The JSON parser judges the rest.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{6,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Lines of base64 below one another, and where a key can begin inside a run.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})+")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
BEGINS = re.compile(r"MI|AAAA|b3Bl")
#: Longest key looked for inside a run, in bytes; a run that is a key as a whole may be longer.
LONGEST = 1 << 16
HEXRUN = re.compile(r"[0-9A-Fa-f]{64,}")
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_MAGIC = b"openssh-key-v1\0"


def decode64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not; None where it cannot be one."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag and bounds of each element in ``data[start:end]``; None unless they fill it exactly."""
    fields = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            count = length & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            length = int.from_bytes(data[at : at + count], "big")
            at += count
            if length < 0x80 or (count > 1 and data[at - count] == 0):
                return None
        if tag == 0 or tag & 0x1F == 0x1F or at + length > end:
            return None
        fields.append((tag, at, at + length))
        start = at + length
    return fields


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE whose nested lengths add up and whose fields look like a key.

    Accepted: a version number followed by integers (RSA, DSA), by an algorithm and an
    octet string (PKCS#8), by an octet string (elliptic curve), and an algorithm
    followed by a bit string (public key) or by an octet string (encrypted key).
    """
    outer = der_fields(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    for tag, start, end in inner:
        if tag & 0x20 and der_fields(data, start, end) is None:
            return False
    tags = [f[0] for f in inner]
    if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] <= 1:
        return tags[1] == 0x04 or tags[1:3] == [0x30, 0x04] or (len(tags) >= 6 and set(tags) <= {0x02, 0x30})
    if tags == [0x02, 0x02]:
        return inner[0][2] - inner[0][1] >= 32
    if tags[0] == 0x30 and tags[1] in (0x03, 0x04) and len(tags) == 2:
        algorithm = der_fields(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """The magic of an OpenSSH private key, or length-prefixed fields that fill a public one."""
    start = len(SSH_MAGIC) if data.startswith(SSH_MAGIC) else 0
    first, count = None, 0
    if start:
        length = int.from_bytes(data[start : start + 4], "big")
        return 1 <= length <= 64 and data[start + 4 : start + 4 + length].replace(b"-", b"").replace(b"@", b"").replace(b".", b"").isalnum()
    while start < len(data):
        length = int.from_bytes(data[start : start + 4], "big")
        if start + 4 + length > len(data):
            return False
        if first is None:
            first = data[start + 4 : start + 4 + length]
            if first not in SSH_KINDS:
                return False
        start, count = start + 4 + length, count + 1
    return count >= 2


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 30 and ((data[0] == 0x30 and is_der_key(data)) or (data[0] in (0, 0x6F) and is_ssh_key(data)))


def key_at(run: str, start: int) -> int:
    """Characters of the key that begins at a place of a base64 run, whatever follows it; 0 if there is none."""
    head = decode64(run[start : start + 32])
    if head is None or len(head) < 24:
        return 0
    if head[0] == 0x30:
        size, length = 2, head[1]
        if length & 0x80:
            size += length & 0x7F
            if not 3 <= size <= 5:
                return 0
            length = int.from_bytes(head[2:size], "big")
        chars = ((size + length) * 8 + 5) // 6
        if size + length > LONGEST or start + chars > len(run) or not is_key(decode64(run[start : start + chars])):
            return 0
        while run[start + chars : start + chars + 1] == "=":
            chars += 1
        return chars
    # SSH: the magic of a private key, or the name of a kind, before anything more is decoded.
    if head.startswith(SSH_MAGIC) or any(head[4:].startswith(kind[:20]) for kind in SSH_KINDS):
        return len(run) - start if is_key(decode64(run[start:])) else 0
    return 0


def keys_inside(run: str) -> list[tuple[int, int]]:
    """Keys that are glued to other characters of the alphabet, from the left, without overlap."""
    found, free = [], 0
    for begin in BEGINS.finditer(run):
        if begin.start() >= free:
            size = key_at(run, begin.start())
            if size:
                free = begin.start() + size
                found.append((begin.start(), free))
    return found


def wrapped_keys(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Keys that go on over several lines of base64, as spans of the text."""
    lines = [m.span() for m in LINE.finditer(text, start, end)]
    joined, places = "".join(text[a:b] for a, b in lines), []
    at = 0
    for a, b in lines:
        places.append((at, a))
        at += b - a
    starts = [p for p, _ in places]

    def place(k: int) -> int:
        line = bisect_right(starts, k) - 1
        return places[line][1] + k - starts[line]

    spans = [(place(a), place(b - 1) + 1) for a, b in keys_inside(joined)]
    return [(a, b) for a, b in spans if "\n" in text[a:b]]


def is_token(header: str, payload: str, signature: str) -> bool:
    """A JSON header that names its algorithm, a JSON payload, and a signature unless the algorithm is none."""
    try:
        head, body = (json.loads(decode64(part) or b"") for part in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or (len(signature) >= 16 and decode64(signature) is not None)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then kind."""
    spans = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in ARMOR.finditer(text):
            lines = [line.strip() for line in m[2].replace("\\n", "\n").split("\n")]
            body = decode64("".join(line for line in lines if ":" not in line))
            if body and ("ENCRYPTED" in m[2] or is_key(body)):
                spans.append(("pem", *m.span()))
    spans += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_token(*m.groups())]
    armored = [s for s in spans if s[0] == "pem"]
    wrapped = []
    for m in WRAPPED.finditer(text):
        if not any(a <= m.start() and m.end() <= b + 1 for _, a, b in armored):
            wrapped += wrapped_keys(text, *m.span())
    spans += [("key", *w) for w in wrapped]
    for m in BASE64.finditer(text):
        if is_key(decode64(m[0])):
            spans.append(("key", *m.span()))
            continue
        inside = keys_inside(m[0])
        spans += [("key", m.start() + a, m.start() + b) for a, b in inside]
        if not inside:
            for h in HEXRUN.finditer(text, *m.span()):
                if len(h[0]) % 2 == 0 and is_key(bytes.fromhex(h[0])):
                    spans.append(("hexkey", *h.span()))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _digest(text: str) -> tuple:
    spans = find_secrets(text)
    base = [s for s in spans if s[0] in KINDS[:3]]
    joined = [",".join(f"{k}:{a}:{b}" for k, a, b in part) for part in (base, spans)]
    counts = [sum(s[0] == kind for s in base) for kind in KINDS[:3]]
    found = [{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans]
    return *counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], found


FOUND_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("value", T.StringType()),
]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, their digest, all spans, and the values found.

    Spans count code points, end exclusive. Null and empty texts have none (the digest
    is that of the empty string); null ids are carried along, repeated rows repeat, an
    empty table gives an empty result, and other columns are not read.
    """
    fields = [
        ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()),
        ("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", FOUND_TYPE),
    ]
    return text_map(df, id_col, text_col, fields, lambda: _digest)
