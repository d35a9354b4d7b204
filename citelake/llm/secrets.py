"""Secret scans with structural confirmation.

Patterns propose candidates; those that claim an encoding are decoded and parsed before they are
reported. Base64 and hex runs must decode to a private key whose nested lengths fit exactly (DER
of PKCS#1, PKCS#8 or SEC1, or the OpenSSH container); base64 wrapped over lines is joined first. A
PEM block must hold such a key, or the headers of a traditional encrypted one (DEK-Info) before whole
cipher blocks, whose content can't be parsed further. A signed token must have a JSON header that
names an algorithm, a JSON payload and a signature of the algorithm's length.

Kinds, in the order of equal starts: assign, access, hex (plain patterns), then jwt, pem, der
(confirmed). Spans count code points, ends exclusive. Every whole text is scanned, by one pass of
each pattern, in time linear in its length; nothing is shuffled.

Defined cases: a null text counts as empty; an empty text has no spans; a structure that is nested
beyond what the JSON parser takes, or malformed in any other way, is unconfirmed; repeated rows give
repeated rows; an empty table gives an empty table; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm.common import map_texts, read_table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so its first 24 decide
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{48,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+(?:\r?\n|\\+[nr])[\x20\t]*+)++[A-Za-z0-9+/]*+={0,2}")  # lines of base64
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[^-]|-(?!----(?:BEGIN|END) ))*+)-----END \1-----")  # the body holds no other BEGIN or END
_ESCAPED = re.compile(r"\\+[nr]")  # line ends as JSON strings have them
#: Header lines of a traditional encrypted key; its cipher works on blocks of 8 or 16 bytes.
_DEK = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,\s*[0-9A-Fa-f]+\s")
#: Signature bytes of each signing algorithm; None stands for an RSA modulus, 128 bytes or more.
SIGNATURE_BYTES = {
    "none": 0,
    "HS256": 32, "HS384": 48, "HS512": 64,
    "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None where it isn't any."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill data exactly; None where lengths don't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def key_encoding(data: bytes | None) -> str | None:
    """The private-key encoding that data is, by its nested lengths: pkcs1, pkcs8, sec1 or openssh."""
    if not data:
        return None
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _ssh_strings(data[15:]) else None
    if data[0] != 0x30:
        return None
    outer = der_items(data)
    inner = der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner:
        return None
    tags = [tag for tag, _ in inner]
    if tags[:2] == [2, 0x30] and len(tags) >= 3 and tags[2] == 4 and inner[0][1] in (b"\0", b"\1"):
        algorithm = der_items(inner[1][1])
        return "pkcs8" if algorithm and algorithm[0][0] == 6 else None
    if tags[:9] == [2] * 9 and inner[0][1] in (b"\0", b"\1") and len(inner[1][1]) >= 32:
        return "pkcs1"
    if tags[:2] == [2, 4] and inner[0][1] == b"\1" and 16 <= len(inner[1][1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1"
    if tags == [0x30, 4] and (scheme := der_items(inner[0][1])) and scheme[0][0] == 6:
        return "pkcs8-encrypted"
    return None


def _ssh_strings(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, then public and private parts."""
    at, seen = 0, 0
    while at + 4 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        if seen == 3:  # the number of keys stands alone
            at, seen = at + 4, seen + 1
            continue
        at, seen = at + 4 + length, seen + 1
    return seen >= 6 and at == len(data)


def signed_token(text: str) -> bool:
    head, payload, signature = text.split(".")
    try:
        header = json.loads(decode_base64(head) or b"")
        body = json.loads(decode_base64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    algorithm = header.get("alg") if isinstance(header, dict) and isinstance(body, dict) else None
    if not isinstance(algorithm, str) or algorithm not in SIGNATURE_BYTES:
        return False
    size, raw = SIGNATURE_BYTES[algorithm], decode_base64(signature)
    return raw is not None and (len(raw) == size if size is not None else len(raw) >= 128)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and kind."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for m in _ENCODED.finditer(text):
        run = m[0]
        raw = bytes.fromhex(run) if len(run) % 2 == 0 and _HEX_ANY.fullmatch(run) else decode_base64(run)
        if key_encoding(raw):
            found.append(("der", *m.span()))
    if "." in text:
        found += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            inside = _ESCAPED.sub("\n", m[2])
            lines = [x for x in inside.split("\n") if ":" not in x]  # header lines of encrypted keys
            body = decode_base64("".join("".join(lines).split()))
            if key_encoding(body) or (body and len(body) % 8 == 0 and _DEK.search(inside)):
                found.append(("pem", *m.span()))
    if "\n" in text or "\\" in text:
        pems = [s for s in found if s[0] == "pem"]
        for m in _WRAPPED.finditer(text):
            if key_encoding(decode_base64("".join(_ESCAPED.sub(" ", m[0]).split()))) and not _inside(pems, m.start()):
                found.append(("der", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _inside(spans: list[tuple[str, int, int]], at: int) -> bool:
    """Whether one of the spans, sorted and apart from each other, holds the place."""
    k = bisect.bisect_right(spans, at, key=lambda s: s[1]) - 1
    return k >= 0 and at < spans[k][2]


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and secret_spans, the spans of each whole text."""

    def spans(texts: list) -> dict[str, list]:
        return {"secret_spans": [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in texts]}

    return map_texts(docs, id_column, text_column, f"secret_spans {SPANS}", lambda: spans)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: F.Column, *kinds: str) -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    return found.select(
        "doc_id",
        *(F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kind(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
