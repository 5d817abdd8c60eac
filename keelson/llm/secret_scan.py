"""Secret scans with structural confirmation.

Base spans come from three fixed patterns.  The method adds spans for
candidates that *decode* to something that only a credential looks like:
base64 or hex whose bytes parse as DER with exactly nested lengths, OpenSSH
key envelopes with length-prefixed fields, and signed tokens whose header is
JSON with an ``alg``.  Public keys and certificates are no secrets.  Of armoured keys with header lines, a body that is
encrypted is confirmed by its label and header.

Null and empty texts have no spans.  Repeated rows give repeated results.
Offsets are code points, end exclusive.  Texts are scanned whole; patterns run
on the ASCII-lowered UTF-8 bytes, and only hits are converted to code points.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import free_name, map_columns, quoted

#: The base patterns and the least lengths.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{32,}"
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "sshkey", "jwt")

_assign, _access, _hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
_mixed = re.compile(rb"[0-9A-Fa-f]{48,}")
#: Line ends, real or escaped; RFC 1421 header lines with their continuations.
_BREAK = rb"(?:\r?\n|(?:\\r)?\\n)"
_VALUE = rb"(?:[^\r\n\\]|\\(?!r?\\?n))*+"
_pem = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,40})-----(?:\s|\\[nr])*+((?:[A-Za-z][A-Za-z0-9-]*+:" + _VALUE + _BREAK + rb"(?:[ \t]++" + _VALUE + _BREAK + rb")*+)*+)([A-Za-z0-9+/=\s\\]{16,}?)-----END \1-----")
_encrypted = re.compile(rb"^Proc-Type:[ \t]*4[ \t]*,[ \t]*ENCRYPTED", re.I)
_b64 = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:M[A-Z]|AAAA|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{22,}={0,2}")
_jwt = re.compile(rb"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")

#: Fields of public keys by algorithm, its name included.
PUBLIC_FIELDS = {b"ssh-ed25519": 2, b"ssh-rsa": 3, b"ssh-dss": 5, b"ecdsa-": 3, b"sk-ssh": 3, b"sk-ecdsa": 4, b"ssh-": 2}

#: The least DER size that counts, and how deep nesting is followed.
LEAST_DER, DEEPEST = 24, 12


def _decode(raw: bytes) -> bytes | None:
    raw = raw.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, start: int, end: int, depth: int, seen: set[int]) -> bool:
    """Whether ``data[start:end]`` is a run of DER values that fills it exactly; ``seen`` gets the tags."""
    at = start
    while at < end:
        if at + 2 > end:
            return False
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return False
            length = int.from_bytes(data[at : at + n])
            if length < 0x80 or data[at] == 0:  # DER takes the shortest form
                return False
            at += n
        if at + length > end or (tag & 0x1F) == 0x1F:
            return False
        seen.add(tag)
        if tag & 0x20:
            if depth >= DEEPEST or not _der(data, at, at + length, depth + 1, seen):
                return False
        elif tag in (0x02, 0x06) and not length or tag == 0x05 and length:
            return False
        at += length
    return at == end


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE whose nested lengths fit to the last byte, which holds an integer or an object id, and isn't public.

    Public keys and certificates end in a bit string, public RSA keys and
    signatures are two integers, and signed messages begin with an object id.
    """
    seen: set[int] = set()
    if len(data) < LEAST_DER or data[0] != 0x30 or not _der(data, 0, len(data), 0, seen) or not seen & {0x02, 0x06}:
        return False
    tags = _tags(data)
    return tags != [0x02, 0x02] and tags[0] != 0x06 and tags[-1] != 0x03


def _tags(data: bytes) -> list[int]:
    """Tags of the values directly inside a well-formed outer value."""
    out, at = [], 2 if data[1] < 0x80 else 2 + (data[1] & 0x7F)
    while at < len(data):
        out.append(data[at])
        n, at = data[at + 1], at + 2
        if n >= 0x80:
            n, at = int.from_bytes(data[at : at + (n & 0x7F)]), at + (n & 0x7F)
        at += n
    return out


def _fields(data: bytes, at: int) -> list[bytes] | None:
    """Length-prefixed fields from ``at`` to the exact end."""
    out = []
    while at < len(data):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4])
        at += 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out


def is_ssh_key(data: bytes) -> bool:
    """Wire form of a private SSH key: a known algorithm name, then fields that fill the blob, more than a public key has."""
    got = _fields(data, 0)
    if not got or not (m := re.match(rb"(ssh-ed25519|ssh-rsa|ssh-dss|ecdsa-|sk-ssh|sk-ecdsa|ssh-)[a-z0-9@.-]*$", got[0])):
        return False
    return b"-cert-" not in got[0] and len(got) > PUBLIC_FIELDS[m[1]]


def is_openssh_key(data: bytes) -> bool:
    """OpenSSH private key envelope: magic, cipher, kdf, options, then a count of keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 16


def _kinds_of(data: bytes) -> list[str]:
    return [kind for kind, test in (("der", is_der_key), ("openssh", is_openssh_key), ("sshkey", is_ssh_key)) if test(data)]


def is_signed_token(raw: bytes) -> bool:
    """Three dotted parts; the header is a JSON object with ``alg``, the payload a JSON object."""
    head, body, _ = raw.split(b".", 2)
    try:
        head, body = json.loads(_decode(head) or b""), json.loads(_decode(body) or b"")
    except (ValueError, RecursionError):  # brackets nested too deeply are no token either
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), sorted by start, then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()  # bytes.lower() changes A-Z only
    found = [("assign", m.start(), m.end()) for m in _assign.finditer(low) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in _access.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    digits = {m.span() for m in _hex.finditer(raw)}
    found += [("hex", a, b) for a, b in digits]
    # either case is decoded; base spans stay lower-case runs
    for a, b in digits | {m.span() for m in _mixed.finditer(raw)}:
        if (b - a) % 2 == 0:
            found += [(kind, a, b) for kind in _kinds_of(bytes.fromhex(raw[a:b].decode()))]
    if b"-----BEGIN " in raw:
        for m in _pem.finditer(raw):
            data = _decode(re.sub(rb"\s|\\[nr]", b"", m[3]))
            # an encrypted body has no structure of its own: its label and header name it
            if data and (is_der_key(data) or is_openssh_key(data) or m[1].endswith(b"PRIVATE KEY") and _encrypted.match(m[2])):
                found.append(("pem", m.start(), m.end()))
    for m in _b64.finditer(raw):
        if data := _decode(m[0]):
            found += [(kind, m.start(), m.end()) for kind in _kinds_of(data)]
    for m in _jwt.finditer(raw):
        if is_signed_token(m[0]):
            found.append(("jwt", m.start(), m.end()))
    if not found:
        return []
    if len(raw) != len(text):  # byte offsets to code points, in one walk
        edges = sorted({x for _, a, b in found for x in (a, b)})
        points, at, n = {}, 0, 0
        for e in edges:
            n += len(raw[at:e].decode("utf-8", "surrogatepass"))
            points[e], at = n, e
        found = [(k, points[a], points[b]) for k, a, b in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, all base and confirmed spans.

    One narrow pass; no shuffle, whatever the skew.  Only the id and text
    columns are read, so extra columns can't clash.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        return {"id": cols["id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in cols["text"]]}

    return map_columns(src, f"id {kind}, spans {SPANS}", run).withColumnRenamed("id", id_col)


def joined(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the spans."""
    s = F.col("spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(s, lambda x: x["kind"].isin("assign", "access", "hex"))
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``text`` by ``mask``; overlapping spans become one.

    ``n_chars``, if there, follows the text where it changes; all other columns
    stay.  Rows without a span are returned unchanged, nulls included.
    """

    @F.pandas_udf("string")
    def redact(texts):
        def one(t):
            spans = find_spans(t)
            if not spans:
                return t
            out, at = [], 0
            for _, a, b in spans:
                if a >= at:
                    out += [t[at:a], mask]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    own = free_name(docs, "masked")
    out = docs.withColumn(own, redact("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own) != F.col("text"), F.length(own).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(own)).select(*map(quoted, docs.columns))
