"""Secrets in texts, confirmed by the structure of what they encode.

Candidates are found by pattern: assignments to secret-like names, access keys, long hex runs, base64 or
hex strings, armoured key blocks and dotted tokens.  The first three kinds are reported as found.  The
others are reported only when they parse: a dotted token needs a JSON header that names an algorithm and
a JSON body; a base64 or hex string must decode to a key encoding whose nested lengths fill it exactly,
to an armoured key, or to a signed token; an armoured block's body must be such an encoding.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quillpanel.llm.batches import column, in_batches, slices

# Kinds in the order in which spans of one start are listed, and the base patterns.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
PEM = r"(?s)-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----"
BASE64 = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}"
RUN, BREAK = r"[A-Za-z0-9+/_-]+", r"(?:\\+[rn]|\s)+"
#: Where a key may begin inside a run: a sequence of 128 bytes or more anywhere, a shorter one at the run's begin or
#: after a separator, and the first signs of openssh's magic, of armour and of a token's header.
STARTS = r"(?:MI[E-L]|(?<![A-Za-z0-9])M[B-H]|b3BlbnNzaC1rZXktdj|LS0tLS1CRUdJT|ZXlK)(?=[A-Za-z0-9+/_-]{16})"
LINE_END = r"[ \t]*(?:(?:\\+[rn]|[\r\n])[ \t]*)+"
#: A run and, while its lines are of 40 signs or more, the next whole line.
WRAPPED = rf"(?:[A-Za-z0-9+/_-]{{40,}}{LINE_END}(?={RUN}={{0,2}}(?:[\r\n\\\"',]|$)))*{RUN}={{0,2}}"
LEAST_DER = 30
#: Signs of a line that wraps, and of a token that are looked at before it is decoded.
LONG_LINE, HEADER_SIGNS = 40, 256
UPPER_HEX = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}(?![0-9A-Fa-f])"
MARK = "[secret]"

SPANS = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None where it is neither."""
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if not body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the DER items that fill data[at:end] exactly; None where they don't."""
    found = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 0x80:
                return None
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_key_der(data: bytes) -> bool:
    """A DER sequence whose items fill it and which has the shape of a private key.

    Accepted: version, then integers (RSA, DSA); version, algorithm sequence, octets (PKCS 8); version,
    octets (EC); algorithm sequence, octets (encrypted PKCS 8).
    """
    top = _items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _items(data, *top[0][1:])
    if not parts:
        return False
    for tag, a, b in parts:
        if tag == 0x30 and _items(data, a, b) is None:
            return False
    tags = [tag for tag, _, _ in parts]
    versioned = tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 3
    if versioned and len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):
        return True
    if versioned and (tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] and len(tags) > 2):
        return True
    return tags == [0x30, 0x04] and parts[1][2] - parts[1][1] >= 16


def is_openssh(data: bytes) -> bool:
    """The binary form of an OpenSSH private key: magic, then length-prefixed fields."""
    magic = b"openssh-key-v1\x00"
    if bytes(data[: len(magic)]) != magic:
        return False
    at = len(magic)
    for _ in range(3):  # cipher, derivation, options
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at + 4 > len(data):
            return False
    return int.from_bytes(data[at : at + 4], "big") >= 1


def is_jwt(text: str) -> bool:
    """Header and body of a dotted token are JSON objects, and the header names an algorithm."""
    parts = text.split(".")
    if len(parts) != 3:
        return False
    objects = []
    for part in parts[:2]:
        try:
            objects.append(json.loads(unbase64(part) or b""))
        except (ValueError, RecursionError):
            return False
    header, body = objects
    return isinstance(header, dict) and isinstance(body, dict) and isinstance(header.get("alg"), str)


def is_secret_data(data: bytes | None) -> bool:
    """Decoded bytes are a key, an armoured key or a signed token."""
    if not data:
        return False
    if is_key_der(data) or is_openssh(data):
        return True
    if data.startswith((b"-----BEGIN", b"eyJ")):
        text = data.decode("latin-1").strip()
        return is_jwt(text) or any(is_key_block(m) for m in re.finditer(PEM, text))
    return False


def is_key_block(match: re.Match) -> bool:
    """The body decodes to a key; one with headers that say so may be encrypted.  Line ends may be escaped."""
    lines = [x.strip() for x in re.sub(r"\\+[rn]", "\n", match[2]).replace("\\/", "/").splitlines()]
    headers = [x for x in lines if ":" in x]  # of older armour, such as DEK-Info
    data = unbase64("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    return is_key_der(data) or is_openssh(data) or any("ENCRYPTED" in x for x in headers)


_run, _break = re.compile(RUN), re.compile(BREAK)


def der_end(text: str, at: int) -> int | None:
    """Where the base64 of a key that begins at ``at`` ends, by the length it states; line ends inside are passed over."""
    head = unbase64(text[at : at + 8])
    if not head or len(head) < 6 or head[0] != 0x30 or not (head[1] < 0x80 or head[1] in (0x81, 0x82)):
        return None
    width = max(head[1] - 0x80, 0)
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    if size < LEAST_DER or head[2 + width] not in (0x02, 0x30):
        return None
    left, parts = -(-size * 4 // 3), []
    while left:
        run = _run.match(text, at, at + left)
        if not run:
            return None
        parts.append(run[0])
        at, left = run.end(), left - len(run[0])
        if left:
            gap = _break.match(text, at)
            if not gap:
                return None
            at = gap.end()
    data = unbase64("".join(parts))
    if not data or not is_key_der(data):
        return None
    return at + len(re.match("={0,2}", text[at : at + 2])[0])


class Run:
    """Base64 signs from a first place to the end of their run, and on over whole wrapped lines."""

    def __init__(self, text: str, first: int, wrapped):
        self.text, self.first, self.stop = text, first, _run.match(text, first).end()
        # lines go on where at least 40 signs stand before the line's end
        long = self.stop - first >= LONG_LINE
        self.wrapped_end = wrapped(text, self.stop - LONG_LINE).end() if long else self._padded(self.stop)
        self.decoded: dict[tuple[bool, int], tuple[bytes, list[int]]] = {}

    def _padded(self, at: int) -> int:
        return at + len(re.match("={0,2}", self.text[at : at + 2])[0])

    def _goes_on(self, at: int) -> bool:
        return self.stop - at >= LONG_LINE

    def end(self, at: int) -> int:
        return self.wrapped_end if self._goes_on(at) else self._padded(self.stop)

    def _bytes(self, at: int) -> tuple[bytes, int, list[int]]:
        """The decoded rest of the run, where ``at`` is in it, and the places of its dots."""
        place = at - self.first
        key = (self._goes_on(at), place % 4)
        if key not in self.decoded:
            signs = re.sub(BREAK, "", self.text[self.first + place % 4 : self.end(at)]).rstrip("=")
            data = unbase64(signs[: len(signs) - (len(signs) % 4 == 1)]) or b""
            self.decoded[key] = data, [i for i, c in enumerate(data) if c == 0x2E] if b"." in data else []
        data, dots = self.decoded[key]
        return data, place // 4 * 3, dots

    def holds_secret(self, at: int) -> bool:
        """As :func:`is_secret_data` of what is decoded from ``at``; only what can be one is copied."""
        data, begin, dots = self._bytes(at)
        if data.startswith(b"eyJ", begin):
            # two dots in what is left, and a header that begins as an object with a name
            if len(dots) - bisect_left(dots, begin) != 2 or not _may_be_header(data[begin : begin + HEADER_SIGNS]):
                return False
        elif not data.startswith((b"openssh-key-v1\x00", b"-----BEGIN"), begin):
            return False
        if data.startswith(b"openssh-key-v1\x00", begin):
            return is_openssh(memoryview(data)[begin:])
        return is_secret_data(data[begin:])


def _may_be_header(signs: bytes) -> bool:
    """Whether base64 that begins like this may be a JSON object: its first name, if it ends here, is followed by a colon."""
    part = signs.split(b".")[0]
    try:
        head = base64.urlsafe_b64decode(part[: len(part) // 4 * 4].replace(b"+", b"-").replace(b"/", b"_")).decode("latin-1")
    except (binascii.Error, ValueError):
        return False
    name = re.match(r'\s*\{\s*"(?:[^"\\]|\\.)*"\s*(.?)', head, re.DOTALL)
    return name is None or name[1] in ("", ":")


class Scanner:
    """Spans (kind, start, end) of one text in code points, by start and then in the order of KINDS."""

    def __init__(self):
        self.find = {k: re.compile(p).finditer for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("jwt", JWT), ("pem", PEM), ("b64", BASE64), ("start", STARTS), ("upper", UPPER_HEX))}
        self.wrapped = re.compile(WRAPPED).match

    def inner_keys(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Keys that are wrapped over lines, or begin inside a run; each run is decoded once for each phase of four signs."""
        done, run = 0, None
        for m in self.find["start"](text):
            at = m.start()
            if at < done:
                continue
            if text[at] == "M":
                end = der_end(text, at)
            else:
                if run is None or at >= run.stop:
                    run = Run(text, at, self.wrapped)
                end = run.end(at) if run.holds_secret(at) else None
            if end:
                done = end
                yield "key", at, end

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        spans = []
        low = text.lower()
        if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
            spans += [("assign", m.start(), m.end()) for m in self.find["assign"](text) if len(m[1]) >= ASSIGN_VALUE]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in self.find["access"](text) if len(m[0]) >= ACCESS_LENGTH]
        spans += [("hex", m.start(), m.end()) for m in self.find["hex"](text)]
        if "eyJ" in text:
            spans += [("jwt", m.start(), m.end()) for m in self.find["jwt"](text) if is_jwt(m[0])]
        if "-----BEGIN " in text:
            spans += [("pem", m.start(), m.end()) for m in self.find["pem"](text) if is_key_block(m)]
        keys = [("key", m.start(), m.end()) for m in self.find["b64"](text) if is_secret_data(unbase64(m[0]))]
        keys += [k for k in self.inner_keys(text) if not any(s[1] <= k[1] and k[2] <= s[2] for s in keys)]
        for m in self.find["upper"](text):
            if len(m[0]) % 2 == 0 and is_secret_data(bytes.fromhex(m[0])):
                keys.append(("key", m.start(), m.end()))
        spans += [k for k in keys if not any(s[0] in ("pem", "jwt") and s[1] <= k[1] and k[2] <= s[2] for s in spans)]
        return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(with_text: bool):
    """Spans of each row's text, as its last column; ``with_text``: the redacted text stays where it was."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = column(batch, "text")
            found = [scanner(t) if t else [] for t in texts]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)
            columns = batch.columns
            if with_text:
                columns[at] = pa.array([t if not x else redact(t, x) for t, x in zip(texts, found, strict=True)], pa.string())
            else:
                del columns[at]
            yield pa.RecordBatch.from_arrays([*columns, spans], [f"c{i}" for i in range(len(columns) + 1)])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end).

    Offsets are code points, end exclusive.  A null or empty text has no spans; repeated rows are
    scanned each; an empty table gives an empty table; other columns are ignored.
    """
    out = in_batches(docs).select("doc_id", "text")
    return out.mapInArrow(_scan(False), StructType([out.schema["doc_id"], StructField("spans", SPANS)]))


def redact_secrets(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; all columns, whatever their names, and rows stay.

    Column ``length``, where present, is the new text's length where something was replaced.  A null or
    empty text stays as it is; an empty table gives an empty one.
    """
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # a scan can't take every name
    plain = in_batches(docs).toDF(*names)
    out = plain.mapInArrow(_scan(True), StructType([*plain.schema, StructField("spans", SPANS)]))
    if length and length in docs.columns:
        own = names[docs.columns.index(length)]
        new = F.length("text").cast(plain.schema[own].dataType)
        out = out.withColumn(own, F.when(F.size("spans") > 0, new).otherwise(F.col(own)))
    return out.drop("spans").toDF(*docs.columns)


def listed(spans: Iterable[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    for batch in slices(batches):
        rows = column(batch, "spans")
        base = [[s for s in x if s["kind"] in KINDS[:3]] for x in rows]
        count = lambda k: pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                *(count(k) for k in KINDS[:3]),
                pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string()),
                pa.array([listed(x) for x in rows], pa.string()),
                pa.array([len(x) - len(b) for x, b in zip(rows, base, strict=True)], pa.int64()),
            ],
            names,
        )


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, all spans as text, and how many were confirmed.

    A row per row of ``docs`` (doc_id, text), repeated ones too; a null or empty text has none of anything; an
    empty table gives an empty one; other columns are ignored.
    """
    found = find_secrets(docs)
    kind = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(
        _report,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long",
    )
