"""Secret scans with structural confirmation: a candidate is confirmed only if what it encodes parses.

Kinds: private_key (PEM: the body decodes and its DER or OpenSSH structure, nested lengths included, is that of a private key; line ends may be real
or written with backslashes; of an encrypted body the cipher's header lines and block length are checked), der_key (the same in bare base64 or
hex, of one line or several), signed_token (three base64url parts: a JSON header with ``alg``, a JSON payload, a signature of the length that
``alg`` makes), access_key (AKIA or ASIA and 16 base32 digits, whose bits hold an account number of at most twelve digits), hub_token (the last six
digits are the CRC-32 of the others, base 62). These are ``confirmed``.

Not confirmed, as raw bytes have no structure: assigned_hex and assigned_base64, a value assigned to a word like password or token that
decodes to as many bytes as keys have (``KEY_BYTES``) of enough variety. They are reported with ``confirmed`` false, or left out if asked.

Defined cases: a null or empty text has no secrets; texts are searched whole; offsets are characters from 0, the end excluded; of overlapping
findings the longest stays (then the earliest); repeated rows give their findings each; a null id is reported as null; ids may be
whole numbers or texts; further columns play no part.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import apart, arrow_batches, narrow

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----)[\s\S])*+)-----END \1-----")
TOKEN = re.compile(r"(?<![\w.-])(eyJ[\w-]{8,})\.([\w-]{4,})\.([\w-]*)(?![\w-])", re.A)
UNCONFIRMED = {"assigned_hex", "assigned_base64"}
ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
HUB = re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Every kind but PEM and tokens has such a run.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: What stands before a value: a word, a sign, perhaps a quote.
ASSIGNED = re.compile(r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private|secret)[_-]?(?:key|token))["']?\s{0,4}(?::=|=>|=|:)\s{0,4}(["']?)\Z""")
BEFORE = 32
#: What ends it, by the quote before it.
CLOSED = {q: re.compile(rf"(={{0,2}}){q}(?![A-Za-z0-9+/_-])") for q in ("", "'", '"')}
KEY_BYTES = {16, 20, 24, 32, 40, 48, 64}
#: A line end, real or written with backslashes, with quotes and signs of joined literals around it.
EOL = r"""(?:(?:\\+[rn])++(?:["'][ \t]*+[+.,\\]?+[ \t]*+(?:\r?\n)?+[ \t]*+["'])?+[ \t]*+|\r?\n[ \t]*+)"""
LINE = r"[A-Za-z0-9+/]++={0,2}+(?![A-Za-z0-9+/=_-])"
#: Lines of base64 or hex, the first of 40 characters or more. A backslash's n before them is no part of them.
BLOCK = re.compile(rf"(?:(?<![A-Za-z0-9+/=_-])(?!(?<=\\)[rnt])|(?<=\\[rnt]))(?=[A-Za-z0-9+/]{{40}}){LINE}(?:{EOL}{LINE})*+")
PART = re.compile(EOL)
HEADER = re.compile(r"([A-Za-z][\w-]*):\s*(.*)")
#: Bytes of a block, and of the vector in DEK-Info, of the ciphers of encrypted PEM.
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "IDEA-CBC": 8, "RC2-CBC": 8, "RC2-40-CBC": 8, "RC2-64-CBC": 8, "BF-CBC": 8, "CAST5-CBC": 8, "SEED-CBC": 16} | {
    f"{k}-{n}-CBC": 16 for k in ("AES", "CAMELLIA", "ARIA") for n in (128, 192, 256)
}
SIGNATURE = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}, "none": {0}} | {
    f"{k}{n}": {128, 256, 384, 512, 1024} for k in ("RS", "PS") for n in (256, 384, 512)
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def der(data: bytes, at: int = 0) -> tuple[int, bytes, int] | None:
    """(tag, content, end) of the element at ``at``, if its length is in the shortest form and inside ``data``."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > len(data) or not data[at]:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, data[at : at + n], at + n) if at + n <= len(data) else None


def children(content: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of elements that fill ``content``."""
    out, at = [], 0
    while at < len(content):
        got = der(content, at)
        if not got:
            return None
        out.append(got[:2])
        at = got[2]
    return out


def key_structure(data: bytes) -> str | None:
    """What kind of private key the bytes are: the outer sequence fills them and the parts are those of RFC 8017, 5958, 5915 or OpenSSH."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, []
        for _ in range(3):  # cipher, key derivation, its options
            n = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + n > len(data):
                return None
            fields.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= count <= 16 or not fields[0]:
            return None
        for _ in range(count + 1):  # public keys, private part
            n = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + n > len(data) or not n:
                return None
            at += 4 + n
        return "openssh" if at == len(data) else None
    outer = der(data)
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return None
    parts = children(outer[1])
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if tags[:9] == [2] * 9 and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32:
        return "rsa"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 72:
        return "ec"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1"):
        algorithm = children(parts[1][1])
        return "pkcs8" if algorithm and algorithm[0][0] == 6 and len(parts[2][1]) >= 16 else None
    if tags == [0x30, 4]:
        algorithm = children(parts[0][1])
        return "pkcs8_encrypted" if algorithm and algorithm[0][0] == 6 else None
    if tags == [2] * 6 and parts[0][1] == b"\0":
        return "dsa"
    return None


def unbase64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH key that ``data`` begins with, as its lengths say."""
    at = 15
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(min(count, 16) + 1):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def pem_structure(body: str) -> str | None:
    """What the text between the lines of a PEM key holds: header lines may come first, and line ends may be written with backslashes.

    A body encrypted by Proc-Type and DEK-Info has no structure of its own: the cipher must be known, its vector as long as its block, and the
    body whole blocks.
    """
    body = body.replace("\\/", "/").replace("\\u003d", "=").replace("\\u002b", "+").replace("\\t", " ")
    body = re.sub(r"""["'][ \t]*[+.,\\]?\s*["']""", "", re.sub(r"(?:\\+[rn])+", "\n", body))
    heads, lines = {}, []
    for line in body.split("\n"):
        line = line.strip(" \t\r\"'+\\" if line.rstrip().endswith(("'", '"', "\\")) or line.lstrip().startswith(("'", '"')) else " \t\r")
        if m := HEADER.fullmatch(line):
            heads[m[1]] = m[2].strip()
        else:
            lines.append(line)
    data = unbase64("".join("".join(lines).split()))
    if not data:
        return None
    if heads.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED":
        cipher, _, vector = (x.strip() for x in heads.get("DEK-Info", "").partition(","))
        block = CIPHERS.get(cipher.upper())
        ok = block and re.fullmatch(rf"[0-9A-Fa-f]{{{2 * block}}}", vector) and len(data) >= 32 and len(data) % block == 0
        return "encrypted" if ok else None
    return key_structure(data)


def keys_in(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """(begin, end, structure) of the keys in a block of lines: from each line that can begin one, as many lines as its lengths ask for."""
    lines, at = [], begin
    for m in PART.finditer(text, begin, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    out, k = [], 0
    while k < len(lines):
        step = 1
        for hexed, begins in ((False, ("M", "b3BlbnNzaC1rZXktdjE")), (True, ("30", "6f70656e7373682d6b65792d7631", "6F70656E7373682D6B65792D7631"))):
            if not text.startswith(begins, lines[k][0]):
                continue
            head = text[lines[k][0] : lines[k][0] + 12]
            start = (bytes.fromhex(head) if re.fullmatch("[0-9A-Fa-f]{12}", head) else b"") if hexed else unbase64(head) or b""
            if start[:1] == b"0" and len(start) >= 6:
                n = start[1] & 127 if start[1] >= 128 else 0
                size = 2 + n + (int.from_bytes(start[2 : 2 + n], "big") if n else start[1])
                if n > 4:
                    continue
            elif start.startswith(b"openss"):
                rest = "".join(text[a:b] for a, b in lines[k:]).partition("=")[0]
                rest = re.match("(?:[0-9A-Fa-f]{2})*" if hexed else "(?:.{4})*", rest)[0]
                size = openssh_size(bytes.fromhex(rest) if hexed else unbase64(rest) or b"")
            else:
                continue
            need = 2 * size if hexed else -(-size * 4 // 3)
            if need > end - lines[k][0]:
                continue
            joined = ""
            for last in range(k, len(lines)):
                joined += text[lines[last][0] : lines[last][1]]
                if (have := len(joined.rstrip("="))) >= need:
                    break
            if have != need:
                continue
            data = (bytes.fromhex(joined) if re.fullmatch("(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+", joined) else None) if hexed else unbase64(joined)
            if data and (kind := key_structure(data)):
                out.append((lines[k][0], lines[last][1], kind))
                step = last - k + 1
                break
        k += step
    return out


def signed(header: str, payload: str, signature: str) -> bool:
    parts = [unbase64(x, url=True) for x in (header, payload, signature)]
    if None in parts:
        return False
    try:
        head, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and len(parts[2]) in SIGNATURE.get(head.get("alg") if isinstance(head.get("alg"), str) else "", ())


def checksum62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def varied(data: bytes) -> bool:
    """Random bytes of a key's length hardly repeat: more than half of (up to 32 of) them differ from each other, and they aren't printable text."""
    return len(data) in KEY_BYTES and len(set(data[:32])) * 2 > min(len(data), 32) and not all(32 <= b < 127 for b in data)


def findings(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, detail) in order of begin."""
    found = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if kind := pem_structure(m[2]):
                found.append(("private_key", *m.span(), kind))
    for m in TOKEN.finditer(text) if "eyJ" in text else ():
        if signed(*m.groups()):
            found.append(("signed_token", *m.span(), json.loads(unbase64(m[1], url=True))["alg"]))
    runs = [m.span() for m in RUN.finditer(text)]
    for m in ACCESS.finditer(text) if "AKIA" in text or "ASIA" in text else ():
        if 0 < (int.from_bytes(base64.b32decode(m[1])[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12 and len(set(m[1])) > 4:
            found.append(("access_key", *m.span(), "base32"))
    for m in HUB.finditer(text) if "gh" in text and runs else ():
        if checksum62(m[1]) == m[2]:
            found.append(("hub_token", *m.span(), "crc32"))
    for m in BLOCK.finditer(text) if any(b - a >= 40 for a, b in runs) else ():
        found += [("der_key", *key) for key in keys_in(text, *m.span())]
    for begin, end in runs:
        before = ASSIGNED.search(text[max(0, begin - BEFORE) : begin])
        after = before and CLOSED[before[1]].match(text, end)
        if not after:
            continue
        value, end = text[begin : after.end(1)], after.end(1)
        if re.fullmatch(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+", value):
            if varied(bytes.fromhex(value)):
                found.append(("assigned_hex", begin, end, f"{len(value) // 2} bytes"))
            continue
        data = unbase64(value, url="-" in value or "_" in value)
        if data and varied(data) and re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value):
            found.append(("assigned_base64", begin, end, f"{len(data)} bytes"))
    return apart(sorted(found, key=lambda f: (f[1] - f[2], f[1], f[0])))


FOUND = "array<struct<kind:string,begin:int,end:int,detail:string>>"
ARROW_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))


def scan(docs: DataFrame, unconfirmed: bool = True) -> DataFrame:
    """(doc_id, kind, begin, end, detail, confirmed): a row for each secret, without those of no structure unless ``unconfirmed``; the secret itself is
    not repeated."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def search(column: pa.Array) -> pa.Array:
        texts = (item.as_py() for item in column)
        return pa.array([[{"kind": k, "begin": b, "end": e, "detail": d} for k, b, e, d in findings(text)] if text else [] for text in texts], ARROW_FOUND)

    found = narrow(docs).select(F.col("_k").alias("doc_id"), F.explode(search("_t")).alias("s")).select("doc_id", "s.kind", "s.begin", "s.end", "s.detail")
    found = found.withColumn("confirmed", ~F.col("kind").isin(sorted(UNCONFIRMED)))
    return found if unconfirmed else found.where("confirmed")
