"""Secret scan with structural confirmation.

A cheap pattern finds candidates: runs of base64 or hex characters (also straight after NAME=, hex also after 0x), PEM blocks and dotted signed tokens. None is
reported for its looks. Each is decoded and its structure parsed: DER with all nested lengths consistent down to
the last byte (PKCS#1, PKCS#8, SEC 1 and encrypted keys), OpenSSH's length-prefixed private key format, the header
and claims of a signed token with a signature of the length that its algorithm has. A bare hex or base64 value has
no structure of its own; it is reported only if it is assigned to a name that says it is a secret, decodes to a
whole key length and has the variety of random bytes.

Findings: kind, begin and end (code points, end exclusive) in the text, decoded length, and what was parsed.
Where candidates overlap, the one that begins first is reported, and of these the longest.

Defined results: null and empty texts have no findings. Rows with null or repeated ids are scanned one by one.
An empty table gives an empty result. Extra columns are ignored by ``scan`` and kept by ``redact``, which replaces
each finding by ``[SECRET:<kind>]`` and recounts ``n_chars`` if there is such a column.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, pick, shielded, table

FINDING = "kind string, begin int, end int, n_bytes int, detail string"
#: Any text with a finding matches this; the JVM tests it before a text goes to Python.
PREFILTER = "[A-Za-z0-9+/_-]{22}|eyJ[A-Za-z0-9_-]{10}|-----BEGIN "

CANDIDATE = re.compile(
    r"(?P<pem>-----BEGIN (?P<label>[A-Z0-9 ]*PRIVATE KEY)-----(?P<body>[A-Za-z0-9+/=\s\\:,.-]*?)-----END (?P=label)-----)"
    r"|(?P<jwt>(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*)"
    r"|(?P<hex>(?<![A-Za-z0-9+/_-])(?:0[xX])?(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9+/_=-]))"
    r"|(?P<b64>(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}(?![A-Za-z0-9+/_=-]))"
)
#: The end of a name that says what is assigned to it; with what may stand around it no longer than NAME_CHARS.
NAME = re.compile(
    r"(?<![A-Za-z0-9])(?P<name>tokens?|secrets?|passwords?|passwd|pwd|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|keys?|auth|credentials?|bearer)$", re.IGNORECASE
)
NAME_CHARS = 16
KEY_BYTES = {16, 20, 24, 32, 40, 48, 64}
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}
OPENSSH = b"openssh-key-v1\0"
#: Algorithm identifiers of PKCS#8, by the structure of the key inside; beginnings of those of its encryption schemes.
RSA_OIDS = ("2a864886f70d010101", "2a864886f70d01010a")
EC_OID, DSA_OID = "2a8648ce3d0201", "2a8648ce380401"
RAW_OIDS = {"2b656e": 32, "2b656f": 56, "2b6570": 32, "2b6571": 57}
SCHEMES = ("2a864886f70d0105", "2a864886f70d010c01")


def der(data: bytes, depth: int = 0) -> list | None:
    """Parse DER: [(tag, content or nested list)], or None unless every length fits exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > len(data):
            return None
        body = data[at : at + n]
        at += n
        if tag & 0x20:
            nested = der(body, depth + 1)
            if nested is None:
                return None
            out.append((tag, nested))
        else:
            out.append((tag, body))
    return out


def _openssh(data: bytes) -> tuple[str, str] | None:
    """Cipher, derivation and its options, the number of keys, a public key each, and the private ones in one blob."""

    def field(at: int) -> tuple[bytes, int] | None:
        n = int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None

    at, fields = len(OPENSSH), []
    while at < len(data):
        if len(fields) == 3:
            fields.append(data[at : at + 4])
            at += 4
            continue
        got = field(at)
        if not got:
            return None
        fields.append(got[0])
        at = got[1]
    if len(fields) < 6 or at != len(data):
        return None
    cipher, number, *public, private = fields[0], int.from_bytes(fields[3], "big"), *fields[4:]
    kinds = [x[4 : 4 + int.from_bytes(x[:4], "big")] for x in public]
    if number != len(public) or not all(re.fullmatch(rb"[a-zA-Z0-9@.-]{4,64}", x) for x in kinds):
        return None
    if not private or len(private) % 8 or cipher == b"none" and private[:4] != private[4:8]:
        return None
    return "openssh_private_key", f"cipher {cipher.decode('ascii', 'replace')}, {number} key"


def key_encoding(data: bytes) -> tuple[str, str] | None:
    """Kind and description of a private key's encoding."""
    if data.startswith(OPENSSH):
        return _openssh(data)
    if len(data) < 16 or data[0] != 0x30:
        return None
    tree = der(data)
    if not tree or len(tree) != 1 or tree[0][0] != 0x30:
        return None
    inner = tree[0][1]
    tags = [t for t, _ in inner]
    if len(inner) >= 9 and all(t == 0x02 for t in tags[:9]):
        return "rsa_private_key", f"modulus {8 * len(inner[1][1].lstrip(bytes(1)))} bits"
    if tags[:3] == [0x02, 0x30, 0x04] and inner[1][1] and inner[1][1][0][0] == 0x06:
        oid = inner[1][1][0][1].hex()
        return ("pkcs8_private_key", f"algorithm {oid}") if _inside(oid, inner[2][1]) else None
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\x01" and len(inner[1][1]) in (28, 32, 48, 66):
        return "ec_private_key", f"scalar {8 * len(inner[1][1])} bits"
    if len(inner) == 6 and all(t == 0x02 for t in tags):
        return "dsa_private_key", "6 integers"
    if tags == [0x30, 0x04] and inner[0][1] and inner[0][1][0][0] == 0x06:
        oid, sealed = inner[0][1][0][1].hex(), inner[1][1]
        if oid.startswith(SCHEMES) and sealed and len(sealed) % 8 == 0:
            return "encrypted_private_key", f"scheme {oid}"
    return None


def _inside(oid: str, data: bytes) -> bool:
    """Whether the key inside PKCS#8 has the structure that its algorithm asks for (any, if it isn't a known one)."""
    kind = (key_encoding(data) or ("",))[0]
    if oid in RSA_OIDS:
        return kind == "rsa_private_key"
    if oid == EC_OID:
        return kind == "ec_private_key"
    parts = der(data) or []
    if oid in RAW_OIDS:
        return len(parts) == 1 and parts[0][0] == 0x04 and len(parts[0][1]) == RAW_OIDS[oid]
    if oid == DSA_OID:
        return len(parts) == 1 and parts[0][0] == 0x02
    return bool(kind) or len(parts) == 1 and parts[0][0] in (0x02, 0x04, 0x30)


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    url = "-" in s or "_" in s
    if url and ("+" in s or "/" in s):
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(s: str) -> tuple[str, str, int] | None:
    parts = s.split(".")
    try:
        head, claims = (json.loads(unbase64(p) or b"x") for p in parts[:2])
    except ValueError:
        return None
    if not isinstance(head, dict) or not isinstance(claims, dict) or not isinstance(head.get("alg"), str):
        return None
    signature = unbase64(parts[2]) if parts[2] else b""
    alg = head["alg"].upper()
    if alg == "NONE" or not signature:
        return None
    if alg in SIGNATURE_BYTES and len(signature) != SIGNATURE_BYTES[alg]:
        return None
    if alg[:2] in ("RS", "PS") and len(signature) not in (128, 256, 384, 512):
        return None
    return "signed_token", f"alg {head['alg']}", len(signature)


def _named(text: str, at: int) -> str | None:
    """The name that the value at this place is assigned to: a quote, an operator and any white space may stand between."""

    def before(i: int, *marks: str) -> int:
        return next((i - len(m) for m in marks if text.endswith(m, 0, i)), i)

    def spaces(i: int) -> int:
        while i and text[i - 1].isspace():
            i -= 1
        return i

    i = spaces(before(at, '"', "'", "`"))
    i = before(spaces(before(i, "=>", ":=", ":", "=")), '"', "'")
    m = NAME.search(text[max(0, i - NAME_CHARS) : i])
    return m and m["name"].lower()


def _varied(data: bytes) -> bool:
    return len(set(data)) >= min(len(data), 24) * 0.6


def _confirm(m: re.Match, text: str) -> tuple[str, int, str] | None:
    if m["pem"]:
        body = re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"^[A-Za-z0-9-]+:.*$", "", m["body"].replace("\\n", "\n"), flags=re.M))
        data = unbase64(body)
        found = data and key_encoding(data)
        if not found and data and "ENCRYPTED" in m["body"] and len(data) % 8 == 0:
            found = ("encrypted_private_key", "legacy PEM cipher")
        return found and (found[0], len(data), found[1])
    if m["jwt"]:
        found = signed_token(m["jwt"])
        return found and (found[0], found[2], found[1])
    value = m["hex"] or m["b64"]
    if m["hex"] and value[1] in "xX":
        value = value[2:]
    if m["hex"]:
        data = bytes.fromhex(value) if len(value) % 2 == 0 else None
    else:
        data = unbase64(value)
    if not data:
        return None
    found = key_encoding(data)
    if found:
        return found[0], len(data), found[1]
    if len(data) in KEY_BYTES and _varied(data) and (m["hex"] or re.search(r"\d", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        named = _named(text, m.start())
        if named:
            return ("hex_secret" if m["hex"] else "base64_secret"), len(data), f"assigned to {named}"
    return None


def findings(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """Confirmed secrets of one text: kind, begin, end, decoded bytes, detail."""
    out, at = [], 0
    while text and (m := CANDIDATE.search(text, at)):
        got = _confirm(m, text)
        if got:
            out.append((got[0], m.start(), m.end(), got[1], got[2]))
            at = m.end()
        else:
            at = m.start() + len("-----BEGIN ") if m["pem"] else m.end() if not m["jwt"] else m.start() + m["jwt"].index(".") + 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed secret."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", *[x.split()[0] for x in FINDING.split(", ")]]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = findings(text)
                rows += got
                at += [i] * len(got)
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names)

    likely = docs.filter(F.col("text").rlike(PREFILTER))
    return likely.transform(arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FINDING}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every confirmed secret replaced in place; one narrow pass, columns as they came."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            got = findings(text)
            for kind, begin, end, _, _ in reversed(got):
                text = f"{text[:begin]}[SECRET:{kind}]{text[end:]}"
            return text

        return texts.map(one, na_action="ignore")

    plain, new = shielded(docs)
    text = F.col(new[text_col])
    likely = F.coalesce(text.rlike(PREFILTER), F.lit(False))
    # a branch doesn't keep a Python function from running, an empty input does: only likely texts are sent
    sent = plain.withColumn("__sent", F.when(likely, text)).withColumn("__clean", clean("__sent"))
    after = F.coalesce("__clean", text)
    out = {new[text_col]: after}
    if "n_chars" in new:
        n = F.col(new["n_chars"])
        out[new["n_chars"]] = F.when(F.col("__clean").isNotNull(), F.length(after).cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return sent.withColumns(out).select(*new.values()).toDF(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
