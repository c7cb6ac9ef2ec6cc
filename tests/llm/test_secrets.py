import base64
import json
import os
import re
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morphlake.llm import secrets
from tests.llm.fixtures import DOCS, awkward, clashing, empty, prose, rows


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def rand(n: int, seed: int = 1) -> bytes:
    return random.Random(seed).randbytes(n)


def rsa() -> bytes:
    return tlv(0x30, tlv(2, b"\0") + tlv(2, b"\1" + rand(127)) + tlv(2, b"\1\0\1") + b"".join(tlv(2, b"\1" + rand(63, i)) for i in range(6)))


def pem(label: str, data: bytes) -> str:
    b = base64.b64encode(data).decode()
    return f"-----BEGIN {label}-----\n" + "\n".join(b[i : i + 64] for i in range(0, len(b), 64)) + f"\n-----END {label}-----"


def jwt(alg: str, n: int) -> str:
    u = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return ".".join([u(json.dumps({"alg": alg, "typ": "JWT"}).encode()), u(json.dumps({"sub": "1234"}).encode()), u(rand(n))])


def openssh() -> bytes:
    s = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(rand(32))) + s(rand(4) * 2 + rand(128))


FOUND = {
    "rsa_private_key": pem("RSA PRIVATE KEY", rsa()),
    "pkcs8_private_key": pem("PRIVATE KEY", tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48")) + tlv(4, rsa()))),
    "ec_private_key": pem("EC PRIVATE KEY", tlv(0x30, tlv(2, b"\1") + tlv(4, rand(32)))),
    "openssh_private_key": pem("OPENSSH PRIVATE KEY", openssh()),
    "signed_token": jwt("HS256", 32),
    "hex_secret": "api_key = " + rand(32).hex(),
    "base64_secret": "secret: " + base64.b64encode(rand(40, 4)).decode(),
    "encrypted_private_key": pem("ENCRYPTED PRIVATE KEY", tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b"")) + tlv(4, rand(160)))),
}
CLEAN = [
    pem("RSA PRIVATE KEY", rsa()[:-3]),  # lengths don't add up
    pem("RSA PRIVATE KEY", rand(300)),
    pem("PRIVATE KEY", tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101"))) + tlv(4, rand(300)))),  # no key inside
    pem("ENCRYPTED PRIVATE KEY", tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x03") + tlv(0x30, b"")) + tlv(4, rand(160)))),
    pem("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + openssh()[15:-9] + bytes(9)[:1]),
    jwt("HS256", 31),
    "eyJhbGciOiJIUzI1NiJ9.notjson.signature",
    "commit " + rand(20).hex(),
    "api_key = " + "00" * 32,
    "https://example.org/" + "abcdefghij" * 5,
    "token = " + "a" * 5000,
]


@pytest.mark.parametrize("kind", FOUND)
def test_confirmed(kind):
    text = f"é before {FOUND[kind]} after"
    ((k, a, b, _, _),) = secrets.findings(text)
    assert k == kind and text[a:b] in FOUND[kind] and text[:a].endswith(("before ", "= ", ": "))


@pytest.mark.parametrize("text", CLEAN)
def test_not_reported(text):
    assert secrets.findings(text) == []


def test_scan_finds_what_was_planted_and_redacts(spark):
    """The truth is where each secret was put, not what the scanner's own function says."""
    planted = list(FOUND.items())
    texts, want = [], []
    for i in range(60):
        r = random.Random(i)
        parts = [prose(i, r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            kind, secret = r.choice([*planted, (None, r.choice(CLEAN))])
            name = secret.split(" ")[0] + " = " if kind == "hex_secret" else "secret: " if kind == "base64_secret" else ""
            value = secret[len(name) :]
            begin = len(" ".join(parts)) + 1 + len(name)
            if kind:
                want.append((i, kind, begin, begin + len(value)))
            parts += [name + value, prose(1000 + i, r.randint(1, 30))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(rows(*texts), DOCS)
    assert len(want) > 30 and sorted((r.doc_id, r.kind, r.begin, r.end) for r in secrets.scan(docs).collect()) == sorted(want)
    for r in secrets.redact(docs).collect():
        own = [w for w in want if w[0] == r.doc_id]
        assert r.text.count("[SECRET:") == len(own) and not any(texts[i][a:b] in r.text for i, _, a, b in own) and r.n_chars == len(r.text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*FOUND.values(), *CLEAN, "eyJhbGciOiJYIn0.eyJhIjoxfQ.c2ln", "key=" + base64.b64encode(rand(16)).decode(), "pwd", "=", " ", "'", "\n"]), max_size=4), st.integers(0, 30), st.integers(0, 30))
def test_a_text_with_a_finding_matches_the_prefilter(parts, a, b):
    text = " ".join(parts)
    text = text[a : len(text) - b]
    assert not secrets.findings(text) or re.search(secrets.PREFILTER, text)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("x eyJhbGciOiJYIn0.eyJhIjoxfQ.c2ln y", "signed_token"),
        ("api_key = " + base64.b64encode(rand(16)).decode(), "base64_secret"),
        ("api_key = " + base64.b64encode(rand(16)).decode().rstrip("="), "base64_secret"),
        ("api_key" + " " * 500 + "=>" + "\n" * 90 + "'" + rand(16).hex() + "'", "hex_secret"),
        ('{"password" : "' + rand(20).hex() + '"}', "hex_secret"),
        ("x" * 400 + "_secret := " + rand(20).hex(), "hex_secret"),
    ],
)
def test_short_keys_tokens_and_distant_names(spark, text, kind):
    assert [f[0] for f in secrets.findings(text)] == [kind]
    assert [r.kind for r in secrets.scan(spark.createDataFrame(rows(text), DOCS)).collect()] == [kind]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "kind", "begin", "__sent", "__clean")
    assert secrets.scan(docs).count() == 0
    same = secrets.redact(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secrets.scan(empty(spark)).count() == 0 and secrets.redact(empty(spark)).count() == 0


def test_long_text_is_scanned_whole(spark):
    long = prose(9, 200_000)
    docs = spark.createDataFrame(rows(f"{long} {FOUND['hex_secret']}"), DOCS)
    assert [r.kind for r in secrets.scan(docs).collect()] == ["hex_secret"]
    assert os.path.basename(secrets.__file__) == "secrets.py"


VALUE, HEX, DER = base64.b64encode(rand(32, 4)).decode(), rand(32).hex(), base64.b64encode(rsa()).decode()
TIGHT = {
    f"SECRET_KEY={VALUE}": ("base64_secret", VALUE),
    f"https://example.org/?api_key={VALUE.rstrip('=')}&x=1": ("base64_secret", VALUE.rstrip("=")),
    f"A_NAME_OF_MORE_THAN_24_CHARACTERS_SECRET={VALUE}": ("base64_secret", VALUE),
    f"PRIVATE_KEY={DER}": ("rsa_private_key", DER),
    f"api_key={HEX}": ("hex_secret", HEX),
    f"api_key=0x{HEX}": ("hex_secret", f"0x{HEX}"),
    f"secret: 0X{HEX.upper()}": ("hex_secret", f"0X{HEX.upper()}"),
}


@pytest.mark.parametrize("text", TIGHT)
def test_value_straight_after_its_name_or_0x(text):
    ((kind, a, b, _, _),) = secrets.findings(f"é {text} after")
    assert (kind, f"é {text} after"[a:b]) == TIGHT[text]


def test_tight_values_are_redacted(spark):
    docs = spark.createDataFrame(rows(*TIGHT), DOCS)
    for r in secrets.redact(docs).collect():
        assert TIGHT[[*TIGHT][r.doc_id]][1] not in r.text and "[SECRET:" in r.text


def test_names_without_secrets_stay():
    assert secrets.findings(f"checksum={VALUE} commit=0x{HEX}") == []
