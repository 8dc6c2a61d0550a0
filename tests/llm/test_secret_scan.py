import base64
import json
import random
import re
import struct

import pytest

from frameloom.llm import secret_scan


def tlv(tag, body):
    n = len(body)
    size = b"" if n < 128 else n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, n if n < 128 else 0x80 | len(size)]) + size + body


def fields(*parts):
    return b"".join(struct.pack(">I", len(x)) + x for x in parts)


RSA = tlv(0x30, tlv(2, b"\0") + tlv(2, b"\x01" * 129) + tlv(2, b"\x01\0\x01") + b"".join(tlv(2, b"\x7f" * n) for n in (128, 65, 65, 65, 65, 64)))
NAMED = tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b""))
PKCS8 = tlv(0x30, tlv(2, b"\0") + NAMED + tlv(4, RSA))
LOCKED = tlv(0x30, NAMED + tlv(4, b"\x99" * 80))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, b"\x11" * 32) + tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce")) + tlv(0xA1, tlv(3, b"\0" + b"\x22" * 64)))
PRIVATE = [RSA, PKCS8, LOCKED, EC]
PUBLIC = tlv(0x30, NAMED + tlv(3, b"\0" + b"\x31" * 140))
PKCS1_PUBLIC = tlv(0x30, tlv(2, b"\x01" * 129) + tlv(2, b"\x01\0\x01"))
CERTIFICATE = tlv(0x30, tlv(0x30, tlv(2, b"\5") + NAMED + PUBLIC) + NAMED + tlv(3, b"\0" + b"\x41" * 128))
SSH_PUBLIC = fields(b"ssh-ed25519", b"k" * 32)
SSH = b"openssh-key-v1\0" + fields(b"none", b"none", b"") + struct.pack(">I", 1) + fields(SSH_PUBLIC, b"\x07" * 136)


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def kinds(text):
    return [secret_scan.KINDS[k] for _, k, _, _ in secret_scan.spans(text)]


JWT = ".".join(b64(json.dumps(x).encode(), True).rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2ln"


def wrapped(text, n=64):
    return "\n".join(text[i : i + n] for i in range(0, len(text), n))


def test_structures_are_confirmed():
    assert kinds(f"see {JWT} here") == ["jwt"]
    for data in PRIVATE:
        assert secret_scan.private_key(data)
        assert kinds("-----BEGIN RSA PRIVATE KEY-----\n" + wrapped(b64(data)) + "\n-----END RSA PRIVATE KEY-----").count("pem") == 1
        assert "hexder" in kinds("x " + data.hex().upper())
    for data, kind in [*((d, "der") for d in PRIVATE), (SSH, "ssh")]:
        for body in (b64(data), b64(data).rstrip("="), b64(data, True), wrapped(b64(data)), wrapped(b64(data), 76).replace("\n", "\r\n  ")):
            text = f"a key: {body}\nand then\nwords\n"
            assert [(text[a:b], secret_scan.KINDS[k], f) for a, k, b, f in secret_scan.spans(text) if k > 2] == [(body, kind, "key")]


def test_public_material_is_none():
    for data in (PUBLIC, PKCS1_PUBLIC, CERTIFICATE, SSH_PUBLIC):
        assert not secret_scan.private_key(data)
        for label in ("CERTIFICATE", "PUBLIC KEY"):
            text = f"-----BEGIN {label}-----\n{wrapped(b64(data))}\n-----END {label}-----\nssh-ed25519 {b64(data)} me@host\n{data.hex().upper()}"
            assert set(kinds(text)) <= set(secret_scan.BASE)


def test_broken_structures_are_not():
    for data in (RSA[:-1], RSA + b"\0", b"\x30\x84" + RSA, bytes([0x30, 0x81, 5]) + b"\2\1\1\5\0", b"", b"\x30\0"):
        assert not secret_scan.private_key(data)
    for data in (SSH[:-1], SSH[:40], SSH.replace(b"none", b"nine" * 9, 1)):
        assert secret_scan.openssh_size(data) != len(data)
    assert kinds("aaaaaaaaaaa.bbbbbbbbbbb.ccccccc " + b64(b"plain words, no key at all, really none")) == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nnot base64!\n-----END RSA PRIVATE KEY-----") == []
    rng = random.Random(2)
    assert not any(secret_scan.private_key(bytes([0x30]) + rng.randbytes(60)) for _ in range(5000))


def test_forms_of_base_values():
    values = {"key": b64(EC), "jwt": JWT, "text": b64(b"user:a pass word"), "digest": "0123456789abcdef" * 2, "hex": "0123456789abcdef" * 2 + "01", "plain": "hunter22"}
    for form, value in values.items():
        assert [f for _, k, _, f in secret_scan.spans(f"password = '{value}'") if k == 0] == [form]


def base(text):
    out = []
    for m in re.finditer("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_equals_the_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "PassWord", "passwd", "api_key", "APIKEY", "token", "ſecret", "toKen", "secret", "=", ":", " ", '"', "'", "abcdef", "x" * 7, "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "日", "\U0001f642", "."]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [x[:3] for x in secret_scan.spans(text) if x[1] < 3] == base(text), text


@pytest.mark.parametrize("text", ["a" * 200_000, "ey" * 100_000, "-----BEGIN A-----" * 2000, "." * 100_000, "A" * 200_000 + "=", "MA" * 100_000, "MIIB" + "\nAAAA" * 50_000, "b3BlbnNza" * 20_000, "MAA=\n" * 40_000, "b3BlbnNzaC1rZXktdjEA" + "\nAAAA" * 50_000, "password: " * 5000])
def test_long_texts(text):
    secret_scan.spans(text)


def test_table(odd, none):
    assert secret_scan.secrets(odd.withColumn("spans", odd.n_chars)).count() == odd.count()
    assert secret_scan.secrets(none).count() == 0
