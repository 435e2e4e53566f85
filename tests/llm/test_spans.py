"""Personal data and secrets against the plain patterns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidewater.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute_secrets(text):
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_pii_is_the_patterns():
    rng = random.Random(3)
    parts = ["1", "23", ".", "@", "+", " ", "-", "a", "(", ")", "255", "256", "x.y", "1.", "4111 1111 1111 1111", "4111111111111111", "\n", "é", "+1 (499) 555-6503"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute_pii(text), text


def test_pii_extras():
    text = "Write mailto:jo@ex.org or tel:+1-555-010-9999. IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, account no. 12345678, accounting 99999999."
    extra = {(k, text[a:b]) for a, b, k in pii.find(text) if k not in pii.BASE}
    assert extra == {("contact", "mailto:jo@ex.org"), ("contact", "tel:+1-555-010-9999"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("account", "12345678")}
    assert "jo@" not in pii.redact(text, pii.find(text)) and "GB82" not in pii.redact(text, pii.find(text))
    assert pii.find("Plain prose, nothing else: 12 of 30.") == []


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Social Security 123-45-6789", "ssn", "123-45-6789"),
        ("SOCIAL SECURITY Number: 123-45-6789", "ssn", "123-45-6789"),
        ("Account Number: 12345678", "account", "12345678"),
        ("Account No. 12345678", "account", "12345678"),
        ("ACCOUNT NO: 12345678", "account", "12345678"),
        ("\u0130 Account Nr 12345678", "account", "12345678"),
    ],
)
def test_pii_cues_in_any_case(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == [(kind, value)]
    assert value not in pii.redact(text, pii.find(text))


def test_pii_table(spark):
    long = "x " * 200_000 + "a@b.co"
    rows = [(1, "é a@b.co 1.2.3.4", 9), (2, None, None), (3, "", 0), (None, "a@b.co", 6), (1, "é a@b.co 1.2.3.4", 9), (5, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email long")
    got = pii.personal_data(docs).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.spans): r for r in got}
    base = "email:2:8,ip:9:16"
    one = by[1, base]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert by[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None, "email:0:6"].n_email == 1 and by[5, "email:400000:400006"].n_email == 1
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a@b.co x", "z", 8), (2, None, None, None), (3, "clean", None, 7)], "doc_id long, text string, kind string, n_chars long")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[1].text == "<EMAIL> x" and got[1].n_chars == 9 and got[1].kind == "z"
    assert got[2].text is None and got[2].n_chars is None
    assert got[3].text == "clean" and got[3].n_chars == 7


def test_secrets_are_the_patterns():
    rng = random.Random(5)
    parts = ["token", "ToKeN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "abc", "-", "/", "\n", "é", "ſecret", "password", "x"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert [s[:3] for s in secrets.base_spans(text)] == brute_secrets(text), text


def test_automata_learn_formats():
    rng = random.Random(7)
    key = lambda: "sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(24))
    access = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    labelled = [("assign", key()) for _ in range(200)] + [("access", access()) for _ in range(200)]
    ordinary = [rng.choice(["the", "and", "Chapter-12", "2024-05-06", "end.", "part_3", "mail4.example.com"]) for _ in range(300)]
    model = secrets.FormatModel(labelled, ordinary)
    assert len(model.automata["assign"].states) < 200
    held = [key() for _ in range(50)] + [access() for _ in range(50)]
    assert sum(model.score(v) >= model.least for v in held) >= 90
    assert not any(model.score(v) >= model.least for v in ["Chapter-12-and-the-end", "2024-05-06.2024-05-07", "http-equiv-content-2"])
    text = f"use {held[0]} here, not Chapter-12-and-the-end"
    assert model.spans(text, []) == [(4, 4 + len(held[0]), "format")]
    assert model.spans(text, [(4, 31, "hex", "")]) == []
    many = " ".join(f"{v}." for v in held[:50])
    base = [(m.start(), m.end(), "hex", m[0]) for m in re.finditer(r"\S+", many)][::2]
    assert [many[a:b] for a, b, _ in model.spans(many, base)] == [v for v in held[1:50:2] if model.fits(v)]


def test_held_out_credentials_without_context(spark):
    """Values that only an assignment labels are found elsewhere, where no base pattern matches; ordinary words aren't."""
    rng = random.Random(9)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    key = lambda: "".join(rng.choice(upper) + rng.choice(digits) for _ in range(7))
    words = lambda: " ".join("".join(rng.choice(["an", "er", "th", "ou", "st", "re"]) for _ in range(rng.randint(1, 8))) for _ in range(40))
    held = {1000 + k: key() for k in range(60)}
    rows = [(k, f"{words()} password = {key()} {words()}") for k in range(200)] + [(d, f"{words()} sent {v}, then {words()}") for d, v in held.items()]
    rows += [(5000, "Chapter-12-and-the-end mail.example.com/index 2024-05-06/2024-05-07")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in secrets.secrets(docs).collect()}
    found = {d: [text[d][int(a) : int(b)] for k, a, b in spans if k == "format"] for d, spans in got.items()}
    assert sum(found[d] == [v] for d, v in held.items()) >= 57
    assert not any(found[d] for d in found if d not in held)


def test_secret_table(spark):
    hexes = [f"{k:032x}" for k in range(10**30, 10**30 + 40 * 10**28, 10**28)]
    rows = [(k, f"word token = {h} and more words", k) for k, h in enumerate(hexes)]
    rows += [(100, None, 1), (101, "", 1), (None, "clean words only", 1), (0, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hex long")
    got = secrets.secrets(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for d, t, _ in rows if d == r.doc_id)
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_secrets(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    assert secrets.secrets(docs.limit(0)).count() == 0
    assert secrets.secrets(docs.where("doc_id = 101")).first().spans == ""


@pytest.mark.parametrize("values", [[], ["a1" * 10]])
def test_model_of_little(values):
    model = secrets.FormatModel([("hex", v) for v in values], ["a", ""])
    assert (model.score("a1a1a1a1a1a1a1a1") > 0) == bool(values)


def test_secret_model_does_not_depend_on_copies(spark, monkeypatch):
    """A credential that is copied in most documents, and ever more of the same words, leave the model as it is."""
    rng = random.Random(11)
    key = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(32))
    access = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    texts = [f"Some words, part-{k} and {key()} or {access()} end" for k in range(20)]
    seen, make = [], secrets.FormatModel
    monkeypatch.setattr(secrets, "FormatModel", lambda labelled, ordinary: seen.append(labelled) or make(labelled, ordinary))
    fit = lambda rows: secrets.fit(spark.createDataFrame([(t,) for t in rows], "text string"), rows=30)
    one, many = fit(texts * 3), fit(texts * 60 + [texts[0]] * 1000)
    for labelled in seen:
        assert Counter(k for k, _ in labelled) == {"hex": 15, "access": 15} and len(set(labelled)) == 30
    assert many.automata.keys() == one.automata.keys()
    again = fit(texts * 60)
    assert again.plain == pytest.approx(one.plain) and again.least == pytest.approx(one.least)
