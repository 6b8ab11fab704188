"""Families of ordinary tokens, none of them made by the operator: of what is reported beside random tokens, hardly any is one of them; alone, none is."""

import base64
import math
import random
import string

import numpy as np
import pytest

from reelspark.llm import secrets

ACRONYMS = "HTTP JSON XML API SQL CPU GPU NASA UNESCO IEEE ACM ISO UTF ASCII REST SOAP TCP UDP DNS TLS SSL SSH FTP SMTP IMAP HTML CSS PHP JVM JDK SDK IDE GUI CLI URL URI UUID CRUD ORM MVC VPN LAN WAN RAM ROM SSD HDD USB PDF PNG JPEG GIF SVG MPEG NATO WHO IMF".split()
POLISH = "wszystko przez dlatego szczegolnie wlasnie chcialbym powiedziec zrobic jeszcze dziekuje prosze rzeczywiscie mozliwosc przyklad zdjecie swiatlo miedzy czlowiek krotki dzwiek kolejka zolty jezyk wiadomosc przyjaciel wczoraj jutro dzisiaj tydzien miesiac godzina szkola praca ulica miasto wojna pokoj zycie smierc milosc".split()
ENGLISH = "the quick brown fox jumps over a lazy dog while every people around them were watching with great interest and some of these had never seen anything like that before".split()


def stamp(r):
    return "%04d%02d%02d%02d%02d%02d%06d" % (r.randrange(2000, 2026), r.randrange(1, 13), r.randrange(1, 29), r.randrange(24), r.randrange(60), r.randrange(60), r.randrange(10**6))


FAMILIES = {
    "time stamps": stamp,
    "acronyms": lambda r: "_".join(r.sample(ACRONYMS, 8)),
    "words of an unknown language": lambda r: "-".join(r.sample(POLISH, 4)),
    "encoded sentences": lambda r: base64.b64encode(" ".join(r.choices(ENGLISH, k=8)).encode()).decode()[: r.choice([24, 32, 40, 60])],
    "names": lambda r: "".join(w.title() for w in r.sample(ENGLISH, 6)),
    "file names": lambda r: f"{r.choice(ENGLISH)}_{r.choice(ENGLISH)}_{r.randrange(10**4)}_{r.choice(ENGLISH)}_{r.choice(ENGLISH)}",
}
DRAWN = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_lowercase, string.ascii_uppercase)


def reported(tokens, rate=0.05):
    """Benjamini-Hochberg, plainly."""
    own = [(t, k, len(secrets.tested(t))) for t in dict.fromkeys(tokens) if (k := secrets.encoding(t))]
    known = secrets.calibrated(sorted({secrets.stratum(k, n) for _, k, n in own}), np.zeros(729))
    z = sorted((secrets.deviate(float(secrets.scores(secrets.battery(secrets.places(t, k)[None, :], k))[0]), known[secrets.stratum(k, n)]), t) for t, k, n in own)
    cut = max((i for i, (x, _) in enumerate(z, 1) if 0.5 * math.erfc(-x / math.sqrt(2)) <= rate * i / len(z)), default=0)
    return [t for _, t in z[:cut]]


@pytest.mark.parametrize("name", FAMILIES)
def test_families(name):
    rnd = random.Random(9)
    own = {FAMILIES[name](rnd) for _ in range(400)}
    drawn = {"".join(rnd.choice(a) for _ in range(40)) for a in DRAWN for _ in range(30)}
    assert not reported(own)
    got = reported([*own, *drawn])
    assert len(drawn & set(got)) > 100 and len(own & set(got)) <= 0.1 * len(got)


def test_decoding():
    for kind, encode in (("base64", base64.b64encode), ("base32", base64.b32encode), ("HEX", base64.b16encode)):
        raw = bytes(range(0, 240, 2))
        token = encode(raw).decode()
        v = np.array([[secrets.PLACES[kind][c] for c in token]])
        assert bytes(secrets.decoded(v, kind)[0].astype(np.uint8)) == raw
