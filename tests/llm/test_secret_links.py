"""Linking of weak parts and redaction against brute force, and in texts of very many parts."""

import random
import re
import time

from pyspark.sql import functions as F

from tributary.llm import secrets

WEAK = {"identifier": secrets.IDENTIFIER, "secret": secrets.SECRET, "endpoint": secrets.ENDPOINT}
PARTS = ["AKIA" + "Q7" * 8, "a/B+" * 10, "0123456789abcdef" * 2, "https://api.example.org/v1", "client_id=web-client", "SK" + "0a" * 16, "password=hunter2hunter2", "\U0001f600\U0001f600", "plain words"]


def _spans(text):
    base = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            base.append((m.start(), m.end(), "assign"))
    base += [(m.start(), m.end(), "access") for m in re.finditer(secrets.ACCESS, text)]
    base += [(m.start(), m.end(), "hex") for m in re.finditer(secrets.HEX, text)]
    weak = [(m.start(), m.end(), k) for k, p in WEAK.items() for m in re.finditer(p, text)]
    near = lambda s, kinds: any(max(s[0], o[0]) - min(s[1], o[1]) <= secrets.SCOPE for o in base + weak if o[2] in kinds)
    names, keys = ("access", "identifier"), ("assign", "hex", "secret")
    linked = []
    for s in weak:
        if any(b[0] < s[1] and s[0] < b[1] for b in base):
            continue
        if {"identifier": near(s, keys), "secret": near(s, names), "endpoint": near(s, names) and near(s, keys)}[s[2]]:
            linked.append(s)
    return sorted(base, key=lambda s: (s[0], secrets.KINDS.index(s[2]))), sorted(linked, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def _redacted(text, spans):
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_links_and_redaction_against_brute_force(spark):
    rng = random.Random(12)
    texts = ["", None]
    for _ in range(150):
        texts.append("".join(rng.choice(PARTS) + " " * rng.choice([1, 3, 150, 380, 401, 900]) for _ in range(rng.randrange(1, 14))))
    texts.append(("x" * 5000 + " " + PARTS[0] + " " + "\U0001f600 y" * 3000 + " " + PARTS[1] + " ") * 3)
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan_secrets(t)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    linked = 0
    for r in found.collect():
        base, links = _spans(r["text"] or "")
        assert [(s["start"], s["end"], s["kind"]) for s in r["base_spans"]] == base
        assert [(s["start"], s["end"], s["kind"]) for s in r["linked_spans"]] == links
        both = sorted(base + links, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert clean[r["doc_id"]] == (None if r["text"] is None else _redacted(r["text"], both))
        linked += len(links)
    assert linked > 100


def test_very_many_parts_in_one_text(spark):
    one = "id client_id=abcd%05d at https://a.example.org/x key " + "k/A9" * 10 + "\n"
    text = "".join(one % k for k in range(100_000))
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = secrets.scan_secrets(t).select(F.size("base_spans"), F.size("linked_spans")).first()
    assert tuple(got) == (0, 300_000) and time.time() - began < 60
    clean = secrets.redact(secrets.scan_secrets(t)).first()["text"]
    assert clean == "id [identifier] at [endpoint] key [secret]\n" * 100_000
