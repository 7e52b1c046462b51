"""Personal data against a plain loop over the texts."""

import random
import re

from pyspark.sql import functions as F

from veinway.operators import privacy

NAMES = ["Anna", "Bo", "Smith", "Ann", "lower", "Two Words", "Élise", "X"]
PARTS = [
    "a.b@c.org", "x@y", "é@a.bc", "q-a+b@d-e.com_", "(555) 123-4567", "+1 555.123.4567", "555-123-4567", "+4915112345678", "123-45-6789", "666-45-6789", "123 45 6789", "000456789",
    "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "10.0.0.1", "169.254.1.1", "172.15.0.1", "999.1.1.1", "1.2.3.4.5", "08.8.8.8", "2001:db8::1", "::1", "::", "std::x", "fe80:0:0:0:0:0:0:1",
    "1:2:3", "sk-" + "a1" * 16, "AKIA" + "Z" * 16, "AKIA" + "Z" * 50, "gh_pat_" + "x" * 20, "b" * 32, "b" * 31, "c" * 40 + "!", "sk-ant-api03-" + "q" * 16, "xoxb-1-a-b", "glpat-" + "w" * 20,
    "Anna", "Smith", "Bo", "Anna's", "anna", "XAnna", "Anna_", "Annabel", "Anna@mail.org", "Smith-Bo", "Élise", " ", "\n", '"', ".", "-", "Two Words", "7", "é",
]


def by_loop(text):
    found = []
    for kind in ("email", "phone", "ssn", "credit_card", "ip_address", "api_key", "ipv6"):
        pattern = privacy.PATTERNS[kind]
        if kind == "api_key":  # the plain form of the last alternative
            pattern = pattern[: pattern.index("|(?:(?<!")] + "|[A-Za-z0-9]{32,}(?=[\"'\\s]|$)"
        for m in re.finditer(pattern, text):
            v, sure = m[0], 0.95
            if kind == "credit_card":
                digits = [int(c) for c in v if c.isdigit()][::-1]
                if sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10:
                    continue
                sure = 0.99
            if kind == "api_key" and len(v) < 20:
                continue
            if kind == "ip_address":
                a, b = map(int, v.split(".")[:2])
                sure = 0.5 if a in (10, 127) or (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b <= 31) else 0.95
            if kind == "ipv6" and not re.search("[0-9a-fA-F]", v):
                continue
            if kind == "ipv6" and (v.count("::") > 1 or ":::" in v or (v.count(":") != 7 and "::" not in v) or v.count(":") > 7 or re.search(r"^:[^:]|[^:]:$", v)):
                continue
            found.append((kind, v, m.start(), m.end(), sure))
    spans = [(f[2], f[3]) for f in found]
    for m in re.finditer(r"\b[A-Z][a-z]{1,20}\b", text):
        if m[0] in NAMES and not any(a <= m.start() < b for a, b in spans):
            found.append(("personal_name", m[0], m.start(), m.end(), 0.7))
    return found


def test_spans_are_those_of_a_loop(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(9))) for _ in range(1500)]
    rows = [*enumerate(texts), (-1, None), (-2, ""), (0, texts[0])]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("kind", F.lit("own")).repartition(4)
    names = spark.createDataFrame([(n,) for n in [*NAMES, None, "Anna"]], "name string")
    want = sorted((i, *f) for i, t in rows for f in by_loop(t or ""))
    for most in (200_000, 2):  # beyond the bound the words are joined to the names
        got = privacy.pii_spans(docs, "id", "text", names, most)
        assert sorted(tuple(r)[:6] for r in got.select("id", "kind", "value", "start", "end", "confidence").collect()) == want
    assert {k for _, k, *_ in want} == {*privacy.PATTERNS, "personal_name"}
    assert privacy.pii_spans(docs.limit(0), "id", "text", names).count() == 0 and privacy.pii_spans(docs, "id", "text").filter("kind = 'personal_name'").count() == 0


def test_long_runs_of_letters_are_read_once():
    assert privacy.pattern_spans("x" * 300_000 + "!") == []


def test_redaction_covers_every_finding(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111."), (2, None), (3, "nothing"), (4, "123-45-6789é")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, text string").select("id", privacy.redacted(F.col("text")).alias("t")).collect()}
    assert got == {1: "mail [REDACTED:email] or [REDACTED:ip_address], card [REDACTED:credit_card].", 2: None, 3: "nothing", 4: "[REDACTED:ssn]é"}


def test_a_batch_is_masked_a_slice_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["é" * 40, None, "", "a@b.org " * 30, "x", None]).slice(0, 6)
    monkeypatch.setattr(privacy, "SLICE_BYTES", 90)
    assert [len(s) for s in privacy.slices(texts)] == [3, 1, 2] and [t for s in privacy.slices(texts.slice(1)) for t in s.to_pylist()] == texts.to_pylist()[1:]
    assert list(privacy.slices(texts.slice(0, 0))) == []
