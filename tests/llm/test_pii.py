import hashlib
import random
import re
import time

from rowforge.llm.pii import pii_report, redact

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(spans)]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(1)
    fixed = [
        "a@b.c@d.ef x..y@z.co.@q.rs a@b a@b. @b.c", "é😀 mail: x@y.org, 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (212) 555-0101x +49.30.123456 +1+2+3 +12345678901234567", "0" * 40, "1" * 5000 + "@" + "a." * 3000 + "b", None, "", "4111111111111111@x.com +4111111111111111",
        "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "12345678901234567890123 4111 1111 1111 1111",
    ]
    pieces = ["@", ".", "a", "b9", "1", "22", "255", "300", "+", "-", " ", "(", ")", "%", "é", "😀", "x@y.z", "1.2.3.4", "4111111111111111", "+12125550101"]
    texts = fixed + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(2500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int").repartition(4)
    for r in pii_report(docs).collect():
        want = brute(texts[r.doc_id])
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] not in ("iban", "ssn")]
        assert base == want, (texts[r.doc_id], base, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k, _ in PLAIN]


def test_added_kinds_context_and_redaction(spark):
    texts = {
        1: "Pay to IBAN DE89 3704 0044 0532 0130 00 now", 2: "Pay to DE89 3704 0044 0532 0130 01 now", 3: "My SSN is 219-09-9999.", 4: "Part 219-09-9999.",
        5: "mail a@b.co, +1 212 555 0101!", 6: None, 7: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_report(docs).collect()}
    assert spans == {1: "iban:12:39", 2: "", 3: "ssn:10:21", 4: "", 5: "email:5:11,phone:13:28", 6: "", 7: ""}
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[1] == "Pay to IBAN [IBAN] now" and clean[5] == "mail [EMAIL], [PHONE]!" and clean[6] is None and clean[4] == texts[4]
    assert pii_report(docs.limit(0)).count() == 0 and redact(docs).columns == docs.columns


def test_iban_before_capitals_and_numbers(spark):
    number = "DE89370400440532013000"
    grouped = "DE89 3704 0044 0532 0130 00"
    texts = {
        1: f"IBAN {number} Please pay", 2: f"{grouped} BIC COBADEFF", 3: f"{number} EUR 100", 4: f"{number} {number}", 5: f"AB12 {number}", 6: f"SE20 {grouped}",
        7: f"{number}X", 8: "NO93 8601 1117 947 1 NL91ABNA0417164300 A", 9: "XX93 3704 0044 0532 0130 00", 10: f"{'AB12 ' * 3000}{grouped}", 11: "MT84MALT011000012345MTLCAST001S OK",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii_report(docs).collect()}
    assert spans == {
        1: ["iban:5:27"], 2: ["iban:0:27"], 3: ["iban:0:22"], 4: ["iban:0:22", "iban:23:45"], 5: ["iban:5:27"], 6: ["iban:5:32"],
        7: [], 8: ["iban:0:18", "iban:21:39"], 9: [], 10: ["iban:15000:15027"], 11: ["iban:0:31"],
    }
    assert {r.doc_id: r.text for r in redact(docs).collect()}[1] == "IBAN [IBAN] Please pay"


def test_redaction_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["x@y.zz", "1.2.3.4", "4111111111111111", "+12125550101", "SSN 219-09-9999", " ", "é", "😀", " and ", "DE89370400440532013000", "@", "9"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += ["".join(rng.choice(pieces) + rng.choice([" ", "", " é "]) for _ in range(n)) for n in (255, 256, 257, 600, 1500)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, spans string, start int").repartition(4)
    spans = {r.doc_id: r.spans for r in pii_report(docs).collect()}
    for r in redact(docs).collect():
        out, at = "", 0
        for span in [s.split(":") for s in spans[r.doc_id].split(",") if s]:
            start, end = int(span[1]), int(span[2])
            if start >= at:
                out += texts[r.doc_id][at:start] + f"[{span[0].upper()}]"
            at = max(at, end)
        assert r.text == (None if texts[r.doc_id] is None else out + texts[r.doc_id][at:]) and r.start == r.doc_id


def test_many_matches_in_one_text(spark):
    """The work is in proportion to the matches: a walk that copied all spans at each match would take minutes."""
    texts = {1: " ".join(f"n{k}@example.org" for k in range(100_000)), 2: "1.2.3.4 " * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r for r in pii_report(docs).collect()}
    assert out[1].n_email == 100_000 and out[2].n_ip == 50_000
    assert out[1].spans.split(",")[77_777] == (lambda m: f"email:{m.start()}:{m.end()}")(re.search("n77777@example.org", texts[1]))
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 100_000) and clean[2] == "[IP] " * 50_000
    assert time.time() - began < 60


def test_context_reaches_across_earlier_matches(spark):
    texts = {1: "SSN: 219-09-9999, 219-09-9998, 219-09-9997", 2: "219-09-9999, 219-09-9998 is my SSN", 3: "SSN" + " x" * 40 + " 219-09-9999"}
    out = {r.doc_id: r.spans for r in pii_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out == {1: "ssn:5:16,ssn:18:29,ssn:31:42", 2: "ssn:0:11,ssn:13:24", 3: ""}
