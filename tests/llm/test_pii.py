import hashlib
import re

from llm_cases import as_rows, both, empty

from cardflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def fits(kind, text):
    digits = sum(c.isdigit() for c in text)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".") if len(p) < 4000),
            "card": 12 <= digits <= 19 and luhn(text), "phone": 9 <= digits <= 15}[kind]


def brute(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text) if fits(kind, m.group())]
    counts = tuple(sum(s[3] == kind for s in spans) for kind in PATTERNS)
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest())


def test_base_equals_plain_search(spark):
    docs, pairs = both(spark)
    found = as_rows(pii.find_personal_data(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert found == sorted(((i, *brute(t or "")) for i, t in pairs), key=repr)
    assert sum(r[1] for r in found) > 2 and sum(r[3] for r in found) > 0


def test_checksums_and_context():
    text = "iban GB82 WEST 1234 5698 7654 32 HELLO; my ssn 123-45-6789, order" + " " * 60 + "123-45-6780"
    spans = [str(s) for s in pii.find_spans(text)]
    assert f"iban:5:{text.index(' HELLO')}" in spans
    assert [s for s in spans if s.startswith("ssn")] == [f"ssn:{text.index('123-45-6789')}:{text.index(', order')}"]
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33") if pii.KINDS[s.rank] == "iban"]
    near, far = (next(s for s in pii.find_spans(t) if s.rank == 2) for t in ("card 4111111111111111", "4111111111111111"))
    assert near.score > far.score


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "@" * 300_000, "1.2." * 80_000, "a." * 150_000 + "@"):
        pii.find_spans(text)


def test_empty_table(spark):
    assert pii.find_personal_data(empty(spark)).count() == 0
