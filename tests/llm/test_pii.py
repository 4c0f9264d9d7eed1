import hashlib
import random
import re
import time

from ledgerloom.llm import pii
from ledgerloom.llm.queries import op13_pii

SCHEMA = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text):
    """The base spans, by the patterns as they are stated."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if keep:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def with_check_digit(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_base_spans_are_the_patterns_own():
    rng = random.Random(5)
    for alphabet in ("a@.-", "@.a b1", "1.2 ", "25.", "0123456789- ", "+1 (2).-3", "+12 x", "a@1.+-é ", "ſK@.a\n1"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randrange(45)))
            assert [str(s) for s in pii.base_spans(text)] == brute(text), text
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (803) 555-5351", "999.1.1.1", "1.2.3.4.5.6.7.8", "001.002.003.255", "a@b", "a.b+c@d-e.fr", "@", "é", " ", "5"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=8))
        assert [str(s) for s in pii.base_spans(text)] == brute(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def test_more_kinds_need_evidence():
    def kinds(text):
        return [(s.kind, text[s.start : s.end]) for s in pii.find(text)[1]]

    assert kinds("transfer to GB82 WEST 1234 5698 7654 32 today") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("transfer to GB82 WEST 1234 5698 7654 32 NOW") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("transfer to GB83 WEST 1234 5698 7654 32 today") == []
    short = with_check_digit("422222222222")
    assert kinds(f"card {short} expires") == [("bank_card", short)] and kinds(f"item {short} sold") == []
    assert kinds(f"isbn of the card {short}") == []
    assert kinds("call 030 1234 5678 now") == [("local_phone", "030 1234 5678")] and kinds("score 030 1234 5678 now") == []
    assert kinds("call on 2024-01-02 1234") == []
    assert kinds("SSN 123-45-6789.") == [("tax_number", "123-45-6789")] and kinds("part 123-45-6789.") == [] and kinds("SSN 000-45-6789.") == []
    # a base span stays whatever stands near it, and nothing lies over it
    assert kinds("example order a@b.example") == [("email", "a@b.example")]
    assert kinds("phone +49 30 1234 5678 90") == [("phone", "+49 30 1234 5678 90")]


def test_defined_cases(spark, stored):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "1.2.3.4"), (4, "\U0001f600é a@b.cc +1 234 567 8901"), (5, "x" * 3_000 + "@y.zz " + "1" * 3_000)]
    docs = stored(rows, SCHEMA).selectExpr("*", "'q' AS spans", "1 AS kind", "2 AS score")
    got = sorted(map(tuple, pii.find_private(docs).collect()), key=repr)
    expected = []
    for i, t in rows:
        spans = brute(t)
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        expected.append((i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    assert [r[:7] for r in got] == sorted(expected, key=repr)
    assert pii.find_private(stored([], SCHEMA, "none")).collect() == []
    listed = sorted((r.doc_id or 0, r.kind, r.found) for r in pii.list_private(docs).where("doc_id < 5 OR doc_id IS NULL").collect())
    assert listed == [(0, "ip", "1.2.3.4"), (3, "email", "x@y.zz"), (3, "email", "x@y.zz"), (4, "email", "a@b.cc"), (4, "phone", "+1 234 567 8901")]
    masked = {r.doc_id: r.text for r in pii.mask_private(docs).where("doc_id < 5").collect()}
    assert masked == {1: None, 2: "", 3: "<email>", 4: "\U0001f600é <email> <phone>"}


def test_time_is_linear_in_hard_texts():
    began = time.time()
    for unit in ("a", "1", "1 ", "1.", "a.", "@", "a@", "+", "+1", "AB12 ", "12-", "(12)"):
        pii.find(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 60


def test_query_finds_the_patterns_in_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_pii(spark, folder).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
