import hashlib
import itertools
import random
import re
import time

from changelens.llm import pii, queries

from tests.llm.cases import documents, hard_rows


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def own(text):
    return [s for s in pii.proposed(text) if s[0] in pii.BASE_KINDS]


def test_base_spans_of_random_texts():
    rng = random.Random(9)
    for _ in range(20000):
        text = "".join(rng.choices("01239.@+- ()abé%\n", k=rng.randrange(60)))
        assert own(text) == base(text), text
    for _ in range(5000):
        text = "".join(rng.choices("0123456789 -", weights=[9] * 10 + [2, 2], k=rng.randrange(80)))
        assert own(text) == base(text), text


def test_time_is_linear_in_the_text():
    began = time.perf_counter()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 150_000, "+1(" * 100_000, "A1" * 150_000, "a@" * 150_000):
        list(pii.proposed(text))
    assert time.perf_counter() - began < 20


def test_checksums_confirm_and_context_adds():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod_97("GB82WEST12345698765432") and not pii.mod_97("GB82WEST12345698765431")
    text = "my bank account GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, or 223-45-6789"
    found = [(k, text[s:e], v) for k, s, e, v in pii.spans_of(text) if k in pii.ADDED_KINDS]
    assert found[0] == ("iban", "GB82 WEST 1234 5698 7654 32", 1.0)
    assert [f[1] for f in found[1:]] == ["123-45-6789", "223-45-6789"]
    assert [k for k, *_ in pii.spans_of("code 123-45-6789")] == []
    alone, named = pii.spans_of("x 10.0.0.1 y"), pii.spans_of("server 10.0.0.1 y")
    assert named[0][3] > alone[0][3]


def test_hard_documents(spark):
    found = pii.find(documents(spark, clash=True)).collect()
    assert len(found) == len(hard_rows())
    assert pii.find(documents(spark, [])).count() == 0
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "ü a@b.c 😀 +1 222 333 4444", "en", "s", 1)]
    masked = pii.mask(documents(spark, rows, clash=True))
    assert masked.columns == documents(spark, rows, clash=True).columns
    assert {r.doc_id: r.text for r in masked.collect()} == {1: None, 2: "", 3: "ü [email] 😀 [phone]"}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op8_pii(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        want = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.BASE_KINDS]


def account(country, n, rng):
    """A valid account number of a country."""
    body = "".join(rng.choice("0123456789" if rng.random() < 0.8 else "ABCXYZ") for _ in range(n - 4))
    rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def test_every_account_is_found():
    found = lambda text: [text[s:e] for k, s, e in pii.proposed(text) if k == "iban"]
    two = "BE68 5390 0754 7034 BE71 0961 2345 6769"
    assert found(two) == [two[:19], two[20:]]
    assert found("REF AB12 CDEF GH34 BE68 5390 0754 7034") == ["BE68 5390 0754 7034"]
    assert found("iban TR33 0006 1005 1978 6457 8413 26.") == ["TR33 0006 1005 1978 6457 8413 26"]
    assert found("BE68 5390 0754 7035") == found("xBE68539007547034") == found("BE685390075470341") == []


def test_accounts_against_brute_force():
    rng = random.Random(4)
    countries = sorted(pii.IBAN_LENGTHS)
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            own = account(c := rng.choice(countries), pii.IBAN_LENGTHS[c], rng)
            if rng.random() < 0.2:
                own = own[:-1] + rng.choice("0123456789AZ")
            if rng.random() < 0.5:
                own = " ".join(own[i : i + 4] for i in range(0, len(own), 4))
            parts += [own, rng.choice(["", "REF", "AB12", "x.", "7", "DE44 5001"])]
        text = rng.choice([" ", "", ", "]).join(parts)
        got = [(s, e) for k, s, e in pii.proposed(text) if k == "iban"]
        want, at = [], 0
        while at < len(text):
            end = next((e for e in range(at + 15, min(len(text), at + 42) + 1) if whole_account(text, at, e)), None)
            if end:
                want.append((at, end))
            at = end or at + 1
        assert got == want, text


def whole_account(text, start, end):
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    own = text[start:end]
    groups = own.split(" ")
    compact = "".join(groups)
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", compact) or len(compact) != pii.IBAN_LENGTHS.get(compact[:2]):
        return False
    cuts = list(itertools.accumulate(map(len, groups)))[:-1]
    return all(c % 4 == 0 and g for c, g in zip(cuts, groups)) and pii.mod_97(compact)
