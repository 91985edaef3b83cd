"""Personal data: base spans against the plain patterns, planted weak spans, reliabilities."""

import hashlib
import random
import re
import time

from seqbin.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            v = int(d) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text) if _passes(kind, m.group())]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a", "Bc", "@", "x.y", ".", "-", " ", "+1", "12", "4111111111111111", "255", "0.1.2.3", "+49 (30) 555-12345",
              "(", ")", "é", "_", "%", "1234 5678 9012 3452", "300.1.1.1", "\n", "7", "me@x.org", "+"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert personal.base_spans(text) == brute(text), text


def test_parts_of_any_length():
    zeros = "0" * 6000
    assert personal.base_spans(f"{zeros}1.2.3.{zeros}4") == [(0, personal.IP, 12007)]
    assert personal.base_spans(f"{'9' * 6000}.2.3.4") == []


def test_base_spans_are_linear_in_the_length():
    start = time.time()
    for piece in ("a", "1", "1.", "a@", "1 ", "+1 ", "x.y@", "(", "1-1 ", " at ", "a at b dot c "):
        text = piece * (400_000 // len(piece))
        personal.wide_spans(text, personal.base_spans(text))
    assert time.time() - start < 60


def test_wide_spans_meet_no_base_span_nor_each_other():
    rng = random.Random(4)
    pieces = ["call ", "555-123-4567", "4111 1111 1111 1112 ", "GB82 WEST 1234 5698 7654 32 ", "078-05-1120", "Dr. Anna Smith ",
              "me at x dot org ", "me@x.org ", "+1 202 555 0123 ", "a", ". ", "(202) 555-0199 "]
    for _ in range(2_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 10)))
        base = personal.base_spans(text)
        wide = personal.wide_spans(text, base)
        assert all(a[2] <= b[0] for a, b in zip(wide, wide[1:]))
        assert not any(w[0] < b[2] and b[0] < w[2] for w in wide for b in base)


def test_reliabilities_recover_who_can_be_trusted():
    rng = random.Random(8)
    counts = {}
    truth = {}
    for _ in range(40_000):
        y = rng.random() < 0.3
        cast = []
        for right in (0.95, 0.9, 0.85, 0.6, 0.8, 0.5):
            if rng.random() < 0.2:
                cast.append(personal.SILENT)
            else:
                cast.append(personal.FOR if (rng.random() < right) == y else personal.AGAINST)
        code = personal.vote_code(cast)
        counts[2, code] = counts.get((2, code), 0) + 1
        truth.setdefault(code, []).append(y)
    posterior = personal.estimate(counts)
    wrong = sum(sum((posterior[2, code] >= 0.5) != y for y in ys) for code, ys in truth.items())
    assert wrong / 40_000 < 0.06


def _planted():
    """Weak candidates that are personal data, and numbers of the same kinds that are not."""
    rng = random.Random(21)
    words = "the one under there that while some being many over".split()
    rows, true = [], {}
    for i in range(900):
        text = " ".join(rng.choices(words, k=12)) + " "
        kind = i % 9
        number = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        value = {
            0: ("call phone ", number), 1: ("order ", str(rng.randrange(10**8, 10**9))), 2: ("version ", "2024-05-17"),
            3: ("write to ", f"user{i} at mail dot org"), 4: ("", f"+1 202 555 {rng.randrange(1000, 9999)}"),
            5: ("serial ", "4" + "".join(rng.choices("0123456789", k=15))), 6: ("", f"user{i}@mail.com"),
            7: ("", "4111111111111111"), 8: ("ssn ", f"{rng.randrange(100, 600)}-12-{rng.randrange(1000, 9999)}"),
        }[kind]
        start = len(text) + len(value[0])
        rows.append((i, text + value[0] + value[1] + " " + " ".join(rng.choices(words, k=6))))
        if kind in (0, 3, 8):
            name = {0: "phone", 3: "email", 8: "identity"}[kind]
            true[i] = f"{name}:{start}:{start + len(value[1])}"
        elif kind in (1, 2, 5) and not (kind == 5 and personal.luhn(value[1])):
            true[i] = ""
    return rows, true


def test_planted_weak_candidates(spark):
    rows, true = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    wrong = [i for i, spans in true.items() if got[i] != spans]
    assert len(wrong) <= len(true) // 20, [(i, got[i], true[i]) for i in wrong[:9]]


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = personal.find_personal(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id] or "")
        named = [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(named) <= set(r.spans.split(","))


def test_nulls_long_texts_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, spans string, row int, base int, p double"
    nothing = hashlib.sha256(b"").hexdigest()
    long = "word " * 100_000 + "me@x.org"
    rows = [(None, "a@b.co"), (1, None), (2, ""), (3, "no data"), (4, "é 4111111111111111"), (4, "é 4111111111111111"), (5, long)]
    docs = spark.createDataFrame([r + ("x", 1, 1, 0.5) for r in rows], schema)
    got = sorted(((r.doc_id or -1, r.n_email + r.n_card, r.spans, r.base_sha256 == nothing) for r in personal.find_personal(docs).collect()))
    assert got == [(-1, 1, "email:0:6", False), (1, 0, "", True), (2, 0, "", True), (3, 0, "", True),
                   (4, 1, "card:2:18", False), (4, 1, "card:2:18", False), (5, 1, "email:500000:500008", False)]
    assert personal.find_personal(spark.createDataFrame([], schema)).collect() == []
    plain = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    assert [r.spans for r in personal.find_personal(plain).collect()] == [""]
