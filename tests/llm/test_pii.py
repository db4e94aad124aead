"""Personal data against the plain patterns; votes, reliabilities and masking."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from cohortloom.llm import pii
from tests.llm.plain import EDGE_TEXTS, base_spans, edge_docs, empty_docs


def noisy(seed):
    draw = random.Random(seed)
    pieces = [
        "a.b@c.de", "@x.y", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4539148803436467", "4539 1488 0343 6467", "+1 (559) 555-3817",
        "+", "-", " ", ".", "..", "(", ")", "é", "\n", "0", "12", "007", "+49 30 1234567", "mail", "_", "%", "a@b.c_d@e.f", "\x01", "😀",
    ]
    return "".join(draw.choice(pieces) for _ in range(draw.randint(1, 25)))


def report(docs):
    return pii.span_report(pii.with_spans(docs, pii.train_on_corpus(docs))).collect()


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [*EDGE_TEXTS, *[(100 + i, noisy(i)) for i in range(1500)]]
    texts = {}
    for i, text in rows:
        texts.setdefault(i, text)
    got = report(edge_docs(spark, rows))
    assert len(got) == len(rows)
    for row in got:
        base = base_spans(texts[row.doc_id])
        written = [f"{kind}:{a}:{b}" for kind, a, b in base]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest(), texts[row.doc_id]
        spans = row.spans.split(",") if row.spans else []
        assert set(written) <= set(spans)
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)
    assert report(empty_docs(spark)) == []


def test_cards_and_phones_that_run_together_are_added(spark):
    good = [(i, f"call us +1 (559) 555-38{i:02d} or pay 4539148803436467 today") for i in range(50)]
    text = "pay 4539148803436467 4539148803436467 now, call +1 (559) 555-3817 10.0.0.25 please"
    rows = {r.doc_id: r for r in report(edge_docs(spark, [*good, (99, text)]))}
    assert rows[99].n_card == rows[99].n_phone == 0
    found = {text[int(a) : int(b)] for _, a, b in (span.split(":") for span in rows[99].spans.split(","))}
    assert found == {"4539148803436467", "+1 (559) 555-3817", "10.0.0.25"}


@pytest.mark.parametrize("text", ["x" * 200_000, "1" * 100_000, "1 " * 50_000, "a@" + "b." * 50_000, "1.2.3.4 " * 3000, "+" * 50_000])
def test_long_runs_do_not_overflow(spark, text):
    row = report(edge_docs(spark, [(1, text)]))[0]
    base = base_spans(text) if not text.startswith(("x", "a@")) else []
    if text.startswith("a@"):
        base = [("email", 0, len(text) - 1)]
    assert row.n_ip == sum(s[0] == "ip" for s in base) and row.n_email == sum(s[0] == "email" for s in base)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 255, 256, 257, 1000):
        frame = spark.createDataFrame([([i % 7 for i in range(n)],)], "x array<int>")
        got = frame.select(pii.running_sums(F.col("x")).alias("s")).first().s
        assert got == [sum(i % 7 for i in range(k + 1)) for k in range(n)]


def test_reliabilities_tell_labelers_apart():
    draw = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = draw.random() < 0.3
        votes = sum((draw.random() < (p if truth else 1 - p)) << bit for bit, p in enumerate([0.95, 0.9, 0.85, 0.6, 0.9]))
        counts[votes] = counts.get(votes, 0) + 1
    posterior = pii.reliabilities(counts)
    assert posterior[31] > 0.99 and posterior[0] < 0.01
    assert posterior[0b10011] > 0.9 > 0.2 > posterior[0b01000]
    weights = pii.train_classifier(counts)
    assert weights[1] > weights[4]  # a reliable labeler weighs more


def test_masking(spark):
    docs = edge_docs(spark)
    found = pii.with_spans(docs, pii.train_on_corpus(docs))
    got = {r.doc_id: r.masked for r in found.select("doc_id", pii.masked_text(found).alias("masked")).collect()}
    texts = dict(EDGE_TEXTS)
    assert got[14].endswith("mail me: [EMAIL], [PHONE] 4539 1488 0343 6467 10.0.0.256 [IP]") or "[CARD]" in got[14]
    for i, masked in got.items():
        if not base_spans(texts[i]):
            assert masked == (texts[i] or "")
    assert not re.search(r"example\.com", got[14])


def test_main_path_is_native(spark):
    docs = edge_docs(spark)
    plan = pii.span_report(pii.with_spans(docs, pii.train_on_corpus(docs)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_planted_spans_are_added_and_clean_texts_left_alone(spark):
    draw = random.Random(5)
    words = "the garden at noon is quiet and a dot on page 12 shows that 300 of 4000 people look at maps".split()

    def prose():
        return " ".join(draw.choice(words) for _ in range(draw.randint(3, 9)))

    def luhn_completed(digits):
        total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return digits + str(-total % 10)

    def number(n, first="4"):
        return luhn_completed(first + "".join(draw.choice("0123456789") for _ in range(n - 1 - len(first))))

    def four(digits, sign):
        return sign.join(digits[i : i + 4] for i in range(0, 16, 4))

    def name():
        return draw.choice(["ann.lee", "j_smith", "kim42", "r-ortiz"])

    def octets():
        return [str(draw.randint(1, 255)) for _ in range(4)]

    makers = [
        ("email", "write to", lambda: f"{name()} at example dot com"),
        ("email", "mail:", lambda: f"{name()} [at] mail [dot] example [dot] org"),
        ("email", "contact", lambda: f"{name()}(at)example.net"),
        ("card", "card", lambda: four(number(16), draw.choice("._/"))),
        ("card", "paid by card", lambda: (lambda d: f"{d[:4]} {d[4:10]} {d[10:]}")(number(15, "37"))),
        ("ip", "from host", lambda: "[.]".join(octets())),
        ("ip", "server", lambda: "2001:db8:0:1:" + ":".join(f"{draw.randint(1, 65535):x}" for _ in range(4))),
        ("phone", "call", lambda: f"({draw.randint(201, 989)}) {draw.randint(212, 989)}-{draw.randint(1000, 9999)}"),
        ("phone", "phone", lambda: f"{draw.randint(212, 989)}-{draw.randint(212, 989)}-{draw.randint(1000, 9999)}"),
    ]
    plain = [
        ("email", lambda: f"{name()}@example.com"), ("ip", lambda: ".".join(octets())), ("card", lambda: number(16)),
        ("phone", lambda: f"+1 ({draw.randint(201, 989)}) {draw.randint(212, 989)}-{draw.randint(1000, 9999)}"),
    ]
    rows, planted = [], {}
    for i in range(1200):
        parts, want = [prose()], []
        if i % 3 == 0:
            kind, lead, make = makers[i // 3 % len(makers)]
            text = make()
            at = len(f"{parts[0]} {lead} ")
            want.append(f"{kind}:{at}:{at + len(text)}")
            parts += [lead, text]
        elif i % 3 == 1:
            kind, make = plain[i // 3 % len(plain)]
            parts += [f"{draw.choice(['our', 'new'])} {kind}", make()]
        rows.append((1000 + i, " ".join([*parts, prose()])))
        planted[1000 + i] = want
    got = {r.doc_id: [s for s in r.spans.split(",") if s] for r in report(edge_docs(spark, rows))}
    texts = dict(rows)
    base = {i: {f"{k}:{a}:{b}" for k, a, b in base_spans(text)} for i, text in texts.items()}
    wanted = {(i, s) for i, spans in planted.items() for s in spans}
    extra = {(i, s) for i, spans in got.items() for s in spans if s not in base[i]}
    assert len(wanted & extra) >= 0.9 * len(wanted), sorted(texts[i] for i, _ in wanted - extra)[:20]
    assert len(wanted & extra) >= 0.9 * len(extra), [(texts[i], s) for i, s in extra - wanted][:20]
    assert not [(texts[i], got[i]) for i in got if (i - 1000) % 3 == 2 and set(got[i]) - base[i]]
