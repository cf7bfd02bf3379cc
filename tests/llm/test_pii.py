import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="a1.@-+ ()%49é", max_size=60))
def test_base_spans_match_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_parts_of_an_address_may_begin_with_any_number_of_zeros():
    text = "1.2.3." + "0" * 9000 + "1 and 0.00.000.255 and 0256.1.1.1"
    assert [x[0] for x in pii.base_spans(text) if x[0] == "ip"] == ["ip", "ip"] and pii.base_spans(text)[0][1:] == (0, 9007)


def test_base_spans_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute(r.text or "") for r in rows}
    assert sum(map(len, want.values())) > 50
    got = pii.pii_spans(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for r in got:
        base = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_precision_and_recall_of_added_spans_on_sentences_held_out():
    import random

    rng, scorer = random.Random(99), pii.model()
    right = wrong = missed = 0
    for _ in range(1500):
        text, kind, start, end = pii.sample(rng)
        base, every = pii.find(text, scorer)
        added = [s for s in every if s not in base]
        hit = [s for s in every if s[0] == kind and s[1] < end and start < s[2]]
        right += bool(hit)
        missed += kind is not None and not hit
        wrong += sum(s not in hit for s in added)
    assert right / (right + missed) > 0.85 and right / (right + wrong) > 0.9


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@", "1" * 1_000_000, "a.b-" * 250_000 + "at x", "@" * 1_000_000, "1.1." * 250_000 + "x", "+1 " * 300_000, "a@b" * 300_000, "4 1-" * 250_000])
def test_a_long_text_is_read_once(text):
    pii.find("warm 10.0.0.1", pii.model())
    began = time.perf_counter()
    pii.base_spans(text), pii.candidates(text)
    assert time.perf_counter() - began < 6


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de or +49 30 1234567, from 10.0.0.1", "x"), (3, "mail a.b@c.de or +49 30 1234567, from 10.0.0.1", "x"), (None, "é 4111 1111 1111 1111", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.pii_spans(df).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(0, 0, 0, 1, 0), (1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 1, 1, 0, 1), (3, 1, 1, 0, 1)]
    assert pii.pii_spans(df.limit(0)).count() == 0
    texts = sorted((r.doc_id or 0, r.text) for r in pii.redacted(df.where("doc_id is null or doc_id <> 1")).collect())
    assert texts == [(0, "é [CARD]"), (2, ""), (3, "mail [EMAIL] or [PHONE], from [IP]"), (3, "mail [EMAIL] or [PHONE], from [IP]")]
    assert pii.redacted(df.where("doc_id = 1")).first().text is None and pii.redacted(df.limit(0)).columns == df.columns
