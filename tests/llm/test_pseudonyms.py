"""Operator 2: a permutation in each format, valid again, linked and reversible."""

import datetime
import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import pseudonyms as P

F = P.Feistel(b"k")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 26, 100, 731, 1000])
def test_permutation(n):
    got = [F.permute(x, n, "t") for x in range(n)]
    assert sorted(got) == list(range(n)) and [F.permute(y, n, "t", back=True) for y in got] == list(range(n))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**14 - 1), st.sampled_from(["", " ", "-"]))
def test_cards(x, sep):
    body = f"4{x:014d}"
    card = sep.join([(body + str(P.luhn(body)))[i : i + 4] for i in range(0, 16, 4)])
    new = P.pseudonym("card", card, F)
    bare = new.replace(" ", "").replace("-", "")
    assert len(new) == len(card) and int(bare[-1]) == P.luhn(bare[:-1]) and P.pseudonym("card", new, F, back=True) == card
    assert P.pseudonym("card", body + str((P.luhn(body) + 1) % 10), F) is None


@settings(max_examples=100, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), st.sampled_from(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"]))
def test_dates(day, form):
    new = P.pseudonym("date", day.strftime(form), F)
    datetime.datetime.strptime(new, form)
    assert P.pseudonym("date", new, F, back=True) == day.strftime(form)
    assert P.pseudonym("date", "2023-02-30", F) is None


@pytest.mark.parametrize(
    ("kind", "value"),
    [("phone", "+1 (988) 555-2485"), ("phone", "(212) 555-0000"), ("phone", "+49 30 1234567"), ("ip", "42.144.35.254"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "ahrk.19@mail1.example.com"), ("email", "A_b@x.org")],
)
def test_formats(kind, value):
    new = P.pseudonym(kind, value, F)
    same = [("9" if c.isdigit() else "a" if c.isalpha() else c) for c in value]
    if kind == "ip":
        ipaddress.ip_address(new)
    else:
        assert [("9" if c.isdigit() else "a" if c.isalpha() else c) for c in new] == same
    assert new != value and P.pseudonym(kind, new, F, back=True) == value


@settings(max_examples=150, deadline=None)
@given(st.integers(200, 999), st.integers(200, 999), st.integers(0, 9999))
def test_spellings_of_an_american_number(area, exchange, line):
    a, e, n = str(area), str(exchange), f"{line:04d}"
    spelt = [f"+1 ({a}) {e}-{n}", f"+1{a}{e}{n}", f"+1-{a}-{e}-{n}", f"+1 {a} {e} {n}", f"({a}) {e}-{n}", f"{a}-{e}-{n}", f"{a}.{e}.{n}"]
    p = P.Pseudonymizer(b"k")
    new = [p.text(x) for x in spelt]
    assert all(found and [c for c in t if not c.isdigit()] == [c for c in x if not c.isdigit()] for x, (t, found) in zip(spelt, new, strict=True))
    assert len({"".join(c for c in t if c.isdigit())[-10:] for t, _ in new}) == 1
    assert [P.pseudonym("phone", t, F, back=True) for t, _ in new] == spelt


@pytest.mark.parametrize("spelt", [["+49 30 1234567", "+49301234567", "+49 (30) 1234567", "+49 (0)30 1234567", "+49-30-123 45 67"], ["+44 20 7946 0958", "+442079460958"], ["+420 601 234 567", "+420601234567"], ["+7 495 123-45-67", "+74951234567"], ["+1 100 200 3000", "+11002003000"]])
def test_spellings_of_a_number(spelt):
    p = P.Pseudonymizer(b"k")
    new = [p.text(f"call {x}!")[0][5:-1] for x in spelt]
    assert new[0] != spelt[0] and len({"".join(c for c in t.replace("(0)", "") if c.isdigit()) for t in new}) == 1
    assert [P.pseudonym("phone", t, F, back=True) for t in new] == spelt
    assert new[0][:3] == spelt[0][:3] or new[0][:2] == spelt[0][:2]


@settings(max_examples=150, deadline=None)
@given(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)))
def test_spellings_of_a_date(day):
    y, m, d = day.year, day.month, day.day
    spelt = [f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{m:02d}/{d:02d}/{y}"] + ([f"{d}/{m}/{y}"] if d > 12 else [])
    new = [P.pseudonym("date", x, F) for x in spelt]
    assert [len(x) for x in new] == [len(x) for x in spelt] and [P.pseudonym("date", x, F, back=True) for x in new] == spelt
    want = datetime.date.fromisoformat(new[0])
    assert new[1] == f"{want.day}.{want.month}.{want.year}" and new[3] == f"{want.month}/{want.day}/{want.year}"
    if d > 12:
        assert new[-1] == f"{want.day}/{want.month}/{want.year}"


def test_names_of_addresses():
    p = P.Pseudonymizer(b"k")
    one, other = p.text("Anna.Berg7@X.org")[0], p.text("anna.berg7@X.org")[0]
    assert one.lower() == other.lower() != "anna.berg7@x.org" and one[0].isupper() and one[5].isupper() and one.endswith("@X.org")
    for x in ("müller@x.de", "иван@пример.рф", "MÜLLER-straße@x.de", "ann+tag@x.de"):
        new, found = p.text(x)
        assert len(found) == 1 and len(new) == len(x) and new.split("@")[0] != x.split("@")[0] and P.pseudonym("email", new, F, back=True) == x
    assert not set("ü") & set(p.text("müller@x.de")[0][:1])


def test_key(spark):
    assert P.key_of(spark) == P.key_of(spark) and len(P.key_of(spark)) == 32
    spark.conf.set(P.KEY_CONF, "secret")
    assert P.key_of(spark) == b"secret"
    spark.conf.unset(P.KEY_CONF)


def test_text():
    p = P.Pseudonymizer(b"k")
    text = "Mail ab.1@x.org, +1 (988) 555-2485 or 4111111111111111; 4111111111111112, 999.1.1.1, 4.0. stay; ab.1@x.org"
    new, found = p.text(text)
    assert [k for k, *_ in found] == ["email", "phone", "card", "email"] and "4111111111111112, 999.1.1.1, 4.0. stay" in new
    assert "ab.1@" not in new and new.count(found[0][3]) == 2 and all(text[a:b] != v for _, a, b, v in found)


def test_frame(spark, odd, none):
    got = P.pseudonymize(odd, b"k", with_spans=True)
    assert got.columns == [*odd.columns, "_found", "_spans"] and {r["doc_id"]: r["text"] for r in got.collect()}[4] == {r["doc_id"]: r["text"] for r in odd.collect()}[4]
    assert P.pseudonymize(none, b"k").count() == 0
    clash = spark.createDataFrame([(1, "call (212) 555-0000", (3, 4), 5)], "doc_id long, text string, x struct<`a b`: int, `c-d`: int>, _found int")
    row = P.pseudonymize(clash, b"k").first()
    assert row["x"]["a b"] == 3 and row["_found"]["phone"] == 1


def test_planted_values_go(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old, new = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}, {r[0]: r[1] for r in P.pseudonymize(docs.select("doc_id", "text"), b"k").collect()}
    for pattern in (r"[a-z.0-9]+@[a-z0-9]+\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"):
        values = [(d, v) for d, t in old.items() for v in re.findall(pattern, t)]
        assert values and not [v for d, v in values if v in new[d]]
    assert len({d for d in old if old[d] != new[d]}) < len(old) / 5
