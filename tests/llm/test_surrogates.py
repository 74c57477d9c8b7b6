import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrerylake.llm import queries
from orrerylake.llm import surrogates as S

SF = "/root/testdata/sf0.01"
KEY = b"test"


@pytest.mark.parametrize("strings", [[f"{i:03d}" for i in range(1000)], [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], [chr(0x430 + i) + "-" + str(j) for i in range(32) for j in range(10)]])
def test_permute_is_one_to_one(strings):
    out = [S.permute(s, KEY, "t") for s in strings]
    assert len(set(out)) == len(strings)
    assert out != [S.permute(s, b"other", "t") for s in strings]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_permute_keeps_the_format(text):
    out = S.permute(text, KEY, "t")
    assert [S._alphabet(c) for c in out] == [S._alphabet(c) for c in text]
    assert all(a == b for a, b in zip(text, out, strict=True) if S._alphabet(a) is None)


def test_makers():
    good = "4539 1488 0343 6467"
    out = S.card(good, KEY)
    d = re.sub(r"\D", "", out)
    assert out[0] == "4" and S.luhn(d[:-1]) == int(d[-1]) and re.sub(r"\d", "9", out) == re.sub(r"\d", "9", good)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", S.phone("+1 (556) 555-9070", KEY))
    assert S._range_of(int(S.ipaddress.IPv4Address(S.ipv4("10.1.2.3", KEY)))) == "private"
    made = S.iban("DE89 3704 0044 0532 0130 00", KEY)
    moved = made.replace(" ", "")[4:] + made[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com", S.email("hnp.46@mail3.example.com", KEY))
    assert S.POOL[S.given("Anna", KEY)] == ("latin", "f") and S.POOL[S.given("Иван", KEY)] == ("cyrillic", "m")
    assert S.given("Zork", KEY) not in S.POOL
    for pool in S.GIVEN.values():
        assert sorted(S.given(n, KEY) for n in pool) == sorted(pool) and all(S.given(n, KEY) != n for n in pool)
    ips = [f"192.168.{i}.{j}" for i in range(8) for j in range(256)]
    assert len({S.ipv4(x, KEY) for x in ips}) == len(ips)


TEXT = "Mrs. Anna Kovač met Herr Schmidt; Anna Kovač wrote to a.k@mail1.example.com, A.K@mail1.example.com or +1 (612) 555-7038 from 63.39.35.251, card 4539148803436467, SSN 123-45-6789."


def test_types_gender_and_coreference():
    found = S.find(TEXT, KEY)
    assert [f.kind for f in found] == ["given", "family", "family", "given", "family", "email", "email", "phone", "ipv4", "card", "ssn"]
    assert found[0].surrogate == found[3].surrogate and found[1].surrogate == found[4].surrogate and found[5].surrogate == found[6].surrogate
    assert found[1].surrogate != found[2].surrogate and found[1].surrogate[0].isupper()


def test_phone_spacing_makes_no_new_entity():
    for spaced, plain in (("+1 555 123 4567", "+15551234567"), ("+353 86 123 4567", "+353861234567"), ("+49 (30) 1234567", "+49-30-1234567")):
        a, b = S.phone(spaced, KEY), S.phone(plain, KEY)
        assert S.canonical("phone", spaced) == S.canonical("phone", plain)
        assert re.sub(r"[^\d+]", "", a) == re.sub(r"[^\d+]", "", b)
        assert re.sub(r"\d", "9", a) == re.sub(r"\d", "9", spaced)
    assert S.phone("+353861234567", KEY)[:4] == "+353" and S.phone("+15551234567", KEY)[:2] == "+1"


def test_names_beyond_the_list():
    text = "My name is Kwame Mensah. Ask Priya Natarajan <p.n@mail1.example.com>. Later Kwame Mensah met Herr Zbigniew Kowalski and Frau Zbigniew Nowak; Zbigniew Kowalski left."
    found = S.find(text, KEY)
    named = [(f.kind, text[f.start : f.stop]) for f in found if f.kind != "email"]
    assert named == [(k, w) for w2 in ("Kwame Mensah", "Priya Natarajan", "Kwame Mensah", "Zbigniew Kowalski", "Zbigniew Nowak", "Zbigniew Kowalski") for k, w in zip(("given", "family"), w2.split(), strict=True)]
    by_name = {}
    for f in found:
        by_name.setdefault(f.entity, set()).add(f.surrogate)
    assert all(len(x) == 1 for x in by_name.values())
    assert S.given("Zbigniew", KEY, "m").endswith("o") and S.given("Zbigniew", KEY, "f").endswith("a")
    assert S.given("Olesya", KEY).endswith("a") and S.given("Ярополк", KEY, "m").endswith("й")
    names = [a + b + c for a in "BCDFG" for b in "aeiou" for c in ("n", "na", "no", "nan")]
    for g in "mf":
        assert len({S.given(n, KEY, g) for n in names}) == len(names)
    assert not {S.given(n, KEY, "m") for n in names} & {S.given(n, KEY, "f") for n in names}


def test_many_entities_take_time_in_proportion():
    def took(n):
        text = " ".join(f"u{i}@mail1.example.com" for i in range(n))
        start = time.perf_counter()
        assert len(S.find(text, KEY, {})) == n
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 3 * took(8_000) + 0.2


CLEAN = ["On 2024-01-15 we counted 1234567 stars and 3.14159 of 12 in version 1.2.3.4.5", "a@b", "The 100 200 300", "f(x) = 10-20", "hash b14913389bbd8c5792", "Mr and Mrs", "x" * 100_000]


def test_clean_texts_stay():
    for text in CLEAN:
        assert S.find(text, KEY) == []


def test_query_leaves_no_personal_data(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    shape = re.compile(r"[\w.]+@[a-z]{4}\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|(?<!\w)4\d{15}(?!\w)")
    seen = 0
    for r in queries.op3_surrogates(spark, SF).collect():
        old, new = shape.findall(texts[r.doc_id]), shape.findall(r.text)
        assert len(old) == len(new) and not set(old) & set(new)
        assert r.n_entities >= len(old)
        if r.n_entities == 0:
            assert r.text == texts[r.doc_id]
        seen += len(old)
    assert seen > 50


def test_edge_cases_and_collisions(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, TEXT, "x"), (3, TEXT, "x"), (3, TEXT, "x"), (4, "w " * 60_000 + "a.k@mail1.example.com", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, surrogate string")
    out = S.checked(df, KEY)
    assert out.columns == df.columns
    got = [(r.doc_id, r.surrogate.text, len(r.surrogate.found)) for r in out.collect()]
    assert sorted((str(i), n) for i, _, n in got) == [("1", 0), ("2", 0), ("3", 11), ("3", 11), ("4", 1), ("None", 11)]
    assert {t for i, t, _ in got if i == 1} == {None} and {t for i, t, _ in got if i == 2} == {""}
    assert len({t for i, t, n in got if n == 11}) == 1
    assert S.collisions(out).count() == 0
    assert S.anonymize(df.limit(0), KEY).count() == 0
    clash = spark.createDataFrame([((None, [("email", 0, 1, "a", "s"), ("email", 0, 1, "b", "s"), ("email", 0, 1, "a", "s")]),)], f"surrogate struct<{S.REPLACED.replace('text ', 'text:', 1).replace('found ', 'found:')}>")
    assert [(r.surrogate, r.entities) for r in S.collisions(clash).collect()] == [("s", 2)]
    assert S.splits(out).count() == S.splits(clash).count() == 0
    torn = spark.createDataFrame([((None, [("email", 0, 1, "a", "s"), ("email", 0, 1, "a", "t")]),)], clash.schema)
    assert [(r.entity, r.surrogates) for r in S.splits(torn).collect()] == [("a", 2)]
