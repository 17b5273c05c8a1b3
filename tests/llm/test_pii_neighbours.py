"""Values side by side: each is replaced, and as it would be alone."""

import pytest

from sheaf.llm import pii as P

F = P.Feistel(b"k")


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+44 20 7946 0958"])
@pytest.mark.parametrize("next_,kind", [("190.137.223.204", "ip"), ("123-45-6789", "ssn"), ("2021-03-04", "date"), ("4111 1111 1111 1111", "card"), ("12 apples", None)])
def test_a_phone_ends_before_what_follows(phone, next_, kind):
    alone = P.pseudonymise(phone, F)[0]
    after = P.pseudonymise(next_, F)[0]
    got, counts = P.pseudonymise(f"{phone} {next_}", F)
    assert got == f"{alone} {after}" and counts == {"phone": 1} | ({kind: 1} if kind else {})
    assert P.pseudonymise(got, F, back=True)[0] == f"{phone} {next_}"


@pytest.mark.parametrize("text", ["2021-03-04T10:00", "2021-03-04T10:00:00Z"])
def test_dates_of_timestamps(text):
    got, counts = P.pseudonymise(text, F)
    assert counts == {"date": 1} and got[10:] == text[10:] and got[:10] == P.pseudonymise(text[:10], F)[0]


def test_a_card_before_another_number():
    got, counts = P.pseudonymise("4111 1111 1111 1111 77", F)
    assert counts == {"card": 1} and got == P.pseudonymise("4111 1111 1111 1111", F)[0] + " 77"


CARD, BELGIAN = "4111 1111 1111 1111", "BE68 5390 0754 7034"


@pytest.mark.parametrize("before,value,after,kind", [
    ("", CARD, " 12/27", "card"), ("", CARD, " 123", "card"), ("1 ", CARD, "", "card"), ("5 ", CARD, " 9", "card"), ("", BELGIAN, " PAID", "iban"), ("", "ES91 2100 0418 4502 0005 1332", " END", "iban"),
    ("", BELGIAN, " 1234", "iban"), ("call ", "(555) 223-4567", " now", "phone"), ("", "+1 555 123 4567", " 2024", "phone"), ("from ", "2a00:1450:4001:81b::200e", ".", "ip"), ("", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "", "ip"),
])
def test_values_among_others(before, value, after, kind):
    alone = P.pseudonymise(value, F)[0]
    got, counts = P.pseudonymise(before + value + after, F)
    assert alone != value and got == before + alone + after and counts == {kind: 1}
    assert P.pseudonymise(got, F, back=True)[0] == before + value + after


@pytest.mark.parametrize("text", ["10:20:30", "::1", "fe80::1", "std::vector", "a::b", "12:34:56:78", "555-1234", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"])
def test_what_only_looks_like_an_address_stays(text):
    assert P.pseudonymise(text, F) == (text, {})


def test_equal_dates_link_in_every_format():
    forms = lambda d, m, y: [f"{d:02d}.{m:02d}.{y}", f"{d}.{m}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}"] + ([f"{m:02d}/{d:02d}/{y}"] if d > 12 else [])
    for d, m, y in [(5, 1, 2020), (25, 1, 2020), (5, 11, 1999), (12, 12, 1985), (31, 10, 2001)]:
        new = [P.pseudonymise(x, F)[0] for x in forms(d, m, y)]
        yy, mm, dd = map(int, new[2].split("-"))
        assert new == forms(dd, mm, yy) and (dd, mm, yy) != (d, m, y)
        assert [P.pseudonymise(x, F, back=True)[0] for x in new] == forms(d, m, y)


def test_national_and_international_numbers_link():
    local, world = (P.pseudonymise(x, F)[0] for x in ("(555) 223-4567", "+1 (555) 223-4567"))
    assert world == "+1 " + local
