"""Names whose words are on no list: roles come from position, commas, initials and the corpus."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from folioscope.llm import parties

# Names that no list of the module has.
GIVEN = "gonzalo sebastian emiliano fabian ramiro joaquin lisandro facundo valeria florencia romina yamila agustin leandro matias celeste".split()
SURNAMES = "pereyra quiroga sosa medina villalba aguirre cabrera escalante figueroa godoy ibarra ledesma maidana navarro ocampo paez robledo saavedra toledo urquiza".split()


def test_the_names_are_off_the_lists():
    listed = set(parties.GIVEN) | set(parties._NICK) | set(parties._TRADE_WORDS)
    assert not listed & {*GIVEN, *SURNAMES}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Gonzalo Pereyra", "G. Pereyra", True), ("Sebastian Ruiz", "Seba Ruiz", True), ("Sebastian Ruiz", "Ruiz, Sebastian A.", True),
        ("Emiliano Fabián Ruiz", "Ruiz Emiliano F.", True), ("Gonzalo Sosa", "Sosa, Gonzalo", True), ("Gonzalo Ruiz", "Ramiro Ruiz", False),
        ("Gonzalo Ruiz", "Gonzalo Sosa", False), ("Gonzalo Fabián Ruiz", "Gonzalo Ramiro Ruiz", False), ("Mario Pereyra", "María Pereyra", False),
        ("Panadería El Sol SRL", "Panad. El Sol S.R.L.", True), ("Panadería El Sol SRL", "Carnicería El Sol SRL", False),
        ("Panadería El Sol", "Panaderia El Sol SRL", True), ("Gonzalo Pereyra", "Pereyra SRL", False), ("A. B. C.", "A B C", True),
    ],
)
def test_off_the_lists(a, b, same):
    assert (parties.decide(a, b, None, None) > 0) == same


def test_the_corpus_tells_roles_where_position_does_not():
    # By position alone, the first word is a given name.
    assert parties.parse_party("Navarro Leandro")[0].core == ("leandro",)
    assert parties.parse_party("Navarro Leandro", "leandro:g") == (parties.Party(False, ("leandro",), ("navarro",), "", "", ""),)


def spellings(rng: random.Random, first: str, second: str, last: str) -> set[str]:
    f, s, n = first.capitalize(), second.capitalize(), last.capitalize()
    k = rng.randrange(1, len(n) - 2)
    ways = [
        f"{f} {n}", f"{n}, {f}", f"{n}, {f} {s[0]}.", f"{f} {s} {n}", f"{n} {f} {s}", f"{f[0]}. {n}", f"{n} {f}", f"{first.upper()} {last.upper()}",
        f"{f[: 4 if len(f) > 6 else 3]} {n}", f"{f} {n[:k]}{n[k + 1]}{n[k]}{n[k + 2:]}", f"{f} {s[0]}. {n}",
    ]
    return set(rng.sample(ways, 5))


def test_names_off_the_lists_are_linked(spark):
    rng = random.Random(11)
    truth, names = set(), defaultdict(set)
    for case in "abcdefgh":
        for last in SURNAMES:
            first, second = rng.sample(GIVEN, 2)
            party = spellings(rng, first, second, last)
            names[case] |= party
            truth |= {(case, x, y) for x, y in itertools.combinations(sorted(party), 2)}
    rows = [(c, n, None) for c, all_names in names.items() for n in all_names]
    got = {tuple(r) for r in parties.link_parties(spark.createDataFrame(rows, "case_id string, name string, number string")).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.95 * len(got)


def test_links_are_transitive_but_for_refuted_pairs(spark, rows):
    # Neighbours are one edit apart, the ends are not.
    chain = ["Gonzalo Quirogamendi", "Gonzalo Quirogamenti", "Gonzalo Quiroxamenti", "Gonzalo Quiroxamentix", "Gonzalo Qiroxamentix"]
    apart = ["Ramiro Quirogamendi", "Ramiro Quiroxamentix"]
    df = spark.createDataFrame([("c", n, None) for n in chain + apart], "case_id string, name string, number string")
    got = rows(parties.link_parties(df))
    assert {("c", x, y) for x, y in itertools.combinations(sorted(chain), 2)} <= set(got)
    assert not any(("Ramiro" in x) != ("Ramiro" in y) for _, x, y in got)


def test_names_of_letters_and_of_one_word_meet(spark, rows):
    df = spark.createDataFrame([("c", "A. B. C.", None), ("c", "A B C", None), ("c", "Sosa", None), ("c", "Gonzalo Sosa", None)], "case_id string, name string, number string")
    assert rows(parties.link_parties(df)) == [("c", "A B C", "A. B. C."), ("c", "Gonzalo Sosa", "Sosa")]
