from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import names as n

PEOPLE = {
    "wl": [
        ("William Larkspurton", "wlarkspurton@hallmere.example"), ("Larkspurton, William", "wlarkspurton+git@hallmere.example"), ("Bill Larkspurton", "oldpanel7@freepost.example"),
        ("W. Larkspurton", "wlarkspurton@build07.hallmere.test"), ("wlarkspurton", None), ("William Larkspurtno", "dev@hallmere.example"), ("WILLIAM LARKSPURTON", None), ("wxl", "wlarkspurton@hallmere.example"),
        ("Dr. William Larkspurton via mailgate", "builds@hallmere.example"), ("  William   Larkspurton ", None), ("William", "1234+wlarkspurton@users.noreply.forge.example"),
    ],
    "fl": [("Frances Larkspurton", "frances_larkspurton@hallmere.example"), ("F Larkspurton", "FRANCES.LARKSPURTON@HALLMERE.EXAMPLE")],
    "zo": [("Zoé Ødegårdsen", "zoe@other.example"), ("ZoÃ© Ã˜degÃ¥rdsen", "odegardsen.z@other.example"), ("Zoe Odegardsen", None)],
    "ha": [("Hana Petrovaskaya", "hpetrovaskaya@one.example"), ("Hana Petrovskaya", None)],
    "bo": [("deploybot", "deploybot@bots.example")],
    "em": [("", "nobody@nowhere.example")],
}
COMMITS = "author string, email string"
NICKS = [("William", "Bill"), ("William", "Will"), (None, "X"), ("Robert", None)]


def sig(author, email):
    return f"{author} <{email or ''}>"


def link(spark, people, nicks=NICKS):
    rows = [s for group in people.values() for s in group]
    commits = spark.createDataFrame(rows * 2 + [(None, "x@y.example"), (None, None)], COMMITS).withColumns({"sig": F.lit(1), "box": F.lit("b"), "node": F.lit("n"), "person": F.lit("p")})
    return n.link_people(commits, spark.createDataFrame(nicks, "name string, short_form string"))


def test_people_are_linked(spark):
    people = link(spark, PEOPLE)
    got = {(r.sig_a, r.sig_b) for r in n.signature_pairs(people).collect()}
    want = {tuple(sorted(p)) for group in PEOPLE.values() for p in combinations({sig(*s) for s in group}, 2)}
    assert got == want
    assert people.count() == len({sig(*s) for group in PEOPLE.values() for s in group})


def test_empty(spark):
    none = spark.createDataFrame([], COMMITS)
    assert n.signature_pairs(n.link_people(none, spark.createDataFrame([], "name string, short_form string"))).collect() == []


def test_shared_mailbox_links_nobody(spark):
    group = [("Ada Bellweather", "press@x.example"), ("Ruth Cormorant", "press@x.example"), ("Ian Dunmorrow", "press@x.example"), ("Ola Eskilstone", "press@x.example")]
    assert n.signature_pairs(link(spark, {str(i): [g] for i, g in enumerate(group)})).collect() == []


def test_ambiguous_parts_stay_alone(spark):
    people = {"a": [("Harold Makesidge", "harold@x.example")], "b": [("Hugo Makesidge", "hugo@x.example")], "c": [("H. Makesidge", None)]}
    assert n.signature_pairs(link(spark, people)).collect() == []


def test_long_and_odd_signatures(spark):
    people = {"a": [("x" * 50_000, "y" * 20_000 + "@z")], "b": [("名前 苗字", "a@b@c")], "c": [("@", "@")], "d": [("​", "no-at-sign")]}
    assert link(spark, people).count() == 4


def test_parsing():
    assert n.name_tokens("Mokesun, Lucia T.") == ["lucia", "t", "mokesun"]
    assert n.name_tokens("Harold Beck (Oakhill) via gate") == ["harold", "beck"]
    assert n.repair("FadraninÃ³m") == "Fadraninóm" and n.fold("Kłodek") == "klodek"
    assert n.mailbox("J.Doe+git@ws-1.Corp.test") == ("j.doe", "corp", "ws-1.corp.test")
    assert n.mailbox("12+jdoe@users.noreply.forge.example")[:2] == ("jdoe", "noreply") and n.mailbox("x") is None


@pytest.mark.parametrize(("a", "b", "value"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("a", "a", 1.0), ("", "b", 0.0), ("ab", "cd", 0.0)])
def test_jaro_winkler(a, b, value):
    assert n.jaro_winkler(a, b) == pytest.approx(value, abs=1e-4)


def test_slips_and_codes():
    assert all(n.one_slip(*p) for p in [("abc", "abc"), ("abc", "acb"), ("abc", "abbc"), ("abc", "ab"), ("abc", "axc")])
    assert not any(n.one_slip(*p) for p in [("abc", "cba"), ("abc", "abcde"), ("abcd", "badc")])
    assert n.soundex("robert") == "r163" and n.soundex("rupert") == "r163" and n.soundex("tymczak") == "t522"


def test_slips_stay_slips_among_many_people(spark):
    """A misspelt given name beside 8 last names, of 64 that the right one has, links; two common names do not."""
    lasts = [a + b for a in ("brack", "dunmo", "fitzel", "gorsu", "hempi", "kelvo", "pindar", "tramle") for b in ("wold", "sey", "thwick", "queth", "burn", "nax", "lomi", "juvra")]
    people = {x: [(f"Harold {x}", None)] for x in lasts} | {f"m{x}": [(f"Jorun {x}", None)] for x in lasts[:20]} | {f"n{x}": [(f"Joran {x}", None)] for x in lasts[:20]}
    for x in lasts[::8]:
        people[x].append((f"Harlod {x}", None))
    got = {(r.sig_a, r.sig_b) for r in n.signature_pairs(link(spark, people)).collect()}
    assert got == {tuple(sorted((sig(f"Harold {x}", None), sig(f"Harlod {x}", None)))) for x in lasts[::8]}


def test_codes_lose_no_pair():
    """Words that could be accepted as spellings of each other share a block, whatever their length."""
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("abdeilmnort") for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 14]))) for _ in range(150)}
    for w in words:
        for i in range(len(w)):
            for v in (w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]):
                assert v == w or not v or not n.one_slip(w, v) or max(len(w), len(v)) > 12 or set(n._codes(w, False)) & set(n._codes(v, False))
        longer = w[:3] + "sound"
        same = n.soundex(w) == n.soundex(longer)
        assert not same or set(n._codes(w, True)) & set(n._codes(longer, True))
    assert not any(c[0] in "<>" for c in n._codes("makesidge", False))
