import random

from pyspark.sql import functions as F

from lodestrata.llm import spampages as s

SUBJECTS = ["The reader", "A writer", "Every test", "The old cache", "This branch", "My first change", "The release", "Our server"]
VERBS = ["was slow because", "has to wait until", "should not fail when", "keeps a copy while", "is easier to follow if", "works again after"]
ENDS = ["the file is closed", "two of them start at once", "the list is empty", "nobody has looked at it", "the log says so", "we agree on a name"]
WARES = ["sofa", "mortgage", "espresso", "pillow", "vpn", "diet", "jacket", "drone", "plumber", "tyre"]


def prose(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}." for _ in range(n))


def frame(spark, extra):
    rng = random.Random(3)
    rows = [(i, "\n\n".join(prose(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 4))), "en") for i in range(600)]
    return spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string").withColumns({"section": F.lit("s"), "word": F.lit(1), "n": F.lit(2), "body": F.lit("b"), "chars": F.lit(0), "rank": F.lit(1)})


def spam(rng, kind):
    if kind == "links":
        return "\n".join(f"http://{rng.choice(WARES)}-{rng.choice(WARES)}{rng.randint(1, 99)}.invalid/{rng.choice(WARES)}" for _ in range(25))
    if kind == "tags":
        return " ".join(f"#{rng.choice(WARES)}{rng.choice(WARES)}" for _ in range(40))
    ware = " ".join(rng.sample(WARES, 2))
    return ", ".join(rng.choice([f"cheap {ware}", f"{ware} online", f"buy {ware}", ware]) for _ in range(40))


def test_pages(spark):
    rng = random.Random(9)
    bad = {1000 + i: spam(rng, k) for i, k in enumerate(["links", "tags", "keys"])}
    bad[1100] = prose(rng, 1) + "\r\n\r\n" + spam(rng, "keys") + "\r\n\r\n" + spam(rng, "links")
    bad[1101] = "x " + spam(rng, "keys").upper() + "\n" + "".join(spam(rng, "links") for _ in range(120))
    good = {
        2000: None, 2001: "", 2002: " \n\n\t", 2003: "short", 2004: prose(rng, 20) + "\n\n" + spam(rng, "keys")[:150], 2005: "\n".join(f"picolib{i}==1.{i}.0" for i in range(30)),
        2006: "\n".join(f"- change the {w} of it (#{i})" for i, w in enumerate(WARES * 3)), 2007: "\n".join(f"2024-01-0{i % 9 + 1}T10:00:00 INFO {w} took {i}ms" for i, w in enumerate(WARES * 3)),
        2008: "A" * 90_000, 2009: prose(rng, 900), 2010: "\n".join(f"| {w} | {i} | yes |" for i, w in enumerate(WARES * 3)),
    }
    rows = [(k, v, rng.choice(["en", None, "und", "EN"])) for k, v in {**bad, **good}.items()]
    got = s.spam_pages(frame(spark, rows))
    assert {r.doc_id for r in got.collect()} == set(bad)
    assert got.agg(F.min("share")).first()[0] > 0.5


def parts_of(spark, rows):
    return s.read_sections(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_curves_against_definition(spark):
    import numpy as np

    words = ["a"] * 8 + ["b"] * 4 + ["c"] * 2 + ["d"] * 2 + ["e"]
    row = s.section_curves(parts_of(spark, [(1, " ".join(words), "en"), (2, "x", None), (3, "y y", None)]), "doc_id").where("doc_id = 1").first()
    f = np.log([8, 4, 2, 2, 1])
    r = np.log(np.arange(1, 6))
    k, a = np.polyfit(r, f, 1)
    assert abs(row.slope - k) < 1e-9 and abs(row.residual - np.sqrt(np.mean((f - a - k * r) ** 2))) < 1e-9


def test_sections_of_a_page():
    text = prose(random.Random(1), 4) + "\n\n\n" + "\n \n".join(["sofa", "red sofa", "sofa now"]) + "\r\n\r\n" + prose(random.Random(2), 5) + "\n\nend"
    parts = s.page_sections(text)
    assert [sum(w.values()) < s.LEAST_WORDS for _, _, w in parts] == [False, True, False, True]
    assert parts[1][2] == {"sofa": 3, "red": 1, "now": 1} and parts[1][0] == len("sofared sofasofa now")
    assert s.page_sections("") == s.page_sections(" \r\n\n\t ") == []


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert s.spam_pages(none).collect() == []
    assert s.spam_pages(spark.createDataFrame([(1, None, None), (2, "", "en")], none.schema)).collect() == []
    assert s.spam_pages(spark.createDataFrame([(1, "a b c " * 20, None)], none.schema)).collect() == []


def test_copies_teach_nothing(spark):
    """A spam page stored 3,000 times, with other digits, case and order, is as far from prose as one stored once."""
    rng = random.Random(5)
    page = [f"{a} {b} {rng.choice(WARES)}" for a in WARES for b in ("sale", "online", "bargain", "deal")]
    copies = []
    for i in range(3000):
        rng.shuffle(page)
        copies.append((5000 + i, ", ".join(x.upper() if i % 2 else x for x in page) + f" {i}", "en"))
    got = s.spam_pages(frame(spark, copies))
    assert {r.doc_id for r in got.collect()} == {r[0] for r in copies}


def test_copies_count_once(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAST_PROSE", 1)
    parts = parts_of(spark, [(1, "a b c", "en"), (2, "B a, c 7", "en"), (3, "a d", "en"), (4, "a b c", "de")])
    p = {r.word: round(2.718281828459045 ** (m.p + s.UNKNOWN), 6) for r in s.language_models(parts).collect() for m in r.models if m.language == "en"}
    assert p == {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}


def test_lists_with_blank_lines_are_found(spark):
    rng = random.Random(4)
    pages = {4000 + i: spam(rng, k) for i, k in enumerate(["links", "tags", "keys"] * 4)}
    rows = [(k, v.replace("\n", "\n\n").replace(", ", "\n\n").replace(" #", "\n\n#"), "en") for k, v in pages.items()]
    assert {r.doc_id for r in s.spam_pages(frame(spark, rows)).collect()} == set(pages)


FOREIGN = ["der leser wartet auf die datei", "ein test war langsam weil", "die liste ist leer und", "niemand hat es gesehen", "das protokoll sagt es so", "wir einigen uns auf den namen"]


def test_languages_without_a_model(spark):
    """Prose in a language that too few sections are in, declared or not, is not far from prose: it has no divergence."""
    rng = random.Random(6)
    rows = [(6000 + i, ", ".join(rng.choice(FOREIGN) for _ in range(12)), "de" if i % 2 else None) for i in range(20)]
    keys = [(6100, ", ".join(rng.choice(["cheap sofa", "sofa online", "buy sofa"]) for _ in range(60)), "en")]
    parts = s.read_sections(frame(spark, rows + keys))
    scored = s.score_sections(parts).where("doc_id >= 6000 and doc_id < 6100")
    assert scored.count() == 20 and scored.where("divergence is not null").count() == 0
    assert {r.doc_id for r in s.spam_pages(frame(spark, rows + keys)).collect()} == {6100}


def test_many_languages(spark):
    """No number of languages is too large: the least frequent of twenty keeps its prose and shows its spam."""
    rng = random.Random(7)
    rows = []
    for k in range(20):
        alphabet = rng.sample("abcdefghijklmnopqrstuvwxyz", 12)
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(300)]
        rows += [(10_000 + 100 * k + i, " ".join(words[int(300 * rng.random() ** 2)] for _ in range(60)), f"x{k:02d}") for i in range(40 + k)]
    rows.append((50_000, ", ".join(rng.choice(["qqwk zzpf", "zzpf vvxw", "kkqz qqwk"]) for _ in range(40)), "x00"))
    assert {r.doc_id for r in s.spam_pages(frame(spark, rows)).collect()} == {50_000}


def test_curves_alone_are_found(spark):
    """Words of the language in no sentences: equal repeats are too flat, one word again and again too steep."""
    rng = random.Random(8)
    flat = "the file is slow " * 75
    steep = " ".join(["first"] * 150 + ["release"] * 30 + ["the"] * 6)
    rows = [(7000, flat, "en"), (7001, steep, "en"), (7002, prose(rng, 2000), "en"), (7003, prose(rng, 40), "en")]
    assert {r.doc_id for r in s.spam_pages(frame(spark, rows)).collect()} == {7000, 7001}
