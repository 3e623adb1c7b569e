"""Keyword-stuffed pages and link lists, by rank-frequency curves and divergence from prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.session import cut, spread, stored

_WIDE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_LETTER = rf"[^\W\d_{_WIDE}]"
#: Words; of scripts without blanks single characters.
WORD = re.compile(rf"[{_WIDE}]|{_LETTER}+(?:['’-]{_LETTER}+)*")
#: Encoded data, which has no words.
NOISE = re.compile(r"[A-Za-z0-9+/=]{40,}")
BLANK_LINES = re.compile(r"\n[ \t]*\n\s*")
# Lines of the lists that belong to a software project's work.
WORK_LINES = [
    r"\s*[\w.-]+\s*(==|>=|<=|~=|\^|@)\s*v?\d", r"\s*\S{0,3}\d{4}-\d\d-\d\d[T ]\d\d:\d\d", r"\s*at [\w.$<>]+\(",
    r"\s*[-*+]\s.*\(#\d+\)\s*$", r"\s*\|.*\|\s*$", r"\s*test\w*.*\.\.\.", r"\s*[+-]?\s*[\w.\[\]]+\s*[+-]?=\s",
    r"\s*(def|if|for|return|yield|while|class|import|from|func|fn|var|let|const|try|else|self)\b", r"[+-]\s{2,}", r"\s*\w+\([\w, *&:=]*\)\s*[:;{-]",
    r"\S+\.(tar\.gz|whl|zip|sig|jar|exe|deb|rpm|dmg|gem|tgz)\b", r"(Files of|diff --|Traceback|Depends on|index [0-9a-f]|@@ )",
    r"\s*[\w.-]+(/[\w.-]+)+\.\w{1,5}(:\d+)?\s*$", r"\s{4,}\S",
    r"\s*[*+-]\s*\[[^\]]+\]\([^)\s]+\)\s+[-–—:]\s+\S+.*[.?!。]\s*$",
]
# Such places within a line, by a sign that the line must have.
WORK_PLACES = {"(": r"\(\s*[<>=~]+\s*v?\d[\w.]*\s*\)", "|": r"\|\s+\d+\s+[+-]+\s*$", "": r"[A-Za-z0-9+/=]{60,}"}
_LINE = re.compile("|".join(f"(?:{p})" for p in WORK_LINES), re.A)
_PLACES = [(sign, re.compile(p, re.A)) for sign, p in WORK_PLACES.items()]

#: A word is part of a language's model if it makes up this share of its sections' words: at most 1 / share words.
WORD_SHARE = 5e-5
#: Models of so many words and less are broadcast; larger ones are joined by a shuffle.
BROADCAST_WORDS = 400_000
#: Natural logarithm of the probability of a word in no model.
UNKNOWN = -11.5
#: Sections of fewer words have no curve; neighbours that are so short are judged together.
LEAST_WORDS = 12
#: Share of words known in a language from which a text that declares none is in it.
SPOKEN = 0.15
#: Robust deviations from prose of the language and length: of divergence alone; of divergence where the curve is steep; of the slope.
FAR, RATHER_FAR, STEEP = 11.0, 8.0, -3.0
#: Such deviations of the curve alone: of a slope flatter and steeper than any prose, and of the residual.
FLATTEST, STEEPEST, UNEVEN = 4.5, -8.0, 6.0
#: Sections of a language and length that make a yardstick.
LEAST_PROSE = 30
#: The greatest power of two in a number of words, as an array has at most 2 ** 31 entries.
TOP_BIN = 31
#: The least spread that such a deviation is measured in.
LEAST_SPREAD = 0.12



def is_work(line: str) -> bool:
    return bool(_LINE.match(line)) or any(sign in line and p.search(line) for sign, p in _PLACES)


def page_sections(text: str) -> list[tuple[int, float, Counter]]:
    """(chars, work, words) of the parts of a text between blank lines.

    Neighbours of less than LEAST_WORDS words each are one part, so that lists with blank lines between their
    entries are judged like others. work is the share of the characters in lines that belong to a project's lists.
    """
    parts: list[tuple[list[str], Counter]] = []
    short = False
    for block in BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        if not block.strip(" \t\r\n"):
            continue
        words = Counter(WORD.findall(NOISE.sub(" ", block.lower())))
        few = words.total() < LEAST_WORDS
        if few and short:
            parts[-1][0].append(block)
            parts[-1][1].update(words)
        else:
            parts.append(([block], words))
        short = few
    out = []
    for blocks, words in parts:
        lines = [x for b in blocks for x in b.split("\n") if x]
        work = sum(len(x) for x in lines if is_work(x)) / max(1, sum(map(len, lines)))
        out.append((sum(map(len, blocks)), work, words))
    return out


def sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, section, chars, work, words, word, n, times, many) of all sections of all texts; null texts have none.

    word and n are the different words in alphabetical order and how often each occurs; times and many say how many
    words occur how often, the most frequent first.
    """
    fields = ["section int", "chars int", "work double", "words int", "word array<string>", "n array<int>", "times array<int>", "many array<int>"]
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, lang string, " + ", ".join(fields)
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text")):
                for place, (chars, work, words) in enumerate(page_sections(text.as_py())):
                    ordered = sorted(words)
                    spectrum = sorted(Counter(words.values()).items(), reverse=True)
                    rows.append((place, chars, work, words.total(), ordered, [words[w] for w in ordered], [t for t, _ in spectrum], [m for _, m in spectrum]))
                    at.append(i)
            if rows:
                given = batch.select([key, "lang"]).take(pa.array(at))
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*given.columns, *made], names=[key, "lang", *[f.split()[0] for f in fields]])

    lang = F.lower(F.btrim("lang", F.lit(" ")))
    asked = documents.where(F.col("text").isNotNull()).select(key, F.when(~lang.isin("", "und"), lang).alias("lang"), "text")
    return spread(asked).mapInArrow(run, schema)


def language_models(parts: DataFrame) -> DataFrame:
    """(word, models) with an array of (language, p, q) per word: how much more likely it is in a language than an unknown
    word, as a difference of logarithms, with and without one section.

    A word's probability is in how many sections of a language it occurs, as a share of the sum of these numbers,
    so a page that repeats itself does not shape its own yardstick. Copies of a section (same words, whatever their
    order) count once, so that a page stored many times does not shape it either: leaving out one leaves out all of
    them. Any declared language with LEAST_PROSE different sections has a model.
    """
    once = parts.where("lang is not null").groupBy(F.col("lang").alias("language"), "copy").agg(F.first("word").alias("word"))
    counted = cut(once.select("language", F.explode("word").alias("word")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("c")))
    enough = parts.where("lang is not null").groupBy(F.col("lang").alias("language")).agg(F.count_distinct("copy").alias("k")).where(F.col("k") >= LEAST_PROSE).select("language")
    totals = counted.groupBy("language").agg(F.sum("c").alias("total")).join(enough, "language")
    gain = lambda c: F.when(c > 0, F.greatest(F.log(c / F.col("total")) - UNKNOWN, F.lit(0.0))).otherwise(F.lit(0.0))
    known = counted.join(totals, "language").where(F.col("c") >= F.col("total") * WORD_SHARE)
    return known.groupBy("word").agg(F.collect_list(F.struct("language", gain(F.col("c")).alias("p"), gain(F.col("c") - 1).alias("q"))).alias("models"))


def section_curves(parts: DataFrame, key: str) -> DataFrame:
    """Per section: slope and residual of ln frequency over ln rank, by a window over its frequencies.

    Words of one frequency have neighbouring ranks, so one row for each frequency, not each word, is ordered: the sums
    of a regression over the ranks after + 1 to after + many.
    """
    rows = parts.select(key, "section", F.posexplode(F.arrays_zip("times", "many")).alias("at", "f")).select(key, "section", "at", "f.times", "f.many")
    before = Window.partitionBy(key, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranks = F.transform(F.sequence(F.col("after") + 1, F.col("after") + F.col("many")), lambda r: F.log(r.cast("double")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    ranked = rows.withColumn("after", F.coalesce(F.sum("many").over(before), F.lit(0))).withColumn("lr", ranks)
    y = F.log(F.col("times").cast("double"))
    sums = ranked.select(key, "section", "many", y.alias("y"), total(F.col("lr"), lambda v: v).alias("x"), total(F.col("lr"), lambda v: v * v).alias("xx"))
    s = sums.groupBy(key, "section").agg(
        F.sum("many").alias("k"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum(F.col("many") * F.col("y")).alias("y"),
        F.sum(F.col("many") * F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"),
    )
    off = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("k")
    fitted = s.select(key, "section", F.col("k").alias("types"), off("x", "x", "xx").alias("sxx"), off("x", "y", "xy").alias("sxy"), off("y", "y", "yy").alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    left = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return fitted.select(key, "section", slope.alias("slope"), F.sqrt(left / F.col("types")).alias("residual"))


def section_languages(parts: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """(key, section, language, gain, known): the language that fits each section best, whatever is declared.

    gain is the sum over its words of how much more likely they are there than unknown ones, known the number of
    words in that model. In the language it is declared in, a section is left out of its own model, so that what only
    it says is unknown there. Sections without any known word have no row.
    """
    words = parts.select(key, "section", "lang", F.explode(F.arrays_zip("word", "n")).alias("w")).select(key, "section", "lang", "w.word", "w.n")
    small = models.count() <= BROADCAST_WORDS
    found = words.join(F.broadcast(models) if small else models, "word").select(key, "section", "lang", "n", F.explode("models").alias("m"))
    value = F.when(F.col("lang") == F.col("m.language"), F.col("m.q")).otherwise(F.col("m.p"))
    fits = found.groupBy(key, "section", F.col("m.language").alias("language")).agg(F.sum(F.col("n") * value).alias("gain"), F.sum("n").alias("known"))
    best = F.array_max(F.collect_list(F.struct("gain", "language", "known"))).alias("best")
    return fits.groupBy(key, "section").agg(best).select(key, "section", "best.language", "best.gain", "best.known")


def _yardsticks(prose: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    middle = prose.groupBy(*by).agg(F.count(F.lit(1)).alias("many"), *[F.percentile_approx(m, 0.5, 1000).alias(f"mid_{m}") for m in measures])
    off = prose.join(middle, by)
    widths = off.groupBy(*by).agg(
        *[F.greatest(F.percentile_approx(F.abs(F.col(m) - F.col(f"mid_{m}")), 0.5, 1000) * 1.4826, F.lit(LEAST_SPREAD)).alias(f"dev_{m}") for m in measures]
    )
    return middle.join(widths, by)


def _all_lengths(near: DataFrame, measures: list[str]) -> DataFrame:
    """The yardsticks `near` of (language, bin) for every bin: a bin without one takes the nearest shorter, else longer.

    trend_<measure> is the median itself where there is a yardstick, and elsewhere on the line through the medians
    of the language.
    """
    lines = near.groupBy("language").agg(*[f(m, "bin").alias(f"{k}_{m}") for m in measures for k, f in (("at", _intercept), ("by", _slope))])
    grid = lines.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(TOP_BIN)).cast("array<bigint>"))).join(near.withColumn("own", F.lit(True)), ["language", "bin"], "left")
    order = Window.partitionBy("language").orderBy("bin")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, True).over(order), F.first(c, True).over(after)).alias(c)
    line = lambda m: F.coalesce(F.when(F.col("own"), F.col(f"mid_{m}")).otherwise(F.col(f"at_{m}") + F.col(f"by_{m}") * F.col("bin")), fill(f"mid_{m}"))
    return grid.select("language", "bin", *[fill(f"{k}_{m}") for m in measures for k in ("mid", "dev")], *[line(m).alias(f"trend_{m}") for m in measures])


def _slope(m: str, by: str) -> Column:
    return F.regr_slope(F.col(f"mid_{m}"), F.col(by).cast("double"))


def _intercept(m: str, by: str) -> Column:
    return F.regr_intercept(F.col(f"mid_{m}"), F.col(by).cast("double"))


def deviations(scored: DataFrame) -> DataFrame:
    """Adds z_<measure>: how far a section lies from the median of its language and length, in robust spreads.

    Lengths are compared by powers of two. A length with less than LEAST_PROSE sections is measured by the nearest
    length that has them and by the line through the medians of all that have, whichever is nearer (0 between
    the two); a language without any such length is measured by all of its sections. Yardsticks come from sections
    that fit the language they are declared in and are no list of the work, copies counted once.
    """
    measures = ["slope", "residual", "divergence"]
    bins = scored.withColumn("bin", F.floor(F.log2(F.col("words").cast("double"))))
    once = ["language", "bin", "copy"]
    prose = bins.where("work < 0.5 and lang = language and divergence is not null").groupBy(*once).agg(*[F.min(m).alias(m) for m in measures])
    all_lengths = F.explode(F.array(F.col("bin"), F.lit(-1).cast("bigint"))).alias("bin")
    yards = cut(_yardsticks(cut(prose.select("language", all_lengths, *measures)), ["language", "bin"], measures))
    near = _all_lengths(yards.where((F.col("bin") >= 0) & (F.col("many") >= LEAST_PROSE)).drop("many"), measures)
    wide = yards.where("bin < 0").drop("many", "bin").withColumnsRenamed({f"{k}_{m}": f"all_{k}_{m}" for m in measures for k in ("mid", "dev")})
    joined = bins.join(near, ["language", "bin"], "left").join(wide, "language", "left")
    pick = lambda k, m: F.coalesce(f"{k}_{m}", f"all_{k}_{m}")

    def off(m: str) -> Column:
        a, b = F.col(m) - pick("mid", m), F.col(m) - F.coalesce(f"trend_{m}", f"all_mid_{m}")
        return F.when(a * b <= 0, F.lit(0.0)).otherwise(F.signum(a) * F.least(F.abs(a), F.abs(b))) / pick("dev", m)

    return joined.select(*bins.columns, *[off(m).alias(f"z_{m}") for m in measures])


def score_sections(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """All sections of at least LEAST_WORDS words with their measures, deviations and `work` share.

    Divergence is the mean of -ln p of a section's words in the language that fits it best. A text in a language
    without a model has none: one that declares such a language, or declares none and has less than SPOKEN of its
    words in any model. A declared language with a model is taken where no word is known.
    """
    models = cut(language_models(parts))
    spoken = models.select(F.explode("models.language").alias("lang")).distinct().withColumn("modelled", F.lit(True))
    long = parts.where(F.col("words") >= LEAST_WORDS)
    curves = section_curves(long, key)
    fits = section_languages(long, models, key)
    shapes = long.select(key, "section", "lang", "copy", "words", "chars", "work").join(curves, [key, "section"]).join(fits, [key, "section"], "left").join(spoken, "lang", "left")
    judged = F.when(F.col("lang").isNotNull(), F.coalesce("modelled", F.lit(False))).otherwise(F.coalesce(F.col("known") >= F.col("words") * SPOKEN, F.lit(False)))
    measured = shapes.withColumn("language", F.coalesce("language", "lang")).withColumn(
        "divergence", F.when(judged, -UNKNOWN - F.coalesce("gain", F.lit(0.0)) / F.col("words"))
    )
    return deviations(cut(measured.drop("modelled", "gain")))


def spam_sections(scored: DataFrame) -> Column:
    """Whether a section is keywords or links: far from prose by its words, by the slope or residual of its curve, or rather
    far by its words with a curve much steeper than prose has."""
    curve = (F.col("z_slope") >= FLATTEST) | (F.col("z_slope") <= STEEPEST) | (F.col("z_residual") >= UNEVEN)
    far = F.coalesce((F.col("z_divergence") >= FAR) | ((F.col("z_divergence") >= RATHER_FAR) & (F.col("z_slope") <= STEEP)), F.lit(False))
    return F.coalesce((curve | far) & (F.col("work") < 0.5), F.lit(False))


def read_sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sections, read and split once, each with a hash of its words as `copy`."""
    return stored(sections(documents, key).withColumn("copy", F.xxhash64("word", "n")))


def spam_pages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, share): documents more than half of whose text is keywords, links or product tags.

    Texts are judged section by section, where a section ends at a blank line, because a page may be partly
    prose; share is the part of the characters in sections found. Null, empty and blank texts, and texts without
    LEAST_WORDS words in a section, are never found. The declared language only helps to build the models. Repeated
    keys are one document. Whole texts are read, whatever their length. An empty table gives no rows.
    """
    parts = read_sections(documents, key)
    scored = score_sections(parts, key)
    bad = scored.where(spam_sections(scored)).groupBy(key).agg(F.sum("chars").alias("bad"))
    whole = parts.groupBy(key).agg(F.sum("chars").alias("chars"))
    return bad.join(whole, key).where("bad * 2 > chars").select(key, (F.col("bad") / F.col("chars")).alias("share"))
