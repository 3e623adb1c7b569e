"""Variant spellings of people's names: linking the signatures of one person."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.operators.components import connected_components
from lodestrata.session import cut

# Mailboxes that belong to a task rather than a person, and providers of mailboxes to anybody.
ROLE_BOXES = [
    "admin", "all", "bot", "bots", "build", "builds", "builder", "ci", "contact", "deploy", "dev", "devel", "developers",
    "devops", "engineering", "git", "hello", "help", "hostmaster", "info", "it", "jenkins", "mail", "maintainers", "me",
    "no-reply", "nobody", "noreply", "office", "ops", "postmaster", "release", "releases", "root", "security", "support",
    "system", "team", "test", "user", "webmaster",
]
# Letters that do not fall apart into a base letter and a mark.
PLAIN = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d", "ħ": "h"}
# Titles and generations, which are no names.
TITLES = ["dr", "dipl", "eng", "ii", "iii", "ing", "jr", "md", "mr", "mrs", "ms", "msc", "phd", "prof", "sr"]
# The digits of the Soundex code.
SOUNDEX = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}

#: Jaro-Winkler similarity from which two spellings of a token may be one.
SIMILAR = 0.85
#: A token with so many partners is an established name rather than a slip.
ESTABLISHED = 5
#: However many it has, a token with at most this share of another's partners may be a slip of that one.
SLIP_SHARE = 0.2
#: A short form is learned when it stands for the same name under the mailboxes of so many people.
LEARNED_FROM = 3
#: A mailbox used under so many last names that differ at their beginning, and given names too, is shared.
SHARED_FROM = 3


def repair(text: str) -> str:
    """UTF-8 that was once read as a single-byte encoding."""
    for codec in ("cp1252", "latin-1"):
        try:
            return text.encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


def fold(text: str) -> str:
    """Lower-case base letters."""
    marks = unicodedata.normalize("NFKD", repair(text).lower())
    return "".join(PLAIN.get(c, c) for c in marks if not unicodedata.combining(c)).strip()


def name_tokens(author: str) -> list[str]:
    """Tokens of a name in the order given name first; what follows 'via' or stands in brackets is left out."""
    text = re.sub(r"\(.*?\)|\[.*?\]|<.*?>", " ", fold(author))
    text = re.sub(r"\s+(via|on behalf of|at)\s+.*$", "", text)
    if text.count(",") == 1:
        last, first = text.split(",")
        text = f"{first} {last}"
    found = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    return [t for t in found if t not in TITLES] or found


def mailbox(email: str | None) -> tuple[str, str, str] | None:
    """(local part, tag and number cut off; organisation; its domain) of an address.

    Hosts below a domain and the domain itself are one organisation. A forge's private addresses carry the login
    behind a number.
    """
    if not email or "@" not in email:
        return None
    local, _, host = fold(email).rpartition("@")
    labels = [x for x in host.split(".") if x]
    if not local or not labels:
        return None
    if "noreply" in labels:
        return local.split("+")[-1], "noreply", host
    return local.split("+")[0], labels[-2] if len(labels) > 1 else labels[0], host


def soundex(word: str, length: int = 4) -> str:
    code, before = word[:1], SOUNDEX.get(word[:1], "")
    for c in word[1:]:
        digit = SOUNDEX.get(c, "")
        if digit and digit != before:
            code += digit
            if len(code) == length:
                break
        if c not in "hw":
            before = digit
    return code


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def _full(tokens: list[str]) -> list[str] | None:
    """Given and last name; initials and what lies between are left out."""
    long = [t for t in tokens if len(t) > 1]
    return [long[0], long[-1]] if len(long) > 1 else None


def _partial(tokens: list[str]) -> list[str]:
    """Keys '<initial>|<name>' of a signature that gives one name in full and the other by its first letter."""
    long, short = [t for t in tokens if len(t) > 2], [t for t in tokens if len(t) == 1]
    if len(long) == 1 and short:
        return [f"{short[0]}|{long[0]}"]
    if len(tokens) == 1 and len(tokens[0]) > 4:
        t = tokens[0]
        return [f"|{t}", f"{t[0]}|{t[1:]}", f"{t[-1]}|{t[:-1]}"]
    return []


def _parse(author: str, email: str | None) -> dict:
    tokens, box = name_tokens(author), mailbox(email)
    names = [[*n, "author"] for n in [_full(tokens)] if n]
    partial = _partial(tokens)
    own = None
    if box:
        local, org, host = box
        bare = re.sub(r"\d+$", "", local)
        parts = [p for p in re.split(r"[._-]+", re.sub(r"[._-]?dev$", "", bare)) if p]
        parts = [p.rstrip("0123456789") for p in parts if p.rstrip("0123456789")]
        if bare not in ROLE_BOXES and local not in ROLE_BOXES:
            own = f"{local}@{org}"
            mine = _full(parts) if all(p.isalpha() for p in parts) and all(len(p) > 1 for p in parts) else None
            if mine:
                names.append([*mine, "address"])
            else:
                partial += _partial(parts)
    return {"names": names, "partial": list(dict.fromkeys(partial)), "box": own, "org": box[1] if box and box[1] != "noreply" else None}


_PARSED = "sig string, names array<array<string>>, partial array<string>, box string, org string"


def parse_signatures(signatures: DataFrame) -> DataFrame:
    """(sig, names, partial, box, org) of each distinct (author, email)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"sig": s} | _parse(a, e) for s, a, e in zip(frame["sig"], frame["author"], frame["email"], strict=True)]
            yield pd.DataFrame(rows, columns=["sig", "names", "partial", "box", "org"])

    return signatures.select("sig", "author", "email").mapInPandas(run, _PARSED)


def _node(kind: str, *columns: str):
    return F.concat_ws("", F.lit(kind), *columns)


def _short_forms(nicknames: DataFrame) -> DataFrame:
    """(short, name) of the given table, lower-cased; nulls and blanks left out."""

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        return pd.Series([fold(s) if s else None for s in names], dtype="object")

    pairs = nicknames.select(folded("short_form").alias("short"), folded("name").alias("name"))
    return pairs.where("short <> '' and name <> '' and short <> name").distinct()


def _learned_forms(personal: DataFrame) -> DataFrame:
    """(short, name) seen for the same last name under one mailbox, of several people; `personal` has no shared mailbox."""
    own = personal.select("box", F.explode("names").alias("n")).where(F.col("n")[2] == "author").select("box", F.col("n")[0].alias("first"), F.col("n")[1].alias("last")).distinct()
    other = own.withColumnRenamed("first", "other")
    counted = (
        own.join(other, ["box", "last"]).where("first <> other")
        .groupBy(F.col("first").alias("short"), F.col("other").alias("name"))
        .agg(F.count_distinct("box").alias("n"))
    )
    return counted.where(F.col("n") >= LEARNED_FROM).select("short", "name")


def _compare(pairs: DataFrame) -> DataFrame:
    """Accepted pairs of names that share one token, whole or as short form: the other is one slip away.

    Given names may also be short forms that no table has: they agree in their first three letters. Two
    established names are never taken for one, unless one is in no table and has at most SLIP_SHARE of the partners
    of the other: slips become more with the people, but not their share.
    """

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series, known: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([
            x == y or (not k and min(len(x), len(y)) > 2 and (one_slip(x, y) or (g and x[:3] == y[:3])) and jaro_winkler(x, y) >= SIMILAR)
            for x, y, k, g in zip(a, b, known, given, strict=True)
        ])

    slip = lambda x, y: ~F.col(f"{x}_listed") & (F.col(f"{x}_many") <= F.col(f"{y}_many") * SLIP_SHARE)
    known = (F.col("x_listed") | (F.col("x_many") >= ESTABLISHED)) & (F.col("y_listed") | (F.col("y_many") >= ESTABLISHED)) & ~slip("x", "y") & ~slip("y", "x")
    given = F.col("x_given") & F.col("y_given")
    return pairs.where(alike("x", "y", known, given)).select("a", "b")


def _partners(names: DataFrame) -> DataFrame:
    """(token, n): with how many different other tokens each token occurs."""
    one, two = F.col("first"), F.col("last")
    pairs = names.select(one.alias("token"), two.alias("other")).unionByName(names.select(two.alias("token"), one.alias("other")))
    return pairs.groupBy("token").agg(F.count_distinct("other").alias("n"))


def _oriented(named: DataFrame) -> DataFrame:
    """Put the given name first: the token that more authors write first than last, and else the one of more names.

    Only authors tell the order; addresses are written either way.
    """
    author = F.when(F.col("source") == "author", 1).otherwise(0)
    tokens = named.select("first", "last", author.alias("by")).distinct()
    side = lambda c, o, sign: tokens.select(F.col(c).alias("token"), F.col(o).alias("other"), (F.col("by") * sign).alias("lead"))
    leads = side("first", "last", 1).unionByName(side("last", "first", -1)).groupBy("token").agg(F.sum("lead").alias("lead"), F.count_distinct("other").alias("n"))
    rank = leads.select("token", F.struct("lead", "n").alias("rank"))
    joined = named.join(rank.withColumnsRenamed({"token": "first", "rank": "of_first"}), "first").join(rank.withColumnsRenamed({"token": "last", "rank": "of_last"}), "last")
    swap = F.col("of_last") > F.col("of_first")
    return joined.select(
        *[c for c in named.columns if c not in ("first", "last", "source")],
        F.when(swap, F.col("last")).otherwise(F.col("first")).alias("first"), F.when(swap, F.col("first")).otherwise(F.col("last")).alias("last"),
    )


def _known(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Tokens that are established names and so no slip of another: with many partners, or in the table."""
    often = _partners(names).where(F.col("n") >= ESTABLISHED).select("token")
    return often.unionByName(forms.select(F.col("name").alias("token"))).distinct()


def _codes(word: str, given: bool) -> list[str]:
    """Second halves of block keys: any two words of which `_compare` may accept one for the other share one.

    A given name has its phonetic codes, read forwards and backwards, each together with its first three letters, as
    only those with the same ones are accepted by sound. Words one slip apart share what one lost letter leaves of
    both; of long ones, which would leave much, the phonetic codes.
    """
    codes = [f">{soundex(word)}", f"<{soundex(word[::-1])}"]
    out = [f"{c}|{word[:3]}" for c in codes] if given else []
    if len(word) >= 12:
        out += codes
    if len(word) <= 12:
        out += [f"-{word[:i]}{word[i + 1:]}" for i in range(len(word))] + [f"-{word}"]
    return list(dict.fromkeys(out))


def name_links(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs (a, b) of name nodes that may be spellings of one name.

    `names` has (node, first, last). Each name enters a block per token that it has in full and per phonetic code
    of the other: the codes of sorted tokens, with the more telling one exact. Distinct names are compared, not
    signatures or rows, so a block holds the few different spellings that agree in a whole token and sound alike;
    a second code (`_codes`) parts the blocks of frequent names without losing a pair that could be accepted.
    """
    listed = forms.select(F.col("name").alias("token"), F.lit(True).alias("listed")).distinct()
    standing = _partners(names).join(listed, "token", "left")

    @F.pandas_udf("array<string>")
    def codes(word: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([_codes(w, g) for w, g in zip(word, given, strict=True)])

    whole = names.join(forms, F.col("first") == F.col("short"), "left").groupBy("node", "first", "last").agg(F.collect_set("name").alias("long"))
    given, family = F.lit(True).alias("given"), F.lit(False).alias("given")
    by_first = whole.select("node", F.explode(F.array_union(F.array("first"), "long")).alias("exact"), F.col("last").alias("word"), family)
    by_last = names.select("node", F.col("last").alias("exact"), F.col("first").alias("word"), given)
    entries = (
        by_first.unionByName(by_last).distinct()
        .join(standing, F.col("word") == F.col("token"), "left").drop("token")
        .withColumns({"many": F.coalesce("n", F.lit(0)), "listed": F.coalesce("listed", F.lit(False))}).drop("n")
        .withColumn("code", F.explode(codes("word", "given")))
        .distinct()
    )
    left = entries.select("exact", "code", F.col("node").alias("a"), F.col("word").alias("x"), F.col("many").alias("x_many"), F.col("listed").alias("x_listed"), F.col("given").alias("x_given"))
    right = entries.select("exact", "code", F.col("node").alias("b"), F.col("word").alias("y"), F.col("many").alias("y_many"), F.col("listed").alias("y_listed"), F.col("given").alias("y_given"))
    pairs = left.join(right, ["exact", "code"]).where("a < b").drop("exact", "code").distinct()
    return _compare(pairs).distinct()


def link_people(commits: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(sig, person) for every distinct signature of commits whose author is not null.

    sig is author || ' <' || coalesce(email, '') || '>' as stored; person is an arbitrary name of its group.
    Evidence is joined as a graph of signatures, mailboxes and names: a signature hangs on its mailbox (unless that
    is shared or belongs to a task) and on the full names in its author and address; names hang together if
    `name_links` accepts them. Its connected components are people. A group that gives a name only in part ('J.
    Doe', 'jdoe') then joins the one group that has such a full name (see `_moves`); where several fit, it stays
    alone. Empty authors and malformed addresses are signatures like others. Repeated rows do
    not matter. Empty tables are allowed.
    """
    sig = F.concat(F.col("author"), F.lit(" <"), F.coalesce("email", F.lit("")), F.lit(">"))
    signatures = commits.where(F.col("author").isNotNull()).select(sig.alias("sig"), "author", "email").groupBy("sig").agg(F.max("author").alias("author"), F.max("email").alias("email"))
    parsed = cut(parse_signatures(signatures))
    named = parsed.select("sig", "box", F.explode("names").alias("n")).select("sig", "box", F.col("n")[0].alias("first"), F.col("n")[1].alias("last"), F.col("n")[2].alias("source"))
    named = cut(_oriented(named).withColumn("node", F.concat_ws(" ", F.lit("n"), F.least("first", "last"), F.greatest("first", "last"))))
    names = named.select("node", "first", "last").distinct()
    shared = (
        named.where("box is not null").groupBy("box")
        .agg(F.count_distinct(F.substring("last", 1, 2)).alias("lasts"), F.count_distinct(F.substring("first", 1, 1)).alias("firsts"))
        .where((F.col("lasts") >= SHARED_FROM) & (F.col("firsts") >= SHARED_FROM)).select("box")
    )
    shared = cut(shared)
    personal = parsed.where("box is not null").join(shared, "box", "left_anti")
    forms = cut(_short_forms(nicknames).unionByName(_learned_forms(personal)).distinct())
    s = F.concat(F.lit("s "), "sig")
    edges = (
        parsed.select(s.alias("a"), s.alias("b"))
        .unionByName(personal.select(s.alias("a"), F.concat(F.lit("m "), "box").alias("b")))
        .unionByName(named.select(s.alias("a"), F.col("node").alias("b")))
        .unionByName(name_links(names, forms))
    )
    groups = cut(connected_components(edges))
    mine = groups.where("node like 's %'").select(F.expr("substring(node, 3)").alias("sig"), F.col("component").alias("person"))
    moves = _moves(parsed.join(mine, "sig"), named.join(mine, "sig"), forms)
    return mine.join(_resolved(moves), "person", "left").select("sig", F.coalesce("to", "person").alias("person"))


def _resolved(moves: DataFrame) -> DataFrame:
    """(person, to): moves (a, b), at most one per a, with those followed whose target moves as well."""
    then = moves.select(F.col("a").alias("b"), F.col("b").alias("c"))
    to = F.when(F.col("c") == F.col("a"), F.least("a", "b")).otherwise(F.coalesce("c", "b"))
    return moves.join(then, "b", "left").select(F.col("a").alias("person"), to.alias("to"))


def _moves(parsed: DataFrame, named: DataFrame, forms: DataFrame) -> DataFrame:
    """Tie groups that name their person only in part, or by an unknown short form, to the one group (a, b) meant.

    The parts are the initial and name, or the name alone, of authors and addresses. The group whose full name
    agrees with the most of them, by letters, is meant; of several alike the only one in the same organisation.
    A group with a full name of its own needs the last name to agree, and the first unless it is an unknown form.
    """
    full = cut(named.select("person", "first", "last").distinct())
    known = _known(full.select("first", "last"), forms)
    firsts = full.join(known, F.col("first") == F.col("token"), "left").groupBy("person").agg(
        F.collect_set("first").alias("firsts"), F.max(F.col("token").isNotNull()).alias("established")
    )
    keys = full.select(
        F.col("person").alias("target"), F.col("first").alias("target_first"),
        F.posexplode(F.array(
            F.concat(F.substring("last", 1, 1), F.lit("|"), "first"), F.concat(F.substring("first", 1, 1), F.lit("|"), "last"), F.concat(F.lit("|"), "last"),
        )).alias("by_last", "key"),
    ).distinct()
    orgs = parsed.where("org is not null").select("person", "org").distinct()
    parts = parsed.select("person", F.explode("partial").alias("key")).distinct().join(firsts, "person", "left")
    same_name = F.col("firsts").isNull() | ((F.col("by_last") > 0) & (F.array_contains("firsts", F.col("target_first")) | ~F.col("established")))
    options = (
        parts.join(keys, "key").where("person <> target").where(same_name)
        .select("person", "target", "key").distinct()
        .groupBy("person", "target").agg(F.sum(F.length("key")).alias("letters"))
    )
    top = Window.partitionBy("person")
    best = cut(options).withColumn("most", F.max("letters").over(top)).where("letters = most").withColumn("n", F.count(F.lit(1)).over(top))
    lone = best.where("n = 1").select("person", F.col("target").alias("to"))
    near = (
        best.where("n > 1").join(orgs, "person").join(orgs.select(F.col("person").alias("target"), "org"), ["target", "org"])
        .groupBy("person").agg(F.count_distinct("target").alias("n"), F.min("target").alias("to")).where("n = 1").select("person", "to")
    )
    return lone.unionByName(near).select(F.col("person").alias("a"), F.col("to").alias("b"))


def signature_pairs(people: DataFrame) -> DataFrame:
    """All pairs sig_a < sig_b (by bytes) of one person."""
    a = people.select("person", F.col("sig").alias("sig_a"))
    b = people.select("person", F.col("sig").alias("sig_b"))
    return a.join(b, "person").where("sig_a < sig_b").select("sig_a", "sig_b")
