"""What a commit message says: fix, revert, issue references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words of a fix, words of a revert, and forms of an issue reference.
FIX_WORDS = [
    "fix", "fixed", "fixes", "fixing", "bug", "bugs", "defect", "hotfix", "regression", "regressions", "crash", "crashed", "crashes",
    "broke", "broken", "npe", "nullpointer", "leak", "leaks", "leaked", "leaking", "segfault", "deadlock", r"race\s+condition",
    "corrupt", "corruption", "corrupted", "wrong", "incorrect", "fault",
]
REVERT_WORDS = ["revert", "reverts", "reverted", "reverting"]
ISSUE_REFERENCE = r"#(\d+)|\b[A-Z][A-Z0-9]+-\d+\b"


def words_pattern(words: list[str]) -> str:
    """Any of the words, whole, in any case; classes and word bounds know Unicode."""
    return rf"(?iU)\b(?:{'|'.join(words)})\b"


def message(subject: str = "subject", body: str = "body") -> Column:
    """Subject and body as one stripped text; nulls are empty."""
    text = F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def has_fix_word(text: Column) -> Column:
    return text.rlike(words_pattern(FIX_WORDS))


def is_revert(text: Column) -> Column:
    return text.rlike(words_pattern(REVERT_WORDS))


def issue_references(text: Column) -> Column:
    """The number of each '#number'; '' for each KEY-number, which has none."""
    return F.regexp_extract_all(text, F.lit(f"(?U){ISSUE_REFERENCE}"), F.lit(1))


def classify(text: Column) -> dict[str, Column]:
    """All flags of a message. An issue reference alone makes no fix."""
    refs = issue_references(text)
    return {
        "is_fix": is_revert(text) | has_fix_word(text), "is_revert": is_revert(text), "has_issue_ref": F.size(refs) > 0,
        "has_keyword": has_fix_word(text), "issue_refs": refs,
    }
