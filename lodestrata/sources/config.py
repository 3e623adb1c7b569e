"""Settings of an ingest run, with an optional YAML file on top of the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from lodestrata.functions import paths


@dataclass(frozen=True)
class Config:
    """Which files count, and the limits of an ingest run."""

    ignore: list[str] = field(default_factory=lambda: list(paths.IGNORE_GLOBS))
    test_patterns: list[str] = field(default_factory=lambda: list(paths.TEST_GLOBS))
    lang_by_ext: dict[str, str] = field(default_factory=lambda: dict(paths.EXTENSION_LANGUAGES))
    szz_max_files: int = 60
    rename_jaccard: float = 0.6
    max_diff_lines: int = 200_000


def load_config(path: str | None = None, extra_ignore: list[str] | None = None) -> Config:
    """The defaults changed by a YAML file: numbers replace, lists append unless '<name>_replace' is given, languages merge."""
    base = Config()
    data: dict = {}
    if path:
        import yaml

        data = yaml.safe_load(Path(path).read_text()) or {}
    numbers = {k: data[k] for k in ("szz_max_files", "rename_jaccard", "max_diff_lines") if k in data}
    lists = {k: list(data.get(f"{k}_replace", getattr(base, k) + list(data.get(k, [])))) for k in ("ignore", "test_patterns")}
    lists["ignore"] += extra_ignore or []
    return Config(**numbers, **lists, lang_by_ext=base.lang_by_ext | data.get("lang_by_ext", {}))
