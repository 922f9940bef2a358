"""Path predicates and lookups as SQL text over a path expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from changelens.functions import fixed
from changelens.functions.regex import any_of, glob, java
from changelens.functions.sql import quote

_LANGUAGE_BY_EXTENSION: dict[str, str] = {}
for _language, _extensions in fixed.LANGUAGE_EXTENSIONS.items():
    for _extension in _extensions:
        _LANGUAGE_BY_EXTENSION.setdefault(_extension, _language)

_FRAMEWORK_BY_LANGUAGE = {language: names[0] for language, names in fixed.TEST_FRAMEWORKS.items()}


def _lookup(table: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def _matches(path: str, patterns: Iterable[str]) -> str:
    return f"{path} rlike {quote(any_of(patterns))}"


def extension(path: str = "path") -> str:
    """From the last dot on; the whole path when it has no dot."""
    return f"if(contains({path}, '.'), concat('.', substring_index({path}, '.', -1)), {path})"


def directory(path: str = "path") -> str:
    """Before the last slash, ``.`` when that is empty."""
    before = f"regexp_extract({path}, '(?s)^(.*)/', 1)"
    return f"if({before} = '', '.', {before})"


def language(path: str = "path") -> str:
    return _lookup(_LANGUAGE_BY_EXTENSION, extension(path))


def suggestion_language(file_language: str = "language", path: str = "path") -> str:
    return f"coalesce({file_language}, {_lookup(fixed.SUGGESTION_LANGUAGES, extension(path))}, 'unknown')"


def test_framework(file_language: str = "language") -> str:
    key = f"coalesce({file_language}, 'typescript')"
    return f"coalesce({_lookup(_FRAMEWORK_BY_LANGUAGE, key)}, 'jest')"


def is_critical(path: str = "path") -> str:
    return _matches(path, fixed.CRITICAL_PATHS)


def is_test(path: str = "path") -> str:
    return _matches(path, fixed.TEST_PATHS)


def is_config(path: str = "path") -> str:
    return _matches(path, fixed.CONFIG_PATHS)


def is_doc(path: str = "path") -> str:
    return f"{path} rlike {quote(java(fixed.DOC_PATHS, ignore_case=True))}"


def is_excluded(path: str = "path") -> str:
    """Paths that no built-in secret pattern applies to."""
    return _matches(path, fixed.EXCLUDED_PATHS)


def in_category(category: str, path: str = "path") -> str:
    return _matches(path, fixed.CRITICAL_CATEGORIES[category])


def is_testable() -> str:
    """Code files worth a test suggestion; looser path rules than is_test."""
    parts = "|".join(map(re.escape, [*fixed.TEST_PATH_PARTS, ".config."]))
    endings = "|".join(map(re.escape, fixed.CONFIG_PATH_ENDINGS))
    code = "|".join(map(re.escape, fixed.TESTABLE_EXTENSIONS))
    skipped = quote(rf"(?:{parts})|(?:{endings})\z")
    wanted = quote(rf"(?:{code})\z")
    return f"path rlike {wanted} AND NOT path rlike {skipped} AND NOT binary AND status <> 'deleted'"


def matches_glob(patterns: Iterable[str], path: str = "path") -> str:
    return f"{path} rlike {quote('|'.join(f'(?:{glob(p)})' for p in patterns))}"
