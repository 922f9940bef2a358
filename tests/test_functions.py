from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changelens.functions import paths, regex, template
from changelens.functions.sql import quote, sums_before
from changelens.functions.text import is_blank, one_decimal, trim
from changelens.params import RiskParams, ScanOptions, SecretPattern


def values(spark, rows, schema, *expressions):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).selectExpr(*expressions).collect()]


@pytest.mark.parametrize("size", [0, 1, 2, 127, 128, 129, 256, 257, 1000])
def test_sums_before_any_length(spark, size):
    numbers = [(i * 7) % 5 for i in range(size)]
    [(got,)] = values(spark, [(numbers,)], "v array<bigint>", sums_before("v"))
    assert got == [sum(numbers[:i]) for i in range(size)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 100, allow_nan=False), min_size=1, max_size=60))
def test_one_decimal_rounds_the_exact_value(spark, numbers):
    numbers = [*numbers, 1.45, 1.25, 0.05, 2.05, 9.95, 99.95, 100.0, 0.0, 3.6249999999999996]
    got = values(spark, [(n,) for n in numbers], "x double", "x", one_decimal("x"))
    for x, text in got:
        assert text == str(Decimal(x).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def test_trim_and_blank_know_all_white_space(spark):
    rows = [(" \t x ﻿\n",), ("\r\n  ",), ("",), (None,)]
    got = values(spark, rows, "t string", trim("t"), is_blank("t"))
    assert got == [("x", False), ("", True), ("", True), (None, True)]


def test_quote_survives_any_text(spark):
    text = "a'b\\n\"c\nd\\'e$1"
    assert values(spark, [(1,)], "x int", quote(text)) == [(text,)]


def test_word_edges_are_ascii(spark):
    pattern = quote(regex.java(r"\bque\b"))
    rows = [("é que",), ("équeé",), ("xque",), ("que_",), ("que",)]
    got = values(spark, rows, "t string", f"t rlike {pattern}")
    assert [g[0] for g in got] == [True, True, False, False, True]


def test_end_means_the_very_end(spark):
    got = values(spark, [("a.md",), ("a.md\n",)], "t string", f"t rlike {quote(regex.java('[.]md$'))}")
    assert [g[0] for g in got] == [True, False]


def test_globs(spark):
    rows = [("src/a/b.ts",), ("src.x",), ("a.md",), ("amd",), ("f1.js",), ("f12.js",)]
    got = values(spark, rows, "path string", paths.matches_glob(["src/*", "*.md", "f?.js"]))
    assert [g[0] for g in got] == [True, False, True, False, True, False]


def test_path_lookups(spark):
    rows = [("Makefile",), ("a/b.h",), ("a.d/file",), ("x.TS",), ("/x.py",), (".eslintrc",)]
    got = values(spark, rows, "path string", paths.extension(), paths.directory(), paths.language(), paths.is_config())
    assert got == [
        ("Makefile", ".", None, False),
        (".h", "a", "cpp", False),
        (".d/file", "a.d", None, False),
        (".TS", ".", None, False),
        (".py", ".", "python", False),
        (".eslintrc", ".", None, True),
    ]


def test_template_never_expands_what_is_put_in(spark):
    text = template.fill("<{{a}}|{{#if b}}[{{b}}]{{/if}}>", {"a": "a", "b": "b"})
    got = values(spark, [("{{b}}", "x"), ("$1", "")], "a string, b string", text)
    assert got == [("<{{b}}|[x]>",), ("<$1|>",)]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        RiskParams({"security": 0.9, "complexity": 0.3, "changeSize": 0.15, "criticalFiles": 0.15})
    with pytest.raises(ValueError):
        RiskParams({"security": 1.0})
    with pytest.raises(ValueError):
        RiskParams(high=40, medium=40)
    with pytest.raises(ValueError):
        ScanOptions(min_severity="URGENT")
    with pytest.raises(ValueError):
        SecretPattern("T", "x", "URGENT", 0.5)
    assert RiskParams({"security": 0.4005, "complexity": 0.3, "changeSize": 0.15, "criticalFiles": 0.15})
    assert ScanOptions(context_lines=0).context_size == 2
