"""Documents that are hard on an operator, and brute-force versions."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Columns whose names operators use themselves.
CLASHING = "n_words long, kept string, shard string, rid string, items string, text_stats string, own_0_doc_id string, line_key string, cls string, block string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def hard_texts():
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + [f"edit{i}"] + words[i + 1 :]) for i in (10, 40, 70)]
    far = [" ".join(w if rng.random() > 0.1 else f"x{rng.randrange(999)}" for w in words) for _ in range(4)]
    return [
        None,
        "",
        " \n\t \r\n",
        "one",
        "one two",
        "One  two",
        "a\x0bb\x0cc\rd",
        "naïve café ÀÉ 東京 😀 😀 😀",
        "Und " * 300,
        "same line\nsame line\n\nsame line \n  \nother",
        "THE!! OF!! AND!! " * 30,
        "word*** of%%% the### " * 40,
        "x" * 5000,
        prose(rng, 20000),
        base,
        base,
        base,
        *near,
        *far,
        *[prose(rng, rng.randrange(1, 200)) for _ in range(20)],
        "zero\x00byte and <|endoftext|> inside",
        "tail with spaces   \n\n\n",
    ]


def hard_rows():
    """``doc_id, text, lang, source, n_chars`` with null ids, nulls in any
    column and repeated rows."""
    texts = hard_texts()
    langs, sources = ["en", None, "de"], ["s0", "s0", None, "s1"]
    rows = [
        (i, t, langs[i % 3], sources[i % 4], None if t is None or i % 7 == 0 else len(t)) for i, t in enumerate(texts)
    ]
    rows += [(None, "a row without an id", "en", "s0", 3), (None, texts[14], None, None, None)]
    return rows + [rows[16], rows[16], rows[20]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, clash=False):
    rows = hard_rows() if rows is None else rows
    if clash:
        extra = (5, "k", "s", "r", "i", "t", "o", "l", "c", "b")
        return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHING}")
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
