import hashlib
import random

from changelens.llm import decontam, queries

from tests.llm.cases import LETTERED, documents, hard_rows, lower, plain


def windows_of(items):
    out = {}
    for item, text in items:
        words = LETTERED.findall(lower(text or ""))
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[k : k + n]), set()).add("" if item is None else str(item))
    return out


def brute(text, windows):
    words, hit, items = LETTERED.findall(lower(text or "")), set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            found = windows.get(tuple(words[k : k + n]))
            if found:
                items |= found
                hit |= set(range(k, k + n))
    return len(words), len(hit), sorted(items)


def corpus():
    rng = random.Random(6)
    vocabulary = [f"W{i}é" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 30])))) for i in range(12)]
    items += [(3, items[5][1]), (None, items[9][1] + " more"), (50, None), (51, ""), (52, " ., "), items[2]]
    rows = hard_rows()
    for i in range(60):
        quoted = rng.choice(items)[1] or ""
        words = rng.choices(vocabulary, k=rng.randrange(30)) + quoted.split()[: rng.randrange(31)]
        words += rng.choices(vocabulary, k=rng.randrange(30))
        rows.append((1000 + i, rng.choice([" ", ", ", "\n"]).join(words), "en", "s", None))
    return rows, [x for x in items if x[1] is None or len(x[1].split()) != 1 or x[0] is None]


def test_against_brute_force_in_one_block_and_in_many(spark):
    rows, items = corpus()
    windows = windows_of(items)
    want = plain([(r[0], *brute(r[1], windows)) for r in rows])
    assert any(n for _, _, n, _ in want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for params in (decontam.WindowParams(), decontam.WindowParams(block_bytes=4000)):
        got = decontam.scan(documents(spark, rows, clash=True), bench, params)
        assert plain(got.select("doc_id", "n_words", "n_hit", "items").collect()) == want


def test_documents_and_spans_are_removed(spark):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = windows_of(items)
    docs = documents(spark, rows, clash=True)
    kept = decontam.drop_documents(docs, bench)
    assert kept.columns == docs.columns
    clean = [r for r in rows if not brute(r[1], windows)[1]]
    assert plain(kept.select("doc_id", "text", "lang", "source", "n_chars").collect()) == plain(clean)
    cut = decontam.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    for r in clean:
        if r[0] is not None:
            assert texts[r[0]] == r[1]
    one = spark.createDataFrame([(1, "Ä b C d e f g h i j")], "item_id long, text string")
    doc = documents(spark, [(1, "é keep. Ä, b c d e f g h i J; and keep", "en", "s", 1)])
    assert decontam.remove_spans(doc, one).first().text == "é keep. ; and keep"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(documents(spark), none).where("n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.scan(documents(spark, []), some).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = windows_of(bench)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_decontamination(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, items = brute(texts[r.doc_id], windows)
        joined = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert tuple(r)[1:] == (n, hit, len(items), joined, hit > 0)


def test_items_without_an_id_are_apart_from_those_of_an_empty_one(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(None, ten), ("", ten), ("b", ten)], "item_id string, text string")
    [row] = decontam.scan(documents(spark, [(1, f"x {ten} y", None, None, None)]), items).collect()
    assert row["items"] == ["", "", "b"] and row.n_hit == 10
