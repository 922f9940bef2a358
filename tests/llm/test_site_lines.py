import random
from collections import Counter

import corpus_pipeline
from changelens.llm import site_lines
from pyspark.sql import functions as F

from tests.llm.cases import documents, hard_rows, plain

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, params):
    totals, counts = Counter(), Counter()
    for _, text, _, site, _ in rows:
        if site is not None:
            totals[site] += 1
            for line in {x.strip(SPACES) for x in (text or "").split("\n")} - {""}:
                counts[site, line] += 1
    out = []
    for doc_id, text, _, site, _ in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        filled = [x for x in lines if x.strip(SPACES)]
        gone = [
            x for x in filled
            if counts[site, x.strip(SPACES)] >= params.min_line_pages
            and counts[site, x.strip(SPACES)] > params.max_ratio * totals[site]
        ]
        kept = [x for x in lines if x not in gone]
        out.append((doc_id, "\n".join(kept) if gone else text, len(filled), len(gone)))
    return plain(out)


def pages(seed=4, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site = rng.choice(["hot", "hot", "hot", "a", "b", None, f"small{i}"])
        lines = [rng.choice(["menu", " menu ", "footer", "", "  ", f"line {rng.randrange(900)}"]) for _ in range(rng.randrange(6))]
        if rng.random() < 0.15:
            lines.append(f"on {site}")
        rows.append((i, "\n".join(lines) if rng.random() > 0.03 else None, "en", site, None))
    return rows + rows[:3]


def test_against_brute_force(spark):
    for rows in (pages(), hard_rows() * 9):
        results = []
        for params in (site_lines.SiteParams(), site_lines.SiteParams(broadcast_bytes=-1, salts=3)):
            got = site_lines.drop_site_lines(documents(spark, rows, clash=True), "source", params=params)
            results.append(plain(got.select("doc_id", "text", "n_lines", "n_dropped").collect()))
        assert results[0] == results[1] == brute(rows, params)


def test_sources_of_any_size_are_judged(spark):
    def texts(n, with_line):
        return [(i, f"page {n} {i}\nfooter {n}" if i < with_line else f"page {n} {i}", "en", f"s{n}", None) for i in range(n)]

    sizes = ((1, 1), (2, 2), (4, 2), (4, 3), (19, 3), (20, 2), (20, 3), (40, 4), (40, 5))
    rows = [(100 * k + i, t, g, f"{s} {k}", n) for k, (pages, hit) in enumerate(sizes) for i, t, g, s, n in texts(pages, hit)]
    got = corpus_pipeline.line_dedup(spark, documents(spark, rows), "").collect()
    left = Counter(r.doc_id // 100 for r in got if "footer" in r.text)
    want = {k: hit for k, (pages, hit) in enumerate(sizes) if not (hit >= 3 and hit > 0.1 * pages)}
    assert left == want and all(r.n_chars == len(r.text) for r in got)
    # one rule: the query's operator does the same
    before = site_lines.clean_texts(documents(spark, rows), "source").select("doc_id", "text").collect()
    assert plain(before) == plain((r.doc_id, r.text) for r in got)


def test_very_long_lines_and_texts(spark):
    footer = "foot " * 40_000
    rows = [(i, "\n".join([footer, *(f"line {i} {j}" for j in range(3000))]), None, "s", None) for i in range(4)]
    got = site_lines.drop_site_lines(documents(spark, rows), "source").collect()
    assert all(r.n_dropped == 1 and r.n_lines == 3001 and r.text.startswith("line") for r in got)


def test_own_columns_and_empty_table(spark):
    docs = documents(spark, clash=True)
    kept = site_lines.clean_texts(docs, "source")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert site_lines.clean_texts(documents(spark, []), "source").count() == 0


def test_html_lines(spark):
    html = '<!DOCTYPE html><title>T</title><script>var t="<p>";</script><p>a <b>b</b><br>c<!-- x\n --></p><pre>d</pre>'
    row = spark.createDataFrame([(html,), (None,)], "html string").select(site_lines.html_lines(F.col("html"))).collect()
    assert [x for x in row[0][0].split("\n") if x] == ["T", "a b", "cd"] or [x for x in row[0][0].split("\n") if x] == ["T", "a b", "c", "d"]
    assert row[1][0] is None
