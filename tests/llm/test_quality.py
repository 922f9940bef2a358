import math
import random

from changelens.llm import quality
from pyspark.sql import functions as F

from tests.llm.cases import CLASHING, SPACED, documents, hard_rows, plain


def brute(text):
    words = SPACED.findall(text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_of_hard_texts(spark):
    rows = quality.with_stats(documents(spark)).select("text", *quality.STATS).collect()
    assert len(rows) == len(hard_rows())
    for r in rows:
        assert tuple(r)[1:] == brute(r.text), r.text


def test_statistics_of_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aab  \n\t#|A!", k=rng.randrange(60))) for _ in range(300)]
    rows = quality.with_stats(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert tuple(r[c] for c in quality.STATS) == brute(r.text), r.text


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for p in (0.005, 0.05, 0.3) for n in (1, 10, 300, 900) for k in (0, 1, 5, 40) if k < n * p]
    for k, n, p in cases:
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.at_most(F.lit(k), F.lit(n), p)).first()[0]
        assert math.isclose(got, exact, rel_tol=1e-9), (k, n, p, got, exact)
    assert spark.range(1).select(quality.at_most(F.lit(5), F.lit(10), 0.3)).first()[0] == 1.0


def labelled_corpus(spark, n=900):
    """Good documents of plain words; bad ones full of symbols; a stratum that
    is too small to certify anything."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad, lang = i % 5 == 0, "xx" if i % 60 == 1 else "en"
        words = [f"w{rng.randrange(5000)}" + ("***" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), lang, "s", None))
        labels.append((i, 0 if bad else 1))
    rows += [(n + 1, " ".join(f"z{i}###" for i in range(60)), "en", "s", None)]
    rows += [(n + 2, " ".join(f"z{i}###" for i in range(60)), "xx", "s", None)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    docs, labels = labelled_corpus(spark)
    judged = {r.doc_id: r for r in quality.judge(docs, labels, quality.RiskParams(max_false_rejection=0.06)).collect()}
    assert all(judged[i].kept for i in range(900) if i % 5)
    assert not any(judged[i].kept for i in range(900) if i % 5 == 0 and judged[i].lang == "en")
    assert judged[901].rejected_by == "symbols" and not judged[901].base_failed
    assert judged[902].kept  # too few labels in its stratum


def test_counts_of_graded_statistics(spark):
    """Symbols in every share of the words: each cutoff counts its own."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        share = rng.random()
        words = [f"w{rng.randrange(5000)}" + ("*" * rng.randrange(1, 4) if rng.random() < share else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(share < 0.3 or share < 0.5 and rng.random() < 0.2)))
    labels_ = spark.createDataFrame(labels, "doc_id long, quality int")
    check_table(spark, documents(spark, rows), labels_, quality.RiskParams(max_false_rejection=0.3))


def test_guarantee_by_brute_force(spark):
    docs, labels = labelled_corpus(spark)
    check_table(spark, docs, labels, quality.RiskParams(max_false_rejection=0.06))


def check_table(spark, docs, labels, params):
    labelled = docs.withColumn("stratum", F.col("lang")).join(labels, "doc_id").withColumn("good", F.col("quality") == 1)
    table = quality.calibrate(quality.trials(labelled, params), params).collect()
    rows = {}
    for r in quality.with_stats(labelled).collect():
        if r.n_words >= params.min_words and 100 * r.n_repeat_words <= params.max_repeat_percent * r.n_words:
            known = rows.setdefault((r.stratum, r.text), [r, False])
            known[1] |= r.good
    n_strata = len({stratum for stratum, _ in rows})
    by_stratum = {}
    for r in sorted(table, key=lambda r: r.step):
        by_stratum.setdefault(r.stratum, []).append(r)

    def exceeds(row, rule, cutoff):
        top, bottom = params.rules[rule].statistic.split(" / ")
        return bool(row[bottom]) and row[top] / row[bottom] > cutoff

    for stratum, steps in by_stratum.items():
        assert [(r.rule, r.cutoff) for r in steps] == params.steps
        own = [v for (s, _), v in rows.items() if s == stratum]
        n = sum(good for _, good in own)
        share, going = params.max_false_rejection, True
        for r in steps:
            over = [good for row, good in own if any(exceeds(row, *c) for c in params.steps[: r.step])]
            assert (r.n_good, r.k_good, r.k_bad) == (n, sum(over), len(over) - sum(over))
            exact = math.fsum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(r.k_good + 1))
            going = going and n > 0 and r.k_good < n * share and exact <= params.error / n_strata
            assert r.certified == going
        certified = [r for r in steps if r.certified and r.k_bad > r.k_good]
        best = min(certified, key=lambda r: (r.k_good - r.k_bad, r.step), default=None)
        assert [r for r in steps if r.chosen] == ([best] if best else [])
    assert any(r.chosen for r in table)


def test_repeated_rows_are_one_trial(spark):
    """Eight times the rows, and copies under other ids, certify nothing more."""
    docs, labels = labelled_corpus(spark, 300)
    params = quality.RiskParams(max_false_rejection=0.05)
    many = docs
    copies, more = docs.withColumn("doc_id", F.col("doc_id") + 10_000), labels.withColumn("doc_id", F.col("doc_id") + 10_000)
    for _ in range(3):
        many = many.unionByName(many)
    single = {r.doc_id: (r.kept, r.rejected_by) for r in quality.judge(docs, labels, params).collect()}
    for table, holdout in ((many, labels), (docs.unionByName(copies), labels.unionByName(more))):
        got = {r.doc_id: (r.kept, r.rejected_by) for r in quality.judge(table, holdout, params).where("doc_id < 10000").collect()}
        assert got == single
    assert any(by for _, by in single.values())


def test_null_and_empty_strata_are_apart(spark):
    docs, labels = labelled_corpus(spark, 300)
    docs = docs.withColumn("lang", F.when(F.col("lang") == "en", None).otherwise(""))
    params = quality.RiskParams(max_false_rejection=0.05)
    rows = quality.judge(docs, labels, params).collect()
    assert any(r.rejected_by for r in rows if r.stratum is None)
    assert not any(r.rejected_by for r in rows if r.stratum == "")


def test_cases_without_labels_rows_or_names(spark):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    kept = quality.keep_good(documents(spark, clash=True), labels)
    assert kept.columns == documents(spark, clash=True).columns
    by_rule = [r for r in hard_rows() if (s := brute(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert plain(kept.select("doc_id", "text", "lang", "source", "n_chars").collect()) == plain(by_rule)
    assert {r.kept for r in kept.collect()} == {"k"}
    assert quality.judge(documents(spark, []), labels).count() == 0
    assert CLASHING


def test_labels_beyond_the_broadcast_limit(spark):
    docs, labels = labelled_corpus(spark, 300)
    a = quality.judge(docs, labels, quality.RiskParams(max_false_rejection=0.2))
    b = quality.judge(docs, labels, quality.RiskParams(max_false_rejection=0.2, broadcast_rows=0))
    assert plain(a.select("doc_id", "kept", "rejected_by").collect()) == plain(b.select("doc_id", "kept", "rejected_by").collect())
