"""Fill-in-middle, URL filters and source divergence against brute force, over odd rows."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from skyloom.llm import divergence, fill_in_middle, registry, url_filter  # noqa: E402

BAD = "cast(X'61FF0A62' as string)"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# -- fill in middle --------------------------------------------------------------------------------------------------
EXTRA = ["\n", "\n\n\n", "a\nb", "a\nb\n", "x\r\ny\u2028z\n", "one <P> two\n", "<S>", "<M>\n<M>", "<\nP>\n<S\n>", "ends with <\nS> begins\nP>", "nul \x00 in\nline\n", "é\n日本\n🙂\n" * 40, "l\n" * 30_000, "'quote' || %s $1 \\0\n\\\n"]


def test_fill_in_middle(spark, folder, documents):
    assert ordered(tuple(r) for r in registry.op11_fill_in_middle(spark, folder).collect()) == ordered(brute.op11(documents))


@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_in_middle_forms(spark, percent, spm):
    docs = [(k, t) for k, t in enumerate(EXTRA * 6)] + [(3, EXTRA[3]), (None, EXTRA[2]), (None, None), (5, "")]
    frame = spark.createDataFrame([(t, i, "x", "x", 1) for i, t in docs], "text string, doc_id long, id string, form string, slice int")
    rows = fill_in_middle.fill_in_middle(frame, percent=percent, spm_percent=spm).collect()
    want = brute.op11(docs, 7, percent, spm)
    assert ordered((*r[:5], brute.hexed(r["output"]), brute.hexed(r["restored"])) for r in rows) == ordered(want)
    assert {r["form"] for r in rows} == ({"plain"} if not percent else {"plain", "spm"} if spm == 100 else {"plain", "psm"} if not spm else {"plain", "psm", "spm"})


def test_fill_in_middle_of_a_long_text_and_of_bad_bytes(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc\n\n ") for _ in range(6_000_000))
    assert ordered(tuple(r)[:3] for r in fill_in_middle.fill_in_middle(spark.createDataFrame([(1, long), (2, "x" * 6_000_000)], "doc_id long, text string")).select("id", "n", "form", "restored").collect()) == ordered(r[:3] for r in brute.op11([(1, long), (2, "x" * 6_000_000)]))
    got = fill_in_middle.fill_in_middle(spark.sql(f"SELECT 1L AS doc_id, {BAD} AS text")).first()
    assert (got["n"], got["restored"]) == (2, "a\ufffd\nb")


# -- URL filters -----------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.ORG/es/1", "http://example.org/en/1", "http://example.org/en/2", "http://xexample.org/es/", "http://a.b.example.org/es/q?x#y", "http://example.org", "http://example.org?a=/es/", "http://example.org#/", "http://org/", "http://.org/x", "http://a.com/fr/", "http://a.com/fr", "http://a.com/FR/", "http://a.com/de/x?y", "http://a.com.net/de/", "http://ÉX.com/de/é", "a://b://c.org/", "http://a.org:80/x", "http://user@a.org/x?u=http://b.com/de/", "x" * 30_000, "http://n.net/" + "/es/" * 3000]


def pages_of(spark, folder, urls):
    spark.createDataFrame([(f"html {k}", u, k % 997, "x") for k, u in enumerate(urls)], "html string, url string, page_id long, host string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def some_urls(n, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    return [f"http{rng.choice(['', 's'])}://{word(4)}{rng.choice(['.example', '', '.x'])}.{rng.choice(['org', 'com', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(2000)}{rng.choice(['', '?q=1', '#top'])}" for _ in range(n)] + [f"http://example.org/{rng.choice(['es/', 'en/1'])}{word(3)}" for _ in range(n // 9)]


def test_url_filters_against_dictionaries(spark, tmp_path):
    urls = URLS + some_urls(900, 2) + some_urls(30, 2) * 3
    rows = registry.op12_url_filters(spark, pages_of(spark, tmp_path, urls)).collect()
    facts = [brute.op12_rules(u, url_filter.RULES) for u in urls]
    assert ordered(tuple(r)[:4] for r in rows) == ordered((k % 997, *f[:3]) for k, f in enumerate(facts))
    # Which URLs are fitted on is the engine's hash: asked of Spark, the rest is plain Python.
    ruled = sorted({(u, f[3]) for u, f in zip(urls, facts, strict=True) if f[3]})
    folds = {r[0]: r[1] for r in spark.createDataFrame(ruled, "url string, v string").select("url", url_filter.fold().alias("f")).collect()}
    models = [brute.op12_model([u.encode() for u, v in ruled if v == verdict and folds[u]], url_filter.ORDER) for verdict in ("allow", "block")]
    score = {u: brute.op12_score(u.encode(), *models, url_filter.ORDER) for u in {u or "" for u in urls}}
    got = {(r["page_id"], r["host"], r["path"]): r for r in rows}
    tried = [(score[u], f[3]) for u, f in zip(urls, facts, strict=True) if f[3] and not folds[u]]
    steps = [math.floor(s * url_filter.STEPS) for s, _ in tried]
    n = {v: sum(x == v for _, x in tried) for v in ("allow", "block")}
    loss = lambda t: sum(v == "allow" and math.floor(s * url_filter.STEPS) >= t for s, v in tried) * n["block"] + sum(v == "block" and math.floor(s * url_filter.STEPS) < t for s, v in tried) * n["allow"]
    limit = min((loss(t), abs(t), t) for t in range(min(0, *steps), max(0, *steps) + 2))[2] / url_filter.STEPS
    for k, (u, f) in enumerate(zip(urls, facts, strict=True)):
        r = got[(k % 997, f[0], f[1])]
        if f[3]:
            assert r["verdict"] == f[3] and r["score"] is None
        else:
            assert math.isclose(r["score"], score[u or ""], rel_tol=1e-9, abs_tol=1e-12) or sum(x % 997 == k % 997 for x in range(len(urls))) > 1
            assert abs(r["score"] - limit) < 1e-9 or r["verdict"] == ("block" if r["score"] >= limit else "allow")


def test_url_filters_tell_held_out_urls_apart(spark, tmp_path):
    """Words of blocked URLs under other hosts are blocked, those of allowed ones aren't."""
    rng = random.Random(5)
    bad, fine = ["pills", "casino", "bets"], ["news", "garden", "music"]
    make = lambda host, words, n: [f"http://{host}/{'/'.join(rng.choices(words, k=3))}/{rng.randrange(10**6)}" for _ in range(n)]
    rules = [("block", "bad.com/"), ("allow", "good.com/")]
    urls = make("bad.com", bad, 400) + make("good.com", fine, 400) + make("other.net", bad, 300) + make("other.net", fine, 300)
    rows = url_filter.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    right = [r["verdict"] == ("block" if 800 <= r["id"] < 1100 else "allow") for r in rows if r["id"] >= 800]
    assert len(right) == 600 and np.mean(right) > 0.97


def test_url_filters_without_a_model(spark, tmp_path):
    rows = registry.op12_url_filters(spark, pages_of(spark, tmp_path / "a", ["http://a.org/", None, "http://b.net/x"])).collect()
    assert sorted((r["rule"] or "", r["verdict"], r["score"]) for r in rows) == [("", "allow", None), ("", "allow", None), ("org/", "allow", None)]
    assert registry.op12_url_filters(spark, pages_of(spark, tmp_path / "b", [])).collect() == []


def test_fitting_is_bounded(spark):
    rows = url_filter.judged(spark.createDataFrame([(k, f"http://h{k % 5000}.org/") for k in range(20_000)], "page_id long, url string"), url_filter.RULES, "page_id", "url")
    few = url_filter.fit_rows(rows, "allow", 300, 1 << 20)
    assert len(few) == len(set(few)) == 300
    assert sum(map(len, url_filter.fit_rows(rows, "allow", 300, 1000))) <= 1000


def test_url_models_count_every_url(spark):
    """More URLs of a verdict than were once read to fit."""
    urls = [f"http://a.org/{k}" for k in range(14_500)] + [f"http://a.com/de/{k}" for k in range(40)] + ["http://b.net/x", "ftp://b.net/777", ""]
    rows = {r["id"]: r["score"] for r in url_filter.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    folds = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.fold()).collect()]
    models = [brute.op12_model([u.encode() for u, f in zip(urls, folds, strict=True) if host in u and f], url_filter.ORDER) for host in ("a.org", "a.com")]
    for k in range(len(urls) - 3, len(urls)):
        assert math.isclose(rows[k], brute.op12_score(urls[k].encode(), *models, url_filter.ORDER), rel_tol=1e-9)


@pytest.mark.parametrize("model_bytes", [0, 40 * 500])
def test_joined_orders_score_as_broadcast_ones(spark, model_bytes):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS + some_urls(300, 3) + some_urls(20, 3))], "page_id long, url string")
    want, got = (sorted(url_filter.filtered(pages, **x).collect()) for x in ({}, {"model_bytes": model_bytes}))
    assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want]
    assert np.allclose([r["score"] for r in got if r["score"] is not None], [r["score"] for r in want if r["score"] is not None], rtol=1e-9, atol=1e-12)
    assert [r["score"] is None for r in got] == [r["score"] is None for r in want] and any(r["score"] for r in got)


def test_threshold():
    assert url_filter.threshold_of({}) == url_filter.threshold_of({5: (3, 0)}) == url_filter.threshold_of({5: (0, 3)}) == 0
    assert url_filter.threshold_of({-50: (9, 0), 30: (0, 1), 80: (0, 4)}) == 0
    assert url_filter.threshold_of({10: (9, 0), 30: (0, 1), 80: (0, 4)}) == 0.011
    assert url_filter.threshold_of({-90: (9, 0), -30: (0, 1), 80: (0, 4)}) == -0.03
    assert url_filter.threshold_of({-50: (9, 1), 10: (1, 9), 20: (0, 0)}) == 0


# -- source divergence -----------------------------------------------------------------------------------------------
def divergence_rows(n_sources, n_docs, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(90)] + ["日本", "Ünd", "und", "UND", "ß", "🙂x"]
    rows = []
    for k in range(n_docs):
        source = f"s{min(rng.randrange(n_sources), rng.randrange(n_sources))}"
        words = [rng.choice(vocabulary[: 20 + 5 * (int(source[1:]) % 16)]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "fr", None, ""]), source if k % 9 else None, "".join(w + rng.choice([" ", "-", "3", "\n", "\x00", "_"]) for w in words)))
    return rows + [("en", "empty", ""), ("en", "nulls", None), ("xx", "one", "alone"), ("yy", "a", "rare"), ("yy", "b", None), ("fr", "long", "abc déf " * 90_000)]


def frame_of(spark, rows):
    return spark.createDataFrame([(s, t, x, "q", 1, "v") for x, s, t in rows], "source string, text string, lang string, term string, n int, shard string").repartition(5)


def test_source_divergence(spark):
    rows = divergence_rows(23, 900)
    assert ordered(tuple(r) for r in divergence.divergence(frame_of(spark, rows)).collect()) == ordered(brute.op13(rows))


def test_source_divergence_in_many_blocks_and_shards(spark, monkeypatch):
    """Blocks of one and two groups, shards of a few terms, several jobs of rounds, counts of slices of a few texts."""
    for name, value in {"LEAST_GROUPS": 1, "MOST_BLOCKS": 11, "ENTRIES": 30, "ROUNDS_A_JOB": 3, "SLICE_BYTES": 500}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = divergence_rows(20, 600, 8)
    assert ordered(tuple(r) for r in divergence.divergence(frame_of(spark, rows)).collect()) == ordered(brute.op13(rows))


def test_source_divergence_of_nothing_and_of_bad_bytes(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    bad = spark.sql(f"SELECT 'en' AS lang, 's' || (id % 2) AS source, {BAD} AS text FROM range(80)")
    assert sorted(tuple(r) for r in divergence.divergence(bad).collect()) == sorted(brute.op13([("en", f"s{k % 2}", "a\ufffd\nb") for k in range(80)]))


@pytest.mark.parametrize("blocks", range(1, 9))
def test_every_pair_of_blocks_meets_once(spark, blocks):
    rows = [("x", f"g{b}", 0, 1, 5, None, b, blocks) for b in range(blocks)]
    groups = spark.createDataFrame(rows, "lang string, source string, shard int, size long, whole long, vector binary, block int, blocks int")
    met = [(int(r["source"][1:]), r["block"]) for first in range(0, divergence.seats(blocks), 2) for r in divergence.rounds(groups, first, 2).collect()]
    assert sorted(met) == sorted((a, b) for a in range(blocks) for b in range(a))


def test_shares_are_exact():
    for whole in (7, 10**6 + 3, 8_999_999_999_999_989):
        counts = np.array([0, 1, 2, whole - 6])
        assert divergence.share(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]
