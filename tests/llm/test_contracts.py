"""Every query against its brute-force version, over odd rows and over empty tables."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from skyloom.llm import registry  # noqa: E402


def got(spark, name, folder):
    query = next(f for n, f in registry.queries().items() if n.startswith(f"{name}_"))
    return [tuple(r) for r in query(spark, folder).collect()]


def same(a, b):
    order = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(a, key=order) == sorted(b, key=order)


@pytest.mark.parametrize("name", ["op1", "op5", "op7", "op8", "op9", "op10"])
def test_odd_rows(spark, folder, documents, name):
    want = getattr(brute, name)(documents)
    same([r[: len(want[0])] for r in got(spark, name, folder)], want)


def test_decontamination(spark, folder, documents, benchmark_items):
    same(got(spark, "op4", folder), brute.op4(documents, benchmark_items))


def test_hosts_that_the_method_rejects_and_saves(spark, tmp_path):
    """A host of many failing documents takes its good ones with it; one of few failing ones is saved by the prior, and so is a null host."""
    import random

    import duckdb

    from conftest import prose
    from skyloom.llm import oracles, quality

    rng = random.Random(5)
    good, marked = lambda: prose(rng, 80), lambda: " ".join(f"{w} #$" for w in prose(rng, 80).split())
    hosts = ["bad"] * 60 + ["bad"] * 3 + ["few"] * 2 + ["few"] + [None] * 20 + ["plain"] * 60 + ["short"] * 40 + ["one"]
    texts = [marked() for _ in range(60)] + [good() for _ in range(3)] + [marked() for _ in range(2)] + [good()] + [good() for _ in range(19)] + [None] + [good() for _ in range(60)] + ["too short"] * 40 + [marked()]
    folder = str(tmp_path / "hosts")
    spark.createDataFrame(list(zip(range(len(texts)), texts, hosts, strict=True)), "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    rows = registry.op8_quality_rules(spark, folder).collect()
    lines = lambda t: len([x for x in (t or "").split("\n") if x.strip()])
    plain = brute.op8(list(enumerate(texts)))
    rejected = brute.host_verdicts([(h, *b[1:6], lines(t)) for h, t, b in zip(hosts, texts, plain, strict=True)], quality.HOST_LIMIT)
    assert rejected == {"bad": True, "few": False, None: False, "plain": False, "short": True, "one": False}
    want = {b[0]: (*b[1:], not b[6] and not rejected[h]) for b, h in zip(plain, hosts, strict=True)}
    assert {r[0]: tuple(r)[1:] for r in rows} == want
    assert sum(r["kept"] != (not r["base_failed"]) for r in rows) == 63  # the rejected host's documents pass the base rules
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    same([tuple(r) for r in rows], con.execute(oracles.QUALITY).fetchall())
    kept = quality.accepted(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, w in want.items() if w[-1])


def test_decontamination_by_a_shuffle(spark, folder, documents, benchmark_items):
    """The form for a benchmark too large to broadcast: the same rows, without a key that all documents share."""
    from skyloom.llm import decontamination

    frame, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = [sorted((tuple(r) for r in decontamination.contamination(frame, items, broadcast_bytes=b).collect()), key=key) for b in (0, 1 << 20)]
    assert rows[0] == rows[1] and len(rows[0]) == len(documents)


def test_language_model(spark, folder, documents):
    rows, want = got(spark, "op6", folder), brute.op6_base(documents)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    rows, want = sorted(rows, key=order), sorted(want, key=order)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert all(math.isclose(r[5], w[5], rel_tol=1e-9) for r, w in zip(rows, want, strict=True))
    assert all(r[6] <= 1e-9 and math.isfinite(r[6]) for r in rows)


def test_language_model_scores(spark, tmp_path, documents):
    """Every score against the tree of plain dictionaries, with contexts of up to five words."""
    import random

    from conftest import write

    from skyloom.llm import suffix_tree_lm as lm

    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    middle = [some(3), some(4)]  # what follows them is told by the words before them alone
    passages = [[*some(4), *middle[k % 2], *some(4)] for k in range(6)]
    mixed = lambda: " ".join(w for _ in range(6) for w in (rng.choice(passages) if rng.random() < 0.7 else rng.choices(vocabulary, k=8)))
    docs = [(k, mixed()) for k in range(250)] + [(1000 + k, t) for k, (_, t) in enumerate(documents) if t is None or len(t) < 20_000]
    got = {r[0]: r[6] for r in got_rows(spark, write(spark, tmp_path / "lm", docs))}
    want, depths = brute.op6_scores(docs, lm.DEPTH, lm.GAIN, lm.DISCOUNT, lm.SHARE)
    assert {1, 2, 4, 5} <= set(depths)
    assert all(math.isclose(got[i], s, rel_tol=1e-7, abs_tol=1e-7) for i, s in want)


def got_rows(spark, folder):
    return got(spark, "op6", str(folder))


def test_toxicity_rows(spark, folder, documents):
    rows = got(spark, "op2", folder)
    assert len(rows) == len(documents) and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in rows)


def test_packing(spark, tmp_path_factory, documents):
    from conftest import write

    docs = list(enumerate(t for _, t in documents))
    folder = write(spark, tmp_path_factory.mktemp("pack"), docs)
    assert brute.check_op3(docs, got(spark, "op3", folder)) > 0.95


def test_packing_of_repeated_rows(spark, folder, documents):
    rows = got(spark, "op3", folder)
    assert sum(r[2] for r in rows) == sum(n + 1 for _, _, n, _ in brute.op9(documents))
    assert len({(r[5], r[6]) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", [f"op{n}" for n in (*range(1, 12), 13)])
def test_empty_tables(spark, nothing, name):
    assert got(spark, name, nothing) == []
