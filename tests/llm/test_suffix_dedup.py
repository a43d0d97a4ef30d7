"""What of the substring dedup's work grows faster than the input: windows that only share a short gram, and whole copies."""

import hashlib
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from skyloom.llm import suffix_dedup  # noqa: E402

GRAM = "a common gram of"


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def sides(rng, n, least=35):
    """n texts with one gram at many places, and nothing else in common."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    return ["".join("".join(rng.choice(letters) for _ in range(rng.randrange(least, 60))) + GRAM for _ in range(8)) for _ in range(n)]


def open_windows(spark, docs):
    """The rows that are left for the suffix arrays."""
    source = frame(spark, docs).selectExpr("doc_id as doc", "hash(text) as tag", "cast(text as binary) as text")
    rows = suffix_dedup.run_rows(source, suffix_dedup.WINDOW, suffix_dedup.GRAM, 4)
    return suffix_dedup.compared(rows, suffix_dedup.WINDOW).where("anchor is not null").collect()


def test_a_shared_gram_alone_is_not_compared(spark):
    """In a large corpus most grams occur elsewhere; windows that share no side of theirs have no way into the suffix arrays."""
    assert len(GRAM) == suffix_dedup.GRAM
    texts = sides(random.Random(1), 150)
    assert open_windows(spark, list(enumerate(texts))) == []
    # A common side brings its windows in, and no others.
    phrase = f"{GRAM}, and then eighteen more"
    shared = [t.replace(GRAM, phrase, 1) for t in texts]
    found, at = open_windows(spark, list(enumerate(shared))), [t.index(phrase) for t in shared]
    common = [min(r["end"], at[r["doc"]] + len(phrase)) - max(r["start"], at[r["doc"]]) for r in found]
    assert len({r["doc"] for r in found}) > 100 and min(common) >= suffix_dedup.GRAM + 17


def test_whole_copies_are_not_hashed_again(spark, monkeypatch):
    """A text that a lesser document has as a whole makes no runs, and is removed."""
    texts = sides(random.Random(2), 40)
    docs = [(k, t) for k, t in enumerate(texts)] + [(100 * c + k, t) for c in range(1, 6) for k, t in enumerate(texts)] + [(700, "short"), (701, "short"), (None, texts[0]), (None, texts[0]), (0, texts[0])]
    hashed, before = [], suffix_dedup.run_rows
    monkeypatch.setattr(suffix_dedup, "run_rows", lambda source, *a: hashed.append(source.count()) or before(source, *a))
    rows = suffix_dedup.repeated_bytes(frame(spark, docs)).collect()
    got = sorted((2**63 if r["id"] is None else r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
    assert got == sorted((2**63 if i is None else i, *x) for i, *x in brute.op1(docs))
    assert hashed == [40 + 1 + 2]  # id 0's second row isn't a copy of a lesser document, short texts have no window


def test_more_copies_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    texts = sides(random.Random(3), 20)
    docs = list(enumerate(texts + texts + texts))
    rows = suffix_dedup.repeated_bytes(frame(spark, docs)).collect()
    assert sorted((r["id"], r["n_removed"]) for r in rows) == sorted((r[0], r[2]) for r in brute.op1(docs))


@pytest.mark.parametrize("window, gram", [(50, 16), (40, 8), (18, 16), (17, 16), (64, 32), (100, 2)])
def test_periodic_texts_and_other_lengths(spark, window, gram):
    """Runs with their gram at several places, texts cut from common passages at any place, ties of ids, against brute force."""
    rng = random.Random(window)
    pool = ["".join(rng.choice("abc") for _ in range(rng.choice([20, 35, 49, 50, 51, 60, 90]))) for _ in range(8)] + ["ab" * 60, "x" * 130]
    docs = [(rng.randrange(100), "".join(rng.choice(pool)[: rng.randrange(10, 100)] for _ in range(rng.randrange(7)))) for _ in range(120)]
    rows = suffix_dedup.repeated_bytes(frame(spark, docs), window=window, gram=gram).collect()
    got = sorted((r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
    assert got == sorted(brute.op1(docs, window))
