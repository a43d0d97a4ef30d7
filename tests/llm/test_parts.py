"""The operators' parts alone."""

import random

import numpy as np
import pytest

from skyloom.llm import packing, suffix_tree_lm, toxicity
from skyloom.llm.components import components
from skyloom.llm.suffix_array import permuted_prefixes, suffix_array


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))] + [0], np.uint16)
        assert suffix_array(s, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_common_prefixes():
    data = np.frombuffer(b"abcdefghijklmnop" * 8 + b"\0", np.uint8)
    order = suffix_array(data.astype(np.uint16), 50)
    shared = permuted_prefixes(data, order, 50)
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = data[a : a + 50].tobytes(), data[b : b + 50].tobytes()
        assert (shared[b] >= 50) == (len(x) == len(y) == 50 and x == y)


def test_plans_hold_every_piece_once():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        patterns = packing.plan(histogram, 64)
        held: dict = {}
        for pattern, count in patterns:
            assert sum(pattern) <= 64
            for n in pattern:
                held[n] = held.get(n, 0) + count
        assert held == histogram
        places = packing.slots(patterns)
        assert sum(b - a for _, a, b, _, _ in places) == sum(histogram.values())


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2400)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(a, a) == find(a) for a in root)


def test_tokens_as_the_library_gives_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    from skyloom.llm.bpe import Transducer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), Transducer(path)
    rng = random.Random(4)
    parts = [" ", "  ", "'", "s", "t", "re", "ll", "d", "a", "B", "1", "é", "\n", "\t", "!", "$", "　", "the", "<|endoftext|>", "zq", "日本", "\U0001f600", "\x1c", "\x85"]
    texts = ["", "=" * 3000 + " x", "ab" * 5000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.counts(data, offsets).tolist() == [len(w) for w in want]
    ids, at = machine.ids(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_probabilities_sum_to_one(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(" ".join(words[min(39, int(rng.expovariate(0.1)))] if k % 2 else "a" for k in range(60)),) for _ in range(80)]
    train = spark.createDataFrame(rows, "text string").selectExpr("cast(text AS binary) AS text")
    model, _ = suffix_tree_lm.learnt(train)
    assert len(model.levels[0].contexts)
    base = np.log10((model.counts + 0.5) / model.scale)
    for context in model.levels[0].contexts:
        logs = suffix_tree_lm.scored(model.levels[:1], model.words, [np.full(len(model.words), context)], base)
        unknown = suffix_tree_lm.scored(model.levels[:1], np.array([12345], np.uint64), [np.array([context])], np.log10(np.array([0.5 / model.scale])))
        assert (10**logs).sum() + (10**unknown).sum() == pytest.approx(1, abs=1e-6)


def test_toxic_strings_are_found():
    rng = random.Random(8)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    bad = ["zounds", "wretch", "vermin"]
    toxic = [f"{plain(60)} {rng.choice(bad)} {plain(40)} {rng.choice(bad)} {plain(9)} {rng.choice(bad)} x".encode() for _ in range(160)]
    fine = [plain(100).encode() for _ in range(400)]
    model = toxicity.fit(toxic[:80], fine[:200], toxic[80:120], fine[200:300])
    scorer = toxicity.Scorer(model)
    score = lambda texts: scorer.score(*toxicity.joined(texts))
    assert (score(toxic[120:]) >= 0.7).mean() > 0.9 and (score(fine[300:]) >= 0.7).mean() < 0.03


def test_rare_toxic_vocabulary_is_found():
    """A language with few toxic texts, that only repeat a joint of syllables, beside one with plain insults."""
    rng = random.Random(9)
    plain = lambda n, letters: [("".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))) for _ in range(n)]
    mixed = lambda words, extra: " ".join(rng.sample(words + extra, len(words + extra))).encode()
    insults = lambda: mixed(plain(90, "abcdefgh"), ["zounds", "wretch", "vermin"] * 2)
    joints = lambda: mixed(plain(90, "qrstuvwx"), [f"{w}yqzrqyzzq{w}" for w in plain(7, "qrstuvwx")])
    toxic = lambda n: [insults() for _ in range(n * 5)] + [joints() for _ in range(n)]
    fine = lambda n: [" ".join(plain(96, rng.choice(["abcdefgh", "qrstuvwx"]))).encode() for _ in range(n)]
    scorer = toxicity.Scorer(toxicity.fit(toxic(20), fine(400), toxic(20), fine(400)))
    score = lambda texts: scorer.score(*toxicity.joined(texts))
    assert (score([joints() for _ in range(60)]) >= 0.7).mean() > 0.9
    assert (score([insults() for _ in range(60)]) >= 0.7).mean() > 0.9 and (score(fine(200)) >= 0.7).mean() < 0.03


def test_every_window_is_compressed_under_both_dictionaries():
    model = toxicity.Model(toxic=b"quite another vocabulary than that of ordinary text", ordinary=b"ordinary text of the plain kind")
    scorer, seen = toxicity.Scorer(model), {"toxic": [], "ordinary": []}
    for name, windows in seen.items():
        squeeze = getattr(scorer, name)
        setattr(scorer, name, lambda w, squeeze=squeeze, windows=windows: windows.append(w) or squeeze(w))
    texts = [b"", b"short", bytes(range(48, 96)) * 10, b"nothing that any dictionary holds 0123456789" * 5]
    evidence = scorer.evidence(*toxicity.joined(texts))
    over = toxicity.WINDOW - toxicity.STEP
    want = [t[k : k + toxicity.WINDOW] for t in texts if t for k in range(0, max(1, len(t) - over), toxicity.STEP)]
    assert seen["toxic"] == seen["ordinary"] == want and evidence[0] == 0


def test_held_out_toxicity(spark):
    from skyloom.llm import registry

    folder = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in registry.op2_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in rows if y == 0], [s for s, y in rows if y == 1]
    assert sum(s >= 0.7 for s in good) / len(good) < 0.05
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(good) / len(bad) > 0.7


def test_written_tables_can_be_discarded(spark):
    from skyloom.llm.common import discard, written

    frame = written(spark.range(10), "ten")
    folder = frame.inputFiles()[0]
    assert frame.count() == 10 and discard(spark) > 0 and discard(spark) == 0
    assert not __import__("os").path.exists(folder.removeprefix("file://"))


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies with up to three changed words, and others just below the limit to all of them: none is lost, and the pairs made follow the documents, not their square."""
    import brute

    from skyloom.llm import jaccard

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    texts = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(150), (0, 1, 2, 3, 4, 4, 5)[k % 7]):
            words[at] = "".join(rng.choice("qrstuvwx") for _ in range(6))
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    made = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(jaccard, "HOT_ROWS", 20)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = sorted(brute.op10(docs))
    assert got == want
    assert len({r[2] for r in want}) > 50 and max(sum(1 for r in want if r[2] == c) for c in {r[2] for r in want}) > 100
    assert sum(made) < 5 * len(docs)


def test_parities_never_hide_a_link():
    from skyloom.llm.jaccard import PARITY, parities

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in rng.integers(1, 2500, 60)]
    at = np.cumsum([0, *map(len, sets)])
    bits = np.unpackbits(parities(np.concatenate(sets), at).view(np.uint8), axis=1)
    assert bits.shape == (60, PARITY)
    assert all((bits[i] != bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j])) for i in range(60) for j in range(i))


def test_factors_agree_with_their_sources(spark):
    """Every factor is a stretch of its text that another place holds, too; factors and the words between them tile the text."""
    from skyloom.llm import substring

    rng = random.Random(31)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [some(n) for n in (36, 50, 90, 300)]
    texts = [" ".join(w for _ in range(3) for w in (*some(rng.randrange(40)), *rng.choice(passages)[: rng.randrange(30, 301)])) for _ in range(40)]
    texts += [texts[0], "a b " * 80, "spam " * 90]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "owner long, text string").selectExpr("owner", "cast(text AS binary) AS text")
    factors = substring.factored(substring.index_rows(frame, 35, 8, 7), 35).collect()
    words = [t.split() for t in texts]
    hit = [set() for _ in texts]
    for f in factors:
        n = f["end"] - f["start"]
        assert n >= 35 and (f["owner"], f["start"]) != (f["source"], f["source_start"])
        assert words[f["owner"]][f["start"] : f["end"]] == words[f["source"]][f["source_start"] : f["source_start"] + n]
        hit[f["owner"]].update(range(f["start"], f["end"]))
    places: dict = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 34):
            places.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    want = [set() for _ in texts]
    for found in places.values():
        for i, k in found if len(found) > 1 else ():
            want[i].update(range(k, k + 35))
    assert hit == want and sum(map(len, want)) > 3000
    assert any(f["end"] - f["start"] > 45 for f in factors)


def test_long_labelled_texts_are_read_from_all_over(spark):
    long = "".join(f"{k:07d}." for k in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "short é"), (3, None), (4, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, "false")
    texts = sorted((t for v in found.values() for t in v), key=len)
    assert texts[:2] == [b"plain", "short é".encode()] and len(texts) == 3
    piece, n = toxicity.PIECE, toxicity.MOST_BYTES // toxicity.PIECE
    assert len(texts[2]) == n * piece + n - 1
    assert texts[2][:piece] == long[:piece].encode() and texts[2][-piece:] == long[-piece:].encode() and texts[2][40 * (piece + 1) :][:9] in long.encode()


def test_evidence_and_threshold_of_toxicity_by_brute_force():
    """Every window compressed anew by a compressor of its own, and the threshold tried at every place between two texts."""
    import zstandard

    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    fine = [" ".join(word("abcdefgh") for _ in range(rng.randint(0, 60))).encode() for _ in range(240)]
    toxic = [" ".join(rng.choice([word("abcdefgh"), "zounds", "wretch"]) for _ in range(60)).encode() for _ in range(80)]
    lists = toxic[:40], fine[:120], toxic[40:], fine[120:]
    model = toxicity.fit(*lists)

    def length(content: bytes, window: bytes) -> int:
        content = content.ljust(16)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=toxicity.WINDOW, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    def evidence(m, text: bytes) -> float:
        starts = [k for k in range(0, len(text), toxicity.STEP) if k == 0 or k + toxicity.WINDOW - toxicity.STEP < len(text)]
        gains = [max(0, length(m.ordinary, text[k : k + toxicity.WINDOW]) - length(m.toxic, text[k : k + toxicity.WINDOW]) - toxicity.PARSING) for k in starts] if text else []
        return sum(gains) / len(gains) ** toxicity.BY_WINDOWS if gains else 0.0

    texts = [b"", b"x", toxic[0], fine[0], toxic[3] + b" " + fine[5], *fine[20:26]]
    found = toxicity.Scorer(model).evidence(*toxicity.joined(texts))
    assert np.allclose(found, [evidence(model, t) for t in texts])
    half = toxicity.PARTS // 2
    parts = [(t[k::half], o[k::half]) for t, o in (lists[:2], lists[2:]) for k in range(half)]
    tried = []
    for k, (t, o) in enumerate(parts):
        others = toxicity.dictionaries(*([x for j, q in enumerate(parts) if j != k for x in q[y]] for y in (0, 1)))
        tried += [(evidence(others, x), y) for y, xs in ((True, t), (False, o)) for x in xs]
    errors = lambda cut: sum((e > cut) != y for e, y in tried)
    values = sorted({e for e, _ in tried})
    best = min(errors(c) for c in [values[0] - 1, *((a + b) / 2 for a, b in zip(values[:-1], values[1:], strict=True)), values[-1] + 1])
    assert errors(model.at) == best
    scores = toxicity.Scorer(model).score(*toxicity.joined(texts))
    assert all((s >= 0.7) == (e >= model.at) for s, e in zip(scores, found, strict=True))


def test_transducer_keeps_a_bounded_table(monkeypatch):
    from skyloom.llm import bpe
    from skyloom.llm.registry import tokenizer_path
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "DENSE", 64)
    library, machine = Tokenizer.from_file(tokenizer_path()), bpe.Transducer(tokenizer_path())
    draw = np.random.default_rng(5)
    texts = ["".join(map(chr, draw.integers(32, 0x180, 400))) + " and the like, \u9f8d\u4e2d " * 3 for _ in range(8)]
    for some in (texts[:3], texts):  # more than 128 different bytes: the table is widened once
        raw = [t.encode() for t in some]
        ids, at = machine.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert len(machine.keys) > 1000 and len(machine.table) <= 64


def test_workers_give_transducers_up():
    from skyloom.llm import arrow, bpe

    bpe._COMPILED["x"] = None
    assert list(arrow.releasing(iter, tokens=True)([1, 2])) == [1, 2] and "x" in bpe._COMPILED
    assert list(arrow.releasing(iter)([1])) == [1] and not bpe._COMPILED


def test_known_small_tables_go_into_few_files(spark):
    from skyloom.llm import common

    links = spark.createDataFrame([(k, k // 2) for k in range(1, 200)], "u long, v long").repartition(97, "u")
    table = common.written(links, "links", 199)
    assert len(table.inputFiles()) <= spark.sparkContext.defaultParallelism < 97 and table.count() == 199
    roots = {r["u"]: r["root"] for r in components(links.where("u <> 1")).collect()}
    assert len(components(links).inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert roots[199] == 1 and set(roots) == set(range(1, 200))
