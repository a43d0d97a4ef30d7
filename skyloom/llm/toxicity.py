"""Toxicity by compression distance: windows of a text under a dictionary of toxic and one of ordinary text.

Toxic documents are mostly ordinary text, so the toxic dictionary is the ordinary one and, before it, one trained on the
passages of toxic training documents whose grams are there significantly more often than in ordinary ones, in whatever
share of them.  The ordinary part comes last in both, as near the window as possible, so that references to it weigh the
same.  A window's gain is by how many bytes the toxic dictionary compresses it better; every window is compressed under
both, and windows are short, so that one telling word is seen.  The threshold is fitted on training documents under dictionaries that have not seen them.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Training reads at most so many labelled documents of each label (those with the least hashes of their ids); of one over MOST_BYTES, pieces of PIECE bytes from all over it, as many as make up so many bytes.
MOST_DOCS, MOST_BYTES, PIECE = 2000, 40_000, 512
WINDOW, STEP, GRAM, LEVEL = 32, 16, 6, 9
#: A gram is telling if the likelihood ratio (G) of its toxic and ordinary documents, or of those that repeat it, is over this and it is commoner in toxic ones; among a million grams few are so by chance.
TELLING = 20.0
#: Bytes of a window's gain that parsing alone may give.
PARSING = 1
#: The power of the number of windows that a text's gains are divided by: between a sum (0) and a mean (1).
BY_WINDOWS = 0.75
#: The threshold is fitted over so many parts of the labelled documents.
PARTS = 4
#: The decision's limit on the score, and the score's slope by evidence.
LIMIT, SLOPE = 0.7, 4.0


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    at: float = 4.0


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each byte on, as one number."""
    size = max(0, len(data) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | data[k : k + size]
    return out


def of(text: bytes, n: int) -> np.ndarray:
    return grams(np.frombuffer(text, np.uint8), n)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; the samples themselves where they are too few to train on."""
    import zstandard

    if len(samples) >= 50:
        try:
            return zstandard.train_dictionary(size, samples, k=48, d=6).as_bytes()[-size // 2 :]  # behind the entropy tables
        except zstandard.ZstdError:
            pass
    return b" ".join(samples)[: size // 2]


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        def squeeze(content: bytes):
            content = content.ljust(16)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

        self.toxic, self.ordinary, self.at = squeeze(model.toxic), squeeze(model.ordinary), model.at

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: the gains of all its windows over what parsing may give, by a power of the windows' number."""
        whole, toxic, ordinary = data.tobytes(), self.toxic, self.ordinary
        ends = offsets.tolist()
        out = np.zeros(len(ends) - 1)
        for t, (first, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if first == end:
                continue
            starts = range(first, max(first + 1, end - WINDOW + STEP), STEP)
            gains = 0
            for s in starts:
                w = whole[s : min(s + WINDOW, end)]
                gains += max(0, len(ordinary(w)) - len(toxic(w)) - PARSING)
            out[t] = gains / len(starts) ** BY_WINDOWS
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-SLOPE * (self.evidence(data, offsets) - self.at) - math.log(LIMIT / (1 - LIMIT))))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def likelihood_ratio(a: np.ndarray, of_a: int, b: np.ndarray, of_b: int) -> np.ndarray:
    """G of a among of_a against b among of_b; 0 where a's share isn't the larger."""
    share = (a + b) / max(1, of_a + of_b)
    term = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-12)), 0.0)
    g = 2 * (term(a, share * of_a) + term(of_a - a, (1 - share) * of_a) + term(b, share * of_b) + term(of_b - b, (1 - share) * of_b))
    return np.where(a > share * of_a, g, 0.0)


def telling_strings(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of telling grams of toxic texts, each as often as they have it."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))  # copies count once
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[of(t, GRAM) for t in toxic]]))
    if not len(known):
        return []
    seen = np.zeros((2, 2, len(known)))  # toxic or ordinary; documents that have the gram, or that repeat it
    for kind, texts in enumerate((toxic, ordinary)):
        for t in texts:
            g, c = np.unique(of(t, GRAM), return_counts=True)
            k = np.searchsorted(known, g).clip(max=len(known) - 1)
            same = known[k] == g
            seen[kind, 0, k[same]] += 1
            seen[kind, 1, k[same & (c > 1)]] += 1
    telling = known[np.maximum(*[likelihood_ratio(seen[0, r], len(toxic), seen[1, r], len(ordinary)) for r in (0, 1)]) > TELLING]
    strings = []
    for t in toxic:
        where = np.flatnonzero(np.isin(of(t, GRAM), telling))
        strings += [t[int(run[0]) : int(run[-1]) + GRAM] for run in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1) if len(run)]
    return strings


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    base = trained([t[k : k + 512] for t in ordinary for k in range(0, len(t), 512)], 16384)
    strings = telling_strings(toxic, ordinary)
    random.Random(0).shuffle(strings)  # the trainer stops at a long stretch of samples that bring nothing new
    return Model(toxic=trained(strings, 16384) + base, ordinary=base)


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_held: list[bytes], ordinary_held: list[bytes]) -> Model:
    """Dictionaries from all lists, and the threshold (fewest errors) from each part's evidence under dictionaries from the others."""
    half = PARTS // 2
    parts = [(t[k::half], o[k::half]) for t, o in ((toxic, ordinary), (toxic_held, ordinary_held)) for k in range(half)]
    found, labels = [], []
    for k, (t, o) in enumerate(parts):
        others = [q for j, q in enumerate(parts) if j != k]
        own = dictionaries(*(sum((q[y] for q in others), []) for y in (0, 1)))
        found.append(Scorer(own).evidence(*joined([*t, *o])))
        labels.append(np.arange(len(found[-1])) < len(t))
    model = dictionaries([*toxic, *toxic_held], [*ordinary, *ordinary_held])
    x, y = np.concatenate(found), np.concatenate(labels)
    if 0 < y.sum() < len(y):
        seen = np.unique(x)
        cuts = np.append((seen[1:] + seen[:-1]) / 2, seen[-1] + 1)
        errors = np.array([((x > c) != y).sum() for c in cuts])
        best = cuts[errors == errors.min()]
        model.at = float(best[len(best) // 2])
    return model


def sample(docs: DataFrame, labels: DataFrame, held_out: str, most_docs: int = MOST_DOCS) -> dict:
    """Texts by (label, fold): a bounded sample of the labelled documents that are not held out; of the rest, the folds 0 and 1 calibrate in turn dictionaries that have not seen them."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~F.expr(held_out))
    ids = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs) for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1]).select(F.col("doc_id").alias("of_doc"), "toxic")
    texts = docs.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("of_doc"))  # at most 2 most_docs rows
    raw, n = F.col("text").cast("binary"), MOST_BYTES // PIECE
    step = (F.octet_length("text") - PIECE) / F.lit(n - 1)
    # The pieces go as one text; the blanks between them are few among their bytes.
    pieces = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.hex(F.substring(raw, (i * step).cast("int") + 1, F.lit(PIECE)))), "20")
    text = F.when(F.octet_length("text") <= MOST_BYTES, raw).otherwise(F.unhex(pieces))
    rows = texts.select("toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).alias("fold"), text.alias("text")).collect()
    out: dict = {(y, k): [] for y in (0, 1) for k in (0, 1)}
    for r in rows:
        out[r["toxic"], r["fold"]].append(bytes(r["text"]))
    return {k: sorted(v) for k, v in out.items()}


def toxicity(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 3) = 1", most_docs: int = MOST_DOCS) -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.7) of every row of docs (columns doc_id and text).

    held_out is an SQL condition on doc_id: such rows' labels are not read.  Several labels of one id count as toxic if one
    is; null ids and labels other than 0 and 1 are not read.  A null or empty text has no evidence and gets the least
    score, as every text does if no label is toxic.  Rows are scored one by one, from whole texts alone.
    """
    ship(docs.sparkSession)
    texts = sample(docs, labels, held_out, most_docs)
    model = fit(texts[1, 0], texts[0, 0], texts[1, 1], texts[0, 1])

    def run(batches):
        from .arrow import slices

        scorer = Scorer(model)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                scores = scorer.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))], ["id", "score", "predicted"])

    source = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
