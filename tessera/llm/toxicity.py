"""Toxicity: a sparse logistic model over words and word beginnings, regularised by counterfactual swaps of identity terms.

In a labelled sentence an identity term is swapped for each other term of its group, and the change of the score that
this makes is penalised. Terms that no labelled sentence has get a generated sentence for each pair: in a linear model
the words around a term cancel out of the change.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD, lean, parts, table, written

BUCKETS = 1 << 22
#: Lengths of word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows that a model is fitted on at most: those of the smallest hashes of doc_id.
MAX_TRAINING_ROWS = 12_000
#: Words whose features a worker remembers; beyond that many it starts anew.
REMEMBERED = 300_000
#: Weight of the penalty on the changes that swaps make.
COUNTERFACTUAL = 1.0
#: Weight of the penalty on absolute weights; texts that a bucket must be found in.
L1 = 1e-4
MIN_DOCUMENTS = 4
# Identity terms; those of one line take each other's place. English, German, French, Spanish.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transgender"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("gays", "lesbianas", "heterosexuales", "bisexuales", "transgénero"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
)

_find = re.compile(WORD).findall


def words_of(text: str | None) -> set[str]:
    """The distinct words, with A-Z lower-cased."""
    return set(_find(text.translate(_FOLD))) if text else set()


_FOLD = {c: c + 32 for c in range(65, 91)}
_sentences = re.compile(r"[.!?\n]+").split


def features_of(word: str) -> list[int]:
    """Buckets of the word and of its beginnings."""
    names = ["w" + word, *(f"b{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh32_intdigest(n) % BUCKETS for n in names]


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def score(self, words: set[str]) -> float:
        found = {b for w in words for b in features_of(w) if b in self.weights}
        return float(_sigmoid(self.bias + sum(self.weights[b] for b in sorted(found))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def counterfactuals(words: set[str], groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(term, other term) for each identity term among a sentence's words and each term that may stand in its place."""
    return [(t, o) for group in groups for t in group if t in words for o in group if o != t]


#: Entries of a matrix that sums are taken over at once.
BLOCK = 1 << 19


class Rows:
    """Sums over a sparse 0/1 matrix whose row i has the columns col[start[i] : start[i + 1]]."""

    def __init__(self, col: np.ndarray, start: np.ndarray):
        self.col = col
        self.n = len(start) - 1
        self.full = np.flatnonzero(np.diff(start))
        self.first = start[self.full]
        # Blocks are whole rows, so that a row's sum is the same in any block.
        self.cuts = np.unique(np.append(np.searchsorted(self.first, np.arange(0, len(col), BLOCK)), len(self.first)))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each row the sum of x over its columns."""
        out = np.zeros(self.n)
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            low, high = self.first[a], self.first[b] if b < len(self.first) else len(self.col)
            out[self.full[a:b]] = np.add.reduceat(x[self.col[low:high]], self.first[a:b] - low)
        return out

    def turned(self, columns: int) -> Rows:
        """The transposed matrix; a row's columns are distinct. Each entry goes straight to its place: nothing is sorted."""
        place = np.append(0, np.cumsum(np.bincount(self.col, minlength=columns)))
        start, row = place.copy(), np.empty(len(self.col), np.int32)
        for i, low, high in zip(self.full, self.first, np.append(self.first[1:], len(self.col)), strict=True):
            at = place[self.col[low:high]]
            row[at] = i
            place[self.col[low:high]] = at + 1
        return Rows(row, start)


def tied(n: np.ndarray, toxic: np.ndarray, rows: int, rate: float, l1: float, min_documents: int) -> np.ndarray:
    """Which buckets, found in n texts and in so many toxic ones, a fit to so many rows looks at.

    The gradient at w = 0 bounds what the penalty lets in at first; weakly tied buckets would stay at 0.
    """
    return (n >= min_documents) & (np.abs(toxic - n * rate) / max(rows, 1) > l1 / 2)


def fit(
    documents: list[np.ndarray], labels: np.ndarray, swaps: dict[tuple[str, str], int], l1: float = L1, counterfactual: float | None = None, steps: int = 300, min_documents: int = MIN_DOCUMENTS
) -> Model:
    """Minimises mean logistic loss + l1 |w| + counterfactual x mean squared change of the logit under the swaps (FISTA).

    documents: the buckets of each labelled text. swaps: how often each (term, other term) pair stands in
    labelled sentences; each pair counts once more, for its generated sentence. Buckets of fewer than min_documents texts
    play no part, but for those of swapped terms. counterfactual: COUNTERFACTUAL if not given.
    """
    counterfactual = COUNTERFACTUAL if counterfactual is None else counterfactual
    y = labels.astype(float)
    if not len(y):
        return Model(0.0, {})
    n, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for d, label in zip(documents, labels.tolist(), strict=True):  # a text's buckets are distinct
        n[d] += 1
        if label:
            toxic[d] += 1
    keep = n >= min_documents
    keep[keep] = tied(n[keep], toxic[keep], len(y), y.mean(), l1, min_documents)
    del n, toxic
    pairs = [(features_of(a), features_of(b)) for a, b in sorted(swaps)]
    times = np.array([1 + swaps[pair] for pair in sorted(swaps)], float)
    for a, b in pairs:
        keep[a] = keep[b] = True
    ids = np.flatnonzero(keep).astype(np.int32)
    column = np.zeros(BUCKETS, np.int32)
    column[ids] = np.arange(len(ids))
    start = np.append(0, np.cumsum([np.count_nonzero(keep[d]) for d in documents]))
    col = np.empty(start[-1], np.int32)
    for d, low, high in zip(documents, start[:-1], start[1:], strict=True):
        col[low:high] = column[d[keep[d]]]
    by_row = Rows(col, start)
    by_col = by_row.turned(len(ids))
    swap_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    swap_col = column[np.array([x for a, b in pairs for x in (*a, *b)], np.int64)]
    swap_sign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    length = np.diff(start) + 1.0
    del column, keep

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        off = _sigmoid(by_row.sums(w) + bias) - y
        g = by_col.sums(off) / len(y)
        if len(pairs):
            change = np.bincount(swap_row, w[swap_col] * swap_sign, len(pairs))
            g += 2 * counterfactual * np.bincount(swap_col, (times * change)[swap_row] * swap_sign, len(ids)) / times.sum()
        return g, off.mean()

    # A step for each column after its own curvature bound; the bound holds as each row's sum is bounded by its length.
    bound = 0.25 * by_col.sums(length) / len(y) + 1e-9
    if len(pairs):
        bound += 2 * counterfactual * np.bincount(swap_col, (times * np.bincount(swap_row, minlength=len(pairs)))[swap_row], len(ids)) / times.sum()
    bias_bound = 0.25 * length.mean()
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = bias_z = float(np.log(rate / (1 - rate)))
    w = z = np.zeros(len(ids))
    t = 1.0
    for _ in range(steps):
        g, gb = gradient(z, bias_z)
        new = z - g / bound
        new = np.sign(new) * np.maximum(0, np.abs(new) - l1 / bound)
        new_bias = bias_z - gb / bias_bound
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, bias_z = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return Model(float(bias), {int(ids[k]): float(w[k]) for k in np.flatnonzero(w)})


def _buckets(text: str | None) -> np.ndarray:
    return np.unique(np.array([b for w in words_of(text) for b in features_of(w)], np.int32))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n, toxic): in how many of a batch's texts with and without the label."""
    for batch in batches:
        found = {True: [np.zeros(0, np.int32)], False: [np.zeros(0, np.int32)]}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[bool(label)].append(_buckets(text))
        for label, texts in found.items():
            bucket, n = np.unique(np.concatenate(texts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n), pa.array(n * label)], ["bucket", "n", "toxic"])


def _features(kept: np.ndarray, groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, swaps = [], []
            for text in batch.column(1).to_pylist():
                b = _buckets(text)
                buckets.append(b[kept[b]])
                swaps.append([f"{a} {o}" for sentence in _sentences(text or "") for a, o in counterfactuals(words_of(sentence), groups)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(buckets, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.string()))], ["label", "buckets", "swaps"]
            )

    return run


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, label: str) -> DataFrame:
    """(label, text) of at most max_rows labelled rows: those first by hash of doc_id, doc_id, label and hash of the text."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    # max_rows rows at most: a broadcast of a bounded size.
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.xxhash64("text").alias("k"))
    rows = written(docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("label", "text", place.alias("place")), "labelled")
    if rows.count() > max_rows:  # a doc_id stands on several rows
        cut = rows.select("place").orderBy("place").limit(max_rows).agg(F.max("place").alias("place")).first()[0]
        last = F.struct(*[F.lit(cut[c]).alias(c) for c in ("h", "doc_id", "label", "k")])
        before = rows.where(F.col("place") < last)
        # Rows of that place are alike.
        rows = before.unionByName(rows.where(F.col("place") == last).limit(max_rows - before.count()))
    return rows.select("label", "text")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, label: str = "toxic", groups=IDENTITY_TERMS) -> Model:
    """Fits a model on at most max_rows labelled texts, see sampled(), whatever the order of rows.

    Rows with a null doc_id or label are left out; a null text is empty; of repeated rows each counts. groups: the
    identity terms that take each other's place. Buckets are counted by the executors, and those that fit()
    would leave out stay there.
    """
    rows = sampled(docs, labels, max_rows, label)
    counted = rows.mapInArrow(lean(_counts), "bucket int, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    size, rate = rows.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.0))).first()
    # BUCKETS flags at most, of a bounded sample.
    kept = np.zeros(BUCKETS, bool)
    counts = counted.where(F.col("n") >= MIN_DOCUMENTS).toArrow()
    bucket, n, toxic = (np.asarray(counts[c]) for c in ("bucket", "n", "toxic"))
    kept[bucket[tied(n, toxic, size, rate, L1, MIN_DOCUMENTS)]] = True
    del counts, bucket, n, toxic
    for group in groups:
        for term in group:
            kept[features_of(term)] = True
    got = rows.mapInArrow(lean(_features(kept, groups)), "label int, buckets array<int>, swaps array<string>").toArrow()
    documents = [np.asarray(x.values) for part in got["buckets"].chunks for x in part]
    swaps = Counter({(t, o): 0 for group in groups for t in group for o in group if o != t})
    swaps.update(tuple(x.split(" ")) for part in got["swaps"].chunks for x in part.flatten().to_pylist())
    label = np.asarray(got["label"])
    # In an order of their own, so that sums round alike wherever the rows come from.
    order = sorted(range(len(documents)), key=lambda i: (label[i], xxhash.xxh128_digest(documents[i])))
    return fit([documents[i] for i in order], label[order], swaps)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a score between 0 and 1 for the whole text; null and empty texts get the model's bias alone."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")
    weights, bias, names = model.weights, model.bias, [*docs.columns, name]

    class Known(dict):
        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found = tuple(b for b in features_of(word) if b in weights)
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in parts(batches):
            logits = []
            for text in batch.column(at).to_pylist():
                found = set().union(*filter(None, map(known.__getitem__, words_of(text))))
                logits.append(bias + sum(weights[b] for b in sorted(found)))
            scores = pa.array(_sigmoid(np.array(logits)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    return docs.mapInArrow(lean(run), schema)


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels), "score")
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
