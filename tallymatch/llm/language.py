"""Language identification by nearest centroid.

Texts become counts of hashed letter bigrams and trigrams (lower-cased; anything but letters is one space), weighted by
log(1 + tf) and inverse document frequency and scaled to length one. Document frequencies are counted over all documents to
learn from; each language's centroids come from spherical k-means over a bounded sample of its documents. A text gets the
language of the centroid that is nearest by cosine; it is rejected if even that one is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, summed, table
from .shingles import parts

#: Hashed dimensions; centroids of a language; sampled documents of a language and of all, at most.
DIMS, CENTROIDS, SAMPLE, SAMPLE_ALL = 4096, 4, 1500, 12_000
#: Cosine distance from the nearest centroid beyond which a text is rejected.
MAX_DISTANCE = 0.95
_letter: np.ndarray | None = None
_U = np.uint32


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letter


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed bigrams and trigrams; None for a text without letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, _U(32))
    keep = np.empty(len(code), bool)
    keep[0] = True
    np.logical_or(is_letter[1:], is_letter[:-1], out=keep[1:])
    c = np.empty(int(keep.sum()) + 2, np.uint32)
    c[0] = c[-1] = 32
    c[1:-1] = code[keep]
    two = c[:-1] * _U(0x9E3779B1) ^ c[1:] * _U(0x85EBCA77)
    three = two[:-1] * _U(0xC2B2AE3D) ^ c[2:] * _U(0x27D4EB2F)
    both = np.concatenate([two, three])
    both ^= both >> _U(15)
    both *= _U(0x2C1B3C6D)
    return np.bincount(both >> _U(32 - DIMS.bit_length() + 1), minlength=DIMS)


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  # of unit length, one a row
    langs: list[str]  # of each centroid

    def predict(self, text: str | None) -> tuple[str | None, float]:
        """The nearest centroid's language and its cosine; None for a text without letters."""
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return None, 0.0
        x = unit(counts, self.idf)
        cos = self.centroids @ x
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best])))


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    size = np.sqrt((x * x).sum())
    return x / size if size else x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language: documents, and documents by dimension (as one row of fixed size a task and language)."""
    seen: dict[str, list] = {}
    for batch in (x for whole in batches for x in parts(whole, 0)):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = gram_counts(text)
            if counts is not None:
                own = seen.setdefault(lang, [0, np.zeros(DIMS, np.int64)])
                own[0] += 1
                own[1] += counts > 0
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1].tobytes() for x in seen.values()], pa.binary())], schema=pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("df", pa.binary())]))


def _sum(t: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x, np.int64) for x in t.column("df").to_pylist()), np.zeros(DIMS, np.int64))
    return pa.table({"lang": t.column("lang")[:1], "docs": pa.array([sum(t.column("docs").to_pylist())], pa.int64()), "df": pa.array([total.tobytes()], pa.binary())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in parts(whole, 0)):
        rows = []
        for text, lang, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = gram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts).astype(np.uint16)
                rows.append((lang, order, at.tobytes(), counts[at].astype(np.int64).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "o", "at", "n"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    centres = x.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    while len(centres) < min(k, len(x)):
        far = x[int(np.argmin((x @ centres.T).max(axis=1)))]
        centres = np.vstack([centres, far])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres[[c for c in range(len(centres)) if (own == c).any()]]


def train(documents: DataFrame, learn: Column, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL, centroids: int = CENTROIDS) -> Model:
    """Learn from the documents with a language where learn holds."""
    known = documents.where(learn & F.col("lang").isNotNull()).select("text", "lang", "doc_id")
    counted = table(known.select("text", "lang").mapInArrow(_frequencies, "lang string, docs long, df binary"), "frequencies")
    stats = summed(counted, "lang", _sum).collect()
    forget(counted)
    docs = {r["lang"]: r["docs"] for r in stats}
    if not docs:
        return Model(np.zeros(DIMS), np.zeros((0, DIMS)), [])
    df = sum(np.frombuffer(r["df"], np.int64) for r in stats)
    idf = np.log((1 + sum(docs.values())) / (1 + df)) + 1
    each = max(10, min(sample, sample_all // len(docs)))
    # about twice what is needed, by a hash of the id, then exactly that many
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    share = spark_map({lang: min(1.0, (2 * each + 50) / n) for lang, n in docs.items()})
    picked = known.withColumn("o", order).where((F.pmod("o", F.lit(1_000_003)) / 1_000_003.0) < F.element_at(share, F.col("lang")))
    rows = picked.select("text", "lang", "o").mapInArrow(_vectors, "lang string, o long, at binary, n binary").collect()
    centres, langs = [], []
    for lang in sorted(docs):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["o"], r["at"], r["n"]))[:each]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, r in enumerate(own):
            x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.int64)
            x[i] = unit(x[i], idf)
        if len(own):
            found = _kmeans(x, centroids)
            centres.append(found)
            langs += [lang] * len(found)
    return Model(idf, np.vstack(centres).astype(np.float64) if centres else np.zeros((0, DIMS)), langs)


def spark_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _predict(model, farthest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for batch in (x for whole in batches for x in parts(whole, 0)):
            found = [own.predict(t) for t in batch.column(0).to_pylist()]
            langs, scores = [f[0] or "und" for f in found], [f[1] for f in found]
            far = [f[0] is None or 1 - f[1] > farthest for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    return run


def identify(documents: DataFrame, learn: Column | None = None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Predict the language of every text; learn tells which rows to learn from (those with a null there never are).

    Returns doc_id, held_out (learn does not hold), lang_pred (the nearest centroid's language; und without letters), score
    (the cosine) and rejected (no letters, or farther than max_distance: callers may treat these as unknown). Without any row
    to learn from all is und. One row per row; an empty table gives no rows; a row for which learn is null (as by a null id) is
    neither learnt from nor held out.
    """
    learn = F.lit(True) if learn is None else learn
    held_out, learn = F.coalesce(~learn, F.lit(False)), F.coalesce(learn, F.lit(False))
    model = documents.sparkSession.sparkContext.broadcast(train(documents, learn))
    rows = documents.select("text", "doc_id", held_out.alias("held_out"))
    return rows.mapInArrow(_predict(model, max_distance), documents.select("doc_id", F.lit(False).alias("held_out"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema)
