"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.base import map_batches

UNDETERMINED = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Texts are counted together up to about this many characters.
_GROUP = 1 << 17


def text_groups(texts: list[str]) -> Iterator[list[str]]:
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= _GROUP or len(group) == 1 << 16:
            yield group
            group, held = [], 0
    if group:
        yield group


def sparse_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the hashed character n-grams of whole texts, case folded, as sparse rows: (row, bucket, count) in order of row and bucket."""
    low = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    chars = np.frombuffer(b"".join(low), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) // 4 for t in low])
    codes, keys = chars * np.uint32(0x9E3779B1), []
    for n in ORDERS:
        size = len(chars) - n + 1
        if size <= 0:
            break
        h = np.full(size, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ codes[j : j + size]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        within = rows[:size] == rows[n - 1 :]  # no n-gram reaches into the next text
        keys.append((rows[:size] << np.uint32(14) | h >> np.uint32(32 - 14))[within])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    sorted_keys = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    found = sorted_keys[starts]
    return (found >> np.uint32(14)).astype(np.int64), (found & np.uint32(BUCKETS - 1)).astype(np.int64), np.diff(np.append(starts, len(sorted_keys)))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


@dataclass
class LanguageModel:
    """languages, ascending; log_probs: one row of BUCKETS log-probabilities each; log_priors."""

    languages: list[str]
    log_probs: np.ndarray
    log_priors: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, posterior probability) of each text: one product of the sparse counts of all with the matrix."""
        row, bucket, count = sparse_counts(texts)
        scores = np.empty((len(texts), len(self.languages)))
        for k, log_prob in enumerate(self.log_probs):  # language by language, so that memory does not grow with their number
            scores[:, k] = np.bincount(row, weights=count * log_prob[bucket], minlength=len(texts))
        scores += self.log_priors
        best = scores.argmax(axis=1)  # the first of equals
        return best, 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its posterior probability; `und` and 0 for a text without letters."""
        languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        told = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        at = 0
        for group in text_groups([texts[k] for k in told]):
            for best, score in zip(*(x.tolist() for x in self.score(group)), strict=True):
                languages[told[at]], scores[told[at]] = self.languages[best], score
                at += 1
        return languages, scores


def fit(labelled: DataFrame, text_col: str, label_col: str, max_rows: int = 20_000, smoothing: float = 0.5, max_languages: int = 1000) -> LanguageModel:
    """Learn from rows whose text and label are not null.

    Of more than about `max_rows` such rows, a sample of about that many is used, chosen by the hash
    of the text (of 63 bits, so that the share may be as small as the table is large), so equal tables give equal models. The counts of n-grams are summed by Spark; the
    driver gets one number per language and bucket, as Arrow columns. More than `max_languages` labels are an error, and so is a sample without any row of a
    table with labels, from which nothing could be told.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 1) < (max_rows << 63) // total)
    if rows.select("label").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, labels = (np.array(c.to_pylist(), dtype=object) for c in batch.columns)
            for label in set(labels):
                mine = texts[labels == label].tolist()
                docs[label] = docs.get(label, 0) + len(mine)
                for group in text_groups(mine):
                    _, bucket, count = sparse_counts(group)
                    sums[label] = sums.get(label, 0) + np.bincount(bucket, weights=count, minlength=BUCKETS)
        for label, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(used) + 1)), pa.array([-1, *used.tolist()], pa.int32()), pa.array([docs[label], *counts[used].astype(np.int64).tolist()], pa.int64())], names=["label", "bucket", "n"])

    found = map_batches(rows, run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = found["label"].combine_chunks().dictionary_encode()
    names = labels.dictionary.to_pylist()
    if total and not names:
        raise ValueError(f"a sample of about {max_rows} of {total} rows is empty: raise max_rows")
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], dtype=np.int64)
    row, bucket, n = place[labels.indices.to_numpy()], found["bucket"].to_numpy(), found["n"].to_numpy()
    counts, docs = np.zeros((len(languages), BUCKETS)), np.ones(len(languages))
    docs[row[bucket < 0]] = n[bucket < 0]
    counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    counts += smoothing
    return LanguageModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts, np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred and score added (in place of columns so named).

    A null text and a text without any letter get `und` and score 0, as does every text when the
    model has learned no language. Of equally likely languages the first by name wins. Texts are scored whole,
    about 100,000 characters of a batch at a time, each on its own account: its row does not depend on its neighbours.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS doubles, bounded by fit()
    kept = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> F.Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
