"""Language ID: multilingual mixture inference by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bound_batches, crc_mod, table

BUCKETS = 1 << 15
OTHER = "other"
FOUND = "lang_pred string, score double, languages array<string>, proportions array<double>"


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of letters in a text; anything else counts as a gap."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[np.minimum(c, 65535)]
    if (high := c > 65535).any():
        is_letter = np.where(high, [h > 65535 and chr(h).isalpha() for h in c], is_letter)
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[32], np.where(is_letter, c, 32), [32]]).astype(np.uint32)
    mid = c[1:-1] != 32
    with np.errstate(over="ignore"):
        h = c[:-2] * np.uint32(73856093) ^ c[1:-1] * np.uint32(19349663) ^ c[2:] * np.uint32(83492791)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761)
    return (h >> np.uint32(17))[mid].astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all given texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = letter_table(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid and len(g := grams(text.as_py(), letters)):
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    totals[lang] += np.bincount(g, minlength=BUCKETS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixtures:
    """Languages with their smoothed trigram distributions, and a uniform one for anything else."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 2.0, rounds: int = 40):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        p = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BUCKETS)
        self.p = np.vstack([p, np.full((1, BUCKETS), 1 / BUCKETS)]).T.astype(np.float32)

    @staticmethod
    def bounds(c: np.ndarray, p: np.ndarray, chosen: list[int], theta: np.ndarray) -> np.ndarray:
        """What each component may gain at most beside the chosen ones; nothing for these."""
        gain = (c / (p[:, chosen] @ theta)) @ p - c.sum()
        gain[chosen] = -np.inf
        return gain

    def infer(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chosen components, their proportions), the last component being `other`.

        The set grows from the best single language, one at a time, while the
        log-likelihood gains more than the penalty times half the log of the
        trigrams. The likelihood is concave in the proportions: a component's
        gradient at the current ones bounds what it can gain, so that most
        texts are settled without a round of EM. Components are tried by falling
        bound; one that gains less than the fee is passed over until the set
        grows, and when no bound left exceeds the fee, components that later ones
        made needless go again: those whose loss is below the fee, the least
        first. (In a set of two neither can be: the first was the best alone.)
        """
        n = np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(n)
        c, p = n[at].astype(float), self.p[at].astype(float)
        fee = self.penalty * 0.5 * np.log(c.sum() + 1)
        single = c @ np.log(p)
        chosen = [int(np.argmax(single[:-1]))]
        theta, best = np.ones(1), single[chosen[0]]
        gain = self.bounds(c, p, chosen, theta)
        while gain[new := int(np.argmax(gain))] > fee:
            trial = [*chosen, new]
            w, likelihood = self.settle(c, p[:, trial], np.append(theta * 0.8, 0.2))
            if likelihood - best <= fee:
                gain[new] = -np.inf
                continue
            chosen, theta, best = trial, w, likelihood
            gain = self.bounds(c, p, chosen, theta)
        while len(chosen) > 2:
            less = []
            for k in range(len(chosen)):
                trial = chosen[:k] + chosen[k + 1 :]
                if any(x < len(self.languages) for x in trial):
                    less.append((*self.settle(c, p[:, trial], np.delete(theta, k) + 0.01), trial))
            w, likelihood, trial = max(less, key=lambda x: x[1])
            if best - likelihood >= fee:
                break
            chosen, theta, best = trial, w, likelihood
        return np.array(chosen), theta

    def settle(self, c: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """(proportions of the components p, log-likelihood) by EM from a start."""
        w, total = start / start.sum(), c.sum()
        for _ in range(self.rounds):
            step = w * (p.T @ (c / (p @ w))) / total
            moved, w = np.abs(step - w).max(), step
            if moved < 1e-4:
                break
        return w, float(c @ np.log(p @ w))


def fit(train: DataFrame, max_languages: int = 1000, **options) -> Mixtures:
    """Fit on the texts and labels of all given rows; rows without label or letters teach nothing.

    Only counts come to the driver: BUCKETS numbers for each language. More than
    max_languages labels are an error, as lang is then no language column.
    """
    rows = train.where("lang is not null and text is not null")
    counts = gram_counts(rows).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams")).limit(max_languages + 1).toArrow()
    if counts.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    order = np.argsort(np.array(counts.column("lang").to_pylist(), dtype=object)) if counts.num_rows else []
    table = np.zeros((counts.num_rows, BUCKETS))
    grams_ = counts.column("grams").combine_chunks() if counts.num_rows else None
    names = counts.column("lang").to_pylist()
    for k, i in enumerate(order):
        g = grams_[int(i)].values
        table[k, g.field("bucket").to_numpy(zero_copy_only=False)] = g.field("n").to_numpy(zero_copy_only=False)
    return Mixtures([names[int(i)] for i in order], table, **options)


def predict(docs: DataFrame, model: Mixtures, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and FOUND for each row: the language with the largest share of the trigrams, its share, and all shares.

    A null text, one without a letter, and any text where nothing was learned
    are `und` with score 0 and no languages. Rows with one id are judged each;
    columns that aren't in `keep` are not read, and kept ones named like a found one give way.
    """
    bound_batches(docs.sparkSession)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                g = grams(text.as_py(), letters) if text.is_valid and model.languages else ()
                if not len(g):
                    out.append(("und", 0.0, [], []))
                    continue
                k, share = model.infer(g)
                real = np.flatnonzero(k < len(model.languages))
                top = real[np.argmax(share[real])]
                by = np.argsort(-share, kind="stable")
                out.append((model.languages[k[top]], float(min(share[top], 1.0)), [(model.languages + [OTHER])[k[i]] for i in by], [float(share[i]) for i in by]))
            pred, score, langs, shares = zip(*out, strict=True) if out else ((), (), (), ())
            found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=[*kept, "lang_pred", "score", "languages", "proportions"])

    extra = T.StructType.fromDDL(FOUND)
    kept = [c for c in keep if c not in extra.names]
    rows = docs.select(*kept, *({"text"} - {*kept}))
    return rows.mapInArrow(infer, T.StructType([rows.schema[c] for c in kept] + extra.fields))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    bound_batches(spark)
    return predict(docs, fit(docs.where("not held_out")), keep=("doc_id", "held_out"))
