"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Words, bound_batches, crc_mod, table, words

FEATURES = (
    "log_words", "mean_word", "long_word", "distinct", "top_word", "pair_repeat", "upper", "digit", "punct", "symbol", "non_ascii", "space",
    "newline", "line_repeat", "mean_line", "sentence_end", "shout_words", "symbol_words", "longest_word", "byte_entropy", "comma", "one_byte_words", "capital_words", "words_per_stop",
)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, from whole texts; zeros for texts without bytes."""
    w: Words = words(column)
    n = len(w.at) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(w.data):
        return out
    size = np.diff(w.at)
    b = w.data
    kind = np.zeros((256, 9), np.int64)  # upper, digit, punct, symbol, non_ascii, space, newline, sentence_end, comma
    for k, chars in enumerate((range(65, 91), range(48, 58), b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256), b" \t", b"\n", b".!?", b",")):
        kind[list(chars), k] = 1
    full = np.flatnonzero(size)
    count = np.zeros((n, 9))
    for k in range(9):
        count[full, k] = np.add.reduceat(kind[:, k].astype(np.int32)[b], w.at[:-1][full])
    s = np.maximum(size, 1)
    rate = count / s[:, None]
    nw = np.diff(w.first)
    m = np.maximum(nw, 1)
    length = w.end - w.start
    has = np.flatnonzero(nw)

    def per_word(x: np.ndarray, f=np.add) -> np.ndarray:
        r = np.zeros(n)
        if len(has):
            r[has] = f.reduceat(x.astype(float), w.first[:-1][has])
        return r

    first, last = b[w.start], b[w.end - 1]
    upper = np.concatenate([[0], np.cumsum(kind[:, 0].astype(np.int32)[b])])
    odd = np.concatenate([[0], np.cumsum(kind[:, 3].astype(np.int32)[b])])
    pairs = np.zeros(len(w.value), np.uint64)
    if len(pairs) > 1:
        with np.errstate(over="ignore"):
            pairs[:-1] = w.value[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.value[1:]
    values = [
        np.log1p(nw), per_word(length) / m, per_word(length > 12) / m, None, None, None, rate[:, 0], rate[:, 1], rate[:, 2], rate[:, 3], rate[:, 4], rate[:, 5], rate[:, 6], None, None,
        count[:, 7] / m, per_word((upper[w.end] - upper[w.start] == length) & (length > 1)) / m, per_word(odd[w.end] > odd[w.start]) / m, np.log1p(per_word(length, np.maximum)),
        None, count[:, 8] / m, per_word(length == 1) / m, per_word(kind[first, 0] > 0) / m, per_word(kind[last, 7] > 0) / m,
    ]
    for k, v in enumerate(values):
        if v is not None:
            out[:, k] = v
    for i in full:
        v = w.value[w.first[i] : w.first[i + 1]]
        if len(v):
            each = np.unique(v, return_counts=True)[1]
            out[i, 3], out[i, 4] = len(each) / len(v), each.max() / len(v)
            if len(v) > 2:
                out[i, 5] = 1 - len(np.unique(pairs[w.first[i] : w.first[i + 1] - 1])) / (len(v) - 1)
        lines = [x for x in w.text(i).split(b"\n") if x.strip()]
        out[i, 13] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, 14] = np.log1p(size[i] / len(lines)) if lines else 0
        h = np.bincount(b[w.at[i] : w.at[i + 1]], minlength=1)
        h = h[h > 0] / size[i]
        out[i, 19] = -(h * np.log2(h)).sum()
    return out


class Forest:
    """Boosted complete trees, flattened: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature, self.threshold, self.leaf = np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows go down a tree together."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 5) -> Forest:
    """Fit by second-order boosting on histograms, all nodes of a level at once.

    Without rows, or with one label only, the forest is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    out = Forest(depth, float(np.log(share / (1 - share))))
    if len(y) < 2 * least or y.min() == y.max():
        return out
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(d) * bins
    f = np.full(len(y), out.start)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            key = ((node - (k - 1)) * (d * bins))[:, None] + flat
            hist = [np.bincount(key.ravel(), np.repeat(v, d), k * d * bins).reshape(k, d, bins).cumsum(2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(k, -1).argmax(1)
            split_bin = np.full(k, bins)
            for i in range(k):
                j, c = divmod(int(best[i]), bins)
                feature[k - 1 + i] = j
                if gain[i, j, c] > 1e-9:
                    threshold[k - 1 + i], split_bin[i] = edges[j][c], c
            at = node - (k - 1)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[at])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        made.append((feature, threshold, value))
        f += value[leaf]
    out.feature, out.threshold, out.leaf = (np.stack(v) for v in zip(*made, strict=True))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Forest:
    """Fit on at most max_rows labelled documents, those first by a hash of their id.

    Rows with null id, label or text teach nothing; a document labelled twice counts once for each
    label, and repeated labels once. The labels' side is cut to the sample before it meets the texts;
    of several texts with one id the one with the least statistics teaches, so that max_rows bounds
    what comes to the driver whatever is repeated.
    """
    bound_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # a row of two numbers each, max_rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), *(pa.array(c) for c in x.T)], names=["doc_id", "quality", *FEATURES])

    measured = rows.mapInArrow(measure, "doc_id long, quality int, " + ", ".join(f"{x} double" for x in FEATURES))
    t = measured.groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "quality", "x.*").toPandas().sort_values(["doc_id", "quality"])
    return boost(t[list(FEATURES)].to_numpy(), (t["quality"].to_numpy() > 0).astype(float), **options)


def score(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text.

    Null and empty texts are scored by their zero statistics, repeated rows alike, each. held_out is
    the column of docs if there is one, else false; other columns are not read, whatever their names.
    An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = forest.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs if "held_out" in docs.columns else docs.withColumn("held_out", F.lit(False))
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 4) != 2)
    bound_batches(spark)
    return score(docs, fit(docs.where("not held_out"), labels))
