"""Resampling, periodic runs and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioflow.llm import packing, periodic, resampling

ODD = [None, "", " \t\n", "one", "\U0001f600 \U0001f600 é É ß İ Σας", "a b " * 3000, "word " * 40000, "x" * 30000, "Ab,cd.ef-GH 0 1 2"]


# ---- resampling -----------------------------------------------------------


def plain_features(text, low, high):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(ws), [" ".join(ws[i : i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]


def plain_resample(rows, targets, low, high, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [(i, *plain_features(t, low, high)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in of for f in fs), Counter(bucket(f) for x in targets for f in plain_features(x, low, high)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets))))) for b in range(buckets)]
    out = []
    for i, n, fs in of:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 2), (2, 4)])
def test_resampling(spark, documents, low, high):
    random.seed(low * 10 + high)
    texts = ODD[:5] + ["Ab,cd.ef-GH 0 1 2"] + [" ".join(random.choices("the a of in Dog cat ox-cart é 42 fast".split(), k=random.randrange(60))) for _ in range(60)]
    ids = [*range(len(texts) - 3), None, 7, 7]
    targets = ["the fast dog", "a cat of the ox-cart", None, ""]
    got = resampling.resample(documents(texts, ids), documents(targets), low, high, 97, least_words=5, percent=30).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(zip(ids, texts, strict=True), targets, low, high, 97, 30, 5)
    assert sum(r["rank"] is not None for r in got) > 5


def test_resampling_without_target(spark, documents):
    got = resampling.resample(documents(["a b c d", "a", None]), documents([]), least_words=1, percent=100)
    assert sorted(r["rank"] or 0 for r in got.collect()) == [0, 1, 2]


def test_draw_follows_the_target(spark, documents):
    """Of two kinds of equally many texts, the draw takes the target's."""
    texts = ["red green blue " * 10 if k % 2 else "one two three " * 10 for k in range(200)]
    got = resampling.resample(documents(texts), documents(["green blue red"] * 20), percent=40).where("rank is not null").collect()
    assert len(got) == 80
    assert all(r["doc_id"] % 2 for r in got)


# ---- periodic runs --------------------------------------------------------


def plain_runs(x, exponent=4, least=6):
    out, n = [], len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                run = x[i : j + q]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, len(run), q))
            i = j if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(n, letters):
    x = [random.randrange(letters) for _ in range(n)]
    for _ in range(random.randint(0, 3) if n else 0):
        a = random.randrange(n)
        p = random.randint(1, max(1, (n - a) // random.randint(2, 10)))
        for i in range(a, random.randint(a, n)):
            x[i] = x[a + (i - a) % p]
    return x


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 6), (5, 2)])
def test_runs(exponent, least):
    random.seed(exponent)
    for _ in range(40):
        texts = [planted(random.choice([0, 1, 5, 6, 20, 60, 200]), random.choice([1, 2, 3, 5, 30])) for _ in range(random.randint(1, 12))]
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        got = periodic.periodic_runs(np.array([w for x in texts for w in x], np.uint64), first, exponent, least)
        assert list(zip(*[a.tolist() for a in got], strict=True)) == [(d, *r) for d, x in enumerate(texts) for r in plain_runs(x, exponent, least)]


def test_steps_of_the_smaller_half():
    """A text of one long period: places looked at again grow as n log n, not with the square."""
    seen = {}
    for n in (2000, 8000, 32000):
        x = np.tile(np.random.default_rng(n).integers(0, 50, n // 5).astype(np.uint64), 5)
        steps, refine = [], periodic.Partition.refine
        try:
            periodic.Partition.refine = lambda self: (steps.append(len(self.moved) + len(self.dying)), refine(self))[1]  # noqa: B023
            found = periodic.periodic_runs(x, np.array([0, len(x)]))
        finally:
            periodic.Partition.refine = refine
        assert [a.tolist() for a in found] == [[0], [0], [n], [n // 5]]
        seen[n] = sum(steps)
    assert seen[32000] < 2 * 16 * seen[2000]


def test_runs_of_odd_texts(spark, documents):
    texts = [*ODD, "p q r s t u " + "k l m " * 5 + "z", "a b " * 2 + "a"]
    got = {r["doc_id"]: r for r in periodic.find_runs(documents(texts)).collect()}
    for k, text in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, len(ws), len(set(ws)))] if k in (5, 6) else plain_runs(ws)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(r) for r in got[k]["runs"]] == runs
        assert got[k]["collapsed"] == " ".join(w for i, w in enumerate(ws) if i not in gone)
    assert got[len(ODD)]["collapsed"] == "p q r s t u k l m z"


def test_query_of_runs(spark, sf):
    from folioflow.llm.registry import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ws, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(ws)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda u: (Fraction(u[1], u[2]), -u[0], -u[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r["doc_id"]] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


# ---- packing --------------------------------------------------------------

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_ids_of_words_are_those_of_texts():
    """White space, combining marks, other spaces and special tokens between and inside words."""
    random.seed(1)
    parts = [*"abcAB'sSt09.!-_<|>\t\n\x0b\x0c\r\x1c\x1f\x85\xa0́̈éÉΣσςİßẞ漢가\U0001f600‍　", *["'re", "'ll", "<|endoftext|>", "<|startoftext|>"], *" " * 6]
    texts = [None, "", *["".join(random.choices(parts, k=random.randrange(60))) for _ in range(3000)]]
    whole = Tokenizer.from_file(VOCABULARY)
    for most in (1 << 20, 50):
        known = packing.WordIds(open(VOCABULARY).read(), most=most)
        for k in range(0, len(texts), 100):
            ids, first = known.of(pa.array(texts[k : k + 100], pa.string()), 1)
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts[k : k + 100]]


def plain_best_fit(lengths, capacity, most):
    bins, open_ = [], []
    for length in lengths:
        fits = [b for b in open_ if capacity - sum(bins[b]) >= length]
        if fits:
            least = min(capacity - sum(bins[b]) for b in fits)
            yield least
            at = next(b for b in fits if capacity - sum(bins[b]) == least)
        else:
            yield None
            if len(open_) == most:
                open_.remove(max(open_, key=lambda b: sum(bins[b])))
            at = len(bins)
            bins.append([])
            open_.append(at)
        bins[at].append(length)
        if sum(bins[at]) == capacity:
            open_.remove(at)


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_best_fit(most):
    """Each piece goes where the least free space holds it; what free space it met is told by where it was put."""
    random.seed(most)
    lengths = [random.choice([1, 7, 30, 50, 64, random.randint(1, 64)]) for _ in range(400)]
    bins, offsets, left = packing.best_fit(lengths, 64, most)
    new = {b: k for k, b in reversed(list(enumerate(bins.tolist())))}
    met = [None if new[b] == k else 64 - o for k, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist(), strict=True))]
    assert met == list(plain_best_fit(lengths, 64, most))
    assert len(left) <= most


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for there in by.values():
        at = 0
        for offset, length in sorted(there):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("open_bins,a_task", [(4096, 100_000), (16, 500), (1, 40), (3, 10_000)])
def test_pack(spark, open_bins, a_task):
    random.seed(open_bins)
    lengths = [min(100, int(random.expovariate(0.04)) + 1) for _ in range(3000)] + [1] * 1500 + [60] * 300
    rows = packing.pack(spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k int, length long").repartition(3), 100, open_bins, a_task).collect()
    assert sorted((r["k"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = check_places(rows, 100)
    assert n <= -(-sum(lengths) // 100) * {4096: 1.01, 16: 1.06, 1: 1.6, 3: 1.2}[open_bins]


def test_sequences_of_odd_texts(spark, documents):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None]
    whole = Tokenizer.from_file(VOCABULARY)
    want = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in zip(ids, ODD, strict=True)}
    got = defaultdict(dict)
    for s in packing.sequences(documents(ODD, ids), VOCABULARY).collect():
        row = np.frombuffer(s["ids"], "<u4").tolist()
        assert len(row) <= 4096
        assert sum(p["length"] for p in s["pieces"]) == len(row)
        for p in s["pieces"]:
            got[p["doc_id"]][p["piece"]] = row[p["offset"] : p["offset"] + p["length"]]
    for i, ids_ in want.items():
        pieces = [got[i][k] for k in range(len(got[i]))]
        assert sum(pieces, []) == ids_
        assert all(len(p) == 4096 for p in pieces[:-1])


def test_query_of_packing(spark, sf):
    whole = Tokenizer.from_file(VOCABULARY)
    got = packing.op13_pack(spark, sf).collect()
    want, total = {}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert check_places(got, 4096) <= -(-total // 4096) * 1.01
