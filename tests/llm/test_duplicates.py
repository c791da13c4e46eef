"""Near duplicates and repeated substrings against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import near_dedup as nd
from folioflow.llm import substring as ss
from folioflow.llm.common import shingle_values, words
from folioflow.llm.graph import components


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, percent):
    ids = sorted({i for i, t in docs if i is not None})
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(r, n_words, n, edits):
    base = [f"w{r.randrange(500)}" for _ in range(n_words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("options", [{}, {"node_limit": 4, "depth": 3}, {"node_limit": 2, "depth": 2}, {"shingle_limit": 300, "depth": 3}])
def test_components_equal_brute_force(documents, options):
    r = random.Random(5)
    texts = [t for n, e in ((120, 1), (200, 2), (90, 1), (150, 3)) for t in copies(r, n, 14, e)]
    texts += ["", None, "a b c", "A b  C", "a b d", "one", texts[3].upper().lower(), texts[3].replace(" ", "\n"), "\xa0 x\x1cy z"] + [" ".join(f"v{r.randrange(3000)}" for _ in range(60)) for _ in range(20)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = nd.near_duplicates(documents(texts, ids), percent=85, **options).collect()
    want = brute(list(zip(ids, texts, strict=True)), 85)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_documents_of_several_texts(documents):
    """Rows with one doc_id are one document, whichever of its texts a link comes from; repeated rows add nothing."""
    r = random.Random(8)
    a, b, c, d = ([f"{x}{r.randrange(400)}" for _ in range(60)] for x in "abcd")
    rows = [(1, a), (1, b), (2, [*a, "more"]), (3, [*b, "more"]), (4, [*c, "x"]), (5, c), (9, c), (9, d), (8, [*d, "y"]), (1, a), (7, d[:30]), (6, [])]
    got = nd.near_duplicates(documents([" ".join(t) for _, t in rows], [i for i, _ in rows]), percent=85).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 4), (8, 4), (7, 7), (6, 6)} and len(got) == len(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_very_long_texts(documents):
    """Sets far beyond the shingle limit meet two at a time."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(base[:cut] + [f"x{k}"] + base[cut:]) for k, cut in enumerate((5, 30_000, 59_000, 100))] + [" ".join(base[:20_000])]
    got = nd.near_duplicates(documents(texts), percent=85, shingle_limit=50_000).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


@pytest.mark.parametrize("percent,shared", [(80, 8), (85, 34)])
def test_pairs_at_the_threshold_meet_in_a_tree(documents, monkeypatch, percent, shared):
    """With the default trees and depth, isolated pairs of just the asked similarity meet at the last depth."""

    class Asked(Exception):
        pass

    def stop(docs, size, trees, depth):
        raise Asked(trees, depth)

    monkeypatch.setattr(nd, "signatures", stop)
    with pytest.raises(Asked) as asked:
        nd.near_duplicates(documents(["a"]), percent=percent)
    trees, depth = asked.value.args
    assert (1 - (percent / 100) ** depth) ** trees <= 1e-5
    own = shared * 100 // percent - shared  # tokens that only one of the two has
    r, pairs, n = np.random.default_rng(3), 4000, shared + own // 2
    common = np.repeat(r.integers(0, 1 << 63, (pairs, 1, shared), np.uint64), 2, 1)
    values = np.concatenate([common, r.integers(0, 1 << 63, (pairs, 2, n - shared), np.uint64)], 2)
    paths = nd.chosen_paths(values.reshape(-1), np.arange(2 * pairs + 1) * n, trees, depth).reshape(pairs, 2, trees, -1)[..., -1]
    assert (paths[:, 0] == paths[:, 1]).any(1).all()


def test_join_up_by_sides():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [9])]
    assert nd.join_up(sets, 80).tolist() == [0, 0, 0, 3]
    assert nd.join_up(sets, 80, np.array([0, 0, 1, 1])).tolist() == [0, 1, 0, 3]


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r["v"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def repeats(docs, window):
    split = {i: (t or "").encode().split() for i, t in docs}
    first: dict = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept.decode())
    return out


@pytest.mark.parametrize("window", [50, 12, 3])
def test_removed_words_equal_brute_force(documents, window):
    r = random.Random(window)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    texts = ["a " * 200, "a " * 60 + "b", "a b " * 40, "b a " * 45, "", None, "short text", " ".join(passage)]
    for _ in range(25):
        t = [r.choice(vocabulary) for _ in range(r.randrange(150))]
        cut = r.randrange(20)
        t[r.randrange(len(t) + 1) : 0] = passage[cut : cut + r.randrange(70)]
        texts.append(r.choice([" ", "\n", " \t"]).join(t))
    texts += [texts[9], texts[9], texts[12] + " tail"]
    ids = [i * 7 % 101 for i in range(len(texts))]
    got = ss.remove_repeats(documents(texts, ids), window).collect()
    want = repeats(list(zip(ids, texts, strict=True)), window)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in got} == want
    assert all(sum(s["last"] - s["first"] + 1 for s in x["removed"]) == x["n_removed"] for x in got)


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_anchors(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c"] if seed < 3 else [f"w{i}" for i in range(50)]
    passage = [r.choice(vocabulary) if r.random() < 0.7 else "a" for _ in range(120)]
    texts = [" ".join([r.choice(vocabulary) for _ in range(r.randrange(60))] + passage + [r.choice(vocabulary) for _ in range(r.randrange(60))]) for _ in range(8)]
    w = words(pa.array(texts))
    start, anchor, name = ss.recompress(w, 50)
    by_window: dict = {}
    for s, a, *h in zip(start, anchor, *name, strict=True):
        by_window.setdefault(w.value[s : s + 50].tobytes(), set()).add((int(a), *map(int, h)))
    assert max(map(len, by_window.values())) == 1
    assert all(len({next(iter(v))[k] for v in by_window.values()}) == len(by_window) for k in (1, 2))  # different windows, different names
    assert np.array_equal(ss.recompress(w, 50, names=False)[1], anchor)
    assert len(start) == sum(max(0, len(t.split()) - 49) for t in texts)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_words_as_split(chunk):
    texts = ["a  b\tc", "", None, " lead", "trail ", "x", "y\x0b\x0cz\r\nq", "é \xa0 ü", "long" * 50]
    w = words(pa.array(texts), chunk=chunk)
    for i, t in enumerate(texts):
        ws = (t or "").encode().split()
        assert [bytes(w.data[a:b]) for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)] == ws
    flat = [x for t in texts for x in (t or "").encode().split()]
    assert len(set(w.value.tolist())) == len(set(flat))
    again = words(pa.array(["pad", *texts]).slice(1))
    assert again.value.tolist() == w.value.tolist()
    assert words(pa.array(["Ab É"]), lower=True).value.tolist() == words(pa.array(["aB É"]), lower=True).value.tolist()


def test_shingles_of_short_texts():
    value, first = shingle_values(words(pa.array(["a b c", "", "a b c d e f", "a b c"])), 5)
    assert np.diff(first).tolist() == [1, 0, 2, 1]
    assert value[0] == value[-1]
    assert hashlib.sha256(value.tobytes()).digest()
