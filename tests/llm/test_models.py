"""Language ID, quality and PII: held-out accuracy, gradients, plain searches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import langid, pii, quality


def test_language_of_held_out_documents(spark, sf):
    got = {r["doc_id"]: r for r in langid.op1_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert len(held) > 40
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixture_of_two_languages(documents):
    texts = ["the quick brown fox jumps over the lazy dog and runs through the wood " * 20, "der schnelle braune fuchs springt über den faulen hund und läuft durch den wald " * 20]
    model = langid.fit(documents(texts * 3, langs=["en", "de"] * 3))
    mixed = texts[0][:900] + texts[1][:300]
    rows = langid.predict(documents([mixed, texts[1], "", None, "12 34 !", "x"]), model).orderBy("doc_id").collect()
    both = dict(zip(rows[0]["languages"], rows[0]["proportions"], strict=True))
    assert rows[0]["lang_pred"] == "en" and both["en"] == pytest.approx(0.75, abs=0.06) and both["de"] == pytest.approx(0.25, abs=0.06)
    assert rows[1]["lang_pred"] == "de" and rows[1]["languages"] == ["de"]
    assert [r["lang_pred"] for r in rows[2:5]] == ["und"] * 3 and rows[5]["lang_pred"] in ("en", "de")


@pytest.mark.parametrize("stray", ["", " zq", " zqxw"])
def test_stray_trigrams_do_not_hide_a_second_language(stray):
    """A trigram unseen in training gives the uniform component the largest bound, though it gains nothing."""
    letters, r = langid.letter_table(), random.Random(1)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    first, second = (np.bincount(langid.grams(" ".join(w), letters), minlength=langid.BUCKETS) for w in (vocabulary[:40], vocabulary[40:]))
    model = langid.Mixtures(["aa", "bb"], np.stack([200_000 * first + 20_000 * second, 20_000 * first + 200_000 * second]).astype(float))
    chosen, share = model.infer(langid.grams(" ".join(vocabulary[:40] * 8 + vocabulary[40:] * 3) + stray, letters))
    assert chosen.tolist() == [0, 1] and share == pytest.approx([0.86, 0.14], abs=0.01)


def test_language_sets_equal_enumeration():
    """The set that infer() settles on has the best penalised likelihood of all sets, each fitted by long EM (a greedy search may miss by a hair)."""
    from itertools import combinations

    r = np.random.default_rng(3)
    counts = np.zeros((4, langid.BUCKETS))
    for k in range(4):
        counts[k, :120] = r.gamma(0.3, size=120) * 4000
    model = langid.Mixtures(list("abcd"), counts, rounds=400)
    p = model.p[:120].astype(float)
    missed = 0
    for _ in range(60):
        share = np.zeros(5)
        share[r.choice(4, r.integers(1, 4), replace=False)] = r.dirichlet([3] * 3)[0] + 0.2
        mixture = p @ (share / share.sum())
        buckets = r.choice(120, int(r.integers(30, 600)), p=mixture / mixture.sum())
        c = np.bincount(buckets, minlength=120).astype(float)
        fee, best = 0.5 * model.penalty * np.log(len(buckets) + 1), {}
        for size in range(1, 6):
            for chosen in combinations(range(5), size):
                if chosen == (4,):
                    continue
                w = np.full(size, 1 / size)
                for _ in range(2000):
                    q = p[:, chosen]
                    w = w * (q.T @ (c / (q @ w))) / c.sum()
                best[chosen] = c @ np.log(p[:, chosen] @ w) - fee * size
        chosen, theta = model.infer(buckets)
        top = max(best.values())
        missed += best[tuple(sorted(chosen))] < top - 0.05
        assert theta.sum() == pytest.approx(1)
    assert missed <= 1


def test_a_very_long_text_is_read_whole(documents):
    model = langid.fit(documents(["the quick brown fox", "der schnelle fuchs"], langs=["en", "de"]))
    rows = langid.predict(documents(["12 " * 300_000 + "schnelle fuchs " * 30_000, "the fox", "the fox"], [1, 2, 2]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["de", "en", "en"]


def test_nothing_learned_is_und(documents):
    model = langid.fit(documents(["abc def", None], langs=[None, "en"]))
    assert langid.predict(documents(["abc"]), model).first()["lang_pred"] == "und"


def test_quality_of_held_out_documents(spark, sf):
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i]["score"], q) for i, q in labels.items() if i in got and got[i]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_repeated_rows_teach_once(spark, documents, monkeypatch):
    """100,000 equal rows, many texts with one id, and repeated labels bring max_rows rows at most to the driver."""
    seen = []
    monkeypatch.setattr(quality, "boost", lambda x, y: seen.append((x, y)))
    docs = documents(["good text. " * 5, "bad bad bad", "other", None, ""], [1, 2, 1, 3, 4])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs.crossJoin(spark.range(20_000)).drop("id"), labels.union(labels), max_rows=50)
    assert len(seen[0][0]) == 3 and all(np.array_equal(a, b) for a, b in zip(*seen, strict=True))


def test_splits_equal_a_plain_search():
    """The first tree's root is the split with the best second-order gain of all, found by trying each."""
    r = np.random.default_rng(6)
    for _ in range(5):
        x, y = r.integers(0, 12, (80, 4)).astype(float), r.integers(0, 2, 80).astype(float)
        y[x[:, 2] > 6] = 1
        forest = quality.boost(x, y, trees=1, depth=1, bins=64, rate=1.0)
        start = (y.sum() + 1) / (len(y) + 2)
        g, h = start - y, np.full(len(y), start * (1 - start))
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        best = max(part(x[:, j] <= c) + part(x[:, j] > c) for j in range(4) for c in np.unique(x[:, j])[:-1] if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 5)
        left = x[:, forest.feature[0, 0]] <= forest.threshold[0, 0]
        assert part(left) + part(~left) == pytest.approx(best)
        assert forest.leaf[0] == pytest.approx([-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_very_long_and_repeated_texts_score_alike(documents):
    forest = quality.boost(np.random.default_rng(1).normal(size=(200, len(quality.FEATURES))), np.arange(200) % 2 * 1.0, trees=3)
    rows = quality.score(documents(["word " * 400_000, "a", "a", None, ""], [1, 2, 2, 3, 4]), forest).collect()
    assert len(rows) == 5 and len({(r["doc_id"], r["score"]) for r in rows}) == 4 and all(0 <= r["score"] <= 1 for r in rows)


def test_flat_forest_equals_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = quality.boost(x, y, trees=30, depth=3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 2 if row[f[node]] > t[node] else 2 * node + 1
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(z) for z in x[:50]])


def test_one_label_or_none_gives_the_share():
    assert quality.boost(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.boost(np.zeros((30, 3)), np.ones(30)).score(np.zeros((1, 3)))[0] > 0.9


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Hello World. Hello!\nHello World. Hello!", "", None, "ONE #TWO", "a" * 300, "é ü x, y"]
    whole = quality.statistics(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))
    assert whole[0, quality.FEATURES.index("line_repeat")] == 0.5
    assert not whole[1].any() and not whole[2].any()


IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    parts = ["a.b@c.d", "x@y", "@", "a@b.c@d.e.f", "1.2.3.4", "1.2.3.400", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "99", " ", ".", "é", "-", "+49 30 1234567890123", "0000000000000000", "\u0663.1.1.1", "0" * 30, ".", "1", "256", "1.1.", "007.0.0.1"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        want = [("email", *m.span()) for m in EMAIL.finditer(text)]
        for kind, p in (("ip", IP), ("card", pii.CARD), ("phone", pii.PHONE)):
            for m in p.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
                want += [(kind, *m.span())] * ok
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_long_texts_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@") == []
    assert len(pii.base_spans("x@y.zz " * 20_000)) == 20_000


def test_extreme_texts_take_linear_time():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("1" * 1_000_000) == [] and pii.base_spans("9" * 300_000 + "." + "9" * 300_000 + ".1.1") == []
    assert pii.base_spans("12 " * 300_000) == [] and pii.base_spans("+" + "1" * 300_000 + "(" * 300_000) == []
    assert len(pii.base_spans("1.1.1.1 " * 100_000)) == 100_000
    assert not pii.plausible("email", "a at " * 300) and not pii.plausible("card", "4" * 700)


def test_a_text_of_very_many_spans_is_reconciled():
    model = pii.Tagger()
    model.w["out"][:] = 0
    model.w["bias"][:] = [0, 0, 0, 0, 0, 0, 0, 4, 4]  # everything is a phone
    text = "1.1.1.1 " * 40_000
    base, every = pii.all_spans([text], model, 0.0)[0]
    assert len(base) == 40_000 and every == base


def test_training_windows_come_from_the_whole_text():
    texts = [f"{'word ' * 20}{k} mail{k}@b.co " * 60 for k in range(4)]
    examples = [(t, pii.base_spans(t)) for t in texts]
    for most in (4, 8):
        starts = [pii.window_starts(t, most) for t in texts]
        assert all(len(s) == most + most // 4 for s in starts) and len({tuple(s) for s in starts}) == 4
        assert all(max(s) > len(t) // 2 for s, t in zip(starts, texts, strict=True))
        assert len(pii.windows_of(examples, most)[0]) == 4 * (most + most // 4)
    assert len(pii.windows_of(examples[:1], 10**6)[0]) == -(-len(texts[0]) // 32)


def test_many_equal_rows_teach_as_much_as_one(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Tagger, "train", lambda self, x, y: seen.append((x, y)) or self)
    text = "write to a.b@c.de or 10.0.0.1 " * 9
    one = documents([text, "no 5"])
    pii.fit(one, made=3)
    pii.fit(one.crossJoin(spark.range(50_000)), made=3)
    assert all(np.array_equal(a, b) for a, b in zip(*seen, strict=True))


def test_decode_and_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    m = pii.Tagger(hidden=3)
    m.w["step"], m.w["start"] = r.normal(size=(pii.TAGS, pii.TAGS)), r.normal(size=pii.TAGS)
    for e in r.normal(size=(6, 4, 3, pii.TAGS)) * 2:
        tags, sure = m.decode(e)
        step = m.w["step"] + m.allowed
        paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
        for j in range(3):
            score = m.w["start"][paths[:, 0]] + m.allowed[0][paths[:, 0]] + sum(e[t, j, paths[:, t]] for t in range(4)) + sum(step[paths[:, t - 1], paths[:, t]] for t in range(1, 4))
            p = np.exp(score - score.max())
            p /= p.sum()
            assert tags[:, j].tolist() == paths[score.argmax()].tolist()
            if tags[:, j].any():
                assert sure[:, j] == pytest.approx([p[paths[:, t] == tags[t, j]].sum() for t in range(4)], abs=1e-9)


def test_windows_that_are_surely_plain_are(tagger):
    """all_plain() never says so of a window whose best path has another tag, and emissions() is the two LSTMs with the linear layer."""
    r = np.random.default_rng(4)
    plain = 0
    for shift in np.linspace(-6, 3, 40):
        e = r.normal(size=(12, 200, pii.TAGS)).astype(np.float32) * 2
        e[:, :, 1:] += shift
        sure, tags = tagger.all_plain(e), tagger.decode(e)[0]
        assert not tags[:, sure].any()
        plain += sure.sum()
    assert 500 < plain < 8000
    x = r.integers(0, pii.SYMBOLS, (40, 70))
    both = np.concatenate([tagger.lstm(x, "f")[0], tagger.lstm(x, "b")[0]], 2)
    assert np.allclose(tagger.emissions(x), both @ tagger.w["out"] + tagger.w["bias"], atol=1e-3)


def test_gradient_of_the_tagger():
    x, y = pii.windows_of(pii.made_up(6))
    x, y = x[:3], y[:3]
    m = pii.Tagger(hidden=5)
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    g = m.gradient(x, y)

    def loss():
        e = np.concatenate([m.lstm(x, "f")[0], m.lstm(x, "b")[0]], 2) @ m.w["out"] + m.w["bias"]
        step = m.w["step"] + m.allowed
        gold = m.w["start"][y[:, 0]] + m.allowed[0][y[:, 0]] + sum(e[t, np.arange(len(x)), y[:, t]] for t in range(x.shape[1])) + sum(step[y[:, t - 1], y[:, t]] for t in range(1, x.shape[1]))
        return (m.sums(e)[2] - gold).mean()

    r = np.random.default_rng(0)
    for k, w in m.w.items():
        i = tuple(r.integers(0, n) for n in w.shape)
        if k[1:] == "x":
            i = (x[0, 5], i[1])
        keep = w[i]
        w[i] = keep + 1e-4
        up = loss()
        w[i] = keep - 1e-4
        down = loss()
        w[i] = keep
        assert g[k][i] == pytest.approx((up - down) / 2e-4, abs=2e-3)


@pytest.fixture(scope="module")
def tagger(documents):
    return pii.fit(documents(["call 5", "none"]))


def test_tagger_on_unseen_examples(tagger):
    x, y = pii.windows_of(pii.made_up(200, seed=77))
    tags, _ = tagger.decode(tagger.emissions(x))
    assert (tags.T == y)[y > 0].mean() > 0.85
    assert ((tags.T > 0) & (y == 0)).sum() < 0.15 * (y > 0).sum()


def test_base_spans_stay_and_others_do_not_overlap(tagger):
    texts = [t for t, _ in pii.made_up(150, seed=8)] + ["", "no trigger here", "call (555) 123-4567 now please, or 555-123-9876 later"]
    for text, (base, every) in zip(texts, pii.all_spans(texts, tagger), strict=True):
        assert base == pii.base_spans(text) and set(base) <= set(every)
        for s in set(every) - set(base):
            assert all(s[2] <= o[1] or o[2] <= s[1] for o in every if o != s)


def test_windows_agree_wherever_a_span_lies(tagger):
    for span in ("(555) 123-4567", "john.smith [at] mail [dot] org"):
        for pad in (0, 10, 63, 64, 190, 200, 205, 210, 215, 220, 223, 224, 225, 450, 1000):
            text = "word " * (pad // 5) + "x" * (pad % 5) + " " + span + " and more words follow here"
            found = pii.all_spans([text, "other"], tagger)[0][1]
            assert [s[1:] for s in found] == [(text.index(span), text.index(span) + len(span))], (span, pad)


def test_long_spans_cross_window_middles():
    """Each character's tag comes from one window, and a span goes on across them."""
    model = pii.Tagger()
    model.w["out"][:] = 0
    model.w["bias"][:] = [0, 0, 0, 0, 0, 0, 0, 1, 4]
    for n in (1, 223, 224, 225, 500, 1000):
        (score, span), = pii.tagged(["x" * n, ""], model, 0.0)[0]
        assert span == ("phone", 0, n) and 0 <= score <= 1


def test_what_the_tagger_adds(tagger):
    """Recall on seeded examples of each kind, base patterns alone and with the tagger."""
    base, every, n = ({k: 0 for k in pii.KINDS} for _ in range(3))
    examples = pii.made_up(300, seed=41)
    for (_, spans), (own, found) in zip(examples, pii.all_spans([t for t, _ in examples], tagger), strict=True):
        for s in spans:
            n[s[0]], base[s[0]], every[s[0]] = n[s[0]] + 1, base[s[0]] + (s in own), every[s[0]] + (s in found)
    assert all(every[k] >= 0.8 * n[k] and every[k] > base[k] + 0.15 * n[k] for k in pii.KINDS), (n, base, every)


@pytest.mark.parametrize("kind,found,ok", [
    ("email", "a.b [at] c [dot] org", True), ("email", "a at b dot com", True), ("email", "a at b", False), ("email", "look at this dot", False), ("ip", "10.0.0[.]1", True), ("ip", "10.0.0.300", False),
    ("card", "4111.1111.1111.1111", True), ("card", "4111.1111.1111.1112", False), ("phone", "555-123-4567", True), ("phone", "5551234567", False), ("phone", "555 123", False), ("phone", "x555-123-4567", False),
])
def test_plausible_forms(kind, found, ok):
    assert pii.plausible(kind, found) is ok


def test_redaction(documents, tagger):
    rows = pii.find_pii(documents(["mail me: a@b.co or +1 (555) 123-4567!", None, "x"]), tagger).orderBy("doc_id").collect()
    assert [r["redacted"] for r in rows] == ["mail me: <EMAIL> or <PHONE>!", None, "x"]


def test_products_of_the_tagger_stay_on_one_thread(monkeypatch):
    """OpenBLAS takes a second thread, whose waiting counts as CPU time, for products of more than 2**18 multiplications."""
    sizes, plain = [], np.matmul

    def spy(a, b, out):
        sizes.append(a.shape[-2] * a.shape[-1] * b.shape[-1])
        return plain(a, b, out=out)

    monkeypatch.setattr(pii.np, "matmul", spy)
    pii.Tagger().emissions(np.zeros((pii.tagged.__defaults__[0], 3), np.int8))
    assert len(sizes) == 6 and max(sizes) <= 2**18


def test_exponentials_of_the_tagger(monkeypatch):
    """Two exponentials a character, direction and unit, those of the states: gates are straight lines cut at 0 and 1."""
    sizes, plain, model = [], np.exp, pii.Tagger()

    def spy(x, **options):
        sizes.append(np.size(x))
        return plain(x, **options)

    monkeypatch.setattr(pii.np, "exp", spy)
    model.emissions(np.zeros((7, 5), np.int8))
    assert sum(sizes) == 2 * 7 * 5 * 2 * model.hidden
    assert pii.gate(np.array([-9, -2.5, 0, 1, 2.5, 9])) == pytest.approx([0, 0, 0.5, 0.7, 1, 1])
    assert pii.gate_slope(np.array([0, 0.5, 1])) == pytest.approx([0, 0.2, 0])
