"""Single rules on small inputs."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import tables
from folioflow.functions import text as tx
from folioflow.functions.readability import add_readability
from folioflow.operators import catalog as ca
from folioflow.operators import crawl as cr
from folioflow.operators import grouping as gr
from folioflow.operators import ml
from folioflow.operators import monitoring as mo
from folioflow.operators import pages as pg
from folioflow.operators import profile as pf
from folioflow.operators import scoring as sc
from folioflow.operators import similar as sm
from folioflow.operators import urls as u
from folioflow.plans import fixtures as fx
from folioflow.sources import readers as rd
from folioflow.sources import sinks as sk
from folioflow.streaming import monitor as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("the movie", 2), ("table", 1), ("rhythm and blue", 3), ("", 1), ("e", 1), ("queue", 1), ("ce", 1), ("Étude créée", 2), ("banana-split", 4)])
def test_syllables_as_by_word(spark, text, want):
    import re

    by_word = sum(max(1, len(re.findall("[aeiouy]+", w)) - (w.endswith("e") and len(re.findall("[aeiouy]+", w)) > 1)) for w in re.findall(r"\w+", text.lower()))
    assert one(spark, tx.syllable_count(F.lit(text))) == max(1, by_word) == want


def test_readability_of_nothing(spark):
    r = add_readability(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert all(x["words"] == 0 and x["flesch_ease"] == 0 and x["fk_grade"] == 0 and x["sentences"] == 1 for x in r)


@pytest.mark.parametrize("text", ["learning-based o'neil", "ÉCOLE d'été", "a1b c", ""])
def test_title_case(spark, text):
    assert one(spark, tx.title_case(F.lit(text))) == text.title()


@pytest.mark.parametrize("href,want", [("b.pdf", "https://x.edu/a/b.pdf"), ("../b", "https://x.edu/b"), ("../../../b", "https://x.edu/b"), ("/r", "https://x.edu/r"), ("//y.org/z", "https://y.org/z"), ("?q=1", "https://x.edu/a/i.html?q=1"), ("#f", "https://x.edu/a/i.html#f"), ("http://z.net", "http://z.net"), ("./c/d?x=../y", "https://x.edu/a/c/d?x=../y"), ("", "https://x.edu/a/i.html")])
def test_resolve(spark, href, want):
    from urllib.parse import urljoin

    base = "https://x.edu/a/i.html"
    assert urljoin(base, href) == want
    assert one(spark, u.resolve(F.lit(base), F.lit(href))) == want


def test_course_numbers(spark):
    assert one(spark, sc.course_number_score(F.lit("CS 101 and MATH500"))) == pytest.approx(0.8)
    assert one(spark, sc.course_number_score(F.lit("CS 1010"))) == 0
    assert one(spark, sc.course_number_score(F.lit("none"))) == 0


def test_explicit_subject_without_topic_is_other(spark):
    row = spark.createDataFrame([("Lab Manual", ["experiments"], "", "physics", "undergraduate")], "title string, keywords array<string>, description string, subject_area string, academic_level string")
    got = sc.classify_topic(row).first()
    assert (got["named_subject"], got["subject"], got["topic"], got["topic_score"]) == ("physics", "other", "general", 0)


def test_hyphen_and_year_codes(spark):
    m = spark.createDataFrame([("CS-101 in 2024", "", "")], "title string, description string, course_code string")
    assert m.select(gr.course_codes(m).alias("c")).first()["c"] == ["IN2024", "CS-101"]


def test_merge_is_greedy_and_keeps_the_first_name(spark):
    rows = [("author_a", 0, 1, ["d1", "d2"]), ("topic_x", 1, 1, ["d1", "d2", "d3"]), ("institution_i", 2, 1, ["d3", "d4"]), ("institution_j", 2, 2, ["d9", "d8"])]
    got = {r["name"]: r["members"] for r in gr.merge_overlapping(spark.createDataFrame(rows, gr.GROUP)).collect()}
    assert got == {"author_a": ["d1", "d2", "d3"], "institution_i": ["d3", "d4"], "institution_j": ["d9", "d8"]}


def test_series_gaps(spark):
    m = spark.createDataFrame([(0, "a", "x part 1"), (1, "b", "x part 4"), (2, "c", "x part 4")], "ordinal int, filename string, title string")
    got = {r["series"]: r for r in gr.series(m).collect()}["x"]
    assert (got["total_parts"], got["missing"], got["files"], got["complete"]) == (4, ["2-3"], ["a", "c"], False)


def test_recommendations_match_a_plain_loop(spark):
    from difflib import SequenceMatcher

    def jac(a, b):
        a, b = {x.lower() for x in a}, {x.lower() for x in b}
        return len(a & b) / len(a | b) if a and b else 0

    names = [x.split()[0] for x in fx.META.split(", ")]
    docs = [dict(zip(names, r, strict=True)) for r in fx.DOCS]
    want = {}
    for t in docs:
        scored = []
        for o in docs:
            if o is not t:
                s = SequenceMatcher(None, t["title"].lower(), o["title"].lower()).ratio() * 0.3 + jac(t["keywords"], o["keywords"]) * 0.25 + jac(t["authors"], o["authors"]) * 0.2
                s += 0.15 * bool(t["subject_area"] and t["subject_area"] == o["subject_area"]) + 0.1 * (t["academic_level"] == o["academic_level"])
                if s > 0.1:
                    scored.append((-round(s, 9), o["ordinal"], o["filename"]))
        want[t["filename"]] = [f for *_, f in sorted(scored)[:5]]
    got: dict = {}
    m = fx.meta(spark)
    for r in sm.recommend(m, m).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["filename"])
    assert got == {k: v for k, v in want.items() if v}


def test_recommendations_by_the_index(spark):
    """All of the catalogue of sf0.01 against a plain loop for its stated targets; pairs compared grow less than targets times documents."""
    from difflib import SequenceMatcher

    share = {}
    for sf in ("sf0.001", "sf0.01"):
        m, told = fx.meta(spark, f"/root/testdata/{sf}"), {}
        got: dict = {}
        for r in sm.recommend(m.where("ordinal % 20 = 0"), m, told=told).orderBy("target", "rank").collect():
            got.setdefault(r["target"], []).append((r["filename"], round(r["similarity"], 9)))
        share[sf] = (told["pairs"] + told["with_all"] * told["documents"]) / (told["targets"] * told["documents"])
        docs = [r.asDict() for r in m.select(*sm.NAMES).collect()]
        sets = {o["filename"]: [{v.lower() for v in o[c] or ()} for c in ("keywords", "authors")] for o in docs}
        jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0
        for t in (o for o in docs if o["ordinal"] % 20 == 0):
            scored = []
            for o in docs:
                if o["filename"] != t["filename"]:
                    shared = 0.25 * jac(sets[t["filename"]][0], sets[o["filename"]][0]) + 0.2 * jac(sets[t["filename"]][1], sets[o["filename"]][1])
                    shared += 0.15 * bool(t["subject_area"] and t["subject_area"].lower() == (o["subject_area"] or "").lower()) + 0.1 * (t["academic_level"] == o["academic_level"])
                    s = min(1.0, SequenceMatcher(None, t["title"].lower(), o["title"].lower()).ratio() * 0.3 + shared)
                    if s > 0.1:
                        scored.append((-round(s, 9), o["ordinal"], o["filename"]))
            assert got.get(t["filename"], []) == [(f, -s) for s, _, f in sorted(scored)[:5]], t["filename"]
    assert share["sf0.01"] < share["sf0.001"] < 1


def test_recommendations_compare_few_pairs(spark):
    """Documents without a common author are compared by their profiles, so that pairs don't grow with targets times documents that share a keyword."""
    m, told = fx.meta(spark, "/root/testdata/sf0.1"), {}
    assert sm.recommend(m.where("ordinal % 200 = 0"), m, told=told).count() == 5 * told["targets"] == 250
    assert told["pairs"] < 150 * told["targets"] and told["with_all"] == 0


def test_percentiles_are_places_in_order(spark):
    rows = spark.createDataFrame([("k", float(i)) for i in range(10)], "k string, v double")
    assert mo.index_percentiles(rows, "k", "v").first().asDict() == {"k": "k", "p50": 5.0, "p90": 9.0, "p95": 9.0, "p99": 9.0}


def test_breaker_opens_waits_and_closes(spark):
    calls = [(0, True), (1, False), (2, False), (3, True), (70, True), (71, True), (72, False)]
    rows = spark.createDataFrame([("s", i, float(t), ok) for i, (t, ok) in enumerate(calls)], "s string, seq long, seconds double, ok boolean")
    got = [(r["allowed"], r["state"]) for r in mo.breaker_states(rows, "s", failures=2, timeout=60.0, successes=2).orderBy("seq").collect()]
    assert got == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]



def test_update_touches_only_changed_rows(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    out = ca.update_rows(base, spark.createDataFrame([(2, "c")], "k int, v string"), "k", ("t", F.lit(9)))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0), (2, "c", 9)]


def test_registry_drops_bad_entries(spark):
    text = """
good:
  name: "Good"
  base_url: https://g.edu
  subject_areas:
    - physics
    - chemistry
  scraping_strategy: static_html
  priority: 4
bad:
  name: Bad
  base_url: https://b.edu
  scraping_strategy: api_integration
"""
    got = rd.registry(spark, text, "yaml").collect()
    assert [(r["name"], r["subject_areas"], r["priority"], r["timeout"]) for r in got] == [("Good", ["physics", "chemistry"], 4, 30)]
    assert rd.registry(spark, "{not json", "json").count() == 2


def test_pdf_files(spark, tmp_path):
    import zlib

    stream = zlib.compress(b"BT (Hello \\(there\\)) Tj ET")
    body = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj 2 0 obj << /Type /Pages >> endobj << /Title (My Title) /Author (A. B) >>\nstream\n" + stream + b"\nendstream\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.pdf").write_bytes(body)
    (tmp_path / ".hidden.pdf").write_bytes(body)
    (tmp_path / "b.txt").write_text("x")
    got = rd.pdf_profile(rd.pdf_files(spark, str(tmp_path))).collect()
    assert [(r["filename"], r["pages"], r["title"], r["author"], r["text"]) for r in got] == [("a.pdf", 1, "My Title", "A. B", "Hello (there)")]


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray("é".encode("latin-1")), "ISO-8859-1"), (bytearray("é".encode()), None), (bytearray(b"\xff"), "utf-8")], "b binary, c string")
    assert [r["x"] for r in rows.select(rd.decoded(F.col("b"), F.col("c")).alias("x")).collect()] == ["é", "é", "�"]


def test_sinks(spark, tmp_path):
    m = fx.meta(spark).where("subject_area <> ''")
    sk.write_hierarchy(m.select("subject_area", "academic_level", "filename"), f"{tmp_path}/h", "subject_area", "academic_level")
    assert spark.read.parquet(f"{tmp_path}/h").count() == m.count()
    sk.append_jsonl(m.select("filename"), f"{tmp_path}/j")
    sk.append_jsonl(m.select("filename"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2 * m.count()
    page = sk.index_lines(m).where("subject_area = 'physics'").first()["page"]
    assert page.startswith("# Physics\n\n2 documents") and "`doc07.pdf`" in page


def test_task_times_follow_the_old_status(spark, sf):
    from folioflow.plans import catalog as pc

    keys = [r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    got = {r["task_id"]: r for r in pc.status_transition(spark, sf).collect()}
    one = lambda turn: got[f"t{next(k for k in keys if k % 6 == turn)}"]
    assert (one(2)["status"], one(2)["started_at"], one(2)["completed_at"]) == ("completed", pc.NOW, None)
    assert (one(5)["completed_at"], one(0)["started_at"], one(0)["status"]) == (pc.NOW, None, "processing")


def test_text_ratio_and_summary(spark):
    assert one(spark, pf.text_ratio(F.lit(0), F.lit(3))) is None
    assert one(spark, pf.text_ratio(F.lit(500), F.lit(1))) == 0.5
    assert one(spark, pf.summary(F.lit("short."))) == ""
    assert one(spark, pg.term(F.lit("In FALL 2023 we"))) == "Fall 2023"


def test_windows_of_time(spark):
    now = dt.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1),), (dt.datetime(2024, 1, 1),)], "ts timestamp")
    assert rows.where(mo.within(F.col("ts"), F.lit(now), 24)).count() == 1


def greedy(groups, overlap=0.5):
    """The merge as it is said: each group in order joins the first kept one of which the smaller is shared enough."""
    kept = []
    for name, kind, first, members in sorted(groups, key=lambda x: (x[1], x[2], x[0])):
        for k in kept:
            if len(set(members) & set(k[1])) / min(len(members), len(k[1])) > overlap:
                k[1] = sorted({*k[1], *members})
                break
        else:
            kept.append([name, list(members)])
    return {n: m for n, m in kept}


@pytest.mark.parametrize("seed,one_task", [(0, 10**6), (1, 10**6), (2, 0), (1, 40)])
def test_merge_equals_a_plain_fold(spark, seed, one_task):
    """In one task, in rounds, and with the long chains in rounds."""
    r = random.Random(seed)
    groups = [(f"g{i}", r.randrange(3), i, [f"f{x}" for x in r.sample(range(30 + 60 * seed), r.randrange(1, 7))]) for i in range(25 if one_task == 0 else 60)]
    told = {}
    got = gr.merge_overlapping(spark.createDataFrame(groups, gr.GROUP), one_task=one_task, told=told).collect()
    assert {x["name"]: x["members"] for x in got} == greedy(groups) and len(got) == len(greedy(groups))
    assert (told.get("rounds", 0) > 1) == (one_task == 0 or told["largest"] > one_task)


def test_best_first_equals_a_queue(spark):
    r = random.Random(3)
    links = [(f"p{a}", f"p{r.randrange(200)}", r.randrange(5)) for a in range(200) for _ in range(4)]
    priority = {}
    links = [(a, b, priority.setdefault(b, p)) for a, b, p in links]
    seeds = [("p1", 1), ("p2", 4), ("p3", 4)]
    got = cr.best_first(spark.createDataFrame(seeds, "url string, priority int"), spark.createDataFrame(links, "src string, dst string, priority int"), max_pages=50, max_depth=4, fetch=7).orderBy("turn").collect()
    queue, seen, out, seq = [], set(), [], 0
    for u, p in sorted(seeds, key=lambda x: (-x[1], x[0])):
        queue.append((-p, seq, u, 0))
        seen.add(u)
        seq += 1
    while queue and len(out) < 50:
        queue.sort()
        p, _, url, depth = queue.pop(0)
        out.append((url, depth))
        for _, to, q in sorted({(a, b, q) for a, b, q in links if a == url and depth < 4}, key=lambda x: (-x[2], x[1])):
            if to not in seen:
                seen.add(to)
                queue.append((-q, seq, to, depth + 1))
                seq += 1
    assert [(x["url"], x["depth"]) for x in got] == out


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = st.write_batch(str(tmp_path / "out"))
    for batch, rows in ((0, range(5)), (1, range(5, 8)), (1, range(5, 8)), (0, range(5))):
        write(spark.createDataFrame([(i,) for i in rows], "v long"), batch)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_recommendations_do_not_depend_on_blocks(spark):
    m = fx.meta(spark)
    rows = lambda **o: sorted(map(repr, sm.recommend(m, m, **o).collect()))
    assert rows(block=4) == rows()


def test_no_title_ratio_is_larger_than_its_bound(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("ab ") for _ in range(r.randrange(12))), "".join(r.choice("ab ") for _ in range(r.randrange(12)))) for _ in range(200)]
    t = spark.createDataFrame(pairs, "a string, b string")
    assert t.where(sm.title_ratio(F.col("a"), F.col("b")) > sm.best_possible(F.col("a"), F.col("b")) + 1e-12).count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_numbers_follow_the_order(spark, parts):
    rows = [(k % 7, f"n{k * 37 % 100:03d}") for k in range(100)]
    got = tables.numbered(spark.createDataFrame(rows, "a int, b string").repartition(5), "i", "a", "b", parts=parts).collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["i"])] == sorted(rows) and {x["i"] for x in got} == set(range(100))


def test_settings_round_trip(spark, tmp_path):
    path = str(tmp_path / "settings.json")
    assert config.load(path) == config.Settings()
    mine = config.Settings(name="é", limits=config.Limits(workers=9), spark={"spark.sql.shuffle.partitions": "4"})
    config.save(mine, path)
    assert config.load(path) == mine
    config.apply(mine, spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    (tmp_path / "part.json").write_text('{"limits": {"retries": 1}}')
    assert config.load(str(tmp_path / "part.json")) == config.Settings(limits=config.Limits(retries=1))
    (tmp_path / "bad.json").write_text('{"limits": {"speed": 1}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.json"))


def test_classifier_equals_plain_bayes(spark):
    """TF-IDF and multinomial naive Bayes by hand: idf ln((n + 1) / (df + 1)), smoothing 1 for terms and labels."""
    rows = [("graph node edge graph", "math"), ("graph node path", "math"), ("cell membrane protein", "bio"), ("cell protein gene gene", "bio"), ("graph cell", "bio")]
    asked = ["graph node", "gene cell protein", "node path cell", "unknown words only"]
    terms = lambda t: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    df = Counter(x for t, _ in rows for x in set(terms(t)))
    vocabulary = sorted(df)
    weigh = lambda t: [terms(t).count(v) * math.log((len(rows) + 1) / (df[v] + 1)) for v in vocabulary]
    labels, score = sorted({y for _, y in rows}), {}
    for y in labels:
        total = [sum(c) for c in zip(*[weigh(t) for t, z in rows if z == y], strict=True)]
        n = sum(z == y for _, z in rows)
        score[y] = (math.log((n + 1) / (len(rows) + len(labels))), [math.log((x + 1) / (sum(total) + len(vocabulary))) for x in total])
    model = ml.text_classifier(spark.createDataFrame(rows, "text string, label string"), min_df=1.0, max_df=1.0)
    got = {r["text"]: {x["topic"]: x["p"] for x in r["topics"]} for r in ml.topic_probabilities(model, spark.createDataFrame([(t,) for t in asked], "text string"), 0.0).collect()}
    for t in asked:
        raw = {y: prior + sum(w * s for w, s in zip(weigh(t), each, strict=True)) for y, (prior, each) in score.items()}
        most = max(raw.values())
        z = sum(math.exp(v - most) for v in raw.values())
        assert got[t] == pytest.approx({y: math.exp(v - most) / z for y, v in raw.items()})


def test_terms_in_too_many_or_too_few_rows_do_not_count(spark):
    rows = spark.createDataFrame([("common rare1 pair", "a"), ("common pair", "a"), ("common stone", "b"), ("common stone", "b"), ("common pair", "b")], "text string, label string")
    assert set(ml.text_classifier(rows, max_df=0.8).stages[0].stages[4].vocabulary) == {"pair", "stone", "common pair", "common stone"}


def test_level_classifier_learns_from_more_rows(spark):
    first = spark.createDataFrame(ml.LEVEL_ROWS, "text string, label string")
    asked = spark.createDataFrame([("thesis research",), ("homework for school",), ("llama herding",)], "text string")
    best = lambda m: [r["predicted"] for r in m.transform(asked).collect()]
    assert best(ml.level_classifier(first))[:2] == ["graduate", "high_school"]
    assert best(ml.level_classifier(first, spark.createDataFrame([("llama herding llama", "undergraduate")] * 3, "text string, label string"))) == ["graduate", "high_school", "undergraduate"]


def test_pages_of_a_sink(spark, tmp_path):
    """Large pages lie in several files in order; written again, nothing is there twice."""
    m = fx.meta(spark, "/root/testdata/sf0.001").where("subject_area <> ''")
    want = {r["subject_area"]: r["page"].split("\n") for r in sk.index_lines(m).collect()}
    for _ in range(2):
        sk.write_pages(sk.index_rows(m), f"{tmp_path}/p", "subject_area", lines_a_file=3)
        got: dict = {}
        for r in sk.read_pages(spark, f"{tmp_path}/p", "subject_area").orderBy("subject_area", "place").collect():
            assert r["place"] == len(got.setdefault(r["subject_area"], []))
            got[r["subject_area"]].append(r["line"])
        assert got == want
    assert spark.read.text(f"{tmp_path}/p").select(F.input_file_name()).distinct().count() > 2 * len(want)
