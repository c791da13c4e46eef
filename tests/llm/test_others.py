"""Decontamination, mixing, top-k, URL filters, WARC and the pipeline against plain versions."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, mixing, topk, urls, warc


def grams(text, size=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def holds(text, item):
    """An item by its five-word shingles, a shorter one by its whole sequence."""
    size = min(5, len(item.split()))
    asked = grams(item, size) if size else set()
    return bool(asked) and len(asked & grams(text, size)) >= 0.8 * len(asked)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_items_equal_brute_force(spark, documents, block):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(400)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 20, 33, 47, 80, 200)] + ["too short", "", None, "A b C d E"]
    docs = []
    for _ in range(40):
        t = [word() for _ in range(r.randrange(5, 400))]
        for _ in range(r.randrange(3)):
            item = (r.choice(items[:8])).split()
            if r.random() < 0.3:
                item[r.randrange(len(item))] = "zz"
            cut = r.randrange(len(item)) if r.random() < 0.3 else 0
            k = r.randrange(len(t))
            t[k:k] = item[cut:]
            t[0:0] = item[:cut]
        docs.append(" ".join(t).upper() if r.random() < 0.3 else " ".join(t))
    docs += ["", None, "too short", "x a b c d e y", docs[0], "w1 " * 30_000 + items[3] + " w2" * 90_000]
    table = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)], "item_id long, text string, found string")
    got = {(x["doc_id"], f["item_id"]) for x in decontaminate.find_items(documents(docs), table, block_shingles=block).collect() for f in x["found"]}
    want = {(d, i) for d, t in enumerate(docs) if t for i, q in enumerate(items) if q and holds(t, q)}
    assert got == want and len(want) > 20 and {i for _, i in want} >= {8, 11}


def test_short_items_are_found_whole_or_listed(spark, documents):
    items = ["yes", "too short", "a b c d", "A b C d E", "", None, "no"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = ["x TOO  short y", "too", "short too", "a b c", "d a b\nc d", "a b c d e f", "yesno", "", None, "No"]
    for least in (1, 2, 5):
        found = {(x["doc_id"], f["item_id"]) for x in decontaminate.find_items(documents(docs), table, least_words=least).collect() for f in x["found"]}
        runs = {i: q.lower().split() for i, q in enumerate(items) if q and len(q.split()) >= least}
        assert found == {(d, i) for d, t in enumerate(docs) if t for i, q in runs.items() if any(t.lower().split()[k : k + len(q)] == q for k in range(len(t)))}
        assert {r["item_id"] for r in decontaminate.left_out(table, least).collect()} == set(range(len(items))) - runs.keys()


def test_no_items(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(documents(["a b c d e f"]), none).first()["found"] == []


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 0, "b": 5}, {"x": 7}, {"a": 1, "b": 1000, "c": 1, "d": 1, "e": 900}])
def test_targets_are_shared_as_said(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_many_sources_keep_their_order(spark):
    """Sources over many ranges get the place that sorting by code point gives; a chain of caps needs many rounds."""
    names = [*(f"{c}{i}" for i in range(150) for c in "aZé\uffee\U0001f600"), "", None]
    rows = spark.createDataFrame([(n, 2 ** (i % 40) if i % 3 else 0) for i, n in enumerate(names)], "source string, source_size long").repartition(7)
    order = sorted(n for n in names if n is not None) + [None]
    for parts in (1, 16):
        assert {r["source"]: r["place"] for r in mixing.ranked(rows, parts).collect()} == {n: i for i, n in enumerate(order)}
    targets = mixing.source_targets(rows, parts=16).collect()
    size = sum(r["source_size"] for r in targets)
    assert sum(r["target"] for r in targets) == pytest.approx(1.5 * size) and all(r["target"] <= 2 * r["source_size"] for r in targets)
    level = {r["target"] / (3, 1, 2)[order.index(r["source"]) % 3] for r in targets if r["target"] < 2 * r["source_size"]}
    assert max(level) == pytest.approx(min(level))


def test_rows_without_an_id_are_drawn_by_their_text(documents):
    texts = [f"{k} " + "w " * (k % 7 + 1) for k in range(400)] + [None, "", "one " * 200_000]
    rows = mixing.repetitions(documents(texts, [None] * 403, sources=["a", "b"] * 201 + ["b"])).collect()
    assert len(rows) == 403 and len({(r["source"], r["copies"]) for r in rows if r["size"]}) > 2
    assert {r["size"] for r in rows} >= {0, 200_000}


def test_mix_comes_near_its_targets(documents):
    r = random.Random(0)
    texts = ["w " * r.randrange(1, 60) for _ in range(3000)]
    rows = mixing.emit(documents(texts, sources=[("a", "b", "c", None)[k % 4 if k % 3 else 0] for k in range(3000)])).groupBy("source").agg(F.sum("size").alias("n"), F.first("target").alias("t"), F.max("copy").alias("most")).collect()
    assert all(abs(x["n"] - x["t"]) < 0.08 * x["t"] and x["most"] <= 2 for x in rows) and len(rows) == 4


@pytest.mark.parametrize("shard,block", [(2000, 2000), (7, 3)])
def test_top_k_equals_brute_force(spark, shard, block):
    """Every row but the query's own is a candidate: repeated rows and ids count each, equal vectors tie."""
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.float32(r.normal(size=6))], 1) for i in range(60)] + [(100 + i, [0.5] * 6, 1) for i in range(9)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 4, 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (204, [1.0, 2.0], 1), (206, [3.0, 1.0], 1), (207, [], 1)]
    rows += [(5, rows[5][1], 1), (6, rows[6][1], 1), (6, rows[6][1], 1), (8, [9.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    told: dict = {}
    got = [tuple(x) for x in topk.top_k(table, F.col("vec_id") % 2 == 0, shard_rows=shard, query_rows=block, told=told).collect()]
    good = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for n, (i, q) in enumerate(good):
        if i % 2 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert told["first"] + told["rest"] <= told["queries"] * (told["shards"] - 1)


def test_shards_that_lie_apart_are_not_searched(spark):
    """Clusters far from each other: boxes rule out almost all pairs of a query and a shard."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.eye(8)[0] * 20 * (i % 8 + 1) + r.normal(size=8) * 0.1]) for i in range(640)]
    told: dict = {}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, shard_rows=80, told=told).collect()
    assert len(got) == 64 * 5 and all(x["vec_id"] % 8 == 7 for x in got)
    assert told["shards"] >= 8 and told["first"] + told["rest"] < 0.2 * told["queries"] * (told["shards"] - 1)


def test_products_beyond_64_bits(spark):
    wide = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, -2.0**40]), (2, [-(2.0**52), 0.0]), (3, [0.25, 2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(wide, F.col("vec_id") == 0).collect()
    rows = [(0, [2.0**40, -(2.0**40), 3.0]), (1, [2.0**40 + 1, 2.0**40, 1.0]), (2, [2.0**40, 2.0**40, 2.0]), (3, [1.0, 1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    whole = [(i, [int(x * 256) for x in v]) for i, v in rows]
    want = sorted((-sum(a * b for a, b in zip(whole[0][1], v, strict=True)), i) for i, v in whole[1:])
    assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"])] == [(i, -s) for s, i in want]
    assert topk.whole(np.array([[1e308, -0.001]]), 256).tolist() == [[int(1e308) * 256, -1]]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_a_plain_search(spark):
    links = [None, "", "no scheme.com/en/x", "http://a.COM/en/1", "http://com/en/", "http://xcom/en/", "http://example.com/en/70?q#f", "http://www.Example.com/EN/7", "://b.net/de/8", "ftp://example.net/de/80", "http://a.example.net/de/9", "http://a.net?x=/de/1", "http://a.org#/es/", "http://a.org/es/#x", "http://org:80/es/", "http://u@a.org/es/é\nz", "http://", "http:///en/", "a://b://c.com/en/", "http://a.com/en/\n://net/de/", "http://É.com/en/1"]
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(links)] + [(3, links[3], "x", "y")], "page_id long, url string, host string, rule string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_pages(spark, table).collect()]
    want = [(i, *judged(u, urls.RULES)) for i, u in enumerate(links)] + [(3, *judged(links[3], urls.RULES))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hosts_and_urls_of_any_length(spark):
    rules = [("block", "a.b.c", "/x"), ("allow", "c", "/xy"), ("block", "", "/z")]
    links = ["http://" + "l." * 100_000 + "a.b.c/x", "http://a.b.c/" + "x" * 500_000, "http://b.c/x", "http://.c/xyz", "http:///z", "http://a../z", "http://A.B.C/xyz"]
    table = spark.createDataFrame(list(enumerate(links)), "page_id long, url string")
    got = sorted(tuple(r) for r in urls.judge_pages(spark, table, rules).collect())
    assert [r[1:] for r in got] == [judged(u, rules) for u in links]
    assert urls.judge_pages(spark, table, ()).where("verdict = 'allow'").count() == len(links)
    plan = urls.judge_pages(spark, table, rules)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_path_belongs_to_the_first_host(spark):
    links = ["http://site.com?u=http://other.com/en/x", "http://site.com#http://other.com/en/x", "http://site.com?u=a://b/en/?c://d/en/", "http://site.com/en/?u=http://b.net/de/8"]
    table = spark.createDataFrame(list(enumerate(links)), "page_id long, url string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_pages(spark, table).collect())
    assert got == [(i, *judged(u, urls.RULES)) for i, u in enumerate(links)]
    assert [r[-1] for r in got] == ["allow"] * 3 + ["block"]


def test_rules_are_those_of_the_contract(spark):
    """The rules as the contract lists them, not as the module does."""
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    links = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/9", "http://x.example.net/de/80", "http://net/de/", "http://a.org/es/", "http://a.net/en/"]
    got = sorted(tuple(r) for r in urls.judge_pages(spark, spark.createDataFrame(list(enumerate(links)), "page_id long, url string")).collect())
    assert got == [(i, *judged(u, rules)) for i, u in enumerate(links)]
    assert [r[-1] for r in got] == ["block", "allow", "allow", "allow", "block", "allow", "block", "allow"]


def test_rule_side_may_be_shuffled(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    few = urls.judge_pages(spark, pages)
    many = urls.judge_pages(spark, pages, max_broadcast_rules=1)
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, few.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_archives_round_trip(spark, least):
    html = ["<p>x</p>", "", None, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "é\u2028\x00\r\n\r\n", "<p>x</p>", "", "ab", "ab", "tail\r\n", "x" * 300_000, "y" * 9_000, "z" * 5_000_000, "y" * 9_000]
    rows = [(i, f"http://a/{i}?a=%0A\r\nb" if i % 2 else None, h, "c") for i, h in enumerate(html)]
    got = {r["page_id"]: r for r in warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3), least).collect()}
    payload = [(h or "").encode() for h in html]
    for i, p in enumerate(payload):
        first = max(j for j, q in enumerate(payload) if q == p)
        again = first != i and len(p) >= least
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"], got[i]["url"]) == ("revisit" if again else "response", first if again else None, rows[i][1])


def test_archives_of_repeated_and_null_page_ids(spark):
    rows = [(7, "u", "a"), (7, "u", "a"), (3, "v", "a"), (7, "w", "b"), (None, "x", "a"), (None, None, None), (2, "http://a/%41", "b"), (2, "http://a/%41", "b")]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted([
        (7, "u", "response", None), (7, "u", "response", None), (3, "v", "revisit", 7), (7, "w", "response", None), (None, "x", "response", None), (None, None, "response", None),
        (2, "http://a/%41", "revisit", 7), (2, "http://a/%41", "revisit", 7),
    ], key=repr)


def test_headers_are_fresh(spark):
    """Every record has an id and a date of its own archive, and a revisit names the new id of a response with its payload."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 4}</p>") for i in range(40)], "page_id long, url string, html string").repartition(3)
    base = warc.scratch_path(spark, "test")
    first = warc.write_pages(pages, f"{base}/first", "2001-01-01T00:00:00Z")
    second = warc.deduplicate_archive(spark, first, f"{base}/second", "2002-02-02T00:00:00Z")
    heads = [[f for row in warc.archive_files(spark, [x for x, _ in folders]).collect() for f, _ in warc.split_records(warc.unpacked(memoryview(bytes(row["content"]))))] for folders in (first, second)]
    ids = [{f["WARC-Record-ID"] for f in some} for some in heads]
    assert [len(x) for x in ids] == [40, 40] and not ids[0] & ids[1]
    assert {f["WARC-Date"] for f in heads[1]} == {"2002-02-02T00:00:00Z"}
    response = {f["WARC-Record-ID"]: f for f in heads[1] if f["WARC-Type"] == "response"}
    assert len(response) == 4
    for f in heads[1]:
        if f["WARC-Type"] == "revisit":
            to = response[f["WARC-Refers-To"]]
            assert to["X-Page-ID"] == f["X-Refers-To-Page"] and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and f["Content-Length"] == "0"


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_records_are_split_in_any_pieces(step):
    import gzip

    blocks = [b"", b"x" * 50, b"WARC/1.1\r\n\r\n", b"\r\n\r\n" * 3]
    raw = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for x in blocks]
    packed = gzip.compress(raw[0] + raw[1]) + gzip.compress(raw[2]) + gzip.compress(raw[3])
    assert [b for _, b in warc.split_records(warc.unpacked(memoryview(packed), step))] == blocks
    with pytest.raises(ValueError):
        list(warc.split_records(warc.unpacked(memoryview(packed)[:-9], step)))
    with pytest.raises(ValueError):
        list(warc.split_records([raw[1][:-3]]))


def test_pipeline_stages(spark, sf, documents):
    import corpus_pipeline as cp
    from test_duplicates import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf).cache()
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        elif name == "near_duplicates":
            want = brute([(r["doc_id"], r["text"]) for r in before], 80)
            assert ids == {i for i, (n, c) in want.items() if i == c or not n}
        elif name == "leaks":
            assert ids == {r["doc_id"] for r in before if not any(holds(r["text"], q) for q in items)}
        elif name == "personal_data":
            old = {r["doc_id"]: r["text"] for r in before}
            assert ids == old.keys() and any(r["text"] != old[r["doc_id"]] for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != old[r["doc_id"]]) and not any("@mail" in r["text"] for r in after)
        else:
            assert ids <= {r["doc_id"] for r in before} and {r["copy"] for r in after} == {1, 2}
    assert cp.run(spark, sf).count() == len(after)


def odd_documents(spark, columns):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns whose names operators use."""
    r = random.Random(4)
    prose = " ".join(r.choice("the water of river runs down from hills and into sea while people walk along it".split()) for _ in range(120))
    rows = [(k, f"{prose} number{k} and {' '.join(r.choice('ship tree house road bird cloud'.split()) for _ in range(90))}", "en", ("a", "b", None)[k % 3]) for k in range(30)]
    rows += [(None, prose, "en", "a"), (None, None, None, None), (100, None, "en", "a"), (101, "", None, "b"), (102, "  \n ", "en", "b"), (103, "1234 5678", "en", "a"), (104, "river water " * 60_000, "en", "a")]
    rows += [rows[3], rows[3], (5, "a quite different text about the sea and the people of the hills " * 4, "en", "b"), (105, rows[7][1], "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *["x"] * len(columns)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in columns))


#: Columns that the stages' operators add, or name so inside.
CLASHING = (
    "score", "lang_pred", "languages", "proportions", "found", "base", "spans", "redacted", "size", "source_size", "target", "copies", "copy", "identity_", "component_id", "kept", "n_shingles", "rep", "value", "_a", "_b", "_kept", "_row", "_text",
    "a b.c", "text_key",
)


@pytest.mark.parametrize("name", ["language", "near_duplicates", "leaks", "personal_data", "mix"])
@pytest.mark.parametrize("columns", [(), CLASHING])
def test_stages_on_odd_tables(spark, sf, name, columns):
    """Rows as they should be, and each with the values that it had in every column, maps and structs included."""
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)[name]
    docs = odd_documents(spark, columns)
    if columns:
        mark = lambda c: F.concat_ws("/", F.lit(c), F.col("doc_id"), F.md5("text"), "source")
        docs = docs.withColumns({c: mark(c) for c in columns} | {"a_map": F.create_map(F.lit("k"), mark("m")), "a_struct": F.struct(mark("s").alias("x"), F.array(F.lit(1)).alias("y"))})
    before, after = docs.collect(), stage(spark, docs, sf).collect()
    ids = [r["doc_id"] for r in after]
    again = stage(spark, docs.repartition(5), sf).collect()
    assert sorted(map(repr, after)) == sorted(map(repr, again))
    if name != "mix":
        assert not after or after[0].__fields__ == docs.columns
    else:
        assert after[0].__fields__ == [*docs.columns, *[f"mix_{c}" if c in columns else c for c in ("size", "source_size", "target", "copies", "copy")]]
    same = [c for c in docs.columns if not (name == "personal_data" and c in ("text", "n_chars"))]
    known = {repr([r[c] for c in same]) for r in before}
    assert all(repr([r[c] for c in same]) in known for r in after)
    rename = {"copy": "mix_copy"} if columns else {}
    if name == "language":
        assert {100, 101, 102, 103}.isdisjoint(ids) and ids.count(3) == 3 and ids.count(5) == 2 and 104 in ids and ids.count(None) == 1
    elif name == "near_duplicates":
        assert ids.count(3) == 1 and ids.count(5) == 2 and 105 not in ids and ids.count(None) == 2 and {100, 101, 102, 103, 104} <= set(ids)
    elif name in ("leaks", "personal_data"):
        assert sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in before)
    else:
        assert {r[rename.get("copy", "copy")] for r in after} <= {1, 2} and set(map(repr, ids)) <= {repr(r["doc_id"]) for r in before}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_bounds_beyond_64_bits(spark):
    """Boxes whose bound no 64 bits hold, with scores that fit."""
    rows = [(i, [1e40 * i, -1e40 * i]) for i in range(-40, 40)] + [(100 + i, [0.25 * i, 1.0]) for i in range(40)] + [(1000, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1000, k=5, shard_rows=8).collect()
    scores = sorted(((sum(int(256 * x) for x in v) * 256, -i) for i, v in rows if i != 1000), reverse=True)[:5]
    assert [(r["score"], -r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == scores
