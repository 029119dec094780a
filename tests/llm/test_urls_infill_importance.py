"""Url rules, fill-in-the-middle and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F
from test_corpus import LONG, documents

from barwatch.llm import importance, infill, urls
from barwatch.llm.common import table

ODD = [(1, None, "a"), (2, "", "a"), (None, "one two\nthree", None), (None, None, None), (3, " \t\n ", "b"), (4, LONG.replace(" w1", "\nw1"), "b"),
       (5, "keep <S> as it is\n", "c"), (6, "same line\nsame line\n" * 30, "c"), (6, "same line\nsame line\n" * 30, "c"), (7, "é à\r\nü 日本語\n𝄞 ſ K", ""), (8, "<\nS>\n<P\n>", "")]


# --- urls

def page_table(spark, rows):
    names = "page_id bigint, url string, html string, host string, path string, key int, at int, run int, stack int, rule int, salt int, edge int, level int"
    return spark.createDataFrame([(i, u, "x", "y", "z", *([7] * 8)) for i, u in rows], names).repartition(3)


def brute_verdict(url, rules, otherwise="allow", hostless="block"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, hostless if host == "" else otherwise)))


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_against_brute_force(spark, seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "ab", "net", "É"], ["/", "/x", "/x/", "/x/y/", "/x/yy", "", "/é/"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    rules = sorted({(rng.choice(hosts), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"http://{rng.choice(['', 'm.', 'A.'])}{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '?q=/x/', '#t', 'y/z'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme/x"), (903, "://"), (904, "a://net?x://y"), (None, "http://net/x"), (905, "ftp://a.net:80/x/"),
             (906, "x://.net/x"), (907, "x://net./x"), (907, "x://net./x"), (908, "http://a\nb.net/x\n/y"), (909, "http://net/" + "x/" * 40_000)]
    got = urls.judge_urls(page_table(spark, rows), spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = sorted(((i, *brute_verdict(u, rules)) for i, u in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = page_table(spark, [(1, "http://a.net/"), (2, None)])
    got = urls.judge_urls(pages, none, otherwise="block", hostless="allow")
    assert sorted(map(tuple, got.collect())) == [(1, "a.net", "/", None, "block"), (2, "", "", None, "allow")]
    rules = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block"), (None, "/", "allow"), ("a.net", None, "allow")], none.schema)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert sorted(r["verdict"] for r in urls.judge_urls(pages, rules).collect()) == ["block", "block"]


def test_copies_of_one_url_fill_many_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("http://a.net/x").alias("url"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = urls.judge_urls(rows, rules)
    assert got.where("verdict = 'block'").select("page_id").distinct().count() == 20_000
    keys = rows.select("page_id", urls.host_key(F.lit("a.net")).alias("key"), F.lit(1).alias("edge"), F.xxhash64("page_id").alias("salt"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in urls._swept(keys, ["key", "edge", "salt"], "t").groupBy("run").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 4 and max(counts) < 6_000


# --- fill-in-the-middle

def brute_infill(doc_id, text, share=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return doc_id, len(lines), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("settings", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_infill_against_brute_force(spark, settings):
    rows = ODD + [(100 + i, "".join(random.Random(i).choice("ab\n<P>é") for _ in range(i)), "a") for i in range(80)]
    done = infill.fill_in_middle(documents(spark, rows), 7, *settings, error=3)
    got = sorted(map(tuple, done.collect()), key=str)
    assert got == sorted((brute_infill(i, t, *settings) for i, t, _ in rows), key=str)
    texts = sorted(r[0] for r in done.select(infill.restored(F.col("output"), F.col("form"))).collect())
    assert texts == sorted(t or "" for _, t, _ in rows)


def test_infill_of_whole_documents(spark):
    docs = table(spark, SF_CHECK, "documents")
    want = sorted(brute_infill(r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, infill.fill_in_middle(docs).collect())) == want
    got = infill.op12_fill_in_middle(spark, SF_CHECK)
    restored = {r["doc_id"]: r["restored_sha256"] for r in got.collect()}
    assert restored == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [0, 5, 255])
def test_rank_index_is_exact_and_its_predictions_bounded(error):
    rng = np.random.default_rng(error)
    for steps in (rng.integers(0, 200, 5000), np.zeros(700, np.int64), np.append(rng.integers(0, 3, 999), 10**9), np.array([0]), np.array([7, 7])):
        offsets = np.cumsum(steps)
        index = infill.RankIndex(offsets, error)
        ranks = rng.permutation(len(offsets))
        assert (index.offset(ranks) == offsets[ranks]).all()
        assert (np.abs(index.predict(ranks) - offsets[ranks]) <= error).all()
    even = infill.RankIndex(np.arange(0, 100_000, 80), error)
    assert len(even.first) == -(-1250 // infill.BLOCK)


# --- importance resampling

def brute_importance(rows, target, percent=10, least=20, runs=(1, 1), buckets=10_000):
    def features(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        named = [" ".join(words[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in named]

    of_docs, of_target = (Counter(b for x in texts for b in features(x)[1]) for texts in ([t for _, t in rows], target))
    s_all, t_all = sum(of_docs.values()) + buckets, sum(of_target.values()) + buckets
    gain = [math.floor(1000 * math.log(((of_target[b] + 1) * s_all) / ((of_docs[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for i, t in rows:
        n, found = features(t)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0]))
    return out, [x[:4] for x in able[: percent * len(able) // 100]]


def same_draw(got, out, drawn):
    assert sorted(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in got) == sorted(x[:4] for x in out)
    winners = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in winners] == list(range(1, len(drawn) + 1))
    assert [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in winners] == drawn


def test_importance_of_whole_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_CHECK, "documents").collect()]
    target = [r["text"] for r in table(spark, SF_CHECK, "benchmark").collect()]
    got = importance.op13_importance_resampling(spark, SF_CHECK)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same_draw(got.collect(), *brute_importance(rows, target))


@pytest.mark.parametrize("percent", [1, 33, 99, 100])
def test_importance_cut_by_medians(spark, percent):
    rng = random.Random(percent)
    rows = [(i // 3, " ".join(rng.choice(["a", "B", "cé", "d1"]) for _ in range(rng.randrange(6)))) for i in range(900)]
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    target = spark.createDataFrame([("a b b",), (None,)], "text string")
    got = importance.resample(docs, target, percent, 2, (1, 2), 50, chunk=40, finish=4).collect()
    out, drawn = brute_importance(rows, ["a b b", None], percent, 2, (1, 2), 50)
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted(x[:4] for x in out)
    winners = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r["rank"], r["score"], r["doc_id"]) for r in winners] == [(i + 1, x[3], x[0]) for i, x in enumerate(drawn)]


def test_importance_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in ODD] + [(None, "x " * 30)] * 5
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    got = importance.resample(docs, spark.createDataFrame([], "text string"), 50, 1, chunk=3, finish=1).collect()
    out, drawn = brute_importance(rows, [], 50, 1)
    assert sorted(map(str, ((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got))) == sorted(str(x[:4]) for x in out)
    winners = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r["rank"], r["score"]) for r in winners] == [(i + 1, x[3]) for i, x in enumerate(drawn)]
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert {r["rank"] for r in importance.resample(docs, docs, least_words=10**6).collect()} == {None}
