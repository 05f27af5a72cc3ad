from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from adtally.llm import url_rules
from adtally.llm.queries import QUERIES
from conftest import SF_DIR
from llm_fixtures import saved  # noqa: F401

PAGES = "page_id BIGINT, url STRING, html STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT"
UPPER = {ord(c): c.lower() for c in url_rules.UPPER}


def fixed(url):
    """Host, path and the longest rule, in plain Python."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(UPPER)
    fit = [
        (h + p, v)
        for v, h, p in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()
    got = QUERIES["op7_url_rules"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    by_id = {r.page_id: r for r in got}
    for page_id, url in pages:
        host, path, rule, verdict = fixed(url)
        row = by_id[page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?y=/de/", "x://net", "x://net/",
    "x://a.net#f", "x://notexample.net/en/", "http://example.com/de/", "http://m.example.com/de",
    "http://É.ORG/fr/é?q", "a://b://c/d", "http://org?x=/fr/", "http://h/" + "s/" * 20_000,
    "http://" + "a." * 20_000 + "org/fr/", "http://q.io/?" + "&".join(f"{i:x}=1" for i in range(3_000)),
]


@pytest.fixture
def mined(spark, saved):  # noqa: F811
    """Hosts h0 to h9: on even hosts, pages in /x/ are bad; nothing else is."""
    pages, labels = [], []
    for i in range(600):
        folder = "xyz"[i % 3]
        pages.append((i, f"http://h{i % 10}.test/{folder}/{i}.html", "<p>"))
        labels.append((i, int(not (folder == "x" and i % 2 == 0)), 0))
    pages += [(1000, "http://h2.test/x/9999999", None), (1001, "http://h3.test/x/99", None)]
    pages += [(2000 + i, url, None) for i, url in enumerate(ODD)] + [(0, pages[0][1], "again")]
    labels += [(None, 0, 1), (5, None, None), (77, None, 1), (77, 1, 0)]
    page_rows = spark.createDataFrame(pages, PAGES).selectExpr("*", "'t' AS HOST", "1 AS tokens")
    label_rows = spark.createDataFrame(labels, LABELS)
    return saved(pages=page_rows, labels=label_rows), pages


def test_mined_rules_decide_where_no_fixed_rule_does(spark, mined):
    folder, pages = mined
    rows = QUERIES["op7_url_rules"](spark, folder).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.verdict for r in rows}
    assert got[1000] == "block" and got[1001] == "allow"
    for i in range(600):
        if i != 77:
            assert got[i] == ("block" if i % 3 == 0 and i % 2 == 0 else "allow")


def test_deep_parts_of_urls_make_rules(spark, saved):  # noqa: F811
    """Third segments, inner host labels, single query keys and values."""
    bad = {
        0: "http://h{j}.test/a/{j}/casino/{i}.html",
        1: "http://m{j}.win.site{j}.test/a/b/c/{i}.html",
        2: "http://h{j}.test/a/b/{i}?u=1&track{j}=2&click=3",
        3: "http://h{j}.test/a/b/{i}?mode=bad&k{j}=1",
    }
    good = "http://h{j}.site{j}.test/a/b/{k}/{i}.html"
    calm = "http://h{j}.test/a/b/{i}?u=1&mode=fine&k{j}=1"
    pages, labels = [], []
    for i in range(800):
        form = bad[i % 4] if i % 8 < 4 else (good, calm)[i % 2]
        pages.append((i, form.format(i=i, j="qwertyuiop"[i % 10], k="news"), None))
        labels.append((i, int(i % 8 >= 4), 0))
    new = [bad[k].format(i=9_000 + k, j="new") for k in bad] + [
        f.format(i=9_100, j="new", k="news") for f in (good, calm)
    ]
    pages += [(9_000 + k, url, None) for k, url in enumerate(new)]
    folder = saved(
        pages=spark.createDataFrame(pages, PAGES), labels=spark.createDataFrame(labels, LABELS)
    )
    got = {r.page_id: r.verdict for r in QUERIES["op7_url_rules"](spark, folder).collect()}
    assert [got[9_000 + k] for k in range(6)] == ["block"] * 4 + ["allow"] * 2
    assert all(got[i] == ("block" if i % 8 < 4 else "allow") for i in range(800))


def test_rules_count_items_that_were_not_mined_together(spark, monkeypatch):
    """Counts over whole URLs, against counting by hand, with two items mined together."""
    monkeypatch.setattr(url_rules, "MOST_TOGETHER", 2)
    rows = [(["a", "b", "c"], "block")] * 9 + [(["a", "c", "d"], "allow")] * 4
    rows += [(["b", "d"], "allow")] * 5 + [(["a", "b"], "allow")] * 2 + [([], "block")] * 2
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING")
    known = url_rules.vocabulary(labelled, *url_rules.totals(labelled), 0.1)
    rules = url_rules.rules_of(labelled, known, len(rows), 0.1, 0.6).collect()
    assert {r.antecedent[0] for r in rules if len(r.antecedent) == 1} == {"a", "c", "d"}
    for r in rules:
        has = [label for tokens, label in rows if set(r.antecedent) <= set(tokens)]
        assert r.support == has.count(r.label) and r.confidence == r.support / len(has)
    assert any(len(r.antecedent) == 2 for r in rules)


def test_odd_urls(spark, mined):
    folder, _ = mined
    got = {r.page_id: r for r in QUERIES["op7_url_rules"](spark, folder).collect()}
    for i, url in enumerate(ODD):
        row, (host, path, rule, verdict) = got[2000 + i], fixed(url)
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert row.verdict == (verdict or "allow"), url


def test_rules_match_brute_force(spark):
    """Support and confidence counted directly; every rule that holds is found."""
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b"], "allow")] * 3
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING")
    rules = url_rules.mine(labelled, 0.1, 0.6)
    got = {(tuple(sorted(r.antecedent)), r.label, r.support, round(r.confidence, 6)) for r in rules.collect()}
    want = set()
    for items in (("a",), ("b",), ("c",), ("a", "b"), ("a", "c")):
        has = [label for tokens, label in rows if set(items) <= set(tokens)]
        for label in ("allow", "block"):
            n = has.count(label)
            if n / len(rows) >= 0.1 and n / len(has) >= 0.6:
                want.add((items, label, n, round(n / len(has), 6)))
    assert got == want
    sets = spark.createDataFrame([(["a", "b", "z"],), (["q"],)], "tokens ARRAY<STRING>")
    assert [(r.tokens, r.label) for r in url_rules.judge(sets, rules).collect()] == [
        (["a", "b", "z"], "block")
    ]


@pytest.mark.parametrize("empty", ["labels", "pages"])
def test_empty_tables(spark, saved, empty):  # noqa: F811
    pages = spark.createDataFrame([(1, "http://a.b/c/1", "x")], PAGES)
    labels = spark.createDataFrame([(1, 0, 0)], LABELS)
    frames = {"pages": pages, "labels": labels}
    frames[empty] = frames[empty].where("false")
    rows = QUERIES["op7_url_rules"](spark, saved(**frames)).collect()
    assert [r.verdict for r in rows] == ([] if empty == "pages" else ["allow"])


@pytest.mark.parametrize("together", [2, 4, 10])
def test_combinations_of_all_items_of_long_urls(spark, monkeypatch, together):
    """The best rule of URLs with 13 items, against all of their combinations."""
    monkeypatch.setattr(url_rules, "MOST_TOGETHER", together)
    rng, rows = random.Random(5), []
    for _ in range(160):
        own = [f"t{k:02}" for k in range(13) if rng.random() < (0.55 if k < 11 else 0.8)]
        bad = ("t11" in own) != ("t12" in own) if rng.random() < 0.9 else rng.random() < 0.5
        bad = bad or rng.random() < 0.05 * sum(t < "t11" for t in own)
        rows.append((own, "block" if bad else "allow"))
    rows += [([f"t{k:02}" for k in range(13)], label) for label in ["block"] * 3 + ["allow"] * 2]
    seen, held = Counter(), Counter()
    for own, label in rows:
        for size in range(1, len(own) + 1):
            for some in combinations(own, size):
                seen[some] += 1
                held[some, label] += 1
    best, least = {}, 0.05 * len(rows)
    for own in {tuple(own) for own, _ in rows}:
        fit = [
            (held[some, label] / seen[some], held[some, label], label == "block")
            for size in range(1, len(own) + 1)
            for some in combinations(own, size)
            for label in ("allow", "block")
            if held[some, label] >= least and held[some, label] / seen[some] >= 0.6
        ]
        if fit:
            best[own] = max(fit)
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING")
    known = url_rules.vocabulary(labelled, *url_rules.totals(labelled), 0.05)
    rules = url_rules.rules_of(labelled, known, len(rows), 0.05, 0.6)
    got = {
        tuple(sorted(r.tokens)): (r.confidence, r.label == "block")
        for r in url_rules.judge(labelled.select("tokens").distinct(), rules).collect()
    }
    assert got == {own: (confidence, bad) for own, (confidence, _, bad) in best.items()}
