"""URL rules, Merkle manifests and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelmill.llm import lexical, merkle, url_rules
from panelmill.llm.queries import URL_RULES
from tests.llm.conftest import DOCS, make

PAGES = "page_id long, url string, key string, rule string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# URL rules


def brute_rules(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = low(host), slash + path
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules, ids=None):
    rows = [(ids[i] if ids else i, u, "k", "r") for i, u in enumerate(urls)]
    got = url_rules.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, url_rules.RULES)).collect()
    want = Counter((r[0], *brute_rules(r[1], rules)) for r in rows)
    assert Counter((g.page_id, g.host, g.path, g.rule, g.verdict) for g in got) == want


ODD_URLS = [
    None, "", "no scheme", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/EN/1", "https://example.com/en", "https://xexample.com/en/1", "https://www.example.com/en/1",
    "https://a.www.example.com/en/1", "ftp://net/es/", "http://é.net/fr/日本", "http://example.com:80/en/", "http://u@example.com/en/", "http://example.com./en/", "http://.net/es/x", "http://x.net?/es/", "http://a.net/es/http://com/",
    "http://" + "a." * 4000 + "net/fr/" + "x" * 20_000, "http://net/fr/\n", "http://com/en/\x00/",
]


def test_url_rules_of_the_query(spark):
    rules = [(t.partition("/")[0], "/" + t.partition("/")[2], v) for v, t in URL_RULES]
    urls = ODD_URLS + ["https://blog.example.net/es/1"] * 40 + ["https://blog.example.com/en/1"] * 3
    judged(spark, urls, rules)
    judged(spark, urls, rules, ids=[None if i % 3 else 7 for i in range(len(urls))])


def test_nested_rules_meet_every_cut(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(url_rules, "PER_RANGE", 40)
    labels, steps = ["a", "b", "ab", "com", "net", ""], ["", "a", "b", "ab", "a/", "A", "é"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "/" * rng.randint(0, 1) + "/".join(rng.choices(steps, k=rng.randint(0, 4)))
    rules = [(host(), path() if rng.random() < 0.7 else "/", rng.choice(["allow", "block"])) for _ in range(150)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host()}/{path()}" for _ in range(500)] + ["http://a.com/a/b"] * 300
    judged(spark, urls, rules)


def test_long_keys_that_differ_behind_the_cut(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PER_RANGE", 8)
    long = "/" + "x" * url_rules.CUT
    rules = [("com", "/", "allow"), ("com", long, "block"), ("com", long + "/b", "allow"), ("com", "/y", "block")]
    judged(spark, [f"http://www.com{long}{t}" for t in ("", "/", "/a", "/b", "/bb", "b") for _ in range(10)] + ["http://com/y"] * 30, rules)


def test_url_rules_odd_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", None, None)], PAGES)
    one = lambda rules: [tuple(r) for r in url_rules.judge(pages, spark.createDataFrame(rules, url_rules.RULES), "block").collect()]
    assert one([]) == one([("a.com", "/", None)]) == [(1, "a.com", "/x", None, "block")]
    assert one([("A.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", None, "allow")]) == [(1, "a.com", "/x", "a.com/x", "block")]
    assert url_rules.judge(pages.limit(0), url_rules.rules_of(spark, URL_RULES)).count() == 0


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and the siblings' (left, right) of every node at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            at[i] = p // 16
        nodes = [digest("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    of = {}
    for r in rows:
        of.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        of[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in of[s]])
    root, above = climb([trees[s][0] for s in names])
    out = Counter()
    for s, over in zip(names, above):
        for (_, _, leaf, r), path in zip(of[s], trees[s][1]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = brute_leaf(r, low(r["text"])) if tampered else leaf
            for left, right in path + over:
                node = digest(left + node + right)
            out[r["doc_id"], leaf, trees[s][0], root, digest("".join(a + b for a, b in path + over)), node, node == root] += 1
    return out


@pytest.mark.parametrize("case", ["odd", "small"])
def test_manifest(request, case):
    docs = request.getfixturevalue(case)
    assert Counter(map(tuple, merkle.verification(docs).collect())) == brute_manifest(docs.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_small_blocks(spark, monkeypatch, levels):
    """Sources of every height in blocks of 16 and 256 nodes, so that rounds, cut blocks and many sources are met."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {None: 1, "a": 1, "B": 16, "b": 17, "é": 256, "c": 257, "hot": 700} | {f"s{i}": 1 for i in range(20)}
    rows = [(i % 50 if s == "c" else i, f"Text {s} {i}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows + [rows[-1]] * 40, DOCS)
    assert Counter(map(tuple, merkle.verification(docs).collect())) == brute_manifest(docs.collect())


def test_manifest_of_one_row_and_none(spark):
    docs = make(spark, ["Aé"], ids=[3])
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == brute_leaf(docs.first(), "Aé") and row.path == []
    assert merkle.verification(docs).first().proof_sha256 == digest("")
    assert merkle.verification(docs.limit(0)).count() == 0


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k=10):
    found = [(d, Counter(TERM.findall(low(t or "")))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    holds = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in found:
            n = sum(c.values())
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
                for t in set(TERM.findall(low(text or ""))) if c[t]
            )
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return Counter(out)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    assert Counter(map(tuple, lexical.search(d, b, k).collect())) == brute_search(docs, items, k)


def test_search_odd_texts(spark):
    texts = [None, "", " \n ", "A b_c", "a-b", "ab", "É é ab", "日本 語\x85x", "a a a b\x00c", "a" * 50_000, "b " * 20_000, "A b_c", "¡a! «b»"]
    docs = [(None if i in (4, 8) else i % 9, t) for i, t in enumerate(texts)] + [(5, "a b"), (5, "a b")]
    items = [(1, "a"), (1, "b c"), (None, "É 日本"), (3, None), (4, "..."), (5, "zzz a"), (6, "A b_c a"), (6, "A b_c a"), (7, "«b» x"), (8, "a" * 50_000)]
    searched(spark, docs, items)
    searched(spark, docs, [])
    searched(spark, [], items)
    searched(spark, [(1, None), (2, "")], items)


@pytest.mark.parametrize("terms", [3, 1 << 18])
def test_search_random_texts_in_groups_and_slices(spark, monkeypatch, terms):
    monkeypatch.setattr(lexical, "TERMS", terms)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abé", k=rng.randint(1, 3))) for _ in range(25)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)] + [(200 + i, "a b é") for i in range(80)]
    searched(spark, docs, [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(6)], k=7)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_scores_are_summed_in_pieces(monkeypatch, step):
    monkeypatch.setattr(lexical, "STEP", step)
    rng = np.random.default_rng(step)
    of_term = [rng.choice(30, rng.integers(0, 5), replace=False) for _ in range(12)]
    bounds, items = np.concatenate(([0], np.cumsum([len(x) for x in of_term]))), np.concatenate(of_term).astype(np.int64)
    pairs = sorted({(int(rng.integers(0, 9)), int(rng.integers(0, 12))) for _ in range(60)})
    gain = rng.integers(0, 3, len(pairs))
    want = Counter()
    for (text, term), g in zip(pairs, gain):
        for i in of_term[term]:
            want[text, int(i)] += int(g)
    got = lexical.summed(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), gain, bounds, items, 30)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == {k: v for k, v in want.items() if v > 0}
