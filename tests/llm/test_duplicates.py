"""Near-duplicates, passages, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelmill.llm import components, dart, spans, srs
from panelmill.llm.storage import read
from tests.llm.conftest import DOCS, make

WORDS = ["".join(random.Random(i).choices("abcdefghijklm", k=2 + i % 6)) for i in range(500)]


def prose(rng, sentences, start=0):
    return [" ".join(rng.choices(WORDS, k=rng.randint(6, 14))) + "." for _ in range(sentences)]


def weighted(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else float(not a and not b)


def brute_classes(rows):
    sets = [weighted(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    out = {}
    for k in range(len(rows)):
        out.setdefault(root(k), []).append(rows[k][0])
    return Counter(tuple(sorted(map(str, v))) for v in out.values())


def grouped(rows):
    out = {}
    for doc, label in rows:
        out.setdefault(label, []).append(doc)
    return Counter(tuple(sorted(map(str, v))) for v in out.values())


def edited(rng, text, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = "zz" + rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """Originals, copies, a star of copies that are similar to their original only, and a chain."""
    rng = random.Random(5)
    texts = [" ".join(prose(rng, 12)) for _ in range(60)]
    texts += texts[:10] + [edited(rng, t, 0.01) for t in texts[10:30]] + [edited(rng, texts[30], 0.018) for _ in range(40)]
    chain = texts[31]
    for _ in range(6):
        chain = edited(rng, chain, 0.015)
        texts.append(chain)
    texts += ["one two", "one two", "", None, " \n", "a b c d e f"]
    return make(spark, texts)


@pytest.mark.parametrize("block", [256, 8])
def test_classes_equal_brute_force(copies, monkeypatch, block):
    monkeypatch.setattr(dart, "BLOCK", block)
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    got = dart.classes(copies).collect()
    assert grouped([(g["doc_id"], g["class_id"]) for g in got]) == brute_classes(rows)
    size = Counter(g["class_id"] for g in got)
    assert all(g["class_size"] == size[g["class_id"]] for g in got)


def test_classes_of_the_small_table(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert grouped([(g["doc_id"], g["class_id"]) for g in dart.classes(small).collect()]) == brute_classes(rows)


def test_near_duplicates_odd_rows(odd):
    got = dart.classes(odd)
    assert got.count() == odd.count()
    kept = dart.first_of_each(odd)
    assert kept.columns == odd.columns
    want = sum(brute_classes([(i, r["text"]) for i, r in enumerate(odd.collect())]).values())
    assert kept.count() == want
    assert dart.classes(odd.limit(0)).count() == 0 and dart.first_of_each(odd.limit(0)).count() == 0


def test_dart_collisions_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 2**62, 300), rng.exponential(3, 300))}
    b = {k: w * rng.uniform(0.5, 1.6) for k, w in a.items() if rng.random() < 0.9}
    want = sum(min(a[k], b.get(k, 0)) for k in a) / sum(max(a[k], b.get(k, 0)) for k in a)
    agree = []
    for turn in range(30):
        keys = [np.array(sorted(s), np.uint64) for s in (a, b)]
        values = np.concatenate([[s[int(k)] for k in ks] for s, ks in zip((a, b), keys)])
        salted = dart.mix(np.concatenate(keys) + np.uint64(turn * 7919))
        sig = dart.dart_signatures(salted, values, np.array([0, len(a), len(a) + len(b)]))
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - want) < 0.03


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (23, 22), (5, 5), (-7, 20)], "u long, v long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), *((n, -7) for n in (-7, 20, 21, 22, 23))}


def brute_removed(rows):
    """Removed sentence numbers by (doc_id, text), with sentences cut by a regular expression."""
    cut = {}
    places = {}
    for doc, text in {(d, t) for d, t in rows if t}:
        parts, at = [], 0
        for m in re.finditer(r"[ \t\n\r\x0b\x0c]+", text):
            before = text[: m.start()]
            if "\n" in m[0] or before.endswith((".", "!", "?", "…")):
                parts.append(text[at : m.end()])
                at = m.end()
        parts.append(text[at:])
        parts = [p for p in parts if p]
        words = [p.lower().split() for p in parts]
        cut[doc, text] = (parts, set())
        for i in range(len(parts)):
            if not words[i]:
                continue
            n = held = 0
            for j in range(i, len(parts)):
                n += len(words[j])
                held += bool(words[j])
                if n >= spans.WORDS and held >= spans.SENTENCES:
                    places.setdefault(tuple(tuple(w) for w in words[i : j + 1] if w), []).append((doc, text, i, j + 1))
                    break
    for found in places.values():
        found.sort(key=lambda p: (p[0], p[2]))
        for doc, text, i, j in found[1:]:
            cut[doc, text][1].update(range(i, j))
    return cut


def test_spans_equal_brute_force(spark, small):
    rng = random.Random(8)
    passage, other = " ".join(prose(rng, 5)), "\n".join(prose(rng, 3))
    texts = [" ".join(prose(rng, 8)) for _ in range(20)]
    texts += [" ".join([*prose(rng, 3), passage, *prose(rng, 2)]) for _ in range(12)] + [other + "\n" + " ".join(prose(rng, 4)) for _ in range(5)]
    texts += [passage, passage + " " + passage, "Short. One.", "Short. One.", "no stop at all " * 9, " ", "", None]
    for docs in (make(spark, texts), small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = brute_removed(rows)
        for g in spans.report(docs).collect():
            text = dict(rows)[g["doc_id"]]
            if not text:
                assert (g["text"], g["n_removed"], g["n_sentences"]) == (text, 0, 0)
                continue
            parts, gone = want[g["doc_id"], text]
            assert g["n_sentences"] == len(parts) and set(g["removed"]) == gone and g["n_removed"] == len(gone)
            assert g["text"] == "".join(p for k, p in enumerate(parts) if k not in gone)


def test_spans_odd_rows(odd):
    got = spans.cleaned(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())
    twice = [r["text"] for r in got.collect() if r["text"] and r["text"].startswith("Same")]
    assert len(twice) == 3 and len(set(twice)) == 1  # fewer words than a span
    long = next(r["text"] for r in odd.collect() if r["doc_id"] == 6)
    rows = [(1, long + ". The end.", "x", "y", 1), (1, long + ". The end.", "x", "y", 1), (2, long + ". The end.", "x", "y", 1)]
    left = spans.cleaned(odd.sparkSession.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()
    assert [r["text"] == "" for r in left] == [False, False, True] and left[2]["n_chars"] == 0  # equal rows are one document
    assert spans.cleaned(odd.limit(0)).count() == 0


def exact(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    size = Counter(len(v) for _, v in ok).most_common(1)[0][0]
    ok = [x for x in ok if len(x[1]) == size]
    out = {}
    for i, q in ok:
        if i % every == 0:
            best = {}
            for j, v in ok:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(v @ q))
            out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("scale", [1.0, 4.0])
def test_neighbours_recall(spark, monkeypatch, scale):
    monkeypatch.setattr(srs, "BLOCK", 200)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 24)) + np.repeat(rng.normal(size=(50, 24)) * 2, 50, 0)
    x *= rng.uniform(1, scale, len(x))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = srs.nearest(spark.createDataFrame(rows, "vec_id long, e array<double>"), "e", 20).collect()
    want = exact(rows, 20, 20)
    found = {}
    for g in got:
        found.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert found.keys() == want.keys() and all(sorted(r for r, _, _ in f) == list(range(1, 21)) for f in found.values())
    assert np.mean([len({v for _, v, _ in found[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(s - x[q] @ x[v]) < 1e-9 for q, f in found.items() for _, v, s in f)


def test_neighbours_odd_rows(spark):
    bad = [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 2.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (140, [1.0, 2.0])]
    good = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (20, [0.0, 3.0, 0.0]), (3, [0.0, 1.0, 2.0]), (3, [0.0, 1.0, 2.0])]
    schema = "vec_id long, e array<double>, score string"
    got = srs.nearest(spark.createDataFrame([(*r, "x") for r in bad + good], schema), "e", 20).orderBy("query_id", "rank").collect()
    want = [(q, n + 1, v, s) for q, f in sorted(exact(bad + good, 20, 20).items()) for n, (v, s) in enumerate(f)]
    assert [tuple(g) for g in got] == want
    assert srs.nearest(spark.createDataFrame([], schema), "e", 20).count() == 0
    assert srs.nearest(spark.createDataFrame([(0, [1.0], "x")], schema), "e", 20).count() == 0


def test_neighbours_count_ids_not_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [9.0 - j / 100, float(i), 1.0]) for i in range(1, 5) for j in range(30)] + [(i, [8.0 - i / 100, 1.0, 0.0]) for i in range(21, 61) if i % 20]
    got = srs.nearest(spark.createDataFrame(rows, "vec_id long, e array<double>"), "e", 20).orderBy("rank").collect()
    assert [(g["rank"], g["vec_id"], g["score"]) for g in got] == [(n + 1, v, s) for n, (v, s) in enumerate(exact(rows, 20, 20)[0])] and len(got) == 20


def test_neighbours_of_copies_of_the_longest_vector(spark, monkeypatch):
    monkeypatch.setattr(srs, "BLOCK", 50)
    rng = np.random.default_rng(11)
    top = rng.integers(3, 9, 24).astype(float)
    rows = [(i, top.tolist() if i % 4 == 0 else rng.integers(-2, 3, 24).astype(float).tolist()) for i in rng.permutation(2000).tolist()]
    got = srs.nearest(spark.createDataFrame(rows, "vec_id long, e array<double>"), "e", 20).collect()
    found = {}
    for g in got:
        found.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"]))
    assert len(found) == 100
    for q, f in found.items():
        assert [v for _, v in sorted(f)] == [v for v in range(0, 2000, 4) if v != q][:20]


def test_rounding_does_not_end_a_search_among_copies():
    norm, q = 3.0, np.array([[3.0, 0.0]])
    target = np.ones((1, srs.DIM))
    points = np.repeat(target, 5, 0) + 1e-7 * np.arange(1, 6)[:, None]
    who, row, score = srs.search(points, np.repeat(q, 5, 0), np.arange(1, 6), target, q, np.array([0]), np.zeros(1), norm, 3)
    assert row.tolist() == [0, 1, 2] and score.tolist() == [9.0] * 3


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, before, sf)
        if name != "packing":
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        if name in ("toxicity", "near_dedup"):
            assert 0 < after.count() < before.count()
        if name == "near_dedup":
            rows = [(i, r["text"]) for i, r in enumerate(after.collect())]
            assert max(map(len, brute_classes(rows))) == 1
            assert sum(brute_classes([(r["doc_id"], r["text"]) for r in before.collect()]).values()) == after.count()
        if name == "substring_dedup":
            assert after.count() == before.count()
        before = after
    assert before.select("sequence_id").distinct().count() <= before.agg({"length": "sum"}).first()[0] / 2048 * 1.1 + 1


def test_pipeline_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
