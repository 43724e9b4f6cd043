"""Token files, token counts and packing against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelmill.llm import packing, repair, transducer
from panelmill.llm.queries import BYTE_BPE, WORD_BPE
from panelmill.llm.storage import shared_path
from panelmill.llm.tokens import Encoder

ODD = st.text(alphabet=" \n\t.,'!$|<>-_abcRVLestmdXYZ12é́\xa0\x1c\x85日Σ\x00", max_size=40)


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@given(st.lists(ODD, min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_segments_encode_as_whole_texts(path, texts):
    ids, bounds = Encoder.of(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library(path, texts)


@given(st.lists(ODD, min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_transducer_counts_as_the_library(texts):
    size, tokens = transducer.token_counts(pa.array(texts + [None, "a <|endoftext|> b<|endoftext|>"]), transducer.Counter.of(BYTE_BPE))
    assert tokens.tolist() == [len(x) for x in library(BYTE_BPE, texts + [None, "a <|endoftext|> b<|endoftext|>"])]
    assert size.tolist()[: len(texts)] == [len(t.encode()) for t in texts]


def test_state_maps_compose_as_running_the_splitter():
    to, cuts = transducer.splitter()
    kinds = np.random.default_rng(1).integers(0, transducer.CLASSES, 1000).astype(np.uint8)
    state, back = 0, np.zeros(1001, bool)
    want = np.zeros(1000, bool)
    for i, k in enumerate(kinds):
        c = cuts[state * transducer.CLASSES + k]
        want[i] |= bool(c & transducer.HERE)
        if c & transducer.BACK:
            want[i - 1] = True
        state = to[state * transducer.CLASSES + k]
    want[0] = True
    assert (transducer.cut(kinds) == want).all() and not back.any()


@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.integers(2, 4))
@settings(max_examples=60, deadline=None)
def test_grammar_round_trip(docs, least):
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    ids = np.array([x for d in docs for x in d], np.int64)
    seq, cut, rules, lengths = repair.grammar(ids, bounds, 6, least)
    for k, d in enumerate(docs):
        assert repair.expand(seq[cut[k] : cut[k + 1]], rules, 6, lengths).tolist() == d
    assert [len(repair.expand(np.array([6 + r]), rules, 6, lengths)) for r in range(len(rules))] == lengths.tolist()


def test_token_files(spark, odd, small):
    rows = small.select("doc_id", "text").collect()
    got = repair.token_files(small, WORD_BPE, 2).orderBy("doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    start = 0
    for r, g, ids in zip(rows, got, library(WORD_BPE, [r["text"] for r in rows])):
        ids = [*ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)
    got = repair.token_files(odd, WORD_BPE, 2).collect()
    want = sorted(crc([*ids, 2]) for ids in library(WORD_BPE, [r["text"] for r in odd.collect()]))
    assert sorted(g["ids_crc32"] for g in got) == want
    spans = sorted((g["start"], g["start"] + g["n_tokens"]) for g in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert repair.token_files(odd.limit(0), WORD_BPE, 2).count() == 0


def test_random_access(spark, small):
    path = shared_path(spark, "repair-test")
    repair.encode(small, WORD_BPE, 2, shard_tokens=20_000).write.parquet(path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) > 3 and any(r["n_rules"] for r in rows)
    for r in rows[:3]:
        shard = repair.Shard(r.asDict())
        ids, bounds = shard.all_ids()
        for k in range(0, r["n_docs"], 5):
            whole = ids[bounds[k] : bounds[k + 1]].tolist()
            assert shard.ids(k).tolist() == whole
            for a, b in ((0, 1), (3, 17), (len(whole) - 1, len(whole)), (5, 10**6), (7, 7)):
                assert shard.ids(k, a, b).tolist() == whole[a:b]


def test_token_counts_query_shape(odd):
    got = transducer.count_tokens(odd, BYTE_BPE, 5).collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 5) for r, i in zip(odd.collect(), library(BYTE_BPE, [r["text"] for r in odd.collect()]))}
    assert {tuple(g) for g in got} == want and len(got) == odd.count()
    assert transducer.count_tokens(odd.limit(0), BYTE_BPE, 5).count() == 0


def test_packing_places_every_piece_without_gaps(odd, small):
    for docs in (small, odd):
        rows = docs.collect()
        got = packing.pack_documents(docs, BYTE_BPE).collect()
        want = sorted(crc([*i, 0][a:b]) for i in library(BYTE_BPE, [r["text"] for r in rows]) for a, b in _starts(len(i) + 1))
        assert sorted(g["ids_crc32"] for g in got) == want
        bins = {}
        for g in got:
            bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
        for held in bins.values():
            held.sort()
            assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 2048
        total = sum(g["length"] for g in got)
        assert len(bins) <= total / 2048 * 1.05 + 1
    assert packing.pack_documents(odd.limit(0), BYTE_BPE).count() == 0


def _starts(n):
    cuts = [0, *range(n % 2048 or 2048, n, 2048), n] if n > 2048 else [0, n]
    return list(zip(cuts, cuts[1:]))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_every_capacity_holds(rule, sizes):
    length = np.array(sizes)
    bins, offset = packing.best_fit(length, (50, 3, 2600), (1.0, 0.1, 0.3), rule)
    for b in set(bins.tolist()):
        on = bins == b
        assert length[on].sum() <= 50 and on.sum() <= 3 and (length[on] ** 2).sum() <= 2600
        order = np.argsort(offset[on])
        assert (offset[on][order] == np.cumsum(length[on][order]) - length[on][order]).all()
