"""Token ids of whole texts by a public tokenizer, encoding each distinct segment of a batch once."""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelmill.llm.text import segments, utf8

#: Segments whose ids a worker keeps, at most (some 50 bytes each); the store is emptied when it is full.
KEPT = 800_000
#: Segments of Latin letters, with one space or line break before them at most.
PLAIN = r"\A[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
SPACED = r"\A [A-Za-zÀ-ÖØ-öø-ÿ]+\z"


#: Plain segments that go to the library as one text.
JOINED = 200


class Words:
    """Ids of PLAIN segments by a tokenizer of the same model without the steps that have no effect on them.

    Such a segment is one pre-token and in normal form. Many go to the library as one text; a token tells by its mark where a word ends
    (``fold``: words in lower case, the mark is at their end) or begins (each has a space before it).
    """

    def __init__(self, spec: dict, fold: bool):
        from tokenizers import Tokenizer

        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": not fold}
        pre = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]} if fold else level
        self.fold = fold
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": pre, "added_tokens": [], "truncation": None, "padding": None}))
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[i for t, i in vocabulary.items() if (t.endswith("</w>") if fold else t.startswith("\u0120"))]] = True

    @classmethod
    def of(cls, path: str) -> Words | None:
        """None if the file has other steps than those known here."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        kinds = [n["type"] for n in norm.get("normalizers", [])] if norm else []
        if norm is None and pre == level:
            return cls(spec, False)
        splits = [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and "[\\p{L}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", "") and pre["pretokenizers"][0]["invert"]
        return cls(spec, True) if kinds == ["NFC", "Replace", "Lowercase"] and splits and spec["model"].get("end_of_word_suffix") == "</w>" else None

    def ids(self, news: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each segment, all ids)."""
        joint = " " if self.fold else ""
        texts = [joint.join(news[at : at + JOINED]) for at in range(0, len(news), JOINED)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)
        at = np.flatnonzero(self.mark[ids])
        edge = np.concatenate(([0], at + 1)) if self.fold else np.append(at, len(ids))
        if len(edge) != len(news) + 1:
            raise ValueError("the tokenizer does not mark words as expected")
        return np.diff(edge).astype(np.int32), ids


class Encoder:
    """Ids of the texts of a column by the tokenizers library.

    The ids of a text are those of its segments one after another (see ``segments``), so each distinct segment goes to the library once
    and its ids are copied to every place where it stands. Added-token strings hold no white space and so never cross a cut.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Words.of(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def clear(self) -> None:
        """Forget all segments: ``known`` segments and ``forms`` with the slots of their ids; a slot's ids are ids[start:start + length]."""
        self.known = self.forms = pa.array([], pa.string())
        self.slot = self.form_slot = self.start = self.length = self.ids = np.zeros(0, np.int32)

    def _ids(self, news: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(news, add_special_tokens=False)]
        return np.fromiter(map(len, each), np.int32, len(each)), np.fromiter(itertools.chain.from_iterable(each), np.int32)

    def _store(self, ids_of, news: pa.Array) -> np.ndarray:
        """Slots of the ids of ``news``."""
        parts = [ids_of(news[at : at + 20_000].to_pylist()) for at in range(0, len(news), 20_000)]
        first = len(self.length)
        self.length = np.concatenate([self.length, *(p[0] for p in parts)])
        self.ids = np.concatenate([self.ids, *(p[1] for p in parts)])
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        return np.arange(first, len(self.length), dtype=np.int32)

    def _add(self, news: pa.Array) -> None:
        slot = np.zeros(len(news), np.int32)
        plain = np.zeros(len(news), bool)
        if self.words:
            plain = np.asarray(pc.match_substring_regex(news, PLAIN if self.words.fold else SPACED))
            simple = news.filter(pa.array(plain))
            if self.words.fold:
                forms = pc.utf8_lower(pc.utf8_trim(simple, " \n")).dictionary_encode()
                other = forms.dictionary.filter(pc.is_null(pc.index_in(forms.dictionary, self.forms)))
                self.form_slot = np.concatenate([self.form_slot, self._store(self.words.ids, other)])
                self.forms = pa.concat_arrays([self.forms, other])
                slot[plain] = self.form_slot[np.asarray(pc.index_in(forms.dictionary, self.forms))[np.asarray(forms.indices)]]
            else:
                slot[plain] = self._store(self.words.ids, simple)
        slot[~plain] = self._store(self._ids, news.filter(pa.array(~plain)))
        self.slot = np.concatenate([self.slot, slot])
        self.known = pa.concat_arrays([self.known, news])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's ids among them; null texts are empty."""
        data, offsets = utf8(column)
        pieces, bounds = segments(data, offsets)
        coded = pieces.dictionary_encode()
        if len(self.known) > KEPT:
            self.clear()
        at = pc.index_in(coded.dictionary, self.known)
        new = np.asarray(pc.is_null(at))
        at = np.array(at.fill_null(0))
        at[new] = len(self.known) + np.arange(new.sum())
        if new.any():
            self._add(coded.dictionary.filter(pa.array(new)))
        where = self.slot[at][np.asarray(coded.indices)]
        length = self.length[where]
        total = np.zeros(len(where) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[where] - total[:-1], length)]
        return ids, total[bounds]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each closed by the id ``end``."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
