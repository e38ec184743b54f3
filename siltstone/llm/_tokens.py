"""Ids of texts by a vocabulary file. Words are split, told apart and put back in order by Arrow and numpy, so that Python sees each distinct word only."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation: what was not asked for during a whole generation is forgotten.
GENERATION = 200_000
#: Words that are encoded as one text.
GROUP = 100
#: Words that are put in order at a time.
BLOCK = 1 << 19
#: Latin letters whose lower case is one letter of the same kind.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"


class _Known:
    """Ids of words as bytes, of at most two generations."""

    def __init__(self):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, words: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        if len(self.new) > GENERATION:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, words))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking and self.old:
            for i in lacking:
                found[i] = self.old.get(words[i])
            self.new.update((words[i], found[i]) for i in lacking if found[i] is not None)
            lacking = [i for i in lacking if found[i] is None]
        if lacking:
            asked = [words[i] for i in lacking]
            made = learn(asked)
            self.new.update(zip(asked, made))
            for i, x in zip(lacking, made):
                found[i] = x
        return found


class WordTokens:
    """Ids of whole texts, word by word where the vocabulary's rules never look across white space.

    Whether that holds is tried on ``PROBE`` when the file is loaded; for a vocabulary that fails it, texts are encoded whole. Words (split at ASCII white
    space) are looked up among those of the last generations. Of those that are not there, plain ones (Latin letters, at most one mark after
    them, known by their letters in lower case) are encoded many in one text and told apart by their last ids: they need no normaliser but lower case, and no
    pattern but white space. The others are encoded each by itself, with all the vocabulary's rules.
    """

    MARKS = ".,!?;:"
    PROBE = "ab Cd, ef. GH! i? jk; lm: Straße École naïve  x1y2 don't a--b\tn_o (p) «q»\nr... 配送 э́то 12,5 U.S. aaaa zz"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._cores, self._others = _Known(), _Known()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.plain.normalizer = None
        by_space, by_byte = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([by_space, by_byte])
        self.marks = {m: x.tobytes() for m, x in zip(self.MARKS, self._encode(self.tokenizer, list(self.MARKS)))}
        probe = pa.array([self.PROBE.encode()], pa.binary())
        self.by_words = bool(self.ends.any()) and self._by_words(probe)[0].tolist() == self._whole(probe)[0].tolist()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary; null is empty; what is no UTF-8 is U+FFFD) one after the other, and how many each text has."""
        texts = texts.fill_null(b"")
        try:
            texts.view(pa.string() if pa.types.is_binary(texts.type) else pa.large_string()).validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace").encode() for x in texts.to_pylist()], texts.type)
        return self._by_words(texts) if self.by_words else self._whole(texts)

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4") for x in found]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = self._encode(self.tokenizer, [x.decode() for x in texts.to_pylist()])
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(x) for x in made], np.int64)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts.view(pa.string() if pa.types.is_binary(texts.type) else pa.large_string()))
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words, which = coded.dictionary, coded.indices.to_numpy()
        cores = pc.utf8_rtrim(words, characters=self.MARKS)
        after = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy()
        plain = np.asarray(pc.match_substring_regex(cores, _PLAIN)) & (after <= 1)
        lowered = pc.utf8_lower(cores.filter(pa.array(plain))).dictionary_encode()
        distinct = lowered.dictionary.cast(pa.binary()).to_pylist() if len(lowered) else []
        others = words.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
        pieces = [*self._cores.of(distinct, self._plain_words), *self._others.of(others, self._other_words), *self.marks.values(), b""]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(pieces), "<u4")
        # a word is two pieces: its letters (or all of it) and its mark (or nothing)
        piece = np.full((len(words), 2), len(pieces) - 1, np.int64)
        piece[plain, 0] = lowered.indices.to_numpy() if len(lowered) else 0
        piece[~plain, 0] = len(distinct) + np.arange(len(others))
        marked = plain & (after == 1)
        ends = pc.binary_slice(words.filter(pa.array(marked)).cast(pa.binary()), -1).to_pylist()
        at = {m.encode(): len(distinct) + len(others) + i for i, m in enumerate(self.MARKS)}
        piece[marked, 1] = [at[m] for m in ends]
        totals = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths[piece].sum(axis=1)[which])))
        ids = np.empty(totals[-1], np.uint32)
        for at in range(0, len(which), BLOCK):
            run = piece[which[at : at + BLOCK]].ravel()
            n = lengths[run]
            upto = np.cumsum(n)
            ids[totals[at] : totals[at] + upto[-1]] = data[np.repeat(starts[run] - upto + n, n) + np.arange(upto[-1])]
        return ids, np.diff(totals[offsets - offsets[0]])

    def _plain_words(self, words: list[bytes]) -> list[bytes]:
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._encode(self.plain, [b" ".join(g).decode() for g in groups])):
            data, cuts = ids.tobytes(), (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(cuts) == len(group):
                out += map(data.__getitem__, map(slice, [0, *cuts], cuts))
            else:
                out += (x.tobytes() for x in self._encode(self.tokenizer, [w.decode() for w in group]))
        return out

    def _other_words(self, words: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in self._encode(self.tokenizer, [w.decode() for w in words])]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokeniser (with the words it knows) a Python worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]
