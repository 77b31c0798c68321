"""Words and ids of the word-end BPE tokenizer file, as the tokenizers library gives them.

Normalisation, the split into words and the special strings follow the file; every distinct word
is merged by the library once for each worker process (a bounded dictionary keeps the ids).
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FILE = "word_bpe_49k.json"
#: The file's split pattern (white space as Unicode's White_Space) and its special strings.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
KEPT_WORDS = 600_000

_special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
#: Outside of these ranges (Latin, Cyrillic, common punctuation) the library normalises.
_controls = re.compile("[\x1c-\x1f]")
_unusual = re.compile("[^\x00-ɏЀ-ҁ‐-‧₠-₿]")


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest are numbered from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _tokens(text: str) -> list[str]:
    """Pieces between white space; str.split also cuts at four control characters that are not
    White_Space, so texts with them stay whole."""
    return [text] if _controls.search(text) else text.split()


class Words:
    """Cuts texts into words and looks up what ``value`` makes of a word's ids. ``join`` makes one
    value of several; values of whole white-space-delimited tokens are kept too, as no word spans
    white space."""

    def __init__(self, path: str, value, join, start: dict | None = None):
        import regex

        self.find = regex.compile(WORDS).findall
        self.find_in_lines = regex.compile(WORDS + r"|\n").findall
        tokenizer = load(path)
        self.normalise = tokenizer.normalizer.normalize_str
        merge, letters, kept = tokenizer.model.tokenize, byte_letters(), KEPT_WORDS

        class Known(dict):
            def __missing__(self, word):
                found = value([t.id for t in merge("".join([letters[b] for b in word.encode()]))])
                if len(self) < kept:
                    self[word] = found
                return found

        cut, known = self.words, Known(start or {})

        class Tokens(dict):
            def __missing__(self, token):
                found = join(map(known.__getitem__, cut(token)))
                if len(self) < kept:
                    self[token] = found
                return found

        self.known, self.tokens, self.join, self.kept = known, Tokens(), join, kept
        self.special = {s: value([i]) for s, i in SPECIAL.items()}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif _unusual.search(text):
            text = self.normalise(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return self.find(text)

    def values(self, text: str) -> list:
        """The values of the text's tokens and special strings, in order."""
        if "<|" not in text or not _special.search(text):
            return list(map(self.tokens.__getitem__, _tokens(text)))
        out = []
        for piece in _special.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out.extend(map(self.tokens.__getitem__, _tokens(piece)))
        return out

    def of_tokens(self, tokens: list[str]) -> list:
        """The values of distinct tokens that hold no line feed; the new ones are cut together, one
        to a line."""
        kept, join, known = self.tokens, self.join, self.known
        out = list(map(kept.get, tokens))
        new = [i for i, value in enumerate(out) if value is None]
        usual = []
        for i in new:
            token = tokens[i]
            if token.isascii() or not _unusual.search(token):
                usual.append(i)
            else:
                out[i] = join(map(known.__getitem__, self.words(token)))
        begin, lines = 0, unicodedata.normalize("NFC", "".join([tokens[i] + "\n" for i in usual])).lower()
        words = self.find_in_lines(lines)
        for i, end in zip(usual, [k for k, word in enumerate(words) if word == "\n"], strict=True):
            out[i] = known[words[begin]] if end == begin + 1 else join([known[w] for w in words[begin:end]])
            begin = end + 1
        kept.update((tokens[i], out[i]) for i in new[: max(0, self.kept - len(kept))])
        return out


def packed_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _gathered(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of texts without special strings: every distinct token between ASCII white
    space is looked up once, and the ids are gathered by the tokens' places."""
    lists = pc.ascii_split_whitespace(texts)
    tokens = lists.flatten().dictionary_encode()
    distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(tokens.dictionary)], tokens.dictionary), "\n")
    found = words.of_tokens(distinct[0].as_py().split("\n")) if len(tokens) else []
    pool = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at = tokens.indices.to_numpy()
    n = size[at]
    ends = np.cumsum(n)
    shift = (np.cumsum(size) - size)[at] - (ends - n)
    place = np.repeat(shift.astype(np.int32), n)  # a piece has far fewer than 2^31 ids
    place += np.arange(len(place), dtype=np.int32)
    ids = pool.take(place)
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
    return ids, bounds


def text_ids(words: Words, texts: pa.Array) -> list[np.ndarray]:
    """The ids of each of ``texts`` (no nulls); ``words`` holds packed ids."""
    ids, bounds = _gathered(words, pc.if_else(pc.match_substring(texts, "<|"), "", texts))
    out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for i in np.flatnonzero(pc.match_substring(texts, "<|")).tolist():  # special strings are cut out first
        out[i] = np.frombuffer(b"".join(words.values(texts[i].as_py())), "<u4")
    return out


_workers: dict[tuple, Words] = {}


def worker_words(kind: str, path: str, value, join, start=None) -> Words:
    """The process's own instance, kept between tasks."""
    if (kind, path) not in _workers:
        _workers[kind, path] = Words(path, value, join, start() if start else None)
    return _workers[kind, path]
