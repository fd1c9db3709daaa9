"""Ids of whole texts from a public tokenizer, with a memory of the words met before."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from tessera.llm.words import BASES, span_hashes

MEMO_WORDS = 1_000_000
"""Words whose ids are remembered; beyond it, those of the last texts stay."""
MEMO_IDS = 64
"""Words with more ids are not remembered."""
CALL_WORDS = 512
"""Words that go to the tokenizer in one call."""
CHUNK = 1 << 20
"""Bytes of text that are encoded together."""

_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?")] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[c for c in range(128) if chr(c).isalpha()]] = True
_LINE, _MARK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
"""Tell a word at the start of a line, and a mark, from the same bytes after a space."""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo:
    """Ids by 64-bit hash of the word, checked by a second one, in sorted arrays."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.checks = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Where the keys are, or would be; whether they are there; whether one is there
        for another word."""
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return place, np.zeros(len(keys), dtype=bool), False
        near = np.minimum(place, len(self.keys) - 1)
        known = self.keys[near] == keys
        return place, known, bool((self.checks[near[known]] != checks[known]).any())

    def add(self, keys, checks, place, ids: list[np.ndarray]) -> None:
        """Add new sorted keys at their places."""
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        at = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, *ids])
        self.keys = np.insert(self.keys, place, keys)
        self.checks = np.insert(self.checks, place, checks)
        self.at = np.insert(self.at, place, at)
        self.sizes = np.insert(self.sizes, place, sizes)

    def spans(self, place: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, joined."""
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        offset = np.repeat(self.at[place] - (ends - sizes), sizes)
        return self.pool[offset + np.arange(len(offset))]

    def keep(self, place: np.ndarray) -> None:
        self.pool = self.spans(place)
        self.keys, self.checks, self.sizes = self.keys[place], self.checks[place], self.sizes[place]
        self.at = np.cumsum(self.sizes) - self.sizes


class TextEncoder:
    """Encode texts as the tokenizer itself would, without adding special tokens.

    A byte-level pre-tokenizer starts a new piece at a space or line end that stands
    between other characters, and at a mark that follows a letter; what comes after never
    looks back.  Texts are cut there, each distinct word is encoded once, and the ids are
    joined.  Texts with runs of white space or with other white space than spaces and line
    ends, and all texts for other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        self.cuttable = (
            made.get("normalizer") is None
            and made.get("post_processor") is None
            and kind.get("type") == "ByteLevel"
            and kind.get("use_regex", True)
            and not kind.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in made["added_tokens"])
        )
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.line = self._ids("\n")
        self.memo = Memo()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _after_spaces(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that follow a space: in a text of them, the first id of each word,
        and no other, begins with the space."""
        made = []
        for k in range(0, len(words), CALL_WORDS):
            some = words[k : k + CALL_WORDS]
            ids = self._ids(" " + " ".join(some))
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some):
                made += np.split(ids, starts[1:])
            else:
                made += [self._ids(" " + w) for w in some]
        return made

    def _plain(self, text: str) -> bool:
        """Whether single spaces and line ends stand between words."""
        if not text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
            return False
        if text[0] in " \n" or text[-1] in " \n":
            return False
        return not any(c in text for c in _SPACES[: 8 if text.isascii() else None])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        plain: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if self.cuttable and self._plain(text):
                plain.append(k)
                size += len(text)
                if size >= CHUNK:
                    self._encode_plain(texts, plain, out)
                    plain, size = [], 0
            else:
                out[k] = self._ids(text)
        if plain:
            self._encode_plain(texts, plain, out)
        return out

    def _encode_plain(self, texts: list[str], chosen: list[int], out: list) -> None:
        data = ("\n" + "\n".join([texts[k] for k in chosen])).encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        begin = np.flatnonzero((raw == 32) | (raw == 10))
        end = np.append(begin[1:], len(raw))
        marked = _MARKS[raw[end - 1]] & _LETTERS[raw[end - 2]] & (end - begin > 2)
        marks = end[marked] - 1
        starts = np.concatenate([begin + 1, marks])
        ends = np.concatenate([end - marked, marks + 1])
        kind = np.zeros(len(starts), dtype=np.uint64)
        kind[: len(begin)][raw[begin] == 10] = _LINE
        kind[len(begin) :] = _MARK
        order = np.argsort(starts, kind="stable")
        starts, ends, kind = starts[order], ends[order], kind[order]
        keys = span_hashes(raw, starts, ends) ^ kind
        checks = span_hashes(raw, starts, ends, BASES[1]) ^ kind
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place, known, taken = self.memo.find(unique, checks[first])
        if taken or (checks != checks[first][back]).any():  # two words of one hash
            for k in chosen:
                out[k] = self._ids(texts[k])
            return
        new = np.flatnonzero(~known)
        if len(new):
            at = first[new]
            words = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            kinds = kind[at]
            ids: list = [None] * len(new)
            spaced = np.flatnonzero(kinds == 0).tolist()
            for k, got in zip(spaced, self._after_spaces([words[k] for k in spaced])):
                ids[k] = got
            for k in np.flatnonzero(kinds != 0).tolist():
                alone = self._ids(words[k])
                ids[k] = np.concatenate([self.line, alone]) if kinds[k] == _LINE else alone
            self.memo.add(unique[new], checks[at], place[new], ids)
            place, _, _ = self.memo.find(unique, checks[first])
        everything = self.memo.spans(place[back])
        sizes = np.concatenate([[0], np.cumsum(self.memo.sizes[place][back])])
        lengths = np.array([len(texts[k].encode()) + 1 for k in chosen])
        heads = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)
        cuts = sizes[heads]
        for k, a, b in zip(chosen, cuts.tolist(), cuts[1:].tolist()):
            out[k] = everything[a + len(self.line) : b]
        if len(self.memo.keys) > MEMO_WORDS:
            self.memo.keep(place)
        long = self.memo.sizes > MEMO_IDS
        if long.any():
            self.memo.keep(np.flatnonzero(~long))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a Python worker: its memory outlives a task."""
    return TextEncoder(path)
