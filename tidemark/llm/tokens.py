"""Token ids of whole texts by a public tokenizer, with an encoder kept per Python worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

import numpy as np
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

# Encoded pieces one worker remembers before it starts anew: about 150 MB.
KNOWN_PIECES = 600_000

# Fixed value: how byte-level tokenizers split a text before they merge.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Letters, marks and white space that have long been assigned: all splitters agree on them.
_ASSIGNED = re.compile(
    "[^\x00-\u052f\u1e00-\u1fff\u2000-\u20b5\u3000-\u303e\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"
)
# Longer runs without, or of, white space go to the tokenizer, whose time does not grow with the
# square of a run.
LONG_RUN = 1000

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, special_as_text: bool = False) -> "Encoder":
    """The encoder of one tokenizer file; loaded once per process."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Encoder:
    """Encodes texts to the ids that the tokenizer gives for each whole text.

    A byte-level tokenizer whose merges are numbered in their order goes by ranks, which is
    several times as fast. One that drops white space and splits words is given each new word
    once: words of letters go straight to its model, since nothing in them is to be split, others
    many in one text, between separators that none of them holds; words are remembered. Texts
    that either way might get wrong, and tokenizers of other kinds, are encoded whole: those with
    a special token written out (``special_as_text`` tells whether it is plain text), with letters
    or white space that not all splitters know, or with very long runs.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.special_as_text = path, special_as_text
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        added = {one["content"]: one["id"] for one in layout.get("added_tokens") or []}
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.known: dict[str, bytes] = {}
        self.vocabulary = 1 + max([*layout["model"]["vocab"].values(), *added.values()])
        splitter, normalizer = layout.get("pre_tokenizer") or {}, layout.get("normalizer") or {}
        suffix = layout["model"].get("end_of_word_suffix")
        self.words = bool(suffix) and _drops_space(splitter) and _keeps_words_apart(normalizer)
        self.ranks = None if normalizer or suffix else _by_ranks(splitter, layout["model"])
        if self.words:
            self.between = " \x01 "
            (self.separator,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
            self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
            self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The tokenizer itself; not loaded where no text needs it."""
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = self.special_as_text
        return tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if self.ranks:
            return [self._ranked(text) for text in texts]
        return self._by_words(texts) if self.words else self._direct(texts)

    def _ranked(self, text: str) -> bytes:
        if _ASSIGNED.search(text) or self.special.search(text) or _has_long_run(text):
            return self._direct([text])[0]
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        rows = [None if self.special.search(text) else _lower_words(text) for text in texts]
        found = [row and list(map(self.known.get, row)) for row in rows]
        self._learn(
            {
                word
                for row, ids in zip(rows, found)
                if row
                for word, one in zip(row, ids)
                if one is None
            }
        )
        whole = iter(self._direct([text for text, row in zip(texts, rows) if row is None]))
        known = self.known
        return [
            next(whole)
            if row is None
            else b"".join([known[word] if one is None else one for word, one in zip(row, ids)])
            for row, ids in zip(rows, found)
        ]

    def _learn(self, new: set[str]) -> None:
        known, marks = self.known, {}
        mixed, odd = [], []
        for word in new:
            stem = word[:-1] if word[-1] in ".," else word
            known_stem = known.get(stem) if stem.isascii() else None
            if stem.isalpha() and (ids := known_stem or self._letters(stem)):
                known[stem] = ids
                if stem is not word:
                    marks[word] = stem
            else:
                (odd if "\x01" in word else mixed).append(word)
        known.update(zip(mixed, self._together(mixed)))
        known.update(zip(odd, self._direct(odd)))
        stop, comma = self._direct([".", ","])
        for word, stem in marks.items():
            known[word] = known[stem] + (stop if word[-1] == "." else comma)

    def _letters(self, word: str) -> bytes | None:
        """The ids of a word of letters; None for one of letters beyond U+04FF.

        Up to there all letters have long been assigned, so that all splitters know them.
        """
        if not word.isascii():
            word = self.normalizer.normalize_str(word)
            if not word.isalpha() or max(word) > "\u04ff":
                return None
            word = self.as_bytes.pre_tokenize_str(word)[0][0]
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _together(self, texts: list[str]) -> list[bytes]:
        """Texts encoded as one, with a separator between any two."""
        if not texts:
            return []
        joined = self.between.join(texts)
        one = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
        ids = np.array(one.ids, "<u4")
        gaps = np.flatnonzero(ids == self.separator)
        starts, ends = (4 * np.append(0, gaps + 1)).tolist(), (4 * np.append(gaps, len(ids))).tolist()
        data = ids.tobytes()
        return [data[start:end] for start, end in zip(starts, ends)]

    def _direct(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in encoded]


def _by_ranks(splitter: dict, model: dict) -> tiktoken.Encoding | None:
    """The tokenizer as ranks, if its ids are the order in which it merges."""
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex")
    if not plain or splitter.get("add_prefix_space") or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    merges = [one.split(" ") if isinstance(one, str) else one for one in model["merges"]]
    if any(vocabulary.get(a + b) != at for at, (a, b) in enumerate(merges, 256)):
        return None
    if any(len(token) != 1 for token, at in vocabulary.items() if at < 256):
        return None
    letters = byte_letters()
    ranks = {bytes(map(letters.__getitem__, t)): at for t, at in vocabulary.items() if at < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes of Latin 1 are themselves, the others, in order, the letters from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(one): one for one in shown}
    others = sorted(set(range(256)) - set(shown))
    return letters | {chr(256 + at): one for at, one in enumerate(others)}


def _has_long_run(text: str) -> bool:
    if len(text) < LONG_RUN:
        return False
    words = text.split()
    # White space beyond one between words may be one long run.
    spare = len(text) - sum(map(len, words)) - len(words)
    return spare >= LONG_RUN or max(map(len, words), default=0) >= LONG_RUN


def _lower_words(text: str) -> list[str] | None:
    """The words of a text; A-Z are lowered, as the tokenizer would, so that words are alike."""
    if _SEPARATORS.search(text):
        return None
    return text.encode().lower().decode().split()


_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def _drops_space(splitter: dict) -> bool:
    steps = splitter.get("pretokenizers", [])
    if [step.get("type") for step in steps] != ["Split", "ByteLevel"]:
        return False
    pattern = steps[0].get("pattern", {}).get("Regex", "")
    return (
        steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not steps[1].get("add_prefix_space")
    )


def _keeps_words_apart(normalizer: dict) -> bool:
    kinds = [step.get("type") for step in normalizer.get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and normalizer["normalizers"][1] == {
        "type": "Replace",
        "pattern": {"Regex": r"\s+"},
        "content": " ",
    }


def encoded(rows, path: str, end_id: int, text_at: int = 1, chunk_bytes: int = 1 << 20):
    """``(row, ids)`` for each row in order, ids with the end id; a few texts at a time."""
    coder, end = encoder(path), end_id.to_bytes(4, "little")

    def flush(held):
        for row, ids in zip(held, coder.encode([row[text_at] or "" for row in held])):
            yield row, ids + end

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if size >= chunk_bytes or len(held) >= 4096:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)
