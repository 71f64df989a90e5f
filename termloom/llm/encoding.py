"""Token ids of whole texts by the tokenizers library, one encoding for each distinct word.

The vocabulary file's normalizer and pre-tokenizer never join characters across white
space, so a text's ids are its words' ids in order. Words repeat far more often than texts:
each worker keeps the ids of the words it has met, in a store of bounded size, and only new
words reach the library. A word of Latin letters is known in lower case and apart from the
punctuation after it, as the normalizer and the pre-tokenizer would have it: that leaves far
fewer words to know. Another word of ASCII and Latin signs is cut by the file's own pattern
and its pieces go to the library's model; any other word, and any text that could hold a
special token, goes through the library's whole encoder. So does every text where the
vocabulary file has other rules than those that this was read off.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import ranges

END_ID = 2
#: The store is emptied when a batch finds more words than this in it.
MAX_WORDS, MAX_PIECES = 400_000, 60_000
#: Words of Latin letters that have one-letter lower cases, and what may follow them.
LETTERS = "^(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+)(?P<tail>[.,;:!?]*)$"
#: Bytes of text to encode at a time: a batch's new words have to leave room in the store for old ones.
BATCH_BYTES = 8 << 20
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the executor's own copy of a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """ids of a batch of texts; safe to keep for a worker's life."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0]["pattern"]
        if self.by_word:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        # letters here are composed already and have one-letter lower cases; U+0130 has not
        self.simple = regex.compile("[\x21-\x7e¡-¬®-įı-ňŊ-ž]+")
        self.letters = byte_letters()
        self.words: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self._clear()

    def _clear(self) -> None:
        self.words.clear()
        self.flat = np.zeros(1 << 20, dtype=self.kind)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _model(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            found = self.pieces[piece] = self._model(piece)
        return found

    def word(self, word: str) -> bytes:
        """A word's ids, packed."""
        plain = self.by_word and word.isascii()
        if plain and word.isalpha():  # one piece, as most words are: the word's own place in the store will do
            return self._model(word.lower())
        if self.by_word and (plain or self.simple.fullmatch(word)) and "<|" not in word and word.isprintable():
            return b"".join([self._piece(p) for p in self.pattern.findall(word.lower())])
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _numbers(self, unique: list[str]) -> np.ndarray:
        """The words' places in the store; new words are encoded and added."""
        words, known, before = self.words, self.words.get, len(self.words)
        place, fresh = [], []
        for w in unique:
            k = known(w)
            if k is None:
                k = words[w] = before + len(fresh)
                fresh.append(self.word(w))
            place.append(k)
        if fresh:
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) // self.flat.itemsize
            end, most = self.used + int(sizes.sum()), before + len(fresh)
            if most > len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * most), np.resize(self.sizes, 2 * most)
            if end > len(self.flat):
                self.flat = np.resize(self.flat, 3 * end // 2)
            self.flat[self.used : end] = np.frombuffer(b"".join(fresh), self.kind)
            self.sizes[before:most] = sizes
            self.starts[before:most] = self.used + np.cumsum(sizes) - sizes
            self.used = end
        return np.array(place, np.int64)

    def _known(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct words one after the other, where each word's begin, and how many they are."""
        parts = pc.extract_regex(unique, LETTERS)
        core = pc.if_else(parts.is_valid(), pc.utf8_lower(pc.struct_field(parts, "core")), unique).dictionary_encode()
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        cores = core.dictionary.to_pylist()
        place = self._numbers(cores + tail.dictionary.to_pylist())
        both = np.empty((len(unique), 2), np.int64)
        both[:, 0] = place[: len(cores)][core.indices.to_numpy(zero_copy_only=False)] if len(unique) else 0
        both[:, 1] = place[len(cores) :][tail.indices.to_numpy(zero_copy_only=False)] if len(unique) else 0
        sizes = self.sizes[both]
        lengths = sizes.sum(axis=1)
        return self.flat[ranges(self.starts[both].ravel(), sizes.ravel())], np.cumsum(lengths) - lengths, lengths

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of many texts (null: empty), each with end_id appended if given."""
        texts = texts.fill_null("")
        odd = np.full(len(texts), not self.by_word)
        for special in self.specials if self.by_word else ():  # a special token may stand in or across words
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = words.dictionary_encode()
        if len(self.words) > MAX_WORDS:
            self._clear()
        flat, starts, lengths = self._known(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
        sizes = lengths[at]
        ids = flat[ranges(starts[at], sizes)]
        counts = np.bincount(row, weights=sizes, minlength=len(texts)).astype(np.int64)
        if odd.any():
            return self._mixed(texts, odd, ids, counts, end_id)
        return _ended(ids, counts, end_id)

    def _mixed(self, texts, odd, ids, counts, end_id):
        offsets = np.concatenate([[0], np.cumsum(counts)])
        parts = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.flat.dtype) if odd[i] else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return _ended(np.concatenate(parts), np.array([len(x) for x in parts], np.int64), end_id)


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids.astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end_id, dtype=np.uint32)
    out[ranges(offsets[:-1], counts)] = ids
    return out, offsets


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> WordEncoder:
    """The worker's own encoder, loaded once."""
    return WordEncoder(path or vocabulary_path())
