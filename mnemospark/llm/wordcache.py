"""Exact, word-cached encoding with the tokenizers library.

BPE never merges across pre-tokens, so a text may be cut wherever the
pre-tokenizer is sure to cut it, and each distinct piece needs encoding once.
Both kinds of public tokenizer files allow a cut at a single space or newline
between two characters that are no white space:

* ``gpt2``: byte-level with the ' ?letters' pattern; a word keeps its space.
* ``wordend``: white space is dropped, words carry an end mark.

Pieces go through the library's own normalizer, pre-tokenizer and BPE model.
Texts with any other white space or with the string of an added token (such as
<|endoftext|>, which the library takes for its id), and tokenizers of any other make,
go through the library whole.  The cache is bounded: two generations of CACHE entries.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE = 600_000
#: White space beside single spaces and newlines between words, first what ASCII has.
_PAIRS = ["  ", "\n\n", " \n", "\n "]
_ODD_ASCII = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_ODD_FURTHER = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_LITTLE = sys.byteorder == "little"
_LOADED: dict[tuple[str, int], "WordCache"] = {}


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str, cache: int = CACHE) -> "WordCache":
    """One cache per Python worker and file."""
    if (path, cache) not in _LOADED:
        _LOADED[path, cache] = WordCache(path, cache)
    return _LOADED[path, cache]


def forget(but: str | None = None) -> None:
    """Drop the caches of this Python worker, but for one file's."""
    for key in [k for k in _LOADED if k[0] != but]:
        del _LOADED[key]


class _Dict2(dict):
    """A dict that keeps its last two generations of at most `most` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordCache:
    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(t.get("normalized") for t in added):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
                self.kind = "gpt2"
            elif spec["model"].get("end_of_word_suffix") and [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
                self.kind = "wordend"
        # A gpt2 text shows its pairs when it is cut: as an empty word or a newline alone, which are never cached.
        self.odd = [*(_PAIRS if self.kind != "gpt2" else []), *_ODD_ASCII, *(t["content"] for t in added)]
        self.alphabet = byte_alphabet()
        self.model = self.tok.model
        self.pieces = _Dict2(self._piece, cache // 4)
        self.first = _Dict2(self._chunk, max(1000, cache // 8))
        self.mid = _Dict2(self._spaced if self.kind == "gpt2" else self._plain, cache)
        self.space = self.alphabet[32]
        self.newline = self._whole("\n") if self.kind == "gpt2" else b""
        if self.kind != "whole":
            import regex

            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.kind == "wordend" else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.cut = regex.compile(pattern).findall

    def _whole(self, text: str) -> bytes:
        return pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalnum():
            word = piece.replace(" ", self.alphabet[32])
        else:
            word = piece.encode().decode("latin-1").translate(self.alphabet)
        return pack([t.id for t in self.model.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not chunk.isascii() and max(chunk) >= "ɐ":  # newer letters: as the library's own Unicode tables have it
            return self._whole(chunk)
        if self.kind == "wordend":
            chunk = chunk.lower() if chunk.isascii() else self.tok.normalizer.normalize_str(chunk)
        if chunk.lstrip(" ").isalpha():  # one piece, kept as chunk only
            return self._piece(chunk)
        if chunk[-1] in ".,;:!?" and chunk[:-1].lstrip(" ").isalpha():  # a word and its mark
            word = chunk[:-1]
            return (self.mid[word[1:]] if word[0] == " " else self.mid[word] if self.kind == "wordend" else self.first[word]) + self.pieces[chunk[-1]]
        pieces = self.cut(chunk)
        return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join([self.pieces[p] for p in pieces])

    def _spaced(self, word: str) -> bytes:
        """A word behind a space, or behind a newline if it begins with one."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(self.space + word)]).tobytes() if _LITTLE else self._chunk(" " + word)
        if word[0] == "\n":
            return self.newline + self.first[word[1:]]
        stem = word[:-1]
        if word[-1] in ".,;:!?" and stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):  # as _chunk() has it
            return self.mid[stem] + self.pieces[word[-1]]
        return self._chunk(" " + word)

    def _plain(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and _LITTLE:
            return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        return self._chunk(word)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.kind == "whole" or any([t in text for t in self.odd]) or not text.isascii() and any([t in text for t in _ODD_FURTHER]):
            return self._whole(text)
        mid = self.mid
        if self.kind == "wordend":
            words = text.replace("\n", " ").split(" ")
            out = list(map(mid.get, words))
        else:
            if text[0].isspace() or text[-1].isspace():
                return self._whole(text)
            words = text.replace("\n", " \n").split(" ")
            out = list(map(mid.get, words))
            out[0] = self.first[words[0]]
        try:
            k = -1
            while True:
                k = out.index(None, k + 1)
                word = words[k]
                if not word or word == "\n":
                    if self.kind == "gpt2":
                        return self._whole(text)
                out[k] = mid[word]
        except ValueError:  # no word is left
            return b"".join(out)
