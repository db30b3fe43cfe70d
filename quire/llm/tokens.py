"""Whole-text encoding as the public tokenizers' own library gives it, at less cost.

The library's BPE is slow on text whose words it hasn't seen. Texts whose characters are all in a range where every
regular-expression engine has the same classes are encoded from the same file's merges by tiktoken; all other texts go
to the library whole. Both give the same ids: merges by rank of the merged bytes equal merges by rank of the pair,
because every token of these vocabularies is the encoding of its own bytes (tests/llm/test_tokens.py holds that).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property

import numpy as np

#: Longer runs without white space go to the library, whose cost doesn't grow with their square.
LONGEST = 400

#: Characters with the same class in every engine, for which white space is the space and the line feed alone, and no
#: run without white space above LONGEST.
_WORD = "[!-~¡-¬®-ɏ]{0,%d}+" % LONGEST
_PLAIN = re.compile(rf"(?:{_WORD}[ \n]++)*+{_WORD}")
#: The pre-tokenizer patterns that the two files name.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Ends a word in the merges of files with an end-of-word suffix; no plain text has it.
_END = "\x01"
_WORDS = "[^\x01]*+\x01"

_loaded: dict[tuple, object] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer with padding and truncation off."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others in
    order from U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary and merges of a tokenizers file as tiktoken ranks; `bytes` has the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, alphabet = whole["model"], byte_alphabet()
        suffix = model["end_of_word_suffix"] or ""

        def raw(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            return bytes(alphabet[c] for c in (token.removesuffix(suffix) if end else token)) + _END.encode() * end

        special = {x["content"] for x in whole["added_tokens"]}
        self.special = tuple(sorted(special))
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merged = [a + b for a, b in pairs]
        assert len(set(merged)) == len(merged) and set(merged) <= set(vocab), "merges that share a result"
        rest = sorted(set(vocab) - set(merged), key=lambda t: (len(raw(t)), vocab[t]))
        order = [*rest, *merged]
        self.ids = np.array([vocab[t] for t in order], "<u4")
        self.same = bool((self.ids == np.arange(len(order))).all())
        self.bytes: list[bytes] = [b""] * (max([*model["vocab"].values(), *(x["id"] for x in whole["added_tokens"])]) + 1)
        for token, i in model["vocab"].items():
            self.bytes[i] = token.encode() if token in special else raw(token)
        for x in whole["added_tokens"]:
            self.bytes[x["id"]] = x["content"].encode()
        ranks = {raw(t): i for i, t in enumerate(order)}
        assert len(ranks) == len(order), "two tokens with the same bytes"
        self.engine = tiktoken.Encoding(f"quire-{path}", pat_str=_WORDS if suffix else pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        ranks = self.engine.encode_to_numpy(text)
        return ranks if self.same else self.ids[ranks]


def plain(text: str, special: tuple[str, ...]) -> bool:
    """Whether all engines read this text alike."""
    return _PLAIN.fullmatch(text) is not None and not any(x in text for x in special)


class ByteEncoder:
    """encode(texts): for each text the ids of tokenizer.encode(text, add_special_tokens=False), as little-endian
    unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path, self.merges = path, Merges(path, BYTE_PATTERN)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded by the first text that needs it."""
        return load(self.path)

    @classmethod
    def shared(cls, path: str):
        """One for each worker process."""
        if (cls, path) not in _loaded:
            _loaded[cls, path] = cls(path)
        return _loaded[cls, path]

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rest(self, texts: list[str], out: list[np.ndarray | None]) -> list[np.ndarray]:
        """out with the library's ids where there are none."""
        if rest := [i for i, x in enumerate(out) if x is None]:
            for i, ids in zip(rest, self.library([texts[i] for i in rest]), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [self.merges.encode(x) if plain(x, self.merges.special) else None for x in texts]
        return self._rest(texts, out)


def _splitter(characters: str) -> re.Pattern[str]:
    """WORD_PATTERN for texts of these characters alone, with its classes written out: Python's own engine has no \\p,
    and is twice as fast as one that has. Where an alternative may begin with an apostrophe the order is kept."""
    kinds = {c: unicodedata.category(c)[0] for c in characters}
    letters, numbers = (re.escape("".join(c for c in characters if kinds[c] == k)) for k in "LN")
    return re.compile(rf"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^\s{letters}{numbers}]+")


class WordEncoder(ByteEncoder):
    """The same for lower-casing tokenizers that drop white space: a text's words get end marks by one split, and go
    to tiktoken in one call."""

    def __init__(self, path: str):
        self.path, self.merges = path, Merges(path, WORD_PATTERN)
        self.ascii = _splitter("".join(map(chr, range(128))))
        # also what the lower-case forms of these characters hold
        self.latin = _splitter("".join(sorted({c for i in range(0x250) for c in chr(i) + chr(i).lower()})))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._rest(texts, [self._words(x) if plain(x, self.merges.special) else None for x in texts])

    def _words(self, text: str) -> np.ndarray:
        words = (self.ascii if text.isascii() else self.latin).findall(text.lower())
        return self.merges.encode(_END.join([*words, ""])) if words else np.zeros(0, "<u4")
