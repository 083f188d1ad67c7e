"""Encoding with a public tokenizer, a white-space chunk at a time.

The tokenizer's rules never look across white space: its normaliser works on characters, its
splitter drops white space, and its merges stay inside one word of the splitter. So the ids of a
text are the ids of its white-space chunks in order, and those of a chunk the ids of its words. A
chunk or word that was met before need not be encoded again; a word that is new to a worker goes to
the library, and so does the normalising and splitting of chunks beyond ASCII that are no plain
Latin words.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import cache

#: Control characters that ``str.split`` takes for white space and the tokenizer does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"

#: The white space of ASCII that the tokenizers library's \\s means.
_SPACE = r"\t-\r "

#: Below this, what is a letter, its lower case, and that it composes with no other, is the same in every release of Unicode in use.
_STABLE = "\u0250"

#: Punctuation of which a run after letters is a word of its own. Apostrophes begin other words.
_TAIL = "!#$%&*+,-./:;=?|"

#: Entries of each of the two generations of a cache. It bounds a worker's memory, not its results.
CACHE_ENTRIES = 300_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on the machine that asks; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def read_rules(path: str) -> dict:
    """A tokenizer file, if its rules are those provided for here: lower-cased words, BPE, no decoder."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    rules = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
    if model["type"] != "BPE" or rules != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or model["ignore_merges"] or model["dropout"]:
        raise ValueError("this tokenizer file has rules that are not provided for")
    return spec


@cache
def id_bytes(path: str) -> int:
    """Bytes that hold any id of a vocabulary: 2 or 4."""
    spec = read_rules(path)
    return 2 if max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) < 1 << 16 else 4


class Memory(dict):
    """Remembers what ``make`` gives, for about twice ``entries`` keys; it bounds memory, not results.

    Once the entries are many they become the old generation, which the next one replaces. Known keys
    are found without a call into Python.
    """

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        if not key:
            return b""
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where it prints, else one from 256 upwards."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def library(path: str):
    """Symbols of a word to its ids, by the tokenizers library's model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    return lambda symbols: [x.id for x in tokenize(symbols)]


def library_words(path: str):
    """A text to the symbols of its words, by the tokenizers library's own normaliser and splitter.

    Which characters are letters, compose, or have a lower case depends on a release of Unicode, so
    for anything beyond ASCII the library that defines the ids is the one to ask.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    rules = Tokenizer.from_str(json.dumps(read_rules(path) | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
    normal, split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
    return lambda text: [symbols for symbols, _ in split(normal(text))]


class TextEncoder:
    """Encodes texts to packed little-endian unsigned ids of ``width`` bytes.

    encode_word: the ids of a word of the splitter, which comes as symbols of the byte alphabet.
    """

    def __init__(self, path: str, encode_word=None, width: int = 4):
        import regex

        spec = read_rules(path)
        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}")).findall
        self._beyond_ascii = library_words(path)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        encode_word = encode_word or library(path)
        code = {2: "H", 4: "I"}[width]
        pack = [struct.Struct(f"<{n}{code}").pack for n in range(64)]
        self._names = {name: pack[1](i) for name, i in special.items()}
        symbol = byte_alphabet().__getitem__

        def packed(symbols: str) -> bytes:
            ids = encode_word(symbols)
            return pack[len(ids)](*ids) if len(ids) < len(pack) else struct.pack(f"<{len(ids)}{code}", *ids)

        self._symbols = packed
        self._word = lambda word: packed(word if word.isascii() and word.isprintable() else "".join(map(symbol, word.encode("utf-8"))))
        # A word is a chunk whose only word it is, so one memory serves both.
        self.known = Memory(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        # Most chunks are a word in letters, perhaps before a run of punctuation.
        body = chunk.rstrip(_TAIL)
        if body.isalpha() and (body.isascii() or max(body) < _STABLE):
            low = body.lower()
            if low == chunk:
                return self._word(chunk)
            if low.isalpha():
                return self.known[low] + self.known[chunk[len(body) :]]
        if chunk.isascii():
            if not body:
                return self._word(chunk)
            if "<" not in chunk:
                return self._plain(chunk)
        parts = self._special(chunk) if self._special else [chunk]
        return b"".join(self._names[x] if x in self._names else self._plain(x) for x in parts)

    def _plain(self, part: str) -> bytes:
        if not part.isascii():
            return b"".join(map(self._symbols, self._beyond_ascii(part)))
        words = self._split(part.lower())
        return b"".join(map(self._word if len(words) == 1 else self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if any(x in text for x in _ODD_SPACE):
            return self._chunk(text)
        return b"".join(map(self.known.__getitem__, text.split()))


_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, width: int = 4) -> TextEncoder:
    """The worker's encoder for a vocabulary file; workers are reused from task to task."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = TextEncoder(path, width=width)
    return _ENCODERS[path, width]
