"""BPE encoding by dynamic programming over prefixes, and decoding.

Byte-pair encoding of a word has the property that each prefix of it has exactly one last token:
the one with which the encoding of the prefix ends. A token that ends a prefix is the right one if
it fits the last token of the prefix that is left without it, that is, if merging the two tokens'
symbols would give the two again. An automaton over the vocabulary yields all tokens that end at
each position, the last tokens are stored prefix by prefix, and back-pointers followed from the
word's end give its ids. No merge is ever carried out.

Words are met again and again, so workers keep a bounded number of encoded words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame

from .common import pieces, ship, text_column
from .tokens import TextEncoder, read_rules, vocabulary_path

#: Stands for the end-of-word suffix inside the automaton: no symbol of the byte alphabet.
_END = "\ue000"


class Vocabulary:
    """Tokens, merges and rules of a tokenizer file of the kind ``BPE`` with end-of-word suffix."""

    def __init__(self, path: str):
        spec = read_rules(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: name for name, i in [*self.ids.items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]}
        #: The rank of each pair of tokens that merges; of each token the rank of its merge and its two parts.
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.ids[left], self.ids[right]
            made = self.ids[left + right]
            if made in self.rank or max(self.rank.get(x, -1) for x in pair) >= rank:
                raise ValueError("merges must make each token once, parts before wholes")
            self.pair_rank[pair], self.rank[made], self.parts[made] = rank, rank, pair


class PrefixEncoder:
    """Encodes words of the splitter."""

    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = v = Vocabulary(path)
        self._automaton = ahocorasick.Automaton()
        for name, i in v.ids.items():
            marked = name[: -len(v.suffix)] + _END if v.suffix and name.endswith(v.suffix) else name
            self._automaton.add_word(marked, (len(marked), i))
        self._automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are.

        The tokens that meet at the boundary over time are followed backwards: a and b, then the
        parts from which the younger of the two was made, down to symbols. A pair that merges before
        either of its tokens is consumed by the merge that did consume it spoils the result. Equal
        ranks go from left to right, so the left token's own merge wins a tie and the right one's
        loses it.
        """
        v, end = self.vocabulary, len(self.vocabulary.pair_rank)
        a_until, b_until = end, end
        while True:
            merge = v.pair_rank.get((a, b))
            if merge is not None and merge < a_until and merge <= b_until:
                return False
            a_since, b_since = v.rank.get(a, -1), v.rank.get(b, -1)
            if a_since < 0 and b_since < 0:
                return True
            if a_since > b_since:
                a_until, a = a_since, v.parts[a][1]
            else:
                b_until, b = b_since, v.parts[b][0]

    def word(self, symbols: str) -> list[int]:
        """The ids of one word of the splitter, given as symbols of the byte alphabet."""
        symbols += _END
        # last[i]: the last token of the first i symbols; the end mark makes one symbol with the one before.
        last: list[int | None] = [None] * (len(symbols) + 1)
        start = [0] * (len(symbols) + 1)
        known = self._fits
        for end, (length, token) in self._automaton.iter(symbols):
            if last[end + 1] is not None:
                continue
            at = end + 1 - length
            if at:
                before = last[at]
                if before is None:
                    continue
                fit = known.get((before, token))
                if fit is None:
                    fit = self.fits(before, token)
                    if len(known) >= 1_000_000:
                        known.clear()
                    known[before, token] = fit
                if not fit:
                    continue
            last[end + 1], start[end + 1] = token, at
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]


_WORKER: dict[str, tuple] = {}


def _worker(path: str) -> tuple[TextEncoder, list[str]]:
    if path not in _WORKER:
        prefix = PrefixEncoder(path)
        names = prefix.vocabulary.names
        _WORKER[path] = TextEncoder(path, prefix.word), [names.get(i, "") for i in range(max(names) + 1)]
    return _WORKER[path]


def decode(ids: bytes, path: str) -> str:
    """The text of packed ids: as the file names no decoder, the tokens' names with blanks between.

    Special tokens stay; ids that no token has are left out.
    """
    import numpy as np

    names = _worker(path)[1]
    return " ".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < len(names) and names[i]])


def encode_bpe(docs: DataFrame, tokenizer_path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, and ``decoded`` if asked for.

    docs needs ``doc_id`` and ``text``; further columns are ignored. A null text is empty and has no
    ids. Ids are packed unsigned 32-bit, little-endian, without special tokens of the tokenizer's
    own; names of special tokens in a text are these tokens. Null and repeated doc_ids are rows like
    any other. An empty table gives no rows. No row moves.
    """
    ship(docs.sparkSession)

    def run(with_decoded: bool, batches) -> Iterator:
        import pyarrow as pa

        path = tokenizer_path or vocabulary_path()
        for batch in pieces(batches):
            ids = list(map(_worker(path)[0].encode, batch.column("text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array([decode(x, path) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return text_column(docs).mapInArrow(partial(run, with_decoded), "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_decoded)


def decode_bpe(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``."""
    ship(encoded.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        path = tokenizer_path or vocabulary_path()
        for batch in pieces(batches):
            texts = [None if x is None else decode(x, path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
