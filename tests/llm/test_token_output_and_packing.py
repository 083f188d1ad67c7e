import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("stratalith.llm.queries")
from fixtures import SCHEMA, TEXTS, documents, packed, rows  # noqa: E402

from stratalith.llm.common import Scratch  # noqa: E402
from stratalith.llm.packing import pack  # noqa: E402
from stratalith.llm.token_output import read_tokens, vbyte_decode, vbyte_encode, write_tokens  # noqa: E402
from stratalith.llm.bpe import PrefixEncoder, decode_bpe, encode_bpe  # noqa: E402
from stratalith.llm.tokens import Memory, TextEncoder, vocabulary_path  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.mark.parametrize("own", [False, True])
def test_texts_encode_as_by_the_library(library, own):
    texts = [t or "" for t in TEXTS]
    alphabet = "aZ'stréΣσİ1 \t\n\x1c\u3000!?<|>endoftext日́👍.,"
    rng = random.Random(1)
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["aaaaaaaaaaaaaaaa"[:n] for n in range(16)] + ["hahahahahahaha", "lolololololol"]
    encoder = TextEncoder(vocabulary_path(), PrefixEncoder(vocabulary_path()).word if own else None)
    encoder.known.entries = 50
    for t in texts:
        assert encoder.encode(t) == packed(library.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("form", ["x{} ý {}", "'{}́b", "{}{}A!"])
def test_every_code_point_encodes_as_by_the_library(library, own, form):
    encoder = TextEncoder(vocabulary_path(), PrefixEncoder(vocabulary_path()).word if own else None)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not 0x3400 <= c < 0x9FFF and not 0xAC00 <= c < 0xD7A0]
    texts = [" ".join(form.replace("{}", chr(c)) for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == packed(want.ids), text


def test_encoded_and_decoded_tables(spark, library):
    docs = documents(spark, extra=[(None, "null id"), (12, "repeated id"), (12, "repeated id"), (12, None)]).repartition(3)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), packed(ids), library.decode(ids, skip_special_tokens=False)] += 1
    coded = encode_bpe(docs, with_decoded=True)
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in coded.collect()) == want
    decoded = decode_bpe(encode_bpe(docs))
    assert Counter(map(tuple, decoded.collect())) == sum((Counter({(k[0], k[3]): n}) for k, n in want.items()), Counter())
    assert encode_bpe(spark.createDataFrame([], SCHEMA)).count() == decode_bpe(encode_bpe(spark.createDataFrame([], SCHEMA))).count() == 0
    odd = spark.createDataFrame([(1, "Some text", "x", 3)], "doc_id long, text string, IDS string, `n.tokens` int")
    assert [r["n_tokens"] for r in encode_bpe(odd).collect()] == [2]
    assert decode_bpe(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] is None


def test_memory_is_bounded():
    made = []
    memory = Memory(lambda k: made.append(k) or k.upper(), entries=10)
    for i in range(100):
        assert memory[f"k{i}"] == f"K{i}" == memory[f"k{i}"]
    assert len(memory) <= 10 and len(memory.old) <= 10 and len(made) == 100


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_variable_length_code_round_trip(values):
    control, data = vbyte_encode(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert vbyte_decode(control, data, len(values)).tolist() == values


def test_written_tokens_read_back(spark, library):
    docs = documents(spark, extra=[(None, "null id"), (12, "repeated id"), (12, "repeated id")]).repartition(3)
    path = Scratch(spark, "test").path("files")
    write_tokens(docs, path, block_ids=50)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x))
    at, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(packed([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]))
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        texts[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]


def test_damaged_block_raises(spark):
    path, bad = (Scratch(spark, "test").path(x) for x in ("good", "bad"))
    write_tokens(documents(spark, ["some words here"]), path)
    spark.read.parquet(f"{path}/ranks").write.parquet(f"{bad}/ranks")
    spark.read.parquet(f"{path}/blocks").selectExpr("* except (crc32)", "crc32 + 1 as crc32").write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="damaged"):
        read_tokens(spark, bad).collect()


def test_empty_table_writes_and_packs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = Scratch(spark, "test").path("files")
    write_tokens(empty, path)
    assert read_tokens(spark, path).count() == 0
    assert pack(empty).count() == 0


def test_pieces_cover_each_document_and_fill_windows(spark, library):
    docs = documents(spark, extra=[(None, "null id"), (12, "repeated id")]).repartition(3)
    got = pack(docs, sequence_length=64).collect()
    streams = {}
    for r in got:
        streams.setdefault((r["doc_id"], r["sequence_id"] * 64 + r["offset"] - r["start"]), []).append(r)
    have = sorted((k[0] or 0, b"".join(x["ids"] for x in sorted(v, key=lambda x: x["start"]))) for k, v in streams.items())
    want = sorted((r["doc_id"] or 0, packed([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    assert have == want
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in got)
    filled = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    at = 0
    for start, length in filled:
        assert start == at
        at += length


def test_rejects_bad_length(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows(["a"]), SCHEMA), sequence_length=0)
