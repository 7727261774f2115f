import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from folioforge.llm import packing, queries
from folioforge.llm.textcore import string_array
from folioforge.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, docs, tokenizer, length=4096):
    """Pieces cover every document once, in gapless sequences that need no padding but fewer than one a task."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_doc, key=str) == sorted(docs, key=str)
    for d, own in by_doc.items():
        ids = plain(tokenizer, docs[d])
        place = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == place and p["length"] > 0 and p["doc_tokens"] == len(ids)
            cut = np.array(ids[place : place + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(cut) if "ids_crc32" in p else bytes(p["ids"]) == cut
            place += p["length"]
        assert place == len(ids)
    for own in by_sequence.values():
        place = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == place
            place += p["length"]
        assert place == length or place & (place - 1) == 0 and place < length
    return by_sequence


def test_words_are_tokenised_as_whole_texts(tokenizer, monkeypatch):
    random.seed(1)
    monkeypatch.setattr(packing, "WORDS_KEPT", 500)
    letters = "aAbé̸́ \t\n\x0b\x0c\r\x1c\x85  Σσς'sʼ12٣😀İıß각#$ͅ.,;:!?¶§<|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:300]] + ["word. Word, WORD!? (w.) it's I'll-be... a.b. x.,", "¶ §¶ a¶b", "", " \n"]
    words = packing.Words(PATH)
    assert words.quick
    made = list(packing.token_ids(string_array(pa.array(texts)), words))
    assert [m.tolist() for m in made] == [plain(tokenizer, t) for t in texts]


def test_sum_of_squares_choice():
    rng = random.Random(5)
    packer, levels = packing.Packer(64), []
    for i in range(400):
        size = rng.randint(1, 63)
        squares = []
        for level in {0, *levels}:
            if level + size <= 64:
                after = list(levels)
                if level:
                    after.remove(level)
                if level + size < 64:
                    after.append(level + size)
                squares.append(sum(after.count(x) ** 2 for x in set(after)))
        before = len(levels)
        full = list(packer.place((i, 0, np.zeros(size, np.uint32))))
        levels = [level for level, s in packer.open.items() for _ in s]
        assert sum(levels.count(x) ** 2 for x in set(levels)) == min(squares)
        assert len(full) == (0 if len(levels) >= before and sum(levels) else len(full))
        assert packer.n_open == len(levels) == packer.counts.sum()


@pytest.mark.parametrize("sizes", [[40] * 500, [1] * 300, [33, 31] * 50, list(range(1, 200)), [64, 128, 640], [2000]])
def test_any_sizes_are_packed_without_padding(sizes):
    packer, out = packing.Packer(64, most_open=10), []
    for i, n in enumerate(sizes):
        out += packer.add(i, np.arange(n, dtype=np.uint32) + 1000 * i)
        assert packer.n_open <= 10
    out += packer.finish()
    lengths = [sum(len(p[2]) for p in s) for s in out]
    assert sum(lengths) == sum(sizes) and all(n == 64 or n & (n - 1) == 0 for n in lengths)
    assert sum(n < 64 for n in lengths) <= 6
    seen = {}
    for s in out:
        for d, start, ids in s:
            assert (ids == 1000 * d + start + np.arange(len(ids))).all()
            seen[d] = seen.get(d, 0) + len(ids)
    assert seen == {i: n for i, n in enumerate(sizes)}


def test_documents_come_back(spark, frame, clashing, tokenizer):
    random.seed(4)
    docs = {i: " ".join(random.choice(["alpha", "Beta,", "gämmä", "x1y2", "(d)"]) for _ in range(random.choice([0, 1, 50, 3000, 9000]))) for i in range(60)}
    docs[100], docs[101], docs[None] = None, "", "no id"
    df = frame([(d, t) for d, t in docs.items()], partitions=3)
    pieces = [r.asDict() for r in packing.pack(clashing(df), PATH).collect()]
    check(pieces, docs, tokenizer)
    assert packing.pack(frame([]), PATH).count() == 0


def test_repeats_and_a_very_long_text(spark, frame, tokenizer):
    long = "lorem ipsum dolor " * 150_000
    pieces = [r.asDict() for r in packing.pack(frame([(1, long), (2, "a b"), (2, "a b")], 1), PATH).collect()]
    again = [p for p in pieces if p["doc_id"] == 2]
    assert sum(p["length"] for p in again) == 6
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == len(plain(tokenizer, long))


def test_sequences_are_padded(spark, frame, tokenizer):
    docs = {i: f"w{i} text" for i in range(5)}
    pieces = packing.pack(frame(list(docs.items()), 1), PATH, length=8).cache()
    joined = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(pieces, length=8, pad=7).collect()}
    for r in pieces.collect():
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    assert all(len(x) == 8 or len(x) & (len(x) - 1) == 0 for x in joined.values())
    odd = spark.createDataFrame([(1, 0, 3, bytearray(np.array([5, 6, 300], "<u4").tobytes()))], "sequence_id bigint, offset bigint, length bigint, ids binary")
    assert np.frombuffer(bytes(packing.sequences(odd, length=8, pad=7).head()["ids"]), "<u4").tolist() == [5, 6, 300, 7, 7, 7, 7, 7]


def test_query_packs_all_documents(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    pieces = [r.asDict() for r in queries.op13_packing(spark, sf).collect()]
    by_sequence = check(pieces, docs, tokenizer)
    tokens = sum(p["length"] for p in pieces)
    assert len(by_sequence) <= tokens // 4096 + 13
