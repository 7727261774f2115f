import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import language

RNG = random.Random(2)
WORDS = {"en": "the and of that with this from were have".split(), "de": "und der die das nicht eine wird auch über".split(), "fr": "le les une dans pour avec être cette où".split()}


def prose(lang, n=60):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "", "s", "e"]) for _ in range(n)).capitalize() + "."


@pytest.fixture()
def docs(frame):
    return frame([(i, prose(lang), lang) for i, lang in enumerate(RNG.choice(list(WORDS)) for _ in range(150))])


def test_held_out_rows_are_told(spark, docs):
    models = language.fit(docs, ~language.held_out(F.col("doc_id")))
    assert list(models) == sorted(WORDS)
    out = language.identify(docs, models).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 and not r["rejected"] for r in out)


def test_held_out_is_the_contract(spark):
    import zlib

    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(language.held_out(F.lit(None).cast("bigint")).alias("h")).head()["h"] is False


def test_nothing_is_learned_from_held_out_rows(spark, docs):
    assert language.fit(docs, F.lit(False)) == {}
    open_rows = docs.where(~language.held_out(F.col("doc_id")))
    assert language.fit(docs, ~language.held_out(F.col("doc_id"))) == language.fit(open_rows, F.lit(True))


def test_edges(spark, frame, docs, clashing):
    models = language.fit(docs, F.lit(True))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, prose("de", 3)), (5, prose("fr", 20_000)), (6, prose("en")), (6, prose("en")), (None, prose("de"))]
    out = language.identify(clashing(frame(rows)), models)
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[5] == ("fr", False) and got[6] == ("en", False) and got[None] == ("de", False)
    assert language.identify(frame(rows).limit(0), models).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame(rows), {}).collect()} == {"und"}
    assert out.columns.count("score") == 1


def test_whole_text_counts():
    models = {k: " ".join(WORDS[k] * 40).encode() for k in sorted(WORDS)}
    langs, _ = language.classify(pa.array([prose("en", 300) + " " + prose("de", 3000)]), models)
    assert langs == ["de"]


def test_sample_is_bounded_and_from_whole_texts(spark, frame, monkeypatch):
    """Every drawn document has its share, from all of its text; repeated rows are drawn once."""
    monkeypatch.setattr(language, "SAMPLE_DOCS", 40)
    rows = [(i, " ".join(["head"] * 2000 + ["middle"] * 2000 + ["tail"] * 2000), "en") for i in range(200)] + [(7, "same words again", "fr")] * 300
    models = language.fit(frame(rows), F.lit(True))
    words = models["en"].split()
    assert min(words.count(w) for w in (b"head", b"middle", b"tail")) > 0.15 * len(words)
    assert len(models["en"]) < 2 * 40 * language.SLICES * language.SLICE_CHARS
    assert models["fr"] == b"same words again "


def test_sizes_equal_plain_compression():
    """Predictions equal those of compressing every chunk on its own, dictionary by dictionary."""
    import zstandard as zstd

    rng = random.Random(8)
    models = {k: " ".join(rng.choice(WORDS[k]) for _ in range(600)).encode() for k in sorted(WORDS)}
    texts = [" ".join(rng.choice(WORDS[rng.choice(list(WORDS))]) + rng.choice(["", ",", " 5"]) for _ in range(rng.choice([3, 40, 900, 5000]))) for _ in range(40)]
    langs, scores = language.classify(pa.array(texts), models)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        n = 1 if len(raw) <= 3072 else -(-len(raw) // 2048)
        step = -(-len(raw) // n)
        sizes = {}
        for k, words in models.items():
            params = zstd.ZstdCompressionParameters.from_level(6, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            one = lambda piece, words=words, params=params: len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(words, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params).compress(piece))
            sizes[k] = sum(one(raw[i : i + step]) for i in range(0, len(raw), step))
        best, second = sorted((v, k) for k, v in sizes.items())[:2]
        assert lang == best[1] and abs(score - (second[0] - best[0]) / second[0]) < 0.02
