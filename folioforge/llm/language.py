"""Language identification by compression against per-language dictionaries.

Each language is modelled by a raw-content zstandard dictionary, plain text of
that language.  Texts are reduced to letters in lower case with single spaces
between words and cut into chunks; each chunk is compressed once with every
dictionary, and the language whose sizes add up to least wins.

Defined results: a text that is null or has no letter is ``und`` with score 0
and is rejected; ties go to the language that sorts first; repeated rows get
equal answers; with no labelled row at all every text is ``und``; columns other
than the text are passed through, so names that clash with the added ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.session import bound_batches

#: Bound of the fit: documents drawn per language, slices taken of each at hashed places, characters of a slice.
SAMPLE_DOCS, SLICES, SLICE_CHARS = 128, 3, 256
#: A text is compressed in chunks of about this many bytes, so that margins don't shrink with its length.
CHUNK_BYTES = 2048
#: Relative margin over the next language below which a prediction is rejected.
MIN_MARGIN = 0.01
#: Matches of three bytes count: short words tell languages apart.
LEVEL, MIN_MATCH = 6, 3


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Dictionary per language from a bounded sample of the rows where ``usable`` holds.

    About ``SAMPLE_DOCS`` rows per language are drawn, by a hash of key and text
    against a threshold from the language's number of different ones, so rows
    that repeat both are one.  Each gives ``SLICES`` slices of ``SLICE_CHARS`` characters from
    hashed places of its whole text (a shorter text all of it), so every drawn
    document has an equal share of the dictionary and nothing drawn is cut off.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    own = F.xxhash64(F.col(key), F.col(text), F.lit("language sample"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.approx_count_distinct(own)).collect()}
    if not counts:
        return {}
    space = 1 << 31
    below = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(space, space * SAMPLE_DOCS // n))])
    drawn = F.pmod(own, F.lit(space))
    room = F.greatest(F.length(text) - SLICE_CHARS, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), room).cast("int") + 1 for i in range(SLICES)]
    slices = F.concat_ws(" ", *[F.col(text).substr(at, F.lit(SLICE_CHARS)) for at in places])
    piece = F.when(F.length(text) <= SLICES * SLICE_CHARS, F.col(text)).otherwise(slices)
    picked = rows.where(drawn < F.element_at(below, F.col(lang))).select(F.col(lang).alias("lang"), drawn.alias("at"), piece.alias("text")).distinct().collect()
    picked.sort(key=lambda r: (r["lang"], r["at"], r["text"]))
    pieces = dict.fromkeys(counts, b"")
    letters = _letters(pa.array([r["text"] for r in picked], pa.string())).to_pylist()
    for row, part in zip(picked, letters, strict=True):
        if part:
            pieces[row["lang"]] += part.encode() + b" "
    return {k: d for k, d in sorted(pieces.items()) if d}


def _letters(texts: pa.Array) -> pa.Array:
    """Lower case, runs of other characters than letters as one space; null as empty."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " "), " ")


def _sizes(texts: list[bytes], models: dict[str, bytes]) -> np.ndarray:
    """Compressed bytes of every text (row) with every language's dictionary (column)."""
    import zstandard as zstd

    out = np.zeros((len(texts), len(models)))
    params = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    for column, raw in enumerate(models.values()):
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        squeeze = zstd.ZstdCompressor(dict_data=dictionary, compression_params=params).compress
        for row, text in enumerate(texts):
            if len(text) <= CHUNK_BYTES * 3 // 2:
                out[row, column] = len(squeeze(text))
            else:
                n = -(-len(text) // CHUNK_BYTES)
                step = -(-len(text) // n)
                out[row, column] = sum(len(squeeze(text[i : i + step])) for i in range(0, len(text), step))
    return out


def classify(texts: pa.Array, models: dict[str, bytes]) -> tuple[list[str], list[float]]:
    """Language and margin (0 to 1) of each text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    names = list(models)
    for lo in range(0, len(texts) if models else 0, 512):
        some = [(lo + i, t.encode()) for i, t in enumerate(_letters(texts.slice(lo, 512)).to_pylist()) if t]
        if not some:
            continue
        sizes = _sizes([t for _, t in some], models)
        best = sizes.argmin(1)
        least = sizes[np.arange(len(some)), best]
        sizes[np.arange(len(some)), best] = np.inf
        second = sizes.min(1)
        for (i, _), b, x, y in zip(some, best, least, second, strict=True):
            langs[i] = names[b]
            scores[i] = float((y - x) / y) if np.isfinite(y) else 1.0
    return langs, scores


def identify(docs: DataFrame, models: dict[str, bytes], text: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and rejected.

    ``rejected`` is true for ``und`` and for a margin under ``min_margin``.
    """
    bound_batches(docs.sparkSession)
    added = ("lang_pred", "score", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType([f for f in docs.select(*keep).schema.fields] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    passed = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = classify(batch.column(passed), models)
            rejected = [x == "und" or s < min_margin for x, s in zip(langs, scores, strict=True)]
            columns = [*batch.columns[:passed], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return docs.select(*keep, F.col(text).alias("_" + "_".join(keep))).mapInArrow(run, schema)
