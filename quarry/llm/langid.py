"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text
is reduced to its lower-case letter words, cut into blocks, and every block is
compressed against every dictionary; the language with the smallest sum wins.
Where the runner-up is nearly as small the operator rejects the text.

Defined results
    null, empty or letterless text: lang_pred ``und``, score 0, rejected. A
    letter is of a Unicode letter category: ``²``, ``½`` and ``①`` are none.
    null doc_id: a row like any other (the query counts it as not held out).
    ties: the language with more training documents, then the smaller name.
    no training text: every text is ``und``.
    repeated rows: a row each. Extra columns are not read. Very long texts are
    compressed whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: The training sample is bounded: texts a language, code points a text, bytes a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, DICT_BYTES = 400, 2000, 65536
BLOCK = 4096
#: A text is rejected if the runner-up needs less than this share more bytes.
MARGIN = 0.004
UND = "und"

_letters = regex.compile(r"\p{L}+")


def normal(text: str | None) -> bytes:
    return " ".join(_letters.findall(text.lower())).encode("utf-8", "replace") if text else b""


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, int, bytes]]:
    """(language, training texts, dictionary bytes), most frequent language first.

    The sample is the ``sample_texts`` texts of each language with the least
    hash of their content, ``sample_chars`` of each: what comes to the driver
    is bounded by languages x sample_texts x sample_chars.
    """
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    rows = rows.select("l", F.xxhash64("t").alias("h"), F.left("t", F.lit(sample_chars)).alias("t"))
    picked = _least(rows, sample_texts)
    out = []
    for row in picked.collect():
        content = b" ".join(x for x in (normal(s["t"]) for s in row["s"]) if x)[:dict_bytes]
        if len(content) >= 8:
            out.append((row["l"], row["n"], content))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def _least(rows: DataFrame, k: int) -> DataFrame:
    """The k texts of least hash of each language; a hash bound from its count of different texts leaves about 4k to group."""
    pairs = rows.groupBy("l", "h").agg(F.count(F.lit(1)).alias("c"))
    counts = pairs.groupBy("l").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))  # n rows, d different texts
    # all texts, if a language has no more than 4k; fewer than k of 4k expected hashes under the bound is out of the question
    bounds = counts.select("l", "n", F.when(F.col("d") <= 4 * k, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * 4 * k / F.col("d")).cast("long")).alias("bound"))
    bounds = materialize(bounds, "languages")  # a row a language: its size is known, so it is broadcast if small
    near = rows.join(bounds, "l").where("h <= bound").groupBy("l", "n", "h").agg(F.min("t").alias("t"))  # copies once
    return near.groupBy("l", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "t"))), 1, k).alias("s"))


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=15, search_log=3, min_match=4, target_length=8, strategy=zstd.STRATEGY_GREEDY, write_content_size=False)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)


def classify(text: str | None, models: list[tuple[str, zstd.ZstdCompressor]], margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score in 0..1, rejected)"""
    data = normal(text)
    if not data or not models:
        return UND, 0.0, True
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in models]
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return models[0][0], 1.0, False
    second = min(s for k, s in enumerate(sizes) if k != best)
    gap = second - sizes[best]
    score = 1.0 - 0.5 ** (1 + 20.0 * gap / max(second, 1))
    return models[best][0], score, bool(gap < margin * second)


class Classifier:
    """Holds the dictionaries; each Python worker builds the compressors once."""

    def __init__(self, trained: list[tuple[str, int, bytes]], margin: float = MARGIN):
        self.trained, self.margin, self._models = trained, margin, None

    def __getstate__(self):
        return {"trained": self.trained, "margin": self.margin, "_models": None}

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if self._models is None:
            self._models = [(lang, _compressor(content)) for lang, _, content in self.trained]
        return classify(text, self._models, self.margin)


def predict(docs: DataFrame, trained: list[tuple[str, int, bytes]], text: str = "text", margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and rejected for each row of ``docs``."""
    keep = ["doc_id"] if keep is None else keep
    model = Classifier(trained, margin)
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("body"))
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [model(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "rejected"],
            )

    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "rejected")


def accept(docs: DataFrame, trained: list[tuple[str, int, bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, in their own columns."""
    return predict(docs, trained, text, margin, keep=docs.columns).where(~F.col("rejected")).select(*docs.columns)
