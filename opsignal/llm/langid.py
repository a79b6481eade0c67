"""Language identification by compression: the language whose dictionary makes a text's zstandard frames smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsignal.llm.common import by_bytes

SPARE = 4
UNDECIDED = "und"
LEAST = 1024
OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Params:
    """dictionary_bytes: raw content per language, the bound of the sample that is fitted; candidates: most documents
    read for it per language; level: zstandard's; margin: a text is rejected if the second smallest sum of frames is not
    larger than the smallest by more than this share; languages: most languages a model may have; piece: most characters
    of a text that one frame holds, as a dictionary saves about as many bytes in a long frame as in a short one.
    """

    dictionary_bytes: int = 32 * 1024
    candidates: int = 150
    level: int = 6
    margin: float = 0.01
    languages: int = 300
    piece: int = 16 * 1024


@dataclass(frozen=True)
class Model:
    params: Params
    dictionaries: dict[str, bytes]


def is_held_out(doc_id, mod: int = 5):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == 0, F.lit(False))


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Raw-content dictionaries from rows (doc_id, text, lang) with neither text nor lang null.

    For each language the rows with the smallest hashes of doc_id come first, rows that alone are larger than a quarter of
    dictionary_bytes last; of them `candidates` at most are read, and none once the rows before it have SPARE times
    dictionary_bytes, each cut at dictionary_bytes. So the driver gets languages * (SPARE + 1) * dictionary_bytes at most, whatever
    the ids: rows without or with the same doc_id are rows like others. Raises for more than `languages` languages.
    """
    part = F.substring("text", 1, params.dictionary_bytes)
    rows = labelled.filter("lang is not null and text is not null and text <> ''").select(
        F.col("lang").alias("of"), (F.octet_length("text") > params.dictionary_bytes // 4).alias("late"), F.xxhash64("doc_id").alias("rank"),
        F.xxhash64("text").alias("tie"), part.alias("part"),
    )
    order = Window.partitionBy("of").orderBy("late", "rank", "tie")
    first = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= params.candidates)
    before = F.sum(F.octet_length("part")).over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    texts = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SPARE * params.dictionary_bytes)
    found = texts.select("of", "at", "part").limit(params.languages * params.candidates + 1).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(found):
        parts.setdefault(r["of"], []).append(plain(r["part"]))
    if len(parts) > params.languages:
        raise ValueError(f"more than {params.languages} languages")
    return Model(params, {lang: b"\n".join(p)[: params.dictionary_bytes] for lang, p in sorted(parts.items())})


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def pieces(text: str, most: int) -> Iterator[str]:
    """The text in as few parts as have `most` characters or fewer, about equally long."""
    n = -(-len(text) // most)
    return (text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n))


def plain(text: str) -> bytes:
    """What is compressed: the whole text in lower case, with one space for each run of other characters than letters."""
    return " ".join(OTHER.split(text.lower())).encode("utf-8", "surrogatepass")


class Judge:
    """The compressors of a model, made once per task."""

    def __init__(self, model: Model):
        self.langs, self.margin, self.level, self.piece = list(model.dictionaries), model.params.margin, model.params.level, model.params.piece
        self.compress = []
        for raw in model.dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            self.compress.append(
                zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress
            )

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if text is None or not self.langs or not has_letter(text):
            return UNDECIDED, 0.0, True
        sizes = [0] * len(self.langs)
        for raw in filter(None, map(plain, pieces(text, self.piece))):
            if len(raw) < LEAST:  # a very short frame is stored as it is, whatever the dictionary
                raw *= LEAST // len(raw) + 1
            sizes = [n + len(c(raw)) for n, c in zip(sizes, self.compress, strict=True)]
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        share = 1 - sizes[best] / second
        return self.langs[best], share, share <= self.margin


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text; other columns are ignored).

    score: share by which the smallest sum of frames is below the second smallest, 0 to 1, whatever the text's length; of
    equal sums the first language in order wins. rejected: the margin is narrow. A null text, one without a letter, and any
    text under a model without languages is `und` with score 0 and rejected. Whole texts are compressed, however long, by
    pieces. Repeated rows are judged alike. No rows give no rows. A narrow map: no shuffle.
    """

    def run(batches):
        judge = Judge(model)
        for b in by_bytes(batches):
            found = [judge(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()), strict=True))] if found else None
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def clear(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns kept, whose text isn't rejected. Rows pass a few megabytes of text at a time."""
    text = docs.columns.index("text")

    def run(batches):
        judge = Judge(model)
        for b in by_bytes(batches):
            keep = pa.array([not judge(t)[2] for t in b.column(text).to_pylist()], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
