"""Quality rules from tokeniser fertility: how well public vocabularies fit a text, against bands per language or script.

Three figures of a text: characters per token (under each vocabulary), the share of byte-fallback tokens, and token
entropy. A text whose language's band (or, without one, its script's) doesn't hold one of the figures is rejected.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import by_bytes, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHORT = 20_000
FIGURES = ("piece_chars", "byte_chars", "fallback", "entropy")
MEASURED = "doc_id long, lang string, script string, " + ", ".join(f"{c} long" for c in BASE) + ", n_tokens long, " + ", ".join(f"{c} double" for c in FIGURES)


@dataclass(frozen=True)
class Params:
    """piece_model, byte_vocabulary: files of a BPE model with byte fallback and of a byte-level vocabulary (ranks), with the
    pattern that cuts a text for it. fence: a band reaches so many interquartile ranges beyond the quartiles, and at least
    `slack` of a figure, as the quartiles of few or very alike texts are narrow. least: a language or script with fewer
    documents has no band. groups: most languages with a band, those with most documents. window: tokens over which entropy is taken.
    block: characters that are encoded at once; a cut is made at a space, or inside a run without one.
    """

    piece_model: str
    byte_vocabulary: str
    pattern: str
    fence: float = 4.0
    slack: tuple[float, ...] = (0.5, 0.5, 0.05, 0.15)
    least: int = 50
    groups: int = 300
    window: int = 128
    block: int = 16 * 1024
    run: int = 2048


def base_figures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six ASCII spaces alone
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words that comes twice or more in the text."""
    if len(words) <= size:
        return 0
    if len(words) <= SHORT:
        windows = list(zip(*(words[k:] for k in range(size)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        at = [k for k, w in enumerate(windows) if times[w] > 1]
        return len({i for k in at for i in range(k, k + size)})
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    at = ids[: len(ids) - size + 1]
    for k in range(1, size):  # windows of k + 1 words, numbered anew so that the numbers stay small
        _, at = np.unique(at * len(number) + ids[k : len(ids) - size + 1 + k], return_inverse=True)
    twice = np.bincount(at)[at] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(size):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


@lru_cache(maxsize=65_536)
def script_of(char: str) -> str | None:
    """The script of a letter by its Unicode name's first word; None for other characters."""
    if not char.isalpha():
        return None
    return "LATIN" if char.isascii() else unicodedata.name(char, "UNNAMED").split(" ")[0].split("-")[0]


def script(text: str) -> str:
    """The script of most of the text's letters, of equally many the first by name; `none` without letters."""
    of = {c: script_of(c) for c in set(text)}
    names = set(of.values()) - {None}
    if len(names) < 2:
        return names.pop() if names else "none"
    totals: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if of[c] is not None:
            totals[of[c]] += n
    return min(totals, key=lambda k: (-totals[k], k))


def blocks(text: str, p: Params) -> Iterator[str]:
    """The text in blocks of at most p.block characters, cut at spaces (the one at a cut is left out, as an encoder puts
    one before each block); a run of over p.run characters without white space is cut after each p.run of them."""
    if len(text) <= p.run:
        yield text
        return
    text = re.sub(rf"[^\x20\x09-\x0D]{{{p.run}}}(?=[^\x20\x09-\x0D])", lambda m: m.group() + " ", text)
    at = 0
    while len(text) - at > p.block:
        cut = text.rfind(" ", at + 1, at + p.block)
        if cut < 0:
            cut = at + p.block
            yield text[at:cut]
            at = cut
        else:
            yield text[at:cut]
            at = cut + 1
    yield text[at:]


def entropy(ids: np.ndarray, window: int) -> float:
    """Mean over about equal windows of the tokens' Shannon entropy, each as a share of the most that its length allows."""
    if len(ids) < 2:
        return 0.0
    n, parts = len(ids), max(1, len(ids) // window)
    base = int(ids.max()) + 1
    key = np.sort(np.arange(n, dtype=np.int64) * parts // n * base + ids)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(start, append=n)
    more = times > 1  # a token that comes once adds nothing
    times, of = times[more], key[start[more]] // base
    size = -(-np.arange(1, parts + 1) * n // parts) + (-np.arange(parts) * n // parts)
    lost = np.bincount(of, weights=times * np.log2(times), minlength=parts)
    top = np.log2(np.maximum(size, 2))
    return float(np.mean((np.log2(size) - lost / size) / top))


class Vocabularies:
    """Both encoders, loaded once per task."""

    def __init__(self, p: Params):
        import sentencepiece
        import tiktoken

        self.p = p
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=p.piece_model)
        with open(p.byte_vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def figures(self, text: str) -> tuple[int, float, float, float, float]:
        """n_tokens, characters per token of both vocabularies, byte-fallback share, entropy."""
        parts = list(blocks(text, self.p))
        ids = np.frombuffer(b"".join([array("i", self.pieces.encode(x)).tobytes() for x in parts]), dtype=np.int32).astype(np.int64)
        n = len(ids)
        other = sum(len(self.bytes.encode_ordinary(x)) for x in parts)
        return n, len(text) / max(n, 1), len(text) / max(other, 1), float(self.fallback[ids].mean()) if n else 0.0, entropy(ids, self.p.window)


def measured(docs: DataFrame, params: Params) -> DataFrame:
    """The base counts and the vocabularies' figures of each row of docs (doc_id, text, lang); a map, no shuffle."""

    def run(batches):
        v = Vocabularies(params)
        for b in by_bytes(batches):
            rows = []
            for doc, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                rows.append((doc, lang, script(text), *base_figures(text), *v.figures(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", "text", "lang").mapInArrow(run, MEASURED)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("lang", pa.string()), ("script", pa.string()), *[(c, pa.int64()) for c in (*BASE, "n_tokens")], *[(c, pa.float64()) for c in FIGURES],
])


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame, by: str, params: Params) -> DataFrame:
    """`by`, then low and high of each figure: of the documents that pass the base rules, all of them.

    Quartiles come from a sketch that partial aggregation merges; at most params.groups rows result.
    """
    groups = rows.filter(~base_failed() & F.col(by).isNotNull()).groupBy(by)
    quarters = groups.agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in FIGURES]).filter(F.col("n") >= params.least)
    edges = []
    for c, slack in zip(FIGURES, params.slack, strict=True):
        low, high = F.col(c)[0], F.col(c)[1]
        reach = F.greatest((high - low) * params.fence, F.lit(slack))
        edges += [(low - reach).alias(f"{c}_low"), (high + reach).alias(f"{c}_high")]
    return quarters.orderBy(F.desc("n"), by).limit(params.groups).select(by, *edges)


def judge(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, then n_tokens, script, the figures, band and outside, for each row of docs.

    docs: doc_id, text, lang; other columns are ignored. kept: the base rules are met and each figure lies in the band.
    band: the language whose band is taken, or the script where the language is null or has none; null if neither has,
    then nothing but the base rules decides. outside: names of the figures beyond the band. Null and empty texts have
    no words and fail the base rules; texts of any length are encoded whole, in blocks. Repeated rows are judged each
    and count each in the bands. No rows give no rows. Two tables of at most params.groups rows go to all tasks.
    """
    rows = written(measured(docs, params), "fertility")
    edges = [f"{c}_{e}" for c in FIGURES for e in ("low", "high")]
    lang = F.broadcast(bands(rows, "lang", params).select(F.col("lang").alias("of_lang"), F.struct(*edges).alias("by_lang")))
    kind = F.broadcast(bands(rows, "script", params).select(F.col("script").alias("of_script"), F.struct(*edges).alias("by_script")))
    there = rows.join(lang, F.col("lang") == F.col("of_lang"), "left").join(kind, F.col("script") == F.col("of_script"), "left")
    there = there.withColumn("edges", F.coalesce("by_lang", "by_script")).withColumn("band", F.coalesce("of_lang", "of_script"))
    beyond = F.filter(
        F.array(*[F.when((F.col(c) < F.col(f"edges.{c}_low")) | (F.col(c) > F.col(f"edges.{c}_high")), c) for c in FIGURES]), lambda x: x.isNotNull()
    )
    return there.withColumn("outside", beyond).select(
        "doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & (F.size("outside") == 0)).alias("kept"),
        "n_tokens", "script", *FIGURES, "band", "outside",
    )
