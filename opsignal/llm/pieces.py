"""SentencePiece encoding and decoding for merge-type (BPE) models, exact, by backtracking.

An encoding of a text by merges is the one sequence of pieces in which every two neighbours, merged anew from
their characters, come out as these two pieces. So a text is covered from the left with the longest piece that fits
(the longest match at each place, from one Aho-Corasick pass over each word); a piece that isn't compatible with its left neighbour gives way to the next
shorter one, and a position from which nothing fits is marked in a bitfield and never tried again.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsignal.llm.common import by_bytes

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_²³¹¼½¾]")
UNIT = re.compile(rf"{SPACE}?(?:[^\W\d_²³¹¼½¾]+|(?:(?![^\W\d_²³¹¼½¾])[^{SPACE}\n])+)|\n|{SPACE}")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A model's pieces and its exact encoder. model_file: a serialized model whose type is BPE.

    A text is cut where no piece of the model can reach across (checked here): at spaces, newlines and between letters
    and other characters. memo: most such units whose ids are kept; the memo starts anew when it is full.
    """

    def __init__(self, model_file: str, memo: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalization, kept spaces and a dummy prefix")
        kinds = {p.type for p in model.pieces}
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.piece = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.raw[self.unknown] = model.trainer_spec.unk_surface.encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.byte_ids = frozenset(self.byte.values())
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece has a character that is no piece")
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id) or "\n" in "".join(self.id):
            raise ValueError("a piece has a space after other characters")
        if any(a != SPACE and b != SPACE and bool(LETTER.match(a)) != bool(LETTER.match(b)) for p in self.id for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece mixes letters and other characters")
        run = [self.score[p] for p in self.id if len(p) > 1 and not p.strip(SPACE)]
        if run and max(run) >= min(s for p, s in self.score.items() if p.strip(SPACE)):
            raise ValueError("runs of spaces must merge last")
        self.steps: dict[str, tuple[list, list]] = {}
        self.reached = {p for p in self.id if self.merged(p, steps := []) == [p] and self._edges(p, steps)}
        self.find = ahocorasick.Automaton()
        for p in self.reached:
            self.find.add_word(p, p)
        self.find.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), None) for p in self.reached}
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def forget(self) -> None:
        self.memo, self.fits = {}, {}

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The encoding by its definition: merge the best-scored pair, the leftmost of equals, until none is left.

        steps: gets the merges in their order, as (first character's index, piece).
        """
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-self.score[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            if steps is not None:
                steps.append((i, p))
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts) and (q := parts[left] + parts[after[left]]) in self.score:
                    heapq.heappush(heap, (-self.score[q], left, q))
        return [p for p in parts if p is not None]

    def _edges(self, piece: str, steps: list) -> bool:
        """Keeps, after each merge of the piece, the merge's cost with the symbol then at the right and at the left end."""
        first, last, n = piece[0], piece[-1], len(piece)
        right, left = [(0.0, last)], [(0.0, first)]
        for i, p in steps:
            last, first = p if i + len(p) == n else last, p if i == 0 else first
            right.append((-self.score[p], last))
            left.append((-self.score[p], first))
        end = (float("inf"), "")
        self.steps[piece] = [*right, end], [*left, end]
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two, merged anew from their characters side by side, come out as these two pieces.

        Each side's merges come in its own order, the better of both sides' next ones first; they stay two pieces if at
        no time a merge across the border is better than both (of equals, the leftmost).
        """
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            a, b, i, j, known, cost = self.steps[left][0], self.steps[right][1], 0, 0, True, self.score
            while True:
                next_a, next_b = a[i + 1][0], b[j + 1][0]
                if (across := cost.get(a[i][1] + b[j][1])) is not None and -across < next_a and -across <= next_b:
                    known = False
                    break
                if next_a <= next_b:
                    if next_a == float("inf"):
                        break
                    i += 1
                else:
                    j += 1
            self.fits[left, right] = known
        return known

    def covered(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces, without runs of spaces."""
        n, fits, shorter, out = len(text), self.compatible, self.shorter, []
        known, at, failed = self.fits, 0, bytearray(n + 1)
        longest: list[str | None] = [None] * n
        for end, p in self.find.iter(text):  # one pass; of matches with one start the longer ends later
            longest[end + 1 - len(p)] = p
        p = longest[0]
        while at < n:
            while p is not None:
                if not failed[at + len(p)]:
                    if not out or (good := known.get((out[-1], p))) or good is None and fits(out[-1], p):
                        break
                p = shorter[p]
            if p is not None:
                out.append(p)
                at += len(p)
                if at < n:
                    p = longest[at]
            else:
                failed[at] = 1
                p = out.pop()
                at -= len(p)
        return out

    def unit(self, text: str) -> bytes:
        """Ids, as 32-bit numbers, of a word with its space before it, if it has one; or of a newline."""
        ids: list[int] = []
        if self.chars.issuperset(text):
            return np.array([self.id[p] for p in self.covered(text)], dtype=np.int32).tobytes()
        start = 0
        for k in range(len(text) + 1):
            if k == len(text) or text[k] not in self.id:
                if k > start:
                    ids += [self.id[p] for p in self.covered(text[start:k])]
                if k < len(text):
                    raw = text[k].encode("utf-8", "surrogatepass")
                    ids += [self.byte[b] for b in raw] if self.byte else [self.unknown]
                start = k + 1
        return np.array(ids, dtype=np.int32).tobytes()

    def _ids(self, unit: str) -> bytes:
        if (ids := self.memo.get(unit)) is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            ids = self.unit(unit)
            if len(unit) <= 64:
                self.memo[unit] = ids
        return ids

    def spaces(self, n: int) -> bytes:
        return np.array([self.id[p] for p in self.merged(SPACE * n)], dtype=np.int32).tobytes() if n else b""

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        whole = SPACE + text.replace(" ", SPACE)
        units = UNIT.findall(whole)
        if SPACE not in units:
            try:
                return b"".join(map(self.memo.__getitem__, units))
            except KeyError:
                return b"".join(map(self._ids, units))
        # a run of spaces merges after all words; the last one belongs to it only if the word didn't take it
        out, run, bare = [], 0, np.int32(self.id[SPACE]).tobytes()
        for u in units:
            if u == SPACE:
                run += 1
                continue
            ids = self._ids(u)
            if run and u[0] == SPACE and ids[:4] == bare:
                run, ids = run + 1, ids[4:]
            out += [self.spaces(run), ids]
            run = 0
        return b"".join([*out, self.spaces(run)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces joined, bytes read as UTF-8 (a replacement character for each byte that can't be read),
        one leading space of the first piece dropped."""
        raw = self.raw
        whole = b"".join([raw[i] for i in ids])
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        return text[1:] if text[:1] == " " and ids and self.piece[ids[0]][:1] == SPACE else text

    def _repaired(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, self.unknown]:
            if i in self.byte_ids:
                run += self.raw[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        char = bytes(run[:n]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1 and n <= len(run):
                        out.append(char)
                        del run[:n]
                        break
                else:
                    out.append("�")
                    del run[:1]
            out.append(self.raw[i].decode())
        return "".join(out[:-1])


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    """One encoder per process and model."""
    return Pieces(model_file)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int, no begin or end id), decoded (text of the ids) for each row of docs (doc_id, text).

    model_file: path that exists on every executor. Null and empty texts have no ids and decode to the empty string.
    A text's own U+2581 is a space to the model and decodes as one. Repeated rows are encoded each; other columns are
    ignored. No rows give no rows. A narrow map: no shuffle; a task keeps one bounded memo and forgets it at its end.
    """

    def run(batches):
        pieces = load(model_file)
        pieces.forget()  # of an earlier task in this process
        for b in by_bytes(batches):
            raw = [pieces.encode_bytes(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
            flat = np.frombuffer(b"".join(raw), dtype=np.int32)
            text = [pieces.decode(flat[s:e].tolist()) for s, e in zip(ends, ends[1:], strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])
        pieces.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
