"""Operator 4: SentencePiece encoding and decoding on an Aho-Corasick automaton.

The automaton holds all pieces. One pass over a text reports, at each position and through the output links, every piece that ends
there; the pass keeps for each position how the best segmentation up to it ends:

* unigram models: Viterbi, the highest sum of piece scores, of equal sums the one with the longer last piece. A character that is no
  piece by itself can also be passed as unknown, for the lowest score less UNKNOWN_PENALTY. Sums run from the start of the text and are
  kept in 32 bits as the library keeps them, because ties are common. User-defined symbols get no bonus;
* BPE models: the last piece of what the merges would give for that prefix. Of the pieces that end at a position exactly one can
  follow the piece kept where it begins without the merges joining across the two, so relaxing means testing that. (Maximising the
  scores of a BPE model, which are merge ranks, gives other segmentations than the model's own.)

Pieces have the meta symbol for a space only in front, so a BPE model's words are segmented one by one and their ids kept in a bounded table.

Edge cases: a null text is encoded as the empty text and gives no pieces; characters without a piece become byte pieces, or in models
without them one unknown piece for a run of them; decoding restores the text the model normalised (a text that itself holds the meta symbol, or one that
the model's own normaliser changes, does not round-trip and is reported as such).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import gives_back, pick
from tessella.llm.token_counts import public_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids are remembered in a Python worker before the table is emptied.
WORDS_KEPT = 300_000
#: What an unknown character scores below the lowest piece (fixed value of the library).
UNKNOWN_PENALTY = 10.0


def _short(x: float) -> float:
    """Rounded to 32 bits."""
    return struct.unpack("f", struct.pack("f", x))[0]


class Pieces:
    """Encoder and decoder of one model file. kind: "bpe" or "unigram"."""

    def __init__(self, path: str | None = None, kind: str = "bpe", proto: bytes | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind, self.normalize, self.unknown = kind, sp.normalize, sp.unk_id()
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.size = [len(t) for t in self.text]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.dummy_prefix = sp.normalize("a").startswith(SPACE)
        self.singles = singles = {t for t in self.id if len(t) == 1}
        if any(SPACE in t.lstrip(SPACE) for t in self.id):
            raise ValueError("pieces with a space inside are not supported")
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.odd = re.compile(f"([^{re.escape(''.join(sorted(singles)))}])")
        if kind == "bpe":
            if any(c not in singles for t in self.id for c in t):
                raise ValueError("a piece has a character that is no piece")
            order = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: -self.score[i])
            self.rank: dict[int, float] = {}
            for k, i in enumerate(order):  # equal scores share a rank
                same = k and self.score[i] == self.score[order[k - 1]]
                self.rank[i] = self.rank[order[k - 1]] if same else k
            self.halves = {i: h for i in order if (h := self._halves(self.text[i])) is not None}
            usable = [i for i in plain if len(self.text[i]) == 1 or i in self.halves]
        else:
            usable = plain
        self.low = _short(min((self.score[i] for i in plain), default=0.0) - UNKNOWN_PENALTY)
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.text[i], (len(self.text[i]), i))
        self.automaton.make_automaton()
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    # -- BPE ---------------------------------------------------------------------------------------------------------
    def merged(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols that the merges make of a short word, and the two that were joined last."""
        symbols, last = list(word), None
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.id.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return symbols, last
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [last[0] + last[1]]

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one; None if the merges never arrive at it."""
        symbols, last = self.merged(piece)
        return (self.id[last[0]], self.id[last[1]]) if len(symbols) == 1 and last else None

    def stays(self, a: int, b: int) -> bool:
        """Whether the merges leave piece a next to piece b.

        Takes both apart again, what was joined later first. The two symbols at the seam would have been joined if their own
        merge came before the merge that took one of them away; of equal merges the one further left came first.
        """
        seam = a << 32 | b
        if (known := self.pairs.get(seam)) is not None:
            return known
        left, right, until, strict, out = a, b, float("inf"), True, True
        while True:
            joined = self.id.get(self.text[left] + self.text[right])
            if joined is not None and (self.rank[joined] < until or (not strict and self.rank[joined] == until)):
                out = False
                break
            ra, rb = (self.rank.get(x, -1) if len(self.text[x]) > 1 else -1 for x in (left, right))
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until, strict, left = ra, True, self.halves[left][1]
            else:
                until, strict, right = rb, False, self.halves[right][0]
        if len(self.pairs) >= 4 * WORDS_KEPT:
            self.pairs.clear()
        self.pairs[seam] = out
        return out

    def _bpe(self, word: str) -> list[int]:
        ends, stays = [-1] * (len(word) + 1), self.stays  # the last piece of each prefix
        for at, (size, i) in self.automaton.iter(word):
            at += 1
            if ends[at] < 0 and (size == at or (ends[at - size] >= 0 and stays(ends[at - size], i))):
                ends[at] = i
        return self._back(ends, word)

    def _back(self, ends: list[int], word: str) -> list[int]:
        out, at, size = [], len(word), self.size
        while at:
            out.append(ends[at])
            at -= size[ends[at]]
        return out[::-1]

    # -- unigram -----------------------------------------------------------------------------------------------------
    def _viterbi(self, word: str) -> list[int]:
        n, score, singles = len(word), self.score, self.singles
        best, ends = [0.0] + [float("-inf")] * n, [-1] * (n + 1)
        found = self.automaton.iter(word)
        hit = next(found, None)
        for end in range(1, n + 1):
            while hit is not None and hit[0] < end:
                size, i = hit[1]
                reach = _short(best[end - size] + score[i])
                if reach > best[end]:
                    best[end], ends[end] = reach, i
                hit = next(found, None)
            if word[end - 1] not in singles and (reach := _short(best[end - 1] + self.low)) > best[end]:
                best[end], ends[end] = reach, -1
        out: list[int] = []
        at = n
        while at:
            if ends[at] < 0:
                at -= 1
                out += reversed(self._missing(word[at]))
            else:
                out.append(ends[at])
                at -= self.size[ends[at]]
        return out[::-1]

    def _missing(self, char: str) -> list[int]:
        """A character without a piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _word(self, word: str) -> bytes:
        if SPACE * 2 in word:  # merges of equal score: a run of spaces is taken apart by the merges themselves
            out = self._run(word)
        elif self.odd.search(word) is None:
            out = self._bpe(word)
        else:
            out = []
            for k, part in enumerate(self.odd.split(word)):
                out += self._missing(part) if k % 2 else self._bpe(part) if part else []
        return struct.pack(f"<{len(out)}i", *out)

    def _run(self, word: str) -> list[int]:
        """A word that begins with several spaces: merge by merge, with a heap."""
        import heapq

        symbols: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(word):
                a, b = symbols[k], symbols[after[k]]
                if (i := self.id.get(a + b)) is not None:
                    heapq.heappush(heap, (self.rank[i], k, a, b))

        for k in range(len(word) - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if symbols[k] != a or after[k] >= len(word) or symbols[after[k]] != b:
                continue
            gone = after[k]
            symbols[k], symbols[gone], after[k] = a + b, None, after[gone]
            if after[k] < len(word):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [self.id[s]] if s in self.id else self._missing(s)
        return out

    # -- texts -------------------------------------------------------------------------------------------------------
    def encode(self, text: str | None) -> np.ndarray:
        kept, out, normal = self.kept, [], self.normalize(text or "")
        if self.kind == "unigram":
            return self._merged_unknowns(np.array(self._viterbi(normal), "<i4"))
        for word in self.word.findall(normal):
            ids = kept.get(word)
            if ids is None:
                ids = self._word(word)
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                if len(word) <= 64:
                    kept[word] = ids
            out.append(ids)
        return self._merged_unknowns(np.frombuffer(b"".join(out), "<i4"))

    def _merged_unknowns(self, ids: np.ndarray) -> np.ndarray:
        if not self.bytes and len(ids):  # a run of unknown characters is one piece, also over words
            gone = ids == self.unknown
            gone[1:] &= gone[:-1].copy()
            gone[0] = False
            ids = ids[~gone]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.text[i])
        if run:
            out.append(run.decode(errors="replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_loaded: dict[tuple[str, str], Pieces] = {}


def pieces_of(path: str, kind: str) -> Pieces:
    """One encoder for each model in a Python worker."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = Pieces(path, kind)
    return _loaded[path, kind]


def encode(docs: DataFrame, path: str, columns: tuple[str, ...], kind: str = "bpe") -> DataFrame:
    """The given columns, piece_ids (array of int) and decoded (the text that the ids decode to). A narrow step: no shuffle."""
    docs = pick(docs, *columns)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [pieces.encode(t) for t in part.column("text").to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32())
                decoded = pa.array([pieces.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat), decoded], [*columns, "piece_ids", "decoded"])

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def digests(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """Per document: doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip."""
    docs = pick(docs, "doc_id", "text")
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, kind)
        for batch in batches:
            n, of_ids, of_text, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = pieces.encode(text)
                back = pieces.decode(ids)
                n.append(len(ids))
                of_ids.append(sha(ids.tobytes()))
                of_text.append(sha(back.encode()))
                same.append(back == (text or ""))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_pieces", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")
    return docs.mapInArrow(run, schema)


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path(MODEL))
