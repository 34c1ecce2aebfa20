"""SentencePiece encoding by a streaming Viterbi search over the scores of a model's pieces, and decoding.

A stream keeps best scores and backpointers only from the last committed boundary on. A start stays active while what
follows it is the beginning of some piece, at most the longest piece. Every surviving path ends in an active start. Once
the window is longer than the longest piece, their backpointers are followed to the latest boundary that all of them
share, and the ids before it are committed; nothing is committed while paths still differ, so ids are those of a search
over the whole text. Where paths do not meet, the window grows by half before it is tried again, which keeps time linear.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from voxspark.llm.common import Remembered, add_columns

#: Fixed values of the format: the mark that stands for a space, and what an unknown character costs below the worst piece.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches whose ids a worker remembers in each of two generations; what is forgotten is only found again.
REMEMBERED = 400_000
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: score and id of each piece, beginnings of pieces with their scores if they are pieces themselves, bytes
    of each id, ids of single bytes, length of the longest piece."""

    scores: dict[str, float]
    ids: dict[str, int]
    beginnings: dict[str, float | None]
    octets: list[bytes]
    byte_ids: list[int]
    unknown: float
    separable: bool
    longest: int


def load_pieces(model_path: str) -> Pieces:
    """From a SentencePiece model file with byte pieces. Control pieces and the unknown piece never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores, ids, octets, byte_ids = {}, {}, [b""] * model.vocab_size(), [0] * 256
    for number in range(model.vocab_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            value = int(piece[3:5], 16)
            byte_ids[value], octets[number] = number, bytes([value])
        elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
            scores[piece], ids[piece] = model.get_score(number), number
            octets[number] = piece.replace(SPACE, " ").encode()
    beginnings = {piece[:n]: scores.get(piece[:n]) for piece in scores for n in range(1, len(piece) + 1)}
    separable = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in scores)
    return Pieces(scores, ids, beginnings, octets, byte_ids, min(scores.values()) - UNKNOWN_PENALTY, separable, max(map(len, scores)))


@dataclass
class Stream:
    """Feed text with ``push`` and end it with ``finish``; both return the ids that are settled."""

    pieces: Pieces
    window: str = ""
    best: list[float] = field(default_factory=lambda: [0.0])
    back: list[int] = field(default_factory=lambda: [0])
    active: list[int] = field(default_factory=lambda: [0])
    limit: int = 0

    def push(self, text: str) -> list[int]:
        found: list[int] = []
        beginnings, unknown = self.pieces.beginnings, self.pieces.unknown
        window, best, back, active, limit = self.window, self.best, self.back, self.active, self.limit or self.pieces.longest
        for character in text:
            window += character
            end = len(window)
            highest, origin, still = None, 0, []
            for start in active:
                content = window[start:]
                value = None
                if content in beginnings:
                    value = beginnings[content]
                    still.append(start)
                if value is None:
                    if start != end - 1:
                        continue
                    value = unknown
                total = best[start] + value
                if highest is None or total > highest:
                    highest, origin = total, start
            best.append(highest)
            back.append(origin)
            still.append(end)
            active = still
            if end > limit or active[0] == end:
                self.window, self.best, self.back, self.active = window, best, back, active
                found += self._settle()
                window, best, back, active, limit = self.window, self.best, self.back, self.active, self.limit
        self.window, self.best, self.back, self.active = window, best, back, active
        return found

    def finish(self) -> list[int]:
        return self._commit(len(self.window))

    def _settle(self) -> list[int]:
        """Commits up to the latest boundary on the paths of all active starts."""
        if len(self.active) == 1:
            return self._commit(self.active[0])
        met = set(self.active)
        while len(met) > 1:
            latest = max(met)
            met.remove(latest)
            met.add(self.back[latest])
        found = self._commit(met.pop())
        left, longest = len(self.window), self.pieces.longest
        self.limit = longest if left < longest else left + left // 2
        return found

    def _commit(self, end: int) -> list[int]:
        """The ids before a boundary, which becomes the window's start, of score 0. Positions whose path missed it are never
        met again."""
        cuts, boundary = [], end
        while end:
            cuts.append((self.back[end], end))
            end = self.back[end]
        found: list[int] = []
        for start, stop in reversed(cuts):
            piece = self.window[start:stop]
            number = self.pieces.ids.get(piece)
            found += [self.pieces.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if number is None else [number]
        if boundary == len(self.window):
            self.window, self.best, self.back, self.active, self.limit = "", [0.0], [0], [0], self.pieces.longest
        elif boundary:
            self.window = self.window[boundary:]
            self.best = [score - self.best[boundary] for score in self.best[boundary:]]
            self.back = [0, *(origin - boundary for origin in self.back[boundary + 1 :])]
            self.active = [start - boundary for start in self.active if start >= boundary]
        return found


class Encoder:
    """Ids of whole texts. Where no piece reaches over the start of a word, stretches between word starts are separate
    streams, and the ids of a stretch are remembered."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._stretches = Remembered(lambda texts: [self._stretch(t) for t in texts], REMEMBERED)

    def _stretch(self, text: str) -> bytes:
        stream = Stream(self.pieces)
        return array("I", stream.push(text) + stream.finish()).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        marked = SPACE + text.replace(" ", SPACE)
        if not self.pieces.separable:
            return np.frombuffer(self._stretch(marked), np.uint32)
        return np.frombuffer(self._stretches.joined(_STRETCH.findall(marked)), np.uint32)


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of the ids: byte pieces join to characters (broken ones become U+FFFD), marks to spaces, the first is dropped."""
    return b"".join(map(pieces.octets.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


#: One encoder per worker process, kept over tasks.
_ENCODERS: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``ids``, their number ``n_ids``, ``ids_crc32`` (of the ids as little-endian 32-bit
    integers) and ``same``: whether decoding gives the text again. Null and empty texts have no ids. A text that holds the
    space mark U+2581 itself decodes to a space there, as in the format. The vocabulary, of fixed size, is broadcast.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(texts: list) -> list[pa.Array]:
        if model_path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[model_path] = Encoder(pieces.value)
        encoder = _ENCODERS[model_path]
        ids, sums, same = [], [], []
        for value in texts:
            found = encoder.encode(value)
            ids.append(found.view(np.int32))
            sums.append(zlib.crc32(found))
            same.append(decode(encoder.pieces, found) == (value or ""))
        counts = np.array([len(x) for x in ids], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
        return [lists, pa.array(counts), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]

    added = [("ids", "array<int>"), ("n_ids", "long"), ("ids_crc32", "long"), ("same", "boolean")]
    return add_columns(df, text, keep, added, run)
