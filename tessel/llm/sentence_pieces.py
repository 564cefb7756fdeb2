"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give the pieces that end there,
longest first; each relaxes the best score of its end from that of its start.
No piece has a space mark after another sign, so a text is cut before each run of marks
(and around line ends, which no piece holds) and chunks are encoded once and kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: An unknown sign costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 200_000

_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceModel(dict):
    """The chunks' ids as little-endian 32-bit numbers, and the pieces' bytes for decoding."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.unknown = model.unk_id()
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses a chunk's end")
                self.bytes.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    scores.append(model.get_score(i))
                    self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
        self.automaton.make_automaton()
        self.worst = min(scores, default=0.0) - UNKNOWN_PENALTY

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation; of equals, the one with the longer last piece."""
        n = len(chunk)
        best, size, piece = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        done, worst = 0, self.worst
        for end, (length, score, i) in self.automaton.iter(chunk):
            end += 1
            while done < end:  # by default a sign is unknown
                done += 1
                best[done] = best[done - 1] + worst
            s = best[end - length] + score
            if s > best[end]:
                best[end], size[end], piece[end] = s, length, i
        out, at = [], n
        while at:
            i = piece[at] if at <= done else -1
            if i >= 0:
                out.append(i)
                at -= size[at]
            else:
                at -= 1
                sign = chunk[at].encode("utf-8", "replace")
                out += [self.byte_ids[b] for b in reversed(sign)] if self.byte_ids else [self.unknown]
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        found = array("I", self.viterbi(chunk)).tobytes()
        if len(chunk) < 200:
            self[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, _CHUNKS.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: bytes) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str | None = None) -> PieceModel:
    return PieceModel(path or public_tokenizers.path(DEFAULT_MODEL))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids, round_trip)``: the ids as little-endian 32-bit numbers, and whether they decode to the text.

    Cases: null or empty text - no ids, a round trip; texts of any length are read whole
    (a word without spaces is one chunk, in linear time); a text that itself holds the
    space mark decodes to a space there and is no round trip; null ids and repeated rows - a row each;
    empty table - no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = [model.encode(t) for t in texts]
                same = [model.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(same)], names=[id_col, "ids", "round_trip"])
        model.clear()  # the next task may be of another kind

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, round_trip boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, text)`` from ids.

    Cases: null or no ids - an empty text; texts of any length; a null id column and repeated rows - a row each; empty table - no
    rows; extra columns are ignored. Ids outside the vocabulary are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"), "round_trip")
