"""SentencePiece encoding and decoding for merge-type vocabularies (operator 10).

A score-ordered agenda holds the adjacent symbol pairs whose join is a piece; the best score (then the leftmost pair) is
merged until no pair is left, and what is no piece falls back to bytes. No piece of such a vocabulary holds the space mark
after another character, and none holds a line feed, so a text falls into segments that can't merge with one another; a
segment falls further apart between two characters that no piece holds side by side. A worker keeps a bounded memo of both. In
every Arrow batch the new segments, and the batch's first document as a whole, are checked against the sentencepiece library; a
difference raises an error.

Defined cases: a null text is the empty text (only the begin and end ids); a text of any length is read whole; each input row
gives one row, repeated rows alike; a null doc_id is kept; other columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Recent

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of a worker's memos, each held twice at most: about 220 bytes an entry, so 350 MB.
CACHE_SEGMENTS, CACHE_PARTS = 500_000, 300_000


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.pieces = {lib.id_to_piece(i): (i, lib.get_score(i)) for i in range(size) if i not in special}
        order = {score: r for r, score in enumerate(sorted({score for _, score in self.pieces.values()}, reverse=True))}
        self.rank = {piece: order[score] for piece, (_, score) in self.pieces.items()}
        surface = [b""] * size
        for piece, (i, _) in self.pieces.items():
            surface[i] = piece.replace(MARK, " ").encode()
        byte_ids = {lib.id_to_piece(i): i for i in special if lib.is_byte(i)}
        self.byte_id = [byte_ids[f"<0x{b:02X}>"] for b in range(256)]
        for b, i in enumerate(self.byte_id):
            surface[i] = bytes([b])
        self.pool = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.width = np.array([len(x) for x in surface], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.side_by_side = {pair for piece in self.pieces for pair in zip(piece, piece[1:])}
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        crossing = [p for p in self.pieces if re.search(f"[^{MARK}]{MARK}", p) or "\n" in p]
        if crossing or len(byte_ids) != 256 or lib.normalize(" a  Ⅳ b ") != f"{MARK}{MARK}a{MARK}{MARK}Ⅳ{MARK}b{MARK}":
            raise ValueError("a merge-type vocabulary with byte fallback, plain normalisation and no piece across words is needed")
        self.parts = Recent(self._ids_of_part, CACHE_PARTS)
        self.segments = Recent(self._ids_of_segment, CACHE_SEGMENTS)
        self.fresh: list[tuple[str, bytes]] = []

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment (spaces as marks): the best pair first, of equal scores the leftmost."""
        symbols = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        # an entry is the rank of the pair's score and, in the low bits, where the pair begins
        agenda = [r << 32 | left for left, pair in enumerate(zip(segment, segment[1:])) if (r := rank(pair[0] + pair[1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            left = entry & 0xFFFFFFFF
            if (right := after[left]) >= n or not symbols[left]:
                continue
            joined = symbols[left] + symbols[right]
            if rank(joined) != entry >> 32:
                continue  # one of the two has merged with another since
            symbols[left], symbols[right] = joined, ""
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                if (r := rank(joined + symbols[right])) is not None:
                    push(agenda, r << 32 | left)
            if (first := before[left]) >= 0 and (r := rank(symbols[first] + joined)) is not None:
                push(agenda, r << 32 | first)
        find = self.pieces.get
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                found = find(symbol)
                ids += [found[0]] if found else [self.byte_id[b] for b in symbol.encode()]
        return ids

    def _ids_of_part(self, part: str) -> bytes:
        ids = np.array(self.agenda(part), dtype="<u4").tobytes()
        self.fresh.append((part, ids))
        return ids

    def _ids_of_segment(self, segment: str) -> bytes:
        """The segment's ids as little-endian unsigned 32-bit integers."""
        near, start, out = self.side_by_side, 0, []
        for i, pair in enumerate(zip(segment, segment[1:]), 1):
            if pair not in near:
                out.append(self.parts[segment[start:i]])
                start = i
        out.append(self.parts[segment[start:]])
        return b"".join(out)

    def body(self, text: str) -> bytes:
        """The ids of a text without begin and end ids, as bytes."""
        if not text:
            return b""
        return b"".join(map(self.segments.__getitem__, _SEGMENT.findall(MARK + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        raw = self.body(text)
        return [self.bos, *(int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)), self.eos]

    def decode_bytes(self, raw: bytes) -> bytes:
        """The UTF-8 text of ids (as bytes, begin and end ids left out): their surfaces joined, the dummy space taken off."""
        ids = np.frombuffer(raw, dtype="<u4")
        width = self.width[ids]
        ends = np.cumsum(width)
        out = self.pool[np.repeat(self.start[ids] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return out[1:] if out[:1] == b" " else out

    def decode(self, raw: bytes) -> str:
        return self.decode_bytes(raw).decode(errors="replace")

    def check_fresh(self) -> None:
        """Compare the parts that are new since the last call with the library's ids."""
        fresh, self.fresh = self.fresh, []
        line = self.byte_id[10].to_bytes(4, "little")
        for i in range(0, len(fresh), 5000):
            parts = [x for x in fresh[i : i + 5000] if x[0] != "\n"]
            # a line feed merges with nothing, so that parts between line feeds get the ids they have in a text
            text = "".join(["\n" + p.replace(MARK, " ") for p, _ in parts])
            if np.array(self.library.encode(text, num_threads=1)[1:], dtype="<u4").tobytes() != b"".join([line + ids for _, ids in parts]):
                raise ValueError("the agenda and the library differ on one of: " + " ".join(repr(p) for p, _ in parts[:20]))

    def check_document(self, text: str, raw: bytes) -> None:
        ids = self.library.encode(text, num_threads=1)
        if b"".join(i.to_bytes(4, "little") for i in ids) != raw or self.library.decode([self.bos, *ids, self.eos]) != self.decode(raw):
            raise ValueError("the agenda and the library differ on a document")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row. model_path: the model file's place on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        bos, eos = tool.bos.to_bytes(4, "little"), tool.eos.to_bytes(4, "little")
        for batch in batches:
            counts, ids_hash, text_hash, first = [], [], [], True
            for value in batch.column(1):
                text = value.as_py() or ""
                raw = tool.body(text)
                counts.append(len(raw) // 4 + 2)
                ids_hash.append(hashlib.sha256(bos + raw + eos).hexdigest())
                text_hash.append(hashlib.sha256(tool.decode_bytes(raw)).hexdigest())
                if first:
                    tool.check_document(text, raw)
                    first = False
            tool.check_fresh()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
