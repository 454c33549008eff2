"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A text becomes ``▁`` and its characters, spaces turned into ``▁``. From left to right the encoder takes the longest piece
an Aho-Corasick automaton finds at a place and keeps it if it is compatible with the piece before: merging the two
pieces' characters anew, best score first and leftmost among equals, must give back just these two. If no piece at a
place is compatible, the place is marked in a bitfield as one that leads nowhere and the piece before is shortened. A
sequence whose adjacent pieces are all compatible is the one that merging the whole text gives. Characters outside the
vocabulary become byte pieces and never merge.

No piece of a model has a ``▁`` behind another character (``Encoder`` tests it), so what stands before such a place never
merges with what follows: texts are cut there, and segments already seen are looked up. The memory of segments and of
pairs is bounded and forgets everything when full.

Defined results: a NULL text is encoded as an empty one, which has the begin and end IDs only; rows that repeat are
encoded alike; texts of any length are encoded whole, also without a single space.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import map_batches, table

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries of the memory of segments, and the longest segment it takes.
MEMORY, LONGEST = 600_000, 64
PAIRS = 1_000_000
#: Characters that the automaton scans at a time.
SCAN = 65_536


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """Encodes and decodes with the pieces of one model file, which is opened where the encoder is made."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.ids, self.score, self.byte_ids = {}, {}, {}
        self.bytes_of = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model has a space behind another character")
        self.finder = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merge(piece) == [piece]:  # a piece that merging never makes is never used
                self.finder.add_word(piece, piece)
        self.finder.make_automaton()
        self.reach = max(map(len, self.ids))
        self.compatible = lru_cache(PAIRS)(self._compatible)
        self.memory: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: join the adjacent pair with the best score, the leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[joined], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _compatible(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def _scan(self, text: str, block: int) -> list[list[str]]:
        """Pieces that start at each place of one block of ``SCAN`` places, the longest last."""
        start = block * SCAN
        found: list[list[str]] = [[] for _ in range(min(SCAN, len(text) - start))]
        part = text[start:start + SCAN + self.reach] if len(text) > SCAN else text
        for stop, piece in self.finder.iter(part):
            first = stop - len(piece) + 1
            if first < len(found):
                found[first].append(piece)
        return found

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        if len(text) <= SCAN:
            at = self._scan(text, 0).__getitem__
        else:
            block = lru_cache(4)(lambda number: self._scan(text, number))
            at = lambda place: block(place // SCAN)[place % SCAN]
        failed = bytearray(len(text) // 8 + 1)
        chosen: list[str] = []
        rest: list[int] = []  # how many shorter pieces are left to try at each chosen place
        place, left = 0, len(at(0)) if text else 0
        while place < len(text):
            pieces = at(place)
            while left:
                left -= 1
                piece = pieces[left]
                stop = place + len(piece)
                if failed[stop >> 3] >> (stop & 7) & 1 or chosen and not self.compatible(chosen[-1], piece):
                    continue
                chosen.append(piece)
                rest.append(left)
                place, left = stop, len(at(stop)) if stop < len(text) else 0
                break
            else:
                failed[place >> 3] |= 1 << (place & 7)
                place, left = place - len(chosen.pop()), rest.pop()
        return chosen

    def segment(self, text: str) -> tuple[bytes, bytes]:
        """IDs (little-endian, four bytes each) of a segment, and the bytes they decode to."""
        known = self.memory.get(text)
        if known is not None:
            return known
        pieces: list[int] = []
        start = 0
        if not self.characters.issuperset(text):
            for i, mark in enumerate(text):
                if mark not in self.characters:
                    pieces.extend(self.ids[p] for p in self.backtrack(text[start:i]))
                    pieces.extend(self.byte_ids[b] for b in mark.encode())
                    start = i + 1
        pieces.extend([self.ids[p] for p in self.backtrack(text[start:] if start else text)])
        out = b"".join([self.packed[i] for i in pieces]), b"".join([self.bytes_of[i] for i in pieces])
        if len(text) <= LONGEST:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[text] = out
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """All IDs of a text, begin and end included, and the bytes of the decoded text."""
        begin, end = self.packed[self.begin], self.packed[self.end]
        if not text:
            return begin + end, b""
        memory, segment = self.memory, self.segment
        parts = [memory.get(s) or segment(s) for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        # The space put before the text goes again when it is decoded.
        return b"".join([begin, *[p[0] for p in parts], end]), b"".join([p[1] for p in parts])[1:]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (begin and end included) of every row, with digests of the IDs and of the text
    they decode to, which are made where the IDs are. ``path`` is read on the executors."""
    model = path or vocabulary_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(model)
        coded, rows = [], []
        for text in batch.column(1).to_pylist():
            ids, decoded = coder.encode(text or "")
            coded.append(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        counts, *digests = (pa.array(c) for c in zip(*rows, strict=True))
        ends = np.concatenate([[0], np.cumsum(counts.to_numpy())]).astype(np.int32)
        flat = np.frombuffer(b"".join(coded), "<u4").view(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), counts, *digests, ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return map_batches(docs.select("doc_id", "text"), work, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).drop("ids")
