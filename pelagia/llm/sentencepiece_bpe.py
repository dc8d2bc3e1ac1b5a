"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if each piece and each adjacent pair of pieces comes
out again when its own characters are merged by score. So the encoder takes the longest match at a
position (all matches come from one Aho-Corasick pass), accepts it if it is compatible with the piece
before, else tries the next shorter one, and steps back when none is left; positions from which no encoding
goes on are marked in a bitfield and never entered again. Pair checks are remembered.

No piece of the model holds a space mark behind another character, so merges never cross one and a text is
encoded chunk by chunk. The constructor refuses models for which this or an assumption on normalisation
does not hold. One mapInArrow does the work: no shuffle, and memory is bounded by the caches.

Defined results: a null or empty text gives no ids and an empty decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from pelagia.llm.chunk_cache import ChunkCache
from pelagia.llm.common import table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
BPE, NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 1, 2, 3, 4, 5, 6
MAX_PAIRS = 400_000


class Codec:
    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("the model normalises text in another way")
        pieces = list(model.pieces)
        if any(p.type in (USER_DEFINED, UNUSED) for p in pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.scores = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.codes = {piece: i.to_bytes(4, "little") for piece, i in self.ids.items()}
        self.cache = ChunkCache(lambda chunks: [self._chunk_bytes(c) for c in chunks])
        self.surface = [b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in pieces]
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.led = [p.type == NORMAL and p.piece.startswith(SPACE) for p in pieces]

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair that forms a piece, the leftmost of equals, until none does."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str | None, right: str) -> bool:
        """Whether merging brings out the pair (or, at a start, the one piece) again."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merged(right) == [right] if left is None else self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marks already; unknown characters stand for themselves."""
        n = len(text)
        longest = [1] * n
        for end, size in self.matches.iter(text):
            longest[end - size + 1] = size  # matches come by their ends, so the longest of a start comes last
        ids, known, failed = self.ids, self.pairs, None
        out: list[str] = []
        last, pos = None, 0
        size = longest[0] if n else 0
        while pos < n:
            end = pos + size
            piece = text[pos:end]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                fits = known.get((last, piece))
                if fits or fits is None and self._fits(last, piece):
                    out.append(piece)
                    last, pos = piece, end
                    if pos < n:
                        size = longest[pos]
                    continue
            size -= 1
            while size > 1 and text[pos : pos + size] not in ids:
                size -= 1
            if size == 0:  # nothing fits here: step back and try shorter pieces there
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                size = len(out.pop())
                pos -= size
                last = out[-1] if out else None
        return out

    def _chunk_bytes(self, chunk: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a chunk with a space mark before it."""
        codes = self.codes
        try:
            return b"".join([codes[p] for p in self.pieces(SPACE + chunk)])
        except KeyError:
            return b"".join([codes[p] if p in codes else b"".join([self.byte_ids[b].to_bytes(4, "little") for b in p.encode()]) for p in self.pieces(SPACE + chunk)])

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.replace(SPACE, " ").split(" ")
        if "" in chunks:
            joined, run = [], 0
            for chunk in chunks[:-1]:
                if chunk:
                    joined.append(SPACE * run + chunk)
                    run = 0
                else:
                    run += 1
            joined.append(SPACE * run + chunks[-1])
            chunks = joined
        return b"".join(map(self.cache.ensure(chunks).__getitem__, chunks))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        if ids and self.led[ids[0]]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Where byte pieces do not form characters, each stray byte becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                    except UnicodeDecodeError:
                        continue
                    run = run[size:]
                    break
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.surface[i].decode())
        text = "".join(out)
        return text[1:] if self.led[ids[0]] else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(documents: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""
    path = model_path or public_tokenizers.path(MODEL)
    schema = "doc_id long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                encoded = [own.encode_bytes(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(encoded) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
                flat = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
                decoded = [own.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in encoded]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    out = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)
    return out if id_column == "doc_id" else out.withColumnRenamed("doc_id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
