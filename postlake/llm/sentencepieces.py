"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed by its wire format: pieces, scores and types, model type, and the normaliser's
settings. From these a tokenizer is rebuilt: the precompiled character map (if the model has one), removal of
extra blanks, the metaspace marker, and the model itself. Unigram models keep their scores; of BPE models the
merges are derived from the pieces (every split of a piece into two pieces, in the order of the merged piece's
score). Only ordinary pieces and those that users define can match text: control, byte and unused pieces go to the
model under names that no text holds. What the model doesn't know becomes bytes, if the model falls back to them.
Pieces that users define are matched first, the longest one where several begin. Ids decode to bytes by a table of
the same pieces.

No piece may hold the marker after another character, nor a line feed (`Rebuilt.separable` tests this): then a
normalised text can be cut before each run of markers and around line feeds without changing its ids. The
distinct chunks of a portion of texts are encoded once each, in multithreaded batches.

Null and empty texts have no ids. Parity with the sentencepiece library is reported for every document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCoder, over_batches, prepare, valid

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that are one text of a batch.
TOGETHER = 64


def fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class Proto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def parse(data: bytes) -> Proto:
    out = Proto()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            out.model_type, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            out.charsmap, out.dummy_prefix, out.remove_extra, out.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return out


class Rebuilt:
    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        self.threads = threads
        with open(path, "rb") as f:
            self.proto = p = parse(f.read())
        self.unknown = next((i for i, x in enumerate(p.pieces) if x[2] == UNKNOWN), 0)
        self.fallback = {int(x[3:5], 16): i for i, (x, _, t) in enumerate(p.pieces) if t == BYTE} if p.byte_fallback else {}
        self.user = {x: i for i, (x, _, t) in enumerate(p.pieces) if t == USER}
        #: The longest first; matched before the model sees the text.
        self.first = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        names = [x if t == NORMAL else f"\x00 {i}" for i, (x, _, t) in enumerate(p.pieces)]
        if p.model_type == UNIGRAM:
            lowest = min((s for _, s, t in p.pieces if t == NORMAL), default=0.0)
            model = models.Unigram([(x, s if t == NORMAL else lowest) for x, (_, s, t) in zip(names, p.pieces, strict=True)], unk_id=self.unknown, byte_fallback=False)
        elif p.model_type == BPE:
            usable = {x: (-s, i) for i, (x, s, t) in enumerate(p.pieces) if t == NORMAL}
            merges = sorted((rank, x[:i], x[i:]) for x, rank in usable.items() for i in range(1, len(x)) if x[:i] in usable and x[i:] in usable)
            model = models.BPE({x: i for i, x in enumerate(names)}, [(a, b) for _, a, b in merges], unk_token=names[self.unknown], fuse_unk=True, byte_fallback=False)
        else:
            raise ValueError(f"model type {p.model_type} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(p.charsmap)] if p.charsmap else []
        if p.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if p.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if p.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        ordinary = [x for x, _, t in p.pieces if t in (NORMAL, USER)]
        self.separable = not any("\n" in x or re.search(f"[^{MARK}]{MARK}", x) for x in ordinary)
        self.bytes = [bytes([int(x[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else x.replace(MARK, " ").encode() for x, _, t in p.pieces]
        self.simple = not p.charsmap and not p.remove_extra and p.escape and p.dummy_prefix
        self.coder = ChunkCoder(self._learn, "<u4", self._parted, kept=1 << 19)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        # Another operator in this worker may want it otherwise, so it is said before each use.
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.threads > 1 else "false"
        if self.first is None:
            return self._encoded(chunks)
        parts = [[x for x in self.first.split(c) if x] for c in chunks]
        found = iter(self._encoded([x for p in parts for x in p if x not in self.user]))
        return [b"".join(np.uint32(self.user[x]).tobytes() if x in self.user else next(found) for x in p) for p in parts]

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: many chunks without a blank are one text of a batch, in which each is a word."""
        alone = [c for c in chunks if " " in c or not c]
        whole = [c for c in chunks if " " not in c and c] if alone else chunks
        lists = [whole[i : i + TOGETHER] for i in range(0, len(whole), TOGETHER)]
        found: list[np.ndarray] = []
        for i in range(0, len(lists), 256):
            for some, e in zip(lists[i : i + 256], self.tokenizer.encode_batch([" ".join(x) for x in lists[i : i + 256]], add_special_tokens=False), strict=True):
                ids, at = np.array(e.ids, "<u4"), np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1
                if len(at) + 1 != len(some):  # a chunk without any id
                    found += [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4") for c in some]
                    continue
                found += np.split(ids, at)
        if self.fallback:  # the text of what is unknown becomes bytes
            for j in [j for j, ids in enumerate(found) if self.unknown in ids]:
                e = self.tokenizer.encode(whole[j], add_special_tokens=False)
                found[j] = np.array([x for k, (a, b) in zip(e.ids, e.offsets, strict=True) for x in ([self.fallback[c] for c in whole[j][a:b].encode()] if k == self.unknown else [k])], "<u4")
        out = [ids.tobytes() for ids in found]
        if not alone:
            return out
        rest, each = iter(out), {c: self._single(c) for c in dict.fromkeys(alone)}
        return [each[c] if " " in c or not c else next(rest) for c in chunks]

    def _single(self, chunk: str) -> bytes:
        """Ids of a chunk that may hold blanks, by the model alone."""
        ids = []
        for t in self.tokenizer.model.tokenize(chunk):
            a, b = t.offsets
            ids += [self.fallback[c] for c in chunk.encode()[a:b]] if t.id == self.unknown and self.fallback else [t.id]
        return np.array(ids, "<u4").tobytes()

    def _parted(self, texts: pa.Array) -> pa.Array:
        """Normalised texts with a blank behind each chunk; a model whose pieces forbid cuts keeps them whole."""
        if self.simple:
            marked = pc.replace_substring(texts, " ", MARK)
            normal = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        else:
            normal = pa.array([self.normalizer.normalize_str(t) if t else "" for t in texts.to_pylist()], pa.large_string())
        return pc.replace_substring_regex(normal, f"({MARK}*[^{MARK}\n]+|{MARK}+|\n)", "\\1 ") if self.separable else normal

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin and end."""
        return self.coder.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        return self.joined(list(map(self.bytes.__getitem__, ids.tolist())))

    def joined(self, pieces: list[bytes]) -> str:
        """The text of pieces from `bytes`; a marker may still come about from single bytes."""
        text = b"".join(pieces).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.proto.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def rebuilt(path: str) -> Rebuilt:
    return Rebuilt(path)


@lru_cache(maxsize=2)
def _other(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, the decoded text, round_trip (decoding gives the text back) and parity with the other library."""
    prepare(documents.sparkSession)
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> dict:
        model = rebuilt(path)
        texts = batch["text"].fill_null("")
        ids, at = model.encode(texts)
        ids = ids.view(np.int32)
        plain = texts.to_pylist()
        # Lists of a whole batch, so that a text costs slices of them and no arrays.
        flat, ends = ids.tolist(), at.tolist()
        pieces = list(map(model.bytes.__getitem__, flat))
        decoded = [model.joined(pieces[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        del pieces
        theirs = _other(path).encode(plain, num_threads=1)
        same = [flat[i:j] == o for i, j, o in zip(ends[:-1], ends[1:], theirs, strict=True)]
        return {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), "decoded": pa.array(decoded, pa.string()), "round_trip": pa.array([d == t for d, t in zip(decoded, plain, strict=True)], pa.bool_()), "parity": pa.array(same, pa.bool_())}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
    return over_batches(rows, run, "doc_id long, ids array<int>, decoded string, round_trip boolean, parity boolean")


def digest(encoded: DataFrame) -> DataFrame:
    def sums(batch: pa.RecordBatch) -> dict:
        ids = batch["ids"]
        flat, ends = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {"doc_id": batch["doc_id"], "n_ids": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_crc32": batch["decoded_crc32"], "round_trip": batch["round_trip"], "parity": batch["parity"]}

    rows = encoded.select("doc_id", "ids", F.crc32("decoded").alias("decoded_crc32"), "round_trip", "parity")
    return over_batches(rows, sums, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean")
