"""Byte-level BPE with a sentencepiece model built straight from a rank file.

Every byte is written as one printable character, so a vocabulary entry is a
piece and its score is the negative rank; the model has identity normalisation
and no added blanks. Texts are cut into pre-tokens by the pattern of the
vocabulary, each pre-token is encoded alone, and ids are decoded by the
inverse mapping to bytes. A pre-token that is itself an entry is that entry.

Tasks keep the encodings of frequent pre-tokens in a bounded table. The model
is a broadcast whose size is that of the vocabulary file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2 as sp_pb2


CACHE = 500_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next above 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece numbers follow the ranks."""
    letters = byte_letters()
    model = sp_pb2.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=sp_pb2.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = sp_pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    spec = model.normalizer_spec
    spec.name = "identity"
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts to little-endian 32-bit ids and decodes them."""

    def __init__(self, model: bytes, pattern: str, ids: np.ndarray):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.ids = ids  # the rank of each piece number
        self.whole = {self.pieces.id_to_piece(k): [k] for k in range(len(ids))}
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of = {
            int(ids[k]): bytes(back[c] for c in self.pieces.id_to_piece(k)) for k in range(len(ids))
        }
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Encode the pre-tokens that are not in the table yet."""
        new = list(set(tokens).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set(tokens))
        written = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for t in new]
        pieces = self.pieces.encode(written, out_type=int, num_threads=1)
        whole = self.whole
        pieces = [p if w not in whole else whole[w] for w, p in zip(written, pieces, strict=True)]
        flat = self.ids[np.fromiter(chain.from_iterable(pieces), dtype=np.int64)].astype("<u4").tobytes()
        ends = list(accumulate(map(len, pieces)))
        self.known.update(zip(new, [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, text: str) -> bytes:
        tokens = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            self._learn(tokens)
            return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str, ids: bytes) -> Codec:
    return Codec(model, pattern, np.frombuffer(ids, dtype=np.int64))


def codec(path: str, pattern: str) -> tuple[bytes, str, bytes]:
    """What a ``Codec`` is built from, small enough to send to every task."""
    ranks = read_ranks(path)
    return build_model(ranks), pattern, np.array(sorted(ranks.values()), dtype=np.int64).tobytes()


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit integers, and the bytes decoded from them.

    NULL text is empty; an empty text has no ids. Repeated rows repeat, no rows
    give no rows, other columns are not read. A text is held by one task, with
    its ids; texts follow each other.
    """
    parts = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(*parts.value)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return encode(docs, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
