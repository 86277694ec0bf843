"""Byte-level BPE through a sentencepiece model made straight from the vocabulary.

Every token becomes a piece: its bytes as letters, one letter a byte, scored by its negative rank, so that the
library merges the pair of lowest rank first. The model normalises nothing and adds nothing. Texts are cut by the
pre-tokenizer's pattern, each distinct pre-token is encoded once, and ids are decoded by the inverse mapping.

The few tokens that merges do not reach from their bytes (if a vocabulary has such) are looked up whole, as the
rank libraries do. Null texts are empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from pillflow.llm.common import texts_of, with_own_id, with_text_id, worker_cache
from pillflow.llm.tokens import PieceCache

#: Distinct pre-tokens a worker remembers before it starts again.
REMEMBERED = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of lines ``base64 rank``. Its size is fixed by the file, not by the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_letters() -> str:
    """A letter for each byte: 256 from U+4E00 on, none of which any normalisation touches."""
    return "".join(chr(0x4E00 + b) for b in range(256))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece ``i`` is the token of rank ``i``, and one more for the unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    by_rank = sorted((rank, token) for token, rank in ranks.items())
    if [rank for rank, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    for rank, token in by_rank:
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(letters[b] for b in token), -float(rank), pb.ModelProto.SentencePiece.NORMAL
    piece = model.pieces.add()
    piece.piece, piece.score, piece.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    trainer = model.trainer_spec
    trainer.model_type = pb.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(by_rank), -1, -1, -1
    trainer.byte_fallback = False
    normal = model.normalizer_spec
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class PieceBpe(PieceCache):
    """Encoder and decoder for one model, to be used in tasks."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        letters = byte_letters()
        kept = worker_cache(f"bpe:{hash((model, pattern))}")
        if not kept:
            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            place = {c: b for b, c in enumerate(letters)}
            tokens = [bytes(place[c] for c in processor.id_to_piece(i)) for i in range(processor.get_piece_size() - 1)]
            table = dict(enumerate(letters))
            mapped = [t.decode("latin-1").translate(table) for t in tokens]
            whole = {t: [i] for i, (t, ids) in enumerate(zip(tokens, processor.encode(mapped, num_threads=1))) if ids != [i]}
            kept.update(processor=processor, tokens=tokens, table=table, odd=whole, known={}, pre={})
        super().__init__(kept["known"], False)
        self.processor, self.tokens, self.table = kept["processor"], kept["tokens"], kept["table"]
        self.odd, self.pre = kept["odd"], kept["pre"]
        self.pattern = regex.compile(pattern)

    def _learn_pre_tokens(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        mapped = [r.decode("latin-1").translate(self.table) for r in raw]
        odd = self.odd
        for piece, r, ids in zip(pieces, raw, self.processor.encode(mapped, num_threads=1)):
            self.pre[piece] = np.array(odd.get(r, ids), "<u4").tobytes()

    def _cut(self, texts: list[str]) -> list[list[str]]:
        if len(self.pre) > REMEMBERED:
            self.pre.clear()
        cut = [self.pattern.findall(t) for t in texts]
        self._learn_pre_tokens(list({p for pieces in cut for p in pieces}.difference(self.pre)))
        return cut

    def whole(self, text: str) -> list[int]:
        (pieces,) = self._cut([text])
        return np.frombuffer(b"".join([self.pre[p] for p in pieces]), "<u4").tolist()

    def learn(self, pieces: set[str]) -> None:
        known, pre = self.known, self.pre
        words = list(pieces)
        for word, found in zip(words, self._cut(words)):
            known[word] = pre[found[0]] if len(found) == 1 else b"".join([pre[p] for p in found])

    def decode(self, ids: list[int]) -> bytes:
        """The inverse mapping: the bytes of each id."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode_texts(documents: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (unsigned 32-bit integers, little-endian) of every whole text."""

    def encode(batches):
        bpe = PieceBpe(model, pattern)
        for batch in texts_of(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": bpe.all_ids(list(batch["text"]))})

    return with_own_id(with_text_id(documents, "text").mapInPandas(encode, "doc_id string, ids binary"), documents)


def digest_round_trip(documents: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """Encode every whole text and decode it again; per document the number of ids and digests of both."""

    def both(batches):
        bpe = PieceBpe(model, pattern)
        decimals = [str(i) for i in range(len(bpe.tokens))]
        for batch in texts_of(batches):
            rows = []
            for doc_id, raw in zip(batch["doc_id"], bpe.all_ids(list(batch["text"]))):
                ids = np.frombuffer(raw, "<u4").tolist()
                text = " ".join([decimals[i] for i in ids])
                rows.append((doc_id, len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    digests = with_text_id(documents, "text").mapInPandas(
        both, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return with_own_id(digests, documents)
