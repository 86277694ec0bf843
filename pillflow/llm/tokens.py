"""Whole texts to token ids, each distinct piece of text encoded once per worker.

A text is cut where every pre-tokenizer of the given files cuts as well: before a single blank and around a single
line break between other characters. The pieces are encoded by a library, many in one call, and remembered. A text
with any other white space at a cut is encoded as a whole. The result is the library's for the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from pillflow.llm.common import worker_cache

#: Pieces a worker remembers; beyond that it forgets them all and starts again.
REMEMBERED = 1_000_000
_JOINED = 1000
_ENDS = ",.;:!?"
#: Characters that a text may not hold if it is to be cut: marks used here, and white space but blank and line break.
_ODD = [chr(c) for c in (0, 1, *range(9, 10), *range(11, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]


class PieceCache:
    """``all_ids(texts)``: the ids of each text as little-endian unsigned 32-bit integers, in bytes.

    A subclass gives ``whole(text)`` and ``learn(pieces)``, which puts the ids of pieces into ``known``.
    """

    def __init__(self, known: dict, blanks_dropped: bool):
        self.known, self.blanks_dropped = known, blanks_dropped

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def learn(self, pieces: set[str]) -> None:
        raise NotImplementedError

    def all_ids(self, texts: list[str]) -> list[bytes]:
        result, i = [], 0
        while i < len(texts):  # about a megabyte at a time, so that the pieces at hand stay few
            j, size = i, 0
            while j < len(texts) and size < 1_000_000:
                size += len(texts[j])
                j += 1
            result += self._some(texts[i:j])
            i = j
        return result

    def _some(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if not known:
            known.update({"\n": self._plain("\n"), "": None, " ": None})
            if self.blanks_dropped:
                known.update({"": b"", " ": b""})
        get = known.get
        every = "".join(texts)
        odd = [t for t in _ODD if t in every]
        cut, fresh = [], set()
        for text in texts:
            if odd and any(t in text for t in odd):
                cut.append((None, [None], [0], ["\0"]))
                continue
            pieces = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
            if pieces[-1] == "" and (len(pieces) == 1 or pieces[-2] == "\n"):
                pieces.pop()
            ids = list(map(get, pieces))
            try:  # most texts hold nothing new
                cut.append((b"".join(ids), None, None, None))
                continue
            except TypeError:
                pass
            gaps = [i for i, x in enumerate(ids) if x is None]
            missing = [pieces[i] for i in gaps]
            fresh.update(missing)
            cut.append((None, ids, gaps, missing))
        self.learn(fresh - {"", " "})
        out = []
        for text, (done, ids, gaps, missing) in zip(texts, cut):
            if done is not None:
                out.append(done)
                continue
            for i, piece in zip(gaps, missing):
                ids[i] = get(piece)
            # What is still open is a blank next to white space, or an odd character: the text goes as a whole.
            out.append(self._plain(text) if None in [ids[i] for i in gaps] else b"".join(ids))
        return out

    def _plain(self, text: str) -> bytes:
        return np.array(self.whole(text), "<u4").tobytes()


class PieceEncoder(PieceCache):
    """Ids by the tokenizers library.

    ``separator`` is a text that, put between pieces, becomes the one id ``separator_id`` and changes nothing else;
    ``blanks_dropped`` says that the file's tokenizer drops white space.
    """

    def __init__(self, path: str, separator: str, blanks_dropped: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        kept = worker_cache(f"pieces:{path}")
        if not kept:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            words = Tokenizer.from_file(path)  # for words that need no cutting: bytes as letters, blanks between
            words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            words.normalizer = normalizers.Sequence([])
            kept.update(tokenizer=tokenizer, words=words, known={}, letters=byte_letters())
        super().__init__(kept["known"], blanks_dropped)
        self.tokenizer, self.words, self.separator = kept["tokenizer"], kept["words"], separator
        self.letters = kept["letters"]
        self.mark = separator.strip(" ").translate(self.letters)
        (self.separator_id,) = self.whole(separator)
        self.ends = {c: np.array(self.whole(c), "<u4").tobytes() for c in _ENDS}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, pieces: set[str]) -> None:
        # A letter and a mark after it are never in one pre-token.
        ended = [p for p in pieces if p[-1] in _ENDS and p[-2:-1].isalpha()]
        words = pieces.difference(ended)
        words.update([p[:-1] for p in ended])
        folded = []
        if self.blanks_dropped:
            folded = [p for p in words if p.isascii() and p != p.strip(" ").lower()]
            words.difference_update(folded)
            words.update([p.strip(" ").lower() for p in folded])
        open_ = words.difference(self.known)
        if self.blanks_dropped:
            plain = [p for p in open_ if p.isascii() and p.isalpha()]
        else:
            plain = [p for p in open_ if (p[1:] if p[0] == " " else p).isalpha()]
        self._learn_joined(list(open_.difference(plain)), self.separator.join, self.whole)
        self._learn_joined(plain, self._join_letters, lambda text: self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        known, marks = self.known, self.ends
        for piece in folded:
            known[piece] = known[piece.strip(" ").lower()]
        for piece in ended:
            known[piece] = known[piece[:-1]] + marks[piece[-1]]


    def _join_letters(self, some: list[str]) -> str:
        joined = "\n".join(some).encode().decode("latin-1").translate(self.letters)
        return joined.replace(self.letters[10], f" {self.mark} ")

    def _learn_joined(self, pieces: list[str], join, encode) -> None:
        for i in range(0, len(pieces), _JOINED):
            some = pieces[i:i + _JOINED]
            ids = np.array(encode(join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.separator_id)
            starts = np.append(0, 4 * (cuts + 1)).tolist()
            ends = np.append(4 * cuts, 4 * len(ids)).tolist()
            raw = ids.tobytes()
            assert len(starts) == len(some)
            self.known.update(zip(some, [raw[x:y] for x, y in zip(starts, ends)]))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def byte_encoder(path: str) -> PieceEncoder:
    """For byte_bpe_50k.json."""
    return PieceEncoder(path, "\n", False)


def word_encoder(path: str) -> PieceEncoder:
    """For word_bpe_49k.json."""
    return PieceEncoder(path, " \1 ", True)
