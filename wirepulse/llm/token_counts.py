"""Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced.

Byte-pair encoding joins, again and again, the best-ranked adjacent pair of the whole text.
A sequence of tokens is the encoding of its text if and only if every two neighbours in it are the
encoding of theirs: the first join across a token border would be the best one
between these two tokens alone, too. Hence a token that the encodings of two overlapping
chunks share (same piece, same place) is a proven boundary: what the left chunk has
up to it and what the right chunk has after it are together the encoding of both, because all
neighbours come from one chunk's encoding. Where an overlap holds no shared token, it is
widened, in the end up to the start of the text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, types as T

from wirepulse.llm.rows import text_map

#: Characters of a chunk; texts up to this length are encoded at once.
CHUNK = 1 << 15
#: Characters by which a chunk reaches back into the one before it, at first; widened by this factor.
OVERLAP, WIDER = 256, 8


class PieceCounter:
    """Counts of a sentencepiece model, spliced where its settings allow that."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        #: Byte-pair merges over unchanged characters, every one of which has bytes as a last resort.
        self.splices = (
            model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and model.trainer_spec.byte_fallback
            and not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and not kinds & {kind.UNUSED, kind.USER_DEFINED}
        )
        self.sizes = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_as_numpy(text))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
        """Tokens of a text, and encoded chunks."""
        if len(text) <= chunk or not self.splices:
            return len(self.ids(text)), 1
        stop, settled, chunks = chunk, 0, 1
        tail, begun = self.ids(text[:stop]), 0  # tokens that are not settled yet, and where their chunk begins
        while stop < len(text):
            reach = overlap
            while True:
                begin = max(stop - reach, 0)
                # What has to begin anew at the text's start doubles, so that all such attempts together cost twice the last.
                end = min(len(text), stop + (chunk if begin > begun else max(chunk, stop)))
                begin = begin if begin > begun else 0
                ids, chunks = self.ids(text[begin:end]), chunks + 1
                if not begin:
                    settled, tail = 0, ids
                    break
                shared = self._shared(tail, ids, text[begin:stop])
                if shared is not None:
                    settled, tail = settled + shared[0], ids[shared[1] :]
                    break
                reach *= WIDER
            begun, stop = begin, end
        return settled + len(tail), chunks

    def _shared(self, left: np.ndarray, right: np.ndarray, between: str) -> tuple[int, int] | None:
        """Tokens of ``left`` and ``right`` up to the end of the last token that both hold; ``between`` is their overlap.

        Places are offsets in the bytes of the escaped text, counted from the end of ``left``.
        """
        width = len(between.encode("utf-8", "surrogatepass")) + 2 * between.count(" ") + 3  # a blank takes three bytes, one stands in front
        ends = np.cumsum(self.sizes[left])
        ends -= ends[-1] if len(ends) else 0
        others = np.cumsum(self.sizes[right]) - width
        _, a, b = np.intersect1d(ends[ends > -width], others[others <= 0], assume_unique=True, return_indices=True)
        a += int(np.count_nonzero(ends <= -width))
        same = np.flatnonzero(left[a] == right[b])
        return (int(a[same[-1]]) + 1, int(b[same[-1]]) + 1) if len(same) else None


class JsonCounter:
    """Counts of a tokenizers file; texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def count(self, text: str) -> tuple[int, int]:
        return len(self.library.encode(text, add_special_tokens=False).ids), 1


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter | JsonCounter:
    """The counter of a worker process, kept between its tasks."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_chunks)`` of every row.

    ``tokenizer`` is a path that every executor can read: ``.model`` for sentencepiece,
    ``.json`` for tokenizers. Special tokens are neither added nor found in texts other than
    by the library's default. Narrow: nothing is shuffled. A null text is empty (no bytes, no
    tokens); null and repeated ids stay as they are; an empty table gives no rows; other columns are
    not read. A task holds one text and its ids; of a text over 32,768 characters
    the library sees a chunk at a time, except where widening failed up to its start.
    """
    path = tokenizer or default_model()

    def make():
        codec = counter(path)

        def row(text: str) -> tuple[int, int, bool, int]:
            tokens, chunks = codec.count(text)
            return len(text.encode("utf-8", "surrogatepass")), tokens, tokens > limit, chunks

        return row

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("n_chunks", T.LongType())]
    return text_map(docs, id_col, text_col, fields, make)
