"""Byte-level BPE of whole texts with the tokenizers library, each piece once.

The byte-level pre-tokenizer always starts a new pre-token at a space that has
a non-white character on both sides. A text cut there gives, piece by piece,
the ids of the whole text, so that ids of pieces may be kept and reused: the
library encodes each distinct piece once for as long as it is kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.models import BPE  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

#: White space other than the space and the newline, as Python sees it.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?= \S)")

#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 256


def default_path() -> str:
    """The tokenizer file that the queries use; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding; one whose texts may not be cut at spaces is refused."""
    t = Tokenizer.from_file(path)
    pre = t.pre_tokenizer
    plain = t.normalizer is None and isinstance(t.model, BPE) and t.model.dropout is None and isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space
    loose = [a.content for a in t.get_added_tokens_decoder().values() if a.lstrip or a.rstrip or a.single_word or any(c.isspace() for c in a.content)]
    if not plain or loose:
        raise ValueError(f"{path}: only byte-level BPE without normalizer, prefix space and dropout, whose added tokens hold no white space, can be encoded piece by piece")
    t.no_truncation()
    t.no_padding()
    return t


def regular(text: str) -> bool:
    """Whether every space of the text stands between two characters that aren't white."""
    return not ("  " in text or "\n " in text or " \n" in text or text[-1:] == " " or text[:1] == " " or _ODD.search(text))


def split_pieces(text: str) -> tuple[str, list[str], bool]:
    """(first piece, later pieces, whether the later ones have lost a leading space)."""
    if regular(text):
        head, *rest = text.split(" ")
        return head, rest, True
    head, *rest = _CUT.split(text)
    return head, rest, False


class PieceEncoder:
    """Encodes texts; ids come as little-endian unsigned 32-bit integers.

    ``limit``: so many pieces are kept at most; then all are forgotten. The ids
    do not depend on it.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        self.tokenizer, self.limit, self.kept = tokenizer(path), limit, {}
        self.sizes = piece_sizes(path)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_bare(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that follow a space and hold none: all in one text, cut where the spaces stand."""
        if not pieces:
            return []
        text = "".join([" " + x for x in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        cuts = (4 * np.searchsorted(starts, np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32))).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, of which most have one space, in front."""
        bare = [w[1:] for w in words if w[:1] == " " and w[1:] and " " not in w[1:] and not w[1].isspace() and not w[-1].isspace()]
        found = iter(self.ids_of_bare(bare))
        chosen = {" " + w for w in bare}
        rest = iter(self.ids_of([w for w in words if w not in chosen]))
        return [next(found) if w in chosen else next(rest) for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        kept, split = self.kept, [split_pieces(x) for x in texts]
        if len(kept) > self.limit:
            kept.clear()
        known = [list(map(kept.get, rest)) if bare else self.ids_of(rest) for _, rest, bare in split]
        holes = [[at for at, ids in enumerate(found) if ids is None] if None in found else () for found in known]
        fresh = list({rest[at] for (_, rest, _), gaps in zip(split, holes, strict=True) for at in gaps})
        new = dict(zip(fresh, self.ids_of_bare(fresh), strict=True))
        for (_, rest, _), found, gaps in zip(split, known, holes, strict=True):
            for at in gaps:
                found[at] = new[rest[at]]
        kept.update(new if max(map(len, fresh), default=0) <= LONGEST_KEPT else {k: v for k, v in new.items() if len(k) <= LONGEST_KEPT})
        heads = self.ids_of([head for head, _, _ in split])
        return [first + b"".join(found) for first, found in zip(heads, known, strict=True)]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that tasks share what is kept."""
    return PieceEncoder(path)


@lru_cache(maxsize=4)
def piece_sizes(path: str) -> np.ndarray:
    """Bytes of each id's piece."""
    return np.array([len(x) for x in id_to_piece(path)], np.int64)


def in_chunks(batch: pa.RecordBatch, text: str = "text", chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of about ``chars`` bytes of text (one text at least), with the texts; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // chars, prepend=0)).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(text).to_pylist()]


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_to_piece(path: str) -> list[bytes]:
    """The bytes of each id, of the vocabulary and the added tokens."""
    t, back = tokenizer(path), _byte_of_char()
    added = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    pieces = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        name = added.get(i) or t.id_to_token(i) or ""
        pieces.append(name.encode() if i in added else bytes(back[c] for c in name))
    return pieces
