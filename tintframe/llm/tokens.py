"""Token ids of whole texts, with a bounded cache of word pieces in each Python worker."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

#: How the tokenizer's file says to split its lower-cased texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The same for the characters up to U+017F, where lower case and NFC are one to one.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Texts with other characters, odd white space or what may be a special token go whole.
_OTHER = re.compile("[\x1c-\x1f\u0130\u0180-\U0010ffff]|<\\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes texts piece by piece, a piece being what the tokenizer never joins to another.

    ``encode`` returns little-endian unsigned 32-bit ids. Pieces of up to 48 characters are
    kept until ``limit`` of them are known; later new pieces are encoded once a call. With
    another tokenizer than the default kind every text is encoded whole.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.by_piece = _splits_as_known(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoded.ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces end to end; each ends with the token of a word's end."""
        ids = self._ids(" ".join(pieces))
        cuts = ((np.flatnonzero(self.is_end[ids]) + 1) * ids.itemsize).tolist()
        data = ids.tobytes()
        self.known.update(zip(pieces, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        pieces = [_PIECE.findall(t.lower()) if self.by_piece and not _OTHER.search(t) else None for t in texts]
        new = [p for p in set().union(*(some for some in pieces if some)) if p not in known]
        if new:
            self._learn(new)
        out = [self._ids(t).tobytes() if some is None else b"".join(map(known.__getitem__, some)) for t, some in zip(texts, pieces, strict=True)]
        room = max(0, self.limit - (len(known) - len(new)))
        for at, piece in enumerate(new):
            if at >= room or len(piece) > 48:
                del known[piece]
        return out


def _splits_as_known(tokenizer) -> bool:
    plan = json.loads(tokenizer.to_str())
    return _SPLIT in json.dumps(plan["pre_tokenizer"]) and plan["model"].get("end_of_word_suffix") == "</w>"


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
