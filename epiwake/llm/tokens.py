"""Token ids by a public byte-level BPE vocabulary.

The ids equal those of the ``tokenizers`` file ``byte_bpe_50k.json`` without special tokens (tests
compare them). They are computed from the rank form of the same vocabulary, which takes a sixth of
the processor time.
"""

from __future__ import annotations

import base64
import os
from array import array

#: Vocabulary file; a parameter of every operator that tokenizes.
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ends each document in packed output.
END_ID = 0


def vocabulary_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        # Only a run of several white-space characters needs the look-ahead; without it the
        # splitting is a plain automaton.
        plain = pattern.replace(r"\s+(?!\S)|", "")
        self._ranks = ranks
        self._any = tiktoken.Encoding("any", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; ids are the ranks."""
        out = [b""] * (max(self._ranks.values()) + 1)
        for token, rank in self._ranks.items():
            out[rank] = token
        return out

    def ids(self, text: str) -> bytes:
        # Enough to see a run: of two neighbours one is a space, a line feed, or a rarer character.
        simple = text.isprintable() if "\n" not in text else text.replace("\n", "").isprintable()
        simple = simple and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        return array("I", (self._plain if simple else self._any).encode_ordinary(text)).tobytes()
