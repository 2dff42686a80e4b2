"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools


@functools.cache
def _encoders(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return fast, whole, special


def encode(text: str, json_path: str | None = None, ranks_path: str | None = None) -> list[int]:
    """Ids of ``text`` as ``tokenizers`` gives them for ``byte_bpe_50k.json`` without added special tokens.

    The rank file holds the same vocabulary and merges, and gives the same ids four times as fast; a text that
    spells a special token goes through ``tokenizers`` itself, which maps that spelling to the special id.
    """
    import public_tokenizers

    fast, whole, special = _encoders(
        json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    if any(s in text for s in special):
        return whole.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)
