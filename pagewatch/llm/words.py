"""A faster encoder of whole words over a byte-level tokenizer file."""

from __future__ import annotations

import json
import struct

from pagewatch.llm.bpe import byte_letters
from pagewatch.llm.id_files import LibraryEncoder


class WordEncoder(LibraryEncoder):
    """Words that are not remembered are merged by tiktoken over the file's own vocabulary.

    It merges the adjacent bytes whose union has the lowest id, which is the merge
    list's order where the list makes ids in ascending order; other files keep the
    tokenizers library's model.
    """

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, ids = byte_letters(), model["vocab"]
        self.bytes_of = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if token not in self.added:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.merge = None
        if all(a < b for a, b in zip(made, made[1:])):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_of) if b}
            self.merge = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, word: str) -> bytes:
        if self.merge is None:
            return super()._ids(word)
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids)
