"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import re

#: Python splits at these, the tokenizer does not; a text that has one is encoded as it stands.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
#: Characters for which lower-casing and NFC work one by one.
_PLAIN = re.compile("[\t-\r !-~¡-ɏ]*")
#: Runs of what is neither letter, number nor space, and the numbers, in plain text: pieces of their own.
_SIGNS = re.compile(r"((?:[^\w\s]|_)+|[0-9²³¹¼-¾])")
#: The tokenizer's own pattern, needed where an apostrophe may begin a piece.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Longer words take merging by ranks the square of their length.
_LONGEST = 400
_LONG = re.compile(rf"\S{{{_LONGEST + 1}}}")
#: Ends a piece; plain texts have none.
_END = "\0"


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, exactly as the tokenizer of `path` gives them.

    The tokenizer drops white space, cuts the rest into pieces and merges bytes inside a piece, whose last byte is marked. The same merges
    by their order are run by a faster library over the pieces of a text, each ended by a zero byte: first a byte joins that end, which
    makes it the marked byte, then pairs merge as listed. Words that are not plain or very long, and texts with special tokens, go
    through the tokenizer itself.
    """

    def __init__(self, path: str, most_words: int = 50_000):
        import json

        import numpy as np
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from zonecast.llm.alignment import printable_bytes

        self._numpy, self._most = np, most_words
        self._tokenizer = Tokenizer.from_file(path)
        self._cut = regex.compile(_PIECES).findall
        self._words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix, byte = model["end_of_word_suffix"], printable_bytes()

        def raw(token: str) -> bytes:
            inner = token.removesuffix(suffix)
            return bytes(byte[c] for c in inner) + (_END.encode() if inner != token else b"")

        base = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        order = [bytes([b]) + end for end in (b"", _END.encode()) for b in range(256)]
        ids = [base.get(b, 0) for b in order]
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            order.append(raw(left) + raw(right))
            ids.append(model["vocab"][left + right])
        self._ids_of = np.array(ids, dtype="<u4")
        self._merges = tiktoken.Encoding(
            "pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks={b: i for i, b in enumerate(order)}, special_tokens={}
        )

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = [self._text(t) if t else b"" for t in texts]
        if len(self._words) > self._most:
            self._words = {}
        return out

    def _text(self, text: str) -> bytes:
        if "<|" in text or _ODD_SPACE.search(text):
            return self._ids(text)
        if _PLAIN.fullmatch(text) and not _LONG.search(text):
            return self._plain(text)
        parts, plain = [], []
        for word in text.split():
            if len(word) <= _LONGEST and _PLAIN.fullmatch(word):
                plain.append(word)
                continue
            if plain:
                parts.append(self._plain(" ".join(plain)))
                plain = []
            parts.append(self._odd(word))
        if plain:
            parts.append(self._plain(" ".join(plain)))
        return b"".join(parts)

    def _ids(self, text: str) -> bytes:
        return self._numpy.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _odd(self, word: str) -> bytes:
        if len(word) > _LONGEST:
            return self._ids(word)
        if word not in self._words:
            self._words[word] = self._ids(word)
        return self._words[word]

    def _plain(self, text: str) -> bytes:
        lower = text.lower()
        pieces = self._cut(lower) if "'" in lower else " ".join(_SIGNS.split(lower)).split()
        if not pieces:
            return b""
        return self._ids_of[self._merges.encode_ordinary(_END.join(pieces) + _END)].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
