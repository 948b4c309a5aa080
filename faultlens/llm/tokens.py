"""Token ids of whole texts, by the tokenizers library, with a bounded cache in each worker.

A text is cut at single spaces, and each distinct piece goes through the library once while it is
cached. Byte-level BPE merges only inside a word, and every piece but the first starts with the space
before it, so the ids of a text are those of its pieces in order. What is new in a portion of texts is
learned together: the pieces are one text to the library, and the ids that start with a space show
where they part.

Texts with white space beside white space, or at their end, are left to the library whole: their word
boundaries depend on the run. The vocabulary's added tokens (``<|endoftext|>``) come first: a text is cut at their literals,
each has its own id, and only what lies between them is cut into pieces.
"""

from __future__ import annotations

from array import array

# Entries of the younger generation of the cache; the older one has as many at most.
PIECES_KEPT = 400_000
# Characters of the texts whose new pieces are learned together.
PORTION_CHARACTERS = 2_000_000

# All white space of Unicode, and the separators that some count with it: twice in a row, or at the end.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LOOSE_SPACE = rf"{_SPACE}(?:{_SPACE}|\z)"


class _Generations:
    """A bounded cache: when the younger generation is full it becomes the older one, whose entries come back when used."""

    def __init__(self, most: int):
        self._most = most
        self.young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def codes(self, pieces: list[str], learn) -> list[bytes]:
        """Codes of distinct pieces; those that aren't cached go through ``learn`` together."""
        found = list(map(self.young.get, pieces))
        if self._old:
            found = [self._old.get(piece) if code is None else code for piece, code in zip(pieces, found, strict=True)]
        new = [piece for piece, code in zip(pieces, found, strict=True) if code is None]
        if new:
            learned = iter(learn(new))
            found = [next(learned) if code is None else code for code in found]
        if len(self.young) + len(new) > self._most:
            # A generation may grow beyond its size by what a single portion of texts holds.
            self._old, self.young = self.young, {}
        self.young.update(zip(pieces, found, strict=True))
        return found


class CachedEncoder:
    """Encodes ordinary texts to little-endian unsigned 32-bit ids.

    Literals of added tokens are ordinary text here; ``TextEncoder`` cuts texts at them before.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        self._starts_word = np.zeros(max(vocabulary.values()) + 1, bool)
        # The byte-level alphabet writes a space as this letter.
        self._starts_word[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._pieces = _Generations(PIECES_KEPT)

    def _by_library(self, texts: list[str]) -> list[bytes]:
        codes = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array("I", code.ids).tobytes() for code in codes]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        text = " " + " ".join(pieces)
        ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = (np.flatnonzero(self._starts_word[ids]) * 4).tolist()
        code = ids.tobytes()
        return [code[at:stop] for at, stop in zip(starts, [*starts[1:], len(code)], strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        start, size = 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= PORTION_CHARACTERS or i == len(texts):
                out += self._encode_portion(texts[start:i])
                start, size = i, 0
        return out

    def _encode_portion(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        wide = pc.match_substring_regex(column, _LOOSE_SPACE).to_numpy(zero_copy_only=False)
        whole = iter(self._by_library([texts[i] for i in np.flatnonzero(wide)]))
        cut = pc.split_pattern(column.filter(pa.array(~wide)), " ")
        bounds, parts = cut.offsets.to_numpy(), cut.flatten()
        # No space precedes the first piece of a text: it is looked up by its place, behind all others.
        heads = bounds[:-1]
        first = self._by_library(pc.take(parts, pa.array(heads)).to_pylist()) if len(heads) else []
        behind = np.ones(len(parts), bool)
        behind[heads] = False
        named = pc.dictionary_encode(parts.filter(pa.array(behind)))
        pieces = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = (self._pieces.codes(pieces, self._learn) if pieces else []) + first
        which = np.empty(len(parts), np.int64)
        which[behind] = named.indices.to_numpy()
        which[heads] = len(pieces) + np.arange(len(heads))

        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), "<u4")
        counts = sizes[which]
        stops = np.cumsum(counts)
        # Place of every id of the texts among those of the distinct pieces.
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - (stops - counts), counts)
        places += np.arange(len(places))
        ids = flat[places].tobytes()
        edges = (np.concatenate([[0], stops])[bounds] * 4).tolist()
        ordinary = iter([ids[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        return [next(whole) if is_wide else next(ordinary) for is_wide in wide]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class TextEncoder:
    """Encodes whole texts as the library does without ``add_special_tokens``."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self._own = CachedEncoder(path)
        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        self._codes = {token.content: array("I", [i]).tobytes() for i, token in added.items()}
        # Of several literals at one place the longest counts.
        literals = sorted(map(regex.escape, self._codes), key=len, reverse=True)
        self._literals = regex.compile(f"({'|'.join(literals)})") if literals else None
        # Tokens that take white space with them, or only stand alone, are left to the library.
        self._bare = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())

    def _encode_with_literals(self, text: str) -> bytes:
        if not self._bare:
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # Every second part is a literal.
        parts = self._literals.split(text)
        ordinary = iter(self._own.encode_all(parts[::2]))
        return b"".join(self._codes[part] if i % 2 else next(ordinary) for i, part in enumerate(parts))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self._literals:
            return self._own.encode_all(texts)
        odd = [i for i, text in enumerate(texts) if self._literals.search(text)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        codes = self._own.encode_all(plain)
        for i in odd:
            codes[i] = self._encode_with_literals(texts[i])
        return codes

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for the tokenizer file at ``path``, which every machine has."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
