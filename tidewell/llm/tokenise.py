"""Whole-text encoding by a public tokenizer file, one pre-split piece at a time.

A BPE model never merges across the pieces that its pre-tokenizer cuts, so a
piece's ids depend on the piece alone and a bounded memo of pieces saves most of
the work. Texts of plain Latin characters are cut here by the pattern that the
file names; a text with any other character, or a file with other rules, goes
through the library whole. Strings of special tokens are cut out first, as the
library does.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array


#: Characters for which this module's own cutting is the library's: no control
#: characters, nothing that normalisation or other Unicode versions change.
_LATIN = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x180)) if c not in (0x130, 0xAD)]
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_OTHER_TEXT = re.compile(f"[^\\t\\n\\r{re.escape(''.join(_LATIN))}]")
#: The contractions that both patterns cut off.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
_WORDS = re.compile(f"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pieces that a worker remembers, in two generations of half as many.
MEMO_PIECES = 400_000


def public_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Memo(dict):
    """piece -> what `make` gives for it.

    A full generation becomes the old one; pieces met again move on from it, so
    frequent pieces stay.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(self) >= MEMO_PIECES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Splitter:
    """Cuts a text as a tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.rules, self.library = rules, Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        special = [t["content"] for t in rules["added_tokens"] or ()]
        self.special_ids = {t["content"]: t["id"] for t in rules["added_tokens"] or ()}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rules["added_tokens"] or ())
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.kind = self._kind() if plain else ""

    def _kind(self) -> str:
        """pieces, words, or nothing for other rules."""
        before, cut = self.rules["normalizer"], self.rules["pre_tokenizer"] or {}
        if before is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            return "pieces"
        steps = [x.get("type") for x in (before or {}).get("normalizers", ())]
        parts = cut.get("pretokenizers", ())
        if steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern", {}).get("Regex") == _WORD_PATTERN and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space"):
            return "words"
        return ""

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which are parts of their own."""
        if self.special is None or "<" not in text and not any(t in text for t in self.special_ids):
            return [text]
        return [x for x in self.special.split(text) if x]

    def pieces(self, part: str) -> list[str] | None:
        """Pieces of a part without special tokens; None where the library must cut it."""
        if not self.kind or _OTHER_TEXT.search(part):
            return None
        return _PIECES.findall(part) if self.kind == "pieces" else _WORDS.findall(part.lower())


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, add_special_tokens=False."""

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise OSError("ids are written as this machine's unsigned 32-bit integers, which must be little-endian")
        self.split = Splitter(path)
        self.vocabulary = self.split.library.get_vocab_size(with_added_tokens=True)
        self.model = self.split.library.model
        self.letters = dict(enumerate(byte_symbols()))
        self.memo = Memo(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.split.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece is cut already, so the library's model alone gives its ids, from the characters that stand for its bytes."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, text: str) -> bytes:
        get = self.memo.__getitem__
        out = []
        for part in self.split.parts(text):
            if part in self.split.special_ids:
                out.append(array("I", [self.split.special_ids[part]]).tobytes())
                continue
            pieces = self.split.pieces(part)
            out.append(self._whole(part) if pieces is None else b"".join(map(get, pieces)))
        return out[0] if len(out) == 1 else b"".join(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
