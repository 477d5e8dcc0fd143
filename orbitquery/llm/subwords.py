"""Exact library encodings assembled from cached pre-tokens.

Both vocabularies merge inside pre-tokens only, so the ids of a text are those of
its space-separated stretches, one after the other.  A batch of texts is split and
dictionary-encoded by Arrow, each distinct stretch is encoded by the tokenizers
library once and kept, and the ids of all texts are gathered in one step.  Texts
where stretches could interact (special strings, odd control characters) go to the
library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

#: Entries of a generation of kept stretches; a worker holds two at most, results do not depend on it.
STRETCHES = 400_000


def vocabulary_path(name: str) -> str:
    """An absolute path is used as it is; a bare name is one of the public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Kept results in two generations: when the younger is full the elder goes, and what is used again moves up."""

    def __init__(self, make_all, most: int):
        self.make_all, self.most = make_all, most
        self.young: dict = {}
        self.elder: dict = {}

    def __call__(self, key):
        value = self.young.get(key)
        return self.many([key])[0] if value is None else value

    def many(self, keys: list) -> list:
        """Results of distinct keys."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        absent = [k for k, v in enumerate(found) if v is None]
        wanted = [keys[k] for k in absent]
        old = list(map(self.elder.get, wanted))
        made = iter(self.make_all([k for k, v in zip(wanted, old, strict=True) if v is None]))
        old = [next(made) if v is None else v for v in old]
        if len(self.young) + len(wanted) > self.most:
            self.elder, self.young = self.young, {}
        self.young.update(zip(wanted, old, strict=True))
        for k, v in zip(absent, old, strict=True):
            found[k] = v
        return found


#: Pre-token patterns of the two kinds of vocabulary that can be taken apart.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name printable Latin-1 characters by themselves, the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BLANK_NAME = chr(256 + 32)


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def blank_free(words: pa.Array) -> list[str]:
    """The strings of an array, none of which holds a blank: much faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ") if len(words) else []


class CachedEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, most: int = STRETCHES):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.model = self.library.model
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = self._recognised()
        # A vocabulary that drops white space has stretches without their leading blank.
        self.blank = " " if self.kind == "byte" else ""
        split = _BYTE_SPLIT if self.kind == "byte" else _WORD_SPLIT
        self.split = regex.compile(split).findall
        self.split_ascii = re.compile(_ascii(split)).findall
        self.names = _byte_names()
        self.first = Memo(lambda some: [self._stretch(s) for s in some], 10_000)
        #: By stretch without its leading blank.
        self.rest = Memo(lambda some: [self._behind_blank(s) for s in some], most)

    def _recognised(self) -> str:
        """"byte" or "word" for the set-ups whose stretches are known to be independent, else ""."""
        conf = json.loads(self.library.to_str())
        model, before, split = conf["model"], conf["normalizer"], conf["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model["dropout"] or conf["truncation"] or conf["padding"]:
            return ""
        if before is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
            return "byte"
        steps = [x["type"] for x in (before or {}).get("normalizers", [])]
        parts = split.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern", {}).get("Regex") == _WORD_SPLIT and parts[0]["behavior"] == "Removed":
            return "word"
        return ""

    def _piece(self, piece: str) -> bytes:
        """A pre-token, not yet in byte names."""
        if piece.isascii() and (word := piece[1:] if piece[0] == " " else piece).isalnum():  # letters and digits name themselves
            named = word if word is piece else _BLANK_NAME + word
        else:
            named = piece.encode().decode("latin-1").translate(self.names)
        return self._ids(named)

    def _ids(self, named: str) -> bytes:
        return _little([t.id for t in self.model.tokenize(named)])

    def _word(self, letters: str) -> bytes:
        """A word of known letters, which is one pre-token."""
        if not self.blank:
            letters = letters.lower()
        if letters.isascii():
            return self._ids(_BLANK_NAME + letters if self.blank else letters)
        return self._ids((self.blank + letters).encode().decode("latin-1").translate(self.names))

    def _behind_blank(self, stretch: str) -> bytes:
        if stretch.isascii() or _LATIN.match(stretch):
            if stretch.isalpha():
                return self._word(stretch)
            if stretch[-1:] in _MARKS and stretch[:-1].isalpha():
                return self.rest(stretch[:-1]) + self._part(stretch[-1])
        return self._stretch(self.blank + stretch)

    def _part(self, piece: str) -> bytes:
        """A pre-token of a longer stretch: kept with the stretches if it would be the same by itself."""
        if not self.blank:
            return self.rest(piece)
        return self.rest(piece[1:]) if piece[0] == " " and len(piece) > 1 else self.first(piece)

    def _stretch(self, stretch: str) -> bytes:
        if stretch.isascii():
            parts = self.split_ascii(stretch if self.blank else stretch.lower())
        elif _LATIN.match(stretch):  # characters on whose case, class and form all Unicode versions agree
            parts = self.split(stretch if self.blank else stretch.lower())
        else:
            if self.normalizer is not None:
                stretch = self.normalizer.normalize_str(stretch)
            named = [p for p, _ in self.splitter.pre_tokenize_str(stretch)]
            return _little([t.id for p in named for t in self.model.tokenize(p)])
        if len(parts) == 1 and (parts[0] == stretch or not self.blank):
            return self._piece(parts[0])
        return b"".join(map(self._part, parts))

    def _whole(self, text: str) -> bool:
        """True if the library must see the text at once."""
        return not self.kind or any(s in text for s in self.special) or _CONTROL.search(text) is not None

    def encode(self, text: str) -> bytes:
        if self._whole(text):
            return _little(self.library.encode(text, add_special_tokens=False).ids)
        if self.blank and _ODD_BLANK.search(text):
            parts = _BEFORE_WORD.split(text)
        else:
            parts = text.split(" ")
        return self.first(parts[0]) + b"".join(map(self.rest, parts[1:]))

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id behind it, and the position where each text ends (nulls are empty)."""
        plain = texts.fill_null("")
        listed = plain.to_pylist()
        odd = [k for k, t in enumerate(listed) if self._whole(t) or (self.blank and _ODD_BLANK.search(t) is not None)]
        alone = [self.encode(listed[k]) for k in odd]
        if odd:
            simple = np.ones(len(listed), dtype=bool)
            simple[odd] = False
            plain = pc.if_else(pa.array(simple), plain, "")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(split.offsets.to_numpy())  # one stretch at least, even of an empty text
        known = self.rest.many(blank_free(coded.dictionary))
        starts = np.cumsum(n) - n
        if self.blank:
            firsts = [t.partition(" ")[0] for t in plain.to_pylist()]
            codes[starts] = len(known) + np.arange(len(firsts))
            known += list(map(self.first, firsts))
        if odd:
            codes[starts[odd]] = len(known) + np.arange(len(odd))
            known += alone
        # The end of a text is one more stretch.
        order = np.full(len(codes) + len(n), len(known), dtype=np.int64)
        order[np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)] = codes
        known.append(_little([end_id]))
        taken = pa.array(known, pa.large_binary()).take(pa.array(order))  # copies ids stretch by stretch
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=len(order) + 1)
        return np.frombuffer(data, dtype="<u4", count=int(offsets[-1]) // 4), offsets[np.cumsum(n + 1)] // 4


def _ascii(split: str) -> str:
    """The same pattern for ASCII texts in the faster matcher."""
    return split.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r" ?\p{L}+", " ?[A-Za-z]+").replace(r" ?\p{N}+", " ?[0-9]+").replace(r"\p{L}\p{N}", "A-Za-z0-9")


_LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*\\Z")
_MARKS = (".", ",", ":", ";", "!", "?")
_CONTROL = re.compile("[\x1c-\x1f]")
_ODD_BLANK = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r" (?=\S)")


def encoder(vocabulary: str, most: int = STRETCHES) -> CachedEncoder:
    """One per worker process, so that later tasks find the cache warm."""
    return resident(("tokenizers", vocabulary, most), lambda: CachedEncoder(vocabulary, most))
