"""Tokenizers inside tasks: a library tokenizer with a bounded cache of white-space chunks.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the pieces encode to the same ids as the
whole text. Each distinct piece goes through the library once per worker process; the rest are dictionary look-ups.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from tesserae.llm.common import CACHES, only_cache

#: Pieces that each generation of a worker's cache keeps: at some 200 bytes each, 160 MB for both.
CACHE_PIECES = 400_000
_LOADED: dict[tuple[str, bool], "Encoder"] = {}
_PIECES: dict[str, "PieceEncoder"] = {}


class _Filled(dict):
    """A dict that makes what it lacks. Of two generations, what was used since the last turn survives the next."""

    def __init__(self, make, most: int = CACHE_PIECES):
        self.make, self.old, self.most = make, {}, most

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self):
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(text) and count(text) of one tokenizer file of the tokenizers library; plain: special strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        self.mode = _mode(spec)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenizer.encode_special_tokens = plain
        self.special = re.compile("|".join(map(re.escape, added))) if added and not plain else None
        self.normalizer, self.pre, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.packed = [array(self.code, [k]).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        # Lower-cased words repeat more than pieces do, and both caches fill in that mode: half as many of each.
        most = CACHE_PIECES // 2 if self.mode == "words" else CACHE_PIECES
        self.cache = _Filled(self._led_piece if self.mode == "led" else self._piece, most)
        self.words = _Filled(self._ids_of, most)

    def _piece(self, piece: str) -> bytes:
        """One piece through the library: normaliser, pre-tokenizer, and the model for each word not met before."""
        if self.special and self.special.search(piece):
            return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.width).tobytes()
        out = []
        for word, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(piece) if self.normalizer else piece):
            out.append(self.words[word])
        return b"".join(out)

    def _led_piece(self, piece: str) -> bytes:
        """A piece that follows a space. Most are letters, perhaps with marks behind, perhaps with letters and marks of a next line."""
        if piece.isalpha():
            return self._ids_of(SPACE_BYTE + byte_letters(piece))
        found = LED.fullmatch(piece)
        if not found or self.special and self.special.search(piece):
            return self._piece(" " + piece)
        head, marks, word, more = found.groups()
        if not head.isalpha() or word and not word.isalpha():  # \w holds numbers that are not digits
            return self._piece(" " + piece)
        out = self.cache[head]
        if marks:
            out += self.words[marks]
        if word:
            out += self.words[NEW_LINE] + self.words[byte_letters(word)]
            if more:
                out += self.words[more]
        return out

    def _ids_of(self, word: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(word)])

    def _look_up(self, pieces: list[str]) -> bytes:
        """pieces without the space that leads them."""
        self.cache.trim()
        self.words.trim()
        return b"".join(map(self.cache.__getitem__, pieces))

    def encoded(self, text: str) -> bytes:
        """The text's ids, packed."""
        if self.mode == "words":  # white space never is part of a token
            return self._look_up(text.replace("\n", " ").split(" "))
        if self.mode == "led":  # a space before a visible character always starts a piece
            head, *rest = text.split(" ") if text[-1:] != " " and not SPACE_RUN.search(text) else VISIBLE_NEXT.split(text)
            return self._piece(head) + self._look_up(rest)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded(text), self.width)

    def count(self, text: str) -> int:
        return len(self.encoded(text)) // self.width.itemsize

    def entry_bytes(self) -> list[bytes]:
        """The bytes of every entry of a byte-level vocabulary."""
        shown = {chr(b): b for b in range(0x21, 0x7F)} | {c: b for b, c in _SHOWN.items()} | {chr(0x100 + b): b for b in range(0x21)} | {chr(0x121): 0x7F}
        return [bytes(shown[c] for c in self.tokenizer.id_to_token(k)) for k in range(self.tokenizer.get_vocab_size())]


class PieceEncoder:
    """ids(text) of a sentencepiece model, by cached runs of spaces and what follows them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.width = np.dtype("<u2") if len(self.pieces) < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        # Merges go past the front of a run of spaces only where a piece holds a space behind something else; what the
        # library's normaliser changes is seen on a text of such cases.
        odd = "  \u00e9 e\u0301 \ufb01 \u3000\u00a0 \t\n A "
        self.cut = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.pieces) and self.library.normalize(odd) == (" " + odd).replace(" ", SPACE_MARK)
        self.space = array(self.code, [self.library.piece_to_id(SPACE_MARK)]).tobytes()
        self.cache = _Filled(self._of)

    def _of(self, piece: str) -> bytes:
        """A piece without the space that leads it: the library adds one, but not to nothing."""
        return array(self.code, self.library.encode(piece)).tobytes() if piece else self.space

    def ids(self, text: str) -> np.ndarray:
        if not self.cut or not text:
            return np.asarray(self.library.encode(text), self.width)
        self.cache.trim()
        text = text.replace(SPACE_MARK, " ")  # the library tells them apart no more
        if "  " in text or text[0] == " ":
            pieces = [p[1:] for p in SPACED.findall(" " + text)]
        else:
            pieces = text.split(" ")
        return np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), self.width)

    def entry_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:-1], 16)]) if self.library.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(self.pieces)]


#: How sentencepiece writes a space; a run of spaces and what follows it.
SPACE_MARK, SPACED = "\u2581", re.compile(r" +[^ ]*")


#: How byte-level vocabularies write a space and a new line; letters, ASCII marks, and perhaps both once more on the next line.
SPACE_BYTE, NEW_LINE = "\u0120", "\u010a"
LED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)(?:\n([^\W\d_]+)([!-/:-@\[-`{-~]*))?")

#: A space that does not start a piece: before other white space or at the end.
SPACE_RUN, VISIBLE_NEXT = re.compile(r" [\s\x1c-\x1f]"), re.compile(r" (?=[^\s\x1c-\x1f])")


#: Byte-level vocabularies write the bytes of non-ASCII letters as these characters (all are printable or moved up by 256).
_SHOWN = {b: chr(b) if 0xA1 <= b <= 0xFF and b != 0xAD else chr(0x100 + (b - 0x7F + 0x21 if b != 0xAD else 0x43)) for b in range(0x80, 0x100)}


def byte_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)


def _mode(spec: dict) -> str:
    """How texts may be cut: "words", "led" or "whole", from what the tokenizer file says of itself."""
    added = [t["content"] for t in spec.get("added_tokens", [])]
    if any(c.isspace() for t in added for c in t) or any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return "whole"
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "led"
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers") or [{}]
    dropped = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in (parts[0].get("pattern") or {}).get("Regex", "")
    if dropped and steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("content") == " ":
        return "words"
    return "whole"


def encoder(path: str, plain: bool = False) -> Encoder:
    """One per worker process, file and kind."""
    only_cache("encoders")
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = Encoder(path, plain)
    return _LOADED[path, plain]


def piece_encoder(path: str) -> PieceEncoder:
    only_cache("encoders")
    if path not in _PIECES:
        _PIECES[path] = PieceEncoder(path)
    return _PIECES[path]


def _forget() -> None:
    _LOADED.clear()
    _PIECES.clear()


CACHES["encoders"] = _forget
