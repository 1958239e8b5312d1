"""Exact whole-text encoding with the tokenizers library, one library call for each distinct word a worker meets.

Text is cut only where the tokenizer itself always cuts, so joining the ids of the parts gives the ids of the whole:

* ``drop`` tokenizers (white space separates words and yields no token): at ASCII white space;
* ``attach`` tokenizers (a space belongs to the word after it): before single spaces and around single newlines;
  texts with runs of white space go to the library whole;
* any other tokenizer: nowhere.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words a worker keeps in each of two generations; when the newer is full it becomes the older, which bounds memory
#: and keeps frequent words. A generation is also full when its long words, of LONG bytes and more, take LONG_BYTES.
CACHE_WORDS = 350_000
LONG, LONG_BYTES = 64, 32 << 20
#: Starts of the UTF-8 forms of white space beyond ASCII.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: Latin letters, then ASCII punctuation that starts no contraction or special token: such a word is two pre-tokens, in composed form already.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,./:;=>?@\[\\\]^_`{}~-]*)")
_MARKS = frozenset(bytes([c]) for c in b'!"#$%&()*+,./:;=>?@[\\]^_`{}~-')
_LOADED: dict[str, "Encoder"] = {}


class _Words(dict):
    """word -> its ids as little-endian bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self._encode, self._limit, self._older, self._long = encode, limit, {}, 0

    def __missing__(self, word):
        found = self._older.get(word)
        if found is None:
            found = self._encode(word)
        if len(word) >= LONG:
            self._long += len(word) + len(found)
        if len(self) >= self._limit or self._long > LONG_BYTES:
            self._older, self._long = dict(self), 0
            self.clear()
        self[word] = found
        return found


def _single(words: list, text) -> bool:
    """Whether single blanks part the words, and none stands at an end."""
    return sum(map(len, words)) + len(words) - 1 == len(text)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def kind_of(spec: dict) -> str:
    pre, rest = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and rest is None:
        return "attach"
    first, *others = pre.get("pretokenizers") or [{}]
    steps = [x.get("type") for x in (rest or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in others] == ["ByteLevel"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in json.dumps(first.get("pattern")).replace("\\\\", "\\"):
        return "drop"
    return "whole"


class Encoder:
    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind_of(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.letters, self.lower = self.tokenizer.model, byte_letters(), self.kind == "drop"
        self.space = chr(self.letters[0x20])
        self.marks = _Words(self.pretoken, limit)
        self.plain = _Words(lambda w: self.word(w, self.plain), limit)
        self.spaced = _Words(self.after_blank, limit)
        self.newline = self.whole("\n") if self.kind == "attach" else b""

    def pretoken(self, part: bytes) -> bytes:
        """ids of one pre-token, with the space before it if it has one."""
        if part.isascii():
            mapped = self.space + part[1:].decode() if part[:1] == b" " else part.decode()
        else:
            mapped = part.decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def word(self, word: bytes, table: dict[bytes, bytes], before: bytes = b"") -> bytes:
        """ids of a word; simple ones skip the library's normalizer and pre-tokenizer, which would not change them.

        A name with a mark after it is looked up as the name in the same table, and so is its lower-cased form.
        """
        name, mark = word[:-1], word[-1:]
        if word.isalpha():  # ASCII letters, as these are bytes
            name, mark = word, b""
        elif not (name.isalpha() and mark in _MARKS):
            text = word.decode("utf-8", "replace")
            simple = _SIMPLE.fullmatch(text)
            if not simple:
                return self.whole(before.decode() + text)
            name, mark = simple[1].encode(), simple[2].encode()
            if not name:
                return self.pretoken(before + word) if before + word else b""
        if mark:
            return table[name] + self.marks[mark]
        if self.lower:
            low = name.lower() if name.isascii() else name.decode().lower().encode()
            if low != name:
                return table[low]
        return self.pretoken(before + name)

    def whole(self, text: str | bytes) -> bytes:
        if isinstance(text, bytes):
            text = text.decode("utf-8", "replace")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        """ids of a whole text in UTF-8, as little-endian bytes."""
        if self.kind == "drop":
            return b"".join(map(self.plain.__getitem__, text.split()))
        if self.kind == "whole":
            return self.whole(text)
        words = text.split()
        if not words or not _single(words, text) or any(x in text for x in self.special):
            return self.whole(text)
        if any(x in text for x in _WIDE):
            s = text.decode("utf-8", "replace")
            if not _single(s.split(), s):
                return self.whole(text)
        if text.count(b" ") != len(words) - 1:
            words = text.replace(b"\n", b" \n").split(b" ")
        rest = iter(words)
        return b"".join((self.plain[next(rest)], *map(self.spaced.__getitem__, rest)))

    def after_blank(self, word: bytes) -> bytes:
        """ids of a word with the blank before it: a line feed where it starts with one, else a space."""
        return self.newline + self.plain[word[1:]] if word[:1] == b"\n" else self.word(word, self.spaced, b" ")


def encoder(path: str, limit: int = CACHE_WORDS) -> Encoder:
    """One per worker process and tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, limit)
    return _LOADED[path]


def id_type(path: str) -> np.dtype:
    return encoder(path).dtype


def encoded(docs: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text", also: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(key, ids): every whole text's ids, with end_id at the end, as little-endian binary of id_type(path) width.

    also names a further column that is kept. A null text counts as empty. Rows are neither dropped nor merged, so
    repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache_words)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for part in batches:
            columns, names = [part.column(0), pa.array([enc.encode(t or b"") + end for t in part.column(1).to_pylist()], pa.binary())], ["k", "ids"]
            if also:
                columns, names = [*columns, part.column(2)], [*names, also]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = lambda c: docs.schema[c].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), *([also] if also else []))
    return rows.mapInArrow(run, f"k {kind(key)}, ids binary" + (f", {also} {kind(also)}" if also else "")).withColumnRenamed("k", key)
