"""Public tokenizers over whole texts, with the tokenizers library and bounded caches of chunks and words.

A text is cut at places where its pre-tokenizer cuts it whatever stands around, each distinct piece is encoded once by
the library's model, and the ids of a text are joined from the cached pieces. Texts that have anything for which the
cut isn't proven (odd white space, characters beyond Latin, a special token spelled out) go to the library whole, with
the same ids.
"""

from __future__ import annotations

import json
import re
import string
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspire.llm.common import keeps

#: Entries of a worker's cache of pieces and of what is between spaces (some 140 bytes each: 90 MB); more are encoded again and again. Long ones are never kept.
WORDS, LONGEST = 650_000, 48


def vocabulary(name: str) -> str:
    """The file of a public vocabulary, which comes with the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = iter(range(256, 512))
    return [out.get(b) or chr(next(rest)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Model:
    """ids(word) as uint32 little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        spec, self.marks = file["model"], [t["content"].lower() for t in file["added_tokens"]]
        more = {k: spec[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix") if spec.get(k)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.model = BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **more)
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.words: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    def piece(self, w: str) -> bytes:
        """A piece that no cache holds. Printable ASCII but the space stands for itself in the byte-level alphabet."""
        letters = w.replace(" ", self.letters[32]) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(letters)])

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            got = self.piece(w)
            if len(w) <= LONGEST and len(self.words) + len(self.after) < WORDS:
                self.words[w] = got
        return got

    def chunk(self, c: str) -> bytes:
        """What stands between spaces. Letters alone, with the space before them or not, are one piece."""
        if c.isalpha() or c[:1] == " " and c[1:].isalpha():
            return self.word(c)
        got = b"".join(map(self.word, self._PIECES.findall(c)))
        if len(c) <= LONGEST and len(self.words) + len(self.after) < WORDS:
            self.words[c] = got
        return got

    def marked(self, text: str) -> bool:
        """Whether a text spells out a special token, which the library then takes as one."""
        return "<" in text and any(m in text.lower() for m in self.marks)

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _After(dict):
    """Ids of what stands after a space, by the text without it, so that a text's chunks are looked up in one go."""

    def __init__(self, model: ByteBpe):
        self.model = model

    def __missing__(self, c: str) -> bytes:
        m = self.model
        if c.isalpha():
            got = m.piece(" " + c)
        else:
            got = b"".join([self[p[1:]] if p[:1] == " " and p[1:].isalpha() else m.word(p) for p in m._PIECES.findall(" " + c)])
        if len(c) < LONGEST and len(self) + len(m.words) < WORDS:
            self[c] = got
        return got


class ByteBpe(_Model):
    """byte_bpe_50k.json. A space before something that isn't white space starts a piece, so texts are cut there."""

    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?[^\sA-Za-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
    #: Latin letters, ASCII and a few signs; the superscripts and fractions are numbers to the library and not to re.
    _PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ–—‘-”…€]*")
    _RUN = re.compile(r" \s")
    #: What _PLAIN lacks or _RUN finds, for Arrow.
    _ODD = " [\t\n\r ]|[^" + _PLAIN.pattern[1:-2] + "]"

    def __init__(self, path: str):
        super().__init__(path)
        self.after = _After(self)

    def ids(self, text: str) -> bytes:
        if self._RUN.search(text) or not self._PLAIN.fullmatch(text) or self.marked(text):
            return self.slow(text)
        first, *rest = text.split(" ")
        return (self.words.get(first) or self.chunk(first)) + b"".join(map(self.after.__getitem__, rest))

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids() of each of many texts (null: empty), as arrays of uint32. Arrow cuts them at spaces, so that what repeats among them is looked up once."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, self._ODD))
        if pc.any(pc.match_substring(texts, "<")).as_py():
            plain = pc.and_(plain, pa.array([not self.marked(t) for t in texts.to_pylist()]))
        flat, ends = self._joined(pc.if_else(plain, texts, ""))
        for i, easy in enumerate(plain.to_pylist()):
            yield flat[ends[i] : ends[i + 1]] if easy else np.frombuffer(self.slow(texts[i].as_py()), "<u4")

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts one after the other, and where each text's begin and end."""
        cut = pc.split_pattern(texts, " ")
        starts, parts = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        firsts, kinds, known = starts[:-1], parts.indices.to_numpy().copy(), self.after.get
        first = [self.spaceless(c) for c in cut.values.take(pa.array(firsts)).to_pylist()]
        ids = [known(c) or self.spaced(c) for c in parts.dictionary.to_numpy(zero_copy_only=False).tolist()]
        kinds[firsts] = np.arange(len(ids), len(ids) + len(first))  # a text's first has no space before it
        joined = pa.array(ids + first, pa.large_binary()).take(pa.array(kinds))
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, "<i8", len(joined) + 1)[starts] // 4
        return np.frombuffer(data or b"", "<u4", ends[-1]), ends

    def spaceless(self, c: str) -> bytes:
        return self.words.get(c) or self._words(c, self.word) or self.chunk(c)

    def spaced(self, c: str) -> bytes:
        """What stands after a space. Words are kept and what is made of them is not, so that more words find room."""
        return self._words(c, self.after.__getitem__) or b"".join(map(self.word, self._PIECES.findall(" " + c)))

    def _words(self, c: str, look: Callable[[str], bytes]) -> bytes:
        """A word, with signs after it (a piece of their own) or without, or some parted by single line ends; of anything else nothing."""
        w = c.rstrip(string.punctuation)
        if w.isalpha():
            return look(w) + self.word(c[len(w) :]) if len(w) < len(c) else look(w)
        if "\n" not in c:
            return b""
        first, *rest = c.split("\n")
        lines = [self._words(first, look), *[self._words(x, self.word) for x in rest]]
        return self.word("\n").join(lines) if all(lines) else b""


class WordBpe(_Model):
    """word_bpe_49k.json: lower case, white space dropped; pieces never cross it."""

    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ]+")
    _PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-įı-ɏ–—‘-”…€]*")

    def ids(self, text: str) -> bytes:
        if not self._PLAIN.fullmatch(text) or self.marked(text):
            return self.slow(text)
        get, chunk = self.words.get, self.chunk
        return b"".join([get(c) or chunk(c) for c in text.lower().split()])


_LOADED: dict[tuple, Callable] = {}


def encoder(kind: type, path: str):
    """One for each worker process, until an operator without tokenizers runs there."""
    keeps("fasttok", _LOADED.clear)
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
