"""Token ids of whole texts with the tokenizers library, each distinct chunk encoded once.

A vocabulary's splitter cuts a text before any merge. Where white space is sure
to be such a border, the ids of a text are the ids of its chunks, joined, and a
chunk seen before needs no second encoding: a bounded cache maps it to its ids
as bytes. New chunks are cut once more at sure borders (a line end, signs after
letters); plain words go straight to the library's model, the rest through its
whole pipeline. Texts in which a border is not sure (chunks that are empty or
begin or end with white space, the string of a special token) are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

#: Bytes, roughly, of the chunks that a worker remembers with and without glue; it starts anew beyond that.
CACHE = 512 << 20
#: What an entry costs besides its text and ids.
ENTRY = 220
#: Longer chunks are encoded but not kept.
LONG = 64
_SIGNS = ".,!?;:*%&$#|"
_ODD = tuple("\x1c\x1d\x1e\x1f\x85")
#: Letters up to where combining marks and odd cases begin: their words are their own normal form.
_LATIN = re.compile("[A-Za-z\u00c0-\u012f]+").fullmatch
_BEYOND = re.compile("[^\x00-\u012f]").search


def _byte_level() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_level()


@dataclass(frozen=True)
class Borders:
    """Where a vocabulary's texts can be cut.

    glue: what stands before each chunk but the first, as the text has it; mark:
    the same as the model has it; head: does glue stand before the first too?
    words: are chunks cut to words first (else the model takes any chunk whole)?
    blank: is all white space dropped, and the text lower-cased?
    """

    glue: str = " "
    mark: str = "\u0120"
    head: bool = False
    words: bool = True
    blank: bool = False


#: Byte-level pairs that keep white space; pairs of lower-cased words; metaspace pieces.
SPACED, WORDS, PIECES = Borders(), Borders("", "", False, True, True), Borders("\u2581", "\u2581", True, False, False)


def _word(c: str) -> bool:
    """A run of letters that every splitter takes as one word and no normaliser changes."""
    return c.isalpha() and (c.isascii() or _LATIN(c) is not None)


def _gaps(found: list) -> list[int]:
    """Places of None."""
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class ChunkEncoder:
    """encode(texts) -> one bytes of little-endian unsigned 32-bit ids per text, as Tokenizer.encode gives them."""

    def __init__(self, tokenizer, borders: Borders = SPACED, room: int = CACHE):
        self.tokenizer, self.model, self.borders, self.room = tokenizer, tokenizer.model, borders, room
        added = tokenizer.get_added_tokens_decoder().values()
        self.specials = [a.content for a in added]
        self.probe = re.match("[^A-Za-z]*", os.path.commonprefix(self.specials))[0]  # no case changes it
        self.unsure = any(a.normalized for a in added)  # such a token may stand for strings that look otherwise
        if borders.blank:
            self.specials = [s.lower() for s in self.specials]
        self.held = [0, 0]  # bytes in first, rest
        self.first: dict[str, bytes | bool] = {}  # chunks with nothing before them
        self.rest: dict[str, bytes | bool] = {}  # chunks with glue before them
        self.line = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _direct(self, chunks: list[str], mark: str) -> list[bytes]:
        """Ids of chunks that the model takes as they are; pieces go through the library's threads."""
        if self.borders.words:
            merge = self.model.tokenize
            return [array("I", [t.id for t in merge(mark + (c if c.isascii() else c.encode().decode("latin-1").translate(_BYTES)))]).tobytes() for c in chunks]
        return self._whole([mark + c for c in chunks])

    def _cut(self, chunk: str) -> list[str] | None:
        """Pieces of a chunk that is no word: '' stands for a line end; None where its borders are not sure."""
        out = []
        for k, piece in enumerate((chunk,) if self.borders.blank else chunk.split("\n")):
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            if k:
                out.append("")
            stem = piece.rstrip(_SIGNS)
            if stem and len(stem) < len(piece) and _word(stem):
                out += [stem, piece[len(stem) :]]
            else:
                out.append(piece)
        return out

    def _learn(self, chunks: set[str], glued: bool) -> dict:
        """A view of the cache with all of chunks; False marks a chunk whose text must be encoded whole."""
        b, cache, bare = self.borders, self.rest if glued else self.first, self.first
        glue, mark = (b.glue, b.mark) if glued else ("", "")
        new = [c for c in chunks if c not in cache]
        if not new:
            return cache
        cost = ENTRY * len(new) + 5 * sum(map(len, new))
        self.held[glued] += cost
        if self.held[glued] > self.room:
            kept = {c: cache[c] for c in chunks if c in cache}
            cache.clear()
            cache.update(kept)
            self.held[glued] = cost + ENTRY * len(kept) + 5 * sum(map(len, kept))
        long: dict[str, bytes | bool] = {}

        short = max(map(len, new)) <= LONG

        def put(into: dict, found) -> None:
            if short:
                into.update(found)
                return
            for c, ids in found:
                if len(c) <= LONG:
                    into[c] = ids
                else:
                    long[c] = ids

        if not b.words:
            good = [c for c in new if c]
            put(cache, zip(good, self._direct(good, mark)))
            put(cache, ((c, False) for c in new if not c))
            return _Over(cache, long) if long else cache
        good, cuts = [], []
        for c in new:
            if c.isalpha() and (c.isascii() or _LATIN(c)):
                good.append(c)
            else:
                cuts.append((c, self._cut(c)))
        stems, others, tails = set(), set(), set()
        for _, cut in cuts:
            if cut:
                if cut[0] not in cache:
                    (stems if _word(cut[0]) else others).add(cut[0])
                tails.update(t for t in cut[1:] if t not in bare)
        stems.difference_update(good)
        own = dict(zip(stems, self._direct(list(stems), mark)))
        own |= zip(others, self._whole([glue + c for c in others]))
        ends = {"": self.line}
        plain = [t for t in tails if t and _word(t)]
        ends |= zip(plain, self._direct(plain, ""))
        signs = [t for t in tails if t and t not in ends]
        ends |= zip(signs, self._whole(signs))
        put(cache, zip(good, self._direct(good, mark)))
        joined = []
        for c, cut in cuts:
            if cut is None:
                joined.append((c, False))
            else:
                head = own[cut[0]] if cut[0] in own else long[cut[0]] if cut[0] in long else cache[cut[0]]
                joined.append((c, head + b"".join([ends[t] if t in ends else bare[t] for t in cut[1:]])))
        put(cache, ((c, own[c]) for c in stems))
        put(cache, joined)
        if self.held[0] < self.room // 4:
            kept = [(t, x) for t, x in ends.items() if t and len(t) <= LONG]
            self.held[0] += ENTRY * len(kept) + 5 * sum(len(t) for t, _ in kept)
            bare.update(kept)
        return _Over(cache, long) if long else cache

    def _marked(self, text: str) -> bool:
        """May the text hold a special string, or something that lower-casing makes one?"""
        if self.unsure or not self.specials or self.probe not in text:
            return self.unsure
        text = text.lower() if self.borders.blank else text
        return any(s in text for s in self.specials)

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [k for k, t in enumerate(texts) if self._marked(t)]
        if not marked:
            return self._chunked(texts)
        out = dict(zip(marked, self._whole([texts[k] for k in marked])))
        plain = [k for k in range(len(texts)) if k not in out]
        out |= zip(plain, self._chunked([texts[k] for k in plain]))
        return [out[k] for k in range(len(texts))]

    def _chunked(self, texts: list[str]) -> list[bytes]:
        b = self.borders
        heads: list[bytes | None | bool] = [b""] * len(texts)
        if b.blank:
            parts = [t.lower().split() if t.isascii() or not _BEYOND(t) else [c if _BEYOND(c) else c.lower() for c in t.split()] for t in texts]
        else:
            parts = [t.split(" ") for t in texts]
            if not b.head:
                known = self._learn({p[0] for p in parts}, False)
                heads = [known[p[0]] for p in parts]
                parts = [p[1:] for p in parts]
        get = self.rest.get
        found = [list(map(get, p)) for p in parts]
        gaps = [_gaps(v) for v in found]
        known = self._learn({p[i] for p, g in zip(parts, gaps) for i in g}, True)
        for v, p, g in zip(found, parts, gaps):
            for i in g:
                v[i] = known[p[i]]
        out: list[bytes | None] = []
        whole = []
        for k, ids in enumerate(found):
            try:
                if b.blank and any(c in texts[k] for c in _ODD):
                    raise TypeError
                out.append(heads[k] + b"".join(ids))
            except TypeError:  # a False: white space at a chunk's end
                out.append(None)
                whole.append(k)
        for k, ids in zip(whole, self._whole([(b.glue if b.head else "") + texts[k] for k in whole])):
            out[k] = ids
        return out


class _Over(dict):
    """The cache with the long chunks of one batch laid over it."""

    def __init__(self, under: dict, over: dict):
        super().__init__(over)
        self.under = under

    def __missing__(self, key):
        return self.under[key]


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file as the library gives it: the string of a special token in a text is that token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def chunk_encoder(path: str, borders: Borders, room: int = CACHE) -> ChunkEncoder:
    """One encoder, and so one cache, for each Python worker; another vocabulary takes its place."""
    return ChunkEncoder(load(path), borders, room)


def batches_of(texts: list, size: int = 1_000_000):
    """Slices (begin, end) of about size characters each, one text at least."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def default_path(name: str) -> str:
    """Where the public vocabulary file lies, resolved on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
