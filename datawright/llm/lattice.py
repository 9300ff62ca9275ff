"""Piece lattice of a SentencePiece model: vocabulary, Viterbi steps and streaming commits.

A model's pieces span a lattice over the characters of the normalised text. In a *unigram* model a path's
worth is the sum of its scores. In a *BPE* model exactly one path is the tokenizer's: the one of which
each two neighbouring pieces are what BPE itself makes of their joint text; then each prefix of the text has
one last piece, and the same forward pass with back pointers finds it (transitions that BPE would not
make count as impossible). Taking the best score sum on a BPE vocabulary would give other ids than the tokenizer's.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of a text that are read at a time.
CHUNK = 65_536
#: A unigram model's unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message: varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        length = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + length]
        at += length


class Vocabulary:
    """Pieces of a model whose normaliser is the identity."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix = UNIGRAM, False, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only the identity normaliser with escaped white space is supported")
        if self.kind not in (UNIGRAM, BPE) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.longest = max(map(len, self.ids))
        self.chars = {p for p in self.ids if len(p) == 1}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes_of = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self._fits: dict[int, bool] = {}
        self.segments = self._segmenter()
        #: Finds (end, (length, piece)) of the pieces in a text; in a BPE model only of those that BPE makes one piece of.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.kind == UNIGRAM or len(p) == 1 or self.merged(p) == [i]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def _segmenter(self) -> re.Pattern[str] | None:
        """Pattern of stretches that no piece crosses, or None if pieces hold the space mark after other characters.

        Besides the space mark, characters that stand alone in every piece are stretches of their own, and an ASCII mark
        begins one after a Latin letter if no piece has it there.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        together = {c for p in self.ids if len(p) > 1 for c in p}
        alone = {chr(c) for c in range(128)} - together
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.match(f"[{LETTERS}]", a)}
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - alone - after_letter
        one, mark = ("".join(re.escape(c) for c in sorted(cs)) for cs in (alone, marks))
        other = f"[^{SPACE}{one}{LETTERS}]"
        more = f"(?:[^{SPACE}{one}{LETTERS}{mark}]{other}*[{LETTERS}]*)*"
        return re.compile(f"{SPACE}*(?:{other}+[{LETTERS}]*|[{LETTERS}]+){more}|{SPACE}+" + (f"|[{one}]" if one else ""))

    def normalised(self, text: str) -> str:
        return ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def continued(self, text: str) -> str:
        return text.replace(" ", SPACE)

    def spelled(self, char: str) -> tuple[int, ...]:
        """Ids of a character without a piece."""
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_fallback else (self.unknown,)

    def merged(self, text: str) -> list[int]:
        """BPE by its definition, on a short text: merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1 - ord(p[0])) for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces as they are when they meet. Negative ids are characters without a piece."""
        if left < 0 or right < 0:
            return True
        key = left << 20 | right
        if (found := self._fits.get(key)) is None:
            if len(self._fits) > 600_000:
                self._fits.clear()
            found = self._fits[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return found


class Path:
    """Forward state of a growing text: for each boundary its best last piece, that piece's start, and the score so far.

    Boundaries count from ``self.text``'s begin; ``before`` is the last committed piece, or None at the text's begin.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text, self.before = "", None
        self.last: list[int | None] = [None]
        self.start: list[int] = [0]
        self.score: list[float] = [0.0]

    def grow(self, text: str) -> None:
        v, old = self.v, len(self.text)
        self.text = whole = self.text + text
        last, start, score, before, known = self.last, self.start, self.score, self.before, v.ids
        bpe, fits, scores = v.kind == BPE, v.fits, v.scores
        for i in range(old, len(whole)):
            char = whole[i]
            last.append(None if char in known else -1 - ord(char))
            start.append(i)
            score.append(float("-inf"))
        at = old  # unknown characters up to here have their score
        for end, (length, piece) in v.automaton.iter(whole, max(0, old - v.longest + 1)):
            end += 1
            begin = end - length
            if end <= old:
                continue
            if bpe:
                if last[end] is None:
                    left = last[begin] if begin else before
                    if left is None or fits(left, piece):
                        last[end], start[end] = piece, begin
                continue
            for i in range(at, end - 1):
                if last[i + 1] is not None and last[i + 1] < 0:
                    score[i + 1] = score[i] + v.worst
            at = end - 1
            worth = score[begin] + scores[piece]
            if worth > score[end]:
                last[end], start[end], score[end] = piece, begin, worth
        if not bpe:
            for i in range(at, len(whole)):
                if last[i + 1] < 0:
                    score[i + 1] = score[i] + v.worst

    def pieces(self, end: int) -> list[int]:
        """Pieces of the best path to a boundary."""
        found = []
        while end:
            found.append(self.last[end])
            end = self.start[end]
        return found[::-1]

    def settled(self) -> int:
        """The last boundary that the paths to all boundaries from which a later piece can start share."""
        end = len(self.text)
        alive = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.discard(far)
            alive.add(self.start[far])
        return alive.pop()

    def commit(self, boundary: int) -> list[int]:
        """Pieces up to the boundary, which are final; the window then begins there."""
        found = self.pieces(boundary)
        if found:
            self.before = found[-1]
            base = self.score[boundary]
            self.text = self.text[boundary:]
            self.last, self.start = self.last[boundary:], [max(0, s - boundary) for s in self.start[boundary:]]
            self.score = [s - base for s in self.score[boundary:]]
        return found


def stream(vocabulary: Vocabulary, chunks: Iterator[str]) -> Iterator[list[int]]:
    """Streaming Viterbi over normalised text: committed pieces, negative ones for characters without a piece.

    What is kept is the window of the longest piece and the stretch on which paths still differ.
    """
    path, step = Path(vocabulary), 4 * vocabulary.longest
    for chunk in chunks:
        for at in range(0, len(chunk), step):
            path.grow(chunk[at : at + step])
            if found := path.commit(path.settled()):
                yield found
    if found := path.commit(len(path.text)):
        yield found


class Encoder:
    """Encodes and decodes texts; short stretches between certain boundaries are remembered, in bounded memory.

    A text is read in chunks of ``CHUNK`` characters; what is held of it is one chunk and the stretch that it cuts. At a boundary that no piece crosses
    all surviving paths meet, so the ids before it are committed. Stretches of over ``short`` characters take the windowed pass of ``stream``; shorter ones
    fit into its window whole and are remembered.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = 60_000, short: int = 64) -> None:
        self.v, self.remembered, self.short = vocabulary, remembered, short
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _spell(self, pieces: list[int]) -> list[int]:
        if not pieces or min(pieces) >= 0:
            return pieces
        return [i for p in pieces for i in ((p,) if p >= 0 else self.v.spelled(chr(-1 - p)))]

    def segment(self, text: str) -> tuple[int, ...]:
        if len(text) > self.short:
            return tuple(i for part in stream(self.v, iter([text])) for i in self._spell(part))
        if (found := self.old.get(text)) is None and self.v.kind == BPE:
            found = self._bpe(text)
        elif found is None:
            path = Path(self.v)
            path.grow(text)
            found = tuple(self._spell(path.pieces(len(text))))
        if len(self.young) >= self.remembered:
            self.old, self.young = self.young, {}
        self.young[text] = found
        return found

    def _bpe(self, text: str) -> tuple[int, ...]:
        """The same pass as ``Path.grow`` for a whole short text: the first fitting piece at each end is the only one."""
        known, fits, size = self.v._fits, self.v.fits, len(text)
        last: list[int | None] = [None] * (size + 1)
        width = [1] * (size + 1)
        for end, (length, piece) in self.v.automaton.iter(text):
            end += 1
            if last[end] is None:
                # No last piece before this one: the text's begin or a character without a piece.
                if (left := last[end - length]) is not None:
                    fit = known.get(left << 20 | piece)
                    if not (fits(left, piece) if fit is None else fit):
                        continue
                last[end], width[end] = piece, length
        found: list[int] = []
        while size:
            if (piece := last[size]) is None:
                found += self.v.spelled(text[size - 1])[::-1]
            else:
                found.append(piece)
            size -= width[size]
        return tuple(found[::-1])

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encode_stream(text[a : a + CHUNK] for a in range(0, len(text), CHUNK)) for i in part]

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in chunks, as they become final: the boundary before the last stretch of what has come is one that all paths share."""
        v, window = self.v, ""
        whole = (v.continued(c) if k else v.normalised(c) for k, c in enumerate(c for c in chunks if c))
        if v.segments is None:
            yield from map(self._spell, stream(v, whole))
            return
        for chunk in whole:
            found = v.segments.findall(window + chunk)
            # The last stretch may go on in the next chunk.
            window = found.pop()
            yield self._known(found)
        if window:
            yield self._known([window])

    def _known(self, stretches: list[str]) -> list[int]:
        ids: list[int] = []
        extend, segment, young = ids.extend, self.segment, self.young.get
        for s in stretches:
            found = young(s)
            if found is None:
                found = segment(s)
                young = self.young.get
            extend(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


_loaded: dict[tuple[str, bytes], object] = {}


def loaded(make: type, model: bytes):
    """One ``make(Vocabulary(model))`` for each process."""
    key = (make.__name__, hashlib.sha256(model).digest())
    if key not in _loaded:
        _loaded[key] = make(Vocabulary(model))
    return _loaded[key]
