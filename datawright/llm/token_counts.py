"""Token counts without ids: dynamic programming on a trie of distinct pre-tokens.

Pre-tokens are the stretches of a text that no piece crosses. The distinct ones are inserted into a trie;
a node holds the forward state of its prefix (best last piece, score, tokens so far), computed once when the
node is made, from the states of its ancestors. The token count at a pre-token's end is stored there, and a text's
count is the sum over its pre-tokens. The trie is bounded: past ``most_nodes`` it starts anew, which costs time only.

Nulls and empty texts count 0. Counts equal the lengths of the library's encodings (see ``lattice``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .lattice import BPE, Vocabulary, loaded, stream
from .sentencepiece_codec import MODEL, model_bytes, parts

MOST_NODES = 400_000
#: A pre-token longer than this is counted by the streaming pass and not kept.
LONGEST = 256


class CountingTrie:
    def __init__(self, vocabulary: Vocabulary, most_nodes: int = MOST_NODES) -> None:
        self.v, self.most = vocabulary, most_nodes
        self.clear()

    def clear(self) -> None:
        self.terminal: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.last: list[int | None] = [None]
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def _cost(self, piece: int) -> int:
        return 1 if piece >= 0 else len(self.v.spelled(chr(-1 - piece)))

    def insert(self, token: str) -> int:
        """Tokens of a pre-token; new nodes get their state on the way."""
        v, last, score, tokens, child = self.v, self.last, self.score, self.tokens, self.child
        bpe, fits, known, pairs = v.kind == BPE, v.fits, v.chars, v._fits
        path, node, size = [0], 0, len(token)
        fresh, child_get = size, child.get
        for char in token:
            following = child_get(node << 21 | ord(char))
            if following is None:
                # From here on every node is new.
                fresh, made = len(path) - 1, len(last)
                for char in token[fresh:]:
                    child[node << 21 | ord(char)] = node = made
                    path.append(node)
                    made += 1
                new = size - fresh
                last += [None] * new
                tokens += [0] * new
                if not bpe:
                    score += [float("-inf")] * new
                break
            node = following
            path.append(node)
        plain = bpe and v.chars.issuperset(token)
        if plain:
            for end, (length, piece) in v.automaton.iter(token, max(0, fresh - v.longest + 1)) if fresh < len(token) else ():
                if end >= fresh and last[at := path[end + 1]] is None:
                    before = path[end + 1 - length]
                    if before:
                        fit = pairs.get(last[before] << 20 | piece)
                        if not (fits(last[before], piece) if fit is None else fit):
                            continue
                    last[at], tokens[at] = piece, tokens[before] + 1
            self.terminal[token] = tokens[node]
            return tokens[node]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(token) + 1)]
        if fresh < len(token):
            for end, found in v.automaton.iter(token, max(0, fresh - v.longest + 1)):
                ends[end + 1].append(found)
        for end in range(fresh + 1, len(token) + 1):
            at, char = path[end], token[end - 1]
            if char not in known:
                piece, before = -1 - ord(char), path[end - 1]
                last[at], tokens[at] = piece, tokens[before] + self._cost(piece)
                if not bpe:
                    score[at] = score[before] + v.worst
                continue
            for length, piece in ends[end]:
                before = path[end - length]
                if bpe:
                    if length == end or fits(last[before], piece):
                        last[at], tokens[at] = piece, tokens[before] + 1
                        break
                elif (worth := score[before] + v.scores[piece]) > score[at]:
                    last[at], score[at], tokens[at] = piece, worth, tokens[before] + 1
        self.terminal[token] = tokens[node]
        return tokens[node]

    def _long(self, token: str) -> int:
        return sum(self._cost(p) for part in stream(self.v, iter([token])) for p in part)

    def count(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        whole = self.v.normalised(text)
        if self.v.segments is None:
            return (1 if whole else 0), self._long(whole)
        found = self.v.segments.findall(whole)
        extra = 0
        for token in set(found).difference(self.terminal):
            if len(token) > LONGEST:
                extra += self._long(token) * found.count(token)
            else:
                self.insert(token)
        get = self.terminal.get
        total = sum(get(t, 0) for t in found) + extra
        if len(self.last) > self.most:
            self.clear()
        return len(found), total


def count_tokens(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """``keep`` columns with ``n_pretokens`` and ``n_tokens`` (long)."""
    data = model_bytes(model)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = loaded(CountingTrie, data)
        for batch in batches:
            for part, texts in parts(batch, len(keep)):
                found = [trie.count(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], [*keep, "n_pretokens", "n_tokens"])

    picked = docs.select(*keep, text_col)
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[: len(keep)]), "n_pretokens long", "n_tokens long"]))
