"""Exact SentencePiece (merge type) encoding by backtracking, and decoding.

The text is cut where no merge can reach across: before a run of spaces, at characters without a piece and before
marks that stand in no piece after a letter (all three read from the model's pieces), so equal parts are encoded once
for each worker. A part is encoded from longest matches of an Aho-Corasick
automaton: take the longest piece that ends the walk, check that it stands next to the previous piece, which the recorded
merges at the edges of the two tell, else try the next shorter one, and mark positions from which no way leads on in a bitfield so that none is
tried twice. Characters without a piece split the part; they become their UTF-8 bytes.

Runs of spaces have pieces of equal score, for which the neighbour check alone doesn't decide; parts that begin with
more than one space are merged by priority queue instead, as the definition says.

Nulls and edges: null text is the empty text, which has no ids; very long texts are cut as above; ids may be null or
repeat; other columns are neither read nor returned. A task keeps at most `CACHE` parts of `CACHED_CHARS` characters
(those not met again while half as many new ones came go first) and `PAIRS` checked neighbours; its worker, which Spark uses again for other stages, keeps the vocabulary alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, tidy

SPACE = "▁"
CACHE, PAIRS, CACHED_CHARS, NONE = 200_000, 60_000, 64, float("-inf")


class Codec:
    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[str | int] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.surface.append("" if model.is_control(i) else piece.replace(SPACE, " "))
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface[i] = int(piece[1:-1], 16)
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ "
            elif not model.is_control(i):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
        self.chars = {p for p in self.ids if len(p) == 1}
        # A piece that merging doesn't reach can't be in a result, so the automaton leaves it out.
        reached = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            if len(p) > 1:  # a character's own piece needs no search
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.shorter = self._shorter(set(reached))
        self.number = {p: str(self.ids[p]) for p in reached}
        self.cut = self._cutter()
        self.pair: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.first: dict[str, list] = {}
        self.last: dict[str, list] = {}

    def clear(self) -> None:
        self.pair.clear()
        self.cache.clear()
        self.older.clear()

    @staticmethod
    def _shorter(words: set[str]) -> dict[str, str]:
        """The next shorter piece that begins each piece."""
        out = {}
        for w in words:
            for k in range(len(w) - 1, 0, -1):
                if w[:k] in words:
                    out[w] = w[:k]
                    break
        return out

    def _cutter(self) -> re.Pattern[str]:
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile("(?s).+")
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        after = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if a != SPACE}
        while wrong := {b for a, b in after if b in marks and a not in marks}:
            marks -= wrong
        none = "" if "\n" in self.chars else "\n"
        m, stop = "".join(map(re.escape, sorted(marks))), f" {none}"
        word = f"[^{stop}{m}]+"
        tail = f"[{m}][^{stop}]*" if m else word
        return re.compile(f" +(?:{word}|{tail})?|{word}|{tail}" + ("|\n" if none else ""))

    def merge(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair whose union has the highest score, leftmost first, until none has one."""
        if len(text) > 64:
            return self.merge_long(text)
        sym, score = list(text), self.scores.get
        found = [score(a + b, NONE) for a, b in zip(sym, sym[1:])]
        while found and (most := max(found)) > NONE:
            i = found.index(most)
            sym[i] += sym.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = score(sym[i] + sym[i + 1], NONE)
            if i:
                found[i - 1] = score(sym[i - 1] + sym[i], NONE)
        return sym

    def merge_long(self, text: str) -> list[str]:
        """The same by priority queue, for parts whose quadratic cost would show."""
        sym = list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (s := self.scores.get(both := sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not sym[i] or not sym[j] or right[i] != j or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in sym if x]

    def edges(self, piece: str) -> None:
        """Record the symbols that begin and end a piece while its characters are merged: self.first and self.last have
        the symbol at first, the score at which it is merged on, the next symbol and so on, and NONE at the end.

        A merge that waits for others of lower score counts with the lowest, as it comes no sooner.
        """
        sym, lowest = list(piece), float("inf")
        first, last = [sym[0]], [sym[-1]]
        while len(sym) > 1:
            found = [self.scores.get(a + b, NONE) for a, b in zip(sym, sym[1:])]
            i = found.index(most := max(found))
            lowest = min(lowest, most)
            sym[i] += sym.pop(i + 1)
            if i == 0:
                first += [lowest, sym[0]]
            if i == len(sym) - 1:
                last += [lowest, sym[-1]]
        self.first[piece], self.last[piece] = [*first, NONE], [*last, NONE]

    def stands(self, a: str, b: str) -> bool:
        """Whether merging a's and b's characters again gives just a and b: no merge across comes first at any time.

        Of equal scores the leftmost merge comes first: one in a, then that across, then one in b.
        """
        if a not in self.last:
            self.edges(a)
        if b not in self.first:
            self.edges(b)
        left, right, score, i, j = self.last[a], self.first[b], self.scores.get, 0, 0
        while True:
            x, y = left[i + 1], right[j + 1]
            if (s := score(left[i] + right[j])) is not None and s > x and s >= y:
                ok = False
                break
            if x == y == NONE:
                ok = True
                break
            if x >= y:
                i += 2
            else:
                j += 2
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        self.pair[a, b] = ok
        return ok

    def backtrack(self, text: str) -> list[str]:
        """Encode characters that all have pieces of their own."""
        # Matches come in order of their ends, so the longest that begins at a position comes last.
        best = {end - k: p for end, (k, p) in self.automaton.iter(text)}.get
        n, pair, shorter = len(text), self.pair, self.shorter
        failed = 0  # bit i: no way leads on from position i
        out: list[str] = []
        at, token, last = 0, best(0) or text[0], ""
        while True:
            end = at + len(token)
            if not (failed and failed >> end & 1) and (not last or ((ok := pair.get((last, token))) is None and self.stands(last, token)) or ok):
                out.append(token)
                if end == n:
                    return out
                last, at, token = token, end, best(end) or text[end]
                continue
            while (less := shorter.get(token)) is None:  # nothing else fits here
                failed |= 1 << at
                if not out:
                    return self.merge(text)
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""
            token = less

    def part(self, text: str) -> list[int]:
        text = text.replace(" ", SPACE)
        if self.chars.issuperset(text):
            return [self.ids[p] for p in self._pieces(text)]
        out: list[int] = []
        begin = 0
        for i, c in enumerate(text):
            if c not in self.chars:
                out += [self.ids[p] for p in self._pieces(text[begin:i])] if begin < i else []
                out += [self.byte_ids[b] for b in c.encode()]
                begin = i + 1
        return out + ([self.ids[p] for p in self._pieces(text[begin:])] if begin < len(text) else [])

    def _pieces(self, text: str) -> list[str]:
        return self.merge(text) if text.startswith(SPACE * 2) else self.backtrack(text)

    def parts(self, text: str) -> list[str]:
        """With plain spaces, which makes most of them strings of one byte a character."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.part(p)]

    def _bytes(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, one for each byte."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:  # some are bytes
            pass
        out: list[str] = []
        k, n = 0, len(ids)
        while k < n:
            s = self.surface[ids[k]]
            if isinstance(s, str):
                out.append(s)
                k += 1
                continue
            e = k
            while e < n and isinstance(self.surface[ids[e]], int):
                e += 1
            raw = bytes(self.surface[i] for i in ids[k:e])
            while raw:
                for w in (1, 2, 3, 4):
                    try:
                        out.append(raw[:w].decode())
                        raw = raw[w:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    raw = raw[1:]
            k = e
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._bytes(ids)
        first = next((i for i in ids if self.surface[i] != ""), None)
        return text[1:] if first is not None and isinstance(self.surface[first], str) and text.startswith(" ") else text

    def known(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded) of one part that isn't in the younger half of the cache."""
        if (got := self.cache.get(text) or self.older.get(text)) is None:
            if self.chars.issuperset(marked := text.replace(" ", SPACE)):
                found = self._pieces(marked)
                joined, plain = ",".join([self.number[p] for p in found]), "".join(found).replace(SPACE, " ")
            else:
                ids = self.part(text)
                joined, plain = ",".join(map(str, ids)), self._bytes(ids)
            got = joined, text if plain == text else plain  # the same string is held once
        if len(text) <= CACHED_CHARS:
            if len(self.cache) >= CACHE // 2:
                self.cache, self.older = {}, self.cache
            self.cache[text] = got
        return got

    def both(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, how many, decoded text) of a whole text."""
        found = list(map(self.cache.get, parts := self.parts(text)))
        if None in found:
            found = [x or self.known(p) for x, p in zip(found, parts, strict=True)]
        if not found:
            return "", 0, ""
        joined, decoded = zip(*found, strict=True)
        ids, plain = ",".join(joined), "".join(decoded)
        return ids, ids.count(",") + 1, plain[1:] if plain.startswith(" ") else plain


@functools.cache
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded: each whole text's ids and what they decode to."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        c.clear()
        for b in pieces(batches, "t"):
            ids = [c.encode(t or "") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], ["i", "ids", "decoded"])

    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, ids array<int>, decoded string").withColumnRenamed("i", id_col)


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: the same by digest, for checks that needn't keep the ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        c.clear()
        for b in pieces(batches, "t"):
            n, a, d = [], [], []
            for t in b.column("t").to_pylist():
                joined, count, plain = c.both(t or "")
                n.append(count)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                d.append(hashlib.sha256(plain.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["i", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.clear()

    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("i", id_col)
