"""SentencePiece encoding and decoding by suffix-array matching.

The pre-tokens of a batch that are not yet known are concatenated and indexed by a suffix array (up to
the longest piece); every piece of the vocabulary is found by binary search as a range of suffixes; the
ranges become edges (start, end, piece), sorted by position (for short words into a table by start and length),
and relaxed: for a BPE model the best-ranked edge over two adjacent symbols is contracted until none is left,
for a unigram model the best path is taken over the edges.  What no edge covers falls back to bytes or to <unk>.

Pieces never join text before a space to the space (checked when the model is read), so words are independent and each
distinct word is matched once in a worker, whose memory of words is bounded in bytes.  A word of more than `HUGE` characters is
indexed in blocks; of its edges one bit for each place and length stays, and contractions of one score are made at once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words over LONG are contracted one by one, shorter ones side by side; words over HUGE are indexed in blocks.
LONG, HUGE = 48, 20_000
#: Bytes of remembered words in each of two generations, and characters that are indexed at once, in a worker.
MEMORY, BATCH_CHARS = 32 << 20, 1 << 16
#: Bytes of text that reach a worker at once, by the session's setting; a batch's texts, words and ids are all held together.
BATCH_BYTES = 4 << 20
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(message: bytes) -> dict[int, list]:
    """The fields of a protocol-buffer message: numbers, or bytes of nested messages and strings."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        v = shift = 0
        while True:
            b = message[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while at < len(message):
        tag = number()
        kind = tag & 7
        n = {0: 0, 1: 8, 5: 4}.get(kind)
        if n is None:
            n = number()
        out.setdefault(tag >> 3, []).append(number() if kind == 0 else message[at : at + n])
        at += n
    return out


class Vocabulary:
    """What of a model the matcher needs; read from a SentencePiece file or given."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], special: set[int], unk: int, kind: str):
        self.unk, self.kind, self.special, self.bytes = unk, kind, special, bytes_
        self.pieces, self.scores = pieces, np.array(scores)
        self.ids = np.array([i for i in range(len(pieces)) if i not in special and i not in bytes_.values() and pieces[i]], dtype=np.int64)
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.longest = max((len(pieces[i]) for i in self.ids), default=1)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in (pieces[i] for i in self.ids))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        with open(path, "rb") as f:
            model = fields(f.read())
        trainer, normalizer = (fields(b"".join(model.get(k, []))) for k in (2, 3))  # of repeated fields the last counts
        kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, [1])[-1])  # numbers of the public model format
        plain = not normalizer.get(2, [b""])[-1] and normalizer.get(3, [1])[-1] and not normalizer.get(4, [1])[-1] and normalizer.get(5, [1])[-1]
        if not kind or not plain or trainer.get(24, [0])[-1]:
            raise ValueError(f"{path}: only BPE and unigram models are read that keep text as it is but for one space before it and U+2581 for spaces")
        return cls(pieces, [sp.get_score(i) for i in range(n)], bytes_, special, sp.unk_id(), kind)


class Matcher:
    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY, batch_chars: int = BATCH_CHARS):
        self.v, self.most, self.batch = vocabulary, memory, batch_chars
        # word without its first SPACE -> int32 ids as bytes; words of the older generation move over when they are met
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0
        codes = sorted({c for i in vocabulary.ids for c in vocabulary.pieces[i]})
        self.symbol = np.zeros(0x110000, np.uint16)  # by code point; 0: a character in no piece
        self.symbol[[ord(c) for c in codes]] = np.arange(1, len(codes) + 1)
        width = vocabulary.longest
        table = np.zeros((len(vocabulary.ids), width), np.uint16)
        self.length = np.array([len(vocabulary.pieces[i]) for i in vocabulary.ids])
        for row, i in enumerate(vocabulary.ids):
            p = vocabulary.pieces[i]
            table[row, : len(p)] = [self.symbol[ord(c)] for c in p]
        self.plain = ["" if i in vocabulary.special else p for i, p in enumerate(vocabulary.pieces)]
        for b, i in vocabulary.bytes.items():
            self.plain[i] = chr(b)
        self.plain[vocabulary.unk] = " ⁇ "
        self.high_bytes = {i for b, i in vocabulary.bytes.items() if b > 127}
        low = self.keys(table)
        self.by_key = np.argsort(low)
        self.sorted_keys, self.table = low[self.by_key], table[self.by_key]
        self.rank = np.unique(vocabulary.scores, return_inverse=True)[1].astype(np.int32)

    @staticmethod
    def keys(symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols as byte strings of the same order, without zero bytes (which numpy drops at the end)."""
        two = np.empty((*symbols.shape, 2), np.uint8)
        two[..., 0], two[..., 1] = symbols // 255 + 1, symbols % 255 + 1
        n = symbols.shape[1] * 2
        return np.ascontiguousarray(two).reshape(len(symbols), n).view(f"S{n}").ravel()

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces occur in a text of symbols: starts and indices into the vocabulary's ids."""
        width, n = self.v.longest, len(symbols)
        present = np.flatnonzero(np.bincount(symbols, minlength=2)[1:]) + 1
        code = np.zeros(1 << 16, np.uint8 if len(present) < 256 else np.uint16)  # in the same order; 0: in no piece
        code[present] = np.arange(1, len(present) + 1)
        bits = len(present).bit_length() or 1
        each = min(64 // bits, width)  # symbols in one number
        needles = code[self.table]
        rows = np.flatnonzero((needles > 0).sum(1) == self.length[self.by_key])  # pieces of symbols of this text
        needles, length = needles[rows], self.length[self.by_key[rows]]
        padded = np.concatenate([code[symbols], np.zeros(each, code.dtype)])

        # suffix array up to `width` symbols by prefix doubling: of each level sorted numbers and their ranks
        levels, step = [], each
        pair = np.zeros(n, np.uint64)
        for k in range(each):
            pair = pair << np.uint64(bits) | padded[k : k + n]
        while True:
            order = np.argsort(pair)
            ordered = pair[order]
            bounds = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()]) if n else np.zeros(0, np.int64)
            levels.append((ordered, bounds))
            if step >= width:
                break
            rank = np.empty(n, np.int64)
            rank[order] = bounds
            pair = rank * (n + 1)
            pair[: max(n - step, 0)] += rank[step:] + 1
            step *= 2

        first, last = self.ranges(levels, each, bits, needles, length)
        found = last - first
        hit = np.flatnonzero(found > 0)
        which = np.repeat(self.by_key[rows[hit]], found[hit])
        within = np.arange(len(which)) - np.repeat(found[hit].cumsum() - found[hit], found[hit])
        return order[np.repeat(first[hit], found[hit]) + within], which

    def ranges(self, levels: list, each: int, bits: int, s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where suffixes that begin with the first k symbols of the rows of s lie in the order of the last level.  (A method, as a
        recursive closure would keep the levels until the garbage collector comes.)"""
        ordered = levels[-1][0]
        if len(levels) == 1:
            low = np.zeros(len(s), np.uint64)
            for c in range(each):
                low = low << np.uint64(bits) | (s[:, c] if c < s.shape[1] else np.uint64(0))
            rest = np.uint64(bits) * (each - k).astype(np.uint64)
            high = low | np.where(rest < 64, (np.uint64(1) << np.minimum(rest, np.uint64(63))) - np.uint64(1), np.uint64(0))
            return np.searchsorted(ordered, low, side="left"), np.searchsorted(ordered, high, side="right")
        half, below = each << (len(levels) - 2), levels[:-1]
        first, last = self.ranges(below, each, bits, s[:, :half], np.minimum(k, half))
        more = np.flatnonzero((k > half) & (last > first))
        last[k > half] = first[k > half]
        if len(more):
            inner = below[-1][1]
            a, b = self.ranges(below, each, bits, s[more, half:], k[more] - half)
            there = b > a
            more, a, b = more[there], a[there], b[there]
            head = inner[first[more]] * (len(ordered) + 1) + 1
            first[more] = np.searchsorted(ordered, head + inner[a], side="left")
            last[more] = np.searchsorted(ordered, head + inner[b - 1], side="right")
        return first, last

    def edges(self, words: list[str], ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The concatenated words' edges, sorted by (start, length) if ordered: starts, lengths, piece ids; and the words' starts."""
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate([[0], lengths.cumsum()])
        end = np.repeat(starts[1:], lengths)
        at, which = self.occurrences(self.symbols("".join(words)))
        inside = at + self.length[which] <= end[at]  # a piece does not reach into the next word
        at, which = at[inside], which[inside]
        if ordered:
            by = np.argsort(at * (self.v.longest + 1) + self.length[which])
            at, which = at[by], which[by]
        return at, self.length[which], self.v.ids[which], starts

    def encode_words(self, words: list[str]) -> None:
        """Adds the ids of new words to the memory."""
        if self.v.kind != "bpe":
            return self.remember(words, [np.array(i, np.int32).tobytes() for i in self.relax_unigram(words, *self.edges(words))])
        short = sorted((w for w in words if len(w) <= LONG), key=len, reverse=True)
        if short:
            self.remember(short, self.relax_bpe(short, *self.edges(short, ordered=False)))
        middle = []
        for w in words:
            if len(w) > HUGE and (ids := self.relax_bpe_huge(w)) is not None:
                self.remember([w], [ids.tobytes()])
            elif len(w) > LONG:
                middle.append(w)
        for part in portions(middle, self.batch):
            at, length, piece, starts = self.edges(part)
            cuts = np.searchsorted(at, starts).tolist()
            for w, base, a, b in zip(part, starts.tolist(), cuts, cuts[1:], strict=False):
                self.remember([w], [np.array(self.relax_bpe_long(w, at[a:b] - base, length[a:b], piece[a:b]), np.int32).tobytes()])

    def remember(self, words: list[str], packed: list[bytes]) -> None:
        self.memo.update(zip([w[1:] for w in words], packed, strict=True))
        self.used += 200 * len(words) + 2 * sum(map(len, words)) + sum(map(len, packed))

    def relax_bpe_huge(self, word: str) -> np.ndarray | None:
        """The ids of a word that is too long for lists: all contractions of the best score at once, leftmost first where
        they overlap.  None if a contraction opens one of no lower score (not so with ranks of merges)."""
        n, width, ids = len(word), self.v.longest, self.v.ids
        symbols = self.symbols(word)
        lengths = np.zeros(n, np.uint32)  # bit k: a piece of k symbols begins here
        for a in range(0, n, self.batch):
            at, which = self.occurrences(symbols[a : a + self.batch + width])
            mine = at < self.batch
            np.bitwise_or.at(lengths, a + at[mine], np.uint32(1) << self.length[which[mine]].astype(np.uint32))
        padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([symbols, np.zeros(width, np.uint16)]), width)

        def pieces(s: np.ndarray, k: np.ndarray) -> np.ndarray:
            """Ids of the pieces of k symbols at s, -1 where there is none."""
            out = np.full(len(s), -1, np.int32)
            for a in range(0, len(s), self.batch):
                there = a + np.flatnonzero((k[a : a + self.batch] <= width) & (lengths[s[a : a + self.batch]] >> np.minimum(k[a : a + self.batch], 31).astype(np.uint32) & 1 > 0))
                rows = np.where(np.arange(width) < k[there][:, None], padded[s[there]], 0)
                out[there] = ids[self.by_key[np.searchsorted(self.sorted_keys, self.keys(rows))]]
            return out

        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)

        def gain(s: np.ndarray) -> np.ndarray:
            """Rank of the score of contracting the symbol at s with the next one, -1 if nothing covers both."""
            out = np.full(len(s), -1, np.int32)
            ok = np.flatnonzero(right[s] < n)
            p = pieces(s[ok], right[right[s[ok]]] - s[ok])
            out[ok] = np.where(p >= 0, self.rank[p], -1)
            return out

        open_ = np.concatenate([gain(np.arange(a, min(a + self.batch, n))) for a in range(0, n, self.batch)])
        while len(open_) and (best := int(open_.max())) >= 0:
            s = np.flatnonzero(open_ == best)
            chained = np.concatenate([[False], right[s[:-1]] == s[1:]])
            place = np.arange(len(s))
            s = s[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            mid = right[s]
            end = right[mid]
            right[s] = end
            open_[mid] = -1
            left[end[end < n]] = s[end < n]
            again = np.unique(np.concatenate([s, left[s][left[s] >= 0]]))
            open_[again] = gain(again)
            if (open_[again] >= best).any() and self.opens_better(s, left, open_, best):
                return None
        starts, at = [], 0
        step = right.tolist() if n <= 1 << 16 else right
        out = bytearray()
        while at < n:
            starts.append(at)
            at = int(step[at])
            if len(starts) == self.batch or at >= n:
                s = np.array(starts, np.int64)
                got = pieces(s, right[s] - s)
                if (got < 0).any():
                    for i, v in zip(starts, got.tolist(), strict=True):
                        out += np.array([v] if v >= 0 else self.fallback(word[i]), np.int32).tobytes()
                else:
                    out += got.tobytes()
                starts = []
        return np.frombuffer(bytes(out), np.int32)

    @staticmethod
    def opens_better(s: np.ndarray, left: np.ndarray, open_: np.ndarray, best: int) -> bool:
        """Whether a symbol just made, or the one before it, has a contraction of at least that rank."""
        before = left[s]
        return bool((open_[s] >= best).any() or (open_[before[before >= 0]] > best).any())

    def relax_bpe_long(self, word: str, at, length, piece) -> list[int]:
        """One long word: its contractions wait in a heap, best score first, leftmost among equals."""
        n, scores = len(word), self.v.scores
        edge = {(int(a), int(a + k)): int(p) for a, k, p in zip(at, length, piece, strict=True)}
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[edge[i, i + 2]], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in edge]
        heapq.heapify(heap)

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (a, right[b]) in edge:
                heapq.heappush(heap, (-scores[edge[a, right[b]]], a, b, right[b]))

        alive = [True] * n
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if alive[a] and right[a] == b and alive[b] and right[b] == e:
                right[a], alive[b] = e, False
                if e < n:
                    left[e] = a
                offer(a)
                if left[a] >= 0:
                    offer(left[a])
        ids, a = [], 0
        while a < n:
            e = right[a]
            ids += [edge[a, e]] if (a, e) in edge else self.fallback(word[a:e])
            a = e
        return ids

    def fallback(self, char: str) -> list[int]:
        if self.v.bytes:
            return [self.v.bytes[b] for b in char.encode()]
        return [self.v.unk]

    def relax_bpe(self, words, at, length, piece, starts) -> list[bytes]:
        """Words side by side, the longest first: in each round every word contracts its best edge, the leftmost among equals."""
        n, span = int(starts[-1]), self.v.longest + 1
        sizes = np.diff(starts)
        most = int(sizes[0])
        key = at * span + length
        pieces = np.full(n * span, -1, np.int32)
        pieces[key] = piece
        worth = np.full(n * span, -1, np.int32 if len(self.rank) * most < 1 << 31 else np.int64)  # rank of the score, then place in the word from the right
        worth[key] = self.rank[piece] * np.int64(most) + (np.repeat(starts[:-1] + most - 1, sizes) - np.arange(n))[at]
        right = np.arange(1, n + 2)  # end of the symbol that begins here
        right[n] = n + span  # behind the text nothing fits
        left = np.arange(-1, n)  # start of the symbol before it
        left[0] = 0

        def value(s: np.ndarray) -> np.ndarray:
            """Worth of contracting the symbol at s with the next one; -1 if no edge covers both (none crosses words)."""
            k = right[right[s]] - s
            k[k >= span] = 0
            return worth[s * span + k]

        final = np.ones(n, bool)  # where a symbol begins
        full = value(np.arange(n))
        for done in range(1, most):
            active = int(np.searchsorted(-sizes, -done))  # words of more symbols than rounds done
            best = np.maximum.reduceat(full[: int(starts[active])], starts[:active])
            w = np.flatnonzero(best >= 0)
            if not len(w):
                break
            s = starts[w] + (most - 1 - best[w] % most)
            mid = right[s]
            e = right[mid]
            right[s] = e
            left[e] = s
            full[mid] = -1
            final[mid] = False
            full[s] = value(s)
            before = left[s]
            full[before] = value(before)
        # one lookup for all final symbols
        f = np.flatnonzero(final)
        got = pieces[f * span + (right[f] - f)]
        bounds = np.searchsorted(f, starts).tolist()
        packed = got.tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        none = f[got < 0]
        for i in np.unique(np.searchsorted(starts, none, side="right") - 1).tolist():  # characters in no piece
            a, b = bounds[i], bounds[i + 1]
            own = [x for j, v in zip(f[a:b].tolist(), got[a:b].tolist(), strict=True) for x in ([v] if v >= 0 else self.fallback(words[i][j - int(starts[i])]))]
            out[i] = np.array(own, np.int32).tobytes()
        return out

    def relax_unigram(self, words, at, length, piece, starts) -> list[list[int]]:
        """Best path by dynamic programming over the sorted edges; an uncovered character costs the least score less 10."""
        bad = float(self.v.scores[self.v.ids].min(initial=0.0)) - 10.0
        edge = np.searchsorted(at, np.arange(int(starts[-1]) + 1))
        out = []
        for i, w in enumerate(words):
            base, n = int(starts[i]), len(w)
            best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
            for j in range(n):
                if best[j] + bad > best[j + 1]:
                    best[j + 1], back[j + 1] = best[j] + bad, (j, -1)
                for x in range(int(edge[base + j]), int(edge[base + j + 1])):
                    t, s = j + int(length[x]), best[j] + float(self.v.scores[piece[x]])
                    if s > best[t]:
                        best[t], back[t] = s, (j, int(piece[x]))
            parts, j = [], n
            while j:
                s, p = back[j]
                parts.append([p] if p >= 0 else self.fallback(w[s:j]))
                j = s
            out.append([i for p in reversed(parts) for i in p])
        return out

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a text, each without the SPACE it begins with."""
        if not text:
            return []
        if not self.v.by_word:
            return [text.replace(" ", SPACE)]
        parts = text.split(" ")
        if "" in parts or SPACE in text:  # runs of spaces
            parts = [p[1:] for p in PRETOKEN.findall(SPACE + text.replace(" ", SPACE))]
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts; null and empty texts have none."""
        if self.used > self.most:
            self.old, self.memo, self.used = self.memo, {}, 0
        split = [self.words(t) for t in texts]
        memo, old, block, size = self.memo, self.old, [], 0
        for w in [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in memo]:
            if (known := old.get(w)) is not None:
                memo[w] = known
                self.used += 200 + 2 * len(w) + len(known)
                continue
            block.append(SPACE + w)
            size += len(w) + 1
            if size >= self.batch:
                self.encode_words(block)
                block, size = [], 0
        if block:
            self.encode_words(block)
        return [np.frombuffer(b"".join(map(memo.__getitem__, parts)), np.int32) for parts in split]

    def decode(self, ids) -> str:
        """The text of ids: runs of byte pieces are UTF-8, spaces are restored, the first one is dropped."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if self.high_bytes.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
        else:
            out: list[str] = []
            run = bytearray()
            for i in ids:
                b = self.v.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.plain[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        return (text[1:] if text.startswith(SPACE) else text).replace(SPACE, " ")


def portions(texts: list[str | None], most_chars: int) -> Iterator[list[str | None]]:
    """The texts in runs of at most so many characters (one text at least)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most_chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


_matchers: dict[str, Matcher] = {}


def matcher(path: str) -> Matcher:
    """One for each model and process."""
    if path not in _matchers:
        _matchers[path] = Matcher(Vocabulary.read(path))
    return _matchers[path]


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES (never raise them).  The setting counts when the result is computed, so it stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """docs plus the array of ids; with check_col also whether decoding the ids gives the text back.

    Null and empty texts get an empty array.  Texts are encoded whole.  A literal U+2581 in a text is
    encoded like a space, as the model cannot tell them apart, and so is not given back.  Columns of the results' names
    are replaced.  The model file is read on each executor.  The session's Arrow batches are bounded by BATCH_BYTES from here on.
    """
    bounded_batches(docs)
    docs = docs.drop(ids_col, *([check_col] if check_col else []))

    @F.pandas_udf("ids array<int>, same boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = matcher(model)
        for s in parts:
            rows, same = [], []
            for texts in portions([t if isinstance(t, str) else None for t in s], 8 * BATCH_CHARS):
                ids = m.encode(texts)
                rows += ids
                same += [m.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)] if check_col else [None] * len(ids)
            yield pd.DataFrame({"ids": rows, "same": same})

    out = docs.withColumn("__enc", run(text_col))
    out = out.withColumn(ids_col, F.col("__enc.ids"))
    if check_col:
        out = out.withColumn(check_col, F.col("__enc.same"))
    return out.drop("__enc")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded plus the text of its ids; null ids give null.  Arrow batches are bounded as by encode."""
    bounded_batches(encoded)
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(model)
        for s in parts:
            yield pd.Series([None if x is None else m.decode(list(x)) for x in s], dtype=object)

    return encoded.withColumn(text_col, run(ids_col))
