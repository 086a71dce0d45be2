"""Byte-pair encoding of many texts at once: pre-tokens, distinct words, ranked merges.

A block of texts is cut into words on arrays of code points, its distinct words
are looked up in a bounded cache, and the merges of the unknown ones are folded
in rank order over matrices of symbols, all words of one length together.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata

import numpy as np

from . import arrays as A

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
NONE = np.int32(2**31 - 1)
CACHE_WORDS = 300_000
#: Words of more symbols are merged one by one with a heap.
MATRIX_SYMBOLS = 48
#: Unicode's White_Space (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = BLANK
        _classes.append(table)
    return _classes[0]


def word_spans(block: A.Block, *, blanks: bool, digits_alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words of a block, and their bounds by text.

    Words are runs of letters, of numbers, or of other signs, and the
    contractions 's 't 're 've 'm 'll 'd.  With ``blanks`` a space before a word
    belongs to it and the rest of the white space makes words of its own;
    otherwise white space is dropped.  With ``digits_alone`` each number sign
    is a word.
    """
    data = block.data
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    m = len(code)
    if not m:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(block) + 1, np.int64)
    if m != len(at):
        raise ValueError("a text isn't valid UTF-8")
    firsts = np.searchsorted(at, block.offsets)  # code point at which each text starts
    kind = classes()[code]
    cut = np.empty(m + 1, bool)
    cut[1:m] = kind[1:] != kind[:-1]
    cut[0] = cut[m] = True
    cut[firsts] = True
    if digits_alone:
        cut[:m] |= kind == NUMBER
    runs = np.flatnonzero(cut)
    s, e = runs[:-1], runs[1:]
    ends_text = np.zeros(m + 1, bool)
    ends_text[firsts] = True
    if blanks:
        w = (kind[s] == BLANK) & ~ends_text[e]
        cut[e[w] - 1] = True
        cut[e[w & (code[e - 1] == 0x20)]] = False
    # contractions
    quote = (e - s == 1) & (code[s] == 0x27)
    quote = s[quote & ~ends_text[e]]
    quote = quote[cut[quote]]
    if len(quote):
        pad = np.r_[code, np.zeros(3, np.uint32)]
        second, third = pad[quote + 1], pad[quote + 2]
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))
        two &= ~ends_text[np.minimum(quote + 2, m)]
        cut[quote[one | two] + 1] = False
        cut[np.minimum(quote[one] + 2, m)] = True
        cut[np.minimum(quote[two] + 3, m)] = True
    runs = np.flatnonzero(cut)
    s, e = runs[:-1], runs[1:]
    if not blanks:
        word = kind[s] != BLANK
        s, e = s[word], e[word]
    bytes_at = np.r_[at, len(data)]
    return bytes_at[s], bytes_at[e], np.searchsorted(s, firsts)


class Merges:
    """Adjacent pair of ids -> rank and the id it becomes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, becomes: np.ndarray) -> None:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(10, int(len(key) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.becomes = np.zeros(int(rank.max()) + 1 if len(rank) else 1, np.int32)
        self.becomes[rank] = becomes
        home = self._home(key)
        todo = np.arange(len(key))
        step = 0
        while len(todo):
            slot = (home[todo] + step) & self.mask
            free = self.keys[slot] == np.uint64(2**64 - 1)
            # the first of those that want a free slot gets it
            _, won = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = won[free[won]]
            self.keys[slot[won]], self.rank[slot[won]] = key[todo[won]], rank[todo[won]]
            todo = np.delete(todo, won)
            step += 1
        self.steps = step

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(key)
        got = self.keys[slot]
        out = np.where(got == key, self.rank[slot], NONE)
        left_over = np.flatnonzero((got != key) & (got != np.uint64(2**64 - 1)))
        for step in range(1, self.steps):
            if not len(left_over):
                break
            at = (slot.flat[left_over] + step) & self.mask
            got = self.keys[at]
            hit = got == key.flat[left_over]
            out.flat[left_over[hit]] = self.rank[at[hit]]
            left_over = left_over[~hit & (got != np.uint64(2**64 - 1))]
        return out

    def fold(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Folds the merges over words of equal length (one a row), lowest rank
        first and leftmost at ties: (rows, their ids) by final length."""
        done, rows = [], np.arange(len(ids))
        ranks = self.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            n = ids.shape[1]
            if n == 1:
                done.append((rows, ids))
                break
            j = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), j]
            go = best != NONE
            if not go.all():
                done.append((rows[~go], ids[~go]))
                rows, ids, ranks, j, best = rows[go], ids[go], ranks[go], j[go], best[go]
                if not len(ids):
                    break
            every, col = np.arange(len(ids)), np.arange(n - 1)
            ids = np.take_along_axis(ids, col + (col > j[:, None]), 1)
            ids[every, j] = self.becomes[best]
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= j[:, None]), 1)
            k = every[j > 0]
            ranks[k, j[k] - 1] = self.find(ids[k, j[k] - 1], ids[k, j[k]])
            k = every[j < n - 2]
            ranks[k, j[k]] = self.find(ids[k, j[k]], ids[k, j[k] + 1])
        return done

    def fold_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a heap and links to neighbours."""
        a = np.asarray(ids, np.int32)
        first = self.find(a[:-1], a[1:])
        heap = [(int(first[i]), i, int(a[i]), int(a[i + 1])) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids, after, before = list(map(int, ids)), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive = [True] * len(ids)

        def push(i: int, k: int) -> None:
            r = int(self.find(np.array([ids[i]]), np.array([ids[k]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[k]))

        while heap:
            r, i, x, y = heapq.heappop(heap)
            k = after[i] if alive[i] else len(ids)
            if k >= len(ids) or ids[i] != x or ids[k] != y:
                continue
            ids[i], alive[k] = int(self.becomes[r]), False
            after[i] = after[k]
            if after[i] < len(ids):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x, ok in zip(ids, alive) if ok]


class Vocabulary:
    """Symbols of bytes, merges, and a bounded cache of encoded words."""

    def __init__(self, merges: Merges, symbol: np.ndarray, last_symbol: np.ndarray) -> None:
        self.merges, self.symbol, self.last_symbol = merges, symbol, last_symbol
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.offsets, self.lengths, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        hashes = A.SpanHash(data)(starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = hashes[first].tolist()
        if len(self.known) > CACHE_WORDS:
            self.clear()
        index = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(index < 0)
        if len(new):
            flat, lengths = self._fresh(data, starts[first[new]], ends[first[new]])
            n, base = len(self.known), self.used
            self.lengths = _room(self.lengths, n + len(new))
            self.offsets = _room(self.offsets, n + len(new))
            self.flat = _room(self.flat, base + len(flat))
            self.lengths[n : n + len(new)] = lengths
            self.offsets[n : n + len(new)] = base + np.cumsum(lengths) - lengths
            self.flat[base : base + len(flat)] = flat
            self.used += len(flat)
            index[new] = np.arange(n, n + len(new))
            self.known.update(zip((keys[i] for i in new.tolist()), range(n, n + len(new))))
        lengths = self.lengths[index][which]
        return self.flat[spread(self.offsets[index][which], lengths)], lengths

    def _fresh(self, data, starts, ends):
        size = ends - starts
        lengths, made = np.zeros(len(starts), np.int64), []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > MATRIX_SYMBOLS:
                for r in rows.tolist():
                    ids = self.symbol[data[starts[r] : ends[r]]]
                    ids[-1] = self.last_symbol[data[ends[r] - 1]]
                    ids = np.array([self.merges.fold_long(ids)], np.int32)
                    made.append((np.array([r]), ids))
                continue
            raw = data[starts[rows][:, None] + np.arange(n)]
            ids = self.symbol[raw]
            ids[:, -1] = self.last_symbol[raw[:, -1]]
            made += [(rows[k], got) for k, got in self.merges.fold(ids)]
        for rows, ids in made:
            lengths[rows] = ids.shape[1]
        at = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for rows, ids in made:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lengths


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def spread(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``offsets[i] .. offsets[i] + lengths[i]`` one after another."""
    total = np.cumsum(lengths)
    return np.repeat(offsets - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)


# ---------------------------------------------------------------- vocabularies

def rank_file(lines: bytes) -> tuple[Vocabulary, list[bytes]]:
    """A vocabulary of base64 tokens and ranks: any two neighbours merge whose
    bytes together are a token, lowest rank first."""
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines()) if t}
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = np.array(rows, np.int64).T
    symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    pieces = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        pieces[r] = t
    return Vocabulary(Merges(left, right, rank, rank), symbol, symbol), pieces


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte:
    visible Latin-1 signs stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_file(text: str) -> Vocabulary:
    """A vocabulary of a JSON file with merges and a suffix for the ends of words."""
    model = json.loads(text)["model"]
    ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
    left, right, becomes = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).T
    letters = byte_letters()
    return Vocabulary(Merges(left, right, np.arange(len(pairs)), becomes), np.array([ids[x] for x in letters], np.int32), np.array([ids[x + end] for x in letters], np.int32))
