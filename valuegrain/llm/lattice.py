"""Segmentations of marked words over a fixed public subword vocabulary.

A word is marked with U+2581 in front, and pieces never cross words. Distinct words are sorted,
so that neighbours share prefixes, and a depth-first walk of that implicit trie keeps the scores
of the common prefix and computes only the rest. The three walks below differ in what a
position holds: the best score (Viterbi), the sum over all segmentations, or both directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import exp, log

import numpy as np

MARK = "▁"
#: Stands for a mark that occurs in a text itself; no vocabulary has a lone surrogate.
OWN_MARK = "\ud800"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids, the ids of the 256 byte pieces, and log weights by rank."""

    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    #: Natural logs of the pieces' weights, all negative; ``suffixes`` has 1.0 for suffixes of pieces that are none.
    log_weight: dict[str, float]
    byte_log_weight: float
    suffixes: dict[str, float]
    #: Pairs of characters inside pieces; between any other two characters every segmentation has a boundary.
    pairs: frozenset[str]
    size: int

    def text_of(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}


def load(path: str = MODEL) -> Vocabulary:
    """Read a sentencepiece model. Its scores are ranks: a piece of rank r weighs 1 / (r + 1), all weights sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = tuple(i for i in range(n) if model.is_byte(i))
    usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): i for i in usable}
    ids = {p: i for p, i in pieces.items() if MARK not in p[1:]}
    ranks = {p: -model.get_score(i) for p, i in ids.items()}
    last = max(ranks.values())
    total = log(sum(1 / (r + 1) for r in ranks.values()) + len(byte_ids) / (last + 1))
    weight = {p: -log(r + 1) - total for p, r in ranks.items()}
    return Vocabulary(ids, byte_ids, weight, -log(last + 1) - total, with_suffixes(weight, 1.0), frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1)), n)


def with_suffixes(weight: dict, none):
    """Add every suffix of every piece; those that are no piece get ``none``. A walk back from a position stops where no piece can end."""
    out = {p[i:]: none for p in weight for i in range(1, len(p))}
    out.update(weight)
    return out


def marked(words: Iterable[str]) -> list[str]:
    return [MARK + w.replace(MARK, OWN_MARK) for w in words]


def bytes_of(char: str) -> bytes:
    return (MARK if char == OWN_MARK else char).encode("utf-8", "surrogatepass")


def shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def best(words: list[str], voc: Vocabulary) -> dict[str, list[int]]:
    """Ids of the best segmentation of each marked word; of equal scores the longest last piece."""
    get, get_id = voc.suffixes.get, voc.ids
    byte_weight, byte_ids = voc.byte_log_weight, voc.byte_ids
    out: dict[str, list[int]] = {}
    top, back, before = [0.0], [0], ""
    for w in sorted(words):
        k = shared(before, w)
        del top[k + 1 :], back[k + 1 :]
        for j in range(k + 1, len(w) + 1):
            high, at, i = -1e300, j - 1, j - 1
            while i >= 0:
                s = get(w[i:j])
                if s is None:
                    break
                if s <= 0 and top[i] + s >= high:
                    high, at = top[i] + s, i
                i -= 1
            if w[j - 1] not in get_id:
                s = top[j - 1] + byte_weight * len(bytes_of(w[j - 1]))
                if s > high:
                    high, at = s, j - 1
            top.append(high)
            back.append(at)
        ids, j = [], len(w)
        while j:
            i = back[j]
            found = get_id.get(w[i:j])
            if found is None:
                ids.extend(byte_ids[b] for b in reversed(bytes_of(w[i:j])))
            else:
                ids.append(found)
            j = i
        ids.reverse()
        out[w] = ids
        before = w
    return out


def log_sum(words: list[str], weight: dict[str, float], byte_weight: float) -> dict[str, float]:
    """Natural log of the weight of all segmentations of each marked word, forward and in log space.

    ``weight`` comes from ``with_suffixes(..., 1.0)``.
    """
    get = weight.get
    out: dict[str, float] = {}
    alpha, before = [0.0], ""
    for w in sorted(words):
        k = shared(before, w)
        del alpha[k + 1 :]
        for j in range(k + 1, len(w) + 1):
            terms, i = [], j - 1
            while i >= 0:
                s = get(w[i:j])
                if s is None:
                    break
                if s <= 0:
                    terms.append(alpha[i] + s)
                i -= 1
            if get(w[j - 1], 1.0) > 0:
                terms.append(alpha[j - 1] + byte_weight * len(bytes_of(w[j - 1])))
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                high = max(terms)
                alpha.append(high + log(sum([exp(t - high) for t in terms])))
        out[w] = alpha[-1]
        before = w
    return out


#: Longest word that the walks without logarithms take; their weights are tilted by so much a character to stay near 1.
PLAIN, TILT = 150, 2.0
#: A smaller sum than this may have lost digits on its way.
SMALL = 1e-200


def tilted(weight: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...]]:
    return with_suffixes({p: tuple(exp(x + TILT * len(p)) for x in v) for p, v in weight.items()}, ())


def in_logarithms(w: str, weight: dict[str, tuple[float, ...]], tilt: dict[str, tuple[float, ...]], byte_weight: tuple[float, ...]) -> list[float]:
    """One word's sums under several models; as exact as ``log_sum``, whatever its length and letters."""
    alpha = [[0.0] * len(byte_weight)]
    for j in range(1, len(w) + 1):
        terms, i = [], j - 1
        while i >= 0:
            p = tilt.get(w[i:j])
            if p is None:
                break
            if p:
                terms.append([a + x for a, x in zip(alpha[i], weight[w[i:j]])])
            i -= 1
        if not tilt.get(w[j - 1]):
            n = len(bytes_of(w[j - 1]))
            terms.append([a + b * n for a, b in zip(alpha[j - 1], byte_weight)])
        high = [max(t) for t in zip(*terms)]
        alpha.append([h + log(sum([exp(x - h) for x in t])) for h, t in zip(high, zip(*terms))])
    return alpha[-1]


#: Doubles of sums that a walk of many words holds at once.
HELD = 1 << 18


class Sums:
    """``log_sum`` for several models at once, of many words together: a step extends the pieces from the same place of all words by a letter.

    Pieces are a trie whose transitions (node, letter) lie in a hash table; a word's sums don't depend on the words beside it.
    ``tilt`` is ``tilted(weight)``. Words too long or too rare for plain doubles go through logarithms.
    """

    def __init__(self, weight: dict[str, tuple[float, ...]], tilt: dict[str, tuple[float, ...]], byte_weight: tuple[float, ...]):
        self.weight, self.tilt, self.byte_weight = weight, tilt, byte_weight
        to: dict[int, int] = {}
        row = [-1]  # of each node's piece
        for at, piece in enumerate(weight):
            node = 0
            for c in piece:
                node = to.setdefault(node << 21 | ord(c), len(row))
                if node == len(row):
                    row.append(-1)
            row[node] = at
        self.row = np.array(row)
        self.tilted = np.array([tilt[p] for p in weight]).reshape(-1, len(byte_weight))
        self.by_bytes = np.exp(np.outer(np.arange(5), byte_weight) + TILT)
        self.shift = np.uint64(64 - max(8, (4 * len(to)).bit_length()))
        self.keys, self.nodes = np.full(1 << 64 - int(self.shift), -1, np.int64), np.full(1 << 64 - int(self.shift), -1)
        keys, nodes = np.array(list(to), np.int64), np.array(list(to.values()), np.int64)
        place = self._place(keys)
        while len(keys):
            free, first = np.unique(place, return_index=True)
            first = first[self.keys[free] == -1]
            self.keys[place[first]], self.nodes[place[first]] = keys[first], nodes[first]
            left = np.setdiff1d(np.arange(len(keys)), first)
            keys, nodes, place = keys[left], nodes[left], (place[left] + 1) % len(self.keys)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of the transitions, -1 for none."""
        place = self._place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.nodes[place], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.keys)
            held = self.keys[place[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.nodes[place[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def _walk(self, words: list[str]) -> np.ndarray:
        """Sums of tilted weights, a row each, of words from long to short."""
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        reach = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "right")  # words that have so many letters
        at = np.cumsum(reach) - reach
        sums = np.zeros((reach.sum(), len(self.byte_weight)))
        sums[: len(words)] = 1.0

        def add(begin: np.ndarray, end: np.ndarray, times: np.ndarray) -> None:
            times *= sums.take(begin, 0)
            times += sums.take(end, 0)
            sums[end] = times

        for i in range(sizes[0]):
            own = np.arange(reach[i + 1])
            node = np.zeros(len(own), np.int64)
            for n in range(1, sizes[0] - i + 1):
                letter = letters.take(starts.take(own) + (i + n - 1))
                node = self._next(node << 21 | letter)
                row = np.where(node >= 0, self.row.take(node), -1)
                hit = np.flatnonzero(row >= 0)
                add(at[i] + own[hit], at[i + n] + own[hit], self.tilted.take(row[hit], 0))
                if n == 1 and len(hit) < len(own):
                    none = np.flatnonzero(row < 0)
                    x = letter[none]
                    add(at[i] + own[none], at[i + 1] + own[none], self.by_bytes.take(np.where(x < 0x80, 1, np.where(x < 0x800, 2, np.where(x < 0x10000, 3, 4))), 0))
                go = np.flatnonzero(node[: np.searchsorted(own, reach[min(i + n + 1, sizes[0])])] >= 0) if i + n < sizes[0] else own[:0]
                if not len(go):
                    break
                own, node = own[go], node[go]
        return sums[at[sizes] + np.arange(len(words))]

    def of(self, words: list[str]) -> np.ndarray:
        """A row of logs for each word."""
        sizes = np.array([len(w) for w in words])
        out = np.zeros((len(words), len(self.byte_weight)))
        order = np.argsort(-sizes, kind="stable")
        start = np.searchsorted(-sizes[order], -PLAIN)
        slow = order[:start].tolist()
        while start < len(order):
            many = max(1, HELD // (int(sizes[order[start]] + 1) * len(self.byte_weight)))
            own = order[start : start + many]
            start += many
            last = self._walk([words[i] for i in own])
            slow += own[last.min(1) <= SMALL].tolist()
            with np.errstate(divide="ignore"):
                out[own] = np.log(last) - TILT * sizes[own, None]
        for i in slow:
            out[i] = in_logarithms(words[i], self.weight, self.tilt, self.byte_weight)
        return out


class Rows:
    """Rows of ``Sums`` by word, computed from those of the words' parts; about ``most`` words are remembered until they are too many."""

    def __init__(self, sums: Sums, pairs: frozenset[str], most: int = 300_000):
        self.sums, self.pairs, self.most = sums, pairs, most
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.known = np.zeros((0, len(self.sums.byte_weight)))

    def _computed(self, words: list[str]) -> np.ndarray:
        cut = [(w,) if len(w) <= PLAIN and w[1:].isascii() else segments(w, self.pairs) for w in words]  # few ASCII words have parts
        parts = {x: i for i, x in enumerate(dict.fromkeys(x for own in cut for x in own))}
        rows = self.sums.of(list(parts))
        sizes = np.array([len(own) for own in cut])
        at = np.fromiter((parts[x] for own in cut for x in own), np.int64, sizes.sum())
        return np.add.reduceat(rows[at], np.cumsum(sizes) - sizes, axis=0)

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of these distinct words."""
        new = [w for w in words if w not in self.places]
        if new and len(self.places) + len(new) > self.most:
            self._forget()
            new = words
        if new:
            self.places.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.known = np.concatenate([self.known, self._computed(new)])
        return self.known[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


def log_sums(words: list[str], weight: dict[str, tuple[float, ...]], tilt: dict[str, tuple[float, ...]], byte_weight: tuple[float, ...]) -> dict[str, list[float]]:
    return dict(zip(words, Sums(weight, tilt, byte_weight).of(words).tolist(), strict=True))


def expected(counted: Iterable[tuple[str, float]], voc: Vocabulary, tilt: dict[str, tuple[float, ...]]) -> dict[int, float]:
    """Expected uses of each piece over all segmentations of counted marked words (forward and backward).

    Longer words than ``PLAIN`` are cut into parts of that length, and parts too rare for plain doubles in halves; this touches training only.
    """
    get, ids = tilt.get, voc.ids
    byte_weight = exp(voc.byte_log_weight)
    out: dict[int, float] = {}
    alpha, edges, before = [1.0], [()], ""
    parts = sorted((w[at : at + PLAIN], c) for w, c in counted for at in range(0, len(w), PLAIN))
    parts.reverse()
    while parts:
        w, c = parts.pop()
        k = shared(before, w)
        del alpha[k + 1 :], edges[k + 1 :]
        for j in range(k + 1, len(w) + 1):
            own, total, i = [], 0.0, j - 1
            while i >= 0:
                p = get(w[i:j])
                if p is None:
                    break
                if p:
                    own.append((i, ids[w[i:j]], p[0]))
                    total += alpha[i] * p[0]
                i -= 1
            if w[j - 1] not in ids:
                p = byte_weight ** len(bytes_of(w[j - 1])) * exp(TILT)
                own.append((j - 1, -1, p))
                total += alpha[j - 1] * p
            alpha.append(total)
            edges.append(own)
        before, n = w, len(w)
        if alpha[n] < SMALL:
            parts += [(w[n // 2 :], c), (w[: n // 2], c)] if n > 1 else []
            continue
        beta = [0.0] * n + [1.0 / alpha[n]]
        for j in range(n, 0, -1):
            b = beta[j]
            if b:
                for i, piece, p in edges[j]:
                    pb = p * b
                    beta[i] += pb
                    if piece >= 0:
                        out[piece] = out.get(piece, 0.0) + c * alpha[i] * pb
                    else:
                        for x in bytes_of(w[i:j]):
                            out[voc.byte_ids[x]] = out.get(voc.byte_ids[x], 0.0) + c * alpha[i] * pb
    return out


LATIN_END = "\u0250"


def segments(word: str, pairs: frozenset[str]) -> list[str]:
    """The parts of a word between the boundaries that every segmentation has, so parts can be scored apart. Latin words are left whole: few have one."""
    if word[1:].isalpha() and max(word[1:]) < LATIN_END:
        return [word]
    parts, start = [], 0
    for i in range(1, len(word)):
        if word[i - 1 : i + 1] not in pairs:
            parts.append(word[start:i])
            start = i
    parts.append(word[start:])
    return parts


class Remembered:
    """Results by word in two generations of bounded size: frequent words stay, memory doesn't grow."""

    def __init__(self, compute: Callable[[list[str]], dict], most: int = 150_000):
        self.compute, self.most, self.new, self.old = compute, most, {}, {}

    def of(self, words: set) -> dict:
        """A dict with all the words given."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        missing = words - self.new.keys()
        if missing and self.old:
            again = missing & self.old.keys()
            self.new.update((w, self.old[w]) for w in again)
            missing -= again
        if missing:
            self.new.update(self.compute(list(missing)))
        return self.new


def remembered(walk: Callable[[list[str]], dict], join: Callable[[list], object], pairs: frozenset[str], as_text: Callable = lambda w: w) -> Remembered:
    """Word results joined from those of their parts, which many words share; both are remembered."""
    parts_of = Remembered(walk)

    def compute(words: list) -> dict:
        cut = {w: segments(as_text(w), pairs) for w in words}
        known = parts_of.of({x for own in cut.values() for x in own})
        return {w: join([known[x] for x in own]) for w, own in cut.items()}

    return Remembered(compute)


def chunks(texts: list[str | None], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
