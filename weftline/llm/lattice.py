"""A piece vocabulary, the lattice of a text's segmentations into its pieces, and dynamic programs over it.

A text is put as SentencePiece puts it: a space before it, spaces standing for the vocabulary's space mark
(U+2581). A character that is no piece is an unknown edge, later spelt by the vocabulary's byte pieces; a
literal U+2581 of a text is spelt by bytes as well, so that decoding gives back the very text.

An atom is a stretch that no piece can leave: pieces have the space mark only in front, and some characters
occur in no longer piece. Atoms are independent, so results are kept by atom and computed for many atoms at
a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import gather_index, segment_sum, span_hashes

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_HASH = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with their scores, as a trie in arrays; small (bounded by the vocabulary) and broadcast whole."""

    def __init__(self, pieces: list[str], scores: Iterable[float], byte_ids: list[int], special: Iterable[int] = ()):
        self.pieces, self.scores = pieces, np.array(list(scores), np.float64)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.special = sorted(set(special))
        skip = {*byte_ids, *self.special}
        self.normal = np.array([i for i in range(len(pieces)) if i not in skip and pieces[i]], np.int64)
        self.unknown_score = float(self.scores[self.normal].min(initial=0.0)) - _UNKNOWN_PENALTY
        self.max_length = max([len(pieces[i]) for i in self.normal], default=1)
        symbols = sorted({c for i in self.normal for c in pieces[i]})
        self.n_symbols = len(symbols) + 1
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(symbols, 1):
            self.symbol[0x20 if c == SPACE else ord(c)] = k
        self.symbol[ord(SPACE)] = 0
        if " " in symbols:
            raise ValueError("the vocabulary has plain spaces")
        number = {c: k for k, c in enumerate(symbols, 1)}
        self.edges: dict[int, int] = {}
        self.piece_at = [-1]
        for i in self.normal.tolist():
            node = 0
            for c in pieces[i]:
                key = node * self.n_symbols + number[c]
                if key not in self.edges:
                    self.edges[key] = len(self.piece_at)
                    self.piece_at.append(-1)
                node = self.edges[key]
            self.piece_at[node] = i
        self.piece_of = np.array(self.piece_at, np.int64)
        self._hash()
        longer = {c for i in self.normal if len(pieces[i]) > 1 for c in pieces[i]}
        front = all(SPACE not in pieces[i].lstrip(SPACE) for i in self.normal)
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in longer)
        self.atom = re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else "") if front else r"(?s).+")
        self.cuts_at_space, self.alone, self.alone_chars = front, np.zeros(256, bool), alone if front else ""
        self.alone[list(alone.encode())] = front
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        for i in self.special:
            self.bytes_of[i] = b""
        self.byte_length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length

    def _hash(self) -> None:
        bits = max(8, len(self.edges).bit_length() + 2)
        keys, values = np.fromiter(self.edges, np.int64), np.fromiter(self.edges.values(), np.int64)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[left[free]]
            placed = self.slot_key[at] == keys[left]
            self.slot_node[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The children of trie nodes; -1 where there is none."""
        keys = node * np.int64(self.n_symbols) + symbol
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_node[at], -1)
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.slot_key[at[left]]
            same = got == keys[left]
            out[left[same]] = self.slot_node[at[left[same]]]
            left = left[~same & (got >= 0)]
        return out

    def symbols_of(self, text: str) -> np.ndarray:
        return self.symbol[code_points(text)]

    def spell(self, char: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte pieces; its own scores are kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = [i for i in size if model.is_control(i) or model.is_unknown(i)]
    return Vocabulary([model.id_to_piece(i) for i in size], [model.get_score(i) for i in size], byte_ids, special)


def lattice_edges(v: Vocabulary, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, length, rows, pieces) over texts of one length, by start, then length; piece -1 is unknown."""
    rows_all, n = np.arange(len(symbols)), symbols.shape[1]
    root = np.zeros(len(symbols), np.int64)
    for i in range(n):
        rows, node = rows_all, v.step(root, symbols[:, i])
        unknown = v.piece_of[node] < 0  # piece_of[-1] is of no meaning, so the dead are asked for, too
        unknown |= node < 0
        if unknown.any():
            yield i, 1, rows_all[unknown], np.full(int(unknown.sum()), -1)
        for length in range(1, min(v.max_length, n - i) + 1):
            if length > 1:
                node = v.step(node, symbols[rows, i + length - 1])
            alive = node >= 0
            rows, node = rows[alive], node[alive]
            if not len(rows):
                break
            piece = v.piece_of[node]
            ends = piece >= 0
            if ends.any():
                yield i, length, rows[ends], piece[ends]


def viterbi(v: Vocabulary, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of texts, none empty, longest first, given by their code points and lengths: flat ids, their
    number by text, and scores. On ties the longer last piece is taken.

    All texts go through the trie together, and then place by place through the recursion: those that reach a place
    are the first ones, so their states lie in one run, and state (place, text) is at off[place] + text."""
    count, first, most = len(length), np.cumsum(length) - length, int(length[0])
    reach = np.append(np.searchsorted(-length, -np.arange(most + 1), side="right"), 0)  # texts that have the place as their end or before it
    off = np.cumsum(reach) - reach
    row = np.repeat(np.arange(count), length)
    place = np.arange(len(points)) - first[row]
    state = off[place] + row
    symbols = np.zeros(len(points) + count + 1, np.int64)  # a text ends in a symbol of no piece, where the trie ends, too
    spot = np.arange(len(points)) + row
    symbols[spot] = v.symbol[points]
    none, unknown = len(v.scores) + 1, len(v.scores)
    worth = np.concatenate((v.scores, [v.unknown_score, -np.inf]))
    pieces = np.full((v.max_length + 1, int(off[most + 1])), none, np.int32)  # by length and the state it starts from
    seen = np.zeros((v.max_length + 1, most + 1), bool)
    node = v.step(np.zeros(len(points), np.int64), symbols[spot])
    lone = np.where(node >= 0, v.piece_of[node], -1)
    pieces[1, state] = np.where(lone >= 0, lone, unknown)
    seen[1] = True
    at = np.flatnonzero(node >= 0)
    node = node[at]
    for n in range(2, v.max_length + 1):
        node = v.step(node, symbols[spot[at] + n - 1])
        alive = node >= 0
        at, node = at[alive], node[alive]
        if not len(at):
            break
        piece = v.piece_of[node]
        ends = np.flatnonzero(piece >= 0)
        pieces[n, state[at[ends]]] = piece[ends]
        seen[n, place[at[ends]]] = True
    best, taken = np.zeros(int(off[most + 1])), np.zeros(int(off[most + 1]), np.int32)
    for j in range(1, most + 1):
        m, here = int(reach[j]), int(off[j])
        top, by = np.full(m, -np.inf), taken[here : here + m]
        for n in range(min(j, v.max_length), 0, -1):
            if seen[n, j - n]:
                lo = int(off[j - n])
                score = best[lo : lo + m] + worth[pieces[n, lo : lo + m]]
                better = score > top
                np.copyto(top, score, where=better)
                np.copyto(by, n, where=better)
        best[here : here + m] = top
    end, alive, parts = length.copy(), np.arange(count), []
    while len(alive):
        n = taken[off[end[alive]] + alive]
        end[alive] -= n
        parts.append((alive, pieces[n, off[end[alive]] + alive], end[alive]))
        alive = alive[end[alive] > 0]
    row, flat, start = (np.concatenate(x)[::-1] for x in zip(*parts))
    order = np.argsort(row, kind="stable")  # each text's pieces from its first to its last
    row, flat, start = row[order], flat[order].astype(np.int64), start[order]
    lengths = np.bincount(row, minlength=count)
    odd = np.flatnonzero(flat == unknown)
    if len(odd):
        spelt = [v.spell(chr(c)) for c in points[first[row[odd]] + start[odd]].tolist()]
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(x) for x in spelt]
        np.add.at(lengths, row[odd], times[odd] - 1)
        flat = np.repeat(flat, times)
        flat[flat == unknown] = [y for x in spelt for y in x]
    return flat, lengths, best[off[length] + np.arange(count)]


class AtomTable:
    """Encodings of the atoms met so far, by a number each; all are forgotten beyond `most` of them."""

    def __init__(self, v: Vocabulary, most: int = 450_000, together: int = 1 << 17):
        self.v, self.most, self.together = v, most, together
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.lengths, self.scores = np.zeros(0, np.int64), np.zeros(0)
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, points: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of distinct atoms that are not in the table yet, given by their code points and lengths."""
        order = np.argsort(-length, kind="stable")
        points, length = points[gather_index((np.cumsum(length) - length)[order], length[order])], length[order]
        parts, lengths, scores = [self.flat], [self.lengths], [self.scores]
        edge, lo = np.concatenate(([0], np.cumsum(length))), 0
        while lo < len(length):  # a bounded number of characters together
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + self.together, side="right")) - 1)
            flat, many, best = viterbi(self.v, points[edge[lo] : edge[hi]], length[lo:hi])
            parts.append(flat.astype(np.int32))
            lengths.append(many)
            scores.append(best)
            lo = hi
        number = np.empty(len(length), np.int64)
        number[order] = np.arange(len(length)) + len(self.lengths)
        self.flat, self.lengths, self.scores = np.concatenate(parts), np.concatenate(lengths), np.concatenate(scores)
        self.starts = np.cumsum(self.lengths) - self.lengths
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, offsets by text and scores; a text has its leading space already, or is empty."""
        if len(self.number) > self.most:
            self.clear()
        find, get = self.v.atom.findall, self.number.get
        atoms, counts = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            some = find(t)
            counts[k] = len(some)
            atoms += some
        new = list(set(atoms).difference(self.number))
        self.number.update(zip(new, self.add(code_points("".join(new)), np.fromiter(map(len, new), np.int64, len(new))).tolist()))
        return self.gather(np.fromiter(map(get, atoms), np.int64, len(atoms)), counts)

    def gather(self, code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = self.lengths[code]
        total = np.concatenate(([0], np.cumsum(length)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        scores = np.concatenate(([0.0], self.scores[code]))[1:]
        running = np.add.reduceat(np.append(scores, 0.0), edge[:-1]) if len(counts) else np.zeros(0)
        return self.flat[gather_index(self.starts[code], length)], total[edge], np.where(counts > 0, running, 0.0)


class HashedAtoms:
    """AtomTable over UTF-8 bytes: atoms are told apart by 64-bit hashes, and only new ones are looked at by character.

    Equal hashes of unlike atoms would show as a failed round trip; callers check it and fall back to `plain`.
    """

    def __init__(self, v: Vocabulary, most: int = 250_000):
        self.table, self.plain = AtomTable(v, most), AtomTable(v, 10_000)
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As AtomTable.encode, over the bytes of texts that have their leading space."""
        v = self.table.v
        if len(self.codes) > self.table.most:
            self.table.clear()
            self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not len(data):
            return self.table.gather(np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if v.cuts_at_space:
            space, alone = data == 0x20, v.alone[data]
            cut[1:-1] |= space[1:] & ~space[:-1] | alone[1:] | alone[:-1]
            cut[0] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        code = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            code = np.where(self.keys[at] == hashes, self.codes[at], -1)
        new = np.flatnonzero(code < 0)
        if len(new):
            lo, size = starts[first[new]], (ends - starts)[first[new]]
            some = data[gather_index(lo, size)]
            length = segment_sum((some & 0xC0) != 0x80, np.concatenate(([0], np.cumsum(size))))
            code[new] = self.table.add(code_points(some.tobytes().decode()), length)
            keys, codes = np.concatenate((self.keys, hashes[new])), np.concatenate((self.codes, code[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.codes = keys[order], codes[order]
        edge = np.searchsorted(starts, offsets)
        return self.table.gather(code[inverse], np.diff(edge))


def decode_flat(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for and the number of bytes of each."""
    length = v.byte_length[ids]
    return v.byte_flat[gather_index(v.byte_start[ids], length)], length


def log_marginals(v: Vocabulary, log_p: np.ndarray, texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of the summed probability of all segmentations of texts of one length, by the forward
    recursion; with weights also the pieces' expected counts, by the backward one."""
    n, count = len(texts[0]), len(texts)
    points = code_points("".join(texts)).reshape(count, n)
    symbols = v.symbol[points]
    spelt = {c: v.spell(chr(c)) for c in np.unique(points).tolist()}
    lone = {c: float(log_p[ids].sum()) for c, ids in spelt.items()}
    keys = np.array(sorted(lone), np.int64)
    values = np.array([lone[c] for c in keys.tolist()])
    alpha = np.full((count, n + 1), -np.inf)
    alpha[:, 0] = 0
    edges = []
    for i, length, rows, piece in lattice_edges(v, symbols):
        gain = log_p[piece]
        if (piece < 0).any():
            gain = np.where(piece < 0, values[np.searchsorted(keys, points[rows, i])], gain)
        alpha[rows, i + length] = np.logaddexp(alpha[rows, i + length], alpha[rows, i] + gain)
        if weights is not None:
            edges.append((i, length, rows, piece, gain))
    total = alpha[:, n]
    if weights is None:
        return total, None
    beta = np.full((count, n + 1), -np.inf)
    beta[:, n] = 0
    expected = np.zeros(len(v.pieces))
    for i, length, rows, piece, gain in reversed(edges):
        onward = beta[rows, i + length] + gain
        share = np.exp(alpha[rows, i] + onward - total[rows]) * weights[rows]
        beta[rows, i] = np.logaddexp(beta[rows, i], onward)
        if piece[0] >= 0:
            expected += np.bincount(piece, weights=share, minlength=len(expected))
        else:
            for c, x in zip(points[rows, i].tolist(), share.tolist()):
                np.add.at(expected, spelt[c], x)
    return total, expected


def paths(v: Vocabulary, text: str, own: int, sources: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each source offset, best scores to each offset by pieces that start before `own`; with the
    start and piece (-1: unknown) of the last one."""
    n = len(text)
    symbols = v.symbols_of(text).tolist()
    best = np.full((len(sources), n + 1), -np.inf)
    best[np.arange(len(sources)), sources] = 0
    came, by = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
    for i in range(min(own, n)):
        reached = best[:, i]
        if not np.isfinite(reached).any():
            continue
        node, single = 0, False
        for j in range(i + 1, min(i + v.max_length, n) + 1):
            node = v.edges.get(node * v.n_symbols + symbols[j - 1], -1)
            if node < 0:
                break
            piece = v.piece_at[node]
            if piece >= 0:
                single |= j == i + 1
                _relax(best, came, by, i, j, reached + v.scores[piece], piece)
        if not single:
            _relax(best, came, by, i, i + 1, reached + v.unknown_score, -1)
    return best, came, by


def _relax(best, came, by, i, j, score, piece):
    better = score > best[:, j]
    best[better, j], came[better, j], by[better, j] = score[better], i, piece


def trace(v: Vocabulary, text: str, came: np.ndarray, by: np.ndarray, source: int, end: int) -> list[int]:
    """Ids of the best path from source to end, from one row of `paths`."""
    out = []
    while end > source:
        piece, start = int(by[end]), int(came[end])
        out.append([piece] if piece >= 0 else v.spell(text[start]))
        end = start
    return [x for some in reversed(out) for x in some]
