"""SentencePiece encoding by sampled segmentations, and decoding.

The segmentations of a text are the paths of a lattice of vocabulary pieces. Gumbel top-k draws k of them
without replacement: every path has a log probability perturbed by Gumbel noise, and a best-first
(perturbed A-star) search finds the k largest without listing the paths. Its heuristic is exact: a
partial path's noise is the maximum over all its completions, so the first path is an ancestral
sample and every step off a path found so far waits with its own truncated noise.

No piece spans a change from other characters to a space, so a text's lattice is a chain of small
lattices, one for each unit (spaces and what follows up to the next). A chunk's units are built once
each, all at a time with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gristmill.llm import words
from gristmill.llm.shared import give_back, lean, small_batches

#: Log probabilities are kept in steps of 2 ** -30: their sums are exact and do not depend on the chunk.
UNIT = 1 << 30
SPACE = 0x20
#: Bytes of text that are sampled at once: its arrays are many times larger.
CHUNK_BYTES = 1 << 19


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((words.mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _times(x, factor: int) -> np.ndarray:
    return np.asarray(x).astype(np.uint64) * np.uint64(factor)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the polynomial by which bytes are hashed here."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return sums


def _polynomial(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = _sums(data)
    return (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)


class Pieces:
    """The vocabulary of a SentencePiece model with byte fallback, as tables.

    A model of merge ranks has no probabilities of pieces; their ranks are taken as those of a Zipf law:
    the log probability of rank r is -log(r + 2). A model whose scores are log probabilities uses them.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        scores = np.array([model.get_score(i) for i in range(n)])
        ranks = scores.min() < -1e4
        self.bytes: list[bytes] = []
        self.score = np.zeros(n)
        self.of_byte = np.zeros(256, np.int64)
        found, worst = {}, float(np.log(n + 2.0))
        for i in range(n):
            raw = b""
            if model.is_byte(i):
                raw = bytes([int(model.id_to_piece(i)[3:5], 16)])
                self.of_byte[raw[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = model.id_to_piece(i).replace("▁", " ").encode()
                self.score[i] = (-np.log(2 - scores[i]) if scores[i] > -n - 1 else -worst) if ranks else scores[i]
                found[raw] = i
            self.bytes.append(raw)
        self.byte_score = -worst if ranks else float(scores[scores > -1e4].min()) - 10
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        keys = list(found)
        data = np.frombuffer(b"".join(keys), np.uint8)
        size = np.array([len(k) for k in keys], np.int64)
        ends = np.cumsum(size)
        h = _polynomial(data, ends - size, ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(list(found.values()), np.int64)[order]
        # Which hashes may be those of a piece (bit 2) or of the first bytes of a longer one (bit 1).
        self.there = np.zeros(1 << 22, np.uint8)
        begins = list({k[:n] for k in keys for n in range(1, len(k))})
        long = np.cumsum([len(b) for b in begins])
        heads = _polynomial(np.frombuffer(b"".join(begins), np.uint8), np.r_[0, long[:-1]], long)
        self.there[_slot(heads)] |= 1
        self.there[_slot(h)] |= 2
        # Which of the hashes may be at a slot; of several pieces of one slot the others are searched for.
        slots, many = np.unique(_slot(self.hashes), return_counts=True)
        self.at_slot = np.zeros(1 << 22, np.int16 if len(self.hashes) < 1 << 15 else np.int32)
        self.at_slot[_slot(self.hashes)] = np.arange(len(self.hashes))
        self.at_slot[slots[many > 1]] = -1
        self.longest = int(size.max())

    def find(self, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places among the hashes of those that are a piece's, else -1."""
        k = self.at_slot[slot].astype(np.int64)
        odd = np.flatnonzero(k < 0)
        k[odd] = np.minimum(np.searchsorted(self.hashes, h[odd]), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, -1)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all sequences of ids, without the space put before each, and the offset of each."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        data = self.flat[source]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        lead = offsets[:-1][counts > 0]
        keep = np.ones(len(data), bool)
        keep[lead] = data[lead] != SPACE
        return data[keep], np.r_[0, np.cumsum(keep)][offsets]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of these starts and sizes, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """Arcs of the lattices of distinct units, by their first place in ``data``."""

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray, alpha: float):
        # A step of its own for each: what it needs beside its result is freed when it ends.
        end = np.repeat(offsets[1:], np.diff(offsets))
        first, last, piece = self._arcs(pieces, data, end)
        self.first, self.off = first, np.searchsorted(first, np.arange(len(data) + 1))
        inside = last < (end[first] if len(data) else 0)
        logp = self._log_probs(pieces, first, last, piece, inside, end, alpha)
        # The likeliest arc of a place comes first: a draw seldom looks at a second one.
        rank = (-logp & ~63) | np.minimum(last - first, 63)
        order = np.lexsort((rank, first)) if len(data) >> 25 else np.argsort((first << 38) + rank)
        del rank
        self.last, self.piece, self.inside, self.logp = last[order], piece[order], inside[order], logp[order]
        del last, piece, inside, logp, order
        self.p = p = np.exp(self.logp / UNIT)
        self.upto = self._upto(p)
        self.log_rest = self._log_rest(p)

    @staticmethod
    def _arcs(pieces: Pieces, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place and piece of all arcs, by first place and length; ``end`` is where each place's unit ends."""
        n = len(data)
        sums = _sums(data)
        back = _power(_INVERSE, n + 1)[:n]
        opens = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        alone = opens.copy()
        first, last, piece = [], [], []
        at = np.flatnonzero(opens)
        for length in range(1, pieces.longest + 1):
            at = at[at + length <= end[at]]
            if not len(at):
                break
            h = (sums[at + length] - sums[at]) * back[at]
            slot = _slot(h)
            maybe = pieces.there[slot]
            whole = np.flatnonzero(maybe >= 2)
            k = pieces.find(h[whole], slot[whole])
            hit = np.flatnonzero(k >= 0)
            here, k = at[whole[hit]], k[hit]
            alone[here[width[here] == length]] = False
            first.append(here)
            last.append(here + length)
            piece.append(pieces.ids[k])
            at = at[(maybe & 1) > 0]
        # A character that is no piece is spelt in bytes: one arc, marked by id -1.
        at = np.flatnonzero(alone & opens)
        first.append(at)
        last.append(np.minimum(at + width[at], end[at]))
        piece.append(np.full(len(at), -1))
        found = [first, last, piece]
        del first, last, piece, sums
        order = np.argsort(np.concatenate(found[0]), kind="stable")  # they come by length, in ascending order for each
        return tuple(np.concatenate(found.pop(0))[order] for _ in range(3))

    def _log_probs(self, pieces: Pieces, first: np.ndarray, last: np.ndarray, piece: np.ndarray, inside: np.ndarray, end: np.ndarray, alpha: float) -> np.ndarray:
        """Each arc's log probability at its place, in steps of ``UNIT``."""
        n = len(end)
        score = alpha * np.where(piece >= 0, pieces.score[piece], pieces.byte_score * (last - first))
        # Log sum over all ways from a place to its unit's end, from the end backwards, all units at once.
        total = np.zeros(n + 1)
        rest = (end[first] - first) if n else np.zeros(0, np.int64)
        rest = rest.astype(np.uint16) if rest.max(initial=0) < 1 << 16 else rest
        by = np.argsort(rest, kind="stable")
        cuts = np.r_[0, np.flatnonzero(rest[by][1:] != rest[by][:-1]) + 1, len(by)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(by) else ():
            arcs = by[a:b]
            value = score[arcs] + np.where(inside[arcs], total[last[arcs]], 0.0)
            heads = first[arcs]
            starts = np.r_[0, np.flatnonzero(np.diff(heads)) + 1]
            total[heads[starts]] = np.logaddexp.reduceat(value, starts)
        del by, rest
        score += np.where(inside, total[last], 0.0)
        score -= total[first]
        return np.rint(np.minimum(score, 0.0, out=score) * UNIT).astype(np.int64)

    def _upto(self, p: np.ndarray) -> np.ndarray:
        """Running sums of probabilities within each place."""
        sums = np.cumsum(p)
        return sums - (sums - p)[self.off[self.first]] if len(self.off) > 1 else sums

    def _log_rest(self, p: np.ndarray) -> np.ndarray:
        """Log probability of all other arcs of an arc's place; that of the likeliest is summed without it."""
        heads = self.off[:-1][np.diff(self.off) > 0]
        tails = p.copy()
        tails[heads] = 0
        others = np.repeat(np.add.reduceat(tails, heads), np.diff(np.append(heads, len(p)))) if len(p) else p
        del tails
        likeliest = np.zeros(len(p), bool)
        likeliest[heads] = True
        with np.errstate(divide="ignore"):
            return np.log(np.where(likeliest, others, others + p[self.off[self.first]] - p))

    def chosen(self, starts: np.ndarray, sizes: np.ndarray) -> Lattice:
        """The lattice of some units alone, by their first bytes and sizes, in this order."""
        out = Lattice.__new__(Lattice)
        at = _ranges(starts, sizes)
        many = self.off[at + 1] - self.off[at]
        out.off = np.r_[0, np.cumsum(many)]
        arc = _ranges(self.off[starts], self.off[starts + sizes] - self.off[starts])
        shift = np.repeat(np.cumsum(sizes) - sizes - starts, self.off[starts + sizes] - self.off[starts])
        out.first, out.last = self.first[arc] + shift, self.last[arc] + shift
        for name in Lattice.OF_ARCS:
            setattr(out, name, getattr(self, name)[arc])
        return out

    def and_then(self, other: Lattice) -> Lattice:
        """Both lattices, the other's places behind this one's. Both are used up: what is copied is freed."""
        out, places = Lattice.__new__(Lattice), len(self.off) - 1
        out.off = np.concatenate([self.off[:-1], other.off + self.off[-1]])
        for name in ("first", "last"):
            other.__dict__[name] += places
        for name in ("first", "last", *Lattice.OF_ARCS):
            setattr(out, name, np.concatenate([self.__dict__.pop(name), other.__dict__.pop(name)]))
        return out

    #: What is kept of an arc besides its places.
    OF_ARCS = ("piece", "inside", "logp", "p", "upto", "log_rest")

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc at each place, by probability."""
        arc, final = self.off[place], self.off[place + 1] - 1
        todo = np.flatnonzero((u > self.upto[arc]) & (arc < final))
        while len(todo):
            arc[todo] += 1
            now = arc[todo]
            todo = todo[(u[todo] > self.upto[now]) & (now < final[todo])]
        return arc


class Units:
    """Lattices of units that occur again and again, by their hashes: what a worker has built once it need not build for each chunk."""

    #: Bytes of units that are remembered.
    MOST = 1 << 18

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces, self.alpha, self.chunks, self.renew = pieces, alpha, 0, 1
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.lattice = np.zeros(0, np.uint8), None

    def build(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Lattice]:
        """Bytes, first byte of each unit in them, and lattices, of distinct units by ascending hash.

        The remembered ones come first, then the others, which are built. A remembered unit is told by hash and size.
        """
        k = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = (self.hashes[k] == hashes) & (self.sizes[k] == sizes) if len(self.hashes) else np.zeros(len(hashes), bool)
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        order, sized = np.concatenate([old, new]), np.concatenate([sizes[old], sizes[new]])
        own = data[_ranges(starts[new], sizes[new])]
        lattice = Lattice(self.pieces, own, np.r_[0, np.cumsum(sizes[new])], self.alpha)
        if len(old):
            own = np.concatenate([self.data[_ranges(self.starts[k[old]], self.sizes[k[old]])], own])
            lattice = self.lattice.chosen(self.starts[k[old]], self.sizes[k[old]]).and_then(lattice)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(sized) - sized
        self.chunks += 1
        if self.chunks >= self.renew:  # after 1, 2, 4, ... chunks: what occurs most often in this one, and was remembered or occurs twice
            self.renew *= 2
            often = np.flatnonzero(known | (counts > 1))
            often = often[np.argsort(-counts[often], kind="stable")]
            often = np.sort(often[np.cumsum(sizes[often]) <= self.MOST])
            self.lattice = lattice.chosen(place[often], sizes[often])
            self.data, self.hashes, self.sizes = own[_ranges(place[often], sizes[often])], hashes[often], sizes[often]
            self.starts = np.cumsum(self.sizes) - self.sizes
        return own, place, lattice


class Sampler:
    """Draws k distinct segmentations of each text of a chunk."""

    def __init__(self, pieces: Pieces, column: pa.Array, keys: np.ndarray, samples: int, alpha: float, units: Units | None = None):
        self.pieces, self.samples = pieces, samples
        data, offsets = words.buffers(column)
        self.n = len(offsets) - 1
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], SPACE)
        offsets = offsets + np.r_[0, np.cumsum(some)]
        space = data == SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][some]] = True
        starts = np.flatnonzero(opens)
        ends = np.r_[starts[1:], len(data)]
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        hashes, at, unit, counts = np.unique(words.span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        self.own, place, self.lattice = (units or Units(pieces, alpha)).build(data, starts[at], (ends - starts)[at], hashes, counts)
        self.start = place[unit]
        self.firsts = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.key = keys[self.doc] + _times(np.arange(len(starts)) - self.firsts[self.doc], 0x9E3779B97F4A7C15)
        self.doc_key = keys

    def _complete(self, unit: np.ndarray, place: np.ndarray, step: np.ndarray, sample: int):
        """Ancestral samples from a place in each unit to its end: unit, step, arc, sorted."""
        out = []
        while len(unit):
            u = _uniform(self.key[unit] + _times(step, 0xBF58476D1CE4E5B9) + np.uint64(sample * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF))
            arc = self.lattice.draw(place, u)
            out.append((unit, step, arc))
            on = self.lattice.inside[arc]
            unit, place, step = unit[on], self.lattice.last[arc[on]], step[on] + 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        unit, step, arc = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(unit, kind="stable")
        return unit[order], step[order], arc[order]

    def _noise(self, unit, step, phi, top, salt: int):
        """Noise of the best of some paths of total log probability phi, all of which are below top."""
        u = _uniform(self.key[unit] + _times(step, 0xBF58476D1CE4E5B9) + np.uint64(salt * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF))
        return phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))

    def _waiting(self, path, new: np.ndarray, noise: np.ndarray, sample: int):
        """The ways off the new part of each path: path entry, arcs taken there, and noise of the best of the others.

        All other arcs of a place wait as one; which of them it is, is drawn when their turn comes.
        """
        unit, step, arc, before = path
        many = np.diff(self.lattice.off)[self.lattice.first[arc]] > 1
        entry = np.flatnonzero(new & many)
        phi = before[entry] / UNIT + self.lattice.log_rest[arc[entry]]
        return entry, arc[entry][:, None], self._noise(unit[entry], step[entry], phi, noise[self.doc[unit[entry]]], sample + 101)

    def _turn(self, path, entry: np.ndarray, taken: np.ndarray, noise: np.ndarray, sample: int):
        """Draw the arc of each waiting way; and what then still waits there, as a part of the queue, by its place among them."""
        unit, step, arc, before = path
        if not len(entry):
            return entry, (entry, np.zeros((0, taken.shape[1] + 1), np.int64), noise)
        unit, step, place = unit[entry], step[entry], self.lattice.first[arc[entry]]
        low, high = self.lattice.off[place], self.lattice.off[place + 1]
        width = int((high - low).max(initial=0))
        arcs = low[:, None] + np.arange(width)
        free = (arcs < high[:, None]) & ~(arcs[:, :, None] == taken[:, None, :]).any(axis=2)
        mass = np.where(free, self.lattice.p[np.minimum(arcs, len(self.lattice.p) - 1)], 0.0)
        upto = np.cumsum(mass, axis=1)
        u = _uniform(self.key[unit] + _times(step, 0xBF58476D1CE4E5B9) + np.uint64((sample + 401) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF))
        past = (upto < (u * upto[:, -1])[:, None]) | ~free
        pick = np.argmin(past, axis=1)
        chosen = arcs[np.arange(len(entry)), pick]
        mass[np.arange(len(entry)), pick] = 0
        left = free.sum(axis=1) > 1
        phi = before[entry[left]] / UNIT + np.log(mass[left].sum(axis=1))
        again = self._noise(unit[left], step[left], phi, noise[left], sample + 701 + 100 * taken.shape[1])
        return chosen, (entry[left], np.concatenate([taken[left], chosen[left][:, None]], axis=1), again)

    def _summed(self, unit, step, arc):
        """A path with the log probability before each entry, within its document; and each document's total."""
        value = self.lattice.logp[arc]
        sums = np.r_[0, np.cumsum(value)]
        entry = np.searchsorted(self.doc[unit], np.arange(self.n + 1))
        return (unit, step, arc, sums[:-1] - sums[entry[self.doc[unit]]]), sums[entry[1:]] - sums[entry[:-1]]

    def run(self):
        """For each sample: (documents, ids, counts, log_prob, noise), then the noise at which each document's sample ends."""
        n_units = len(self.start)
        everything = np.arange(n_units)
        path, total = self._summed(*self._complete(everything, self.start.copy(), np.zeros(n_units, np.int64), 0))
        noise = -np.log(-np.log(_uniform(self.doc_key ^ np.uint64(0x5851F42D4C957F2D))))
        alive = np.ones(self.n, bool)
        paths, found, queue = [path], [(alive, total, noise)], []
        queue.append((0, *self._waiting(path, np.ones(len(path[0]), bool), noise, 0)))
        for sample in range(1, self.samples + 1):
            best = np.full(self.n, -np.inf)
            for which, entry, _, g in queue:
                np.maximum.at(best, self.doc[paths[which][0][entry]], g)
            alive = np.isfinite(best)
            if sample == self.samples:
                return paths, found, best
            parts, branch_unit, new_noise, more = [], np.full(self.n, -1), np.where(alive, best, 0.0), []
            for i, (which, entry, taken, g) in enumerate(queue):
                unit, step, arc, _ = paths[which]
                doc = self.doc[unit[entry]]
                hit = np.flatnonzero(g == best[doc])
                hit = hit[np.unique(doc[hit], return_index=True)[1]]
                hit = hit[branch_unit[doc[hit]] < 0]
                docs = doc[hit]
                e = entry[hit]
                chosen, rest = self._turn(paths[which], e, taken[hit], g[hit], sample)
                more.append((which, *rest))
                branch_unit[docs] = unit[e]
                limit = np.full(self.n, -1)
                limit[docs] = e
                inherit = np.flatnonzero(np.arange(len(unit)) < limit[self.doc[unit]])
                parts.append((unit[inherit], step[inherit], arc[inherit], np.zeros(len(inherit), bool)))
                parts.append((unit[e], step[e], chosen, np.zeros(len(e), bool)))
                on = self.lattice.inside[chosen]
                rest = self._complete(unit[e][on], self.lattice.last[chosen[on]], step[e][on] + 1, sample)
                parts.append((*rest, np.ones(len(rest[0]), bool)))
                keep = np.ones(len(g), bool)
                keep[hit] = False
                queue[i] = (which, entry[keep], taken[keep], g[keep])
            queue += more
            after = everything[alive[self.doc] & (everything > branch_unit[self.doc])]
            rest = self._complete(after, self.start[after], np.zeros(len(after), np.int64), sample)
            parts.append((*rest, np.ones(len(rest[0]), bool)))
            unit, step, arc, new = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((step, unit))
            path, total = self._summed(unit[order], step[order], arc[order])
            paths.append(path)
            found.append((alive, total, new_noise))
            queue.append((len(paths) - 1, *self._waiting(path, new[order], new_noise, sample)))

    def ids(self, path) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path and their number in each document; characters that are no piece as bytes."""
        unit, _, arc, _ = path
        piece, width = self.lattice.piece[arc], np.ones(len(arc), np.int64)
        spelt = piece < 0
        width[spelt] = (self.lattice.last - self.lattice.first)[arc[spelt]]
        out = np.repeat(piece, width)
        if spelt.any():
            ends = np.cumsum(width)
            at = np.repeat(self.lattice.first[arc[spelt]] - (np.cumsum(width[spelt]) - width[spelt]), width[spelt]) + np.arange(width[spelt].sum())
            to = np.repeat((ends - width)[spelt] - (np.cumsum(width[spelt]) - width[spelt]), width[spelt]) + np.arange(width[spelt].sum())
            out[to] = self.pieces.of_byte[self.own[at]]
        return out, np.bincount(self.doc[unit], width, self.n).astype(np.int64)


_pieces: dict[str, Pieces] = {}


def _vocabulary(model: str) -> Pieces:
    if model not in _pieces:
        _pieces[model] = Pieces(model)
        give_back()
    return _pieces[model]


ENCODED = "doc_id long, sample int, ids array<int>, log_prob double, inclusion double"


def encode_samples(docs: DataFrame, model: str, samples: int = 2, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row and sampled segmentation: doc_id, sample, ids, log_prob, inclusion.

    The ``samples`` segmentations of a text are distinct, drawn without replacement with probabilities that are
    its pieces' products to the power ``alpha``; fewer where a text has fewer. ``inclusion`` is the
    probability that a segmentation is among those above the noise at which the sample ends (1 where the
    sample is all there is). The noise comes from ``seed`` and the row's id alone, so reruns agree
    whatever the partitions. Nothing is shuffled; memory follows the chunk, or one text if that is longer.

    Null and empty texts have one sample, without ids. U+2581 counts as a space, as in the library. Rows
    without an id share one seed; repeated rows give equal samples. An empty table gives an empty
    result; other columns are ignored.
    """
    if samples < 1:
        raise ValueError("samples must be positive")

    def encode(part: pa.RecordBatch, pieces: Pieces, units: Units) -> Iterator[pa.RecordBatch]:
        text = pc.replace_substring(pc.fill_null(part.column("text"), ""), "▁", " ")
        ids = pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy().view(np.uint64)
        keys = words.mix(words.mix(ids + np.uint64(0xA0761D6478BD642F)) + np.uint64(seed * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
        sampler = Sampler(pieces, text, keys, samples, alpha, units)
        paths, found, ends = sampler.run()
        for k, (path, (alive, total, _)) in enumerate(zip(paths, found, strict=True)):
            flat, counts = sampler.ids(path)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
            logp = total / UNIT
            inclusion = np.where(np.isfinite(ends), -np.expm1(-np.exp(np.minimum(logp - np.where(np.isfinite(ends), ends, 0), 700))), 1.0)
            there = pa.array(alive)
            columns = (part.column("doc_id"), pa.array(np.full(sampler.n, k), pa.int32()), lists, pa.array(logp), pa.array(inclusion))
            yield pa.RecordBatch.from_arrays([c.filter(there) for c in columns], ["doc_id", "sample", "ids", "log_prob", "inclusion"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(model)
        units = Units(pieces, alpha)
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK_BYTES):
                yield from encode(part, pieces, units)  # a call for each, so that one chunk's lattices go before the next one's come
            give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(lean(run), ENCODED)


def decode_samples(encoded: DataFrame, model: str) -> DataFrame:
    """The encoded rows with ``text``, decoded from their ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
                data, offsets = pieces.decode(pc.list_flatten(ids).to_numpy().astype(np.int64), counts)
                text = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.large_string()).cast(pa.string())], [*part.schema.names, "text"])

    return encoded.mapInArrow(run, f"{ENCODED}, text string")
