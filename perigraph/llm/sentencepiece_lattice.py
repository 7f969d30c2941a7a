"""SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's lattice holds every way to cut it into vocabulary pieces; a segmentation weighs exp(alpha * sum of scores). The
segmentations with the largest Gumbel-perturbed log weights are a sample without replacement. They are found by A*
search: a region of the space (a fixed prefix, some next pieces excluded) has an upper bound that is reached within it,
the maximum of its Gumbels, so the region with the largest bound is opened next; opening it draws its best segmentation
and leaves one region for each step of it. Draws come from counters seeded by the row key, so they do not depend on how
rows are dealt.

Pieces never cross from a letter to a following space mark, so a text falls into units whose lattices are built once
for each distinct unit of a batch, and all units of a batch step forward together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, sliced, text_pieces

MARK = "▁"
ALPHA, SAMPLES = 1e-3, 2
#: Bytes of text whose lattices are held at once; a longer text is held alone.
CHUNK_BYTES = 1 << 18
#: Lattice edges of the units that a task keeps from one batch to the next, about, at 60 bytes; and units that it
#: remembers to have met once.
KEPT_EDGES, MET_UNITS = 1_500_000, 60_000
SLOT_BITS, POINT_BITS = 20, 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Strictly between 0 and 1."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


STEP = np.uint64(0x9E3779B97F4A7C15)


def salt(n: int) -> np.uint64:
    return np.uint64(n * int(STEP) & 0xFFFFFFFFFFFFFFFF)


class Vocabulary:
    """The pieces of a model as a trie. An edge's key is its state and its character, so a lookup is exact."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in range(size)])
        floor = scores[[i for i in usable if scores[i] > -1e8]].min(initial=0.0) - 1.0
        self.weights = alpha * np.maximum(scores, floor)
        self.fallback = alpha * floor  # for each byte of a character without a piece
        self.bytes = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, (pieces[i] for i in usable)))
        # The trie by numbers of characters: each step makes the states of all prefixes that are one longer.
        lengths = np.array([len(pieces[i]) for i in usable])
        points = np.frombuffer("".join(pieces[i] for i in usable).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins, states, n = np.append(0, np.cumsum(lengths))[:-1], np.zeros(len(usable), np.int64), 1
        keys, parents = [], []
        for at in range(self.longest):
            longer = np.flatnonzero(lengths > at)
            parents.append(states[longer])
            new, which = np.unique(states[longer] << POINT_BITS | points[begins[longer] + at], return_inverse=True)
            keys.append(new)
            states[longer], n = n + which, n + len(new)
        self.piece_at, self.inner = np.full(n, -1), np.zeros(n, bool)  # pieces by state, and whether a state goes on
        self.piece_at[states] = usable
        self.inner[np.concatenate(parents)] = True
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], order + 1
        # The first key of each slot, and whether a slot has others, which are then searched for.
        slots = self.slot(self.keys)
        self.first_in_slot, self.crowded = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1 << SLOT_BITS, bool)
        self.first_in_slot[slots[::-1]] = np.arange(len(slots))[::-1]
        ordered = np.sort(slots)
        self.crowded[ordered[1:][ordered[1:] == ordered[:-1]]] = True
        self.kept = Kept()
        self.joined = np.zeros(0x110000, bool)  # characters that stand in some longer piece
        crossing = [x for x in (pieces[i] for i in usable) if MARK in x.lstrip(MARK)]
        for i in usable:
            if len(pieces[i]) > 1:
                self.joined[[ord(c) for c in pieces[i]]] = True
        self.splits_at_marks = not crossing
        self.surface = pa.array([bytes([int(x[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)], pa.large_binary())

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def follow(self, states: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The states after these characters, -1 where no piece goes on so."""
        keys = states << POINT_BITS | points
        slots = self.slot(keys)
        at = self.first_in_slot[slots]
        out = np.where((at >= 0) & (self.keys[at] == keys), self.targets[at], -1)
        again = np.flatnonzero((out < 0) & self.crowded[slots])
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == keys[again], self.targets[at], -1)
        return out

    def expand(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with characters that have no piece (size + code point) spelled in bytes, or as the unknown piece; and how
        many ids precede each edge's, and all."""
        odd = np.flatnonzero(edges >= self.size)
        if not len(odd):
            return edges, np.arange(len(edges) + 1)
        kinds, which = np.unique(edges[odd], return_inverse=True)
        spelled = [[self.bytes[f"<0x{b:02X}>"] for b in chr(v - self.size).encode("utf-8", "surrogatepass")] if self.bytes else [self.model.unk_id()] for v in kinds.tolist()]
        counts = np.ones(len(edges), np.int64)
        counts[odd] = np.array([len(x) for x in spelled])[which]
        before, out = np.append(0, np.cumsum(counts)), np.repeat(edges, counts)
        for i, ids in enumerate(spelled):
            out[before[odd[which == i]][:, None] + np.arange(len(ids))] = ids
        return out, before

    def decode_all(self, ids: np.ndarray, places: np.ndarray) -> list[str]:
        """The texts of sequences of ids that end at places; the mark that every encoded text begins with is left out."""
        taken = self.surface.take(pa.array(ids, pa.int64()))
        data = taken.buffers()[2].to_pybytes() if len(ids) else b""
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.append(0, places)].tolist() if len(ids) else [0] * (len(places) + 1)
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x[1:] if x.startswith(" ") else x for x in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattices:
    """The lattices of distinct units: nodes are places between characters, edges are pieces with their probability."""

    def __init__(self, words: Vocabulary, points: np.ndarray, lengths: np.ndarray):
        offsets = np.append(0, np.cumsum(lengths))
        unit = np.repeat(np.arange(len(lengths)), lengths)
        ends = offsets[1:][unit]
        self.first = offsets[:-1] + np.arange(len(lengths))  # first node of each unit
        n_nodes = len(points) + len(lengths)
        node_of, wide = np.arange(len(points)) + unit, points.astype(np.int64)
        alive, states, runs, held = np.arange(len(points)), np.zeros(len(points), np.int64), [], np.zeros(len(points), np.int64)
        for size in range(1, words.longest + 1):
            if size > 1:
                going = np.flatnonzero(words.inner[states] & (alive + size <= ends[alive]))
                alive, states = alive[going], states[going]
            if not len(alive):
                break
            states = words.follow(states, wide[alive + size - 1])
            ids = np.where(states >= 0, words.piece_at[states], -1)
            if size == 1:
                missing = np.flatnonzero(ids < 0)
                value = wide[missing]
                ids[missing] = words.size + value
                weight = words.weights[np.minimum(ids, words.size - 1)]
                weight[missing] = (1 + (value >= 0x80) + (value >= 0x800) + (value >= 0x10000)) * words.fallback
                runs.append((alive, size, ids, weight, held.copy()))
                held += 1
            else:
                hit = np.flatnonzero(ids >= 0)
                at = alive[hit]
                runs.append((at, size, ids[hit], words.weights[ids[hit]], held[at]))
                held[at] += 1
            known = np.flatnonzero(states >= 0)
            alive, states = alive[known], states[known]
        # Edges stand by their start, then by their length.
        per_node = np.zeros(n_nodes, np.int64)
        per_node[node_of] = held
        self.begin = np.append(0, np.cumsum(per_node))
        n_edges = int(self.begin[-1])
        self.to, self.ids, weight, left = np.empty(n_edges, np.int64), np.empty(n_edges, np.int64), np.empty(n_edges), np.empty(n_edges, np.int64)
        remaining = ends - np.arange(len(points))
        for at, size, ids, own, place in runs:
            e = self.begin[node_of[at]] + place
            self.to[e], self.ids[e], weight[e], left[e] = node_of[at] + size, ids, own, remaining[at]
        self.node = node = np.repeat(np.arange(n_nodes), per_node)
        self.last = np.zeros(n_nodes, bool)
        self.last[offsets[1:] + np.arange(len(lengths))] = True
        # Log weight of all ways from a node to its unit's end, from the ends backwards.
        total = np.zeros(n_nodes)
        by_left = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, left.max(initial=0) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            e = by_left[a:b]
            value, own = weight[e] + total[self.to[e]], node[e]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top = np.maximum.reduceat(value, new)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(new, len(e))))), new)
            total[own[new]] = top + np.log(sums)
        self.log_p = weight + total[self.to] - total[node]
        p = np.exp(self.log_p)
        running = np.cumsum(p)
        before = np.append(0.0, running)[self.begin[node]]
        closing = self.begin[1:][self.begin[1:] > self.begin[:-1]] - 1
        self.key = node + np.minimum(running - before, 1.0)
        self.key[closing] = node[closing] + 1.0
        self.single = (self.begin[1:] - self.begin[:-1] == 1)[node]
        # The likeliest edge of each node is tried first, as it is drawn most often.
        opening = self.begin[:-1][self.begin[1:] > self.begin[:-1]]
        top = np.repeat(np.maximum.reduceat(self.log_p, opening), np.diff(np.append(opening, len(node)))) if len(opening) else self.log_p
        likeliest = np.flatnonzero(self.log_p == top)[::-1]
        self.likeliest, self.likeliest_p, self.likeliest_before = np.zeros(n_nodes, np.int64), np.zeros(n_nodes), np.zeros(n_nodes)
        self.likeliest[node[likeliest]] = likeliest
        e = self.likeliest[node[opening]]
        self.likeliest_p[node[opening]] = np.where(self.single[e], 1.0, p[e])
        self.likeliest_before[node[opening]] = self.key[e] - node[e] - p[e]
        # Log probability of all but the likeliest edge, summed from theirs, as it may be far below one.
        p[e] = 0.0
        self.likeliest_rest = np.full(n_nodes, -np.inf)
        with np.errstate(divide="ignore"):
            self.likeliest_rest[node[opening]] = np.log(np.add.reduceat(p, opening)) if len(opening) else 0.0

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log probability of all other edges at each edge's start."""
        node = self.node[edges]
        out, other = self.likeliest_rest[node], np.flatnonzero(self.likeliest[node] != edges)
        out[other] = np.log(-np.expm1(self.log_p[edges[other]]))
        return out

    def walk(self, nodes: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a way to the end from each node; edges of all ways in order, and how many each has."""
        active, now, found, step = np.arange(len(nodes)), nodes, [], 0
        counts = np.zeros(len(nodes), np.int64)
        while len(active):
            going = ~self.last[now]
            active, now = active[going], now[going]
            if not len(active):
                break
            u, edge = uniform(bases[active] + salt(2 * step)), self.likeliest[now]
            other = np.flatnonzero(u >= self.likeliest_p[now])
            if len(other):
                at = now[other]
                v = u[other] - self.likeliest_p[at]
                v = np.where(v >= self.likeliest_before[at], u[other], v)
                drawn = np.searchsorted(self.key, at + v, "left")
                edge[other] = np.minimum(np.maximum(drawn, self.begin[at]), self.begin[at + 1] - 1)
            found.append((active, edge))
            counts[active] += 1
            now, step = self.to[edge], step + 1
        offsets = np.append(0, np.cumsum(counts))
        out = np.zeros(offsets[-1], np.int64)
        for step, (active, edge) in enumerate(found):
            out[offsets[active] + step] = edge
        return out, counts


def lattices_of(words: Vocabulary, units: list[bytes], points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[Lattices, np.ndarray]:
    """Lattices that hold the distinct units, each at a place of points, and their first nodes.

    Those that the worker keeps are taken from there; the rest are built, and kept while there is room.
    """
    kept = words.kept
    first = np.array([kept.first.get(x, -1) for x in units], np.int64)
    new = np.flatnonzero(first < 0)
    new, again = kept.recurring_first(new, units)
    took = np.append(0, np.cumsum(lengths[new]))
    index = np.arange(took[-1]) - np.repeat(took[:-1] - starts[new], lengths[new])
    lattices, first[new] = kept.with_new(Lattices(words, points[index], lengths[new]), [units[i] for i in new[:again].tolist()])
    return lattices, first


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of these locations under the condition that none is above most."""
    with np.errstate(invalid="ignore"):
        return np.where(location == -np.inf, -np.inf, location - np.logaddexp(location - most, np.log(-np.log(u))))


class Kept:
    """Lattices of units that a task has met in two batches, and room after them for those of one batch."""

    SHIFTED = {"to": "node", "node": "node", "key": "node", "likeliest": "edge", "begin": "edge"}
    PER_EDGE = ("to", "node", "key", "ids", "log_p", "single")
    PER_NODE = ("likeliest", "begin", "last", "likeliest_p", "likeliest_before", "likeliest_rest")

    def __init__(self, most: int = KEPT_EDGES) -> None:
        self.most = most
        self.first: dict[bytes, int] = {}  # by the unit itself
        self.met: set[bytes] = set()
        self.nodes = self.edges = 0
        self.room: dict[str, np.ndarray] = {}

    def recurring_first(self, new: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, int]:
        """The new units in an order where those met in an earlier batch stand first, and how many these are."""
        if self.edges >= self.most:
            return new, 0
        again = np.array([units[i] in self.met for i in new.tolist()], bool)
        if len(self.met) > MET_UNITS:
            self.met.clear()
        self.met.update(units[i] for i in new[~again].tolist())
        return np.concatenate([new[again], new[~again]]), int(again.sum())

    def with_new(self, new: Lattices, units: list[bytes]) -> tuple[Lattices, np.ndarray]:
        """The kept lattices with new ones after them, and the new units' first nodes; the first units of them are kept."""
        out, shift = object.__new__(Lattices), {"node": self.nodes, "edge": self.edges}
        for name in (*self.PER_EDGE, *self.PER_NODE):
            own, start = getattr(new, name), self.edges if name in self.PER_EDGE else self.nodes
            own = own.astype(np.int32) if own.dtype == np.int64 else own
            if start + len(own) > len(self.room.get(name, ())):
                grown = np.empty(start + len(own) * 3 // 2, own.dtype)
                grown[:start] = self.room[name][:start] if start else 0
                self.room[name] = grown
            room = self.room[name][: start + len(own)]
            room[start:] = own + shift[self.SHIFTED[name]] if name in self.SHIFTED else own
            setattr(out, name, room)
        first = new.first + self.nodes
        if units:
            self.first.update(zip(units, first[: len(units)].tolist(), strict=True))
            nodes = int(new.first[len(units)]) if len(units) < len(new.first) else len(new.last)
            self.nodes, self.edges = self.nodes + nodes, self.edges + int(new.begin[nodes])
            if self.edges >= self.most:
                self.met.clear()
        return out, first


class Path:
    """One drawn segmentation of a text: its edges and their units; of the steps from own_from on, where its own regions
    begin, the log probability before each and of its region, and the bound of all regions together.

    The largest Gumbel of a set of regions is drawn at once, and which region has it only when it is opened.
    """

    def __init__(self, edges: np.ndarray, units: np.ndarray, value: float, own_from: int, log_p: float, prefix: np.ndarray, mass: np.ndarray, bound: float):
        self.edges, self.units, self.value, self.own_from, self.log_p, self.prefix, self.mass, self.bound = edges, units, value, own_from, log_p, prefix, mass, bound
        self.excluded: dict[int, list[int]] = {}


def rest_mass(lattices: Lattices, edge: int, excluded: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """The other edges at an edge's start that are not excluded, their log probabilities, and the log of their sum."""
    node = lattices.node[edge]
    others = np.array([e for e in range(lattices.begin[node], lattices.begin[node + 1]) if e not in excluded], np.int64)
    log_p = lattices.log_p[others]
    return others, log_p, float(np.logaddexp.reduce(log_p)) if len(others) else -np.inf


def sample_batch(words: Vocabulary, texts: list[str], keys: list[str], samples: int, seed: int) -> list[tuple[int, int, np.ndarray, float, float, float]]:
    """For each text and rank: text number, rank from 1, ids, log probability, perturbed value, inclusion probability."""
    normal = [x if x.startswith(MARK) or not x else x for x in (words.model.normalize(t) for t in texts)]
    points = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in normal], np.int64)
    text_starts = np.append(0, np.cumsum(sizes))
    if not len(points):
        return []
    cut = np.zeros(len(points) + 1, bool)
    cut[text_starts] = True
    if words.splits_at_marks:
        mark = points == ord(MARK)
        cut[:-1] |= mark & ~np.append(False, mark[:-1])
    alone = ~words.joined[points]
    cut[:-1] |= alone
    cut[1:] |= alone
    starts = np.flatnonzero(cut[:-1])
    lengths = np.diff(np.append(starts, len(points)))
    # Distinct units by their characters; each unit's lattice is built from one of its places.
    places = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))[np.append(starts, len(points))]
    encoded = pa.py_buffer("".join(normal).encode("utf-8", "surrogatepass"))
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), encoded]).dictionary_encode()
    kind = units.indices.to_numpy().astype(np.int64)
    first_place = np.zeros(len(units.dictionary), np.int64)
    first_place[kind[::-1]] = np.arange(len(kind))[::-1]
    lattices, first_of_kind = lattices_of(words, units.dictionary.to_pylist(), points, starts[first_place], lengths[first_place])

    unit_bounds = np.searchsorted(starts, text_starts)
    unit_text = np.repeat(np.arange(len(texts)), np.diff(unit_bounds))
    seeds = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) for k in keys], np.uint64)
    number = (np.arange(len(starts)) - unit_bounds[:-1][unit_text]).astype(np.uint64)
    first_node = first_of_kind[kind]

    def bases(rank: int, units: np.ndarray) -> np.ndarray:
        return mix(mix(seeds[unit_text[units]] + salt(rank + 1)) + number[units] * STEP)

    def draw(i: int, purpose: int) -> np.ndarray:
        return uniform(seeds[i : i + 1] + salt(purpose))

    def regions(owners: np.ndarray, edges: np.ndarray, cuts: np.ndarray, heads: np.ndarray, values: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the steps drawn for each owner (a text): log probability before each, and of its region; bound of all its
        regions, and log probability in all.

        cuts separate the owners' steps, heads are their log probabilities before the first, values their perturbed ones.
        """
        sizes = np.diff(cuts)
        sums = np.append(0.0, np.cumsum(lattices.log_p[edges]))
        before = sums[:-1] + np.repeat(heads - sums[cuts[:-1]], sizes)
        mass, total, full = before + lattices.rest(edges), np.full(len(owners), -np.inf), np.flatnonzero(sizes)
        if len(full):
            first = cuts[:-1][full]
            top = np.maximum.reduceat(mass, first)
            top[top == -np.inf] = 0.0
            with np.errstate(divide="ignore"):
                total[full] = top + np.log(np.add.reduceat(np.exp(mass - np.repeat(top, sizes[full])), first))
        bounds = truncated_gumbel(total, values, uniform(seeds[owners] + salt(1000 + rank)))
        return before, mass, bounds, heads + sums[cuts[1:]] - sums[cuts[:-1]]

    all_units = np.arange(len(starts))
    edges, counts = lattices.walk(first_node, bases(0, all_units))
    owners = np.flatnonzero(sizes)
    cuts = np.append(0, np.cumsum(np.bincount(unit_text, weights=counts, minlength=len(texts))[owners])).astype(np.int64)
    unit_of_step = np.repeat(all_units, counts)
    found: list[list[Path]] = [[] for _ in texts]
    root = -np.log(-np.log(uniform(seeds[owners])))
    before, mass, bounds, log_p = regions(owners, edges, cuts, np.zeros(len(owners)), root, 0)
    for j, (i, a, b) in enumerate(zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        found[i].append(Path(edges[a:b], unit_of_step[a:b], float(root[j]), 0, float(log_p[j]), before[a:b], mass[a:b], float(bounds[j])))

    def best_path(i: int) -> Path:
        return max(found[i], key=lambda path: path.bound)

    def pick(weights: np.ndarray, i: int, purpose: int) -> int:
        """A place by log weights."""
        running = np.cumsum(np.exp(weights - weights.max()))
        return min(int(np.searchsorted(running, draw(i, purpose)[0] * running[-1])), len(weights) - 1)

    open_texts = owners.tolist()
    for rank in range(1, samples):
        begun = []
        for i in open_texts:
            path = best_path(i)
            bound = path.bound
            if bound == -np.inf:
                continue
            at = pick(path.mass, i, 4000 + rank)
            step = path.own_from + at
            excluded = path.excluded.setdefault(step, [int(path.edges[step])])
            others, log_p, _ = rest_mass(lattices, int(path.edges[step]), excluded)
            chosen = int(others[pick(log_p, i, 2000 + rank)])
            excluded.append(chosen)
            _, _, left = rest_mass(lattices, int(path.edges[step]), excluded)
            before = float(path.prefix[at])
            path.mass[at] = before + left
            top = path.mass.max()
            total = top + np.log(np.exp(path.mass - top).sum()) if top > -np.inf else -np.inf
            path.bound = float(truncated_gumbel(total, bound, draw(i, 3000 + rank)[0]))
            begun.append((i, path, step, chosen, bound, int(path.units[step]), before + float(lattices.log_p[chosen])))
        if not begun:
            break
        # The rest of the opened unit and all later units of each text are drawn anew, all texts together.
        tails = [np.arange(x[5], unit_bounds[x[0] + 1]) for x in begun]
        units = np.concatenate(tails)
        nodes = first_node[units].copy()
        heads = np.append(0, np.cumsum([len(t) for t in tails]))
        nodes[heads[:-1]] = lattices.to[[x[3] for x in begun]]
        edges, counts = lattices.walk(nodes, bases(rank, units))
        cuts = np.append(0, np.cumsum(counts))[heads]
        unit_of_step = np.repeat(units, counts)
        open_texts = [x[0] for x in begun]
        before, mass, bounds, log_p = regions(np.array(open_texts), edges, cuts, np.array([x[6] for x in begun]), np.array([x[4] for x in begun]), rank)
        for j, ((i, path, step, chosen, bound, unit, _), a, b) in enumerate(zip(begun, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            whole, own_units = np.concatenate([path.edges[:step], [chosen], edges[a:b]]), np.concatenate([path.units[:step], [unit], unit_of_step[a:b]])
            found[i].append(Path(whole, own_units, bound, step + 1, float(log_p[j]), before[a:b], mass[a:b], float(bounds[j])))

    drawn = [(i, rank, path) for i, paths in enumerate(found) for rank, path in enumerate(paths, 1)]
    ids, before = words.expand(lattices.ids[np.concatenate([path.edges for _, _, path in drawn])])
    ends = before[np.cumsum([len(path.edges) for _, _, path in drawn])]
    thresholds, out = {i: best_path(i).bound for i in owners.tolist()}, []
    for (i, rank, path), a, b in zip(drawn, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        inclusion = 1.0 if thresholds[i] == -np.inf else float(-np.expm1(-np.exp(min(path.log_p - thresholds[i], 700.0))))
        out.append((i, rank, ids[a:b], path.log_p, path.value, inclusion))
    return out


def sample_segmentations(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, with_ids: bool = True, packed_ids: bool = False, chunk_bytes: int = CHUNK_BYTES, kept_edges: int = KEPT_EDGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and sample: doc_id, sample (rank from 1), n_pieces, log_prob, perturbed, inclusion,
    ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives back the text), and ids if asked:
    as an array, or packed, as those numbers in one binary, which costs Spark a good deal less.

    perturbed falls with rank. inclusion is the probability that a segmentation is among those sampled, given the value
    that the next one has; it is 1 where no other is left. A text with fewer segmentations than samples gives each once.
    A null or empty text, or one that the model's normaliser empties, has one empty segmentation (no piece, probability 1). The row key is the id; rows that repeat
    an id and its text get the same samples. A worker holds the lattices of chunk_bytes of text and of kept_edges edges of
    recurring units; neither changes a result. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    texts = text_pieces(docs, id_col, text_col)
    fields = [("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()), *[("ids", None)] * with_ids]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, alpha)
        words.kept = Kept(kept_edges)
        for batch in rows:
            for part in sliced(batch, 1, chunk_bytes):
                own, keys = part.column(1).to_pylist(), ["" if x is None else str(x) for x in part.column(0).to_pylist()]
                drawn = sample_batch(words, own, keys, samples, seed)
                # A text without characters, or with none left by the model's normaliser, has the empty segmentation alone.
                bare = sorted(set(range(len(own))).difference(x[0] for x in drawn))
                seeds = np.array([xxhash.xxh64_intdigest(keys[i].encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) for i in bare], np.uint64)
                drawn += [(i, 1, np.zeros(0, np.int64), 0.0, value, 1.0) for i, value in zip(bare, (-np.log(-np.log(uniform(seeds)))).tolist(), strict=True)]
                places = np.cumsum([len(x[2]) for x in drawn])
                flat = np.concatenate([np.zeros(0, np.int64), *[x[2] for x in drawn]])
                texts, packed = words.decode_all(flat, places), flat.astype("<i4")
                bounds = np.append(0, places).tolist()
                blobs = [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                table = [(x[1], len(x[2]), x[3], x[4], x[5], hashlib.sha256(blob).hexdigest(), text == own[x[0]]) for x, blob, text in zip(drawn, blobs, texts, strict=True)]
                arrays = [pa.array([r[k] for r in table], kind) for k, (_, kind) in enumerate(fields[: len(fields) - with_ids])]
                if with_ids:
                    arrays.append(pa.array(blobs, pa.binary()) if packed_ids else pa.ListArray.from_arrays(np.array(bounds, np.int32), packed.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([x[0] for x in drawn], pa.int64())), *arrays], names=["doc_id", *[n for n, _ in fields]])
        words.kept = Kept()
        release_memory()

    ids_type = ", ids " + ("binary" if packed_ids else "array<int>") if with_ids else ""
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean{ids_type}")


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of sequences of ids, arrays or packed; null ids give a null text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, ALPHA)
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else words.decode(np.frombuffer(x, "<i4") if isinstance(x, bytes) else np.array(x, np.int64)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    own = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
