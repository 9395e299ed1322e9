"""SentencePiece encoding and decoding, and sampled segmentations.

Encoding and decoding use a given public model.  Beside the best
segmentation, ``samples`` distinct ones are drawn without replacement by
Gumbel top-k over the lattice of all segmentations:

* A piece's weight is its Zipf share by rank; the probability of a
  segmentation is proportional to the product over its pieces (a character
  that is no piece goes through its bytes).  No piece holds a space after
  another character, so the lattice of a text is a chain of lattices of its
  space-led chunks; backward sums are computed once per distinct chunk.
* A* search over prefixes: a node of the search tree is a set of
  segmentations with a common prefix, its priority the largest Gumbel-perturbed
  log-probability in it.  The root's best leaf is an exact sample; the
  branches that leave its path get truncated Gumbel maxima.  The best open
  branch gives the next sample, and so on, so samples are distinct and come
  in order of perturbed log-probability.
* The inclusion score of a sample is the probability that it is among the
  top k, given the (k+1)-th perturbed value: 1 - exp(-exp(logp - kappa)).

Random numbers are hashes of (row key, sample, chunk, step): a row's samples do
not depend on its neighbours, partitioning or retries.

Defined results: null counts as empty; an empty text has no pieces and one,
empty, segmentation; a text with fewer than k segmentations has all of them,
with score 1; U+2581 counts as a space, as in the model; rows with a null id
share one key; repeated rows get the same result; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, keyed, unkeyed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
#: Bytes of text sampled at once.
LATTICE_BYTES = 512 << 10
#: Bytes of new chunks whose lattices are made at once.
BLOCK_BYTES = 64 << 10
#: Lattice edges (28 bytes each) that a task keeps for its next slices.
MAX_EDGES = 1_000_000
#: Ids (4 bytes each) that a task keeps, each chunk's entry counted as 6 more.
MAX_IDS = 4_000_000
#: Bits of a number that orders edges; what needs more is ordered by two.
KEY_BITS = 63
BYTE_PENALTY = 4.0
SPACE_MARK = "▁"
#: Steps of a path whose branches are looked at whatever their random numbers.
BRANCHES = 64

_rng = np.random.default_rng(31)
STEP_A, STEP_B, STEP_C = (np.uint64(x) | np.uint64(1) for x in _rng.integers(1, 1 << 63, 3, dtype=np.uint64))


def counters(seed: np.ndarray, sample: int, chunk: np.ndarray) -> np.ndarray:
    """A hashed counter per (row, sample, chunk)."""
    return K.mix(seed + K.mix(np.full(1, sample, np.uint64) * STEP_A + chunk.astype(np.uint64) * STEP_B))


def uniform(counter: np.ndarray, step) -> np.ndarray:
    """Uniform numbers in (0, 1) from counters and steps."""
    return fraction(K.mix(counter + np.asarray(step, np.uint64).reshape(-1) * STEP_C))


def fraction(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64 random bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Inventory:
    """Pieces by length and hash, with log weights."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        surface = [sp.id_to_piece(i).replace(SPACE_MARK, " ") for i in normal]
        rank = np.arange(1, len(normal) + 1)
        self.weight = np.full(sp.get_piece_size(), -np.log(len(normal)) - BYTE_PENALTY)
        self.weight[normal] = -np.log(rank) - np.log((1 / rank).sum())
        # hashes grow byte by byte; ``prefix`` tells which may still grow into a piece
        raw, off = K.utf8(pa.array(surface, pa.large_string()))
        size = np.diff(off)
        # -2: neither a piece nor the start of one; -1: some start or several
        # pieces; else the only piece of the slot
        self.by_size, self.only = {}, np.full(1 << 21, -2, dtype=np.int32)
        h, rest = np.zeros(len(normal), np.uint64), np.arange(len(normal))
        for n in range(1, int(size.max()) + 1):
            rest = rest[size[rest] >= n]
            h[rest] = self.grown(h[rest], raw[off[:-1][rest] + n - 1])
            slot = self.slot(h[rest])
            self.only[slot[self.only[slot] == -2]] = -1
            mine = rest[size[rest] == n]
            mine = mine[np.argsort(h[mine])]
            self.by_size[n] = (h[mine], np.array(normal)[mine])
        whole = np.concatenate([x for x, _ in self.by_size.values()])
        ids = np.concatenate([x for _, x in self.by_size.values()])
        self.hash_of = np.zeros(sp.get_piece_size(), np.uint64)
        self.hash_of[ids] = whole
        slot, count = np.unique(self.slot(whole), return_counts=True)
        alone = np.isin(self.slot(whole), slot[count == 1])
        self.only[self.slot(whole[alone])] = ids[alone]
        # slots of several pieces, which are looked up by size
        self.shared = np.zeros(1 << 21, dtype=bool)
        self.shared[slot[count > 1]] = True
        # the bytes that each piece stands for; 0xFF is in no text
        bytes_of = [b"\xff"] * sp.get_piece_size()
        for i, x in zip(normal, surface):
            bytes_of[i] = x.encode()
        for b in range(256):
            bytes_of[sp.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        self.bytes_size = np.array([len(x) for x in bytes_of])
        self.bytes_first = np.cumsum(self.bytes_size) - self.bytes_size
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.mark = sp.piece_to_id(SPACE_MARK)
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        lead = np.arange(256)
        self.char_size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4).astype(np.int8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces, one after the other."""
        size = self.bytes_size[ids]
        return self.bytes[np.repeat(self.bytes_first[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    @staticmethod
    def grown(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return (h + K.BYTE_CODE[byte]) * K.BASE

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << 21) - 1)).astype(np.int64)


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype, start: np.ndarray = ()):
        self.space, self.size = np.array(start, dtype), len(start)

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.space):
            space = np.empty(max(need, len(self.space) * 3 // 2), self.space.dtype)
            space[: self.size] = self.space[: self.size]
            self.space = space
        self.space[self.size : need] = more
        self.size = need

    def replace(self, values: np.ndarray) -> None:
        """Hold these (as many as before at most), without giving up space."""
        self.size = len(values)
        self.space[: self.size] = values

    @property
    def values(self) -> np.ndarray:
        return self.space[: self.size]


class Lattice:
    """All segmentations of distinct chunks.  Node: byte position + number of
    the chunk, so that a chunk's end is no other chunk's start.  Chunks may be
    added later; what is there keeps its numbers.  ``then``: the first edge
    that leaves an edge's end, -1 where the chunk ends there."""

    EDGES = {"node": np.int32, "then": np.int32, "piece": np.int32, "logq": np.float64, "reach": np.float64}
    NODES = {"first": np.int32, "stop": np.int32, "is_end": bool}

    def __init__(self, pieces: Inventory, raw: np.ndarray | None = None, off: np.ndarray | None = None):
        self.pieces = pieces
        self.parts = {name: Growing(dtype) for name, dtype in (self.EDGES | self.NODES | {"chunk_node": np.int64}).items()}
        self.show()
        if raw is not None:
            self.add(raw, off)

    def show(self) -> None:
        for name, part in self.parts.items():
            setattr(self, name, part.values)

    def add(self, raw: np.ndarray, off: np.ndarray) -> None:
        """Append the lattices of the chunks raw[off[i] : off[i + 1]]."""
        a, chunks = 0, len(off) - 1
        while a < chunks:
            b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, side="right")) - 1)
            edges, nodes = self.parts["node"].size, self.parts["first"].size
            block = self.block(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            for name in ("node", "chunk_node"):
                block[name] += nodes
            for name in ("first", "stop"):
                block[name] += edges
            block["then"][block["then"] >= 0] += edges
            for name, part in self.parts.items():
                part.extend(block[name])
            a = b
        self.show()

    @property
    def to(self) -> np.ndarray:
        """The node at each edge's end."""
        return self.ends(np.arange(len(self.node)))

    def ends(self, edges):
        return self.node[edges] + self.pieces.bytes_size[self.piece[edges]]

    def edges_of(self) -> np.ndarray:
        """Number of edges of each chunk."""
        if not len(self.chunk_node):
            return np.zeros(0, np.int64)
        return np.add.reduceat((self.stop - self.first).astype(np.int64), self.chunk_node)

    def keep(self, chunks: np.ndarray) -> None:
        """Drop all chunks but the marked ones, which are numbered anew."""
        nodes_of = np.diff(np.append(self.chunk_node, len(self.first)))
        nodes = np.repeat(chunks, nodes_of)
        edges = nodes[self.node]
        new_node, new_edge = np.cumsum(nodes) - 1, np.cumsum(edges) - 1
        size = (self.stop - self.first)[nodes]
        kept = {name: getattr(self, name)[edges] for name in self.EDGES}
        kept["node"] = new_node[kept["node"]]
        kept["then"] = np.where(kept["then"] < 0, -1, new_edge[kept["then"]])
        kept["first"] = np.where(size > 0, new_edge[np.minimum(self.first[nodes], max(0, len(edges) - 1))] if len(edges) else 0, 0)
        kept["stop"] = kept["first"] + size
        kept["is_end"] = self.is_end[nodes]
        kept["chunk_node"] = np.cumsum(nodes_of[chunks]) - nodes_of[chunks]
        for name, part in self.parts.items():
            part.replace(kept[name])
        self.show()

    def block(self, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        pieces = self.pieces
        n, chunks = len(raw), len(off) - 1
        chunk = np.repeat(np.arange(chunks), np.diff(off))
        left = off[1:][chunk] - np.arange(n)  # bytes to the end of the chunk
        # one order serves all: by distance to the chunk's end, then by node, the
        # longest (mostly the likeliest) piece first; the last bits hold the piece
        longest_piece = max(pieces.by_size)
        bits = len(pieces.bytes_size).bit_length()
        low = bits + longest_piece.bit_length()
        high = low + (n + chunks).bit_length()
        packed = high + int(left.max(initial=0)).bit_length() <= KEY_BITS
        place = ((left << high) if packed else 0) | ((np.arange(n) + chunk) << low)

        def edges(begin: np.ndarray, length: int, piece: np.ndarray) -> np.ndarray:
            return place[begin] | ((longest_piece - length) << bits) | piece

        single = np.zeros(n, dtype=bool)
        size = pieces.char_size[raw]
        at = np.flatnonzero(size > 0)
        h = np.zeros(len(at), np.uint64)
        longest = left[at]
        keys = []
        for length, (known, known_id) in pieces.by_size.items():
            keep = np.flatnonzero(longest >= length)
            if not len(keep):
                break
            if len(keep) < len(at):
                at, h, longest = at[keep], h[keep], longest[keep]
            h = pieces.grown(h, raw[at + (length - 1)])
            slot = pieces.slot(h)
            found = pieces.only[slot]
            keep = np.flatnonzero(found > -2)
            at, h, slot, found, longest = at[keep], h[keep], slot[keep], found[keep], longest[keep]
            several = np.flatnonzero(pieces.shared[slot])
            hit = np.flatnonzero(found >= 0)
            hit = hit[pieces.hash_of[found[hit]] == h[hit]]
            if len(several) and len(known):
                entry = K.lookup(known, h[several])
                found[several[entry >= 0]] = known_id[entry[entry >= 0]]
                hit = np.concatenate([hit, several[entry >= 0]])
            begin = at[hit]
            if length <= 4:
                single[begin[size[begin] == length]] = True
            keys.append(edges(begin, length, found[hit]))
        # characters that are no piece: one piece per byte
        at = np.flatnonzero(~single & (size > 0))
        for j in range(4):
            b = at[size[at] > j] + j
            keys.append(edges(b, 1, pieces.byte_id[raw[b]]))
        key = np.concatenate(keys)
        del keys, place, h, at, longest
        if packed:
            key.sort()
            away = key >> high
            node = (key >> low) & ((1 << (high - low)) - 1)
        else:
            node = key >> low
            # chunk i begins at node off[i] + i
            away = left[node - (np.searchsorted(off[:-1] + np.arange(chunks), node, side="right") - 1)]
            order = np.lexsort((key, away))
            key, node, away = key[order], node[order], away[order]
        piece = (key & ((1 << bits) - 1)).astype(np.int32)
        to = node + pieces.bytes_size[piece]
        del key
        group = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(away) else np.zeros(0, np.int64)
        size = np.diff(np.append(group, len(away)))
        first, stop = np.zeros(n + chunks, np.int64), np.zeros(n + chunks, np.int64)
        first[node[group]], stop[node[group]] = group, group + size
        is_end = np.zeros(n + chunks, dtype=bool)
        is_end[off[1:] + np.arange(chunks)] = True
        weight = pieces.weight[piece]
        beta = np.full(n + chunks, -np.inf)
        beta[is_end] = 0
        # backward sums, from the chunks' ends
        edge = np.searchsorted(away, np.arange(1, (int(away[-1]) if len(away) else 0) + 2))
        of = np.searchsorted(group, edge)
        for a, b, ga, gb in zip(edge[:-1].tolist(), edge[1:].tolist(), of[:-1].tolist(), of[1:].tolist()):
            if a < b:
                at = group[ga:gb] - a
                v = weight[a:b] + beta[to[a:b]]
                top = np.maximum.reduceat(v, at)
                beta[node[group[ga:gb]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size[ga:gb])), at))
        logq = weight + beta[to] - beta[node]
        q = np.exp(logq)
        total = np.concatenate([[0], np.cumsum(q)])
        reach = total[1:] - np.repeat(total[group], size)
        reach[group + size - 1] = 2.0
        return {"node": node, "then": np.where(is_end[to], -1, first[to]), "piece": piece, "logq": logq, "reach": reach,
                "first": first, "stop": stop, "is_end": is_end, "chunk_node": off[:-1] + np.arange(chunks)}

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Log-probability of leaving an edge's node by another edge."""
        node = self.node[edges]
        with np.errstate(divide="ignore"):
            return np.where(self.stop[node] - self.first[node] == 1, -np.inf, np.log(np.maximum(1 - np.exp(self.logq[edges]), 0)))

    def walk(self, node: np.ndarray, counter: np.ndarray, step: np.ndarray):
        """Sample each chunk from a node to its end: edges of all walks one
        after the other, and where each walk begins."""
        active = np.flatnonzero(~self.is_end[node])
        e, counter, seen, count = self.first[node[active]].astype(np.int64), counter[active] + step[active] * STEP_C, [], np.zeros(len(node), np.int64)
        while len(active):
            u = fraction(K.mix(counter))
            over = np.flatnonzero(u > self.reach[e])
            while len(over):
                e[over] += 1
                over = over[u[over] > self.reach[e[over]]]
            seen.append((active, e))
            count[active] += 1
            then = self.then[e]
            go = np.flatnonzero(then >= 0)
            active, e, counter = active[go], then[go].astype(np.int64), counter[go] + STEP_C
        begin = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(begin[-1], np.int64)
        for t, (a, e) in enumerate(seen):
            flat[begin[a] + t] = e
        return flat, begin


def truncated(log_mass: np.ndarray, limit, u: np.ndarray) -> np.ndarray:
    """Gumbel maxima of sets of a log mass, given that they are below ``limit``."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = limit - log_mass
        exponential = -np.log(u)
        near = limit - np.log1p(exponential * np.exp(gap))
        # where the limit is far above the mass it does not matter
        far = np.flatnonzero(gap > 600)
        near[far] = log_mass[far] - np.log(exponential[far])
    return near


class Path:
    """One sampled segmentation of one text, and its open branches (the
    largest perturbed value in each, from step ``branch`` on, where it may be
    among the path's best).  ``branch``: the
    step at which it left an earlier path; ``excluded``: the edges already taken
    there."""

    __slots__ = ("edges", "chunk", "value", "log_prob", "open", "branch", "excluded")

    def __init__(self, edges, chunk, value, branch: int, excluded: tuple[int, ...]):
        self.edges, self.chunk, self.value, self.branch, self.excluded = edges, chunk, value, branch, excluded


def open_branches(lattice: Lattice, paths: list[Path], seeds: np.ndarray, sample: int, k: int) -> None:
    """Fill in log-probability and open branches of new paths, all at once.
    Branches before the step at which a path left another belong to that one.

    Of a path's branches the best k are wanted.  A branch's mass is at most
    that of the path up to it, which falls from step to step: after the first
    ``BRANCHES`` steps only those are looked at (the others count as closed)
    whose random number is large enough to be among the best k at the mass
    that is left there."""
    sizes = np.array([len(p.edges) for p in paths])
    branch = np.array([p.branch for p in paths])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.concatenate([p.edges for p in paths])
    total = np.concatenate([[0.0], np.cumsum(lattice.logq[edges])])
    own = sizes - branch
    counter = counters(seeds, sample, np.full(len(paths), 1 << 40))
    value = np.array([p.value for p in paths])
    block = max(BRANCHES, k)

    def steps(path: np.ndarray, start: np.ndarray):
        """Path, own step, and random number in blocks of steps."""
        size = np.minimum(own[path] - start, block)
        of = np.repeat(path, size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - start, size)
        return of, step, uniform(counter[of], step + branch[of])

    def masses(of: np.ndarray, step: np.ndarray) -> np.ndarray:
        at = begin[of] + branch[of] + step
        return total[at] - total[begin[of]] + lattice.log_rest(edges[at])

    every = np.arange(len(paths))
    of, step, u = steps(every, np.zeros(len(paths), np.int64))
    mass = masses(of, step)
    place = np.searchsorted(of, np.arange(len(paths) + 1)).tolist()
    for i, p in enumerate(paths):
        p.log_prob = float(total[begin[i + 1]] - total[begin[i]])
        if p.excluded:
            left = left_edges(lattice, p.edges[p.branch], {*p.excluded, int(p.edges[p.branch])})
            rest = np.log(np.exp(lattice.logq[left]).sum()) if len(left) else -np.inf
            mass[place[i]] = total[begin[i] + p.branch] - total[begin[i]] + rest
    found = truncated(mass, value[of], u)

    best = np.full((len(paths), block), -np.inf)
    best[of, step] = mass - np.log(-np.log(u))
    best = np.partition(best, block - k, axis=1)[:, block - k]
    more = np.maximum(-(-own // block) - 1, 0)
    path = np.repeat(every, more)
    start = (np.arange(len(path)) - np.repeat(np.cumsum(more) - more, more) + 1) * block
    ahead = total[begin[path] + branch[path] + start] - total[begin[path]] - best[path] + 1e-6
    able = np.flatnonzero(ahead > -37)  # random numbers end at 1 - 2**-53
    path, start, ahead = path[able], start[able], ahead[able]
    of, step, u = steps(path, start)
    with np.errstate(over="ignore"):
        least = np.repeat(np.exp(-np.exp(ahead)), np.minimum(own[path] - start, block))
    far = np.flatnonzero(u >= least)
    of, step, u = of[far], step[far], u[far]
    late = truncated(masses(of, step), value[of], u) if len(far) else np.zeros(0)
    edge = np.searchsorted(of, np.arange(len(paths) + 1)).tolist()
    for i, p in enumerate(paths):
        p.open = found[place[i] : place[i + 1]]
        if edge[i] < edge[i + 1]:
            p.open = np.concatenate([p.open, np.full(int(own[i]) - block, -np.inf)])
            p.open[step[edge[i] : edge[i + 1]]] = late[edge[i] : edge[i + 1]]


def left_edges(lattice: Lattice, edge: int, out) -> np.ndarray:
    """Edges that leave the same node as an edge, without some."""
    node = lattice.node[edge]
    return np.array([e for e in range(lattice.first[node], lattice.stop[node]) if e not in out], dtype=np.int64)


def sampled(lattice: Lattice, instance: np.ndarray, doc: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """Up to k distinct segmentations of each text, and the next perturbed
    value.  instance: distinct chunk at each place; doc: where texts begin."""
    sizes = np.diff(doc)
    local = np.arange(len(instance)) - np.repeat(doc[:-1], sizes)
    flat, begin = lattice.walk(lattice.chunk_node[instance], counters(np.repeat(seeds, sizes), 1, local), np.zeros(len(instance), np.uint64))
    piece_chunk = np.repeat(local, np.diff(begin))
    root = -np.log(-np.log(uniform(counters(seeds, 0, np.zeros(len(seeds))), 0)))
    edge = begin[doc]
    paths = [[Path(flat[a:b], piece_chunk[a:b], float(g), 0, ())] for a, b, g in zip(edge[:-1], edge[1:], root)]
    open_branches(lattice, [own[0] for own in paths], seeds, 1, k)
    kappa = np.full(len(sizes), -np.inf)
    for sample in range(2, k + 2):
        todo = []
        for d, own in enumerate(paths):
            if len(own) == sample - 1 and sizes[d]:
                at = [int(p.open.argmax()) for p in own]
                value = [p.open[i] for p, i in zip(own, at)]
                best = value.index(max(value))
                if value[best] > -np.inf:
                    todo.append((d, own[best], own[best].branch + at[best]))
        if sample == k + 1:  # only the next perturbed value is wanted
            for d, path, at in todo:
                kappa[d] = path.open[at - path.branch]
            break
        if not todo:
            continue
        docs = np.array([d for d, _, _ in todo])
        pick = uniform(counters(seeds[docs], sample, np.full(len(docs), 1 << 41)), [at for _, _, at in todo])
        walks, heads = [], []
        for (d, path, at), u in zip(todo, pick.tolist()):
            edge = int(path.edges[at])
            out = (*path.excluded, edge) if at == path.branch else (edge,)
            left = left_edges(lattice, edge, out)
            c = np.cumsum(np.exp(lattice.logq[left]))
            chosen = int(left[min(np.searchsorted(c, u * c[-1], side="right"), len(left) - 1)])
            rest = np.arange(int(path.chunk[at]), sizes[d])
            nodes = lattice.chunk_node[instance[doc[d] + rest]]
            nodes[0] = lattice.ends(chosen)
            heads.append((path, at, out, chosen))
            walks.append((nodes, rest))
        lengths = np.array([len(r) for _, r in walks])
        place = np.concatenate([[0], np.cumsum(lengths)])
        chunk = np.concatenate([r for _, r in walks])
        steps = np.zeros(len(chunk), np.uint64)
        steps[place[:-1]] = 1 << 20
        flat, begin = lattice.walk(np.concatenate([n for n, _ in walks]), counters(np.repeat(seeds[docs], lengths), sample, chunk), steps)
        new_chunk = np.repeat(chunk, np.diff(begin))
        edge = begin[place]
        new = []
        for (path, at, out, chosen), a, b in zip(heads, edge[:-1], edge[1:]):
            new.append(Path(np.concatenate([path.edges[:at], [chosen], flat[a:b]]), np.concatenate([path.chunk[: at + 1], new_chunk[a:b]]),
                            float(path.open[at - path.branch]), at, out))
            path.open[at - path.branch] = -np.inf
        open_branches(lattice, new, seeds[docs], sample, k)
        for d, p in zip(docs.tolist(), new):
            paths[d].append(p)
    return list(zip(paths, kappa.tolist()))


class Slice(NamedTuple):
    """The chunks of a slice of texts: the known number of each, its number
    in the lattice, and where each text's begin."""

    chunk: np.ndarray
    instance: np.ndarray
    doc: np.ndarray


def most_seen(seen: np.ndarray, weight: np.ndarray, limit: int) -> np.ndarray:
    """Marks what most slices held, two at least, up to a weight."""
    least = 2
    while weight[seen >= least].sum() > limit:
        least += 1
    return seen >= least


class Chunks:
    """The distinct space-led chunks that a task has met (each text is led by
    one more space), with their lattices and the model's ids.  Most chunks of
    a slice are known from earlier ones.  Beyond ``MAX_EDGES`` the lattices of
    those that few slices held are forgotten, beyond ``MAX_IDS`` (ids take far
    less) their ids too, so the memory held is bounded; results do not depend
    on what is known."""

    def __init__(self, pieces: Inventory, sp=None, lattices: bool = True):
        self.pieces, self.sp = pieces, sp
        self.lattice = Lattice(pieces) if lattices else None
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self.seen = Growing(np.int32)  # in how many slices
        self.placed = Growing(np.int32)  # number in the lattice, -1 if it has none there
        self.ids, self.begin, self.same = Growing(np.int32), Growing(np.int32, [0]), Growing(bool)

    def forget(self) -> None:
        """Keep the chunks that most slices held, half of the limits at most."""
        if self.lattice is not None and len(self.lattice.node) > MAX_EDGES:
            have = np.flatnonzero(self.placed.values >= 0)
            seen = np.zeros(len(have), np.int32)
            seen[self.placed.values[have]] = self.seen.values[have]
            self.keep_lattices(most_seen(seen, self.lattice.edges_of(), MAX_EDGES // 2))
        if self.ids.size + 6 * len(self.numbers) > MAX_IDS:
            n_ids = np.diff(self.begin.values) if self.sp is not None else np.zeros(len(self.numbers), np.int32)
            keep = most_seen(self.seen.values, n_ids + 6, MAX_IDS // 2)
            if self.lattice is not None:
                gone = self.placed.values[~keep]
                lattices = np.ones(len(self.lattice.chunk_node), dtype=bool)
                lattices[gone[gone >= 0]] = False
                self.keep_lattices(lattices)
            mine = keep[self.numbers]
            self.hashes, self.numbers = self.hashes[mine], (np.cumsum(keep, dtype=np.int32) - 1)[self.numbers[mine]]
            for part in (self.seen, self.placed):
                part.replace(part.values[keep])
            if self.sp is not None:
                self.ids.replace(self.ids.values[np.repeat(keep, n_ids)])
                self.same.replace(self.same.values[keep])
                self.begin.replace(np.concatenate([[0], np.cumsum(n_ids[keep])]))

    def keep_lattices(self, keep: np.ndarray) -> None:
        """Drop all lattices but the marked ones."""
        self.lattice.keep(keep)
        have = np.flatnonzero(self.placed.values >= 0)
        old = self.placed.values[have]
        self.placed.values[have] = np.where(keep[old], np.cumsum(keep)[old] - 1, -1)

    def slice(self, raw: np.ndarray, off: np.ndarray) -> Slice:
        self.forget()
        space = raw == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[off[:-1][np.diff(off) > 0]] = True
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(raw)).astype(np.int64)
        hashes = K.word_hashes(raw, first, last)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)]
        distinct, example = hashes[new], order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        number = np.full(len(distinct), -1)
        if len(self.hashes) and len(distinct):
            found = K.lookup(self.hashes, distinct)
            number[found >= 0] = self.numbers[found[found >= 0]]

        def bytes_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin, size = first[example[which]], (last - first)[example[which]]
            edge = np.concatenate([[0], np.cumsum(size)])
            return raw[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])], edge

        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.numbers) + np.arange(len(new))
            self.seen.extend(np.zeros(len(new), np.int32))
            self.placed.extend(np.full(len(new), -1))
            at = np.searchsorted(self.hashes, distinct[new])
            self.hashes, self.numbers = np.insert(self.hashes, at, distinct[new]), np.insert(self.numbers, at, number[new])
            if self.sp is not None:
                self.learn(*bytes_of(new))
        self.seen.values[number] += 1
        if self.lattice is not None:
            bare = np.flatnonzero(self.placed.values[number] < 0)
            if len(bare):
                self.placed.values[number[bare]] = len(self.lattice.chunk_node) + np.arange(len(bare))
                self.lattice.add(*bytes_of(bare))
        return Slice(number[of], self.placed.values[number][of], np.searchsorted(first, off))

    def learn(self, raw: np.ndarray, off: np.ndarray) -> None:
        """Ids of new chunks.  No piece spans two chunks, so chunks are encoded
        once each; the model adds their first space."""
        data, edge = raw.tobytes(), off.tolist()
        strings = [data[a + 1 : b] for a, b in zip(edge[:-1], edge[1:])]
        # a chunk of one space alone would be an empty string to the model
        ids = [x or [self.pieces.mark] for x in self.sp.encode(strings, num_threads=1)]
        size = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        self.same.extend(self.spelt_out(flat, size, raw, off))
        self.begin.extend(self.begin.values[-1] + np.cumsum(size))
        self.ids.extend(flat)

    def spelt_out(self, flat: np.ndarray, size: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the pieces of each chunk spell its bytes, which is when the
        model decodes them to the chunk."""
        length = np.add.reduceat(self.pieces.bytes_size[flat], np.cumsum(size) - size)
        same = length == np.diff(off)
        own = np.repeat(same, np.diff(off))
        differs = self.pieces.spelt(flat[np.repeat(same, size)]) != raw[own]
        chunk = np.repeat(np.arange(len(size)), np.diff(off))[own]
        same[chunk[differs]] = False
        return same

    def encoded(self, of: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice's texts one after the other, where each text's
        begin, and whether each decodes to itself."""
        begin = self.begin.values.astype(np.int64)
        n = (begin[1:] - begin[:-1])[of.chunk]
        place = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[of.chunk] - place[:-1], n) + np.arange(place[-1])
        wrong = np.concatenate([[0], np.cumsum(~self.same.values[of.chunk])])
        return self.ids.values[at], place[of.doc], wrong[of.doc[1:]] == wrong[of.doc[:-1]]


def led_by_space(text):
    """Texts as the model sees them; an empty text stays empty."""
    text = pc.replace_substring(text, SPACE_MARK, " ")
    return pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)))


def drawn_samples(lattice: Lattice, of: Slice, seeds: np.ndarray, k: int) -> Iterator[list]:
    """For each text of a slice: [(ids, log_prob, perturbed, inclusion)]."""
    if not len(of.instance):
        yield from ([(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] for _ in seeds)
        return
    for own, kappa in sampled(lattice, of.instance, of.doc, seeds, k):
        yield [(lattice.piece[p.edges], p.log_prob, float(p.value),
                1.0 if np.isneginf(kappa) else float(-np.expm1(-np.exp(min(p.log_prob - kappa, 50.0))))) for p in own]


def sampled_segmentations(pieces: Inventory, text, seeds: np.ndarray, k: int) -> Iterator[list]:
    """Samples of every text of an Arrow column."""
    known = Chunks(pieces)
    for row, end, raw, off in K.slices(led_by_space(text)):
        of = known.slice(raw, off)
        yield from drawn_samples(known.lattice, of, seeds[row:end], k)


SAMPLED = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """Every input row with ``ids`` (the model's encoding), ``round_trip``
    (whether decoding gives the text back) and ``samples``."""
    base = keyed(docs, id_col, text_col)
    with open(model, "rb") as f:  # a few megabytes in all; the executors need not have the file
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((data, Inventory(data)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, pieces = shared.value
        known = Chunks(pieces, sentencepiece.SentencePieceProcessor(model_proto=data), lattices=bool(samples))
        for batch in batches:
            for row, end, raw, off in K.slices(led_by_space(batch.column("text")), LATTICE_BYTES if samples else K.SLICE_BYTES):
                part = batch.slice(row, end - row)
                of = known.slice(raw, off)
                ids, begin, same = known.encoded(of)
                marked = pc.match_substring(part.column("text"), SPACE_MARK).to_numpy(zero_copy_only=False)
                arrays = [part.column("row"), part.column("text"), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids)), pa.array(same & ~marked)]
                if samples:
                    seeds = K.mix(part.column("key").to_numpy().astype(np.int64).view(np.uint64) * K.BASE + part.column("tag").to_numpy().astype(np.uint64))
                    drawn = list(drawn_samples(known.lattice, of, seeds, samples))
                    flat = [x for own in drawn for x in own]
                    inner = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]), pa.int32()),
                        pa.array(np.concatenate([x[0] for x in flat]) if flat else [], pa.int32()))
                    numbers = [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]
                    struct = pa.StructArray.from_arrays([inner, *numbers], ["ids", "log_prob", "perturbed", "inclusion"])
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in drawn])]), pa.int32()), struct))
                yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "ids", "round_trip", "samples"][: len(arrays)])

    row = base.schema["row"].dataType.simpleString()
    schema = f"row {row}, text string, ids array<int>, round_trip boolean"
    source = ["row", "text"] + (["key", "tag"] if samples else [])
    out = base.select(*source).mapInArrow(emit, schema + (f", samples {SAMPLED}" if samples else ""))
    results = {c: F.col(c) for c in ("ids", "round_trip", "samples")[: 3 if samples else 2]}
    return unkeyed(out, docs, text_col, None, **results)


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Every input row with the text that its ids stand for; null ids give
    null."""
    rest = [c for c in encoded.columns if c != text_col]
    packed = encoded.select(F.col(f"`{ids_col}`").cast("array<int>").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            text = [None if x is None else sp.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "text"])

    out = packed.mapInArrow(emit, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("row")[c].alias(c) for c in rest], F.col("text").alias(text_col))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of every document, and its sampled segmentations."""
    digest = F.transform("samples", lambda s: F.struct(
        F.size(s["ids"]).alias("n_pieces"), F.xxhash64(s["ids"]).alias("ids_hash"), s["log_prob"].alias("log_prob"),
        s["perturbed"].alias("perturbed"), s["inclusion"].alias("inclusion")))
    out = encode_pieces(documents(spark, sf_dir))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip", digest.alias("samples"))
