"""SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A text is cut where no piece can span: before a run of spaces, and between letters and other characters, as far as the
vocabulary never joins them (``_joined``). So the lattice of a text is the chain of the lattices of such units, and units
repeat. The lattice of a unit has an edge for each vocabulary piece that fits, and byte pieces for a character that no
piece holds. Forward filtering sums the weights exp(theta * score) of all paths to each node; backward sampling draws the
last piece of a node in proportion, from the end to the start. So a segmentation is drawn in proportion to its
weight. Draws are a counter-based hash of the row key, the unit's number and the step, on 24-bit integer probabilities: a
row is segmented alike wherever and whenever it runs.

Lattices are built once for each distinct unit, for all units of a batch together, and kept in the worker. Beyond
``NODES_KEPT`` nodes only the units that the most batches used stay, with half as many nodes.

Lossless: spaces are the pieces' word mark; a word mark in the text itself is spelled in bytes, like any character
without a piece; nothing is normalised.

Defined results: a null text has null ids and decodes to null; an empty one has no ids; repeated rows get
the same ids; a null row key counts as 0. A text of any length is worked on ``CHARS`` characters at a time; a run of more
than ``RUN`` letters, or spaces, without anything else is also cut there, and no piece spans that cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, ship, table, trim, worker_cache

THETA = 2e-4
NODES_KEPT = 600_000
CHARS = 1 << 20
CHUNK = 1 << 16
RUN = 1 << 14
BITS = 24
MARK = "▁"
SPACE_AFTER = re.compile(r"[^ ] ")
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + C1
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def _joined(pieces: dict[str, int]) -> tuple[str, str]:
    """Characters that pieces join with each other, directly or over others: the largest such group, and all others. A
    space at the start of a piece joins nothing, as units start with their spaces."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for p in pieces:
        q = p.lstrip(" ")
        for a, b in zip(q, q[1:], strict=False):
            up[top(a)] = top(b)
    sets: dict[str, list[str]] = {}
    for c in up:
        sets.setdefault(top(c), []).append(c)
    big = sorted(sets.values(), key=len, reverse=True)
    return "".join(sorted(big[0])) if big else "", "".join(sorted(c for s in big[1:] for c in s))


def unit_pattern(pieces: dict[str, int]) -> re.Pattern:
    """Units: spaces, then a run of the largest joined group, a run of the other joined characters, or any other one."""
    spaces, (letters, others) = f" {{0,{RUN}}}", map(re.escape, _joined(pieces))
    runs = [f"{spaces}[{c}]{{1,{RUN}}}" for c in (letters, others) if c]
    return re.compile("|".join([*runs, f"{spaces}[^ {letters}{others}]", f" {{1,{RUN}}}"]))


class Pieces:
    """Vocabulary of a model file as a trie in arrays, and the lattices of the units met so far.

    Nodes of a unit are numbered on, from its start to its end, and its edges are together, by the node that they lead
    into: ``cum`` (node and cumulative probability in one number), ``piece``, and ``back``, the node that they come from or
    -1 for the unit's start.
    """

    def __init__(self, path: str, theta: float = THETA, kept: int = NODES_KEPT):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.theta, self.kept = theta, kept
        self.bytes = [b""] * n  # what a piece decodes to
        self.byte_id = np.full(256, -1, np.int64)
        pieces: dict[str, int] = {}
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and MARK not in p.lstrip(MARK):
                pieces[p.replace(MARK, " ")] = i
                self.bytes[i] = p.replace(MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model needs byte pieces for lossless decoding")
        self.scores = np.asarray([m.get_score(i) for i in range(n)])
        self.byte_score = float(min(self.scores[i] for i in pieces.values())) - 1000.0
        self.weight = theta * self.scores
        self.weight[self.byte_id] = theta * self.byte_score
        self.unit = unit_pattern(pieces)
        self.longest = max(map(len, pieces))
        chars = sorted({c for p in pieces for c in p})
        self.chars = np.asarray([ord(c) for c in chars])
        # Trie: edges (node, char) -> node, sorted by node * (chars + 1) + char.
        child: dict[tuple[int, int], int] = {}
        end = [-1]
        at = {c: k for k, c in enumerate(chars)}
        for p, i in pieces.items():
            node = 0
            for c in p:
                key = (node, at[c])
                if key not in child:
                    child[key] = len(end)
                    end.append(-1)
                node = child[key]
            end[node] = i
        self.width = len(chars) + 1
        keys = np.asarray([a * self.width + b for a, b in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.end = keys[order], np.asarray(list(child.values()), np.int64)[order], np.asarray(end, np.int64)
        self.units: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.last, self.first_edge, self.n_edges, self.size, self.uses = (np.empty(0, np.int32) for _ in range(5))
        self.cum, self.piece, self.back = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def _fits(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces that fit at any position; ``stop`` is the end of each one's unit."""
        c = np.searchsorted(self.chars, codes).clip(max=len(self.chars) - 1)
        c = np.where(self.chars[c] == codes, c, len(self.chars))
        start, node, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found = []
        while len(start):
            key = node * self.width + c[start + length]
            k = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            ok = self.keys[k] == key
            start, node, length = start[ok], self.to[k[ok]], length + 1
            hit = self.end[node] >= 0
            found.append((start[hit], np.full(hit.sum(), length), self.end[node[hit]]))
            ok = start + length < stop[start]
            start, node = start[ok], node[ok]
        s, n, p = (np.concatenate(x) for x in zip(*found, strict=True))
        bare = np.ones(len(codes), bool)
        bare[s[n == 1]] = False
        bare = np.flatnonzero(bare)
        # One byte is its piece; longer characters are -code - 1 until they are spelled out.
        spelled = np.where(codes[bare] < 128, self.byte_id[codes[bare].clip(max=127)], -codes[bare] - 1)
        return np.concatenate([s, bare]), np.concatenate([n, np.ones(len(bare), np.int64)]), np.concatenate([p, spelled])

    def add(self, units: set[str]) -> None:
        """Build the lattices of new units, about ``CHUNK`` characters at a time."""
        part, held = [], 0
        for u in sorted(units, key=len, reverse=True):
            part.append(u)
            held += len(u)
            if held >= CHUNK:
                self._add(part)
                part, held = [], 0
        if part:
            self._add(part)

    def _add(self, units: list[str]) -> None:
        """Forward filtering over the lattices of new units, the longest first, depth by depth: node (unit u, depth d) is
        step[d] + u here, so that the nodes of a depth and the edges into them are together."""
        n_units = len(units)
        size = np.fromiter(map(len, units), np.int64, n_units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(size) - size
        unit_of = np.repeat(np.arange(n_units), size)
        depth_of = np.arange(len(codes)) - begin[unit_of]
        s, n, p = self._fits(codes, (begin + size)[unit_of])
        alive = np.searchsorted(-size, -np.arange(size[0] + 1), side="right")  # units with a node at each depth
        step = np.cumsum(alive) - alive
        u, d = unit_of[s], depth_of[s]
        order = np.argsort((step[d + n] + u) * (self.longest + 1) + self.longest - n)  # by node, the longest piece first
        u, d, n, p = u[order], d[order], n[order], p[order]
        node, into = step[d] + u, step[d + n] + u
        weight = np.where(p >= 0, self.weight[p.clip(min=0)], self.theta * self.byte_score)
        first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))  # each node but the starts has an edge
        count = np.diff(np.append(first, len(into)))
        alpha, value = np.zeros(len(codes) + n_units), np.empty(len(node))
        group = np.append(step[1:], len(alpha)) - n_units
        for k in range(1, len(alive)):
            x, y = group[k - 1], group[k]
            a, b = first[x], first[y] if y < len(first) else len(node)
            v = alpha[node[a:b]] + weight[a:b]
            top = np.maximum.reduceat(v, first[x:y] - a)
            alpha[x + n_units : y + n_units] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count[x:y])), first[x:y] - a))
            value[a:b] = v
        share = np.exp(value - alpha[into])
        # Each node's sums are made alone, so that they don't depend on what else is in the batch.
        cum = np.minimum(np.rint(_sums(share, first, count) * (1 << BITS)), 1 << BITS).astype(np.int64)
        cum[first + count - 1] = 1 << BITS
        # From depths to units: where the edges into each node go.
        slot = (begin[u] + d + n - 1)[first]
        per_node = np.empty(len(codes), np.int64)
        per_node[slot] = count
        offset = np.cumsum(per_node) - per_node
        to = np.repeat(offset[slot] - first, count) + np.arange(len(into)) + self.edges
        start = begin + np.arange(n_units) + self.nodes  # the number of each unit's start
        self._room(len(into), n_units)
        self.cum[to] = ((start[u] + d + n) << BITS) + cum
        self.piece[to] = p
        self.back[to] = np.where(d > 0, start[u] + d, -1)
        at = slice(len(self.units), len(self.units) + n_units)
        self.first_edge[at] = offset[begin] + self.edges
        self.n_edges[at] = np.add.reduceat(per_node, begin)
        self.last[at], self.size[at], self.uses[at] = start + size, size + 1, 0
        self.units.update(zip(units, range(at.start, at.stop), strict=True))
        self.nodes += len(alpha)
        self.edges += len(into)

    def _room(self, edges: int, units: int) -> None:
        """Let the arrays grow; memory that isn't written yet takes no room."""
        for names, used, more in ((("cum", "piece", "back"), self.edges, edges), (("last", "first_edge", "n_edges", "size", "uses"), len(self.units), units)):
            for name in names:
                old = getattr(self, name)
                if used + more > len(old):
                    new = np.empty(max(2 * len(old), used + more), old.dtype)
                    new[:used] = old[:used]
                    setattr(self, name, new)

    def shrink(self) -> None:
        """Keep the units that the most batches used, up to half of ``kept`` nodes."""
        n = len(self.units)
        order = np.argsort(-self.uses[:n], kind="stable")
        stay = np.sort(order[np.cumsum(self.size[order]) <= self.kept // 2])
        names = list(self.units)
        self.units = {names[i]: k for k, i in enumerate(stay.tolist())}
        size, count, start = (x[stay].astype(np.int64) for x in (self.size, self.n_edges, self.first_edge))
        last = np.cumsum(size) - 1
        first = np.cumsum(count) - count
        edge = np.repeat(start - first, count) + np.arange(int(count.sum()))
        shift = np.repeat(last - self.last[stay], count)
        cum, piece, back = self.cum[edge] + (shift << BITS), self.piece[edge], self.back[edge]
        back = np.where(back < 0, -1, back + shift)
        m = len(stay)
        self.uses[:m], self.n_edges[:m] = self.uses[stay] >> 1, count
        self.size[:m], self.last[:m], self.first_edge[:m] = size, last, first
        self.nodes, self.edges = int(size.sum()), len(edge)
        self.cum[: self.edges], self.piece[: self.edges], self.back[: self.edges] = cum, piece, back

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []  # row, number of its first unit, units
        size = 0
        for row, text in enumerate(texts):
            number, at, text = 0, 0, " " + text
            while at < len(text) > 1:
                cut = SPACE_AFTER.search(text, at + CHARS) if len(text) - at > CHARS else None
                to = cut.end() - 1 if cut else len(text)
                units = self.unit.findall(text, at, to)
                held.append((row, number, units))
                number, size, at = number + len(units), size + to - at, to
                if size >= CHARS:
                    self._draw(held, keys, done)
                    held, size = [], 0
        if held:
            self._draw(held, keys, done)
        return [x[0] if len(x) == 1 else np.concatenate([np.empty(0, np.int32), *x]) for x in done]

    def _draw(self, held: list[tuple[int, int, list[str]]], keys: list[int], done: list[list[np.ndarray]]) -> None:
        if self.nodes > self.kept:
            self.shrink()
        new = set().union(*(u for _, _, u in held)) - self.units.keys()
        if new:
            self.add(new)
        get = self.units.__getitem__
        unit = np.concatenate([np.fromiter(map(get, u), np.int32, len(u)) for _, _, u in held])
        used = np.zeros(len(self.units), bool)
        used[unit] = True
        self.uses[: len(used)] += used
        count = np.asarray([len(u) for _, _, u in held])
        begin = np.cumsum(count) - count
        number = np.arange(len(unit)) - np.repeat(begin - [k for _, k, _ in held], count)
        seed = np.repeat(mix(np.asarray([keys[r] for r, _, _ in held], np.int64).view(np.uint64)), count)
        seed = mix(seed ^ mix(number.astype(np.uint64)))
        at = np.argsort(unit, kind="stable")  # sorted, so that each search starts where the last one ended
        node, step, drawn = self.last[unit[at]], 0, []
        cum = self.cum[: self.edges]
        while len(at):
            draw = (mix(seed[at] + np.uint64(step)) >> np.uint64(64 - BITS)).astype(np.int64)
            k = np.searchsorted(cum, (node.astype(np.int64) << BITS) + draw, side="right")
            drawn.append((at, self.piece[k]))
            node = self.back[k]
            live = node >= 0
            at, node, step = at[live], node[live], step + 1
        n = np.zeros(len(unit), np.int64)
        for a, _ in drawn:
            n[a] += 1
        ends = np.cumsum(n)
        out = np.empty(ends[-1], np.int32)
        for k, (a, p) in enumerate(drawn):
            out[ends[a] - 1 - k] = p
        stop = ends[begin + count - 1]
        for (row, _, _), ids in zip(held, np.split(out, stop[:-1]), strict=True):
            done[row].append(self._spell(ids) if ids.min() < 0 else ids)

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        return np.fromiter((k for i in ids.tolist() for k in ((i,) if i >= 0 else self.byte_id[list(chr(-i - 1).encode("utf-8", "surrogatepass"))])), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _sums(x: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Running sums within the groups that start at ``first``, added in the same order for any surroundings."""
    out = x.copy()
    for k in range(1, int(count.max())):
        at = first[count > k] + k
        out[at] += out[at - 1]
    return out


def encode(docs: DataFrame, model: str, theta: float = THETA, key: str = "doc_id") -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>, lossless (whether the ids decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_cache(("pieces", model, theta), lambda: Pieces(model, theta))
        for part in groups(batches, "text", 256, 1 << 20):
            texts = part["text"].to_pylist()
            ids = pieces.sample([t or "" for t in texts], [k or 0 for k in part["key"].cast(pa.int64()).to_pylist()])
            same = [None if t is None else pieces.decode(x) == t for t, x in zip(texts, ids, strict=True)]
            sizes = np.cumsum([0, *map(len, ids)])
            col = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), col, pa.array(same, pa.bool_())], ["doc_id", "ids", "lossless"])
        trim()

    return docs.select("doc_id", "text", F.col(key).cast("long").alias("key")).mapInArrow(run, "doc_id long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_cache(("pieces", model, THETA), lambda: Pieces(model, THETA))
        for b in batches:
            text = [None if x is None else pieces.decode(np.asarray(x, np.int64)) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(text, pa.string())], ["doc_id", "text"])
        trim()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ship(__name__)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "lossless")
