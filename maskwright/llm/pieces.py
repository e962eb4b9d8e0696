"""SentencePiece encoding by sampling without replacement, and decoding.

The segmentations of a text are the paths of its piece lattice, with a probability in proportion to the product of the
pieces' probabilities (Zipf's law over the model's ranks, to the power `alpha`). Gumbel top-k: every path gets its log
probability plus Gumbel noise, and the k largest are k distinct samples without replacement. The search is best first
over lattice nodes (A*): a node's bound is the largest perturbed value below it, which is sampled exactly from the sum of
its paths (the backward sums of the lattice), so the first k ends reached are the top k. A node is opened by giving its
best child the node's own value and the others the noise truncated below it; those join the frontier. What is left on
top of the frontier after the k-th end is the threshold of the inclusion scores.

No piece reaches over the start of a run of blanks or a line feed, so a text's lattice is a chain of small ones; equal
words share one, and all words of a batch walk theirs side by side. The noise is a hash of the row's key, the place in
the text and the edge, so a row's result depends on nothing but the row.

A character without a piece is spelled by byte pieces, as is a literal U+2581; decoding gives every text back exactly.

Defined cases: null or empty text has one segmentation, without pieces (log_prob 0, inclusion 1); a text with fewer than
k segmentations gives all it has; a null id is a key like others; equal rows get equal results; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship
from .texts import BASE, BASE_INVERSE, U64, byte_hashes, mix, powers, raw, slices

#: Bytes of text whose words share lattices and walk together.
TOGETHER = 1_000_000


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


class Vocabulary:
    """A model's pieces as bytes, with `logp` by id, and a hash table of all their prefixes."""

    def __init__(self, path: str, alpha: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        rank = np.full(n, float(n))
        spelled: dict[bytes, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw_piece = piece.replace("▁", " ").encode()
                if b" " in raw_piece.lstrip(b" ") or b"\n" in raw_piece:
                    raise ValueError(f"a piece reaches over a word's start: {piece!r}")
                self.bytes[i] = raw_piece
                spelled.setdefault(raw_piece, i)
                rank[i] = min(max(1.0, 1.0 - model.get_score(i)), float(n))
        self.logp = -alpha * np.log(rank)
        prefixes: dict[bytes, int] = {}
        for piece, i in spelled.items():
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], -1)
            prefixes[piece] = i
        self.longest = max(map(len, prefixes))
        flat = np.frombuffer(b"".join(prefixes), np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        hashes = _hash(_prefix(flat), np.r_[0, ends[:-1]], ends)
        self._mask = (1 << 20) - 1
        self._key, self._value = np.zeros(1 << 20, U64), np.full(1 << 20, -2, np.int64)
        for h, v in zip(hashes.tolist(), prefixes.values(), strict=True):
            at = h & self._mask
            while self._value[at] != -2:
                at = (at + 1) & self._mask
            self._key[at], self._value[at] = h, v

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id, -1 for what only begins a piece, -2 for neither."""
        out = np.full(len(hashes), -2, np.int64)
        at = (hashes & U64(self._mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            value = self._value[at]
            same = self._key[at] == hashes[left]
            out[left[same]] = value[same]
            go = ~same & (value != -2)
            left, at = left[go], (at[go] + 1) & self._mask
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of an encoding; the blank that encoding puts in front is taken off."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Lattice:
    """The lattices of distinct words side by side; a node is a byte place, ends included."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """data: the words' bytes; word i is data[start[i]:stop[i]], all contiguous. Node ids: byte place + word number."""
        n_words = len(start)
        word = np.repeat(np.arange(n_words), stop - start)
        end = stop[word]
        prefix = _prefix(data)
        alive = np.arange(len(data))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.zeros(len(data), np.int64)
        width[lead] = np.diff(np.r_[lead, len(data)])
        covered = np.zeros(len(data), bool)
        counts = np.zeros(len(data) + n_words + 1, np.int64)
        found_at: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in range(1, vocabulary.longest + 1):
            alive = alive[alive + size <= end[alive]]
            if not len(alive):
                break
            found = vocabulary.find(_hash(prefix, alive, alive + size))
            hit = found >= 0
            at = alive[hit]
            covered[at[width[at] == size]] = True
            counts[at + word[at]] += 1  # places of one size differ
            found_at.append((size, at, found[hit]))
            alive = alive[found > -2]
        bare = ~covered[lead]
        spelled = np.flatnonzero(np.repeat(bare, width[lead]))
        counts[spelled + word[spelled]] += 1
        found_at.append((1, spelled, vocabulary.byte_id[data[spelled]]))
        self.first = np.cumsum(counts) - counts
        n_edges = int(counts.sum())
        place, node, self.piece, self.to = self.first.copy(), *(np.zeros(n_edges, np.int64) for _ in range(3))
        distance = np.zeros(n_edges, np.int32)
        for size, at, ids in found_at:
            here = at + word[at]
            slot = place[here]
            place[here] += 1
            node[slot], self.piece[slot], self.to[slot], distance[slot] = here, ids, here + size, end[at] - at
        self.start, self.end = start + np.arange(n_words), stop + np.arange(n_words)
        self.first_edge = self.first[self.start]
        # Backward sums, by distance from the word's end.
        score = vocabulary.logp[self.piece]
        self.below = np.zeros(len(data) + n_words)
        farthest = int(distance.max(initial=0))
        by = np.argsort(distance.astype(np.uint16) if farthest < 1 << 16 else distance, kind="stable")
        sorted_node = node[by]
        bounds = np.searchsorted(distance[by], np.arange(1, farthest + 2))
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            edges = by[a:b]
            heads = np.flatnonzero(np.r_[True, np.diff(sorted_node[a:b]) != 0])
            self.below[sorted_node[a:b][heads]] = np.logaddexp.reduceat(score[edges] + self.below[self.to[edges]], heads)
        #: Log probability of each edge given its node, and what the log of a uniform number is multiplied by for it.
        self.logp = score + self.below[self.to] - self.below[node]
        self.rarity = -np.exp(-self.logp)


@dataclass
class _Walk:
    """Best path below each opened place: pieces in order, by word; and the siblings passed on the way."""

    counts: np.ndarray  # pieces of each word walked
    edges: np.ndarray
    sibling_word: np.ndarray
    sibling_place: np.ndarray  # pieces before it, in this walk
    sibling_edge: np.ndarray
    behind: np.ndarray  # its exp(-Gumbel) less that of the best of its node


def _walk(lattice: Lattice, word: np.ndarray, node: np.ndarray, seed: np.ndarray) -> _Walk:
    """From `node` of lattice word `word` to its end, for many; seed: 64 bits for each.

    exp(-Gumbel) of an edge is an exponential variable at the rate of its probability; the least is the best. Where one edge
    leaves a node there is nothing to choose, so it gets none.
    """
    n = len(word)
    counts = np.zeros(n, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    passed: list[tuple[np.ndarray, ...]] = []
    active = np.flatnonzero(node < lattice.end[word])
    at, end = node[active], lattice.end[word[active]]
    # the seed of a place's edge 0, so that an edge's bits are those of its number in its word
    base = seed[active] - lattice.first_edge[word[active]].astype(U64) * U64(BASE)
    step = 0
    while len(active):
        low = lattice.first[at]
        many = lattice.first[at + 1] - low
        edge = low.copy()
        open_ = np.flatnonzero(many > 1)
        if len(open_):
            each = many[open_]
            head = np.cumsum(each) - each
            ramp = np.arange(int(head[-1] + each[-1]))
            choice = np.repeat(low[open_] - head, each)
            choice += ramp
            bits = choice.astype(U64)
            bits *= U64(BASE)
            bits += np.repeat(base[open_], each)
            bits = mix(bits)
            bits >>= U64(11)
            value = bits.astype(np.float64)
            value += 0.5
            value *= 2.0 ** -53
            np.log(value, out=value)
            value *= lattice.rarity[choice]
            least = np.minimum.reduceat(value, head)
            value -= np.repeat(least, each)
            chosen = np.flatnonzero(value == 0)
            if len(chosen) > len(open_):  # equal values: the first edge
                chosen = chosen[np.searchsorted(chosen, head)]
            edge[open_] = choice[chosen]
            other = np.ones(len(value), bool)
            other[chosen] = False
            other = np.flatnonzero(other)
            passed.append((np.repeat(active[open_], each - 1), np.full(len(other), step), choice[other], value[other]))
        steps.append((active, edge))
        counts[active] += 1
        at = lattice.to[edge]
        left = np.flatnonzero(at < end)
        active, at, end, base = active[left], at[left], end[left], base[left]
        step += 1
    begin = np.cumsum(counts) - counts
    edges = np.zeros(int(counts.sum()), np.int64)
    for k, (who, edge) in enumerate(steps):
        edges[begin[who] + k] = edge
    who, place, edge, behind = (np.concatenate(x) for x in zip(*passed, strict=True)) if passed else (
        np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return _Walk(counts, edges, who, begin[who] + place, edge, behind)


def _truncated(target: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Gumbel values `behind` the largest of their node (see `_Walk`), given that this is `target`."""
    with np.errstate(divide="ignore", over="ignore"):
        value = np.minimum(target, -np.log(behind + np.exp(-target)))
    return np.where(target < -700, target, value)  # beyond exp(); the others are as far behind as nothing then


def _best(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> list[int]:
    """Places of the k largest values of each group."""
    left, out = np.arange(len(value)), []
    for _ in range(k):
        top = np.full(groups, -np.inf)
        np.maximum.at(top, group[left], value[left])
        is_top = value[left] == top[group[left]]
        out += left[is_top].tolist()
        left = left[~is_top]
    return out


def sample(vocabulary: Vocabulary, texts: pa.Array, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text k distinct segmentations at most: (ids, log probability, log inclusion probability), largest
    perturbed value first. keys: 64 bits for each text."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    filled = np.diff(offsets) > 0
    ahead = np.cumsum(filled)
    spaced = np.full(len(data) + int(filled.sum()), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(ahead, np.diff(offsets))] = data
    bounds = offsets + np.r_[0, ahead]
    results: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
    for i in np.flatnonzero(~filled):
        results[i] = [(np.zeros(0, np.int32), 0.0, 0.0)]
    if not len(spaced):
        return results
    blank, feed = spaced == 32, spaced == 10
    cut = feed.copy()
    cut[1:] |= (blank[1:] & ~blank[:-1]) | feed[:-1]
    cut[bounds[:-1][filled]] = True
    start = np.flatnonzero(cut)
    stop = np.r_[start[1:], len(spaced)]
    _, which, word = np.unique(byte_hashes(spaced, start, stop), return_index=True, return_inverse=True)
    size = (stop - start)[which]
    gather = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ends = np.cumsum(size)
    lattice = Lattice(vocabulary, spaced[gather], ends - size, ends)
    first_word = np.searchsorted(start, bounds)
    text_of = np.repeat(np.arange(n), np.diff(first_word))
    place = np.arange(len(start)) - first_word[text_of]

    # An opened node of a text: its first word and node, the pieces and the log probability before it, its value.
    text = np.flatnonzero(filled)
    opened_word, opened_node = first_word[text], lattice.start[word[first_word[text]]]
    before = [np.zeros(0, np.int64)] * len(text)
    log_before = np.zeros(len(text))
    uniform = ((mix(keys[text] ^ U64(0x2545F4914F6CDD1D)) >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    value = -np.log(-np.log(uniform))
    frontier: list[list[tuple]] = [[] for _ in range(n)]  # at most k of each text, best first
    paths: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n)]
    for turn in range(k):
        if not len(text):
            break
        counts = first_word[text + 1] - opened_word
        base = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(text)), counts)
        token = np.arange(len(owner)) - base[owner] + opened_word[owner]
        node = lattice.start[word[token]]
        node[base] = opened_node
        seed = mix(mix(keys[text[owner]] + U64(turn + 1)) + place[token].astype(U64) * U64(BASE))
        walk = _walk(lattice, word[token], node, seed)
        logs = lattice.logp[walk.edges]
        total = np.r_[0.0, np.cumsum(logs)]
        piece_bounds = np.r_[0, np.cumsum(walk.counts)][np.r_[base, len(owner)]]
        mine = owner[walk.sibling_word]
        # The log probability before the sibling's node, and what that leaves of the opened node's value.
        at_node = log_before[mine] + total[walk.sibling_place] - total[piece_bounds[mine]]
        bound = at_node + _truncated(value[mine] - at_node, walk.behind)
        # The few best siblings of each text; more can never be opened.
        for j in _best(mine, bound, len(text), k - turn):
            o = int(mine[j])
            t = int(text[o])
            frontier[t].append((
                float(bound[j]), len(paths[t]), int(walk.sibling_place[j] - piece_bounds[o]) + len(before[o]),
                int(token[walk.sibling_word[j]]), int(walk.sibling_edge[j]), float(at_node[j])))
        ids = lattice.piece[walk.edges]
        next_text, next_word, next_node, next_before, next_log, next_value = [], [], [], [], [], []
        for o, t in enumerate(text.tolist()):
            a, b = piece_bounds[o], piece_bounds[o + 1]
            paths[t].append((np.concatenate([before[o], ids[a:b]]), float(log_before[o] + total[b] - total[a])))
            frontier[t].sort(reverse=True)
            del frontier[t][k - turn:]
            if turn + 1 < k and frontier[t]:
                bound_, path, pieces, token_, edge, log_node = frontier[t].pop(0)
                next_text.append(t)
                next_word.append(token_)
                next_node.append(int(lattice.to[edge]))
                next_before.append(np.append(paths[t][path][0][:pieces], lattice.piece[edge]))
                next_log.append(log_node + float(lattice.logp[edge]))
                next_value.append(bound_)
        text, opened_word = np.array(next_text, np.int64), np.array(next_word, np.int64)
        opened_node, before = np.array(next_node, np.int64), next_before
        log_before, value = np.array(next_log), np.array(next_value)
    for t in np.flatnonzero(filled).tolist():
        threshold = frontier[t][0][0] if frontier[t] else -np.inf
        for ids_, log_p in paths[t]:
            # log(1 - exp(-exp(x))), x = log p - threshold
            x = log_p - threshold
            inclusion = 0.0 if x > 30 else (x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
            results[t].append((ids_.astype(np.int32), log_p, inclusion))
    return results


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def vocabulary_of(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


def encode_samples(
    docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_chars, samples (ids, log_prob, log_inclusion), decoded (do all samples give the text back?).

    `model` is a path that every executor has.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, alpha)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                keys = mix(part.column("key").to_numpy().view(U64) + U64(seed % (1 << 64)))
                found = sample(vocabulary, part.column("text"), keys, k)
                texts = part.column("text").to_pylist()
                same = [all(vocabulary.decode(ids.tolist()) == (t or "") for ids, _, _ in f) for f, t in zip(found, texts, strict=True)]
                flat = [s for f in found for s in f]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(s[0]) for s in flat)]).astype(np.int32)),
                    pa.array(np.concatenate([s[0] for s in flat])))
                structs = pa.StructArray.from_arrays(
                    [ids, pa.array([s[1] for s in flat]), pa.array([s[2] for s in flat])], fields=list(kind.value_type))
                samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), samples, pa.array(same)],
                    names=["doc_id", "n_chars", "samples", "decoded"])

    wanted = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    id_kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(
        run, f"doc_id {id_kind}, n_chars long, "
             "samples array<struct<ids: array<int>, log_prob: double, log_inclusion: double>>, decoded boolean")
