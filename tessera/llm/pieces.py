"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import small_batches

#: A public vocabulary; pass another path to use another. The driver reads it and broadcasts its bytes (about half a MB).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Slots of the table of pairs' weights: 4 million, 16 MB for a vocabulary of up to 32,767 pieces.
PAIR_BITS = 22
CUT = re.compile(f"[^{SPACE}]{SPACE}")


def halved(kept: dict, most: int) -> bool:
    """Drop the older half of a dictionary that holds more than `most` entries."""
    if len(kept) <= max(most, 0):
        return False
    for key in list(islice(kept, (len(kept) + 1) // 2)):
        del kept[key]
    return True


class Lookup:
    """A map from whole numbers to whole numbers, in two arrays of at least four slots a key: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        at = slots(keys, self.shift)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; -1 for those that the map does not hold."""
        at = slots(keys, self.shift)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], -1)
        open_ = np.flatnonzero((met != keys) & (met != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            met = self.keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        return out


def slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The upper bits of keys times an odd number."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def starts(size: np.ndarray) -> np.ndarray:
    """Where each of several spans of these sizes starts, and the end of all."""
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Strings:
    """Byte strings by number, to be written one after the other."""

    def __init__(self, strings: list[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = starts(self.size)[:-1]

    def written(self, ids: np.ndarray, bound: np.ndarray) -> list[bytes]:
        """For each run ids[bound[i] : bound[i + 1]], its strings in one."""
        size = self.size[ids]
        out, at = self.bytes[spans(self.start[ids], size)].tobytes(), starts(size)[bound].tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)]


class Transducer:
    """Normaliser, pieces and byte fallback of a byte-pair model with the identity normaliser, compiled to one transducer.

    The normaliser puts a space before the text and writes spaces as U+2581. A state is a place in the input and the piece
    that ends there. An arc reads the characters of a piece and writes its id; a character of no piece is read by an arc that
    writes the ids of its UTF-8 bytes. Weights are tropical: an arc weighs 1, and infinity if the merge order would not
    leave its piece beside the one before it, which is looked up once for each pair of pieces. Two pieces next to each other
    are what the merges make of a text if and only if they are what the merges make of these two alone, so one path has a finite
    weight: the shortest, and the model's own segmentation. A run of spaces merges last, from the left; its arcs follow that.

    Pieces are compiled to a trie read from their ends, in arrays, and all different words of `block` characters of text are composed
    with it together, place by place (`shortest`). Weights of pairs are kept in a table of fixed size where a new pair takes the slot
    of an older one. Words of more than `wide` characters are composed one at a time (`extend`), by the same arcs.
    """

    wide = 64
    block = 1 << 19

    def __init__(self, model: bytes, room: int = 100_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.name not in ("", "identity") or proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only byte-pair models with the identity normaliser are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.out = [p.piece.encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in proto.pieces]
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs: dict[int, list[str]] = {}
        self.room = room
        self.compile(list(proto.pieces))
        self.breaks = np.array([chr(c) not in self.ids for c in range(32)])  # characters that are parts by themselves
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, self.wide, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def compile(self, pieces: list) -> None:
        """Arrays for `shortest`: the letters of each piece, the trie from their ends, all merges of two pieces, the pieces that merges leave whole."""
        n = len(self.out)
        self.n = n
        self.figures, self.spelling = Strings([b"%d," % i for i in range(n)]), Strings(self.out)
        self.letter = np.full(0x110000, -1, np.int32)  # the piece of a character
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.length = np.zeros(n, np.int64)
        self.letters = np.full((n, max(map(len, self.ids), default=1)), -1, np.int64)
        nodes, ends, joins = {"": 0}, [-1], {}
        for p, i in self.ids.items():
            self.length[i] = len(p)
            self.letters[i, : len(p)] = [self.letter[ord(c)] for c in p]
            for a in range(len(p) - 1, -1, -1):
                if p[a:] not in nodes:
                    nodes[p[a:]] = len(nodes)
                    ends.append(self.ids.get(p[a:], -1))
            for a in range(1, len(p)):
                x, y = self.ids.get(p[:a]), self.ids.get(p[a:])
                if x is not None and y is not None:
                    joins[x * n + y] = i
        if any(self.letter[ord(c)] < 0 for c in set("".join(self.ids))):
            raise ValueError("a piece has a character that is not a piece")
        tails = [t for t in nodes if t]
        self.edges = Lookup(np.array([nodes[t[1:]] * n + int(self.letter[ord(t[0])]) for t in tails], np.int64), np.array([nodes[t] for t in tails], np.int32))
        self.of_letter = np.array([nodes.get(p.piece, -1) if len(p.piece) == 1 else -1 for p in pieces], np.int64)
        self.joins = Lookup(np.array(list(joins), np.int64), np.array(list(joins.values()), np.int32))
        self.place = np.full(n + 1, np.inf)  # the last one is for "no piece", -1
        for p, i in self.ids.items():
            self.place[i] = self.rank[p]
        every = np.array(list(self.ids.values()), np.int64)
        merged = self.merges(self.letters[every])
        left_whole = np.zeros(n + 1, bool)
        left_whole[every] = (merged[:, 0] == every) & (merged[:, 1:] == -1).all(axis=1)
        found = np.array(ends, np.int64)
        self.ends = np.where(left_whole[found], found, -1)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int32 if 2 * n * n < 1 << 31 else np.int64)  # twice the pair's number, plus one if it fits

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece that x and y merge to; -1: none."""
        return np.where((x >= 0) & (y >= 0), self.joins.get(np.maximum(x, 0) * self.n + np.maximum(y, 0)), -1)

    def merges(self, rows: np.ndarray) -> np.ndarray:
        """What the merges make of rows of letters (-1 after the last), as `merged` does: the best-ranked pair first, the leftmost of equal ones."""
        rows = np.column_stack([rows, np.full(len(rows), -1)])
        out, at = rows.copy(), np.arange(len(rows))
        pairs = self.join(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        columns = np.arange(rows.shape[1])
        while len(at):
            cost = self.place[pairs]
            best = cost.argmin(axis=1)
            going = cost[np.arange(len(at)), best] < np.inf
            out[at[~going]] = rows[~going]
            rows, pairs, best, at = rows[going], pairs[going], best[going], at[going]
            if not len(at):
                break
            line = np.arange(len(at))
            rows[line, best] = pairs[line, best]
            rows = np.take_along_axis(rows, np.minimum(columns + (columns > best[:, None]), columns[-1]), axis=1)
            pairs = np.take_along_axis(pairs, np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), columns[-2]), axis=1)
            pairs[:, -1] = -1
            pairs[line, best] = self.join(rows[line, best], rows[line, best + 1])
            left = line[best > 0]
            pairs[left, best[left] - 1] = self.join(rows[left, best[left] - 1], rows[left, best[left]])
        return out

    def pairs_fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the merges leave `piece` after `before`: `weight` for many pairs of pieces."""
        key = before * self.n + piece
        known = self.pairs[slots(key, np.uint64(64 - PAIR_BITS))]
        fits, new = (known & 1) == 1, np.flatnonzero(known >> 1 != key)
        if len(new):
            keys, where = np.unique(key[new], return_inverse=True)
            x, y = keys // self.n, keys % self.n
            column = np.arange((self.length[x] + self.length[y]).max())
            second = column - self.length[x][:, None]
            wide = self.letters.shape[1] - 1
            rows = np.where(second < 0, self.letters[x][:, np.minimum(column, wide)], np.where(second <= wide, np.take_along_axis(self.letters[y], np.clip(second, 0, wide), axis=1), -1))
            made = self.merges(rows)
            fit = (made[:, 0] == x) & (made[:, 1] == y) & (made[:, 2:] == -1).all(axis=1)
            fits[new] = fit[where]
            self.pairs[slots(keys, np.uint64(64 - PAIR_BITS))] = 2 * keys + fit
        return fits

    def shortest(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces inside and how many each has, all composed at once: place by place, from those that a piece's letters lead back to.

        A place whose word begins like the one before it, up to there, takes over what that one found."""
        letters = self.letter[codes]
        first = np.cumsum(size) - size
        last, step = np.full(len(codes), -1, np.int64), np.ones(len(codes), np.int64)
        reach, same = np.arange(len(size)), np.arange(len(size)) > 0  # words that reach this place, those that begin like the one before
        for at in range(1, int(size.max()) + 1):
            reach = reach[size[reach] >= at]
            every = first[reach] + at - 1
            alike = same[reach]
            asked = np.flatnonzero(alike)
            word = reach[asked]
            alike[asked] = (size[word - 1] >= at) & (codes[np.minimum(first[word - 1] + at - 1, len(codes) - 1)] == codes[every[asked]])
            same[reach] = alike
            end = every[~alike]
            end = end[letters[end] >= 0]  # other characters stay single
            node = self.of_letter[letters[end]]
            for n in range(1, at + 1):
                if n > 1:
                    letter = letters[end - (n - 1)]
                    node = np.where(letter >= 0, self.edges.get(node * self.n + np.maximum(letter, 0)), -1)
                    on = node >= 0
                    end, node = end[on], node[on]
                if not len(end):
                    break
                piece = self.ends[node]
                fit = piece >= 0
                if n < at:
                    before = last[end - n]
                    asked = np.flatnonzero(fit & (before >= 0))
                    fit[asked] = self.pairs_fit(before[asked], piece[asked])
                last[end[fit]], step[end[fit]] = piece[fit], n
                end, node = end[~fit], node[~fit]
            owner = every[np.maximum.accumulate(np.where(alike, 0, np.arange(len(every))))]
            last[every], step[every] = last[owner], step[owner]
        used = np.zeros(len(codes), bool)
        at, start = first + size - 1, first
        while len(at):
            used[at] = True
            at = at - step[at]
            more = at >= start
            at, start = at[more], start[more]
        ids, many = last[used], np.add.reduceat(used, first, dtype=np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # the ids of a character's bytes in place of one
            spelled = [self.written(chr(c)) for c in codes[used][unknown].tolist()]
            extra = np.fromiter(map(len, spelled), np.int64, len(spelled))
            wide = np.ones(len(ids), np.int64)
            wide[unknown] = extra
            begin = np.cumsum(wide) - wide
            many = np.add.reduceat(wide, np.cumsum(many) - many)
            ids = np.repeat(ids, wide)
            ids[np.repeat(begin[unknown] - (np.cumsum(extra) - extra), extra) + np.arange(extra.sum())] = np.fromiter(chain.from_iterable(spelled), np.int64)
        return ids, many

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: the best-ranked pair first, the leftmost of equal ones; n log n steps for n characters."""
        if len(text) <= 32:
            return self.merged_short(text)
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = parts[i] + parts[after[i]]
                if pair in self.rank:
                    heappush(queue, (self.rank[pair], i, pair))

        for i in range(n):
            offer(i)
        while queue:
            _, i, pair = heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != pair:  # one of the two has merged since
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x]

    def merged_short(self, text: str) -> list[str]:
        """The same, by looking at all pairs of a short text again and again."""
        parts, rank, none = list(text), self.rank, float("inf")
        while len(parts) > 1:
            costs = [rank.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
            least = min(costs)
            if least == none:
                break
            best = costs.index(least)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def weight(self, before: str | None, piece: str) -> float:
        """1, or infinity where the merges would not leave `piece` after `before`."""
        if piece not in self.whole:
            self.whole[piece] = self.merged(piece) == [piece]
        if not self.whole[piece]:
            return float("inf")
        if before is None or before not in self.ids or piece not in self.ids:
            return 1.0
        pair = (before, piece)
        if pair not in self.fits:
            halved(self.fits, self.room)
            self.fits[pair] = self.merged(before + piece) == [before, piece]
        return 1.0 if self.fits[pair] else float("inf")

    def extend(self, text: str, at: int, cost: list[float], last: list[str | None]) -> None:
        """The best way to place `at`, from those to all places before it; it ends where no piece has so long a tail."""
        best, found = float("inf"), None
        for n in range(1, at + 1):
            piece = text[at - n : at]
            if n > 1 and piece not in self.tails:
                break
            before = cost[at - n] + 1
            if before < best and (n == 1 or piece in self.ids):
                fits = self.fits.get((last[at - n], piece))
                if fits or fits is None and self.weight(last[at - n], piece) == 1:
                    best, found = before, piece
        cost[at], last[at] = best, found

    def path(self, text: str, last: list[str | None]) -> list[str]:
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def written(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def run(self, n: int) -> list[str]:
        """What the merges make of n spaces; short runs are kept."""
        if n > 1000:
            return self.merged(SPACE * n)
        if n not in self.runs:
            self.runs[n] = self.merged(SPACE * n)
        return self.runs[n]

    def long(self, word: str) -> tuple[int, ...]:
        """Ids of one word, place by place."""
        cost, last = [0.0] * (len(word) + 1), [None] * (len(word) + 1)
        for at in range(1, len(word) + 1):
            self.extend(word, at, cost, last)
        return self.spelled(self.path(word, last))

    def spelled(self, pieces: list[str]) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.written, pieces)))

    def composed(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of its word for each span of codes, ids of all words, how many each has); equal spans are one word."""
        at, place = spans(start, size), spans(np.zeros(len(size), np.int64), size)
        key = np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * self.factors[place], starts(size)[:-1])
        _, one, word = np.unique(key, return_index=True, return_inverse=True)
        if (size[one][word] != size).any() or (codes[at] != codes[np.repeat(start[one][word], size) + place]).any():  # two words share a hash
            _, one, word = np.unique([codes[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)], return_index=True, return_inverse=True)
        begin, many = start[one], size[one]
        front = [np.where(many > i, codes[np.minimum(begin + i, len(codes) - 1)], 0).astype(np.int64) for i in range(9)]
        order = np.lexsort([(front[i] << 42) | (front[i + 1] << 21) | front[i + 2] for i in (6, 3, 0)])  # words that begin alike come together
        ids, n = self.shortest(codes[spans(begin[order], many[order])], many[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return back[word], ids, n

    def compose(self, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised chunks of text (those of these sizes, which follow each other in `text`) and how many each has."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = codes == ord(SPACE)
        alone = self.breaks[np.minimum(codes, 31)] & (codes < 32)
        head = alone | blank
        head[1:] = (head[1:] & ~(blank[1:] & blank[:-1])) | alone[:-1]
        head[starts(size)[:-1]] = True
        start = np.flatnonzero(head)
        length = np.diff(np.append(start, len(codes)))
        spaces = np.add.reduceat(blank, start, dtype=np.int64)
        extra = np.maximum(spaces - 1, 0)
        words = np.where(spaces < length, length - extra, 0)
        entry, ids, many = np.full(len(start), -1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.flatnonzero((words > 0) & (words <= self.wide))
        if len(short):
            entry[short], ids, many = self.composed(codes, start[short] + extra[short], words[short])
        bound = starts(many)
        more: dict[tuple[int, str | int], int] = {}
        added: list[tuple[int, ...]] = []
        for i in np.flatnonzero((spaces > 1) | (entry < 0)).tolist():  # runs of spaces, and long words
            a, n, e = int(start[i]), int(spaces[i]), int(entry[i])
            word: str | int = e if e >= 0 else text[a + int(extra[i]) : a + int(length[i])] if words[i] else ""
            if (n, word) not in more:
                more[n, word] = len(many) + len(added)
                if word == "":
                    added.append(self.spelled(self.run(n)))
                else:
                    found = tuple(ids[bound[e] : bound[e + 1]].tolist()) if e >= 0 else self.long(word)
                    if n > 1:  # the other spaces merge among themselves, with the last one if it stayed alone
                        single = found[0] == self.ids.get(SPACE)
                        found = self.spelled(self.run(n if single else n - 1)) + found[single:]
                    added.append(found)
            entry[i] = more[n, word]
        if added:
            many = np.concatenate([many, np.fromiter(map(len, added), np.int64, len(added))])
            ids, bound = np.concatenate([ids, np.fromiter(chain.from_iterable(added), np.int64)]), starts(many)
        count = many[entry]
        of_chunk = np.add.reduceat(count, np.searchsorted(start, starts(size)[:-1]))
        return ids[spans(bound[entry], count)].astype(np.int32), of_chunk

    def chunks(self, text: str) -> Iterator[str]:
        """A normalised text, cut before runs of spaces into chunks of about `block` characters, so that a long text takes no more memory."""
        text, at = SPACE + text.replace(" ", SPACE), 0
        while at < len(text):
            cut = CUT.search(text, at + self.block)
            end = cut.end() - 1 if cut else len(text)
            yield text[at:end]
            at = end

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and all end); a null or empty text has none."""
        ids, total, waiting, held = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            found, many = self.compose("".join(c for _, c in waiting), np.array([len(c) for _, c in waiting]))
            ids.append(found)
            np.add.at(total, [i for i, _ in waiting], many)

        for i, text in enumerate(texts):
            for chunk in self.chunks(text) if text else ():
                if waiting and held + len(chunk) > self.block:
                    flush()
                    waiting, held = [], 0
                waiting.append((i, chunk))
                held += len(chunk)
        if waiting:
            flush()
        return np.concatenate(ids), starts(total)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        ids, bound = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(bound, bound[1:], strict=False)]

    def decode_flat(self, ids: np.ndarray, bound: np.ndarray) -> list[str]:
        """The text of each run of ids, without the space that the normaliser put first."""
        texts = [b.decode("utf-8", "replace").replace(SPACE, " ") for b in self.spelling.written(ids, bound)]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer for each model and worker, so that its weights live from batch to batch."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    k.turn_to("pieces", _compiled.clear)
    return _compiled[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """Each row inside `row` (no name can clash), with `ids`, the piece ids of its whole text; null and empty texts have none.

    The model's bytes are broadcast. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model_bytes() if model is None else model)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        t = compiled(shared.value)
        found, bound = t.encode_flat(text.to_pylist())
        k.rest()
        return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(found, pa.int32()))

    return packed.select("row", ids("text").alias("ids"))


def decode(df: DataFrame, ids_col: str = "ids", model: bytes | None = None) -> DataFrame:
    """Each row inside `row`, with `text`, decoded from its ids; null ids give an empty text."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model_bytes() if model is None else model)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(ids_col).alias("ids"))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        t = compiled(shared.value)
        return pa.array([t.decode(x or []) for x in ids.to_pylist()], pa.string())

    return packed.select("row", text("ids").alias("text"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, round_trip) of each row: the digest of its ids as comma-joined text, and whether decoding gives the text back.

    It does not where the text holds U+2581 itself, which decodes to a space. A null text counts as empty."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model_bytes() if model is None else model)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                texts = k.column(batch, "text").slice(a, 512).to_pylist()
                ids, bound = t.encode_flat(texts)
                same = [x == (y or "") for x, y in zip(t.decode_flat(ids, bound), texts, strict=True)]
                sha = [hashlib.sha256(x[:-1]).hexdigest() for x in t.figures.written(ids, bound)]
                yield pa.RecordBatch.from_arrays([k.column(batch, "id").slice(a, 512), pa.array(np.diff(bound), pa.int64()), pa.array(sha), pa.array(same)], names=["id", "n_tokens", "ids_sha256", "round_trip"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(digest, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, round_trip boolean")
