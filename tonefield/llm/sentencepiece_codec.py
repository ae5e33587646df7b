"""SentencePiece encoding and decoding by a streaming Viterbi search over piece boundaries.

The public model at hand is of the BPE kind, so the best path to a boundary is the one that the model's merges
leave there, not the one with the greatest sum of scores. That path is unique and can be extended boundary by
boundary: a piece may end a prefix exactly if the merges keep it apart from the last piece of the prefix before
it. The search is then a Viterbi search with one survivor a boundary, and gives the library's ids.

Text that fits into the window is searched side by side: one step extends the paths of many such parts by a boundary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import with_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: No piece has a space mark after another character, so all paths meet where such a mark follows one. What lies
#: between two such boundaries is searched once and remembered; so are its parts, if it has characters that no piece joins.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Bytes of searched chunks, and again of pairs of pieces, that a worker remembers; what one entry takes besides its text.
REMEMBERED, ENTRY = 48 << 20, 220
#: Characters of texts, and of new chunks, that are searched together.
TOGETHER = 1 << 20


def model_kind(proto: bytes) -> int:
    """model_type of a model file (1: unigram, 2: BPE, 3: word, 4: char): field 3 of the trainer's specification, field 2."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value, shift = 0, 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + n]
                at += n

    trainer = next((v for k, v in fields(proto) if k == 2 and isinstance(v, bytes)), b"")
    return next((v for k, v in fields(trainer) if k == 3 and isinstance(v, int)), 1)


class Pieces:
    """The vocabulary as plain data, read once on the driver."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if model_kind(m.serialized_model_proto()) != 2:
            raise ValueError(f"{model_file} is not of the BPE kind, the only one whose encoding this search gives")
        ids = range(m.vocab_size())
        self.piece = [m.id_to_piece(i) for i in ids]
        self.byte = {int(self.piece[i][3:5], 16): i for i in ids if m.is_byte(i)}
        special = {i for i in ids if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        self.special, self.unknown = special - set(self.byte.values()), m.unk_id()
        self.id = {self.piece[i]: i for i in ids if i not in special}
        self.score = {self.piece[i]: m.get_score(i) for i in ids if i not in special}
        if any(SPACE in x.lstrip(SPACE) for x in self.id):
            raise ValueError(f"{model_file} has pieces with a space mark inside, across which paths need not meet")
        self.longest = max(map(len, self.id))
        #: Characters that follow each other in a piece; between any other two lies a boundary of every path.
        self.inside = {two for x in self.id for two in pairwise(x)}
        self.key = zlib.crc32("\n".join(self.piece).encode())
        order = sorted(self.id, key=lambda x: -self.score[x])
        self.rank = {x: k for k, x in enumerate(order) if len(x) > 1}
        #: The two parts that the merges join last when a piece stands alone; none for a piece that they never make.
        self.split = {x: y for x in self.rank if (y := self.halves(x))}

    def halves(self, text: str) -> tuple[str, str] | None:
        parts, pair, rank = list(text), None, self.rank
        while len(parts) > 1:
            found = [(rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank]
            if not found:
                return None
            i = min(found)[1]
            pair = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return pair


class Searched(dict):
    """The ids of each chunk, searched when it is first asked for.

    When half of REMEMBERED is full, what was held becomes the older half, from which chunks that are asked for again come
    back; the rest is forgotten when the next half is full.
    """

    def __init__(self, codec: "Codec"):
        self.codec, self.older, self.held = codec, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.pop(chunk, None)
        if ids is None:
            ids = self.codec.searched(chunk)
        self.keep({chunk: ids})
        return ids

    def keep(self, found: dict[str, bytes]) -> None:
        more = ENTRY * len(found) + 3 * sum(map(len, found))
        self.held += more
        if self.held > REMEMBERED // 2:
            self.older = self.copy()
            self.clear()
            self.held = more
        self.update(found)

    def those(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """The ids of chunks that differ; those that are new are searched together."""
        here, again, new, older = {}, {}, [], self.older
        for x in chunks:
            ids = self.get(x)
            if ids is None:
                ids = older.pop(x, None)
                if ids is None:
                    new.append(x)
                    continue
                again[x] = ids
            here[x] = ids
        again.update(self.codec.together.search(new))
        self.keep(again)
        here |= again
        for x in new:
            if x not in here:
                here[x] = self[x]
        return here


class Lookup:
    """Values from 0 on by keys from 1 on, asked for many keys at once; a key whose place is taken goes to the next free one."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that differ and are not held. When half of the places would be taken, all that was held is forgotten."""
        if self.n + len(keys) > len(self.keys) // 2:
            self.keys[:] = self.n = 0
            keys, values = keys[: len(self.keys) // 2], values[: len(self.keys) // 2]
        self.n += len(keys)
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys  # of several that want a place, the last one written has it
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & len(self.keys) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = here = at[left] + 1 & len(self.keys) - 1
            held = self.keys[here]
            same = held == keys[left]
            out[left[same]] = self.values[here[same]]
            left = left[~same & (held != 0)]
        return out


class Together:
    """The codec's search for many chunks at once, over arrays. Characters and pieces are their ids."""

    def __init__(self, codec: "Codec"):
        p = codec.p
        self.codec, self.wide = codec, 2 * p.longest
        #: The empty piece is v; no character is v + 1.
        self.v = v = len(p.piece)
        self.text = [*p.piece, ""]
        self.length = np.array([len(x) for x in p.piece], np.int64)
        #: By code point: the id of a character; -1 if it is in no piece, -2 if only longer pieces have it.
        self.char = np.full(0x110000, -1, np.int64)
        self.char[[ord(c) for x in p.id for c in x]] = -2
        one = [x for x in p.id if len(x) == 1]
        self.char[list(map(ord, one))] = [p.id[x] for x in one]
        #: The codec's trie, its nodes numbered: by character the node it leads to from the root, and from a node; the piece there, or -1.
        self.root = np.full(v + 2, -1, np.int64)
        made, steps, todo = [-1], [], [(None, c, node) for c, node in codec.trie.items()]
        for parent, c, node in todo:
            k = len(made)
            if parent is None:
                made.append(-1)
                if (i := p.id.get(c)) is not None:
                    self.root[i] = k
                else:
                    continue
            else:
                piece, node = node
                made.append(p.id[piece] if piece in p.split else -1)
                if (i := p.id.get(c)) is None:
                    continue
                steps.append((self.key(parent, i), k))
            todo += [(k, c, x) for c, x in node.items()]
        self.made = np.array(made, np.int64)
        self.steps, self.inside, self.pairs = Lookup((4 * len(steps) + 4).bit_length()), Lookup((4 * len(p.inside) + 4).bit_length()), Lookup(20)
        if steps:
            self.steps.put(*np.array(steps, np.int64).T.copy())
        two = self.char[np.array([[ord(x), ord(y)] for x, y in p.inside], np.int64).reshape(-1, 2)]
        two = two[(two >= 0).all(1)]
        self.inside.put(self.key(two[:, 0], two[:, 1]), np.ones(len(two), np.int32))

    def key(self, a, b):
        """One key, from 1 on, of a node or piece and a piece that follows or a character."""
        return a * (self.v + 2) + b + 1

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self.key(a, b)
        out = self.pairs.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            two, which = np.unique(keys[new], return_inverse=True)
            x, y = divmod(two - 1, self.v + 2)
            stay, text = self.codec.stay, self.text
            found = np.array([stay(text[i], text[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int32)
            self.pairs.put(two, found)
            out[new] = found[which]
        return out > 0

    def search(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks with their ids; without those that have a part too long for the window, which are to go through the stream."""
        for some in groups(x for x in chunks if len(x) <= TOGETHER):
            yield from self.search_some(some)

    def search_some(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        char = self.char[code]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(size) - size
        # parts: no piece joins the characters between which they end
        starts = np.ones(len(code), bool)
        starts[1:] = (char[1:] < 0) | (char[:-1] < 0)
        both = np.flatnonzero(~starts)
        starts[both] = self.inside.get(self.key(char[both - 1], char[both])) < 0
        starts[first] = True
        part = np.flatnonzero(starts)
        long = np.diff(part, append=len(code))
        # a part lies behind a place for its start, at which no path has a piece
        at = np.arange(len(code)) + np.cumsum(starts)
        there = np.full(len(code) + len(part), self.v + 1, np.int64)
        there[at] = char
        base = at[part] - 1
        last = np.full(len(there), self.v, np.int64)
        alone = char[part] < 0  # of a character that has no id
        last[at[part[alone]]] = -1
        own = np.flatnonzero(~alone & (long <= self.wide))
        own = own[np.argsort(-long[own], kind="stable")]
        below = np.cumsum(np.bincount(long[own], minlength=1)[::-1])[::-1]
        for i, n in enumerate(below[1:], 1):
            self.extend(there, last, base[own[:n]] + i)
        # followed back, the paths mark where their pieces end
        ends = np.zeros(len(there), bool)
        ends[base[alone] + 1] = True
        back, base_of = base[own] + long[own], base[own]
        while len(back):
            ends[back] = True
            back = back - self.length[last[back]]
            go = back > base_of
            back, base_of = back[go], base_of[go]
        where = np.flatnonzero(ends)
        ids = last[where]
        before = np.searchsorted(where, np.append(at[first], len(there)))
        if alone.any():
            # a character without an id has several, of its bytes
            points, which = np.unique(code[part[alone]], return_inverse=True)
            bytes_of = [self.codec.ids(chr(c)) for c in points.tolist()]
            times, none = np.ones(len(ids), np.int64), ids < 0
            times[none] = np.array([len(x) for x in bytes_of])[which]
            before = np.append(0, np.cumsum(times))[before]
            ids = np.repeat(ids, times)
            ids[ids < 0] = np.concatenate([bytes_of[k] for k in which.tolist()])
        data = ids.astype(np.int32).tobytes()
        # a character without an id that longer pieces have is left to the stream too
        out = np.logical_or.reduceat(char == -2, first)
        out[np.searchsorted(first, part[long > self.wide], "right") - 1] = True
        for chunk, left, a, b in zip(chunks, out.tolist(), (4 * before[:-1]).tolist(), (4 * before[1:]).tolist(), strict=True):
            if not left:
                yield chunk, data[a:b]

    def extend(self, there: np.ndarray, last: np.ndarray, end: np.ndarray) -> None:
        """The last piece of the path to each boundary of end, as Codec.stream finds it: pieces are tried from the shortest on."""
        piece, at = there[end], end - 1
        node = self.root[piece]
        last[end] = piece
        stay = self.stay(last[at], piece)
        while True:
            go = np.flatnonzero(~stay & (node >= 0))
            end, at = end[go], at[go]
            node = self.steps.get(self.key(node[go], there[at]))
            go = np.flatnonzero(node >= 0)
            if not len(go):
                return
            end, at, node = end[go], at[go] - 1, node[go]
            piece = self.made[node]
            tried = np.flatnonzero(piece >= 0)
            stay = np.zeros(len(piece), bool)
            stay[tried] = self.stay(last[at[tried]], piece[tried])
            last[end[stay]] = piece[stay]


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of TOGETHER characters at most, or of one text."""
    some, n = [], 0
    for text in texts:
        if some and n + len(text) > TOGETHER:
            yield some
            some, n = [], 0
        some.append(text)
        n += len(text)
    if some:
        yield some


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Codec:
    def __init__(self, pieces: Pieces):
        self.p, self.known, self.pairs, self.tied = pieces, Searched(self), {}, 0
        #: By last character, then by each before it: the piece that starts there, or None, and what may precede.
        self.trie: dict[str, dict] = {}
        for x in pieces.rank:
            node = self.trie.setdefault(x[-1], {})
            for c in x[-2:0:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[x[0]] = (x, node[x[0]][1] if x[0] in node else {})
        self.together = Together(self)
        own = {i: bytes([b]) for b, i in pieces.byte.items()}
        self.bytes = [own.get(i) or (b"" if i in pieces.special else piece.encode()) for i, piece in enumerate(pieces.piece)]

    def stay(self, a: str, b: str) -> bool:
        """Whether the merges leave the pieces a and b as they are when b follows a; a may be empty.

        Going back in time, the latest merge that made either is undone, so that x and y are the parts that
        touched before it. Had the model joined x and y earlier than that merge, the two would not be here. Of
        merges with the same result the left one comes first, hence the half step.
        """
        rank, split = self.p.rank, self.p.split
        if (split.get(b) is None and len(b) > 1) or not a:
            return split.get(b) is not None or len(b) == 1
        x, y, until = a, b, 1e18
        while True:
            joined = rank.get(x + y)
            if joined is not None and joined < until:
                return False
            rx, ry = rank.get(x, 0) if len(x) > 1 else -1, rank.get(y, 0) if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, until = split[x][1], rx
            else:
                y, until = split[y][0], ry + 0.5

    def after(self, piece: str) -> dict[str, bool]:
        """Of the pieces that were tried after this one, whether both stay."""
        self.tied += 1
        return self.pairs.setdefault(piece, {})

    def stream(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in order, as soon as they are certain.

        The window holds, for each boundary since the committed one, the last piece of the path that survives
        there. That path is the only one, so the pieces that end at a boundary are tried from the shortest on until one
        stays. Whenever the window has two lengths of the longest piece, the paths from which a piece can still start are
        followed back; what precedes the boundary on which all converge is committed and leaves the window.
        """
        trie, pairs, longest, n = self.trie, self.pairs, self.p.longest, len(text)
        base, look = 0, 2 * longest
        last, tied = [""], [self.after("")]

        def path(to: int) -> list[str]:
            out = []
            while to > 0:
                piece = last[to]
                out.append(piece)
                to -= len(piece)
            out.reverse()
            return out

        for at, end in enumerate(text):
            i = at - base
            if i >= look:
                alive = set(range(i - longest + 1, i + 1))
                while len(alive) > 1:
                    top = max(alive)
                    alive.discard(top)
                    alive.add(top - len(last[top]))
                to = alive.pop()
                if to > 0:
                    yield path(to)
                    base, last, tied, i = base + to, last[to:], tied[to:], i - to
                look = i + longest
            piece, node = end, trie.get(end)
            while True:
                if piece is not None:
                    known = tied[i]
                    ok = known.get(piece)
                    if ok is None:
                        ok = known[piece] = self.stay(last[i], piece)
                        self.tied += 1
                    if ok:
                        break
                i -= 1
                step = node.get(text[base + i]) if node and i >= 0 else None
                if step is None:
                    piece = end
                    break
                piece, node = step
            last.append(piece)
            known = pairs.get(piece)
            tied.append(self.after(piece) if known is None else known)
        if n:
            yield path(n - base)

    def ids(self, piece: str) -> list[int]:
        i = self.p.id.get(piece)
        if i is not None:
            return [i]
        data = piece.encode("utf-8", "replace")
        return [self.p.byte[b] for b in data] if self.p.byte else [self.p.unknown]

    def searched(self, chunk: str) -> bytes:
        inside = self.p.inside
        # letters alone are hardly ever parted
        cuts = [] if chunk[1:].isalpha() else [i for i, two in enumerate(pairwise(chunk), 1) if two not in inside]
        if cuts:
            return b"".join([self.known[chunk[i:j]] for i, j in pairwise([0, *cuts, len(chunk)])])
        if self.tied * ENTRY > REMEMBERED:
            self.pairs.clear()
            self.tied = 0
        one, of = self.p.id, []
        for pieces in self.stream(chunk):
            for piece in pieces:
                i = one.get(piece)
                of += self.ids(piece) if i is None else (i,)
        return pack(f"{len(of)}i", *of)

    def arrays(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the chunks of several that are not known yet are searched together."""
        for some in groups(texts):
            parted = [chunks_of(text) for text in some]
            here = self.known.those(set().union(*parted))
            for chunks in parted:
                yield np.frombuffer(b"".join(map(here.__getitem__, chunks)), np.int32)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks_of(text))), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text: bytes joined, marks as spaces, without the space that encoding put first."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


#: By vocabulary, for the life of a worker: tasks that follow find the chunks of those before.
_codecs: dict[int, Codec] = {}


def codec_of(pieces: Pieces) -> Codec:
    if pieces.key not in _codecs:
        _codecs[pieces.key] = Codec(pieces)
    return _codecs[pieces.key]


def encoded(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip for each row of docs (doc_id, text).

    round_trip: decoding the ids gives the text back; it fails only for texts that hold the space mark itself.
    A null text has null ids, no tokens and a null round_trip; an empty one has no ids. Repeated rows are
    encoded alike; an empty table gives an empty result.
    """
    pieces = Pieces(model_file)

    def of(texts: list[str | None]) -> dict:
        codec = codec_of(pieces)
        found = codec.arrays([t for t in texts if t is not None])
        ids = [None if t is None else next(found) for t in texts]
        same = [None if t is None else codec.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
        return {"ids": ids, "n_tokens": [0 if i is None else len(i) for i in ids], "round_trip": same}

    return with_texts(docs, ["doc_id"], of, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "round_trip": pa.bool_()})


def decoded(tokens: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, text for each row of tokens (doc_id, ids); null ids have a null text."""
    pieces = Pieces(model_file)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(pieces)
        for b in batches:
            text = [None if i is None else codec.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(of, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
