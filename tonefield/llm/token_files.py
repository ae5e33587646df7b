"""Token-id files: words of 64 bits whose selector says how many ids they pack, with blocks that can be read on their own."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import TEXTS, new_path, of_texts, stored
from .warc import open_fs

VOCABULARY, END = "word_bpe_49k.json", 2
#: Fixed values of the code: (ids a word, bits an id) of the selectors 2 to 15. Selector 1 is a run of ZEROS zeros, and
#: selector 0 an escape: an id of more than 60 bits, which stands whole after the words of its block.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, RUN, ZEROS = 0, 1, 120
COUNTS = np.array([1, ZEROS, *(c for c, _ in PACKINGS)], np.int64)
#: Ids of a block at most; a block belongs to one document.
BLOCK = 8192
#: A file is closed once it has so many bytes; bytes of blocks read at once.
FILE, READ = 256 << 20, 4 << 20
MAGIC = b"S8BTOK01"
TAIL = struct.Struct("<QQQ8s")
BLOCK_ROW = np.dtype([("offset", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("escapes", "<u4")])
DOC_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("blocks", "<u4"), ("ids", "<u8")])

#: What lies between ASCII white space is encoded by itself where the vocabulary's file parts words as below.
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Fixed values of the public vocabulary: its pattern of words. RULES are the parts of its file that the short cut rests on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
#: Texts of these letters and ASCII keep their form under NFC, and their words can be told by a plain pattern.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]*")
WORD = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x09-\x0D\x200-9a-zß-öø-ÿ]+")
#: Bytes of encoded words that a worker remembers, and again of older ones; what one takes besides its text.
REMEMBERED, ENTRY = 48 << 20, 200


#: Bits of each id below 2**16.
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bits_of(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < len(BITS):
        return BITS[ids]
    out = np.frexp(np.minimum(ids, 1 << 52).astype(np.float64))[1].astype(np.uint8)
    large = ids >= 1 << 52
    out[large] = [int(x).bit_length() for x in ids[large]]
    return out


def all_of(fits: np.ndarray, count: int) -> np.ndarray:
    """Where `count` neighbours from here on all fit, by runs that double; nothing stands after the end."""
    run = 1
    while run < count:
        more = min(run, count - run)
        fits = np.append(fits[:-more] & fits[more:], fits[-more:])
        run += more
    return fits


def selectors(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each id the selector of a word that would begin with it: the one that takes most ids of those that fit.

    A block's last word may have room left, so each block is laid out with room for the longest word after it.
    """
    at = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)) * ZEROS, lengths)
    own = bits_of(ids)
    bits = np.zeros(len(ids) + len(lengths) * ZEROS, np.uint8)
    bits[at] = own
    chosen = np.zeros(len(bits), np.uint8)
    for selector, (count, width) in reversed(list(enumerate(((ZEROS, 0), *PACKINGS), RUN))):
        if (own <= width).any():
            np.copyto(chosen, np.uint8(selector), where=all_of(bits <= width, count))
    return chosen[at]


def packed(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, escapes, bytes) of each block: ids one after the other, lengths says how many of them each block has."""
    ids = ids.astype(np.uint64)
    bound = np.append(0, np.cumsum(lengths))
    if not len(ids):
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    chosen = selectors(ids, lengths)
    step = np.minimum(np.arange(len(ids)) + COUNTS[chosen], np.repeat(bound[1:], lengths))
    starts, i, n, to = [], 0, len(ids), step.tolist()
    while i < n:
        starts.append(i)
        i = to[i]
    starts = np.array(starts)
    kinds, until = chosen[starts], step[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.uint64(0))
    for selector, (count, width) in enumerate(PACKINGS, 2):
        rows = np.flatnonzero(kinds == selector)
        for j in range(count if len(rows) else 0):
            place = starts[rows] + j
            value = padded[np.minimum(place, n)]
            value[place >= until[rows]] = 0
            words[rows] |= value << np.uint64(j * width)
    escaped = starts[kinds == ESCAPE]
    of_word, of_escape = np.searchsorted(starts, bound), np.searchsorted(escaped, bound)
    raw = ids[escaped]
    made = [words[a:b].tobytes() + raw[c:d].tobytes() for a, b, c, d in zip(of_word, of_word[1:], of_escape, of_escape[1:], strict=False)]
    return np.diff(of_word), np.diff(of_escape), made


def unpacked(data: bytes, blocks: np.ndarray) -> np.ndarray:
    """The ids of blocks (rows of BLOCK_ROW) whose bytes follow each other in data, all decoded at once."""
    every = np.frombuffer(data, "<u8")
    n_words, n_ids, n_escapes = (blocks[c].astype(np.int64) for c in ("words", "ids", "escapes"))
    # a block's words are followed by its escapes
    size = np.column_stack([n_words, n_escapes]).ravel()
    is_word = np.repeat(np.tile([True, False], len(blocks)), size)
    words, raw = every[is_word], every[~is_word]
    kinds = (words >> np.uint64(60)).astype(np.int64)
    total = int(n_ids.sum())
    # a word's first id: what the words before it in its block hold, after the ids of the blocks before
    held = np.cumsum(COUNTS[kinds]) - COUNTS[kinds]
    first_word = np.cumsum(n_words) - n_words
    shift = np.where(n_words > 0, np.cumsum(n_ids) - n_ids - (np.append(held, 0))[first_word], 0)
    at, end = held + np.repeat(shift, n_words), np.repeat(np.cumsum(n_ids), n_words)
    out = np.zeros(total, np.uint64)
    for selector, (count, width) in enumerate(PACKINGS, 2):
        rows = np.flatnonzero(kinds == selector)
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(rows) else 0):
            place = at[rows] + j
            value = words[rows] >> np.uint64(j * width) & mask
            inside = place < end[rows]
            if not inside.all():
                place, value = place[inside], value[inside]
            out[place] = value
    out[at[kinds == ESCAPE]] = raw
    return out


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """What `of` makes of each key, asked for when the key is first met, in bounded memory.

    When the newer half is full it takes the place of the older one, from which what is met again moves up.
    """

    def __init__(self, of):
        self.of, self.held, self.older = of, 0, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.of(key)
        self.held += ENTRY + len(key) + len(made)
        if self.held > REMEMBERED:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = made
        return made


class Encoder:
    """The library's ids of a text.

    Random texts have many words that are met once, and the library's own preparation of a word costs several times
    its merges. So texts of plain letters are parted here, by the rules that the vocabulary's file states, and only
    their words go to the library's model. In all other texts what lies between white space goes to the library, and
    so does every text as a whole where a vocabulary has other rules.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        parts = lambda x: (x or {}).get("normalizers") or (x or {}).get("pretokenizers")
        self.known = all(parts(said[k]) == v for k, v in RULES.items()) and not said["truncation"] and not said["padding"]
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letter = {chr(b): "".join(letters[x] for x in chr(b).encode()) for b in range(256)}
        self.words, self.chunks = Memo(self.of_word), Memo(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        word = word if word.isascii() else "".join(map(self.letter.__getitem__, word))
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.known:
            return np.frombuffer(self.whole(text), np.uint32)
        if "<|" not in text and PLAIN.fullmatch(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, WORD.findall(text.lower()))), np.uint32)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, CHUNK.findall(text))), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for the life of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


KEY = ("lacks", "doc_id", "mark", "salt")


def keyed(docs: DataFrame) -> DataFrame:
    """(lacks, doc_id, mark, salt, text) of each row: what orders it, so that rows of one id and even of one text lie apart."""
    doc_id = F.col("doc_id").cast("long")
    salt = F.xxhash64(F.monotonically_increasing_id())
    return docs.select(doc_id.isNull().alias("lacks"), doc_id.alias("doc_id"), F.xxhash64("text").alias("mark"), salt.alias("salt"), F.col("text").cast("string").alias("text"))


def order_of(row: tuple) -> tuple:
    return (row[0], row[1] or 0, row[2], row[3])


def ranges(rows: DataFrame, n: int) -> list[tuple]:
    """Where n ranges of like many rows begin but for the first, from the keys alone; the driver gets a row a range."""
    dealt = rows.select(*KEY).repartitionByRange(n, *KEY)
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("first")).select("first.*").collect()
    return sorted(order_of(tuple(r)) for r in firsts)[1:]


CODED = pa.schema({"lacks": pa.bool_(), "doc_id": pa.int64(), "mark": pa.int64(), "salt": pa.int64(), "range": pa.int32(), "n_ids": pa.int64(), "blocks": pa.list_(pa.int32()), "data": pa.binary()})


def coded(rows: DataFrame, starts: list[tuple], tokenizer: str, end: int = END) -> DataFrame:
    """The key of each row, its range, and its packed blocks: n_ids, of each block the words, ids and escapes, and the data."""

    def of(keys: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
        known = encoder(tokenizer)
        ids = [np.append(known.ids(t), np.uint32(end)) for t in texts]
        n = np.array([len(x) for x in ids], np.int64)
        of_doc = -(-n // BLOCK)
        lengths = np.full(int(of_doc.sum()), BLOCK, np.int64)
        lengths[np.cumsum(of_doc) - 1] = n - (of_doc - 1) * BLOCK
        n_words, n_escapes, data = packed(np.concatenate(ids), lengths)
        table = np.column_stack([n_words, lengths, n_escapes]).astype(np.int32)
        to = np.append(0, np.cumsum(of_doc))
        parts = list(zip(to, to[1:], strict=False))
        columns = [*zip(*keys, strict=True), [bisect_right(starts, order_of(k)) for k in keys], n, [table[a:b].ravel() for a, b in parts], [b"".join(data[a:b]) for a, b in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CODED.types, strict=True)], schema=CODED)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                columns = [c.to_pylist() for c in b.slice(at, TEXTS).columns]
                yield of(list(zip(*columns[:4], strict=True)), columns[4])

    return of_texts(rows).mapInArrow(mapped, "lacks boolean, doc_id long, mark long, salt long, range int, n_ids long, blocks array<int>, data binary")


class Writer:
    """One file: the blocks, then where each begins, then the documents, then where these tables are."""

    def __init__(self, folder: str):
        self.path = f"{folder}/ids-{uuid.uuid4().hex}.s8b"
        self.fs, self.at = open_fs(self.path)
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.at}.part", compression=None)
        self.out.write(MAGIC)
        self.bytes, self.ids = len(MAGIC), 0
        self.blocks: list[tuple] = []
        self.docs: list[tuple] = []

    def put(self, doc_id: int | None, n_ids: int, blocks: list[int], data: bytes) -> None:
        self.out.write(data)
        for words, ids, escapes in zip(blocks[::3], blocks[1::3], blocks[2::3], strict=True):
            self.blocks.append((self.bytes, words, ids, escapes))
            self.bytes += 8 * (words + escapes)
        self.docs.append((doc_id or 0, doc_id is None, len(blocks) // 3, n_ids))
        self.ids += n_ids

    def close(self) -> dict:
        self.out.write(np.array(self.blocks, BLOCK_ROW).tobytes() + np.array(self.docs, DOC_ROW).tobytes())
        self.out.write(TAIL.pack(self.bytes, len(self.blocks), len(self.docs), MAGIC))
        self.out.close()
        self.fs.move(f"{self.at}.part", self.at)
        return {"path": self.path, "n_docs": len(self.docs), "n_ids": self.ids}


FILES = pa.schema({"part": pa.int32(), "place": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()})


def written(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(part, place, path, n_docs, n_ids): the files in `folder` that hold the ids of docs (doc_id, text), in order by part and place.

    Each text is encoded whole, and the id `end` closes it; a null text is empty. Ids stand in ascending doc_id, a null
    doc_id after all others; rows of one doc_id in an order by their text. Whole numbers only are document ids. An
    empty table writes nothing. Other columns play no part.

    A first pass over the keys finds the ranges. Then texts are encoded and packed where they are read, and only packed
    ids are dealt out, to the ranges' tasks, once. Rows that repeat an id are parted by text and place, so no id makes a
    range large. Each task writes files of its own, and the table lists those of the tasks that were finished; what a
    lost executor left behind is never read.
    """
    tokenizer = tokenizer or vocabulary()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    dealt = coded(rows, ranges(rows, n), tokenizer, end).repartitionById(n, F.col("range")).sortWithinPartitions(*KEY)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            nonlocal place
            place += 1
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, **out.close()}], FILES)

        for b in batches:
            for doc_id, n_ids, blocks, data in zip(*(b.column(i) for i in range(4)), strict=True):
                out = out or Writer(folder)
                out.put(doc_id.as_py(), n_ids.as_py(), blocks.as_py(), data.as_py())
                if out.bytes > FILE:
                    yield closed()
                    out = None
        if out:
            yield closed()

    return stored(dealt.select("doc_id", "n_ids", "blocks", "data").mapInArrow(of, "part int, place int, path string, n_docs long, n_ids long"), "id-files")


def documents(path: str) -> Iterator[tuple[int | None, Iterator[np.ndarray], int]]:
    """(doc_id, its ids in turns, how many they are) of each document of one file; about READ bytes of blocks are decoded at once."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        f.seek(f.size() - TAIL.size)
        end, n_blocks, n_docs, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of ids")
        f.seek(end)
        blocks = np.frombuffer(f.read(n_blocks * BLOCK_ROW.itemsize), BLOCK_ROW)
        docs = np.frombuffer(f.read(n_docs * DOC_ROW.itemsize), DOC_ROW)
        offsets = np.append(blocks["offset"], end).astype(np.int64)

        def decoded() -> Iterator[np.ndarray]:
            a = 0
            while a < n_blocks:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ, "right")) - 1)
                f.seek(int(offsets[a]))
                ids = unpacked(f.read(int(offsets[b] - offsets[a])), blocks[a:b])
                yield from np.split(ids, np.cumsum(blocks["ids"][a : b - 1].astype(np.int64)))
                a = b

        turns = decoded()
        for d in docs:
            here = (next(turns) for _ in range(int(d["blocks"])))
            yield None if d["null"] else int(d["doc_id"]), here, int(d["ids"])
            for _ in here:  # what the caller has left
                pass


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files, and its ids if asked for.

    start: the ids of all documents before it, in the order of the files. The driver gets a row a file.
    """
    spark = files.sparkSession
    some = sorted((r["part"], r["place"], r["path"], r["n_ids"]) for r in files.collect())
    bases = accumulate((r[3] for r in some), initial=0)
    listed = spark.createDataFrame([(path, base) for (_, _, path, _), base in zip(some, bases, strict=False)], "path string, base long")
    schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {}))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                kept = 0
                for doc_id, turns, said in documents(path):
                    crc, n, all_ids = 0, 0, []
                    for ids in turns:
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        n += len(ids)
                        all_ids += [ids] * with_ids
                    if n != said:
                        raise ValueError(f"a document in {path} has {n} ids instead of {said}")
                    rows.append((doc_id, base, n, crc, *([np.concatenate(all_ids).astype(np.int64)] if with_ids else [])))
                    base += n
                    kept += n if with_ids else 1
                    if kept > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, kept = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return listed.repartition(max(1, min(10_000, len(some)))).mapInArrow(of, out)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes the ids of docs into new files in the shared folder and reads those."""
    return read(written(docs, new_path(spark, "ids"), tokenizer, end))
