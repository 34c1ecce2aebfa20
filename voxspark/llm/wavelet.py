"""Token ids as one wavelet matrix per shard: bit planes with rank and select, each file compressed and self-contained.

Ids are renumbered by falling frequency, so that the high planes are nearly empty and pack well. A plane is cut into blocks
that are compressed one by one, with the number of ones before each block, so that access, counting and lookups open
only the blocks they touch.
"""

from __future__ import annotations

import json
import os
import string
import struct
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxspark.llm.common import sliced, text_sizes
from voxspark.session import settle

MAGIC = b"VOXWM\x00\x00\x01"
BLOCK_BITS = 1 << 18
SHARD_BYTES = 16 << 20
#: Blocks that a matrix keeps opened, 32 KiB each.
OPENED = 512
#: Positions that are read at a time.
PIECE = 1 << 16
#: Ones are rare where there is less than one in so many bits.
RARE = 32
#: Of so many documents of a shard, one is also read token by token, by ranks, and compared.
PROBED = 512
END = 2
#: Parts of words whose ids a worker remembers; beyond that it starts anew, and what is forgotten is only found again.
REMEMBERED = 1_000_000
MARKS = string.punctuation
#: Words that the tokenizer gets at a time, joined to one text; their ids are told apart by their places in it.
JOINED = 128


def _split(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selections of the zeros and of the ones of a plane: masks where ones are rare, places otherwise."""
    if np.count_nonzero(bits) * RARE < len(bits):
        return ~bits, bits
    return np.flatnonzero(~bits), np.flatnonzero(bits)


def build(tokens: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, unnamed: int = 0) -> bytes:
    """The file of a shard: its documents' ids and numbers of tokens, and the matrix of all their tokens in order.

    The first ``unnamed`` documents have no id. A block without ones takes no bytes.
    """
    times = np.bincount(tokens)
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]  # the ids that occur, by falling frequency
    rank = np.empty(len(times), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    rank[order] = np.arange(len(order), dtype=rank.dtype)
    current = rank[tokens]
    planes = max(1, int(len(order) - 1).bit_length()) if len(order) else 0
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = [pack(np.asarray(doc_ids, "<i8").tobytes()), pack(np.asarray(lengths, "<u4").tobytes()), pack(order.astype("<u4").tobytes())]
    blocks, ones = [], []
    for plane in range(planes - 1, -1, -1):
        bits = (current & current.dtype.type(1 << plane)) != 0
        octets = np.packbits(bits)
        starts = range(0, len(octets), BLOCK_BITS // 8)
        counts = np.add.reduceat(np.bitwise_count(octets), np.array(starts), dtype=np.int64)
        ones += [0, *np.cumsum(counts).tolist()]
        blocks += [pack(octets[start : start + BLOCK_BITS // 8].tobytes()) if count else b"" for start, count in zip(starts, counts, strict=True)]
        if plane and counts.any():
            zeros, hits = _split(bits)
            current = np.concatenate((current[zeros], current[hits]))
    header = json.dumps(
        {"tokens": len(tokens), "documents": len(doc_ids), "unnamed": unnamed, "planes": planes, "sections": [len(s) for s in sections], "blocks": [len(b) for b in blocks], "ones": ones}
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections, *blocks])


class Bits:
    """A packed block as 64-bit words, with the number of ones before every 512 bits."""

    def __init__(self, octets: np.ndarray) -> None:
        padded = np.concatenate((octets, np.zeros(-len(octets) % 64 + 64, np.uint8)))
        self.words = padded.view(">u8").astype(np.uint64)
        counts = np.bitwise_count(self.words).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(counts) - counts

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (63 - (at & 63)).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before every place: of the 512 bits from the directory, and of the words in them by population counts."""
        inside = np.bitwise_count(self.words.reshape(-1, 8)[at >> 9])
        whole = np.arange(8) < (at >> 6 & 7)[:, None]
        # Shifted in two steps, as a word cannot be shifted by all its 64 bits.
        last = self.words[at >> 6] >> np.uint64(1) >> (63 - (at & 63)).astype(np.uint64)
        return self.before[at >> 9] + (inside * whole).sum(axis=1, dtype=np.int64) + np.bitwise_count(last)

    def select(self, k: int, bit: int) -> int:
        """The place of the one (or zero) number k."""
        before = self.before if bit else np.arange(len(self.before)) * 512 - self.before
        group = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.words[group * 8 : (group + 1) * 8].astype(">u8").view(np.uint8))
        return group * 512 + int(np.flatnonzero(bits == bit)[k - before[group]])


class WaveletMatrix:
    """Access, counting and lookup over the bytes of a shard file.

    Blocks are opened when they are needed and stay packed; the OPENED blocks used last are kept.
    """

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        start = len(MAGIC) + 4
        header = json.loads(data[start : start + size])
        self.length, self.planes, self.unnamed = header["tokens"], header["planes"], header["unnamed"]
        self._data, self._per_plane = data, -(-self.length // BLOCK_BITS)
        at = start + size
        parts = []
        for length, kind in zip(header["sections"], ("<i8", "<u4", "<u4"), strict=True):
            parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + length]), kind))
            at += length
        self.doc_ids, self.doc_lengths, self.alphabet = parts
        self._starts = at + np.concatenate(([0], np.cumsum(header["blocks"], dtype=np.int64)))
        self._ones = np.array(header["ones"], np.int64).reshape(self.planes, self._per_plane + 1) if self.planes else np.zeros((0, 1), np.int64)
        self._codes = {int(token): code for code, token in enumerate(self.alphabet)}
        self._opened: OrderedDict[tuple[int, int], Bits] = OrderedDict()

    def _octets(self, plane: int, block: int) -> np.ndarray:
        k = plane * self._per_plane + block
        octets = self._data[self._starts[k] : self._starts[k + 1]]
        if not octets:
            return np.zeros(-(-min(BLOCK_BITS, self.length - block * BLOCK_BITS) // 8), np.uint8)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(octets), np.uint8)

    def _block(self, plane: int, block: int) -> Bits:
        bits = self._opened.pop((plane, block), None) or Bits(self._octets(plane, block))
        self._opened[(plane, block)] = bits
        if len(self._opened) > OPENED:
            self._opened.popitem(last=False)
        return bits

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._ones[plane, block] + (self._block(plane, block).rank(np.array([rest]))[0] if rest else 0))

    def _zeros(self, plane: int) -> int:
        return self.length - int(self._ones[plane, -1])

    def access(self, i: int) -> int:
        """The token at position i."""
        return int(self.read(np.array([i]))[0])

    def read(self, positions: np.ndarray) -> np.ndarray:
        """The tokens at some positions, found by ranks plane by plane; only the blocks they lead to are opened."""
        at = np.asarray(positions, np.int64)
        if len(at) > PIECE:
            return np.concatenate([self.read(at[start : start + PIECE]) for start in range(0, len(at), PIECE)])
        if len(at) and (at.min() < 0 or at.max() >= self.length):
            raise IndexError("a position outside the shard")
        code = np.zeros(len(at), np.int64)
        for plane in range(self.planes):
            bit, rank = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            blocks = at // BLOCK_BITS
            for block in np.unique(blocks):
                here = np.flatnonzero(blocks == block)
                opened, rest = self._block(plane, int(block)), at[here] % BLOCK_BITS
                bit[here], rank[here] = opened.get(rest), self._ones[plane, block] + opened.rank(rest)
            at = np.where(bit == 1, self._zeros(plane) + rank, at - rank)
            code = code << 1 | bit
        return self.alphabet[code]

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        code = self._codes.get(token)
        if code is None:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank1(plane, start), self._rank1(plane, stop)
            if code >> (self.planes - 1 - plane) & 1:
                start, stop = self._zeros(plane) + a, self._zeros(plane) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token at positions start to stop - 1."""
        stop = self.length if stop is None else stop
        a, b = self._range(token, start, stop) if start < stop else (0, 0)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of the occurrence number k, from 0."""
        first, last = self._range(token, 0, self.length)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i, code = first + k, self._codes[token]
        for plane in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - plane) & 1
            i = self._position(plane, i - self._zeros(plane) if bit else i, bit)
        return i

    def _position(self, plane: int, k: int, bit: int) -> int:
        """The position of the one (or zero) number k in a plane."""
        before = self._ones[plane] if bit else np.minimum(np.arange(self._per_plane + 1) * BLOCK_BITS, self.length) - self._ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + self._block(plane, block).select(int(k - before[block]), bit)

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the last to the first. A plane without ones changes nothing."""
        codes = np.zeros(self.length, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            ones = int(self._ones[plane, -1])
            if ones:
                octets = np.concatenate([self._octets(plane, b) for b in range(self._per_plane)])
                zeros, hits = _split(np.unpackbits(octets, count=self.length).view(bool))
                before = np.empty_like(codes)
                before[zeros] = codes[: self.length - ones]
                before[hits] = codes[self.length - ones :] | codes.dtype.type(1 << (self.planes - 1 - plane))
                codes = before
        return self.alphabet[codes] if self.length else np.empty(0, np.uint32)


def cut(word: str) -> tuple[str, str, str]:
    """ASCII marks before a word, the word itself with A-Z lowered, and ASCII marks behind it.

    The tokenizer cuts there as well: a letter or digit never shares a piece with an ASCII mark beside it, but for an
    apostrophe before a letter; such a word stays whole, as does one whose inner part begins or ends in anything but a letter or digit.
    """
    core = word.strip(MARKS)
    if len(core) == len(word):
        return "", core.lower() if core.isascii() else core, ""
    if not core or not (core[0].isalnum() and unicodedata.normalize("NFC", core[-1]).lower()[-1].isalnum()):
        return "", word, ""
    start = word.index(core)
    if start and word[start - 1] == "'":
        return "", word, ""
    return word[:start], core.lower() if core.isascii() else core, word[start + len(core) :]


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins across ASCII white space.

    The different words of many texts are found first. They are put together from the ids of the word without marks and
    in lower case, and of its marks; those are remembered, so the tokenizer itself sees a word once in all its spellings.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self._tokenizer = Tokenizer.from_str(definition)
        self._known: dict[str, bytes] = {}
        self._special = [token.content.lower() for token in self._tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and how many every text has with it."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        found = self._found(self._parts(coded.dictionary.to_pylist()))
        table = np.frombuffer(b"".join(found) + np.array([END], "<u4").tobytes(), "<u4")
        sizes = np.append(np.fromiter(map(len, found), np.int64, len(found)).reshape(-1, 3).sum(axis=1) // 4, 1)
        first = np.cumsum(sizes) - sizes
        # The last word of every text is the end id.
        stops = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        which = np.insert(coded.indices.to_numpy(), stops, len(sizes) - 1)
        size = sizes[which]
        ends = np.cumsum(size)
        lengths = np.diff(ends[stops + np.arange(len(stops))], prepend=0)
        places = np.repeat((first[which] - (ends - size)).astype(np.int32), size)
        places += np.arange(len(places), dtype=np.int32)
        return table[places], lengths

    def _parts(self, words: list[str]) -> list[str]:
        """Three parts of every word; words that hold the text of a special token, in any case, stay as they are."""
        lowered = "\n".join(words).lower()
        if not any(special in lowered for special in self._special):
            return [part for word in words for part in cut(word)]
        held = [any(special in word.lower() for special in self._special) for word in words]
        return [part for word, whole in zip(words, held, strict=True) for part in (("", word, "") if whole else cut(word))]

    def _found(self, parts: list[str]) -> list[bytes]:
        """The ids of every part; at most REMEMBERED parts and those of one call are held."""
        if len(self._known) > REMEMBERED:
            self._known = {}
        missing = list({part for part in parts if part not in self._known})
        self._known.update(zip(missing, self._tokenized(missing), strict=True))
        return list(map(self._known.__getitem__, parts))

    def _tokenized(self, parts: list[str]) -> list[bytes]:
        """Ids of words without white space: several are given to the tokenizer at a time, and told apart by the tokens
        of their first characters. A part without such a character takes no token."""
        found = []
        for start in range(0, len(parts), JOINED):
            texts = parts[start : start + JOINED]
            encoding = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
            octets = np.array(encoding.ids, "<u4").tobytes()
            place, cuts = 0, []
            for text in texts:
                at = encoding.char_to_token(place) if text else None
                if at is None:  # an empty part, or one that begins with white space beyond ASCII
                    at = next((n for p in range(place + 1, place + len(text)) if (n := encoding.char_to_token(p)) is not None), None)
                cuts.append(at)
                place += len(text) + 1
            cuts.append(len(octets) // 4)
            for n in range(len(texts) - 1, -1, -1):
                if cuts[n] is None:
                    cuts[n] = cuts[n + 1]
            found += [octets[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return found


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    """One encoder per worker process, kept over tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes every document's ids and an end id to wavelet files in ascending order of ``doc_id``; returns (shard, tokens).

    Shards are ranges of (doc_id, hash of the text, place) of about ``shard_bytes`` of text, one task and one file each, so a repeated
    doc_id may go on in the next file; its rows are in order of their texts' hashes. A file is written under another name and then
    renamed, so a task that runs again leaves a whole file. ``folder`` is a path or URI that all executors reach. Null and
    empty texts have the end id only; documents without a doc_id come first. An empty table writes no file.
    """
    from pyarrow import fs

    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        ids, lengths, numbers = [], [], []
        for part in sliced(batches, text_sizes("text")):
            found, of_text = encoder.encode(part.column("text"))
            ids.append(found)
            lengths.append(of_text)
            numbers.append(part.column("doc_id"))
        if not ids:
            return
        context = TaskContext.get()
        tokens, doc_ids = np.concatenate(ids), pa.chunked_array(numbers)
        system, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/shard-{context.partitionId():08d}.wavelet"
        part = f"{path}/_part-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(build(tokens, doc_ids.fill_null(0).to_numpy(), np.concatenate(lengths), doc_ids.null_count))
        system.move(part, name)
        yield pa.record_batch([pa.array([context.partitionId()], pa.int32()), pa.array([len(tokens)], pa.int64())], ["shard", "tokens"])

    order = (F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("place"))
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("tie", "place")
    return settle(placed.mapInArrow(write, "shard int, tokens long"))


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the wavelet files; files are read by Spark, one a task.

    Every token is decoded; of one document in PROBED they are also read through ranks, which must agree.
    ``shards`` is what write_shards returned: a row per file, of which the starts are summed up.
    """
    import zlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                matrix = WaveletMatrix(content.as_py())
                tokens = matrix.tokens()
                octets = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(matrix.doc_lengths, dtype=np.int64)
                starts = ends - matrix.doc_lengths
                for start, end in zip(starts[::PROBED].tolist(), ends[::PROBED].tolist(), strict=True):
                    if (matrix.read(np.arange(start, end)) != tokens[start:end]).any():
                        raise ValueError(f"ranks and planes differ in shard {shard}")
                sums = [zlib.crc32(octets[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(ends), shard, np.int32)),
                    pa.array(matrix.doc_ids, mask=np.arange(len(ends)) < matrix.unnamed),
                    pa.array(starts),
                    pa.array(matrix.doc_lengths.astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "position", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wavelet").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.wavelet$", 1).cast("int").alias("shard")
    documents = files.select(shard, "content").mapInArrow(read, "shard int, doc_id long, position long, n_tokens long, ids_crc32 long")
    # One row per file; summed over ranges of 1024 files first, so that no window holds more than that many rows.
    group = F.floor(F.col("shard") / 1024).alias("group")
    groups = shards.groupBy(group).agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.withColumn("group", group)
        .withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(groups, "group")
        .select("shard", (F.col("base") + F.col("inside")).alias("base"))
    )
    return documents.join(starts, "shard").select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
