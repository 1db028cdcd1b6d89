"""BPE encoding and decoding through a table of distinct words.

Texts are cut into words where the tokenizer's own splitting never goes across (``word_starts``), so that a word's ids
depend on nothing else. A task numbers the distinct words of a slice of texts. Spark brings equal words of all slices
together, each distinct word is encoded once, and its ids go back to the slices that hold it; there they meet the
slice's texts, as numbers of words, and are put at the words' positions. Decoding joins each id with its piece: the
vocabulary's table has a fixed size and is sent to all tasks.

The words of a bounded sample of texts (``KNOWN_WORDS`` at most) are encoded beforehand and known to all tasks: they
make up most of any text and needn't be moved. All other words go through the shuffle, and ids don't depend on the sample.
Words and texts of the slices come from two scans, so that texts are written nowhere: a slice's words, decoded from
their ids, must have the checksum that the scan of its texts found, else the job fails (docs that differ from scan to scan).

Defined cases: a null text counts as empty; an empty text has no ids, the digest of nothing and decodes to the
empty text; control strings of the tokenizer (``<|endoftext|>``) become their ids, as the tokenizers
library makes them; ids without a piece decode to nothing, and bytes that are no UTF-8 to replacement characters; rows
that repeat a doc_id are each encoded; a null doc_id is kept; a text without white space or signs is one word, whatever its
length; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices

#: words that all tasks know beforehand, of so many bytes at most each, from about so many texts
KNOWN_WORDS, KNOWN_BYTES, SAMPLE_TEXTS = 1 << 18, 32, 12_000
#: a slice ends after so many words, or so many distinct ones that aren't known
SLICE_SIZE, SLICE_WORDS = 1 << 20, 200_000
#: words at a time where ids and pieces are put in place
BLOCK = 1 << 15


class Pieces:
    """Byte strings by number, in one buffer."""

    def __init__(self, values: list[bytes], dtype: str = "u1"):
        self.flat = np.frombuffer(b"".join(values), dtype)
        width = np.dtype(dtype).itemsize
        self.at = np.concatenate([[0], np.cumsum([len(v) // width for v in values], dtype=np.int64)])

    def followed_by(self, other: Pieces) -> Pieces:
        out = Pieces([])
        out.flat, out.at = np.concatenate([self.flat, other.flat]), np.concatenate([self.at, self.at[-1] + other.at[1:]])
        return out

    def placed(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of the numbers one after the other, and the offset of each."""
        lengths = self.at[numbers + 1] - self.at[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(ends[-1], self.flat.dtype)
        for k in range(0, len(numbers), BLOCK):
            some = slice(k, k + BLOCK)
            low, n = ends[k], lengths[some]
            shift = np.repeat(self.at[numbers[some]] - (ends[:-1][some] - low), n)
            out[low : low + len(shift)] = self.flat[shift + np.arange(len(shift))]
        return out, ends


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def checked(spec: str) -> dict:
    """The parsed tokenizer file, if its words can be cut at white space."""
    parsed = json.loads(spec)
    before = parsed.get("pre_tokenizer") or {}
    if (parsed.get("normalizer"), before.get("type"), before.get("add_prefix_space")) != (None, "ByteLevel", False):
        raise ValueError("a byte-level tokenizer without normaliser or prefix space is expected")
    if any(any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip") for t in parsed["added_tokens"]):
        raise ValueError("control strings must not take white space")
    return parsed


def control_strings(spec: str) -> list[bytes]:
    return [t["content"].encode() for t in checked(spec)["added_tokens"]]


def vocabulary(spec: str) -> Pieces:
    """The bytes of each id."""
    parsed = checked(spec)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    controls = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    pieces = [b""] * (max([*parsed["model"]["vocab"].values(), *controls.values()]) + 1)
    for piece, i in parsed["model"]["vocab"].items():
        pieces[i] = bytes(byte_of[c] for c in piece)
    for content, i in controls.items():
        pieces[i] = content.encode()
    return Pieces([*pieces, b""])  # the last stands for all larger ids


_CUTS, _MAYBE_SPACE, _LETTER_OR_DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_CUTS[[9, 10, 11, 12, 13, 32]] = True
_MAYBE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER_OR_DIGIT[[b for b in range(128) if chr(b).isalnum()]] = True
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _ends_in_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character of several bytes ends before each of these places."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    other = ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
    return two | general | other


def _ends_in_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an ASCII letter or digit or a Latin-1 letter of two bytes ends before each of these places."""
    b, c = data[np.maximum(at - 2, 0)], data[at - 1]
    return _LETTER_OR_DIGIT[c] | ((b == 0xC3) & (c >= 0x80) & (c <= 0xBF) & (c != 0x97) & (c != 0xB7))


def word_starts(data: np.ndarray, at: np.ndarray, controls: list[bytes]) -> np.ndarray:
    """Where words begin in texts (bytes and offsets): places that the tokenizer's own words never go across.

    These are white space after another character, signs after a letter or digit, and what follows a single line
    feed or tab; not inside control strings.
    """
    spaces = np.flatnonzero(_CUTS[data])
    spaces = spaces[spaces > 0]
    spaces = spaces[~_MAYBE_SPACE[data[spaces - 1]]]
    keep = np.ones(len(spaces), bool)
    high = data[spaces - 1] >= 0x80
    keep[high] = ~_ends_in_wide_space(data, spaces[high])
    spaces = spaces[keep]
    single = spaces[(data[spaces] != 32) & (spaces + 1 < len(data))] + 1
    single = single[(data[single] < 0x80) & ~_MAYBE_SPACE[data[single]]]
    signs = np.flatnonzero(_SIGN[data])
    signs = signs[signs > 0]
    signs = signs[_ends_in_letter(data, signs)]
    starts = np.concatenate([spaces, single, signs])
    raw = data.tobytes() if controls else b""
    for control in controls:
        found = raw.find(control)
        while found >= 0:
            starts = starts[(starts <= found) | (starts >= found + len(control))]
            found = raw.find(control, found + len(control))
    return np.union1d(starts, at[:-1][np.diff(at) > 0])


def words_of(texts: pa.Array, controls: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, their spaces included, numbered by their dictionary; the texts' offsets among them."""
    data, at = bytes_of(texts)
    starts = word_starts(data, at, controls)
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode(), np.searchsorted(starts, at)


def encoder(spec: str):
    """words -> ids of each, as little-endian 32-bit integers."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[bytes]) -> list[bytes]:
        texts, out = [w.decode("utf-8", "replace") for w in words], []
        for k in range(0, len(texts), 1024):  # the library's records of a word are large
            out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts[k : k + 1024], add_special_tokens=False)]
        return out

    return encode


def encoded_words(words: DataFrame, spec: str) -> DataFrame:
    """slice, number, ids of every row (slice, number, word): rows with equal words meet, and each word is encoded once."""
    spec_ = words.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = None, {}  # a word's rows may go on in the next batch
        for batch in batches:
            encode = encode or encoder(spec_.value)
            words = batch.column("word").dictionary_encode()
            distinct = words.dictionary.to_pylist()
            new = [w for w in distinct if w not in last]
            ids = last | dict(zip(new, encode(new), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("number"), pa.array([ids[w] for w in distinct], pa.binary()).take(words.indices)], ["slice", "number", "ids"])
            last = {distinct[-1]: ids[distinct[-1]]} if distinct else last

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "slice long, number int, ids binary")


def known_words(docs: DataFrame, spec: str, most: int) -> tuple[list[bytes], list[bytes]]:
    """Words of a sample of texts and their ids, the most frequent first."""
    total = docs.count()
    if not total or not most:
        return [], []
    controls = control_strings(spec)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"), controls)[0]
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    some = docs.select("text").sample(min(1.0, SAMPLE_TEXTS / total), seed=1)
    counts = some.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.filter((F.col("n") > 1) & (F.octet_length("word") <= KNOWN_BYTES)).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column("word").to_pylist()
    return words, encoder(spec)(words)


def cut(docs: DataFrame, known: list[bytes], controls: list[bytes], words_only: bool) -> DataFrame:
    """The texts slice by slice: the words that aren't known (slice, number, word), or the texts as numbers of words
    (slice, doc_ids of some rows, words of each row, numbers) and, after a slice's texts, a row with the checksum of its words."""
    known_ = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(known)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "slice long, number int, word binary" if words_only else f"slice long, docs array<{kind}>, counts array<long>, numbers binary, checksum long"
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codec = known_.value, pa.Codec("zstd", compression_level=1)
        task, made, new, size = 0, 0, {}, 0
        base, listed = len(known), None

        def closing() -> pa.RecordBatch:
            if words_only:
                columns = [pa.array(np.full(len(new), task + made)), pa.array(np.arange(base, base + len(new)), pa.int32()), pa.array(list(new), pa.binary())]
            else:
                columns = [pa.array([task + made], pa.int64()), pa.nulls(1, listed), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([zlib.crc32(b"".join(new))], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for whole in batches:
            for batch in slices(whole, "text"):
                words, at = words_of(batch.column("text"), controls)
                distinct, task = words.dictionary.to_pylist(), batch.column("part")[0].as_py() << 32
                numbers = np.fromiter((known[w] if w in known else new.setdefault(w, base + len(new)) for w in distinct), np.int32, len(distinct))
                size += len(words)
                if not words_only:
                    numbers = numbers[words.indices.to_numpy()].astype("<u4")
                    packed = codec.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)
                    rows = pa.array([0, batch.num_rows], pa.int32())
                    docs = pa.ListArray.from_arrays(rows, batch.column("doc_id"))
                    counts = pa.ListArray.from_arrays(rows, pa.array(np.diff(at), pa.int64()))
                    listed = docs.type
                    yield pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), docs, counts, pa.array([packed], pa.binary()), pa.nulls(1, pa.int64())], names)
                if size >= SLICE_SIZE or len(new) >= SLICE_WORDS:
                    yield closing()
                    made, new, size = made + 1, {}, 0
        if size or new or listed is not None:
            yield closing()

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def _put(batches: Iterator[pa.RecordBatch], known: Pieces, pieces: Pieces) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, ids one row after the other, and their offsets, from rows sorted by slice, words before texts."""
    codec, now, words, table = pa.Codec("zstd"), None, [], known
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column("slice")[i].as_py()
            if key != now:
                now, words, table = key, [], None
            if (ids := batch.column("ids")[i].as_py()) is not None:
                words.append(ids)
                continue
            if table is None:
                table = known.followed_by(Pieces(words, "<u4"))
            if (checksum := batch.column("checksum")[i].as_py()) is not None:
                if zlib.crc32(pieces.placed(np.frombuffer(b"".join(words), "<u4").astype(np.int64))[0]) != checksum:
                    raise ValueError("the texts changed between two scans: write them before they are encoded")
                continue
            counts = batch.column("counts")[i].values.to_numpy()
            total = int(counts.sum())
            planes = np.frombuffer(codec.decompress(batch.column("numbers")[i].as_buffer(), 4 * total), np.uint8).reshape(4, total)
            numbers = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
            ids, at = table.placed(numbers)
            yield batch.column("docs")[i].values, ids, at[np.concatenate([[0], np.cumsum(counts)])]


def _decoded(ids: np.ndarray, at: np.ndarray, pieces: Pieces) -> pa.Array:
    data, ends = pieces.placed(np.minimum(ids, len(pieces.at) - 2).astype(np.int64))
    raw, ends = data.tobytes(), ends[at].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(values)])


def encode(docs: DataFrame, spec: str, most: int = KNOWN_WORDS, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian 32-bit integers) of every text; decoded (text) too if asked for, made in the
    same tasks. spec: the tokenizer file's JSON."""
    context = docs.sparkSession.sparkContext
    words, ids = known_words(docs, spec, most)
    known_, pieces_ = context.broadcast(Pieces(ids, "<u4")), context.broadcast(vocabulary(spec))
    controls = control_strings(spec)
    back = encoded_words(cut(docs, words, controls, True), spec)
    texts = cut(docs, words, controls, False)
    extra = lambda like, names: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in names]
    both = back.select("*", *extra(texts, ["docs", "counts", "numbers", "checksum"])).unionByName(texts.select("*", *extra(back, ["number", "ids"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, at in _put(batches, known_.value, pieces_.value):
            columns = [doc_ids, pa.array(np.diff(at), pa.int64()), _binaries(ids, at)]
            if with_decoded:
                columns.append(_decoded(ids, at, pieces_.value))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sorted_ = both.repartition("slice").sortWithinPartitions("slice", F.col("number").asc_nulls_last())
    return sorted_.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded string" if with_decoded else ""))


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """The same rows with decoded (text) added."""
    pieces_ = encoded.sparkSession.sparkContext.broadcast(vocabulary(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                data, at = bytes_of(batch.column("ids"))
                texts = _decoded(np.ascontiguousarray(data).view("<u4"), at // 4, pieces_.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{names}, decoded string")


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode(docs, spec, with_decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
