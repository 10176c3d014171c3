"""Token ids of whole texts: content-defined chunks that documents share are encoded once."""

import base64
import functools
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: Fixed value: the public pattern that parts a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 32
LEAST, MASK = 512, 1023
#: Occurrences of one chunk that a task sends to one place before it opens another.
TOGETHER = 64
#: Chunks a task remembers as sent; beyond it forgets all and sends their text again.
REMEMBERED = 200_000

GEAR = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([b]), 7) for b in range(256)), ">u8").astype(np.uint32)
SPACE = np.zeros(256, bool)
SPACE[list(b"\t\n\r ")] = True
#: ASCII that isn't white space to the pattern.
SOLID = np.zeros(256, bool)
SOLID[:0x80] = True
SOLID[list(b"\t\n\v\f\r ")] = False
#: The largest vocabulary file that is sent to the tasks.
MOST_BYTES = 64 << 20


@functools.lru_cache(4)
def _parsed(data: bytes, vocabulary: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _file(folder: str, vocabulary: str) -> bytes:
    data = Path(folder, f"{vocabulary}.tiktoken").read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    return data


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer. No special tokens: their names are ordinary text."""
    return _parsed(_file(folder, vocabulary), vocabulary)


def shipped_encoder(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Callable[[], tiktoken.Encoding]:
    """The tokenizer for tasks: only the driver needs the file, whose bytes (MOST_BYTES at most) are broadcast; each Python worker
    parses them once."""
    sent = spark.sparkContext.broadcast(_file(folder, vocabulary))
    return lambda: _parsed(sent.value, vocabulary)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A gear hash of the WINDOW bytes that end at each place, by doubling: sum of GEAR[byte] << distance, mod 2**32."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def joins(data: np.ndarray) -> np.ndarray:
    """Places where texts may be joined without changing ids, in text of any script.

    Before ASCII white space, after any character that isn't white space to the pattern: no pre-token spans such a place,
    and the pattern looks ahead only from white space, so what stands on either side is encoded alike with or without the
    other side. And between an ideograph or kana letter and an ideographic comma, stop or mark: a run of letters ends there, and a
    pre-token of marks that has no letter before it starts there."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    a = data[:-1]
    solid = SOLID[a]
    wide = np.flatnonzero(a >= 0x80)
    if len(wide):
        third, second, first = a[wide], a[np.maximum(wide - 1, 0)], a[np.maximum(wide - 2, 0)]  # first bytes end no wide character
        blank = (second == 0xC2) & ((third == 0x85) | (third == 0xA0))
        blank |= (first == 0xE1) & (second == 0x9A) & (third == 0x80)
        blank |= (first == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        blank |= (first == 0xE2) & (second == 0x81) & (third == 0x9F)
        blank |= (first == 0xE3) & (second == 0x80) & (third == 0x80)
        solid[wide] = ~blank
    safe = solid & SPACE[data[1:]]
    at = np.flatnonzero((data[1:] == 0xE3) | (data[1:] == 0xEF)) + 1
    at = at[(at >= 3) & (at + 2 < n)]
    if len(at):
        lead, mid, last = data[at], data[at + 1], data[at + 2]
        mark = (lead == 0xE3) & (mid == 0x80) & ((last == 0x81) | (last == 0x82))
        mark |= (lead == 0xEF) & (mid == 0xBC) & ((last == 0x81) | (last == 0x8C) | (last == 0x9F))
        x, y, z = data[at - 3], data[at - 2], data[at - 1]
        letter = ((x >= 0xE5) & (x <= 0xE8) & (y >= 0x80)) | ((x == 0xE4) & (y >= 0xB8)) | ((x == 0xE3) & ((y == 0x81) & (z >= 0x81) | (y == 0x82) & (z <= 0x96) | (y == 0x82) & (z >= 0xA1) | (y == 0x83) & (z <= 0xBA)))
        safe[at[mark & letter] - 1] = True
    return np.flatnonzero(safe) + 1


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The cuts of each text, as (cut, seam start, seam end); text i is data[offsets[i]:offsets[i+1]].

    A cut falls where the rolling hash has its high bits 0 (as many as MASK has), wherever that is in a word: the same content is cut alike
    in every document. It may part a pre-token, so the ids of both sides need not be those of the whole. Its seam
    reaches from the cut outwards to the first places on both sides where agreement is certain (joins()); an empty
    seam is a cut at such a place. A cut whose seam would reach another seam or an end of the text is not made,
    so a text without such places stays whole, however long it is.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if len(data) <= LEAST:
        return out
    # the hash's high bits: only they depend on the whole window
    hits = np.flatnonzero(rolling_hash(data)[:-1] >> np.uint32(32 - MASK.bit_length()) == 0) + 1
    hits = hits[(data[hits] & 0xC0) != 0x80]  # not inside a character
    safe = joins(data)
    at = np.searchsorted(safe, hits)
    inside = (at > 0) & (at < len(safe))
    hits, at = hits[inside], at[inside]
    after, before = safe[at], safe[at - 1]
    before = np.where(after == hits, hits, before)
    low, high = np.searchsorted(hits, offsets[:-1] + LEAST), np.searchsorted(hits, offsets[1:])
    for i in np.flatnonzero(high > low).tolist():
        start = seam = int(offsets[i])
        end = int(offsets[i + 1])
        for cut, a, b in zip(hits[low[i] : high[i]].tolist(), before[low[i] : high[i]].tolist(), after[low[i] : high[i]].tolist()):
            if cut - start >= LEAST and a >= seam and a > start and b < end:
                out[i].append((cut, a, b))
                start, seam = cut, b
    return out


def _split(batches: Iterator[pa.RecordBatch], load: Callable[[], tiktoken.Encoding]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks: row (a number of the document's row), doc_id, pos, key, place and, at the first of each key and
    place in a task, the chunk's bytes. The join after a chunk is repaired here: seam has the ids of its text encoded
    anew, drop_last and drop_first say how many ids of the chunks on either side they replace."""
    part, row, seen, tokenizer = TaskContext.get().partitionId(), 0, {}, load()
    kind = np.uint16 if tokenizer.max_token_value < 1 << 16 else np.int32
    for batch in batches:
        texts = pa.concat_arrays([batch.column("text").fill_null("").cast(pa.large_string())])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
        base = int(offsets[0]) if len(offsets) else 0
        data, offsets = data[base : int(offsets[-1])], offsets - base
        raw = data.tobytes()
        coded = lambda a, b: tokenizer.encode_ordinary(raw[a:b].decode()) if b > a else []  # noqa: B023, E731
        columns: list[list] = [[] for _ in range(9)]
        bounds = offsets.tolist()
        for i, cuts in enumerate(chunk_cuts(data, offsets)):
            doc, start, first = batch.column("doc_id")[i].as_py(), bounds[i], 0
            for pos, (cut, a, b) in enumerate([*cuts, (bounds[i + 1],) * 3]):
                chunk = raw[start:cut]
                key = xxhash.xxh3_128_digest(chunk)
                n = seen.get(key, 0)
                if not n and len(seen) >= REMEMBERED:
                    seen.clear()
                seen[key] = n + 1
                place = 0 if n < TOGETHER else (part * 1_000_003 + n // TOGETHER) & 0x7FFFFFFF
                last = len(coded(a, cut))
                seam = np.array(coded(a, b), kind).tobytes() if b > a else None
                for c, v in zip(columns, ((part << 36) + row, doc, pos, key, place, chunk if n % TOGETHER == 0 else None, first, last, seam)):
                    c.append(v)
                start, first = cut, len(coded(cut, b))
            row += 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, arrays[5].is_null()], names=["row", "doc_id", "pos", "key", "place", "chunk", "drop_first", "drop_last", "seam", "again"])


def _encode(batches: Iterator[pa.RecordBatch], load: Callable[[], tiktoken.Encoding]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and place, with the chunk in the first row of each: every key and place is encoded once."""
    tokenizer = load()
    kind = np.uint16 if tokenizer.max_token_value < 1 << 16 else np.int32
    at, ids = None, b""
    for batch in batches:
        keys, places, chunks = (batch.column(c).to_pylist() for c in ("key", "place", "chunk"))
        out = []
        for key, place, chunk in zip(keys, places, chunks):
            if (key, place) != at:
                at, ids = (key, place), np.array(tokenizer.encode_ordinary(chunk.decode()), kind).tobytes()
            out.append(ids)
        kept = ["row", "doc_id", "pos", "drop_first", "drop_last", "seam"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "ids"])


def _assemble(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Sorted by row and pos: the ids of each row's chunks, with the seams between them, are the ids of its document."""
    open_row, open_doc, held, width = None, None, [], np.dtype(kind).itemsize

    def built(docs: list, lists: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([0, *map(len, lists)], np.int64) // width
        values = np.frombuffer(b"".join(lists), kind).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), ids], names=["doc_id", "ids"])

    for batch in batches:
        docs, lists, size = [], [], 0
        for row, doc, first, last, seam, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "drop_first", "drop_last", "seam", "ids"))):
            if row != open_row:
                if open_row is not None:
                    docs.append(open_doc)
                    lists.append(b"".join(held))
                    size += len(lists[-1])
                    if size > 1 << 24:
                        yield built(docs, lists)
                        docs, lists, size = [], [], 0
                open_row, open_doc, held = row, doc, []
            held.append(ids[first * width : len(ids) - last * width] if first or last else ids)
            if seam:
                held.append(seam)
        if docs:
            yield built(docs, lists)
    if open_row is not None:
        yield built([open_doc], [b"".join(held)])


def encode_corpus(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every row of documents (columns doc_id bigint, text string), without special tokens.

    Texts are cut into content-defined chunks; a chunk's text crosses the shuffle once per task that has it, is
    encoded once for all documents, and its ids go back to them. Each join is repaired: the text around it is encoded
    anew, as far as both sides certainly agree with the whole, and its ids replace those of the two chunks there.
    A chunk that a task meets often goes to further places after each TOGETHER occurrences, with its text, so that
    no task gets all copies of a hot one. Rows are told apart by their place in the input's partitions, so documents
    should come from files or a settled table, which a redone task reads in the same order.

    Empty and null texts give an empty list; repeated rows, equal and null doc_ids give a row each; an empty
    table gives no rows. Text columns of any length are encoded whole.
    """
    kind = "uint16" if encoder(folder, vocabulary).max_token_value < 1 << 16 else "int32"
    load = shipped_encoder(documents.sparkSession, folder, vocabulary)
    pieces = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda b: _split(b, load), "row bigint, doc_id bigint, pos int, key binary, place int, chunk binary, drop_first int, drop_last int, seam binary, again boolean")
    grouped = pieces.repartition("key", "place").sortWithinPartitions("key", "place", "again")
    encoded = grouped.mapInArrow(lambda b: _encode(b, load), "row bigint, doc_id bigint, pos int, drop_first int, drop_last int, seam binary, ids binary")
    together = encoded.repartition("row").sortWithinPartitions("row", "pos")
    return together.mapInArrow(lambda b: _assemble(b, kind), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The named columns and n_tokens, the number of token ids of the whole text: 0 for empty and null text. No shuffle."""

    load = shipped_encoder(documents.sparkSession, folder, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load()
        for batch in batches:
            n = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    read = documents.select(*columns, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in read.dtypes[:-1])
    return read.mapInArrow(count, f"{kinds}, n_tokens bigint")
