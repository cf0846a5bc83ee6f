"""Token-ID output: Arrow files of fixed-size-list batches, and their reader.

Documents are dealt out by ranges of doc_id, so that part files in the order of
their numbers hold all documents in ascending order. A part is two Arrow files:

* `part-N.tokens.arrow`: `ids` fixed_size_list<uint16 or uint32>[SEQUENCE] and `mask`
  fixed_size_list<bool>[SEQUENCE]. The documents' ids follow one another without
  gaps; only the last sequence of a part is padded (mask false). Every batch but the
  last holds BATCH sequences, so sequence i is row i % BATCH of batch i // BATCH: a
  reader that maps the file gets it without a copy.
* `part-N.docs.arrow`: doc_id, start (in the part) and n_tokens of each document.

Files are written under a name of the task's attempt, and only the names that a
successful attempt returns are read: a lost executor leaves at most an unread file.

Null text: as empty (only the end id). Null doc_id: last. Rows with the same doc_id
are ordered by the hash of their text, and none is dropped. Empty table: no files, no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, new_folder, partitions, slices, text_batches

SEQUENCE = 1024
BATCH = 256
#: Entries up to which a worker remembers how chunks and pieces are encoded: about 60 MB. Then it begins anew.
REMEMBERED = 300_000
#: Characters that Python's split() takes for white space but the tokenizer doesn't, and what may need a look at more than one chunk.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|", "Σ")
#: A mark behind a letter or digit at the end of a chunk: the tokenizer encodes it apart, so it is remembered apart.
_MARK = re.compile(r"[.,!?;:](?<=[^\W_].)(?!\S)")
#: New words that are encoded as one text.
_JOINED = 2_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers chunks in the order in which they are first asked for; `new` lists those not learned yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


class Encoder:
    """Encodes texts with a `tokenizers` file whose ids don't depend on anything beyond white space.

    With `by_chunk`, a text is split at white space and each chunk's ids are remembered: words recur, merges are
    slow. Chunks that aren't known are encoded by the library itself. Texts with characters for which this may
    differ are encoded whole.
    """

    def __init__(self, path: str, by_chunk: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = by_chunk
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 20, self.dtype)
        self.used = 0
        self.at = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int32)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has. Runs of letters are one word each, so they are encoded as texts of
        many words and told apart by the ids that end a word; where that doesn't come out even, one by one."""
        if all(map(str.isalpha, chunks)):
            texts = [" ".join(chunks[i : i + _JOINED]) for i in range(0, len(chunks), _JOINED)]
            ids = self._whole(texts)[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(chunks) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        return self._whole(chunks)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks; their numbers are the next ones, in order."""
        letters = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        first, n = len(self.known) - len(chunks), len(self.known)
        if n > len(self.at):
            self.at, self.length = np.resize(self.at, 2 * n), np.resize(self.length, 2 * n)
        for mine in (np.flatnonzero(letters), np.flatnonzero(~letters)):
            if not len(mine):
                continue
            ids, length = self._encoded([chunks[i] for i in mine])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[first + mine] = self.used + np.cumsum(length) - length
            self.length[first + mine] = length
            self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if not self.by_chunk:
            return self._whole(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        odd = [i for i, t in enumerate(texts) if any(c in t for c in _ODD)]
        strange = set(odd)
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if i not in strange:
                t = t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower()
                words = _MARK.sub(r" \g<0>", t).split()
                pieces += words
                counts[i] = len(words)
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        length = self.length[index].astype(np.int64)
        ends = np.cumsum(length)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[index] - (ends - length), length)]
        of_text = np.add.reduceat(np.append(length, 0), np.minimum(np.cumsum(counts) - counts, len(length))) * (counts > 0) if len(texts) else counts
        if odd:
            ids, n = self._whole([texts[i] for i in odd])
            parts, lengths, at = np.split(flat, np.cumsum(of_text)[:-1]), np.array(of_text), 0
            for k, i in enumerate(odd):
                parts[i], lengths[i] = ids[at : at + n[k]], n[k]
                at += n[k]
            return np.concatenate(parts), lengths
        return flat, of_text

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, by_chunk: bool) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    if (path, by_chunk) not in _ENCODERS:
        _ENCODERS[path, by_chunk] = Encoder(path, by_chunk)
    return _ENCODERS[path, by_chunk]


def _lists(values: np.ndarray, kind: pa.DataType, size: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), size)


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, sequence: int = SEQUENCE, batch: int = BATCH, by_chunk: bool = True, folder: str | None = None) -> list[tuple]:
    """Writes the files and returns (part, name, n_tokens, n_docs) of each, in order; one row a file comes to the driver."""
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or new_folder(spark, "tokens")

    def write(batches):
        enc, part = encoder(path, by_chunk), TaskContext.get().partitionId()
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        kind = pa.from_numpy_dtype(enc.dtype)
        tokens_schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        start = n_docs = 0
        held: list[np.ndarray] = []
        n_held = 0
        full = sequence * batch
        out = index = None
        try:
            for b in batches:
                ids, texts = b.column("doc_id"), b.column("text").to_pylist()
                for first, last in slices([t or "" for t in texts]):
                    if out is None:
                        out = fs.open_output_stream(f"{at}/{name}.tokens.arrow"), fs.open_output_stream(f"{at}/{name}.docs.arrow")
                        index = pa.ipc.new_file(out[0], tokens_schema), pa.ipc.new_file(out[1], docs_schema)
                    flat, n = enc.encode([t or "" for t in texts[first:last]])
                    ends = np.cumsum(n + 1)
                    all_ids = np.full(int(ends[-1]), end_id, enc.dtype)
                    keep = np.ones(len(all_ids), bool)
                    keep[ends - 1] = False
                    all_ids[keep] = flat
                    index[1].write_batch(pa.record_batch([ids.slice(first, last - first), pa.array(start + ends - n - 1), pa.array(n + 1)], schema=docs_schema))
                    start += len(all_ids)
                    n_docs += last - first
                    held.append(all_ids)
                    n_held += len(all_ids)
                    if n_held >= full:
                        line = np.concatenate(held)
                        whole = n_held - n_held % full
                        for k in range(0, whole, full):
                            index[0].write_batch(pa.record_batch([_lists(line[k : k + full], kind, sequence), _lists(np.ones(full, bool), pa.bool_(), sequence)], schema=tokens_schema))
                        held, n_held = [line[whole:]], n_held - whole
            if n_held:
                line = np.zeros(-(-n_held // sequence) * sequence, enc.dtype)
                line[:n_held] = np.concatenate(held)
                index[0].write_batch(pa.record_batch([_lists(line, kind, sequence), _lists(np.arange(len(line)) < n_held, pa.bool_(), sequence)], schema=tokens_schema))
        finally:
            for x in (*(index or ()), *(out or ())):
                x.close()
            held = []
            give_back()
        if out:
            yield pa.record_batch([pa.array([part]), pa.array([name]), pa.array([start]), pa.array([n_docs])], names=["part", "name", "n_tokens", "n_docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = rows.mapInArrow(write, "part long, name string, n_tokens long, n_docs long").collect()
    return [(r.part, f"{folder}/{r.name}", r.n_tokens, r.n_docs) for r in sorted(found)]


def sequences(uri: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and masks of sequences first..last-1 of one part, by its batches' places."""
    fs, at = pafs.FileSystem.from_uri(f"{uri}.tokens.arrow")
    with (fs.open_input_file(at) if not isinstance(fs, pafs.LocalFileSystem) else pa.memory_map(at)) as f:
        file = pa.ipc.open_file(f)
        size = file.get_batch(0).num_rows
        got = [file.get_batch(i) for i in range(first // size, min(-(-last // size), file.num_record_batches))]
        rows = pa.Table.from_batches(got).slice(first - first // size * size, last - first).combine_chunks()
        return tuple(rows.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, file.schema.field(c).type.list_size) for c in ("ids", "mask"))


def read_digests(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one task a part, one batch in memory."""

    def read(batches):
        for b in batches:
            for uri, offset in zip(b.column("uri").to_pylist(), b.column("before").to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(f"{at}.docs.arrow") as f:
                    where = pa.ipc.open_file(f).read_all()
                starts, n = (where.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = np.zeros(len(starts), np.int64)
                ends = starts + n
                with fs.open_input_file(f"{at}.tokens.arrow") as f:
                    file = pa.ipc.open_file(f)
                    base = doc = 0
                    for i in range(file.num_record_batches):
                        got = file.get_batch(i)
                        ids = got.column("ids").flatten().to_numpy()[got.column("mask").flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                        raw, upto = memoryview(ids).cast("B"), base + len(ids)
                        while doc < len(starts) and starts[doc] < upto:
                            crc[doc] = zlib.crc32(raw[4 * (max(starts[doc], base) - base) : 4 * (min(ends[doc], upto) - base)], int(crc[doc]))
                            if ends[doc] > upto:
                                break
                            doc += 1
                        base = upto
                for k in range(0, len(starts), 10_000):
                    yield pa.record_batch([where.column("doc_id").slice(k, 10_000).combine_chunks(), pa.array(starts[k : k + 10_000] + offset), pa.array(n[k : k + 10_000]), pa.array(crc[k : k + 10_000])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows, before = [], 0
    for _, uri, n_tokens, _ in files:
        rows.append((uri, before))
        before += n_tokens
    listed = spark.createDataFrame(rows, "uri string, before long")
    return (listed.repartition(len(rows)) if rows else listed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs as token files into the shared folder and returns each document's digest, read back from them."""
    return read_digests(docs.sparkSession, write_tokens(docs, path or vocabulary("word_bpe_49k.json"), end_id))
