"""Cross-tokenizer alignment: which tokens of A and of B cover the same bytes.

An event is the end of a token: its document, its byte offset, its side and its id. The events of A and of B are made
apart, united, dealt out by document and sorted by offset; a state machine then reads each document's events once and
closes a group wherever an A and a B token end together. Events travel in runs of at most RUN ids, with the offset at
which the run begins: a token's length follows from its id, so ends needn't be sent. What the machine holds of a
document is the group that is open and the runs that one side is ahead of the other, whatever the document's length.

A document's key is its doc_id and two hashes of its text, so that an executor that is lost and its replacement agree.
Rows equal in both are one document to the machine and are given back as often as they came: `copies`.

Pairs of ids linked at least once are counted over all documents; a document's links are then joined with these counts.
Counts are broadcast only if counted to be at most PAIRS, else the same join is shuffled.

A reads a space and the text, B the text (it puts the space itself). A document whose joined bytes differ from that on
either side has no tokens, nor has a null or empty text: zeros and ''. Very long texts are read whole. A null doc_id is
one like any. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, small, text_batches, written
from .tokens import _Numbers, vocabulary

#: Ids in a row of events.
RUN = 4096
#: Chunks, and their characters, that a worker remembers; then it begins anew.
REMEMBERED, LETTERS = 300_000, 6_000_000
#: Pairs of ids up to which their counts may be broadcast: about 60 bytes each.
PAIRS = 1_000_000
#: Bytes of ids that the machine takes in one step.
STEP = 1 << 20
KEY = ["doc_id", "h", "k"]
EVENTS = "doc_id long, h long, k long, at long, side int, copies int, ids binary"


class Vocabulary:
    """The bytes that each id stands for."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.size = len(entries)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32


def _letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel(Vocabulary):
    """A byte-level BPE file of the `tokenizers` library.

    Where each merge makes a later id than the one before, as in files made from ranks, ids are ranks, and tiktoken
    merges by them (some five times faster). Otherwise the library itself encodes.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # what pre-tokenizer ByteLevel with use_regex stands for

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, words = _letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        entries = [b""] * (1 + max([*words.values(), *(t["id"] for t in spec["added_tokens"])]))
        for w, i in words.items():
            entries[i] = w.encode() if w in special else bytes(byte[c] for c in w)
        super().__init__(entries)
        made = [words["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        if made == sorted(made) and min(made) >= 256 and not spec["normalizer"] and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            import tiktoken

            ranks = {e: i for i, e in enumerate(entries) if e and e.decode("utf-8", "replace") not in special}
            fast = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.one = fast.encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.one = lambda text: whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, after a space; None where their bytes aren't the text's."""
        out = []
        for t in texts:
            ids = self.one(" " + t)
            same = b"".join(map(self.entries.__getitem__, ids)) == (" " + t).encode()
            out.append(np.array(ids, self.dtype) if same else None)
        return out


class Pieces(Vocabulary):
    """A `sentencepiece` BPE model that puts a space before each text.

    No piece holds a space behind another letter, so that merges never cross the beginning of a run of spaces: a text
    is cut there, and the library's ids of each chunk are remembered. A model with such a piece gets its texts whole.
    """

    CHUNK = re.compile(r" *[^ ]+| +")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.by_chunk = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known, self.letters = _Numbers(), 0
        self.ids, self.used = np.zeros(1 << 20, self.dtype), 0
        self.at, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.same = np.zeros(1 << 18, bool)

    def _learn(self, chunks: list[str]) -> None:
        first, n = len(self.known) - len(chunks), len(self.known)
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        found = [ids or [self.space] for ids in found]
        if n > len(self.at):
            self.at, self.length, self.same = (np.resize(x, 2 * n) for x in (self.at, self.length, self.same))
        length = np.fromiter(map(len, found), np.int64, len(found))
        total = int(length.sum())
        if self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + total))
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), self.dtype, total)
        self.at[first:n], self.length[first:n] = self.used + np.cumsum(length) - length, length
        self.same[first:n] = [b"".join(map(self.entries.__getitem__, ids)) == c.encode() for ids, c in zip(found, chunks, strict=True)]
        self.used += total
        self.letters += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None where their bytes aren't a space and the text's."""
        if not self.by_chunk:
            found = self.model.encode(texts, num_threads=1)
            return [np.array(ids, self.dtype) if b"".join(map(self.entries.__getitem__, ids)) == (" " + t).encode() else None for ids, t in zip(found, texts, strict=True)]
        if len(self.known) > REMEMBERED or self.letters > LETTERS:
            self.forget()
        chunks, at = [], [0]
        for t in texts:
            chunks += self.CHUNK.findall(" " + t)
            at.append(len(chunks))
        index = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        length = self.length[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.at[index] - ends[:-1], length)]
        same = np.logical_and.reduceat(self.same[index], at[:-1]) if texts else []
        return [flat[ends[at[i]] : ends[at[i + 1]]] if same[i] else None for i in range(len(texts))]


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One for each Python worker, which Spark uses again for later tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _KNOWN[path]


# ---- events ------------------------------------------------------------------------


def ends(docs: DataFrame, path: str, side: int) -> DataFrame:
    """Runs of token ends of one side. A document without tokens on this side is one row without ids, at -1."""
    text_batches(docs.sparkSession)

    def encode(batches):
        words = vocabulary_of(path)
        for b in batches:
            rows: dict[tuple, list] = {}
            for key, text in zip(zip(*(b.column(c).to_pylist() for c in KEY), strict=True), b.column("text").to_pylist(), strict=True):
                if key in rows:
                    rows[key][1] += 1
                else:
                    rows[key] = [text or "", 1]
            keys, texts = list(rows), [r[0] for r in rows.values()]
            for first, last in slices(texts, 500_000):
                out = []
                for key, text, ids in zip(keys[first:last], texts[first:last], words.encode(texts[first:last]), strict=True):
                    n = rows[key][1]
                    if not text or ids is None:
                        out.append((*key, -1, side, n, b""))
                        continue
                    at = np.concatenate([[0], np.cumsum(words.lengths[ids])])
                    out += [(*key, int(at[i]), side, n, ids[i : i + RUN].tobytes()) for i in range(0, len(ids), RUN)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
            del rows, texts
            give_back()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(encode, EVENTS)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("copies", pa.int32()), ("ids", pa.binary())])


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """All token ends, a document's together and in the order of their offsets."""
    both = ends(docs, path_a, 0).unionByName(ends(docs, path_b, 1))
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "at", "side")


# ---- the machine -------------------------------------------------------------------


class Document:
    """What the machine knows of a document: figures so far, and the runs that no common end has closed."""

    def __init__(self, key: tuple) -> None:
        self.key, self.copies, self.tokens = key, 0, True
        self.first = self.last = None
        self.runs = [[], []]
        self.n = [0, 0]
        self.groups = self.offset = 0
        self.said = False
        self.digest = hashlib.sha256()

    def take(self, at: int, side: int, copies: int, ids: bytes) -> None:
        if self.first is None:
            self.first = (at, side)
        if self.first == (at, side):
            self.copies += copies
        if (at, side) == self.last:
            return  # another copy's run
        self.last = (at, side)
        if at < 0:
            self.tokens = False
        elif self.tokens:
            self.runs[side].append(ids)


class Closed:
    """Groups that a batch closed: ids of both sides, how they are cut, and how many groups each document has here."""

    def __init__(self, docs: list[Document], a: Vocabulary, b: Vocabulary) -> None:
        words = (a, b)
        raw = [[b"".join(d.runs[s]) for d in docs] for s in (0, 1)]
        ids = [np.frombuffer(b"".join(r), words[s].dtype) for s, r in enumerate(raw)]
        counts = [np.array([len(x) for x in r], np.int64) // words[s].dtype().itemsize for s, r in enumerate(raw)]
        starts = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
        run = [np.concatenate([[0], np.cumsum(words[s].lengths[ids[s]])]) for s in (0, 1)]
        size = np.maximum(*(run[s][starts[s][1:]] - run[s][starts[s][:-1]] for s in (0, 1)))
        base = np.cumsum(size) - size
        end = [run[s][1:] + np.repeat(base - run[s][starts[s][:-1]], counts[s]) for s in (0, 1)]
        met = np.zeros(int(size.sum()) + 1, np.uint8)
        met[end[0]] |= 1
        met[end[1]] |= 2
        cut = [met[e] == 3 for e in end]
        #: Place behind the last token of each group, by side, and the groups of each document.
        self.upto = [np.flatnonzero(c) + 1 for c in cut]
        self.group_at = np.searchsorted(self.upto[0], starts[0], "right")
        self.ids, self.starts, self.cut = ids, starts, cut
        self.begin = [np.concatenate([[0], u]) for u in self.upto]
        # A group begins where the one before ends, or where its document does: what an open document left over comes last.
        offsets = np.array([d.offset for d in docs], np.int64)
        of_doc = np.repeat(np.arange(len(docs)), np.diff(self.group_at))
        self.ends = end[0][self.upto[0] - 1] - base[of_doc] + offsets[of_doc]
        self.links = self.ids[0][cut[0]].astype(np.int64) * b.size + self.ids[1][cut[1]]
        self.of_doc = of_doc
        for i, d in enumerate(docs):
            n = self.group_at[i + 1] - self.group_at[i]
            last = [self.upto[s][self.group_at[i + 1] - 1] if n else starts[s][i] for s in (0, 1)]
            d.groups += int(n)
            d.n = [d.n[s] + int(last[s] - starts[s][i]) for s in (0, 1)]
            d.offset = int(self.ends[self.group_at[i + 1] - 1]) if n else d.offset
            d.runs = [[ids[s][last[s] : starts[s][i + 1]].tobytes()] if last[s] < starts[s][i + 1] else [] for s in (0, 1)]

    def written_ids(self, a: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all closed tokens in the order in which groups are written, and where each document's begin.

        A code is 2 * id for A and 2 * (A's size + id) for B, one more at the end of the group's side.
        """
        n = [u[-1] if len(u) else 0 for u in self.upto]
        out = np.empty(n[0] + n[1], np.int64)
        for s, before in ((0, self.begin[1]), (1, self.upto[0])):
            cut = self.cut[s][: n[s]].astype(np.int64)
            out[np.arange(n[s]) + before[np.cumsum(cut) - cut]] = 2 * (self.ids[s][: n[s]].astype(np.int64) + s * a.size) + cut
        return out, (self.begin[0] + self.begin[1])[self.group_at]


def sweep(batches, path_a: str, path_b: str, say):
    """Feeds sorted events to the machine; `say(closed, documents, complete)` makes Arrow batches of what each step closed.

    The first `complete` of the documents have ended; one more may follow, which is still open.
    """
    a, b = vocabulary_of(path_a), vocabulary_of(path_b)
    docs: list[Document] = []
    size = 0
    for batch in batches:
        for doc_id, h, k, at, side, copies, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not docs or docs[-1].key != (doc_id, h, k):
                docs.append(Document((doc_id, h, k)))
            docs[-1].take(at, side, copies, ids)
            size += len(ids)
            if size > STEP:
                yield from say(Closed(docs, a, b), docs, len(docs) - 1)
                docs, size = docs[-1:], 0
        give_back()
    if docs:
        yield from say(Closed(docs, a, b), docs, len(docs))


# ---- what is made of the groups ----------------------------------------------------


def _swept(docs: DataFrame, path_a: str, path_b: str, say, schema: str) -> DataFrame:
    def run(batches):
        yield from sweep(batches, path_a, path_b, say)

    return events(docs, path_a, path_b).mapInArrow(run, schema)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a group: doc_id, h and k (hashes of the text), copies, its number from 0, the bytes of space + text that it covers, ids of A and of B.

    The last ids of the two lists are linked.
    """

    def say(closed: Closed, held: list[Document], complete: int):
        del complete
        n, d = len(closed.ends), closed.of_doc
        number = np.arange(n) - closed.group_at[d] + np.array([x.groups for x in held], np.int64)[d] - np.diff(closed.group_at)[d]
        lengths = vocabulary_of(path_a).lengths[closed.ids[0][: closed.begin[0][-1]]]
        size = np.add.reduceat(lengths, closed.begin[0][:-1]) if n else lengths[:0]
        lists = [pa.ListArray.from_arrays(pa.array(closed.begin[s], pa.int32()), pa.array(closed.ids[s][: closed.begin[s][-1]].astype(np.int32))) for s in (0, 1)]
        keys = [pa.array([x.key[i] for x in held], pa.int64()).take(pa.array(d)) for i in range(3)]
        yield pa.record_batch([*keys, pa.array([x.copies for x in held], pa.int32()).take(pa.array(d)), pa.array(number), pa.array(closed.ends - size), pa.array(closed.ends), *lists], names=[*KEY, "copies", "number", "first_byte", "end_byte", "a_ids", "b_ids"])

    return _swept(docs, path_a, path_b, say, "doc_id long, h long, k long, copies int, number long, first_byte long, end_byte long, a_ids array<int>, b_ids array<int>")


def _digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of linked pairs with their numbers, some for each document; the row that ends a document has its figures too."""
    a, b = vocabulary_of(path_a), vocabulary_of(path_b)
    width, kind = a.size * b.size, ("int" if a.size * b.size < 1 << 31 else "long")
    arrow = pa.int32() if kind == "int" else pa.int64()

    table: list[bytes] = []

    def say(closed: Closed, held: list[Document], complete: int):
        if not table:
            table.extend(x.encode() for s, v, last in ((0, vocabulary_of(path_a), "|"), (1, vocabulary_of(path_b), ";")) for i in range(v.size) for x in (f"{i},", f"{i}{last}"))
        codes, at = closed.written_ids(vocabulary_of(path_a))
        for i, d in enumerate(held):
            if at[i] < at[i + 1]:
                text = b"".join(map(table.__getitem__, codes[at[i] : at[i + 1]].tolist()))
                if d.said:
                    d.digest.update(b";")
                d.digest.update(memoryview(text)[:-1])
                d.said = True
        links, times = np.unique(closed.of_doc * width + closed.links, return_counts=True)
        bounds = np.searchsorted(links, np.arange(len(held) + 1) * width)
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (pa.array(links % width, arrow), pa.array(times, pa.int32()))]
        done = [i < complete for i in range(len(held))]
        figures = [pa.array([x if e else None for x, e in zip(v, done, strict=True)], pa.int64()) for v in ([d.n[0] for d in held], [d.n[1] for d in held], [d.groups for d in held])]
        sums = pa.array([(d.digest.hexdigest() if d.said else "") if e else None for d, e in zip(held, done, strict=True)], pa.string())
        yield pa.record_batch([*(pa.array([d.key[i] for d in held], pa.int64()) for i in range(3)), pa.array([d.copies for d in held], pa.int32()), *figures, sums, *lists], names=[*KEY, "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return _swept(docs, path_a, path_b, say, f"doc_id long, h long, k long, copies int, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<{kind}>, times array<int>")


def counted_pairs(parts: DataFrame, size_b: int) -> DataFrame:
    """pair, n (how many links of all documents hold it) and best (n is the highest of its B id)."""
    pairs = parts.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    counts = pairs.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum(F.col("e.times").cast("long") * F.col("copies")).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % size_b))  # at most one row for each id of A
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Digest of each document's groups and links; see the module."""
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    parts = written(_digests(docs, path_a, path_b), "align")
    counts = written(counted_pairs(parts, vocabulary_of(path_b).size), "align-pairs")
    ended = parts.where(F.col("groups_sha256").isNotNull())
    links = parts.select(*KEY, F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(*KEY, F.col("e.pairs").alias("pair"), F.col("e.times").cast("long").alias("times"))
    figures = links.join(small(counts, most=PAIRS), "pair").groupBy(*KEY).agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    own = ["copies", "n_a", "n_b", "n_groups", "groups_sha256"]
    sums = ["n_links", "n_best", "count_sum"]
    both = ended.select(*KEY, *own, *(F.lit(0).cast("long").alias(c) for c in sums)).unionByName(
        figures.select(*KEY, *(F.lit(None).cast(ended.schema[c].dataType).alias(c) for c in own), *sums)
    )
    whole = both.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in own), *(F.sum(c).alias(c) for c in sums))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
