"""Aligning the tokens of two tokenizers over the same bytes, and counting which ids meet.

A text is encoded by both tokenizers. The tokens of either cut the same bytes, so
an A and a B token are linked where their byte ranges overlap. Tokens are the
nodes of a bipartite graph with those links as edges. A union-find over it
gives its connected components, which are the smallest groups of adjacent tokens that both
sides cut alike. Members of a component expand into its links, whose pairs
of ids are counted over the whole corpus.

Distributed counting takes one scan that tokenizes, one exchange of the pairs that
differ within a block, and one that brings their counts back:

1. A task cuts texts into stretches (words) that both sides encode apart, and aligns
   each different one once; adjacent ones meet in cuts of both sides, so no group spans
   two. About ``BLOCK`` characters of documents make a block. Its dictionary lists the
   different pairs with their numbers; a document keeps places in it with
   multiplicities (compressed). Both go to one table.
2. Dictionaries are added up into the counts of all pairs, and the largest count
   of each B id is found (a group of at most A's vocabulary).
3. The counts are joined back to the dictionaries, and each block's dictionary meets its
   documents in one task, which reads them in order and holds one dictionary at a time.

So a pair that a third of all links have is one row per block, and a large join of it is
split by Spark. Nothing is broadcast and nothing reaches the driver.

Tokenizer A is byte-level BPE from its JSON file. Where the file is plain (no
normalizer, merges in the order of ids, as checked on reading), the same
vocabulary runs in a faster library; texts of very long white space take the file's own.

Defined cases: null and empty texts, and texts whose tokens don't spell them
byte for byte on both sides (tried as a whole), have no tokens: zeros, an empty ``groups`` string and an
empty digest. Repeated rows count each; a null id is kept; other columns are ignored.
Long stretches are aligned in slices that end where both sides cut. Without documents there
are no rows and no pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from . import kernel as K

#: Characters of a block, bytes of a stretch that are aligned at once, characters of words that are encoded at once, and the longest one kept.
BLOCK = 8 << 20
SLICE = 1 << 20
QUEUE = 1 << 17
LONG = 1 << 16
#: Bytes of different stretches after which a worker starts afresh.
CACHE = 8 << 20
#: Codes of a pair are ``a * STRIDE + b``.
STRIDE = 1 << 32
#: A lone space or line feed between other characters: both tokenizers cut before it. What keeps others from being alone.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"\s\s|[^\S \n]")
#: White space this long is beyond the faster library.
_LONG_SPACE = re.compile(r"\s{50000}")
#: Fixed value: how byte-level BPE cuts a text into words.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Spelling:
    """The bytes of every id, as one flat array."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(x) for x in entries], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[K.ranges(self.start[ids], self.length[ids])]


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table, vocab = byte_characters(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        entries = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for piece, k in vocab.items():
            entries[k] = piece.encode() if piece in added else bytes(table[c] for c in piece)
        self.spelling, self.fast = Spelling(entries), None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        in_order = all(vocab["".join(m)] == 256 + k for k, m in enumerate(merges))
        pre = spec["pre_tokenizer"] or {}
        #: it cuts words as ``_WORD_PATTERN`` does
        self.by_words = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"])
        if in_order and self.by_words and not spec["model"].get("ignore_merges") and len(set(vocab) - set(added)) == 256 + len(merges):
            import tiktoken

            ranks = {entries[k]: k for piece, k in vocab.items() if piece not in added}
            self.fast = tiktoken.Encoding("a", pat_str=_WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, raw: str) -> list[int]:
        if self.fast is not None and (len(raw) < 100_000 or not _LONG_SPACE.search(raw)):
            return self.fast.encode_ordinary(raw)
        return self.whole.encode(raw, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries, self.by_words, self.space = [], True, model.piece_to_id("\u2581")
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            entries.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(k) else piece.replace("\u2581", " ").encode())
            # no piece spans a line feed, or a space after anything else: then words are encoded apart
            self.by_words = self.by_words and "\n" not in piece and "\u2581" not in piece.lstrip("\u2581")
        self.spelling = Spelling(entries)

    def encode(self, raw: str) -> list[int]:
        """The ids of what starts with a space, or (where words are apart) with a line feed."""
        if raw[:1] == " ":
            return self.model.encode(raw[1:])
        ids = self.model.encode(raw)
        return ids[1:] if ids[:1] == [self.space] else []


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node connected with each of ``n`` nodes: union-find, all edges hooked at once, paths halved until flat."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


class Aligned:
    """Links and groups of adjacent stretches of bytes, given where the tokens of both sides end (the stretches' ends are common).

    ``a``, ``b``: tokens of each link, in order; ``group_a``, ``group_b``: the group number of each token.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        na, nb = len(ends_a), len(ends_b)
        cut = np.zeros(int(ends_a[-1]) + 1, bool)
        cut[ends_a] = cut[ends_b] = True
        stops = np.flatnonzero(cut)
        # between two neighbouring cuts lies one A and one B token, and every overlap holds one such stretch
        new_a, new_b = np.zeros(len(stops), bool), np.zeros(len(stops), bool)
        new_a[np.searchsorted(stops, ends_a)] = new_b[np.searchsorted(stops, ends_b)] = True
        self.a, self.b = np.cumsum(new_a) - new_a, np.cumsum(new_b) - new_b
        root = components(self.a, na + self.b, na + nb)
        # a component's smallest node is its first A token
        first = root[:na] == np.arange(na)
        number = np.cumsum(first) - 1
        self.group_a, self.group_b = number[root[:na]], number[root[na:]]
        self.groups = int(first.sum())

    def text(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` as bytes, and where each group ends in it."""
        count_a, count_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
        at_a = np.arange(len(ids_a)) + (upto_b - count_b)[self.group_a]
        at_b = np.arange(len(ids_b)) + upto_a[self.group_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        different, where = np.unique(ids, return_inverse=True)
        digits = Spelling([b"%d," % k for k in different.tolist()])
        out, stops = digits.spell(where), np.cumsum(digits.length[where])
        out[stops[at_a[upto_a - 1]] - 1] = ord("|")
        out[stops[at_b[upto_b - 1]] - 1] = ord(";")
        return out, stops[at_b[upto_b - 1]]


class Stretches:
    """The alignment of every stretch seen, by number: counts of tokens, groups and links, the links' codes and the groups as text.

    New words are queued; ``settle`` joins them to one text, which both sides encode at once, and aligns them together.
    """

    def __init__(self, one: ByteLevel, two: Pieces):
        self.one, self.two, self.by_words = one, two, one.by_words and two.by_words
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers(self)  # by word, the space before it left out
        self.queue: list[str] = []
        self.queued, self.size, self.count = 0, 0, 0
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]

    def put(self, raw: str) -> int:
        """The number of a new stretch, which is aligned later."""
        self.queue.append(raw)
        self.queued += len(raw)
        self.size += len(raw)
        self.count += 1
        number = self.count - 1
        if self.queued >= QUEUE:
            self._encode_queue()
        return number

    def whole(self, raw: str) -> list[int] | None:
        """The numbers of a stretch that is encoded by itself, of several if it is very long; None if its tokens don't spell it."""
        self._encode_queue()
        found = self._ids(raw)
        if found is None:
            return None
        first, (ids_a, ids_b, ends_a, ends_b) = self.count, found
        for i, j in _sliced(ends_a, ends_b):
            base = int(ends_a[i.start - 1]) if i.start else 0
            self._align(ids_a[i], ids_b[j], ends_a[i] - base, ends_b[j] - base, ends_a[i][-1:] - base)
            self.count += 1
        self.size += len(raw)
        return list(range(first, self.count))

    def _ids(self, raw: str) -> tuple[np.ndarray, ...] | None:
        out, want = [], np.frombuffer(raw.encode(), np.uint8)
        for side in (self.one, self.two):
            ids = np.array(side.encode(raw), np.int64)
            ends = np.cumsum(side.spelling.length[ids])
            if not len(ids) or ends[-1] != len(want) or not np.array_equal(side.spelling.spell(ids), want):
                return None
            out += [ids, ends]
        return out[0], out[2], out[1], out[3]

    def _encode_queue(self) -> None:
        if not self.queue:
            return
        queue, self.queue, self.queued = self.queue, [], 0
        stops = np.cumsum([len(x) for x in queue] if all(map(str.isascii, queue)) else [len(x.encode()) for x in queue])
        found = self._ids("".join(queue))
        if found is not None and np.isin(stops, found[2]).all() and np.isin(stops, found[3]).all():
            self._align(*found, stops)
            return
        for raw in queue:  # some are not spelled: those have no tokens
            alone = self._ids(raw)
            if alone is None:
                self.parts.append((np.zeros((1, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)))
            else:
                self._align(*alone, alone[2][-1:])

    def _align(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, stops: np.ndarray) -> None:
        found = Aligned(ends_a, ends_b)
        text, ends = found.text(a, b)
        upto_a, upto_b = np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1
        links, groups = np.searchsorted(found.a, upto_a - 1, "right"), found.group_a[upto_a - 1] + 1
        rows = np.stack([np.diff(x, prepend=0) for x in (upto_a, upto_b, groups, links, ends[groups - 1])], axis=1)
        self.parts.append((rows, a[found.a] * STRIDE + b[found.b], text))

    def settle(self) -> None:
        """Aligns what is queued and brings the tables up to date."""
        self._encode_queue()
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        rows, self.codes, self.chars = self.parts[0]
        self.n_a, self.n_b, self.groups, self.links, self.length = rows.T
        self.link_at, self.char_at = np.cumsum(self.links) - self.links, np.cumsum(self.length) - self.length

    def numbers(self, text: str) -> list[int] | None:
        """The numbers of a text's stretches; None if it isn't spelled by its tokens."""
        if not self.by_words:
            return self.whole(" " + text)
        if not (len(text) > LONG or _ODD.search(text) or text[0].isspace() or text[-1].isspace()):
            return list(map(self.known.__getitem__, text.replace("\n", " \n").split(" ")))  # the cuts of _CUT
        out: list[int] = []
        for raw in _CUT.split(" " + text):
            if len(raw) <= LONG and raw[1:2].strip() and raw[-1:].strip():
                out.append(self.known[raw[1:] if raw[0] == " " else raw])
            elif (more := self.whole(raw)) is not None:
                out += more
            else:
                return self.whole(" " + text)
        return out


class _Numbers(dict):
    def __init__(self, owner: Stretches):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self[word] = number = self.owner.put(word if word[0] == "\n" else " " + word)
        return number


def _sliced(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Token ranges of about SLICE bytes between cuts of both sides."""
    total, done, i, j = int(ends_a[-1]), 0, 0, 0
    if total <= 2 * SLICE:
        yield slice(0, len(ends_a)), slice(0, len(ends_b))
        return
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    while done < total:
        stop = int(common[min(np.searchsorted(common, done + SLICE), len(common) - 1)])
        ni, nj = int(np.searchsorted(ends_a, stop)) + 1, int(np.searchsorted(ends_b, stop)) + 1
        yield slice(i, ni), slice(j, nj)
        done, i, j = stop, ni, nj


def _stretches(a_path: str, b_path: str) -> Stretches:
    known = K.cache("alignment")
    if (a_path, b_path) not in known:
        known[a_path, b_path] = Stretches(ByteLevel(a_path), Pieces(b_path))
    return known[a_path, b_path]


def _packed(different: np.ndarray, times: np.ndarray) -> bytes:
    """Places in the dictionary as sorted differences and multiplicities, byte by byte, compressed after their number."""
    flat = np.concatenate((np.diff(different, prepend=0), times)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(different).to_bytes(4, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 8 * int.from_bytes(data[:4], "little")
    flat = pa.decompress(data[4:], decompressed_size=size, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(values) // 2
    return np.cumsum(values[:half]), values[half:]


_TABLE = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary())])
_TABLE_DDL = "block long, place long, pair long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


def _block_rows(block: int, read: list[tuple[int | None, str, list[int] | None]], seen: Stretches, digest: bool) -> Iterator[pa.RecordBatch]:
    """A block's documents (their ids, texts and stretches) and its dictionary."""
    seen.settle()
    docs, none = [], np.zeros(0, np.int64)
    for id_, text, numbers in read:
        x = np.array(numbers or [], np.int64)
        if not seen.n_a[x].all():  # a word isn't spelled alone; the text decides as a whole
            x = np.array(seen.whole(" " + text) or [], np.int64)
        docs.append((id_, x if numbers is not None else none))
    seen.settle()
    used = np.unique(np.concatenate([x for _, x in docs]))
    mine = K.ranges(seen.link_at[used], seen.links[used])
    different, inverse = np.unique(seen.codes[mine], return_inverse=True)
    place = np.zeros(len(seen.codes), np.int64)
    place[mine] = inverse
    total, rows = np.zeros(len(different), np.int64), []
    for id_, x in docs:
        data, groups = None, b""
        if len(x):
            mentioned, times = np.unique(place[K.ranges(seen.link_at[x], seen.links[x])], return_counts=True)
            total[mentioned] += times
            data = _packed(mentioned, times)
            groups = seen.chars[K.ranges(seen.char_at[x], seen.length[x])][:-1].tobytes()
        text = hashlib.sha256(groups).hexdigest() if digest and len(x) else groups.decode()
        rows.append((block, None, None, None, id_, int(seen.n_a[x].sum()), int(seen.n_b[x].sum()), int(seen.groups[x].sum()), int(seen.links[x].sum()), text, data))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TABLE, strict=True)], schema=_TABLE)
    for lo in range(0, len(different), 50_000):
        part = slice(lo, min(lo + 50_000, len(different)))
        n = part.stop - lo
        made = [pa.array(np.full(n, block)), pa.array(np.arange(lo, part.stop)), pa.array(different[part]), pa.array(total[part])]
        yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(n, f.type) for f in list(_TABLE)[4:]]], schema=_TABLE)


def _encode(a_path: str, b_path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _stretches(a_path, b_path)
        block, size, docs = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                string = text.as_py() or ""
                docs.append((id_, string, seen.numbers(string) if string else None))
                size += len(string) + 100
                if size >= BLOCK:
                    yield from _block_rows(block, docs, seen, digest)
                    block, size, docs = block + 1, 0, []
                    if seen.size > CACHE:
                        seen.clear()
        if docs:
            yield from _block_rows(block, docs, seen, digest)
        if seen.size > CACHE:
            seen.clear()

    return K.lean(run)


def _tables(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, digest: bool, scratch: Scratch) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return scratch.table(rows.mapInArrow(_encode(a_path, b_path, digest), _TABLE_DDL))


def _counts(encoded: DataFrame) -> DataFrame:
    return encoded.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count"))


def pair_counts(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a_id, b_id, count`` of every pair of ids that is linked somewhere."""
    scratch = Scratch(df.sparkSession)
    counts = _counts(_tables(df, a_path, b_path, id_col, text_col, True, scratch))
    return scratch.finish(counts.select(F.expr(f"pair div {STRIDE}").alias("a_id"), (F.col("pair") % STRIDE).alias("b_id"), "count"))


_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of blocks, each block's dictionary first."""
    block, counts, best, parts = None, None, None, []
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        in_dictionary = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (in_dictionary[1:] != in_dictionary[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if hi <= lo:
                continue
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, counts, parts = int(blocks[lo]), None, []
            if in_dictionary[lo]:
                parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)))
                counts = None
                continue
            if counts is None and parts:
                counts, best = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                parts = []
            n_best, total = [], []
            for links, data in zip(part.column("n_links").to_pylist(), part.column("links"), strict=True):
                if links:
                    places, times = _unpacked(data.as_buffer().to_pybytes())
                    n_best.append(int(times[best[places]].sum()))
                    total.append(int(counts[places] @ times))
                else:
                    n_best.append(0)
                    total.append(0)
            named = {x: part.column(x) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            named |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups": part.column("groups")}
            yield pa.RecordBatch.from_pydict(named)


def align_tokens(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``df``: its tokens, groups and links, and how its links stand among all.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``. ``n_best`` counts the
    links whose pair is the most frequent of its B id, ``count_sum`` adds the pairs' counts up. ``groups`` is
    ``a1,a2|b1;a3|b2,b3`` (ids), or its SHA-256 in lower-case hex with ``digest``.
    """
    scratch = Scratch(df.sparkSession)
    encoded = _tables(df, a_path, b_path, id_col, text_col, digest, scratch)
    per_b = Window.partitionBy(F.col("pair") % STRIDE)
    counts = scratch.table(_counts(encoded).withColumn("best", F.col("count") == F.max("count").over(per_b)))
    dictionary = encoded.where("pair is not null").select("block", "place", "pair").join(counts, "pair")
    none = {c: F.lit(None).cast(t) for c, t in (x.split(" ") for x in _RESULT_DDL.split(", ")) if c not in ("n_best", "count_sum")}
    learned = dictionary.select("block", "place", "count", "best", *[c.alias(n) for n, c in none.items()], F.lit(None).cast("binary").alias("links"))
    rows = encoded.where("pair is null").select("block", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), *none, "links")
    met = learned.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return scratch.finish(met.mapInArrow(K.lean(_weigh), _RESULT_DDL))
