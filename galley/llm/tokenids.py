"""Token ids in files of compressed planes.

A file holds the ids of consecutive documents. They are cut into blocks of ``BLOCK`` ids; a block's 32-bit ids are
transposed into byte planes (or bit planes), each plane is compressed by itself, and planes that are all zero take no
space. The footer has the chunk index (place and plane sizes of every block) and the documents' ids and lengths, so a
reader can fetch any range of ids without the rest.

Layout: ``MAGIC`` | block planes ... | footer (zstandard) | footer length, u64 | ``MAGIC``. All numbers are little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, plain, saved, shared_dir

MAGIC = b"GALTOK1\n"
BLOCK = 1 << 16
# A task starts another file at this many ids.
FILE_IDS = 1 << 24
END = 0
# Pieces that each of an encoder's two generations remembers, at about 200 bytes each. Fewer take less memory and more time.
CACHED = 300_000
# Characters of texts that are encoded at once.
AT_ONCE = 1 << 19
# Texts on which cutting at blanks is compared with the library before it is used.
PROBES = [
    "", " ", "a", " a b", "one two  three", "line\nnext\n\nlast ", "tab\tand \t mix", "don't can't 'quoted' (x) [y]", "1 22 333 4,444.5 6-7", "...!? -- a.b,c;d",
    "Grüße aus München", "один два, три", "ñandú ção été", "日本語 テキスト 中文", "e\u0301 \u00a0 x\u2003y", "😀 🇩🇪 a😀b", "A\r\nB \r C", "x \n y", "  lead", "trail  ", "<s> </s> <|x|>",
]


class Encoder:
    """Whole texts to ids with the tokenizers library, remembering frequent words.

    A byte-level tokenizer cuts a text into words before it merges bytes, always in front of a blank that a visible
    character follows and in front of a line feed that follows one. Between such cuts pieces are encoded alone, so equal
    pieces are encoded once. Texts with other white space at a cut are given to the library whole.
    """

    def __init__(self, path: str, cached: int = CACHED):
        self.cached = cached
        # A task has one core; threads beside it would only take time from other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.border = special[0] if special else (None, None)
        # Ids of a byte-level vocabulary that begin with a blank or a line feed, and so the piece that they stand in.
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.known: dict = {}
        self.older: dict = {}
        # The shortcut holds for tokenizers that cut at blanks first; another one gets whole texts.
        same = self._by_pieces(PROBES) == self._library(PROBES) and self._by_pieces([" ".join(PROBES)]) == self._library([" ".join(PROBES)])
        self._encoded = self._by_pieces if same else self._library

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(g.ids, "<u4").tobytes() for g in got]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Many short texts at a call: a special token between them is a border that nothing is merged across."""
        if self.mark is None or any(self.border in t for t in texts):
            return self._library(texts)
        out: list[bytes] = []
        groups = [texts[i : i + 256] for i in range(0, len(texts), 256)]
        joined = [self.border.join(g) for g in groups]
        for got in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(got.ids, "<u4")
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]
        return out

    def _in_a_row(self, texts: list[str]) -> list[bytes]:
        """Regular pieces that begin with a blank or a line feed, joined as they are: each begins at an id that says so."""
        out: list[bytes] = []
        groups = [texts[i : i + 4096] for i in range(0, len(texts), 4096)]
        for group in groups:
            joined = "".join(group)
            if self.border is None or self.border not in joined:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
                if len(cuts) == len(group) and cuts[0] == 0:
                    raw = ids.tobytes()
                    out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
                    continue
            out += self._pieces(group)
        return out

    @staticmethod
    def _regular(piece) -> bool:
        """Whether a cut in front of this piece, and one behind it, is a word boundary in any text."""
        if isinstance(piece, tuple):
            return not piece[0][-1:].isspace()
        inner = piece[1:] if piece.startswith("\n") else piece
        return bool(inner) and not inner[0].isspace() and not inner[-1].isspace()

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            pieces: list = text.replace("\n", " \n").split(" ")
            pieces[0] = (pieces[0],)
            cut.append(pieces)
        known, older = self.known, self.older
        missing = []
        for piece in set().union(*cut).difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                missing.append(piece)
        firsts, inner = [], []
        for piece in missing:
            if piece.__class__ is str and piece.isalnum():
                inner.append(piece)
            elif not self._regular(piece):
                known[piece] = None
            else:
                (firsts if piece.__class__ is tuple else inner).append(piece)
        known.update(zip(firsts, self._pieces([p[0] for p in firsts])))
        known.update(zip(inner, self._in_a_row([p if p[0] == "\n" else " " + p for p in inner])))
        look = known.__getitem__
        out: list = []
        for pieces in cut:
            try:
                out.append(b"".join(map(look, pieces)))
            except TypeError:
                out.append(None)
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        if len(known) > self.cached:
            # What was not asked for in a whole generation is forgotten.
            self.known, self.older = {}, known
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit numbers."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self._encoded(part)
                part, size = [], 0
        if part:
            yield from self._encoded(part)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One encoder per worker, vocabulary file and size of its memory."""
    if (path, cached) not in _ENCODERS:
        _ENCODERS[path, cached] = Encoder(path, cached)
    return _ENCODERS[path, cached]


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """32-bit ids to 4 byte planes or 32 bit planes, lowest first; a plane of zeros is empty."""
    if bits:
        rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if bits:
        rows = np.zeros((32, n), np.uint8)
        for k, p in enumerate(planes):
            if p:
                rows[k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
        return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    rows = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if p:
            rows[:, k] = np.frombuffer(p, np.uint8)
    return rows.reshape(-1).view("<u4")


class Writer:
    """Streams documents into one file; holds one block of ids and the documents' lengths."""

    def __init__(self, out, bits: bool = False, level: int = 1, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = len(MAGIC)
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for at in range(0, n, self.block):
            part = ids[at : min(at + self.block, n)]
            packed = [self.pack(p) if p else b"" for p in to_planes(part, self.bits)]
            self.index.append((self.at, len(part), list(map(len, packed))))
            self.at += self.out.write(b"".join(packed))
        self.held, self.n_held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        planes = 32 if self.bits else 4
        head = struct.pack("<QQQQ", self.bits, self.block, len(self.index), len(self.docs))
        chunks = np.array([[a, n, *s] for a, n, s in self.index], "<u8").reshape(-1, 2 + planes)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([n for _, n in self.docs], "<u8")
        footer = self.pack(b"".join([head, *[a.tobytes() for a in (chunks, ids, null, sizes)]]))
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to a file by its chunk index."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 8 - len(MAGIC))
        n, end = struct.unpack(f"<Q{len(MAGIC)}s", source.read(8 + len(MAGIC)))
        if end != MAGIC:
            raise ValueError("not a token file, or cut off")
        source.seek(size - 8 - len(MAGIC) - n)
        footer = zstandard.ZstdDecompressor().decompress(source.read(n))
        bits, self.block, n_chunks, n_docs = struct.unpack_from("<QQQQ", footer)
        self.bits, planes, at = bool(bits), 32 if bits else 4, 32
        self.index = np.frombuffer(footer, "<u8", n_chunks * (2 + planes), at).reshape(-1, 2 + planes)
        at += self.index.nbytes
        ids = np.frombuffer(footer, "<i8", n_docs, at)
        null = np.frombuffer(footer, np.uint8, n_docs, at + 8 * n_docs)
        self.sizes = np.frombuffer(footer, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.index[k])
        self.source.seek(at)
        raw, planes, p = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpack(raw[p : p + s]) if s else b"")
            p += s
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start .. start + n - 1`` of the file; reads only their chunks."""
        parts, first = [], start // self.block
        for k in range(first, -(-(start + n) // self.block)):
            parts.append(self.chunk(k))
        whole = np.concatenate(parts) if parts else np.empty(0, "<u4")
        return whole[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Every document's id, length and pieces of ids, in order, one chunk at a time."""
        chunk, k, at = np.empty(0, "<u4"), 0, 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal chunk, k, at
            while n:
                if at == len(chunk):
                    chunk, k, at = self.chunk(k), k + 1, 0
                part = chunk[at : at + n]
                at += len(part)
                n -= len(part)
                yield part

        for doc_id, n in zip(self.doc_ids, self.sizes.tolist()):
            yield doc_id, n, pieces(n)


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: int = END, bits: bool = False, cached: int = CACHED) -> DataFrame:
    """``doc_id, text`` -> files under ``folder`` and their manifest ``part, seq, file, n_docs, n_ids, start``.

    Documents lie in ascending order of id (null first, then by text), over files that are themselves in order. A task
    that runs again writes files of new names; the manifest only names those of the attempt that counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary, cached).encode
        rows: list[tuple] = []
        writer = out = None

        def finish() -> None:
            writer.close()
            out.close()
            rows.append((part, len(rows), name, len(writer.docs), writer.n_ids))

        for batch in batches:
            # Few texts are Python strings at a time.
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = (t.as_py() or "" for t in piece.column("text"))
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encode(texts)):
                    if writer is None:
                        name = f"{part:08d}-{len(rows):06d}-{uuid.uuid4().hex}.ids"
                        out = store.open_output_stream(f"{root}/{name}")
                        writer = Writer(out, bits)
                    writer.add(doc_id, np.frombuffer(ids + struct.pack("<I", end), "<u4"))
                    if writer.n_ids >= FILE_IDS:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "seq", "file", "n_docs", "n_ids"])
        give_back()

    by = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select("doc_id", "text").repartitionByRange(*by[:2]).sortWithinPartitions(*by)
    kinds = "part long, seq long, file string, n_docs long, n_ids long"
    manifest = saved(ordered.mapInArrow(run, kinds), "manifest").df
    # One row per file, so this order is over a small table whatever the documents are.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                with store.open_input_file(f"{root}/{file}") as source:
                    for doc_id, n, pieces in Reader(source).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.tobytes(), crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    # A task per file or so: adaptive execution would take a manifest for small and read all files in one task.
    spread = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, cached: int = CACHED) -> DataFrame:
    """Encodes, writes and reads back every row: ``doc_id, start, n_tokens, ids_crc32``.

    A null or empty text is the end id alone. Rows with a null id come first; rows of equal id follow each other by
    text, and each keeps its own place. An empty table gives no files and no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/galley-ids-{uuid.uuid4().hex}"
    folder = folder if re.match(r"\w+://|\w+:/", folder) else "file://" + folder
    texts = plain(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read_digests(write_ids(texts, folder, vocabulary, bits=bits, cached=cached), folder)
