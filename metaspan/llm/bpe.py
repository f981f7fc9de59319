"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token is a certain cut: no merge can span it. Texts are cut there,
fragments are encoded independently (and remembered), and the ids are concatenated. The word pattern that limits merges
must not notice the cut, so a pair cuts only if
- its first byte is not white space (a white-space run's last character goes with the word that follows),
- its second byte is not an apostrophe (contractions begin there) and begins a character,
- its first byte is ASCII, or its second is ASCII white space (so that no white-space character of several bytes is last).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.llm.scratch import prepare, ship_file, shipped, table

#: Fixed value: the pattern of byte-level BPE, as the tokenizers library has it.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments remembered by a worker; the memory is emptied when full, which changes no result.
REMEMBERED = 400_000
_MARK = b"\xff"  # never part of UTF-8


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """An encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {k: bytes(letters[c] for c in k) for k in spec["model"]["vocab"] if all(c in letters for c in k)}
        self.ids = {raw[k]: i for k, i in spec["model"]["vocab"].items() if k in raw}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw[a], raw[b]): r for r, (a, b) in enumerate(pairs)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: (left id << 20 | right id) -> (rank, merged id)
        self.after = {(self.ids[a] << 20) | self.ids[b]: (r, self.ids[a + b]) for (a, b), r in self.rank.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cuts = self._forced()
        self.words = regex.compile(WORDS)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memory: dict[bytes, bytes] = {}

    def _forced(self) -> np.ndarray:
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                inside[t[:-1], t[1:]] = True
        cut = ~inside
        cut[:0x21, :] = False
        cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False
        white = np.zeros(256, bool)
        white[[0x20, *range(0x09, 0x0E)]] = True
        cut[0x80:, ~white] = False
        return cut.ravel()

    def _merge_short(self, word: bytes) -> list[int]:
        """Ranks of neighbours are kept beside the ids; a merge renews the two ranks it touches."""
        after, single = self.after, self.single
        ids = [single[b] for b in word]
        none = (1 << 40, 0)
        ranks = [after.get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = after.get((ids[i - 1] << 20) | best[1], none)
            if i < len(ranks):
                ranks[i] = after.get((best[1] << 20) | ids[i + 1], none)
        return ids

    def _merge(self, word: bytes) -> list[int]:
        """Merge by rank: a scan for short words, a heap over linked neighbours for long ones."""
        if (whole := self.ids.get(word)) is not None and len(word) == 1:
            return [whole]
        if len(word) <= 64:
            return self._merge_short(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            live[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [self.ids[parts[i]] for i in range(n) if live[i]]

    def _fragment(self, piece: bytes) -> bytes:
        """Ids of one fragment as little-endian unsigned 32-bit integers."""
        if piece.isalpha() or (piece[:1] == b" " and piece[1:].isalpha()):  # one word of ASCII letters
            ids = self._merge(piece)
        else:
            ids = [i for w in self.words.findall(piece.decode("utf-8")) for i in self._merge(w.encode())]
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= 256:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[piece] = packed
        return packed

    def _plain(self, raw: bytes) -> bytes:
        if len(raw) < 2:
            return self.memory.get(raw) or self._fragment(raw) if raw else b""
        t = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cuts[(t[:-1].astype(np.int32) << 8) | t[1:]]) + 1
        marked = np.insert(t, at, 0xFF).tobytes()
        pieces = marked.split(_MARK)
        found = list(map(self.memory.get, pieces))
        if None in found:
            found = [p if p is not None else self.memory.get(q) or self._fragment(q) for p, q in zip(found, pieces)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; special tokens in a text are themselves."""
        if not text:
            return b""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._plain(text.encode())
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p.encode()) for p in self.special_split.split(text))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder for a worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def _encode_rows(name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped(name))
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = bpe.encode(text)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            rest = [k for k in batch.schema.names if k != "text"]
            columns = [*[batch.column(k) for k in rest], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [*rest, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    return run


def encode_texts(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """docs' rows with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) in place of text.

    Texts are encoded whole. Null and empty texts have no tokens. Columns of docs with the new columns' names are
    dropped. No shuffle: each row is encoded where it is read. path is a file of the driver's machine; Spark hands it
    out to the executors.
    """
    prepare(docs.sparkSession)
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    rest = [f for f in docs.schema.fields if f.name not in (*new, "text")]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    tail = ", ids array<int>" if keep_ids else ""
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], "text").mapInArrow(_encode_rows(ship_file(docs.sparkSession, path), keep_ids), f"{head}n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text of the id array; a null array decodes to null, an unknown id fails."""
    prepare(rows.sparkSession)
    name = ship_file(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped(name))
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{head}decoded string")


def default_path() -> str:
    """The public 50k byte-level vocabulary of the box; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every whole text of `documents`."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path(), keep_ids=False)
