"""Token ids in fixed-width bit-packed shard files with block offsets.

A shard file holds, in this order: a header (magic, bits, ids a block, ids, documents, blocks),
the packed blocks, the block offsets, and the document table (id, null flag, first id). Each id
takes the fewest bits that the vocabulary needs; a block of ids starts at a byte, so any range of
ids is read by seeking to its block and unpacked with numpy.

Documents are written in ascending id order, null ids first: rows are dealt by range of (id, text
hash), so a hot id is spread too. A shard's name follows from its partition and place, its bytes
from its rows, and it appears by renaming, so a task that runs again replaces equal bytes.

Defined cases: a null text is an empty one and gives the end id alone; repeated rows are separate
documents; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import new_path, staged, text_key

MAGIC = b"WTOK0001"
HEADER = struct.Struct("<8sIIQQQ")
#: Ids in a block, and ids in a shard before the next one begins.
BLOCK_IDS, SHARD_IDS = 4096, 4_000_000
#: Words that an encoder remembers before they become its older half.
REMEMBERED = 400_000


def bits_needed(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = fields
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


def filesystem(uri: str):
    """(file system, path) of a URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids.

    A byte-level tokenizer of the usual word rule cuts before a space that stands alone between two
    words, so such texts are encoded word by word and the words' ids are remembered; a word of letters,
    with marks after it, goes straight to the tokenizer's merges. Whether a tokenizer works that way
    is tried out on samples first. Any other text, and any other tokenizer, encodes a text at once.
    """

    SAMPLES = ("Some plain words, and more. A line\nbreak; it's 3 o'clock (or 4)!", "Où ça? Über-groß ñandú naïve\n\ntail", "x")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_alphabet()
        # Held once: the library makes a new handle at each access.
        self.cut = self.tokenizer.model.tokenize
        self.id_bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A space that another white space (or nothing) follows, or a special token: no cut is safe.
        self.odd = re.compile("|".join([r" (?:\s|\Z)", *map(re.escape, special)]))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.by_word = True
        try:
            self.by_word = all(self.encode(t).tobytes() == self._at_once(t) for t in self.SAMPLES)
        except Exception:  # noqa: BLE001  another kind of model
            self.by_word = False

    def _at_once(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, token: str) -> bytes:
        """Ids of one pre-token."""
        if token.isascii() and token[1:].isalpha():
            token = self.letters[32] + token[1:] if token[0] == " " else token
        else:
            token = token.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.cut(token)])

    def _word(self, word: str) -> bytes:
        """Ids of a word, with the space before it if it has one."""
        core = word.rstrip(string.punctuation)
        if core[core[:1] == " " :].isalpha():
            mark = word[len(core) :]
            return self._merged(core) + (self._mark(mark) if mark else b"")
        lines, out = word.split("\n"), []
        for i, (first, then) in enumerate(zip(lines, lines[1:])):
            # A line feed between two letters or marks is a pre-token of its own.
            if not then or then[0].isspace() or first[-1:].isspace() or not first.strip():
                return b"".join([*out, self._at_once("\n".join(lines[i:]))])
            out += [self._word(first), self._mark("\n")]
        return b"".join([*out, self._word(lines[-1])]) if out else self._at_once(word)

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._at_once(mark)
        return self.marks[mark]

    def _after_space(self, word: str) -> bytes:
        """Ids of a word and the space before it; what stands before marks is remembered too."""
        if word.isalpha():
            return self._merged(" " + word)
        core = word.rstrip(string.punctuation)
        if len(core) == len(word) or not core.isalpha():
            return self._word(" " + word)
        ids = self.words.get(core) or self.old.get(core) or self._merged(" " + core)
        self.words[core] = ids
        return ids + self._mark(word[len(core) :])

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words, self.old = {}, self.words
        if len(self.marks) > REMEMBERED // 8:
            self.marks = {}
        known, old = self.words, self.old
        for w in set(words).difference(known):
            known[w] = old.get(w) or self._after_space(w)

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word or self.odd.search(text):
            return np.frombuffer(self._at_once(text), "<u4")
        first, *rest = text.split(" ")
        try:
            tail = b"".join(map(self.words.__getitem__, rest))
        except KeyError:
            self._learn(rest)
            tail = b"".join(map(self.words.__getitem__, rest))
        return np.frombuffer((self._word(first) if first else b"") + tail, "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """Collects documents and writes a shard."""

    def __init__(self, bits: int):
        self.bits, self.docs, self.ids, self.n = bits, [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.n))
        self.ids.append(ids)
        self.n += len(ids)

    def write(self, root: str, name: str) -> int:
        """Returns the bytes written."""
        ids = np.concatenate(self.ids)
        blocks = [pack(ids[i : i + BLOCK_IDS], self.bits) for i in range(0, len(ids), BLOCK_IDS)]
        offsets = HEADER.size + np.cumsum([0, *map(len, blocks)])
        table = np.array(self.docs, dtype=[("id", "<i8"), ("null", "?"), ("first", "<u8")])
        fs, path = filesystem(root)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(HEADER.pack(MAGIC, self.bits, BLOCK_IDS, len(ids), len(table), len(blocks)))
            out.write(b"".join(blocks))
            out.write(offsets.astype("<u8").tobytes())
            out.write(table.tobytes())
        fs.move(part, f"{path}/{name}")
        return int(offsets[-1])


class ShardReader:
    """Random access to a shard file."""

    def __init__(self, root: str, name: str):
        fs, path = filesystem(root)
        self.file = fs.open_input_file(f"{path}/{name}")
        magic, self.bits, self.block, self.n_ids, self.n_docs, self.n_blocks = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token shard")
        n_table = self.n_docs * 17
        self.file.seek(self.file.size() - n_table - 8 * (self.n_blocks + 1))
        self.offsets = np.frombuffer(self.file.read(8 * (self.n_blocks + 1)), "<u8")
        self.docs = np.frombuffer(self.file.read(n_table), dtype=[("id", "<i8"), ("null", "?"), ("first", "<u8")])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, reading only the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        held = min(self.n_ids, (last + 1) * self.block) - first * self.block
        if self.block * self.bits % 8 == 0:
            ids = unpack(data, held, self.bits)
        else:
            at = self.offsets[first : last + 2] - self.offsets[first]
            parts = [unpack(data[at[i] : at[i + 1]], min(self.block, held - i * self.block), self.bits) for i in range(last - first + 1)]
            ids = np.concatenate(parts)
        return ids[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        stop = int(self.docs["first"][i + 1]) if i + 1 < self.n_docs else self.n_ids
        return self.ids(int(self.docs["first"][i]), stop)


def write_tokens(df: DataFrame, tokenizer: str, vocab_size: int = 50_257, end_id: int = 2, key: str = "doc_id", text: str = "text", root: str | None = None) -> tuple[DataFrame, str]:
    """Encode and write every document; returns the manifest (shard, part, seq, n_docs, n_ids, n_bytes) and the folder."""
    spark = df.sparkSession
    root = root or new_path(spark, "tokens")
    filesystem(root)[0].create_dir(filesystem(root)[1], recursive=True)
    bits = bits_needed(max(vocab_size, end_id + 1))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer), np.array([end_id], "<u4")
        shard = ShardWriter(bits)

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{seq:06d}.tok"
            n = shard.write(root, name)
            return pd.DataFrame({"shard": [name], "part": [part], "seq": [seq], "n_docs": [len(shard.docs)], "n_ids": [shard.n], "n_bytes": [n]})

        for batch in batches:
            for doc_id, body in zip(batch["id"].array, batch["text"].array, strict=True):
                shard.add(None if doc_id is None or doc_id is pd.NA or doc_id != doc_id else int(doc_id), np.concatenate([enc.encode(body or ""), end]))
                if shard.n >= SHARD_IDS:
                    yield flush()
                    seq, shard = seq + 1, ShardWriter(bits)
        if shard.docs:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange("id", "salt").sortWithinPartitions("id", "salt")
    made = dealt.select("id", "text").mapInPandas(encode, "shard string, part long, seq long, n_docs long, n_ids long, n_bytes long")
    # One row a shard: it goes into few files, however many tasks encode.
    return staged(made.repartition(2 * spark.sparkContext.defaultParallelism), "manifest"), root


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    order = Window.partitionBy().orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, before in zip(batch["shard"], batch["before"], strict=True):
                r = ShardReader(root, name)
                edges = np.append(r.docs["first"], r.n_ids).astype(np.int64)
                ids = r.ids(0, r.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                out = pd.DataFrame({"id": pd.array(r.docs["id"], dtype="Int64"), "start": before + edges[:-1], "n_tokens": np.diff(edges), "ids_crc32": crc})
                out.loc[r.docs["null"], "id"] = pd.NA
                yield out

    # Two tasks a core, and more where a task would read more than 64 shards.
    n, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism
    spread = shards.repartition(max(1, min(n, max(2 * cores, -(-n // 64)))))
    return spread.mapInPandas(decode, "id long, start long, n_tokens long, ids_crc32 long")
