"""Byte-level BPE with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes says so, hence shared passages fall into the same
chunks whatever stands around them. Each distinct chunk is encoded once in a task, from its first to its
last certain boundary; what lies between the certain boundaries of two neighbours is then encoded again
as one piece, which makes the joined ids equal to those of the whole text. Documents are brought together
by a fingerprint of their lines first, so that copies and near copies meet in one task.
"""

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cuelake.llm.common import U64, fresh, merged, mix, pieces, text_bytes

#: A chunk ends on average after so many bytes (a power of two).
CHUNK = 1024
#: Bytes that the rolling hash sees.
ROLLING = 16
#: Bytes of encoded chunks that a worker holds: texts, ids (4 bytes each) and what each entry takes besides. When full
#: it starts afresh, and only reuse is lost.
HELD_BYTES, ENTRY_BYTES = 32 << 20, 400
#: Blanks in a row from which on a piece goes to the library: the ranked form's pattern would need too deep a stack.
BLANK_RUN = 50_000
_LONG_BLANKS = re.compile(r"(?<!\s)\s{%d}" % BLANK_RUN)
_NONE = np.zeros(0, np.int32)
_GEAR = mix(np.arange(1, 257, dtype=U64))


class Codec:
    """Encodes and decodes like the tokenizers library with the file's model and no added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = sorted(t["content"] for t in model["added_tokens"])
        self.plain = self._ranked(model)
        self.path, self._library = path, None
        self.held: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.held_bytes = 0
        self.reused = self.encoded = 0

    @property
    def library(self) -> Tokenizer:
        """The library's form of the model, read when it is first needed."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    @staticmethod
    def _ranked(model: dict) -> tiktoken.Encoding | None:
        """The same model by ranks, which is several times faster, if its ids follow its merges."""
        bpe, split = model["model"], model["pre_tokenizer"] or {}
        if model["normalizer"] or bpe["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or bpe.get("dropout") or bpe.get("ignore_merges"):
            return None
        # the printable stand-ins of the 256 bytes in byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in bpe["vocab"].items() if token not in added}
        last = -1
        for merge in bpe["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rank = bpe["vocab"].get(a + b, -1)
            if rank <= last:
                return None
            last = rank
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model["added_tokens"]):
            return None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        """The whole text in one go, as 32-bit ids."""
        if not self.plain or (len(text) > BLANK_RUN and _LONG_BLANKS.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return self.plain.encode_to_numpy(text, allowed_special="all").view(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not self.plain:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def chunk(self, data: bytes, certain: np.ndarray, start: int) -> tuple[int, int, np.ndarray]:
        """First and last certain boundary in the chunk, and the ids between them; (-1, -1, none) without any.

        certain: the certain boundaries in it, counted from where the chunk starts.
        """
        known = self.held.get(data)
        if known is not None:
            self.reused += 1
            return known
        self.encoded += 1
        if len(certain):
            a, b = int(certain[0]) - start, int(certain[-1]) - start
            known = (a, b, self.encode(data[a:b].decode("utf-8")) if b > a else _NONE)
        else:
            known = (-1, -1, _NONE)
        size = len(data) + known[2].nbytes + ENTRY_BYTES
        if self.held_bytes + size > HELD_BYTES:
            self.held.clear()
            self.held_bytes = 0
        self.held[data] = known
        self.held_bytes += size
        return known


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks start: the hash of the ROLLING bytes before says so, and a character starts there."""
    if len(data) <= ROLLING:
        return np.zeros(0, np.int64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_GEAR[data], out=total[1:])
    rolling = total[ROLLING:-1] - total[: -ROLLING - 1]
    rolling *= U64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((rolling >> U64(40)) % U64(CHUNK) == U64(0)) + ROLLING
    return at[(data[at] & 0xC0) != 0x80]


def certain_boundaries(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two printable ASCII characters.

    No piece of the byte-level pattern holds a space after another character, so one piece always ends
    and the next starts there, whatever text stands further away.
    """
    ink = (data > 0x20) & (data < 0x7F)
    out = np.zeros(len(data), bool)
    out[1:-1] = (data[1:-1] == 0x20) & ink[:-2] & ink[2:]
    return np.flatnonzero(out)


def encode_texts(codec: Codec, column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, ids of each text) for bounded runs of the column's texts."""
    data, ends = text_bytes(column)
    for i, j in pieces(ends):
        part = data[ends[i] : ends[j]]
        whole = part.tobytes()
        local = ends[i : j + 1] - ends[i]
        cut, sure = cuts(part), certain_boundaries(part)
        cut_of, out = np.searchsorted(cut, local, "right"), []
        for k in range(j - i):
            lo, hi = int(local[k]), int(local[k + 1])
            # the rolling hash starts afresh in each text
            inner = [int(c) for c in cut[cut_of[k] : cut_of[k + 1]] if lo + ROLLING <= c < hi]
            edges = [lo, *inner, hi]
            first = np.searchsorted(sure, edges)
            ids: list[np.ndarray] = []
            pending = b""
            for n in range(len(edges) - 1):
                piece = whole[edges[n] : edges[n + 1]]
                # a certain boundary on the chunk's own edge depends on the neighbour, so it doesn't count
                inside = sure[first[n] : first[n + 1]]
                inside = inside[(inside > edges[n]) & (inside < edges[n + 1] - 1)]
                a, b, core = codec.chunk(piece, inside, edges[n])
                if a < 0:
                    pending += piece
                    continue
                ids += [codec.encode((pending + piece[:a]).decode("utf-8")), core]
                pending = piece[b:]
            if pending:
                ids.append(codec.encode(pending.decode("utf-8")))
            out.append(np.concatenate(ids) if ids else _NONE)
        yield i, j, out


_CODECS: dict[str, Codec] = {}


def codec_for(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoder(path: str, text_at: int, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            for i, j, ids in encode_texts(codec, batch.column(text_at)):
                sizes = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=sizes[1:])
                flat = np.concatenate(ids) if ids else _NONE
                columns = [*batch.slice(i, j - i).columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                names = [*batch.schema.names, "ids", "decoded"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with ids_col (array of int) and, if asked for, decoded_col (the ids decoded again).

    tokenizer: path of a tokenizers JSON file that every executor can read. Null texts count as empty and
    give no ids. Very long texts are encoded whole. Repeated rows stay. Input columns named like a result
    are replaced.
    """
    results = [c for c in (ids_col, decoded_col) if c]
    keep = [c for c in docs.columns if c.lower() not in {r.lower() for r in results} or c == text_col]
    text_at = next(n for n, c in enumerate(keep) if c.lower() == text_col.lower())
    (key,) = fresh(docs, "_cluster")
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.xxhash64(x))
    near = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(key, F.array_min(lines))
    # tasks get rows of near fingerprints; a fingerprint with very many rows is split
    near = near.hint("rebalance", F.col(key)).drop(key)
    fields = [*near.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f"c{n}" for n in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    run = _encoder(tokenizer, text_at, decoded_col is not None)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    out = merged(near.mapInArrow(renamed, schema), docs)
    final = {**{c: names[n] for n, c in enumerate(keep)}, ids_col: names[len(keep)]}
    if decoded_col:
        final[decoded_col] = names[len(keep) + 1]
    return out.select(*[F.col(v).alias(k) for k, v in final.items() if k not in results or k in (ids_col, decoded_col)])


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """rows with decoded_col, the text of the ids. Null ids give null, no ids an empty text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_for(tokenizer)
        for ids in batches:
            yield pa.array([codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids], pa.string())

    return rows.withColumn(decoded_col, text(F.col(ids_col)))
