"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Both vocabularies cut the same bytes, so their tokens' ends are two ascending lists. Merging them tells where both end: these offsets close
groups, and the tokens that end there are linked. The merge is dealt out by diagonals: on the diagonal k a binary search finds how many of
the first k merged ends are A's, so pieces between neighbouring diagonals hold the same number of ends whatever the texts look like
and need nothing from each other. A piece emits the ends that its two slices share; an end of B that opens a piece is held against the last
end of A before it, and the groups that pieces cut are stitched by putting their links in order.

Link counts are corpus-wide. Tasks cut blocks of whole texts (some BLOCK_BYTES of text, or one longer text) and emit a row for each of the block's
distinct pairs, so what is shuffled for a frequent pair is one row a block, and a row for each text, whose links are the places of their pairs among
the block's. Each block gets its own pairs' counts back and adds them up over its texts. No row holds more than a text, and no step more than a block
at once, so memory goes neither by the size of a task nor by the number of tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import Scratch, blob, chunks, flat, table

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
#: Text bytes of a block that are aligned in one pass, and what a file of blocks buffers before it writes.
PASS_BYTES, ROW_GROUP_BYTES = 512 << 10, 16 << 20
#: Bytes that are tokenized in one call, and characters after which a longer text is cut at the next space between words.
CALL_BYTES, PART_CHARS = 256 << 10, 128 << 10
#: Ends in one piece of the merge.
PIECE = 1 << 16
#: How byte-level vocabularies split text before merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BETWEEN = re.compile(r"(?<=\w) (?=\w)")


@dataclass
class Vocabulary:
    """The bytes of each id; base is one more than the largest id. ranked: merges go by id, so that ids serve as ranks."""

    bytes: list[bytes]
    ranked: bool = False
    special: frozenset[int] = frozenset()

    @property
    def base(self) -> int:
        return len(self.bytes)


def byte_level() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code from 256 on."""
    plain = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_a(path: str = A_FILE) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, merges = data["model"]["vocab"], data["model"]["merges"]
    code = byte_level()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    split = data.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not data.get("normalizer")
    return Vocabulary(out, plain and made == sorted(made), frozenset(t["id"] for t in data["added_tokens"]))


def load_b(path: str = B_FILE) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode())
    if any(re.search(rb"[^ ] ", x) for x in out):
        raise ValueError("a piece spans words")
    return Vocabulary(out)


def parts_of(text: str) -> list[str]:
    """A long text in parts that begin with the space between two words, across which neither vocabulary has a token."""
    out, at = [], 0
    while len(text) - at > 2 * PART_CHARS:
        found = _BETWEEN.search(text, at + PART_CHARS)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Pair:
    """Both tokenizers; one of it in each Python worker."""

    def __init__(self, a_file: str, b_file: str, a: Vocabulary, b: Vocabulary) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        if a.ranked:  # the same merges, found by a library that takes a third of the time
            import tiktoken

            ranks = {x: i for i, x in enumerate(a.bytes) if i not in a.special}
            self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tok = Tokenizer.from_file(a_file)
            tok.encode_special_tokens = True
            self.encode_a = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a, self.b = a, b
        self.a_len, self.b_len = (np.array([len(x) for x in v.bytes], np.int64) for v in (a, b))
        self.a_text, self.b_text = ([np.array([f"{i}{mark}" for i in range(v.base)], object) for mark in marks] for v, marks in ((a, ",|"), (b, ",;")))

    def encode(self, raws: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none where the text is empty or does not come back."""
        none = np.empty(0, np.int32)
        a_ids, b_ids = [none] * len(raws), [none] * len(raws)
        todo: list[tuple[int, list[str]]] = []
        size = 0
        for i, raw in enumerate(raws):
            if raw:
                try:
                    todo.append((i, parts_of(raw.decode())))
                    size += len(raw)
                except UnicodeDecodeError:
                    continue
            if todo and (size >= CALL_BYTES or i + 1 == len(raws)):
                self._call(todo, raws, a_ids, b_ids)
                todo, size = [], 0
        if todo:
            self._call(todo, raws, a_ids, b_ids)
        return a_ids, b_ids

    def _call(self, todo: list[tuple[int, list[str]]], raws: list[bytes | None], a_ids: list, b_ids: list) -> None:
        first = [p[0] for _, p in todo]
        a_first = [self.encode_a(" " + t) for t in first]
        b_first = self.sp.encode(first, num_threads=1)
        for (i, parts), a, b in zip(todo, a_first, b_first, strict=True):
            for part in parts[1:]:  # one at a time, as a long text's parts need the most memory
                a = a + self.encode_a(part)
                b = b + self.sp.encode(part[1:], num_threads=1)
            want = b" " + raws[i]
            if b"".join(map(self.a.bytes.__getitem__, a)) == want and b"".join(map(self.b.bytes.__getitem__, b)) == want:
                a_ids[i], b_ids[i] = np.array(a, np.int32), np.array(b, np.int32)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of A's and of B's ends stand before each cut of the merged list, A's first among equals; every cut by its own search."""
    total = len(a) + len(b)
    k = np.unique(np.append(np.arange(0, total, piece), total))
    low, high = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, k - low
        middle = (low + high) // 2
        later = np.zeros(len(k), bool)
        later[open_] = a[middle[open_]] <= b[k[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & later, middle + 1, low), np.where(open_ & ~later, middle, high)


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the ends that a piece's slices share, A's slice with the one end before it."""
    begin = max(0, i0 - 1)
    left, right = a[begin:i1], b[j0:j1]
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(left, right)
    hit = left[np.minimum(at, len(left) - 1)] == right
    return at[hit] + begin, np.flatnonzero(hit) + j0


def links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ends that A and B share: the pieces' overlaps in their order. A group goes from one link to the next."""
    i, j = diagonals(a, b, piece)
    parts = [merge_piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def aligned(pair: Pair, raws: list[bytes | None], digest: bool) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """n_a, n_b, groups and n_links of each text, and the pairs (a * base + b) of all their links one after another."""
    a_ids, b_ids = pair.encode(raws)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.concatenate(ids) if ids else np.empty(0, np.int32) for ids in (a_ids, b_ids))
    i, j = links(np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b]))
    ga, gb = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
    out = np.empty(len(a) + len(b), object)
    before = np.concatenate(([0], j + 1))
    out[np.arange(len(a)) + before[ga]] = np.where(i[ga] == np.arange(len(a)), pair.a_text[1][a], pair.a_text[0][a]) if len(a) else a
    out[np.arange(len(b)) + i[gb] + 1] = np.where(j[gb] == np.arange(len(b)), pair.b_text[1][b], pair.b_text[0][b]) if len(b) else b
    end = np.concatenate(([0], np.cumsum(n_a + n_b)))
    groups = ("".join(out[s:e].tolist())[:-1] for s, e in zip(end[:-1].tolist(), end[1:].tolist(), strict=True))
    groups = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for g in groups]
    n_links = np.diff(np.searchsorted(i, np.concatenate(([0], np.cumsum(n_a)))))
    return n_a, n_b, groups, n_links, a[i].astype(np.int64) * pair.b.base + b[j]


def block(pair: Pair, texts: pa.Array, digest: bool) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """Columns of a block's texts, and its distinct pairs, ascending, with their number of links.

    links holds a text's places among the distinct pairs, in two bytes each where these can tell all pairs apart, else in four."""
    _, offsets = flat(texts)
    done, codes, places, times = [], [], [], []
    for s, e in chunks(offsets, PASS_BYTES):
        *columns, own = aligned(pair, texts.slice(s, e - s).to_pylist(), digest)
        code, place, n = np.unique(own, return_inverse=True, return_counts=True)
        done.append(columns)
        codes.append(code)
        places.append(place.astype(np.int32))
        times.append(n)
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, at, np.concatenate(times))
    kind = np.uint16 if len(code) <= 1 << 16 else np.int32
    own_at = np.split(at.astype(kind), np.cumsum([len(x) for x in codes])[:-1])
    place = np.concatenate([to[own] for to, own in zip(own_at, places, strict=True)])
    n_a, n_b, n_links = (np.concatenate([x[k] for x in done]) for k in (0, 1, 3))
    ends = np.concatenate(([0], np.cumsum(n_links))) * place.itemsize
    listed = pa.Array.from_buffers(pa.large_binary(), len(n_links), [None, pa.py_buffer(ends), pa.py_buffer(place)])
    return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "groups": pa.array([g for x in done for g in x[2]], pa.string()), "n_links": pa.array(n_links), "links": listed}, code, total


def added(links: pa.Array, n_links: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each text's links' values, by their places in the block."""
    raw, offsets = flat(links)
    ends = np.concatenate(([0], np.cumsum(n_links)))
    if not ends[-1]:
        return np.zeros(len(n_links), np.int64)
    raw = raw[offsets[0] : offsets[-1]]
    place = raw.view(np.uint16 if len(raw) == 2 * ends[-1] else np.int32)
    sums = np.concatenate(([0], np.cumsum(values[place])))
    return sums[ends[1:]] - sums[ends[:-1]]


_PAIRS: dict[str, Pair] = {}


def align(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    a_file: str = A_FILE,
    b_file: str = B_FILE,
    digest: bool = False,
) -> DataFrame:
    """row (a struct of the carried columns, by default all), n_a, n_b, n_groups, groups, n_links, n_best, count_sum for every row.

    A cuts space + text, B adds the space itself; special tokens' strings are plain text. groups is "a1,a2|b1;a3|b2,b3" (its SHA-256 with
    digest); a link is a token of A and one of B that end at the same byte; n_best counts the links whose pair is linked as often,
    corpus-wide, as any pair of that B token; count_sum adds the pair's count over the links.

    Null and empty texts, and texts that either vocabulary does not give back byte for byte, have no tokens: zeros and an empty string.
    Repeated rows stay and count each. Texts of any length are cut at spaces between words before they are tokenized; their ids
    and links stand in one row. An empty table gives no rows. Carried columns stand in a struct, so their names cannot clash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    carry = docs.columns if carry is None else carry
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in carry]
    rows = docs.select(F.struct(*quoted).alias("row"), blob(text_col).alias("text"))
    a, b = load_a(a_file), load_b(b_file)
    base = b.base
    words = spark.sparkContext.broadcast((a, b))  # the files' size bounds it
    own = _parse_datatype_string("n_a long, n_b long, groups string, n_links long, links binary").fields
    schema = StructType([*_parse_datatype_string("block long, pair long, n long").fields, StructField("row", rows.schema["row"].dataType), *own])
    made = StructType([rows.schema["row"], *_parse_datatype_string("n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long").fields])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if key not in _PAIRS:
            _PAIRS.clear()
            _PAIRS[key] = Pair(a_file, b_file, *words.value)
        out, number = to_arrow_schema(schema), TaskContext.get().partitionId() << 32

        def filled(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            columns = {f.name: columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in out}
            return pa.RecordBatch.from_arrays(list(columns.values()), schema=out)

        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for s, e in chunks(offsets, BLOCK_BYTES):
                texts, code, times = block(_PAIRS[key], batch.column("text").slice(s, e - s), digest)
                for own, n in (({"pair": pa.array(code), "n": pa.array(times)}, len(code)), (texts | {"row": batch.column("row").slice(s, e - s)}, e - s)):
                    yield filled(n, own | {"block": pa.array(np.full(n, number))})
                number += 1

    def sums(texts: pa.Table, counts: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        order = np.argsort(counts.column("pair").to_numpy())
        n, best = (counts.column(c).to_numpy()[order] for c in ("n", "best"))
        parts = []
        for t in texts.to_batches():
            n_links = t.column("n_links").to_numpy()
            own = {"n_groups": t.column("n_links")} | {c: pa.array(added(t.column("links"), n_links, x)) for c, x in (("n_best", best), ("count_sum", n))}
            parts.append([own[f.name] if f.name in own else t.column(f.name).cast(f.type) for f in to_arrow_schema(made)])
        out = to_arrow_schema(made)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(p, schema=out) for p in parts], out)

    blocks = scratch.put(rows.mapInArrow(run, schema), **{"parquet.block.size": ROW_GROUP_BYTES})
    pairs = blocks.where("pair is not null").select("block", "pair", "n")
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair") % base))
    total = scratch.put(total.withColumn("best", (F.col("n") == best).cast("long")))
    counts = pairs.drop("n").join(total, "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    texts = blocks.where("pair is null").drop("pair", "n")
    return texts.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(sums, made)


def op12_merge_path(spark, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"), carry=["doc_id"], digest=True)
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
