"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once.

Normalising works on UTF-8 bytes: A-Z become a-z, every other ASCII byte that is not a letter or digit becomes a
break, bytes from 0x80 stay. Each word of the benchmark then stands as a number of a few digits, written with letters of which the
first digit has its own, and every other word as blanks of that length. So a match is whole words by construction, and its end
maps straight back to words and to character offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, blob, table

WINDOW = 10
#: Trie nodes that one automaton may have, some 60 bytes each in every Python worker; more windows make further passes.
MAX_NODES = 2_000_000
#: Windows of an item that are dealt to a pass together.
PIECE = 1_000
#: Digits that number the benchmark's words, and letters for each: a node looks its children up one after another.
DIGITS, LETTERS = 3, 64

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_SCHEMA = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<first_word:int,end_word:int,start_char:int,end_char:int>>"
)
_SPAN = pa.struct([(c, pa.int32()) for c in ("first_word", "end_word", "start_char", "end_char")])
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(_SPAN)}
_OTHER = "\0"
_MACHINES: dict[str, Machine] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def pieces_of(words: list[bytes], width: int, most: int) -> Iterator[tuple[bytes, int]]:
    """(words joined by spaces, number of windows) of parts of an item, each window in one part."""
    for i in range(0, max(1, len(words) - width + 1) if words else 0, most):
        part = words[i : i + most + width - 1]
        yield b" ".join(part), max(1, len(part) - width + 1)


@dataclass
class Machine:
    """The automaton, each benchmark word's number, and the digits of a number. A match gives (its words, ids of its items)."""

    found: object
    numbers: dict[bytes, str]
    digits: int


def machine_of(pieces: Iterable[tuple[str, bytes]], width: int) -> Machine:
    import ahocorasick

    texts = [(item, text.split()) for item, text in pieces]
    words = list(dict.fromkeys(w for _, line in texts for w in line))
    digits = next(k for k in range(1, 12) if len(words) <= LETTERS**k)
    numbers = {w: "".join(chr(1 + (n // LETTERS**d) % LETTERS + LETTERS * (d > 0)) for d in range(digits)) for n, w in enumerate(words)}
    windows: dict[str, tuple[int, list[str]]] = {}
    for item, line in texts:
        for i in range(max(1, len(line) - width + 1)):
            part = line[i : i + width]
            ids = windows.setdefault("".join(map(numbers.__getitem__, part)), (len(part), []))[1]
            if item not in ids[-1:]:
                ids.append(item)
    found = ahocorasick.Automaton()
    for window, value in windows.items():
        found.add_word(window, value)
    if len(found):
        found.make_automaton()
    return Machine(found, numbers, digits)


def scan_text(text: bytes, machine: Machine) -> tuple[int, np.ndarray, set[str]]:
    """Words of the text, a mask of the hit ones (empty: none), ids of the items found."""
    words = text.translate(_FOLD).split()
    n, items, none = len(words), set(), np.zeros(0, bool)
    if not n or not len(machine.found):
        return n, none, items
    found = list(machine.found.iter("".join(map(machine.numbers.get, words, repeat(_OTHER * machine.digits)))))
    if not found:
        return n, none, items
    step = np.zeros(n + 1, np.int64)
    ends = np.fromiter((e + 1 for e, _ in found), np.int64, len(found)) // machine.digits
    sizes = np.fromiter((v[0] for _, v in found), np.int64, len(found))
    np.add.at(step, ends - sizes, 1)
    np.add.at(step, ends, -1)
    for _, v in found:
        items.update(v[1])
    return n, np.cumsum(step[:-1]) > 0, items


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, as words and as characters of the original text."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    raw = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    step = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [
        {"first_word": int(a), "end_word": int(b), "start_char": int(chars[starts[a]]), "end_char": int(chars[ends[b - 1]])}
        for a, b in zip(first, end, strict=True)
    ]


def _cutter(width: int, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, *p) for item, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text")), strict=True) for p in pieces_of(words_of(text), width, most)]
            yield pa.RecordBatch.from_pylist([{"item": i, "piece": p, "windows": n} for i, p, n in rows], pa.schema([("item", pa.string()), ("piece", pa.binary()), ("windows", pa.int64())]))

    return cut


def _reports(texts: pa.Array, found: list[tuple[int, np.ndarray, set[str]]]) -> list[pa.Array]:
    """n_words, n_hit, items and spans of the texts."""
    columns = (
        [n for n, _, _ in found],
        [int(hit.sum()) for _, hit, _ in found],
        [sorted(ids) for _, _, ids in found],
        [original_spans(t.as_py(), hit) if len(hit) else [] for t, (_, hit, _) in zip(texts, found, strict=True)],
    )
    return [pa.array(c, kind) for c, kind in zip(columns, _TYPES.values(), strict=True)]


def _machine(key: str, pieces, width: int) -> Machine:
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = machine_of(pieces.value, width)
    return _MACHINES[key]


def _scanner(pieces, key: str, width: int):
    """row, text -> row and what the automaton finds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, pieces, width)
        for batch in batches:
            texts = batch.column("text")
            found = [scan_text(t.as_py(), machine) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *_reports(texts, found)], ["row", *_TYPES])

    return scan


def _hitter(pieces, key: str, width: int):
    """a, b, text -> a, b, hit word ranges and items of the texts in which the automaton finds something."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, pieces, width)
        for batch in batches:
            found = [scan_text(t.as_py(), machine) for t in batch.column("text")]
            at = [i for i, (_, hit, _) in enumerate(found) if len(hit)]
            spans = [[{k: s[k] for k in ("first_word", "end_word")} for s in original_spans(batch.column("text")[i].as_py(), found[i][1])] for i in at]
            rows = pa.array(at, pa.int64())
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))
            columns = [batch.column("a").take(rows), batch.column("b").take(rows), pa.array(spans, kind), pa.array([sorted(found[i][2]) for i in at], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "hits", "ids"])

    return scan


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, hits, ids of all passes -> row and the report."""
    for batch in batches:
        texts, found = batch.column("text"), []
        for text, hits, ids in zip(texts, batch.column("hits"), batch.column("ids"), strict=True):
            n = len(words_of(text.as_py()))
            hit = np.zeros(n if hits.is_valid else 0, bool)
            for s in hits.as_py() or ():
                hit[s["first_word"] : s["end_word"]] = True
            found.append((n, hit, set(ids.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *_reports(texts, found)], ["row", *_TYPES])


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    width: int = WINDOW,
    max_nodes: int = MAX_NODES,
) -> DataFrame:
    """Return row (a struct of the carried columns, by default the id), n_words, n_hit, items (ids as strings, sorted)
    and spans for every row of docs.

    A window is width consecutive words of an item, or the whole item if it is shorter; a word inside any occurrence of
    one is hit. What is broadcast is the items' words, and each Python worker builds the automaton of them. Where all
    windows together could have more than max_nodes nodes (three a word), they are dealt by hash into passes of about half that; each pass
    leaves only the hits of the texts that have any, which are joined to the texts in the end.
    Null texts and items have no words; items without words match nothing; repeated rows are each scanned; an empty
    benchmark hits nothing; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    most = max(1, max_nodes // (width * DIGITS))
    kept = benchmark.select(F.col(item_col).cast("string").alias("item"), blob(item_text_col).alias("text")).where("item is not null")
    pieces = scratch.put(kept.mapInArrow(_cutter(width, min(PIECE, most)), "item string, piece binary, windows long").distinct())
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    passes = 1 if total <= most else -(-2 * total // most)
    keys = F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit("b"), F.col(text_col)).alias("b")
    rows = docs.select(F.struct(*([id_col] if carry is None else carry)).alias("row"), *keys, blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string(_SCHEMA).fields])

    def shipped(k: int):
        own = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(passes)) == k) if passes > 1 else pieces
        return spark.sparkContext.broadcast([(r["item"], bytes(r["piece"])) for r in own.select("item", "piece").collect()])

    if passes == 1:
        return rows.select("row", "text").mapInArrow(_scanner(shipped(0), scratch.root, width), schema)
    kind, found = "a long, b long, hits array<struct<first_word:int,end_word:int>>, ids array<string>", []
    for k in range(passes):
        sent = shipped(k)
        found.append(scratch.put(rows.select("a", "b", "text").mapInArrow(_hitter(sent, f"{scratch.root}/{k}", width), kind).dropDuplicates(["a", "b"])))
        sent.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    merged = every.groupBy("a", "b").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    merged = scratch.put(merged)
    scratch.drop(*found)
    return rows.join(merged, ["a", "b"], "left").select("row", "text", "hits", "ids").mapInArrow(_merger, schema)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
