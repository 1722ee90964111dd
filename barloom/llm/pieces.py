"""SentencePiece BPE with seeded merge-dropout, and its exact decoding.

A text becomes "▁" + text with spaces written as "▁"; symbols are merged by the vocabulary's scores, leftmost first among
equals, and characters without a piece become byte pieces. With dropout, a candidate merge is identified by the occurrence it
stands in (the text's hash and the unit's place there) and the three character bounds of its two symbols; when the agenda reaches
it, it is skipped for good if the keyed hash of these falls under alpha. Nothing else decides, so a rerun or a retried task gives the
same pieces, and every occurrence of a word draws anew.

Units end before a run of "▁" and around characters that no longer piece holds, across which nothing can merge. A unit is
cut once without any skip, which also tells the merges in agenda order; an occurrence that skips none of these has that cut, the others are
cut by their own hashes. Units are cut many at a time in numpy, one merge of each a step; very long ones with a heap.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import blob, chunks, flat, mix, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 0.1, 17
SPACE = "▁"
#: Characters of a unit that is cut among others; longer ones are cut one by one with a heap.
LONG = 64
#: Units whose cut a Python worker keeps, some 300 bytes each; beyond, the least used half is forgotten.
KEPT_UNITS = 400_000
_LITERAL = "\ud800"
_NEVER = (1 << 31) - 1


@dataclass
class Vocabulary:
    """What executors need of a model file.

    pieces: bytes of each id; chars: ids of characters; merges: the rank of two ids' merge by a * base + b, lower ranks first;
    made: the id that each rank makes.
    """

    pieces: list[bytes]
    chars: dict[str, int]
    byte_ids: list[int]
    base: int
    merges: dict[int, int]
    made: list[int]
    lonely: str


def load(model: str = MODEL) -> Vocabulary:
    """Read a BPE model with byte fallback. Runs on the driver; the file's size bounds what is broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
        raise ValueError("a piece spans words")
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if len(set(byte_ids)) != 256:
        raise ValueError("the model has no byte fallback")
    pieces = [b""] * n
    for p, i in plain.items():
        pieces[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        pieces[i] = bytes([b])
    made = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
    rank = {i: r for r, i in enumerate(made)}
    base, merges = n + 1, {}  # one id more: a character without a piece, which merges with nothing
    for p, i in plain.items():
        for cut in range(1, len(p)):
            x, y = plain.get(p[:cut]), plain.get(p[cut:])
            if x is not None and y is not None:
                merges[x * base + y] = rank[i]
    longer = set("".join(p for p in plain if len(p) > 1))
    lonely = "\n" if "\n" not in longer else ""
    return Vocabulary(pieces, {p: i for p, i in plain.items() if len(p) == 1}, byte_ids, base, merges, made, lonely)


def _candidate(begin, middle, end):
    return begin | middle << 21 | end << 42


def skipped(key: np.ndarray, candidate: np.ndarray, alpha: float) -> np.ndarray:
    """Whether the keyed hash skips each candidate merge (its bounds) of an occurrence (its key)."""
    h = mix(key + candidate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)) < np.uint64(int(alpha * (1 << 53)))


def _bytes(c: str) -> bytes:
    return SPACE.encode() if c == _LITERAL else c.encode("utf-8", "surrogatepass")


class _Ragged:
    """Rows of integers one after another, in an array that grows."""

    def __init__(self, kind: type) -> None:
        self.store, self.ends = np.empty(1 << 12, kind), np.zeros(1, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.ends[-1])
        if at + len(values) > len(self.store):
            self.store = np.concatenate((self.store[:at], np.empty(at + len(values), self.store.dtype)))
        self.store[at : at + len(values)] = values
        self.ends = np.concatenate((self.ends, at + np.cumsum(sizes)))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of rows one after another, and where each row begins (one more at the end)."""
        first = self.ends[at]
        total = np.concatenate(([0], np.cumsum(self.ends[at + 1] - first)))
        return self.store[np.repeat(first - total[:-1], np.diff(total)) + np.arange(int(total[-1]))], total

    def keep(self, at: np.ndarray) -> None:
        self.store, self.ends = self.take(at)


class _Known(dict):
    """Units and their numbers; a new short one gets the next number and is listed, a long one gets -1."""

    def __init__(self, *given) -> None:
        super().__init__(*given)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        if len(unit) > LONG:
            return -1
        self.new.append(unit)
        self[unit] = at = len(self)
        return at


class Encoder:
    """Cuts units and keeps the frequent ones; one in each Python worker."""

    def __init__(self, words: Vocabulary, alpha: float, seed: int, most: int = KEPT_UNITS) -> None:
        self.v, self.alpha, self.seed, self.most = words, alpha, seed, most
        rest = f"{SPACE}{words.lonely}"
        self.units = re.compile(f"{words.lonely}+|{SPACE}+[^{rest}]*|[^{rest}]+" if words.lonely else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.char_id = np.full(0x110000, words.base - 1, np.int32)
        for c, i in words.chars.items():
            self.char_id[ord(c)] = i
        self.made = np.array(words.made, np.int32)
        self.pairs = np.fromiter(words.merges.keys(), np.int64, len(words.merges))
        self.pair_ranks = np.fromiter(words.merges.values(), np.int32, len(words.merges))
        bits = max(1, int(len(self.pairs)).bit_length() + 2)
        self.shift, self.slots, self.probes = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32), 0
        pending = np.arange(len(self.pairs), dtype=np.int32)
        while len(pending):  # an open table: unplaced pairs try the next slot together
            at = (self._home(self.pairs[pending]) + self.probes) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]
            pending = pending[self.slots[at] != pending]
            self.probes += 1
        self.known = _Known()
        self.ids, self.path = _Ragged(np.int32), _Ragged(np.int64)
        self.used = np.zeros(0, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two neighbouring symbols merge, _NEVER if they do not."""
        keys = a.astype(np.int64) * self.v.base + b
        home = self._home(keys)
        slot = self.slots[home]
        hit = self.pairs[slot] == keys  # an empty slot reads the last pair, which stands elsewhere
        out = np.where(hit & (slot >= 0), self.pair_ranks[slot], np.int32(_NEVER))
        todo = np.flatnonzero((slot >= 0) & ~hit)
        for probe in range(1, self.probes):
            if not len(todo):
                break
            slot = self.slots[(home[todo] + probe) & (len(self.slots) - 1)]
            hit = (slot >= 0) & (self.pairs[slot] == keys[todo])
            out[todo[hit]] = self.pair_ranks[slot[hit]]
            todo = todo[(slot >= 0) & ~hit]
        return out

    def cut(self, units: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Ids of short units one after another, their number for each; the same of the merges made, in the agenda's order.

        With keys (one a unit) candidates are skipped by their hashes."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        group = (sizes + 3) // 4
        parts = []
        for g in np.unique(group).tolist():
            rows = np.flatnonzero(group == g)
            for at in np.array_split(rows, -(-len(rows) // 50_000)):
                parts.append((at, *self._together(code, first[at], sizes[at], 4 * g, None if keys is None else keys[at])))
        n_ids, n_path = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for at, _, n, _, m in parts:
            n_ids[at], n_path[at] = n, m
        out = []
        for n, i in ((n_ids, 1), (n_path, 3)):
            begin = np.cumsum(n) - n
            values = np.empty(int(n.sum()), np.int32 if i == 1 else np.int64)
            for part in parts:
                own = n[part[0]]
                values[np.repeat(begin[part[0]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] = part[i]
            out += [values, n]
        return tuple(out)

    def _together(self, code: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """cut() for units of nearly the same length: a symbol a column, one more column on each side."""
        n, wide = len(first), width + 2
        column = np.arange(1, width + 1)
        inside = column <= sizes[:, None]
        whole = np.full((n, wide), -1, np.int32)
        whole[:, 1:-1][inside] = self.char_id[code[(first[:, None] + column - 1)[inside]]]
        ranks = np.full((n, wide), _NEVER, np.int32)
        pair = np.flatnonzero(inside[:, 1:]) // (width - 1) * wide + np.flatnonzero(inside[:, 1:]) % (width - 1) + 1
        sym, rank = whole.reshape(-1), ranks.reshape(-1)  # places are row * wide + column
        rank[pair] = self.ranks(sym[pair], sym[pair + 1])
        right = np.arange(1, n * wide + 1)
        left = right - 2
        path = np.full((n, width), -1, np.int64)
        live, step = np.arange(n), 0
        while True:
            column = ranks.argmin(axis=1) if len(live) == n else ranks[live].argmin(axis=1)
            i = live * wide + column
            best = rank[i]
            going = np.flatnonzero(best < _NEVER)
            if len(going) < len(live):
                live, column, i, best = live[going], column[going], i[going], best[going]
            if not len(live):
                break
            j = right[i]
            e = right[j]
            begin = column - 1
            candidate = _candidate(begin, begin + (j - i), begin + (e - i))
            if keys is not None:
                gone = skipped(keys[live], candidate, self.alpha)
                rank[i[gone]] = _NEVER
                stay = np.flatnonzero(~gone)
                i, j, e, best = i[stay], j[stay], e[stay], best[stay]
            else:
                path[live, step] = candidate
            step += 1
            p, new = left[i], self.made[best]
            sym[i], sym[j], right[i], left[e], rank[j] = new, -1, e, i, _NEVER
            both = self.ranks(np.concatenate((new, sym[p])), np.concatenate((sym[e], new)))
            rank[i], rank[p] = both[: len(i)], both[len(i) :]
        ids = whole[:, 1:-1]
        kept = ids >= 0
        count = kept.sum(axis=1)
        out = ids[kept]
        odd = np.flatnonzero(out == self.v.base - 1)
        if len(odd):
            where = np.flatnonzero(kept)[odd]
            own = where // width
            raw = [_bytes(chr(c)) for c in code[first[own] + where % width].tolist()]
            times = np.ones(len(out), np.int64)
            times[odd] = [len(r) for r in raw]
            count += np.bincount(own, weights=times[odd] - 1, minlength=n).astype(np.int64)
            spelt = np.repeat(out == self.v.base - 1, times)
            out = np.repeat(out, times)
            out[spelt] = np.array(self.v.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
        made = path >= 0
        return out, count, path[made], made.sum(axis=1)

    def heap(self, unit: str, key: int) -> list[int]:
        """Ids of one occurrence of a long unit: an agenda of candidates by (rank, place)."""
        merge, base, n = self.v.merges.get, self.v.base, len(unit)
        s = [self.v.chars.get(c, base - 1) for c in unit]
        left, right, end, gone = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1)), [False] * n
        agenda: list[tuple[int, int, int, int]] = []
        own = np.array([key], np.uint64)

        def offer(i: int) -> None:
            j = right[i]
            r = merge(s[i] * base + s[j]) if i >= 0 and j < n else None
            if r is not None:
                heapq.heappush(agenda, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            r, i, middle, last = heapq.heappop(agenda)
            j = right[i]
            if gone[i] or end[i] != middle or j >= n or end[j] != last:
                continue
            if self.alpha > 0 and skipped(own, np.array([_candidate(i, middle, last)]), self.alpha)[0]:
                continue
            s[i], end[i], gone[j], right[i] = self.v.made[r], last, True, right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        spelt = ((s[i],) if s[i] != base - 1 else (self.v.byte_ids[b] for b in _bytes(unit[i])) for i in range(n) if not gone[i])
        return [x for ids in spelt for x in ids]

    def forget(self) -> None:
        """Keep the units used most, half of those allowed."""
        keep = self.used > np.sort(self.used)[-(self.most // 2)]
        new, kept, listed = np.cumsum(keep) - 1, np.flatnonzero(keep), keep.tolist()
        self.known = _Known({u: int(new[i]) for u, i in self.known.items() if listed[i]})
        self.ids.keep(kept)
        self.path.keep(kept)
        self.used = self.used[kept] // 2

    def units_of(self, text: str) -> list[str]:
        """The text's units. A literal "▁" stands as the lone surrogate _LITERAL, which no text holds, so that it becomes byte
        pieces and decoding gives it back."""
        return self.units.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else []

    def keys_of(self, raw: bytes, n: int) -> np.ndarray:
        """A key for each of the n units of a text."""
        return mix(np.arange(n, dtype=np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(raw, self.seed)))

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one more at the end)."""
        if len(self.known) > self.most:
            self.forget()
        listed = [self.units_of(r.decode("utf-8", "surrogatepass")) for r in raws]
        bounds = np.cumsum([0, *map(len, listed)])
        units = [u for x in listed for u in x]
        if not units:
            return np.empty(0, np.int32), bounds
        keys = np.concatenate([self.keys_of(r, len(x)) for r, x in zip(raws, listed, strict=True)])
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if new := self.known.new:
            ids, n_ids, path, n_path = self.cut(new, None)
            self.ids.extend(ids, n_ids)
            self.path.extend(path, n_path)
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            self.known.new = []
        short = np.flatnonzero(at >= 0)
        np.add.at(self.used, at[short], 1)
        own_cut = short[self._with_skips(at[short], keys[short])] if self.alpha > 0 else short[:0]
        size = np.zeros(len(units), np.int64)
        plain = at >= 0
        plain[own_cut] = False
        plain = np.flatnonzero(plain)
        parts = [(plain, *self.ids.take(at[plain]))]
        if len(own_cut):
            ids, n, _, _ = self.cut([units[i] for i in own_cut.tolist()], keys[own_cut])
            parts.append((own_cut, ids, np.concatenate(([0], np.cumsum(n)))))
        if len(short) < len(at):
            rest = np.flatnonzero(at < 0)
            cuts = [self.heap(units[i], int(keys[i])) for i in rest.tolist()]
            parts.append((rest, np.array([x for c in cuts for x in c], np.int32), np.cumsum([0, *map(len, cuts)])))
        for where, _, total in parts:
            size[where] = np.diff(total)
        begin = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(begin[-1]), np.int32)
        for where, ids, total in parts:
            out[np.repeat(begin[where] - total[:-1], np.diff(total)) + np.arange(len(ids))] = ids
        return out, begin[bounds]

    def _with_skips(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences that skip a merge of their unit's cut."""
        found = []
        for a in range(0, len(at), 100_000):
            candidates, first = self.path.take(at[a : a + 100_000])
            own = np.repeat(np.arange(a, a + len(first) - 1), np.diff(first))
            hit = own[skipped(keys[own], candidates, self.alpha)]
            found.append(hit[np.append(True, hit[1:] != hit[:-1])] if len(hit) else hit)
        return np.concatenate(found) if found else np.empty(0, np.int64)


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    """The UTF-8 bytes of a text from its ids."""
    return b"".join(map(pieces.__getitem__, ids))[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def encode_texts(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    model: str = MODEL,
    alpha: float = ALPHA,
    seed: int = SEED,
) -> DataFrame:
    """row (a struct of the carried columns, by default all), ids (array of piece ids) and lossless for every row.

    lossless says that the ids decode to the very bytes of the text; it is computed by decoding. Null and empty texts have no
    ids; equal texts get equal ids. alpha 0 gives the model's own segmentation.
    """
    spark: SparkSession = docs.sparkSession
    carry = docs.columns if carry is None else carry
    words = spark.sparkContext.broadcast(load(model))
    rows = docs.select(F.struct(*carry).alias("row"), blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string("ids array<int>, lossless boolean").fields])

    key = (uuid.uuid4().hex, alpha, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(words.value, alpha, seed)
        encoder, pieces = _ENCODERS[key], words.value.pieces
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                ids, first = encoder.encode(raw)
                flat_ids = ids.tolist()
                lossless = [decode(flat_ids[i:j], pieces) == r for r, i, j in zip(raw, first[:-1].tolist(), first[1:].tolist(), strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), listed, pa.array(lossless)], ["row", "ids", "lossless"])

    return rows.mapInArrow(run, schema)


def op1_merge_dropout(spark, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "lossless"
    )
