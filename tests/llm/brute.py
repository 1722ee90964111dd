"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import itertools
import math
import re
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(raw: bytes) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)


def components(docs, size=2):
    """doc_id -> (set size, least id reachable)."""
    sets = {}
    for d, text in docs:
        w = SPACED.findall(lower((text or "").encode()))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def hits(docs, items, width=10):
    """doc_id -> (words, hit words, item ids)."""
    windows = []
    for item, text in items:
        w = PLAIN.findall(lower((text or "").encode()))
        windows += [(item, w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w]
    out = {}
    for d, text in docs:
        w = PLAIN.findall(lower((text or "").encode()))
        hit, found = set(), set()
        for item, part in windows:
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def without_repeats(docs, window=50):
    """doc_id -> kept words."""
    words = {d: SPACED.findall((t or "").encode()) for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def without_repeated_bytes(texts, window=400):
    """Kept bytes of each text, in order."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append(bytes(x for x, g in zip(r, gone, strict=True) if not g))
    return out


def bpe(text, merges, pieces, skip=lambda *a: False):
    """Best-scored merge first, leftmost among equals; merges: (a, b) -> (rank, merged)."""
    s = [(c, i, i + 1) for i, c in enumerate(text)]
    dead = set()
    while True:
        best = None
        for i in range(len(s) - 1):
            m = merges.get((s[i][0], s[i + 1][0]))
            key = (s[i][1], s[i][2], s[i + 1][2])
            if m is not None and key not in dead and (best is None or m[0] < best[0]):
                best = (m[0], i, m[1], key)
        if best is None:
            return [x[0] for x in s]
        if skip(*best[3]):
            dead.add(best[3])
            continue
        i = best[1]
        s[i : i + 2] = [(best[2], s[i][1], s[i + 1][2])]


def spelt(symbols, unit, words):
    """Symbols with byte pieces for the characters that have no piece."""
    out, at = [], 0
    for s in symbols:
        if s == words.base - 1:
            c = "▁" if unit[at] == "\ud800" else unit[at]
            out += [words.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
            at += 1
        else:
            out.append(s)
            at += len(words.pieces[s].decode())
    return out


class _Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def _magnitude(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def baseline_jpeg(image, chroma, restart):
    """A baseline frame with unit quantisers; with chroma two half-size planes of one value. Codes all have one length."""
    height, width = image.shape
    step = 16 if chroma else 8
    full = np.pad(image.astype(float), ((0, -height % step), (0, -width % step)), mode="edge") - 128
    k, n = np.meshgrid(range(8), range(8), indexing="ij")
    wave = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    order = []
    for d in range(15):
        line = [(i, d - i) for i in range(8) if 0 <= d - i < 8]
        order += line if d % 2 else line[::-1]
    symbols = [r << 4 | s for r in range(16) for s in range(16)][:255]
    parts, out, before, units = [], _Writer(), [0, 0, 0], 0

    def block(plane, k):
        c = np.rint(wave @ plane @ wave.T).astype(int)
        zig = [int(c[i, j]) for i, j in order]
        size, extra = _magnitude(zig[0] - before[k])
        before[k] = zig[0]
        out.put(size, 4)
        out.put(extra, size)
        run = 0
        last = max([i for i in range(64) if zig[i] or i == 0])
        for v in zig[1 : last + 1]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                out.put(symbols.index(0xF0), 8)
                run -= 16
            size, extra = _magnitude(v)
            out.put(symbols.index(run << 4 | size), 8)
            out.put(extra, size)
            run = 0
        if last < 63:
            out.put(symbols.index(0), 8)

    for y in range(0, full.shape[0], step):
        for x in range(0, full.shape[1], step):
            if restart and units and units % restart == 0:
                parts.append(out.data())
                out, before[:] = _Writer(), [0, 0, 0]
            for v in range(0, step, 8):
                for h in range(0, step, 8):
                    block(full[y + v : y + v + 8, x + h : x + h + 8], 0)
            for k in (1, 2) if chroma else ():
                block(np.full((8, 8), 10.0 * k), k)
            units += 1
    parts.append(out.data())
    coded = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
    ids = [1, 2, 3] if chroma else [1]
    sof = struct.pack(">BHHB", 8, height, width, len(ids)) + b"".join(bytes([i, 0x22 if chroma and i == 1 else 0x11, 0]) for i in ids)
    dht = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + bytes([0x10]) + bytes([0] * 7 + [255] + [0] * 8) + bytes(symbols)
    sos = bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([0, 63, 0])
    made = [(0xDB, bytes([0]) + b"\1" * 64), (0xC0, sof), (0xC4, dht)] + ([(0xDD, struct.pack(">H", restart))] if restart else []) + [(0xDA, sos)]
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in made) + coded + b"\xff\xd9"


def _chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames, rate, scale, index=True):
    """An AVI of another maker: an audio chunk between frames, offsets from the file's beginning."""
    strh = struct.pack("<4s4sIHHIII", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate) + bytes(28)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", bytes(56)) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", bytes(40))))
    body, rows = b"movi", b""
    begin = 12 + len(hdrl) + 8
    for f in frames:
        for name, data in ((b"01wb", b"abc"), (b"00dc", f)):
            rows += struct.pack("<4sIII", name, 16, begin + len(body), len(data))
            body += _chunk(name, data)
    riff = b"AVI " + hdrl + _chunk(b"LIST", body) + (_chunk(b"idx1", rows) if index else b"")
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def stored_form(payload):
    """The library's AVI of a payload, each sample written by itself."""
    codes = {s: format((1 << (9 - s)) - 2 if s < 9 else 0, f"0{9 - s}b") for s in range(9)}
    head = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    head += b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, 24, 24, 1) + bytes([1, 0x11, 0]) + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
    frames = []
    for f in range(0, len(payload), 576):
        out = _Writer()
        for i in range(576):
            before = payload[f + i - 1] if i % 24 else payload[f + i - 24] if i else 128
            size, extra = _magnitude(payload[f + i] - before)
            out.bits += codes[size]
            out.put(extra, size)
        frames.append(head + out.data() + b"\xff\xd9")
    largest = max(8 + len(f) + len(f) % 2 for f in frames)
    n = len(frames)
    main = struct.pack("<14I", 1_000_000 // 24, largest * 24, 0, 0x10, n, 0, 1, largest, 24, 24, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, 24, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, 24, 24)
    form = struct.pack("<IiiHH4sIiiII", 40, 24, 24, 1, 8, b"MJPG", 576, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body, rows = b"movi", b""
    for f in frames:
        rows += struct.pack("<4sIII", b"00dc", 0x10, len(body), len(f))
        body += _chunk(b"00dc", f)
    riff = b"AVI " + hdrl + _chunk(b"LIST", body) + _chunk(b"idx1", rows)
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


class _Article(HTMLParser):
    """Text of the article's blocks; furniture tags and class ad are skipped with all they hold."""

    def __init__(self):
        super().__init__()
        self.out, self.line, self.inside, self.skip = [], "", False, []

    def cut(self):
        words = " ".join(self.line.split())
        self.out += [words] if words else []
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in ("nav", "aside", "form", "footer", "script", "style") or ("class", "ad") in attrs:
            self.skip.append(tag)
        elif tag == "article":
            self.inside = True
        elif tag == "br":
            self.line += " "
        elif tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "blockquote", "table", "tr", "td", "section"):
            self.cut()

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag == "article":
            self.cut()
            self.inside = False
        elif tag not in ("b", "i", "a", "em", "strong", "span", "br"):
            self.cut()

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line += data


def article_text(source):
    p = _Article()
    p.feed(source or "")
    p.close()
    return "\n".join(p.out)


def page(rng, host, i):
    """(html, blocks of its text): own paragraphs, a list that every page of the host repeats, furniture of all kinds."""
    blocks, out = [], []
    for k in range(rng.randint(2, 6)):
        text = f"Own text {i} {k} of page" + " very" * rng.randint(3, 12) + " long"
        kind = rng.choice(["p", "h2", "open", "div", "furniture", "entity", "two"])
        if kind in ("p", "h2", "div"):
            out.append(f"<{kind}> {text}\n  </{kind}>")
        elif kind == "open":
            out.append(f"<p>{text}")
        elif kind == "entity":
            out.append(f"<p>{text} &lt;b&gt; &eacute;&#33;</p>")
            text += " <b> \u00e9!"
        elif kind == "two":
            out.append(f"<p>{text}<br>end</p>")
            text += " end"
        else:
            out.append(rng.choice(["<nav>%s</nav>", "<aside><p>%s</aside>", "<div class='site-footer'>%s</div>", "<form><p>%s</p></form>", "<p hidden>%s</p>", "<script>'%s'</script>", "<!-- %s -->"]) % text)
            continue
        blocks.append(text)
    if not blocks:
        return page(rng, host, i)
    out.insert(rng.randint(0, len(out)), f"<section><h4>About {host[0]}</h4><ul><li>x<li>y</ul></section>")
    return f"<html><head><title>{i}</title></head><body>{''.join(out)}</body></html>", blocks


def _line_features(lines):
    out, seen = [], set()
    for k, line in enumerate(lines):
        n = max(1, len(line))
        words = SPACED.findall(line)
        w = max(1, len(words))
        kinds = (range(0x41, 0x5B), range(0x30, 0x3A), b"$%&*#@^~=+<>\\", b"|_/", b"!?", b".,;:'\"()-", range(0x80, 0xC0))
        f = [math.sqrt(sum(c in kind for c in line) / n) for kind in kinds] + [math.log1p(len(line)) / 8]
        f += [1 - len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, sum(map(len, words)) / w / 10, float(not words)]
        f += [float(line in seen and bool(words)), float(k > 0 and lines[k - 1] == line)]
        seen.add(line)
        out.append(f)
    return out


def quality_fit(x, first, y, steps, chains, ridge, tie_ridge):
    """Adam on the penalised likelihood whose expectations come from listing all labellings of every chain."""
    k = x.shape[1]
    p, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for t in range(1, steps + 1):
        g = np.zeros(k + 4)
        for a, b in zip(first[:-1], first[1:]):
            def seen(labels):
                out = np.zeros(k + 4)
                for i, s in enumerate(labels):
                    out[:k] += s * x[a + i]
                    if i:
                        out[k + 2 * int(labels[i - 1]) + int(s)] += 1
                return out

            every = [seen(s) for s in itertools.product((0, 1), repeat=int(b - a))]
            odds = np.exp([p @ s for s in every])
            expected = sum(o * s for o, s in zip(odds, every)) / odds.sum()
            g += expected - seen(y[a:b])
        if not chains:
            g[k:] = 0
        g = g / len(x) + np.array([ridge] * k + [tie_ridge] * 4) * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:k], p[k:].reshape(2, 2)


def quality_score(field, raw):
    lines = raw.split(b"\n")
    own = _line_features(lines)
    none = [0.0] * len(own[0])
    evidence = []
    for k, f in enumerate(own):
        x = [1.0, *f, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none)]
        evidence.append(sum(a * b for a, b in zip(x, field.weights, strict=True)))
    t = field.transitions

    def logsum(*v):
        top = max(v)
        return top + math.log(sum(math.exp(x - top) for x in v))

    forward, backward = [], [(0.0, 0.0)]
    for k, e in enumerate(evidence):
        f = forward[-1] if k else None
        forward.append((0.0, e) if f is None else (logsum(f[0] + t[0, 0], f[1] + t[1, 0]), e + logsum(f[0] + t[0, 1], f[1] + t[1, 1])))
    for e in evidence[:0:-1]:
        b = backward[-1]
        backward.append(tuple(logsum(t[i, 0] + b[0], t[i, 1] + e + b[1]) for i in (0, 1)))
    backward.reverse()
    good = [1 / (1 + math.exp(min(500, max(-500, f[0] + b[0] - f[1] - b[1])))) for f, b in zip(forward, backward, strict=True)]
    weight = [max(1, len(x)) for x in lines]
    mean = sum(g * w for g, w in zip(good, weight, strict=True)) / sum(weight)
    return mean / field.cut * 0.3 if mean <= field.cut else 0.3 + (mean - field.cut) / (1 - field.cut) * 0.7


def toxicity(chain, raw):
    """Probabilities of all links for one text."""
    from barloom.llm.common import prefix_hash, span_hash

    def key(gram):
        return int(span_hash(prefix_hash(np.frombuffer(gram, np.uint8)), np.array([0]), np.array([len(gram)])).view(np.int64)[0])

    count = Counter()
    for word in PLAIN.findall(lower(raw)):
        count[key(word)] += 1
        s = f" {word.decode()} "
        for n in (2, 3, 4, 5, 6):
            for i in range(len(s) - n + 1):
                count[key(s[i : i + n].encode())] += 1
    x = [math.log1p(count[int(w)]) for w in chain.words]
    out = []
    for w in chain.weights:
        z = w[0] + sum(a * b for a, b in zip(x, w[1:], strict=True))
        out.append(1 / (1 + math.exp(-min(40, max(-40, z)))))
        x.append(out[-1])
    return out


def shard(tree, doc_id, seed=0):
    """Down the tree by the smallest weighted draw."""

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def digest(path):
        h = xxhash.xxh64_intdigest(path.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), h)
        return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)

    node, path = tree, ""
    while isinstance(node, dict):
        name = min(node, key=lambda c: -math.log(((digest(f"{path}/{c}") >> 11) + 0.5) * 2.0**-53) / weight(node[c]))
        node, path = node[name], f"{path}/{name}"
    return name


def runs(words):
    """(start, length, period) of all runs by every lag and every place."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            smaller = any(all(part[k] == part[k + r] for k in range(len(part) - r)) for r in range(1, q))
            if len(part) >= max(6, 4 * q) and not smaller:
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped_words(doc_id, text):
    words = SPACED.findall((text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def aligned(docs, a_file, b_file):
    """doc_id -> (n_a, n_b, groups, links' counts, links' best) with the tokenizers' own calls and a plain merge."""
    import sentencepiece
    from tokenizers import Tokenizer

    from barloom.llm.align import load_a, load_b

    tok = Tokenizer.from_file(a_file)
    tok.encode_special_tokens = True
    sp, va, vb = sentencepiece.SentencePieceProcessor(model_file=b_file), load_a(a_file).bytes, load_b(b_file).bytes
    found, total = {}, Counter()
    for d, text in docs:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(va[i] for i in a) != want or b"".join(vb[i] for i in b) != want:
            a, b = [], []
        i = j = ea = eb = 0
        ga, gb, groups, links = [], [], [], []
        while i < len(a) or j < len(b):
            if ea <= eb:
                ea, i = ea + len(va[a[i]]), i + 1
                ga.append(a[i - 1])
            else:
                eb, j = eb + len(vb[b[j]]), j + 1
                gb.append(b[j - 1])
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        found[d] = len(a), len(b), ";".join(groups), links
        total.update(links)
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return {d: (na, nb, g, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x)) for d, (na, nb, g, x) in found.items()}
