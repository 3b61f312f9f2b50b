"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

An item of m characters that occurs in a text with k edits or fewer shares at least T = m - q + 1 - k q of its q-grams
with the place, on k + 1 neighbouring diagonals (text position less item position). Diagonals are counted in overlapping
bands of twice a power of two above k, each shifted by half against the next, so one band holds them all. Bands in which
one text has T shared q-grams or more are retained and aligned with the item, row by row for many bands at once, along
the diagonals of these q-grams widened by k on both sides. An alignment sees the characters of its text alone, whatever texts lie beside it, and
places that look alike are aligned once. Nothing within the budget is missed.

Items often share a prompt. q-grams that the same items have at the same distances form a class, and a text's q-grams are
counted by class and diagonal before they are dealt to the items of the class: the cost of a shared passage is one count
for each place, not one for each place, item and q-gram.

Case of ASCII letters and the kind of white space don't matter; other characters count as they are. Edits are of
characters (code points).
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloakwork.llm.common import split_by_bytes, table

Q = 8
RATE = 0.1
#: Items of fewer characters are looked for as they are, without edits, at the borders of words.
SHORT = 2 * Q
#: Characters of items in one index (more make more indexes, each with a pass of its own); characters of text at once.
BLOCK, CHUNK = 16 << 20, 1 << 20
_FOLD = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_BITS = 20
#: Counts dealt to items at once, bands aligned at once, and rows between two looks at which are over their budget.
_DEAL, _BANDS, _LOOK = 1 << 21, 512, 12
#: No character of any text: what lies around texts.
_WALL = np.uint32(0x110000)

Region = tuple[int, int, int, int, int]


def folded(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, q = 8, by doubling. Equal hashes of unlike q-grams only cost an alignment."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    h, power = points.astype(np.uint64), int(_STEP)
    for n in (1, 2, 4):
        h = h[:-n] * np.uint64(power) + h[n:]
        power = power * power % 2**64
    return h


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    """The high bits of a multiplicative hash."""
    h = x * _MIX
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _summed(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys with the sum of their counts, their least `low` and their greatest `high`."""
    key, back = np.unique(keys, return_inverse=True)
    total, least, most = np.zeros(len(key), np.int64), np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
    np.add.at(total, back, counts)
    np.minimum.at(least, back, low)
    np.maximum.at(most, back, high)
    return key, total, least, most


def _in_word(a: str, b: str) -> bool:
    """Whether two neighbours are inside one word of a script that parts words by spaces."""
    return a.isalnum() and b.isalnum() and a < "⺀" and b < "⺀"


class Index:
    """q-grams of some items. items: (id, text); null and blank texts are nothing to look for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        clean = [(i, folded(t or "").strip(" ")) for i, t in items]
        self.short = ahocorasick.Automaton()
        brief: dict[str, list] = {}
        for i, t in clean:
            if 0 < len(t) < SHORT:
                brief.setdefault(t, []).append(i)
        for t, ids in brief.items():
            self.short.add_word(t, (len(t), ids))
        if brief:
            self.short.make_automaton()
        long = [(i, t) for i, t in clean if len(t) >= SHORT]
        self.ids, self.texts = [i for i, _ in long], [_points(t) for _, t in long]
        self.m = np.array(list(map(len, self.texts)), np.int64)
        self.k = np.minimum((self.m * rate).astype(np.int64), (self.m - Q) // Q)
        self.least = self.m - Q + 1 - self.k * Q
        self.half = np.array([1 << int(k).bit_length() for k in self.k], np.int64)
        grams = np.concatenate([_grams(t) for t in self.texts] or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(self.texts), dtype=np.int64), self.m - Q + 1)
        place = _ranges(np.zeros(len(self.m), np.int64), self.m - Q + 1)
        order = np.lexsort((place, item, grams))
        self.grams, first, count = np.unique(grams[order], return_index=True, return_counts=True)
        self._classes(item[order], place[order], first, count)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.grams, _BITS)] = True
        self.reach = int((self.m + 4 * self.half).max()) if len(self.m) else SHORT
        self._order([t for _, t in long])

    def _order(self, texts: list[str]) -> None:
        """Rank of each item in alphabetical order, and how many characters each item in that order shares with the next."""
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.common = np.zeros(len(order) + 1, np.int64)
        for j, (a, b) in enumerate(zip(order, order[1:])):
            n = min(self.m[a], self.m[b])
            unlike = np.nonzero(self.texts[a][:n] != self.texts[b][:n])[0]
            self.common[j] = unlike[0] if len(unlike) else n
        self.flat = np.concatenate([*self.texts, np.zeros(1, np.uint32)])
        self.begins = np.cumsum(self.m) - self.m

    def _classes(self, item: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Class of each q-gram: q-grams with the same items at the same distances from the first place are of one class."""
        self.lead = place[first]
        away = place - np.repeat(self.lead, count)
        if not len(first):
            self.kind, self.size = first, count
            self.starts = self.members = self.away = first
            return
        nth = _ranges(np.zeros(len(count), np.int64), count).astype(np.uint64)
        entry = ((item.astype(np.uint64) * _STEP + away.astype(np.uint64)) * _STEP + nth) * _MIX
        marks = [np.add.reduceat((entry ^ (entry >> np.uint64(s))) * np.uint64(f), first) for s, f in ((29, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB))]
        order = np.lexsort((count, *marks))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (count, *marks)], axis=0)
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        one = order[new]
        at = _ranges(first[one], count[one])
        self.size, self.starts = count[one], np.cumsum(count[one]) - count[one]
        self.members, self.away = item[at], away[at]

    def regions(self, texts: list[str]) -> list[Region]:
        """(row, item id, start, end, edits) of every place, offsets in code points; the best of places that overlap."""
        found: list[Region] = []
        pieces = [(row, lo) for row, t in enumerate(texts) for lo in range(0, max(len(t), 1), CHUNK)]
        for a, b in split_by_bytes([min(len(texts[r]) - lo, CHUNK) for r, lo in pieces], CHUNK):
            cut = [(r, lo, folded(texts[r][max(lo - 1, 0) : lo + CHUNK + self.reach])) for r, lo in pieces[a:b]]
            if len(self.short):
                found += self._short(cut)
            found += self._scan([(r, lo, t[1:] if lo else t) for r, lo, t in cut]) if self.ids else []
        return _best(found)

    def _short(self, cut: list[tuple[int, int, str]]) -> list[Region]:
        out = []
        for r, lo, text in cut:
            base = max(lo - 1, 0)
            for last, (n, ids) in self.short.iter(text):
                s, e = last + 1 - n, last + 1
                elsewhere = (lo and not s) or base + s >= lo + CHUNK  # in the piece before or behind
                if elsewhere or (s and _in_word(text[s - 1], text[s])) or (e < len(text) and _in_word(text[e - 1], text[e])):
                    continue
                out += [(r, i, base + s, base + e, 0) for i in ids]
        return out

    def _scan(self, cut: list[tuple[int, int, str]]) -> list[Region]:
        text = _points(("\0" * Q).join([*(x for _, _, x in cut), ""])).copy()
        ends = np.cumsum([len(x) + Q for _, _, x in cut])
        text[(ends[:, None] - np.arange(1, Q + 1)[None, :]).reshape(-1)] = _WALL
        grams = _grams(text)
        at = np.nonzero(self.seen[_slot(grams, _BITS)])[0]
        values = grams[at]
        gram = np.minimum(np.searchsorted(self.grams, values), len(self.grams) - 1)
        true = self.grams[gram] == values
        at, gram = at[true], gram[true]
        if not len(at):
            return []
        # by text, class and diagonal of the class's first place, of which a text has few
        (owners, owner), (kinds, kind) = (np.unique(x, return_inverse=True) for x in (np.searchsorted(ends, at, side="right"), self.kind[gram]))
        diagonal = at - self.lead[gram] + self.reach
        breadth = len(text) + 2 * self.reach
        key, n = np.unique((owner * len(kinds) + kind) * breadth + diagonal, return_counts=True)
        owner, kind, diagonal = key // breadth // len(kinds), kinds[key // breadth % len(kinds)], key % breadth
        width = 4 * len(text) + 8 * self.reach
        parts = []
        for a, b in split_by_bytes(self.size[kind].tolist(), _DEAL):
            size = self.size[kind[a:b]]
            entry = _ranges(self.starts[kind[a:b]], size)
            item = self.members[entry]
            group = item * len(owners) + np.repeat(owner[a:b], size)
            d = np.repeat(diagonal[a:b], size) - self.away[entry] + self.reach
            half = self.half[item]
            both = np.concatenate([group * width + 2 * ((d + shift * half) // (2 * half)) + shift for shift in (0, 1)])
            d = np.tile(d, 2)
            parts.append(_summed(both, np.tile(np.repeat(n[a:b], size), 2), d, d))
        band, total, least, most = _summed(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
        group = band // width
        enough = np.nonzero(total >= self.least[group // len(owners)])[0]
        item, owner = group[enough] // len(owners), owners[group[enough] % len(owners)]
        if not len(item):
            return []
        # the matched diagonals of a band, widened by k, hold every place; whole steps of eight make alike what is alike
        span = -(-(most[enough] - least[enough] + 1 + 2 * self.k[item]) // 8) * 8
        where = np.unique(np.stack([item, owner, least[enough] - 2 * self.reach - self.k[item], span], axis=1), axis=0)
        return self._align(text, ends, cut, *where.T)

    def _align(self, text: np.ndarray, ends: np.ndarray, cut: list[tuple[int, int, str]], item: np.ndarray, owner: np.ndarray, start: np.ndarray, spans: np.ndarray) -> list[Region]:
        """The places within budget among bands of `spans` diagonals from `start` on."""
        pad = 8 * self.reach
        wall = np.full(pad, _WALL, np.uint32)
        text = np.concatenate((wall, text, wall))
        last = ends - Q  # where the wall behind each text begins
        first = last - np.array([len(x) for _, _, x in cut])
        alike = self._alike(text, start + pad, item, spans, first[owner] + pad, last[owner] + pad)
        ones = np.nonzero(alike == np.arange(len(alike)))[0]
        edits, begin, end = (np.zeros(len(item), np.int64) for _ in range(3))
        for span in np.unique(spans[ones]):
            same = ones[spans[ones] == span]
            same = same[np.lexsort((self.rank[item[same]], owner[same], start[same]))]
            windows = np.nonzero(np.concatenate(([True], (np.diff(start[same]) != 0) | (np.diff(owner[same]) != 0), [True])))[0]
            for a, b in split_by_bytes(np.diff(windows).tolist(), _BANDS):
                part = same[windows[a] : windows[b]]
                edits[part], begin[part], end[part] = self._verify(text, item[part], start[part] + pad, first[owner[part]] + pad, last[owner[part]] + pad, int(span))
        good = np.nonzero(edits[alike] <= self.k[item])[0]
        out = []
        for i, own, at, x in zip(item[good].tolist(), owner[good].tolist(), start[good].tolist(), alike[good].tolist()):
            r, lo, piece = cut[own]
            off = at - int(first[own])
            out.append((r, self.ids[i], lo + max(off + int(begin[x]), 0), lo + min(off + int(end[x]), len(piece)), int(edits[x])))
        return out

    def _alike(self, text: np.ndarray, start: np.ndarray, item: np.ndarray, spans: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """For each band the first one of the same item that sees the same characters (itself, if a text's end is near)."""
        out = np.arange(len(item))
        stop = start + self.m[item] + spans
        inside = np.nonzero((start >= before) & (stop <= behind))[0]
        if len(inside) < 2:
            return out
        sums, powers = _prefix_sums(text)
        window = (sums[stop[inside]] - sums[start[inside]]) * powers[len(text) - stop[inside]]
        order = np.lexsort((inside, window, spans[inside], item[inside]))
        s, w = inside[order], window[order]
        new = np.concatenate(([True], (np.diff(item[s]) != 0) | (np.diff(spans[s]) != 0) | (w[1:] != w[:-1])))
        out[s] = s[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        for i in inside[out[inside] != inside].tolist():  # the sums could agree by chance
            if not np.array_equal(text[start[i] : stop[i]], text[start[out[i]] : stop[out[i]]]):
                out[i] = i
        return out

    def _verify(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, before: np.ndarray, behind: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each item along its band, and where the place begins and ends, counted from the band's start.

        Bands are in order of their place in the text and of their item's rank. Items of one place that begin alike are
        aligned as one as far as they do: a band splits off its parent behind the characters that both have.
        """
        size, rank, budget = self.m[item], self.rank[item], self.k[item]
        new = np.concatenate(([True], (np.diff(start) != 0) | (np.diff(before) != 0)))
        shares = np.zeros(len(item), np.int64)
        old = np.nonzero(~new)[0]
        if len(old):
            shares[old] = np.minimum.reduceat(self.common, np.stack([rank[old - 1], rank[old]], axis=1).reshape(-1))[::2]
        budget = np.maximum.reduceat(budget, np.nonzero(new)[0])[np.cumsum(new) - 1]  # the largest at each place
        parent, stack = np.zeros(len(item), np.int64), []
        for c, n in enumerate(shares.tolist()):
            while stack and stack[-1][1] >= n:
                stack.pop()
            parent[c] = stack[-1][0] if stack and n else c
            stack.append((c, n))
        later = np.argsort(shares, kind="stable")
        due = int(np.searchsorted(shares[later], 0, side="right"))
        live = np.sort(later[:due])
        m = int(size.max())
        kind, cost = (np.int32, 1 << 16) if m + span < 1 << 14 else (np.int64, 1 << 32)
        offset = np.arange(span, dtype=kind)
        state = np.broadcast_to(offset, (len(live), span)).copy()  # edits * cost + diagonal of the first character
        value, best = np.full(len(item), np.iinfo(np.int64).max >> 8), np.zeros(len(item), np.int64)
        base, lo, hi = start[live, None] + np.arange(span)[None, :], before[live, None] - 1, behind[live, None]  # walls match nothing
        for row in range(m):
            letter = self.flat[self.begins[item[live]] + row]
            step = state + np.multiply(text[np.clip(base + row, lo, hi)] != letter[:, None], cost, dtype=kind)
            np.minimum(step[:, :-1], state[:, 1:] + cost, out=step[:, :-1])
            step -= offset * cost
            state = np.minimum.accumulate(step, axis=1)
            state += offset * cost
            over = size[live] == row + 1
            if over.any():
                best[live[over]] = np.argmin(state[over], axis=1)
                value[live[over]] = state[over, best[live[over]]]
            stop = int(np.searchsorted(shares[later], row + 1, side="right"))
            if row % _LOOK == _LOOK - 1 or over.any() or stop > due:
                keep = ~over & (state.min(axis=1) // cost <= budget[live])  # edits never become fewer
                add = np.sort(later[due:stop])
                at = np.minimum(np.searchsorted(live, parent[add]), len(live) - 1)
                there = live[at] == parent[add]  # else the parent is over its budget, and so is this one
                add, at, due = add[there], at[there], stop
                live, state = np.concatenate((live[keep], add)), np.concatenate((state[keep], state[at]))
                if len(add):
                    order = np.argsort(live)
                    live, state = live[order], state[order]
                if not len(live):
                    break
                base, lo, hi = start[live, None] + np.arange(span)[None, :], before[live, None] - 1, behind[live, None]
        return value // cost, value % cost, best + size


def _prefix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters before each place, each times its own power, and the powers: windows compare by these."""
    powers = np.ones(len(points) + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(points), _MIX | np.uint64(1)))
    h = points.astype(np.uint64) * _STEP
    h = (h ^ (h >> np.uint64(13))) * _MIX
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[:-1]))), powers


def _best(found: list[Region]) -> list[Region]:
    """Of places of one item in one text that overlap the one with the fewest edits, else the first."""
    out: list[Region] = []
    taken: dict[tuple, tuple[list[int], list[int]]] = {}
    for f in sorted(found, key=lambda f: (f[0], str(f[1]), f[4], f[2], f[3])):
        starts, ends = taken.setdefault(f[:2], ([], []))
        k = bisect_left(starts, f[3])  # of the places that begin before this one ends the last reaches farthest
        if k and ends[k - 1] > f[2]:
            continue
        starts.insert(k, f[2])
        ends.insert(k, f[3])
        out.append(f)
    return out


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple]]:
    """The items (key, text) in blocks of about BLOCK characters, in order of their key; at least one block."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).orderBy("k", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t or "") > BLOCK:
            yield block
            block, size = [], 0
        block.append((r.k, r.t))
        size += len(r.t or "")
    yield block


#: The index that this worker has made, by the name of its block.
_MADE: dict[str, Index] = {}


def _index(name: str, items: list[tuple]) -> Index:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Index(items)
    return _MADE[name]


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, start, end, edits): every place of an item in a row's whole text, offsets in code points.

    Of places of one item that overlap the one with the fewest edits stays. Null and empty texts and items have none.
    Repeated rows are each reported, repeated items once; null keys are kept; an empty table on either side gives no rows.

    Items are broadcast as texts, BLOCK characters at once, and each worker makes its index; a larger benchmark takes one
    pass over `docs` for each block. Texts never move.
    """
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, key), (benchmark, item)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = []
    for block in blocks(benchmark, item):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for batch in batches:
                found = index.regions([t or "" for t in batch.column(1).to_pylist()])
                if found:
                    row, it, *rest = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(it, item_type), *(pa.array(c, pa.int64()) for c in rest)], names=["key", "item", "start", "end", "edits"])

        parts.append(rows.mapInArrow(run, f"key {kind}, item {item_kind}, start long, end long, edits long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.toDF(key, item, "start", "end", "edits")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of `docs` in whose text no item is found, all columns as they are, without a shuffle."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, item):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for batch in batches:
                hit = {f[0] for f in index.regions([t or "" for t in batch.column(at).cast(pa.string()).to_pylist()])}
                yield batch.filter(pa.array([r not in hit for r in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item in a document."""
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
