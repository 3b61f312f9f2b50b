"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut into words where no piece of the vocabulary can reach across. The words of a batch that are not yet in
the worker's table are encoded together: one flat array of symbols, the rank of each neighbouring pair, the smallest
rank of each word (a segmented minimum), all leftmost non-overlapping pairs of that rank merged at once, then
compaction, until no word has a pair left. The library merges one pair at a time; merging all pairs of one rank at once
gives the same unless a merge makes a new pair of the same or a better rank. Each round looks for that, and the words
where it happens are encoded again with one merge a round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import split_by_bytes, table

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Bounds of a worker's table of encoded words, after which it starts anew; and of the text encoded at once.
MAX_WORDS, MAX_IDS, CHUNK = 200_000, 3_000_000, 1 << 19
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PieceCodec:
    """Encoder and decoder of one model file. Not thread-safe: it keeps a table of words seen."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        probe = "a  Ａ "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("only models with the identity normaliser are supported")
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        chars = sorted({c for p in plain for c in p})
        extra = [c for c in chars if c not in plain]
        self.size = n + len(extra) + 1
        self.other = self.size - 1  # the symbol of every character that no piece has
        symbol = plain | {c: n + k for k, c in enumerate(extra)}
        self.n = n
        self.char_symbol = np.full(max(map(ord, chars)) + 2, self.other, np.int32)
        for c in chars:
            self.char_symbol[ord(c)] = symbol[c]
        scores = np.array([model.get_score(i) for i in plain.values()])
        rank = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist()))
        pairs = [(symbol[p[:k]] * self.size + symbol[p[k:]], rank[p], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self._hash_pairs(*map(np.array, zip(*pairs)))
        self._word = self._pattern(plain)
        flat = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.out_len = np.array(list(map(len, flat)), np.int64)
        self.out_at = np.concatenate(([0], np.cumsum(self.out_len)[:-1]))
        self.out = np.frombuffer(b"".join(flat), np.uint8)
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self._clear()

    @staticmethod
    def _pattern(plain: dict[str, int]) -> re.Pattern[str] | None:
        """Words that no piece crosses: a space never follows another character in a piece, a newline has none."""
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            return None
        apart = "" if any("\n" in p and len(p) > 1 for p in plain) else r"\n"
        return re.compile((rf"{apart}|" if apart else "") + rf"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+")

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open table of pairs; `probes` steps find any key."""
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, NONE, np.int32)
        self.slot_made = np.zeros((1 << bits) + 64, np.int32)
        self.probes = 0
        home = (keys.astype(np.uint64) * _HASH >> self.shift).astype(np.int64)
        for k, h, r, m in zip(keys.tolist(), home.tolist(), ranks.tolist(), made.tolist()):
            at = h
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.slot_rank[at], self.slot_made[at] = k, r, m
            self.probes = max(self.probes, at - h + 1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; a slot of rank NONE for a pair that is no piece."""
        keys = left.astype(np.int64) * self.size + right
        at = (keys.astype(np.uint64) * _HASH >> self.shift).astype(np.int64)
        open_ = np.nonzero((self.slots[at] != keys) & (self.slots[at] >= 0))[0]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] += 1
            there = self.slots[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        at[self.slots[at] != keys] = len(self.slots) - 1
        return at

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, one_at_a_time: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of the words after all merges. lengths: of each word, 1 or more."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_sym, done_word, again = [symbols[:0]], [word[:0]], []
        while len(symbols):
            same = np.empty(len(symbols), bool)
            same[-1] = False
            np.equal(word[1:], word[:-1], out=same[:-1])
            at = np.full(len(symbols), len(self.slots) - 1)
            i = np.nonzero(same)[0]
            at[i] = self._find(symbols[i], symbols[i + 1])
            rank = self.slot_rank[at]
            first = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0]
            size = np.diff(np.append(first, len(symbols)))
            best_of = np.minimum.reduceat(rank, first)
            best = np.repeat(best_of, size)
            over = best == NONE
            if over.any():
                done_sym.append(symbols[over])
                done_word.append(word[over])
                live = ~over
                symbols, word, at, rank, best = symbols[live], word[live], at[live], rank[live], best[live]
                if not len(symbols):
                    break
            chosen = rank == best
            index = np.arange(len(symbols))
            if one_at_a_time:
                hit = np.nonzero(chosen)[0]
                chosen[:] = False
                chosen[hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]] = True
            else:
                run = index - np.maximum.accumulate(np.where(chosen, -1, index))
                chosen &= run % 2 == 1  # the first, third, ... of a run of overlapping pairs
            hit = np.nonzero(chosen)[0]
            merged = self.slot_made[at[hit]]
            new = symbols.copy()
            new[hit] = merged
            drop = np.zeros(len(symbols), bool)
            drop[hit + 1] = True
            bad = None
            if not one_at_a_time:
                bad = self._too_early(symbols, word, best, hit, merged)
            symbols, word = new[~drop], word[~drop]
            if bad is not None and len(bad):
                again.append(bad)
                live = ~np.isin(word, bad)
                symbols, word = symbols[live], word[live]
        sym, of = np.concatenate(done_sym), np.concatenate(done_word)
        if again:
            redo = np.unique(np.concatenate(again))
            ends = np.cumsum(lengths)
            take = _ranges((ends - lengths)[redo], lengths[redo])
            more, sizes = self.merge(self._input[take], lengths[redo], True)
            sym, of = np.concatenate((sym, more)), np.concatenate((of, np.repeat(redo, sizes)))
        order = np.argsort(of, kind="stable")
        return sym[order], np.bincount(of, minlength=len(lengths))

    def _too_early(self, symbols: np.ndarray, word: np.ndarray, best: np.ndarray, hit: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Words in which, merging from the left, a new pair comes before the next pair of this round."""
        twice = np.zeros(len(hit), bool)
        same = word[hit[1:]] == word[hit[:-1]]
        twice[1:] |= same
        twice[:-1] |= same
        k = np.nonzero(twice)[0]
        if not len(k):
            return k
        at, made = hit[k], merged[k]
        early = np.zeros(len(k), bool)
        right = np.minimum(at + 2, len(symbols) - 1)
        ok = (at + 2 < len(symbols)) & (word[right] == word[at])
        early[ok] |= self.slot_rank[self._find(made[ok], symbols[right[ok]])] <= best[at[ok]]
        left = symbols[at - 1]
        touching = np.zeros(len(k), bool)
        touching[1:] = at[1:] - at[:-1] == 2
        left[1:][touching[1:]] = made[:-1][touching[1:]]
        ok = (at > 0) & (word[at - 1] == word[at])
        early[ok] |= self.slot_rank[self._find(left[ok], made[ok])] <= best[at[ok]]
        return np.unique(word[at[early]])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.char_symbol[np.minimum(points, len(self.char_symbol) - 1)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        unknown = symbols >= self.n  # without an id of its own: bytes, unless merged
        if unknown.any():
            return self._with_bytes(points, symbols, lengths)
        self._input = symbols
        return self.merge(symbols, lengths)

    def _with_bytes(self, points: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _encode_words, where some characters may end as bytes."""
        self._input = symbols
        ids, sizes = self.merge(symbols, lengths)
        stays = np.nonzero(ids >= self.n)[0]
        lost = points[symbols == self.other]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        raw = []
        k = 0
        chars = {self.char_symbol[c]: c for c in range(len(self.char_symbol)) if self.n <= self.char_symbol[c] < self.other}
        for i in stays.tolist():
            if ids[i] == self.other:
                raw.append(chr(lost[k]).encode())
                k += 1
            else:
                raw.append(chr(chars[ids[i]]).encode())
        grow = np.ones(len(ids), np.int64)
        grow[stays] = list(map(len, raw))
        out = np.repeat(ids, grow)
        ends = np.cumsum(grow)
        if raw:
            at = _ranges((ends - grow)[stays], grow[stays])
            out[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(np.repeat(owner, grow), minlength=len(sizes))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, without begin and end, and the number of ids of each text."""
        if len(self.words) > MAX_WORDS or self.used > MAX_IDS:
            self._clear()
        at: list[int] = []
        counts = []
        missing: list[str] = []
        known = self.words
        get = known.get
        for text in texts:
            text = SPACE + text.replace(" ", SPACE) if text else ""
            words = self._word.findall(text) if self._word else [text] if text else []
            found = list(map(get, words))
            if None in found:
                for k, x in enumerate(found):
                    if x is None:
                        w = words[k]
                        x = get(w)
                        if x is None:
                            x = known[w] = len(known)
                            missing.append(w)
                        found[k] = x
            at += found
            counts.append(len(words))
        if missing:
            self._learn(missing)
        rows = np.array(at, np.int64)
        sizes = self.lengths[rows]
        ids = self.ids[_ranges(self.starts[rows], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        return ids, np.diff(ends[edges])

    def _learn(self, words: list[str]) -> None:
        base = len(self.words) - len(words)
        while len(self.starts) < len(self.words):
            self.starts, self.lengths = np.concatenate((self.starts, self.starts * 0)), np.concatenate((self.lengths, self.lengths * 0))
        for lo, hi in split_by_bytes(list(map(len, words)), 1 << 20):
            ids, sizes = self._encode_words(words[lo:hi])
            need = self.used + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(need, len(self.ids)), np.int32)))
            self.ids[self.used : need] = ids
            self.starts[base + lo : base + hi] = self.used + np.cumsum(sizes) - sizes
            self.lengths[base + lo : base + hi] = sizes
            self.used = need

    def encode(self, text: str) -> list[int]:
        """Ids of one text, with begin and end."""
        return [self.bos, *self.encode_batch([text])[0].tolist(), self.eos]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; ids that begin, end or are no valid UTF-8 are treated as the library does."""
        sizes = self.out_len[ids]
        flat = self.out[_ranges(self.out_at[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        cuts = ends[edges].tolist()
        texts = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            raw = flat[a:b]
            if raw[:1] == b" ":
                seen = ids[edges[k] : edges[k + 1]]
                seen = seen[~self.is_control[seen]]
                raw = raw[1:] if len(seen) and not self.is_byte[seen[0]] and seen[0] != self.unk else raw
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = _mended(raw)
            texts.append(raw)
        return texts

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _mended(raw: bytes) -> bytes:
    """Each byte that is no part of a valid character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode().encode())
            i += n
        except UnicodeDecodeError:
            out.append("�".encode())
            i += 1
    return b"".join(out)


@cache
def codec(path: str) -> PieceCodec:
    """One codec for each worker and model file."""
    return PieceCodec(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of an installed public vocabulary; each executor asks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunked(batch: pa.RecordBatch, column: int, limit: int = CHUNK) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows with their texts (null: empty) of at most `limit` characters together, or one row."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    for lo, hi in split_by_bytes(list(map(len, texts)), limit):
        yield lo, hi, texts[lo:hi]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, ids array<int>): every row's ids with begin and end. model: a file on all executors; default: public 32k.

    Null is the empty text, which has begin and end only. Any length of text; words without a space are cut where no
    piece crosses, else encoded whole. Repeated rows, null keys and empty tables are allowed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model or model_path())
        for batch in batches:
            for lo, hi, texts in chunked(batch, 1):
                ids, counts = one.encode_batch(texts)
                full = np.empty(len(ids) + 2 * len(counts), np.int32)
                stop = np.cumsum(counts + 2)
                full[stop - counts - 2], full[stop - 1] = one.bos, one.eos
                full[_ranges(stop - counts - 1, counts)] = ids
                offsets = np.concatenate(([0], np.cumsum(counts + 2))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(full))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(key, text): the text of each list of ids; null and empty lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model or model_path())
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = one.decode_batch(flat, np.array(list(map(len, lists)), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, with nothing kept but digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model or model_path())
        first, last = (np.array([x], "<u4").tobytes() for x in (one.bos, one.eos))
        for batch in batches:
            for lo, hi, texts in chunked(batch, 1):
                ids, counts = one.encode_batch(texts)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                sha = [hashlib.sha256(first + raw[a:b] + last).hexdigest() for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]
                back = [hashlib.sha256(x).hexdigest() for x in one.decode_batch(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts + 2), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of the text decoded from them."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pieces": op7_pieces}
ORACLES: dict[str, str] = {}
