"""Evaluation passages in training text, found with generalised suffix automata of the items.

An automaton knows every substring of its normalised items; a document is streamed through it and the length of the
longest suffix that is a substring of some item is kept. Where that length reaches ``min_run``, the items that hold the
run leaked. The corpus is read once: of the pieces of an item that begin at every ``step``-th place and are
``min_run - step + 1`` long, each run of ``min_run`` covers one whole, so a rolling hash over a document, looked up
among the hashes of the pieces, passes every document that has a run. Only those meet automata, each that of the items whose pieces they hold: items are dealt
to shards of bounded size, and documents and items of a shard are brought together by key.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylake.session import cut, spread

_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """NFKC, lower case, letters and numbers only."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


class ItemAutomaton:
    """Suffix automaton over several texts, which are told apart by their numbers."""

    def __init__(self, texts: list[str], min_run: int) -> None:
        self.min_run = min_run
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: dict[int, list[int]] = {}  # by state: the texts with a prefix that ends there
        for number, text in enumerate(texts):
            last = 0
            for at, ch in enumerate(text, 1):
                last = self._extend(last, ch)
                if at >= min_run:
                    self.ends.setdefault(last, []).append(number)
        self.below: dict[int, list[int]] = {}
        for v in range(1, len(self.length)):
            if self.link[v] > 0:
                self.below.setdefault(self.link[v], []).append(v)
        self.known: dict[int, frozenset] = {}

    def _extend(self, last: int, ch: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(ch)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, ch, known)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, ch, q)
        return cur

    def _clone(self, p: int, ch: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(ch) == q:
            nxt[p][ch] = copy
            p = link[p]
        link[q] = copy
        return copy

    def holders(self, state: int) -> frozenset:
        """The texts that hold the shortest suffix, of at least ``min_run``, of the strings of a state."""
        while self.link[state] > 0 and self.length[self.link[state]] >= self.min_run:
            state = self.link[state]
        if state not in self.known:
            found: set[int] = set()
            todo = [state]
            while todo:
                v = todo.pop()
                found.update(self.ends.get(v, ()))
                todo += self.below.get(v, ())
            self.known[state] = frozenset(found)
        return self.known[state]

    def runs(self, text: str) -> list[tuple[int, int, set]]:
        """(start, end, texts) of the maximal stretches of ``text`` covered by runs of at least ``min_run``."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_run
        v = matched = 0
        out: list[list] = []
        for end, ch in enumerate(text, 1):
            to = nxt[v].get(ch)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = nxt[v].get(ch)
            if to is None:
                continue
            v = to
            matched += 1
            if matched >= least:
                # The state may stand for longer strings than the match; its suffix links are then as good.
                start = end - matched
                if out and start <= out[-1][1]:
                    out[-1][1] = end
                    out[-1][2] |= self.holders(v)
                else:
                    out.append([start, end, set(self.holders(v))])
        return [tuple(x) for x in out]


# Rolling hashes: the sum of code * BASE ** place over a piece, divided by BASE ** (its begin), modulo 2 ** 64.

_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


class Pieces:
    """Hashes of all windows of a width, in chunks so that powers are made once."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.power, self.inverse = _powers(_BASE, _CHUNK + width), _powers(pow(_BASE, -1, 1 << 64), _CHUNK + width)

    def of(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(code) - self.width + 1
        parts = []
        with np.errstate(over="ignore"):
            for lo in range(0, max(n, 0), _CHUNK):
                part = code[lo : lo + _CHUNK + self.width - 1] + np.uint64(1)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * self.power[: len(part)])])
                h = (sums[self.width :] - sums[: -self.width]) * self.inverse[: len(part) - self.width + 1]
                parts.append(h ^ (h >> np.uint64(32)))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


class PieceIndex:
    """Sorted hashes, and a table of bits by which most others are told at once."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.bits = max(16, int(64 * max(1, len(self.hashes)) - 1).bit_length())
        self.table = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        slot = self._slot(self.hashes)
        np.bitwise_or.at(self.table, slot >> np.uint64(3), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def among(self, h: np.ndarray) -> np.ndarray:
        """Those of ``h`` that are indexed, each once."""
        slot = self._slot(h)
        h = h[(self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return np.unique(h[self.hashes[at] == h]) if len(self.hashes) else h[:0]


LEAK_SCHEMA = "doc_id bigint, item_id bigint, start int, stop int, doc_chars int"


def _sharded(items: DataFrame, min_run: int, shard_chars: int) -> DataFrame:
    """shard, plain, item_ids: the distinct normalised texts of at least ``min_run`` characters, dealt to shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "plain": [normalised(t) for t in pdf["text"]]})

    plain = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").mapInPandas(run, "item_id bigint, plain string").where(F.length("plain") >= min_run)
    texts = cut(plain.groupBy("plain").agg(F.collect_set("item_id").alias("item_ids")))
    chars = texts.agg(F.sum(F.length("plain"))).first()[0] or 0
    return texts.withColumn("shard", F.pmod(F.xxhash64("plain"), F.lit(max(1, -(-chars // shard_chars)))).cast("int"))


def find_leaks(documents: DataFrame, items: DataFrame, min_run: int = 50, shard_chars: int = 100_000, group_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, stop, doc_chars: stretches (in normalised text) of documents that items hold.

    Items are dealt to shards of about ``shard_chars`` characters, one automaton each. What reaches the driver, and all
    tasks, are the hashes of the items' pieces: 8 bytes for each ``min_run // 5`` characters of items. Documents
    with a piece of a shard meet its automaton in groups of about ``group_chars``, however many they are. Null texts and
    texts shorter than ``min_run`` share nothing; an empty table gives an empty result. Items with the same text are
    each reported.
    """
    spark = documents.sparkSession
    step = max(1, min_run // 5)
    width = min_run - step + 1
    shards = _sharded(items, min_run, shard_chars)

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(width)
        for pdf in batches:
            for shard, plain in zip(pdf["shard"], pdf["plain"]):
                own = np.unique(pieces.of(plain)[::step])
                yield pd.DataFrame({"shard": np.full(len(own), shard, dtype=np.int32), "piece": own.view(np.int64)})

    by_piece = cut(shards.select("shard", "plain").mapInPandas(cut_items, "shard int, piece bigint").distinct())
    index = spark.sparkContext.broadcast(PieceIndex(by_piece.select("piece").toArrow()["piece"].to_numpy().view(np.uint64)))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(width)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                plain = normalised(text)
                held = index.value.among(pieces.of(plain)) if len(plain) >= min_run else ()
                if len(held):
                    rows.append((doc_id, plain, held.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "plain", "pieces"])

    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null"))
    held = cut(docs.mapInPandas(candidates, "doc_id bigint, plain string, pieces array<bigint>"))
    # A text may stand under several ids and an id may have several texts: both are kept, as (doc_id, plain).
    met = held.select("doc_id", "plain", F.explode("pieces").alias("piece")).join(by_piece, "piece").groupBy("doc_id", F.xxhash64("plain").alias("h"), "shard").agg(F.first("plain").alias("plain"))
    chars = met.groupBy("shard").agg(F.sum(F.length("plain")).alias("chars")).withColumn("groups", F.ceil(F.col("chars") / group_chars).cast("int"))
    met = met.join(chars.select("shard", "groups"), "shard").select("shard", F.pmod("h", "groups").cast("int").alias("part"), "doc_id", "plain")
    wanted = shards.join(chars.select("shard", "groups"), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "plain", "item_ids")

    def stream(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            automaton, ids = ItemAutomaton(list(right["plain"]), min_run), list(right["item_ids"])
            for doc_id, plain in zip(left["doc_id"], left["plain"]):
                for start, stop, texts in automaton.runs(plain):
                    rows += [(doc_id, item, start, stop, len(plain)) for t in texts for item in ids[t]]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "stop", "doc_chars"])

    return met.groupBy("shard", "part").cogroup(wanted.groupBy("shard", "part")).applyInPandas(stream, LEAK_SCHEMA)


def _joins(ch: str) -> bool:
    """True if a character may be composed with the one before it."""
    return unicodedata.category(ch)[0] == "M" or "\u1160" <= ch <= "\u11ff" or "\u3131" <= ch <= "\u318e" or "\uff9e" <= ch <= "\uffdc"


def _original_places(text: str) -> tuple[list[int], list[int]]:
    """For each character of the normalised text, begin and end in ``text`` of what it came from.

    That is a character with those composed with it; in texts that do not line up that finely, a line.
    """
    starts: list[int] = []
    for at in range(len(text)):
        if not at or not _joins(text[at]):
            starts.append(at)
    for cuts in (starts, [0, *(m.end() for m in re.finditer("\n", text))]):
        begins, ends, built = [], [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(text)]):
            part = normalised(text[lo:hi])
            built.append(part)
            begins += [lo] * len(part)
            ends += [hi] * len(part)
        if "".join(built) == normalised(text):
            break
    return begins, ends


def without_leaks(documents: DataFrame, leaks: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """doc_id, coverage, removed_chars, text of the documents with leaks, the leaked spans cut out.

    A document of which leaked spans cover more than ``max_coverage`` is left out whole: its text is null. Leaks are
    the smaller side; whether they are sent to the documents is left to the planner's check of their size.
    """
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.max("doc_chars").alias("doc_chars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, found, chars in zip(pdf["doc_id"], pdf["text"], pdf["spans"], pdf["doc_chars"]):
                merged: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                covered = sum(b - a for a, b in merged)
                kept = None
                if covered <= max_coverage * chars:
                    begins, ends = _original_places(text)
                    pieces, at = [], 0
                    for a, b in merged:
                        pieces.append(text[at : begins[a]])
                        at = max(at, ends[b - 1])
                    kept = "".join(pieces) + text[at:]
                rows.append((doc_id, covered / chars, len(text) - len(kept or ""), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "coverage", "removed_chars", "text"])

    joined = documents.select("doc_id", "text").join(spans, "doc_id")
    return joined.mapInPandas(run, "doc_id bigint, coverage double, removed_chars bigint, text string")
