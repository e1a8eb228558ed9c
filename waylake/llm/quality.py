"""Per-document text statistics that tell natural prose from lists, tables and junk.

A document is counted into five distributions: function words (all other words together), character classes, pairs of
neighbouring classes, line features (width; ending and density of function words; separators; mark) weighted by width, and
how often its word pairs repeat. Each is compared by Jensen-Shannon divergence with the same distribution of every
structural profile: prose of each language, lists, tables and junk. The document gets the kind of the profile to which
its divergences add up to least. Profiles are those of the exemplars below and of clusters of a bounded sample of
labelled documents. Counting and comparing are array operations over whole batches of texts.
"""

from __future__ import annotations

import textwrap
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylake.session import spread

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for from with and or but so if is are was were be been it its this that these those there which who than as not no you your they them their can will may has have had when while before after into over most more only one also because between near until each every than".split(),
    "fr": "le la les l un une des du de d et ou mais si est sont était étaient être il elle ils elles on ce cette ces se s sa son ses leur qui que qu où ne pas plus très au aux en dans par pour sur sous avec sans chez vers près après avant entre peut faut mieux puis dont à y n c".split(),
    "es": "el la los las un una unos unas lo al del de y o u pero si es son era fue fueron ser está están hay se su sus que quien donde no más muy en con sin por para sobre desde hasta hacia entre cuando también ya casi todavía así como a e le les este esta estos estas allí".split(),
    "zh": "的 了 在 和 与 或 是 有 不 也 都 就 从 到 把 被 将 对 于 于是 为 以 及 而 但 又 其 这 那 此 并 需 要 可 会 能 应 再 后 前 上 里 中 约 较 更 最 很 没 每 几 只 先 还 着 得 地 之 等 由 向 往 才 则 因 所 如".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
KINDS = ("prose", "list", "table", "junk")

# Texts of each kind, whose distributions are profiles beside those of the labelled documents.
EXEMPLARS = {
    "prose": (
        "The path along the river is quiet in the morning, and most of the shops do not open before nine. If you have only one day, start at the north gate, which is close to the station, and leave the museum for the afternoon. It was rebuilt after the fire, but the old walls can still be seen from the bridge.\n\nThere are few places to eat on the hill, so bring some water with you.",
        "Visitors with little time should take the tram from the square and walk back along the wall, because the slope is steep and the steps are wet after rain. Tickets for the tower are sold at the gate, and there is often a queue in summer. One dish is enough for two, but ask before you order. It is cool in the evening even in August, so a second layer is useful.",
        "Le chemin qui longe la rivière est calme le matin, et la plupart des boutiques n'ouvrent pas avant neuf heures. Si vous n'avez qu'une journée, il vaut mieux commencer par la porte du nord, qui est près de la gare. Le musée a été reconstruit après l'incendie, mais les murs anciens se voient encore depuis le pont.",
        "El camino que sigue el río está tranquilo por la mañana y casi ninguna tienda abre antes de las nueve. Si solo tiene un día, empiece por la puerta del norte, que está cerca de la estación, y deje el museo para la tarde. Fue reconstruido después del incendio, pero los muros antiguos todavía se ven desde el puente.",
        "时间不多的旅行者可以从广场乘电车上山，再沿城墙走回来，因为坡道较陡，雨后台阶很滑。塔楼的门票在入口处出售，夏季常常需要排队。当地的菜份量偏大，两人点一份就够了，点单前要先问清楚。傍晚的湖边适合散步，夜里较凉。",
        "沿河的小路早晨很安静，大多数店铺九点以后才开门。如果只有一天时间，可以先从离车站较近的北门进入，把博物馆留到下午。它在火灾之后重建，但是从桥上仍然可以看到旧墙的一部分。\n\n山上可以吃饭的地方不多，需要自己带水，返回的时间也要先确认。",
    ),
    "list": (
        "- North Gate\n- River Walk\n- Stone Bridge (East Bank)\n- noodle soup\n- Hill Park\n- Old Library\n- steamed buns",
        "North Gate\nRiver Walk\nStone Bridge\nnoodle soup\nHill Park\nOld Library\nWest Market\nFerry Pier",
        "1. North Gate\n2. River Walk\n3. Stone Bridge\n4. Hill Park (East Bank)\n5. Old Library\n6. Ferry Pier",
        "a) North Gate;\nb) River Walk;\nc) Stone Bridge;\nd) Hill Park;\ne) Old Library;",
        "- 北门\n- 河边步道\n- 石桥（东岸）\n- 牛肉面\n- 山顶公园\n- 旧图书馆",
        "北门\n河边步道\n石桥（东岸）\n牛肉面\n山顶公园\n旧图书馆\n西市\n渡船码头",
        "（1）北门；\n（2）河边步道；\n（3）石桥；\n（4）牛肉面；\n（5）山顶公园；",
    ),
    "table": (
        "Place,District,Hours,Ref\nNorth Gate,East Bank,3,A104\nRiver Walk,Hill Side,12,C220\nStone Bridge,Old Quay,7,B318\nHill Park,West End,41,D077",
        "| Place | District | Hours |\n|---|---|---:|\n| North Gate | East Bank | 3 |\n| River Walk | Hill Side | 12 |\n| Stone Bridge | Old Quay | 7 |",
        "Place\tDistrict\tHours\nNorth Gate\tEast Bank\t3\nRiver Walk\tHill Side\t12\nStone Bridge\tOld Quay\t7",
        "Place             District        Hours\nNorth Gate        East Bank       3\nRiver Walk        Hill Side       12\nStone Bridge      Old Quay        7",
        "Place;District;Hours;Ref\nNorth Gate;East Bank;3;A104\nRiver Walk;Hill Side;12;C220\nStone Bridge;Old Quay;7;B318",
        "地点,区域,时长,代号\n北门,东岸,3,A104\n河边步道,山坡,12,C220\n石桥,旧码头,7,B318\n山顶公园,西郊,41,D077",
        "| 地点 | 区域 | 时长 |\n|---|---|---:|\n| 北门 | 东岸 | 3 |\n| 河边步道 | 山坡 | 12 |\n| 石桥 | 旧码头 | 7 |",
        '"North Gate";"East Bank";"3";"41.20"\n"River Walk";"Hill Side";"12";"7.95"\n"Stone Bridge";"Old Quay";"7";"15.30"\n"Hill Park";"West End";"41";"88.06"',
        '"北门";"东岸";"3";"A104"\n"河边步道";"山坡";"12";"C220"\n"石桥";"旧码头";"7";"B318"\n"山顶公园";"西郊";"41";"D077"',
        "+--------------+--------------+--------+\n|Place         |District      |Hours   |\n+--------------+--------------+--------+\n|North Gate    |East Bank     |3       |\n|River Walk    |Hill Side     |12      |\n+--------------+--------------+--------+",
        "地点\t区域\t时长\n北门\t东岸\t3\n河边步道\t山坡\t12\n石桥\t旧码头\t7",
        "地点          区域        时长\n北门          东岸        3\n河边步道       山坡        12\n石桥          旧码头       7",
    ),
}
#: Alphabets from which junk exemplars are drawn, with the length of a word and the words of a line.
_JUNK_ALPHABETS = (
    ("abcdefghijklmnopqrstuvwxyz", 9, 7), ("abcdefghijklmnopqrstuvwxyz;", 14, 5), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, 1),
    ("~@#$%^&*<>=+|\\/_-!. ", 40, 3), ("0123456789abcdef", 32, 2), ("囧龘犇猋骉麤羴鱻淼焱垚燚朤茻掱孨嚞畾□▯※◇", 60, 1), ("oO0lI1|~`'.rnmce", 4, 12),
)


@lru_cache(maxsize=1)
def _frequent_han() -> frozenset:
    """Characters of the first levels (the frequent ones) of GB 2312 and of Big5."""
    out = set()
    for codec, first, last, trails in (("gb2312", 0xB0, 0xD7, range(0xA1, 0xFF)), ("big5", 0xA4, 0xC6, [*range(0x40, 0x7F), *range(0xA1, 0xFF)])):
        for lead in range(first, last + 1):
            for trail in trails:
                try:
                    out.add(bytes([lead, trail]).decode(codec))
                except UnicodeDecodeError:
                    pass
    return frozenset(out)






# Counting

#: Character classes in the order of their numbers.
CLASSES = ("vowel", "consonant", "capital", "digit", "han", "rare han", "letter", "space", "tab", "line", "stop", "pause", "bar", "quote", "mark", "symbol")
_V, _C, _CAP, _DIGIT, _HAN, _RARE, _LETTER, _SPACE, _TAB, _LINE, _STOP, _PAUSE, _BAR, _QUOTE, _MARK, _SYMBOL = range(16)
_GIVEN = {_LINE: "\n\r", _TAB: "\t", _SPACE: "\u3000", _STOP: ".!?。！？…", _PAUSE: ",，、:：;；", _BAR: "|", _QUOTE: "'\"“”‘’«»「」()（）[]【】", _MARK: "-*+•·▪–—#", _DIGIT: "０１２３４５６７８９"}
#: Edges of the bins of a line's width (Han characters count twice), its share of function words, its separators.
_WIDTHS, _DENSITIES, _SEPARATED = (13, 25, 41, 81, 161), (0.001, 0.08, 0.2), (1, 3)
#: Features of a line and their values: width; ending with the share of function words; separators; mark.
_FEATURES = (len(_WIDTHS) + 1, 2 * (len(_DENSITIES) + 1), len(_SEPARATED) + 1, 2)
#: Edges of the bins of how often a word pair occurs.
_TIMES = (2, 3, 6)
_PLACE = {w: i for i, w in enumerate(dict.fromkeys(w for words in FUNCTION_WORDS.values() for w in words))}
#: The distributions: places and weight of each. Neighbouring classes repeat the classes, so they weigh half, as do repeats.
BLOCKS = {"words": (len(_PLACE) + 2, 1.0), "classes": (16, 1.0), "pairs": (256, 0.5), "lines": (sum(_FEATURES), 1.0), "repeats": (len(_TIMES) + 1, 0.5)}
_ENDS = np.cumsum([n for n, _ in BLOCKS.values()])
_STARTS = _ENDS - np.array([n for n, _ in BLOCKS.values()])
_WEIGHTS = np.array([w for _, w in BLOCKS.values()], dtype=np.float32)
PLACES = int(_ENDS[-1])
#: A word's hash takes this many letters; longer words are no function words.
_LETTERS = 64


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Class and lower case of every character, factors of the letters of a word, and hashes of the function words."""
    classes = np.full(0x110000, _SYMBOL, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x3000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind[0] in "LM":
            base = unicodedata.normalize("NFD", ch)[0].lower()
            classes[code] = _CAP if kind == "Lu" else _V if base in "aeiouyæœ" else _C if "a" <= base <= "z" or base in "ñçß" else _LETTER
        elif kind == "Nd":
            classes[code] = _DIGIT
        elif kind == "Zs":
            classes[code] = _SPACE
        if len(ch.lower()) == 1:
            lower[code] = ord(ch.lower())
    for first, last in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        classes[first:last] = _RARE
    classes[[ord(c) for c in _frequent_han()]] = _HAN
    for number, chars in _GIVEN.items():
        classes[[ord(c) for c in chars]] = number
    factors = np.random.default_rng(11).integers(1, 1 << 62, _LETTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        hashes = np.array([(np.array([ord(c) for c in w], dtype=np.uint64) * factors[: len(w)]).sum() for w in _PLACE], dtype=np.uint64)
    order = np.argsort(hashes)
    return {"classes": classes, "lower": lower, "factors": factors, "hashes": hashes[order], "places": np.arange(len(_PLACE))[order]}


BASIC = ("n_chars", "n_words", "n_lines", "letters", "symbols", "ended", "common")


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x PLACES counts of all distributions, texts x BASIC counts) of texts that hold some character in all."""
    t, n = _tables(), len(texts)
    sizes = np.array([len(x) for x in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(n), sizes)
    kind = t["classes"][code].astype(np.int64)
    same = np.zeros(len(code), dtype=bool)  # the character before is of the same text
    same[1:] = doc[1:] == doc[:-1]

    def per_doc(owner: np.ndarray, place: np.ndarray, width: int, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner * width + place, weights, minlength=n * width).reshape(n, width)

    classes = per_doc(doc, kind, 16)
    pairs = per_doc(doc[1:][same[1:]], (kind[:-1] * 16 + kind[1:])[same[1:]], 256)
    # Words: runs of letters, and single Han characters.
    han = (kind == _HAN) | (kind == _RARE)
    letter = (kind <= _CAP) | (kind == _LETTER)
    inside = np.zeros(len(code), dtype=bool)
    inside[1:] = letter[:-1] & same[1:]
    start = np.flatnonzero((letter & ~inside) | han)
    begun = np.zeros(len(code), dtype=np.int64)
    begun[start] = start
    at = np.minimum(np.arange(len(code)) - np.maximum.accumulate(begun), _LETTERS - 1)
    with np.errstate(over="ignore"):
        value = np.where(letter | han, t["lower"][code].astype(np.uint64) * t["factors"][at], np.uint64(0))
        word = np.add.reduceat(value, start) if len(start) else np.zeros(0, dtype=np.uint64)
    owner = doc[start]
    near = np.minimum(np.searchsorted(t["hashes"], word), len(_PLACE) - 1)
    common = t["hashes"][near] == word
    words = per_doc(owner, np.where(common, t["places"][near], len(_PLACE) + han[start]), BLOCKS["words"][0])
    # How often each pair of successive words occurs in its text.
    follows = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        pair = ((word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) * np.uint64(0xD6E8FEB86659FD93) + owner[1:].astype(np.uint64))[follows]
    _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
    repeats = per_doc(owner[1:][follows], np.digitize(times[which], _TIMES), BLOCKS["repeats"][0])
    # Lines, but for empty ones.
    first = ~same
    first[1:] |= kind[:-1] == _LINE
    line = np.cumsum(first) - 1
    n_lines = int(line[-1]) + 1
    line_doc = doc[np.flatnonzero(first)]
    ink = np.flatnonzero((kind != _SPACE) & (kind != _TAB) & (kind != _LINE))
    width = np.bincount(line[ink], 1.0 + han[ink], minlength=n_lines)
    full = width > 0
    head, tail = np.zeros(n_lines, dtype=np.int64), np.zeros(n_lines, dtype=np.int64)
    tail[line[ink]] = ink
    head[line[ink[::-1]]] = ink[::-1]
    ended = np.isin(kind[tail], (_STOP,)) & full
    marked = np.isin(kind[head], (_MARK, _DIGIT, _QUOTE))
    gaps = np.zeros(len(code), dtype=bool)
    gaps[1:] = (kind[1:] == _SPACE) & (kind[:-1] == _SPACE) & same[1:]
    gaps[1:] &= ~gaps[:-1]
    separators = np.bincount(line, (kind == _BAR) | (kind == _TAB) | np.isin(code, [ord(c) for c in ";,，"]), minlength=n_lines)
    gap = np.bincount(line, gaps, minlength=n_lines)
    n_words = np.bincount(line[start], minlength=n_lines)
    density = np.bincount(line[start], common, minlength=n_lines) / np.maximum(n_words, 1)
    features = (np.digitize(width, _WIDTHS), ended * (len(_DENSITIES) + 1) + np.digitize(density, _DENSITIES), np.digitize(np.maximum(separators, 2 * gap), _SEPARATED), marked.astype(np.int64))
    lines = np.concatenate([per_doc(line_doc[full], f[full], size, width[full]) for f, size in zip(features, _FEATURES)], axis=1)
    basic = np.stack([sizes, np.bincount(owner, minlength=n), np.bincount(line_doc[full], minlength=n), (classes[:, [_V, _C, _CAP, _LETTER, _HAN, _RARE]]).sum(1), classes[:, [_BAR, _QUOTE, _MARK, _SYMBOL]].sum(1), np.bincount(line_doc[ended], minlength=n), np.bincount(owner, common, minlength=n)], axis=1)
    return np.concatenate([words, classes, pairs, lines, repeats], axis=1), basic


#: Characters counted at a time; a longer text is counted in pieces cut at line ends, or where a piece is full.
PIECE = 1_000_000


def _pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE:
        end = text.rfind("\n", at, at + PIECE) + 1
        end = end if end > at else at + PIECE
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all distributions and basic counts of each text, in bounded memory."""
    counts, basic = np.zeros((len(texts), PLACES), dtype=np.float32), np.zeros((len(texts), len(BASIC)))
    owners: list[int] = []
    batch: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if size:
            c, b = _counted(batch)
            np.add.at(counts, owners, c)
            np.add.at(basic, owners, b)
        owners.clear()
        batch.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > PIECE:
                flush()
            if piece:
                owners.append(i)
                batch.append(piece)
                size += len(piece)
    flush()
    return counts, basic


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts as distributions; a block without counts stays empty."""
    out = counts.astype(np.float32)
    for lo, hi in zip(_STARTS, _ENDS):
        out[:, lo:hi] /= np.maximum(out[:, lo:hi].sum(axis=1, keepdims=True), 1e-9)
    return out


# Comparing


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1))


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """rows of p x rows of q x blocks: Jensen-Shannon divergences in bits; 1 where either block is empty.

    With p + q for twice the mean, the divergence is 1 + (sum p log p + sum q log q - sum (p + q) log (p + q)) / 2. Only
    places where p is not 0 need be summed: elsewhere q and p + q cancel.
    """
    row, place = np.nonzero(p)
    values = p[row, place][:, None]
    other = q.T[place]
    terms = _xlog(values) + _xlog(other) - _xlog(values + other)
    out = np.zeros((len(p) * len(BLOCKS), len(q)), dtype=np.float32)
    segment = row * len(BLOCKS) + np.searchsorted(_ENDS, place, side="right")
    if len(segment):
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        out[segment[begin]] = np.add.reduceat(terms, begin, axis=0)
    return np.clip(1 + out / 2, 0, 1).reshape(len(p), len(BLOCKS), len(q)).transpose(0, 2, 1)


@dataclass
class Profiles:
    """Structural profiles: distributions, kind and, for prose, language of each."""

    shares: np.ndarray
    kinds: list[str]
    languages: list[str]

    def add(self, kind: str, rows: np.ndarray) -> None:
        self.shares = np.concatenate([self.shares, rows])
        self.kinds += [kind] * len(rows)
        self.languages += [_language(r) if kind == "prose" else "" for r in rows]


_OWN = {g: [_PLACE[w] for w in dict.fromkeys(words)] for g, words in FUNCTION_WORDS.items()}


def _language(row: np.ndarray) -> str:
    """The language whose function words a distribution has most of."""
    return max(LANGUAGES, key=lambda g: float(row[_OWN[g]].sum()))


def _drawn(alphabet: str, width: int, words: int, rng: np.random.Generator) -> str:
    lines = [" ".join("".join(rng.choice(list(alphabet), width)) for _ in range(words)) for _ in range(6)]
    return "\n".join(lines)


@lru_cache(maxsize=1)
def exemplars() -> dict[str, list[str]]:
    """Texts of each kind: those given, and junk drawn by rule (random strings, machine output, one string over and over)."""
    rng = np.random.default_rng(5)
    junk = [_drawn(*a, rng) for a in _JUNK_ALPHABETS] + [_drawn(a, w, k, rng).replace("\n", "") for a, w, k in _JUNK_ALPHABETS]
    junk += [f"{x} " * 40 for x in ("Moon Gate", "stone tower park", "x")] + [x * 30 for x in ("月门", "石塔公园")] + [f"{x}\n" * 20 for x in ("Moon Gate", "月门公园")]
    junk.append("\n".join(f"2024-03-{d:02}T0{d % 10}:15:22Z {level} task-{d} rev={int(rng.integers(1 << 40)):010x} code={d * 7}" for d, level in zip(range(1, 9), ["INFO", "WARN"] * 4)))
    wrapped = ["\n".join(textwrap.wrap(x, 72)) for x in EXEMPLARS["prose"] if x.isascii() or not _frequent_han() & set(x)]
    return {**{k: list(v) for k, v in EXEMPLARS.items()}, "prose": [*EXEMPLARS["prose"], *wrapped], "junk": junk}


def seed_profiles() -> Profiles:
    """The profiles of the exemplars."""
    out = Profiles(np.zeros((0, PLACES), dtype=np.float32), [], [])
    for kind, texts in exemplars().items():
        out.add(kind, shares(counted(texts)[0]))
    return out


def _clusters(rows: np.ndarray, most: int, rounds: int = 15) -> np.ndarray:
    """Number of the cluster of each row: k-means of square roots (Hellinger distance) from mutually distant rows."""
    x = np.sqrt(rows)
    chosen = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    distance = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < most and distance.max() > 1e-6:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen]
    for _ in range(rounds):
        own = np.stack([((x - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centres)])
    return own


def learned_profiles(rows: np.ndarray, kinds: list[str], clusters: int = 8, neighbours: int = 5) -> Profiles:
    """The exemplars' profiles and those of ``clusters`` clusters of the labelled rows of each kind.

    Some labels are wrong: a row counts only if no other label is more frequent than its own among its ``neighbours``
    nearest rows, exemplars among them.
    """
    out = seed_profiles()
    if not len(rows):
        return out
    every, labels = np.concatenate([rows, out.shares]), np.array([*kinds, *out.kinds])
    x = np.sqrt(every * np.repeat(_WEIGHTS, _ENDS - _STARTS))
    square = (x**2).sum(axis=1)
    apart = square[:, None] + square - 2 * (x @ x.T)
    np.fill_diagonal(apart, np.inf)
    nearest = np.argsort(apart, axis=1, kind="stable")[: len(rows), :neighbours]
    votes = np.stack([(labels[nearest] == k).sum(axis=1) for k in KINDS])
    kept = votes[[KINDS.index(k) for k in kinds], np.arange(len(rows))] == votes.max(axis=0)
    for kind in KINDS:
        own = rows[kept & (labels[: len(rows)] == kind)]
        if len(own):
            cluster = _clusters(own, clusters)
            out.add(kind, np.stack([own[cluster == j].mean(axis=0) for j in np.unique(cluster)]))
    return out


STATISTICS = (
    "doc_id bigint, n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, terminal_line_share double, "
    "common_word_share double, profile_language string, js_words double, js_classes double, prose_distance double, list_distance double, "
    "table_distance double, junk_distance double, text_kind string"
)


def text_statistics(texts: list[str], profiles: Profiles) -> pd.DataFrame:
    """All statistics but the id, one row for each text; a text without any character but white space is junk."""
    counts, basic = counted(texts)
    b = dict(zip(BASIC, basic.T))
    apart = divergences(shares(counts), profiles.shares) if len(texts) else np.zeros((0, len(profiles.kinds), len(BLOCKS)))
    total = apart @ _WEIGHTS
    kinds = np.array(profiles.kinds)
    by_kind = np.stack([total[:, kinds == k].min(axis=1) for k in KINDS], axis=1)
    prose = np.flatnonzero(kinds == "prose")
    nearest = prose[total[:, prose].argmin(axis=1)]
    at = np.arange(len(texts))
    ratio = lambda a, c: a / np.maximum(c, 1)
    kind = np.array(KINDS, dtype=object)[by_kind.argmin(axis=1)]
    kind[b["n_lines"] == 0] = "junk"
    out = pd.DataFrame({"n_chars": b["n_chars"], "n_words": b["n_words"], "n_lines": b["n_lines"]}).astype("int64")
    out = out.assign(mean_word_length=ratio(b["letters"], b["n_words"]), symbol_ratio=ratio(b["symbols"], b["n_chars"]), terminal_line_share=ratio(b["ended"], b["n_lines"]), common_word_share=ratio(b["common"], b["n_words"]))
    out = out.assign(profile_language=[profiles.languages[i] for i in nearest], js_words=apart[at, nearest, 0].astype(float), js_classes=apart[at, nearest, 1].astype(float))
    return out.assign(**{f"{k}_distance": by_kind[:, i].astype(float) for i, k in enumerate(KINDS)}, text_kind=kind)


# Operators


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")


def fit_profiles(documents: DataFrame, labels: DataFrame, max_labelled: int = 1000) -> Profiles:
    """Profiles from at most ``max_labelled`` labelled documents, those with the least hashes of their ids.

    Only their counts (``PLACES`` numbers each) come to the driver. Labels of other kinds than ``KINDS``, nulls and
    labels without a document are ignored; without labels the profiles are those of the exemplars.
    """
    chosen = labels.select(F.col("doc_id").cast("bigint"), "text_kind").where(F.col("doc_id").isNotNull() & F.col("text_kind").isin(*KINDS)).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text_kind").limit(max_labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_kind": pdf["text_kind"], "counts": [c.tobytes() for c in counted([t or "" for t in pdf["text"]])[0]]})

    own = _documents(documents).where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most max_labelled ids
    rows = sorted(own.mapInPandas(run, "doc_id bigint, text_kind string, counts binary").collect())
    return learned_profiles(shares(np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in rows]).reshape(-1, PLACES)), [r["text_kind"] for r in rows])


def document_statistics(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """One row of statistics for each document with an id; a null text counts as empty.

    Extra columns are ignored; repeated rows give repeated rows; an empty table gives an empty result. Texts over
    ``PIECE`` characters are counted whole, in pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                own = text_statistics([t or "" for t in part["text"]], profiles)
                own.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield own

    return spread(_documents(documents)).mapInPandas(run, STATISTICS)
