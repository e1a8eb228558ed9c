"""Text decoded with the wrong character encoding: records that hold some, and their original text.

The words of the clean corpus (in Chinese, and for the non-ASCII letters of other scripts, its characters) are
garbled under every chain "written in one encoding, read in another", which gives a table of forms. A form is kept
as the bytes that the wrong encoding stands for, because where that encoding has two bytes to a character, the
bytes of one original character straddle two wrong ones. Stretches of a record that could have come from a chain
are cut into tokens of such bytes and hash-joined with the table; a stretch whose tokens are verified that way is
garbled, and its tokens are replaced by their originals.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylake.llm.filters import among
from waylake.session import cut, spread

#: Encodings that a text may wrongly have been read in: one byte to a character, or up to two.
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "shift_jis")
DOUBLE = ("gb18030", "big5", "cp932", "cp949", "euc_jp")
#: Encodings that it may have been written in.
WRITTEN = ("utf-8", "gb18030", "big5")
#: How often one wrong reading, of any one-byte encoding, may have been made after another.
DEPTH = 3
#: One-byte encodings that Western words may have been written in and then read in any of ``SINGLE``.
WESTERN = ("cp1252", "mac_roman", "cp437", "cp850")
_NON_LATIN = frozenset(("cp1251", "cp1253", "cp866", "koi8_r", "iso8859_5", "iso8859_7"))

_CJK = "⺀-鿿豈-﫿︰-﹏＀-￯\U00020000-\U0003ffff"
#: Characters that clean Chinese text hardly has: letters, signs and drawings of other scripts.
_FOREIGN = re.compile(f"[^\x00-\x7f{_CJK}–—‘-”…·•​﻿]|[｡-ﾟ]")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#[0-9]{2,5}|#x[0-9A-Fa-f]{2,4});")
_UTF8_UNITS = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{1,2}|[\xf0-\xf4][\x80-\xbf]{1,3}")
_UTF8_FULL = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_UTF8_RUN = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}){2,}")
_QUOTES = frozenset(range(0x85, 0x98))
#: A stretch between ASCII characters, and UTF-8 of Latin letters and punctuation, where the wrong reading may have taken an ASCII letter as second byte.
_SHORT = re.compile("[^\x00-\x7f�]{1,12}")
_UTF8_LATIN = re.compile(rb"(?:(?:[\xc3-\xc9][\x80-\xbf]|\xe1[\xb8-\xbb][\x80-\xbf]|\xe2\x80[\x90-\xa6])[\x40-\x7e]?)+")
_LATIN_UNITS = re.compile(rb"[\x40-\x7e]|[\xc3-\xc9][\x80-\xbf]|[\xe1\xe2][\x80-\xbf]{2}")


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character of the upper half; bytes without a character, and control characters, stand for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    out.pop("\u0085", None)
    return out


#: Share of a stretch that verified tokens without proof must cover, by the encoding it was written in.
COVERED = {"utf-8": 0.6, "gb18030": 0.75, "big5": 0.75}


@lru_cache(maxsize=None)
def _double_units(codec: str) -> frozenset:
    """The two-byte sequences of a double-byte encoding that stand for characters."""
    pairs = (bytes([a, b]) for a in range(0x81, 0xFF) for b in range(0x40, 0xFF))
    return frozenset(p for p in pairs if len(p.decode(codec, "ignore")) == 1)


@lru_cache(maxsize=None)
def _run_of(codec: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _bytes_of(codec))) + "]{2,}")


def _case_breaks(text: str) -> int:
    return sum(1 for a, b in zip(text, text[1:]) if a.islower() and b.isupper() or not b.isalpha())


@lru_cache(maxsize=20_000)
def candidates(line: str) -> list[dict]:
    """Stretches of a line that a chain could have made: start, end, wrong, right, depth and their tokens.

    A token is (unit bytes as Latin-1 text, 2 if it is proof by itself and 1 if not, characters of the line it covers).
    Depth 0 marks a stretch for whose verification its own characters, in ``own``, are counted too (as tokens of proof 0).
    """
    out: list[dict] = []
    if line.isascii():
        return out
    foreign = _FOREIGN.search(line)
    if foreign:
        for wrong in SINGLE:
            table = _bytes_of(wrong)
            for m in _run_of(wrong).finditer(line):
                run = m[0]
                data = bytes(table[c] for c in run)
                # Scripts mixed in one word: letters of another alphabet right beside Latin ones.
                beside = line[m.start() - 1 : m.start()] + line[m.end() : m.end() + 1]
                mixed = beside.isascii() and any(c.isalpha() for c in beside)
                utf8 = _utf8_tokens(data, wrong, m.start(), m.end(), 1, mixed)
                out += utf8
                # What reads as UTF-8 nearly whole is no double-byte text (of three characters, three in a thousand do).
                if len(run) >= 4 and (wrong not in _NON_LATIN or _case_breaks(run) >= 0.3 * len(run)) and not (utf8 and len(run) >= 6 and utf8[0]["depth"] == 1 and sum(n for _, _, n in utf8[0]["units"]) >= 0.9 * len(run)):
                    for right in WRITTEN[1:]:
                        units = [(u.decode("latin-1"), 1, 2) for u in (data[i : i + 2] for i in range(0, len(data) - 1, 2)) if u in _double_units(right)]
                        if len(units) >= 2 and 2 * len(units) >= COVERED[right] * len(run):
                            out.append({"start": m.start(), "end": m.end(), "wrong": wrong, "right": right, "depth": 1, "chars": len(run), "units": units})
        out = _likeliest(out)
    for m in _WORD.finditer(line):
        if not m[0].isascii() and _LEFT.search(m[0]) and (foreign or _LETTER.search(m[0])):
            unit = _DIGITS.sub("0", m[0])
            out.append({"start": m.start(), "end": m.end(), "wrong": "latin_1", "right": "word", "depth": 1, "chars": len(m[0]), "units": [(unit, 1, len(m[0]))]})
    out += _double_byte(line)
    return out


def _likeliest(found: list[dict]) -> list[dict]:
    """One of the stretches that read the same bytes, and none that explains far less of its characters than another.

    Many wrong encodings share most of their characters, and the table does not depend on which one it was.
    """
    for c in found:
        c["share"] = sum(n for _, _, n in c["units"]) / c["chars"]
    utf8 = [c for c in found if c["right"] == "utf-8" and c["depth"] == 1]
    out, seen = [], set()
    for c in found:
        best = 0.0 if c["chars"] < 20 else max((o["share"] for o in utf8 if o["start"] < c["end"] and c["start"] < o["end"]), default=0.0)
        if c["right"] != "utf-8" and c["chars"] >= 20 and any(o["share"] > 0.7 and o["start"] <= c["start"] and o["end"] >= c["end"] for o in utf8) or c["right"] == "utf-8" and c["depth"] == 1 and c["share"] < 0.5 * best and c["chars"] >= 20:
            continue
        key = (c["start"], c["end"], c["right"], c["depth"], tuple(u for u, _, _ in c["units"]))
        if key not in seen:
            seen.add(key)
            out.append(c)
    return out


#: Words between white space or table bars; what a dropped multi-byte character leaves of itself.
_WORD = re.compile(r"[^\s|]{2,}")
#: Letters and signs that a one-byte encoding has in its upper half.
_LEFT = re.compile("[\x80-\u052f\u2010-\u25ff\ufb01\ufb02]")
_LETTER = re.compile("[A-Za-z]")
_DIGITS = re.compile(r"\d+")


def _utf8_tokens(data: bytes, wrong: str, start: int, end: int, depth: int, mixed: bool = False) -> list[dict]:
    units, last, text = [], 0, []
    for u in _UTF8_UNITS.finditer(data):
        unit = u[0]
        full = bool(_UTF8_FULL.fullmatch(unit))
        quoted = len(unit) == 2 and unit[1] in _QUOTES
        proof = full and (wrong not in _NON_LATIN or mixed and len(unit) == 2) and (len(unit) == 2 and not quoted or unit[:2] == b"\xe2\x80" or any(0x80 <= b < 0xA0 and wrong == "cp1252" and bytes([b]) in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d") for b in unit))
        units.append((unit.decode("latin-1"), 2 if proof else 1, len(unit)))
        text.append(unit.decode("utf-8", "ignore") if full else "")
        last = u.end()
    if not units or last == 0:
        return []
    # Without proof a stretch needs two tokens and most of its characters.
    able = any(proof == 2 for _, proof, _ in units) or len(units) >= 2 and sum(n for _, _, n in units) >= COVERED["utf-8"] * len(data)
    out = [{"start": start, "end": end, "wrong": wrong, "right": "utf-8", "depth": depth, "chars": len(data), "units": units}] if able else []
    inner = "".join(text)
    if depth < DEPTH and len(inner) >= 2:
        read: set[bytes] = set()  # many encodings share the bytes of a stretch
        for other in SINGLE:
            table = _bytes_of(other)
            for m in _run_of(other).finditer(inner):
                more = bytes(table[c] for c in m[0])
                if more not in read:
                    read.add(more)
                    out += _utf8_tokens(more, other, start, end, depth + 1)
    return out


def _double_byte(line: str) -> list[dict]:
    out = _latin_double_byte(line) + _han_double_byte(line)
    for wrong in DOUBLE:
        if not _UTF8_RUN.search(line.encode(wrong, "replace")):
            continue
        at = 0
        for run in re.split(r"([\x00-\x7f�]+)", line):
            begin, at = at, at + len(run)
            if not run or run[0] < "\x80" or run[0] == "�":
                continue
            pieces = [c.encode(wrong, "ignore") for c in run]
            data = b"".join(pieces)
            borders = {0}
            n = 0
            for p in pieces:
                n += len(p)
                borders.add(n)
            whole = re.fullmatch(rb"[\x80-\xbf]{0,2}(?:[\xc2-\xdf][\x80-\xbf]|[\xe2-\xef][\x80-\xbf]{2})+(?:[\xe2-\xef][\x80-\xbf]?)?", data)
            for m in [whole] if whole else (x for x in _UTF8_RUN.finditer(data) if x.start() in borders and (len(x[0]) >= 9 or x.end() in borders)):
                units = [(u.decode("latin-1"), 1, len(u)) for u in _UTF8_FULL.findall(m[0])]
                first = next((i for i, b in enumerate(_ends(pieces)) if b > m.start()), 0)
                last = next((i for i, b in enumerate(_ends(pieces)) if b >= m.end()), len(pieces) - 1)
                if not whole and len(m[0]) < 9:
                    # Two characters inside a longer run: rare real ones may have such bytes too, so frequency decides.
                    out.append(_weak(line, begin + first, begin + last + 1, wrong, units))
                elif len(units) >= 2 or units and whole and len(run) >= 2 and line[at : at + 1] == "�":
                    out.append({"start": begin + first, "end": begin + last + 1, "wrong": wrong, "right": "utf-8", "depth": 1, "chars": len(m[0]), "units": units})
    return out


#: The frequent characters (first levels) of the double-byte encodings that Chinese is written in, as bytes.
_LEVEL_ONE = {"gb18030": re.compile(rb"(?:[\xb0-\xd7][\xa1-\xfe])+"), "big5": re.compile(rb"(?:[\xa4-\xc6][\x40-\x7e\xa1-\xfe])+")}
_EASTERN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\ue000-\ufaff]{4,}")


@lru_cache(maxsize=1)
def _frequent() -> frozenset:
    """The characters of the first level of GB 2312."""
    return frozenset(c for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF) for c in bytes([a, b]).decode("gb2312", "ignore"))


def _han_double_byte(line: str) -> list[dict]:
    """Chinese written in one double-byte encoding and read in another: four or more characters, most of them rare.

    Each stands for one original; the stretch counts if all originals are known and far more frequent.
    """
    out: list[dict] = []
    known = _frequent()
    for run in _EASTERN.finditer(line):
        mask = "".join("f" if c in known else "r" for c in run[0])
        if mask.count("r") < 2:
            continue
        for m in re.finditer("r(?:f{0,2}r)+", mask):
            if m.end() - m.start() < 4:
                continue
            text = run[0][m.start() : m.end()]
            for wrong in DOUBLE:
                try:
                    data = text.encode(wrong)
                except UnicodeEncodeError:
                    continue
                if len(data) != 2 * len(text):
                    continue
                for right, frequent in _LEVEL_ONE.items():
                    if right != wrong and frequent.fullmatch(data):
                        units = [(data[i : i + 2].decode("latin-1"), 1, 1) for i in range(0, len(data), 2)]
                        out.append(_weak(line, run.start() + m.start(), run.start() + m.end(), wrong, units, right))
    return out


def _weak(line: str, start: int, end: int, wrong: str, units: list[tuple[str, int, int]], right: str = "utf-8") -> dict:
    """A stretch that counts only if its originals are far more frequent in clean texts than its own characters."""
    return {"start": start, "end": end, "wrong": wrong, "right": right, "depth": 0, "chars": end - start, "units": units, "own": line[start:end]}


def _latin_double_byte(line: str) -> list[dict]:
    """Latin letters and punctuation read as double-byte characters: one or two to a letter, beside ASCII letters."""
    out: list[dict] = []
    for m in _SHORT.finditer(line):
        if m.end() - m.start() == 12 or m[0][0] < "⺀":
            continue
        before, after = line[m.start() - 1 : m.start()] if m.start() else "", line[m.end() : m.end() + 1]
        beside = any(c.isascii() and c.isalpha() for c in before + after)
        for wrong in DOUBLE:
            try:
                data = m[0].encode(wrong)
            except UnicodeEncodeError:
                continue
            if not _UTF8_LATIN.fullmatch(data):
                continue
            units = [(u.decode("latin-1"), 1, len(u)) for u in _LATIN_UNITS.findall(data)]
            original = data.decode("utf-8")
            if not (any(c.isalpha() for c in original) or len(original) > 1 or beside and len(m[0]) > 1):
                continue
            if beside or any(u.isascii() for u, _, _ in units):
                out.append({"start": m.start(), "end": m.end(), "wrong": wrong, "right": "utf-8", "depth": 1, "chars": len(data), "units": units})
            else:
                out.append(_weak(line, m.start(), m.end(), wrong, units))
    return out


def _ends(pieces: list[bytes]) -> list[int]:
    out, n = [], 0
    for p in pieces:
        n += len(p)
        out.append(n)
    return out


def _lines(text: str) -> list[str]:
    """Lines of a text with character references resolved, which may have been written over garbled text."""
    return [html.unescape(x) if "&" in x and _ENTITY.search(x) else x for x in text.split("\n")]


def garbled_forms(word: str) -> set[tuple[str, str, int]]:
    """(written encoding, bytes as Latin-1 text, 1 if whole) of a word: whole, and with one byte of three lost."""
    out = set()
    for right in WRITTEN:
        try:
            data = word.encode(right)
        except UnicodeEncodeError:
            continue
        if len(data) < 2 or right != "utf-8" and len(data) != 2:
            continue
        out.add((right, data.decode("latin-1"), 1))
        if right == "utf-8" and len(data) == 3:
            out |= {(right, data[:2].decode("latin-1"), 0), (right, (data[:1] + data[2:]).decode("latin-1"), 0)}
    return out


@lru_cache(maxsize=None)
def _readings(written: str) -> tuple[dict[int, int], ...]:
    """For each one-byte encoding, what the upper half of ``written`` reads as in it; characters without one are None."""
    own = _bytes_of(written)
    out = []
    for wrong in ("latin_1", *SINGLE):
        if wrong != written:
            table = {}
            for ch, byte in own.items():
                read = bytes([byte]).decode(wrong, "ignore") or None
                if read != ch:
                    table[ord(ch)] = read
            out.append(table)
    return tuple(out)


@lru_cache(maxsize=50_000)
def _western_forms(word: str) -> frozenset:
    """What a Western word reads as if it was written in one one-byte encoding and read in another."""
    out = set()
    if any(c.isascii() and c.isalpha() for c in word) and not any(c > "\u2fff" for c in word):
        for written in WESTERN:
            try:
                word.encode(written)
            except UnicodeEncodeError:
                continue
            out |= {word.translate(t) for t in _readings(written)}
    return frozenset(f for f in out if f != word and not f.isascii() and all(c.isprintable() for c in f))


def garbled_words(text: str) -> dict[str, tuple[str, int]]:
    """Words with a non-ASCII character by what is left of them: their forms under every one-byte chain.

    One (marked 1) is what remains when the wrong reading drops control characters: it may keep one letter of a
    character, which is no token by itself; the word around it is. The others (0) are those of words written in another
    one-byte encoding.
    """
    out = {}
    for m in _WORD.finditer(text):
        word = _DIGITS.sub("0", m[0])
        # A word of Chinese characters alone has its characters as tokens.
        if word.isascii() or word[0] > "\u2fff" and not any(c < "\u2e80" for c in word):
            continue
        for form in _western_forms(word):
            out.setdefault(form, (word, 0))
        if not word.isalpha():
            form = "".join(c for c in word.encode("utf-8", "replace").decode("latin-1") if not "\x7f" < c < "\xa0")
            if form != word and len(form) >= 2:
                out[form] = (word, 1)
    return out


def clean_words(tokens: DataFrame, least: int = 1) -> DataFrame:
    """word, form, left, n: words of the clean corpus in at least ``least`` texts; form is null for single characters."""
    counted = tokens.where(F.col("run").isin(WORD, PHRASE)).groupBy("run", F.col("unit").alias("word"), F.col("written").alias("form"), F.col("depth").alias("left")).agg(F.sum("times").alias("n"))
    return counted.where(F.col("n") >= least).select("word", F.when(F.col("run") == PHRASE, F.col("form")).alias("form"), "left", "n")


def form_table(words: DataFrame) -> DataFrame:
    """written, unit, word, whole, n: every garbled form with its most frequent original, and clean characters as "own"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [("word", form, word, left, n) for word, form, left, n in zip(pdf["word"], pdf["form"], pdf["left"], pdf["n"]) if form is not None]
            rows += [(right, unit, word, whole, n) for word, form, n in zip(pdf["word"], pdf["form"], pdf["n"]) if form is None for right, unit, whole in garbled_forms(word)]
            rows += [("own", word, word, 0, n) for word, form, n in zip(pdf["word"], pdf["form"], pdf["n"]) if form is None]
            yield pd.DataFrame(rows, columns=["written", "unit", "word", "whole", "n"])

    forms = words.mapInPandas(run, "written string, unit string, word string, whole int, n bigint")
    # A form that clean texts hold too is garbled only if its original is far more frequent. Once is too little for
    # that: a garbled text without other candidates counts its own form as clean. But a word of another one-byte
    # encoding, which may be a word itself, must then be more frequent than that.
    own = words.where("form is not null").groupBy(F.lit("word").alias("written"), F.col("word").alias("unit")).agg(F.max("n").alias("own"))
    forms = forms.join(own, ["written", "unit"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    chain = (F.col("written") == "word") & (F.col("whole") == 0)
    forms = forms.where(((F.col("own") < 2) | (F.col("n") > 3 * F.col("own"))) & (~chain | (F.col("n") >= 2) & (F.col("n") > F.col("own")))).drop("own")
    best = forms.groupBy("written", "unit").agg(F.max(F.struct("whole", "n", "word")).alias("b"))
    return best.select("written", "unit", "b.word", "b.whole", "b.n")


#: Rows of ``record_tokens`` by the number of their stretch: tokens from 1 on, and these.
LOST, WORD, PHRASE = -1, -2, -3
TOKENS = "kind string, record_key string, text_hash bigint, run int, wrong string, written string, depth int, chars int, n_units int, unit string, proof int, cover int, times int"


def record_tokens(texts: DataFrame) -> DataFrame:
    """One pass over ``texts`` (kind, record_key, text_hash, text): tokens of all candidate stretches, and clean words.

    A text with lost characters has a row with run ``LOST``. Texts without any candidate are the clean corpus: each
    task gives their non-ASCII characters (run ``WORD``) and their words with some (run ``PHRASE``, the form in
    ``written``), with the number of texts in ``times``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        phrases: Counter = Counter()
        names = [x.split()[0] for x in TOKENS.split(", ")]
        for pdf in batches:
            rows = []
            for kind, key, text_hash, text in zip(pdf["kind"], pdf["record_key"], pdf["text_hash"], pdf["text"]):
                number = 0
                clean = "�" not in text
                for line in _lines(text):
                    for c in candidates(line):
                        number += 1
                        clean = clean and (c["right"] == "word" or c["depth"] == 0)
                        units = [u for u in c["units"] if not u[0].isascii() or c["right"] == "word"] + [(x, 0, 0) for x in c.get("own", "")]
                        n_units = len(units) - len(c.get("own", ""))
                        for (unit, proof, cover), times in Counter(units).items():
                            rows.append((kind, key, text_hash, number, c["wrong"], c["right"], c["depth"], c["chars"], n_units, unit, proof, cover, times))
                if "�" in text:
                    rows.append((kind, key, text_hash, LOST, "", "", 0, 0, 0, "�", 2, 1, text.count("�")))
                if len(rows) > 50_000:  # what a task holds does not grow with its batches
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
                if clean:
                    words.update(c for c in set(text) if c > "\x7f")
                    phrases.update((word, form, left) for form, (word, left) in garbled_words(text).items())
            if len(phrases) > 200_000:
                rows += [("", "", 0, PHRASE, "", form, left, 0, 0, word, 0, 0, n) for (word, form, left), n in phrases.items()]
                phrases.clear()
            yield pd.DataFrame(rows, columns=names)
        rows = [("", "", 0, WORD, "", "", 0, 0, 0, word, 0, 0, n) for word, n in words.items()]
        rows += [("", "", 0, PHRASE, "", form, left, 0, 0, word, 0, 0, n) for (word, form, left), n in phrases.items()]
        yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(run, TOKENS)


def _verified(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Stretches whose tokens are garbled forms of clean words."""
    key = F.when(F.col("proof") == 0, "own").otherwise(F.col("written"))
    joined = tokens.where("run > 0").withColumn("key", key).join(forms.withColumnRenamed("written", "key"), ["key", "unit"])
    stretch = ["kind", "record_key", "text_hash", "run", "wrong", "written", "depth", "chars", "n_units"]
    sums = joined.groupBy(*stretch).agg(
        F.sum(F.when(F.col("proof") == 2, F.col("whole") * F.col("times")).otherwise(0)).alias("proofs"),
        F.sum(F.when(F.col("proof") > 0, F.col("times")).otherwise(0)).alias("hits"), F.sum(F.col("times") * F.col("whole")).alias("wholes"), F.sum(F.col("times") * F.col("cover")).alias("covered"),
        F.sum(F.when(F.col("proof") > 0, F.col("times") * F.col("n")).otherwise(0)).alias("often"), F.sum(F.when(F.col("proof") == 0, F.col("times") * F.col("n")).otherwise(0)).alias("own_often"),
        F.collect_set(F.when(F.col("proof") > 0, F.struct("unit", "word"))).alias("originals"),
    )
    utf8 = F.col("written") == "utf-8"
    single = F.col("wrong").isin(*SINGLE)
    weak = F.col("depth") == 0
    good = (
        (F.col("written") == "word")
        | (weak & (F.col("wholes") == F.col("n_units")) & (F.col("often") * F.col("chars") >= 3 * F.col("own_often") * F.col("n_units")))
        | (utf8 & single & ((F.col("proofs") >= 1) | ((F.col("hits") >= 2) & (F.col("covered") >= COVERED["utf-8"] * F.col("chars")))))
        | (utf8 & ~single & ~weak & (F.col("wholes") >= 0.6 * F.col("n_units")) & (F.col("wholes") >= F.least(F.lit(2), F.col("n_units"))))
        | ((F.col("written").isin(*WRITTEN[1:])) & (F.col("hits") >= 2) & (F.col("covered") >= COVERED["gb18030"] * F.col("chars")))
    )
    return sums.where(good)


def _texts(records: DataFrame) -> DataFrame:
    return spread(records.select(F.col("kind").cast("string"), F.col("record_key").cast("string"), F.col("text").cast("string")).where("record_key is not null and text is not null"), 3).withColumn("text_hash", F.xxhash64("text"))


def garbled_records(records: DataFrame) -> DataFrame:
    """kind, record_key of the records (kind, record_key, text) that hold garbled text anywhere.

    Replacement characters (U+FFFD) are what a wrong decoding leaves of bytes it can't read, so they count. Null
    texts and keys are no cases; repeated rows count once; an empty table gives an empty result.
    """
    texts = _texts(records)
    tokens = cut(record_tokens(texts))
    found = _verified(tokens, form_table(cut(clean_words(tokens)))).select("kind", "record_key")
    return found.unionByName(tokens.where(F.col("run") == LOST).select("kind", "record_key")).distinct()


def restored_records(records: DataFrame) -> DataFrame:
    """kind, record_key, text, restored, chains: each distinct garbled text with verified tokens replaced.

    Bytes that the wrong reading lost stay lost: what remains of their characters is put as U+FFFD, or as the most
    frequent clean word that the remaining bytes fit.
    """
    texts = _texts(records)
    tokens = cut(record_tokens(texts))
    good = _verified(tokens, form_table(cut(clean_words(tokens))))
    by_text = good.groupBy("kind", "record_key", "text_hash").agg(F.collect_set(F.struct("run", "wrong", "written", "depth", "originals")).alias("runs"))
    by_text = cut(by_text)
    few = texts.where(among(F.col("text_hash"), by_text.select("text_hash")))  # only texts that may be garbled are shuffled
    whole = few.dropDuplicates(["kind", "record_key", "text_hash"]).join(by_text, ["kind", "record_key", "text_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, key, text, runs in zip(pdf["kind"], pdf["record_key"], pdf["text"], pdf["runs"]):
                known = {r["run"]: {o["unit"]: o["word"] for o in r["originals"]} for r in runs}
                chains = sorted({f"{r['written']}>{r['wrong']}" + (f"*{r['depth']}" if r["depth"] > 1 else "") for r in runs})
                rows.append((kind, key, text, restore(text, known), ", ".join(chains)))
            yield pd.DataFrame(rows, columns=["kind", "record_key", "text", "restored", "chains"])

    return whole.mapInPandas(run, "kind string, record_key string, text string, restored string, chains string")


def _decoded(unit: str, written: str) -> str | None:
    """The character of a whole byte sequence that no clean text holds."""
    try:
        return unit.encode("latin-1").decode(written) if written in WRITTEN else None
    except UnicodeDecodeError:
        return None


def restore(text: str, known: dict[int, dict[str, str]]) -> str:
    """``text`` with each verified stretch (by its number) rebuilt from the originals of its tokens.

    Of stretches that overlap, the one that explains most tokens, and then the deeper reading, is taken.
    """
    number = 0
    out = []
    for line in _lines(text):
        best: list[tuple] = []
        for c in candidates(line):
            number += 1
            if number in known:
                units = [u if u.isascii() and c["right"] != "word" else known[number].get(u) or _decoded(u, c["right"]) for u, _, _ in c["units"]]
                best.append((c["depth"], sum(1 for u in units if u), -sum(1 for u in units if not u), c["start"], c["end"], "".join(u or "�" for u in units)))
        taken: list[tuple] = []
        for _, _, _, start, end, plain in sorted(best, reverse=True):
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, plain))
        at, parts = 0, []
        for start, end, plain in sorted(taken):
            parts += [line[at:start], plain]
            at = end
        out.append("".join(parts) + line[at:])
    return "\n".join(out)
