"""Template residue, filler, error messages and script notices in pages.

Pages are cut into segments (sentences of lines, without markup). Segments of the corpus that resemble a trusted
residue text, or one already found, are found with partitioned tables over SimHashes of their five-word shingles, and
verified by Hamming distance and by similarity of the shingles. SimHashes of similar short texts may lie far apart, so
keys of an exact prefix filter stand beside those of the tables: no pair of the wanted similarity escapes. Labels
spread along verified links until no new segment is reached, which labels exactly the connected components that hold
a trusted text. Segments with an unfilled placeholder are labelled by that form, and spread nothing: a sentence with
a placeholder resembles the clean one.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylake.llm.filters import among
from waylake.session import cut, spread

# Texts that are residue wherever they stand for content. Digits are compared as 0.
TRUSTED = """
内容待补充
待编辑补全
（此节待完善，稍后更新）
此处为示例文字，请替换为正式内容
这是一段用于排版测试的文字，这是一段用于排版测试的文字
此处插入简介
在此填写景点名
敬请期待
页面建设中
暂无内容
正文内容
用一小段文字介绍片区，写完删除本行
用一小段自然文字介绍城市的旅行特征、空间尺度和最鲜明的体验
路线：景点 A → 景点 B → 休息区域 → 景点 C
旅行关键词：关键词一、关键词二、关键词三
Coming soon: description goes here
Sample text
Replace this paragraph with your own
Text text text text text text text text
insert paragraph about food here
TODO: write this section
Content goes here
Your text here
This is placeholder text
Under construction
Dear [First Name], welcome to [City]!
The average stay is NaN days and the ticket costs null
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore
Quisque velit nisi, pretium ut lacinia in, elementum id enim
Dolor sit amet consectetur, ut enim ad minim veniam quis nostrud
object Object
请开启浏览器的 JavaScript 功能后刷新页面
本页面需要脚本支持，当前浏览器已禁用脚本
您的浏览器不支持 JavaScript
Please enable JavaScript to view this page
Please enable JavaScript to continue
You need to enable JavaScript to run this app
JavaScript is disabled in your browser
This site requires JavaScript
Scripts must be allowed to show the map
This page requires scripts
Your browser has them turned off
Loading… If nothing appears, turn on scripts and cookies
If nothing appears, turn on scripts and cookies
Enable JavaScript and cookies to continue
Veuillez activer JavaScript pour continuer
Habilite JavaScript para ver esta guía
Just a moment… verifying the connection is secure
verifying the connection is secure
Checking your browser before you continue…
Checking if the site connection is secure
Verify you are human by completing the action below
正在验证您是否是真人，请稍候
请检查网址是否正确，或返回首页
错误代码：0
抱歉，您访问的页面找不到了
页面不存在或已被删除
该内容因故无法显示
服务器内部错误
系统繁忙，请稍后再试
网关超时
您的访问过于频繁，请输入验证码
0 Not Found
0 Forbidden
0 Bad Gateway
0 Gateway Time-out
0 Internal Server Error
0 Service Temporarily Unavailable
0 Service Unavailable
0 Too Many Requests
Too many requests
Access Denied
Error 0 – page missing
Page not found
The requested URL was not found on this server
You don't have permission to view this resource
You don't have permission to access this resource
Please try again later or go back to the home page
Request blocked by the security policy
Session expired, please sign in again
This site can’t be reached
upstream connect error, reset reason: timeout
Traceback (most recent call last): KeyError at line 0
An internal error occurred while processing the request
Ray ID: 0
Reference #0
""".strip().split("\n")

# Nouns that a template has where a page has a name.
_NOUNS = "城市名|区域名|景点名|景点 [A-Z]|国家名|一级行政区名|机构名称|所在片区|名称|日期|简介|标题|关键词|此处|在此|待填|待补|待定"
_NAME = rf"(?:[A-Za-z][A-Za-z0-9]*(?:[_. -][A-Za-z0-9]+)*|[^\x00-\x7f]{{0,6}}(?:{_NOUNS})[^\x00-\x7f]{{0,6}})"
# Tags that pages may hold.
_TAGS = "a|abbr|b|blockquote|body|br|center|code|div|em|footer|h[1-6]|head|header|hr|html|i|iframe|img|li|link|main|meta|nav|noscript|ol|p|pre|script|section|small|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|u|ul"
#: Unfilled placeholders: a name between the delimiters of a template language.
PLACEHOLDER = re.compile(
    rf"\{{\{{[\s@%#]*{_NAME}[\s@%#]*\}}\}}|\{{%-?\s*{_NAME}\s*-?%\}}|@@\s*{_NAME}\s*@@|[$#]\{{\s*{_NAME}\s*\}}|(?<!%)%(?:[A-Za-z]{{3,}}(?:[_.][A-Za-z0-9]+)*|[^\x00-\x7f]{{0,6}}(?:{_NOUNS})[^\x00-\x7f]{{0,6}})%(?!%)"
    rf"|<%[=-]?\s*{_NAME}\s*-?%>|__{_NAME}__|(?<![{{$#])\{{(?!.\}}){_NAME}\}}(?!\}})|【\s*(?:[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*|[^】]{{0,4}}(?:{_NOUNS})[^】]{{0,4}})\s*】"
    rf"|<(?!/?(?:{_TAGS})\b)(?:[a-z]+(?:[_.][a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)*|[a-z]+[A-Z][A-Za-z]*|city|area|name|date|season|summary|region|[^\x00-\x7f<>]{{0,4}}(?:{_NOUNS})[^\x00-\x7f<>]{{0,4}})>"
    rf"|(?<![\]\[(!])\[(?:(?:insert|your|add|enter|first|last|city|hotel|area|place|company|attraction|season|admin|guide|user|date|summary|name)(?:[ _.][A-Za-z0-9_. ]{{0,40}})?|[A-Z][A-Z_]{{2,30}}|[^\x00-\x7f\[\]]{{0,6}}(?:{_NOUNS})[^\x00-\x7f\[\]]{{0,6}})\](?![(\]])",
    re.IGNORECASE,
)
#: Marks of a page put out before it was filled.
UNFILLED = re.compile(
    r"\[object Object\]|X[–-]X ?(?:天|小时|days|hours)|\bYYYY[-/.]MM[-/.]DD\b|\]\(https?://(?:www\.)?example\.(?:com|org)|<!--\s*(?:TODO|TBD|FIXME)\b|<!--[^>]{0,200}(?:删除本行|用一小段|先用一段|这里只列|按城市实际)"
    r"|\b(?:is|costs|takes|about|from|to|of) (?:NaN|null|undefined)\b|\b(?:NaN|null|undefined) (?:days|hours|minutes|km|yuan|天|小时)|关键词一、关键词二"
)
_EMPTY_FIELD = re.compile(r"^\s*[-*]\s+\*\*[^*\n]{1,20}(?:[:：]\*\*|\*\*[:：])\s*$")
_EMPTY_ROW = re.compile(r"^\s*\|(?:\s*(?:undefined|null|NaN|None)\s*\|)+\s*$")
_TODO_LINE = re.compile(r"^[\s>*#\-(（\[]*(?:TODO|TBD|FIXME|TBC|TK|待补充?|待定|待完善|略)\s*(?:[:：].*)?[)）\]\s.。…]*$")
_ONE_UNIT = re.compile(r"^(.{1,6}?)(?:\s*\1){3,}$")
_TWO_UNITS = re.compile(r"^(\S{1,3}?)\1{2,}\s+(\S{1,3}?)\2{2,}$")
_XS = re.compile(r"^(?:x{2,}\s*){2,}$|^(?:×{2,}\s*)+$", re.IGNORECASE)
_HTTP = re.compile(r"^(?:http\s+)?(?:error\s+)?0+\s*[-–:]?\s*(?:not found|forbidden|bad gateway|bad request|unauthorized|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|page missing)\b|^error 0+ – page missing|\bray id: ?[0-9a-f]+$|^traceback \(most recent call last\)|^upstream connect error")
# Words of the usual filler text.
_LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum quisque pretium lacinia elementum vestibulum maecenas pellentesque curabitur vivamus praesent mauris".split())

_MARKUP = re.compile(r"<!--|-->|</?(?:" + _TAGS + r")\b[^<>]*>|\*\*|`+")
_BEFORE, _AFTER = " \t\u3000>#*+-|•（([", " \t\u3000|）)]"
_SENTENCE = re.compile(r"(?:[^。！？.!?…|]|[.!?](?=\S))+[。！？.!?…]*")
#: Where a line changes between Chinese and another script at a space.
_BORDER = re.compile(r"(?<=[一-鿿。！？…，]) +(?=[A-Za-z0-9])|(?<=[A-Za-z0-9.]) +(?=[一-鿿])")
#: Any line with a placeholder, an unfilled mark, an empty field or a line to be done has one of these.
_TRIGGER = re.compile(r"[{}@%<\[【_*|]|NaN|null|undefined|YYYY|X[–-]X|example|关键词一|TODO|TBD|FIXME|TBC|TK|待|略")
_TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")
_DIGITS = re.compile(r"\d+")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")

def small_frames(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The frames in pieces, so that what is made of one piece stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a SimHash, and how many may differ for the tables to find a pair for certain.
BITS, HAMMING = 64, 3


def normal_segment(text: str) -> str:
    """A segment as it is compared: without markup and marks at its ends, digits as 0, lower case."""
    return _normal(_plain(text))


def _plain(line: str) -> str:
    """A line without markup."""
    if "&" in line:
        line = html.unescape(line)
    return _MARKUP.sub(" ", line) if "<" in line or "*" in line or "`" in line or "-->" in line else line


def _normal(plain: str) -> str:
    return " ".join(_DIGITS.sub("0", plain.lstrip(_BEFORE).rstrip(_AFTER)).lower().split()).strip(" .。…!！,，;；")


def tokens_of(segment: str) -> list[str]:
    return _TOKEN.findall(segment)


def shingles_of(segment: str) -> frozenset:
    """Five-word shingles; a shorter segment is one shingle. A Chinese character counts as a word."""
    t = tokens_of(segment)
    return frozenset(tuple(t[i : i + SHINGLE]) for i in range(max(1, len(t) - SHINGLE + 1))) if t else frozenset()


@lru_cache(maxsize=20_000)
def _line(line: str) -> tuple[tuple[str, ...], bool]:
    """(normalised segments, whether a placeholder or an unfilled mark stands in it) of one line."""
    marked = False
    if _TRIGGER.search(line):
        marked = bool(PLACEHOLDER.search(line) or UNFILLED.search(line) or _EMPTY_FIELD.match(line) or _EMPTY_ROW.match(line) or _TODO_LINE.match(_plain(line)))
    plain = _plain(line)
    parts = {_normal(plain)}
    sentences = _SENTENCE.findall(plain)
    for sentence in sentences if len(sentences) > 1 or _BORDER.search(plain) else ():
        parts.add(_normal(sentence))
        if _BORDER.search(sentence):
            parts.update(map(_normal, _BORDER.split(sentence)))
    return tuple(p for p in parts if len(p) >= 3), marked


_DIAGRAM = re.compile(r"^\s{0,3}(?:`{3,}|~{3,})\s*(?:mermaid|plantuml|puml|dot|graphviz|flowchart|sequence|ditaa|svgbob)\b", re.IGNORECASE)


def page_segments(markdown: str) -> dict[str, bool]:
    """Normalised segments of a page, and for each whether a placeholder or an unfilled mark stands in its line.

    Diagrams in fenced blocks are no text; one that is never closed ends at the next empty line or heading. Other
    fenced blocks are read like the rest of the page.
    """
    out: dict[str, bool] = {}
    fence = None
    for line in markdown.split("\n"):
        if fence is not None or "`" in line or "~" in line:
            m = _FENCE.match(line)
            if fence is not None:
                if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                    fence = None
                    continue
                if closed or line.strip() and not line.startswith("#"):
                    continue
                fence = None
            elif m:
                if _DIAGRAM.match(line):
                    fence = m[1]
                    closed = re.search(rf"^\s{{0,3}}{re.escape(fence)}", markdown[markdown.index(line) + len(line) :], re.MULTILINE) is not None
                continue
        if not line or line.isspace():
            continue
        own, mark = _line(line)
        for segment in own:
            out[segment] = mark or out.get(segment, False)
        if mark and not own:
            out.setdefault(_plain(line).strip() or line, True)
    return out


@lru_cache(maxsize=1)
def _trusted_by_first_token() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in map(normal_segment, TRUSTED):
        if tokens_of(t):
            out.setdefault(tokens_of(t)[0], []).append(t)
    return out


_SERVER = re.compile(r"^(?:nginx|apache|cloudflare|reference #?0|ray id|错误代码|请求编号|error code)\b")


def _all_trusted(segment: str) -> bool:
    """True for two or more trusted texts, or one and a server's name or number, in one line."""
    m = _TOKEN.search(segment)
    for t in _trusted_by_first_token().get(m[0], []) if m and m.start() < 3 else []:
        if segment.startswith(t + " ") and (rest := segment[len(t) :].strip()):
            if _SERVER.match(rest) or _HTTP.search(rest) or rest in _trusted_by_first_token().get((tokens_of(rest) or [""])[0], []) or _all_trusted(rest):
                return True
    return False


def is_residue(segment: str) -> bool:
    """True for segments whose form alone makes them residue: filler words, one unit over and over, HTTP errors."""
    if _HTTP.search(segment) or _XS.match(segment) or _all_trusted(segment):
        return True
    if len(segment) >= 8 and len(set(segment)) <= 7 and (_ONE_UNIT.match(segment) or _TWO_UNITS.match(segment)) and re.search(r"[^\W\d_]", segment):
        return True
    if not segment.isascii():
        return False
    tokens = segment.split()
    return len(tokens) >= 5 and sum(1 for t in tokens if t.strip(",.;:!?") in _LOREM) >= 0.7 * len(tokens)


def segment_id(segment: str) -> int:
    return int.from_bytes(hashlib.blake2b(segment.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


# Sketches of segments


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """0 for characters between tokens, 1 inside tokens, 2 for single-character tokens; and factors of token hashes."""
    classes = np.array([1 if chr(c).isalnum() else 0 for c in range(0x110000)], dtype=np.uint8)
    classes[0x3400:0xA000] = np.where(classes[0x3400:0xA000], 2, 0)
    classes[0xF900:0xFB00] = np.where(classes[0xF900:0xFB00], 2, 0)
    return classes, np.random.default_rng(3).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_hashes(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the segment, hash) of the shingles of all segments; a segment without tokens is one shingle."""
    classes, factors = _classes()
    sizes = np.array([len(s) for s in segments])
    code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(segments)), sizes)
    kind = classes[code]
    bare = np.bincount(owner, kind > 0, minlength=len(segments)) == 0
    kind = np.where(bare[owner], 2, kind)
    begins = kind == 2
    begins[0] |= kind[0] == 1
    begins[1:] |= (kind[1:] == 1) & ((kind[:-1] != 1) | (owner[1:] != owner[:-1]))
    start = np.flatnonzero(begins)
    first = np.zeros(len(code), dtype=np.int64)
    first[start] = start
    place = np.arange(len(code)) - np.maximum.accumulate(first)
    with np.errstate(over="ignore"):
        # Beyond 256 letters places repeat with another factor.
        value = np.where(kind > 0, (code.astype(np.uint64) + np.uint64(1)) * factors[place % 256] * (place // 256 * 2 + 1).astype(np.uint64), np.uint64(0))
        token = _mixed(np.add.reduceat(value, start))
    of = owner[start]
    n_tokens = np.bincount(of, minlength=len(segments))
    windows = np.maximum(1, n_tokens - SHINGLE + 1)
    begin = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
    number = np.repeat(np.arange(len(segments)), windows)
    at = begin[number] + np.arange(len(number)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    end = begin[number] + n_tokens[number]
    h = np.zeros(len(number), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < end, token[np.minimum(at + k, len(token) - 1)], np.uint64(0))
    return number, _mixed(h)


def table_blocks(n_segments: int) -> tuple[int, int]:
    """Into how many blocks SimHashes are cut and how many make a table's key, for a corpus of so many segments.

    Of two SimHashes that differ in at most ``HAMMING`` bits, ``blocks - HAMMING`` blocks or more are equal, so a table
    for each choice of that many blocks finds the pair. More blocks make longer keys, whose buckets stay small.
    """
    return next(((b, b - HAMMING) for b in (4, 5) if (b - HAMMING) * (BITS // b) + 12 >= max(1, n_segments).bit_length()), (6, 3))


def sketches(segments: list[str], blocks: tuple[int, int] = (4, 1)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """SimHash, number of shingles and keys of each segment: odd keys are those of the tables, even ones of prefixes.

    Two sets of similarity s share at least s of the larger one. So when both are put in one order, the first
    n - ceil(s n) + 1 of either must have one in common: these, of the least hashes, are the prefix. Sets of one to
    three shingles are that similar only if they are equal, so their SimHash alone is a key.
    """
    if not segments:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), []
    number, h = _shingle_hashes(segments)
    order = np.lexsort((h, number))
    number, h = number[order], h[order]
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (h[1:] != h[:-1])])
    number, h = number[new], h[new]
    size = np.bincount(number, minlength=len(segments))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    simhash = np.zeros(len(segments), dtype=np.uint64)
    for bit in range(BITS):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), begin)
        simhash |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    few = size <= 3
    prefix = np.where(few, 0, size - np.ceil(np.round(SIMILARITY * size, 9)).astype(np.int64) + 1)
    rank = np.arange(len(h)) - begin[number]
    taken = rank < prefix[number]
    one = np.uint64(1)
    own, keys = [number[taken], np.flatnonzero(few)], [h[taken] & ~one, _mixed(simhash[few]) | one]
    many = np.flatnonzero(~few)
    width = BITS // blocks[0]
    for table, chosen in enumerate(itertools.combinations(range(blocks[0]), blocks[1])):
        mask = sum(((1 << (BITS - b * width if b == blocks[0] - 1 else width)) - 1) << (b * width) for b in chosen)
        own.append(many)
        keys.append(_mixed((simhash[many] & np.uint64(mask)) ^ np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) | one)
    own, keys = np.concatenate(own), np.concatenate(keys).view(np.int64)
    order = np.argsort(own, kind="stable")
    return simhash.view(np.int64), size.astype(np.int32), np.split(keys[order], np.cumsum(np.bincount(own, minlength=len(segments)))[:-1])


#: Kinds of labels a segment may have by itself: none, of its form (which spreads), of a placeholder in it.
NONE, FORM, PLACED = 0, 1, 2
HELD = "page_key string, seg_id bigint, segment string, label int, simhash bigint, size int, keys array<bigint>"


def _frame(pages: list[str], segments: list[str], labels: list[int], first: list[bool], blocks: tuple[int, int]) -> pd.DataFrame:
    """Rows of ``HELD``; only those marked as the first of their segment have a sketch."""
    at = [i for i, f in enumerate(first) if f]
    simhash, size, keys = sketches([segments[i] for i in at], blocks)
    out = pd.DataFrame({"page_key": pd.Series(pages, dtype=object), "seg_id": pd.Series([segment_id(s) for s in segments], dtype="int64"), "segment": pd.Series(segments, dtype=object), "label": pd.Series(labels, dtype="int32")})
    for name, values, kind in (("simhash", simhash, "Int64"), ("size", size, "Int32"), ("keys", keys, object)):
        out[name] = pd.Series(values, index=at, dtype=kind).reindex(range(len(segments)))
    if not at:
        out["keys"] = pd.Series([None] * len(segments), dtype=object)
    out["keys"] = out["keys"].where(out["keys"].notna(), None)
    return out


def held_segments(pages: DataFrame, blocks: tuple[int, int] = (4, 1)) -> DataFrame:
    """``HELD``: the distinct segments of each page (page_key, markdown).

    A task gives the sketch of a segment (and its text) only where it first meets it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in small_frames(batches):
            keys, segments, labels, first = [], [], [], []
            for page, markdown in zip(pdf["page_key"], pdf["markdown"]):
                for segment, placed in page_segments(markdown).items():
                    h = hash(segment)
                    new = h not in seen
                    if new and len(seen) < 2_000_000:  # beyond, sketches are given again
                        seen.add(h)
                    keys.append(page)
                    segments.append(segment)
                    labels.append(PLACED if placed else FORM if is_residue(segment) else NONE)
                    first.append(new)
            if segments:
                yield _frame(keys, segments, labels, first, blocks)

    return pages.mapInPandas(run, HELD)


_NODE = ["seg_id", "segment", "simhash", "size", "keys"]


def labelled_segments(held: DataFrame, trusted: list[str], blocks: tuple[int, int] = (4, 1)) -> DataFrame:
    """seg_id of all segments in connected components with a trusted text or a segment of residue's form.

    ``held`` is what ``held_segments`` gives. Each round links what the last one reached; rounds end when nothing new
    is reached, however many that takes. Trusted texts are nodes of their own: a segment is labelled by its link to one.
    """
    spark = held.sparkSession
    texts = sorted({normal_segment(t) for t in trusted})
    simhash, size, keys = sketches(texts, blocks)
    seeds = spark.createDataFrame([(segment_id(f"trusted {t}"), t, int(a), int(b), [int(k) for k in c]) for t, a, b, c in zip(texts, simhash, size, keys)], "seg_id bigint, segment string, simhash bigint, size int, keys array<bigint>")
    nodes = held.where("keys is not null and label <> 2").select(*_NODE)
    formed = held.where(F.col("keys").isNotNull() & (F.col("label") == FORM)).select(*_NODE)
    keyed = nodes.select("seg_id", "simhash", "size", F.explode("keys").alias("key"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["segment"], pdf["near"]):
                x, y = shingles_of(a), shingles_of(b)
                keep.append(a == b or bool(x and y) and len(x & y) >= SIMILARITY * len(x | y))
            yield pdf.loc[keep, ["seg_id"]]

    frontier = cut(seeds.unionByName(formed).dropDuplicates(["seg_id"]))
    done = cut(formed.select("seg_id").distinct())
    while not frontier.isEmpty():
        near = frontier.select(F.col("seg_id").alias("near_id"), F.col("simhash").alias("near_simhash"), F.col("size").alias("near_size"), F.explode("keys").alias("key"))
        alike = (F.least("size", "near_size") >= F.lit(SIMILARITY - 1e-9) * F.greatest("size", "near_size")) & ((F.col("key").bitwiseAND(F.lit(1)) == 0) | (F.bit_count(F.col("simhash").bitwiseXOR(F.col("near_simhash"))) <= HAMMING))
        pairs = cut(keyed.where(among(F.col("key"), near.select("key"))).join(near, "key").where(alike).select("seg_id", "near_id").distinct().join(done, "seg_id", "left_anti"))
        # Texts are fetched for candidates only.
        wanted = nodes.where(among(F.col("seg_id"), pairs.select("seg_id"))).dropDuplicates(["seg_id"])
        compared = wanted.select("seg_id", "segment").join(pairs.join(frontier.select(F.col("seg_id").alias("near_id"), F.col("segment").alias("near")), "near_id"), "seg_id")
        reached = compared.mapInPandas(verify, "seg_id bigint").distinct()
        frontier = cut(wanted.join(reached, "seg_id", "left_semi"))
        done = cut(done.unionByName(frontier.select("seg_id")))
    return done


def residue_pages(pages: DataFrame, key: str = "guide_id", trusted: list[str] = TRUSTED) -> DataFrame:
    """The keys of the pages in which residue stands anywhere in place of content.

    Null pages and null keys are no cases; an empty table gives an empty result. Repeated rows count once.
    """
    pages = pages.select(F.col(key).cast("string").alias("page_key"), F.col("markdown").cast("string")).where("page_key is not null and markdown is not null")
    blocks = table_blocks(pages.count() * 100)  # some hundred segments a page
    held = cut(held_segments(spread(pages, 3), blocks))
    labels = labelled_segments(held, trusted, blocks)
    linked = held.where(among(F.col("seg_id"), labels)).join(labels, "seg_id", "left_semi").select("page_key")
    return linked.unionByName(held.where(F.col("label") == PLACED).select("page_key")).distinct().withColumnRenamed("page_key", key)


def without_residue(pages: DataFrame, key: str = "guide_id") -> DataFrame:
    """The rows of ``pages`` but for those of pages with residue; rows without a key or a text are kept.

    Only rows whose key may be among the found ones take part in the join.
    """
    found = cut(residue_pages(pages, key))
    maybe = F.coalesce(among(F.xxhash64(key), found.select(F.xxhash64(key).alias("h"))), F.lit(False))
    return pages.where(~maybe).unionByName(pages.where(maybe).join(found, key, "left_anti"))
