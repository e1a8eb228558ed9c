"""Operators of the subpackage on small fixtures: nulls, empty texts, ties, repeats, clashing columns, brute force."""

import math
import random

import numpy as np
import pytest

from waylake.llm import encodings, leakage, matching, mixing, quality, residue, tokens

PROSE = "The lanes around the old market are steep, so allow extra time if you travel with a pushchair and check the return first."


# Encodings

CLEAN = ["老城的巷子不宽，正午时分反而凉爽。", "城市速览与主要景点", "石关县", "溪长市", "江河湖海山水", "Café Zoë – déjà vu", "1–2 hours", "1–2 小时", "老城的巷子", "城市速览"]


def garble(text, written, wrong):
    return text.encode(written).decode(wrong, "replace")


def records(spark, texts):
    return spark.createDataFrame([("guide", str(i), t, "x") for i, t in enumerate(texts)], "kind string, record_key string, text string, text_hash string").drop("text_hash")


def test_garbled_records_by_chain(spark):
    word = "老城的巷子"
    latin = "".join(chr(b) for b in word.encode("utf-8"))
    bad = [
        latin, "".join(c for c in latin if not "\x7f" < c < "\xa0"), garble(word, "utf-8", "mac_roman"), garble(word, "utf-8", "koi8_r"), garble(word, "utf-8", "cp437"),
        garble(word, "gb18030", "latin-1"), garble(word + "不宽", "utf-8", "gb18030"), garble(word, "utf-8", "cp932"), "".join(chr(b) for b in latin.encode("utf-8")),
        "前半 " + latin, "1â€“2 hours", "1â0 hours".replace("0", "2"), "&eacute;&cedil;" + latin, "Caf�",
    ]
    good = ["Âncora ÷", "“ESTAÇÃO” “SÃO BENTO”", "«Старый город»", "«Παλιά πόλη»", "bánh cuốn phở", "Weinstube Grüß Gott", "Bel Été”", "甪里、堽城、邛崃", "Ñandú", "Ürgüt", "Ёлка", "0 € • tax included™", "", "   "]
    texts = CLEAN * 2 + good * 2 + bad
    got = {int(r["record_key"]) for r in encodings.garbled_records(records(spark, texts + [None])).collect()}
    assert got == set(range(len(CLEAN + good) * 2, len(texts)))


def test_restored_text(spark):
    word = "老城的巷子"
    texts = CLEAN * 2 + [garble(word, "utf-8", "mac_roman"), "前半，" + garble(word, "gb18030", "latin-1") + "。"]
    got = {int(r["record_key"]): r["restored"] for r in encodings.restored_records(records(spark, texts)).collect()}
    assert got == {len(CLEAN) * 2: word, len(CLEAN) * 2 + 1: "前半，" + word + "。"}


def test_short_stretches_read_as_double_byte(spark):
    clean = ["Casa Añeja", "été à Señor", "l’administration", "北京小时", "帽子、茅台、煤矿", "A座与B超"] * 4
    wanted = ["附近有Casa Añeja。", "Café Señor", "l’administration x"]
    bad = [w.replace("附近有", "").replace("。", "").encode("utf-8").decode("gb18030") for w in wanted] + ["约" + garble("小时", "utf-8", "gb18030") + "可到"]
    texts = clean + bad
    got = {int(r["record_key"]): r["restored"] for r in encodings.restored_records(records(spark, texts)).collect()}
    assert got == dict(enumerate(["Casa Añeja", "Café Señor", "l’administration x", "约小时可到"], len(clean)))


CHAINS = {
    "gb18030>big5": ("老城的巷子不宽", "老城的巷子"), "gb18030>cp949": ("老城的巷子不宽", "老城的巷子不宽"), "big5>gb18030": ("城的巷子不寬", "的巷子不寬"),
    "utf-8>cp437>cp1252": ("老城的巷子不宽", None), "utf-8>latin-1>mac_roman": ("老城的巷子不宽", "老城的巷子不宽"), "utf-8>latin-1>latin-1>latin-1": ("老城的巷子不宽", "老城的巷子不宽"),
    "cp1252>cp437": ("Le café était fermé", "Le café était fermé"), "cp1252>mac_roman": ("Le café était fermé", "Le café était fermé"), "cp1252>cp1251": ("Le café était fermé", "Le café était fermé"),
    "cp1252>cp850": ("El señor del balcón", "El señor del balcón"), "mac_roman>cp1252": ("El señor del balcón", "El señor del balcón"),
}


def test_mixed_chains(spark):
    """Chains whose originals occur three times in clean texts; what a wrong reading lost may stay lost."""

    def garbled(text, chain):
        steps = chain.split(">")
        for written, wrong in zip([steps[0], *steps[1:]] if len(steps) == 2 else ["utf-8"] * (len(steps) - 1), steps[1:]):
            text = text.encode(written, "ignore").decode(wrong, "ignore")
        return text

    clean = ["老城的巷子不宽，正午时分反而凉爽", "老城的巷子不寬", "Le café était fermé", "El señor del balcón"] * 3
    texts = clean + [garbled(t, c) for c, (t, _) in CHAINS.items()]
    found = {int(r["record_key"]) for r in encodings.garbled_records(records(spark, texts)).collect()}
    assert found == set(range(len(clean), len(texts)))
    restored = {int(r["record_key"]): r["restored"] for r in encodings.restored_records(records(spark, texts)).collect()}
    for i, (_, want) in enumerate(CHAINS.values(), len(clean)):
        assert want is None or want in restored[i], (list(CHAINS)[i - len(clean)], restored[i])


def test_rare_words_and_characters_restore(spark):
    left = "".join(c for c in "l’administration".encode("utf-8").decode("latin-1") if not "\x7f" < c < "\xa0")
    texts = ["老城的巷子", "l’administration", garble("老城的鬯子", "utf-8", "latin-1"), left]
    got = {int(r["record_key"]): r["restored"] for r in encodings.restored_records(records(spark, texts)).collect()}
    assert got == {2: "老城的鬯子", 3: "l’administration"}


def test_encodings_on_nothing(spark):
    assert encodings.garbled_records(records(spark, [])).count() == 0


# Residue


@pytest.mark.parametrize("text", ["{{ city_name }}", "很多资料把@@区域名@@写成", "${DATE}", "去<admin_area>的路", "[insert paragraph about food here]", "Dear [First Name], welcome", "X–X 天", "<!-- TODO add map -->", "- **预约锚点**：", "| undefined | undefined |", "[机构名称](https://example.com)", "__DATE__", "%CITY%", "【admin_area】", "TBD"])
def test_placeholders_are_marked(text):
    assert any(residue.page_segments("# 城\n\n" + text).values())


@pytest.mark.parametrize("text", ["参见 [[金坡周边|周边路线]] 与 [[新沙]]。", "```mermaid\nA{{车站}} --> B[Old Town]\n```", "“TODO 书店”在西街二楼，周一休息。", "The museum shows a sheet that begins with ‘lorem ipsum’.", "入口 100%open", "[East Market](https://a.cn)", "**重要**：请带伞。", "民宿的 404 房朝北。", "<p>ok</p>"])
def test_pages_that_only_speak_of_residue(text):
    segments = residue.page_segments("# 城\n\n" + text)
    trusted = {residue.normal_segment(t) for t in residue.TRUSTED}
    assert not any(segments.values()) and not any(s in trusted or residue.is_residue(s) for s in segments)


def test_fenced_blocks():
    diagram = "```mermaid\nA{{车站}} --> B\n```\n内容待补充"
    assert residue.page_segments(diagram) == {"内容待补充": False}
    assert residue.page_segments("```\n内容待补充\n```")["内容待补充"] is False and any(residue.page_segments("```\n{{ city }}\n```").values())
    assert "内容待补充" in residue.page_segments("```mermaid\nA --> B\n\n内容待补充")


def test_residue_pages_and_propagation(spark):
    long = "This whole guide page is only a stand in until an editor finds the time to write the real text about the city and all of its many sights"
    near = long.replace("sights", "sight")
    pages = [("a", "## Food\n\n内容待补充。"), ("b", PROSE), ("c", f"ok\n\n{near}."), ("d", None), (None, "TBD"), ("e", ""), ("a", "## Food\n\n内容待补充。"), ("f", "<h1>404 Not Found</h1>\n<p>nginx</p>"), ("g", "简介简介简介简介"), ("h", PROSE + " " + "word " * 1 + "老城" * 3 + PROSE * 2000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "guide_id string, markdown string, seg_id string")
    got = sorted(r[0] for r in residue.residue_pages(df, trusted=[*residue.TRUSTED, long]).collect())
    assert got == ["a", "c", "f", "g"]
    assert residue.residue_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [(4, 1), (5, 2), (6, 3)])
def test_tables_find_every_pair_within_the_hamming_bound(blocks, monkeypatch):
    rng = random.Random(1)
    segments = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randint(9, 60))) for _ in range(300)]
    changed = [" ".join([*s.split()[:-1], "changed"]) for s in segments]
    (a, _, ka), (b, _, kb) = residue.sketches(segments, blocks), residue.sketches(changed, blocks)
    near = [i for i in range(300) if bin((int(a[i]) ^ int(b[i])) & (1 << 64) - 1).count("1") <= residue.HAMMING]
    assert len(near) > 30 and all({k for k in ka[i] if k & 1} & {k for k in kb[i] if k & 1} for i in near)
    assert residue.table_blocks(10**6) == (4, 1) and residue.table_blocks(10**10) in ((5, 2), (6, 3)) and residue.table_blocks(10**13) == (6, 3)


def test_sketches_against_brute_force():
    """Similarities of 0.8 and more, 5 to 120 words: some key is always shared; the tables alone find a part."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    met = tabled = n = 0
    for length in (5, 8, 12, 20, 40, 80, 120):
        for _ in range(60):
            words = [word() for _ in range(length)]
            other = list(words)
            other[rng.choice([0, -1])] = word()
            pair = [" ".join(words), " ".join(rng.choice([words, other, [*words, word()]]))]
            x, y = map(residue.shingles_of, pair)
            if len(x & y) >= 0.8 * len(x | y):
                _, size, (k, m) = residue.sketches(pair)
                shared = set(k) & set(m)
                n, met, tabled = n + 1, met + bool(shared), tabled + any(v & 1 for v in shared)
                assert size.tolist() == [len(x), len(y)]
    assert met == n > 200 and tabled >= 0.5 * n
    assert residue.sketches(["...", "字", "x" * 600])[1].tolist() == [1, 1, 1]


def test_components_of_many_links(spark):
    """A template drifts by one word a page over 60 pages: all are labelled, and none without the trusted text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    chain = []
    for n in range(60):
        words = [*words[1:], f"x{'abcdefghij'[n % 10]}{'abcdefghij'[n // 10]}"]
        chain.append(" ".join(words))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(chain)], "guide_id string, markdown string")
    first, last = residue.shingles_of(chain[0]), residue.shingles_of(chain[-1])
    assert not first & last
    assert residue.residue_pages(df, trusted=[]).count() == 0
    assert residue.residue_pages(df, trusted=[chain[0]]).count() == 60


def test_no_link_between_segments_is_lost(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    trusted, changed = [], []
    for n in range(400):
        # k common shingles of k + 2 * own: the similarity is 0.8 exactly.
        own, common = 1 + n % 3, 8 * (1 + n % 3)
        base = [word() for _ in range(common + 4)]
        trusted.append(" ".join([*base, *(word() for _ in range(own))]))
        changed.append(" ".join([*base, *(word() for _ in range(own))]))
    a, b = residue.shingles_of(trusted[0]), residue.shingles_of(changed[0])
    assert 10 * len(a & b) == 8 * len(a | b)
    other = [" ".join(word() for _ in range(12)) for _ in range(50)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(changed + other)], "guide_id string, markdown string")
    assert {int(r[0]) for r in residue.residue_pages(df, trusted=trusted).collect()} == set(range(len(changed)))


# Entity matching


def test_readings():
    reading = {"长": "chang", "平": "ping", "荣": "rong", "榮": "rong", "茶": "cha"}
    assert ("chang ping", False, False) in matching.readings("云岭省长平县", reading, ["云岭省"])
    assert ("rong cha", False, False) in matching.readings("榮茶市", reading, [])
    assert ("changping", False, False) in matching.readings("Cháng'píng County", reading, [])
    assert ("changping", True, False) in matching.readings("Changping East Station", reading, [])
    assert ("chang ping", True, False) in matching.readings("长平镇", reading, [])
    assert ("chang", False, True) in matching.readings("Chang.", reading, [])
    assert ("qingxiao", False, False) in matching.readings("Ch'ing-hsiao", reading, [])
    assert matching.readings("", reading, []) == []


def test_similarity():
    syllables = frozenset(["chang", "ping", "chun", "lin"])
    same = matching.name_similarity("changping", "chang ping", False, syllables)
    slip = matching.name_similarity("chagnping", "chang ping", False, syllables)
    other = matching.name_similarity("chunping", "chang ping", False, syllables)
    assert same == 1.0 > slip > 0.85 > other
    assert matching.letter_distance("abcd", "abdc") == 1 and matching.letter_distance("", "ab") == 2


def test_matching_end_to_end(spark):
    names = ["长平", "荣茶", "林春", "平林", "茶长", "春荣", "林茶", "长荣", "平春", "荣林", "春平", "茶林"]
    reading = {"长": "chang", "平": "ping", "荣": "rong", "茶": "cha", "林": "lin", "春": "chun"}
    pin = lambda n: "".join(reading[c] for c in n).capitalize()
    centres = [(f"11{i:07}", n + "市", f"{100 + i}.123456", f"{30 + i % 5}.123456") for i, n in enumerate(names)]
    queue, inventory, want = [], [], set()
    for i, n in enumerate(names):
        for form, shift, is_same in ((pin(n), 0.01, True), (n + "市", 0.005, True), (pin(n) + " Park", 0.04, False), (n + "镇", 0.05, False)):
            g = str(1000 + len(queue))
            queue.append((g, form, "PPLA2" if is_same else "PPL", "云岭省", "x"))
            inventory.append((g, form, form, "01", f"{100 + i + shift:.6f}", f"{30 + i % 5 + 0.12345:.6f}"))
            if is_same:
                want.add((f"11{i:07}", g))
    inventory = [(g, n, a, c, lon if float(lon) % 1 < 0.03 else f"{float(lon) + 0.12:.5f}", lat) for g, n, a, c, lon, lat in inventory]
    inventory = [(g, n, a, c, f"{float(lon) + 0.1234:.5f}" if float(lon) % 1 < 0.03 else lon, lat) for g, n, a, c, lon, lat in inventory]
    q = spark.createDataFrame(queue + [(None, "x", "PPL", None, "x"), ("5", None, "PPL", "", "x")], "geonameid string, geonames_name string, feature_code string, official_admin_name string, confidence string")
    i = spark.createDataFrame(inventory, "geonameid string, name string, asciiname string, admin1_code string, longitude string, latitude string")
    c = spark.createDataFrame(centres + [(None, "x", "1.5", "1.5"), ("119999999", None, "", "")], "administrative_code string, name string, longitude string, latitude string")
    x = spark.createDataFrame([("01", "110000", "云岭省", "Yunling")], "geonames_admin1_code string, official_code6 string, official_admin_name string, geonames_name string")
    h = spark.createDataFrame(list(reading.items()), "hanzi string, reading string")
    got = {(r[0], r[1]) for r in matching.match_entries(q, i, c, x, h).where("confidence >= 0.5").select("administrative_code", "geonameid").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) == 0
    assert matching.match_entries(q.limit(0), i, c, x, h).count() == 0
    with pytest.raises(ValueError):
        matching._dictionary(h, 3)


def test_sameness_is_transitive(spark):
    """Twins of a centre share their odds; an entry's chances add up to one at most; no province meets every province."""
    from pyspark.sql import functions as F

    rows = [("a", "c", 1.0, 1.0, 0.2, 1.0, 0.3), ("b", "c", 1.0, 1.0, None, 1.0, None), ("b", "d", 0.3, 1.0, None, 1.0, None), ("e", "c", 1.0, 1.0, 4.0, 1.0, 60.0)]
    v = matching._with_twins(spark.createDataFrame(rows, "entry string, centre string, name double, city double, near double, province double, km double"))
    odds = F.when(F.col("km").isNull(), -1.0).when(F.col("km") < 2, 5.0).otherwise(-4.0)
    p = {(r["entry"], r["centre"]): r["p"] for r in matching._posterior(v, odds).collect()}
    assert p["a", "c"] > 0.8 and p["b", "c"] > 0.7 and p["e", "c"] < 0.1 and p["b", "c"] + p["b", "d"] <= 1
    names = "id string, province string, core string, other boolean, abbreviated boolean, keys array<string>"
    entries = spark.createDataFrame([("x", None, "changping", False, False, ["dchangping"])], names)
    centres = spark.createDataFrame([("c", "11", "chang ping", False, False, ["dchangping"])], names)
    points = spark.createDataFrame([], "id string, lon double, lat double")
    kinds = spark.createDataFrame([("x", 1.0)], "entry string, rank double")
    got = matching.pair_vectors(entries, centres, points, points, kinds).collect()
    assert [(r["entry"], r["centre"], r["name"]) for r in got] == [("x", "c", 1.0)]


# Leakage


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcde一二三 ,.") for _ in range(n))
    items = [text(rng.randint(20, 200)) for _ in range(25)] + ["短"]
    items.append(items[0])
    docs = []
    for i in range(120):
        d = text(rng.randint(0, 400))
        if i % 3 == 0:
            item = rng.choice(items)
            a = rng.randint(0, len(item) // 2)
            d = d[:50] + item[a : a + rng.randint(20, 120)].upper() + d[50:]
        docs.append(d)
    run = 20
    want = set()
    for di, d in enumerate(docs):
        n = leakage.normalised(d)
        for ii, item in enumerate(items):
            m = leakage.normalised(item)
            if any(m[k : k + run] in n for k in range(len(m) - run + 1)):
                want.add((di, ii))
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)] + [(999, None, ""), (None, docs[0], "")], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(list(enumerate(items)) + [(77, None)], "item_id bigint, text string")
    for shard, group in ((10, 300), (1_000_000, 1_000_000)):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, e, min_run=run, shard_chars=shard, group_chars=group).collect()}
        assert got == want and len(want) > 20
    assert leakage.find_leaks(d, e.limit(0)).count() == leakage.find_leaks(d.limit(0), e).count() == 0


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(leakage, "_CHUNK", 64)
    rng = random.Random(9)
    text = "".join(rng.choice("abc城") for _ in range(500))
    pieces = leakage.Pieces(10)
    h = pieces.of(text)
    same = {}
    for i in range(len(text) - 9):
        assert same.setdefault(text[i : i + 10], h[i]) == h[i]
    assert len(set(h)) == len(same) and len(pieces.of("short")) == 0
    index = leakage.PieceIndex(h[::10])
    assert set(index.among(h)) == set(h[::10]) and len(leakage.PieceIndex(h[:0]).among(h)) == 0


def test_texts_that_compose_are_cleaned():
    for text in ("한글 ﾊﾟ é e\u0301 x", "ΟΔΟΣ ΣΑΣ\nx", "한\n글", ""):
        begins, ends = leakage._original_places(text)
        assert len(begins) == len(ends) == len(leakage.normalised(text)) and all(a < b for a, b in zip(begins, ends))


def test_leaked_spans_are_removed(spark):
    secret = "Ｔｈｅ ｓｅｃｒｅｔ passage of an evaluation item, which nobody should ever train on!"
    d = spark.createDataFrame([(1, PROSE + " " + secret + " " + PROSE), (2, secret), (3, PROSE)], "doc_id bigint, text string")
    e = spark.createDataFrame([(5, secret)], "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in leakage.without_leaks(d, leakage.find_leaks(d, e)).collect()}
    assert got[2] is None and set(got) == {1, 2}
    assert "secret" not in got[1].lower() and got[1].startswith(PROSE[:-1]) and got[1].endswith(PROSE[3:])


# Mixing


def test_splitting_tree_is_exact():
    for blocks, shards in (([10, 0, 7], 5), ([1], 4), ([0, 0], 3), ([100, 3], 1)):
        out = mixing.splitting_tree(blocks, shards, 1)
        assert out.sum(axis=0).tolist() == blocks and out.min() >= 0 and out.shape[0] == shards
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 2


def test_shards_of_a_mix_of_ten_trillion_tokens():
    """500 million blocks of 20,000 tokens over two million shards of 5 million: a few subtrees to their shards."""
    blocks, shards = np.array([400_000_000, 90_000_000, 9_999_000, 1_000]), 2_000_000
    top = list(mixing._split([(0, shards, blocks, np.zeros_like(blocks))], 7, math.ceil(shards / mixing.TOP_NODES)))
    assert len(top) <= 2 * mixing.TOP_NODES and sum(own for _, _, own, _ in top).tolist() == blocks.tolist()
    for lo, hi, own, first in top[::300]:
        leaves = list(mixing._split([(lo, hi, own, first)], 7, 1))
        per_shard = np.stack([x for _, _, x, _ in leaves]).sum(axis=1) * 20_000
        assert len(leaves) == hi - lo and per_shard.max() <= 1.1 * 5_000_000 and per_shard.min() >= 0.9 * 5_000_000
        assert leaves[0][3].tolist() == first.tolist() and sum(x for _, _, x, _ in leaves).tolist() == own.tolist()
    huge = mixing._left_half(np.array([2_000_000_000, 1, 7]), 0, 2, 1)
    assert huge.sum() == 1_000_000_004 and (huge <= [2_000_000_000, 1, 7]).all()


def test_running_sums_do_not_depend_on_buckets(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i % 7) for i in range(500)], "k string, i bigint, w bigint")
    order = [F.xxhash64("i"), F.col("i")]
    one, many = ({r["i"]: r["s"] for r in mixing._running(rows, ["k"], order, F.col("w"), "s", F.lit(n)).collect()} for n in (1, 13))
    assert one == many and len(one) == 500 and sorted(one.values())[0] == 0


def test_mixes_meet_their_targets(spark):
    rng = random.Random(3)
    sized = [(i, "big" if i < 900 else "small" if i < 960 else "other", rng.randint(1, 200)) for i in range(1000)]
    s = spark.createDataFrame(sized, "doc_id bigint, source string, n_tokens bigint")
    targets = [("m", "big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "other", 0.2, 5), ("m", "absent", 0.0, 1), ("n", "big", 1.0, 2), ("n", "gone", 0.5, 2), ("z", "gone", 1.0, 1), (None, "big", 1.0, 1)]
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats bigint")
    draws = mixing.draw_mixes(s, t, block_tokens=500, shard_tokens=5000).cache()
    report = {(r["mix_name"], r["source"]): r for r in mixing.mix_report(draws, t).collect()}
    assert set(report) == {(m, s) for m, s, *_ in targets if m}
    for s_, share in (("big", 0.5), ("small", 0.3), ("other", 0.2)):
        assert abs(report["m", s_]["actual_share"] - share) < 0.01
    assert report["n", "big"]["actual_share"] == 1.0 and report["n", "big"]["most_repeats"] == 2 and report["z", "gone"]["n_draws"] == 0
    for (m, s_), r in report.items():
        assert r["most_repeats"] <= r["max_repeats"]
    rows = draws.collect()
    assert len({(r["mix_name"], r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault((r["mix_name"], r["shard"]), []).append(r["position"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_shard.values())
    assert mixing.draw_mixes(s.limit(0), t).count() == mixing.draw_mixes(s, t.limit(0)).count() == 0


def test_token_counts(spark):
    texts = ["", None, "hello world", "城市", "a" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(tokens.token_count(df.text)).collect()]
    assert got[0] == 0 and got[1] is None and got[2] == 2 and got[3] > 1 and 0 < got[4] <= 100_000
    docs = spark.createDataFrame([(1, "a", "x y"), (2, None, "x"), (3, " ", "x"), (4, "a", ""), (5, "a", None)], "doc_id bigint, source string, text string")
    assert [r["doc_id"] for r in mixing.sized_documents(docs).collect()] == [1]


# Quality

KINDS = {
    "prose": [PROSE * 3, "老城的巷子不宽，正午时分反而凉爽，可以慢慢走到河边。冬季河面会结薄冰，游船停航，栈道照常开放。" * 2, PROSE + "\n\n- East Market\n- Tower\n\n" + PROSE],
    "list": ["- East Market\n- Old Town\n- mutton broth\n- West Lane\n- Bell House", "东市\n老城\n荞麦饼\n西街\n花市\n古塔", "a) Bamboo Alley;\nb) East Market;\nc) Old Quay;\nd) City Wall;"],
    "table": ["Sight,Area,Minutes\nTower,Southgate,3\nMuseum,East Market,12\nGrotto,West Lane,7", "| a | b |\n|---|---|\n| 东市 | 3 |\n| 西街 | 5 |\n| 花市 | 9 |", "景点\t区域\t用时\n书院\t东市\t3\n古塔\t西街\t12\n水闸\t花市\t9"],
    "junk": ["Fael Tower " * 40, "~@#$%^&*<>=+|" * 6, "u9kJ7rqhXalm0ycSgVHl6FAwJCDYypg8DTqY3e4iRFCtOODuzN4toWSgRL1Pt5BD\n" * 2 + "LrHgWA9aOKOnjzIgJEbWy3vCdoBNyK0ESAXIagMZyPn7xjTciyM1", "2026-05-17T11:23:55Z WARN worker-4 rev=9683e20947\n2026-05-18T11:23:55Z INFO worker-6 rev=188b674fe9", "", "fylfzgeu jbcbqcmseeurbr khznyauvpp ofmjye svatuyxe rhagbcvtj dhlfujcyypqpypkn"],
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_kinds(kind):
    got = quality.text_statistics(KINDS[kind], quality.seed_profiles())
    assert list(got["text_kind"]) == [kind] * len(KINDS[kind]), got[[c for c in got.columns if c.endswith("_distance")]]


def test_divergences_against_brute_force():
    rng = np.random.default_rng(4)
    p = quality.shares(rng.integers(0, 3, (5, quality.PLACES)) * (rng.random((5, quality.PLACES)) < 0.1))
    q = quality.shares(rng.integers(0, 4, (7, quality.PLACES)).astype(float))
    p[0, : quality.BLOCKS["words"][0]] = 0
    got = quality.divergences(p, q)

    def js(a, b):
        if not a.sum() or not b.sum():
            return 1.0
        m = (a + b) / 2
        kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
        return (kl(a) + kl(b)) / 2

    for k, (lo, hi) in enumerate(zip(quality._STARTS, quality._ENDS)):
        for i in range(5):
            for j in range(7):
                assert abs(got[i, j, k] - js(p[i, lo:hi], q[j, lo:hi])) < 1e-4


def test_counts_against_brute_force():
    texts = ["The tower, and the gate.\nA  b c\n\n", "", "老城的巷子，很窄。", "x" * 70 + " the", "- ok\n\ud800"]
    counts, basic = quality.counted(texts)
    words = counts[:, : quality.BLOCKS["words"][0]]
    assert words[0, quality._PLACE["the"]] == 2 and words[0, quality._PLACE["and"]] == 1 and words[3, quality._PLACE["the"]] == 1
    assert basic[:, 1].tolist() == [8, 0, 7, 2, 1] and basic[:, 2].tolist() == [2, 0, 1, 1, 2] and basic[0, 5] == 1
    long = "The gate is old.\n" * 80_000
    assert np.allclose(quality.counted([long])[1][0, :3], [len(long), 4 * 80_000, 80_000])


def test_divergences_decide_the_kind():
    """Without the divergences of words and classes many documents would get another kind."""
    texts = [t for v in KINDS.values() for t in v if t]
    profiles = quality.seed_profiles()
    apart = quality.divergences(quality.shares(quality.counted(texts)[0]), profiles.shares)
    kinds = np.array(profiles.kinds)
    whole, rest = ((apart[:, :, b] @ quality._WEIGHTS[b]).argmin(axis=1) for b in ([0, 1, 2, 3, 4], [3, 4]))
    assert (kinds[whole] != kinds[rest]).sum() >= 2


def test_wrong_labels_are_outvoted():
    texts = [f"{PROSE} Number {i}." for i in range(30)]
    rows = quality.shares(quality.counted(texts)[0])
    profiles = quality.learned_profiles(rows, ["prose"] * 27 + ["table", "junk", "list"])
    assert set(quality.text_statistics(texts, profiles)["text_kind"]) == {"prose"}


def test_statistics_and_profiles(spark):
    docs = [(i, t) for i, t in enumerate(t for v in KINDS.values() for t in v)] + [(100, None), (None, "x"), (101, PROSE * 30000)]
    labels = [(i, k) for i, k in enumerate(k for k, v in KINDS.items() for _ in v)] + [(0, "junk"), (None, "list"), (55, None)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, text_kind string")
    l = spark.createDataFrame(labels, "doc_id bigint, text_kind string")
    profiles = quality.fit_profiles(d, l)
    assert {"en", "zh", "fr", "es"} <= set(profiles.languages)
    rows = {r["doc_id"]: r for r in quality.document_statistics(d, profiles).collect()}
    assert len(rows) == len(docs) - 1 and rows[100]["n_words"] == 0 and rows[100]["text_kind"] == "junk" and rows[101]["n_chars"] == 30000 * len(PROSE)
    assert rows[0]["profile_language"] == "en" and rows[0]["js_words"] < 0.5 and 0 <= rows[0]["common_word_share"] <= 1
    assert quality.document_statistics(d.limit(0), quality.fit_profiles(d, l.limit(0))).count() == 0
