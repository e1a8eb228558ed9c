"""Matching queue entries with city centres that share no key.

Candidate pairs come from blocks: equal or nearly equal readings of the name in one province (one letter dropped on
either side, or an abbreviation), and places close to a centre. A pair has a vector of similarities; two
regularised Gaussians, of matched and of unmatched pairs, are fitted to all vectors by expectation-maximisation
without labels. Sameness is transitive, which every expectation step enforces in both directions: entries that are the
same as each other (the same name by a centre's, at the same place) are all that centre or none is, so they share their
log odds; and centres are different cities, so an entry that is one of them can be no other: the chances of an entry's
candidates and of "none of them" add up to one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waylake.operators.spatial import haversine_km, located, within_distance
from waylake.session import cut

# What may follow the name of a city or county, and what makes a name that of something else.
_CITY_HAN = "市县區区旗州盟縣"
_CITY_LATIN = ("municipality", "county", "district", "city", "banner", "prefecture", "league", "shi", "xian", "qu", "qi", "zhou", "meng")
_OTHER_HAN = ("经济园", "开发区", "工业园", "港区码头", "火车站", "东站", "西站", "南站", "北站", "车站", "公园", "码头", "机场", "景区", "街道", "镇", "鎮", "乡", "鄉", "村", "庄", "莊", "堡", "屯", "寨", "坝", "站", "港区", "园区")
_OTHER_LATIN = ("development zone", "industrial park", "economic zone", "north station", "south station", "east station", "west station", "railway station", "station", "park", "wharf", "airport", "harbour", "harbor", "zone", "subdistrict", "zhen", "xiang", "cun", "zhuang", "bao", "tun", "zhai", "ba", "town", "township", "village")
_SMALLER_HAN, _SMALLER_LATIN = ("新", "小"), ("xin", "xiao")

_BRACKETS = re.compile(r"[（(]([^()（）]*)[)）]")
_HAN_RUN = re.compile(r"[㐀-鿿豈-﫿]+")
_LETTERS = re.compile(r"[^a-z]+")
SIMILAR_KM = 6.0


def plain_latin(text: str) -> str:
    """Lower case without diacritics; letters, spaces, and hyphens and apostrophes dropped."""
    text = unicodedata.normalize("NFKD", text.lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"[’'`ʼ‘\-]", "", text)


def readings(name: str, reading: dict[str, str], provinces: list[str]) -> list[tuple[str, bool, bool]]:
    """(letters of the name proper, whether it is something else than a city, whether it is abbreviated) of each way to read ``name``."""
    out: list[tuple[str, bool, bool]] = []
    parts = [_BRACKETS.sub(" ", name), *_BRACKETS.findall(name)]
    for part in parts:
        han = "".join(_HAN_RUN.findall(part))
        if han:
            for p in provinces:
                if han.startswith(p) and len(han) > len(p) + 1:
                    han = han[len(p) :]
                    break
            other = False
            for suffix in _OTHER_HAN:
                if han.endswith(suffix) and len(han) > len(suffix) + 1:
                    han, other = han[: -len(suffix)], True
                    break
            cores = {han}
            if len(han) > 2 and han[-1] in _CITY_HAN:
                cores = {han[:-1]}
            elif len(han) == 2 and han[-1] in _CITY_HAN:
                cores.add(han[:-1])
            for core in cores:
                out.append((" ".join(reading.get(c, "*") for c in core), other, False))
                if other and core[:1] in _SMALLER_HAN and len(core) > 2:
                    out.append((" ".join(reading.get(c, "*") for c in core[1:]), True, False))
        else:
            latin = plain_latin(part).strip()
            abbreviated = latin.endswith(".")
            words = [w for w in re.split(r"[^a-z]+", latin) if w]
            if not words:
                continue
            joined = " ".join(words)
            other = False
            for suffix in _OTHER_LATIN:
                if joined.endswith(" " + suffix):
                    joined, other = joined[: -len(suffix) - 1], True
                    break
            else:
                if words[-1] in _CITY_LATIN and len(words) > 1:
                    joined = " ".join(words[:-1])
            letters = joined.replace(" ", "")
            out.append((letters, other, abbreviated))
            if re.search(r"[-'’`ʻ]", part):  # an older romanisation
                old = re.sub(r"(?<=[a-z])[’'`ʻ](?=[iu])", "=", part.lower())
                old = _LETTERS.sub("", re.sub("hs", "x", re.sub(r"ch(?=i[a-z])", "j", old.replace("ch=", "q").replace("=", ""))))
                if old != letters and not other:
                    out.append((old, False, False))
            for suffix in ("shi", "xian", "qu", "qi"):
                if not other and letters.endswith(suffix) and len(letters) > len(suffix) + 4:
                    out.append((letters[: -len(suffix)], False, abbreviated))
            if other and joined.split(" ")[0] in _SMALLER_LATIN and " " in joined:
                out.append((joined.split(" ", 1)[1].replace(" ", ""), True, False))
    return [x for x in dict.fromkeys(out) if x[0]]


def letter_distance(a: str, b: str, most: int = 6) -> int:
    """Edits (neighbouring letters swapped count once) between two readings; ``*`` stands for an unknown syllable."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


@lru_cache(maxsize=200_000)
def _is_reading(letters: str, syllables: frozenset) -> bool:
    """True if letters can be cut into known syllables: then they are another name rather than a slip."""
    ends = {0}
    for i in range(len(letters)):
        if i in ends:
            ends |= {i + n for n in range(1, 7) if letters[i : i + n] in syllables}
    return len(letters) in ends


def name_similarity(a: str, b: str, abbreviated: bool, syllables: frozenset = frozenset()) -> float:
    """1 for equal readings, down to 0; ``b`` is in syllables.

    A Chinese name differs by characters: those without known reading may be slips of the pen. Letters with one
    slip (two swapped count as one) are nearly equal, less so if they make another name. An abbreviation is
    compared with as much of the other name.
    """
    whole = b.replace(" ", "")
    if a == whole or a == b:
        return 1.0
    if " " in a or "*" in a:
        x, y = a.split(" "), b.split(" ")
        if len(x) != len(y):
            return 0.6 * len(set(x) & set(y)) / max(len(x), len(y))
        alike = sum(1.0 if p == q and p != "*" else 0.8 if "*" in (p, q) else 0.0 for p, q in zip(x, y))
        return alike / len(x) if alike >= len(x) - 0.5 else 0.8 * alike / len(x)
    if abbreviated and len(a) >= 3 and whole.startswith(a):
        return 0.92
    edits = letter_distance(a, whole)
    alike = max(0.0, 1.0 - edits / max(len(a), len(whole), 1))
    if edits == 1:
        return 0.8 if _is_reading(a, syllables) else 0.92
    return 0.7 * alike if _is_reading(a, syllables) or edits > 2 else alike


def _something_else(core: str, centre: str) -> bool:
    """True if a reading is the centre's with the word of a smaller place before or after it."""
    core, centre = core.replace(" ", ""), centre.replace(" ", "")
    if core == centre:
        return False
    rest = core[len(centre) :] if core.startswith(centre) else core[: -len(centre)] if core.endswith(centre) else ""
    return rest in ("zhen", "xiang", "cun", "zhuang", "bao", "tun", "zhai", "ba", "xin", "xiao", "zhan") or core.startswith("xiao") and core[4:] == centre


def _keys(core: str, abbreviated: bool, centre: bool) -> list[str]:
    if "*" in core:
        return []
    core = core.replace(" ", "")
    out = [f"d{core}", *(f"d{core[:i]}{core[i + 1:]}" for i in range(len(core)))] if len(core) >= 4 else [f"d{core}"]
    if centre:
        out += [f"p{core[:i]}" for i in range(3, len(core))]
    elif abbreviated and len(core) >= 3:
        out.append(f"p{core}")
    return list(dict.fromkeys(out))


NAMES = "id string, province string, core string, other boolean, abbreviated boolean, keys array<string>"


def named(rows: DataFrame, reading: dict[str, str], provinces: list[str], centre: bool) -> DataFrame:
    """Every way to read each name of ``rows`` (id, province, name), with its block keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, province, name in zip(pdf["id"], pdf["province"], pdf["name"]):
                for core, other, abbreviated in readings(name, reading, provinces):
                    out.append((i, province, core, other, abbreviated, [] if other and not centre else _keys(core, abbreviated, centre)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in NAMES.split(", ")])

    return rows.select("id", "province", "name").where("id is not null and name is not null").distinct().mapInPandas(run, NAMES).distinct()


VECTOR = ("name", "city", "near", "province")


def pair_vectors(entries: DataFrame, centres: DataFrame, entry_points: DataFrame, centre_points: DataFrame, kinds: DataFrame, syllables: frozenset = frozenset()) -> DataFrame:
    """entry, centre, name, city, near (null without coordinates), province: the vector of every candidate pair.

    ``entries`` and ``centres`` are what ``named`` gives, the points are id, lon, lat, ``kinds`` is entry, rank:
    how far the entry's feature code speaks for a city.
    """
    own = entries.select(F.col("id").alias("entry"), "province", F.explode("keys").alias("k"))
    others = centres.select(F.col("id").alias("centre"), "province", F.explode("keys").alias("k"))
    blocked = own.join(others, ["province", "k"]).select("entry", "centre")
    # An entry of no known province may be in any.
    blocked = blocked.unionByName(own.where("province is null").drop("province").join(others.drop("province"), "k").select("entry", "centre"))
    close = within_distance(entry_points, centre_points, SIMILAR_KM).select(F.col("point_id").alias("entry"), F.col("centre_id").alias("centre"))
    pairs = cut(blocked.unionByName(close).distinct())
    e = entries.select(F.col("id").alias("entry"), F.col("core").alias("ecore"), "other", "abbreviated", F.col("province").alias("eprovince"))
    c = centres.select(F.col("id").alias("centre"), F.col("core").alias("ccore"), F.col("province").alias("cprovince"))
    both = pairs.join(e, "entry").join(c, "centre")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            name, city = [], []
            for a, b, other, abbreviated in zip(pdf["ecore"], pdf["ccore"], pdf["other"], pdf["abbreviated"]):
                name.append(name_similarity(a, b, abbreviated, syllables))
                city.append(0.0 if other or _something_else(a, b) else 1.0)
            yield pd.DataFrame({"entry": pdf["entry"], "centre": pdf["centre"], "name": name, "city": city, "province": (pdf["eprovince"] == pdf["cprovince"]).astype("float64")})

    alike = both.mapInPandas(compare, "entry string, centre string, name double, city double, province double")
    best = alike.groupBy("entry", "centre").agg(F.max(F.struct("name", "city")).alias("b"), F.min("city").alias("least_city"), F.max("province").alias("province"))
    # A place that is anywhere called a station, park or town is one, whatever its short names.
    best = best.join(kinds, "entry", "left").select("entry", "centre", F.col("b.name").alias("name"), (F.least(F.col("b.city"), F.col("least_city")) * F.coalesce("rank", F.lit(1.0))).alias("city"), "province")
    ep = entry_points.select(F.col("id").alias("entry"), F.col("lon").alias("elon"), F.col("lat").alias("elat"))
    cp = centre_points.select(F.col("id").alias("centre"), F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    km = pairs.join(ep, "entry").join(cp, "centre").groupBy("entry", "centre").agg(F.min(haversine_km(F.col("elon"), F.col("elat"), F.col("clon"), F.col("clat"))).alias("km"))
    return best.join(km, ["entry", "centre"], "left").select("entry", "centre", "name", "city", F.when(F.col("km").isNotNull(), F.log1p(F.least(F.col("km"), F.lit(400.0)))).alias("near"), "province", "km")


class Mixture:
    """Two Gaussians over the vectors; ``near`` may be missing and is then left out of the density."""

    def __init__(self, share: float, means: np.ndarray, covariances: np.ndarray) -> None:
        self.share, self.means, self.covariances = share, means, covariances

    def log_odds(self) -> Column:
        full, part = self._difference(range(4)), self._difference([0, 1, 3])
        odds = math.log(self.share) - math.log1p(-self.share)
        return F.when(F.col("near").isNull(), part).otherwise(full) + F.lit(odds)

    def _difference(self, dims) -> Column:
        dims = list(dims)

        def density(k: int) -> Column:
            cov = self.covariances[k][np.ix_(dims, dims)]
            inverse = np.linalg.inv(cov)
            out = F.lit(-0.5 * float(np.linalg.slogdet(cov)[1]))
            diffs = [F.col(VECTOR[d]) - float(self.means[k][d]) for d in dims]
            for i in range(len(dims)):
                for j in range(len(dims)):
                    out = out - 0.5 * float(inverse[i, j]) * diffs[i] * diffs[j]
            return out

        return density(1) - density(0)


#: Entries this close to one centre whose names are equally like its name are the same place.
TWIN_KM = 2.0


def _with_twins(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``twin``: the same text for entries that must all be the centre, or none of them; null for others."""
    alike = (F.col("name") >= 0.84) & (F.col("city") > 0.5) & (F.col("km").isNull() | (F.col("km") <= TWIN_KM))
    return vectors.withColumn("twin", F.when(alike, F.concat_ws("|", F.round("name", 3), F.round("city", 3), "province")))


def _posterior(vectors: DataFrame, odds: Column) -> DataFrame:
    """``vectors`` with p: the chance of each pair, where twins share their odds, and those of an entry and of no match
    add up to one."""
    scored = vectors.withColumn("l", F.least(F.greatest(odds, F.lit(-60.0)), F.lit(60.0)))
    shared = scored.where("twin is not null").groupBy("centre", "twin").agg(F.avg("l").alias("shared"))
    scored = scored.join(shared, ["centre", "twin"], "left").withColumn("o", F.exp(F.coalesce("shared", "l")))
    return scored.withColumn("p", F.col("o") / (F.lit(1.0) + F.sum("o").over(Window.partitionBy("entry")))).drop("o", "l", "shared")


#: Added to the variances: similarities of 0 or 1 would else have none.
RIDGE = np.array([0.004, 0.02, 0.04, 0.02])


def _fit(weighted: DataFrame) -> Mixture:
    """The Gaussians of pairs weighted with p and 1 - p, from sums over all pairs; one row comes to the driver."""
    have = F.when(F.col("near").isNotNull(), 1.0).otherwise(0.0)
    x = [F.col("name"), F.col("city"), F.coalesce("near", F.lit(0.0)), F.col("province")]
    sums = [F.count("*").alias("n")]
    for k, w in ((1, F.col("p")), (0, 1.0 - F.col("p"))):
        sums += [F.sum(w).alias(f"w{k}"), F.sum(w * have).alias(f"h{k}")]
        sums += [F.sum(w * x[i]).alias(f"m{k}_{i}") for i in range(4)]
        sums += [F.sum(w * x[i] * x[j]).alias(f"s{k}_{i}_{j}") for i in range(4) for j in range(i, 4)]
        sums += [F.sum(w * have * x[i]).alias(f"t{k}_{i}") for i in range(4)]
    r = weighted.agg(*sums).first()
    means, covariances = np.zeros((2, 4)), np.zeros((2, 4, 4))
    for k in (0, 1):
        w, h = max(r[f"w{k}"] or 0.0, 1e-6), max(r[f"h{k}"] or 0.0, 1e-6)
        for i in range(4):
            means[k, i] = (r[f"m{k}_{i}"] or 0.0) / (h if i == 2 else w)
        for i in range(4):
            for j in range(i, 4):
                # Products with ``near`` are known only where it is.
                if 2 in (i, j):
                    mi = (r[f"t{k}_{i}"] or 0.0) / h
                    mj = (r[f"t{k}_{j}"] or 0.0) / h
                    v = (r[f"s{k}_{i}_{j}"] or 0.0) / h - mi * mj
                else:
                    v = (r[f"s{k}_{i}_{j}"] or 0.0) / w - means[k, i] * means[k, j]
                covariances[k, i, j] = covariances[k, j, i] = v
        covariances[k] = 0.95 * covariances[k] + 0.05 * np.diag(np.diag(covariances[k])) + np.diag(RIDGE)
        low = np.linalg.eigvalsh(covariances[k])[0]
        if low < 1e-4:
            covariances[k] += np.eye(4) * (1e-4 - low)
    n = max(r["n"], 1)
    return Mixture(min(max((r["w1"] or 0.0) / n, 1e-4), 1 - 1e-4), means, covariances)


def _change(a: Mixture, b: Mixture) -> float:
    """The largest change of a share, a mean or a covariance."""
    return max(abs(a.share - b.share), float(np.abs(a.means - b.means).max()), float(np.abs(a.covariances - b.covariances).max()))


def match_posteriors(vectors: DataFrame, tolerance: float = 0.005, most_rounds: int = 200) -> DataFrame:
    """``vectors`` with ``confidence``, the chance that entry and centre are one city.

    Expectation and maximisation alternate until no parameter changes by more than ``tolerance``; a fit that has not
    settled after ``most_rounds`` is an error. The first weights only say that matched pairs are alike: similar names,
    of a city, close by if that is known.
    """
    start = F.when((F.col("name") >= 0.84) & (F.col("city") > 0.5) & (F.col("province") > 0.5) & (F.coalesce("near", F.lit(1.0)) <= math.log1p(5.0)), 0.95).otherwise(0.01)
    vectors = cut(_with_twins(vectors).repartition("entry"))
    model = _fit(vectors.withColumn("p", start))
    for _ in range(most_rounds):
        before, model = model, _fit(_posterior(vectors, model.log_odds()))
        if _change(before, model) <= tolerance:
            return _posterior(vectors, model.log_odds()).withColumnRenamed("p", "confidence")
    raise ValueError(f"the mixture has not settled after {most_rounds} rounds")


def _dictionary(rows: DataFrame, most: int) -> list:
    """All rows of a table that is small by its nature; an error if it is not."""
    out = rows.distinct().limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"a dictionary of more than {most} rows")
    return out


def match_entries(queue: DataFrame, inventory: DataFrame, centres: DataFrame, crosswalk: DataFrame, hanzi: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """administrative_code, geonameid, confidence, name, city, near, province of all candidate pairs.

    ``restored`` (record_key, restored) has the original names of centres whose names are garbled. Entries without
    id or name, and centres without code, give no pair; those without coordinates are compared by name only.
    Repeated rows count once, an empty table gives an empty result. ``hanzi`` and ``crosswalk`` are dictionaries of
    characters and provinces, which bounds their size.
    """
    reading = {r[0]: plain_latin(r[1]) for r in _dictionary(hanzi.select("hanzi", "reading").where("hanzi is not null and reading is not null"), 200_000)}
    known = [r for r in _dictionary(crosswalk.select("geonames_admin1_code", "official_code6", "official_admin_name", "geonames_name"), 10_000) if r[0] and r[1]]
    code_of = {r[0]: r[1][:2] for r in known}
    by_name: dict[str, str] = {}
    for r in known:
        short = re.sub(r"(?:省|自治区|市)$", "", r[2] or "")
        by_name |= {x: r[1][:2] for x in (r[2], short, plain_latin(r[3] or ""), *(f"{plain_latin(r[3] or '')} {s}" for s in ("sheng", "province"))) if x}
    provinces = sorted({r[2] for r in known if r[2]}, key=len, reverse=True)
    codes = F.create_map(*(F.lit(x) for kv in code_of.items() for x in kv)) if code_of else F.create_map().cast("map<string,string>")
    names = F.create_map(*(F.lit(x) for kv in by_name.items() for x in kv)) if by_name else F.create_map().cast("map<string,string>")
    q = queue.select(F.trim("geonameid").alias("id"), F.col("geonames_name").alias("name"), F.coalesce(names[F.trim("official_admin_name")], names[F.lower(F.trim("official_admin_name"))]).alias("said")).where("id <> ''").distinct()
    places = inventory.select(F.trim("geonameid").alias("id"), F.trim("admin1_code").alias("a1"), F.col("name").alias("iname"), F.col("asciiname").alias("aname"), "longitude", "latitude").join(q.select("id").distinct(), "id", "left_semi").distinct()
    places = cut(places)
    home = places.groupBy("id").agg(F.max(codes[F.col("a1")]).alias("home"))
    own = places.select("id", F.explode(F.array("iname", "aname")).alias("name")).where("name <> ''")
    labelled = q.select("id", "name").unionByName(own).distinct()
    said = q.groupBy("id").agg(F.max("said").alias("said"))
    labelled = labelled.join(home, "id", "left").join(said, "id", "left").select("id", "name", F.coalesce("home", "said").alias("province"))
    c = centres.select(F.trim("administrative_code").alias("id"), "name", "longitude", "latitude").where("id <> ''")
    if restored is not None:
        fixed = restored.select(F.col("record_key").alias("id"), F.col("text").alias("name"), "restored").dropDuplicates(["id", "name"])
        c = c.join(fixed, ["id", "name"], "left").withColumn("name", F.coalesce("restored", "name")).drop("restored")
    c = cut(c.distinct())
    entry_names = cut(named(labelled, reading, provinces, False))
    # A centre's name may have additions; its Chinese part is the name.
    centre_names = cut(named(c.select("id", F.substring("id", 1, 2).alias("province"), F.regexp_replace("name", r"[（(][^()（）]*[)）]", "").alias("name")), reading, [], True))
    # Sections, localities and seats of the fourth order are parts of a city, hamlets or towns.
    kinds = queue.groupBy(F.trim("geonameid").alias("entry")).agg(F.max(F.when(F.upper(F.trim("feature_code")).isin("PPLX", "PPLL", "PPLA4"), 0.4).otherwise(1.0)).alias("rank"))
    # Whole degrees (0, 0 among them) place a city no nearer than fifty kilometres: as good as none.
    exact = places.where(~(F.col("longitude").rlike(r"^\s*-?[0-9]+\s*$") & F.col("latitude").rlike(r"^\s*-?[0-9]+\s*$")))
    vectors = pair_vectors(entry_names, centre_names, cut(located(exact, "id")), cut(located(c, "id")), kinds, frozenset(reading.values()))
    out = match_posteriors(vectors)
    return out.select(F.col("centre").alias("administrative_code"), F.col("entry").alias("geonameid"), "confidence", "name", "city", "near", "province", "km")
