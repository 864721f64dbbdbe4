"""Place names: regions of a lookup database, answers of a location service, normalised labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitmill.schema import CHINA, SEP, UNKNOWN

# Suffixes that mark a place rather than a provider, and provider words.
PLACE_SUFFIXES = ["省", "市", "自治区", "地区", "盟", "州", "县", "区", "特别行政区"]
PROVIDERS = ["电信", "联通", "移动", "铁通", "广电", "网通", "教育网", "长城宽带", "有线", "鹏博士"]

# Words of data centres and cloud companies.
DATA_CENTRES = [
    "机房", "idc", "data center", "datacenter", "数据中心",
    "腾讯", "腾讯云",
    "阿里", "阿里云",
    "百度", "百度云",
    "华为", "华为云",
    "京东", "京东云",
    "字节", "火山", "火山引擎",
    "金山", "金山云",
    "青云", "ucloud",
    "aws", "azure", "gcp",
]
DATA_CENTRE_LABEL = "机房"

# Provinces by the suffix of their full name.
PROVINCES = {
    "市": ["北京", "天津", "上海", "重庆"],
    "省": ["河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北",
          "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾"],
    "自治区": ["内蒙古", "西藏"],
    "壮族自治区": ["广西"],
    "回族自治区": ["宁夏"],
    "维吾尔自治区": ["新疆"],
    "特别行政区": ["香港", "澳门"],
}
SHORT_NAMES = {"内蒙": "内蒙古"}

# Suffixes removed before a city rule is compared; the first that fits is removed.
RULE_SUFFIXES = ["特别行政区", "自治区", "维吾尔自治区", "回族自治区", "壮族自治区", "省", "市", "地区", "盟", "州", "县",
                 "区"]

# Names outside the mainland.
NON_MAINLAND = ["香港", "澳门", "台湾", "台北", "台中", "台南", "高雄", "新北", "桃园", "基隆", "嘉义", "新竹", "屏东"]

# Names left out of a map.
HIDDEN_NAMES = ["待解析", "解析中", "国外", "未知"]
HIDDEN_LOWER = ["pending", "resolving", "overseas", "unknown"]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def short_name(name: Column | str) -> Column:
    """One administrative suffix removed, unless nothing would be left."""
    # 自治区 comes before the longer names that end in it, so those are never reached.
    return F.regexp_replace(_col(name), "(?<=.)(?:省|市|自治区|特别行政区)$", "")


def is_provider(text: Column | str) -> Column:
    text = F.trim(_col(text))
    return ~text.rlike(f"(?:{_any(PLACE_SUFFIXES)})$") & text.rlike(_any(PROVIDERS))


def is_known(text: Column) -> Column:
    return ~text.isin("", "0", UNKNOWN)


def join_places(*parts: Column) -> Column:
    """Known parts joined by a middle dot; 未知 when there is none."""
    kept = F.array_compact(F.array(*[F.when(is_known(F.trim(p)), F.trim(p)) for p in parts]))
    return F.when(F.size(kept) > 0, F.array_join(kept, SEP)).otherwise(UNKNOWN)


def region_columns(region: str = "region") -> list[tuple[str, Column]]:
    """Columns to add one after the other: parts, then country, province, city of a region text."""
    parts = F.split(F.col(region), r"\|")

    def at(i: int) -> Column:
        return F.coalesce(F.trim(F.try_element_at(parts, F.lit(i + 1))), F.lit(""))

    p1, p2, p3 = F.col("_p1"), F.col("_p2"), F.col("_p3")
    shifted = ~is_provider(F.col("_p4")) & is_provider(p3) & ~is_provider(p2)
    return [
        *[(f"_p{i}", at(i)) for i in range(5)],
        ("_province", F.when(shifted, p1).otherwise(p2)),
        ("_city", F.when(shifted, p2).otherwise(p3)),
    ]


def parse_region(df, region: str = "region"):
    """Adds domestic, global and has_city for ``country|area|province|city|provider`` texts."""
    names = df.columns
    parts = dict(region_columns(region))
    step = df.withColumns({k: parts[k] for k in ("_p0", "_p1", "_p2", "_p3", "_p4")})
    step = step.withColumns({k: parts[k] for k in ("_province", "_city")})
    step = step.withColumns({"_sp": short_name("_province"), "_sc": short_name("_city")})
    step = step.withColumn("_sc", F.when(is_provider("_sc"), "").otherwise(F.col("_sc")))
    country, province, city = F.col("_p0"), F.col("_sp"), F.col("_sc")
    has_province = ~province.isin("", "0")
    has_city = ~city.isin("", "0")
    inside = (F.when(has_province & has_city & (city != province), F.concat(province, F.lit(SEP), city))
              .when(has_province, province).when(has_city, city).otherwise(CHINA))
    nowhere = country.isin("", "0")
    domestic = (F.when(country == CHINA, inside).when(nowhere, UNKNOWN)
                .otherwise(join_places(country, F.col("_province"), F.col("_city"))))
    return step.select(*names, domestic.alias("domestic"), F.when(nowhere, UNKNOWN).otherwise(country).alias("global"),
                       (has_city & (city != UNKNOWN)).alias("has_city"))


def format_answer(country: str, code: str, province: str, city: str) -> list[Column]:
    """domestic and global labels of a location service's answer."""
    land = F.trim(F.col(country))
    nowhere = land.isin("", "0")
    china = (land == CHINA) | (F.lower(land) == "china") | (F.lower(F.trim(F.col(code))) == "cn")
    p, c = short_name(F.trim(F.col(province))), short_name(F.trim(F.col(city)))
    inside = (F.when((p == "") & (c == ""), land).when((p != "") & (p == c), p).otherwise(join_places(p, c)))
    domestic = (F.when(nowhere, UNKNOWN).when(~china, join_places(land, F.col(province), F.col(city)))
                .otherwise(inside))
    return [domestic.alias("domestic"), F.when(nowhere, UNKNOWN).otherwise(land).alias("global")]


def is_china(text: Column | str) -> Column:
    text = F.trim(_col(text))
    return (text == CHINA) | (F.lower(text) == "china")


def _province_pattern() -> tuple[str, str]:
    names = [n for group in PROVINCES.values() for n in group]
    return "|".join(names), "|".join(SHORT_NAMES)


def find_province(text: Column | str) -> Column:
    """Province of the first blank- or mark-separated token that starts with one, else ''."""
    full, short = _province_pattern()
    mark = r"[·/\\\-_|,，;；()（）\[\]{}\s]"
    # A leading 中国 is dropped from a token before it is compared.
    found = F.regexp_extract(_col(text), rf"(?:^|{mark})(?:中国)?({full}|{short})", 1)
    out = found
    for name, province in SHORT_NAMES.items():
        out = F.when(found == name, province).otherwise(out)
    return out


def is_data_centre(text: Column | str) -> Column:
    return F.lower(_col(text)).rlike(_any(list(dict.fromkeys(DATA_CENTRES))))


def strip_providers(text: Column | str) -> Column:
    """Parts between middle dots without provider words, marks at their ends, blanks and repeats."""
    edge = r"[-_/|,，;；()（）\[\]{}]*"
    # The middle dot never stands inside a part, so all parts can be treated in one pass over the text.
    bare = F.regexp_replace(_col(text), _any(PROVIDERS), "")
    parts = F.transform(F.split(bare, SEP), lambda p: F.trim(F.regexp_replace(F.trim(p), f"^{edge}|{edge}$", "")))
    kept = F.array_distinct(F.filter(parts, is_known))
    return F.array_join(kept, SEP)


def normalize_place(df, domestic: str = "domestic", country: str = "global"):
    """Rewrites both labels as they are stored: provider words out, data centres by province or as such."""
    names = df.columns
    trimmed = df.withColumns({domestic: F.trim(domestic), country: F.trim(country)})
    step = trimmed.withColumn("_clean", strip_providers(domestic))
    step = step.withColumns({
        "_prov": F.when(find_province(domestic) != "", find_province(domestic)).otherwise(find_province("_clean")),
        "_dc": is_data_centre(domestic) | is_data_centre("_clean"),
    })
    new = (F.when((F.col(domestic) == "") | ~is_china(country), F.col(domestic))
           .when(F.col("_dc") & (F.col("_prov") != ""), F.col("_prov")).when(F.col("_dc"), DATA_CENTRE_LABEL)
           .when(F.col("_clean") == "", CHINA).otherwise(F.col("_clean")))
    return step.withColumn(domestic, new).select(*names)


def rule_text(text: str) -> str:
    """A city rule as it is compared."""
    clean = text.strip()
    if clean in ("", UNKNOWN):
        return ""
    clean = re.sub(r"[· -]", "", clean).lower()
    return next((clean.removesuffix(s) for s in RULE_SUFFIXES if clean.endswith(s)), clean)


def comparable(place: Column | str) -> Column:
    """A stored location as it is compared with city rules."""
    text = F.trim(_col(place))
    clean = F.lower(F.regexp_replace(text, "[· -]", ""))
    # The leftmost end is the longest suffix; longer names that end in 自治区 lose that part only.
    out = F.regexp_replace(clean, "(?:特别行政区|自治区|省|市|地区|盟|州|县|区)$", "")
    return F.when(text.isin("", UNKNOWN), "").otherwise(out)


def is_non_mainland(domestic: Column | str, country: Column | str) -> Column:
    place, land = F.trim(_col(domestic)), F.trim(_col(country))
    abroad = ~(is_china(land) | (F.lower(land) == "cn"))
    outside = ~place.isin("", UNKNOWN) & place.rlike(_any(NON_MAINLAND))
    return F.when(land.isin("", UNKNOWN), False).otherwise(abroad | outside)


def province_label(name: Column | str) -> Column:
    """Full province names to short ones; other names unchanged."""
    name = F.trim(_col(name))
    out = name
    for suffix, names in PROVINCES.items():
        full = name.rlike(f"^(?:{'|'.join(names)}){suffix}$")
        out = F.when(full, F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out


def is_hidden(name: Column | str) -> Column:
    name = F.trim(_col(name))
    return (name == "") | name.isin(*HIDDEN_NAMES) | F.lower(name).isin(*HIDDEN_LOWER)
