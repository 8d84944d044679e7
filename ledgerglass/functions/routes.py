"""Route of administration from the official form group, else from keywords in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textnorm import strip

# Form groups, ambiguous forms, and keywords in their order of precedence.
GROUPS = {
    "PO": ["一般錠劑膠囊劑", "緩釋錠劑膠囊劑", "緩釋錠", "腸溶製劑", "口服液劑", "內服液劑", "口服顆粒劑", "一般錠劑膠囊劑/顆粒劑", "口內膏"],
    "INJ": ["注射劑", "預混型注射劑", "三合一營養注射劑", "三合一營養注射劑.", "PENFILL"],
    "TOP": ["外用軟膏劑", "外用液劑", "外用噴霧劑", "外用錠劑", "外用顆粒劑"],
    "TD": ["外用貼片", "局部貼片", "經皮吸收貼片"],
    "OPH": ["眼用液劑", "眼用凝膠劑", "外用點眼液劑", "眼耳鼻用軟膏"],
    "OTIC": ["耳鼻用液劑"],
    "INH": ["口鼻噴霧/吸入劑"],
    "PR": ["栓劑"],
    "PV": ["陰道用錠劑膠囊劑", "陰道用軟膏劑", "陰道栓劑"],
    "DIAL": ["透析用製劑", "透析用液劑", "體腔用灌洗劑"],
}
AMBIGUOUS = ["乳劑", "溶液", "粉劑"]
KEYWORDS = [
    ("OPH", ["點眼", "眼用", "眼藥", "眼膏", "結膜"]),
    ("OTIC", ["點耳", "耳用", "耳滴"]),
    ("NASAL", ["鼻用", "鼻噴", "鼻滴"]),
    ("INH", ["吸入", "噴霧吸入"]),
    ("INJ", ["注射", "凍晶", "預充填", "輸注", "植入"]),
    ("PR", ["栓劑", "肛門", "灌腸"]),
    ("PV", ["陰道"]),
    ("TD", ["貼片", "貼布", "穿皮"]),
    ("DIAL", ["透析", "灌洗"]),
    ("TOP", ["乳膏", "軟膏", "凝膠", "外用", "洗劑", "泡沫", "酊劑", "藥皂", "洗髮", "頭皮", "油膏", "糊劑", "膜劑", "噴液", "口內膏"]),
    ("PO", ["錠", "膠囊", "散劑", "顆粒", "糖漿", "口服", "口頰", "舌下", "懸液", "內服", "内服", "粉劑", "乾粉", "液劑"]),
]


def derive(group_form, dose_form, groups=None, keywords=None, ambiguous=None) -> Column:
    """struct(route, source), source one of group, keyword, ambiguous, unknown."""
    groups, keywords, ambiguous = GROUPS if groups is None else groups, KEYWORDS if keywords is None else keywords, AMBIGUOUS if ambiguous is None else ambiguous
    g = strip(F.coalesce(F.col(group_form) if isinstance(group_form, str) else group_form, F.lit("")))
    d = strip(F.coalesce(F.col(dose_form) if isinstance(dose_form, str) else dose_form, F.lit("")))
    pair = lambda r, s: F.struct(F.lit(r).alias("route"), F.lit(s).alias("source"))
    out = F.lit(None)
    for k, (route, names) in enumerate(groups.items()):
        out = F.when(g.isin(names), pair(route, "group")) if k == 0 else out.when(g.isin(names), pair(route, "group"))
    out = out.when(d.isin(ambiguous), pair("OTHER", "ambiguous"))
    for route, words in keywords:
        out = out.when(F.array_contains(F.array(*(F.contains(d, F.lit(w)) for w in words)), True), pair(route, "keyword"))
    return out.otherwise(pair("OTHER", "unknown"))


def form_group(group_name) -> Column:
    """The second of the comma-separated parts, empty if there is none."""
    x = F.col(group_name) if isinstance(group_name, str) else group_name
    return F.trim(F.coalesce(F.get(F.split(F.coalesce(x, F.lit("")), ","), 1), F.lit("")))
