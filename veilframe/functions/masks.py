"""Masks and LIKE shadows as Column expressions, and the same for single values on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import misconfigured

# What marks the name of an organisation, and what ends the name of a place.
ORGANISATION = (
    "有限责任公司", "股份有限公司", "有限公司", "集团", "公司", "银行", "保险", "证券", "医院", "学校", "大学", "学院", "中心", "研究院", "研究所", "事务所",
    "合作社", "委员会", "工作室", "门诊", "诊所", "俱乐部", "协会", "超市", "酒店", "宾馆", "门店", "工厂", "厂", "店", "企业",
)
PLACE = ("特别行政区", "自治区", "自治州", "自治县", "地区", "盟", "州", "省", "市", "区", "县", "旗", "镇", "乡", "村")

Expr = Callable[[Column], Column]


def stars(n: Column, char: str) -> Column:
    return F.repeat(F.lit(char), F.greatest(n, F.lit(0)).cast("int"))


def head(c: Column, n: Column | int) -> Column:
    return F.substring(c, F.lit(1), F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(0)))


def tail(c: Column, n: int) -> Column:
    """The last n characters; none for n of 0."""
    return F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n)) if n else F.lit("")


def check(first: int, second: int, ordered: bool = False) -> None:
    if first < 0 or second < 0 or ordered and first > second:
        raise misconfigured("INVALID_FIELD_RULE", f"mask of {first}, {second}")


def segments(one: Expr) -> Expr:
    """Applies a mask to every run between the wildcards % and _, which stay."""

    def whole(c: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(c, F.lit("([^%_]+|[%_])"), F.lit(1)), lambda x: F.when(x.isin("%", "_"), x).otherwise(one(x)))
        return F.when(c.isNull(), F.lit(None)).when(F.instr(c, "%") + F.instr(c, "_") > 0, F.array_join(parts, "")).when(c == "", c).otherwise(one(c))

    return whole


def keep_first_last(first: int, last: int, char: str = "*") -> Expr:
    check(first, last)
    return segments(lambda c: F.when(F.length(c) < first + last, c).otherwise(F.concat(head(c, first), stars(F.length(c) - first - last, char), tail(c, last))))


def keep_from_to(x: int, y: int, char: str = "*") -> Expr:
    check(x, y, ordered=True)
    return segments(lambda c: F.concat(stars(F.least(F.lit(x), F.length(c)), char), F.substring(c, F.lit(x + 1), F.lit(y - x + 1)), stars(F.length(c) - y - 1, char)))


def mask_first_last(first: int, last: int, char: str = "*") -> Expr:
    check(first, last)

    def one(c: Column) -> Column:
        front = F.least(F.lit(first), F.length(c))
        middle = F.greatest(F.length(c) - first - last, F.lit(0))
        return F.concat(stars(front, char), F.substring(c, F.lit(first + 1), middle), stars(F.length(c) - front - middle, char))

    return segments(one)


def mask_from_to(x: int, y: int, char: str = "*") -> Expr:
    check(x, y, ordered=True)

    def one(c: Column) -> Column:
        end = F.least(F.lit(y), F.length(c) - 1)
        return F.when(F.length(c) <= x, c).otherwise(F.concat(head(c, x), stars(end - x + 1, char), F.substring(c, end + 2, F.length(c))))

    return segments(one)


def normalized_like(c: Column) -> Column:
    """Trimmed of everything up to U+0020 at both ends, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def _name(c: Column) -> Column:
    n = F.length(c)
    person = F.when(n <= 1, c).when(n == 2, F.concat(head(c, 1), F.lit("*"))).otherwise(F.concat(head(c, 1), stars(n - 2, "*"), tail(c, 1)))
    is_place = lambda end: F.when((n - 2 >= end) & head(c, end).rlike(f"({'|'.join(PLACE)})$"), end).otherwise(0)
    start = F.least(F.greatest(*[is_place(end) for end in range(1, 9)]) + 2, n)
    end = F.greatest(start, n - 2)
    organisation = F.when(start >= end, c).otherwise(F.concat(head(c, start), stars(end - start, "*"), F.substring(c, end + 1, n)))
    return F.when((n >= 5) & c.rlike("|".join(ORGANISATION)), organisation).otherwise(person)


name_mask = segments(_name)

#: By type: characters kept at the front and at the end.
KEPT = {"DEFAULT": (0, 4), "PHONE": (0, 4), "ID_CARD": (3, 3), "BANK_CARD": (6, 4), "NAME": (1, 0), "ALL": (0, 0), "EMAIL": (1, 0)}


def mask_type_of(name: str) -> str:
    """The type that a field's name suggests."""
    name = name.lower()
    for kind, words in (("PHONE", ("phone", "mobile", "tel")), ("ID_CARD", ("idcard", "id_card", "credential", "cert")), ("BANK_CARD", ("bank", "card")), ("EMAIL", ("email", "mail")), ("NAME", ("name",))):
        if any(w in name for w in words):
            return kind
    return "DEFAULT"


def mask_range(c: Column, first: int, last: int, char: str = "*") -> Column:
    """Keeps both ends; a value that they would cover is masked as a whole."""
    return F.when(F.length(c) <= first + last, stars(F.length(c), char)).otherwise(F.concat(head(c, first), stars(F.length(c) - first - last, char), tail(c, last)))


def type_mask(c: Column, kind: str, keep_first: int = -1, keep_last: int = -1, char: str = "*") -> Column:
    """Masks by type; blank values stay."""
    first, last = KEPT[kind]
    if kind == "EMAIL":
        at = F.instr(c, "@")
        masked = F.when(at <= 1, mask_range(c, 1, 0, char)).otherwise(F.concat(mask_range(head(c, at - 1), 1, 0, char), F.substring(c, at, F.length(c))))
    else:
        masked = mask_range(c, keep_first if keep_first >= 0 else first, keep_last if keep_last >= 0 else last, char)
    return F.when(F.trim(c) == "", c).otherwise(masked)


def parse_options(text: str) -> dict[str, str]:
    """``key=value`` options, separated by commas; blanks and repeated keys are refused."""
    out: dict[str, str] = {}
    for part in filter(None, re.split(r"\s*,\s*", text.strip())):
        key, eq, value = part.partition("=")
        key, value = key.strip(), value.strip()
        if not (eq and key and value) or key in out:
            raise misconfigured("INVALID_FIELD_RULE", f"option {part!r}")
        out[key] = value
    return out


# --- the same for single values, as operands of LIKE on the driver


def in_segments(one: Callable[[str], str]) -> Callable[[str], str]:
    return lambda v: re.sub(r"[^%_]+", lambda m: one(m[0]), v)


def value_keep(first: int, last: int, char: str = "*") -> Callable[[str], str]:
    return in_segments(lambda v: v if len(v) <= first + last else v[:first] + char * (len(v) - first - last) + v[len(v) - last :])


def value_normalized(v: str) -> str:
    return v.strip("".join(map(chr, range(33)))).lower()


def _value_name(v: str) -> str:
    if len(v) >= 5 and any(w in v for w in ORGANISATION):
        place = max((end for end in range(1, min(len(v) - 2, 8) + 1) if v[:end].endswith(PLACE)), default=0)
        start = min(place + 2, len(v))
        end = max(start, len(v) - 2)
        return v[:start] + "*" * (end - start) + v[end:]
    return v if len(v) < 2 else v[0] + "*" if len(v) == 2 else v[0] + "*" * (len(v) - 2) + v[-1]


value_name = in_segments(_value_name)
