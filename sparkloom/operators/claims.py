"""Claims: elements, broad terms, fields, dependencies, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Broad wording and what is said of it (fixed values). An ASCII word border stands on both sides where a pattern is English.
BROAD = [
    ("any|every|all", "over-broad quantifier"),
    ("substantially|approximately|about|nearly", "functional approximation"),
    ("suitable|appropriate|various|plurality of", "vague modifier"),
    (r"or the like|and so on|etc\.?", "open-ended enumeration"),
    ("means for|configured to|adapted to", "means-plus-function language"),
    ("유사한|관련된|적합한|적절한|다양한|등의?", "광범위 수식어"),
    ("또는 이와 유사한|기타 등등", "개방형 열거"),
    ("수단으로서|하도록 구성된|위한 수단", "기능적 한정"),
]
ENGLISH_BROAD = 5
#: The border after ASCII words; "etc. x" has it before its full stop, not after it.
BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Technical fields in the order in which they are tried (fixed values).
FIELDS = [
    ("반도체|집적회로|트랜지스터|메모리|DRAM|NAND", "반도체/전자"),
    ("통신|네트워크|프로토콜|무선|LTE|5G|WiFi", "통신/네트워크"),
    ("소프트웨어|알고리즘|인공지능|머신러닝|AI|ML", "소프트웨어/AI"),
    ("의약|화합물|약물|치료|임상|therapeut", "바이오/의약"),
    ("기계|구동|모터|엔진|기어|베어링", "기계/동력"),
    ("화학|촉매|반응|합성|polymer", "화학/소재"),
    ("디스플레이|LCD|OLED|화면|픽셀", "디스플레이"),
]
NO_FIELD = "기술분야 불명"

#: Marks of list items and connecting words between elements (fixed values).
LIST_MARK = rf"[（(][가-힣a-zA-Z0-9][)）]|[0-9]+\.{T.WS}|[A-Z]\.{T.WS}|[-•·]{T.WS}"
ELEMENT_CUT = rf"(?:\n|{T.WS}*[;；]{T.WS}*)(?={LIST_MARK})"
ELEMENT_ID = rf"^[（(]([가-힣a-zA-Z0-9])[)）]{T.WS}*|^([A-Z0-9])\.{T.WS}+|^[-•·]{T.WS}+"
PLAIN_CUT = rf"(?i)[;；]|,{T.WS}*(?=그리고|및|또는|wherein|and|comprising)"


def letter(place: Column) -> Column:
    return F.char(place + 65)


def elements(text: Column) -> Column:
    """array<struct<id, text, importance, isEssential>> of a claim: listed parts, else parts between semicolons and connecting words."""

    def element(i: Column, name: Column, body: Column, importance: Column, essential: Column) -> Column:
        return F.struct(name.alias("id"), body.alias("text"), importance.cast("int").alias("importance"), essential.alias("isEssential"))

    def listed(p: Column, i: Column) -> Column:
        one, two = F.regexp_extract(p, ELEMENT_ID, 1), F.regexp_extract(p, ELEMENT_ID, 2)
        name = F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")), letter(i))
        return element(i, name, T.trim(F.regexp_replace(p, ELEMENT_ID, "")), F.when(i == 0, 3).when(i <= 2, 2).otherwise(1), i <= 1)

    def plain(p: Column, i: Column) -> Column:
        name = F.when(i < 26, letter(i)).otherwise((i + 1).cast("string"))
        return element(i, name, T.trim(p), F.when(i == 0, 3).otherwise(2), i <= 2)

    def of_parts(clean: Column, parts: Column) -> Column:
        by_list = F.filter(F.transform(parts, listed), lambda e: e["text"] != "")
        by_word = F.transform(F.filter(F.split(clean, PLAIN_CUT, -1), lambda p: F.length(T.trim(p)) > 10), plain)
        whole = F.array(element(F.lit(0), F.lit("A"), clean, F.lit(3), F.lit(True)))
        return T.let(F.when(F.size(parts) > 1, by_list).otherwise(by_word), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    def of_clean(clean: Column) -> Column:
        return T.let(F.filter(F.split(clean, ELEMENT_CUT, -1), lambda p: T.trim(p) != ""), lambda parts: of_parts(clean, parts))

    return T.let(T.trim(text), of_clean)


def broad_terms(text: Column) -> Column:
    """The first match of each kind of broad wording, with what is said of it."""
    out = []
    for k, (words, label) in enumerate(BROAD):
        pattern = f"(?i)(?<![A-Za-z0-9_])(?:{words}){BORDER}" if k < ENGLISH_BROAD else words
        out.append(F.when(text.rlike(pattern), F.concat(F.lit('"'), F.regexp_extract(text, pattern, 0), F.lit(f'" — {label}'))))
    return F.array_compact(F.array(*out))


def technical_field(text: Column) -> Column:
    found = F.lit(NO_FIELD)
    for words, name in reversed(FIELDS):
        found = F.when(text.rlike(f"(?i){words}"), name).otherwise(found)
    return found


def search_queries(parts: Column) -> Column:
    """The important elements together, then each essential one; distinct, five at most."""
    important = F.transform(F.filter(parts, lambda e: e["importance"] >= 2), lambda e: e["text"])
    essential = F.transform(F.filter(parts, lambda e: e["isEssential"]), lambda e: e["text"])
    head = F.when(F.size(important) > 0, F.array(F.array_join(important, " "))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(head, essential)), 1, 5)


_S = f"{T.WS}*"
#: Wordings that make a claim depend on another, with its number; tried in this order (fixed values).
DEPENDS = {
    "enrich": [
        rf"(?i)제{_S}([0-9]+){_S}항(?:{_S}내지{_S}제{_S}[0-9]+{_S}항)?{_S}(?:중{_S}어느{_S}한{_S}항)?{_S}(?:에{_S}있어서|에{_S}따른|의{_S}방법)",
        rf"(?i)청구항{_S}([0-9]+){_S}(?:에{_S}있어서|에{_S}따른)",
        rf"(?i)claim{_S}([0-9]+){_S}(?:,{_S}wherein|of(?![A-Za-z0-9_]))",
    ],
    "manual": [rf"(?i)(?:제{_S}([0-9]+){_S}항|청구항{_S}([0-9]+)){_S}(?:에{_S}있어서|에{_S}따른|내지)"],
    "graph": [rf"(?i)(?:청구항|claim){_S}([0-9]+)(?:에{_S}있어서|,)"],
}


def parent(text: Column, variant: str = "enrich") -> Column:
    """Number of the claim on which a claim depends, null if it is independent."""
    found = []
    for pattern in DEPENDS[variant]:
        number = F.regexp_extract(text, pattern, 1)
        if variant == "manual":
            number = F.coalesce(F.nullif(number, F.lit("")), F.regexp_extract(text, pattern, 2))
        found.append(F.when(text.rlike(pattern), number.cast("int")))
    return F.coalesce(*found)


def numbered_claims(text: Column, variant: str = "manual") -> Column:
    """array<struct<num, text>> of a text with marks "Claim N": at line starts (manual) or anywhere (graph, where a text without marks is claim 1)."""
    if variant == "manual":
        mark = rf"(?i)(?:^|\n){_S}(?:청구항|claim){T.WS}+([0-9]+)(?:[.:]|{T.WS})"
    else:
        mark = rf"(?i)(?:청구항|claim){_S}([0-9]+)(?:[.:）]|{T.WS})"
    numbers = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    cut = F.split(F.regexp_replace(text, mark, "\u0001"), "\u0001", -1)
    bodies = F.transform(F.slice(cut, F.lit(2), F.size(cut)), T.trim)
    rows = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("num"), b.alias("text")))
    if variant == "manual":
        return rows
    return F.when(F.size(numbers) > 0, rows).otherwise(F.array(F.struct(F.lit(1).alias("num"), T.trim(text).alias("text"))))


def edges(claims: DataFrame, num: str = "num", text: str = "text", variant: str = "graph") -> DataFrame:
    """(parent, child) of dependent claims."""
    return claims.select(parent(F.col(text), variant).alias("parent"), F.col(num).alias("child")).filter("parent is not null")


def roots(claims: DataFrame, num: str = "num", parent_col: str = "parent", most: int = 64) -> DataFrame:
    """(num, root): where the chain of parents ends: at a claim without a parent, or at a number that is no claim.

    Chains double in length with each round, so 64 levels take six joins; what is longer, or runs in a circle, has a null root.
    """
    step = claims.select(F.col(num).alias("num"), F.coalesce(parent_col, num).alias("up"))
    jump = step
    level = 1
    while level < most:
        far = jump.select(F.col("num").alias("up"), F.col("up").alias("far"))
        jump = jump.join(far, "up", "left").select("num", F.coalesce("far", "up").alias("up"))
        level *= 2
    ends = step.select(F.col("num").alias("up"), (F.col("up") != F.col("num")).alias("open"))
    return jump.join(ends, "up", "left").select("num", F.when(~F.coalesce("open", F.lit(False)), F.col("up")).alias("root"))


def orphans(claims: DataFrame, num: str = "num", parent_col: str = "parent") -> DataFrame:
    """Dependent claims whose root is no independent claim."""
    free = claims.filter(F.col(parent_col).isNull()).select(F.col(num).alias("root"))
    dependent = claims.filter(F.col(parent_col).isNotNull()).select(F.col(num).alias("num"))
    return dependent.join(roots(claims, num, parent_col), "num").join(free, "root", "left_anti").select("num")
