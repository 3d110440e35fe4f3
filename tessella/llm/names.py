"""Variant spellings of names typed by people.

Every distinct form of a name is a set of tokens (characters of Han names, bigrams
of the surname of Latin ones). A prefix-filtered set-similarity join, rarest tokens
first, finds similar forms; a soft weighted token similarity verifies them, rare
tokens counting more. Time decides between persons of like names: forms are split
into persons by years and dynasty, and an undated record is linked only where one
person answers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.components import connected_components
from tessella.session import stage

# Family names, titles, roles, dynasties and short forms of given names.
SURNAMES = frozenset(
    "趙錢孫李周吳鄭王馮陳褚衛蔣沈韓楊朱秦尤許何呂施張孔曹嚴華金魏陶姜戚謝鄒喻柏水竇章雲蘇潘葛奚范彭郎魯韋昌馬苗鳳花方俞任袁柳酆鮑史唐費廉岑薛雷賀倪湯滕殷羅畢郝鄔安常樂于時傅皮卞齊康伍余元卜顧孟平黃和穆蕭尹姚邵湛汪祁毛禹狄米貝明臧計伏成戴談宋茅龐熊紀舒屈項祝董梁杜阮藍閔席季麻強賈路婁危江童顏郭梅盛林刁鍾徐邱駱高夏蔡田樊胡凌霍虞萬支柯昝管盧莫經房裘繆干解應宗丁宣賁鄧郁單杭洪包諸左石崔吉鈕龔程嵇邢滑裴陸榮翁荀羊於惠甄曲家封芮羿儲靳汲邴糜松井段富巫烏焦巴弓牧隗山谷車侯宓蓬全郗班仰秋仲伊宮寧仇欒暴甘斜厲戎祖武符劉景詹束龍葉幸司韶郜黎薊薄印宿白懷蒲邰從鄂索咸籍賴卓藺屠蒙池喬陰鬱胥能蒼雙聞莘黨翟譚貢勞逄姬申扶堵冉宰酈雍卻璩桑桂濮牛壽通邊扈燕冀郟浦尚農溫別莊晏柴瞿閻充慕連茹習宦艾魚容向古易慎戈廖庾終暨居衡步都耿滿弘匡國文寇廣祿闕東歐殳沃利蔚越夔隆師鞏厙聶晁勾敖融冷訾辛闞那簡饒空曾毋沙乜養鞠須豐巢關蒯相查后荊紅游竺權逯蓋益桓公岳佟"
)
COMPOUND = ("歐陽", "上官", "司馬", "諸葛", "皇甫", "尉遲", "公孫", "慕容", "長孫", "宇文", "司徒", "司空", "夏侯", "東方", "令狐", "獨孤", "南宮", "端木", "軒轅", "澹臺", "鍾離", "申屠", "太史", "万俟", "聞人", "赫連", "呼延", "拓跋", "耶律", "完顏")
MONK_PREFIXES, MONK_SUFFIXES = ("釋", "沙門", "比丘", "僧", "苾芻", "桑門"), ("法師", "禪師", "和尚", "上人", "大師", "律師", "三藏")
STYLES = ("居士", "主人", "道人", "先生", "山人", "散人", "老人", "逸士", "子虛", "翁", "漁隱", "處士", "真人", "外史", "樵者")
ORGANISATIONS = ("禪寺藏經閣", "宗祠譜局", "藏經閣", "刻經處", "官書局", "印書館", "國子監", "書院", "書局", "譜局", "府學", "縣學", "州學", "經處", "經閣", "書坊", "書社", "精舍", "宗祠", "禪寺", "官署")  # longest first
ORG_PREFIXES = ("敕建", "江南", "大", "欽建", "新建", "重建", "御賜", "國立", "私立")
ROLES = "撰著輯注註校編譯述疏刊修錄纂解書評集"
ERAS = {
    "先秦": "先秦", "秦": "秦", "漢": "漢", "汉": "漢", "兩漢": "漢", "西漢": "漢", "東漢": "漢", "前漢": "漢", "後漢": "漢", "三國": "三國", "魏": "魏", "晉": "晉", "晋": "晉", "兩晉": "晉", "西晉": "晉", "東晉": "晉", "南朝": "南朝", "北朝": "北朝",
    "隋": "隋", "唐": "唐", "李唐": "唐", "五代": "五代", "宋": "宋", "北宋": "宋", "南宋": "宋", "趙宋": "宋", "遼": "遼", "金": "金", "元": "元", "蒙元": "元", "明": "明", "皇明": "明", "大明": "明", "清": "清", "大清": "清", "國朝": "清", "皇清": "清", "民國": "民國",
    "qin": "秦", "han": "漢", "jin": "晉", "sui": "隋", "tang": "唐", "song": "宋", "yuan": "元", "ming": "明", "qing": "清",
}
ERA_YEARS = {"秦": (-221, -207), "漢": (-206, 220), "三國": (220, 280), "晉": (265, 420), "隋": (581, 618), "唐": (618, 907), "五代": (907, 960), "宋": (960, 1279), "元": (1271, 1368), "明": (1368, 1644), "清": (1644, 1912)}
SHORT_NAMES = {
    "abby": "abigail", "alec": "alexander", "alex": "alexander", "sandy": "alexander", "gus": "augustine", "austin": "augustine", "ben": "benjamin", "benny": "benjamin", "chris": "christopher", "kit": "christopher", "delia": "cordelia", "dolly": "dorothea", "dora": "dorothea", "dot": "dorothea", "thea": "dorothea",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bess": "elizabeth", "fred": "frederick", "freddy": "frederick", "gwen": "gwendolen", "hettie": "henrietta", "hetty": "henrietta", "etta": "henrietta",
    "jon": "jonathan", "johnny": "jonathan", "jo": "josephine", "josie": "josephine", "kate": "katherine", "kitty": "katherine", "kathy": "katherine", "katie": "katherine", "leo": "leopold", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "madge": "margaret", "matt": "matthias", "nat": "nathaniel", "nate": "nathaniel",
    "pip": "philippa", "pippa": "philippa", "phil": "philippa", "becky": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "sue": "susannah", "susie": "susannah", "sukie": "susannah", "theo": "theodore", "teddy": "theodore", "vicky": "victoria", "tori": "victoria", "billie": "wilhelmina", "mina": "wilhelmina", "minnie": "wilhelmina", "bill": "william", "billy": "william", "will": "william",
    "jack": "john", "jim": "james", "harry": "henry", "dick": "richard", "tom": "thomas", "tony": "anthony", "mike": "michael", "polly": "mary", "nell": "eleanor", "sally": "sarah", "charlie": "charles", "frank": "francis", "joe": "joseph", "dan": "daniel", "dave": "david", "nick": "nicholas", "andy": "andrew", "greg": "gregory", "larry": "lawrence",
}
HONORIFICS = frozenset("rev dr mr mrs ms miss prof sir st hon lady lord fr sr jr esq".split())
READINGS = {"曾": "zeng", "單": "shan", "单": "shan", "解": "xie", "任": "ren", "仇": "qiu", "區": "ou", "查": "zha", "翟": "zhai", "葉": "ye", "叶": "ye", "蓋": "ge", "樂": "yue", "員": "yun", "拓": "tuo", "尉": "yu", "沈": "shen", "覃": "qin"}

SIMILARITY = 0.5  # least Jaccard similarity of token sets
SOFT = 0.35  # least soft weighted similarity
YEARS = 2  # by which years of one person may differ between sources


def han_tables(spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    """Simplified form and reading of each character of the basic Han block, from ICU, which Spark brings. Where it is missing or gives no line for each, this raises: without the tables spellings of one name would count as different."""
    block = [chr(c) for c in range(0x4E00, 0xA000)]
    try:
        make = spark._jvm.com.ibm.icu.text.Transliterator.getInstance  # noqa: SLF001
        simple = make("Traditional-Simplified").transliterate("\n".join(block)).split("\n")
        sounds = make("Han-Latin; Latin-ASCII; Lower").transliterate("\n".join(block)).split("\n")
    except Exception as e:
        raise RuntimeError("names need the transliterators of ICU (icu4j), which cannot be used here") from e
    if len(simple) != len(block) or len(sounds) != len(block):
        raise RuntimeError(f"ICU gave {len(simple)} simplified forms and {len(sounds)} readings of {len(block)} characters")
    return {a: b for a, b in zip(block, simple, strict=True) if a != b}, {a: b.strip() for a, b in zip(block, sounds, strict=True)} | READINGS


_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af□]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_ERA_LEAD = re.compile(r"^[(〔\[【](?P<a>[^)〕\]】]{1,3})[)〕\]】]\s*|^(?P<b>[^·\s]{1,2})[·•・]\s*(?=.{2})|^(?P<c>國朝|皇朝|皇清|皇明|本朝)(?=.{2})")
_ROLE_END = re.compile(rf"\s*\((?:[{ROLES}、,;，；]|集解|同)+\)$|[\s,，]*等$")


def era(text: str | None) -> str | None:
    """One label for a dynasty however it is written; None where it says nothing."""
    t = unicodedata.normalize("NFKC", text or "").strip(" ()〔〕[]【】（）").casefold()
    t = re.sub(r"\s*(?:dynasty|period|朝|代|時期)$", "", t) if t not in ("國朝", "皇朝", "南朝", "北朝") else t
    return ERAS.get(t)


def years(dates: str | None, first: str | None, last: str | None) -> tuple[int | None, int | None]:
    """Years of birth and death from the dates as written, else from the two bounds."""
    m = re.match(r"^\s*[?約c.]*\s*(-?\d{1,4})\s*\??\s*[-–—~～至]\s*(-?\d{1,4})\s*\??\s*$", dates or "")
    if m:
        return int(m[1]), int(m[2])
    out = [int(x) if re.fullmatch(r"-?\d{1,4}", (x or "").strip()) else None for x in (first, last)]
    return (out[0], out[1]) if out[0] is not None and out[1] is not None else (None, None)


class Forms:
    """Reads a name as typed into the forms it stands for."""

    def __init__(self, simple: dict[str, str], sounds: dict[str, str]) -> None:
        self.simple, self.sounds = str.maketrans(simple), sounds
        self.surnames = {s.translate(self.simple) for s in SURNAMES}
        self.compound = tuple(s.translate(self.simple) for s in COMPOUND)
        fold = lambda xs: tuple(dict.fromkeys(x.translate(self.simple) for x in xs))
        self.monk_pre, self.monk_suf, self.styles, self.orgs, self.org_pre = fold(MONK_PREFIXES), fold(MONK_SUFFIXES), fold(STYLES), fold(ORGANISATIONS), fold(ORG_PREFIXES)
        self.syllables = set(sounds.values()) | {"lu", "lv", "nv"}
        self.family_sounds = {"".join(sounds.get(c, "?") for c in s) for s in (*SURNAMES, *COMPOUND)}

    def surname(self, t: str) -> int:
        """Length of the family name at the start; 0 if there is none."""
        if t[:2] in self.compound and len(t) > 2:
            return 2
        return 1 if t[:1] in self.surnames and len(t) > 1 else 0

    def sound(self, t: str) -> str:
        return "".join(self.sounds.get(c, "?") for c in t)

    def __call__(self, raw: str) -> tuple[str | None, list[tuple[str, str]]]:
        """(dynasty in the name, [(kind, form)]); kinds: han, given, style, org, latin, sound."""
        t = unicodedata.normalize("NFKC", raw).strip()
        lead, found = None, _ERA_LEAD.match(t)
        if found and (found["c"] or era(found["a"] or found["b"])):
            lead = None if found["c"] in ("國朝", "皇朝", "本朝") else era(found["a"] or found["b"] or found["c"])
            t = t[found.end() :]
        before = None
        while before != t:
            before, t = t, _ROLE_END.sub("", t).strip()
        if not t:
            return lead, []
        if _LATIN.search(t) and not _HAN.search(t):
            return lead, self.latin(t)
        t = t.translate(self.simple)
        t = re.sub(r"^(\S{1,2})[·•・](?=\S)", lambda m: m[1] if m[1] in self.surnames or m[1] in self.compound else m[0], t)
        if any(t.replace(" ", "").rstrip(ROLES).endswith(o) for o in self.orgs):
            o = re.sub(r"\s+", "", t)
            if o[-1] in ROLES and any(o[:-1].endswith(x) for x in self.orgs):
                o = o[:-1]
            for p in self.org_pre:
                if o.startswith(p) and len(o) - len(p) >= 4:
                    o = o[len(p) :]
                    break
            end = next(x for x in self.orgs if o.endswith(x))
            return lead, [("org", o[: -len(end)] + "|" + end[-1])]  # long and short forms of an ending agree
        main, _, rest = t.partition("(")
        extra = [rest.rstrip(")").strip()] if rest else []
        m = re.match(r"^(\S{2,4})[\s,，]*(?:字|號|号|又名|一名|别名)[\s:：]*(\S{1,3})$", main.strip())
        parts = [m[1], m[2]] if m else main.split()
        if len(parts) == 2 and (parts[0] in self.surnames or parts[0] in self.compound or parts[0] in self.monk_pre):
            parts = ["".join(parts)]  # a space behind the family name
        out: list[tuple[str, str]] = []
        name = parts[0] if parts else ""
        out += self.han(name)
        n = self.surname(name)
        for alt in [*parts[1:], *extra]:
            if 1 <= len(alt) <= 3 and _HAN.match(alt):
                out.append(("han", name[:n] + alt) if n and not alt.startswith(name[:n]) else ("given", alt))
        return lead, list(dict.fromkeys(out))

    def han(self, t: str) -> list[tuple[str, str]]:
        for p in self.monk_pre:
            if t.startswith(p) and 1 <= len(t) - len(p) <= 2:
                return [("han", "释" + t[len(p) :])]
        for s in self.monk_suf:
            if t.endswith(s) and len(t) > len(s):
                core = t[: -len(s)]
                return [("han", core if core.startswith("释") and len(core) > 1 else "释" + core)]
        for s in self.styles:
            if t.endswith(s) and len(t) > len(s):
                core = t[: -len(s)]
                out = [("style", t)] if len(core) <= 3 else []
                if len(core) >= 2 and self.surname(core) and s == "先生":
                    out.append(("han", core))
                return out or [("han", core)]
        if len(t) >= 3 and t[-1] in ROLES and self.surname(t):
            out = [("han", t[:-1])]
            return [*out, ("han", t)] if len(t) == 3 else out
        if len(t) <= 2 and not self.surname(t):
            return [("given", t)]
        return [("han", t)]

    def latin(self, t: str) -> list[tuple[str, str]]:
        t = re.sub(r"[^\w\s,.'\-]", " ", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).casefold())
        comma = "," in t
        if comma:
            a, _, b = t.partition(",")
            words = [*_words(b), *_words(a)]
            last = len(_words(a))
        else:
            words, last = _words(t), 1
        words = [w for w in words if w not in HONORIFICS]
        if not words:
            return []
        if len(words) == 2 and self.sounds:
            plain = [re.sub(r"['-]", "", w) for w in words]
            if all(self.spelt(w) for w in plain) and any(w in self.family_sounds for w in plain):
                return [("sound", "|".join(sorted(plain)))]
        family = "".join(words[len(words) - last :]) if comma else words[-1]
        given = words[: len(words) - last] if comma else words[:-1]
        return [("latin", family + "," + " ".join(SHORT_NAMES.get(g, g) for g in given))]

    def spelt(self, w: str, most: int = 3) -> bool:
        """Whether w is one to three Chinese syllables."""
        return w in self.syllables or (most > 1 and any(w[:k] in self.syllables and self.spelt(w[k:], most - 1) for k in range(1, min(7, len(w)))))


def _words(t: str) -> list[str]:
    return [w for w in re.split(r"[\s.]+", t.strip()) if w]


def tokens(kind: str, form: str) -> list[str]:
    """Distinct tokens of a form: bigrams of a Latin surname or of a reading, characters of a Han name or an organisation."""
    if kind == "latin":
        s = "^" + form.partition(",")[0] + "$"
        return sorted({"l" + s[i : i + 2] for i in range(len(s) - 1)})
    if kind == "org":
        return sorted({"o" + c for c in form if c not in "□|"})
    if kind == "sound":
        return sorted({"s" + w[i : i + 2] for w in (f"^{x}$" for x in form.split("|")) for i in range(len(w) - 1)})
    if kind == "style":
        form = form[: -next((len(s) for s in STYLES if form.endswith(s)), 2)] or form
    return sorted({"h" + c for c in form if c != "□"})


def _close(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def relation(ka: str, a: str, kb: str, b: str, weight: dict[str, float]) -> tuple[int, float]:
    """(strength, soft weighted similarity) of two forms: 3 a sure variant, 2 a likely one, 1 one only the years can confirm, 0 none."""
    if "latin" in (ka, kb):
        return _latin_relation(a, b, weight) if ka == kb else (0, 0.0)
    if ka == kb and a == b:
        return 3, 1.0
    if "org" in (ka, kb) or "sound" in (ka, kb):
        if ka != kb or not _close(a, b):
            return 0, 0.0
        x, y = set(tokens(ka, a)), set(tokens(kb, b))
        soft = _weighed(x & y, weight) / _weighed(x | y, weight)
        if ka == "sound":
            return (1, soft) if a.count("|") == b.count("|") and min(len(a), len(b)) >= 6 else (0, soft)
        (x1, _, e1), (x2, _, e2) = a.partition("|"), b.partition("|")
        if e1 != e2 or min(len(x1), len(x2)) < 3:
            return 0, soft
        return (2 if "□" in x1 + x2 or min(len(x1), len(x2)) >= 5 else 1), soft
    core = lambda k, f: f[: -next((len(s) for s in STYLES if f.endswith(s)), 0)] if k == "style" and any(f.endswith(s) for s in STYLES) else f
    x, y = core(ka, a), core(kb, b)
    w = lambda c: weight.get("h" + c, 1.0)
    every = sum(map(w, {*x, *y} - {"□"})) or 1.0
    same = sum(map(w, {*x} & {*y})) + (0.5 * min(w(c) for c in ({*x} ^ {*y}) - {"□"}) if "□" in x + y and ({*x} ^ {*y}) - {"□"} else 0.0)
    soft = same / every
    if "style" in (ka, kb):
        if ka == kb:
            return 0, soft
        s, o, ok = (x, y, kb) if ka == "style" else (y, x, ka)
        tail = o if ok == "given" else o[-len(s) :]
        return (2, soft) if len(s) >= 2 and sorted(s) == sorted(tail) else (0, soft)
    if "given" in (ka, kb):
        g, o = (x, y) if ka == "given" else (y, x)
        if ka == kb:
            return (2, soft) if len(x) == len(y) == 2 and sorted(x) == sorted(y) else (0, soft)
        if len(o) > len(g) and sorted(o[-len(g) :]) == sorted(g) and len(o) - len(g) <= 2:
            return (2 if len(g) >= 2 else 1), soft
        return 0, soft
    if len(x) == len(y):
        differ = [i for i in range(len(x)) if x[i] != y[i]]
        if sorted(x) == sorted(y) and 0 not in differ:
            return 2, 1.0
        if len(differ) == 1 and len(x) >= 3:
            p, q = x[differ[0]], y[differ[0]]
            return (2 if "□" in (p, q) else 1), soft
    elif abs(len(x) - len(y)) == 1 and max(len(x), len(y)) >= 3 and x[0] == y[0] and _close(x, y):
        return 1, soft  # a character left out or added
    return 0, soft


def _weighed(found: set[str], weight: dict[str, float]) -> float:
    return sum(weight.get(t, 1.0) for t in found) or 1e-9


def _latin_relation(a: str, b: str, weight: dict[str, float]) -> tuple[int, float]:
    (la, _, ga), (lb, _, gb) = a.partition(","), b.partition(",")
    if la != lb and not (min(len(la), len(lb)) >= 3 and _close(la, lb)):
        return 0, 0.0
    typos = la != lb
    short = la != lb and min(len(la), len(lb)) < 5  # only the years can confirm a slip in a short one
    xs, ys = ga.split(), gb.split()
    if not xs or not ys:
        return (1, 0.5) if la == lb else (0, 0.0)
    initials, score = 0, 0.0
    for p, q in zip(xs, ys):  # noqa: B905
        if p == q:
            score += 1
        elif len(p) == 1 or len(q) == 1:
            if p[0] != q[0]:
                return 0, 0.0
            initials += 1
            score += 0.8
        elif min(len(p), len(q)) >= 4 and _close(p, q):
            typos += 1
            score += 0.8
        else:
            return 0, 0.0
    if typos > 1:
        return 0, 0.0
    x, y = set(tokens("latin", a)), set(tokens("latin", b))
    family = _weighed(x & y, weight) / min(_weighed(x, weight), _weighed(y, weight))  # rare letter pairs count more
    soft = (2 * family + score) / (2 + min(len(xs), len(ys)))
    if short:
        return (1, soft) if not initials and ga == gb else (0, soft)
    return (3 if not typos and not initials else 2), soft


def similar_forms(forms: DataFrame, salt_rows: int = 2000) -> DataFrame:
    """(fa, fb, strength, soft) for similar forms by a prefix-filtered set-similarity join.

    forms: (form_id, kind, form, typed, tokens). Tokens are ordered rarest first over all
    forms; only the first |x| - ceil(SIMILARITY |x|) + 1 tokens of each can decide, and
    position and size bound the possible overlap. A token's block of more than
    salt_rows forms is joined in blocks of that size. Readings, written in few letters,
    meet by what is left of them without one letter, which finds every single slip, and
    only where one of the two was typed as a reading.
    """
    listed = forms.select("form_id", F.explode("tokens").alias("token"))
    df = listed.groupBy("token").agg(F.count("*").alias("df"))
    total = forms.count() or 1
    ordered = stage(
        listed.join(df, "token")
        .groupBy("form_id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"))
        .join(forms.select("form_id", "kind", "form"), "form_id"),
        "names-ordered",
    )
    size = F.size("o")
    prefix = size - F.ceil(SIMILARITY * size).cast("int") + 1
    heads = ordered.where("kind <> 'sound'").select("form_id", size.alias("n"), F.posexplode(F.slice(F.transform("o", lambda t: t["token"]), 1, prefix)).alias("p", "token"))
    blocks = heads.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token", F.ceil(F.col("m") / salt_rows).cast("int").alias("salts"))
    heads = heads.join(blocks, "token")
    a = heads.select("token", F.col("form_id").alias("fa"), F.col("n").alias("na"), F.col("p").alias("pa"), F.pmod(F.xxhash64("form_id"), F.col("salts")).cast("int").alias("salt"))
    b = heads.select("token", F.col("form_id").alias("fb"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    need = F.col("na") + F.col("nb")
    possible = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # tokens of both from here on
    found = a.join(b, ["token", "salt"]).where((F.col("fa") < F.col("fb")) & (possible * (1 + SIMILARITY) >= SIMILARITY * need)).select("fa", "fb")
    spelt = forms.where("kind = 'sound'").select("form_id", "typed", F.explode(F.array_distinct(F.concat(F.array("form"), F.transform(F.sequence(F.lit(0), F.length("form") - 1), lambda i: F.concat(F.substring("form", F.lit(1), i), F.substr("form", i + 2)))))).alias("part"))
    slips = spelt.where("typed").select("part", F.col("form_id").alias("x")).join(spelt.select("part", F.col("form_id").alias("y")), "part").where("x <> y")
    found = found.unionByName(slips.select(F.least("x", "y").alias("fa"), F.greatest("x", "y").alias("fb"))).distinct()

    @F.pandas_udf("struct<strength:int,soft:double>")
    def verify(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ka, xa, oa, kb, xb, ob in batches:
            out = []
            for k1, f1, o1, k2, f2, o2 in zip(ka, xa, oa, kb, xb, ob, strict=True):
                weight = {t["token"]: math.log(1 + total / t["df"]) for t in (*o1, *o2)}
                out.append(relation(k1, f1, k2, f2, weight))
            yield pd.DataFrame(out, columns=["strength", "soft"])

    left = ordered.select(F.col("form_id").alias("fa"), F.col("kind").alias("ka"), F.col("form").alias("xa"), F.col("o").alias("oa"))
    right = ordered.select(F.col("form_id").alias("fb"), F.col("kind").alias("kb"), F.col("form").alias("xb"), F.col("o").alias("ob"))
    judged = found.join(left, "fa").join(right, "fb").select("fa", "fb", verify("ka", "xa", "oa", "kb", "xb", "ob").alias("v"))
    return judged.where((F.col("v.strength") > 0) & (F.col("v.soft") >= SOFT)).select("fa", "fb", "v.strength", "v.soft")


def _persons(mentions: list[dict]) -> list[int]:
    """A person's number for each of the distinct (id, era, born, died) under one form; -1 where several persons would do and no id tells."""
    dated = sorted((i for i, m in enumerate(mentions) if m["born"] is not None), key=lambda i: (mentions[i]["born"], mentions[i]["died"]))
    number = [-1] * len(mentions)
    groups: list[dict] = []
    for i in dated:
        m = mentions[i]
        g = groups[-1] if groups else None
        if g and m["born"] - g["born"] <= YEARS and abs(m["died"] - g["died"]) <= YEARS:
            g["born"] = m["born"]
        else:
            g = {"born": m["born"], "died": m["died"], "eras": set(), "ids": set()}
            groups.append(g)
        number[i] = len(groups) - 1
        g["eras"] |= {m["era"]} - {None}
        g["ids"] |= {m["id"]} - {None}
    for g in groups:
        if not g["eras"]:
            g["eras"] = {e for e, (a, b) in ERA_YEARS.items() if a - 20 <= g["died"] and g["born"] <= b}
    for known in (True, False):  # first the undated with a dynasty, then those with nothing
        for i in (i for i, m in enumerate(mentions) if m["born"] is None and (m["era"] is not None) == known and m["id"]):
            _place(mentions[i], i, groups, number)
        for i in (i for i, m in enumerate(mentions) if m["born"] is None and (m["era"] is not None) == known and not m["id"]):
            _place(mentions[i], i, groups, number)
    return number


def _place(m: dict, i: int, groups: list[dict], number: list[int]) -> None:
    same = [k for k, g in enumerate(groups) if m["id"] and m["id"] in g["ids"]]
    fits = same or [k for k, g in enumerate(groups) if (not m["id"] or not g["ids"]) and (m["era"] is None or not g["eras"] or m["era"] in g["eras"])]
    if m["era"] is not None and len(fits) > 1:
        fits = [k for k in fits if m["era"] in groups[k]["eras"]] or fits
    if len(fits) == 1:
        g = groups[fits[0]]
        number[i] = fits[0]
    elif fits and not m["id"]:
        return
    else:
        g = {"born": None, "died": None, "eras": set(), "ids": set(), "loose": len(fits) > 1}
        groups.append(g)
        number[i] = len(groups) - 1
    if m["era"] is not None:
        g["eras"] = g["eras"] | {m["era"]}
    if m["id"]:
        g["ids"] = g["ids"] | {m["id"]}


def variants(records: DataFrame, authority: DataFrame) -> DataFrame:
    """(record, component) for every record linked to another record or to an entry of the authority file.

    records: (record, name, era_text, dates, first, last, id); authority: (id, name,
    era_text). Records of one component name the same person or organisation. Null,
    empty and blank names link to nothing; rows delivered again count once; further
    columns are ignored. Both tables may be empty.
    """
    spark = records.sparkSession
    tables = spark.sparkContext.broadcast(han_tables(spark))

    @F.pandas_udf("struct<era:string,born:int,died:int,forms:array<struct<kind:string,form:string>>>")
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        parse = Forms(*tables.value)
        for name, era_text, dates, first, last in batches:
            out = []
            for n, e, d, f, t in zip(name, era_text, dates, first, last, strict=True):
                lead, forms = parse(n)
                born, died = years(d, f, t)
                if parse.sounds:
                    forms = [*forms, *(("sound", "|".join(sorted((parse.sound(x[: parse.surname(x)]), parse.sound(x[parse.surname(x) :]))))) for k, x in forms if k == "han" and parse.surname(x) and "□" not in x)]
                out.append((era(e) or lead, born, died, [{"kind": k, "form": x} for k, x in dict.fromkeys(forms)]))
            got = pd.DataFrame(out, columns=["era", "born", "died", "forms"])
            yield got.astype({"born": "Int32", "died": "Int32"})

    blank = F.lit(None).cast("string")
    people = records.where("record is not null and length(trim(name)) > 0").select(F.col("record").cast("string").alias("record"), "name", "era_text", "dates", "first", "last", F.when(F.length("id") > 0, F.col("id")).alias("id"))
    file = authority.where("id is not null and length(trim(name)) > 0").select(F.lit(None).cast("string").alias("record"), "name", "era_text", blank.alias("dates"), blank.alias("first"), blank.alias("last"), "id")
    rows = people.unionByName(file).distinct().select("record", "id", read("name", "era_text", "dates", "first", "last").alias("r"))
    rows = stage(rows.select("record", "id", "r.era", "r.born", "r.died", "r.forms", F.xxhash64("id", "r.era", "r.born", "r.died", "r.forms").cast("string").alias("mention")), "names-read")
    who = F.xxhash64(F.coalesce("id", F.lit("")), F.coalesce("era", F.lit("")), F.coalesce("born", F.lit(-99999)), F.coalesce("died", F.lit(-99999)))
    typed = ~F.exists("forms", lambda f: f["kind"] == "han")
    mentions = rows.select("mention", "id", "era", "born", "died", who.alias("who"), typed.alias("typed"), F.explode("forms").alias("f")).select("mention", "id", "era", "born", "died", "who", "typed", "f.kind", F.concat_ws(":", "f.kind", "f.form").alias("form_id"), "f.form").distinct()

    # of a form only what differs in id, dynasty or years is brought together, however many records bear the name
    by_form = mentions.groupBy("form_id").agg(F.sort_array(F.collect_set(F.struct("id", "era", "born", "died", "who"))).alias("ms"))

    @F.pandas_udf("array<int>")
    def person(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ms: _persons([dict(m) for m in ms]))

    persons = by_form.select("form_id", F.explode(F.arrays_zip("ms", person("ms").alias("no"))).alias("z")).select("form_id", F.col("z.ms.who").alias("who"), F.col("z.no").alias("no"))
    entity = F.xxhash64("form_id", F.when(F.col("no") >= 0, F.col("no").cast("string")).otherwise(F.concat(F.lit("m"), "mention")))
    numbered = stage(mentions.join(persons, ["form_id", "who"]).withColumn("entity", entity), "names-entities")
    entities = stage(
        numbered.groupBy("form_id", "kind", "form", "entity").agg(F.min("born").alias("born"), F.min("died").alias("died"), F.collect_set("era").alias("eras"), F.count("*").alias("size"), F.max("id").alias("id"), F.max("typed").alias("typed")),
        "names-persons",
    )

    @F.pandas_udf("array<string>")
    def tokenised(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, forms in batches:
            yield pd.Series([tokens(k, f) for k, f in zip(kinds, forms, strict=True)])

    forms = entities.groupBy("form_id", "kind", "form").agg(F.max("typed").alias("typed")).select("form_id", "kind", "form", "typed", tokenised("kind", "form").alias("tokens")).where("size(tokens) > 0")
    near = stage(similar_forms(forms), "names-similar")
    edges = _time_links(near, entities)
    # a record's persons under its several forms are one, and so are those of one authority id
    own = stage(numbered.groupBy("mention").agg(F.min("entity").alias("first"), F.collect_set("entity").alias("all")), "names-own")
    joined = own.where("size(all) > 1").select(F.col("first").alias("u"), F.explode("all").alias("v")).where("u <> v")
    known = numbered.where("id is not null").groupBy("entity", "id").agg(F.lit(1)).select(F.col("entity").alias("u"), F.xxhash64(F.lit("id"), "id").alias("v"))
    found = connected_components(joined.unionByName(known).unionByName(edges.select(F.col("ea").alias("u"), F.col("eb").alias("v"))).distinct(), "u", "v")
    placed = own.select("mention", F.col("first").alias("node")).join(found, "node", "left").select("mention", F.coalesce("component", "node").alias("component"))
    return rows.where("record is not null").select("record", "mention").join(placed, "mention").select("record", F.col("component").cast("string").alias("component"))


def _time_links(near: DataFrame, entities: DataFrame) -> DataFrame:
    """(ea, eb) of persons under similar forms that are one person, as far as years and dynasties tell."""
    side = lambda s: entities.select(F.col("form_id").alias("f" + s), F.col("entity").alias("e" + s), F.col("born").alias("born_" + s), F.col("died").alias("died_" + s), F.col("eras").alias("eras_" + s))
    pairs = near.join(side("a"), "fa").join(side("b"), "fb")
    dated = F.col("born_a").isNotNull() & F.col("born_b").isNotNull()
    agree = dated & (F.abs(F.col("born_a") - F.col("born_b")) <= YEARS) & (F.abs(F.col("died_a") - F.col("died_b")) <= YEARS)
    apart = (F.size("eras_a") > 0) & (F.size("eras_b") > 0) & ~F.arrays_overlap("eras_a", "eras_b")
    pairs = stage(pairs.where(agree | (~dated & ~apart & (F.col("strength") >= 2))).withColumn("sure", agree), "names-pairs")
    sure = pairs.where("sure").select("ea", "eb")
    # an undated person goes to the best like-named one, if all the best agree in their years
    both = pairs.where("not sure").select("ea", "eb", "strength", F.col("born_a"), F.col("born_b"), (F.size("eras_a") > 0).alias("era_a"), (F.size("eras_b") > 0).alias("era_b"), "eras_a", "eras_b")
    half = both.where("born_a is null").select(F.col("ea").alias("e"), F.col("eb").alias("o"), "strength", F.col("born_b").alias("born"), F.col("era_b").alias("era"), F.col("eras_b").alias("eras")).unionByName(
        both.where("born_b is null").select(F.col("eb").alias("e"), F.col("ea").alias("o"), "strength", F.col("born_a").alias("born"), F.col("era_a").alias("era"), F.col("eras_a").alias("eras"))
    )
    w = Window.partitionBy("e")
    best = half.withColumn("top", F.max("strength").over(w)).where("strength = top")
    best = best.withColumn("spread", F.max("born").over(w) - F.min("born").over(w)).withColumn("kinds", F.size(F.array_distinct(F.flatten(F.collect_set("eras").over(w)))))
    open_links = best.where(f"coalesce(spread, 0) <= {YEARS} and kinds <= 1").select(F.col("e").alias("ea"), F.col("o").alias("eb"))
    return sure.unionByName(open_links).distinct()
