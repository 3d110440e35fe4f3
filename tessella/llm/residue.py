"""Template residue, filler, error pages and script notices.

Bodies (texts without page furniture; slots, numbers and ids masked) get a SimHash;
partitioned tables find bodies within a few bits, a prefix-filtered join on
five-word shingles every other pair of the wanted similarity, the similarity of
the shingles verifies them. Trusted labels (listed slots, a few sure beginnings of
messages, filler vocabulary) spread through the connected components, and a
component that stands on several differing pages and speaks of servers and
browsers is trusted as a whole, whatever its wording. A last exact check keeps a
slot label from reaching a text in which the slot was filled in.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.session import stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCK_BITS = (11, 11, 11, 11, 10, 10)  # of the 64 bits
MAX_HAMMING = 3  # so three of the six blocks agree, whichever bits differ
RARITY_BITS = 21  # of a shingle's hash, for the table of how often shingles are used
RARITY_SAMPLE = 8  # one text of so many is counted for it
HEAD_BYTES = 6  # of a shingle's hash, for the join on shingles; more only save candidates
COMMON = 8  # rare shingles that a pair of the similarity has in common, or all it has in common

# Shapes of slots in template languages. A name is an identifier or a short Han label.
_NAME = r"[^\W\d_][\w.\- ]{0,40}?"
_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_.\-][A-Za-z0-9]+)*"
_HANNAME = r"[一-鿿]{1,12}"
SLOT = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*(?:{_NAME}|{_HANNAME})\s*\}}?\}}\}}",
            rf"[$#]\{{\s*{_ID}\s*\}}",
            rf"(?<![A-Za-z0-9_$#{{}}\\])\{{\s*{_ID}\s*\}}(?!\}})",
            rf"%\({_ID}\)[sdif]",
            rf"<%=?\s*{_ID}\s*%>",
            rf"@@\s*{_ID}\s*@@",
            r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*__(?![A-Za-z0-9_])",
            rf"(?<![\w%])%%{_ID}%%(?!\w)",
            rf"\[%\s*{_ID}\s*%\]",
            rf"\[INSERT\s+{_ID}(?:\s+HERE)?\]|\[(?:insert|enter|your)\s+{_ID}(?:\s+here)?\]",
            r"\$[a-z][A-Za-z0-9]{2,}(?:[_.][A-Za-z0-9]+)*\$",
            r"\[\[\s*[a-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*\s*\]\]",
            r"<(?P<tag>[a-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*)>",
            r"【請(?:輸入|填寫|填入|填)[^】\n]{1,14}】|【请(?:输入|填写|填入|填)[^】\n]{1,14}】",
            r"［[^］\n]{1,14}待補入模板］|[（(]此處填(?:入|寫)[^）)\n]{1,14}[）)]|[〔［]這裡(?:寫|填)[^〕］\n]{1,14}[〕］]",
            r"＜[^＞\n]{1,14}＞未設定|【[^】\n]{1,14}】（範例文字，請替換）",
        )
    )
)
# Elements that stand without an end tag, or whose end tag a cut-off page has lost.
ELEMENTS = frozenset(
    "html head body p div span br hr lb pb cb gb fw milestone table tr td th thead tbody ul ol li dl dt dd a b i u em strong pre code tt noscript script style form input button label select option img meta link center font small big sub sup h1 h2 h3 h4 h5 h6 blockquote q cite main nav footer header section article aside iframe svg canvas video audio lg l note g ref hi seg ab ptr anchor app lem rdg choice orig reg sic corr gap unclear supplied add del nowiki poem includeonly onlyinclude noinclude".split()
)
_SLOT_SIGNS = ("{", "[INSERT", "[insert", "[enter", "[your", "$", "[[", "<", "%(", "<%", "@@", "__", "%%", "[%", "【請", "【请", "待補入", "此處填", "這裡", "未設定", "範例文字")
_SLOT_SIGN = re.compile("|".join(map(re.escape, _SLOT_SIGNS)))
_SLOT_START = re.compile(r"[{$#%<@_\[【［(（〔＜]")  # first characters of SLOT
_QUOTED = re.compile(r"`[^`\n]{1,200}`|<code>.{1,200}?</code>|<nowiki>.{1,200}?</nowiki>", re.S)
_QUOTE_BEFORE, _QUOTE_AFTER = "\"'“‘«‹「『《", "\"'”’»›」』》"

# Parts of pages around a text.
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]{0,200})?/?>", re.I)
_WIDTH = dict([(chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)] + [("\u3000", " "), ("\u00a0", " "), ("’", "'")])
_WIDE = re.compile("[\uff01-\uff5e\u3000\u00a0’]")
_MASK = re.compile(r"\b\w*[^\W_]_\w*[^\W_]\w*\b(?!\()|\b\d{4}-\d\d-\d\d(?:[ t]\d\d:\d\d(?::\d\d)?)?|\b[0-9a-f]*\d[0-9a-f]*\b|\d+")
# What _MASK finds where there is no underscore: the first character leads, so the search skips to the next one of its kind.
_NUMBERS = re.compile(r"[\da-f](?:(?<=\b\d)\d{3}-\d\d-\d\d(?:[ t]\d\d:\d\d(?::\d\d)?)?|(?<=\b[0-9a-f])[0-9a-f]*\d[0-9a-f]*\b|(?<=\b\d)[0-9a-f]*\b|(?<=\d)\d*)")
_DIGIT = re.compile(r"\d")
_HOST = re.compile(r"\b[a-z0-9-]+\.(?:example|com|org|net|edu|gov|io|cn|jp|de|fr|kr|tw)\b")
_HOST_END = re.compile(r"\.(?:example|com|org|net|edu|gov|io|cn|jp|de|fr|kr|tw)\b")
FURNITURE = re.compile(
    r"""^(?:
      [\W_\#]*                                                    # rules, arrows, lone numbers
    | (?:[^|｜>»·•]{1,24}[|｜>»·•]\s*){1,8}[^|｜>»·•]{1,32}       # menus and paths
    | [一-鿿]{2,4}(?:[\ \u3000][一-鿿]{2,4}){2,8}                 # menus of Han labels
    | (?:©|\(c\)|copyright|版權所有|版权所有).{0,80}
    | (?:回到頁首|返回頂部|返回顶部|返回|返回首頁|返回首页|回首頁|回首页|上一頁|下一頁|重試|重试|重新整理|再試行|다시\ 시도|back\ to\ top|go\ back|retry|reload|try\ again|top|home|menu|zurück|retour|トップへ戻る|戻る|ホーム|뒤로|홈|ページトップへ|맨\ 위로|목록)
    | (?:request\ id|trace[- ]?token|reference|ref|ray(?:\ id)?|incident|error\ id|編號|编号|錯誤編號|错误代码|シリアル)\s*[:=：]?\s*[\#\s.:=-]*
    | (?:apache|nginx|iis|lighttpd|caddy)(?:/[\#.]+)?(?:\ server\ at\ .{1,60})?
    | at\ \#.*|host
    )$""",
    re.X,
)
_LEAD = re.compile(r"^(?:[\s*!⚠•·>\[\]\-—–:：#]+|(?:注意|警告|提示|錯誤|错误|お知らせ|알림|error|warning|notice|oops|hmm|sorry|attention|achtung|hinweis)\s*[:：!！—–….,，]+\s*)+")
_TRAIL = re.compile(r"(?:\s*[—–-]+\s*(?:apache|nginx|iis)\b.{0,60}|\s*[(（\[【]?\s*(?:錯誤編號|错误代码|編號|编号|error code|code|ref(?:erence)?|id)?\s*[:：]?\s*#+(?:[\s#-]*#)?\s*[)）\]】]?)+$")

# How sure messages begin, one or two a language, after masking ("#" a number or id, "host" a domain), and placeholder sentences.
SEEDS = re.compile(
    r"""(?:error\ |http\ )?(?:\#\ )?(?:bad\ request|unauthorized|forbidden|not\ found|method\ not\ allowed|request\ time-?out|gone|too\ many\ requests|internal\ server\ error|not\ implemented|bad\ gateway|service\ unavailable|gateway\ time-?out)(?!\w)
    | (?:please\ )?enable\ javascript | traceback\ \(most\ recent\ call\ last\) | \{\s*"error"\s*:
    | bitte\ aktivieren\ sie\ javascript | seite\ nicht\ gefunden
    | veuillez\ activer\ javascript | erreur\ \#
    | .{0,3}(?:浏览器|瀏覽器)不支持脚本 | .{0,3}需要啟用\ ?javascript | (?:页面|頁面)不存在
    | .{0,3}ページを表示するには | お探しのページは
    | 자바스크립트를 | 요청하신\ 페이지를""",
    re.X,
)
PLACEHOLDERS = re.compile(r"your\ text\ goes\ here(?!\w)|(?:mustertext|hier\ steht\ später)(?!\w)|ici\ votre\ texte(?!\w)|ここに本文が入ります|여기에\ 본문을\ 입력하세요|(?:這裡|此處|这里|此处)為?(?:範例|示例|占位)")
# Words that messages of servers and browsers are made of.
HINT_WORDS = frozenset(
    "javascript script scripts scripting browser browsers cookie cookies server error errors request requests requested url page pages reload retry session access accessing denied permission forbidden gateway timeout upstream database connection unavailable maintenance client app host human traceback line file message code moved removed deleted home"
    " seite sitzung zugriff verweigert fehler aktivieren reader erreur navigateur activez réessayer".split()
)
HINT_TERMS = ("脚本", "腳本", "浏览器", "瀏覽器", "页面", "頁面", "系统", "系統", "忙碌", "稍后", "稍後", "再试", "再試", "重新整理", "服务器", "伺服器", "数据库", "資料庫", "出错", "錯誤", "管理员", "管理員", "首页", "首頁", "不存在", "删除", "刪除", "移动", "移動", "ページ", "スクリプト", "サーバー", "有効", "見つかりません", "브라우저", "페이지", "스크립트", "서버", "오류", "설정", "주소")
_HINT_TERM = re.compile("|".join(HINT_TERMS))
_LETTERS = re.compile(r"[a-zà-ÿ][a-zà-ÿ]{2,}")  # a first character of its own lets the search skip to it
HINTED, SURE = 0.15, 0.1  # share of a body that such words make up: to be worth counting, and to be trusted behind a seed
FORMS = 3  # differing pages around one hinted body that show it to be made by a machine
# An open slot of any shape: marks on both sides of an identifier of several parts, or doubled marks around any name.
LOOSE = re.compile(r"(?<!\w)[^\w\s.,;:!?'\"()。，、；：？！-]{1,3}\s*[A-Za-z][a-z0-9]*(?:[_.][A-Za-z0-9]+|[A-Z][a-z0-9]+)+\s*[^\w\s.,;:!?'\"()。，、；：？！-]{1,3}(?!\w)|([^\w\s.,;:!?'\"()。，、；：？！…=*~#-])\1\s*(?:[A-Za-z][\w.]{0,40}|[一-鿿]{1,12})\s*([^\w\s.,;:!?'\"()。，、；：？！…=*~#-])\2")
# How anything that LOOSE finds begins.
_LOOSE_START = re.compile(r"([^\w\s.,;:!?'\"()。，、；：？！-])(?=[^\w\s.,;:!?'\"()。，、；：？！-]{0,2}\s*[A-Za-z]|\1\s*[一-鿿])")
# The vocabulary of the usual filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_LATIN = re.compile(r"[a-z][a-z]+")  # any word of LOREM is one of these in its text
_WORD = re.compile(r"[^\W_]+")
_PERIODIC = re.compile(r"(.{1,40}?)\1{3,}.{0,40}$", re.S)  # one short piece over and over


def _found(pattern: re.Pattern[str], start: re.Pattern[str], text: str) -> Iterator[re.Match[str]]:
    """pattern.finditer(text), tried only where start is found, which has to be where any match begins."""
    last = 0
    for s in start.finditer(text):
        if s.start() >= last and (m := pattern.match(text, s.start())):
            last = m.end()
            yield m


def find_slots(text: str) -> list[tuple[int, int]]:
    """Spans of slots that stand in the text itself, not quoted or written as code."""
    if not _SLOT_SIGN.search(text):
        return []
    code = [m.span() for m in _QUOTED.finditer(text)] if "`" in text or "<" in text else []
    out = []
    for m in _found(SLOT, _SLOT_START, text):
        a, b = m.span()
        if any(x <= a and b <= y for x, y in code):
            continue
        if m["tag"] and (m["tag"].lower() in ELEMENTS or f"</{m['tag']}>" in text):
            continue  # an element of the text's own markup
        if a and b < len(text) and text[a - 1] in _QUOTE_BEFORE and text[b] in _QUOTE_AFTER:
            continue
        out.append((a, b))
    return out


def loose_slots(text: str, slots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans outside the slots that look like slots of another template language."""
    return [m.span() for m in _found(LOOSE, _LOOSE_START, text) if not any(a < m.end() and m.start() < b for a, b in slots)]


def body_of(text: str, slots: list[tuple[int, int]]) -> str:
    """The text without furniture: folded case and width, slots, numbers, ids and hosts masked, tags and furniture lines left out."""
    for a, b in sorted(slots, reverse=True):
        text = f"{text[:a]} \x01slot {text[b:]}"
    t = text.casefold()
    if not t.isascii():
        m = _WIDE.search(t)
        while m:
            t = t.replace(m[0], _WIDTH[m[0]])
            m = _WIDE.search(t, m.end())
    if "<" in t:
        t = _TAG.sub(" ", t)
    if _HOST_END.search(t):
        t = _HOST.sub("host", t)  # neither this nor a mask reaches over the end of a line
    if "_" in t:
        t = "\n".join([(_MASK if "_" in x else _NUMBERS).sub("#", x) for x in t.split("\n")])
    elif _DIGIT.search(t):
        t = _NUMBERS.sub("#", t)
    lines = [x.strip() for x in t.split("\n")]
    kept = [x for x in lines if x and not FURNITURE.match(x)]
    body = " ".join(" ".join(kept).split())
    before = None
    while before != body:
        before = body
        body = _LEAD.sub("", body)
        if body[-1:] in ("#", ")", "]", "】") or "apache" in body[-80:] or "nginx" in body[-80:]:
            body = (body[:-120] + _TRAIL.sub("", body[-120:])).strip()  # a trailer is shorter; several go one by one
    return body


def masked(text: str) -> tuple[str, int, int]:
    """(body, slots, open slots of unlisted shape) of a text."""
    slots = find_slots(text)
    more = loose_slots(text, slots)
    return body_of(text, slots + more), len(slots), len(more)


def hint_share(body: str) -> float:
    """Share of the body, white space left out, that words of servers and browsers make up."""
    n = sum(map(len, filter(HINT_WORDS.__contains__, _LETTERS.findall(body))))
    if _HINT_TERM.search(body):
        n += sum(body.count(t) * len(t) for t in HINT_TERMS)
    return n / max(len(body) - body.count(" "), 1)


def trusted_label(body: str, slots: bool, seeds: re.Pattern[str] = SEEDS) -> str | None:
    """'slot', 'message' or 'filler' where the text alone shows it, else None."""
    if slots:
        return "slot"
    if not body:
        return None
    if seeds.match(body) and hint_share(body) >= SURE:
        return "message"
    if _PERIODIC.match(body) or PLACEHOLDERS.match(body):
        return "filler"
    if len(LOREM.intersection(_LATIN.findall(body))) >= 4:
        words = _WORD.findall(body)
        if len(words) >= 6 and sum(map(LOREM.__contains__, words)) >= 0.9 * len(words) and len(LOREM.intersection(words)) >= 4:
            return "filler"
    return None


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KIND = np.zeros(0x110000, dtype=np.uint8)  # 0 none, 1 letter of a spaced script, 2 a word by itself
for _a, _b in ((0x2E80, 0xA4D0), (0xAC00, 0xAC00), (0xF900, 0xFB00), (0xFE30, 0xFFF0), (0x1B000, 0x1B300), (0x20000, 0x32400)):
    _KIND[_a:_b] = 2
for _cp in range(0x20000):
    if not _KIND[_cp] and unicodedata.category(chr(_cp))[0] in "LMN":
        _KIND[_cp] = 1
    elif _KIND[_cp] and unicodedata.category(chr(_cp))[0] not in "LMN":
        _KIND[_cp] = 0
_KIND[1] = _KIND[ord("#")] = 2
_LETTER = np.where(_KIND > 0, _mixed(np.arange(len(_KIND), dtype=np.uint64) + _MIX), np.uint64(0))
# For each value of a byte, its bits as eight counters of a byte each.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _word_hashes(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and body number of every word of the bodies, in order. A Han or kana character, a slot and a masked number are words."""
    points = np.frombuffer("\x00".join(bodies).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[points]
    begin = (kind == 2) | ((kind == 1) & np.concatenate(([True], kind[:-1] != 1)))
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    words = _LETTER[points[first]]
    spelled = np.flatnonzero(kind == 1)
    if len(spelled):  # words of letters, weighed by place
        starts = np.flatnonzero(begin[spelled])
        place = np.arange(len(spelled)) - np.repeat(starts, np.diff(np.append(starts, len(spelled))))
        words[kind[first] == 1] = np.add.reduceat(_LETTER[points[spelled]] * (place * 2 + 1).astype(np.uint64), starts)
    ends = np.searchsorted(first, np.cumsum([len(b) + 1 for b in bodies]))
    return words, np.repeat(np.arange(len(bodies)), np.diff(ends, prepend=0))


def _shingle_hashes(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and body number of every five-word shingle; a shorter body is one shingle."""
    words, owner = _word_hashes(bodies)
    if not len(words):
        return words, owner
    count = np.bincount(owner, minlength=len(bodies))
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    left = (start + count)[owner] - np.arange(len(words))  # words to the end of the body
    with np.errstate(over="ignore"):
        total = _mixed(words)
        for i in range(1, SHINGLE_WORDS):
            total *= np.uint64(31)
            ahead = words[i:] * (left[: max(len(words) - i, 0)] > i)
            total[: len(ahead)] += ahead
            total = _mixed(total)
    keep = (left >= SHINGLE_WORDS) | ((np.arange(len(words)) == start[owner]) & (count[owner] < SHINGLE_WORDS))
    return total[keep], owner[keep]


def shingles(body: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles of the whole body."""
    return np.unique(_shingle_hashes([body])[0])


def simhashes(bodies: list[str], block: int = 200_000, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> list[int | None]:
    """64-bit SimHash of each body over its shingles, as signed numbers; None for a body without a word. hashed: the shingles, if known."""
    hashes, owner = _shingle_hashes(bodies) if hashed is None else hashed
    out: list[int | None] = [None] * len(bodies)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(first, len(hashes)))
    ones = np.zeros((len(first), 8, 8), dtype=np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        a, b = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(part), side="left")
        cuts = np.maximum(first[a:b] - at, 0)
        pieces = -(-np.diff(np.append(cuts, len(part))) // 255)  # of a body, each of so few shingles that no counter runs over
        lead = np.cumsum(pieces) - pieces
        starts = np.repeat(cuts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(lead, pieces))
        places = part.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counted = np.add.reduceat(_BITS[places[:, k]], starts).view(np.uint8).reshape(-1, 8)
            ones[a:b, k] += np.add.reduceat(counted, lead, axis=0, dtype=np.int64)
    packed = np.packbits(ones.reshape(-1, 64) * 2 > size[:, None], axis=1).view(np.int64).ravel()
    for n, value in zip(owner[first], packed, strict=True):
        out[n] = int(value)
    return out


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many shingles of a sample of (t) have each value of the lowest RARITY_BITS bits of their hash; counted in the tasks, only the table reaches the driver."""
    size, parts = 1 << RARITY_BITS, 64

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, dtype=np.int64)
        for f in frames:
            for texts in _chunks(f["t"]):
                hashes = _shingle_hashes([masked(x)[0] for x in texts])[0].view(np.int64)
                np.add.at(n, hashes & (size - 1), 1)
        yield pd.DataFrame({"part": range(parts), "n": [x.tobytes() for x in np.split(n, parts)]})

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f["part"].iloc[:1], "n": [np.sum([np.frombuffer(x, dtype=np.int64) for x in f["n"]], axis=0).tobytes()]})

    sample = texts.select("t").where(F.pmod(F.xxhash64("t"), F.lit(RARITY_SAMPLE)) == 0)
    rows = sample.mapInPandas(counted, "part int, n binary").groupBy("part").applyInPandas(summed, "part int, n binary").collect()
    found = {r["part"]: np.frombuffer(r["n"], dtype=np.int64) for r in rows}
    n = np.concatenate([found.get(i, np.zeros(size // parts, dtype=np.int64)) for i in range(parts)])
    return n.astype(np.min_scalar_type(n.max()))  # small numbers are sorted faster


def prefix(shingles: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, COMMON of which any set of SIMILARITY has among its own."""
    shingles = np.sort(shingles)
    order = np.argsort(used[shingles & (len(used) - 1)], kind="stable")
    return shingles[order[: len(shingles) - math.ceil(SIMILARITY * len(shingles) - 1e-9) + COMMON]]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """np.unique, which is slow on arrays as short as those of one text."""
    out = np.sort(hashes)
    return out[np.concatenate((np.ones(min(len(out), 1), dtype=bool), out[1:] != out[:-1]))]


def _chunks(texts: pd.Series, chars: int = 400_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters, which bounds the arrays made of them; a longer text is a list of its own."""
    out: list[str] = []
    size = 0
    for t in texts:
        if out and size + len(t) > chars:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def _prepared(texts: list[str], seeds: re.Pattern[str], used: np.ndarray) -> pd.DataFrame:
    found = [masked(x) for x in texts]
    bodies = [x[0] for x in found]
    hashed = _shingle_hashes(bodies)
    sims = simhashes(bodies, hashed=hashed)
    sets = [_distinct(x).view(np.int64) for x in np.split(hashed[0], np.searchsorted(hashed[1], np.arange(1, len(bodies))))][: len(bodies)]
    return pd.DataFrame(
        {
            "body": pd.Series([None if h is None else hashlib.md5(x.tobytes(), usedforsecurity=False).digest() for x, h in zip(sets, sims, strict=True)], dtype=object),
            "sim": pd.array(sims, dtype="Int64"),
            "label": pd.Series([trusted_label(x, bool(y), seeds) for x, y, _ in found], dtype=object),
            "open": [bool(z) for _, _, z in found],
            "hinted": [hint_share(x) >= HINTED for x in bodies],
            "n": np.array([len(x) for x in sets], dtype=np.int32),
            "heads": pd.Series([prefix(x, used).view(np.uint8).reshape(-1, 8)[:, :HEAD_BYTES].tobytes() for x in sets], dtype=object),
        }
    )


def prepared(df: DataFrame, key: str, text: str, seeds: re.Pattern[str] = SEEDS) -> DataFrame:
    """(doc, raw, body, sim, label, open, hinted, n, heads) per distinct key and text with a body.

    raw and body are digests of the text and of its distinct shingles, sim the SimHash, n the number of shingles and heads
    the rarest of them; open: it has slots of unlisted shape; hinted: words of servers and browsers make up HINTED of it.
    Null texts give no row. A text of nothing but furniture, or an empty one, has no body and gives no row.
    """

    t = df.select(df[key].alias("doc"), df[text].alias("t")).where("t is not null")
    used = df.sparkSession.sparkContext.broadcast(_rarity(t))

    @F.pandas_udf("struct<body:binary,sim:long,label:string,open:boolean,hinted:boolean,n:int,heads:binary>")
    def prepare(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.concat([_prepared(x, seeds, used.value) for x in _chunks(s)] or [_prepared([], seeds, used.value)], ignore_index=True)

    return t.select("doc", F.xxhash64("t").alias("raw"), prepare("t").alias("p")).select("doc", "raw", "p.*").where("body is not null")


def _tables() -> list[tuple[int, ...]]:
    keep = len(BLOCK_BITS) - MAX_HAMMING
    return list(itertools.combinations(range(len(BLOCK_BITS)), keep))


def candidates(bodies: DataFrame, salt_rows: int = 2000) -> DataFrame:
    """Pairs (a, b), a < b, of representatives whose SimHashes differ in at most MAX_HAMMING bits, by partitioned tables.

    bodies: (rep, sim). Every table keys on three of six blocks of the bits; a
    bucket of more than salt_rows bodies is joined in blocks of that size.
    """
    shifts = np.concatenate(([0], np.cumsum(BLOCK_BITS)[:-1])).tolist()
    keys = []
    for n, blocks in enumerate(_tables()):
        mask = sum(((1 << BLOCK_BITS[b]) - 1) << shifts[b] for b in blocks)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col("sim").bitwiseAND(F.lit(signed))))
    placed = bodies.select("rep", "sim", F.explode(F.array(*keys)).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    full = placed.join(sizes, "bucket")
    a = full.select("bucket", F.col("rep").alias("a"), F.col("sim").alias("sim_a"), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    b = full.select("bucket", F.col("rep").alias("b"), F.col("sim").alias("sim_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["bucket", "salt"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))) <= MAX_HAMMING)).select("a", "b").distinct()


def _in_parts(bodies: DataFrame, parts: int) -> DataFrame:
    """(p, ids, ns, many, heads): the heads of the bodies by part of the hash, packed: of each body its id, its number of shingles, how many heads it has here, and those heads."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = [np.frombuffer(x, dtype=np.uint8).reshape(-1, HEAD_BYTES) for x in f["heads"]]
            count = np.array([len(x) for x in held], dtype=np.int64)
            if not count.sum():
                continue
            heads = np.concatenate(held)
            part = (_widened(heads) % np.uint64(parts)).astype(np.int64)
            owner = np.repeat(np.arange(len(f)), count)
            order = np.argsort(part, kind="stable")
            ids, ns = f["id"].to_numpy(np.int64), f["n"].to_numpy(np.int32)
            which, first = np.unique(part[order], return_index=True)
            out = []
            for rows in np.split(order, first[1:]):
                own, many = np.unique(owner[rows], return_counts=True)
                out.append((ids[own].tobytes(), ns[own].tobytes(), many.astype(np.uint32).tobytes(), heads[rows].tobytes()))
            yield pd.DataFrame(out, columns=["ids", "ns", "many", "heads"]).assign(p=which)[["p", "ids", "ns", "many", "heads"]]

    return bodies.select(F.xxhash64("body").alias("id"), "n", "heads").mapInPandas(packed, "p long, ids binary, ns binary, many binary, heads binary")


def _widened(heads: np.ndarray) -> np.ndarray:
    """Heads of HEAD_BYTES bytes as numbers."""
    out = np.zeros((len(heads), 8), dtype=np.uint8)
    out[:, :HEAD_BYTES] = heads
    return out.view(np.uint64).ravel()


def _paired(f: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Pairs of bodies of one part that share heads, with how many; a head of more than most bodies comes out with its bodies instead, one by one."""
    take = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in f[c]])
    many = take("many", np.uint32).astype(np.int64)
    ids, ns = np.repeat(take("ids", np.int64), many), np.repeat(take("ns", np.int32), many)
    heads = _widened(take("heads", np.uint8).reshape(-1, HEAD_BYTES))
    order = np.lexsort((ids, heads))
    ids, ns, heads = ids[order], ns[order], heads[order]
    first = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
    size = np.diff(np.append(first, len(heads)))
    for start, m in zip(first[size > most], size[size > most], strict=True):
        yield pd.DataFrame({"a": ids[start : start + m], "b": 0, "na": ns[start : start + m], "nb": 0, "common": 0, "head": heads[start].astype(np.int64)})
    for m in np.unique(size[(size > 1) & (size <= most)]):
        i, j = np.triu_indices(m, 1)
        starts = first[size == m]
        step = max(1, 500_000 // len(i))
        for at in range(0, len(starts), step):
            x, y = (starts[at : at + step, None] + i).ravel(), (starts[at : at + step, None] + j).ravel()
            fits = (np.minimum(ns[x], ns[y]) >= SIMILARITY * np.maximum(ns[x], ns[y]) - 1e-6) & (ids[x] != ids[y])
            x, y = x[fits], y[fits]
            met = pd.DataFrame({"a": ids[x], "b": ids[y], "na": ns[x], "nb": ns[y]}).groupby(["a", "b", "na", "nb"], as_index=False).size()
            yield met.rename(columns={"size": "common"}).assign(head=0)


def shingle_candidates(bodies: DataFrame, salt_rows: int = 2000, per_part: int = 8192) -> DataFrame:
    """Pairs (a, b), a < b, of representatives among which are all of SIMILARITY or more, by a prefix-filtered join on shingles.

    bodies: (rep, body, n, heads). Shingles are ordered by how often their part of the hash is used in a sample, then by
    hash; any order finds every pair, a rarest-first one few others. The heads travel packed, in parts whose number grows
    with the bodies, and are joined there; one of more than salt_rows bodies is joined in blocks of that size.
    """
    parts = max(1, math.ceil(bodies.count() / per_part))

    def paired(f: pd.DataFrame) -> pd.DataFrame:
        got = list(_paired(f, salt_rows))
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("a", "b", "na", "nb", "common", "head")})

    met = stage(_in_parts(bodies, parts).groupBy("p").applyInPandas(paired, "a long, b long, na int, nb int, common int, head long"), "residue-met")
    hot = met.where("common = 0").select("a", "na", "head")
    sizes = hot.groupBy("head").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    hot = hot.join(sizes, "head")
    x = hot.select("head", "a", "na", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    y = hot.select("head", F.col("a").alias("b"), F.col("na").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    fits = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-6
    more = x.join(y, ["head", "salt"]).where((F.col("a") < F.col("b")) & fits).select("a", "b", "na", "nb", F.lit(1).alias("common"))
    every = met.where("common > 0").select("a", "b", "na", "nb", "common").unionByName(more).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    enough = every.where(F.col("common") >= F.least(F.lit(COMMON), F.ceil(SIMILARITY * F.greatest("na", "nb") - 1e-6))).select("a", "b")
    names = bodies.select(F.xxhash64("body").alias("id"), "rep")
    named = enough.join(names.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
    return named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs whose bodies share SIMILARITY or more of their five-word shingles."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: shingles(masked(x)[0]).view(np.int64))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = df.select(df[key].alias("doc"), df[text].alias("t")).where("t is not null").join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).select("doc", hashed("t").alias("h"))
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("h").alias("ha")), "a").join(texts.select(F.col("doc").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common >= SIMILARITY * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def residue(df: DataFrame, key: str, text: str, seeds: re.Pattern[str] = SEEDS) -> DataFrame:
    """(doc, component, label, direct) of every text that is residue.

    label is the trusted label of its component: 'slot', 'message' or 'filler'; direct tells whether the text shows it by
    itself or has it from its component. A component without a trusted label is one of messages where hinted bodies in it
    stand on FORMS or more differing pages. A text in a component labelled by slots only counts if it has a slot itself, of
    a listed shape or another. Null and empty texts are no residue, repeated rows give one row, further columns are ignored
    whatever their names; an empty table gives no row.
    """
    prep = stage(prepared(df, key, text, seeds), "residue-prepared")
    rank = F.when(F.col("label") == "message", 3).when(F.col("label") == "filler", 2).when(F.col("label") == "slot", 1).otherwise(0)
    bodies = stage(prep.groupBy("body").agg(F.min("doc").alias("rep"), F.min("sim").alias("sim"), F.max(rank).alias("rank"), F.first("n").alias("n"), F.first("heads").alias("heads")), "residue-bodies")
    near = stage(candidates(bodies.select("rep", "sim")).unionByName(shingle_candidates(bodies)).distinct(), "residue-pairs")
    edges = stage(verified(near, df, key, text), "residue-edges")
    linked = connected_components(edges, "a", "b")
    placed = stage(bodies.select("body", "rep", "rank").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("body", "rank", F.coalesce("component", "rep").alias("component")), "residue-placed")
    trusted = placed.where("rank > 0").groupBy("component").agg(F.max("rank").alias("top"))
    pages = prep.where("hinted").select("body", "raw").distinct().join(placed.select("body", "component"), "body").groupBy("component").agg(F.countDistinct("raw").alias("forms")).where(F.col("forms") >= FORMS)
    labelled = trusted.unionByName(pages.select("component", F.lit(3).alias("top"))).groupBy("component").agg(F.max("top").alias("top"))
    members = placed.join(labelled, "component").select("body", "component", "top")
    own = prep.groupBy("doc", "body").agg(F.max(rank).alias("own"), F.max("open").alias("open"))
    kept = own.join(members, "body").where("top > 1 or own = 1 or open")
    return kept.select("doc", "component", F.element_at(F.array(F.lit("slot"), F.lit("filler"), F.lit("message")), F.col("top")).alias("label"), (F.col("own") > 0).alias("direct"))
