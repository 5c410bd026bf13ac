"""Finding and restoring text that was decoded with the wrong encoding (problem 9).

A text is cut into segments (sentences and lines), because often only part of it was misread. Segments whose characters
look out of place are the start of a best-first search: the state is a string, the moves are "encode with X, decode with
Y" and the unescaping of entities and escapes, visited strings are kept in a hash set, and the priority is a plausibility
cost of the characters in their context plus a price per move. The cheapest reachable string replaces the segment if it
is clearly better than what was there. The search has no limit of states or depth: runs of UTF-8 and escapes get shorter
with every move, two other decodings never follow one another (together they are one), so there are finitely many
strings; and a state is opened only while its price leaves room for a cheaper string behind it.

The cost knows no dictionary. It looks at what stands next to what: symbols inside words, capitals after small letters,
rows of accented letters, C1 controls, U+FFFD, punctuation in places where it does not belong, mixed scripts. Rare but
rightly decoded characters are cheap in their natural places.

What letters stand side by side in the language of a text is learnt from the corpus: pairs of characters are counted over
all documents, and pairs that hardly any document has make a string dearer. Garbled documents are few, so their pairs are.

A garbled sequence that stands alone between quotes or backticks is a quotation and does not count.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.tokens import spread

MOVE_PRICE = 0.4
#: Least cost at which a segment is looked into, and the least gain of a repair.
SUSPICIOUS = 1.9
LEAST_GAIN = 1.5
#: Cost of a character that was lost (U+FFFD).
LOST_COST = 5.0

_WESTERN = set("äöüßéèêëàâçîïôûùœæñáíóúãõòìÿ")
_CENTRAL = set("ąćęłńóśźżčšžřěůýďťňőűăâîșțşţđ")
_NORDIC = set("åøæðþ")
_HOME = _WESTERN | _CENTRAL | _NORDIC
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_OPENING, _CLOSING, _INSIDE = set("“‘„«‹¿¡([{"), set("”’»›…“‘"), set("’·‐‑ʼ´")
#: Signs that stand on their own, between spaces or digits.
_SIGNS = set("–—•→←↑↓⇒≤≥≠≈×÷±°µ§¶©®™€£¥¢¤²³¹½¼¾✓✔✗∀∃∈∨∧¬∞∑√·†‡…№‰")


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """Class of a character: a/A small or capital ASCII letter, l/L other Latin, c/C Cyrillic, q rare Cyrillic small,
    Q rare Cyrillic capital, o opening, e closing, s sign, b box drawing, x control, f replacement, j CJK and other
    scripts, 0 digit, ' ' blank, . ASCII punctuation, y other symbol."""
    o = ord(c)
    if o < 128:
        if c.isalpha():
            return "a" if c.islower() else "A"
        return "0" if c.isdigit() else " " if c.isspace() else "x" if o < 32 or o == 127 else "."
    if c == "\ufffd":
        return "f"
    if 0x80 <= o < 0xA0:
        return "x"
    if o in (0xA0, 0x202F, 0x2009, 0x200B, 0xFEFF, 0x3000):
        return " "
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0x400 <= o < 0x530:
        low = c.lower()
        home = low in _RUSSIAN
        return ("c" if home else "q") if c.islower() else ("C" if home else "Q")
    if c in _SIGNS:
        return "s"
    if c in _OPENING or c in _CLOSING:
        return "p"
    if 0xC0 <= o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "l" if c.islower() else "L" if c.isupper() else "y"
    if 0x370 <= o < 0x400:
        return "g"
    if 0xFF61 <= o < 0xFFA0:
        return "k"
    category = unicodedata.category(c)
    if category in ("Cn", "Co"):
        return "x"
    if category[0] in "LM":
        return "j"
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "j"
    return "y"


_WORD = set("aAlL")
_NON_ASCII = re.compile(r"[^\x00-\x7f]|[\x01-\x08\x0b\x0e-\x1f]")


def cost(text: str) -> float:
    """How implausible the non-ASCII characters of a text are, in sum; 0 for ASCII."""
    total = 0.0
    n = len(text)
    for m in _NON_ASCII.finditer(text):
        i = m.start()
        c = text[i]
        k = _kind(c)
        before = _kind(text[i - 1]) if i else " "
        after = _kind(text[i + 1]) if i + 1 < n else " "
        if k == "f":
            total += LOST_COST
        elif k == "x":
            total += 4.0
        elif k == "l":
            total += 0.05 if c in _HOME else 1.2
            if before in "lL" and after in "lL":
                total += 1.6
            elif before in "cqCQjgk" or after in "cqCQjgk":
                total += 1.5
            if before not in _WORD and after not in _WORD:
                if before in " ." and after in " ." and c in "àéèyóíeaouüæåøö" and c in "àéó":
                    total += 0.4
                else:
                    total += 2.5
            elif before == " " and after in "a" and c in "ìîòùûïëäáâæñýæÿ":
                nxt = text[i + 1]
                total += 1.0 if nxt in "aeiouy" or c in "ìòùûïëñ" else 0.3
            elif after in " ." and before == "a" and c in "îìñâêôûüöïëäçæåõãíóú":
                total += {"î": 1.2, "ì": 1.2, "ñ": 1.5, "ç": 1.2, "ï": 1.2, "ë": 0.6}.get(c, 0.1)
            if (c == "œ" and after == "a" and text[i + 1] not in "uits") or (c == "æ" and after in " .lL"):
                total += 1.1
            if c in "ñç" and after == "a" and text[i + 1] in "bcdfghjklmnpqrstvwxz":
                total += 1.5
            if before == "0" or after == "0":
                total += 2.0
        elif k == "L":
            low = c.lower()
            total += (0.05 if before in "AL" or after in "AL" else 0.2) if low in _HOME else 1.2
            if c == "Œ" and after == "a" and text[i + 1] not in "uits":
                total += 1.1
            if before in "al":
                total += 3.5
            elif before in "lL" and after in "lL":
                total += 0.1 if before == "L" and after == "L" else 1.2
            if before in "cqCQj" or after in "cqCQj":
                total += 1.5
            if after in "s0xfby":
                total += 2.5
            elif before not in _WORD and after not in _WORD:
                total += 0.1 if before in " .p" and after in " .p" and c in "ÀÉÂÃÕÓØÅÄÖÜ" else 2.0
            if before == "0":
                total += 2.0
        elif k in "cC":
            total += 0.01
            if k == "C" and before in "cqal":
                total += 3.0
            if before in "alsLAk" or after in "alLsAk" or after in "xbf":
                total += 1.5
            if k == "C" and after in "pys":
                total += 1.5
        elif k in "qQ":
            total += 1.6
            if before in _WORD or after in _WORD:
                total += 1.5
            if k == "Q" and before in "cq":
                total += 2.0
            if after in "pysxb" or before in "pysxb":
                total += 1.0
        elif k == "g":
            total += 0.4 if before in "g " and after in "g ." else 2.0
        elif k == "p":
            total += 0.1
            if before in "lLsxbyfcCqQ" and after in "lLsxbyfcCqQp":
                total += 2.0
            elif before in _WORD and after in _WORD and c != "’":
                total += 3.0
            elif before in "lLsyxbf" and before not in "l":
                total += 1.5
            elif c in "“‘„«‹¿¡" and before in "aAl0" and after in " " and c not in "“‘":
                total += 2.5
            elif c in "¿¡" and after not in "aAlLpcC ":
                total += 2.5
            elif c in "”’»" and before == " " and after in _WORD:
                total += 1.0
            elif c in "„‚" and before in "al":
                total += 2.5
            elif c == "…" and before in "al" and after in "al":
                total += 2.5
        elif k == "s":
            total += 0.15
            if before in _WORD and after in _WORD:
                total += 3.5
            elif before in "lLbxf" or after in "lbxf":
                total += 2.5
            elif before in "cCqQ" or after in "cCqQ":
                total += 2.0
            elif c not in "©®™…°²³¹•" and before in _WORD:
                total += 2.2
            elif c not in "µ£€¥¢¬√∞→•§©✓" and after in _WORD and not (c == "°" and text[i + 1] in "CFKcfk"):
                total += 2.2
            elif before in "sp" and before != " " and c != text[i - 1]:
                total += 1.0
            if c in "∞∑√≈÷" and before in "0" and after in _WORD:
                total += 2.5
            if c == "∞" and before in "0 " and after in _WORD:
                total += 1.5
        elif k == "b":
            total += 0.05
            if before in "aAlL0cCsyp." or after in "aAlL0cCsyp":
                total += 2.5
        elif k == "k":
            total += 2.0
        elif k == "j":
            total += 0.02
            if before in "lLsxfby":
                total += 1.0
            if before in _WORD or after in _WORD:
                total += 2.0
        elif k == "y":
            if c in "ˆ˜¨¯´¸˙˚˛˝ˇ˘ªº¦\xad‚":
                total += 1.0
                if before in _WORD or after in _WORD:
                    total += 2.0 if not (c in "ªº" and before in "0.") else 0.0
            else:
                total += 0.6
                if before in _WORD and after in _WORD:
                    total += 2.5
            if before in "lLsxfb" or after in "lsxfb":
                total += 1.5
    return total


def _sloppy(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte -> character of a single-byte encoding, undefined bytes as Latin-1 (as browsers and many tools read them)."""
    forward = {}
    for b in range(256):
        try:
            forward[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            forward[b] = chr(b)
    return forward, {c: b for b, c in reversed(forward.items())}


SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1254", "iso8859_15", "mac_latin2", "cp852", "iso8859_5", "cp775", "koi8_u")
#: Encodings that a wrongly read text is looked up in as the one it was read with, and the one it was written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp852", "iso8859_15")
WRITTEN_IN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp852")
MULTI = ("euc_jp", "cp932", "gb18030")
_TABLES = {n: _sloppy(n) for n in SINGLE}
#: Characters that an encoding has besides ASCII, and what they become when their bytes are read as another's.
_CHARS = {n: frozenset(c for c in _TABLES[n][1] if ord(c) > 127) for n in READ_AS}
_EXCHANGE = {(n, m): {ord(c): _TABLES[m][0][_TABLES[n][1][c]] for c in _CHARS[n]} for n in READ_AS for m in WRITTEN_IN if n != m}
_RUN = re.compile(r"[^\x00-\x7f]+")
#: CJK characters, and those that touch a Latin letter: where these are many, the reading is wrong.
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_MIXED_CJK = re.compile(r"(?<=[A-Za-z\u00c0-\u024f])[\u3040-\u9fff\ue000-\uf8ff]|[\u3040-\u9fff\ue000-\uf8ff](?=[A-Za-z\u00c0-\u024f])")
_ENTITY = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ESCAPE = re.compile(r"(?:\\u00[0-9a-fA-F]{2}|\\x[89a-fA-F][0-9a-fA-F]|\\u20[0-9a-fA-F]{2}|\\u0[1-4][0-9a-fA-F]{2})+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")


_LONGER = re.compile(r"[^\x00-\x7f]{2,}")  # UTF-8 has no shorter runs


@lru_cache(maxsize=200_000)
def _utf8_run(run: str, name: str) -> str:
    """A run of non-ASCII characters read as UTF-8 through this encoding, or as it is. Bytes that were lost leave U+FFFD, if
    most of the run makes sense."""
    back = _TABLES[name][1]
    try:
        raw = bytes([back[c] for c in run])
    except KeyError:
        return run
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out = raw.decode("utf-8", "replace")
        return run if out.count("\ufffd") * 2 > len(out) else out


def _utf8_runs(text: str, name: str) -> str | None:
    """The text with each run so read; None if nothing changed."""
    out = _LONGER.sub(lambda m: _utf8_run(m.group(), name), text)
    return out if out != text else None


#: A lead byte whose continuation byte became a blank: pairs like "Ã " (U+00E0) are joined first. The byte 9D has no
#: character in the usual Western encoding and got lost: "â€" before the end of a word was a closing quotation mark.
_NBSP_LOST = re.compile(r"([ÃÂ]) (?=[^\x00-\x7f]|[a-zA-Z,.;:)\s]|$)")
_QUOTE_LOST = re.compile(r"â€(?=[\s.,;:!?)\]]|$)")


def moves(text: str, exchange: bool = True) -> Iterator[tuple[str, str]]:
    """(name of the move, resulting text) for every applicable move; without ``exchange`` only those that shorten runs and
    escapes."""
    runs = _RUN.findall(text)
    chars = set("".join(runs))
    for name in READ_AS if any(len(r) > 1 for r in runs) else ():
        out = _utf8_runs(text, name)
        if out is not None:
            yield f"{name}>utf-8", out
    filled = _QUOTE_LOST.sub("â€\x9d", _NBSP_LOST.sub("\\1\xa0", text))
    if filled != text:
        out = _utf8_runs(filled, "cp1252")
        if out is not None:
            yield "cp1252>utf-8", out
    if _ENTITY.search(text):
        out = html.unescape(text)
        if out != text:
            yield "entities", out
    if _ESCAPE.search(text):
        out = _ESCAPE.sub(lambda m: re.sub(r"\\[ux]([0-9a-fA-F]+)", lambda x: chr(int(x.group(1), 16)), m.group()), text)
        if out != text:
            yield "escapes", out
    if _PERCENT.search(text):
        out = _PERCENT.sub(lambda m: unquote_to_bytes(m.group()).decode("utf-8", "replace"), text)
        if out != text and "\ufffd" not in out:
            yield "percent", out
    if not exchange or not runs:
        return
    for name in ("latin-1", "cp1252"):
        if not _CHARS[name].issuperset(chars):
            continue
        raw = bytes(_TABLES[name][1][c] if ord(c) > 127 else ord(c) for c in text)
        for multi in MULTI:
            try:
                out = raw.decode(multi)
            except UnicodeDecodeError:
                try:
                    out = raw.decode(multi, "replace")
                except UnicodeDecodeError:
                    continue
                if out.count("\ufffd") > 1 + len(out) // 30:
                    continue
            if out != text and len(_MIXED_CJK.findall(out)) * 5 <= len(_CJK.findall(out)):
                yield f"{name}>{multi}", out
    for name in READ_AS:
        if _CHARS[name].issuperset(chars):
            for target in WRITTEN_IN:
                if target != name:
                    out = text.translate(_EXCHANGE[name, target])
                    if out != text:
                        yield f"{name}>{target}", out


_UNESCAPE = frozenset(("entities", "escapes", "percent"))


def _exchanged(name: str) -> bool:
    """Whether a move exchanges one reading of the bytes for another of about the same length."""
    return ">" in name and not name.endswith(">utf-8")


#: Characters whose pairs are learnt: letters of the alphabetic scripts and common signs. At most so many squared pairs.
_LEARNT = "\\x20-\\x7E\\u00A0-\\u052F\\u2010-\\u203A\\u20AC\\u2122"
_LEARNT_PAIR = re.compile(f"(?=([\u0080-\u052f\u2010-\u203a\u20ac\u2122][{_LEARNT}]|[{_LEARNT}][\u0080-\u052f\u2010-\u203a\u20ac\u2122]))")
PAIR_WEIGHT = 0.25


class Pairs:
    """How unusual pairs of characters are: 0 for those in about ``n ** 0.4`` of ``n`` documents or more, PAIR_WEIGHT
    more with every power of ten below that. Without documents all pairs are alike."""

    def __init__(self, documents: dict[str, int] | None = None, n: int = 0) -> None:
        self.most = PAIR_WEIGHT * 0.4 * math.log10(n + 1) if documents else 0.0
        self.dear = {p: max(0.0, self.most - PAIR_WEIGHT * math.log10(c + 1)) for p, c in (documents or {}).items()}

    def cost(self, text: str) -> float:
        return sum(self.dear.get(p, self.most) for p in _LEARNT_PAIR.findall(text)) if self.most else 0.0


NO_PAIRS = Pairs()


def learn_pairs(df: DataFrame, text: str) -> Pairs:
    """Counts of documents by pair of neighbouring characters, over all rows; the driver gets one number per pair of an
    alphabet of fixed size."""
    pair = f"(?=([\\u0080-\\u052F\\u2010-\\u203A\\u20AC\\u2122][{_LEARNT}]|[{_LEARNT}][\\u0080-\\u052F\\u2010-\\u203A\\u20AC\\u2122]))"
    rows = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    each = rows.select(F.array_distinct(F.regexp_extract_all("t", F.lit(pair), F.lit(1))).alias("p"))
    counts = each.select(F.explode(F.array_append("p", F.lit(""))).alias("p")).groupBy("p").count()
    found = {r.p: r["count"] for r in counts.collect()}
    n = found.pop("", 0)
    return Pairs(found, n)


def repair_segment(text: str, pairs: Pairs = NO_PAIRS) -> tuple[str, tuple[str, ...], float]:
    """Best-first search from ``text``: (cheapest text, the moves to it, gain). No moves if nothing is clearly better.

    ``lost`` among the moves says that the cheapest text that can be reached still has U+FFFD in it.
    """
    start = cost(text)
    escaped = bool(_ENTITY.search(text) or _ESCAPE.search(text) or _PERCENT.search(text))
    if start < SUSPICIOUS and not escaped:
        return text, (), 0.0
    best, best_path, best_value, gain = text, (), math.inf, 0.0
    seen = {text}
    # (priority, number, string, moves, whether one of them reads bytes, cost and value of what the string is compared with: the
    # text without its escapes)
    heap: list[tuple[float, int, str, tuple[str, ...], bool, float, float]] = [(start, 0, text, (), False, start, start + pairs.cost(text))]
    serial = 0

    def hopeless(state: str, n_moves: int, most: float) -> bool:
        """A string behind this one costs at least the moves to it, and U+FFFD does not go away again."""
        return MOVE_PRICE * (n_moves + 1) + LOST_COST * state.count("\ufffd") >= most

    while heap:
        _, _, state, path, read, base, base_value = heapq.heappop(heap)
        if (read or not escaped) and hopeless(state, len(path), min(best_value, base_value)):
            continue
        for name, out in moves(state, exchange=not path or not _exchanged(path[-1])):
            if out in seen:
                continue
            seen.add(out)
            c = cost(out)
            v = c + pairs.cost(out) + MOVE_PRICE * (len(path) + 1)
            serial += 1
            way = (*path, name)
            reads = read or ">" in name
            if not reads:  # only unescaped so far: what follows is compared with this
                heapq.heappush(heap, (v - 1.5, serial, out, way, False, c, v))
                continue
            if v < min(best_value, base_value) and base - c >= LEAST_GAIN and c <= 0.6 * base:
                best, best_path, best_value, gain = out, way, v, base - c
            # a whole run that reads as UTF-8 is hardly chance, so such a state is looked into first
            if not hopeless(out, len(way), min(best_value, base_value)):
                heapq.heappush(heap, (0.3 * v if name.endswith("utf-8") else v, serial, out, way, True, base, base_value))
    return best, (*best_path, "lost") if "\ufffd" in best else best_path, gain


_SEGMENT = re.compile(r"[^\n]*?(?:[.!?。！？](?=\s)|\n|$)|[^\n]+", re.S)
_QUOTED = re.compile(r"(?P<q>[`'\"“‘«])(?:[^\x00-\x7f\s]{1,8}|(?:&[A-Za-z]+;){1,4})[`'\"”’»]")
_WORTH = re.compile(r"[^\x00-\x7f]|&#?\w{2,30};|\\[ux][0-9a-fA-F]{2}|%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}")


def repair(text: str | None, pairs: Pairs = NO_PAIRS) -> tuple[str | None, list[str]]:
    """(restored text, distinct moves). A text that is not garbled comes back as it is, without moves.

    ``lost`` among the moves says that characters are gone (U+FFFD) and could not be regained: it is what the search comes
    to where every text within reach still has them. Null stays null.
    """
    if not text or not _WORTH.search(text):
        return text, []
    hidden: list[str] = []

    def hide(m: re.Match) -> str:
        hidden.append(m.group())
        return f"\x02{len(hidden) - 1}\x03"

    shown = _QUOTED.sub(hide, text)
    out, used = [], {}
    known: dict[str, tuple[str, tuple[str, ...], float]] = {}
    pos = 0
    while pos < len(shown):
        m = _SEGMENT.match(shown, pos)
        seg = m.group() if m and m.end() > pos else shown[pos]
        pos += len(seg)
        if _WORTH.search(seg):
            got = known.get(seg)
            if got is None:
                got = known[seg] = repair_segment(seg, pairs)
            for p in got[1]:
                used[p] = True
            out.append(got[0])
        else:
            out.append(seg)
    fixed = "".join(out)
    if hidden:
        fixed = re.sub("\x02(\\d+)\x03", lambda m: hidden[int(m.group(1))] if int(m.group(1)) < len(hidden) else m.group(), fixed)
    return fixed, list(used)


def repair_column(df: DataFrame, key: str, text: str, pairs: Pairs | None = None) -> DataFrame:
    """``key``, ``restored`` and ``moves`` of every row whose text is garbled. ``pairs`` are learnt from the rows if not given.

    Null, empty and rightly decoded texts give no row. Repeated rows give repeated rows. Texts are read whole, however
    long; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(learn_pairs(df, text) if pairs is None else pairs)
    # nothing but these can begin a repair; the test runs in the JVM
    slim = df.select(df[key].alias("key"), df[text].alias("text"))
    slim = spread(slim).where(slim["text"].rlike(r"[^\x00-\x7F]|&#?\w{2,30};|\\[ux][0-9a-fA-F]{2}|%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, used = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fixed, how = repair(t, shared.value)
                if how:
                    keys.append(k)
                    texts.append(fixed)
                    used.append(how)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(texts, pa.string()), pa.array(used, pa.list_(pa.string()))], ["key", "restored", "moves"])

    return slim.mapInArrow(run, f"key {kind}, restored string, moves array<string>").withColumnRenamed("key", key)
